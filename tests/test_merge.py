"""Folds against plain loops, on random pages, and the chunked path against the plain one."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sheafline.operators import encoders as en
from sheafline.operators import merge as mg

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = (
    "doc_id bigint, line_no bigint, page int, text string, font_size double, font_name string, weight int, "
    "x0 double, y0 double, x1 double, y1 double, x_center double, y_center double, label string"
)


def random_blocks(seed, docs=12, lines=25):
    rng = random.Random(seed)
    rows = []
    for doc in range(docs):
        y = 50.0
        for line in range(1, lines + 1):
            y += rng.choice([0.0, 8.0, 20.0, 30.0, 45.0, 60.0])
            size = rng.choice([12.0, 12.5, 18.0, 19.0, 20.0, 24.0])
            x0 = rng.choice([72.0, 150.0])
            x1 = x0 + rng.choice([200.0, 300.0])
            tall = rng.choice([size, size, 60.0])
            rows.append(
                (
                    doc, line, 1 + line // 13, f"t{line} w{rng.randint(0, 2)}", size,
                    rng.choice(["A-Bold", "A-Bold", "B"]), rng.choice([400, 700, 700]), x0, y, x1, y + tall,
                    (x0 + x1) / 2, (y + y + tall) / 2, rng.choice(["title", "H1", "Body"]),
                )
            )
    rng.shuffle(rows)
    return rows


def as_dicts(rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return [dict(zip(names, r)) for r in rows]


def union_box(a, b):
    a["x0"], a["y0"] = min(a["x0"], b["x0"]), min(a["y0"], b["y0"])
    a["x1"], a["y1"] = max(a["x1"], b["x1"]), max(a["y1"], b["y1"])
    a["x_center"], a["y_center"] = (a["x0"] + a["x1"]) / 2, (a["y0"] + a["y1"]) / 2
    a["text"] += " " + b["text"]


def greedy(rows, joins):
    groups = []
    for row in sorted(rows, key=lambda r: (r["page"], r["y_center"], r["line_no"])):
        if groups and joins(groups[-1], row):
            union_box(groups[-1], row)
        else:
            groups.append(dict(row))
    return groups


def plain_titles(rows):
    out = []
    for doc in {r["doc_id"] for r in rows}:
        mine = [r for r in rows if r["doc_id"] == doc]
        avg = sum(r["font_size"] for r in mine) / len(mine)
        for r in mine:
            r["ish"] = r["font_size"] >= avg + 4 and r["weight"] >= 700 and abs(r["x_center"] - 300) < 100
        out += greedy(
            mine,
            lambda g, n: g["ish"] and n["ish"] and g["page"] == n["page"] and g["font_name"] == n["font_name"]
            and 0 <= n["y0"] - g["y1"] <= 40 and abs(g["font_size"] - n["font_size"]) <= 1,
        )
    return out


def plain_blocks(rows):
    out = []
    for key in {(r["doc_id"], r["label"]) for r in rows}:
        mine = [r for r in rows if (r["doc_id"], r["label"]) == key]
        out += greedy(
            mine,
            lambda g, n: g["page"] == n["page"] and g["font_name"] == n["font_name"]
            and abs(g["font_size"] - n["font_size"]) <= 1 and abs(n["y_center"] - g["y_center"]) <= 50,
        )
    return out


def facts(rows):
    return sorted(((r["doc_id"], r["line_no"], r["text"], r["x0"], r["y0"], r["x1"], r["y1"], r["y_center"]) for r in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("limit", [None, 20])
def test_folds_equal_plain_loops(spark, seed, limit):
    rows = random_blocks(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    for job, plain in ((mg.merge_titles, plain_titles), (mg.merge_blocks, plain_blocks)):
        got = [r.asDict() for r in job(df, limit=limit or 10_000).collect()]
        assert facts(got) == facts(plain(as_dicts(rows)))
        assert sum(r["n_lines"] for r in got) == len(rows)


def test_one_hot_page_spans_chunks(spark):
    rows = random_blocks(9, docs=1, lines=400)
    rows = [(*r[:2], 1, *r[3:]) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert facts(r.asDict() for r in mg.merge_blocks(df, limit=60).collect()) == facts(plain_blocks(as_dicts(rows)))
    assert facts(r.asDict() for r in mg.merge_titles(df, limit=60).collect()) == facts(plain_titles(as_dicts(rows)))


def test_long_segments_go_line_by_line(spark, monkeypatch):
    monkeypatch.setattr(mg, "FOLD_ROWS", 2)
    rows = random_blocks(4)
    df = spark.createDataFrame(rows, SCHEMA)
    assert facts(r.asDict() for r in mg.merge_titles(df).collect()) == facts(plain_titles(as_dicts(rows)))
    assert facts(r.asDict() for r in mg.merge_blocks(df).collect()) == facts(plain_blocks(as_dicts(rows)))


@pytest.mark.parametrize("rows", [3, 7, 50])
def test_very_long_segments_go_in_chunks(spark, monkeypatch, rows):
    monkeypatch.setattr(mg, "FOLD_ROWS", 2)
    monkeypatch.setattr(mg, "CHUNK_ROWS", rows)
    lines = random_blocks(11, docs=3, lines=60)
    lines += [(None, *r[1:]) for r in random_blocks(12, docs=1, lines=60)]
    # One group over many chunks, and a drift where each chunk depends on the one before.
    lines += [(70, i, 1, str(i), 12.0, "A", 400, 0.0, 0.1 * i, 10.0, 0.1 * i + 1, 5.0, 0.1 * i, "Body") for i in range(40)]
    lines += [(71, i, 1, str(i), 12.0, "A", 400, 0.0, 30.0 * i, 10.0, 30.0 * i + 10, 5.0, 30.0 * i + 5, "Body") for i in range(60)]
    df = spark.createDataFrame(lines, SCHEMA).repartition(3)
    assert facts(r.asDict() for r in mg.merge_titles(df).collect()) == facts(plain_titles(as_dicts(lines)))
    assert facts(r.asDict() for r in mg.merge_blocks(df).collect()) == facts(plain_blocks(as_dicts(lines)))


@pytest.mark.parametrize("frame_rows", [1, 25, 10_000])
def test_short_chunks_share_frames(spark, monkeypatch, frame_rows):
    """Chunks of three lines, one a frame or many: the same groups, also of a document without an id."""
    monkeypatch.setattr(mg, "FRAME_ROWS", frame_rows)
    lines = random_blocks(13, docs=4, lines=40) + [(None, *r[1:]) for r in random_blocks(14, docs=1, lines=40)]
    df = spark.createDataFrame(lines, SCHEMA).repartition(3)
    assert facts(r.asDict() for r in mg.merge_blocks(df, chunk_rows=3).collect()) == facts(plain_blocks(as_dicts(lines)))


def column(spark, sizes, step=20.0):
    rows = [
        (1, i, 1, str(i), s, "A", 400, 0.0, step * i, 10.0, step * i + 10, 5.0, step * i + 5, "Body")
        for i, s in enumerate(sizes)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_size_is_held_against_the_head(spark):
    got = {r["text"] for r in mg.merge_blocks(column(spark, [20.0, 19.0, 18.0]), largest=3).collect()}
    assert got == {"0 1", "2"}


def test_growing_box_moves_the_centre(spark):
    got = sorted(r["text"] for r in mg.merge_blocks(column(spark, [12.0] * 8, 30.0), largest=8).collect())
    assert got == sorted(r["text"] for r in plain_blocks(as_dicts([tuple(r) for r in column(spark, [12.0] * 8, 30.0).collect()])))
    assert len(got) > 1


def test_weights_separate_lines_where_they_are_known(spark):
    df = column(spark, [12.0, 12.0]).withColumn("merge_weight", F.when(F.col("line_no") == 0, 400).otherwise(700))
    assert mg.merge_blocks(df, largest=2).count() == 2


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mg.merge_titles(df).count() == 0
    assert mg.merge_blocks(df).count() == 0


@pytest.mark.parametrize("limit", [None, 30])
def test_semantic_merge_equals_plain_loop(spark, limit):
    rng = random.Random(5)
    rows = []
    for r in random_blocks(4, docs=6, lines=30):
        words = rng.choice(["a b c d e", "a b c d", "x y z", "x y", "a x"])
        rows.append((*r[:3], words, *r[4:]))
    df = spark.createDataFrame(rows, SCHEMA)

    def counts(t):
        return {w: t.split().count(w) for w in t.split()}

    def similar(a, b):
        x, y = counts(a), counts(b)
        dot = sum(v * y.get(k, 0) for k, v in x.items())
        size = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        return dot / size > 0.8

    want = []
    dicts = as_dicts(rows)
    for key in {(r["doc_id"], r["page"], r["label"]) for r in dicts if r["label"] != "Body"}:
        mine = [r for r in dicts if (r["doc_id"], r["page"], r["label"]) == key]
        groups = []
        for row in sorted(mine, key=lambda r: (r["y_center"], r["line_no"])):
            if groups and similar(groups[-1]["text"], row["text"]):
                groups[-1]["text"] += " " + row["text"]
            else:
                groups.append(dict(row))
        want += groups
    want += [r for r in dicts if r["label"] == "Body"]
    got = en.merge_semantic(df, limit=limit or 10_000).collect()
    assert sorted((r["doc_id"], r["line_no"], r["text"]) for r in got) == sorted(
        (r["doc_id"], r["line_no"], r["text"]) for r in want
    )
    assert any(r["n_lines"] > 2 for r in got)


def test_semantic_runs_share_frames(spark):
    """Many runs go to one call of the fold and are still folded each by itself; large document numbers and nulls stay."""
    big = 2**60 + 1
    lines = [(doc, i, 1 + i // 2, "a b c", 12.0, "A", 400, 0.0, 0.0, 1.0, 1.0, 1.0, float(i), "H1") for doc in (big, big + 2, None) for i in range(8)]
    out = en.merge_semantic(spark.createDataFrame(lines, SCHEMA), limit=1000)
    assert "_call" in out._jdf.queryExecution().analyzed().toString()
    got = sorted(((r["doc_id"], r["line_no"], r["text"], r["n_lines"]) for r in out.collect()), key=str)
    assert got == sorted(((doc, i, "a b c a b c", 2) for doc in (big, big + 2, None) for i in (0, 2, 4, 6)), key=str)


def trigram_encoder():
    """Not additive: a joined text has trigrams that its parts do not have."""
    import numpy as np

    def encode(texts):
        out = np.zeros((len(texts), 16))
        for k, t in enumerate(texts):
            for i in range(len(t) - 2):
                out[k, sum(map(ord, t[i : i + 3])) % 16] += 1
        return out

    return encode


@pytest.mark.parametrize("call_rows", [5000, 20])
def test_dense_semantic_merge_equals_a_loop_that_encodes_again(spark, call_rows):
    rng = random.Random(6)
    rows = [(*r[:3], rng.choice(["a b c d e", "a b c d", "x y z", "x y z z", "a x"]), *r[4:]) for r in random_blocks(5, docs=6, lines=40)]
    rows += [(None, *r[1:]) for r in rows[:30]] + [(90, 1, 1, None, 12.0, "A", 400, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, "H1"), (90, 2, 1, "", 12.0, "A", 400, 0.0, 0.0, 1.0, 1.0, 1.0, 2.0, "H1")]
    model = trigram_encoder()

    def similar(a, b):
        x, y = model([a or "", b or ""])
        scale = (x @ x * (y @ y)) ** 0.5
        return scale > 0 and x @ y / scale > 0.8

    want, dicts = [], as_dicts(rows)
    for key in {(r["doc_id"], r["page"], r["label"]) for r in dicts if r["label"] != "Body"}:
        groups = []
        for row in sorted((r for r in dicts if (r["doc_id"], r["page"], r["label"]) == key), key=lambda r: (r["y_center"], r["line_no"])):
            if groups and similar(groups[-1]["text"], row["text"]):
                groups[-1]["text"] += " " + row["text"]
            else:
                groups.append(dict(row))
        want += groups
    want += [r for r in dicts if r["label"] == "Body"]
    got = en.merge_semantic_dense(spark.createDataFrame(rows, SCHEMA).repartition(3), trigram_encoder, call_rows=call_rows).collect()
    pick = lambda found: sorted(((r["doc_id"], r["line_no"], r["text"]) for r in found), key=str)
    assert pick(got) == pick(want) and any(r["n_lines"] > 2 for r in got)
