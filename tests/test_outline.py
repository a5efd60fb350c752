import random

import pytest
from pyspark.sql import functions as F

from sheafline.operators import labels as lb
from sheafline.operators import ordering as od
from sheafline.operators import outline as ol

SCHEMA = "doc_id bigint, line_no bigint, page int, y_center double, label string, text string, font_size double, font_name string, x0 double, y0 double, x1 double, y1 double, x_center double"
LEVELS = ["title", "H1", "H2", "H3", "H4"]


def rows_of(rng, doc, n):
    return [
        (
            doc, i, rng.randint(1, 3), float(rng.randint(0, 9)), rng.choice([*LEVELS, "Body", "Other"]),
            rng.choice(["Intro", "intro", "Results ", "café", "é", "Method x"]) + rng.choice(["", " 1", " 2"]),
            rng.choice([12.0, 14.0, 20.0]), "F", 0.0, 0.0, 1.0, 1.0, 0.5,
        )
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    return [r for doc in range(8) for r in rows_of(rng, doc, 60)]


def in_order(rows, doc):
    return sorted((r for r in rows if r[0] == doc), key=lambda r: (r[2], r[3], r[1]))


@pytest.mark.parametrize("limit", [10_000, 25])
def test_repair_equals_plain_loop(spark, data, limit):
    got = {
        (r["doc_id"], r["line_no"]): r["new_label"]
        for r in ol.repair_levels(spark.createDataFrame(data, SCHEMA), limit=limit).collect()
    }
    assert len(got) == len(data)
    for doc in range(8):
        before = 0
        for r in in_order(data, doc):
            if r[4] in LEVELS:
                level = min(LEVELS.index(r[4]), before + 1)
                assert got[doc, r[1]] == LEVELS[level]
                before = level
            else:
                assert got[doc, r[1]] == r[4]


@pytest.mark.parametrize("limit", [10_000, 12])
def test_outline_equals_plain_loop(spark, data, limit):
    got = ol.outline(spark.createDataFrame(data, SCHEMA), limit=limit).collect()
    for doc in range(8):
        mine = sorted((r for r in got if r["doc_id"] == doc), key=lambda r: r["seq"])
        assert [r["seq"] for r in mine] == list(range(1, len(mine) + 1))
        want, seen, before = [], set(), None
        for r in in_order(data, doc):
            clean = "".join(c for c in " ".join(r[5].split()) if " " <= c <= "~")
            if r[4] not in LEVELS[1:] or not clean or clean in seen:
                continue
            level = "H2" if before == "H1" and r[4] == "H3" else r[4]
            want.append((level, clean, r[2]))
            seen.add(clean)
            before = level
        assert [(r["level"], r["text"], r["page"]) for r in mine] == want


def test_small_chunks_need_no_partitions_of_their_own(spark, data):
    """Chunks of at most ``limit`` rows, ascending in reading order, in no more partitions than the rows need."""
    rows, spans = od.chunked(spark.createDataFrame(data, SCHEMA), ["doc_id"], list(od.READING_ORDER), limit=2)
    assert spans and rows.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.groupBy(od.CHUNK).count().agg(F.max("count")).first()[0] <= 2
    for doc in range(8):
        mine = sorted((r for r in rows.collect() if r["doc_id"] == doc), key=lambda r: (r["page"], r["y_center"], r["line_no"]))
        assert [r[od.CHUNK] for r in mine] == sorted(r[od.CHUNK] for r in mine)


def test_ranged_repair_of_a_document_without_id(spark):
    levels = ["H4", "H4", "H4", "H1", "H3", "H2", "H4", "title", "H4"] * 4
    rows = [(None, i, 1, float(i), label, "x", 12.0, "F", 0.0, 0.0, 1.0, 1.0, 0.5) for i, label in enumerate(levels)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = {r["line_no"]: r["new_label"] for r in ol.repair_levels(df, limit=1000).collect()}
    assert {r["line_no"]: r["new_label"] for r in ol.repair_levels(df, limit=5).collect()} == plain


def test_invariants_on_the_blocks(spark):
    from sheafline.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    labelled = fx.labelled(spark, sf)
    out = ol.outline(labelled, largest=fx.largest_document(spark, sf))
    assert out.groupBy("doc_id", "text").count().filter("count > 1").count() == 0
    assert labelled.groupBy("label").count().agg(F.sum("count")).first()[0] == fx.blocks(spark, sf).count()
    assert not out.filter("text rlike '[^ -~]'").count()


def test_titles(spark):
    def row(doc, line, page, label, text, size, y):
        return (doc, line, page, y, label, text, size, "F", 0.0, y, 1.0, y + 1, 0.5)

    rows = [
        row(1, 1, 2, "title", "later", 30.0, 10.0), row(1, 2, 1, "title", "first", 20.0, 10.0),
        row(1, 3, 1, "title", "tie", 20.0, 500.0), row(2, 1, 3, "title", "only", 9.0, 10.0),
        row(3, 1, 1, "Body", "none", 9.0, 10.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["title"] for r in ol.doc_titles(df).collect()}
    assert got == {1: "first", 2: "only", 3: "Untitled Document"}
    nested = {r["doc_id"]: r for r in ol.nested_outline(ol.titled_outline(df)).collect()}
    assert nested[3]["outline"] == [] and nested[3]["title"] == "Untitled Document"


@pytest.mark.parametrize("largest", [None, 100])
def test_uniform_rules_stop_at_their_branch(spark, largest):
    cases = [
        ("Chapter one of the long long long book", True, False, "H1"), ("ALL CAPS HERE", True, False, "H1"),
        ("plain", True, True, "H2"), ("a b c d e f g h", False, True, "H3"),
        ("a b c d e f g h i how to", False, True, "Body"), ("Short sentence", False, False, "H3"),
        ("How to do this with more than six words", False, False, "Body"),
        ("how to do this with more than six words", False, False, "H2"), ("nothing", False, False, "Body"),
    ]
    rows = [(1, i, t, b, it, 12.0, "Body") for i, (t, b, it, _) in enumerate(cases)] + [
        (1, 99, "Kept", True, False, 12.0, "title"), (2, 1, "Short sentence", False, False, 10.0, "Body"),
        (2, 2, "x", False, False, 12.0, "Body"),
    ]
    df = spark.createDataFrame(
        rows, "doc_id bigint, line_no bigint, text string, is_bold boolean, is_italic boolean, font_size double, label string"
    )
    got = {(r["doc_id"], r["line_no"]): r["label"] for r in lb.with_uniform_relabel(df, largest=largest).collect()}
    assert [got[1, i] for i in range(len(cases))] == [c[3] for c in cases]
    assert got[1, 99] == "title" and got[2, 1] == "Body"


def test_categories_match_inside_words(spark):
    df = spark.createDataFrame([("Multipage",), ("Embargo",), ("Plain",)], "t string")
    got = df.select(lb.category(F.col("t")).alias("c")).select("c", lb.importance(F.col("c")).alias("i")).collect()
    assert [tuple(r) for r in got] == [("tips", 4), ("entertainment", 5), ("other", 99)]


@pytest.mark.parametrize("largest", [None, 100])
def test_rule_labels_with_and_without_a_bound(spark, data, largest):
    df = spark.createDataFrame(data, SCHEMA).drop("label").withColumn("weight", F.lit(700))
    got = lb.with_rule_labels(df, largest=largest).groupBy("label").count().collect()
    want = lb.with_rule_labels(df, largest=100).groupBy("label").count().collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}


def test_documents_whose_levels_were_repaired(spark):
    rows = spark.createDataFrame(
        [(1, "H1", "H1"), (1, "H4", "H2"), (2, "H1", "H1"), (3, None, None), (None, "H2", "H1")],
        "doc_id bigint, label string, new_label string",
    )
    got = {r["doc_id"]: r["modified"] for r in ol.modified_documents(rows).collect()}
    assert got == {1: True, 2: False, 3: False, None: True}


def test_headings_are_made_once_for_ranges(spark, data):
    """The ranges are counted and sampled on stored headings, so the plan of the rest holds no regular expression of theirs."""
    heads = ol.first_headings(spark.createDataFrame(data, SCHEMA))
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    counted = heads.mapInPandas(count, heads.schema)
    n = heads.count()
    ol.fix_skips(counted, limit=12).collect()
    assert made.value == n
