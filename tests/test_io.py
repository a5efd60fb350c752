import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from sheafline.operators import encoders as en
from sheafline.sources import blocks_json as bj
from sheafline.sources import pages as pg
from sheafline.sources import requests as rq
from sheafline.sources import spans as sp
from sheafline.sources import tabular as tb

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def block(text, page=1):
    return {
        "page": page, "text": text, "font_size": 12.0, "font_name": "A-Bold", "bbox": [0, 1, 2, 3],
        "x_center": 1.0, "y_center": 2.0, "Font": {"weight": 700}, "attributes": {"TextAlign": "Left"},
    }


def test_folder_of_documents(spark, tmp_path):
    (tmp_path / "Weekly Plan - 1_classified.json").write_text(json.dumps([block("aé"), block("b")], indent=2))
    (tmp_path / "two.json").write_text(json.dumps([]))
    (tmp_path / "three.json").write_text(json.dumps([block("c")]))
    (tmp_path / "bad.json").write_text('{"not": "a list"}')
    (tmp_path / "worse.json").write_text("[{")
    (tmp_path / "tail.json").write_text(json.dumps([block("t")]) + " and more")
    (tmp_path / "x_outline.json").write_text(json.dumps([block("skip")]))
    (tmp_path / "note.txt").write_text("[]")
    blocks, broken = bj.read_blocks(spark, str(tmp_path))
    got = sorted((r["document"], r["line_no"], r["text"]) for r in blocks.collect())
    assert got == [("Weekly Plan - 1", 1, "aé"), ("Weekly Plan - 1", 2, "b"), ("three", 1, "c")]
    assert {"bad", "worse", "tail"} <= {r["document"] for r in broken.collect()}
    assert {r["doc_id"] for r in blocks.collect()} == {"Weekly Plan - 1", "three"}
    flat = bj.with_box_columns(blocks).filter("text = 'c'").first()
    assert (flat["x1"], flat["y1"], flat["weight"]) == (2.0, 3.0, 700)


def test_names(spark):
    df = spark.createDataFrame([("a.pdf",)], "n string")
    assert df.select(bj.derived_name(F.col("n"), "_classified.json")).first()[0] == "a_classified.json"


def test_request_file(spark, tmp_path):
    path = tmp_path / "request.json"
    path.write_text(json.dumps({
        "documents": [{"filename": "a.pdf", "title": "A"}, {"filename": "", "title": "none"}, {"filename": "b.pdf", "title": "B"}],
        "persona": {"role": "cook"}, "job_to_be_done": {"task": "plan"},
    }, indent=1))
    got = rq.explode_manifest(rq.read_requests(spark, str(path))).orderBy("doc_ord").collect()
    assert [(r["doc_ord"], r["filename"], r["persona"], r["task"]) for r in got] == [
        (0, "a.pdf", "cook", "plan"), (2, "b.pdf", "cook", "plan")
    ]


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'quote " and, comma', 1.5), (2, "two\nlines", None)]
    tb.write_csv(spark.createDataFrame(rows, "i int, t string, x double"), str(tmp_path / "c"))
    back = tb.read_csv(spark, str(tmp_path / "c"), "i int, t string, x double").orderBy("i").collect()
    assert [tuple(r) for r in back] == rows


def test_spans_keep_text_blocks_and_first_style(spark):
    schema = "doc_id bigint, page int, block int, block_type int, line int, span_no int, text string, size double, font string, x0 double, y0 double, x1 double, y1 double"
    box = (0.0, 1.0, 2.0, 3.0)
    rows = [
        (1, 1, 0, 0, 0, 1, " world ", 20.0, "B", *box), (1, 1, 0, 0, 0, 0, "hello ", 12.345, "A", *box),
        (1, 1, 0, 0, 1, 0, "  ", 12.0, "A", *box), (1, 1, 1, 1, 0, 0, "image", 12.0, "A", *box),
    ]
    got = sp.lines_from_spans(spark.createDataFrame(rows, schema)).collect()
    assert [(r["text"], r["font_name"]) for r in got] == [("hello world", "A")]


def test_spans_in_any_order_give_the_same_lines(spark):
    schema = "doc_id bigint, page int, block int, block_type int, line int, span_no int, text string, size double, font string, x0 double, y0 double, x1 double, y1 double"
    words = [(d, 1, 0, 0, line, n, None if n == 3 else f" w{d}{line}{n} ", 9.0 + n, f"F{n}", 0.0, 1.0, 2.0, 3.0)
             for d in (1, 2, None) for line in range(7) for n in range(5)]
    words += [(3, 1, 0, 0, 0, None, "b", 1.0, "X", 0.0, 1.0, 2.0, 3.0), (3, 1, 0, 0, 0, None, "a", 1.0, "Y", 0.0, 1.0, 2.0, 3.0)]
    want = {(d, line, " ".join(f"w{d}{line}{n}" for n in (0, 1, 2, 4)), 9.0, "F0") for d in (1, 2, None) for line in range(7)}
    want.add((3, 0, "a b", None, None))
    for rows in (words, words[::-1], sorted(words, key=lambda r: (str(r[5]), r[4], str(r[0])))):
        got = sp.lines_from_spans(spark.createDataFrame(rows, schema).coalesce(2)).collect()
        assert len(got) == len(want)
        assert {(r["doc_id"], r["line"], r["text"], r["font_size"], r["font_name"]) for r in got} == want
    assert sp.lines_from_spans(spark.createDataFrame([], schema)).count() == 0


def test_spans_are_put_together_before_the_shuffle(spark):
    """One row a line is sorted and shuffled, not one a span."""
    schema = "doc_id bigint, page int, block int, block_type int, line int, span_no int, text string, size double, font string, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, 1, 0, 0, i // 50, i % 50, "w", 9.0, "F", 0.0, 1.0, 2.0, 3.0) for i in range(1000)]
    spans = spark.createDataFrame(rows, schema).coalesce(1)
    assert sp._runs(spans, ("doc_id", "page", "block", "line")).count() == 20
    plan = sp.lines_from_spans(spans)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Exchange") < plan.index("MapInArrow")
    assert "Aggregate" not in plan[plan.index("Exchange") :]


def read_words(name, content):
    if b"broken" in content:
        raise ValueError(name)
    for i, w in enumerate(content.decode().split()):
        yield {"document": name, "page": 1, "block": 0, "block_type": 0, "line": 0, "span_no": i, "text": w, "size": 12.0}


def test_bytes_through_a_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"some words here")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    rows = sp.parse_files(spark, str(tmp_path), read_words)
    lines = sp.lines_from_spans(rows, ("document", "page", "block", "line")).collect()
    assert [(r["document"], r["text"]) for r in lines] == [("a.pdf", "some words here")]
    failed = sp.failed_files(spark, str(tmp_path), read_words).collect()
    assert [(r["file"], r["error"]) for r in failed] == [("b.pdf", "ValueError: b.pdf")]


def test_page_text_goes_on_over_inline_tags(spark):
    html = "<title>T</title><script>var p = '<p>no</p>';</script><ul><li><a href='#'>one</a> two</li></ul><p>x <b>y</b> z</p><pre>q</pre><link>"
    got = pg.blocks_from_pages(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("line_no").collect()
    assert [(r["tag"], r["text"]) for r in got] == [("title", "T"), ("li", "one two"), ("p", "x y z")]


def load_length_model():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def load_shout_model():
    return lambda texts: [t.upper() for t in texts]


def test_plugged_models(spark):
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    got = df.select(en.encoder(load_length_model)("t").alias("v"), en.summarizer(load_shout_model)("t").alias("s")).collect()
    assert [(list(r["v"]), r["s"]) for r in got] == [([3.0, 1.0], "ABC"), ([0.0, 1.0], "")]


def test_hashed_vectors_count_tokens(spark):
    df = spark.createDataFrame([("a b a",), ("",)], "t string")
    got = [r["vector"] for r in en.encode_hashed(df, "t", size=64).collect()]
    assert sum(got[0]) == 3.0 and max(got[0]) == 2.0 and sum(got[1]) == 0.0


def test_stream_skips_what_it_has_seen(spark, tmp_path):
    from sheafline.streaming.incremental import incremental_classify

    def arrive(name, doc):
        lines = [{**block(f"Heading {doc}"), "font_size": 20.0}, block("body")]
        (tmp_path / "in" / name).write_text(json.dumps(lines))

    (tmp_path / "in").mkdir()
    paths = [str(tmp_path / p) for p in ("in", "out", "ck")]
    arrive("a.json", 1)
    incremental_classify(spark, *paths).awaitTermination()
    arrive("b.json", 2)
    (tmp_path / "in" / "cut.json").write_text('[{"text": "cut')
    incremental_classify(spark, *paths).awaitTermination()
    labels = spark.read.parquet(str(tmp_path / "out" / "labels"))
    assert sorted((r["doc_id"], r["batch"]) for r in labels.select("doc_id", "batch").distinct().collect()) == [("a", 0), ("b", 1)]
    assert labels.count() == 4
    outlines = spark.read.parquet(str(tmp_path / "out" / "outlines"))
    assert {r["doc_id"] for r in outlines.collect()} == {"a", "b"}
    broken = spark.read.parquet(str(tmp_path / "out" / "broken")).collect()
    assert [(r["document"], r["batch"]) for r in broken] == [("cut", 1)]
