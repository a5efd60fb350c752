"""Blocks with any fields: read, header, flat columns, union, CSV."""

import json

from pyspark.sql import functions as F

from sheafline.operators import schemaless as sl
from sheafline.sources import blocks_json as bj
from sheafline.sources import tabular as tb


def flat_dict(d, parent=""):
    out = {}
    for k, v in d.items():
        name = f"{parent}_{k}" if parent else k
        if isinstance(v, dict):
            out.update(flat_dict(v, name))
        else:
            out[name] = v
    return out


DOCS = {
    "a_classified.json": [
        {"text": "one", "Font": {"weight": 700, "more": {"deep": {"er": 1.5}}}, "n": 1, "empty": {}, "list": [1, 2.5], "nothing": None},
        {"text": 2, "n": 2.5, "flag": True, "Font": "plain", "words": ["x", "y"], "rows": [{"a": 1}]},
        "no object",
        {"text": "three", "we'ird \"key\"": 1, "we'ird": 2, 'q"uote': 3, "dots.in $[0]": 4, "ünï": "ß", "doc_id": 77, "line_no": 9},
    ],
    "b.json": [{"extra": {"only": {"here": "yes"}}, "TEXT": "upper"}],
    "c.json": [],
}


def frames(spark, tmp_path):
    for name, blocks in DOCS.items():
        (tmp_path / name).write_text(json.dumps(blocks))
    (tmp_path / "bad.json").write_text('{"a": 1}')
    (tmp_path / "cut.json").write_text('[{"a": 1')
    return bj.read_any_blocks(spark, str(tmp_path))


def test_read_and_header(spark, tmp_path):
    blocks, broken = frames(spark, tmp_path)
    assert sorted((r["document"], r["doc_id"], r["line_no"]) for r in blocks.collect()) == [("a", "77", 9), ("a", "a", 1), ("a", "a", 2), ("b", "b", 1)]
    assert sorted((r["document"], r["value"]) for r in broken.collect()) == [("a", '"no object"'), ("bad", '{"a": 1}'), ("cut", '[{"a": 1')]
    names = {"_".join(r["path"]) for r in sl.field_kinds(blocks).collect()}
    want = set().union(*(flat_dict(b) for held in DOCS.values() for b in held if isinstance(b, dict)))
    assert names == want
    assert set(sl.Fields.of(blocks).header()) - {"text_nested", "doc_id_nested", "line_no_nested"} == (want | {"label"}) - {"text", "doc_id", "line_no"}


def test_flat_columns(spark, tmp_path):
    blocks, _ = frames(spark, tmp_path)
    fields = sl.Fields.of(blocks)
    kinds = {name: kind for name, (_, kind) in fields.columns.items()}
    assert kinds["n"] == "double" and kinds["flag"] == "boolean" and kinds["list"] == "array<double>" and kinds["words"] == "array<string>"
    assert kinds["text_nested"] == "variant" and kinds["TEXT"] == "string" and kinds["Font_more_deep_er"] == "double" and kinds["Font"] == "string"
    rows = {(r["doc_id"], r["line_no"]): r for r in sl.flatten_any(blocks, fields).withColumn("text_nested", F.to_json("text_nested")).withColumn("rows", F.to_json("rows")).collect()}
    first, second, third, other = (rows[k] for k in (("a", 1), ("a", 2), ("77", 9), ("b", 1)))
    assert (first["text_nested"], first["n"], first["Font"], first["Font_weight"], first["Font_more_deep_er"]) == ('"one"', 1.0, None, 700, 1.5)
    assert (second["text_nested"], second["Font"], second["Font_weight"], second["rows"]) == ("2", "plain", None, '[{"a":1}]')
    assert [third[k] for k in ("we'ird \"key\"", "we'ird", 'q"uote', "dots.in $[0]", "ünï", "doc_id_nested")] == [1, 2, 3, 4, "ß", 77]
    assert other["extra_only_here"] == "yes" and other["TEXT"] == "upper" and other["n"] is None


def test_one_name_from_two_paths(spark):
    fields = sl.Fields([(("a", "b"), "BIGINT"), (("a_b",), "BIGINT"), (("A_b",), "STRING")])
    assert fields.columns == {"A_b": ([("A_b",)], "string"), "a_b_nested": ([("a_b",), ("a", "b")], "bigint")}
    df = spark.sql("""select parse_json(v) as block from values ('{"a_b": 1, "a": {"b": 2}}'), ('{"a": {"b": 3}}'), ('{"A_b": "x"}') t(v)""")
    got = sl.flatten_any(df, fields).collect()
    assert [(r["a_b_nested"], r["A_b"]) for r in got] == [(1, None), (3, None), (None, "x")]


def test_union_and_dataset(spark, tmp_path):
    blocks, _ = frames(spark, tmp_path)
    a, b = blocks.filter("document = 'a'"), blocks.filter("document = 'b'")
    both = sl.union_any(a, b)
    assert both.count() == 4 and set(both.columns) == set(sl.flatten_any(blocks, sl.Fields.of(blocks)).columns)
    table = sl.dataset(both, F.lit("Body"))
    assert table.columns[3:] == sorted(table.columns[3:]) and "label" in table.columns
    tb.write_csv(table.select([F.col(f"`{c}`").alias(c.replace(".", " ")) for c in table.columns]), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv"))
    assert back.count() == 4 and {r["label"] for r in back.collect()} == {"Body"}
    none = sl.flatten_any(blocks.limit(0), sl.Fields.of(blocks.limit(0)))
    assert none.columns == ["document", "doc_id", "line_no"] and none.count() == 0
