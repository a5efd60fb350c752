"""One document a file: whole or not at all, under derived names; readers with errors as rows."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sheafline.sources import blocks_json as bj
from sheafline.sources import documents as dc
from sheafline.sources import spans as sp

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def entries(spark, rows):
    return spark.createDataFrame(rows, "document string, head string, entry string, tail string, seq int")


def listed(folder):
    return sorted(os.path.relpath(os.path.join(top, f), folder) for top, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def test_round_trip_and_names(spark, tmp_path):
    names = ["report.pdf", "plain", "a/b.pdf", ".hidden", "_under", "50% off.pdf", "Ünï 中.pdf", "x.pdf.pdf", "none.pdf"]
    rows = [(n, "[", json.dumps({"k": k, "n": n}), "]", k) for n in names[:-1] for k in (3, 1, 2)] + [("none.pdf", "[", None, "]", None)]
    path = str(tmp_path / "out")
    os.mkdir(path)
    dc.write_documents(entries(spark, rows).repartition(5), path, "_outline.json", order=("seq",))
    assert listed(path) == sorted(dc.file_name(n, "_outline.json") for n in names)
    assert "report_outline.json" in listed(path) and not os.path.exists(f"{path}/{dc.TEMPORARY}")
    back = {r["document"]: json.loads(r["value"]) for r in dc.read_documents(spark, path, "_outline.json").collect()}
    assert back == {n.removesuffix(".pdf"): [{"k": k, "n": n} for k in (1, 2, 3)] if n != "none.pdf" else [] for n in names}
    assert dc.read_documents(spark, path, ".nothing").count() == 0


def test_append_and_replace_all(spark, tmp_path):
    path = f"file://{tmp_path}"
    (tmp_path / "other.txt").write_text("stays")
    dc.write_documents(entries(spark, [("a", "1", None, "", 0), ("b", "1", None, "", 0)]), path, ".json")
    dc.write_documents(entries(spark, [("b", "2", None, "", 0)]), path, ".json")
    assert {f: (tmp_path / f).read_text() for f in listed(tmp_path)} == {"a.json": "1", "b.json": "2", "other.txt": "stays"}
    dc.write_documents(entries(spark, [("c", "3", None, "", 0)]), path, ".json", replace_all=True)
    assert listed(tmp_path) == ["c.json", "other.txt"]
    dc.write_documents(entries(spark, []), path, ".json")
    assert listed(tmp_path) == ["c.json", "other.txt"]


def test_an_aborted_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    dc.write_documents(entries(spark, [("a", "old", None, "", 0)]), path, ".json")
    broken = entries(spark, [("a", "new", None, "", 0), ("b", "x", "e", "y", 0), ("c", "z", None, "", 0)]).repartition(3, "document")
    fails = broken.withColumn("head", F.when(F.col("document") == "c", F.raise_error(F.lit("stop"))).otherwise(F.col("head")))
    for rows in (fails, broken.unionByName(entries(spark, [(None, "", None, "", 0)]))):
        with pytest.raises(Exception, match="stop|without a name"):
            dc.write_documents(rows, path, ".json")
        assert listed(path) == ["a.json"] and (tmp_path / "a.json").read_text() == "old" and os.listdir(path) == ["a.json"]


def test_a_document_from_two_tasks_is_refused(spark, tmp_path):
    spark.dataSource.register(dc.DocumentFiles)
    rows = entries(spark, [("a", "x", None, "", 0)] * 4).repartition(4).drop("seq")
    with pytest.raises(Exception, match="several tasks"):
        rows.write.format(dc.FORMAT).option("path", str(tmp_path)).mode("append").save()
    mixed = entries(spark, [("a", "x", None, "", 0), ("b", "x", None, "", 0), ("a", "x", None, "", 0)]).coalesce(1).drop("seq")
    with pytest.raises(Exception, match="do not follow"):
        mixed.write.format(dc.FORMAT).option("path", str(tmp_path)).mode("append").save()
    assert listed(tmp_path) == []


def test_a_long_document_streams(spark, tmp_path):
    rows = spark.range(60_000).select(F.lit("long.pdf").alias("document"), F.lit("[").alias("head"), F.to_json(F.struct("id")).alias("entry"), F.lit("]").alias("tail"), F.col("id").cast("int").alias("seq"))
    dc.write_documents(rows.repartition(7), str(tmp_path), ".json", order=("seq",))
    assert [x["id"] for x in json.loads((tmp_path / "long.json").read_text())] == list(range(60_000))
    blocks, _ = bj.read_blocks(spark, str(tmp_path))
    assert blocks.count() == 60_000


def numbers(name, content):
    if b"broken" in content:
        raise ValueError(name)
    for word in content.split():
        yield {"document": name, "page": 1, "block": 0, "block_type": 0, "line": 0, "span_no": int(word) if word.isdigit() else "word", "text": "t", "size": 12.0}
    if name.startswith("odd"):
        yield "not a row"


def test_rows_of_a_wrong_type_are_errors(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"1 2 x 3")
    (tmp_path / "odd.pdf").write_bytes(b"4")
    (tmp_path / "bad.pdf").write_bytes(b"broken")
    rows, failed = sp.parse_once(spark, str(tmp_path), numbers)
    assert sorted((r["document"], r["span_no"]) for r in rows.collect()) == [("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("odd.pdf", 4)]
    found = sorted((r["file"], r["error"].split(":")[0]) for r in failed.collect())
    assert found == [("a.pdf", "row 2"), ("bad.pdf", "ValueError"), ("odd.pdf", "row 1")]
    dc.register_parser(spark, "number_files", numbers, sp.SPAN_SCHEMA)
    both = spark.read.format("number_files").option("suffix", ".pdf").load(str(tmp_path)).collect()
    assert sum(r["_error"] is None for r in both) == 4 and sum(r["_error"] is not None for r in both) == 3
    assert {r["_file"] for r in both} == {"a", "odd", "bad"}
