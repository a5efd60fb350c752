"""Nulls lose no row, and give the same answer on the window path and on the joined one."""

from pyspark.sql import functions as F

from sheafline.operators import features as ft
from sheafline.operators import labels as lb
from sheafline.operators import merge as mg
from sheafline.operators import ordering as od
from sheafline.plans import fixtures as fx

SMALL = "/root/testdata/sf0.001"


def gaps(spark):
    """Lines of the fixture in which ids, places, sizes, texts and boxes are missing here and there."""
    b = fx.blocks(spark, SMALL)
    where = lambda n, k: F.pmod(F.xxhash64("doc_id", "line_no", F.lit(k)), F.lit(n)) == 0
    return b.withColumns(
        {
            "font_size": F.when(~where(9, 1), F.col("font_size")),
            "text": F.when(~where(9, 2), F.col("text")),
            "x0": F.when(~where(9, 3), F.col("x0")),
            "font_name": F.when(~where(9, 4), F.col("font_name")),
            "weight": F.when(~where(9, 5), F.col("weight")),
            "doc_id": F.when(F.col("doc_id") != 3, F.col("doc_id")),
            "line_no": F.when(~where(11, 6), F.col("line_no")),
        }
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rule_labels_on_both_paths(spark):
    b = gaps(spark).select("doc_id", "line_no", "text", "font_size", "weight", "x_center")
    assert rows(lb.with_rule_labels(b, largest=10_000)) == rows(lb.with_rule_labels(b, largest=10_000, limit=1))


def test_merge_titles_keeps_every_line(spark):
    b = gaps(spark)
    merged = mg.merge_titles(b, largest=10_000)
    assert merged.agg(F.sum("n_lines")).first()[0] == b.count()


def test_folds_treat_nulls_alike(spark):
    lines = [
        (1, 1, "a", 10.0, "F", 400, None, 0.0, 5.0, 2.0), (1, 2, None, 10.0, "F", 400, 1.0, 3.0, None, 4.0),
        (1, 3, "c", 10.0, None, 400, 1.0, 5.0, 9.0, 6.0), (1, 4, "d", 10.0, None, 400, 1.0, 7.0, 9.0, 8.0),
        (1, 5, None, 10.0, "F", 400, 1.0, 9.0, 9.0, 10.0), (1, 6, "f", None, "F", 400, 1.0, 11.0, 9.0, 12.0),
    ]
    schema = "doc_id int, line_no int, text string, font_size double, font_name string, weight int, x0 double, y0 double, x1 double, y1 double"
    b = spark.createDataFrame(lines, schema).withColumns(
        {"page": F.lit(1), "x_center": F.col("y0"), "y_center": F.col("y0"), "label": F.lit("Body")}
    )
    order, keys = ["y_center", "line_no"], ["doc_id", "page", "label"]
    cut = b.withColumn("_segment", F.lit(1))

    def joins(group, nxt):
        return (group["font_name"] == nxt["font_name"]) & mg._within(group["font_size"], nxt["font_size"], 1)

    arrays = mg._fold_arrays(cut, keys, order, joins)
    by_line = mg._fold_lines(cut, keys, order, joins, arrays.schema)
    assert rows(arrays) == rows(by_line)
    assert {r["text"] for r in arrays.collect()} == {"a ", "c", "d", None, "f"}


def test_stats_meet_null_keys(spark):
    df = spark.createDataFrame([(None, None, 1.0), (None, 5, 3.0), (1, 1, 7.0)], "doc_id int, line_no int, v double")
    out = od.attach_stats(df, ["doc_id"], {"m": F.avg("v")}, largest=10, limit=1)
    assert rows(out.select("v", "m")) == [(1.0, 2.0), (3.0, 2.0), (7.0, 7.0)]


def test_flat_names_do_not_clash(spark, tmp_path):
    b = fx.blocks(spark, SMALL).limit(3).select(F.col("font_name"), F.struct(F.col("font_name").alias("name"), F.lit(1).alias("x")).alias("Font"))
    flat = ft.flatten(b)
    assert flat.columns == ["font_name", "Font_name_nested", "Font_x"]
    flat.write.parquet(str(tmp_path / "flat"))
    assert ft.union_flat(b, b).count() == 6


def test_neighbours_of_null_and_repeated_identities(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T

    from sheafline.operators import models as md

    train = [(i, Vectors.dense(1.0, i / 10), float(i % 2)) for i in range(8)] + [(None, Vectors.dense(0.0, 1.0), 1.0)]
    asked = [(1, Vectors.dense(1.0, 0.1)), (1, Vectors.dense(0.0, 1.0)), (1, Vectors.dense(0.0, 1.0)), (None, Vectors.dense(1.0, 0.2)), (None, Vectors.dense(1.0, 0.3))]
    kinds = [T.StructField("line", T.IntegerType()), T.StructField("features", VectorUDT())]
    df = spark.createDataFrame(asked, T.StructType(kinds))
    known = spark.createDataFrame(train, T.StructType([*kinds, T.StructField("label_index", T.DoubleType())]))
    got = md.neighbour_probabilities(df, known, "line", 2, 1)
    assert got.columns == ["line", "features", "p_knn"]
    found = sorted(((str(r["line"]), r["features"][1], r["p_knn"]) for r in got.collect()))
    assert found == [("1", 0.1, [0.0, 1.0]), ("1", 1.0, [0.0, 1.0]), ("1", 1.0, [0.0, 1.0]), ("None", 0.2, [1.0, 0.0]), ("None", 0.3, [0.0, 1.0])]
