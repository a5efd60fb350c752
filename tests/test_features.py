import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.operators import features as ft
from sheafline.operators import knn
from sheafline.operators import metrics as mt
from sheafline.operators import ordering as od


@pytest.mark.parametrize("largest", [None, 100])
def test_codes_per_document(spark, largest):
    rng = random.Random(1)
    rows = [(d, i, rng.choice(["b", "a", "c", None, "é"])) for d in range(5) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, line_no bigint, f string")
    got = ft.category_codes(df, "f", "code", ["doc_id"], largest=largest).collect()
    assert len(got) == len(rows)
    for r in got:
        values = sorted({f for d, _, f in rows if d == r["doc_id"] and f is not None})
        assert r["code"] == (-1 if r["f"] is None else values.index(r["f"]))


def test_codes_over_all_rows(spark):
    words = ["src1", "src10", "src2", "a", "ab", "Z", None]
    df = spark.createDataFrame([(w,) for w in words * 3], "f string")
    values = sorted(w for w in words if w)
    for r in ft.category_codes(df, "f", "code").collect():
        assert r["code"] == (-1 if r["f"] is None else values.index(r["f"]))


def test_stats_of_a_hot_document_are_spread(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("doc_id"), F.col("id").alias("line_no")
    )
    plain = od.attach_stats(df, ["doc_id"], {"m": F.max("line_no")}, largest=1000)
    spread = od.attach_stats(df, ["doc_id"], {"m": F.max("line_no")}, rows_per_chunk=50)
    assert sorted(plain.collect()) == sorted(spread.collect())


@pytest.mark.parametrize("limit", [10_000, 30])
def test_running_sums(spark, limit):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 500).alias("o"))
    got = od.running_sum(df, ["k"], ["o"], {"s": F.col("o")}, limit=limit).collect()
    for k in range(3):
        total = 0
        for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["o"]):
            total += r["o"]
            assert r["s"] == total


def test_split_is_exact_per_class(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("int").alias("c"))
    got = ft.stratified_split(df, "c", "id", prefix_chars=1).groupBy("c").agg(
        F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")
    )
    for r in got.collect():
        assert r["t"] == math.ceil(0.2 * r["n"])


def test_constant_column_scales_to_zero(spark):
    df = spark.range(5).withColumn("c", F.lit(3.0))
    out = ft.standardize(df, ["c"], ft.fit_scaler(df, ["c"]))
    assert {r["z_c"] for r in out.collect()} == {0.0}
    fitted = ft.fit_scaler(df, ["c"]).first()["s"].asDict()
    assert {r["z_c"] for r in ft.standardize(df, ["c"], fitted).collect()} == {0.0}


def test_header_and_union_of_flat_fields(spark):
    a = spark.sql("select 1 as page, struct(400 as weight, struct(1 as y) as x) as Font")
    b = spark.sql("select 'x' as text")
    assert ft.field_names(a, b) == ["Font_weight", "Font_x_y", "label", "page", "text"]
    assert ft.union_flat(a, b).columns == ["Font_weight", "Font_x_y", "page", "text"]


def test_bounding_boxes_from_text(spark):
    df = spark.createDataFrame([("[1, 2, 4.5, 8]",), ("[1, 2]",), ("x",), (None,)], "bbox string").withColumn("text", F.lit("a"))
    got = ft.network_features(df).select("bbox_width", "bbox_height").collect()
    assert [tuple(r) for r in got] == [(3.5, 6.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_single_row_and_empty_document(spark):
    schema = "doc_id bigint, line_no bigint, text string, font_size double, font_name string, x0 double, y0 double, x1 double, y1 double, y_center double"
    df = spark.createDataFrame([(1, 1, "", 12.0, "A", 0.0, 0.0, 1.0, 1.0, 0.0)], schema)
    for largest in (None, 10):
        r = ft.block_features(df, scope="document", largest=largest).first()
        assert (r["font_size_zscore"], r["normalized_y_pos"], r["avg_word_length"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("limit", [10_000, 40])
def test_auc_equals_pair_counting(spark, limit):
    rng = random.Random(4)
    rows = [(1, rng.randint(0, 300) / 300, rng.random() < 0.4) for _ in range(400)]
    df = spark.createDataFrame(rows, "class int, s double, hit boolean")
    auc = mt.roc_auc(mt.roc_curve(df, ["class"], "s", F.col("hit"), limit=limit), ["class"]).first()["auc"]
    pos = [s for _, s, h in rows if h]
    neg = [s for _, s, h in rows if not h]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert abs(auc - wins / (len(pos) * len(neg))) < 1e-9


def test_histogram_of_equal_values_sits_in_the_middle(spark):
    df = spark.range(4).withColumn("c", F.lit(0.5))
    got = {r["bin"]: r["n"] for r in mt.confidence_histogram(df, "c").collect()}
    assert len(got) == 20 and got[11] == 4


@pytest.mark.parametrize("block_rows, shared", [(4096, 0), (16, 0), (16, 10**6)])
def test_neighbours_equal_brute_force(spark, block_rows, shared):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(8, 12))
    train = np.vstack([base[i % 8] + 0.3 * rng.normal(size=12) for i in range(300)])
    train[100:180] = train[0]
    train[5] = 0.0
    queries = np.vstack([train[0], np.zeros(12), *(base[i % 8] + 0.3 * rng.normal(size=12) for i in range(30))])
    t = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(train)], "id bigint, v array<double>, c int")
    q = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(queries)], "id bigint, v array<double>")
    got = knn.nearest_neighbours(q, t, "id", "v", ["c"], block_rows=block_rows, shared_values=shared).collect()

    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    d = np.round(np.maximum(1 - unit(queries) @ unit(train).T, 0), 9)
    for i in range(len(queries)):
        want = sorted((d[i, j], j) for j in range(len(train)))[:5]
        mine = sorted((r["distance"], r["id"]) for r in got if r["query_id"] == 1000 + i)
        assert [j for _, j in mine] == [j for _, j in want]


def test_zero_distance_takes_all_weight(spark):
    near = spark.createDataFrame(
        [(1, 0.0, 2), (1, 0.1, 0), (1, 0.1, 0), (2, 0.5, 1), (2, 0.5, 0)], "query_id bigint, distance double, c int"
    )
    got = {r["query_id"]: (r["predicted"], r["confidence"]) for r in knn.predict(near, "c").collect()}
    assert got == {1: (2, 1.0), 2: (0, 0.5)}
