"""Rows with nulls, empty and very long texts, ties and repeats, and extra columns whose names clash with results."""

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

FIELDS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.StringType()),  # clashes with result names
        T.StructField("n_words", T.StringType()),
    ]
)

PASSAGE = " ".join(f"passage{i}" for i in range(60))
ROWS = [
    (1, f"Alpha beta {PASSAGE} end one.", "en", "a"),
    (2, f"Other head {PASSAGE} and tail two", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (None, "a row without an id", None, None),
    (5, "tie " * 80, "de", "b"),
    (6, "tie " * 80, "de", "b"),
    (6, "tie " * 80, "de", "b"),
    (7, " \t\n\x0b ", "fr", "b"),
    (8, "Ünï ▁ x y \U0001f600", "fr", "b"),
    (9, " ".join(f"w{i % 977}x{i}" for i in range(30_000)), "es", "c"),
]


def frame(spark, rows=ROWS):
    full = [(i, t, lang, s, None if t is None else len(t), "extra", "clash") for i, t, lang, s in rows]
    return spark.createDataFrame(full, FIELDS)
