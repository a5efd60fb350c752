import random
import re

from pyspark.sql import functions as F

from sheafline.functions import text as tx

SAMPLES = [
    "", " ", "\t a b \n", "ACAR AJÉ", "acarajé", "GROß", "ÄÖ 12", "1. INTRO", "ß", "ǅ", "x" * 30,
    "one two three four five six", "one two three four five six seven", " wide　", "a  b", "é b é",
]


def plain_clean(t):
    return re.sub(r"[^\x20-\x7E]", "", re.sub(r"\s+", " ", t.strip()))


def test_against_plain_strings(spark):
    rng = random.Random(3)
    alphabet = ["a", "B", " ", "\t", " ", "é", "É", "1", ".", " ", "\x1f", "ß"]
    texts = SAMPLES + ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c = F.col("t")
    rows = df.select(
        "t",
        tx.strip(c).alias("strip"),
        tx.clean_text(c).alias("clean"),
        tx.word_count(c).alias("n"),
        tx.is_upper(c).alias("upper"),
        tx.at_most_words(tx.strip(c), 6).alias("few"),
        tx.squared_norm(tx.tokens(c)).alias("sq"),
        tx.tokens(c).alias("toks"),
    ).collect()
    for r in rows:
        assert r["strip"] == r["t"].strip()
        assert r["clean"] == plain_clean(r["t"])
        assert r["n"] == len(r["t"].split())
        assert r["upper"] == r["t"].isupper()
        assert r["few"] == (len(r["t"].split()) <= 6)
        assert r["sq"] == sum(r["toks"].count(t) ** 2 for t in set(r["toks"]))


def test_null_text_is_empty(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(tx.clean_text(F.col("t"))).first()[0] == ""
