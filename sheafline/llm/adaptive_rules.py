"""Quality rules with thresholds that follow the data: quantile sketches per language and source, in DataFrame functions only.

Each text gives a few measures (shares of symbols, capitals, repeated lines and words, mean word length). A measure's sketch is
a table of counts in buckets of equal relative width: two sketches merge by adding counts, so it is a grouped sum, and a
quantile is the bucket where the running count passes it (relative error ``WIDTH``). A threshold lies beyond the median by a
multiple of the distance between the lower quantile and the median, and at least by the measure's least gap: what the larger values
are does not move it, so a source keeps its threshold while less than half of its rows are junk. Beyond that the merged sketches
bound it: no group's threshold lies over that of its language, or of all rows if that is lower, by more than the gap (word length
is a matter of the language alone). A language and source with fewer than ``least_rows`` rows takes the merged sketch of its
language, or of all rows. The thresholds are joined back, and rows beyond any are rejected.

Scale: the texts are read once, their measures are stored; sketches are combined before the shuffle, so a source with a third
of all rows is a few hundred counts a task. Windows run over the buckets of a sketch, whose number is bounded.

Defined results: a null or empty text has no words, fails the base rules and is not kept; null languages and sources are
groups of their own; rows that repeat are judged a row each; of extra columns none is looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import stored

SPAN = 8
WIDTH = 0.02
SMALLEST = 1e-3
LOW, HIGH = 0.2, 0.5
REACH = 5.0
LEAST_ROWS = 50

# The measures, how far beyond the upper quantile a threshold lies at least, and those that differ by language.
LEAST_GAPS = {"symbol_share": 0.08, "upper_share": 0.35, "line_share": 0.25, "repeat_share": 0.25, "word_length": 6.0}
BY_LANGUAGE = ("word_length",)

_SPACES = r"[\x20\x09-\x0D]+"


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes; ``words`` is their number."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def place(x: Column, k: Column) -> Column:
        before = F.get(ordered_col, k - 1)["h"]
        after = F.get(ordered_col, k + 1)["h"]
        return F.when((x["h"] == before) | (x["h"] == after), x["i"])

    ordered_col = F.col("_ordered")
    starts = F.sort_array(F.array_compact(F.transform(ordered_col, place)))
    starts_col = F.col("_starts")
    covered = F.aggregate(
        F.transform(starts_col, lambda p, k: F.least(F.lit(SPAN), F.coalesce(F.get(starts_col, k + 1) - p, F.lit(SPAN)))),
        F.lit(0),
        lambda total, n: total + n,
    )
    return ordered, starts, covered


def measures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the group keys, the base counts and the measures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang_key"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"),
        text.alias("text"),
    )
    rows = rows.withColumn("_words", F.filter(F.split("text", _SPACES), lambda w: w != ""))
    rows = rows.withColumn(
        "_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    n = F.size("_words")
    rows = rows.select(
        "doc_id",
        "lang_key",
        "source_key",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            n >= SPAN,
            F.transform(F.sequence(F.lit(1), F.greatest(n - SPAN + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(F.col("_words"), i, SPAN))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_hashes"),
    )
    # Most texts repeat no window; only the others sort theirs.
    rows = rows.withColumn("_hashes", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.col("_hashes")))
    ordered, starts, covered = _repeat_words(F.col("n_words"), F.col("_hashes"))
    rows = rows.withColumn("_ordered", ordered).withColumn("_starts", starts)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_hashes", "_ordered", "_starts")
    n = F.greatest(F.col("n_words"), F.lit(1))
    return rows.select(
        "doc_id",
        "lang_key",
        "source_key",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / n).alias("symbol_share"),
        (F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))).alias("line_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("word_chars") / n).alias("word_length"),
    )


def bucket(value: Column) -> Column:
    """Bucket of a measure: 0 below ``SMALLEST``, then one for each factor 1 + ``WIDTH``."""
    k = F.floor(F.log(value / SMALLEST) / math.log(1 + WIDTH)) + 1
    return F.when(value < SMALLEST, 0).otherwise(k).cast("int")


def bucket_top(k: Column) -> Column:
    return F.when(k == 0, 0.0).otherwise(SMALLEST * F.pow(F.lit(1 + WIDTH), k))


def sketches(rows: DataFrame, names=tuple(LEAST_GAPS)) -> DataFrame:
    """(lang_key, source_key, measure, bucket, n): the mergeable sketch of each measure of each language and source."""
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in names]))
    return rows.select("lang_key", "source_key", entries.alias("e")).groupBy("lang_key", "source_key", "e.measure", "e.bucket").agg(
        F.count("*").alias("n")
    )


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sum sketches over all but ``keys``."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """(keys, measure, held, one column a share): upper end of the bucket where the running count reaches the share."""
    own = W.partitionBy(*keys, "measure")
    run = sketch.withColumn("_run", F.sum("n").over(own.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
    run = run.withColumn("_all", F.sum("n").over(own))
    return run.groupBy(*keys, "measure").agg(
        F.max("_all").alias("held"),
        *[bucket_top(F.min(F.when(F.col("_run") >= share * F.col("_all"), F.col("bucket")))).alias(name) for name, share in shares.items()],
    )


def thresholds(sketch: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang_key, source_key, one column ``max_<measure>`` each): see the module."""
    shares = {"low": LOW, "high": HIGH}
    groups = quantiles(sketch, ["lang_key", "source_key"], shares)
    langs = quantiles(merge(sketch, ["lang_key"]), ["lang_key"], shares)
    every = quantiles(merge(sketch.withColumn("_one", F.lit(0)), ["_one"]), ["_one"], shares)

    def named(df: DataFrame, to: str) -> DataFrame:
        return df.select(*[c for c in df.columns if c.endswith("_key") or c == "measure"], F.struct("held", "low", "high").alias(to))

    joined = named(groups, "own").join(named(langs, "wide"), ["lang_key", "measure"], "left").join(named(every, "all"), ["measure"], "left")
    used = (
        F.when(F.col("own.held") >= least_rows, F.col("own")).when(F.col("wide.held") >= least_rows, F.col("wide")).otherwise(F.col("all"))
    )
    gap = F.create_map(*[F.lit(x) for pair in LEAST_GAPS.items() for x in pair])[F.col("measure")]

    def limit(of: Column) -> Column:
        return of["high"] + F.greatest(gap, REACH * (of["high"] - of["low"]))

    wide = F.when(F.col("wide.held") >= least_rows, limit(F.col("wide"))).otherwise(limit(F.col("all")))
    bound = F.when(F.col("measure").isin(*BY_LANGUAGE), wide).otherwise(F.least(wide, limit(F.col("all")))) + gap
    rows = joined.withColumn("top", F.least(limit(used), bound))
    return rows.groupBy("lang_key", "source_key").agg(*[F.max(F.when(F.col("measure") == m, F.col("top"))).alias(f"max_{m}") for m in LEAST_GAPS])


def judged(docs: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Per row of ``docs``: the base counts, ``base_failed``, ``kept`` and the measures that went beyond their thresholds."""
    rows = stored(measures(docs), "measures")
    # Stored, so that adaptive execution can broadcast them by size or split a group with very many rows.
    limits = stored(thresholds(sketches(rows.filter(~F.col("base_failed"))), least_rows), "limits")
    beyond = F.array_compact(F.array(*[F.when(F.col(m) > F.col(f"max_{m}"), F.lit(m)) for m in LEAST_GAPS]))
    out = rows.join(limits, ["lang_key", "source_key"], "left").withColumn("beyond", beyond)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("beyond") == 0)).alias("kept"),
        "beyond",
    )
