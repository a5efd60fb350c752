"""Quality reports of label models, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as nb
from . import ordering as od

# Fixed value: bins of the confidence histogram.
BINS = 20


def confusion_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(df: DataFrame, truth: str, pred: str, classes: Sequence) -> DataFrame:
    """One row a true class, one ``pred_<class>`` column a predicted class."""
    counted = (
        confusion_counts(df, truth, pred).groupBy("truth").pivot("pred", list(classes)).sum("n")
    )
    return counted.select(
        "truth", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"pred_{c}") for c in classes]
    )


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class, then accuracy, macro and weighted means.

    All tables after the first count have at most classes x classes rows.
    """
    return report_of_counts(confusion_counts(df, truth, pred))


def report_of_counts(counts: DataFrame) -> DataFrame:
    """``classification_report`` from ``confusion_counts``; its four parts read ``counts`` each, so costly ones are stored first."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("truth").cast("string").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    hit.cast("bigint").alias("hits"),
                ),
                F.struct(
                    F.col("pred").cast("string").alias("class"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    per_class = (
        sides.groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
        .withColumn("precision", nb.ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", nb.ratio(F.col("hits"), F.col("support")))
        .withColumn(
            "f1",
            nb.ratio(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
        )
    )
    scores = ["precision", "recall", "f1"]
    accuracy = F.sum("hits") / F.sum("support")
    total = F.sum("support").alias("support")
    rows = [
        per_class.select("class", *scores, "support"),
        per_class.agg(*[accuracy.alias(s) for s in scores], total).select(
            F.lit("accuracy").alias("class"), *scores, "support"
        ),
        per_class.agg(*[F.avg(s).alias(s) for s in scores], total).select(
            F.lit("macro avg").alias("class"), *scores, "support"
        ),
        per_class.agg(
            *[(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in scores], total
        ).select(F.lit("weighted avg").alias("class"), *scores, "support"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, corr): every pair in one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(
                F.struct(F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b"), F.col(f"c{i}").alias("corr"))
            )
    return one.select(F.inline(F.array(*cells)))


def roc_curve(
    scored: DataFrame,
    keys: Sequence[str],
    score: str,
    positive: Column,
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """ROC points per key, one a distinct score (ties are one point): threshold, fpr, tpr.

    Rows are counted per score first. Classes are few, so the running sums are kept in chunks of the
    score order when a class has very many distinct scores.
    """
    per_score = scored.groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.sum(nb.flag(positive)).alias("_pos"), F.sum(nb.flag(~positive)).alias("_neg")
    )
    totals = per_score.groupBy(*keys).agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_f"))
    points = od.running_sum(
        per_score,
        keys,
        [F.desc("threshold")],
        {"tp": F.col("_pos"), "fp": F.col("_neg")},
        largest,
        limit,
    )
    return points.join(totals, list(keys)).select(
        *keys,
        "threshold",
        nb.ratio(F.col("fp"), F.col("_f")).alias("fpr"),
        nb.ratio(F.col("tp"), F.col("_p")).alias("tpr"),
        "_pos", "_neg", "tp", "fp", "_p", "_f",
    )


def roc_auc(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under each curve: a point adds ``neg * (tp - pos / 2)``, a trapezoid over its own ties."""
    area = F.sum(F.col("_neg") * (F.col("tp") - F.col("_pos") / F.lit(2.0)))
    return points.groupBy(*keys).agg(
        nb.ratio(area, F.max("_p") * F.max("_f").cast("double")).alias("auc")
    )


def confidence_histogram(df: DataFrame, confidence: str, bins: int = BINS) -> DataFrame:
    """(bin, n) over ``bins`` equal bins from minimum to maximum; empty bins are kept."""
    ends = df.agg(
        F.struct(F.min(confidence).alias("lo"), F.max(confidence).alias("hi")).alias("e")
    ).scalar()
    held = df.filter(F.col(confidence).isNotNull()).withColumn("_e", ends)
    width = F.nullif(F.col("_e.hi") - F.col("_e.lo"), F.lit(0.0))
    place = (F.col(confidence) - F.col("_e.lo")) / width
    # Where all values are equal they sit in the middle, the range being half a unit to each side.
    number = F.least(F.lit(bins), F.floor(F.coalesce(place, F.lit(0.5)) * bins) + 1)
    counted = (
        held.groupBy(number.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    frame = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
