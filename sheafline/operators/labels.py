"""Heading labels from layout and style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordering import attach_stats, is_bounded, join_keys, line_chunk

# The label domain, outermost level first.
LEVELS = ["title", "H1", "H2", "H3", "H4"]
OUTLINE_LEVELS = ["H1", "H2", "H3", "H4"]

# Geometry and font thresholds.
PAGE_MIDDLE = 300.0
CENTRE_REACH = 100.0
BOLD_WEIGHT = 700
MODEL_CONFIDENCE = 0.6
DOMINANT_SHARE = 0.8
FEW_SIZES = 2

# Words that open a heading, and phrases that mark a guide heading.
OPENING_WORDS = [
    "chapter", "section", "part", "introduction", "conclusion", "overview", "summary",
]
REPAIR_OPENING_WORDS = ["chapter", "section", "part"]
GUIDE_PHRASES = [
    "what you need to know", "key points", "quick guide", "tips for", "guide to", "how to",
    "best places", "things to do", "where to",
]

# Section categories in order of test, with their words and importance.
CATEGORIES = {
    "cities": (1, ["city", "cities", "town", "region"]),
    "activities": (2, ["beach", "sport", "adventure", "activity"]),
    "cuisine": (3, ["food", "cuisine", "restaurant", "wine"]),
    "tips": (4, ["tip", "guide", "advice", "pack"]),
    "entertainment": (5, ["night", "entertainment", "bar", "club"]),
}
OTHER_CATEGORY = ("other", 99)


def parse_font(name: Column) -> Column:
    """Font struct from a PostScript-style name such as ``Sans-BoldItalic``."""
    family = F.split(name, "-")[0]
    lowered = F.lower(name)
    bold = lowered.contains("bold") | lowered.contains("black")
    return F.struct(
        family.alias("alt_family_name"),
        F.lit(False).alias("embedded"),
        F.lit("WinAnsiEncoding").alias("encoding"),
        family.alias("family_name"),
        F.lit("TrueType").alias("font_type"),
        lowered.contains("italic").alias("italic"),
        F.lit(False).alias("monospaced"),
        name.alias("name"),
        F.lit(False).alias("subset"),
        F.when(bold, BOLD_WEIGHT).otherwise(400).alias("weight"),
    )


def is_centred(x_center: Column) -> Column:
    return F.abs(x_center - PAGE_MIDDLE) < CENTRE_REACH


def layout_attributes(size: str = "font_size") -> list[Column]:
    """Centre, alignment, line height and rounded size from the box ``x0 y0 x1 y1``."""
    x_center = (F.col("x0") + F.col("x1")) / 2
    return [
        x_center.alias("x_center"),
        ((F.col("y0") + F.col("y1")) / 2).alias("y_center"),
        F.bround(F.col(size), 2).alias("font_size"),
        F.bround(F.col(size) * F.lit(1.2), 1).alias("line_height"),
        F.lit(0.0).alias("space_after"),
        F.when(is_centred(x_center), "Center").otherwise("Left").alias("text_align"),
    ]


def rule_label(size: Column, weight: Column, x_center: Column, avg: Column, largest: Column) -> Column:
    """Label from size against the document's mean and maximum; the first rule that holds wins."""
    return (
        F.when((size >= largest - 0.5) & is_centred(x_center), "title")
        .when((size >= avg + 4) & (weight >= BOLD_WEIGHT), "H1")
        .when(size >= avg + 3, "H2")
        .when(size >= avg + 2, "H3")
        .when(size >= avg + 1, "H4")
        .when(size >= avg - 1, "Body")
        .otherwise("Other")
    )


def font_stats(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    return blocks.groupBy(doc).agg(
        F.count("*").alias("n_blocks"),
        F.avg("font_size").alias("avg_font_size"),
        F.max("font_size").alias("largest_font"),
    )


def with_rule_labels(
    blocks: DataFrame,
    doc: str = "doc_id",
    out: str = "label",
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    with_stats = attach_stats(
        blocks, [doc], {"_avg": F.avg("font_size"), "_max": F.max("font_size")}, largest, limit
    )
    label = rule_label(
        F.col("font_size"), F.col("weight"), F.col("x_center"), F.col("_avg"), F.col("_max")
    )
    return with_stats.withColumn(out, label).drop("_avg", "_max")


def confidence_gate(confidence: Column, predicted: Column, rule: Column) -> Column:
    """The model's label where it is sure enough, the rule's label elsewhere."""
    sure = F.coalesce(confidence, F.lit(0.0)) >= F.lit(MODEL_CONFIDENCE)
    return F.when(sure & predicted.isNotNull(), predicted).otherwise(rule)


def size_shares(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: share of the most frequent font size, distinct sizes, and both uniformity tests."""
    sized = blocks.select(doc, F.bround("font_size", 1).alias("size"))
    per_size = sized.groupBy(doc, "size").agg(F.count("*").alias("n"))
    known = F.col("size").isNotNull()
    return (
        per_size.groupBy(doc)
        .agg(
            F.sum(F.when(known, F.col("n"))).alias("_total"),
            F.max(F.when(known, F.col("n"))).alias("_top"),
            F.count("size").alias("n_sizes"),
        )
        .select(
            doc,
            F.coalesce(F.col("_top") / F.col("_total"), F.lit(0.0)).alias("top_share"),
            F.col("n_sizes"),
        )
        .withColumn("is_dominated", F.col("top_share") > F.lit(DOMINANT_SHARE))
        .withColumn("has_few_sizes", F.col("n_sizes") <= FEW_SIZES)
    )


def uniform_relabel(label: Column, t: Column, low: Column, bold: Column, italic: Column) -> Column:
    """Style-only labels for documents ruled by one font size (titles are kept).

    ``t`` is the trimmed text and ``low`` its lower case. Each style test claims its block: a bold block is never looked at as italic, and a block that
    opens with a capital is never searched for guide phrases.
    """
    bold_label = F.when(
        tx.starts_with_any(low, OPENING_WORDS) | (tx.is_upper(t) & tx.at_most_words(t, 6)), "H1"
    ).otherwise("H2")
    restyled = (
        F.when(bold, bold_label)
        .when(italic, F.when(tx.at_most_words(t, 8), "H3").otherwise(label))
        .when(t.rlike("^[A-Z]"), F.when(tx.at_most_words(t, 6), "H3").otherwise(label))
        .when(low.rlike("|".join(GUIDE_PHRASES)), "H2")
        .otherwise(label)
    )
    return F.when(label == "title", label).otherwise(restyled)


def _dominated(
    blocks: DataFrame, doc: str, largest: int | None, limit: int | None
) -> DataFrame:
    """Add ``_uniform``: one rounded font size covers more than the share of the document's blocks."""
    sized = blocks.withColumn("_size", F.bround("font_size", 1))
    known = F.col("_size").isNotNull()
    if is_bounded(largest, limit):
        per_size = F.count("_size").over(W.partitionBy(doc, "_size"))
        whole = W.partitionBy(doc)
        share = F.max("_n").over(whole) / F.nullif(F.count("_size").over(whole), F.lit(0))
        return (
            sized.withColumn("_n", per_size)
            .withColumn("_uniform", share > F.lit(DOMINANT_SHARE))
            .drop("_size", "_n")
        )
    n = F.when(known, F.col("_n"))
    uniform = (
        sized.groupBy(doc, "_size")
        .agg(
            F.count("*").alias("_n"),
            F.min(line_chunk()).alias("_lo"),
            F.max(line_chunk()).alias("_hi"),
        )
        .groupBy(doc)
        .agg(
            (F.max(n) / F.sum(n) > F.lit(DOMINANT_SHARE)).alias("_uniform"),
            F.min("_lo").alias("_lo"),
            F.max("_hi").alias("_hi"),
        )
        .filter("_uniform")
        .select(doc, "_uniform", F.explode(F.sequence("_lo", "_hi")).alias("_salt"))
    )
    salted = blocks.withColumn("_salt", line_chunk())
    return join_keys(salted, uniform, [doc, "_salt"]).drop("_salt")


def with_uniform_relabel(
    blocks: DataFrame,
    doc: str = "doc_id",
    label: str = "label",
    out: str = "label",
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Apply ``uniform_relabel`` to the documents whose dominant font size exceeds the share."""
    relabelled = F.when(
        F.col("_uniform"),
        uniform_relabel(
            F.col(label), F.col("_t"), F.col("_low"), _style(blocks, "is_bold"), _style(blocks, "is_italic")
        ),
    ).otherwise(F.col(label))
    # Trimmed and lowered once, for the documents that need it.
    trimmed = F.when(F.col("_uniform"), tx.strip(F.col("text")))
    marked = _dominated(blocks, doc, largest, limit).withColumn("_t", trimmed)
    return (
        marked.withColumn("_low", F.lower("_t")).withColumn(out, relabelled).drop("_uniform", "_t", "_low")
    )


def _style(df: DataFrame, name: str) -> Column:
    """An optional style flag; absent or null is false."""
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def repair_relabel(label: Column, raw_text: Column, bold: Column, italic: Column) -> Column:
    """Style-only labels for ``Other`` blocks of documents with at most two font sizes."""
    t = tx.strip(raw_text)
    restyled = (
        F.when(bold, F.when(tx.is_upper(t), "H1").otherwise("H2"))
        .when(italic, "H3")
        .when(t.rlike(r"^\d+\.(\d+\.?)?\s"), "H2")
        .when(tx.starts_with_any(F.lower(t), REPAIR_OPENING_WORDS), "H1")
        .otherwise(label)
    )
    return F.when(F.coalesce(label, F.lit("Other")) == "Other", restyled).otherwise(label)


def with_repair_relabel(
    blocks: DataFrame,
    doc: str = "doc_id",
    label: str = "label",
    out: str = "label",
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Apply ``repair_relabel`` to the documents with at most two rounded font sizes."""
    # Sizes rounded to a tenth of a point are a small set however long the document is.
    sizes = F.collect_set(F.bround("font_size", 1))
    stats = attach_stats(blocks, [doc], {"_sizes": sizes}, largest, limit)
    few = F.size("_sizes") <= FEW_SIZES
    restyled = repair_relabel(
        F.col(label), F.col("text"), _style(blocks, "is_bold"), _style(blocks, "is_italic")
    )
    return stats.withColumn(out, F.when(few, restyled).otherwise(F.col(label))).drop("_sizes")


def category(heading: Column) -> Column:
    """First category one of whose words occurs anywhere in the heading."""
    low = F.lower(heading)
    out = None
    for name, (_, needles) in CATEGORIES.items():
        hit = tx.contains_any(low, needles)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER_CATEGORY[0])


def importance(cat: Column) -> Column:
    out = None
    for name, (rank, _) in CATEGORIES.items():
        out = F.when(cat == name, rank) if out is None else out.when(cat == name, rank)
    return out.otherwise(OTHER_CATEGORY[1])
