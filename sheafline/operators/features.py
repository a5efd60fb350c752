"""Layout and text features of blocks, and their encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as nb
from ..functions import text as tx
from ..session import cut_lineage
from . import ordering as od
from .labels import BOLD_WEIGHT

# Cue words, thresholds and the feature list of the network model.
TITLE_WORDS = ["chapter", "section", "part"]
HEADING_KEYWORDS = [
    "introduction", "conclusion", "summary", "methodology", "results", "discussion", "references",
]
TOP_THIRD = 0.33
FOLLOWING_GAP = 20
# Most values, and bytes of them, whose codes are broadcast.
FEW_VALUES = 10_000
FEW_BYTES = 4_000_000
ALIGN_NAMES = ["attributes_TextAlign", "TextAlign", "text_align"]
WEIGHT_NAMES = ["Font_weight", "font_weight", "weight"]
ITALIC_NAMES = ["Font_italic", "font_italic", "italic"]
NETWORK_FEATURES = [
    "font_size", "Font_weight", "font_weight", "weight", "page", "x_center", "y_center",
    "attributes_LineHeight", "LineHeight", "line_height", "text_length", "word_count",
    "bbox_width", "bbox_height", "bbox_area", "is_center_aligned", "is_left_aligned", "is_bold",
    "is_italic",
]


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs to ``parent_child`` columns, by a walk over the schema alone.

    A name that another column has, whatever its case, gets the suffix ``_nested`` (again until it is free), so that the
    result can be selected, united and written; columns that were flat before keep their names.
    """

    def walk(schema: T.StructType, parents: tuple[str, ...]):
        for field in schema.fields:
            path = (*parents, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from walk(field.dataType, path)
            else:
                yield path

    paths = list(walk(df.schema, ()))
    taken = {path[0].lower() for path in paths if len(path) == 1}
    columns = []
    for path in paths:
        name = sep.join(path)
        if len(path) > 1:
            while name.lower() in taken:
                name += f"{sep}nested"
            taken.add(name.lower())
        columns.append(F.col(".".join(f"`{p}`" for p in path)).alias(name))
    return df.select(*columns)


def field_names(*frames: DataFrame) -> list[str]:
    """Sorted union of the flattened field names, plus ``label``: a dataset header."""
    names = {"label"}
    for df in frames:
        names.update(flatten(df).columns)
    return sorted(names)


def union_flat(*frames: DataFrame) -> DataFrame:
    """Flattened frames under one sorted header; fields a frame lacks are null."""
    flat = [flatten(df) for df in frames]
    out = flat[0]
    for df in flat[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def first_existing(df: DataFrame, names: Sequence[str], default: Column) -> Column:
    """The first of ``names`` the frame has, else ``default``."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    return default


def parse_bbox(c: Column) -> Column:
    """``"[x0, y0, x1, y1]"`` to array<double>; null unless it is a list of at least four numbers."""
    box = F.from_json(c, "array<double>")
    return F.when(F.size(box) >= 4, box)


def bbox_features(x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    width = F.coalesce(x1 - x0, F.lit(0.0))
    height = F.coalesce(y1 - y0, F.lit(0.0))
    return {"bbox_width": width, "bbox_height": height, "bbox_area": width * height}


def category_codes(
    df: DataFrame,
    column: str,
    out: str,
    keys: Sequence[str] = (),
    line_col: str = "line_no",
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """0-based rank among the sorted distinct values (per ``keys``, or over all rows); null is -1.

    Only distinct values are ranked. Over all rows, beyond the row limit, they are dealt into ranges that are ranked apart and
    shifted by the values before, so no task sorts them all and no first letter is a hot key.
    """
    if keys and od.is_bounded(largest, limit):
        w = W.partitionBy(*keys).orderBy(F.col(column).asc_nulls_last())
        code = F.when(F.col(column).isNotNull(), F.dense_rank().over(w) - 1).otherwise(-1)
        return df.withColumn(out, code)
    if keys:
        chunk = od.line_chunk(line_col)
        values = (
            df.filter(F.col(column).isNotNull())
            .groupBy(*keys, column)
            .agg(F.min(chunk).alias("_lo"), F.max(chunk).alias("_hi"))
        )
        w = W.partitionBy(*keys).orderBy(column)
        codes = values.select(
            *keys,
            column,
            (F.row_number().over(w) - 1).alias(out),
            F.explode(F.sequence("_lo", "_hi")).alias("_salt"),
        )
        joined = od.join_keys(df.withColumn("_salt", chunk), codes, [*keys, column, "_salt"])
        return joined.drop("_salt").withColumn(out, F.coalesce(out, F.lit(-1)))
    values = cut_lineage(df.select(column).filter(F.col(column).isNotNull()).distinct())
    n_values, size = values.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(column).cast("string"))), F.lit(0))).first()
    # Numbered as one group in order: by a window up to the row limit, beyond it in ranges of values that are stored and shifted.
    ranked = od.numbered(values.withColumn("_all", F.lit(0)), ["_all"], [column], out, largest=n_values, limit=limit)
    codes = ranked.select(column, (F.col(out) - 1).alias(out))
    if n_values <= FEW_VALUES and size <= FEW_BYTES:
        # Joined by a shuffle, all rows would meet in as many partitions as there are values.
        codes = F.broadcast(codes)
    return df.join(codes, column, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def text_features(text: Column, compat: bool = False) -> dict[str, Column]:
    """Length, words and simple patterns. ``compat`` keeps the serving-side pattern for numbers,
    which looks for a literal backslash and ``d`` and so is practically never met."""
    digit = text.startswith("\\d") if compat else text.rlike(r"^\d")
    return {
        "text_length": F.coalesce(F.char_length(text), F.lit(0)),
        "word_count": F.coalesce(tx.word_count(text), F.lit(0)),
        "starts_with_number": nb.flag(digit),
        "has_punctuation": nb.flag(text.rlike(r"[.,!?]")),
    }


def block_features(
    blocks: DataFrame,
    scope: str = "global",
    compat: bool = False,
    doc: str = "doc_id",
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Features of one block each; size z-score, height share and font codes per document or global.

    ``scope="document"`` is what a model is served with, ``scope="global"`` what it is trained on.
    """
    feats = blocks.withColumns(
        {
            **text_features(F.col("text"), compat),
            **bbox_features(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")),
        }
    ).withColumn("avg_word_length", nb.ratio(F.col("text_length"), F.col("word_count")))
    if scope == "document":
        stats = {
            "_mean": F.avg("font_size"),
            "_std": F.stddev_samp("font_size"),
            "_ymax": F.max("y_center"),
        }
        feats = od.attach_stats(feats, [doc], stats, largest, limit)
        mean, std, ymax = F.col("_mean"), F.col("_std"), F.col("_ymax")
        keys = [doc]
    else:
        one = blocks.agg(
            F.struct(
                F.avg("font_size").alias("mean"),
                F.stddev_samp("font_size").alias("std"),
                F.max("y_center").alias("ymax"),
            ).alias("s")
        ).scalar()
        # Held in a column, so that the sub-query is planned once, not once a use.
        feats = feats.withColumn("_one", one)
        mean, std, ymax = F.col("_one.mean"), F.col("_one.std"), F.col("_one.ymax")
        keys = []
    share = F.col("y_center") / F.nullif(ymax, F.lit(0.0))
    feats = feats.withColumns(
        {
            "font_size_zscore": nb.ratio(F.col("font_size") - mean, std),
            "normalized_y_pos": F.coalesce(share, F.lit(0.0)),
            "is_top_third": nb.flag(share <= TOP_THIRD),
        }
    ).drop("_mean", "_std", "_ymax", "_one")
    return category_codes(feats, "font_name", "font_name_code", keys, largest=largest, limit=limit)


def network_features(df: DataFrame) -> DataFrame:
    """Length, box, alignment and style flags, from whichever of the known column names exist."""
    if "bbox" in df.columns:
        box = parse_bbox(F.col("bbox")) if dict(df.dtypes)["bbox"] == "string" else F.col("bbox")
        corner = [F.try_element_at(box, F.lit(i)) for i in (1, 2, 3, 4)]
    elif "x0" in df.columns:
        corner = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    else:
        corner = [F.lit(None).cast("double")] * 4
    align = first_existing(df, ALIGN_NAMES, F.lit("Left"))
    weight = first_existing(df, WEIGHT_NAMES, F.lit(0))
    italic = first_existing(df, ITALIC_NAMES, F.lit(False))
    text = text_features(F.col("text"))
    return df.withColumns(
        {
            "text_length": text["text_length"],
            "word_count": text["word_count"],
            **bbox_features(*corner),
            "is_center_aligned": nb.flag(align == "Center"),
            "is_left_aligned": nb.flag(align == "Left"),
            "is_bold": nb.flag(nb.number(weight.cast("string"), 400) >= BOLD_WEIGHT),
            "is_italic": nb.flag(italic.cast("boolean")),
        }
    )


def numeric_inputs(df: DataFrame, features: Sequence[str] = NETWORK_FEATURES) -> tuple[DataFrame, list[str]]:
    """The features that exist, as doubles; what is not a number is 0."""
    present = [f for f in features if f in df.columns]
    types = dict(df.dtypes)

    def value(f: str) -> Column:
        if types[f] == "string":
            return nb.number(F.col(f))
        return F.coalesce(F.col(f).cast("double"), F.lit(0.0))

    return df.withColumns({f: value(f) for f in present}), present


def next_distance(
    blocks: DataFrame,
    doc: str = "doc_id",
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add ``next_block_distance``: gap to the next block down the page, null on the last."""
    keys = [doc, "page"]
    order = ["y_center", "line_no"]
    rows, spans = od.chunked(blocks, keys, order, largest, limit)
    w = od.chunk_window(keys, order)
    nxt = F.lead("y0").over(w)
    if spans:
        rows = od.carry(
            rows,
            keys,
            [F.min_by("y0", F.struct(*order)).alias("_first")],
            lambda over: [F.lead("_first").over(over).alias("_carried")],
        )
        nxt = F.coalesce(nxt, F.col("_carried"))
    return rows.withColumn("next_block_distance", nxt - F.col("y1")).select(
        *blocks.columns, "next_block_distance"
    )


def heading_cues(df: DataFrame) -> DataFrame:
    """Cues for documents set in one font size; columns a frame lacks take their defaults."""

    def optional(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in df.columns else default

    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    return df.withColumns(
        {
            "is_bold": optional("is_bold", F.lit(False)),
            "is_all_caps": tx.is_upper(text),
            "starts_with_number": text.rlike(r"^\d+\.?\s"),
            "indentation": optional("x_coord", F.lit(0.0)),
            "text_length": F.char_length(text),
            "line_spacing_before": optional("space_before", F.lit(0.0)),
            "has_following_content": optional("next_block_distance", F.lit(0.0)) < FOLLOWING_GAP,
            "position_on_page": nb.ratio(
                optional("y_coord", F.lit(0.0)), optional("page_height", F.lit(1.0))
            ),
            "looks_like_title": tx.contains_any(low, TITLE_WORDS),
            "ends_with_colon": tx.strip(low).endswith(":"),
            "contains_heading_keywords": tx.contains_any(low, HEADING_KEYWORDS),
        }
    )


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: a struct of the mean and population deviation of each column."""
    parts = []
    for c in columns:
        parts.append(F.avg(c).alias(f"m_{c}"))
        parts.append(F.stddev_pop(c).alias(f"s_{c}"))
    return df.agg(F.struct(*parts).alias("s"))


def standardize(
    df: DataFrame, columns: Sequence[str], fitted: DataFrame | dict[str, float], prefix: str = "z_"
) -> DataFrame:
    """``(x - mean) / population deviation``; a constant column gives 0.

    ``fitted`` is a ``fit_scaler`` frame, planned into the same job, or its values once known.
    """
    if isinstance(fitted, dict):
        return df.withColumns(
            {
                f"{prefix}{c}": nb.ratio(F.col(c) - F.lit(fitted[f"m_{c}"]), F.lit(fitted[f"s_{c}"]))
                for c in columns
            }
        )
    held = df.withColumn("_fit", fitted.scalar())
    return held.withColumns(
        {
            f"{prefix}{c}": nb.ratio(F.col(c) - F.col(f"_fit.m_{c}"), F.col(f"_fit.s_{c}"))
            for c in columns
        }
    ).drop("_fit")


def stratified_split(
    df: DataFrame,
    label: str,
    identity: str,
    test_share: float = 0.2,
    out: str = "is_test",
    prefix_chars: int = 3,
) -> DataFrame:
    """Exact share of each class by the order of md5(identity), without sorting a class.

    Counts per (class, hash prefix) tell in which prefix the cut falls; only that prefix is ranked to
    find the hash of the last test row, and one threshold a class decides all rows. Both tables have a row a class and are
    broadcast: joined by class, all rows would meet in as many partitions as there are classes.
    """
    digest = F.md5(F.col(identity).cast("string"))
    hashed = df.select(label, digest.alias("_h")).withColumn("_p", F.substring("_h", 1, prefix_chars))
    per_prefix = hashed.groupBy(label, "_p").agg(F.count("*").alias("_n"))
    whole = W.partitionBy(label)
    running = whole.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    cuts = (
        per_prefix.withColumn("_goal", F.ceil(F.sum("_n").over(whole) * F.lit(float(test_share))))
        .withColumn("_sum", F.sum("_n").over(running))
        .filter((F.col("_sum") >= F.col("_goal")) & (F.col("_sum") - F.col("_n") < F.col("_goal")))
        .select(label, "_p", (F.col("_goal") - F.col("_sum") + F.col("_n")).alias("_take"))
    )
    ranked = W.partitionBy(label, "_p").orderBy("_h")
    thresholds = (
        hashed.join(F.broadcast(cuts), [label, "_p"])
        .withColumn("_r", F.row_number().over(ranked))
        .filter(F.col("_r") == F.col("_take"))
        .select(label, F.col("_h").alias("_last"))
    )
    return (
        df.join(F.broadcast(thresholds), label, "left")
        .withColumn(out, F.coalesce(digest <= F.col("_last"), F.lit(False)))
        .drop("_last")
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with the balanced weight ``all / (classes * n)``."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k")).alias("t")).scalar()
    held = counts.withColumn("_t", total)
    return held.withColumn(
        "weight", F.col("_t.n").cast("double") / (F.col("_t.k") * F.col("n")).cast("double")
    ).drop("_t")
