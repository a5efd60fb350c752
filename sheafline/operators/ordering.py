"""Ordered work inside groups of any size.

Reading order inside a document is ``(page, y_center, line_no)``. Windows over a document are fine
while the largest document is small; the caller proves that with a row count, or the operators take
it themselves. Beyond ``MAX_GROUP_ROWS`` the rows are range-partitioned on (group, order) and each
partition is cut into chunks, so one hot group is spread over many chunks, and every running value is
computed inside the chunks and then shifted by what the earlier chunks of the same group contribute
(one summary row per chunk). The partitions follow from the number of rows alone, however small the chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_GROUP_ROWS = 2_000_000
ROWS_PER_CHUNK = 1_000_000
CHUNK = "_chunk"

READING_ORDER = ("page", "y_center", "line_no")


def group_profile(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(all rows, rows of the largest group): one aggregate, two numbers to the driver."""
    row = (
        df.groupBy(*keys)
        .count()
        .agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0)))
        .first()
    )
    return int(row[0]), int(row[1])


def chunked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    largest: int | None = None,
    limit: int | None = None,
) -> tuple[DataFrame, bool]:
    """Add ``_chunk``, ascending along ``order`` inside a group; no chunk has more than ``limit`` rows.

    Returns the frame and whether a group may span chunks. ``largest`` is a known bound on the rows
    of a group; without it the group sizes are counted.
    """
    limit = MAX_GROUP_ROWS if limit is None else limit
    total = None
    if largest is None:
        total, largest = group_profile(df, keys)
    if largest <= limit:
        return df.withColumn(CHUNK, F.lit(0)), False
    if total is None:
        total = df.count()
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(default, -(-total // ROWS_PER_CHUNK))
    ranged = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    # The identity is the partition's number and, in its 33 lower bits, the row's place: no chunk spans partitions.
    place = F.monotonically_increasing_id()
    row = place.bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ranged.withColumn(CHUNK, place - row % F.lit(max(limit, 1)))
    # The range bounds are sampled, so the chunk numbers must be stored before they are relied on.
    return cut_lineage(ranged), True


def _columns(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def chunk_window(keys: Sequence[str], order: Sequence[Column | str]):
    return W.partitionBy(*keys, CHUNK).orderBy(*_columns(order))


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where nulls meet nulls, as they do in a window; the left side's keys stay."""
    named = right.select(*[F.col(k).alias(f"_right_{k}") if k in keys else F.col(k) for k in right.columns])
    same = [left[k].eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return left.join(named, condition, how).drop(*[f"_right_{k}" for k in keys])


def carry(
    df: DataFrame,
    keys: Sequence[str],
    summary: Sequence[Column],
    carried: Callable[[W], Sequence[Column]],
) -> DataFrame:
    """Join to each chunk what the earlier chunks of its group add up to.

    ``summary`` aggregates one chunk; ``carried`` turns a window over a group's chunks into
    columns. There is one summary row per (group, chunk), i.e. groups + chunks rows in all.
    """
    per_chunk = df.groupBy(*keys, CHUNK).agg(*summary)
    over = W.partitionBy(*keys).orderBy(CHUNK)
    shifts = per_chunk.select(*keys, CHUNK, *carried(over))
    return join_keys(df, shifts, [*keys, CHUNK])


BEFORE = (W.unboundedPreceding, -1)
UP_TO = (W.unboundedPreceding, 0)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    values: dict[str, Column],
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Inclusive running sums inside each group; ``values`` maps the new names to the addends."""
    df, spans = chunked(df, keys, order, largest, limit)
    w = chunk_window(keys, order).rowsBetween(*UP_TO)
    if not spans:
        return df.select("*", *[F.sum(v).over(w).alias(n) for n, v in values.items()]).drop(CHUNK)
    df = carry(
        df,
        keys,
        [F.sum(v).alias(f"_sum_{n}") for n, v in values.items()],
        lambda over: [
            F.coalesce(F.sum(f"_sum_{n}").over(over.rowsBetween(*BEFORE)), F.lit(0)).alias(f"_off_{n}")
            for n in values
        ],
    )
    out = df.select(
        "*", *[(F.sum(v).over(w) + F.col(f"_off_{n}")).alias(n) for n, v in values.items()]
    )
    return out.drop(CHUNK, *[f"_off_{n}" for n in values])


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str,
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """1-based position inside each group."""
    out = running_sum(df, keys, order, {name: F.lit(1)}, largest, limit)
    return out.withColumn(name, F.col(name).cast("int"))


def line_chunk(line_col: str = "line_no", rows: int = ROWS_PER_CHUNK) -> Column:
    """Salt of bounded size: at most ``rows`` lines of a document share a value; lines without a number share one."""
    return F.coalesce(F.floor(F.col(line_col) / rows).cast("int"), F.lit(0))


def is_bounded(largest: int | None, limit: int | None = None) -> bool:
    """Whether a known bound on the rows of a group allows a plain window over it."""
    return largest is not None and largest <= (MAX_GROUP_ROWS if limit is None else limit)


def attach_stats(
    df: DataFrame,
    keys: Sequence[str],
    aggs: dict[str, Column],
    largest: int | None = None,
    limit: int | None = None,
    line_col: str = "line_no",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Group statistics on every row.

    Groups of a known small size take a window: one read and one shuffle, whose partitioning the next
    operators on the same document reuse. Otherwise the statistics are aggregated (combined map-side)
    and joined back on (keys, line chunk), the one row of a group repeated for the chunks that group
    has, so that a hot group is spread evenly.
    """
    if is_bounded(largest, limit):
        w = W.partitionBy(*keys)
        return df.select("*", *[agg.over(w).alias(name) for name, agg in aggs.items()])
    chunk = line_chunk(line_col, rows_per_chunk)
    stats = (
        df.groupBy(*keys)
        .agg(
            *[agg.alias(name) for name, agg in aggs.items()],
            F.min(chunk).alias("_lo"),
            F.max(chunk).alias("_hi"),
        )
        .withColumn("_salt", F.explode(F.sequence("_lo", "_hi")))
        .drop("_lo", "_hi")
    )
    return join_keys(df.withColumn("_salt", chunk), stats, [*keys, "_salt"]).drop("_salt")
