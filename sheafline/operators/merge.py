"""Greedy merges of neighbouring lines.

A group grows line by line in reading order, and whether the next line joins depends on the box and
head of the group so far, so the merge is a fold, not a lag. To keep folds small the lines are first
cut into segments at places where no merge can happen whatever the group looks like (that part *is* a
lag); only a segment is gathered into an array and folded.

A segment of very many lines is folded in chunks. What a chunk needs from those before it is the open group's head and box, a state of
fixed size, so every chunk is first folded as if a group began with it. Then each is entered with the state that the one before it
left: as soon as a line begins a group both ways, the rest is the same, and the state it leaves was right from the start. Chunks
that are left in another state than supposed are entered again, until none is. No frame holds more than a chunk, or about ``FRAME_ROWS``
lines of short ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import ordering as od
from .labels import BOLD_WEIGHT, is_centred
from .ordering import attach_stats

# Merge thresholds.
TITLE_LEAD = 4
TITLE_GAP = 40
SIZE_REACH = 1
CENTRE_GAP = 50
WEIGHT_REACH = 100

# Segments up to this many lines are folded by an array expression, longer ones line by line, very long ones in chunks.
FOLD_ROWS = 2_000
CHUNK_ROWS = 100_000
# Lines of short chunks that are handed to a worker at once.
FRAME_ROWS = 20_000


def _within(a, b, reach):
    """|a - b| <= reach, for columns and for numbers."""
    return (a - b <= reach) & (b - a <= reach)


def _segments(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    look_back: Sequence[str],
    breaks: Callable[[Column], Column],
    largest: int | None,
    limit: int | None,
) -> DataFrame:
    """Add ``_segment``: a counter that moves on at every certain break (``breaks(previous row)``)."""
    df, spans = od.chunked(df, keys, order, largest, limit)
    w = od.chunk_window(keys, order)
    before = F.struct(*look_back)
    df = df.withColumn("_before", F.lag(before).over(w))
    if spans:
        first = F.col("_before").isNull()
        df = od.carry(
            df,
            keys,
            [F.max_by(before, F.struct(*order)).alias("_last")],
            lambda over: [F.lag("_last").over(over).alias("_carried")],
        )
        df = df.withColumn("_before", F.when(first, F.col("_carried")).otherwise(F.col("_before")))
        df = df.drop("_carried")
    fresh = F.col("_before").isNull() | F.coalesce(breaks(F.col("_before")), F.lit(True))
    df = df.withColumn("_new", fresh.cast("int"))
    df = df.withColumn("_segment", F.sum("_new").over(w.rowsBetween(*od.UP_TO)))
    if spans:
        df = od.carry(
            df,
            keys,
            [F.sum("_new").alias("_n")],
            lambda over: [
                F.coalesce(F.sum("_n").over(over.rowsBetween(*od.BEFORE)), F.lit(0)).alias("_off")
            ],
        )
        df = df.withColumn("_segment", F.col("_segment") + F.col("_off")).drop("_off")
    return df.drop(od.CHUNK, "_new", "_before")


def _fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    joins: Callable,
    largest: int | None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Greedy left fold of every segment; ``joins(group, line)`` decides.

    Both ways treat nulls alike: a null text counts as empty inside a group, a null side of a box is passed over, a null in
    a test does not join, and null places come first.

    The array expression copies its groups at every step, which suits short segments. Where a document
    may hold longer ones, those go line by line through a linear loop.
    """
    if largest is not None and largest <= FOLD_ROWS:
        return _fold_arrays(df, keys, order, joins)
    where = [*keys, "_segment"]
    very_long = None
    chunk_rows = chunk_rows or CHUNK_ROWS
    if largest is None or largest > chunk_rows:
        # Counted and parted without a window: a page with a third of all rows goes into no single task.
        sizes = df.groupBy(*where).agg(F.count("*").alias("_length")).filter(F.col("_length") > chunk_rows).select(*where)
        sizes = cut_lineage(sizes)
        if not sizes.isEmpty():
            very_long = od.join_keys(df, sizes, where, "left_semi")
            df = od.join_keys(df, sizes, where, "left_anti")
    sized = df.withColumn("_length", F.count("*").over(W.partitionBy(*where)))
    short = sized.filter(F.col("_length") <= FOLD_ROWS).drop("_length")
    long = sized.filter(F.col("_length") > FOLD_ROWS).drop("_length")
    folded = _fold_arrays(short, keys, order, joins)
    folded = folded.unionByName(_fold_lines(long, keys, order, joins, folded.schema))
    if very_long is None:
        return folded
    return folded.unionByName(fold_in_chunks(very_long, keys, order, joins, chunk_rows).select(folded.columns))


_STATE = ("font_name", "font_size", "merge_weight", "x0", "y0", "x1", "y1", "x_center", "y_center")


class _Open:
    """The open group of a fold: what tests look at, no text."""

    def __init__(self, joins: Callable, values: dict):
        self.joins, self.values = joins, values

    def take(self, line: dict) -> bool:
        """Whether ``line`` joins; if not, it begins the next group."""
        group = self.values
        if group and self.joins(group, line):
            for side, pick in (("x0", np.fmin), ("y0", np.fmin), ("x1", np.fmax), ("y1", np.fmax)):
                group[side] = float(pick(group[side], line[side]))
            group["x_center"] = (group["x0"] + group["x1"]) / 2
            group["y_center"] = (group["y0"] + group["y1"]) / 2
            return True
        self.values = dict(line)
        return False


def _records(frame: pd.DataFrame, names: Sequence[str]) -> list[dict]:
    unknown = float("nan")
    held = frame[list(names)].to_dict("records")
    return [{k: unknown if v is None else v for k, v in line.items()} for line in held]


def _heads(joins: Callable, lines: list[dict], entry: dict | None) -> tuple[list[bool], dict]:
    """Which lines begin a group, entered with an open group or none, and the group left open."""
    group = _Open(joins, dict(entry) if entry else {})
    heads = [not group.take(line) for line in lines]
    return heads, group.values


def _as_text(state: dict, names: Sequence[str]) -> str:
    return json.dumps([None if v != v else v for v in (state[n] for n in names)])


def _as_state(text: str, names: Sequence[str]) -> dict:
    return {n: float("nan") if v is None else v for n, v in zip(names, json.loads(text))}


def fold_in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], joins: Callable, rows: int) -> DataFrame:
    """The greedy fold of segments of any length, with frames of at most ``rows`` lines; see the module."""
    names = [c for c in _STATE if c in df.columns]
    where = [*keys, "_segment"]
    placed = od.numbered(df, where, list(order), "_pos", limit=max(rows, 2)).withColumn("_part", F.floor((F.col("_pos") - 1) / rows).cast("int"))

    def name(part: Column) -> Column:
        return F.to_json(F.struct(*where, part.alias("_part")))

    placed = cut_lineage(placed.withColumn("_name", name(F.col("_part"))))
    lines = placed.select("_name", name(F.col("_part") + 1).alias("_next"), "_pos", *names)
    # Short chunks share a frame, so that frames follow from the number of lines.
    frames = -(-placed.count() // FRAME_ROWS) or 1

    def dealt(chunks: DataFrame):
        deal = F.col("_name") if rows >= FRAME_ROWS else F.pmod(F.xxhash64("_name"), F.lit(frames))
        return chunks.withColumn("_deal", deal).repartition(frames, "_deal").groupBy("_deal")

    def entered_chunks(frame: pd.DataFrame):
        """Per chunk of a frame, its rows in order: (their slice, entry, heads, the group left open)."""
        held = _records(frame, names)
        ends = np.flatnonzero((frame["_name"] != frame["_name"].shift(-1)).to_numpy()) + 1
        for lo, hi, entry in zip([0, *ends], ends, frame["_entry"].iloc[ends - 1]):
            yield slice(lo, hi), entry, *_heads(joins, held[lo:hi], _as_state(entry, names) if entry is not None else None)

    def in_order(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[np.lexsort((frame["_pos"], pd.factorize(frame["_name"])[0]))]

    def leave(frame: pd.DataFrame) -> pd.DataFrame:
        """The state that each chunk leaves when it is entered with ``_entry``."""
        frame = in_order(frame)
        found = [(at.start, _as_text(state, names)) for at, _, _, state in entered_chunks(frame)]
        return frame[["_name", "_next", "_entry"]].iloc[[lo for lo, _ in found]].assign(_left=[text for _, text in found])

    def run(chunks: DataFrame) -> DataFrame:
        """Lines with ``_entry`` -> (_name, _next, _entry, _left) of their chunks."""
        return cut_lineage(dealt(chunks).applyInPandas(leave, "_name string, _next string, _entry string, _left string"))

    known = run(lines.withColumn("_entry", F.lit(None).cast("string")))
    while True:
        before = known.select(F.col("_next").alias("_name"), F.col("_left").alias("_given"))
        wrong = known.join(before, "_name").filter(~F.col("_entry").eqNullSafe(F.col("_given")))
        again = cut_lineage(wrong.select("_name", F.col("_given").alias("_entry")))
        if again.isEmpty():
            break
        fresh = run(lines.join(again, "_name"))
        known = cut_lineage(known.join(again, "_name", "left_anti").unionByName(fresh))

    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        frame = in_order(frame)
        return frame[["_name", "_pos"]].assign(_head=[head for _, _, heads, _ in entered_chunks(frame) for head in heads])

    entered = lines.join(known.select("_name", "_entry"), "_name")
    heads = dealt(entered).applyInPandas(mark, "_name string, _pos int, _head boolean")
    marked = placed.join(heads, ["_name", "_pos"]).drop("_name")
    grouped = od.running_sum(marked, where, ["_pos"], {"_group": F.col("_head").cast("int")}, limit=max(rows, 2))
    return _closed_groups(grouped, [*where, "_group"]).drop("_segment")


def _closed_groups(lines: DataFrame, where: Sequence[str]) -> DataFrame:
    """One row a group: its head's columns, the union of the boxes, the texts in order, ``y_head`` and ``n_lines``."""
    own = [c for c in lines.columns if c not in (*where, "_pos", "_part", "_head")]

    def side(name: str, pick: Callable[[Column], Column]) -> Column:
        known = F.when(~F.isnan(name), F.col(name))
        return pick(known).alias(f"_{name}")

    texts = F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("text", F.lit("")).alias("t"))))  # the text of one group is one row
    per = lines.groupBy(*where).agg(
        F.min_by(F.struct(*own), "_pos").alias("_first"),
        *[side(c, F.min) for c in ("x0", "y0")],
        *[side(c, F.max) for c in ("x1", "y1")],
        F.array_join(F.transform(texts, lambda x: x["t"]), " ").alias("_text"),
        F.count("*").cast("int").alias("n_lines"),
    )
    many = F.col("n_lines") > 1
    changed = {
        "text": F.col("_text"), "x0": F.col("_x0"), "y0": F.col("_y0"), "x1": F.col("_x1"), "y1": F.col("_y1"),
        "x_center": (F.col("_x0") + F.col("_x1")) / 2, "y_center": (F.col("_y0") + F.col("_y1")) / 2,
    }
    columns = [F.when(many, changed[c]).otherwise(F.col(f"_first.{c}")).alias(c) if c in changed else F.col(f"_first.{c}").alias(c) for c in own]
    return per.select(*where, *columns, F.col("_first.y_center").alias("y_head"), "n_lines").drop("_group")


def _fold_lines(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], joins: Callable, schema: T.StructType
) -> DataFrame:
    names = [f.name for f in schema.fields]

    def fold(lines: pd.DataFrame) -> pd.DataFrame:
        groups: list[dict] = []
        texts: list[list[str]] = []
        # Not-a-number compares like a null: it is neither equal to anything nor within any reach.
        unknown = float("nan")
        for line in lines.sort_values(list(order), na_position="first").to_dict("records"):
            line = {k: unknown if v is None else v for k, v in line.items()}
            group = groups[-1] if groups else None
            if group is not None and joins(group, line):
                for side, pick in (("x0", np.fmin), ("y0", np.fmin), ("x1", np.fmax), ("y1", np.fmax)):
                    group[side] = float(pick(group[side], line[side]))
                group["x_center"] = (group["x0"] + group["x1"]) / 2
                group["y_center"] = (group["y0"] + group["y1"]) / 2
                group["n_lines"] += 1
                texts[-1].append(line["text"])
            else:
                groups.append({**line, "y_head": line["y_center"], "n_lines": 1})
                texts.append([line["text"]])
        for group, parts in zip(groups, texts):
            if len(parts) > 1:
                group["text"] = " ".join("" if p is unknown or p != p else p for p in parts)
        out = pd.DataFrame(groups)[names].astype(object)
        return out.where(out.notna(), None)

    return df.groupBy(*keys, "_segment").applyInPandas(fold, schema)


def _fold_arrays(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], joins: Callable
) -> DataFrame:
    payload = [c for c in df.columns if c not in (*keys, *order, "_segment")]
    line = F.struct(*order, *payload, F.col("y_center").alias("y_head"), F.lit(1).alias("n_lines"))
    fields = [*order, *payload, "y_head", "n_lines"]
    folded = df.groupBy(*keys, "_segment").agg(
        F.array_sort(F.collect_list(line)).alias("_lines")
    )

    def grown(group: Column, nxt: Column) -> Column:
        box = {
            "x0": F.least(group["x0"], nxt["x0"]),
            "y0": F.least(group["y0"], nxt["y0"]),
            "x1": F.greatest(group["x1"], nxt["x1"]),
            "y1": F.greatest(group["y1"], nxt["y1"]),
        }
        changed = {
            **box,
            "text": F.concat(F.coalesce(group["text"], F.lit("")), F.lit(" "), F.coalesce(nxt["text"], F.lit(""))),
            "x_center": (box["x0"] + box["x1"]) / 2,
            "y_center": (box["y0"] + box["y1"]) / 2,
            "n_lines": group["n_lines"] + nxt["n_lines"],
        }
        return F.struct(*[changed.get(f, group[f]).alias(f) for f in fields])

    def step(acc: Column, nxt: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when(
            joins(last, nxt),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown(last, nxt))),
        ).otherwise(F.concat(acc, F.array(nxt)))

    merged = F.aggregate(
        F.slice(F.col("_lines"), F.lit(2), F.size("_lines")),
        F.slice(F.col("_lines"), F.lit(1), F.lit(1)),
        step,
    )
    # A segment of one line is its own result; only longer ones run the fold.
    groups = F.when(F.size("_lines") == 1, F.col("_lines")).otherwise(merged)
    return folded.select(*keys, F.inline(groups))


def title_like(avg: Column) -> Column:
    return (
        (F.col("font_size") >= avg + TITLE_LEAD)
        & (F.col("weight") >= BOLD_WEIGHT)
        & is_centred(F.col("x_center"))
    )


def merge_titles(
    blocks: DataFrame,
    doc: str = "doc_id",
    largest: int | None = None,
    limit: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Join title-like lines that follow each other closely on a page.

    Adds ``n_lines``. A line joins when it is the next block of the page, is title-like itself, sits
    0 to 40 below the group, has the head's font and is within 1 of the head's size.
    """
    keys = [doc, "page"]
    order = ["y_center", "line_no"]
    marked = attach_stats(blocks, [doc], {"_avg": F.avg("font_size")}, largest, limit)
    # An unknown size, weight or place is not title-like, so every line is on one side.
    marked = marked.withColumn("_titleish", F.coalesce(title_like(F.col("_avg")), F.lit(False))).drop("_avg")
    cut = _segments(
        marked,
        keys,
        order,
        ["_titleish", "font_name", "font_size", "y1"],
        lambda b: ~(
            b["_titleish"]
            & F.col("_titleish")
            & (b["font_name"] == F.col("font_name"))
            & (F.abs(b["font_size"] - F.col("font_size")) <= 2 * SIZE_REACH)
            & (F.col("y0") >= b["y1"])
        ),
        largest,
        limit,
    )
    plain = cut.filter(~F.col("_titleish")).select(*blocks.columns, F.lit(1).alias("n_lines"))

    def joins(group, nxt):
        gap = nxt["y0"] - group["y1"]
        return (
            (gap >= 0)
            & (gap <= TITLE_GAP)
            & (group["font_name"] == nxt["font_name"])
            & _within(group["font_size"], nxt["font_size"], SIZE_REACH)
        )

    folded = _fold(cut.filter("_titleish").drop("_titleish"), keys, order, joins, largest, chunk_rows)
    return plain.unionByName(folded.select(*blocks.columns, "n_lines"))


def merge_blocks(
    blocks: DataFrame,
    doc: str = "doc_id",
    label: str = "label",
    largest: int | None = None,
    limit: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Join neighbouring lines of one label: same page and font, near in size, weight and height.

    The group's centre moves with its box. Adds ``n_lines`` and ``y_head`` (the first line's centre,
    which keeps the order of the groups). All labels are merged at once; filter before for one.
    Where the weight is not known it counts as 400 on both sides, which never separates lines.
    """
    keys = [doc, "page", label]
    order = ["y_center", "line_no"]
    weighted = "merge_weight" in blocks.columns
    look_back = ["font_name", "font_size"] + (["merge_weight"] if weighted else [])

    def apart(b: Column) -> Column:
        out = (b["font_name"] != F.col("font_name")) | (
            F.abs(b["font_size"] - F.col("font_size")) > 2 * SIZE_REACH
        )
        if weighted:
            out = out | (F.abs(b["merge_weight"] - F.col("merge_weight")) > 2 * WEIGHT_REACH)
        return out

    cut = _segments(blocks, keys, order, look_back, apart, largest, limit)

    def joins(group, nxt):
        out = (
            _within(group["font_size"], nxt["font_size"], SIZE_REACH)
            & (group["font_name"] == nxt["font_name"])
            & _within(nxt["y_center"], group["y_center"], CENTRE_GAP)
        )
        if weighted:
            out = out & _within(group["merge_weight"], nxt["merge_weight"], WEIGHT_REACH)
        return out

    return _fold(cut, keys, order, joins, largest, chunk_rows).select(*blocks.columns, "n_lines", "y_head")
