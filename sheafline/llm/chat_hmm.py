"""Chat formatting: a hidden Markov model over the lines of a transcript recovers turns and roles, then turns are rendered.

A transcript is numbered lines (conv_id, n, line), no more: neither turns nor roles are given, and some turns carry no speaker marker.
Every line gives one observation: the class of its marker, its length, and whether it asks. States are the roles, each beginning a
turn or inside one; a line inside a turn has the role of the line before it. The tables of moves and observations are counted from
labelled transcripts (grouped counts, add-one). On the Viterbi path a turn begins where a beginning state stands; it is rendered as
``<|role|>``, its lines without markers, and ``<|end|>``.

Scale: a conversation of any length, and a turn of any length. Lines are numbered by a distributed prefix count and dealt into chunks
of ``CHUNK`` lines; each chunk gives the best score from every state before it to every state at its end, chunks of chunks are combined
in levels of ``CHUNK``, and the states at the borders go back down the levels, so a call holds about ``CALL_ROWS`` lines and the path is
the exact Viterbi path. Turns are counted by a running sum, and a turn is rendered in parts of at most ``PART_LINES`` lines.

Defined results: a null or empty line is a blank line of the turn around it; an unknown marker is text; ties go to the state named
first; null conversation ids are one conversation; lines without a number come first, lines of one number in the order of their text;
repeated lines stay; other columns are ignored, whatever their names; an empty table gives no turns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ordering as od
from .frames import stored

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for begins in (True, False) for role in ROLES]
CHUNK = 64
CALL_ROWS = 20_000
PART_LINES = 2000
NEVER = -1e9

# Marker words of each role, in lower case.
MARKERS = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "q", "question", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "gpt", "model"),
}
MARKER = r"^\s*(?:#{1,3}\s*|<\|?|\[|\*\*)?([A-Za-z]{1,12})(?:\|?>|\]|\*\*)?\s*[:>\-]\s*"
LENGTHS = (40, 120, 320, 900)


def observed(lines: DataFrame) -> DataFrame:
    """Add ``mark`` (a role, ``other`` or empty), ``body`` (the line without a known marker) and ``obs``, a small number."""
    line = F.coalesce(F.col("line"), F.lit(""))
    word = F.lower(F.regexp_extract(line, MARKER, 1))
    mark = F.when(word == "", F.lit(""))
    for role, words in MARKERS.items():
        mark = mark.when(word.isin(*words), F.lit(role))
    mark = mark.otherwise(F.lit("other"))
    out = lines.withColumn("mark", mark)
    known = F.col("mark").isin(*ROLES)
    out = out.withColumn("body", F.when(known, F.regexp_replace(line, MARKER, "")).otherwise(line))
    kinds = F.array_position(F.array(*[F.lit(m) for m in ("", "other", *ROLES)]), F.col("mark")).cast("int") - 1
    n = F.length("body")
    size = F.lit(0)
    for cut in LENGTHS:
        size = size + F.when(n > cut, 1).otherwise(0)
    asks = F.col("body").rlike(r"\?\s*$").cast("int")
    return out.withColumn("obs", (kinds * 5 + size) * 2 + asks)


N_OBS = 5 * 5 * 2


@dataclass
class Tables:
    """log probabilities: of the first line's state, of each move, and of the observations in each state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _next_states(rows: DataFrame) -> DataFrame:
    """(a, b, n): how often a line in state ``a`` is followed by one in state ``b``; the number is part of the key, so no key is hot."""
    nxt = rows.select("conv_key", (F.col("pos") - 1).alias("pos"), F.col("state").alias("b"))
    return rows.select("conv_key", "pos", F.col("state").alias("a")).join(nxt, ["conv_key", "pos"]).groupBy("a", "b").agg(F.count("*").alias("n"))


def fit(rows: DataFrame) -> Tables:
    """``rows``: numbered, observed lines with their true ``role`` and ``begins``; only counts of states leave Spark."""
    at = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int") - 1
    known = rows.filter(F.col("role").isin(*ROLES)).withColumn("state", at + F.when(F.col("begins"), 0).otherwise(len(ROLES)))
    known = stored(known.select("conv_key", "pos", "state", "obs"), "states")
    n = len(STATES)
    emit, move, start = np.ones((n, N_OBS)), np.ones((n, n)), np.ones(n)
    for r in known.groupBy("state", "obs").count().collect():  # as many rows as states and observations
        emit[r["state"], r["obs"]] += r["count"]
    for r in _next_states(known).collect():
        move[r["a"], r["b"]] += r["n"]
    for r in known.filter("pos = 1").groupBy("state").count().collect():
        start[r["state"]] += r["count"]
    for b, (role, begins) in enumerate(STATES):
        if not begins:  # the first line begins a turn; inside a turn the role stays
            start[b] = 0
            move[[a for a, (other, _) in enumerate(STATES) if other != role], b] = 0

    def logs(x: np.ndarray) -> np.ndarray:
        share = x / x.sum(axis=-1, keepdims=True)
        return np.where(share > 0, np.log(np.maximum(share, 1e-300)), NEVER)

    return Tables(logs(start), logs(move), logs(emit))


def _best_products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max-plus product and, for each pair, the state in between (the first of equals)."""
    ways = a[:, :, None] + b[None, :, :]
    return ways.max(axis=1), ways.argmax(axis=1)


def _fold(steps: list[np.ndarray]) -> np.ndarray:
    total = steps[0]
    for step in steps[1:]:
        total, _ = _best_products(total, step)
    return total


def _trace(steps: list[np.ndarray], first: int, last: int) -> list[int]:
    """States after each step of the best path that starts in ``first`` and ends in ``last``."""
    score, backs = steps[0][first], []
    for step in steps[1:]:
        ways = score[:, None] + step
        backs.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    path = [last]
    for back in reversed(backs):
        path.append(int(back[path[-1]]))
    return path[::-1]


_ORDER = ["pos"]


def _steps(tables: Tables, steps) -> list[np.ndarray]:
    """A matrix a line: from the state before it to its own. What stands before a first line (from ``N_OBS`` on) does not matter."""
    return [(tables.move if o < N_OBS else tables.start[None, :].repeat(len(STATES), 0)) + tables.emit[:, o % N_OBS][None, :] for o in steps]


def numbered(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Lines with ``conv_key`` and ``pos``, 1, 2, ... through each conversation, however long it is."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return od.numbered(lines.withColumn("conv_key", key), ["conv_key"], ["n", "line"], "pos", limit=limit)


def _grouped(df: DataFrame, keys: list[str], order: list[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, n_rows: int) -> DataFrame:
    """``run`` on frames of many whole groups of ``keys``, sorted, with the row at which each group starts (and the end).

    Groups are dealt by hash into calls of about ``CALL_ROWS`` rows: most conversations are short, and a call each would cost
    more than its work. ``n_rows`` is the number of rows of ``df``; the number of calls grows with it.
    """
    calls = F.pmod(F.xxhash64(*keys), F.lit(-(-max(n_rows, 1) // CALL_ROWS)))

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*keys, *order], na_position="first", ignore_index=True)
        at = frame.groupby(keys, sort=False).ngroup().to_numpy()
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        return run(frame, np.append(starts, len(frame)))

    return df.withColumn("_call", calls).groupBy("_call").applyInPandas(each, schema)


def _summed(rows: DataFrame, keys: list[str], order: list[str], values: str, matrices: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """The product of the matrices of each group's ``values``."""

    def run(frame: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        held = frame[values].to_numpy()
        totals = [_fold(matrices(held[lo:hi])).ravel().tolist() for lo, hi in zip(edges, edges[1:])]
        return frame.loc[edges[:-1], keys].assign(matrix=totals)

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    narrow = rows.select(*keys, *order, values)
    return _grouped(narrow, keys, order, run, f"{kinds}, matrix array<double>", rows.count())


def decode(lines: DataFrame, tables: Tables) -> DataFrame:
    """``lines`` (numbered and observed) with ``role_pred`` and ``begins_pred``, from the Viterbi path of their conversation."""
    n = len(STATES)
    step = F.col("obs") + F.when(F.col("pos") == 1, N_OBS).otherwise(0)
    rows = lines.withColumns({"chunk": F.floor((F.col("pos") - 1) / CHUNK).cast("bigint"), "step": step})
    rows = stored(rows, "lines")
    square = lambda m: np.array(m).reshape(n, n)

    def of_lines(steps: np.ndarray) -> list[np.ndarray]:
        return _steps(tables, steps)

    def of_chunks(held: np.ndarray) -> list[np.ndarray]:
        return [square(m) for m in held]

    levels = [stored(_summed(rows, ["conv_key", "chunk"], _ORDER, "step", of_lines), "chunks")]
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) > 0:
        up = levels[-1].withColumn("part", F.floor(F.col("chunk") / CHUNK).cast("bigint"))
        up = _summed(up, ["conv_key", "part"], ["chunk"], "matrix", of_chunks).withColumnRenamed("part", "chunk")
        levels.append(stored(up, "chunks"))
    def ends(group: pd.DataFrame) -> pd.DataFrame:
        ways = np.stack([square(m) for m in group["matrix"]])
        flat = ways.reshape(len(group), -1).argmax(axis=1)
        return pd.DataFrame({"conv_key": group["conv_key"], "chunk": group["chunk"], "first": flat // n, "last": flat % n})

    def ends_of(batches):
        for group in batches:
            yield ends(group)

    borders = levels[-1].mapInPandas(ends_of, "conv_key string, chunk bigint, first int, last int")

    def down(frame: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        first, last = frame["first"].to_numpy(copy=True), frame["last"].to_numpy(copy=True)
        held = frame["matrix"].to_numpy()
        for lo, hi in zip(edges, edges[1:]):
            path = _trace([square(m) for m in held[lo:hi]], int(first[lo]), int(last[lo]))
            first[lo:hi], last[lo:hi] = [first[lo], *path[:-1]], path
        return frame[["conv_key", "chunk"]].assign(first=first, last=last)

    for level in reversed(levels[:-1]):
        own = level.withColumn("part", F.floor(F.col("chunk") / CHUNK).cast("bigint"))
        above = borders.withColumnRenamed("chunk", "part")
        kinds = "conv_key string, chunk bigint, first int, last int"
        borders = _grouped(own.join(above, ["conv_key", "part"]), ["conv_key", "part"], ["chunk"], down, kinds, level.count())

    names = rows.columns

    def states(frame: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        steps, first, last = (frame[c].to_numpy() for c in ("step", "first", "last"))
        path = [k for lo, hi in zip(edges, edges[1:]) for k in _trace(_steps(tables, steps[lo:hi]), int(first[lo]), int(last[lo]))]
        return frame[names].assign(role_pred=[STATES[k][0] for k in path], begins_pred=[STATES[k][1] for k in path])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.join(borders, ["conv_key", "chunk"])
    found = _grouped(placed, ["conv_key", "chunk"], _ORDER, states, f"{kinds}, role_pred string, begins_pred boolean", rows.count())
    return found.drop("chunk", "step")


def recover(lines: DataFrame, tables: Tables, limit: int | None = None) -> DataFrame:
    """(conv_id, n, line) -> the lines with ``pos``, ``body``, ``turn`` (0, 1, ... through the conversation) and ``role_pred``."""
    found = decode(observed(numbered(lines.select("conv_id", "n", "line"), limit)), tables)
    begun = F.col("begins_pred").cast("int")
    counted = od.running_sum(stored(found, "states"), ["conv_key"], ["pos"], {"turn": begun}, limit=limit)
    return counted.withColumn("turn", (F.col("turn") - 1).cast("bigint"))


def rendered(lines: DataFrame) -> DataFrame:
    """Recovered lines -> a row for each turn, of over ``PART_LINES`` lines for each part of it.

    (conv_id, turn, part, first_line, n_lines, role, rendered): the first part opens the turn and the last one ends it.
    """
    lines = stored(lines, "turn-lines")
    turns = lines.groupBy("conv_key", "turn").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    turns = stored(turns, "turns")
    parts = lines.join(turns, ["conv_key", "turn"]).withColumn("part", F.floor((F.col("pos") - F.col("_lo")) / PART_LINES).cast("int"))
    per = parts.groupBy("conv_key", "turn", "part").agg(
        F.any_value("conv_id").alias("conv_id"),
        F.min("pos").alias("first_line"),
        F.count("*").alias("n_lines"),
        F.any_value("role_pred").alias("role"),
        F.max("pos").alias("_end"),
        F.any_value("_hi").alias("_hi"),
        F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("_lines"),  # at most PART_LINES
    )
    text = F.array_join(F.transform("_lines", lambda x: x["body"]), "\n")
    head = F.when(F.col("part") == 0, F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))).otherwise(F.lit(""))
    tail = F.when(F.col("_end") == F.col("_hi"), F.lit("\n<|end|>")).otherwise(F.lit("\n"))
    return per.select("conv_id", "conv_key", "turn", "part", "first_line", "n_lines", "role", F.concat(head, text, tail).alias("rendered"))


def transcript(conversations: DataFrame, marked: Column, limit: int | None = None) -> DataFrame:
    """(conv_id, n, line, role, begins) of a table of conversations: its turns' lines, numbered through each conversation.

    Where ``marked`` holds, a turn's first line carries its role's marker. ``role`` and ``begins`` are the truth, for learning and for
    comparison; ``recover`` takes the first three columns.
    """
    styles = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    names = F.create_map(*[F.lit(x) for role, words in MARKERS.items() for x in (role, "|".join(words[:3]))])
    word = F.element_at(F.split(names[F.col("role")], r"\|"), (styles + 1).cast("int"))
    head = F.when(marked & F.col("role").isin(*ROLES), F.concat(F.initcap(word), F.lit(": "))).otherwise(F.lit(""))
    parts = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    lines = conversations.select("conv_id", "turn", "role", head.alias("head"), F.xxhash64("text").alias("of"), F.posexplode(parts).alias("line_no", "line"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    order = ["turn", "of", "role", "line_no", "line"]
    rows = od.numbered(lines.withColumn("_key", key), ["_key"], order, "n", limit=limit)
    begins = F.col("line_no") == 0
    return rows.select("conv_id", "n", F.when(begins, F.concat("head", "line")).otherwise(F.col("line")).alias("line"), "role", begins.alias("begins"))


def formatted(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """Recover and render the turns of transcripts in which three turns of ten carry no marker.

    The tables are counted on the conversations outside fold 0 of five. Returns, a row for each recovered turn (or part): conv_id,
    turn, part, first_line, n_lines, held_out, role_pred, ``begins`` (whether a turn of the table begins at its first line),
    ``correct`` (whether that line has the role), ``n_begins`` (turns of the table that begin in its lines) and rendered.
    """
    marked = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) < 7
    truth = stored(transcript(conversations, marked, limit), "transcript")
    learn = observed(numbered(truth.filter(~held_out_of(F.col("conv_id"))), limit))
    found = stored(recover(truth, fit(learn), limit), "recovered")
    known = truth.withColumn("conv_key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    known = known.select("conv_key", F.col("n").alias("pos"), "role", "begins")
    begun = found.select("conv_key", "pos", "turn").join(known, ["conv_key", "pos"])
    # A part's lines follow each other, so its truth is that of its first line and a count.
    per = rendered(found)
    at_first = known.select("conv_key", F.col("pos").alias("first_line"), F.col("role").alias("_role"), F.col("begins").alias("_begins"))
    lo = found.groupBy("conv_key", "turn").agg(F.min("pos").alias("_lo"))
    counted = begun.join(lo, ["conv_key", "turn"]).groupBy("conv_key", "turn", F.floor((F.col("pos") - F.col("_lo")) / PART_LINES).cast("int").alias("part"))
    counted = counted.agg(F.count_if("begins").alias("n_begins"))
    out = per.join(at_first, ["conv_key", "first_line"]).join(counted, ["conv_key", "turn", "part"])
    return out.select(
        "conv_id",
        "turn",
        "part",
        "first_line",
        "n_lines",
        held_out_of(F.col("conv_id")).alias("held_out"),
        F.col("role").alias("role_pred"),
        F.col("_begins").alias("begins"),
        F.col("role").eqNullSafe(F.col("_role")).alias("correct"),
        "n_begins",
        "rendered",
    )


def held_out_of(conv_id: Column) -> Column:
    return F.coalesce(F.crc32(conv_id.cast("string")) % 5, F.lit(0)) == 0
