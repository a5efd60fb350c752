"""Text vectors and the places where users plug in their own models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .labels import LEVELS
from .merge import _segments

# Similarity from which headings are one, and the default vector length.
SAME_TOPIC = 0.8
VECTOR_SIZE = 512
# Headings that a call of a model or a fold gets at once, about.
CALL_ROWS = 5_000


def encode_hashed(df: DataFrame, text: str, out: str = "vector", size: int = VECTOR_SIZE) -> DataFrame:
    """Token counts hashed into ``size`` slots (the built-in encoder)."""
    counted = HashingTF(inputCol="_toks", outputCol="_tf", numFeatures=size).transform(
        df.withColumn("_toks", tx.tokens(F.coalesce(F.col(text), F.lit(""))))
    )
    return counted.withColumn(out, vector_to_array("_tf", "float32")).drop("_toks", "_tf")


def encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """Wrap a user's model: ``load`` runs once a worker, its result encodes one batch of texts."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors = np.asarray(model(texts.fillna("").tolist()), dtype="float32")
            yield pd.Series(list(vectors))

    return encode


def summarizer(load: Callable[[], Callable[[list[str]], list[str]]]) -> Callable[[Column], Column]:
    """Wrap a user's text-to-text model the same way."""

    @F.pandas_udf(T.StringType())
    def summarize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    return summarize


def _counts(tokens) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in tokens:
        out[t] = out.get(t, 0) + 1
    return out


def merge_semantic(
    blocks: DataFrame,
    doc: str = "doc_id",
    same: float = SAME_TOPIC,
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Join successive headings of one level and page while the text so far is similar to the next.

    Similarity is the cosine of token counts, so the vector of the joined text is the sum of its parts
    and nothing is encoded twice. If two lines are both within angle a of the text between them, they
    are within 2a of each other; successive headings further apart than that can never be joined, and
    cut the level into the short runs that are folded. Only the text of the first heading grows.
    """
    keys = [doc, "page", "label"]
    order = ["y_center", "line_no"]
    heads = blocks.filter(F.col("label").isin(LEVELS)).withColumn("_toks", tx.tokens(F.col("text")))
    floor = 2 * same * same - 1 - 1e-9

    def apart(before: Column) -> Column:
        dot = F.aggregate(
            F.col("_toks"),
            F.lit(0),
            lambda acc, t: acc + F.size(F.filter(before["_toks"], lambda x: x == t)),
        )
        scale = F.sqrt(
            tx.squared_norm(F.col("_toks")).cast("double") * tx.squared_norm(before["_toks"])
        )
        return F.coalesce(dot / F.nullif(scale, F.lit(0.0)), F.lit(0.0)) <= floor

    cut = _segments(heads, keys, order, ["_toks"], apart, largest, limit)
    columns = list(blocks.columns)
    schema = T.StructType([*blocks.schema.fields, T.StructField("n_lines", T.IntegerType())])

    run = [*keys, "_segment"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*run, *order])
        groups: list[dict] = []
        total: dict[str, int] = {}
        last = None
        for number, row in zip(pdf.groupby(run, sort=False, dropna=False).ngroup(), pdf.to_dict("records")):
            if number != last:
                last, total = number, {}
            counts = _counts(row["_toks"])
            dot = sum(c * total.get(t, 0) for t, c in counts.items())
            scale = sum(c * c for c in counts.values()) * sum(c * c for c in total.values())
            if scale > 0 and dot / scale**0.5 > same:
                groups[-1]["text"] += " " + row["text"]
                groups[-1]["n_lines"] += 1
                for t, c in counts.items():
                    total[t] = total.get(t, 0) + c
            else:
                groups.append({**row, "n_lines": 1})
                total = counts
        return pd.DataFrame(groups)[[*columns, "n_lines"]]

    sized = cut.withColumn("_run", F.count("*").over(W.partitionBy(*run)))
    alone = sized.filter(F.col("_run") == 1).select(*columns, F.lit(1).alias("n_lines"))
    # Runs are short: many share a frame. Null keys have frames of their own, so that whole numbers stay whole in the others.
    calls = -(-max(heads.count(), 1) // CALL_ROWS)
    dealt = sized.filter(F.col("_run") > 1).drop("_run").withColumn("_call", F.pmod(F.xxhash64(*keys), F.lit(calls)))
    frames = dealt.groupBy("_call", *[F.col(k).isNull().alias(f"_no_{k}") for k in keys])
    merged = frames.applyInPandas(fold, schema)
    rest = blocks.filter(~F.coalesce(F.col("label").isin(LEVELS), F.lit(False)))
    return merged.unionByName(alone).unionByName(rest.withColumn("n_lines", F.lit(1)))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; 0 where a vector is zero."""
    scale = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.divide((a * b).sum(axis=1), scale, out=np.zeros(len(a)), where=scale > 0)


def _wave_fold(model: Callable[[list[str]], np.ndarray], texts: list[str], starts: np.ndarray, same: float) -> tuple[np.ndarray, dict[int, str]]:
    """(which lines begin a group, grown text of a group by its first line) for many runs, all moving on one line a round.

    ``starts``: the first line of each run, and the end. The lines are encoded once; a round encodes the open groups that grew in the
    round before, of all runs together, in one call.
    """
    heads = np.zeros(len(texts), bool)
    heads[starts[:-1]] = True
    if not len(texts):
        return heads, {}
    lines = np.asarray(model(texts), dtype=float)
    open_at, at, end = starts[:-1].copy(), starts[:-1] + 1, starts[1:]
    group = lines[open_at].copy()
    parts: dict[int, list[str]] = {}
    live = np.flatnonzero(at < end)
    grown = np.zeros(len(open_at), bool)
    while len(live):
        again = live[grown[live]]
        if len(again):
            group[again] = np.asarray(model([" ".join(parts[k]) for k in open_at[again].tolist()]), dtype=float)
            grown[again] = False
        joins = _cosines(group[live], lines[at[live]]) > same
        for k in live[joins].tolist():
            parts.setdefault(int(open_at[k]), [texts[open_at[k]]]).append(texts[at[k]])
        grown[live[joins]] = True
        fresh = live[~joins]
        heads[at[fresh]] = True
        open_at[fresh] = at[fresh]
        group[fresh] = lines[at[fresh]]
        at[live] += 1
        live = live[at[live] < end[live]]
    return heads, {k: " ".join(held) for k, held in parts.items()}


def merge_semantic_dense(
    blocks: DataFrame,
    load: Callable[[], Callable[[list[str]], np.ndarray]],
    doc: str = "doc_id",
    same: float = SAME_TOPIC,
    call_rows: int = CALL_ROWS,
) -> DataFrame:
    """``merge_semantic`` with a user's encoder: the text of a group so far is encoded anew whenever it has grown.

    ``load`` runs once a call and gives a function from texts to vectors. Runs (headings of one level and page) are dealt into calls of
    about ``call_rows`` lines by a hash; in a call they move on together, so the model sees batches. A run of any length is one call's.
    Null texts count as empty; null documents and pages are runs of their own; nulls in the order come first.
    """
    keys = [doc, "page", "label"]
    columns = list(blocks.columns)
    is_head = F.coalesce(F.col("label").isin(LEVELS), F.lit(False))
    heads = blocks.filter(is_head)
    calls = F.pmod(F.xxhash64(*keys), F.lit(-(-max(heads.count(), 1) // call_rows)))
    schema = T.StructType([*blocks.schema.fields, T.StructField("n_lines", T.IntegerType())])

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*keys, "y_center", "line_no"], na_position="first", ignore_index=True)
        run = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        starts = np.append(np.flatnonzero(np.diff(run, prepend=-1)), len(frame))
        given = frame["text"]
        first, text = _wave_fold(load(), given.fillna("").tolist(), starts, same)
        at = np.flatnonzero(first)
        out = frame.iloc[at][columns].reset_index(drop=True)
        out["text"] = [text.get(k, given.iloc[k]) for k in at.tolist()]
        out["n_lines"] = np.diff(np.append(at, len(frame))).astype("int32")
        out = out.astype(object)
        return out.where(out.notna(), None)

    merged = heads.withColumn("_call", calls).groupBy("_call").applyInPandas(fold, schema)
    return merged.unionByName(blocks.filter(~is_head).withColumn("n_lines", F.lit(1)))
