"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of surface features. The weights are learnt from preference pairs (a good
document is preferred to a bad one) by logistic loss on feature differences. A quantile of the training strengths is the
threshold: of all quantiles the one whose two sides agree best with the labels. Scores are a logistic curve of the
strength that passes 0.3 at the threshold.

The fit uses a bounded sample of labelled rows (``per_label`` of each label); scoring maps whole texts and
shuffles nothing. Labels, language, source and id are no features.

Defined results: null and empty texts have features like others (all zero but for the constant ones); without labelled rows of
both kinds every score is 0.5; repeated rows are scored a row each; labels of unknown documents, or null ones, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textblocks as tb
from .frames import bounded_draw, crc_fold, fresh

PER_LABEL = 4000
PAIRS = 40_000
CUT = 0.3

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "high": range(0x80, 0x100),
    "mark": b"#*$%&<>~^=_+@\\",
    "pipe": b"|",
    "shout": b"!?",
    "stop": b".,;:",
    "bracket": b"()[]{}/\"'-",
    "line": b"\n",
}
_MEMBER = np.zeros((256, len(_CLASSES)), np.float32)
for _k, _members in enumerate(_CLASSES.values()):
    _MEMBER[list(_members), _k] = 1


def features(texts: pa.Array) -> np.ndarray:
    """(rows, features) of a slice of texts."""
    data, offsets = tb.raw_bytes(texts)
    rows = len(texts)
    row_of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    histogram = np.bincount(row_of_byte * 256 + data, minlength=rows * 256).reshape(rows, 256)
    kinds = histogram @ _MEMBER
    k = {name: kinds[:, i] for i, name in enumerate(_CLASSES)}
    starts, ends, firsts = tb.word_spans(data, offsets)
    n = np.diff(firsts)
    row = np.repeat(np.arange(rows), n)
    words = tb.word_hashes(data, starts, ends)
    # Distinct words of a row: sort them inside their row.
    keyed = np.sort((row.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24)))
    fresh = np.ones(len(keyed), bool)
    fresh[1:] = keyed[1:] != keyed[:-1]
    distinct = np.bincount((keyed >> np.uint64(40)).astype(np.int64), fresh, rows)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    repeats = np.bincount(row, again, rows)
    chars = np.bincount(row, ends - starts, rows)
    words_n, letters = np.maximum(n, 1), np.maximum(k["upper"] + k["lower"] + k["high"], 1)
    shares = [
        k["upper"] / letters,
        np.minimum(k["mark"] / words_n, 3),
        np.minimum(k["pipe"] / words_n, 1),
        np.minimum(k["shout"] / words_n, 3),
        k["digit"] / np.maximum(chars, 1),
        np.minimum(k["stop"] / words_n, 2),
        np.minimum(k["bracket"] / words_n, 2),
        np.minimum(k["line"] / words_n, 1),
        distinct / words_n,
        repeats / words_n,
        np.log1p(n) / 10,
        np.minimum(chars / words_n, 30) / 10,
    ]
    # Small shares matter too, so each share also stands as its root.
    roots = [np.sqrt(s) for s in shares[:10]]
    return np.stack([*shares, *roots, (distinct / words_n) ** 2], axis=1)


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    quantile: float

    def scores(self, values: np.ndarray) -> np.ndarray:
        strength = ((values - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(strength - self.threshold + np.log(CUT / (1 - CUT)), -40, 40)))


def learn(values: np.ndarray, label: np.ndarray, pairs: int = PAIRS, steps: int = 300, penalty: float = 1e-4, seed: int = 7) -> Ranking | None:
    """Bradley-Terry weights from preference pairs of the rows, and the quantile of their strengths that parts them."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = values.mean(axis=0), values.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    x = np.clip((values - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    difference = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    weights, first, second = np.zeros(x.shape[1]), 0.0, 0.0
    for step in range(1, steps + 1):
        lost = 1 / (1 + np.exp(np.clip(difference @ weights, -40, 40)))  # chance that the pair is ranked wrongly
        slope = -(lost @ difference) / pairs + penalty * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights = weights - 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    strength = ((values - mean) / scale) @ weights
    grid = np.linspace(0.0, 1.0, 401)
    cuts = np.quantile(strength, grid)
    # Agreement of each side with its label, each kind counted alike; of equal quantiles the middle one.
    agree = np.array([(strength[good] >= c).mean() + (strength[bad] < c).mean() for c in cuts])
    best = np.flatnonzero(agree >= agree.max() - 1e-12)
    k = int(best[len(best) // 2])
    below = strength[strength < cuts[k]]
    threshold = (cuts[k] + below.max()) / 2 if len(below) else cuts[k]
    return Ranking(mean, scale, weights, float(threshold), float(grid[k]))


def _feature_rows(docs: DataFrame, extra: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tb.text_column(batch)
            for lo, hi in tb.row_slices(texts):
                found = features(texts.slice(lo, hi - lo))
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[1:], pa.array(list(found), pa.list_(pa.float64()))], names=[*extra, "features"]
                )

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra]
    return docs.select("text", *extra).mapInArrow(run, ", ".join([*kinds, "features array<double>"]))


def labelled_sample(docs: DataFrame, labels: DataFrame, kind: str, learn_from: Column, per_label: int, seed: int = 7) -> DataFrame:
    """(doc_id, text, label) of at most about ``per_label`` rows of each label 0 and 1, drawn by a hash of the id."""
    rows = labels.filter(learn_from & F.col(kind).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(kind).alias("label")).distinct()
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**31))
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, int(2**31 * min(1.0, per_label / n))).otherwise(share)
    picked = rows.filter(draw < share)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by per_label
    return bounded_draw(found, "label", dict.fromkeys(counts, per_label), "doc_id", "text")


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, per_label: int = PER_LABEL) -> Ranking | None:
    rows = _feature_rows(labelled_sample(docs, labels, "quality", learn_from, per_label), ["doc_id", "label"]).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["features"]))
    return learn(np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows]))


def score(docs: DataFrame, ranking: Ranking | None, name: str = "_score") -> DataFrame:
    """``docs`` with the score as the column ``name``, which they must not have."""
    if ranking is None:
        return docs.withColumn(name, F.lit(0.5))
    plain = docs.sparkSession.sparkContext.broadcast(vars(ranking))
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ranking(**plain.value)
        for batch in batches:
            texts = tb.text_column(batch, batch.schema.names[text_at])
            for lo, hi in tb.row_slices(texts):
                found = own.scores(features(texts.slice(lo, hi - lo)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def scored_documents(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """Learn from the labels outside fold 0, score every document: (doc_id, held_out, score, predicted)."""
    held_out = crc_fold(fold) == 0
    out = score(docs.select("doc_id", "text"), fit(docs, labels, ~held_out))
    return out.select(
        "doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` whose score reaches the threshold; learns from all labels outside fold 0."""
    ranking = fit(docs, labels, crc_fold(5) != 0)
    name = fresh(docs, "_score")
    return score(docs, ranking, name).filter(F.col(name) >= CUT).drop(name)
