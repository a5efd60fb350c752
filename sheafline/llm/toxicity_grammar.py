"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of word classes. Small weighted transducers for insult, threat, target, negation and
reported speech are composed into one machine that reads each clause once: an insult or a threat weighs its evidence, a
target near it adds to it, a negation before it or reported speech around it takes most of it away. Clauses
count, not isolated words: a text's score is a logistic curve of the sum of its clauses' weights.

Insult stems are learnt from a bounded sample of labelled rows (``per_label`` of each label): whole words and word
beginnings that toxic texts hold and clean ones do not, weighted by their log odds. Threat, target, negation and report words
are fixed values. An automaton over all stems finds the clauses worth reading in one pass over a whole text.

Defined results: null and empty texts have no clause and the score of a text without matches; without labelled toxic rows
only the fixed threats count; repeated rows are scored a row each; labels, language, source and id are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .frames import crc_fold
from .pairwise_quality import labelled_sample

PER_LABEL = 6000
MIN_STEM, MAX_STEM = 4, 10
MIN_DOCS = 5
CUT = 0.5

# Words of the grammar besides the insults, in the corpus languages.
THREATS = {"kill", "hurt", "destroy", "punch", "stab", "shoot", "töten", "umbringen", "schlagen", "matar", "golpear", "tuer", "frapper"}
TARGETS = {
    "you", "your", "yours", "yourself", "they", "them", "he", "she",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tú", "te", "ti", "usted", "vosotros", "tu", "toi", "vous", "votre",
}
NEGATIONS = {"not", "no", "never", "isn't", "aren't", "nicht", "kein", "keine", "nie", "nunca", "jamás", "ne", "pas", "jamais"}
REPORTS = {"said", "says", "wrote", "called", "quoted", "sagte", "schrieb", "nannte", "dijo", "escribió", "llamó", "dit", "écrit", "appelé"}

_WORD = regex.compile(r"[\p{L}\p{M}]+(?:'[\p{L}]+)?")
_CLAUSE_END = regex.compile(r"[.!?;:\n]")
CLAUSE_REACH = 400  # characters read on each side of a match when no clause end comes earlier


class Transducer:
    """Deterministic weighted transducer: (state, class) -> (state, class out, factor); missing arcs copy and stay."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]], fallback: dict[int, int] | None = None):
        self.arcs, self.fallback = arcs, fallback or {}

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (self.fallback.get(state, state), symbol, 1.0)


class Cascade:
    """Composition of transducers: each reads what the one before writes; composed states are made when first reached."""

    def __init__(self, parts: list[Transducer]):
        self.parts = parts
        self.states: dict[tuple[int, ...], int] = {(0,) * len(parts): 0}
        self.names = [(0,) * len(parts)]
        self.arcs: dict[tuple[int, str], tuple[int, str, float]] = {}

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        found = self.arcs.get((state, symbol))
        if found is None:
            out, factor, to = symbol, 1.0, []
            for part, own in zip(self.parts, self.names[state]):
                nxt, out, f = part.step(own, out)
                factor *= f
                to.append(nxt)
            key = tuple(to)
            if key not in self.states:
                self.states[key] = len(self.names)
                self.names.append(key)
            found = self.arcs[(state, symbol)] = (self.states[key], out, factor)
        return found


def _countdown(trigger: str, hit: tuple[str, ...], factor: float, reach: int) -> Transducer:
    """After ``trigger``, the next hit within ``reach`` words is scaled by ``factor``."""
    arcs = {}
    for state in range(reach + 1):
        arcs[(state, trigger)] = (reach, trigger, 1.0)
        for symbol in hit:
            arcs[(state, symbol)] = (max(state - 1, 0), symbol, factor if state else 1.0)
    return Transducer(arcs, {state: state - 1 for state in range(1, reach + 1)})


def grammar() -> Cascade:
    """Classes: I insult, T threat, P target, N negation, R report, o other."""
    hits = ("I", "T")
    negated = _countdown("N", hits, 0.15, 3)
    reported = Transducer({(0, "R"): (1, "R", 1.0), **{(1, h): (1, h, 0.4) for h in hits}})
    targeted = _countdown("P", hits, 1.5, 4)
    # A threat word counts in full behind a target or before one, alone it is only a verb.
    threat = Transducer({(0, "P"): (1, "P", 1.0), (0, "T"): (0, "T", 0.3), (1, "T"): (1, "T", 1.0)})
    insult = Transducer({(0, "I"): (1, "I", 1.0), (1, "I"): (1, "I", 0.8)})
    return Cascade([insult, threat, targeted, negated, reported])


@dataclass
class Lexicon:
    """Evidence of words and word beginnings, and the curve from a text's weight to its score."""

    words: dict[str, float]
    stems: dict[str, float]
    slope: float = 2.0
    shift: float = -2.0


class Reader:
    """Finds and weighs the clauses of a text that hold an insult or a threat."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.machine = lexicon, grammar()
        self.finder = ahocorasick.Automaton()
        for stem in {*lexicon.words, *lexicon.stems, *THREATS}:
            self.finder.add_word(stem, len(stem))
        self.any = len(self.finder) > 0
        if self.any:
            self.finder.make_automaton()
        self.lengths = sorted({len(s) for s in lexicon.stems})

    def class_of(self, word: str) -> tuple[str, float]:
        weight = self.lexicon.words.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            weight = max(weight, self.lexicon.stems.get(word[:n], 0.0))
        if weight:
            return "I", weight
        if word in THREATS:
            return "T", 1.0
        if word in TARGETS:
            return "P", 0.0
        if word in NEGATIONS:
            return "N", 0.0
        return ("R", 0.0) if word in REPORTS else ("o", 0.0)

    def weigh(self, clause: str) -> float:
        state, total = 0, 0.0
        for word in _WORD.findall(clause):
            kind, weight = self.class_of(word)
            state, out, factor = self.machine.step(state, kind)
            if out in "IT":
                total += weight * factor
        return total

    def clauses(self, text: str) -> Iterator[str]:
        """Each clause with a stem at a word's beginning, once."""
        done = -1
        for end, size in self.finder.iter(text):
            at = end - size + 1
            if at < done or at and text[at - 1].isalpha():
                continue
            lo = max(0, at - CLAUSE_REACH)
            cuts = [m.end() for m in _CLAUSE_END.finditer(text, lo, at)]
            lo = max(cuts[-1] if cuts else lo, done, 0)
            stop = _CLAUSE_END.search(text, end, min(len(text), end + CLAUSE_REACH))
            done = stop.end() if stop else min(len(text), end + CLAUSE_REACH)
            while done < len(text) and not stop and text[done].isalpha():
                done += 1
            yield text[lo:done]

    def weight(self, text: str) -> tuple[float, int]:
        """(sum of the clauses' weights, clauses that count)."""
        if not self.any:
            return 0.0, 0
        found = [w for w in map(self.weigh, self.clauses(text.lower())) if w > 0]
        return sum(found), len(found)

    def score(self, weight: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.lexicon.slope * weight + self.lexicon.shift))))


def _evidence(sample: DataFrame) -> DataFrame:
    """(stem, whole, toxic, clean): documents of each label that hold a word or a word beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, bool], list[int]] = {}
            for text, label in zip(tb.text_column(batch), batch.column(1)):
                words = set(_WORD.findall(text.as_py().lower()))
                keys = {(w, True) for w in words} | {(w[:n], False) for w in words for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1)}
                for key in keys:
                    counts.setdefault(key, [0, 0])[label.as_py()] += 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.bool_()),
                    pa.array([counts[k][1] for k in keys], pa.int64()),
                    pa.array([counts[k][0] for k in keys], pa.int64()),
                ],
                names=["stem", "whole", "toxic", "clean"],
            )

    rows = sample.select("text", F.col("label").cast("int").alias("label"))
    counts = rows.mapInArrow(run, "stem string, whole boolean, toxic bigint, clean bigint")
    return counts.groupBy("stem", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, learn_from, per_label: int = PER_LABEL) -> Lexicon:
    sample = labelled_sample(docs, labels, "toxic", learn_from, per_label)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, {})
    # A stem of an insult is held by toxic texts at twenty times the rate of clean ones; few stems are.
    rate = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / clean)
    # With at least MIN_DOCS texts each, the sample's bound bounds the stems too.
    found = _evidence(sample).filter((F.col("toxic") >= MIN_DOCS) & (rate >= 20)).withColumn("weight", F.log(rate) / 3).collect()
    weight = {(r["stem"], r["whole"]): r["weight"] for r in found}
    words = {r["stem"] for r in found if r["whole"]}
    # A beginning stands for many words, so it needs more documents than its longest word alone has.
    alone = {r["stem"]: r["toxic"] for r in found if r["whole"]}
    stems = {r["stem"]: r["toxic"] for r in found if not r["whole"] and r["toxic"] > max((alone.get(w, 0) for w in words if w.startswith(r["stem"])), default=0)}
    short = {s for s in stems if not any(s[:n] in stems for n in range(MIN_STEM, len(s)))}
    full = {w for w in words if not any(w[:n] in short for n in range(MIN_STEM, len(w) + 1))}
    lexicon = Lexicon({w: weight[w, True] for w in sorted(full)}, {s: weight[s, False] for s in sorted(short)})
    return _calibrated(sample, lexicon)


def _calibrated(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Log-odds curve of a text's weight, fitted on the sample."""
    rows = _weights(sample.select("doc_id", "text", "label"), lexicon, ["doc_id", "label"]).collect()
    x = np.array([math.log1p(r["weight"]) for r in rows])
    y = np.array([r["label"] for r in rows], float)
    a, b = 1.0, -1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        a -= 2.0 * (float(((p - y) * x).mean()) + 1e-3 * a)
        b -= 2.0 * float((p - y).mean())
    return Lexicon(lexicon.words, lexicon.stems, a, b)


def _weights(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    plain = docs.sparkSession.sparkContext.broadcast(vars(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Lexicon(**plain.value))
        for batch in batches:
            found = [reader.weight(t.as_py()) for t in tb.text_column(batch)]
            scores = [reader.score(math.log1p(w)) for w, _ in found]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64()), pa.array(scores, pa.float64())],
                names=[*keep, "weight", "clauses", "score"],
            )

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select("text", *keep).mapInArrow(run, ", ".join([*kinds, "weight double", "clauses bigint", "score double"]))


def scored_documents(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses) of every document; learns from the labels outside fold 0."""
    held_out = crc_fold(fold) == 0
    out = _weights(docs, fit(docs, labels, ~held_out), ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "clauses")
