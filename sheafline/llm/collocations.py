"""Phrase collocation mining: frequent phrases by mergeable Misra-Gries summaries, then exact counts and scores.

A text is lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and the pieces into words at ``[\\x20\\x09]+``. A phrase is
1 to ``longest`` consecutive words of one piece; everything is counted per language.

Summaries. Every phrase has a 64-bit hash, and the range of hashes is dealt into partitions. A task keeps a Misra-Gries summary
a partition: with more than ``capacity`` counters, the next largest count is taken from all and what is left at zero goes. Two
summaries merge by adding counters and trimming again. All that was ever taken (``taken``) is at most the mass of a partition
over its capacity; as the capacity exceeds mass over threshold, a phrase with ``threshold`` occurrences keeps a counter. What was
taken is added up, so the guarantee is checked and not assumed: should a partition hold more than its share of the mass
(very common phrases), so that ``taken`` reaches the threshold, the pass is made again with twice the capacity.

Passes over the texts: words; pairs of surviving words; longer phrases of surviving pairs; exact counts of all that survived. What
survived is handed on as a bit filter of 16 bits a phrase, at most ``MOST_BITS`` (64 MB). Its false positives, and a filter too
small for its phrases, cost work and never change a result: the last pass counts by text, not by hash.

Scale: what a task sends are blocks of counters, summed before; a partition of hashes has a bounded mass, so its blocks are
bounded too, however large the table, and a merging task streams them into its summaries. Scores,
cuts and containment are joins and grouped minima over the phrases that occur often enough.

Defined results: a null text is empty, a null language is ``und`` (one group with a language of that name); rows that repeat
count each; a very long text is worked on in bounded stretches that overlap by ``longest - 1`` words (a single word is never cut);
an empty table gives no rows; other columns are ignored, whatever their names. Two phrases with the same 64-bit hash share a
counter of a summary, so both survive if their sum does; counts are added by text, but inside one task by hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textblocks as tb
from .frames import stored

BLANKS = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"
STRETCH_BYTES = 1 << 20
PART_MASS = 1 << 20
HELD = 1 << 19
MOST_BITS = 1 << 29
BLOCK_BITS = 1 << 15

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_WORD = ~_BREAK
_WORD[list(BLANKS)] = False
_AHEAD = re.compile(rb"[ \t]*[^ \t.,;:!?\n\x0b\x0c\r]+")
_U = np.uint64


def trimmed(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``capacity`` counters of a summary, and what was taken from each."""
    if len(keys) <= capacity:
        return keys, counts, 0
    at = len(counts) - capacity - 1
    taken = np.partition(counts, at)[at]
    kept = counts > taken
    return keys[kept], counts[kept] - taken, int(taken)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


class Summary:
    """A Misra-Gries summary that takes in blocks of counters; it holds at most ``4 * capacity`` and one block."""

    def __init__(self, capacity: int):
        self.capacity, self.taken, self.held = capacity, 0, 0
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray, taken: int = 0) -> None:
        """Take in the counters of another summary, from each of which ``taken`` was taken."""
        self.blocks.append((keys, counts))
        self.held += len(keys)
        self.taken += taken
        if self.held > 4 * self.capacity:
            self.trim()

    def trim(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = summed(*(np.concatenate(x) for x in zip(*self.blocks))) if self.blocks else (np.zeros(0, _U), np.zeros(0, np.int64))
        keys, counts, taken = trimmed(keys, counts, self.capacity)
        self.taken += taken
        self.blocks, self.held = [(keys, counts)], len(keys)
        return keys, counts


def stretches(texts: pa.Array, ahead: int, limit: int = STRETCH_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row, end of what counts) of bounded parts of an array of texts.

    Short texts come many at a time; a longer one is cut behind a break, else behind a blank, and then up to ``ahead`` words of
    what follows are shown again: phrases may end in them but not begin.
    """
    for lo, hi in tb.row_slices(texts, limit):
        data, offsets = tb.raw_bytes(texts.slice(lo, hi - lo))
        if hi - lo > 1 or len(data) <= limit:
            yield data, offsets, np.arange(lo, hi), offsets[1:]
            continue
        at, n = 0, len(data)
        while at < n:
            end = stop = min(at + limit, n)
            if end < n:
                marks = np.flatnonzero(_BREAK[data[at:end]])
                if len(marks):
                    end = stop = at + int(marks[-1]) + 1
                else:
                    blanks = np.flatnonzero(~_WORD[data[at:end]])
                    end = at + int(blanks[-1]) + 1 if len(blanks) else end
                    while not len(blanks) and end < n:  # one word of over ``limit`` bytes: whole
                        found = np.flatnonzero(~_WORD[data[end : end + limit]])
                        blanks, end = found, end + int(found[0]) if len(found) else min(end + limit, n)
                    stop = _look_ahead(data, end, ahead)
            yield data[at:stop], np.array([0, stop - at]), np.array([lo]), np.array([end - at])
            at = end


def _look_ahead(data: np.ndarray, at: int, words: int) -> int:
    """End of the next ``words`` words of the same piece."""
    rest = memoryview(data)[at:]
    end = 0
    for _ in range(words):
        found = _AHEAD.match(rest, end)
        if not found:
            break
        end = found.end()
    return at + end


class Words:
    """The words of a stretch: places, hashes, and which begin phrases of each length."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ends: np.ndarray, langs: np.ndarray):
        upper = (data >= 0x41) & (data <= 0x5A)
        self.data = np.where(upper, data | 0x20, data)
        word = _WORD[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        self.start = np.flatnonzero(word & (np.append(False, ~word)[:-1] | first[:-1]))
        self.end = np.flatnonzero(word & (np.append(~word, True)[1:] | first[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        piece = np.cumsum(_BREAK[data], dtype=np.int64)[self.start]
        self.link = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])
        self.own = self.start < ends[self.row]
        self.total = tb.running_hash(tb.word_hashes(self.data, self.start, self.end))
        self.lang = langs[self.row]

    def __len__(self) -> int:
        return len(self.start)

    def keys(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the phrases of ``size`` words that begin at the words ``at``."""
        return tb.mix(tb.span_hash(self.total, at, at + size) ^ self.lang[at] ^ _U(size))

    def begins(self, size: int, before: np.ndarray | None = None) -> np.ndarray:
        """Whether a phrase of ``size`` words begins at each word; ``before``: the same for one word less."""
        if size == 1:
            return np.ones(len(self), bool)
        out = np.zeros(len(self), bool)
        n = len(self) - size + 1
        if n > 0:
            out[:n] = before[:n] & self.link[size - 2 : size - 2 + n]
        return out

    def phrase(self, at: int, size: int) -> bytes:
        spans = zip(self.start[at : at + size].tolist(), self.end[at : at + size].tolist())
        return b" ".join([self.data[a:b].tobytes() for a, b in spans])


class BitFilter:
    """Keys as two bits each of a table of a power of two."""

    def __init__(self, bits: int, table: np.ndarray):
        self.mask, self.table = _U(bits - 1), table

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
        return [keys & _U(bits - 1), (keys >> _U(32)) * _U(0x9E3779B1) & _U(bits - 1)]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for place in self.places(keys, int(self.mask) + 1):
            out &= (self.table[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1
        return out


def bit_filter(keys: DataFrame, n: int) -> BitFilter:
    """The filter of ``n`` rows of ``key``, built in blocks on the executors; the driver holds its bits, at most 64 MB."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (16 * n - 1).bit_length()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(0)).view(_U)
            place = np.concatenate(BitFilter.places(values, bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place // BLOCK_BITS), pa.array((place % BLOCK_BITS).astype(np.int32))], names=["block", "bit"])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(BLOCK_BITS, np.uint8)
        own[group["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": [group["block"].iloc[0]], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    blocks = keys.select("key").mapInArrow(spread, "block bigint, bit int").distinct().groupBy("block").applyInPandas(pack, "block bigint, bits binary")
    table = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():
        at = row["block"] * (BLOCK_BITS // 8)
        table[at : at + BLOCK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return BitFilter(bits, table)


def _lang_hash(langs: list[str]) -> np.ndarray:
    known = {x: xxhash.xxh64_intdigest(x.encode(), 7) for x in set(langs)}
    return np.array([known[x] for x in langs], _U)


def _worded(batch: pa.RecordBatch, ahead: int, limit: int) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    """The words of each stretch of a batch of (text, lang), with the languages of its rows."""
    langs = batch.column(1).to_pylist()
    hashes = _lang_hash(langs)
    for data, offsets, rows, ends in stretches(tb.text_column(batch), ahead, limit):
        yield Words(data, offsets, ends, hashes[rows]), [langs[i] for i in rows.tolist()], rows


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit("und")).alias("lang"))


def survivors(docs: DataFrame, sizes: tuple[int, ...], threshold: int, mass: int, guess: int, parts_held=None, limit: int = STRETCH_BYTES) -> tuple[DataFrame, int, int]:
    """(``key``: hashes of all phrases of these sizes with ``threshold`` occurrences or more, and of some others; how many; how often they occur at most).

    ``mass`` bounds the number of phrases, ``guess`` is about their number. ``parts_held``: (size, filter) of shorter phrases; only
    phrases all of whose parts of that size are held are looked at.
    """
    n_parts = -(-guess // PART_MASS) or 1
    capacity = 2 * -(-mass // (threshold * n_parts)) + 64
    while True:
        merged = stored(_pass(docs, sizes, n_parts, capacity, parts_held, limit), "phrases")
        often = F.col("key").isNotNull() & (F.col("n") + F.col("taken") >= threshold)
        taken, n, most = merged.agg(F.max("taken"), F.count_if(often), F.sum(F.when(often, F.col("n") + F.col("taken")))).first()
        if taken is None or taken < threshold:
            return merged.filter(often).select("key"), n, most or 0
        capacity *= 2  # a partition with more than its share of the mass


def _pass(docs: DataFrame, sizes: tuple[int, ...], n_parts: int, capacity: int, parts_held, limit: int) -> DataFrame:
    ahead = max(sizes) - 1
    held = docs.sparkSession.sparkContext.broadcast(parts_held) if parts_held else None  # at most 64 MB

    def blocks(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = (((keys >> _U(32)) * _U(n_parts)) >> _U(32)).astype(np.int64)
        rows = []
        edges = np.searchsorted(part, np.arange(n_parts + 1))
        for p in range(n_parts):
            a, b = edges[p], edges[p + 1]
            if a < b:
                k, c, taken = trimmed(keys[a:b], counts[a:b], capacity)
                rows.append((p, taken, k.tobytes(), c.astype(np.uint32).tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "taken", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter, filter_ = held.value if held else (0, None)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flushed(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal found, n
            keys, counts = summed(*(np.concatenate(x) for x in zip(*found)))
            found, n = [(keys, counts)], len(keys)
            if n > least:
                found, n = [], 0
                yield blocks(keys, counts)

        for batch in batches:
            for words, _, _ in _worded(batch, ahead, limit):
                begins, kept = None, None
                for size in range(1, max(sizes) + 1):
                    begins = words.begins(size, begins)
                    if size == shorter:
                        at = np.flatnonzero(begins)
                        kept = np.zeros(len(words), bool)
                        kept[at[filter_.holds(words.keys(at, size))]] = True
                        begins = begins & kept
                    elif kept is not None:  # the last part of that size must be held as well; the others were looked at before
                        m = len(words) - (size - shorter)
                        if m > 0:
                            begins[:m] &= kept[size - shorter :]
                    if size in sizes:
                        at = np.flatnonzero(begins & words.own)
                        if len(at):
                            keys, counts = np.unique(words.keys(at, size), return_counts=True)
                            found.append((keys, counts.astype(np.int64)))
                            n += len(keys)
                if n > 2 * HELD:
                    yield from flushed(HELD)
        if n:
            yield from flushed(0)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Summary] = {}
        for batch in batches:
            parts, takens = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (part, taken) in enumerate(zip(parts, takens)):
                keys, counts = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((2, _U), (3, np.uint32)))
                own.setdefault(part, Summary(capacity)).add(keys, counts.astype(np.int64), taken)
        for part in list(own):
            summary = own.pop(part)
            keys, counts = summary.trim()
            m = len(keys) + 1
            key = pa.array(np.append(keys.view(np.int64), 0), mask=np.append(np.zeros(m - 1, bool), True))
            taken = np.full(m, summary.taken, np.int64)
            yield pa.RecordBatch.from_arrays([key, pa.array(np.append(counts, 0)), pa.array(taken)], names=["key", "n", "taken"])

    sent = _texts(docs).mapInArrow(count, "part int, taken bigint, keys binary, counts binary")
    return sent.repartition(n_parts, "part").mapInArrow(merge, "key bigint, n bigint, taken bigint")


def exact_counts(docs: DataFrame, filters: dict[int, BitFilter], n_parts: int, limit: int = STRETCH_BYTES) -> DataFrame:
    """(lang, size, phrase, f) of all phrases that the filters (one a size) hold; size 0 with a null phrase counts all words.

    A task sends blocks of phrases and counts of one language and partition; they are added by text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tallies: dict[str, tuple[np.ndarray, np.ndarray, list[bytes]]] = {}  # a language's sorted keys, counts, phrases in order of arrival
        totals: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            rows = []
            for lang, (keys, counts, phrases) in tallies.items():
                part = (keys[:, 0] % _U(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(n_parts + 1))
                for p in np.flatnonzero(np.diff(edges)).tolist():
                    some = order[edges[p] : edges[p + 1]]
                    rows.append((p, lang, 0, b"\n".join([phrases[i] for i in keys[some, 1].tolist()]), counts[some].tobytes()))
            rows += [(xxhash.xxh32_intdigest(lang.encode()) % n_parts, lang, n, None, None) for lang, n in totals.items()]
            tallies.clear()
            totals.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "lang", "words", "phrases", "counts"])

        for batch in batches:
            for words, langs, _ in _worded(batch, max(own) - 1, limit):
                names = list(dict.fromkeys(langs))
                code = np.array([names.index(x) for x in langs])[words.row]
                for c, n in enumerate(np.bincount(code[words.own], minlength=len(names)).tolist()):
                    totals[names[c]] = totals.get(names[c], 0) + n
                begins, found = None, []
                for size in sorted(own):
                    begins = words.begins(size, begins)
                    at = np.flatnonzero(begins & words.own)
                    keys = words.keys(at, size)
                    some = own[size].holds(keys)
                    keys, first, counts = np.unique(keys[some], return_index=True, return_counts=True)
                    found.append((keys, at[some][first], counts.astype(np.int64), np.full(len(keys), size)))
                keys, at, counts, sizes = (np.concatenate(x) for x in zip(*found))
                for c, lang in enumerate(names):
                    mine = np.flatnonzero(code[at] == c)
                    mine = mine[np.argsort(keys[mine], kind="stable")]
                    tallies[lang] = _added(tallies.get(lang), words, keys[mine], at[mine], counts[mine], sizes[mine])
                if sum(len(x[0]) for x in tallies.values()) > HELD:
                    yield out()
        if totals:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bytes | None], int] = {}
        for batch in batches:
            langs, words = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, lang in enumerate(langs):
                phrases = batch.column(3)[i].as_py()
                if phrases is None:
                    found[lang, None] = found.get((lang, None), 0) + words[i]
                    continue
                for phrase, n in zip(phrases.split(b"\n"), np.frombuffer(batch.column(4)[i].as_py(), np.int64).tolist()):
                    key = (lang, phrase)
                    found[key] = found.get(key, 0) + n
        rows = [(lang, 0 if p is None else p.count(b" ") + 1, None if p is None else p.decode(errors="replace"), n) for (lang, p), n in found.items()]
        for lo in range(0, len(rows), 10_000):
            columns = zip(*rows[lo : lo + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "size", "phrase", "f"])

    sent = _texts(docs).mapInArrow(count, "part int, lang string, words bigint, phrases binary, counts binary")
    return sent.repartition(n_parts, "part").mapInArrow(merge, "lang string, size int, phrase string, f bigint")


def _added(tally, words: Words, keys: np.ndarray, at: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
    """A tally (sorted keys with the place of the phrase, counts, phrases) with the counts of one stretch."""
    if tally is None:
        tally = (np.zeros((0, 2), _U), np.zeros(0, np.int64), [])
    known, held, phrases = tally
    place = np.searchsorted(known[:, 0], keys)
    old = np.zeros(len(keys), bool)
    inside = place < len(known)
    old[inside] = known[place[inside], 0] == keys[inside]
    held[place[old]] += counts[old]
    new = np.flatnonzero(~old)
    if not len(new):
        return tally
    first = len(phrases)
    phrases += [words.phrase(i, size) for i, size in zip(at[new].tolist(), sizes[new].tolist())]
    fresh = np.stack((keys[new], np.arange(first, len(phrases), dtype=_U)), axis=1)
    return np.insert(known, place[new], fresh, axis=0), np.insert(held, place[new], counts[new]), phrases


def scored(counts: DataFrame, threshold: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate: the lowest-scoring cut in two, the earliest of equal ones."""
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    often = counts.filter((F.col("size") > 0) & (F.col("f") >= threshold))
    words = F.split("phrase", " ")
    cuts = often.filter("size > 1").select(
        "lang",
        "phrase",
        F.col("f").alias("a"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.col("size") - 1),
                lambda k: F.struct(
                    k.alias("k"),
                    F.array_join(F.slice(words, 1, k), " ").alias("first"),
                    F.array_join(F.slice(words, k + 1, F.col("size") - k), " ").alias("rest"),
                ),
            )
        ).alias("cut"),
    )
    cuts = cuts.select("lang", "phrase", "a", "cut.*")
    left = often.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = often.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    joined = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    wide = "cast(1000 as decimal(4, 0)) * cast(a as decimal(16, 0)) * cast(n as decimal(16, 0))"
    score = F.expr(f"({wide}) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))")
    best = joined.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def contained(counts: DataFrame, threshold: int) -> DataFrame:
    """(lang, phrase) of candidates that lie inside a longer one which occurs as often."""
    longer = counts.filter((F.col("size") > 2) & (F.col("f") >= threshold))
    words = F.split("phrase", " ")
    inside = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("size") - 1),
                lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " ")),
            )
        )
    )
    most = longer.select("lang", inside.alias("phrase"), F.col("f").alias("most")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    return counts.join(most, ["lang", "phrase"]).filter(F.col("most") >= F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, first: int = 2000, limit: int = STRETCH_BYTES) -> DataFrame:
    """Each language's ``first`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    mass = (size + 1) // 2 + 1  # a word has a byte, and a byte stands between two words
    words, n, often = survivors(docs, (1,), threshold, mass, size // 6, limit=limit)
    filters, held = {1: bit_filter(words, n)}, n
    if longest > 1:
        pairs, n, often = survivors(docs, (2,), threshold, mass, often, (1, filters[1]), limit)
        filters[2], held = bit_filter(pairs, n), held + n
    if longest > 2:
        more = tuple(range(3, longest + 1))
        longer, n, _ = survivors(docs, more, threshold, len(more) * mass, len(more) * often, (2, filters[2]), limit)
        every, held = bit_filter(longer, n), held + n
        filters |= dict.fromkeys(more, every)
    counts = exact_counts(docs, filters, -(-held // 2000) or 1, limit)
    counts = stored(counts.filter((F.col("size") == 0) | (F.col("f") >= threshold)), "phrase-counts")
    kept = stored(scored(counts, threshold), "scores").join(contained(counts, threshold), ["lang", "phrase"], "left_anti")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
