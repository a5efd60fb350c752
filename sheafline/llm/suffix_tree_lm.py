"""Language model scoring with a probabilistic suffix tree over word symbols.

A text is the sequence of its lower-cased (A-Z) words and one end. A word's *symbol* is the word itself if it occurs ``word_least``
times in the training texts, else the class of the words that end in the same two bytes; the end is a symbol of its own and also
stands before a text. The tree keeps a context of 1 to ``depth`` symbols if it occurs ``least`` times and a divergence test tells its
next-symbol distribution from its parent's (the same context without its oldest symbol): the likelihood ratio 2 * n * KL must pass
what chance gives. A distribution is smoothed towards its parent's with the weight of ``prior`` tokens and of those symbols that
were seen less than ``pair_least`` times after the context. A token's probability is that of its symbol after the longest kept suffix
of the history; a word of a class has besides the share (c + 1) / (n + v + 1) of it, with c the word's count and n, v the tokens and
distinct words of the class, so unknown words are one word of the class.

All supports are counts, not shares, so the tree grows with its corpus. Learning reads the training texts three times: words; what
follows each symbol; and what follows longer contexts, all of whose pairs of neighbours occur ``least`` times (a bit filter of at most
64 MB tells them; its false positives cost work and change nothing). Tasks send blocks of counts, dealt by a hash of the context, so a
context is whole where it is added up. Tests and smoothing are joins of a level's table with that of its parents. The tree is a stored
table. Scoring loads it in shards of about ``SHARD_BYTES`` (half as much again when laid out as tables of hashes) by the symbol before a token, which all contexts of the token share, and
``SHARDS_A_PASS`` of them a pass: a larger tree means more passes over the texts, each token being scored in the pass of its shard,
with the same result.
Words that are symbols are broadcast, at most one for every ``word_least`` tokens (16 bytes each, 24 more as a symbol, 4 a shard, and 18 in a worker's table). Other words
meet their counts in a join, once a slice of texts and row.
Words are compared by 48 bits of a hash and their last two bytes, contexts by 64 bits of a hash.

Defined results: a null or empty text is the end alone; without training texts no word is known and every symbol is
equally likely; columns other than the id and the text are ignored; rows that repeat an id, or have none, are scored a row each; a
very long text is scored as a whole, with some 60 bytes of memory a word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .collocations import BitFilter, bit_filter, summed
from .frames import crc_fold, stored

DEPTH = 3
LEAST = 100
PAIR_LEAST = 4
WORD_LEAST = 100
PRIOR = 20.0
SHARD_BYTES = 48 << 20
SHARDS_A_PASS = 2
PART_MASS = 1 << 19
HELD = 1 << 18
SLICE = 1 << 19
END = 0  # symbol; class symbols follow, then frequent words
CLASSES = 1 + (1 << 16)
BILLION = 1e9

_U = np.uint64
_NONE = np.iinfo(np.uint64).max  # a free place of a table; a hash of this value is a collision like others
ROOM = 1.5  # places of a table for each of its keys


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, last two bytes, row) of each word of a slice."""
    data, offsets = tb.raw_bytes(texts)
    data = data + (((data - np.uint8(0x41)) < 26).view(np.uint8) << np.uint8(5))  # A-Z
    starts, ends, firsts = tb.word_spans(data, offsets)
    hashes = tb.word_hashes(data, starts, ends)
    tail = data[ends - 1].astype(np.int64)
    tail += np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64) << 8
    return hashes.view(np.int64), tail, np.repeat(np.arange(len(texts)), np.diff(firsts))


def _combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


def _counted(texts: DataFrame, keys_of) -> DataFrame:
    """(key, n) of the int64 keys that ``keys_of(words of a slice)`` gives, combined for each batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tb.text_column(batch)
            parts: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi in tb.row_slices(column, SLICE):
                parts.append(np.unique(keys_of(*_words(column.slice(lo, hi - lo)), hi - lo), return_counts=True))
                if len(parts) > 1 and sum(len(k) for k, _ in parts[1:]) > max(len(parts[0][0]), HELD):
                    parts = [_combined(parts)]
            if parts:
                keys, n = _combined(parts)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
            tb.give_back()

    counts = texts.select("text").mapInArrow(run, "key bigint, n bigint")
    return counts.groupBy("key").agg(F.sum("n").alias("n"))


def _tailed(hashes, tail, row, n_rows):
    """A word's hash with its tail: two keys in turn would be two shuffles, so the tail replaces the lowest bits."""
    return (hashes & ~np.int64(0xFFFF)) | tail


@dataclass
class Table:
    """Distinct hashes with their values, each at its place by its upper half or the next free one.

    The table rises but for free places, which end a search.
    """

    size: int
    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        """Of sorted keys."""
        size = int(ROOM * len(keys)) + 1
        table, own = cls(size, keys, values), np.arange(len(keys))
        place = own + np.maximum.accumulate(table._home(keys) - own) if len(keys) else own
        n = max(size, int(place[-1]) + 1 if len(keys) else 0) + 1  # the last one stays free
        table.keys, table.values = np.full(n, _NONE, _U), np.zeros(n, values.dtype)
        table.keys[place], table.values[place] = keys, values
        return table

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (((keys >> _U(32)) * _U(self.size)) >> _U(32)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is held, the place of its value or any)."""
        at = self._home(keys)
        there = self.keys[at]
        held, left = there == keys, np.flatnonzero(there < keys)
        while len(left):
            at[left] += 1
            there, own = self.keys[at[left]], keys[left]
            held[left[there == own]] = True
            left = left[there < own]
        return held, at


class Vocabulary:
    """Words that are symbols of their own: sorted keys and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        order = np.argsort(keys.view(_U))
        self.table = Table.of(keys.view(_U)[order], order.astype(np.int32))

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The symbol of each word key, ``CLASSES`` or more if the word is one of its own."""
        held, at = self.table.find(keys.view(_U))
        return np.where(held, CLASSES + self.table.values[at].astype(np.int64), (keys & 0xFFFF) + 1)


def _sequence(symbols: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols one after another, each text with its end, and the rows' lengths."""
    lengths = np.bincount(row, minlength=n_rows) + 1
    out = np.full(len(symbols) + n_rows, END, np.int64)
    out[np.arange(len(symbols)) + row] = symbols
    return out, lengths


class History:
    """What stands before each symbol of a sequence of texts: hashes of the contexts of each length."""

    def __init__(self, sequence: np.ndarray, lengths: np.ndarray):
        self.sequence = sequence
        self.place = np.arange(len(sequence)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def back(self, n: int) -> np.ndarray:
        """The symbol ``n`` places before; in front of a text stands an end."""
        out = np.full(len(self.sequence), END, np.int64)
        out[n:] = self.sequence[: len(self.sequence) - n]
        out[self.place < n] = END
        return out

    def contexts(self, depth: int):
        """For each length: the context's hash, and whether it is no longer than the text before it and one end."""
        code = np.zeros(len(self.sequence), _U)
        for d in range(1, depth + 1):
            code = extended(code, self.back(d))
            yield d, code, self.place >= d - 1


def extended(code: np.ndarray, older: np.ndarray) -> np.ndarray:
    """Hashes of the contexts ``code`` with one more symbol in front."""
    return tb.mix(code * _U(0x9E3779B97F4A7C15) + older.astype(_U) + _U(1))


def pair_keys(code: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return tb.mix(code ^ (symbol.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(7)))


PAIRS = "d int, ctx bigint, parent bigint, last int, total bigint, dropped bigint, sym int, n bigint"


def _numbered_sort(keys: np.ndarray) -> np.ndarray:
    """An order of the keys by their upper bits, the places in the lower ones: values sort several times faster than places by value."""
    low = _U((1 << len(keys).bit_length()) - 1)
    order = np.sort((keys & ~low) | np.arange(len(keys), dtype=_U))
    return (order & low).view(np.int64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place, count) of groups of equal hashes; equal ones may be several groups if others share their upper bits."""
    order = _numbered_sort(keys)
    own = keys[order]
    first = np.flatnonzero(np.append(len(own) > 0, own[1:] != own[:-1]))
    return order[first], np.diff(np.append(first, len(own)))


def together(keys: np.ndarray) -> np.ndarray:
    """An order in which equal keys stand together."""
    spread = keys * _U(0x9E3779B97F4A7C15)  # odd: distinct keys stay distinct
    order = _numbered_sort(spread)
    own = spread[order]
    clash = ((own[1:] ^ own[:-1]) >> _U(len(keys).bit_length()) == 0) & (own[1:] != own[:-1])
    return np.argsort(keys) if clash.any() else order


def _sorted_pairs(parts: list[tuple], exact: bool = True) -> tuple[np.ndarray, ...]:
    """(ctx, sym, n, parent, last, d) arrays added up by (ctx, sym), those of a context together.

    Not ``exact``: sorted by the upper bits of the context alone, which is faster; a few pairs may then stay apart, to be added up later.
    """
    ctx, sym, n, parent, last, d = (np.concatenate(x) for x in zip(*parts))
    if exact:
        order = together(ctx)
        own = ctx[order]
        number = np.cumsum(np.append(False, own[1:] != own[:-1])).astype(_U)  # of the context
        own, width, held = sym[order].astype(_U), int(sym.max()).bit_length(), len(order).bit_length()
        if int(number[-1]).bit_length() + width + held <= 64:
            by_both = np.sort((number << _U(width) | own) << _U(held) | np.arange(len(order), dtype=_U))
            order = order[(by_both & _U((1 << held) - 1)).view(np.int64)]
        else:
            order = np.lexsort((sym, ctx))
    else:
        order = np.argsort((ctx & ~_U(0xFFFFFF)) | sym.astype(_U) & _U(0xFFFFFF))
    ctx, sym, n = ctx[order], sym[order], n[order]
    first = np.flatnonzero(np.append(len(ctx) > 0, (ctx[1:] != ctx[:-1]) | (sym[1:] != sym[:-1])))
    at = order[first]
    return ctx[first], sym[first], np.add.reduceat(n, first, dtype=np.int64), parent[at], last[at], d[at]


def _followers(train: DataFrame, vocabulary: Vocabulary, levels: range, n_parts: int, least: int, pair_least: int, pairs_held=None) -> DataFrame:
    """``PAIRS``: what follows each context of these lengths that occurs ``least`` times; a null symbol stands for its existence."""
    sc = train.sparkSession.sparkContext
    words, held = sc.broadcast((vocabulary.keys, vocabulary.counts)), sc.broadcast((int(pairs_held.mask) + 1, pairs_held.table)) if pairs_held is not None else None
    kinds = (pa.int32(), pa.binary(), pa.binary())

    def blocks(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        ctx, sym, n, parent, last, d = found
        part = (((ctx >> _U(32)) * _U(n_parts)) >> _U(32)).astype(np.int64)
        edges = np.searchsorted(part, np.arange(n_parts + 1))
        rows = []
        for p in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[p], edges[p + 1])
            first = np.flatnonzero(np.append(True, ctx[own][1:] != ctx[own][:-1]))
            size = np.diff(np.append(first, edges[p + 1] - edges[p]))
            heads = np.stack((ctx[own][first], parent[own][first], last[own][first].astype(_U) << _U(8) | d[own][first].astype(_U), size.astype(_U)), axis=1)
            rows.append((p, heads.tobytes(), np.stack((sym[own], n[own]), axis=1).astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "heads", "pairs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, filter_ = Vocabulary(*words.value), BitFilter(*held.value) if held else None
        parts: list[tuple] = []
        n = 0
        for batch in batches:
            column = tb.text_column(batch)
            for lo, hi in tb.row_slices(column, SLICE):
                hashes, tail, row = _words(column.slice(lo, hi - lo))
                symbols = own.look_up(_tailed(hashes, tail, row, hi - lo))
                history = History(*_sequence(symbols, row, hi - lo))
                last = history.back(1)
                often, parent = None, np.zeros(len(history.sequence), _U)
                for d, code, known in history.contexts(levels[-1]):
                    if d == 2 and filter_ is not None:
                        often = filter_.holds(code)
                        usable = often & known
                    elif d > 2:  # the pair of its oldest symbols is the one d - 2 places before
                        older = np.zeros(len(often), bool)
                        older[d - 2 :] = often[: len(often) - (d - 2)]
                        usable = usable & older & known
                    else:
                        usable = known
                    if d in levels:
                        at = np.flatnonzero(usable)
                        first, counts = grouped(pair_keys(code[at], history.sequence[at]))
                        at = at[first]
                        narrow = [x.astype(np.int32) for x in (history.sequence[at], counts, last[at])]
                        parts.append((code[at], narrow[0], narrow[1], parent[at], narrow[2], np.full(len(at), d, np.int8)))
                        n += len(at)
                    parent = code
                if n > 2 * HELD:
                    parts = [_sorted_pairs(parts, exact=False)]
                    n = len(parts[0][0])
                    if n > HELD:
                        yield blocks(parts[0])
                        parts, n = [], 0
            tb.give_back()
        if n:
            yield blocks(_sorted_pairs(parts, exact=False))

    def unpacked(heads: bytes, pairs: bytes) -> tuple:
        h, x = np.frombuffer(heads, _U).reshape(-1, 4), np.frombuffer(pairs, np.uint32).reshape(-1, 2).astype(np.int64)
        size = h[:, 3].astype(np.int64)
        tail = h[:, 2].astype(np.int64)
        last, d = (tail >> 8).astype(np.int32), (tail & 255).astype(np.int8)
        return (np.repeat(h[:, 0], size), x[:, 0].astype(np.int32), x[:, 1].astype(np.int32), np.repeat(h[:, 1], size), np.repeat(last, size), np.repeat(d, size))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for i, p in enumerate(numbers):
                found = unpacked(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                own = parts.setdefault(p, [])
                own.append(found)
                sizes[p] = sizes.get(p, 0) + len(found[0])
                if len(own) > 1 and sizes[p] > 2 * len(own[0][0]) + HELD:
                    parts[p] = [_sorted_pairs(own)]
                    sizes[p] = len(parts[p][0][0])
        for p in list(parts):
            ctx, sym, n, parent, last, d = _sorted_pairs(parts.pop(p))
            first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
            size = np.diff(np.append(first, len(ctx)))
            total = np.add.reduceat(n, first)
            dropped = np.add.reduceat(np.where(n < pair_least, n, 0), first)
            often = total >= least
            kept = np.flatnonzero((n >= pair_least) & np.repeat(often, size))
            of = np.repeat(np.arange(len(first)), size)[kept]
            heads = np.flatnonzero(often)
            at = np.concatenate((first[heads], kept))
            of = np.concatenate((heads, of))
            symbols = pa.array(np.concatenate((np.zeros(len(heads), np.int32), sym[kept].astype(np.int32))), mask=np.arange(len(at)) < len(heads))
            counts = np.concatenate((np.zeros(len(heads), np.int64), n[kept]))
            columns = [d[at].astype(np.int32), ctx[at].view(np.int64), parent[at].view(np.int64), last[at].astype(np.int32), total[of], dropped[of]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), symbols, pa.array(counts)], names=[x.split()[0] for x in PAIRS.split(", ")])

    sent = train.select("text").mapInArrow(count, "part int, heads binary, pairs binary")
    return stored(sent.repartition(n_parts, "part").mapInArrow(add, PAIRS), "followers")


@dataclass
class Model:
    vocabulary: Vocabulary
    root: np.ndarray  # log10 probability of each symbol
    class_logs: np.ndarray  # of each class symbol: log10 of n + v + 1; 0 for other symbols
    tree: DataFrame  # (last, key, log, pair): kept contexts' log10 rest by their hash, pairs' log10 probability by theirs; stored
    depth: int
    words: DataFrame  # (key, n), stored
    texts: int
    tokens: int
    distinct: int


def _frequent(words: DataFrame, word_least: int) -> Vocabulary:
    table = words.filter(F.col("n") >= word_least).toArrow()  # at most a row for every ``word_least`` tokens
    keys, counts = np.asarray(table["key"], np.int64), np.asarray(table["n"], np.int64)
    order = np.argsort(keys)
    return Vocabulary(keys[order], counts[order])


def _smoothed_root(counts: dict[int, int], n_symbols: int) -> np.ndarray:
    root = np.zeros(n_symbols)
    for symbol, n in counts.items():
        root[symbol] = n
    return np.log10((root + 1) / (root.sum() + len(counts) + 1))


def _pruned(followers: DataFrame, root: DataFrame, depth: int, prior: float) -> DataFrame:
    """(last, key, log, pair) of the kept contexts and of what follows them, level by level from the shortest."""
    above = root  # (parent, sym, p): the parents' probabilities
    out = None
    for d in range(1, depth + 1):
        level = followers.filter(F.col("d") == d)
        pairs = level.filter("sym is not null")
        met = pairs.join(above, ["sym"] if d == 1 else ["parent", "sym"])
        gain = F.col("n") * (F.log(F.col("n") / F.col("total")) - F.log("p"))
        test = met.groupBy("ctx").agg(F.sum(gain).alias("gain"), F.count("*").alias("cells"), F.sum("p").alias("held"))
        heads = level.filter("sym is null").select("ctx", "last", "total", "dropped").join(test, "ctx")
        # What was seen too seldom is one more cell.
        rest = F.col("dropped") * (F.log(F.col("dropped") / F.col("total")) - F.log(F.greatest(1 - F.col("held"), F.lit(1e-9))))
        ratio = 2 * (F.col("gain") + F.when(F.col("dropped") > 0, rest).otherwise(0.0))
        freedom = F.greatest(F.col("cells") - F.when(F.col("dropped") > 0, 0).otherwise(1), F.lit(1))
        kept = (ratio > freedom + 3 * F.sqrt(2 * freedom)) & (ratio > 1e-2 * F.col("total"))
        share = (prior + F.col("dropped")) / (F.col("total") + prior)
        heads = stored(heads.select("ctx", "last", kept.alias("kept"), share.alias("share")), "contexts")
        own = F.when(F.col("kept"), F.col("n") / (F.col("total") + prior) + F.col("share") * F.col("p")).otherwise(F.col("p"))
        judged = stored(met.join(heads.select("ctx", "kept", "share"), "ctx").select("ctx", "sym", "last", "kept", own.alias("own")), "judged")
        rows = heads.filter("kept").select("last", F.col("ctx").alias("key"), F.log10("share").alias("log"), F.lit(False).alias("pair"))
        rows = rows.unionByName(judged.filter("kept").select("last", _pair_key(F.col("ctx"), F.col("sym")).alias("key"), F.log10("own").alias("log"), F.lit(True).alias("pair")))
        out = rows if out is None else out.unionByName(rows)
        above = judged.select(F.col("ctx").alias("parent"), "sym", F.col("own").alias("p"))
    return out


def _pair_key(ctx, sym):
    @F.pandas_udf("bigint")
    def key(ctx: pd.Series, sym: pd.Series) -> pd.Series:
        return pd.Series(pair_keys(ctx.to_numpy(np.int64).view(_U), sym.to_numpy(np.int64)).view(np.int64))

    return key(ctx, sym)


def fit(
    train: DataFrame,
    depth: int = DEPTH,
    least: int = LEAST,
    pair_least: int = PAIR_LEAST,
    word_least: int = WORD_LEAST,
    prior: float = PRIOR,
) -> Model:
    spark = train.sparkSession
    words = stored(_counted(train, _tailed), "words")
    texts = train.count()
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens = n_words + texts  # the end is a token
    vocabulary = _frequent(words, word_least)
    n_symbols = CLASSES + len(vocabulary.keys)
    rare = words.filter(F.col("n") < word_least)
    classes = rare.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    class_logs = np.zeros(n_symbols)
    counts = dict(zip(range(CLASSES, n_symbols), vocabulary.counts.tolist()))
    for r in classes:  # at most 2**16
        class_logs[r["tail"] + 1] = math.log10(r["n"] + r["v"] + 1)
        counts[r["tail"] + 1] = r["n"]
    if texts:
        counts[END] = texts
    root = _smoothed_root(counts, n_symbols)
    n_parts = -(-tokens // PART_MASS) or 1
    first = _followers(train, vocabulary, range(1, 2), n_parts, least, pair_least)
    followers = first
    if depth > 1:
        often = first.filter(F.col("n") >= least)  # as pairs: the recent symbol and the one before it
        # Stored: keys made in the filter's own tasks would take two Python workers each, which then live to the end.
        keys = stored(often.select(_older_key(F.col("sym"), F.col("last")).alias("key")), "often")
        held = bit_filter(keys, keys.count())
        followers = first.unionByName(_followers(train, vocabulary, range(2, depth + 1), n_parts, least, pair_least, held))
    symbols = spark.createDataFrame(pa.table({"sym": pa.array(np.array(sorted(counts), np.int32)), "p": pa.array(10 ** root[sorted(counts)])}))
    tree = stored(_pruned(followers, symbols, depth, prior), "tree")
    return Model(vocabulary, root, class_logs, tree, depth, words, texts, tokens, distinct + (1 if texts else 0))


def _older_key(recent, older):
    """The hash of the context of two symbols, as the tasks compute it."""

    @F.pandas_udf("bigint")
    def key(recent: pd.Series, older: pd.Series) -> pd.Series:
        code = extended(np.zeros(len(recent), _U), recent.to_numpy(np.int64))
        return pd.Series(extended(code, older.to_numpy(np.int64)).view(np.int64))

    return key(recent, older)


@dataclass
class Shard:
    """Tables of hashes of contexts and pairs with their logs, and the symbols before a token that they cover."""

    contexts: Table  # apart from the far more pairs, which most contexts need not be looked for in
    pairs: Table
    rests: np.ndarray  # of each symbol: the log of the context of it alone, if that is kept
    number: int
    shards: int
    depth: int

    def plain(self) -> dict:
        """What is broadcast: objects of this package could only be read where it is installed."""
        return {**vars(self), "contexts": vars(self.contexts), "pairs": vars(self.pairs)}

    @classmethod
    def of(cls, plain: dict) -> Shard:
        return cls(**{**plain, "contexts": Table(**plain["contexts"]), "pairs": Table(**plain["pairs"])})

    def add_logs(self, out: np.ndarray, sequence: np.ndarray, last: np.ndarray, contexts: list[tuple]) -> None:
        """Put the log10 probabilities after the longest kept suffix in place of the root's, for the tokens of this shard."""
        mine = last % self.shards == self.number
        for d, code, known in contexts:
            if d == 1:
                rest = self.rests[last]
                held = ~np.isnan(rest)
                at, rest = np.flatnonzero(held), rest[held]
            else:
                at = np.flatnonzero(mine & known)
                held, place = self.contexts.find(code[at])
                at, rest = at[held], self.contexts.values[place[held]]
            seen, place = self.pairs.find(pair_keys(code[at], sequence[at]))
            out[at] = np.where(seen, self.pairs.values[place], out[at] + rest)

    def log_probabilities(self, root: np.ndarray, sequence: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out, history = root[sequence], History(sequence, lengths)
        self.add_logs(out, sequence, history.back(1), list(history.contexts(self.depth)))
        return out


def _shards(model: Model) -> Iterator[Shard]:
    n = model.tree.count()
    shards = -(-12 * n // SHARD_BYTES) or 1
    for number in range(shards):
        rows = model.tree.filter(F.pmod("last", F.lit(shards)) == number)
        rows = rows.select("key", F.col("log").cast("float").alias("log"), "pair").toArrow()  # about SHARD_BYTES
        keys, logs, pair = np.asarray(rows["key"], np.int64).view(_U), np.asarray(rows["log"], np.float32), np.asarray(rows["pair"], bool)
        order = np.argsort(keys)
        contexts, pairs = (Table.of(keys[at], logs[at]) for at in (order[~pair[order]], order[pair[order]]))
        rests = np.full(len(model.root), np.nan, np.float32)
        symbols = np.arange(number, len(rests), shards)
        held, place = contexts.find(extended(np.zeros(len(symbols), _U), symbols))
        rests[symbols[held]] = contexts.values[place[held]]
        yield Shard(contexts, pairs, rests, number, shards, model.depth)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    sc = docs.sparkSession.sparkContext
    vocabulary = model.vocabulary
    word_logs = np.zeros(len(model.root))
    word_logs[CLASSES:] = np.log10(vocabulary.counts + 1.0)
    held_words, plain = sc.broadcast((vocabulary.keys, vocabulary.counts)), sc.broadcast((model.root, model.class_logs, word_logs))
    texts = model.texts
    names = ["n", "id", "key", "times", "known", "log", "score"]
    # A number of its own tells rows apart that repeat an id. It follows from the partition, so a repeated task repeats it.
    rows = docs.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id"), "text")
    kind = rows.schema["id"].dataType.simpleString()

    def passed(parts: list) -> DataFrame:
        """The scores of the tokens of some shards, a row a text without a key; the first pass also gives the words to count, with their times."""
        n_shards, first = parts[0][1][1], parts[0][1][0] == 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, (root, of_class, of_word) = Vocabulary(*held_words.value), plain.value
            trees = [Shard.of(held.value) for held, _ in parts]
            tb.give_back()
            numbers = np.zeros(n_shards, bool)
            numbers[[tree.number for tree in trees]] = True
            for batch in batches:
                column = tb.text_column(batch)
                for lo, hi in tb.row_slices(column, SLICE):
                    n_rows = hi - lo
                    hashes, tail, row = _words(column.slice(lo, n_rows))
                    keys = _tailed(hashes, tail, row, n_rows)
                    symbols = own.look_up(keys)
                    sequence, lengths = _sequence(symbols, row, n_rows)
                    history = History(sequence, lengths)
                    last, contexts = history.back(1), list(history.contexts(trees[0].depth))
                    logs = root[sequence]
                    for tree in trees:
                        tree.add_logs(logs, sequence, last, contexts)
                    logs -= of_class[sequence]
                    if len(trees) < n_shards:
                        logs[~numbers[last % n_shards]] = 0.0
                    scores = np.add.reduceat(logs, np.cumsum(lengths) - lengths)
                    of_row, ids = batch.column(0).slice(lo, n_rows), batch.column(1).slice(lo, n_rows)
                    known = symbols >= CLASSES
                    yield pa.RecordBatch.from_arrays(
                        [of_row, ids, pa.nulls(n_rows, pa.int64()), pa.array(lengths.astype(np.int64) * first),
                         pa.array((np.bincount(row, known, n_rows).astype(np.int64) + (1 if texts else 0)) * first),
                         pa.array((np.bincount(row, of_word[symbols], n_rows) + math.log10(texts + 1)) * first), pa.array(scores)],
                        names=names,
                    )
                    if first:
                        rare = np.flatnonzero(~known)
                        at, times = grouped(pair_keys(keys[rare].view(_U), row[rare]))
                        rare = rare[at]
                        empty = [pa.nulls(len(rare), x) for x in (pa.int64(), pa.float64(), pa.float64())]
                        yield pa.RecordBatch.from_arrays(
                            [of_row.take(pa.array(row[rare])), pa.nulls(len(rare), ids.type), pa.array(keys[rare]), pa.array(times), *empty], names=names
                        )

        return rows.mapInArrow(run, f"n bigint, id {kind}, key bigint, times bigint, known bigint, log double, score double")

    held = [(sc.broadcast(shard.plain()), (shard.number, shard.shards)) for shard in _shards(model)]
    passes = [held[k : k + SHARDS_A_PASS] for k in range(0, len(held), SHARDS_A_PASS)]
    scored = reduce(DataFrame.unionByName, [passed(parts) for parts in passes])
    # A text's own row has no word: a key of its own spreads these rows, and the flag keeps them from counting.
    spread = scored.withColumn("whole", F.col("key").isNull()).withColumn("key", F.coalesce("key", F.xxhash64("n")))
    # Sums of doubles depend on their order; sums of decimals, and of whole billionths, do not.
    counts = model.words.select("key", F.round(F.log10(F.col("n") + 1.0) * BILLION).cast("long").alias("of_word"))
    # A word is one row of the counts, so their part of a partition is small whatever the texts repeat: it is hashed, the rest is not sorted.
    met = spread.join(counts.hint("shuffle_hash"), "key", "left").withColumn("of_word", F.when(~F.col("whole"), F.col("of_word")))
    exact = lambda column: F.sum(F.col(column).cast("decimal(28,10)")).cast("double")
    out = met.groupBy("n").agg(
        F.first("id", ignorenulls=True).alias("id"),
        F.max(F.when(F.col("whole"), F.col("times"))).alias("n_tokens"),
        F.sum(F.when(F.col("whole"), F.col("known")).when(F.col("of_word").isNotNull(), F.col("times"))).alias("n_known"),
        exact("log").alias("log"),
        exact("score").alias("score"),
        (F.coalesce(F.sum(F.col("times") * F.col("of_word")), F.lit(0)) / BILLION).alias("rare"),
    )
    width = math.log10(model.tokens + model.distinct + 1)
    base = F.col("log") + F.col("rare") - F.col("n_tokens") * F.lit(width)
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        # Of a word of a class the count belongs to the score too.
        (F.col("score") + F.col("rare")).alias("score"),
    )


def scored_documents(docs: DataFrame, fold: int = 7, held_out: int = 2) -> DataFrame:
    """Learn from the rows outside the held-out fold and score all rows."""
    outside = crc_fold(fold) != held_out
    model = fit(docs.filter(outside))
    return score(docs, model).withColumn("held_out", ~outside)
