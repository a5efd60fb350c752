"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the words of all benchmark items. A document's words are streamed through it; the state and the
length of the longest match at each word tell which item windows end there. Words inside such a window are hit, and
the hit spans can be reported, or removed when they pass a length or coverage limit.

Scale: the items are a stated query set; their words are counted first, and items beyond ``shard_words`` words are dealt over several
automata, one pass over the documents each: what the driver builds and a task opens at a time is one automaton of bounded size. With
one automaton the documents are only mapped; with several, each pass gives the spans of the documents that it hits, and they are
merged by document.

Defined results: a null or empty document has no words; a null or empty item has no window; an item with fewer words
than a window is one window; repeated items count each by its id; a null item id is skipped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .frames import fresh, stored

WINDOW = 10
SHARD_WORDS = 500_000

# Letters, digits and bytes from 0x80 up stay (A-Z in lower case), all else ends a word.
KEPT = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(KEPT).split()


class Automaton:
    """Suffix automaton of several word sequences; states are numbers, 0 is the start."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        held: dict[int, set[int]] = {}
        whole: list[tuple[int, int, int]] = []
        self.items = [item for item, _ in items]
        for k, (_, words) in enumerate(items):
            last = 0
            for n, word in enumerate(words, 1):
                last = self._extend(last, word)
                if n >= window:
                    held.setdefault(last, set()).add(k)
            if 0 < len(words) < window:
                whole.append((last, len(words), k))
        self._attach(held, whole)

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        state = self._add(self.length[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at < 0:
            self.link[state] = 0
        else:
            target = self.next[at][word]
            exact = self.length[target] == self.length[at] + 1
            self.link[state] = target if exact else self._split(at, word, target)
        return state

    def _add(self, length: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, word: bytes, target: int) -> int:
        """Give the part of ``target`` that is no longer than what ends at ``at`` a state of its own."""
        part = self._add(self.length[at] + 1, dict(self.next[target]))
        self.link[part], self.link[target] = self.link[target], part
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = part
            at = self.link[at]
        return part

    def _attach(self, held: dict[int, set[int]], whole: list[tuple[int, int, int]]) -> None:
        """For each state: the state of its last ``window`` words, the items there, and the short items it ends with."""
        order = sorted(range(len(self.next)), key=lambda s: self.length[s])
        items = [set() for _ in order]
        for state, ks in held.items():
            items[state] |= ks
        for state in reversed(order):  # what ends at a state ends at its link too
            if state and self.length[self.link[state]] >= self.window:
                items[self.link[state]] |= items[state]
        self.window_state = [0] * len(order)
        for state in order[1:]:
            if self.length[state] >= self.window:
                up = self.link[state]
                self.window_state[state] = self.window_state[up] if self.length[up] >= self.window else state
        self.window_items = {s: sorted(items[s]) for s in set(self.window_state) if s}
        # A short item may have been read along states that were split later: look its state up again.
        own: dict[int, list[tuple[int, int]]] = {}
        for state, n, k in whole:
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            own.setdefault(state, []).append((n, k))
        self.short: list[tuple] = [()] * len(order)
        for state in order[1:]:
            self.short[state] = tuple(own.get(state, ())) + self.short[self.link[state]]

    @classmethod
    def of(cls, fields: dict) -> Automaton:
        """The automaton whose ``vars`` were broadcast."""
        out = cls.__new__(cls)
        vars(out).update(fields)
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (start, end), merged, and the numbers of the items whose windows occur."""
        moves, link, length = self.next, self.link, self.length
        window, window_state, short = self.window, self.window_state, self.short
        spans: list[list[int]] = []
        found: set[int] = set()
        seen: set[int] = set()
        state = have = 0
        for i, word in enumerate(words):
            to = moves[state].get(word)
            while to is None and state:
                state = link[state]
                have = length[state]
                to = moves[state].get(word)
            if to is None:
                continue
            state = to
            have += 1
            reach = 0
            if have >= window:
                reach = window
                at = window_state[state]
                if at not in seen:
                    seen.add(at)
                    found.update(self.window_items[at])
            if short[state]:
                for n, k in short[state]:
                    if n <= have:
                        found.add(k)
                        reach = max(reach, n)
            if reach:
                lo = i + 1 - reach
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append([lo, i + 1])
        return [(a, b) for a, b in spans], found


def _tokens(items: DataFrame) -> DataFrame:
    return items.select("item_id", "text").filter("item_id is not null and text is not null")


def automata(items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Iterator[Automaton]:
    """One automaton for each shard of the items; no shard holds more than about ``shard_words`` words."""
    rows = _tokens(items)
    # A word takes at least a character and one between, so characters bound the words.
    total = rows.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0.0))).first()[0]
    shards = max(1, -(-int(total) // shard_words))
    for k in range(shards):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).orderBy("item_id", "text")
        yield Automaton([(r["item_id"], words_of(r["text"])) for r in part.toLocalIterator()], window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = "id {kind}, n_words bigint, spans array<struct<start:int,end:int>>, item_ids array<string>"


def _scanned(rows: DataFrame, automaton: Automaton, all_rows: bool) -> DataFrame:
    """(id, n_words, spans, item_ids) of rows (id, text): of all, or of those that one automaton hits."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(automaton))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton.of(shared.value)
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            at, counts, spans, ids = [], [], [], []
            for i, text in enumerate(tb.text_column(batch)):
                words = words_of(text.as_py())
                where, found = machine.scan(words)
                if where or all_rows:
                    at.append(i)
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in _merged(where)])
                    ids.append(sorted({str(machine.items[k]) for k in found}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(ids, pa.list_(pa.string()))],
                names=["id", "n_words", "spans", "item_ids"],
            )

    return rows.select("id", "text").mapInArrow(run, _SPANS.format(kind=rows.schema["id"].dataType.simpleString()))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` stored with a number for each row, and its name: later passes find the same row by it."""
    name = fresh(docs, "_row")
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def _merged_passes(rows: DataFrame, machines: Iterator[Automaton]) -> DataFrame:
    """(id, n_words, spans, item_ids) of the rows that any of several automata hits, one stored pass an automaton."""
    passes = [stored(_scanned(rows, machine, False), "hits") for machine in machines]
    every = reduce(DataFrame.unionByName, passes)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))  # of one document, from as many passes as there are automata
    per = every.groupBy("id").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(done, x):
        top = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(top["start"].alias("start"), F.greatest(top["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(F.concat(done, F.array(x)))

    return per.withColumn("spans", F.aggregate("spans", none, add))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, spans, item_ids): hit word spans [start, end) and the ids, sorted as strings, of the items found."""
    machines = automata(items, window, shard_words)
    first, more = next(machines), next(machines, None)
    if more is None:
        return _scanned(docs.select(F.col(id_col).alias("id"), "text"), first, True).withColumnRenamed("id", id_col)
    rows, name = _numbered(docs.select(F.col(id_col).alias("id"), "text"))
    keyed = rows.select(F.col(name).alias("id"), "text")
    found = _merged_passes(keyed, chain([first, more], machines)).withColumnRenamed("id", name)
    none = {"spans": "array<struct<start:int,end:int>>", "item_ids": "array<string>"}
    words = _scanned(keyed, Automaton([], window), True).select(F.col("id").alias(name), F.col("n_words").alias("_n"))
    out = rows.select("id", name).join(words, name).join(found, name, "left")
    return out.select(F.col("id").alias(id_col), F.col("_n").alias("n_words"), *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in none.items()])


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The digest of ``hits``: counts, the hash of the item ids, and whether any word is hit."""
    found = hits(docs, items, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove_spans(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, min_words: int = WINDOW, max_share: float = 0.5, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``docs`` with the benchmark passages cut out.

    A hit span of at least ``min_words`` words (short items: always) is removed, from the start of its first word to the
    start of the next one; a document with more than ``max_share`` of its words hit is dropped. ``n_chars``, if there
    is one, follows the new text. Other texts and columns stay as they are.
    """
    machines = automata(items, window, shard_words)
    first, more = next(machines), next(machines, None)
    shared = given = None
    names = docs.columns
    if more is None:
        shared = docs.sparkSession.sparkContext.broadcast(vars(first))
        rows = docs
    else:  # the spans of all passes come with the row
        rows, row = _numbered(docs)
        given = fresh(rows, "_spans")
        found = _merged_passes(rows.select(F.col(row).alias("id"), "text"), chain([first, more], machines))
        rows = rows.join(found.select(F.col("id").alias(row), F.col("spans").alias(given)), row, "left").select(*names, given)
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(text: str, find) -> str | None:
        raw = text.encode()
        flat = raw.translate(KEPT)
        words = flat.split()
        spans = [(a, b) for a, b in _merged(find(words)) if b - a >= min_words or b - a < window]
        if not spans:
            return text
        if sum(b - a for a, b in spans) > max_share * len(words):
            return None
        starts, at = [], 0
        for word in words:
            at = flat.index(word, at)
            starts.append(at)
            at += len(word)
        starts.append(len(raw))
        kept, at = [], 0
        for a, b in spans:
            kept.append(raw[at : starts[a]])
            at = starts[b]
        return (b"".join(kept) + raw[at:]).decode(errors="ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton.of(shared.value) if shared else None
        for batch in batches:
            column = batch.column(text_at)
            if machine:
                finds = [lambda words: machine.scan(words)[0]] * batch.num_rows
            else:
                held = batch.column(len(names)).to_pylist()
                finds = [lambda words, own=own: [(x["start"], x["end"]) for x in own or ()] for own in held]
            texts = [None if t is None else cut(t, find) for t, find in zip(column.to_pylist(), finds)]
            changed = [i for i, (old, new) in enumerate(zip(column, texts)) if new is not None and old.as_py() != new]
            columns = list(batch.columns)[: len(names)]
            columns[text_at] = pa.array(texts, column.type)
            if chars_at is not None and changed:
                counts = batch.column(chars_at).to_pylist()
                for i in changed:
                    counts[i] = len(texts[i])
                columns[chars_at] = pa.array(counts, columns[chars_at].type)
            out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(names)])
            stays = pa.array([new is not None or not old.is_valid for old, new in zip(column, texts)], pa.bool_())
            yield out.filter(stays)

    return rows.mapInArrow(run, docs.schema)
