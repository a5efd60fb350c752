"""Substring dedup: windows of words that occur more than once in a corpus, found with an FM-index per shard.

1. A pass over the texts cuts each document into *stretches*: runs of consecutive windows that share the smallest hash
   of their ``gram``-word parts. Equal windows have equal smallest hashes, so they meet in one shard, and every window
   lies in exactly one stretch. Only hashes and positions leave this pass.
2. Stretches whose hash occurs once in the corpus hold no repeated window and stop here (counts are combined before the
   shuffle).
3. Equal stretches become one with a multiplicity, so that thousands of copies of a passage are two in the index. Their
   words are read once more, and go to the shard of their hash.
4. Each shard builds a compressed FM-index of its stretches; backward search through its wavelet matrix gives the
   matching statistics of the stretches, and the intervals of repeated windows are reported. A shard beyond
   ``shard_words`` words is cut into blocks, and every pair of blocks gets an index: exact, with bounded tasks.
5. The intervals are joined back to all places of their stretch and merged a document.

Words are compared by 64-bit hashes, stretches by 64-bit hashes of those. A window is judged on the input only. Hot keys:
a passage in a third of all documents is one stretch in 3 and 4; in 2 and 5 it is a skewed side of a plain sort-merge
join, which adaptive execution splits.

Defined results: null and empty texts have no words; a document shorter than a window has no window; rows that repeat
a text (or an id and a text) repeat each other's windows; a null id is told apart by its text, like a repeated one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .fm_index import FMIndex, repeated_cover
from .frames import fresh, stored

WINDOW = 35
GRAM = 8
SHARD_WORDS = 1_000_000


def _stretches_of(texts: pa.Array, window: int, gram: int):
    """(row, first word, windows, shared hash, hash of the words, times the shared hash occurs) of a slice's stretches."""
    data, offsets = tb.raw_bytes(texts)
    starts, ends, firsts = tb.word_spans(data, offsets)
    n = len(starts)
    if n < window:
        return None
    words = tb.word_hashes(data, starts, ends)
    total = tb.running_hash(words)
    at = np.arange(n - gram + 1)
    grams = tb.span_hash(total, at, at + gram)
    least = tb.sliding_min(grams, window - gram + 1)  # of each window
    row = np.repeat(np.arange(len(texts)), np.diff(firsts))
    whole = row[: n - window + 1] == row[window - 1 :]
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (row[1 : len(least)] != row[: len(least) - 1])
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(least))
    # Windows of a row are consecutive; those that reach into the next row end its last stretch early.
    inside = np.concatenate(([0], np.cumsum(whole)))
    sizes = inside[end] - inside[begin]
    some = sizes > 0
    begin, sizes = begin[some], sizes[some]
    stop = begin + sizes + window - 1
    key = least[begin]
    spread = sizes + window - gram
    ids = np.repeat(np.arange(len(begin)), spread)
    places = np.arange(len(ids)) - np.repeat(np.cumsum(spread) - spread, spread) + begin[ids]
    times = np.bincount(ids[grams[places] == key[ids]], minlength=len(begin))
    which = row[begin]
    return which, begin - firsts[which], sizes, key, tb.span_hash(total, begin, stop), times


def _sliced(texts: pa.Array):
    for lo, hi in tb.row_slices(texts):
        yield lo, texts.slice(lo, hi - lo)


def stretches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, id, first, windows, same, times): see the module; ``docs`` has (id, text)."""
    names = ["key", "id", "first", "windows", "same", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tb.give_back()
            texts = tb.text_column(batch)
            for lo, part in _sliced(texts):
                out = _stretches_of(part, window, gram)
                if out is None:
                    continue
                which, first, sizes, key, same, times = out
                ids = batch.column(0).take(pa.array(which + lo))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        ids,
                        pa.array(first.astype(np.int32)),
                        pa.array(sizes.astype(np.int32)),
                        pa.array(same.view(np.int64)),
                        pa.array(np.minimum(times, 2).astype(np.int32)),
                    ],
                    names=names,
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"key bigint, id {kind}, first int, windows int, same bigint, times int")


def _with_words(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """Distinct stretches (key, id, first, windows, same, copies) with their words as text."""
    per_doc = wanted.groupBy("id").agg(
        F.collect_list(F.struct("first", "windows", "key", "same", "copies")).alias("parts")  # a document's own stretches
    )
    kind = "struct<key:bigint,same:bigint,windows:int,copies:int,words:binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tb.give_back()
            texts = tb.text_column(batch)
            parts_at = batch.schema.get_field_index("parts")
            parts = batch.column(parts_at)
            for lo, part in _sliced(texts):
                data, offsets = tb.raw_bytes(part)
                starts, ends, firsts = tb.word_spans(data, offsets)
                raw = data.tobytes()
                rows = parts.slice(lo, len(part))
                flat = rows.flatten()
                sizes = np.asarray(rows.value_lengths().fill_null(0), np.int64)
                which = np.repeat(np.arange(len(part)), sizes)
                first = firsts[which] + np.asarray(flat.field("first"))
                stop = first + np.asarray(flat.field("windows")) + window - 1
                words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[stop - 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [flat.field("key"), flat.field("same"), flat.field("windows"), flat.field("copies"), pa.array(words, pa.binary())],
                    names=["key", "same", "windows", "copies", "words"],
                )

    joined = docs.select("id", "text").join(per_doc, "id")
    return joined.mapInArrow(run, kind.removeprefix("struct<").removesuffix(">").replace(":", " "))


def _search(window: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Index the stretches of a shard and report what is repeated of each: the ends of the intervals, in turn."""
        tb.give_back()
        group = group.drop_duplicates("same")
        texts = pa.array(group["words"], pa.binary()).cast(pa.large_binary())
        data, offsets = tb.raw_bytes(texts)
        starts, ends, firsts = tb.word_spans(data, offsets)
        _, ids = np.unique(tb.word_hashes(data, starts, ends), return_inverse=True)
        sizes = np.diff(firsts)
        copies = group["copies"].to_numpy()
        # Stretches stand one after another behind a separator; of a repeated one the second copy is not needed: it
        # counts for itself, so one occurrence is enough for its windows, and it is added once more for the others.
        twice = np.flatnonzero(copies > 1)
        order = np.concatenate((np.arange(len(sizes)), twice))
        length = sizes[order] + 1
        begin = np.cumsum(length) - length
        symbols = np.zeros(int(length.sum()), np.int64)
        place = np.repeat(firsts[:-1][order] - begin - 1, length) + np.arange(len(symbols))
        inner = np.ones(len(symbols), bool)
        inner[begin] = False
        symbols[inner] = ids[place[inner]] + 1
        index = FMIndex(symbols, window)
        n = len(sizes)
        k, at = repeated_cover(index, symbols, begin[:n] + 1, group["windows"].to_numpy(), window, np.full(n, 2))
        by_stretch = np.lexsort((at, k))
        k, at = k[by_stretch], at[by_stretch]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (at[1:] > at[:-1] + window)
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(k)) - 1
        return pd.DataFrame(
            {
                "same": group["same"].to_numpy()[k[head]],
                "lo": at[head].astype(np.int32),
                "hi": (at[tail] + window).astype(np.int32),
            }
        )

    return run


def _shard(words: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Deal the stretches over shards, and large shards over all pairs of their blocks."""
    spark = words.sparkSession
    size = F.col("windows") + window - 1
    total = words.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // shard_words))
    dealt = words.withColumn("shard", F.pmod(F.hash("key"), F.lit(n)))
    large = dealt.groupBy("shard").agg(F.sum(size).alias("held")).filter(F.col("held") > shard_words)
    large = large.select("shard", F.ceil(F.col("held") / (shard_words / 2)).cast("int").alias("blocks"))
    dealt = dealt.join(large, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n)
    return dealt.drop("own", "other", "blocks").repartition(parts, "shard", "one", "two")


def repeated_intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` (id, text) -> (id, lo, hi): word intervals that are covered by repeated windows; they may overlap."""
    all_of = stored(stretches(docs, window, gram), "stretches")
    often = all_of.groupBy("key").agg(F.sum("times").alias("n")).filter("n > 1").select("key")
    places = stored(all_of.join(often, "key", "left_semi"), "places")
    wanted = places.groupBy("key", "same", "windows").agg(
        F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"), F.min(F.struct("id", "first")).alias("at")
    )
    wanted = wanted.select("key", "same", "windows", "copies", "at.id", "at.first")
    words = stored(_with_words(wanted, docs, window), "stretch_words")
    sharded = _shard(words, window, shard_words)
    found = sharded.groupBy("shard", "one", "two").applyInPandas(_search(window), "same bigint, lo int, hi int")
    found = stored(found.distinct(), "intervals")
    at = places.select("id", "first", "same").join(found, "same")
    return at.select("id", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))


def _covered(parts, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    for part in parts or ():
        step[min(part["lo"], n)] += 1
        step[min(part["hi"], n)] -= 1
    return np.cumsum(step[:-1]) > 0


def _with_intervals(docs: DataFrame, id_col: str, **options) -> tuple[DataFrame, str]:
    """Every row of ``docs`` with one more column, the array of its intervals or null, and that column's name.

    A row is named by its id and its text, so that null and repeated ids are told apart by their texts.
    """
    key, parts = fresh(docs, "_key"), fresh(docs, "_parts")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64("text").alias("of")))
    found = repeated_intervals(keyed.select(F.col(key).alias("id"), "text"), **options)
    merged = found.distinct().groupBy(F.col("id").alias(key)).agg(F.collect_list(F.struct("lo", "hi")).alias(parts))
    return keyed.join(merged, key, "left").drop(key), parts


def digest(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every document."""
    rows, parts_col = _with_intervals(docs.select(id_col, "text"), id_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests = [], [], []
            for text, parts in zip(tb.text_column(batch), batch.column(2)):
                words = text.as_py().encode().split()
                gone = _covered(parts.as_py(), len(words))
                n = int(gone.sum())
                kept = words if not n else [w for w, g in zip(words, gone.tolist()) if not g]
                counts.append(len(words))
                removed.append(n)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                names=[id_col, "n_words", "n_removed", "kept_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_words bigint, n_removed bigint, kept_sha256 string"
    return rows.select(id_col, "text", parts_col).mapInArrow(run, schema)


def _cut(text: str, parts) -> str:
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, _, _ = tb.word_spans(data, np.array([0, len(raw)]))
    gone = _covered(parts, len(starts))
    edge = np.append(starts, len(raw))
    kept = [raw[: edge[0]]] + [raw[edge[i] : edge[i + 1]] for i in np.flatnonzero(~gone).tolist()]
    return b"".join(kept).decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the words of repeated windows, each removed with the white space behind it.

    Every place of a repeated passage goes, the first one too; a document that is all repeats stays with an empty text.
    ``n_chars``, if there is one, follows the new text. Texts without repeats stay as they are.
    """
    rows, parts_col = _with_intervals(docs, id_col, **options)
    rows = rows.select(*docs.columns, parts_col)
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            parts = columns.pop()
            texts = columns[text_at].to_pylist()
            counts = columns[chars_at].to_pylist() if chars_at is not None else None
            for i, own in enumerate(parts):
                if own.is_valid and texts[i] is not None:
                    texts[i] = _cut(texts[i], own.as_py())
                    if counts is not None:
                        counts[i] = len(texts[i])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if counts is not None:
                columns[chars_at] = pa.array(counts, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return rows.mapInArrow(run, docs.schema)
