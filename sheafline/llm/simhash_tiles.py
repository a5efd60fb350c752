"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared with numpy exclusive-or and bit counts, tile against tile. Two fingerprints within
``radius`` bits have bit counts within ``radius`` of each other, so tiles hold one bit count each and only tiles whose
counts are near are paired; inside a pair the same bound on the count of the upper half skips most blocks. The
comparison is exact: no bucket is capped and no pair is left out.

Scale: equal fingerprints are one row before anything is compared. A tile has at most about ``tile_rows`` rows
(popular bit counts are cut into several tiles by a hash), a task compares one pair of tiles, and what leaves it is a
spanning forest of the links it found, so a group of k near copies gives at most k - 1 links a tile pair.

``keep_first`` works on sets of distinct shingles and takes fingerprints of 256 bits for candidates only. Its tiles hold the sets
with one of ``KEYS`` smallest hashes in common, so that work follows what texts share: two sets with a Jaccard index of 0.8 have no
tile in common with a chance of 0.2 ** 12. Inside a tile the comparison is exact: such sets differ in 39 bits on average with a
standard deviation of 5.7, the smallest ones (4 of 5) in 48 with one of 6.2, unrelated ones in 128 with one of 8; candidates are
within 80 bits. A pair is a link if the sets themselves have the index: inside a group of candidates, common shingles of one set
with all others that are not joined yet are counted at once.

Defined results: a null or empty text has no words and the fingerprint zero, linked like any other; a text of fewer
words than a shingle is one shingle; repeated shingles count each time; a null id is grouped like any id
(its component is the smallest id of the group that is not null); columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .collocations import bit_filter
from .components import components
from .frames import fresh, stored

SEED = 42
TILE_ROWS = 32_768
BLOCK = (16, 8192)
#: Of ``keep_first``: words of fingerprint, the most bits that candidates differ in, and smallest hashes a set.
SET_WORDS, SET_RADIUS, KEYS = 4, 80, 12
TILE_SHINGLES = 1 << 20


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of a text: ``width`` words joined by one space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - width]))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray, n_words: int, step: int = 1 << 15) -> list[int]:
    """``n_words`` 64-bit integers; a bit is set if it is set in over half of the hashes.

    The first word counts the hashes' own bits, each further one those of another mix of them.
    """
    out = []
    for k in range(n_words):
        counts = np.zeros(64, np.int64)
        for lo in range(0, len(hashes), step):
            h = hashes[lo : lo + step]
            if k:
                h = tb.mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, width: int = 4, n_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint): big-endian bytes, 8 for each of ``n_words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [
                b"".join(w.to_bytes(8, "big") for w in fingerprint(shingle_hashes(t.as_py().encode(), width), n_words))
                for t in tb.text_column(batch)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["id", "fingerprint"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, fingerprint binary")


def _matrix(prints) -> np.ndarray:
    """One row of native 64-bit words a fingerprint."""
    raw = np.frombuffer(b"".join(prints), ">u8").astype(np.uint64)
    return raw.reshape(len(prints), -1)


def popcounts(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values).sum(axis=1, dtype=np.int64)


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within ``radius`` bits, block by block; both sides in the order of their upper counts."""
    upper = lambda v: np.bitwise_count(v >> np.uint64(32)).sum(axis=1, dtype=np.int64)
    lu, ru = upper(left), upper(right)
    lt, rt = popcounts(left), popcounts(right)
    lo_order, ro_order = np.lexsort((lt, lu)), np.lexsort((rt, ru))
    left, right, lu, ru = left[lo_order], right[ro_order], lu[lo_order], ru[ro_order]
    shift = int(rt[0] - lt[0])  # a tile has one bit count
    # |d| + |shift - d| <= radius for the difference d of the upper counts
    most = (radius + shift) // 2
    least = -((radius - shift) // 2)
    rows, cols = BLOCK
    for a in range(0, len(left), rows):
        x = left[a : a + rows]
        lo, hi = np.searchsorted(ru, [lu[a] + least, lu[min(a + rows, len(lu)) - 1] + most + 1])
        for b in range(int(lo), int(hi), cols):
            y = right[b : min(b + cols, int(hi))]
            away = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            for k in range(1, left.shape[1]):
                away = away + np.bitwise_count(x[:, None, k] ^ y[None, :, k])
            near = away <= radius
            if near.any():
                i, j = np.nonzero(near)
                yield lo_order[a + i], ro_order[b + j]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], holds=lambda i, j: True) -> list[tuple[int, int]]:
    """Spanning forest, over nodes 0..n-1, of the pairs that hold."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for left, right in pairs:
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = root(i), root(j)
            if a != b and holds(i, j):
                parent[max(a, b)] = min(a, b)
                kept.append((i, j))
    return kept


def links(prints: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distinct ``fingerprint`` rows -> (a, b): a spanning forest, for each tile pair, of all pairs within the radius."""

    def count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            bits = popcounts(_matrix(column.to_pylist())) if len(column) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([column, pa.array(bits.astype(np.int32))], names=["fingerprint", "bits"])

    def pairs(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return close_pairs(left, right, radius)

    tiled = stored(prints.select("fingerprint").mapInArrow(count_bits, "fingerprint binary, bits int"), "tiles")
    return tile_links(tiled, radius, pairs, tile_rows)


def tile_links(tiled: DataFrame, reach: int, pairs, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(fingerprint, bits) -> (a, b): spanning forests of what ``pairs(left, right)`` finds where ``bits`` are within ``reach``."""
    sizes = {r["bits"]: r["count"] for r in tiled.groupBy("bits").count().collect()}  # as many rows as bit counts
    cuts = {b: -(-n // tile_rows) for b, n in sizes.items()}
    partners = []  # (bits, tile) -> pairs of tiles that it belongs to; as many as pairs of bit counts
    for b in sorted(cuts):
        for c in sorted(cuts):
            if b <= c <= b + reach:
                partners.append((b, c, cuts[b], cuts[c], True))
                if b != c:
                    partners.append((c, b, cuts[c], cuts[b], False))
    if not partners:
        return tiled.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).limit(0)
    spark = tiled.sparkSession
    table = F.broadcast(spark.createDataFrame(partners, "bits int, other int, own_cuts int, other_cuts int, lower boolean"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("own_cuts")).cast("int")
    spread = (
        tiled.join(table, "bits")
        .withColumn("own", own)
        .withColumn("there", F.explode(F.sequence(F.lit(0), F.col("other_cuts") - 1)))
        .filter((F.col("bits") != F.col("other")) | (F.col("there") >= F.col("own")))
    )
    same = F.col("bits") == F.col("other")
    sides = spread.select(
        "fingerprint",
        F.when(F.col("lower"), F.struct("bits", "own", F.col("other").alias("c"), "there"))
        .otherwise(F.struct(F.col("other").alias("bits"), F.col("there").alias("own"), F.col("bits").alias("c"), F.col("own").alias("there")))
        .alias("pair"),
        F.col("lower").alias("left"),
        (same & (F.col("there") == F.col("own"))).alias("itself"),
    )
    # A pair of tiles of one bit count needs the later tile's rows too.
    again = spread.filter(same).select("fingerprint", "bits", "own", "own_cuts").distinct()
    again = again.withColumn("there", F.explode(F.sequence(F.lit(0), F.col("own_cuts") - 1))).filter(F.col("there") < F.col("own"))
    sides = sides.unionByName(
        again.select(
            "fingerprint",
            F.struct("bits", F.col("there").alias("own"), F.col("bits").alias("c"), F.col("own").alias("there")).alias("pair"),
            F.lit(False).alias("left"),
            F.lit(False).alias("itself"),
        )
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        prints = group["fingerprint"].to_numpy()
        is_left = group["left"].to_numpy(bool)
        if group["itself"].iloc[0]:
            a = b = np.arange(len(prints))
        else:
            a, b = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []})
        values = _matrix(prints.tolist())
        found = ((a[i], b[j]) for i, j in pairs(values[a], values[b]))
        kept = _forest(len(prints), found)
        return pd.DataFrame({"a": [prints[i] for i, _ in kept], "b": [prints[j] for _, j in kept]})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(cuts.values()) - len(cuts))
    return sides.repartition(parts, "pair").groupBy("pair").applyInPandas(compare, "a binary, b binary")


def near_duplicates(
    docs: DataFrame,
    width: int = 4,
    radius: int = 4,
    n_words: int = 1,
    tile_rows: int = TILE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, fingerprint, component_id): the smallest id that is reachable over links of at most ``radius`` bits."""
    marked = stored(fingerprints(docs, width, n_words, id_col, text_col), "fingerprints")
    firsts = stored(marked.groupBy("fingerprint").agg(F.min("id").alias("first")), "firsts")
    found = components(links(firsts, radius, tile_rows))
    grouped = firsts.join(found.select(F.col("node").alias("fingerprint"), "component"), "fingerprint", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "fingerprint"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = grouped.join(least, "component").select("fingerprint", "component_id")
    return marked.join(classes, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def _bit_majorities(hashes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes: the 64 bits that are set in over half of them."""
    # Eight counters a word at a time, one a byte; a byte holds 255.
    extra = (sizes - 1) // 255
    at = np.repeat(first, extra + 1) + 255 * (np.arange(int((extra + 1).sum())) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1))
    runs = np.cumsum(extra + 1) - extra - 1
    lanes = np.uint64(0x0101010101010101)
    out = np.zeros(len(first), np.uint64)
    for k in range(8):
        counts = np.add.reduceat((hashes >> np.uint64(k)) & lanes, at).view(np.uint8).reshape(-1, 8)
        most = 2 * np.add.reduceat(counts, runs, axis=0, dtype=np.int64) > sizes[:, None]
        out |= (most.astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return out


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, sorted in each, sizes): 64-bit hashes of ``width`` words, A-Z lower-cased.

    A text of fewer words is one shingle, one of none has an empty set.
    """
    data, offsets = tb.raw_bytes(texts)
    data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
    starts, ends, firsts = tb.word_spans(data, offsets)
    total = tb.running_hash(tb.word_hashes(data, starts, ends))
    n = np.diff(firsts)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    at = firsts[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    hashes = tb.span_hash(total, at, np.minimum(at + width, firsts[1:][row]))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[fresh], np.bincount(row[fresh], minlength=len(n))


def _set_names(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """128 bits of a hash of each set: texts of one set have one name."""
    ends = np.cumsum(sizes)
    return [xxhash.xxh3_128_digest(hashes[a:b].tobytes(), SEED) for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def set_prints(docs: DataFrame, width: int) -> DataFrame:
    """Rows (id, one, two, text) -> (id, one, two, node, print, size, least): a set's name, fingerprint, size and smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tb.give_back()
            column = tb.text_column(batch)
            for lo, hi in tb.row_slices(column):
                hashes, sizes = shingle_sets(column.slice(lo, hi - lo), width)
                some = np.flatnonzero(sizes)
                first = (np.cumsum(sizes) - sizes)[some]
                prints = np.zeros((hi - lo, SET_WORDS), np.uint64)
                least = np.zeros((len(some), KEYS), np.uint64)
                if len(some):
                    for k in range(SET_WORDS):
                        prints[some, k] = _bit_majorities(tb.mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)), first, sizes[some])
                    for k in range(KEYS):
                        least[:, k] = np.minimum.reduceat(tb.mix(hashes ^ np.uint64((k + 1) * 0xD6E8FEB86659FD93 % 2**64)), first)
                marks = np.concatenate(([0], np.cumsum(np.where(sizes > 0, KEYS, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, hi - lo) for c in range(3)),
                        pa.array(_set_names(hashes, sizes), pa.binary()),
                        pa.array([p.tobytes() for p in prints], pa.binary()),
                        pa.array(sizes.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(marks), pa.array(least.reshape(-1).view(np.int64))),
                    ],
                    names=["id", "one", "two", "node", "print", "size", "least"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, one bigint, two bigint, node binary, print binary, size bigint, least array<bigint>")


def _chosen_sets(docs: DataFrame, groups: DataFrame, n: int, width: int) -> DataFrame:
    """(node, size, shingles) of the sets in ``groups`` (n rows), each once; others hardly leave the task that reads them."""
    keys = groups.select(F.xxhash64("node").alias("key"))
    held = docs.sparkSession.sparkContext.broadcast(bit_filter(keys, n))  # at most 64 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tb.give_back()
            column = tb.text_column(batch)
            for lo, hi in tb.row_slices(column):
                hashes, sizes = shingle_sets(column.slice(lo, hi - lo), width)
                nodes = _set_names(hashes, sizes)
                keys = np.array([xxhash.xxh64_intdigest(x, SEED) for x in nodes], np.uint64)
                some = held.value.holds(keys)
                names = [x for x, kept in zip(nodes, some.tolist()) if kept]
                values = hashes[np.repeat(some, sizes)]
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes[some]))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(sizes[some].astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64)))],
                    names=["node", "size", "shingles"],
                )

    found = docs.select("text").mapInArrow(run, "node binary, size bigint, shingles array<bigint>")
    return found.groupBy("node").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))


def _merge(labels: np.ndarray, i: int, others: np.ndarray) -> Iterator[int]:
    """Join the nodes ``others`` to the component of ``i``; gives those that were in another one."""
    for j in others.tolist():
        if labels[j] != labels[i]:
            labels[labels == labels[j]] = labels[i]
            yield j


def _close_in_tiles(key: np.ndarray, prints: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float):
    """Spanning forest (i, j) of the candidates, left rows against right rows of the same key; rows come sorted by key."""
    labels = np.arange(len(key))
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    small = np.diff(edges)
    kept: list[tuple[int, int]] = []

    def close(i, j) -> np.ndarray:
        fits = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 0.5
        away = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=-1, dtype=np.int64)
        return fits & (away <= SET_RADIUS) & ((left[i] & right[j]) | (left[j] & right[i]))

    # Tiles of few rows: all at once, by the distance of two rows in a tile.
    most = 32
    inside = np.repeat((small <= most) & (small > 1), small)
    till = np.repeat(edges[1:], small)
    for step in range(1, most):
        i = np.flatnonzero(inside & (np.arange(len(key)) + step < till))
        if not len(i):
            break
        near = i[close(i, i + step)]
        for a in near[labels[near] != labels[near + step]].tolist():
            kept += [(a, j) for j in _merge(labels, a, np.array([a + step]))]
    for t in np.flatnonzero(small > most).tolist():
        rows = np.arange(edges[t], edges[t + 1])
        for a in rows[left[rows]].tolist():
            others = rows[(labels[rows] != labels[a]) & right[rows]]
            kept += [(a, j) for j in _merge(labels, a, others[close(a, others)])]
    return kept


def candidates(nodes: DataFrame, similarity: float, tile_rows: int) -> DataFrame:
    """(node, print, size, least) -> (a, b): spanning forests, a tile, of the sets that may reach ``similarity``."""
    spark = nodes.sparkSession
    # A set of s hashes has at most the index s / (s + 1) with another one.
    rows = nodes.filter(F.col("size") / (F.col("size") + 1) >= similarity).select("node", "print", "size", F.explode("least").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(shared.withColumn("cuts", F.ceil(F.col("n") / tile_rows).cast("int")), "tiles")
    total = shared.agg(F.coalesce(F.sum(F.when(F.col("cuts") == 1, F.col("n"))), F.lit(0))).first()[0]
    packs = int(total // tile_rows) + 1
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    sides = (
        rows.join(shared, "key")
        .withColumn("own", own)
        .withColumn("there", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select(
            "key",
            "node",
            "print",
            "size",
            # Small tiles share a task; a hot one is cut, and each pair of its parts is a task.
            F.when(F.col("cuts") > 1, F.struct("key", F.least("own", "there").alias("one"), F.greatest("own", "there").alias("other")))
            .otherwise(F.struct(F.pmod("key", F.lit(packs)).alias("key"), F.lit(-1).alias("one"), F.lit(-1).alias("other")))
            .alias("tile"),
            (F.col("own") <= F.col("there")).alias("left"),
            (F.col("own") >= F.col("there")).alias("right"),
        )
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        tb.give_back()
        group = group.sort_values("key", kind="stable")
        nodes = group["node"].to_numpy()
        kept = _close_in_tiles(
            group["key"].to_numpy(), _matrix(group["print"].tolist()), group["size"].to_numpy(float), group["left"].to_numpy(bool), group["right"].to_numpy(bool), similarity
        )
        return pd.DataFrame({"a": [nodes[i] for i, _ in kept], "b": [nodes[j] for _, j in kept]})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), packs)
    return sides.repartition(parts, "tile").groupBy("tile").applyInPandas(compare, "a binary, b binary").distinct()


def _linked_sets(group: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Spanning forest (i, j) of the pairs that reach ``similarity``, left rows against right rows of the same component."""
    shingles = group["shingles"].to_numpy()
    sizes = np.fromiter(map(len, shingles), np.int64, len(shingles))
    ends = np.cumsum(sizes)
    ids = np.unique(np.concatenate(shingles), return_inverse=True)[1] if sizes.sum() else np.zeros(0, np.int64)
    flag = np.zeros(len(ids), bool)
    prints = _matrix(group["print"].tolist())
    left, right = group["left"].to_numpy(bool), group["right"].to_numpy(bool)
    labels = np.arange(len(sizes))
    kept: list[tuple[int, int]] = []
    component = pd.factorize(group["component"])[0]
    order = np.argsort(component, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
        for i in rows[left[rows]].tolist():
            others = rows[(labels[rows] != labels[i]) & right[rows]]
            fits = np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i]) - 0.5
            others = others[fits]
            others = others[np.bitwise_count(prints[others] ^ prints[i]).sum(axis=1, dtype=np.int64) <= SET_RADIUS]
            own = ids[ends[i] - sizes[i] : ends[i]]
            flag[own] = True
            step = max(1, (1 << 20) // max(1, int(sizes[i])))
            for lo in range(0, len(others), step):
                some = others[lo : lo + step]
                some = some[labels[some] != labels[i]]
                if not len(some):
                    continue
                n = sizes[some]
                begin = np.cumsum(n) - n
                places = np.repeat(ends[some] - n - begin, n) + np.arange(int(n.sum()))
                both = np.add.reduceat(flag[ids[places]], begin, dtype=np.int64)
                kept += [(i, j) for j in _merge(labels, i, some[both >= similarity * (sizes[i] + n - both)])]
            flag[own] = False
    return kept


def set_components(docs: DataFrame, nodes: DataFrame, width: int, similarity: float, tile_rows: int, tile_shingles: int) -> DataFrame:
    """Stored nodes of ``docs`` -> (node, component) of the sets that a chain of pairs with ``similarity`` or more joins.

    Tiles of all nodes give groups of candidates. Inside a group all candidates are checked on their sets, but for those
    that checked links join already. Small groups share a task; one of over ``tile_shingles`` is cut into tiles again.
    """
    groups = stored(components(candidates(nodes, similarity, tile_rows)), "groups")
    n = groups.count()
    held = _chosen_sets(docs, groups, n, width).join(groups, "node").join(nodes.select("node", "print"), "node")
    held = stored(held, "sets")
    sizes = held.groupBy("component").agg(F.sum("size").alias("held"))
    cuts = F.ceil(F.col("held") / tile_shingles)
    sizes = stored(sizes.withColumn("cuts", cuts.cast("int")), "cuts")
    small = sizes.filter("cuts = 1").agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    sides = (
        held.join(sizes, "component")
        .withColumn("own", own)
        .withColumn("there", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumn("shared", F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("component"), F.lit(small // tile_shingles + 1))))
        .select(
            "node",
            "print",
            "component",
            "shingles",
            F.struct(
                F.when(F.col("cuts") > 1, F.col("component")).alias("group"),
                "shared",
                F.least("own", "there").alias("one"),
                F.greatest("own", "there").alias("other"),
            ).alias("pair"),
            (F.col("own") <= F.col("there")).alias("left"),
            (F.col("own") >= F.col("there")).alias("right"),
        )
    )

    def check(group: pd.DataFrame) -> pd.DataFrame:
        tb.give_back()
        nodes = group["node"].to_numpy()
        kept = _linked_sets(group, similarity)
        return pd.DataFrame({"a": [nodes[i] for i, _ in kept], "b": [nodes[j] for _, j in kept]})

    return components(sides.groupBy("pair").applyInPandas(check, "a binary, b binary"))


def keep_first(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, tile_rows: int = TILE_ROWS, tile_shingles: int = TILE_SHINGLES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the near copies: of each group the row with the smallest id stays.

    Near copies have distinct five-word shingles with a Jaccard index of ``similarity`` or more, counted on the sets
    themselves; groups are chains of them. A row is told by its id and text, so rows that repeat an id with other texts are
    documents of their own (of near ones with one id, one stays: the same whenever it is computed again); of rows with equal id and
    text one stays. A null id counts as larger than any. Null and empty texts have an empty set and are copies of each other.
    """
    one, two, id_ = (fresh(docs, f"_{c}") for c in ("one", "two", "id"))
    keyed = docs.withColumns({one: F.xxhash64(text_col), two: F.xxhash64(F.lit(SEED), text_col), id_: F.col(id_col)})
    rows = keyed.select(F.col(id_).alias("id"), F.col(one).alias("one"), F.col(two).alias("two"), F.col(text_col).alias("text"))
    marked = stored(set_prints(rows, width), "prints")
    held = marked.groupBy("id", "one", "two", "node").agg(F.count("*").alias("n"))
    row = F.struct(F.col("id").isNull().alias("none"), "id", "one", "two", "n")
    firsts = held.groupBy("node").agg(F.min(row).alias("row"))
    firsts = stored(firsts, "firsts")
    attributes = [F.first(c).alias(c) for c in ("print", "size", "least")]
    nodes = stored(marked.groupBy("node").agg(*attributes), "nodes")
    grouped = firsts.join(set_components(rows, nodes, width, similarity, tile_rows, tile_shingles), "node", "left")
    kept = grouped.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("row").alias("row"))
    kept = stored(kept.select("row.id", "row.one", "row.two", "row.n"), "kept")

    def chosen(of: str) -> DataFrame:
        right = kept.filter(of)
        same = keyed[id_].eqNullSafe(right["id"]) & (keyed[one] == right["one"]) & (keyed[two] == right["two"])
        return keyed.join(right, same, "left_semi")

    out = chosen("n = 1").select(docs.columns)
    if not kept.filter("n > 1").isEmpty():
        # Rows with equal id and text: the one whose columns hash to the least, combined before the shuffle.
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        single = chosen("n > 1").groupBy(id_, one, two).agg(F.min_by(whole, F.xxhash64(whole)).alias(one + "row"))
        out = out.unionByName(single.select(f"{one}row.*"))
    return out

