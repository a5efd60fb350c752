"""Whole texts as byte arrays inside Arrow batches: row slices of bounded size, words, rolling hashes.

White space is ``[\\x20\\x09-\\x0D]``; a word is a maximal run of other bytes. A null text counts as empty. Word and
n-gram identities are 64-bit polynomial hashes with a random value per byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_BYTE_VALUES = np.random.default_rng(42).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers 0..n-1, kept for the next slice; at least doubled, so that small slices keep few."""
    if len(_powers[0]) < n:
        size = max(n, min(2 * len(_powers[0]), SLICE_BYTES + 64))
        for k, base in enumerate((_BASE, _U(pow(int(_BASE), -1, 2**64)))):
            run = np.full(size, base, _U)
            run[0] = 1
            _powers[k] = np.cumprod(run)
    return _powers[0][:n], _powers[1][:n]


def give_back() -> None:
    """Return freed memory to the system: a worker serves many tasks, and what it once used counts as long as it lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_string()), "")


def row_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    sizes = np.asarray(pc.binary_length(texts), np.int64)
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a (sliced) large_string array, and the offsets of its rows in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word and, for each row, the index of its first word (one more at the end)."""
    n = len(data)
    word = (data != 0x20) & (data - np.uint8(0x09) > 4)  # not SPACE, without a look-up of each byte
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word; many bytes are worked on in parts between words, so that memory follows the part."""
    if len(data) <= SLICE_BYTES:
        return _word_hashes(data, starts, ends)
    out = np.empty(len(starts), _U)
    lo = 0
    while lo < len(starts):
        a = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, a + SLICE_BYTES, side="right")))
        out[lo:hi] = _word_hashes(data[a : int(ends[hi - 1])], starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return out


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_VALUES[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def running_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any span of ``values``."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(len(values) + 1)[0][:-1], out=total[1:])
    return total


def span_hash(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix((total[hi] - total[lo]) * powers(len(total))[1][lo])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` consecutive values, at each possible start."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out
