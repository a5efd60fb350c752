"""FM-index over a wavelet matrix, searched for many patterns at once with numpy.

The index holds one integer sequence. Suffixes are sorted on their first ``depth`` symbols, which is exact for
patterns up to that length. The Burrows-Wheeler transform is kept as a wavelet matrix: one bit vector a symbol bit,
64 bits a word with a running count a word, so that n symbols of b bits take 1.5 * n * b bits.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffix numbers in the order of their first ``depth`` symbols, by prefix doubling."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    have = 1
    while have < depth:
        key = rank * (int(rank.max(initial=0)) + 2)
        key[: n - have] += rank[have:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.ones(n, np.int64)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        have *= 2
        if n and rank[order[-1]] == n - 1:
            break
    return order


class WaveletMatrix:
    def __init__(self, values: np.ndarray, n_bits: int):
        self.n = len(values)
        self.levels = []
        left = values.astype(np.uint32)
        for bit in range(n_bits - 1, -1, -1):
            ones = (left >> np.uint32(bit)) & np.uint32(1) != 0
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(ones) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((bit, words, before, self.n - int(ones.sum())))
            left = np.concatenate((left[~ones], left[ones]))

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a position before symbol ``at`` ends up after sorting by the symbol's bits, for each (symbol, at)."""
        at = at.astype(np.int64)
        for bit, words, before, zeros in self.levels:
            word = at >> 6
            below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
            ones = before[word] + np.bitwise_count(words[word] & below)
            at = np.where((symbols >> bit) & 1 != 0, zeros + ones, at - ones)
        return at


class FMIndex:
    def __init__(self, symbols: np.ndarray, depth: int):
        """``symbols``: integers from 0; 0 separates texts and is in no pattern."""
        n = len(symbols)
        top = int(symbols.max(initial=0))
        order = suffix_order(symbols, depth)
        self.last = WaveletMatrix(symbols[order - 1], max(1, top.bit_length()))
        counts = np.bincount(symbols, minlength=top + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
        self.base = self.last.walk(np.arange(top + 1, dtype=np.int64), np.zeros(top + 1, np.int64))
        self.n = n

    def match_lengths(self, text: np.ndarray, ends: np.ndarray, longest: int, least: np.ndarray) -> np.ndarray:
        """For each end: how many symbols back from it (``longest`` at most) the text still occurs ``least`` times."""
        done = np.zeros(len(ends), np.int64)
        alive = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        for step in range(longest):
            at = ends[alive] - step - 1
            symbol = np.where(at >= 0, text[np.maximum(at, 0)], 0)
            both = self.last.walk(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
            shift = self.first[symbol] - self.base[symbol]
            lo, hi = both[: len(alive)] + shift, both[len(alive) :] + shift
            keep = (symbol != 0) & (hi - lo >= least[alive])
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            done[alive] = step + 1
            if not len(alive):
                break
        return done


def repeated_cover(
    index: FMIndex, text: np.ndarray, start: np.ndarray, n_windows: np.ndarray, width: int, least: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(stretch number, window start) pairs whose windows occur ``least`` times and together cover every such window.

    Stretch k has ``n_windows[k]`` windows of ``width`` symbols from ``start[k]`` on. The matching statistics of a
    window's end decide it, and say how far to go on: windows that hold an unrepeated part are passed over together.
    After a repeated window the last repeated one that touches it is looked for, since those between add no words.
    """
    k = np.flatnonzero(n_windows > 0)
    at = np.zeros(len(k), np.int64)  # window that is tested
    after = np.full(len(k), -1, np.int64)  # last repeated window, when looking back towards it; else -1
    onward = np.zeros(len(k), np.int64)  # where to go on when nothing is found before it
    found_k, found_at = [], []
    while len(k):
        size = index.match_lengths(text, start[k] + at + width, width, least[k])
        hit = size == width
        found_k.append(k[hit])
        found_at.append(at[hit])
        looking = after >= 0
        first_try = looking & (onward < 0)
        past = at + width - size  # windows from here on leave the unrepeated part behind
        onward = np.where(~hit & first_try, np.maximum(past, after + width + 1), onward)
        back = ~hit & looking & (at - 1 > after)
        gone = ~hit & looking & ~back
        step = ~hit & ~looking
        last = n_windows[k] - 1
        next_at = np.where(hit, np.minimum(at + width, last), np.where(back, at - 1, np.where(gone, onward, past)))
        ended = hit & (at >= last)
        after = np.where(hit, at, np.where(gone | step, -1, after))
        onward = np.where(hit, -1, onward)
        alive = ~ended & (next_at <= last)
        k, at, after, onward = k[alive], next_at[alive], after[alive], onward[alive]
    if not found_k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_k), np.concatenate(found_at)
