"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is a blank and its UTF-8 bytes; pieces are byte strings in which the model's blank mark is a blank. At each place
the best segmentation so far ends with one of the pieces that fit, so only the last ``longest piece`` places can be
reached from what is to come: the search keeps a window of scores and back pointers of that size, and whenever all paths out
of the window go through one boundary, the ids up to it are committed and forgotten. Memory does not grow with the text.

The vocabulary file given is a merge model: its scores are minus the merge rank. The search needs weights that add up, so a
piece of rank r weighs -log(r + 2) (Zipf's law), rounded to a fixed unit, and a byte piece ``-BYTE_COST``. The ids are
those of the best segmentation by these weights: of the same vocabulary as the library's, but not the merge order's.
Ties go to the longer last piece. What no piece spells becomes byte pieces, so decoding gives back every text exactly.

Defined results: a null text has null ids, an empty one no ids; a text is one stream however long it is; the other columns
stay, but for those named like a result.

Scale: documents are only mapped. No piece goes on from another symbol into a blank (this is checked), so all paths meet in
front of a blank and the ids before it are final. The distinct stretches between such places, told apart by a 64-bit hash, are
streamed side by side with numpy: all lanes move one byte a step, hold a window each and commit where their own paths meet. The last
few lanes of a block, and those whose paths do not meet in the window, go on one by one from their last commit. Texts come in slices
of ``SLICE`` bytes; a longer text is cut in front of blanks, so memory is bounded by the slice, the ids of a text and the text itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb

MARK = "▁"
BLANK = 0x20
UNIT = 1 << 20  # weights are whole numbers of 1 / UNIT: sums are exact, so ties are ties wherever they stand
BYTE_COST = 12 * UNIT
LANES = 8192
FEW = 24
SLICE = 1 << 20
_FLOOR = -(1 << 60)


class Pieces:
    """Pieces (bytes) with ids and weights, the two searches over them, and the way back."""

    def __init__(self, pieces: list[bytes], ids: list[int], weights: list[int], bytes_at: int, byte_cost: int = BYTE_COST):
        if any(BLANK in piece.lstrip(b" ") for piece in pieces):
            raise ValueError("a piece goes on into a blank")
        self.bytes_at, self.byte_cost = bytes_at, byte_cost
        self.longest = max(map(len, pieces), default=1)
        self.known = {p: (i, w) for p, i, w in zip(pieces, ids, weights)}
        self._trie()
        n = max([bytes_at + 255, *ids]) + 1
        spelled = [b""] * n
        for b in range(256):
            spelled[bytes_at + b] = bytes([b])
        for piece, i in zip(pieces, ids):
            spelled[i] = piece
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)

    def _trie(self) -> None:
        """Dense moves of the nodes that have children; these come first, then the leaves. Node 0 is the root, -1 is none."""
        begun = {p[:k] for p in self.known for k in range(len(p))} | {b""}
        inner = {p: k for k, p in enumerate(sorted(begun, key=lambda p: (len(p), p)))}
        leaves = {p: len(inner) + k for k, p in enumerate(sorted(self.known.keys() - begun))}
        moves = np.full((len(inner), 256), -1, np.int32)
        for p, node in (*inner.items(), *leaves.items()):
            if p:
                moves[inner[p[:-1]], p[-1]] = node
        self.moves, self.n_inner = moves.reshape(-1), len(inner)
        self.node_id = np.full(len(inner) + len(leaves), -1, np.int32)
        self.node_weight = np.full(len(inner) + len(leaves), _FLOOR, np.int64)
        for p, (i, w) in self.known.items():
            node = inner.get(p, leaves.get(p))
            self.node_id[node], self.node_weight[node] = i, w

    def search(self, stream: Iterable[int]) -> Iterator[int]:
        """Ids of the best segmentation of an iterable of bytes, given out as soon as they are certain."""
        longest, known, cost = self.longest, self.known, self.byte_cost
        best, back, ids = [0], [0], [0]
        recent = bytearray()
        for byte in stream:
            recent.append(byte)
            end = len(recent)
            top, size_, id_ = best[-1] - cost, 1, self.bytes_at + byte
            for size in range(1, min(longest, end) + 1):
                found = known.get(bytes(recent[end - size :]))
                if found is not None and best[end - size] + found[1] >= top:
                    top, size_, id_ = best[end - size] + found[1], size, found[0]
            best.append(top)
            back.append(size_)
            ids.append(id_)
            if end >= 2 * longest:
                # Later pieces start at one of the last places; where do their paths meet?
                lows = set(range(end - longest + 1, end + 1))
                while len(lows) > 1:
                    high = max(lows)
                    lows.remove(high)
                    lows.add(high - back[high])
                meet = lows.pop()
                if meet:
                    yield from self._path(meet, back, ids)
                    del recent[:meet], back[:meet], ids[:meet]
                    best = [b - best[meet] for b in best[meet:]]
        yield from self._path(len(recent), back, ids)

    @staticmethod
    def _path(end: int, back: list[int], ids: list[int]) -> list[int]:
        out = []
        while end:
            out.append(ids[end])
            end -= back[end]
        return out[::-1]

    def search_all(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, counts) of many short stretches, side by side."""
        order = np.argsort(-size, kind="stable")
        counts = np.zeros(len(size), np.int64)
        found = []
        for lo in range(0, len(order), LANES):
            lanes = order[lo : lo + LANES]
            values, n = self._block(data, start[lanes], size[lanes])
            counts[lanes] = n
            found.append((lanes, values, n))
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for lanes, values, n in found:
            place = np.repeat(at[lanes] - (np.cumsum(n) - n), n) + np.arange(len(values))
            out[place] = values
        return out, counts

    def _block(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One block of stretches, longest first, streamed side by side."""
        n, longest, most = len(size), self.longest, int(size[0])
        window = min(most + 1, 5 * longest) + longest
        best = np.full((window, n), _FLOOR, np.int64)
        best[0] = 0
        back = np.zeros((window, n), np.int16)
        ids = np.zeros((window, n), np.int32)
        base = np.zeros(n, np.int64)  # ids up to here are committed
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (lanes, their next ids one after another, counts)
        alone: list[int] = []

        def commit(lanes: np.ndarray, at: np.ndarray) -> None:
            """Give out the ids of the paths from ``base`` to ``at``."""
            steps, values = [], []
            lane, place = np.arange(len(lanes)), at.copy()
            while len(lane):
                slot = place[lane] % window
                steps.append(lane)
                values.append(ids[slot, lanes[lane]])
                place[lane] -= back[slot, lanes[lane]]
                lane = lane[place[lane] > base[lanes[lane]]]
            if not steps:
                return
            counts = np.bincount(np.concatenate(steps), minlength=len(lanes))
            last = np.cumsum(counts) - 1
            flat = np.empty(int(counts.sum()), np.int32)
            for k, (lane, value) in enumerate(zip(steps, values)):
                flat[last[lane] - k] = value
            out.append((lanes, flat, counts))
            base[lanes] = at

        live, i = n, 0
        while True:
            still = live
            while still and size[still - 1] <= i:
                still -= 1
            if still < live:
                done = np.arange(still, live)
                commit(done[base[done] < size[done]], size[done[base[done] < size[done]]].astype(np.int64))
                live = still
            if not live:
                break
            if live <= FEW and i >= 2 * longest:
                alone = list(range(live))
                break
            if i >= 2 * longest and i % longest == 0:
                self._commit_where_paths_meet(back, base, live, i, commit)
                late = np.flatnonzero(base[:live] < i + 2 * longest - window)
                if len(late):  # their paths stay apart: all lanes of the block go on alone
                    alone = list(range(live))
                    break
            if i + longest >= window:
                best[(i + longest) % window, :live] = _FLOOR
            here = i % window
            rows = np.arange(live)
            so_far = best[here, :live]
            node = np.zeros(live, np.int64)
            j = i
            while len(rows):
                node = self.moves[(node << 8) + data[start[rows] + j]].astype(np.int64)
                j += 1
                some = np.flatnonzero(node >= 0)
                rows, so_far, node = rows[some], so_far[some], node[some]
                score = so_far + self.node_weight[node]
                slot = j % window
                better = np.flatnonzero(score > best[slot, rows])
                to = rows[better]
                best[slot, to] = score[better]
                back[slot, to] = j - i
                ids[slot, to] = self.node_id[node[better]]
                on = np.flatnonzero((node < self.n_inner) & (size[rows] > j))
                rows, so_far, node = rows[on], so_far[on], node[on]
            score = best[here, :live] - self.byte_cost
            slot = (i + 1) % window
            better = np.flatnonzero(score > best[slot, :live])
            best[slot, better] = score[better]
            back[slot, better] = 1
            ids[slot, better] = self.bytes_at + data[start[better] + i].astype(np.int32)
            i += 1
        for lane in alone:
            lo = int(start[lane] + base[lane])
            own = np.fromiter(self.search(data[lo : int(start[lane] + size[lane])].tobytes()), np.int32)
            out.append((np.array([lane]), own, np.array([len(own)])))
        total = np.zeros(n, np.int64)
        for lanes, _, counts in out:
            total[lanes] += counts
        place = np.cumsum(total) - total
        flat = np.empty(int(total.sum()), np.int32)
        for lanes, values, counts in out:
            flat[np.repeat(place[lanes] - (np.cumsum(counts) - counts), counts) + np.arange(len(values))] = values
            place[lanes] += counts
        return flat, total

    def _commit_where_paths_meet(self, back: np.ndarray, base: np.ndarray, live: int, at: int, commit) -> None:
        """Pieces still to come begin at one of the last places: walk their paths back until one place is left."""
        window, longest = len(back), self.longest
        lanes = np.arange(live)
        marks = np.zeros((window + longest, live), bool)  # by the distance from ``at``
        marks[:longest] = np.arange(longest)[:, None] <= at - base[:live]
        left = marks[:longest].sum(axis=0)
        for away in range(window):
            some = lanes[marks[away] & (left > 1)]
            if not len(some):
                if (left <= 1).all():
                    break
                continue
            marks[away, some] = False
            to = away + back[(at - away) % window, some]
            left[some] -= marks[to, some]
            marks[to, some] = True
        meet = at - marks.argmax(axis=0)
        some = lanes[(left == 1) & (meet > base[:live])]
        if len(some):
            commit(some, meet[some].astype(np.int64))

    def encode_data(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all streams, counts a stream) of streams that stand one after another in ``data``."""
        some = lengths > 0
        first = np.zeros(len(data), bool)
        begins = (np.cumsum(lengths) - lengths)[some]
        blank = data == BLANK
        first[1:] = blank[1:] & ~blank[:-1]
        first[begins] = True
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(data)))
        hashes = tb.word_hashes(data, start, start + size)
        _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        values, counts = self.search_all(data, start[at], size[at])
        places = np.cumsum(counts) - counts
        per = counts[back]
        ids = values[np.repeat(places[back] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))]
        of_stream = np.repeat(np.flatnonzero(some), np.diff(np.append(np.searchsorted(start, begins), len(start))))
        return ids, np.bincount(of_stream, per, len(lengths)).astype(np.int64)

    def encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, counts a text, the streams' bytes, their lengths); an empty text has no ids."""
        raw, offsets = tb.raw_bytes(texts)
        some = np.diff(offsets) > 0
        data = np.insert(raw, offsets[:-1][some], BLANK)
        lengths = np.diff(offsets) + some
        return *self.encode_data(data, lengths), data, lengths

    def encode_long(self, raw: np.ndarray, limit: int = SLICE) -> tuple[np.ndarray, bool]:
        """(ids, whether they spell the text) of one text, cut in front of blanks into parts of about ``limit`` bytes."""
        found, same, at, n = [], True, 0, len(raw)
        while at < n:
            end = min(at + limit, n)
            if end < n:
                blank = raw[at : end + 1] == BLANK
                runs = np.flatnonzero(blank[1:] & ~blank[:-1])
                end = at + 1 + int(runs[-1]) if len(runs) else end
                while not len(runs) and end < n:
                    blank = raw[end - 1 : end + limit] == BLANK
                    runs = np.flatnonzero(blank[1:] & ~blank[:-1])
                    end = end + int(runs[0]) if len(runs) else min(end + limit, n)
            part = raw[at:end]
            if end - at > limit + 1:  # one stretch: nothing is gained from its neighbours
                ids = np.fromiter(self.search(chain([BLANK] * (at == 0), part.tobytes())), np.int32)
            else:
                part = np.insert(part, [0] * (at == 0), BLANK)
                ids = self.encode_data(part, np.array([len(part)]))[0]
            spelled = self.spell(ids)[0]
            lead = len(spelled) - (end - at)
            same &= lead == (at == 0) and bool(np.array_equal(spelled[lead:], raw[at:end])) and bool((spelled[:lead] == BLANK).all())
            found.append(ids)
            at = end
        return np.concatenate(found), same

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bytes of each id)."""
        n = self.sizes[ids]
        return self.letters[np.repeat(self.places[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def spelled_right(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each stream of ``data``, whether its ids spell it."""
        spelled, n = self.spell(ids)
        per = np.concatenate(([0], np.cumsum(n)))
        ends = np.cumsum(counts)
        sizes = per[ends] - per[ends - counts]
        if np.array_equal(sizes, lengths):
            wrong = np.concatenate(([0], np.cumsum(spelled != data)))
            stops = np.cumsum(lengths)
            return wrong[stops] == wrong[stops - lengths]
        at, to = per[ends - counts], np.cumsum(lengths) - lengths
        return np.array([a == b and np.array_equal(spelled[i : i + a], data[j : j + a]) for a, b, i, j in zip(sizes, lengths, at, to)], bool)

    def decode(self, ids) -> str:
        return self.spell(np.asarray(ids, np.int64))[0].tobytes()[1:].decode(errors="replace")


def load(path: str) -> tuple[list[bytes], list[int], list[int], int]:
    """(pieces, ids, weights, id of byte 0) of a vocabulary file with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ids, weights, bytes_at = [], [], [], None
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_at = i if int(piece[3:5], 16) == 0 else bytes_at
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            # Symbols that no merge makes stand behind the merges.
            rank = -model.get_score(i) if model.get_score(i) > -1e8 else float(model.get_piece_size())
            pieces.append(piece.replace(MARK, " ").encode())
            ids.append(i)
            weights.append(-round(math.log(rank + 2) * UNIT))
    if bytes_at is None:
        raise ValueError("the vocabulary has no byte pieces")
    return pieces, ids, weights, bytes_at


def default_vocabulary() -> str:
    """The vocabulary file's path, where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with, for the text, ``ids``, ``n_ids`` and ``same``: whether decoding the ids gives the text back."""
    plain = docs.sparkSession.sparkContext.broadcast(load(vocabulary))  # as large as the vocabulary
    rest = [c for c in docs.columns if c.lower() not in ("ids", "n_ids", "same", text_col.lower())]
    docs = docs.select(*rest, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*plain.value)
        for batch in batches:
            tb.give_back()
            texts = tb.text_column(batch, text_col)
            missing = np.asarray(batch.column(len(rest)).is_null())
            for lo, hi in tb.row_slices(texts, SLICE):
                slice_ = texts.slice(lo, hi - lo)
                raw = tb.raw_bytes(slice_)[0]
                if hi - lo == 1 and len(raw) > SLICE:
                    ids, right = pieces.encode_long(raw)
                    counts, same = np.array([len(ids)]), np.array([right])
                else:
                    ids, counts, data, lengths = pieces.encode_slice(slice_)
                    same = pieces.spelled_right(ids, counts, data, lengths)
                none = missing[lo:hi]
                ends = np.cumsum(counts)
                marks = pa.array(np.append(ends - counts, len(ids)).astype(np.int32), mask=np.append(none, False))
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        *own.columns[: len(rest)],
                        pa.ListArray.from_arrays(marks, pa.array(ids, pa.int32())),
                        pa.array(counts, mask=none),
                        pa.array(same, mask=none),
                    ],
                    names=[*rest, "ids", "n_ids", "same"],
                )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema.fields]
    return docs.mapInArrow(run, ", ".join([*kinds, "ids array<int>", "n_ids bigint", "same boolean"]))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with ``text_col``: the text of ``ids_col``, null where that is null."""
    plain = encoded.sparkSession.sparkContext.broadcast(load(vocabulary))

    @F.pandas_udf("string")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(*plain.value)
        for ids in batches:
            yield ids.map(lambda own: None if own is None else pieces.decode(own))

    return encoded.withColumn(text_col, spell(ids_col))
