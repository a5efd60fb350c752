"""Embedding whitening: leading eigenvectors of the covariance by spectrum slicing and Rayleigh quotient iteration.

An entry c becomes the whole number ``floor(64 * c) + 1000000``. Rows whose vector is null, or holds an entry that is null or not
finite, are left out of the fit and of the result.

Spectrum slicing. The LDL^T factors of V - s I (Bunch-Kaufman pivots) have as many negative pivots as V has eigenvalues below s
(Sylvester's law of inertia). Counts of this kind halve intervals until each leading eigenvalue stands alone in one; from the
middle of its interval Rayleigh quotient iteration converges cubically, and two more counts, just below and just above what
it found, certify the number of the component. Eigenvalues that cannot be told apart in double precision share an interval: their
vectors are made orthogonal to each other, any basis of their space being as good.

Scale: three passes over the vectors, each a map. What a task sends are sums of whole numbers, then one triangle of cross products of
centred vectors, added entry by entry before the driver sees them: its size is the square of the dimension, whatever the number of
rows. Sums are of whole numbers and exact; vectors are centred before they are multiplied.

Defined results: repeated rows count each and give their rows each; a null id is kept; an empty table, or one without a usable vector,
gives no rows; vectors of no entries are left out; usable vectors of different lengths are an error, as is an entry of 2**40 or more (its
square would not be exact). Components with an eigenvalue of less than 1e-12 of the largest have no whitened value and are left out.
``deviation`` is null if it does not fit 64 bits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64.0, 1_000_000
LARGEST = float(1 << 40)
LEAST_SHARE = 1e-12
_EPS = np.finfo(float).eps
_ALPHA = (1 + 17**0.5) / 8


def inertia_below(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric ``v`` below ``shift``: negative pivots of the LDL^T factors of v - shift I."""
    a = v - shift * np.eye(len(v))
    n, k, below = len(a), 0, 0
    tiny = _EPS * max(np.abs(v).max(initial=0.0), abs(shift), 1e-300)
    while k < n:
        s = a[k:, k:]
        column = np.abs(s[1:, 0])
        most = column.max(initial=0.0)
        one, swap = True, 0
        if max(abs(s[0, 0]), most) > 0 and abs(s[0, 0]) < _ALPHA * most:
            r = int(column.argmax()) + 1
            row = np.abs(s[r]).copy()
            row[r] = 0
            sigma = row.max()
            if abs(s[0, 0]) * sigma >= _ALPHA * most * most:
                pass
            elif abs(s[r, r]) >= _ALPHA * sigma:
                swap = r
            else:
                one, swap = False, r
        to = 0 if one else 1
        if swap != to:
            s[[to, swap]] = s[[swap, to]]
            s[:, [to, swap]] = s[:, [swap, to]]
        if one:
            pivot = s[0, 0]
            below += pivot < 0
            if abs(pivot) < tiny:  # an eigenvalue of the leading part: a hair above the shift
                pivot = tiny
            if len(s) > 1:
                s[1:, 1:] -= np.outer(s[1:, 0] / pivot, s[0, 1:])
            k += 1
        else:
            d = s[:2, :2].copy()
            det = d[0, 0] * d[1, 1] - d[0, 1] * d[1, 0]
            below += 1 if det < 0 else 2 * (d[0, 0] + d[1, 1] < 0)
            if len(s) > 2:
                s[2:, 2:] -= s[2:, :2] @ np.linalg.solve(d, s[:2, 2:])
            k += 2
    return int(below)


def _refined(v: np.ndarray, shift: float, apart: list[np.ndarray], seed: int, low: float, high: float) -> tuple[float, np.ndarray]:
    """Eigenvalue and vector by Rayleigh quotient iteration from ``shift``, orthogonal to the vectors ``apart``."""
    norm = np.abs(v).sum(axis=1).max()
    x = np.random.default_rng(seed).standard_normal(len(v))

    def clean(y: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for z in apart:
                y = y - (z @ y) * z
        return y / np.linalg.norm(y)

    x, at, best = clean(x), shift, None
    for step in range(60):
        try:
            y = np.linalg.solve(v - at * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(v - (at + 4 * _EPS * norm) * np.eye(len(v)), x)
        if not np.isfinite(y).all():
            break
        x = clean(y / np.abs(y).max())
        value = float(x @ v @ x)
        left = float(np.linalg.norm(v @ x - value * x))
        if best is None or left < best[0]:
            best = (left, value, x)
        elif step > 3 and left <= 64 * _EPS * norm:
            break
        # Steps from the middle of the interval first; the quotient takes over once it lies inside with a small residual.
        if low < value < high and left < 0.25 * (high - low) or high - low <= 64 * _EPS * norm:
            at = value
    return best[1], best[2]


def leading_components(v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``n`` largest eigenvalues of the symmetric ``v``, falling."""
    size = len(v)
    n = min(n, size)
    if not v.any():
        return np.zeros(n), np.eye(size)[:, :n]
    radius = np.abs(v).sum(axis=1) - np.abs(np.diag(v))
    norm = float(np.abs(v).sum(axis=1).max())
    low = float((np.diag(v) - radius).min()) - 4 * _EPS * norm
    high = float((np.diag(v) + radius).max()) + 4 * _EPS * norm
    counts: dict[float, int] = {low: 0, high: size}

    def below(s: float) -> int:
        if s not in counts:
            counts[s] = inertia_below(v, s)
        return counts[s]

    values: list[float] = []
    vectors: list[np.ndarray] = []
    same = 64 * _EPS * norm  # narrower intervals say nothing in double precision
    for k in range(n):
        rank = size - k  # the eigenvalue with rank - 1 others below it
        a = max(s for s, c in counts.items() if c < rank)
        b = min(s for s, c in counts.items() if c >= rank)
        while True:
            while b - a > same and (below(b) - below(a) > 1 or b - a > 1e-3 * norm):
                middle = (a + b) / 2
                a, b = (middle, b) if below(middle) < rank else (a, middle)
            near = [x for y, x in zip(values, vectors) if y - b < 1e-7 * norm]
            value, vector = _refined(v, (a + b) / 2, near, k, a, b)
            margin = 16 * same
            certified = below(value - margin) < rank <= below(value + margin)
            if certified or b - a <= same:
                break
            middle = (a + b) / 2
            a, b = (middle, b) if below(middle) < rank else (a, middle)
        values.append(value)
        vectors.append(vector)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors)[order].T


def _whole(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of usable rows, their whole numbers as a matrix)."""
    column = batch.column(at).cast(pa.list_(pa.float64()))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    entries = column.flatten()
    good = np.isfinite(np.asarray(pc.fill_null(entries, np.nan), float)) if len(entries) else np.zeros(0, bool)
    bad = np.concatenate(([0], np.cumsum(~good)))
    ends = np.cumsum(sizes)
    usable = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
    if not len(usable):
        return usable, np.zeros((0, 0), np.int64)
    dim = sizes[usable[0]]
    if (sizes[usable] != dim).any():
        raise ValueError("vectors of different lengths")
    values = np.asarray(pc.fill_null(entries, 0.0), float)[(ends - sizes)[usable][:, None] + np.arange(dim)]
    if (np.abs(values) >= LARGEST / SCALE).any():
        raise ValueError(f"an entry beyond {LARGEST / SCALE:g}")
    return usable, np.floor(SCALE * values).astype(np.int64) + SHIFT


def _sums(rows: DataFrame) -> tuple[int, list[int], int]:
    """(rows, sum a dimension, largest distance of an entry from the shift) of the usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, None, 0
        for batch in batches:
            usable, x = _whole(batch, 0)
            if len(usable):
                if total is not None and len(total) != x.shape[1]:
                    raise ValueError("vectors of different lengths")
                total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
                n += len(usable)
                most = max(most, int(np.abs(x - SHIFT).max()))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n)), pa.array(np.full(len(total), most))],
                names=["i", "s", "n", "most"],
            )

    parts = rows.mapInArrow(run, "i bigint, s bigint, n bigint, most bigint")
    wide = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    found = sorted(parts.groupBy("i").agg(wide, F.sum("n").alias("n"), F.max("most").alias("most")).collect())  # a row a dimension
    if len({r["n"] for r in found}) > 1:
        raise ValueError("vectors of different lengths")
    return (found[0]["n"], [int(r["s"]) for r in found], max(r["most"] for r in found)) if found else (0, [], 0)


def _cross_products(rows: DataFrame, centred, size: int, onto: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sum of y y^T, sum of y) over the usable vectors, y being the ``centred`` vector, or that projected ``onto`` columns."""
    size = size if onto is None else onto.shape[1]
    i, j = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, line, some = np.zeros((size, size)), np.zeros(size), False
        for batch in batches:
            usable, x = _whole(batch, 0)
            if len(usable):
                y = centred(x) if onto is None else centred(x) @ onto
                total += y.T @ y
                line += y.sum(axis=0)
                some = True
        if some:
            at = np.concatenate((i * size + j, size * size + np.arange(size)))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate((total[i, j], line)))], names=["at", "v"])

    out, line = np.zeros((size, size)), np.zeros(size)
    for at, v in rows.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # the square of the dimension
        if at >= size * size:
            line[at - size * size] = v
        else:
            out[at // size, at % size] = out[at % size, at // size] = v
    return out, line


def whitened(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: the id, component, n, deviation, whitened, explained, identity_error."""
    only = vectors.select(F.col(vector_col).cast("array<double>"))
    n, sums, most = _sums(only)
    id_type = vectors.schema[id_col].dataType.simpleString()
    kinds = f"`{id_col}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not n:
        return vectors.sparkSession.createDataFrame([], kinds)
    base = np.array([s // n for s in sums], np.int64)
    over = np.array([(s % n) / n for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - base) - over  # x - S / n; what is large cancels in whole numbers

    covariance = _cross_products(only, centred, len(sums))[0] / n
    values, basis = leading_components(covariance, components)
    some = values > LEAST_SHARE * max(values[0], 0.0)
    values, basis = values[some], basis[:, some]
    onto = basis / np.sqrt(values)
    squares, line = _cross_products(only, centred, len(sums), onto)
    error = float(np.abs(squares / n - np.outer(line / n, line / n) - np.eye(len(values))).max(initial=0.0))
    explained = values / np.trace(covariance)
    k = len(values)
    # |n x - S| <= 2 n most; one long is enough if the sum of squares of that is below 2**63.
    narrow = (2 * n * most + n) ** 2 * len(sums) < 1 << 63
    rest = np.array([s - n * int(b) for s, b in zip(sums, base)], np.int64)

    def deviations(x: np.ndarray) -> list[int | None]:
        if narrow:
            return ((n * (x - base) - rest) ** 2).sum(axis=1).tolist()
        each = [sum((n * a - r) ** 2 for a, r in zip(row, rest.tolist())) for row in (x - base).tolist()]
        return [d if d < 1 << 63 else None for d in each]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                usable, x = _whole(part, 1)
                m = len(usable)
                if not m or not k:
                    continue
                y = centred(x) @ onto
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(usable[each])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        pa.array(deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(y.reshape(-1)),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select(F.col(id_col), F.col(vector_col).cast("array<double>")).mapInArrow(run, kinds)
