"""Eigenvectors by inertia counts against numpy, and whitened rows against a plain whitening."""

import numpy as np
import pytest
from llm_data import SMALL

from sheafline.llm import queries, whitening


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_components_equal_numpy(size):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((size, size))
    for v in (a @ a.T, a + a.T):
        values, basis = whitening.leading_components(v, 12)
        want = np.linalg.eigvalsh(v)[::-1][:12]
        assert np.allclose(values, want, rtol=0, atol=1e-12 * np.abs(want).max())
        assert np.allclose(basis.T @ basis, np.eye(len(values)), atol=1e-10)
        assert np.allclose(v @ basis, basis * values, atol=1e-11 * np.abs(want).max())


def test_equal_and_near_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((30, 30)))
    for spectrum in ([3.0] * 4 + [2.0] * 6 + [1.0] * 20, [5, 5 + 1e-10, 5 + 2e-12, *np.linspace(3, 0, 27)], [1.0, 0.5] + [0.0] * 28):
        v = (q * np.array(spectrum)) @ q.T
        v = (v + v.T) / 2
        values, basis = whitening.leading_components(v, 12)
        assert np.allclose(values, sorted(spectrum, reverse=True)[:12], atol=1e-12)
        assert np.allclose(basis.T @ basis, np.eye(12), atol=1e-9)
        assert np.allclose(v @ basis, basis * values, atol=1e-11)


def test_inertia_counts():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a = rng.standard_normal((9, 9)) * (rng.random((9, 9)) < 0.5)
        a = a + a.T - np.diag(np.diag(a)) * rng.integers(0, 2)
        s = rng.standard_normal()
        assert whitening.inertia_below(a, s) == (np.linalg.eigvalsh(a) < s).sum()


def plain(rows):
    """(ids, n, deviations, whitened up to the sign, explained) with numpy alone."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in kept], float)).astype(object) + 1_000_000
    n, sums = len(kept), x.sum(axis=0)
    deviation = [(int(sum((n * a - s) ** 2 for a, s in zip(map(int, row), map(int, sums))))) for row in x]
    y = np.array([[float(int(a) * n - int(s)) / n for a, s in zip(row, sums)] for row in x])
    values, basis = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:32]
    order = order[values[order] > 1e-12 * values.max()]
    return [i for i, _ in kept], n, deviation, y @ basis[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def same(df, rows):
    ids, n, deviation, want, explained = plain(rows)
    got = df.collect()
    k = len(explained)
    assert len(got) == len(ids) * k
    by = {c: {} for c in range(1, k + 1)}
    for r in got:
        by[r["component"]].setdefault((r["vec_id"], r["n"], r["deviation"]), []).append(r["whitened"])
        assert abs(r["explained"] - explained[r["component"] - 1]) <= 1e-9 and r["identity_error"] < 1e-9
    for c in range(1, k + 1):
        column = {}
        for i, d, w in zip(ids, deviation, want[:, c - 1]):
            column.setdefault((i, n, d), []).append(w)
        assert column.keys() == by[c].keys()
        keys = list(column)
        a, b = (np.concatenate([sorted(np.abs(x[key])) for key in keys]) for x in (column, by[c]))
        assert np.allclose(a, b, atol=1e-7)
        signed = np.array([sum(column[key]) for key in keys]), np.array([sum(by[c][key]) for key in keys])
        assert np.allclose(*signed, atol=1e-6) or np.allclose(signed[0], -signed[1], atol=1e-6)


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    same(queries.op12_whitening(spark, SMALL), rows)


def test_odd_rows(spark):
    """Null, empty and unusable vectors, repeated rows, a null id, clashing names, a constant dimension."""
    rng = np.random.default_rng(8)
    rows = [(i, [*map(float, rng.standard_normal(4)), 2.0]) for i in range(50)]
    rows += [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0, 1.0]), (53, [float("nan")] * 5), (54, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    rows += [(None, rows[0][1]), rows[1], rows[1]]
    full = [(i, v, "x", 1) for i, v in rows]
    df = spark.createDataFrame(full, "vec_id bigint, embedding array<float>, whitened string, component int")
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    same(whitening.whitened(df.repartition(3)), exact)


def test_empty_and_equal(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):  # no rows, none usable, no spread at all
        df = whitening.whitened(spark.createDataFrame(rows, kind))
        assert df.count() == 0 and df.columns[0] == "vec_id"
    with pytest.raises(Exception, match="different lengths"):
        whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], kind)).count()


def test_large_deviations(spark):
    """Beyond 64 bits there is no deviation; below, it is exact."""
    rows = [(i, [float(i * 2**16), 1.0 * i]) for i in range(200)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    ids, _, deviation, _, _ = plain(rows)
    assert got == {i: d if d < 1 << 63 else None for i, d in zip(ids, deviation)}
    assert None in got.values() and any(d is not None for d in got.values())
