"""Whitening against numpy on small tables."""

import numpy as np
import pytest

from simlens.llm import whiten


def test_solver_finds_the_largest_eigenpairs():
    rng = np.random.default_rng(3)
    for width, k in ((1, 1), (5, 32), (64, 32), (120, 7)):
        a = rng.standard_normal((width, width))
        c = a @ a.T
        values, vectors, told = whiten.jacobi_davidson(lambda b, c=c: c @ b, width, k)
        want = np.linalg.eigvalsh(c)[::-1][:k]
        assert np.allclose(values, want, rtol=0, atol=1e-12 * want[0])
        assert np.abs(c @ vectors - vectors * values).max() <= 1e-12 * want[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12 and told["residual"] < 1e-12


def test_equal_and_zero_eigenvalues():
    c = np.diag([5.0, 5.0, 5.0, 2.0, 0.0, 0.0])
    values, vectors, _ = whiten.jacobi_davidson(lambda b: c @ b, 6, 5)
    assert np.allclose(values, [5, 5, 5, 2, 0], atol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(5)).max() < 1e-12


def test_minres_solves_columns_apart():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((8, 8))
    a = a + a.T
    right = rng.standard_normal((8, 3))
    right[:, 1] = 0
    assert np.allclose(a @ whiten.minres(lambda b: a @ b, right, 8), right, atol=1e-6)


def expected(vectors, k):
    x = np.floor(np.array(vectors, dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    near = x - sums / n
    values, basis = np.linalg.eigh(near.T @ near / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return deviation, near @ basis / np.sqrt(values), values / (near ** 2).sum() * n


def test_whitened_rows_equal_numpy(spark):
    rng = np.random.default_rng(5)
    data = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    data[7] = data[8]
    rows = [(None if i == 4 else i, [float(v) for v in row], "x", 1) for i, row in enumerate(data)]
    rows += [(900, None, "x", 1), (901, [None] + [0.0] * 11, "x", 1), (902, [float("nan")] * 12, "x", 1), (903, [float("inf")] + [0.0] * 11, "x", 1), (1, rows[1][1], "y", 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, component int").repartition(4)
    got = whiten.whiten(frame, components=8).toPandas()
    kept = [r for r in rows if r[0] is None or r[0] < 900]
    deviation, whitened, explained = expected([r[1] for r in kept], 8)
    assert len(got) == len(kept) * 8 and set(got.n) == {len(kept)} and got.identity_error.iloc[0] < 1e-10
    table = {}
    for r in got.itertuples():
        table.setdefault((r.vec_id if r.vec_id == r.vec_id else None, r.deviation), {}).setdefault(r.component, []).append((r.whitened, r.explained))
    signs = {}
    for (ident, *_), dev, white in zip(kept, deviation, whitened):
        own = table[(ident, dev)]
        for c in range(1, 9):
            value, share = own[c][0]
            assert abs(share - explained[c - 1]) < 1e-9
            assert abs(abs(value) - abs(white[c - 1])) < 1e-7
            if abs(value) > 1e-3:
                signs.setdefault(c, set()).add(np.sign(value * white[c - 1]))
    assert all(len(s) == 1 for s in signs.values())


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, []), (2, [])], schema)).count() == 0
    # one direction varies; another length is a list of its own
    rows = [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0]), (4, [2.0])]
    got = sorted((r["vec_id"], r["component"], r["n"], round(abs(r["whitened"]), 9)) for r in whiten.whiten(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 1, 2, 1.0), (2, 1, 2, 1.0), (3, 1, 2, 1.0), (4, 1, 2, 1.0)]


def test_exact_sums_of_large_numbers():
    centre = whiten.Centre(3, [3 * (1 << 40) + 1])
    x = np.array([[1 << 40], [(1 << 40) + 1], [1 << 40]])
    assert centre.deviations(x) == [1, 4, 1]
    wide = whiten.Centre(2, [0])
    assert wide.deviations(np.array([[1 << 50], [-(1 << 50)]])) == [None, None]
    assert wide.deviations(np.array([[1 << 30]])) == [1 << 62]


@pytest.mark.parametrize("cells", [7, 64])
def test_batches_of_any_size(spark, monkeypatch, cells):
    monkeypatch.setattr(whiten, "CELLS", cells)
    frame = spark.createDataFrame([(i, [float(i % 7), float(i % 5), float(i)]) for i in range(50)], "vec_id long, embedding array<float>")
    got = whiten.whiten(frame).where("component = 1").select("vec_id").toPandas()
    assert sorted(got.vec_id) == list(range(50))
