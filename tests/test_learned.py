"""Forests over binned parameters against brute force."""

import numpy as np

from simlens.operators import binned as B
from simlens.operators import learned as L


def _brute(bins, w, y, depth=30):
    """Prediction of each row by a recursive tree over all parameters; the first best cut wins."""
    out = np.full(len(y), (w * y).sum() / w.sum())
    best, found = 1e-9, None
    for f in range(bins.shape[1]):
        for b in range(B.BINS):
            left = bins[:, f] <= b
            wl, wr = w[left].sum(), w[~left].sum()
            if wl and wr:
                gain = (w[left] * y[left]).sum() ** 2 / wl + (w[~left] * y[~left]).sum() ** 2 / wr - (w * y).sum() ** 2 / w.sum()
                if gain > best + 1e-9:
                    best, found = gain, left
    if depth and found is not None:
        out[found], out[~found] = _brute(bins[found], w[found], y[found], depth - 1), _brute(bins[~found], w[~found], y[~found], depth - 1)
    return out


def test_tree_is_the_recursive_one():
    r = np.random.default_rng(3)
    bins = np.unique(r.integers(0, 7, (60, 2)), axis=0).astype(np.int8)
    w, y = r.integers(1, 4, len(bins)).astype(float), r.normal(size=len(bins))
    for depth in (2, 30):
        tree = B._grow(bins, w, w * y, w * y * y, 1, 0, 2, depth, 0.0)
        at = np.zeros(len(bins), dtype=int)
        for _ in range(depth):
            f = tree["feature"][at]
            go = np.where(bins[np.arange(len(at)), np.maximum(f, 0)] <= tree["split"][at], tree["below"][at], tree["above"][at])
            at = np.where(f >= 0, go, at)
        assert np.allclose(tree["value"][at], _brute(bins, w, y, depth))


def test_counted_rows_draw_poisson_sums():
    u = np.random.default_rng(5).random(200_000)
    for k in (1, 7, 5000):
        drawn = B._poisson(u, k)
        assert abs(drawn.mean() - k) < 0.01 * k and abs(drawn.var() - k) < 0.02 * k


def test_forest_is_grown_in_few_jobs_and_fits(spark):
    rows = [(float(i % 40), float(i * 7 % 23), 3.0 * (i % 40) + (i * 7 % 23) / 10, "x") for i in range(3000)] + [(None, 1.0, 1.0, "x"), (1.0, float("nan"), 1.0, "x")]
    df = spark.createDataFrame(rows, "a double, b double, y double, other string")
    spark.sparkContext.setJobGroup("forest", "")
    table, model = L.forest_importance(df, ["a", "b"], "y", trees=20)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest"))
    spark.sparkContext.setJobGroup("", "")
    score = {r["parameter"]: r["importance"] for r in table.collect()}
    assert jobs < 25                                            # not some for each level
    assert abs(sum(score.values()) - 1) < 1e-9 and score["a"] > 0.9
    fit = L.forest_fit(df, model, ["a", "b"], "y").first()
    assert fit["r2"] > 0.99
    again = L.forest_importance(df.repartition(5), ["a", "b"], "y", trees=20)[0].collect()       # draws depend on rows, not on their places
    assert all(abs(r["importance"] - score[r["parameter"]]) < 1e-9 for r in again)


def test_more_parameters_than_one_code_holds(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 14))
    names = [f"p{i}" for i in range(14)]
    df = spark.createDataFrame([(*map(float, v), float(4 * v[13])) for v in x], ", ".join(f"{n} double" for n in [*names, "y"]))
    table, model = L.forest_importance(df, names, "y", trees=10)
    assert max(table.collect(), key=lambda r: r["importance"])["parameter"] == "p13"
    assert model.transform(df).where("prediction IS NULL").isEmpty()


def test_cells_beyond_the_bound_are_grown_by_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "CELLS", 3)
    df = spark.createDataFrame([(float(i % 10), float(i % 3), float(i % 10)) for i in range(60)], "a double, b double, y double")
    table, _ = L.forest_importance(df, ["a", "b"], "y", trees=5)
    assert {r["parameter"]: r["importance"] > 0.5 for r in table.collect()} == {"a": True, "b": False}
