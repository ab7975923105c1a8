"""Distance correlation against all pairs, normality statistics against known values, one growth for many settings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlens.operators import dependence as D
from simlens.operators import distance
from simlens.operators import forest as Fo


def pairs(x, y):
    a = np.abs(x[:, None] - x[None])
    b = np.sqrt(((y[:, None, :] - y[None]) ** 2).sum(-1))
    a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
    return math.sqrt(max((a * b).mean(), 0) / math.sqrt((a * a).mean() * (b * b).mean()))


def test_numpy_sums_equal_all_pairs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 101):
        x, y = rng.integers(0, 9, n).astype(float), rng.normal(size=n)
        assert math.isclose(distance.cross_sum(x, y), (np.abs(x[:, None] - x) * np.abs(y[:, None] - y)).sum(), abs_tol=1e-8)
        assert np.allclose(distance.distances_to_all(x), np.abs(x[:, None] - x).sum(1))


@pytest.mark.parametrize("bound", [None, 0])
def test_both_routes(spark, bound):
    rng = np.random.default_rng(2)
    n = 45
    x, y = np.round(rng.normal(size=n), 1), rng.normal(size=n)
    y += x * x
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(2, i, 1.0, float(i)) for i in range(5)] + [(1, 900, None, 1.0), (1, 901, 1.0, float("nan")), (None, 0, 1.0, 2.0)]
    got = {r["k"]: (r["n"], r["distance_correlation"]) for r in distance.distance_correlation(spark.createDataFrame(rows, "k int, id int, a double, b double"), ["k"], "id", "a", "b", bound).collect()}
    assert got[1][0] == n and math.isclose(got[1][1], pairs(x, y[:, None]), abs_tol=1e-9)
    assert got[2] == (5, 0.0) and got[None] == (1, 0.0)


@pytest.mark.parametrize("bound,directions", [(None, 400), (0, 6)])
def test_several_metrics(spark, bound, directions):
    rng = np.random.default_rng(3)
    n = 60 if bound is None else 25
    x, y = rng.normal(size=n), rng.normal(size=(n, 3))
    y[:, 0] += x
    y[:, 1] *= 4
    df = spark.createDataFrame([(i, float(a), *map(float, r)) for i, (a, r) in enumerate(zip(x, y))], "id int, p double, a double, b double, c double")
    got = distance.joint_distance_correlation(df, "id", ["p"], ["a", "b", "c"], directions, bound=bound).first()["distance_correlation"]
    assert abs(got - pairs(x, y)) < 1.0 / math.sqrt(directions)
    if bound == 0:          # the same directions by both routes
        whole = distance.joint_distance_correlation(df, "id", ["p"], ["a", "b", "c"], directions).first()["distance_correlation"]
        assert math.isclose(got, whole, abs_tol=1e-9)


def test_shapiro_wilk_known_values():
    w, p = D.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert abs(w - 0.7888148) < 1e-5 and abs(p - 0.0067038) < 1e-5
    assert D.shapiro_wilk(np.ones(5)) == (1.0, 1.0)
    w, p = D.shapiro_wilk(np.array([1.0, 2.0, 3.0]))
    assert math.isclose(w, 1.0) and math.isclose(p, 1.0, abs_tol=1e-6)
    assert D.shapiro_wilk(np.random.default_rng(1).exponential(size=200))[1] < 1e-6


def test_kolmogorov_and_choice_of_test(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = rng.normal(3, 2, 300)
    rows = [("a", float(v)) for v in values] + [("b", 1.0)] * 9 + [("c", None)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, value double")
    got = {r["k"]: r for r in D.kolmogorov_normality(df, ["k"]).collect()}
    x = np.sort(values)
    f = np.array([0.5 * math.erfc(-(v - values.mean()) / values.std() / math.sqrt(2)) for v in x])
    want = max((np.arange(1, 301) / 300 - f).max(), (f - np.arange(300) / 300).max())
    assert math.isclose(got["a"]["statistic"], want, rel_tol=1e-9) and got["a"]["n"] == 300 and got["b"]["statistic"] is None and "c" not in got
    t = 300 * want ** 2
    assert math.isclose(got["a"]["p_value"], 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t) for k in range(1, 200)), abs_tol=1e-6)
    monkeypatch.setattr(D, "MOST_SHAPIRO", 100)
    tests = {r["k"]: r["test"] for r in D.normality_tests(df, ["k"]).collect()}
    assert tests == {"a": "Kolmogorov-Smirnov", "b": "Shapiro-Wilk"}


def test_refit_grid_reads_all_settings_off_one_growth(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(a + rng.normal(0, 0.1)), float(rng.normal())) for i, a in enumerate(rng.uniform(0, 1, 150))]
    df = spark.createDataFrame(rows, "id int, theta double, s double, noise double").cache()
    goal = spark.createDataFrame([(0.5, 0.0)], "s double, noise double")
    grid = {(r["seed"], r["leaf"], r["n_trees"]): r for r in Fo.refit_grid(df, goal, "id", ["theta"], ["s", "noise"], [1, 4], [3, 30], [1, 2]).collect()}
    assert len(grid) == 8
    _, members = Fo.grow(df, goal, "id", ["theta"], ["s", "noise"], 4, settings=[(2, 3)])
    found = members.where("seed = 2").toPandas()
    weights = np.zeros(150)
    for _, tree in found.groupby("tree"):
        leaf = tree[tree.node == tree[tree.role == 2].node.iloc[0]]
        inside = leaf[leaf.role == 1].id.astype(int)
        weights[inside] += 1 / max(len(inside), 1) / 4
    row = grid[2, 3, 4]
    assert math.isclose(row["ess"], weights.sum() ** 2 / (weights ** 2).sum()) and row["support"] == (weights > 0).sum() and row["n_particles"] == 150
    assert all(r["support"] >= grid[k[0], k[1], 1]["support"] for k, r in grid.items())


def test_hundred_thousand_points_of_several_metrics_are_not_ordered_by_direction(spark, monkeypatch):
    """Rows for each direction and bit of the rank filled the disks; a task of a few directions keeps them to itself."""
    def numbered(*_):
        raise AssertionError("rows for each direction")
    monkeypatch.setattr(distance, "_numbered", numbered)
    df = spark.range(100_000).select("id", F.rand(1).alias("p"), F.rand(2).alias("a"), F.rand(3).alias("b"))
    got = distance.joint_distance_correlation(df, "id", ["p"], ["a", "b"], 2).first()
    assert got["n"] == 100_000 and 0 <= got["distance_correlation"] < 0.05


def test_low_bits_are_not_shuffled(spark, monkeypatch):
    sizes, plain = [], distance.running

    def watched(df, *args, **options):
        sizes.append(df.count())
        return plain(df, *args, **options)
    monkeypatch.setattr(distance, "running", watched)
    df = spark.range(64).select(F.lit(1).alias("k"), "id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    distance.distance_correlation(df, ["k"], "id", "x", "y", bound=0).collect()
    assert max(sizes) == 128        # two of six bits
