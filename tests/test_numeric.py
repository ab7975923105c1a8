"""Numeric kernels against plain numpy on small fixtures, and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from simlens.functions import exprs as X
from simlens.operators import dependence as D
from simlens.operators import errors as E
from simlens.operators import forest as Fo
from simlens.operators import modes as M
from simlens.operators import neighbours as N
from simlens.operators import reduce as R
from simlens.operators import sampling as S
from simlens.operators import series as Se
from simlens.operators import weights as Wt
from simlens.session import literal_table


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    n = 240
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "y": x + 0.1 * rng.normal(size=n), "z": rng.normal(size=n), "w": rng.random(n)})
    pdf.loc[:9, ["x", "y"]] = 0.25      # a group of copies
    return spark.createDataFrame(pdf), pdf


def _psi(n):
    return -0.5772156649015329 + sum(1 / k for k in range(1, n))


def _t_tail(r, n):
    """Two-sided tail of the t distribution by the trapezoid rule."""
    df = n - 2
    t = np.linspace(0, r * math.sqrt(df / (1 - r * r)), 200001)
    pdf = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + t * t / df) ** (-(df + 1) / 2)
    return 1 - 2 * float(np.sum((pdf[1:] + pdf[:-1]) / 2) * (t[1] - t[0]))


@pytest.mark.parametrize("block", [40, 4096])
def test_kth_distance_visits_every_needed_block(cloud, block):
    df, pdf = cloud
    got = N.kth_distance(df, [], ["x", "y"], "id", 3, "euclidean", block).toPandas().set_index("id").radius
    p = pdf[["x", "y"]].to_numpy()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert np.allclose(got.sort_index(), np.sort(d, axis=1)[:, 2])


def test_mutual_information_matches_a_loop(cloud):
    df, pdf = cloud
    got = {(r.parameter, r.metric): r.mi for r in D.mutual_information(df, "id", ["x", "z"], ["y"], block=64).collect()}
    for p in ("x", "z"):
        a, b = (pdf[c].to_numpy() / pdf[c].std(ddof=0) for c in (p, "y"))
        dx, dy = np.abs(a[:, None] - a), np.abs(b[:, None] - b)
        joint = np.maximum(dx, dy)
        np.fill_diagonal(joint, np.inf)
        r = np.sort(joint, axis=1)[:, 2][:, None] * (1 - 1e-10)
        nx, ny = np.maximum((dx < r).sum(1), 1), np.maximum((dy < r).sum(1), 1)
        want = _psi(len(a)) + _psi(3) - np.mean([_psi(k) for k in nx]) - np.mean([_psi(k) for k in ny])
        assert math.isclose(got[(p, "y")], max(want, 0), abs_tol=1e-9)
    assert got[("x", "y")] > 10 * got[("z", "y")]


def test_joint_mutual_information_matches_a_loop(cloud):
    df, pdf = cloud
    got = {r.parameter: r.mi for r in D.joint_mutual_information(df, "id", ["x"], ["y", "z"], block=64).collect()}
    s = {c: ((pdf[c] - pdf[c].mean()) / pdf[c].std(ddof=0)).to_numpy() for c in "xyz"}
    dx = np.abs(s["x"][:, None] - s["x"])
    dy = np.sqrt((s["y"][:, None] - s["y"]) ** 2 + (s["z"][:, None] - s["z"]) ** 2)
    joint = np.sqrt(dx ** 2 + dy ** 2)
    np.fill_diagonal(joint, np.inf)
    r = np.sort(joint, axis=1)[:, 2][:, None] * (1 - 1e-10)
    nx, ny = np.maximum((dx < r).sum(1), 1), np.maximum((dy < r).sum(1), 1)
    want = _psi(3) - np.mean([_psi(k + 1) for k in nx]) - np.mean([_psi(k + 1) for k in ny]) + _psi(len(dx))
    assert math.isclose(got["x"], max(want, 0), abs_tol=1e-9)


@pytest.mark.parametrize("block", [50, 4096])
def test_leave_one_out_matches_a_loop(cloud, block):
    df, pdf = cloud
    factors = [0.05, 0.3]
    got = {r.factor: r.score for r in M.leave_one_out(df, "id", factors, weight="w", coords=("x", "z"), block=block).collect()}
    p, w = pdf[["x", "z"]].to_numpy(), (pdf.w / pdf.w.sum()).to_numpy()
    d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    for f in factors:
        k = -0.5 * d2 / f ** 2 + np.log(w)
        m = k.max(1)
        density = m + np.log(np.exp(k - m[:, None]).sum(1)) - 2 * math.log(f) - math.log(2 * math.pi) - np.log1p(-w)
        assert math.isclose(got[f], float((w * density).sum()), rel_tol=1e-9)


def test_weighted_density_matches_numpy(cloud):
    df, pdf = cloud
    got = M.kde(df, ["x", "z"], size=12, pad=(1.0, 1.0), weight="w").toPandas().sort_values(["iy", "ix"])
    w = (pdf.w / pdf.w.sum()).to_numpy()
    p = pdf[["x", "z"]].to_numpy()
    cov = np.cov(p.T, aweights=w) * ((1 / (w ** 2).sum()) ** (-1 / 6)) ** 2
    q = got[["x", "y"]].to_numpy()
    d = q[:, None] - p[None]
    e = np.einsum("gni,ij,gnj->gn", d, np.linalg.inv(cov), d)
    want = (np.exp(-0.5 * e) * w).sum(1) / (2 * math.pi * math.sqrt(np.linalg.det(cov)))
    assert np.allclose(got.density, want)


def test_two_bumps_give_two_peaks_in_row_order(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal([-4, 0], 0.5, (150, 2)), rng.normal([4, 0.5], 0.5, (150, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "pc1": pts[:, 0], "pc2": pts[:, 1]}))
    peaks = M.cloud_peaks(df, size=60, threshold=0.5, factor=0.4).toPandas()
    assert len(peaks) == 2 and set(peaks.peak) == {1, 2}
    sizes = M.assign(df, spark.createDataFrame(peaks)).groupBy("peak").count().collect()
    assert sorted(r["count"] for r in sizes) == [150, 150]


def test_forest_path_equals_whole_trees_and_splits_the_groups(spark):
    rng = np.random.default_rng(5)
    n = 120
    s = np.r_[rng.uniform(0, 1, n // 2), rng.uniform(2, 3, n // 2)]
    pdf = pd.DataFrame({"id": np.arange(n), "theta": np.where(s < 1.5, 0.0, 10.0) + rng.normal(0, 0.01, n), "s": s, "noise": rng.normal(size=n)})
    df, goal = spark.createDataFrame(pdf), literal_table(spark, [(2.5, 0.0)], "s double, noise double")
    weights = {}
    for full in (False, True):
        _, members = Fo.grow(df, goal, "id", ["theta"], ["s", "noise"], trees=4, tries=20, full=full, min_leaf=20)
        weights[full] = Fo.leaf_weights(members, df, "id", 4).toPandas().set_index("id").weight.sort_index()
    assert np.allclose(weights[False], weights[True])
    assert math.isclose(weights[False].sum(), 1.0)
    assert weights[False][:n // 2].sum() == 0
    # large-node route: the distributed split finds the same first cut
    nodes, members = Fo.grow(df, goal, "id", ["theta"], ["s", "noise"], trees=2, tries=20, min_leaf=20, finish=70)
    root = nodes.where("node = 0").collect()
    assert len(root) == 2 and all(r.stat in (0, 1) for r in root)
    w = Fo.leaf_weights(members, df, "id", 2).agg(F.sum("weight")).first()[0]
    assert math.isclose(w, 1.0)


def test_resample_draws_only_weighted_rows(spark):
    df = literal_table(spark, [(1, 0.0), (2, 0.0), (3, 1.0)], "id int, weight double")
    rows = Wt.resample(df, 50, 1, "id").collect()
    assert len(rows) == 50 and {r.id for r in rows} == {3}


def test_sobol_points_and_ranges(spark):
    rows = S.sobol(spark.range(4), "id", ["a", "b"]).orderBy("id").collect()
    assert [(r.a, r.b) for r in rows] == [(0.0, 0.0), (0.5, 0.5), (0.75, 0.25), (0.25, 0.75)]
    many = S.sobol(spark.range(256), "id", [f"d{i}" for i in range(21)], 7).toPandas()
    assert (many.drop(columns="id").apply(lambda c: len(set((c * 256).astype(int)))) == 256).all()


def test_prior_draws_respect_the_constraint(spark):
    df = S.constrained_prior(spark, 500, {"r": (0.01, 1.0)}, {"a": (0.0, 0.8), "b": (0.0, 0.7)}, 3)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("a") + F.col("b")).alias("m"), F.min("r").alias("lo"), F.max("r").alias("hi")).first()
    assert row.n == 500 and row.m <= 1 and row.lo >= 0.01 and row.hi <= 1


def test_mixed_design_has_all_combinations(spark):
    d = S.mixed_design(spark, {"c": ["x", "y"], "k": [1, 2, 3], "r": (0.0, 2.0)}, 5, 1)
    assert d.count() == 30 and d.select("c", "k").distinct().count() == 6


def test_ward_matches_centroid_form(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(9, 3))
    merges = R.ward_merges(pts)
    groups, heights = {i: [i] for i in range(9)}, []
    for k in range(8):
        best = min(((math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(pts[a].mean(0) - pts[b].mean(0)), i, j)
                    for i, a in groups.items() for j, b in groups.items() if i < j))
        heights.append(best[0])
        groups[9 + k] = groups.pop(best[1]) + groups.pop(best[2])
    assert np.allclose([m[2] for m in merges], heights)


def test_component_sign_and_round_trip(cloud):
    df, _ = cloud
    model = M.fit_pca(df, ["x", "y", "z"], components=3)
    load = np.array(model.first().loadings).reshape(3, 3)
    assert (load[np.arange(3), np.abs(load).argmax(1)] > 0).all()
    back = M.invert(M.project(df, model, ["x", "y", "z"], components=3).select("id", "pc1", "pc2", "pc3"), model, ["x", "y", "z"], components=3).toPandas().sort_values("id")
    assert np.allclose(back[["x", "y", "z"]], cloud[1][["x", "y", "z"]])


def test_error_expressions_and_p_values(spark):
    df = literal_table(spark, [(0.0,), (1.0,), (2.0,)], "v double")
    assert [r[0] for r in df.select(X.absolute_error("v", F.lit(1.0))).collect()] == [1, 0, 1]
    r = df.select(X.correlation_p(F.lit(0.5), F.lit(30.0)).alias("p"), X.normal_two_sided_p(F.lit(1.959963984540054)).alias("q"), X.digamma_int(F.lit(40)).alias("d")).first()
    assert math.isclose(r.p, _t_tail(0.5, 30), rel_tol=1e-6) and math.isclose(r.q, 0.05, abs_tol=1e-12) and math.isclose(r.d, _psi(40), abs_tol=1e-13)
    assert df.select(X.safe_corr(F.lit(1.0), "v")).first()[0] is None


def test_interpolation_holds_the_first_value_and_falls_to_zero(spark):
    df = literal_table(spark, [(1.0, 10.0), (3.0, 20.0)], "time double, v double")
    got = [r.value for r in Se.on_grid(df, [], "time", "v", 0.0, 4.0, 1.0).orderBy("time").collect()]
    assert got == [10.0, 10.0, 15.0, 20.0, 0.0]


def test_scenario_test_p_value(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(20)] + [("b", float(v) + 15) for v in range(20)], "s string, v double")
    small, large = (E.scenario_tests(df, [], "s", "v", bound=b).first() for b in (None, 0))
    assert small.u == large.u == 12.5 and small.significant and math.isclose(small.p, large.p)


def test_permutations_keep_group_sizes(cloud):
    df, _ = cloud
    dealt = M.group_permutations(df.withColumn("g", F.col("id") % 3), "id", "g", 3, 1)
    counts = dealt.groupBy("permutation", "g").count().collect()
    assert len(counts) == 12 and {r["count"] for r in counts} == {80}
    assert dealt.groupBy("permutation").agg(F.count_distinct("id").alias("n")).where("n <> 240").count() == 0


def test_chain_samples_are_complete_and_valid(spark):
    out = S.chain_samples(spark, 40, {"a": (0.0, 1.0)}, [("b", "a", 2.0, -0.5), ("c", "b", 1.0, 0.1)], ["a", "b"], 3).toPandas()
    assert len(out) == 40 and (out.b >= 0).all() and sorted(out.particle) == list(range(1, 41))
    assert np.allclose(out.b, 2 * out.a - 0.5) and np.allclose(out.c, out.b + 0.1)


def test_source_layouts(spark):
    units = S.sobol(spark.range(16), "id", ["X_SPACING", "Y_SPACING", "GLUCOSE_CONCENTRATION"])
    specs = {"X_SPACING": (2, 9), "Y_SPACING": (2, 9), "GLUCOSE_CONCENTRATION": (0.1, 0.5)}
    grid = S.source_sites(units, specs, 10, 30.0, False).toPandas()
    x, y = (grid[c].str.split(":").str[1].astype(int) for c in ("X_SPACING", "Y_SPACING"))
    assert (x <= y).all() and grid.GLUCOSE_CONCENTRATION.between(0.1, 0.5).all()
    want = (57 // x) * (38 // y) / (29 * 30.0 * 38 * 30 * 1e-6)
    assert np.allclose(grid.CAPILLARY_DENSITY, want)
    point = S.source_sites(units, specs, 10, 30.0, True).toPandas()
    assert set(point.X_SPACING) == {"27:29"} and (point.DISTANCE_TO_CENTER >= 0).all()
    assert S.percentage_grid(spark, {"a": 2.0, "b": 3.0}).count() == 121
