"""Numbers that must not depend on tuning sizes, offsets or limits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlens.functions import exprs as X
from simlens.operators import dependence as D
from simlens.operators import forest as Fo
from simlens.operators import ordered as O
from simlens.operators import sampling as S
from simlens.operators import weights as Wt
from simlens.operators.subsets import subset_errors


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(b), float(a * 2 + rng.normal(0, 0.1)), float(b - a + rng.normal(0, 0.1)))
            for i, (a, b) in enumerate(rng.uniform(0, 1, (400, 2)))]
    return spark.createDataFrame(rows, "particle long, a double, b double, s1 double, s2 double").repartition(4).cache()


@pytest.mark.parametrize("criterion", ["cart", "mmd"])
def test_forest_does_not_depend_on_the_small_node_size(spark, cloud, criterion):
    seen = spark.createDataFrame([(1.0, 0.2)], "s1 double, s2 double")
    got = []
    for finish in (100_000, 60):
        w = Fo.forest_weights(cloud, seen, "particle", ["a", "b"], ["s1", "s2"], trees=3, min_leaf=5, criterion=criterion, features=4, finish=finish, seed=3)
        got.append(sorted((r["particle"], round(r["weight"], 12)) for r in w.collect()))
    assert got[0] == got[1] and sum(w for _, w in got[0]) == pytest.approx(1)


def test_forest_of_a_hundred_thousand_rows_needs_no_levels(spark, monkeypatch):
    """Cuts near the ends shorten a node by a few rows, so levels are many and jobs per level must not meet such nodes."""
    rows = spark.range(100_000).select(F.col("id").alias("particle"), F.rand(1).alias("a"), F.rand(2).alias("s1"), F.rand(3).alias("s2"))
    seen = spark.createDataFrame([(0.5, 0.5)], "s1 double, s2 double")

    def level(*_):
        raise AssertionError("a level of jobs for a small node")
    monkeypatch.setattr(Fo, "_cut_of_boxes", level)
    for criterion in ("cart", "mmd"):
        w = Fo.forest_weights(rows, seen, "particle", ["a"], ["s1", "s2"], trees=1, criterion=criterion, features=4)
        assert w.agg(F.sum("weight")).first()[0] == pytest.approx(1)


def test_forest_that_fits_a_task_unfolds_no_row_per_tree(spark, cloud, monkeypatch):
    """The way of an observed row needs a particle once for each part of the trees, not once for each tree."""
    seen = spark.createDataFrame([(1.0, 0.2)], "s1 double, s2 double")

    def spread(*_):
        raise AssertionError("a row per tree and particle")
    monkeypatch.setattr(Fo._Boxes, "spread", spread)
    w = Fo.forest_weights(cloud, seen, "particle", ["a", "b"], ["s1", "s2"], trees=30, min_leaf=5)
    assert w.count() == 400 and w.agg(F.sum("weight")).first()[0] == pytest.approx(1)


@pytest.mark.parametrize("honest", [0.5, None])
def test_forest_of_one_task_equals_levels_on_odd_rows(spark, cloud, honest):
    """Text ids, missing statistics, a group without particles and one without an observed row."""
    odd = cloud.withColumns({"particle": F.concat(F.lit("p"), "particle"), "g": F.when(F.col("particle") % 9 == 0, "idle").when(F.col("particle") % 3 > 0, "full"),
                             "s1": F.when(F.col("particle") % 11 > 0, F.col("s1")), "s2": F.when(F.col("particle") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("s2"))})
    seen = spark.createDataFrame([("full", 1.0, 0.2), (None, 0.4, 0.1), ("none", 0.5, 0.5)], "g string, s1 double, s2 double")
    got = []
    for finish in (100_000, 150):
        nodes, members = Fo.grow(odd, seen, "particle", ["a", "b"], ["s1", "s2"], 3, honest=honest, keys=["g"], finish=finish)
        got.append([sorted(map(repr, members.select("g", "tree", "node", "particle", "role", "copies").collect())),
                    sorted(map(repr, nodes.select("g", "tree", "node", "stat", "cut_value", "threshold").collect()))])
    assert got[0] == got[1] and len(got[0][1]) > 6


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_draws_of_many_rows_equal_column_draws(spark, kind):
    rows = spark.createDataFrame([(0,), (1,), (-5,), (2 ** 31 - 1,)], "n long").select(F.col("n").cast(kind)).select(
        "n", X.uniform(4, F.lit("split"), F.lit(7), "n").alias("u"), F.xxhash64(F.lit(4), F.lit("split"), F.lit(7)).alias("h")).toPandas()
    assert list(X.uniforms_of(rows["n"].to_numpy())(int(rows["h"][0]))) == list(rows["u"])


def test_whole_trees_write_no_row_per_tree_and_particle(spark, cloud, monkeypatch):
    seen = spark.createDataFrame([(1.0, 0.2)], "s1 double, s2 double")
    options = dict(trees=5, min_leaf=5, seed=3, full=True)
    large, _ = Fo.grow(cloud, seen, "particle", ["a", "b"], ["s1", "s2"], finish=60, **options)
    written, plain = [], Fo.cut

    def watched(df, *args):
        out = plain(df, *args)
        written.append(out.count())
        return out
    monkeypatch.setattr(Fo, "cut", watched)
    nodes, _ = Fo.grow(cloud, seen, "particle", ["a", "b"], ["s1", "s2"], with_members=False, **options)
    columns = ["tree", "node", "stat", "cut_value", "threshold"]
    assert sorted(map(tuple, nodes.select(*columns).collect())) == sorted(map(tuple, large.select(*columns).collect()))
    assert max(written) <= 400


def test_python_draws_equal_column_draws(spark):
    ids = [(3, 5, -7), (0, 1, 2 ** 62)]
    frame = spark.createDataFrame(ids, "g long, t int, n long")
    rows = frame.select("*", X.uniform(4, F.lit("s1"), "g", "t", "n").alias("u"), X.normal(9, F.lit(2), F.lit("p"), "g", "t", "n").alias("z"),
                        X.poisson(6.0, 5, "g", "t", "n").alias("k"), F.xxhash64("n", F.lit(1)).alias("c")).collect()
    for r in rows:
        own = (("q", r["g"]), ("i", r["t"]), ("q", r["n"]))
        assert X.uniform_of(4, "s1", *own) == r["u"] and X.poisson_of(6.0, 5, *own) == r["k"]
        assert X.normal_of(9, ("i", 2), "p", *own) == pytest.approx(r["z"], abs=1e-12)
        assert X.hash_of(("q", r["n"]), ("i", 1)) == r["c"]


def test_poisson_has_no_ceiling(spark):
    row = spark.range(4000).select(X.poisson(60.0, 1, "id").alias("k")).agg(F.avg("k"), F.max("k")).first()
    assert row[0] == pytest.approx(60, abs=0.6) and row[1] > 75


def test_constant_replicates_have_no_spread(spark):
    rows = [(g, i, v) for g, v in (("x", 0.1), ("y", 100000000.1)) for i in range(10)]
    frame = spark.createDataFrame(rows, "g string, i int, v double")
    for r in subset_errors(frame, ["g"], "i", "v", 10, 4, "std").collect():
        assert r["median_error"] < 1e-7 and r["q95_error"] < 1e-7


def test_weighted_moments_survive_offsets(spark):
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(0, 1, 300), rng.normal(0, 2, 300), rng.uniform(0, 1, 300)
    frame = spark.createDataFrame([(float(a + 1e9), float(b - 1e9), float(c)) for a, b, c in zip(x, y, w)], "x double, y double, weight double")
    cov = np.array(D.moments(frame, ["x", "y"], weight="weight").first()["cov"]).reshape(2, 2)
    assert np.allclose(cov, np.cov(x, y, aweights=w, ddof=0), atol=1e-4)
    trace = Wt.weighted_geometry(frame, [], ["x", "y"]).first()["trace"]
    assert trace == pytest.approx(np.trace(np.cov(x, y, aweights=w, ddof=0)), abs=1e-4)


def test_resampling_routes_agree(spark):
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.gamma(0.3, 1, 500))], "particle long, weight double")
    pick = [sorted(tuple(r) for r in Wt.resample(frame, 3000, 5, "particle", bound=b).select("draw", "particle").collect()) for b in (None, 0)]
    assert pick[0] == pick[1]
    with pytest.raises(Exception, match="weights sum to zero"):
        Wt.resample(frame.withColumn("weight", F.lit(0.0)), 10, 5, "particle").collect()


def test_joins_without_keys_refuse_several_rows(spark):
    with pytest.raises(Exception, match="several rows"):
        O.keys_equal(spark.range(3), spark.range(2).toDF("x"), []).collect()
    assert O.keys_equal(spark.range(3), spark.range(1).toDF("x"), []).count() == 3


def test_exploded_inputs_are_counted_before_they_are_called_small(spark):
    from simlens.session import is_small
    wide = spark.range(1000).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(1_000_000))))
    assert not is_small(wide) and is_small(spark.range(1000))


def test_constrained_prior_fills_the_area(spark):
    rows = S.constrained_prior(spark, 4000, {"r": (0.1, 10.0)}, {"a": (0.0, 1.0), "b": (0.2, 0.9)}, 3, limit=0.8)
    got = [(r["a"], r["b"]) for r in rows.collect()]
    assert len(got) == 4000 and all(0 <= a <= 0.6 + 1e-9 and 0.2 <= b and a + b <= 0.8 + 1e-9 for a, b in got)
    # uniform on the triangle a in [0, 0.6], b in [0.2, 0.8 - a]: means at a third of the sides
    assert np.mean([a for a, _ in got]) == pytest.approx(0.2, abs=0.01) and np.mean([b for _, b in got]) == pytest.approx(0.4, abs=0.01)


def test_sobol_refuses_unknown_dimensions(spark):
    with pytest.raises(ValueError):
        S.sobol(spark.range(4), "id", [f"x{i}" for i in range(40)])
    first = [tuple(r) for r in S.sobol(spark.range(8), "id", ["x", "y"]).orderBy("id").select("x", "y").collect()]
    assert first[:4] == [(0.0, 0.0), (0.5, 0.5), (0.75, 0.25), (0.25, 0.75)] and all(math.isfinite(v) for r in first for v in r)


def test_product_of_many_weights_does_not_underflow(spark):
    rows = [(i, 1.0 if i else 2.0) for i in range(3)]
    frame = spark.createDataFrame(rows, "particle long, w double").withColumn("log_weight", F.log("w") * 4000 - 5000)
    got = {r["particle"]: r["weight"] for r in Wt.normalise_log(frame, []).collect()}
    assert got[0] == pytest.approx(1.0) and got[1] < 1e-300


def test_constrained_box_on_the_route_of_large_inputs(spark, cloud):
    def found():
        return [sorted(tuple(r) for r in f(cloud, ["a", "b"], ["s1", "s2"]).collect()) for f in (D.constrained_relationships, D.constrained_correlations)]
    small = found()
    spark.conf.set("simlens.smallBytes", "0")
    try:
        large = found()
    finally:
        spark.conf.unset("simlens.smallBytes")
    for a, b in zip(small, large):
        assert len(a) == len(b) > 0
        for x, y in zip(a, b):
            assert x[0] == y[0] and [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)])


@pytest.mark.parametrize("bound", [None, 0])
def test_next_value_reads_no_shrinking_frame(spark, bound):
    n = 20_000
    df = spark.range(n).select("id", (F.col("id") % 2).alias("k"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    got = Wt.next_value(df, ["k"], ["id"], "v", bound)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing" not in plan.replace("specifiedwindowframe(RowFrame, ", "")
    rows = {r["id"]: r["v"] for r in got.collect()}
    for k in (0, 1):
        after = None
        for i in range(n - 2 + k, -1, -2):
            after = i if i % 7 == 0 else after
            assert rows[i] == after


def test_bootstrap_draws_from_one_order_of_the_particles(spark, cloud, monkeypatch):
    from simlens.operators import modes as M
    seen = {}

    def resample(df, *args, **options):
        seen["rows"], seen["drawn"] = df.count(), Wt.resample(df, *args, **options)
        return seen["drawn"]
    monkeypatch.setattr(M, "resample", resample)
    points = cloud.select("particle", F.col("s1").alias("pc1"), F.col("s2").alias("pc2"), (F.col("a") + 0.1).alias("w"))
    centres = spark.createDataFrame([(1, 1.0, 0.0)], "peak int, x double, y double")
    M.bootstrap_peaks(points, "particle", centres, 6, 11, 50, weight="w", size=10).collect()
    assert seen["rows"] == 400
    copies = points.withColumnRenamed("w", "weight").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(6))))
    want = Wt.resample(copies, 50, 11, "particle", ["replicate"]).select((F.col("replicate") * 50 - 50 + F.col("draw")).alias("draw"), "particle")
    assert sorted(map(tuple, seen["drawn"].select("draw", "particle").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_moments_of_many_columns(spark, keys):
    rng = np.random.default_rng(2)
    x = rng.normal(100, 1, (300, 20)) @ rng.normal(0, 1, (20, 20))
    names = [f"c{i}" for i in range(20)]
    rows = [(("a", "b")[i % 2], *map(float, r)) for i, r in enumerate(x)] + [("a", None, *[1.0] * 19)]
    m = D.moments(spark.createDataFrame(rows, "k string, " + ", ".join(f"{c} double" for c in names)).repartition(3), names, keys)
    assert m._jdf.queryExecution().optimizedPlan().toString().count("covar_pop") == 0
    for r in m.collect():
        part = x[("a", "b").index(r["k"])::2] if keys else x
        assert r["n"] == len(part) and r["mean"] == pytest.approx(part.mean(axis=0).tolist())
        assert np.allclose(np.reshape(r["cov"], (20, 20)), np.cov(part.T, bias=True))


def test_file_keys_of_long_paths(spark):
    import re
    from simlens.sources import snapshots
    names = ["exp_run_0001_014400.CELLS.json", "a_b_c_7_8.CELLS.json", "a_1_2.CELLS.json", "_x_y_1_2.CELLS.json", "a__1_2.CELLS.json", "a_b_1_x.CELLS.json"]
    paths = [f"file:/data/{f}/{n}" for f in ("input_3", "a b", "x_1_2_3") for n in names]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    for r in rows.select("p", *[c.alias(n) for n, c in snapshots.file_keys(F.col("p"), "CELLS").items()]).collect():
        m = re.search(r"([^/_]+)_([^/]+)_(\d+)_(\d+)\.CELLS\.json$", r["p"])
        assert (r["exp_group"], r["exp_name"], r["seed"], r["t_min"]) == ((m[1], m[2], int(m[3]), int(m[4])) if m else ("", "", None, None))
        assert r["folder"] == r["p"].split("/")[-2]
    plan = rows.select(*[c.alias(n) for n, c in snapshots.file_keys(F.col("p"), "CELLS").items()])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(p#" not in plan        # a pattern over a whole path starts anew at each of its places, for each row
