"""Both routes of the ordered primitives against brute force, with a hot group and many copies."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from simlens.operators import ordered as o


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 6000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.3, 5.0, rng.normal(0, 10, n).round(3))
    pdf = pd.DataFrame({"k": key, "id": np.arange(n), "v": value})
    return spark.createDataFrame(pdf).repartition(7), pdf


@pytest.mark.parametrize("bound", [None, 0])
def test_running(table, bound):
    df, pdf = table
    got = o.running(df, ["k"], ["v", "id"], sums={"s": F.col("v")}, bound=bound, range_rows=300).toPandas()
    want = pdf.sort_values(["k", "v", "id"]).copy()
    want["rn"] = want.groupby("k").cumcount() + 1
    want["s"] = want.groupby("k")["v"].cumsum()
    merged = want.merge(got, on="id", suffixes=("", "_g"))
    assert len(got) == len(pdf)
    assert (merged.rn == merged.rn_g).all()
    assert np.allclose(merged.s, merged.s_g)


@pytest.mark.parametrize("bound", [None, 0])
def test_quantiles(table, bound):
    df, pdf = table
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    got = {r.k: r.q for r in o.quantiles(df, ["k"], "v", probs, bound=bound, range_rows=300).collect()}
    for k, g in pdf.groupby("k"):
        assert np.allclose(got[k], np.quantile(g.v, probs))


def test_quantiles_without_keys(table):
    df, pdf = table
    got = o.quantiles(df, [], "v", [0.1, 0.5], bound=0, range_rows=300).first().q
    assert np.allclose(got, np.quantile(pdf.v, [0.1, 0.5]))


def test_quantiles_of_values_far_apart(spark):
    """Bins of equal width cannot tell these from each other, and infinities have no width at all."""
    rng = np.random.default_rng(2)
    values = np.concatenate([10.0 ** rng.uniform(-300, 300, 3000), -(10.0 ** rng.uniform(-300, 300, 3000)), [np.inf] * 40, [-np.inf] * 40])
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(5)
    probs = [0.0, 0.2, 0.4999, 0.7, 0.9, 1.0]
    got = o.quantiles(df, [], "v", probs, bound=0, range_rows=100).first().q
    assert (got[0], got[-1]) == (-np.inf, np.inf)
    assert np.allclose(got[1:-1], np.quantile(values, probs[1:-1]), rtol=1e-12)


def test_quantiles_shuffle_no_rows_of_large_groups(spark):
    """What meets in a task are counts of bins; the rows themselves stay where they are read."""
    df = spark.range(50_000).withColumn("v", F.rand(1) * F.rand(2))
    seen = []
    plain = o._divided

    def watched(data, intervals, keys):
        out = plain(data, intervals, keys)
        seen.append(out.count())
        return out
    o._divided = watched
    try:
        got = o.quantiles(df, [], "v", [0.5], bound=0, range_rows=100).first().q[0]
    finally:
        o._divided = plain
    assert got == pytest.approx(df.agg(F.percentile("v", 0.5)).first()[0])
    assert seen and max(seen) <= 2


@pytest.mark.parametrize("bound", [None, 0])
def test_ranks(table, bound):
    df, pdf = table
    got = o.with_ranks(df, ["k"], "v", bound=bound).toPandas().set_index("id").sort_index()
    g = pdf.set_index("id").groupby("k")["v"]
    assert np.allclose(got.avg_rank, g.rank("average"))
    assert (got.min_rank == g.rank("min")).all()
    assert (got.dense_rank == g.rank("dense")).all()


@pytest.mark.parametrize("bound", [None, 0])
def test_windowed(table, bound):
    df, pdf = table

    def build(w):
        return {"prev": F.lag("v", 2).over(w), "nxt": F.lead("v").over(w),
                "m": F.avg("v").over(w.rowsBetween(-5, -1))}
    got = o.windowed(df, ["k"], ["id"], 5, 1, build, block=50, bound=bound).toPandas().set_index("id").sort_index()
    g = pdf.set_index("id").groupby("k")["v"]
    assert len(got) == len(pdf)
    pd.testing.assert_series_equal(got.prev, g.shift(2), check_names=False)
    pd.testing.assert_series_equal(got.nxt, g.shift(-1), check_names=False)
    want = g.transform(lambda s: s.shift(1).rolling(5, min_periods=1).mean())
    assert np.allclose(got.m.fillna(-1), want.fillna(-1))


def test_nearest_rows_prunes_before_the_shuffle(table, capsys):
    df, _ = table
    picked = o.nearest_rows(df, ["k"], ["v", "id"], 5)
    picked.explain()
    plan = capsys.readouterr().out
    assert plan.index("WindowGroupLimit") >= 0
    assert picked.groupBy("k").count().where("count <> 5").count() == 0
