"""Lag of the largest cross-correlation against direct sums."""

import numpy as np
import pytest

from simlens.operators import spectral


def direct(a, b):
    return np.correlate(np.asarray(a, float) - np.mean(a), np.asarray(b, float) - np.mean(b), mode="full")


def first_lag(a, b):
    sums = direct(a, b)
    scale = np.std(a) * np.std(b) * len(a)
    return int(np.flatnonzero(sums >= sums.max() - spectral.EQUAL * scale)[0]) - len(a) + 1


@pytest.mark.parametrize("strip,bound", [(64, None), (2, None), (3, 0)])
def test_sums_equal_direct_ones(spark, monkeypatch, strip, bound):
    monkeypatch.setattr(spectral, "STRIP", strip)
    rng = np.random.default_rng(strip)
    series = {k: (rng.normal(size=n), rng.normal(size=n)) for k, n in enumerate([1, 2, 3, 7, 8, 33, 200])}
    series[100] = (np.ones(9), np.ones(9))
    t = np.arange(90)
    series[101] = (np.sin(t / 7.0), np.sin((t + 5) / 7.0))
    rows = [(k, i, float(x), float(y)) for k, (a, b) in series.items() for i, (x, y) in enumerate(zip(a, b))] + [(5, 1000, None, 1.0), (6, 1000, 2.0, None), (None, 0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k int, t int, a double, b double").repartition(5)
    got = {}
    for r in spectral.cross_correlation(df, ["k"], ["t"], "a", "b", bound=bound).collect():
        got.setdefault(r["k"], {}).update(zip(r["lags"], r["sums"]))
    for k, (a, b) in series.items():
        n = len(a)
        assert sorted(got[k]) == list(range(1 - n, n))
        assert np.allclose([got[k][lag] for lag in range(1 - n, n)], direct(a, b), atol=1e-9)
    lags = {r["k"]: r["lag"] for r in spectral.best_lag(df, ["k"], ["t"], "a", "b", bound=bound).collect()}
    assert lags == {k: first_lag(a, b) for k, (a, b) in series.items()} | {None: 0}
    assert lags[100] == -8 and lags[101] == first_lag(*series[101]) != 0


def test_no_keys_and_no_rows(spark):
    df = spark.createDataFrame([(i, float(i % 4), float((i + 1) % 4)) for i in range(40)], "t int, a double, b double")
    assert spectral.best_lag(df, [], ["t"], "a", "b").first()["lag"] == first_lag([i % 4 for i in range(40)], [(i + 1) % 4 for i in range(40)])
    assert spectral.best_lag(df.where("t < 0").withColumn("k", df["t"]), ["k"], ["t"], "a", "b").count() == 0
