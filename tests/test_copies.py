"""Tables with many copies of a place: copies are counted, not searched one by one."""

import math

import numpy as np
import pandas as pd
import pytest

from simlens.operators import modes as M
from simlens.operators import neighbours as N
from simlens.plans import smc


def _copies(seed: int = 7):
    rng = np.random.default_rng(seed)
    base = pd.DataFrame({"x": rng.normal(size=25), "z": rng.normal(size=25), "w": rng.integers(1, 4, 25).astype(float)})
    pdf = pd.concat([base] * 9 + [base.assign(w=base.w + 0.5), pd.DataFrame({"x": [9.0], "z": [9.0], "w": [1.0]})], ignore_index=True)
    return pdf.assign(id=np.arange(len(pdf)))


@pytest.mark.parametrize("block", [20, 4096])
def test_leave_one_out_counts_copies(spark, monkeypatch, block):
    pdf, seen = _copies(), []
    visit = N.visit

    def counted(points, *rest, **more):
        seen.append(points.count())
        return visit(points, *rest, **more)
    monkeypatch.setattr(N, "visit", counted)
    factors = [0.05, 0.3]
    got = {r.factor: r.score for r in M.leave_one_out(spark.createDataFrame(pdf), "id", factors, weight="w", coords=("x", "z"), block=block).collect()}
    p, w = pdf[["x", "z"]].to_numpy(), (pdf.w / pdf.w.sum()).to_numpy()
    d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    for f in factors:
        k = -0.5 * d2 / f ** 2 + np.log(w)
        m = k.max(1)
        density = m + np.log(np.exp(k - m[:, None]).sum(1)) - 2 * math.log(f) - math.log(2 * math.pi) - np.log1p(-w)
        assert math.isclose(got[f], float((w * density).sum()), rel_tol=1e-9)
    assert seen == [51]                                         # 25 places with two weights each, and the lone one


def test_importance_weights_count_copies(spark):
    pdf = _copies(3).rename(columns={"w": "weight", "id": "particle"}).assign(s=lambda d: d.particle % 5)
    df = spark.createDataFrame(pdf)
    out = smc.importance_weights(df.where("particle % 2 = 0"), df.where("particle % 3 = 0"), {"x": (0.0, 5.0), "z": (0.0, 5.0)}, 0.1, spacings=["s"], reach=2)
    got = {r.particle: r.log_denominator for r in out.collect()}
    q, p = pdf[pdf.particle % 2 == 0], pdf[pdf.particle % 3 == 0]
    assert set(got) == set(q.particle)
    for r in q.itertuples():
        near = p[(p.s - r.s).abs() <= 2]
        terms = np.log(near.weight / p.weight.sum()) - 0.5 * (((near.x - r.x) / 0.5) ** 2 + ((near.z - r.z) / 0.5) ** 2)
        want = np.logaddexp.reduce(terms) - 2 * math.log(0.5 * math.sqrt(2 * math.pi)) - math.log(5)
        assert math.isclose(got[r.particle], want, rel_tol=1e-9, abs_tol=1e-9)


def test_subset_errors_write_no_row_per_subset(spark):
    from itertools import combinations

    from simlens.operators.subsets import subset_errors
    rng = np.random.default_rng(2)
    values = {g: rng.normal(size=6) for g in range(4)}
    df = spark.createDataFrame([(g, i, float(v)) for g, vs in values.items() for i, v in enumerate(vs)] + [(9, 0, 1.0), (0, 6, None)], "g long, i long, v double")
    out = subset_errors(df, ["g"], "i", "v", 6, 3, "median")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.g: r for r in out.collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        errors = [abs(np.median(c) - np.median(vs)) for c in combinations(vs, 3)]
        assert got[g].subsets == 20
        assert math.isclose(got[g].median_error, np.median(errors), rel_tol=1e-12, abs_tol=1e-15)
        assert math.isclose(got[g].q95_error, np.quantile(errors, 0.95), rel_tol=1e-12)


def test_information_over_k_searches_once(spark, monkeypatch):
    from simlens.operators import dependence as D
    rng, seen = np.random.default_rng(4), []
    pdf = pd.DataFrame({"id": np.arange(120), "g": ["a"] * 116 + ["b"] * 4, "x": rng.normal(size=120)}).assign(y=lambda d: d.x + rng.normal(size=120))
    df, visit = spark.createDataFrame(pdf), N.visit
    each = {k: {r.g: (r.n, r.mi) for r in D.mutual_information(df, "id", ["x"], ["y"], k, ["g"]).collect()} for k in (3, 5)}

    def counted(*rest, **more):
        seen.append(1)
        return visit(*rest, **more)
    monkeypatch.setattr(N, "visit", counted)
    rows = D.mi_over_k(df, "id", ["x"], ["y"], (3, 5), ["g"]).collect()
    assert seen == [1]
    assert {(r.k, r.g) for r in rows} == {(3, "a"), (3, "b"), (5, "a")}        # four points have no fifth neighbour
    for r in rows:
        assert r.n == each[r.k][r.g][0] and math.isclose(r.mi, each[r.k][r.g][1], rel_tol=1e-12, abs_tol=1e-12)


def test_importance_weights_make_their_inputs_once(spark):
    """What made the two generations runs once, however often their rows are read."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf
    df = spark.range(60).selectExpr("id particle", "double(id % 7) x", "double(id % 3) s", "1.0D weight")
    df = df.mapInPandas(count, df.schema)
    out = smc.importance_weights(df, df.where("particle < 30"), {"x": (0.0, 6.0)}, 0.1, spacings=["s"])
    assert out.count() == 60 and made.value == 120
