"""Correlation, regression, mutual information, importance and sensitivity."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from simlens.functions import exprs as X
from simlens.operators import neighbours as N
from simlens.operators.clean import melt
from simlens.operators.ordered import attach, keys_equal, nearest_rows, quantiles, running, value_counts, with_ranks
from simlens.session import settled


# --- moments: one pass over the rows, then small matrices --------------------------------------------

WIDE = 16                # more columns than this are summed as matrices, not as one aggregate per pair
HELD_CELLS = 1 << 21     # matrix cells held at once by one task


def moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(keys, n, mean[], cov[] population, row-major). Rows with a missing column are left out."""
    complete = df
    for c in columns:
        complete = complete.where(X.finite(c).isNotNull())
    p = len(columns)
    if weight is None and p > WIDE:
        return _wide_moments(complete, columns, keys)
    if weight is None:
        cells = {(i, j): F.covar_pop(columns[i], columns[j]) for i in range(p) for j in range(i, p)}
        means = [F.avg(c) for c in columns]
    else:
        # products are taken around the plain group means, so large offsets do not cancel
        complete = attach(complete, keys, **{f"__m{i}": F.avg(c) for i, c in enumerate(columns)})
        w = F.col(weight)
        total = F.sum(w)
        apart = [F.col(c) - F.col(f"__m{i}") for i, c in enumerate(columns)]
        shift = [F.try_divide(F.sum(w * e), total) for e in apart]
        means = [F.first(f"__m{i}") + s for i, s in enumerate(shift)]
        cells = {(i, j): F.try_divide(F.sum(w * apart[i] * apart[j]), total) - shift[i] * shift[j]
                 for i in range(p) for j in range(i, p)}
    return complete.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*means).alias("mean"),
        F.array(*[cells[(min(i, j), max(i, j))] for i in range(p) for j in range(p)]).alias("cov"))


def _wide_moments(complete: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Moments of many columns: a task adds the centred products of its rows as one matrix per group, cells are summed by place."""
    p, names = len(columns), list(keys)
    base = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in columns]).alias("mean"))
    rows = keys_equal(complete.select(*keys, F.array(*[F.col(c).cast("double") for c in columns]).alias("__x")), base.select(*keys, F.col("mean").alias("__mean")), keys)
    schema = ", ".join([*[f"`{k}` {complete.schema[k].dataType.simpleString()}" for k in keys], "part array<double>"])

    def add(batches):
        import pandas as pd
        sums: dict = {}

        def emit():
            out = pd.DataFrame([(*key, total.ravel()) for key, total in sums.items()], columns=[*names, "part"])
            sums.clear()
            return out

        for pdf in batches:
            for key, g in pdf.groupby(names, sort=False, dropna=False) if names else [((), pdf)]:
                if len(g):
                    apart = np.stack(g["__x"].to_numpy()) - np.asarray(g["__mean"].iloc[0], dtype=float)
                    sums[key] = sums.get(key, 0.0) + apart.T @ apart
            if len(sums) * p * p > HELD_CELLS:
                yield emit()
        yield emit()

    cells = rows.mapInPandas(add, schema).select(*keys, F.posexplode("part").alias("__i", "__v")).groupBy(*keys, "__i").agg(F.sum("__v").alias("__v"))
    total = cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda c: c["__v"]).alias("__s"))
    return keys_equal(base, total, keys, "left").select(*keys, "n", "mean", F.transform("__s", lambda v: v / F.col("n")).alias("cov"))


def from_moments(moment_rows: DataFrame, keys: Sequence[str], fn, schema: str) -> DataFrame:
    """Applies ``fn(n, mean, cov) -> list of tuples`` to every moment row (one small matrix per group)."""
    kept = list(keys)
    key_schema = ", ".join(f"`{k}` {moment_rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [part.strip().split(" ")[0].strip("`") for part in _split(schema)]

    def run(batches):
        import pandas as pd
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                mean = np.asarray(r["mean"], dtype=float)
                cov = np.asarray(r["cov"], dtype=float).reshape(len(mean), len(mean))
                rows += [(*[r[k] for k in kept], *t) for t in fn(int(r["n"]), mean, cov)]
            yield pd.DataFrame(rows, columns=[*kept, *names])

    return moment_rows.mapInPandas(run, ", ".join(x for x in (key_schema, schema) if x))


def _split(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += ch in "<(" 
        depth -= ch in ">)"
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def correlation_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long (a, b, cov, r): symmetric, clipped to [-1, 1], unit diagonal; fails on a constant column."""
    names = list(columns)

    def cells(n, mean, cov):
        sd = np.sqrt(np.diag(cov))
        if (sd == 0).any():
            raise ValueError(f"constant column: {names[int(np.argmin(sd))]}")
        r = np.clip(cov / np.outer(sd, sd), -1, 1)
        np.fill_diagonal(r, 1.0)
        return [(a, b, float(cov[i, j]), float(r[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return from_moments(moments(df, names, keys), keys, cells, "a string, b string, cov double, r double")


def rank_columns(df: DataFrame, ident: Sequence[str], columns: Sequence[str], keys: Sequence[str] = (), bound: int | None = None) -> DataFrame:
    """Average ranks of several columns, wide again (one row per id)."""
    long = melt(df, [*keys, *ident], columns, "__c", "__v")
    ranked = with_ranks(long.where(F.col("__v").isNotNull()), [*keys, "__c"], "__v", bound)
    return ranked.groupBy(*keys, *ident).agg(*[F.max(F.when(F.col("__c") == c, F.col("avg_rank"))).alias(c) for c in columns])


def cross_correlation(df: DataFrame, parameters: Sequence[str], metrics: Sequence[str], keys: Sequence[str] = (),
                      p_values: bool = False) -> DataFrame:
    """Long (parameter, metric, r, n) over rows where both are present."""
    cells = [F.struct(F.lit(p).alias("parameter"), F.lit(m).alias("metric"), X.pair_corr(p, m).alias("r"),
                      F.count_if(F.col(p).isNotNull() & F.col(m).isNotNull()).alias("n")) for p in parameters for m in metrics]
    out = df.groupBy(*keys).agg(F.array(*cells).alias("__c")).select(*keys, F.explode("__c").alias("__c")).select(*keys, "__c.*")
    return out.withColumn("p_value", X.correlation_p(F.col("r"), F.col("n").cast("double"))) if p_values else out


def spearman(df: DataFrame, ident: Sequence[str], parameters: Sequence[str], metrics: Sequence[str], keys: Sequence[str] = (),
             p_values: bool = False, bound: int | None = None) -> DataFrame:
    ranked = rank_columns(df, ident, [*parameters, *metrics], keys, bound)
    return cross_correlation(ranked, parameters, metrics, keys, p_values)


def linear_importance(df: DataFrame, parameters: Sequence[str], metrics: Sequence[str], keys: Sequence[str] = (), ridge: float = 0.0) -> DataFrame:
    """Coefficients of each metric on standardised parameters, their size, intercept and R²."""
    ps, ms = list(parameters), list(metrics)

    def solve(n, mean, cov):
        k = len(ps)
        sd = np.sqrt(np.diag(cov)[:k])
        sd = np.where(sd > 0, sd, 1.0)
        a = cov[:k, :k] / np.outer(sd, sd)
        rows = []
        for j, m in enumerate(ms):
            b = cov[:k, k + j] / sd
            coef = np.linalg.lstsq(a * n + ridge * np.eye(k), b * n, rcond=None)[0]
            var = cov[k + j, k + j]
            r2 = float((2 * coef @ b - coef @ a @ coef) / var) if var > 0 else None
            rows += [(p, m, float(coef[i]), abs(float(coef[i])), float(mean[k + j]), r2) for i, p in enumerate(ps)]
        return rows
    return from_moments(moments(df, [*ps, *ms], keys), keys, solve,
                        "parameter string, metric string, coefficient double, importance double, intercept double, r2 double")


def peak_ridge(df: DataFrame, peak: str, distance: str, ident: str, parameters, metrics, n: int = 50, alpha: float = 1.0) -> DataFrame:
    """Ridge on the n particles nearest each peak."""
    near = nearest_rows(df, [peak], [distance, ident], n)
    return linear_importance(near, parameters, metrics, [peak], alpha)


def pair_r2(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """R² of every unordered pair over rows where both are present."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), X.safe_r2(b, a).alias("r2")) for a, b in pairs]
    return df.groupBy(*keys).agg(F.array(*cells).alias("__c")).select(*keys, F.explode("__c").alias("__c")).select(*keys, "__c.*")


def pair_equations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), threshold: float = 0.0) -> DataFrame:
    """Both straight lines of every pair whose R² reaches the threshold."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), X.safe_r2(b, a).alias("r2"), X.pair_corr(a, b).alias("r"),
                      F.regr_slope(b, a).alias("slope_ab"), F.regr_intercept(b, a).alias("intercept_ab"),
                      F.regr_slope(a, b).alias("slope_ba"), F.regr_intercept(a, b).alias("intercept_ba")) for a, b in pairs]
    out = df.groupBy(*keys).agg(F.array(*cells).alias("__c")).select(*keys, F.explode("__c").alias("__c")).select(*keys, "__c.*")
    return out.where(F.col("r2") >= threshold)


def top_pairs(pairs: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return nearest_rows(pairs, keys, [F.desc("r2"), F.col("a"), F.col("b")], n)


def correlation_ratio(df: DataFrame, parameters: Sequence[str], metrics: Sequence[str], keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Share of metric variance between equal-width parameter bins; a bin of one row counts as no variance."""
    long = melt(df, [*keys, *metrics], parameters, "parameter", "x")
    stats = long.groupBy(*keys, "parameter").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"),
        F.approx_count_distinct("x").alias("__about"),
        *[F.var_pop(m).alias(f"__t_{m}") for m in metrics])
    # The exact distinct number matters only near ``bins``: only parameters with few values are looked at again.
    few = keys_equal(long.select(*keys, "parameter", "x"), stats.where(F.col("__about") <= 10 * bins).select(*keys, "parameter"), [*keys, "parameter"])
    few = few.where(F.col("x").isNotNull()).distinct().groupBy(*keys, "parameter").agg(F.count(F.lit(1)).alias("__distinct"))
    stats = keys_equal(stats, few, [*keys, "parameter"], "left").withColumn(
        "bins", F.least(F.coalesce("__distinct", F.lit(bins)), F.lit(bins))).drop("__about", "__distinct")
    placed = keys_equal(long, stats, [*keys, "parameter"]).where(F.col("bins") > 1)
    u = (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    binned = placed.withColumn("__bin", F.least(F.floor(u * F.col("bins")), F.col("bins") - 1))
    per = binned.groupBy(*keys, "parameter", "__bin").agg(
        F.first("n").alias("n"), *[F.first(f"__t_{m}").alias(f"__t_{m}") for m in metrics],
        *[(F.count(F.lit(1)) * F.var_pop(m)).alias(f"__w_{m}") for m in metrics])
    cells = [F.struct(F.lit(m).alias("metric"), F.when(F.first(f"__t_{m}") > 0, (F.first(f"__t_{m}") - F.sum(f"__w_{m}") / F.first("n")) / F.first(f"__t_{m}"))
                      .otherwise(F.lit(0.0)).alias("share")) for m in metrics]
    out = per.groupBy(*keys, "parameter").agg(F.array(*cells).alias("__c"))
    return out.select(*keys, "parameter", F.explode("__c").alias("__c")).select(*keys, "parameter", "__c.*")


# --- multivariate importance ---------------------------------------------------------------------------

def metric_pca_importance(df: DataFrame, parameters, metrics, keys=(), components: int = 3) -> DataFrame:
    """|correlation| with the leading metric components, weighted by their explained variance."""
    ps, ms = list(parameters), list(metrics)

    def solve(n, mean, cov):
        k = len(ps)
        values, vectors = np.linalg.eigh(cov[k:, k:])
        order = np.argsort(values)[::-1][:min(components, len(ms))]
        share = values[order] / values.sum()
        cross = cov[:k, k:] @ vectors[:, order]
        r = np.abs(cross) / np.sqrt(np.outer(np.diag(cov)[:k], np.maximum(values[order], 1e-300)))
        return [(p, float(r[i] @ share)) for i, p in enumerate(ps)]
    return from_moments(moments(df, [*ps, *ms], keys), keys, solve, "parameter string, importance double")


def canonical_importance(df: DataFrame, parameters, metrics, keys=()) -> DataFrame:
    """Mean absolute canonical weight of each standardised parameter (weights scaled to unit length)."""
    ps, ms = list(parameters), list(metrics)

    def solve(n, mean, cov):
        k = len(ps)
        sd = np.sqrt(np.diag(cov))
        c = cov / np.outer(sd, sd)
        if len(ms) == 1:          # one metric: the correlations themselves
            return [(p, float(abs(c[i, k]))) for i, p in enumerate(ps)]

        def whiten(m):
            v, q = np.linalg.eigh(m)
            keep = v > 1e-12 * v.max()
            return (q[:, keep] / np.sqrt(v[keep])) @ q[:, keep].T
        a = whiten(c[:k, :k])
        u, _, _ = np.linalg.svd(a @ c[:k, k:] @ whiten(c[k:, k:]))
        w = a @ u[:, :min(k, len(ms))]
        w = w / np.linalg.norm(w, axis=0)
        return [(p, float(np.abs(w[i]).mean())) for i, p in enumerate(ps)]
    return from_moments(moments(df, [*ps, *ms], keys), keys, solve, "parameter string, importance double")


def multi_output_importance(df: DataFrame, parameters, metrics, keys=()) -> DataFrame:
    return linear_importance(df, parameters, metrics, keys).groupBy(*keys, "parameter").agg(F.avg("importance").alias("importance"))


def overall_ranking(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Min-max mean over methods and Borda share per parameter, with ranks; scores: (method, parameter, score).

    The table has one row per method and parameter, so the windows are a few dozen rows.
    """
    by = W.partitionBy(*keys, "method")
    span = F.max("score").over(by) - F.min("score").over(by)
    same = W.partitionBy(*keys, "method", "score")
    rank = F.rank().over(by.orderBy(F.desc("score"))) + (F.count(F.lit(1)).over(same) - 1) / 2.0
    t = scores.select(*keys, "method", "parameter", F.try_divide(F.col("score") - F.min("score").over(by), F.nullif(span, F.lit(0.0))).alias("unit"), rank.alias("rank"))
    agg = t.groupBy(*keys, "parameter").agg(F.avg("unit").alias("ensemble"), F.sum("rank").alias("rank_sum"), F.count(F.lit(1)).alias("methods"))
    all_ = W.partitionBy(*keys)
    borda = F.col("methods") * F.count(F.lit(1)).over(all_) - F.col("rank_sum") + F.col("methods")
    out = agg.withColumn("borda", borda).withColumn("borda", F.col("borda") / F.sum("borda").over(all_))
    return out.select(*keys, "parameter", "ensemble", "borda",
                      F.rank().over(all_.orderBy(F.desc("ensemble"))).cast("bigint").alias("rank_ensemble"),
                      F.rank().over(all_.orderBy(F.desc("borda"))).cast("bigint").alias("rank_borda"))


def weighted_method_scores(scores: DataFrame, weights: dict[str, float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(method, parameter, score) from per-metric scores, averaged with metric weights."""
    w = F.lit(1.0)
    for m, v in (weights or {}).items():
        w = F.when(F.col("metric") == m, F.lit(float(v))).otherwise(w)
    return scores.withColumn("__w", w).groupBy(*keys, "method", "parameter").agg(
        F.try_divide(F.sum(F.col("score") * F.col("__w")), F.sum("__w")).alias("score"))


def constrained_relationships(df: DataFrame, subset_a: Sequence[str], subset_b: Sequence[str], low: float = 25, high: float = 75,
                              keys: Sequence[str] = ()) -> DataFrame:
    """Mean, variance and variance reduction of B parameters, all rows against rows inside the percentile box of A."""
    inside = _inside_box(df, subset_a, low, high, keys)
    long = melt(inside, [*keys, "__in"], subset_b, "parameter", "value")
    kept = F.when(F.col("__in"), F.col("value"))
    out = long.groupBy(*keys, "parameter").agg(
        F.count(kept).alias("n_in_range"), F.var_pop("value").alias("variance_full"), F.var_pop(kept).alias("variance_constrained"),
        F.avg("value").alias("mean_full"), F.avg(kept).alias("mean_constrained"))
    return out.withColumn("variance_reduction", F.coalesce(1 - F.try_divide(F.col("variance_constrained"), F.nullif("variance_full", F.lit(0.0))), F.lit(0.0)))


def constrained_correlations(df: DataFrame, subset_a, subset_b, low: float = 25, high: float = 75, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of B pairs on all rows and inside the box of A."""
    inside = _inside_box(df, subset_a, low, high, keys)
    pairs = [(a, b) for i, a in enumerate(subset_b) for b in list(subset_b)[i + 1:]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), X.pair_corr(a, b).alias("r_full"),
                      X.pair_corr(F.when(F.col("__in"), F.col(a)), F.when(F.col("__in"), F.col(b))).alias("r_constrained")) for a, b in pairs]
    out = inside.groupBy(*keys).agg(F.array(*cells).alias("__c")).select(*keys, F.explode("__c").alias("__c")).select(*keys, "__c.*")
    return out.withColumn("difference", F.col("r_constrained") - F.col("r_full")).withColumn("high", F.abs("r_constrained") > 0.7)


def _inside_box(df, subset_a, low, high, keys):
    q = quantiles(melt(df, keys, subset_a, "__axis", "__x"), [*keys, "__axis"], "__x", [low / 100, high / 100], "__q")
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("__axis") == a, F.col("__q"))).alias(f"__b_{a}") for a in subset_a])
    joined = keys_equal(df, wide, keys)
    inside = F.lit(True)
    for a in subset_a:
        inside = inside & F.coalesce(F.col(a).between(F.element_at(f"__b_{a}", 1), F.element_at(f"__b_{a}", 2)), F.lit(False))
    return joined.withColumn("__in", inside).drop(*[f"__b_{a}" for a in subset_a])


# --- mutual information ------------------------------------------------------------------------------

def pair_table(df: DataFrame, ident: str, parameters: Sequence[str], metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long (keys, parameter, metric, id, x, y), rows with a missing side dropped, both sides divided by their spread."""
    x = melt(df, [*keys, ident, *metrics], parameters, "parameter", "x").where(F.col("x").isNotNull())
    y = x.select(*keys, ident, "parameter", "x", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), X.finite(m).alias("y")) for m in metrics])).alias("__m")).select(*keys, ident, "parameter", "x", "__m.*")
    group = [*keys, "parameter", "metric"]
    scaled = attach(y.where(F.col("y").isNotNull()), group, __sx=F.stddev_pop("x"), __sy=F.stddev_pop("y"))
    one = lambda c, s: F.col(c) / F.when(F.col(s) > 0, F.col(s)).otherwise(F.lit(1.0))
    return scaled.select(*group, ident, one("x", "__sx").alias("x"), one("y", "__sy").alias("y"))


def mutual_information(df: DataFrame, ident: str, parameters: Sequence[str], metrics: Sequence[str], k: int = 3,
                       keys: Sequence[str] = (), block: int = N.BLOCK, bound: int | None = None) -> DataFrame:
    """Nearest-neighbour mutual information of every parameter and metric (Chebyshev balls, open radius)."""
    return mi_over_k(df, ident, parameters, metrics, [k], keys, block, bound).drop("k")


def joint_mutual_information(df: DataFrame, ident: str, parameters: Sequence[str], metrics: Sequence[str], k: int = 3,
                             keys: Sequence[str] = (), block: int = N.BLOCK, bound: int | None = None) -> DataFrame:
    """Mutual information of each parameter with all metrics together (Euclidean balls; the point counts itself)."""
    group = [*keys, "parameter"]
    x = melt(df, [*keys, ident, *metrics], parameters, "parameter", "x")
    for c in ("x", *metrics):
        x = x.where(X.finite(c).isNotNull())
    scaled = attach(x, group, **{f"__m_{c}": F.avg(c) for c in ("x", *metrics)}, **{f"__s_{c}": F.stddev_pop(c) for c in ("x", *metrics)})
    z = settled(scaled.select(*group, ident, *[F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")).alias(c) for c in ("x", *metrics)]))
    radius = N.kth_distance(z, group, ["x", *metrics], ident, k, "euclidean", block, bound)
    placed = keys_equal(z, radius, [*group, ident])
    nx = N.interval_counts(placed, group, "x", ident, "radius", bound).withColumnRenamed("inside", "nx")
    ny = N.ball_counts(placed, group, list(metrics), ident, "radius", "euclidean", block, bound).withColumnRenamed("inside", "ny")
    both = keys_equal(nx, ny, [*group, ident])
    n = F.count(F.lit(1))
    mi = X.digamma_int(F.lit(k)) - F.avg(X.digamma_int(F.col("nx") + 1)) - F.avg(X.digamma_int(F.col("ny") + 1)) + X.digamma_int(n)
    return both.groupBy(*group).agg(n.alias("n"), F.greatest(mi, F.lit(0.0)).alias("mi"))


def scaled_mi(mi: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Min-max over parameters inside each (keys, metric); zero when all are equal. A table of parameters, not rows."""
    w = W.partitionBy(*keys, "metric")
    lo, hi = F.min("mi").over(w), F.max("mi").over(w)
    return mi.withColumn("strength", F.when(hi > lo, (F.col("mi") - lo) / (hi - lo)).otherwise(F.lit(0.0)))


def mi_profile(mi: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean strength over metrics and the sum used as rank strength."""
    return scaled_mi(mi, keys).groupBy(*keys, "parameter").agg(F.avg("strength").alias("mean_strength"), F.sum("strength").alias("rank_strength"))


def mi_with_direction(df: DataFrame, ident: str, parameters, metrics, k: int = 3, keys: Sequence[str] = (), bound: int | None = None) -> DataFrame:
    mi = mutual_information(df, ident, parameters, metrics, k, keys, bound=bound)
    rho = spearman(df, [ident], parameters, metrics, keys, bound=bound).select(*keys, "parameter", "metric", F.coalesce(F.signum("r"), F.lit(0.0)).cast("int").alias("direction"))
    return keys_equal(mi, rho, [*keys, "parameter", "metric"])


def permutation_information(df: DataFrame, ident: str, parameters, metrics, labels: DataFrame, group: str, k: int = 3, bound: int | None = None) -> DataFrame:
    """(permutation, group, parameter, strength): profile of each group under each labelling.

    ``labels`` are (permutation, ident, group) rows, permutation 0 the observed one. Strengths are the informations of a
    labelling's group, scaled to 0 to 1 over parameters for each metric, and averaged over metrics.
    """
    rows = df.select(ident, *dict.fromkeys([*parameters, *metrics])).join(labels.select("permutation", ident, group), ident)
    keys = ["permutation", group]
    mi = mutual_information(rows, ident, parameters, metrics, k, keys, bound=bound)
    return mi_profile(mi, keys).select(*keys, "parameter", F.col("mean_strength").alias("strength"))


def mi_over_k(df: DataFrame, ident: str, parameters, metrics, ks: Sequence[int] = (3, 4, 5), keys: Sequence[str] = (),
              block: int = N.BLOCK, bound: int | None = None) -> DataFrame:
    """Mutual information for each number of neighbours: one search finds the radii of all, one running count both sides of all."""
    group, sides = [*keys, "parameter", "metric"], [*keys, "parameter", "metric", "k", "__side"]
    pairs = settled(pair_table(df, ident, parameters, metrics, keys))
    radii = N.kth_distances(pairs, group, ["x", "y"], ident, ks, "chebyshev", block, bound)
    placed = keys_equal(pairs, radii, [*group, ident])
    cells = F.array(*[F.struct(F.lit(int(k)).alias("k"), F.element_at("radii", i + 1).alias("radius"), F.lit(side).alias("__side"), F.col(side).alias("__v"))
                      for i, k in enumerate(ks) for side in ("x", "y")])
    long = placed.select(*group, ident, F.explode(cells).alias("__c")).select(*group, ident, "__c.*").where(F.col("radius").isNotNull())
    inside = N.interval_counts(long, sides, "__v", ident, "radius", bound)
    per = inside.groupBy(*group, "k").agg(*[F.avg(F.when(F.col("__side") == s, X.digamma_int("inside"))).alias(f"__{s}") for s in ("x", "y")],
                                          F.count_if(F.col("__side") == "x").alias("n"))
    mi = X.digamma_int(F.col("n")) + X.digamma_int(F.col("k")) - F.col("__x") - F.col("__y")
    return per.select(*group, "n", F.greatest(mi, F.lit(0.0)).alias("mi"), "k")


def k_agreement(mi: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(k, other_k, metric, spearman): rank correlation of the parameters' informations between every two numbers of neighbours."""
    w = W.partitionBy(*keys, "k", "metric", "mi")
    ranked = mi.withColumn("__r", F.rank().over(W.partitionBy(*keys, "k", "metric").orderBy("mi")) + (F.count(F.lit(1)).over(w) - 1) / 2.0)      # a table of parameters, not rows
    left = ranked.select(*keys, "metric", "parameter", "k", "__r")
    right = ranked.select(*keys, "metric", "parameter", F.col("k").alias("other_k"), F.col("__r").alias("__s"))
    both = keys_equal(left, right, [*keys, "metric", "parameter"]).where("k < other_k")
    return both.groupBy(*keys, "k", "other_k", "metric").agg(X.safe_corr("__r", "__s").alias("spearman"))


def ordered_parameters(mi: DataFrame, parameters: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All ``parameters`` in the order of their mean information, missing ones last, names breaking ties."""
    mean = mi.groupBy(*keys, "parameter").agg(F.avg("mi").alias("mean_mi"))
    rows = keys_equal(parameters, mean, [*keys, "parameter"], "left")
    place = W.partitionBy(*keys).orderBy(F.desc_nulls_last("mean_mi"), "parameter")        # a table of parameters, not rows
    return rows.withColumn("place", F.row_number().over(place).cast("bigint"))


def core_parameters(profiles: DataFrame, keys: Sequence[str] = (), cutoff: float = 0.7) -> DataFrame:
    """Parameters above the cutoff at every k, and at any k; profiles: (k, parameter, mean_strength)."""
    return profiles.groupBy(*keys, "parameter").agg(
        F.bool_and(F.col("mean_strength") > cutoff).alias("core"), (F.max("mean_strength") > cutoff).alias("ever_above"),
        F.min("mean_strength").alias("low"), F.max("mean_strength").alias("high"))


def mi_importance(mi: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and spread over metrics after scaling each metric by its largest value."""
    w = W.partitionBy(*keys, "metric")
    unit = F.try_divide(F.col("mi"), F.nullif(F.max("mi").over(w), F.lit(0.0)))
    return mi.withColumn("__u", unit).groupBy(*keys, "parameter").agg(F.avg("__u").alias("mean_mi"), F.stddev_pop("__u").alias("std_mi"))


def rank_table(scores: DataFrame, keys: Sequence[str], score: str, columns: str, names: Sequence) -> DataFrame:
    """Dense ranks per column value, one column each."""
    w = W.partitionBy(*keys, columns).orderBy(F.desc(score))
    ranked = scores.withColumn("__r", F.dense_rank().over(w).cast("bigint"))
    return ranked.groupBy(*keys, "parameter").pivot(columns, list(names)).agg(F.max("__r"))


def compare_ranks(left: DataFrame, right: DataFrame, keys: Sequence[str], score_l: str, score_r: str) -> DataFrame:
    """Ordinal ranks of two score tables side by side and their difference."""
    def ranked(df, s, name):
        w = W.partitionBy(*keys).orderBy(F.desc(s), F.col("parameter"))
        return df.select(*keys, "parameter", F.row_number().over(w).cast("bigint").alias(name))
    j = keys_equal(ranked(left, score_l, "rank_left"), ranked(right, score_r, "rank_right"), [*keys, "parameter"])
    return j.withColumn("difference", F.col("rank_left") - F.col("rank_right"))


def rank_agreement(compared: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman of the ranks, number of moved parameters and whether the top one is the same."""
    return compared.groupBy(*keys).agg(
        X.safe_corr("rank_left", "rank_right").alias("rho"), F.count_if(F.col("difference") != 0).alias("moved"),
        F.bool_or((F.col("rank_left") == 1) & (F.col("rank_right") == 1)).alias("same_top"))


def stable_parameters(ranks: DataFrame, keys: Sequence[str], levels: Sequence, tolerance: int = 1) -> DataFrame:
    """Parameters whose rank moves at most ``tolerance`` over all levels; one that misses a level is not stable."""
    out = ranks.groupBy(*keys, "parameter").agg(F.min("rank").alias("__lo"), F.max("rank").alias("__hi"), F.count_distinct("level").alias("__n"))
    return out.select(*keys, "parameter", ((F.col("__n") >= len(levels)) & (F.col("__hi") - F.col("__lo") <= tolerance)).alias("stable"))


# --- suitability ----------------------------------------------------------------------------------------

def normality(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Jarque-Bera statistic with its chi-square(2) p-value."""
    n = F.count(value)
    out = long.groupBy(*keys).agg(n.alias("n"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.pow("skewness", F.lit(2.0)) + F.pow("kurtosis", F.lit(2.0)) / 4)
    return out.withColumn("statistic", jb).withColumn("p_value", F.exp(-F.col("statistic") / 2)).withColumn("is_normal", F.col("p_value") > 0.05)


def kolmogorov_normality(long: DataFrame, keys: Sequence[str], value: str = "value", bound: int | None = None) -> DataFrame:
    """Largest gap between the running share of the rows and the normal curve with the group's own mean and deviation.

    The p-value is that of the limiting distribution. Nulls are left out; a group without spread has no statistic.
    """
    data = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    counted = running(value_counts(data, keys, "__v"), keys, ["__v"], number=None, sums={"__upto": F.col("copies")}, bound=bound)
    facts = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("__v").alias("__m"), F.stddev_pop("__v").alias("__s"))
    curve = keys_equal(counted, facts, keys).withColumn("__f", X.normal_below(F.try_divide(F.col("__v") - F.col("__m"), F.col("__s"))))
    gap = F.greatest(F.col("__upto") / F.col("n") - F.col("__f"), F.col("__f") - (F.col("__upto") - F.col("copies")) / F.col("n"))
    out = curve.groupBy(*keys).agg(F.first("n").alias("n"), F.max(F.when(F.col("__s") > 0, gap)).alias("statistic"))
    t = F.col("n") * F.col("statistic") * F.col("statistic")
    # the alternating series converges fast for large t; for small t its mirror form does
    tail = 2 * sum(((-1.0) ** (k - 1) * F.exp(-2.0 * k * k * t) for k in range(1, 9)), F.lit(0.0))
    body = F.sqrt(F.lit(2 * math.pi) / t) * sum((F.exp(-((2 * k - 1) ** 2) * math.pi ** 2 / (8 * t)) for k in range(1, 9)), F.lit(0.0))
    p = F.when(t < 0.3, 1 - body).otherwise(tail)
    return out.withColumn("p_value", F.when(t > 0, F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))).when(t == 0, F.lit(1.0))).withColumn("is_normal", F.col("p_value") > 0.05)


# Royston's polynomials (1995) for the coefficients and the p-value of the Shapiro-Wilk statistic.
_SW_FIRST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_SW_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SW_SMALL = ((-2.273, 0.459), (0.5440, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322))
_SW_LARGE = ((-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302))
#: Largest sample that the Shapiro-Wilk approximation covers.
MOST_SHAPIRO = 5000


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """Statistic and p-value of a sample of 3 to 5000 values; a sample without spread has statistic 1 and p-value 1."""
    from statistics import NormalDist

    x = np.sort(values)
    n, half = len(x), len(x) // 2
    spread = float(((x - x.mean()) ** 2).sum())
    if x[0] == x[-1]:
        return 1.0, 1.0

    def poly(c, t):
        return sum(v * t ** i for i, v in enumerate(c))

    scores = np.array([NormalDist().inv_cdf((i + 0.625) / (n + 0.25)) for i in range(half)])
    if n == 3:
        a = np.array([math.sqrt(0.5)])
    else:
        total = 2 * float((scores ** 2).sum())
        near = [poly(_SW_FIRST, n ** -0.5) - scores[0] / math.sqrt(total)]
        if n > 5:
            near.append(poly(_SW_SECOND, n ** -0.5) - scores[1] / math.sqrt(total))
        fixed = len(near)
        rest = math.sqrt((total - 2 * float((scores[:fixed] ** 2).sum())) / (1 - 2 * sum(v * v for v in near)))
        a = np.concatenate([near, -scores[fixed:] / rest])
    w = min(float((a * (x[::-1][:half] - x[:half])).sum()) ** 2 / spread, 1.0)
    if n == 3:
        return w, max(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        edge = poly(_SW_SMALL[0], n)
        if y >= edge:
            return w, 0.0
        y, mean, sd = -math.log(edge - y), poly(_SW_SMALL[1], n), math.exp(poly(_SW_SMALL[2], n))
    else:
        mean, sd = poly(_SW_LARGE[0], math.log(n)), math.exp(poly(_SW_LARGE[1], math.log(n)))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))


def shapiro_normality(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Shapiro-Wilk statistic of the groups with 3 to ``MOST_SHAPIRO`` values; larger and smaller groups are left out."""
    data = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    size = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n").between(3, MOST_SHAPIRO))
    types = {f.name: f.dataType.simpleString() for f in data.schema.fields}
    names, own = list(keys), shapiro_wilk

    def run(pdf):
        w, p = own(pdf["__v"].to_numpy(float))
        return pdf[names].iloc[:1].assign(n=len(pdf), statistic=w, p_value=p)

    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "n bigint, statistic double, p_value double"
    return keys_equal(data, size, keys).groupBy(*keys).applyInPandas(run, schema).withColumn("is_normal", F.col("p_value") > 0.05)


def normality_tests(long: DataFrame, keys: Sequence[str], value: str = "value", bound: int | None = None) -> DataFrame:
    """Shapiro-Wilk for groups of at most ``MOST_SHAPIRO`` rows, Kolmogorov-Smirnov for the others."""
    small = shapiro_normality(long, keys, value).withColumn("test", F.lit("Shapiro-Wilk"))
    large = kolmogorov_normality(long, keys, value, bound).where(F.col("n") > MOST_SHAPIRO).withColumn("test", F.lit("Kolmogorov-Smirnov"))
    return small.unionByName(large)


def linearity(df: DataFrame, ident: Sequence[str], parameters, metrics, keys: Sequence[str] = ()) -> DataFrame:
    p = cross_correlation(df, parameters, metrics, keys).select(*keys, "parameter", "metric", F.col("r").alias("pearson"))
    s = spearman(df, ident, parameters, metrics, keys).select(*keys, "parameter", "metric", F.col("r").alias("spearman"))
    j = keys_equal(p, s, [*keys, "parameter", "metric"])
    score = F.abs("pearson") / (F.abs("spearman") + 1e-10)
    return j.withColumn("linearity", score).withColumn("is_linear", (score > 0.8) & (F.abs(F.col("pearson") - F.col("spearman")) < 0.2))


def sample_size(df: DataFrame, features: int, keys: Sequence[str] = ()) -> DataFrame:
    n = F.count(F.lit(1))
    need_g, need_k = max(30, 5 * features), max(50, 10 * features)
    return df.groupBy(*keys).agg(n.alias("n_samples"), (n >= need_g).alias("adequate_for_gaussian"), (n >= need_k).alias("adequate_for_ksg"),
                                 F.when(n >= need_k, "Good").when(n >= need_g, "Limited").otherwise("Insufficient").alias("adequacy"))


# --- prior to posterior ------------------------------------------------------------------------------------

def parameter_shifts(prior: DataFrame, posterior: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean shift, standardised and relative shift, uncertainty reduction, variance ratio and Gaussian divergence."""
    a = prior.groupBy(*keys).agg(F.avg("value").alias("m0"), F.stddev_samp("value").alias("s0"))
    b = posterior.groupBy(*keys).agg(F.avg("value").alias("m1"), F.stddev_samp("value").alias("s1"))
    shift, ratio = F.col("m1") - F.col("m0"), F.try_divide(F.pow("s1", F.lit(2.0)), F.pow("s0", F.lit(2.0)))
    kl = F.ln(F.try_divide(F.col("s0"), F.col("s1"))) + F.try_divide(F.pow("s1", F.lit(2.0)) + shift * shift, 2 * F.pow("s0", F.lit(2.0))) - 0.5
    return keys_equal(a, b, keys).select(
        *keys, F.col("m0").alias("prior_mean"), F.col("m1").alias("posterior_mean"), shift.alias("mean_shift"),
        F.try_divide(shift, F.col("s0")).alias("standardised_shift"), F.try_divide(shift, F.abs("m0")).alias("relative_shift"),
        (1 - F.try_divide(F.col("s1"), F.col("s0"))).alias("uncertainty_reduction"), ratio.alias("variance_ratio"), kl.alias("kl_divergence"))


def correlation_change(prior: DataFrame, posterior: DataFrame, columns: Sequence[str]) -> DataFrame:
    a, b = (correlation_matrix(d, columns).select("a", "b", F.col("r").alias(n)) for d, n in ((prior, "r_prior"), (posterior, "r_posterior")))
    return a.join(b, ["a", "b"]).withColumn("change", F.abs(F.col("r_posterior") - F.col("r_prior")))


def linear_sensitivity(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """First-order share of each parameter in the variance of a linear output."""
    y = sum((F.col(p) * float(b) for p, b in coefficients.items()), F.lit(0.0))
    total = F.var_pop(y)
    cells = [F.struct(F.lit(p).alias("parameter"), F.try_divide(F.var_pop(F.col(p) * float(b)), total).alias("sensitivity")) for p, b in coefficients.items()]
    return df.agg(F.array(*cells).alias("__c")).select(F.explode("__c").alias("__c")).select("__c.*")


def combined_importance(shifts: DataFrame, parts: dict[str, float]) -> DataFrame:
    """Weighted sum of min-max scaled score columns (one row per parameter)."""
    w = W.partitionBy(F.lit(1))
    total = F.lit(0.0)
    for c, weight in parts.items():
        lo, hi = F.min(F.abs(c)).over(w), F.max(F.abs(c)).over(w)
        total = total + float(weight) * F.coalesce(F.try_divide(F.abs(c) - lo, F.nullif(hi - lo, F.lit(0.0))), F.lit(0.0))
    return shifts.withColumn("combined", total)


def importance_share(scores: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    return scores.withColumn("share", F.col(score) / F.sum(score).over(W.partitionBy(*keys)))
