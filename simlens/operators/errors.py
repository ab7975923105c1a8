"""Distances to targets, error reports and comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from simlens.functions import exprs as X
from simlens.operators.clean import fence, flag_outliers, melt
from simlens.operators.ordered import attach, keys_equal, medians, quantiles, running, value_ranks
from simlens.session import literal_table


def with_targets(long: DataFrame, targets: DataFrame, name: str = "metric") -> DataFrame:
    """Long metric rows beside their target (targets: one row per metric)."""
    return long.join(targets, name)


# --- rejection -----------------------------------------------------------------------------------

def normalisation_factors(long: DataFrame, static: dict[str, float] | None = None) -> DataFrame:
    """Per metric: the static factor, else the observed range, else 1."""
    static = static or {}
    span = long.groupBy("metric").agg((F.max("value") - F.min("value")).alias("span"))
    fixed = F.lit(None).cast("double")
    for m, f in static.items():
        fixed = F.when(F.col("metric") == m, F.lit(float(f))).otherwise(fixed)
    return span.select("metric", F.coalesce(fixed, F.when(F.col("span") > 0, F.col("span")), F.lit(1.0)).alias("norm"))


def rejection(long: DataFrame, targets: DataFrame, keys: Sequence[str], epsilon: float, strict: bool = True,
              static: dict[str, float] | None = None) -> DataFrame:
    """Weighted normalised L1 distance per particle and its acceptance."""
    weighed = targets.select("metric", "target", F.coalesce("weight", F.lit(1.0)).alias("weight")) \
        if "weight" in targets.columns else targets.select("metric", "target", F.lit(1.0).alias("weight"))
    wanted = with_targets(long, weighed)
    factors = normalisation_factors(wanted, static)
    terms = wanted.join(factors, "metric")
    distance = (F.sum(F.abs(F.col("value") - F.col("target")) / F.col("norm") * F.col("weight")) / F.sum("weight"))
    out = terms.groupBy(*keys).agg(distance.alias("distance"))
    accepted = F.col("distance") < epsilon if strict else F.col("distance") <= epsilon
    return out.withColumn("accepted", accepted)


# --- distances per sample --------------------------------------------------------------------------

def distances(df: DataFrame, targets: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Six distances of each row to the target; ``keys`` are groups with their own scaler and covariance.

    The scaler counts the target as one more row. The inverse covariance is one small matrix per group.
    """
    names = list(targets)
    d = {m: F.col(m) - F.lit(float(t)) for m, t in targets.items()}
    moments = [F.count(F.lit(1)).alias("__n")]
    for m, t in targets.items():
        moments += [F.avg(d[m]).alias(f"__m_{m}"), F.var_pop(m).alias(f"__v_{m}")]
    moments += [F.covar_samp(a, b).alias(f"__c_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    stats = df.groupBy(*keys).agg(*moments)
    size = len(names)

    def invert(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                c = np.array([[r[f"__c_{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], dtype=float)
                try:
                    rows.append(np.linalg.inv(c).ravel().tolist() if np.isfinite(c).all() else None)
                except np.linalg.LinAlgError:
                    rows.append(None)
            pdf["__inv"] = rows
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields) + ", `__inv` array<double>"
    stats = stats.mapInPandas(invert, schema)
    joined = keys_equal(df, stats, keys)
    n = F.col("__n")
    standard = {}
    for m in names:
        # population variance of n rows plus the target row
        var = (n * F.col(f"__v_{m}") / (n + 1)) + n * F.pow(F.col(f"__m_{m}"), F.lit(2.0)) / F.pow(n + 1.0, F.lit(2.0))
        standard[m] = F.try_divide(d[m], F.sqrt(F.when(var > 0, var).otherwise(F.lit(1.0))))

    def norm(parts):
        return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    rel = {m: d[m] / F.lit(max(abs(float(t)), 1e-10)) for m, t in targets.items()}
    quad = F.lit(0.0)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            quad = quad + d[a] * d[b] * F.element_at("__inv", i * size + j + 1)
    return joined.select(
        *df.columns,
        norm(d.values()).alias("euclidean_raw"),
        norm([rel[m] for m in names]).alias("euclidean_normalized"),
        norm(standard.values()).alias("euclidean_standardized"),
        sum((F.abs(x) for x in d.values()), F.lit(0.0)).alias("manhattan_raw"),
        (sum((rel[m] * 100 for m in names), F.lit(0.0)) / size).alias("relative_error_mean"),
        F.sqrt(quad).alias("mahalanobis"))


DISTANCES = ("euclidean_raw", "euclidean_normalized", "euclidean_standardized", "manhattan_raw", "mahalanobis")


def distance_summary(df: DataFrame, targets: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    long = melt(distances(df, targets, keys), keys, DISTANCES, "distance", "value")
    base = long.groupBy(*keys, "distance").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return keys_equal(base, medians(long, [*keys, "distance"], "value"), [*keys, "distance"])


def best_sample(df: DataFrame, targets: dict[str, float], ident: str, keys: Sequence[str] = (), include_target: bool = False) -> DataFrame:
    """Row with the least standardised distance to the target, ties by id."""
    if include_target:
        scored = distances(df, targets, keys).withColumn("__d", F.col("euclidean_standardized"))
    else:
        scored = attach(df, keys, **{f"__s_{m}": F.stddev_pop(m) for m in targets})
        total = F.lit(0.0)
        for m, t in targets.items():
            sd = F.when(F.col(f"__s_{m}") > 0, F.col(f"__s_{m}")).otherwise(F.lit(1.0))
            total = total + F.pow((F.col(m) - float(t)) / sd, F.lit(2.0))
        scored = scored.withColumn("__d", F.sqrt(total))
    scored = scored.where(F.col("__d").isNotNull())
    key = F.struct(F.col("__d"), F.col(ident))
    best = scored.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), key).alias("__b"), F.min("__d").alias("distance"))
    rest = [c for c in df.columns if c not in keys]
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest], "distance")


# --- summaries per metric ----------------------------------------------------------------------------

def posterior_summary(long: DataFrame, truth: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, median, spread, central 95 % interval, bias and coverage of the true value."""
    base = long.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    q = quantiles(long, keys, value, [0.025, 0.5, 0.975], "__q")
    name = keys[-1]
    out = keys_equal(base, q, keys).join(truth, name)
    lo, hi = F.element_at("__q", 1), F.element_at("__q", 3)
    bias = F.col("mean") - F.col("true_value")
    return out.select(*keys, "mean", F.element_at("__q", 2).alias("median"), "std", lo.alias("ci_lo"), hi.alias("ci_hi"),
                      bias.alias("bias"),
                      F.when(F.col("true_value") != 0, F.try_divide(bias, F.col("true_value"))).otherwise(F.lit(X.INF)).alias("relative_bias"),
                      F.col("true_value").between(lo, hi).alias("in_ci"))


def metric_summary(long: DataFrame, targets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bias, squared and absolute error and coverage per metric."""
    joined = with_targets(long.where(F.col("value").isNotNull()), targets)
    group = [*keys, "metric"]
    base = joined.groupBy(*group).agg(
        F.first("target").alias("target"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.avg(X.squared_error("value", "target")).alias("mse"), F.avg(X.absolute_error("value", "target")).alias("mae"))
    q = quantiles(joined, group, "value", [0.025, 0.5, 0.975], "__q")
    lo, hi = F.element_at("__q", 1), F.element_at("__q", 3)
    bias = F.col("mean") - F.col("target")
    return keys_equal(base, q, group).select(
        *group, "target", "mean", "std", F.element_at("__q", 2).alias("median"), bias.alias("bias"), "mse", "mae",
        (bias / F.greatest(F.abs("target"), F.lit(1e-10)) * 100).alias("relative_bias_pct"),
        lo.alias("p025"), hi.alias("p975"), F.col("target").between(lo, hi).alias("target_in_interval"))


def generation_statistics(long: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments and quartiles of the value and of its signed percent error."""
    joined = with_targets(long.where(F.col("value").isNotNull()), targets)
    err = F.try_divide(F.col("value") - F.col("target"), F.col("target")) * 100
    group = [*keys, "metric"]
    out = joined.groupBy(*group).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg(err).alias("err_mean"), F.stddev_pop(err).alias("err_std"), F.min(err).alias("err_min"), F.max(err).alias("err_max"),
        F.first("target").alias("__t"))
    q = quantiles(joined, group, "value", [0.25, 0.75], "__q")
    joined = keys_equal(out, q, group)
    a, b = F.element_at("__q", 1), F.element_at("__q", 2)

    def to_err(v):
        return F.try_divide(v - F.col("__t"), F.col("__t")) * 100
    flip = F.col("__t") < 0     # a negative target reverses the order of the errors
    return joined.select(*group, "mean", "std", a.alias("q25"), b.alias("q75"), "min", "max", "err_mean", "err_std",
                         F.when(flip, to_err(b)).otherwise(to_err(a)).alias("err_q25"),
                         F.when(flip, to_err(a)).otherwise(to_err(b)).alias("err_q75"), "err_min", "err_max")


def fenced_metric_errors(long: DataFrame, targets: DataFrame, keys: Sequence[str], min_n: int = 0, guard_iqr: bool = True) -> DataFrame:
    """Fenced median of each metric and its absolute percent error."""
    group = [*keys, "metric"]
    kept = fence(with_targets(long.where(F.col("value").isNotNull()), targets.select("metric")), group, min_n=min_n, guard_iqr=guard_iqr)
    med = with_targets(medians(kept, group, "value"), targets)
    return med.select(*group, "median", X.absolute_percent_error("median", "target").alias("error_pct"))


def generation_error(long: DataFrame, targets: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Mean and spread over metrics of the fenced-median percent error."""
    per_metric = fenced_metric_errors(long, targets, keys, **options)
    return per_metric.groupBy(*keys).agg(F.avg("error_pct").alias("error_mean"), F.stddev_pop("error_pct").alias("error_std"))


def mean_error(long: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same on plain means, without a fence."""
    joined = with_targets(long.where(F.col("value").isNotNull()), targets)
    means = joined.groupBy(*keys, "metric").agg(F.avg("value").alias("m"), F.first("target").alias("t"))
    e = X.absolute_percent_error("m", "t")
    return means.groupBy(*keys).agg(F.avg(e).alias("error_mean"), F.stddev_pop(e).alias("error_std"))


def change_between(errors: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Change from the preceding generation (one row per generation and run)."""
    w = W.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    return errors.withColumn("change", F.col(value) - before).withColumn("change_pct", X.percent_change(F.col(value), before))


def mode_errors(modes: DataFrame, reference: DataFrame, targets: DataFrame, scaler: DataFrame, loss: str = "absolute") -> DataFrame:
    """Scaled error of each sample size's mode, next to the reference modes, in one min-max scale per metric.

    ``modes``: (n, metric, mode, std); ``reference``: (reference, metric, mode, std); scaler: (metric, lo, hi).
    """
    both = modes.select(F.col("n").cast("string").alias("label"), "metric", "mode", "std").unionByName(
        reference.select(F.col("reference").alias("label"), "metric", "mode", "std"))
    joined = both.join(scaler, "metric").join(targets, "metric")
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    a, b = (F.col("mode") - F.col("lo")) / width, (F.col("target") - F.col("lo")) / width
    err = X.squared_error(a, b) if loss == "squared" else X.absolute_error(a, b)
    return joined.select("label", "metric", err.alias("error"), (F.col("std") / width).alias("error_std"))


def arm_scores(long: DataFrame, targets: DataFrame, primary: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per arm: fenced-median errors averaged over primary and all targets, and the median seed spread.

    ``long`` holds target metrics and ``<metric>_std`` rows for the primary metrics.
    """
    group = [*keys, "metric"]
    kept = fence(long.where(F.col("value").isNotNull()), group)
    med = medians(kept, group, "value")
    direct = with_targets(med, targets).select(*keys, F.col("metric").alias("of"), X.absolute_percent_error("median", "target").alias("err"),
                                               F.lit(None).cast("double").alias("spread"))
    stds = med.where(F.col("metric").endswith("_std")).withColumn("metric", F.regexp_replace("metric", "_std$", ""))
    seed = with_targets(stds, targets).select(*keys, F.col("metric").alias("of"), F.lit(None).cast("double").alias("err"),
                                              (F.try_divide(F.col("median"), F.abs("target")) * 100).alias("spread"))
    is_primary = F.col("of").isin(list(primary))
    return direct.unionByName(seed).groupBy(*keys).agg(
        F.avg(F.when(is_primary, F.col("err"))).alias("primary_mae_pct"), F.avg("err").alias("all_target_mae_pct"),
        F.avg(F.when(is_primary, F.col("spread"))).alias("mean_seed_sd_pct"))


def selection_summary(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("arms"),
        F.avg("primary_mae_pct").alias("mean_primary_mae_pct"), F.stddev_samp("primary_mae_pct").alias("sd_primary_mae_pct"),
        F.avg("all_target_mae_pct").alias("mean_all_target_mae_pct"), F.stddev_samp("all_target_mae_pct").alias("sd_all_target_mae_pct"),
        F.avg("mean_seed_sd_pct").alias("mean_seed_sd_pct"))


def ranked_selections(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Selections in order of mean primary error, then its spread, then key (one row per selection)."""
    w = W.orderBy("mean_primary_mae_pct", "sd_primary_mae_pct", *keys)
    return selection_summary(scores, keys).withColumn("rank", F.row_number().over(w).cast("bigint"))


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows unchanged; the job fails when a key repeats."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    checked = counted.select(*keys, F.when(F.col("__n") > 1, F.raise_error(F.lit("key is not unique"))).alias("__bad"))
    return keys_equal(df, checked, keys).where(F.col("__bad").isNull()).drop("__bad")


def paired_methods(scores: DataFrame, pair_keys: Sequence[str], first: str, second: str, values: Sequence[str]) -> DataFrame:
    """One-to-one pairing of two methods with differences and a winner by the first value."""
    side = {m: F.col("method") == m for m in (first, second)}
    paired = scores.where(F.col("method").isin(first, second)).groupBy(*pair_keys).agg(
        *[F.count_if(side[m]).alias(f"__n_{m}") for m in (first, second)],
        *[F.max(F.when(side[m], F.col(v))).alias(f"{v}_{m}") for m in (first, second) for v in values])
    n = {m: F.col(f"__n_{m}") for m in (first, second)}
    repeated = F.when((n[first] > 1) | (n[second] > 1), F.raise_error(F.lit("a pair holds a method twice")).cast("boolean"))
    paired = paired.where(F.coalesce(repeated, (n[first] == 1) & (n[second] == 1))).drop(f"__n_{first}", f"__n_{second}")
    delta = {v: F.col(f"{v}_{second}") - F.col(f"{v}_{first}") for v in values}
    lead = delta[values[0]]
    return paired.select("*", *[e.alias(f"delta_{v}") for v, e in delta.items()],
                         F.when(lead < 0, second).when(lead > 0, first).otherwise("tie").alias("winner"))


def peak_comparison(paired: DataFrame, keys: Sequence[str], value: str, first: str, second: str) -> DataFrame:
    mean_a, mean_b = F.avg(f"{value}_{first}"), F.avg(f"{value}_{second}")
    out = paired.groupBy(*keys).agg(mean_a.alias("mean_first"), mean_b.alias("mean_second"),
                                    F.count_if(F.col("winner") == second).alias("second_wins"), F.count(F.lit(1)).alias("pairs"))
    delta = F.col("mean_second") - F.col("mean_first")
    return out.select(*keys, "mean_first", "mean_second", delta.alias("delta"),
                      (100 * F.try_divide(delta, F.nullif("mean_first", F.lit(0.0)))).alias("relative_change_pct"),
                      "second_wins", "pairs", F.when(delta < 0, second).when(delta > 0, first).otherwise("tie").alias("winner"))


def metric_records(long: DataFrame, targets: DataFrame, keys: Sequence[str], expected: DataFrame) -> DataFrame:
    """Record per expected (keys, metric): counts before and after a guarded fence, quartiles and errors, or why it is missing."""
    group = [*keys, "metric"]
    finite = long.where(F.col("value").isNotNull())
    flagged = flag_outliers(finite, group, min_n=4, guard_iqr=True)
    counts = flagged.groupBy(*group).agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(~F.col("outside")).alias("n_used"))
    q = quantiles(flagged.where(~F.col("outside")), group, "value", [0.25, 0.5, 0.75], "__q")
    rec = keys_equal(keys_equal(expected.select(*group), keys_equal(counts, q, group, "left"), group, "left"),
                     targets.select("metric", "target"), ["metric"], "left")
    runs = long.select(*keys).distinct().withColumn("__run", F.lit(True))
    columns = long.select(*group).distinct().withColumn("__column", F.lit(True))
    rec = keys_equal(keys_equal(rec, runs, keys, "left"), columns, group, "left")
    lo, mid, hi = (F.element_at("__q", i) for i in (1, 2, 3))
    reason = (F.when(F.col("__run").isNull(), "source_missing").when(F.col("__column").isNull(), "metric_missing")
              .when(F.col("n_used").isNull() | (F.col("n_used") == 0), "no_finite_values"))
    return rec.select(*group, "target", reason.isNull().alias("available"), reason.alias("missing_reason"),
                      "n_raw", "n_used", lo.alias("value_q25"), mid.alias("value_median"), hi.alias("value_q75"),
                      X.signed_percent_error(lo, "target").alias("signed_q25"),
                      X.signed_percent_error(mid, "target").alias("signed_median"),
                      X.signed_percent_error(hi, "target").alias("signed_q75"),
                      X.absolute_percent_error(mid, "target").alias("absolute_median"))


def record_summaries(records: DataFrame, model: str, peak: str) -> DataFrame:
    """Summaries per (model, peak), (model, metric) and model in one pass over the records."""
    ok = records.where("available")
    grouped = ok.groupingSets([[model, peak], [model, "metric"], [model]], model, peak, "metric")
    return grouped.agg(F.count(F.lit(1)).alias("records"), F.avg("signed_median").alias("mean_signed_error_pct"),
                       F.avg("absolute_median").alias("mean_absolute_error_pct"))


def padded_ranges(long: DataFrame, keys: Sequence[str], pad: float = 0.05, targets: DataFrame | None = None) -> DataFrame:
    """Axis range per metric with padding; centred on the target when targets are given."""
    out = long.groupBy(*keys).agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    margin = F.when(F.col("mx") > F.col("mn"), (F.col("mx") - F.col("mn")) * pad).otherwise(F.lit(1.0))
    lo, hi = F.col("mn") - margin, F.col("mx") + margin
    if targets is None:
        return out.select(*keys, lo.alias("lo"), hi.alias("hi"))
    half = F.greatest(F.abs(hi - F.col("target")), F.abs(F.col("target") - lo))
    return with_targets(out, targets).select(*keys, (F.col("target") - half).alias("lo"), (F.col("target") + half).alias("hi"))


def total_error(errors: DataFrame, keys: Sequence[str], value: str = "error", ci: str = "ci") -> DataFrame:
    """Equal-weight total over metrics with the propagated interval half-width."""
    n = F.count(F.lit(1))
    return errors.groupBy(*keys).agg(F.avg(value).alias("total_error"),
                                     (F.sqrt(F.sum(F.col(ci) * F.col(ci))) / n).alias("total_ci"), F.sum(value).alias("summed_error"))


def size_errors(values: DataFrame, centres: DataFrame, references: DataFrame, targets: DataFrame, size: str = "size") -> DataFrame:
    """Normalised error of each sample size and of named references, on one scale per metric.

    ``values`` (size, metric, value) are the samples, ``centres`` (size, metric, centre, spread) their summaries, ``references``
    (source, metric, centre, spread) others such as prior and default. The scale maps the absolute errors of the largest
    sample to [0, 1]; a metric without any range keeps its errors. Result: (source, size, metric, error, error_spread).
    """
    largest = values.groupBy("metric").agg(F.max(size).alias(size))
    scale = (with_targets(values.join(largest, ["metric", size], "left_semi"), targets.select("metric", "target"))
             .groupBy("metric").agg(F.min(F.abs(F.col("value") - F.col("target"))).alias("__lo"), F.max(F.abs(F.col("value") - F.col("target"))).alias("__hi"), F.first("target").alias("target")))
    rows = (centres.select(F.lit("posterior").alias("source"), size, "metric", "centre", "spread")
            .unionByName(references.select("source", F.lit(None).cast(centres.schema[size].dataType).alias(size), "metric", "centre", "spread")))
    span = F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(F.lit(1.0))
    return rows.join(scale, "metric").select("source", size, "metric", ((F.abs(F.col("centre") - F.col("target")) - F.col("__lo")) / span).alias("error"), (F.col("spread") / span).alias("error_spread"))


def final_size_errors(long: DataFrame, targets: DataFrame, keys: Sequence[str] = ("size",), generation: str = "gen") -> DataFrame:
    """Percent error of the metric means in the last generation of each size, with its half-width and the totals over metrics."""
    last = long.groupBy(*keys).agg(F.max(generation).alias(generation))
    held = long.where(F.col("value").isNotNull()).join(last, [*keys, generation], "left_semi")
    per = with_targets(held.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")), targets.select("metric", "target"))
    errors = per.select(*keys, "metric", X.absolute_percent_error("mean", "target").alias("error"), (F.col("sd") / F.col("target") * 100).alias("ci"))
    return keys_equal(errors, total_error(errors, keys), list(keys))


def error_contribution(long: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = with_targets(long.where(F.col("value").isNotNull()), targets)
    return joined.groupBy(*keys, "metric").agg(F.avg(X.absolute_percent_error("value", "target")).alias("contribution_pct"))


def best_summed_error(long: DataFrame, targets: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Metric-wise errors of the sample with the least summed absolute percent error, per group."""
    joined = with_targets(long.where(F.col("value").isNotNull()), targets).withColumn("error_pct", X.absolute_percent_error("value", "target"))
    totals = joined.groupBy(*keys, ident).agg(F.sum("error_pct").alias("summed"))
    best = totals.groupBy(*keys).agg(F.min_by(ident, F.struct("summed", ident)).alias(ident))
    return keys_equal(joined.select(*keys, ident, "metric", "error_pct"), best, [*keys, ident])


#: Scenarios that a pairwise comparison may have; more are refused, none are dropped.
MOST_SCENARIOS = 200


def scenario_tests(long: DataFrame, keys: Sequence[str], scenario: str, value: str, bound: int | None = None) -> DataFrame:
    """Two-sided Mann-Whitney test of every scenario pair with tie correction and a Bonferroni cut.

    Works on value counts: the rank sum of a pair comes from running counts over the distinct values of both
    scenarios, so no row is paired with another row. The number of scenarios is small (one per run compared).
    """
    present = long.where(F.col(value).isNotNull())
    counts = present.groupBy(*keys, scenario, value).agg(F.count(F.lit(1)).alias("c"))
    names = [r[0] for r in present.select(scenario).distinct().orderBy(scenario).limit(MOST_SCENARIOS + 1).collect()]
    if len(names) > MOST_SCENARIOS:
        raise ValueError(f"more than {MOST_SCENARIOS} scenarios to compare pair by pair")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    table = literal_table(
        present.sparkSession, [(a, b, s) for a, b in pairs for s in (a, b)], f"first {_type(long, scenario)}, second {_type(long, scenario)}, __s {_type(long, scenario)}")
    placed = counts.join(F.broadcast(table), F.col(scenario) == F.col("__s")).drop("__s")
    group = [*keys, "first", "second"]
    merged = placed.groupBy(*group, value).agg(
        F.sum(F.when(F.col(scenario) == F.col("first"), F.col("c")).otherwise(0)).alias("c1"), F.sum("c").alias("copies"))
    ranked = running(merged, group, [value], number=None, sums={"__cum": F.col("copies")}, bound=bound)
    avg_rank = F.col("__cum") - (F.col("copies") - 1) / 2.0
    t = F.col("copies").cast("double")
    sums = ranked.groupBy(*group).agg(
        F.sum(F.col("c1") * avg_rank).alias("r1"), F.sum("c1").cast("double").alias("n1"), F.sum("copies").cast("double").alias("n"),
        F.sum(t * t * t - t).alias("ties"))
    n1, n, n2 = F.col("n1"), F.col("n"), F.col("n") - F.col("n1")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.abs(u - n1 * n2 / 2) - 0.5, sd)
    out = sums.select(*group, u.alias("u"), F.greatest(z, F.lit(0.0)).alias("z"))
    out = out.withColumn("p", X.normal_two_sided_p("z"))
    return out.withColumn("significant", F.col("p") < 0.05 / max(len(pairs), 1))


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def pairwise_metrics(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Correlation and straight line for every ordered metric pair, one aggregation over the rows."""
    pairs = [(a, b) for a in columns for b in columns if a != b]
    agg = df.groupBy(*keys).agg(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), X.pair_corr(a, b).alias("r"),
                 F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept")) for a, b in pairs]).alias("p"))
    return agg.select(*keys, F.explode("p").alias("p")).select(*keys, "p.*")


def ranks_of_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return value_ranks(df, keys, value)
