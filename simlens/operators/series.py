"""Time series of simulated trajectories."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlens.functions import exprs as X
from simlens.operators.ordered import keys_equal, medians, quantiles, running, windowed
from simlens.operators.spectral import best_lag


def epidemic_statistics(series: DataFrame, keys: Sequence[str], time: str = "time", infected: str = "I", recovered: str = "R",
                        bound: int | None = None) -> DataFrame:
    """Peak, time of the first peak, final recovered, area over time and early log growth.

    ``time`` is unique inside a trajectory. The early part is the first fifth of its rows.
    """
    base = series.select(*keys, F.col(time).cast("double").alias("__t"), F.col(infected).cast("double").alias("__i"), F.col(recovered).alias("__r"))
    stepped = windowed(base, keys, ["__t"], 0, 1, lambda w: {
        "__t2": F.lead("__t").over(w), "__i2": F.lead("__i").over(w)}, bound=bound)
    out = stepped.groupBy(*keys).agg(
        F.max("__i").alias("peak_i"), F.min_by("__t", F.struct(-F.col("__i"), F.col("__t"))).alias("time_to_peak"),
        F.max_by("__r", "__t").alias("final_r"), F.count(F.lit(1)).alias("n_points"),
        F.coalesce(F.try_divide(F.sum((F.col("__i") + F.col("__i2")) / 2 * (F.col("__t2") - F.col("__t"))), F.max("__t") - F.min("__t")), F.lit(0.0)).alias("area_i"))
    numbered = running(base, keys, ["__t"], "__rn", bound=bound)
    early = keys_equal(numbered, out.select(*keys, "n_points"), keys)
    first = F.greatest(F.lit(2), F.floor(F.col("n_points") * 0.2))
    used = early.where((F.col("__rn") <= first) & (first > 2) & (F.col("n_points") > first))
    slope = used.groupBy(*keys).agg(F.regr_slope(F.ln(F.col("__i") + 1e-10), F.col("__t")).alias("__g"))
    joined = keys_equal(out, slope, keys, "left")
    return joined.withColumn("growth_rate", F.coalesce("__g", F.lit(0.0))).drop("__g")


def area_under(series: DataFrame, keys: Sequence[str], time: str, value: str, bound: int | None = None) -> DataFrame:
    """Trapezoid area over irregular times."""
    s = windowed(series.select(*keys, F.col(time).alias("__t"), F.col(value).alias("__v")), keys, ["__t"], 0, 1,
                 lambda w: {"__t2": F.lead("__t").over(w), "__v2": F.lead("__v").over(w)}, bound=bound)
    return s.groupBy(*keys).agg(F.sum((F.col("__v") + F.col("__v2")) / 2 * (F.col("__t2") - F.col("__t"))).alias("area"))


def local_peaks(series: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bound: int | None = None) -> DataFrame:
    """Rows strictly above both neighbours."""
    s = windowed(series, keys, order, 1, 1, lambda w: {"__a": F.lag(value).over(w), "__b": F.lead(value).over(w)}, bound=bound)
    return s.where((F.col("__a") < F.col(value)) & (F.col(value) > F.col("__b"))).drop("__a", "__b")


def two_species_statistics(series: DataFrame, keys: Sequence[str], order: Sequence[str], a: str, b: str, bound: int | None = None) -> DataFrame:
    """Moments, correlation and peak counts of two series, and the lag of their largest full cross-correlation."""
    s = windowed(series, keys, order, 1, 1, lambda w: {f"__{side}{v}": f(v).over(w) for v in (a, b) for side, f in (("p", F.lag), ("n", F.lead))}, bound=bound)

    def peaks(v):
        return F.count_if((F.col(f"__p{v}") < F.col(v)) & (F.col(v) > F.col(f"__n{v}"))).alias(f"{v}_peaks")
    parts = [e for v in (a, b) for e in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"), peaks(v))]
    out = s.groupBy(*keys).agg(*parts, X.safe_corr(a, b).alias("correlation"))
    return keys_equal(out, best_lag(series, keys, order, a, b, bound=bound), keys, "left")


def equilibrium_time(series: DataFrame, keys: Sequence[str], time: str, value: str, threshold: float = 0.05, span: int = 5,
                     bound: int | None = None) -> DataFrame:
    """First time whose preceding ``span`` values stay within ``threshold`` of their mean, else the last time."""
    s = windowed(series.select(*keys, F.col(time).alias("__t"), F.col(value).alias("__v")), keys, ["__t"], span, 0, lambda w: {
        "__n": F.count("__v").over(w.rowsBetween(-span, -1)), "__m": F.avg("__v").over(w.rowsBetween(-span, -1)),
        "__hi": F.max("__v").over(w.rowsBetween(-span, -1)), "__lo": F.min("__v").over(w.rowsBetween(-span, -1))}, bound=bound)
    off = F.greatest(F.col("__hi") - F.col("__m"), F.col("__m") - F.col("__lo"))
    wave = F.when(F.col("__m") == 0, F.greatest(F.abs("__hi"), F.abs("__lo"))).otherwise(F.try_divide(off, F.col("__m")))
    calm = (F.col("__n") == span) & (wave < threshold)
    return s.groupBy(*keys).agg(F.coalesce(F.min(F.when(calm, F.col("__t"))), F.max("__t")).alias("equilibrium_time"))


def nearest_in_time(series: DataFrame, keys: Sequence[str], time: str, target, columns: Sequence[str]) -> DataFrame:
    """Row whose time is nearest the target; the earlier one on ties."""
    key = F.struct(F.abs(F.col(time) - F.lit(target)), F.col(time))
    best = series.groupBy(*keys).agg(F.min_by(F.struct(time, *columns), key).alias("__b"))
    return best.select(*keys, "__b.*")


def on_grid(series: DataFrame, keys: Sequence[str], time: str, value: str, start: float, stop: float, step: float,
            right: float | None = 0.0, bound: int | None = None) -> DataFrame:
    """Linear interpolation on a common grid: each segment emits the grid points it covers.

    Before the first time the first value holds; past the last time ``right`` (or the last value when None).
    """
    s = windowed(series.select(*keys, F.col(time).cast("double").alias("__t"), F.col(value).cast("double").alias("__v")), keys, ["__t"], 1, 1,
                 lambda w: {"__t2": F.lead("__t").over(w), "__v2": F.lead("__v").over(w), "__p": F.lag("__t").over(w)}, bound=bound)
    last_index = int(math.floor((stop - start) / step + 1e-9))
    lo = F.greatest(F.lit(0), F.ceil((F.col("__t") - start) / step)).cast("int")
    at_end = F.col("__t2").isNull()
    hi = F.when(at_end, F.lit(last_index)).otherwise(F.least(F.lit(last_index), (F.ceil((F.col("__t2") - start) / step) - 1).cast("int")))
    begin = F.when(F.col("__p").isNull(), F.lit(0)).otherwise(lo)
    spread = s.withColumn("__lo", begin).withColumn("__hi", hi).where(F.col("__lo") <= F.col("__hi")) \
        .withColumn("__k", F.explode(F.sequence("__lo", "__hi")))
    g = F.lit(float(start)) + F.col("__k") * float(step)
    tail = F.col("__v") if right is None else F.when(g == F.col("__t"), F.col("__v")).otherwise(F.lit(float(right)))
    inside = F.col("__v") + (F.col("__v2") - F.col("__v")) * F.try_divide(g - F.col("__t"), F.col("__t2") - F.col("__t"))
    y = F.when(g <= F.col("__t"), F.col("__v")).when(at_end, tail).otherwise(inside)
    return spread.select(*keys, g.alias("time"), y.alias("value"))


def grid_quartiles(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    q = quantiles(grid, [*keys, "time"], "value", [0.25, 0.5, 0.75], "__q")
    n = grid.groupBy(*keys, "time").agg(F.count(F.lit(1)).alias("n"))
    return keys_equal(q, n, [*keys, "time"]).select(*keys, "time", *[F.element_at("__q", i + 1).alias(c) for i, c in enumerate(("q25", "median", "q75"))], "n")


def time_course(long: DataFrame, keys: Sequence[str], bound: int | None = None) -> DataFrame:
    """Quartiles over the replicates per key (mode, time, metric)."""
    q = quantiles(long, keys, "value", [0.25, 0.5, 0.75], "__q", bound)
    n = long.groupBy(*keys).agg(F.count("value").alias("n_seeds"))
    return keys_equal(q, n, keys).select(*keys, "n_seeds", *[F.element_at("__q", i + 1).alias(c) for i, c in enumerate(("q25", "median", "q75"))])


def kinetic_fit(points: DataFrame, keys: Sequence[str], time: str, value: str, log: bool) -> DataFrame:
    """Straight-line fit (of the logarithm when ``log``) with R² on the original scale."""
    y = F.ln(F.col(value)) if log else F.col(value)
    fit = points.groupBy(*keys).agg(F.regr_slope(y, F.col(time)).alias("slope"), F.regr_intercept(y, F.col(time)).alias("__a"),
                                    F.avg(value).alias("__mean"), F.count(F.lit(1)).alias("n_timepoints"))
    joined = keys_equal(points, fit, keys)
    line = F.col("__a") + F.col("slope") * F.col(time)
    predicted = F.exp(line) if log else line
    out = joined.groupBy(*keys).agg(
        F.first("slope").alias("slope"), F.first("__a").alias("__a"), F.first("n_timepoints").alias("n_timepoints"),
        (1 - F.try_divide(F.sum(F.pow(F.col(value) - predicted, F.lit(2.0))), F.sum(F.pow(F.col(value) - F.col("__mean"), F.lit(2.0))))).alias("r_squared"))
    intercept = F.exp("__a") if log else F.col("__a")
    out = out.withColumn("intercept", intercept).drop("__a")
    return out.withColumn("doubling_time_h", F.try_divide(F.lit(24.0 * math.log(2.0)), F.col("slope"))) if log else out


def fit_variability(points: DataFrame, keys: Sequence[str], seed: str, time: str, value: str, log: bool) -> DataFrame:
    """Population spread over replicates of the fitted doubling time (log) or slope."""
    y = F.ln(F.col(value)) if log else F.col(value)
    slopes = points.groupBy(*keys, seed).agg(F.regr_slope(y, F.col(time)).alias("__s"))
    x = F.try_divide(F.lit(24.0 * math.log(2.0)), F.col("__s")) if log else F.col("__s")
    return slopes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_seed_fits"), F.stddev_pop(x).alias("seed_fit_sd"))


def fits_with_variability(points: DataFrame, keys: Sequence[str], seed: str, time: str, value: str, log: bool) -> DataFrame:
    """Fit of each key's mean curve beside the spread of its replicates' fits."""
    curve = points.groupBy(*keys, time).agg(F.avg(value).alias(value))
    return keys_equal(kinetic_fit(curve, keys, time, value, log), fit_variability(points, keys, seed, time, value, log), list(keys))


def case_summary(long: DataFrame, keys: Sequence[str], spread: str = "std") -> DataFrame:
    """Centre with lower and upper end per case and metric: mean and sample deviation, or median and quartiles; non-finite values are left out."""
    finite = long.withColumn("value", X.finite("value")).where(F.col("value").isNotNull())
    if spread == "std":
        mean, sd = F.avg("value"), F.coalesce(F.stddev_samp("value"), F.lit(0.0))
        return finite.groupBy(*keys).agg(mean.alias("centre"), (mean - sd).alias("lower"), (mean + sd).alias("upper"), F.count(F.lit(1)).alias("n"))
    if spread != "iqr":
        raise ValueError("spread must be std or iqr")
    q = time_course(finite, keys)
    return q.select(*keys, F.col("median").alias("centre"), F.col("q25").alias("lower"), F.col("q75").alias("upper"), F.col("n_seeds").alias("n"))


def extinction_summary(draws: DataFrame, keys: Sequence[str], extinct: str, time: str) -> DataFrame:
    """Extinct share and the median extinction time of the extinct."""
    share = draws.groupBy(*keys).agg(F.avg(F.col(extinct).cast("double")).alias("fraction"), F.count(F.lit(1)).alias("n"))
    med = medians(draws.where(F.col(extinct).cast("int") == 1), keys, time, "median_time")
    return keys_equal(share, med, keys, "left")
