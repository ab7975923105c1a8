"""Projections, filters, fences, scalers and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simlens.functions import exprs as X
from simlens.operators.ordered import attach, keys_equal, quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def id_column(df: DataFrame, metric: str, name: str | None = None) -> str:
    """Identifying column by precedence: the caller's choice, the usual name, a lone companion of the metric, the short name."""
    present = set(df.columns)
    companions = sorted(present - {metric, "states"})
    ranked = [name] if name is not None else ["input_folder", companions[0] if len(companions) == 1 else None, "folder"]
    usable = [c for c in ranked if c in present]
    if not usable:
        raise KeyError(f"no identifying column: tried {[c for c in ranked if c]}")
    return usable[0]


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long, values as doubles with NaN and infinities set to NULL."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keys), list(columns), name, value).withColumn(value, X.finite(value))


def round_metrics(df: DataFrame, digits: int = 3) -> DataFrame:
    return df.withColumns({c: F.bround(c, digits) for c in float_columns(df)})


def _spread(df: DataFrame, columns: Sequence[str], **aggregates):
    """One row of per-column aggregates on the driver (columns, not rows, set its size)."""
    return df.agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in aggregates.items()]).first()


def drop_constant_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drops columns with exactly one distinct non-null value; all-null columns stay."""
    columns = [c for c in df.columns if c not in keep]
    row = _spread(df, columns, lo=F.min, hi=F.max)
    constant = [c for c in columns if row[f"{c}__lo"] is not None and row[f"{c}__lo"] == row[f"{c}__hi"]]
    return df.drop(*constant)


def varying_columns(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1e-10) -> list[str]:
    columns = numeric_columns(df) if columns is None else list(columns)
    row = _spread(df, columns, sd=F.stddev_samp)
    return [c for c in columns if row[f"{c}__sd"] is not None and row[f"{c}__sd"] > threshold]


def drop_invalid_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keeps rows whose every listed column is present and finite."""
    condition = None
    for c in columns:
        ok = X.finite(c).isNotNull()
        condition = ok if condition is None else condition & ok
    return df.where(condition)


def count_valid_seeds(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Means over the replicates that are valid in every metric, and their number."""
    valid = drop_invalid_rows(df, columns)
    return valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("seed_count"), *[F.avg(c).alias(c) for c in columns])


def fence_bounds(long: DataFrame, keys: Sequence[str], value: str = "value", multiplier: float = 1.5,
                 min_n: int = 0, guard_iqr: bool = False, bound: int | None = None) -> DataFrame:
    """Interquartile fence per group; an unguarded fence always applies, a guarded one opens when n or IQR is too small."""
    q = quantiles(long, keys, value, [0.25, 0.75], "__q", bound)
    q1, q3 = F.element_at("__q", 1), F.element_at("__q", 2)
    iqr = q3 - q1
    lo, hi = q1 - multiplier * iqr, q3 + multiplier * iqr
    if guard_iqr:
        lo, hi = F.when(iqr > 0, lo), F.when(iqr > 0, hi)
    out = q.select(*keys, lo.alias("fence_lo"), hi.alias("fence_hi"))
    if min_n:
        n = long.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        out = keys_equal(out, n, keys).select(
            *keys, *[F.when(F.col("__n") >= min_n, F.col(c)).alias(c) for c in ("fence_lo", "fence_hi")])
    return out


def flag_outliers(long: DataFrame, keys: Sequence[str], value: str = "value", **fence) -> DataFrame:
    """Long rows with ``outside``; NULL values and open fences are never outside."""
    joined = keys_equal(long, fence_bounds(long, keys, value, **fence), keys, "left")
    outside = (F.col(value) < F.col("fence_lo")) | (F.col(value) > F.col("fence_hi"))
    return joined.withColumn("outside", F.coalesce(outside, F.lit(False)))


def fence(long: DataFrame, keys: Sequence[str], value: str = "value", **options) -> DataFrame:
    return flag_outliers(long, keys, value, **options).where(~F.col("outside")).drop("fence_lo", "fence_hi", "outside")


def fence_rows(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5, keys: Sequence[str] = (),
               bound: int | None = None) -> DataFrame:
    """Drops rows with any listed column outside its own fence; missing values do not drop a row."""
    long = melt(df, keys, columns)
    bounds = fence_bounds(long, [*keys, "metric"], "value", multiplier, bound=bound)
    wide = bounds.groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == c, F.col(side))).alias(f"__{side}_{c}")
        for c in columns for side in ("fence_lo", "fence_hi")])
    joined = keys_equal(df, wide, keys, "left")
    outside = F.lit(False)
    for c in columns:
        outside = outside | F.coalesce((F.col(c) < F.col(f"__fence_lo_{c}")) | (F.col(c) > F.col(f"__fence_hi_{c}")), F.lit(False))
    return joined.where(~outside).select(*df.columns)


def outlier_report(long: DataFrame, keys: Sequence[str], value: str = "value", method: str = "iqr") -> DataFrame:
    if method == "iqr":
        flagged = flag_outliers(long.where(F.col(value).isNotNull()), keys, value)
    else:
        scored = attach(long.where(F.col(value).isNotNull()), keys, __m=F.avg(value), __s=F.stddev_pop(value))
        flagged = scored.withColumn("outside", F.coalesce(F.abs(F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))) > 3, F.lit(False)))
    share = F.avg(F.col("outside").cast("double")) * 100
    return flagged.groupBy(*keys).agg(F.count_if("outside").alias("n_outliers"), share.alias("outlier_percentage"),
                                      (share > 5).alias("has_many_outliers"))


def percentile_labels(df: DataFrame, metric: str, percentile: float = 10, keys: Sequence[str] = (),
                      bound: int | None = None) -> DataFrame:
    """Labels low, high or neither tail; a value in both tails is high."""
    if not 0 < percentile <= 50:
        raise ValueError("percentile must lie in (0, 50]")
    q = quantiles(df, keys, metric, [percentile / 100, 1 - percentile / 100], "__q", bound)
    joined = keys_equal(df, q, keys, "left")
    label = (F.when(F.col(metric) >= F.element_at("__q", 2), "high_metric")
             .when(F.col(metric) <= F.element_at("__q", 1), "low_metric").otherwise("not_assigned"))
    return joined.withColumn("percentile_label", label).drop("__q")


def out_of_box(df: DataFrame, keys: Sequence[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Particles with at least one parameter outside its range; fixed parameters are not checked."""
    checked = {p: r for p, r in ranges.items() if p in df.columns and r[0] != r[1]}
    outside = F.lit(False)
    for p, (lo, hi) in checked.items():
        outside = outside | F.coalesce((F.col(p) < lo) | (F.col(p) > hi), F.lit(False))
    return df.groupBy(*keys).agg(F.count_if(outside).alias("outside"), F.lit(len(checked)).alias("columns_checked"))


def to_prior_range(long: DataFrame, ranges: DataFrame, value: str = "value", clip: tuple[float, float] | None = None,
                   name: str = "parameter") -> DataFrame:
    """Long parameter rows placed in their prior range; parameters with an empty range are left out."""
    joined = long.join(ranges.where("hi <> lo"), name)
    return joined.withColumn("unit", X.to_unit(value, "lo", "hi", clip)).drop("lo", "hi")


def fit_scaler(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return long.groupBy(*keys).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))


def apply_scaler(long: DataFrame, scaler: DataFrame, keys: Sequence[str], value: str = "value", name: str = "z") -> DataFrame:
    """Z-scores with moments of another table; a zero spread only centres."""
    joined = keys_equal(long, scaler, keys)
    spread = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return joined.withColumn(name, (F.col(value) - F.col("mu")) / spread).drop("mu", "sd")


def fit_minmax(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return long.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def apply_minmax(long: DataFrame, scaler: DataFrame, keys: Sequence[str], value: str = "value", name: str = "scaled") -> DataFrame:
    joined = keys_equal(long, scaler, keys)
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    return joined.withColumn(name, (F.col(value) - F.col("lo")) / width).drop("lo", "hi")


def change_from_mean(long: DataFrame, reference: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Percent change of every value from the reference table's mean of the same key."""
    means = reference.groupBy(*keys).agg(F.avg(value).alias("reference_mean"))
    return keys_equal(long, means, keys).withColumn("change_pct", X.percent_change(value, "reference_mean"))


def split_family(long: DataFrame, dictionary: DataFrame, family: str, name: str = "parameter") -> DataFrame:
    """Rows of the parameters that the dictionary puts in one family."""
    return long.join(dictionary.where(F.col("family") == family).select(name), name, "left_semi")


def valid_samples(df: DataFrame, ranged: Sequence[str]) -> DataFrame:
    """Predicted samples without a negative value in a ranged column; missing values and ``*_r2`` are ignored."""
    condition: Column = F.lit(True)
    for c in ranged:
        if c in df.columns and not c.endswith("_r2"):
            condition = condition & F.coalesce(F.col(c) >= 0, F.lit(True))
    return df.where(condition)


def to_log(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.ln(c) for c in columns})


def from_log(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.exp(c) for c in columns})


def format_parameters(long: DataFrame, dictionary: DataFrame, name: str = "parameter", value: str = "value") -> DataFrame:
    """Clips each value as its dictionary row says (``bounded``) and rounds to ``digits``."""
    joined = long.join(dictionary, name)
    x = F.when(F.col("bounded"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value)))).otherwise(F.greatest(F.lit(0.0), F.col(value)))
    scale = F.pow(F.lit(10.0), F.col("digits"))
    return joined.withColumn("formatted", F.bround(x * scale, 0) / scale)
