"""Importance weights: normalisation, effective size, weighted moments and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlens.functions import exprs as X
from simlens.operators.ordered import attach, keys_equal, running
from simlens.session import is_small, settled


def normalise(df: DataFrame, keys: Sequence[str], weight: str = "weight") -> DataFrame:
    """Weights scaled to sum 1 per group; a group without positive total fails."""
    total = attach(df, keys, __t=F.sum(weight))
    checked = F.when(F.col("__t") > 0, F.col(weight) / F.col("__t")).otherwise(F.raise_error(F.lit("weights sum to zero")).cast("double"))
    return total.withColumn(weight, checked).drop("__t")


def normalise_log(df: DataFrame, keys: Sequence[str], log_weight: str = "log_weight", weight: str = "weight") -> DataFrame:
    """Weights from logarithms: the group's largest logarithm is taken out before exponentiation."""
    shifted = attach(df, keys, __m=F.max(log_weight)).withColumn(weight, F.exp(F.col(log_weight) - F.col("__m"))).drop("__m")
    return normalise(shifted, keys, weight)


def align(particles: DataFrame, weights: DataFrame, ident: Sequence[str], keys: Sequence[str], weight: str = "weight") -> DataFrame:
    """Every particle with its weight, 0 where none is recorded, renormalised per group."""
    joined = keys_equal(particles, weights.select(*ident, weight), list(ident), "left").withColumn(weight, F.coalesce(weight, F.lit(0.0)))
    return normalise(joined, keys, weight)


def effective_size(df: DataFrame, keys: Sequence[str], weight: str = "weight") -> DataFrame:
    w = F.col(weight)
    ess = F.try_divide(F.pow(F.sum(w), F.lit(2.0)), F.sum(w * w))
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("n_particles"), ess.alias("ess"), (ess / n).alias("ess_fraction"),
                                 F.count_if(w > 0).alias("support"), F.max(w / 1.0).alias("max_weight"))


def weighted_geometry(df: DataFrame, keys: Sequence[str], columns: Sequence[str], weight: str = "weight",
                      reference: dict[str, float] | None = None) -> DataFrame:
    """Weighted centroid, trace of the weighted covariance and distance to a reference centroid.

    Squares are taken around the plain group means, so large offsets do not cancel.
    """
    w, total = F.col(weight), F.sum(weight)
    around = attach(df, keys, **{f"__m_{c}": F.avg(c) for c in columns})
    apart = {c: F.col(c) - F.col(f"__m_{c}") for c in columns}
    out = around.groupBy(*keys).agg(*[(F.first(f"__m_{c}") + F.try_divide(F.sum(w * e), total)).alias(f"centre_{c}") for c, e in apart.items()],
                                    *[(F.try_divide(F.sum(w * e * e), total) - F.pow(F.try_divide(F.sum(w * e), total), F.lit(2.0))).alias(f"__q_{c}") for c, e in apart.items()])
    trace = sum((F.col(f"__q_{c}") for c in columns), F.lit(0.0))
    out = out.withColumn("trace", F.greatest(trace, F.lit(0.0)))
    if reference:
        d2 = sum((F.pow(F.col(f"centre_{c}") - float(v), F.lit(2.0)) for c, v in reference.items()), F.lit(0.0))
        out = out.withColumn("centroid_shift", F.sqrt(d2))
    return out.drop(*[f"__q_{c}" for c in columns])


def spread_across(geometry: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return geometry.groupBy(*keys).agg(*[F.stddev_samp(c).alias(f"sd_{c}") for c in columns], F.count(F.lit(1)).alias("families"))


def weighted_errors(long: DataFrame, targets: DataFrame, keys: Sequence[str], weight: str = "weight") -> DataFrame:
    """Weighted and plain mean absolute percent error and the error of the weighted mean, averaged over metrics."""
    joined = long.where(F.col("value").isNotNull() & F.col(weight).isNotNull()).join(targets, "metric")
    e, w = X.absolute_percent_error("value", "target"), F.col(weight)
    per = joined.groupBy(*keys, "metric").agg(
        F.try_divide(F.sum(w * e), F.sum(w)).alias("wm"), F.avg(e).alias("pm"),
        F.try_divide(F.sum(w * F.col("value")), F.sum(w)).alias("mean"), F.first("target").alias("target"))
    return per.groupBy(*keys).agg(F.avg("wm").alias("weighted_mae"), F.avg("pm").alias("prior_mae"),
                                  F.avg(X.absolute_percent_error("mean", "target")).alias("predictive_mean_error"))


def resample(df: DataFrame, n: int, seed: int, ident: str, keys: Sequence[str] = (), weight: str = "weight",
             draw: str = "draw", bound: int | None = None, uniforms: DataFrame | None = None) -> DataFrame:
    """Weighted draws with replacement: draw i takes the particle whose slice of [0, total) holds its uniform.

    Particles and uniforms of a group are put in one order and a running count of uniforms tells how many fall
    into each slice, so a slice with a third of all draws is repeated row by row, never joined pair by pair.
    ``uniforms``: optional (keys, draw, u) table; otherwise u is a hash of seed, group and draw.
    """
    # weights become whole numbers of 2^-52 of the group's largest power of two: their sums are exact in any order
    df = settled(df)
    known = attach(df, keys, __top=F.max(weight))
    usable = F.when(F.col("__top") > 0, F.col(weight) > 0).otherwise(F.raise_error(F.lit("weights sum to zero")).cast("boolean"))
    unit = F.pow(F.lit(2.0), F.floor(F.log2("__top")) - 52)
    positive = known.where(usable).withColumn("__w", F.round(F.col(weight) / unit).cast("decimal(20,0)")).drop("__top")
    slices = running(positive, keys, [ident], number=None, sums={"__hi": F.col("__w")}, bound=bound)
    slices = attach(slices, keys, __t=F.sum("__w"), __last=F.max(ident)).withColumn(
        "__pos", F.when(F.col(ident) == F.col("__last"), F.lit(2.0)).otherwise(F.col("__hi").cast("double") / F.col("__t").cast("double")))
    spark = df.sparkSession
    if uniforms is None:
        ids = spark.range(n).withColumnRenamed("id", draw)
        if keys:
            groups = positive.select(*keys).distinct()
            ids = groups.withColumn(draw, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
        uniforms = ids.withColumn("u", X.uniform(seed, *keys, draw))
    # Both sides in one order; the first slice end above a uniform is its particle.
    s = slices.select(*keys, F.col("__pos"), F.lit(0).alias("__side"), F.col(ident).alias("__id"), F.lit(None).cast("bigint").alias(draw))
    u = uniforms.select(*keys, F.col("u").alias("__pos"), F.lit(1).alias("__side"), F.lit(None).cast(df.schema[ident].dataType).alias("__id"), draw)
    chosen = next_value(s.unionByName(u), keys, ["__pos", "__side", "__id", draw], "__id", bound).where(F.col("__side") == 1)
    picked = chosen.select(*keys, draw, F.col("__id").alias(ident))
    return keys_equal(picked, df, [*keys, ident])


def next_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bound: int | None = None) -> DataFrame:
    """Fills NULLs of ``value`` with the next non-null value in the group's order (backward fill).

    Rows are taken from the end: Spark carries a frame that grows on from row to row, but reads one that shrinks anew for each row.
    """
    from pyspark.sql.window import Window as W
    from simlens.operators.ordered import _ranges
    if is_small(df, bound):
        w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(value, F.last(value, ignorenulls=True).over(w))
    split = _ranges(settled(df), keys, order)
    heads = split.where(F.col(value).isNotNull()).groupBy(*keys, "__range").agg(
        F.min_by(value, F.struct(*order)).alias("__head"))
    spans = split.select(*keys, "__range").distinct()
    later = W.partitionBy(*keys).orderBy("__range").rowsBetween(1, W.unboundedFollowing)
    carry = keys_equal(spans, heads, [*keys, "__range"], "left").withColumn("__carry", F.first("__head", ignorenulls=True).over(later))
    joined = keys_equal(split, carry.drop("__head"), [*keys, "__range"])
    w = W.partitionBy(*keys, "__range").orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(w), F.col("__carry"))
    return joined.withColumn(value, filled).drop("__carry", "__range")


def average_over(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])
