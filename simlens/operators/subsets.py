"""Precision of replicate subsets: every choice of k out of n replicates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlens.functions import exprs as X
from simlens.operators.ordered import keys_equal


def subset_errors(df: DataFrame, keys: Sequence[str], index: str, value: str, n: int, k: int, statistic: str) -> DataFrame:
    """Median and 95 % quantile of |estimate - full| over all subsets, for groups with exactly n finite replicates.

    Replicates of a group are one short array, so a subset estimate is an expression over that array, and the quantiles
    are read from the sorted array of its errors: no row per subset is written.
    """
    if statistic not in ("median", "std"):
        raise ValueError("statistic must be median or std")
    finite = df.where(X.finite(value).isNotNull())
    eligible = finite.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == n).drop("__n")
    packed = keys_equal(finite, eligible, keys).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("__v"))
    choices = F.array(*[F.array(*[F.lit(i + 1) for i in c]) for c in combinations(range(n), k)])

    def estimate(v):
        if statistic == "median":
            s, m = F.array_sort(v), F.size(v)
            return (F.element_at(s, F.floor((m + 1) / 2).cast("int")) + F.element_at(s, F.floor(m / 2).cast("int") + 1)) / 2
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(v))
    errors = F.transform(choices, lambda c: F.abs(estimate(F.transform(c, lambda i: F.element_at("__v", i))) - estimate(F.col("__v"))))
    sorted_ = packed.select(*keys, F.array_sort(errors).alias("__e"))

    def quantile(q):
        at = (F.size("__e") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        a, b = F.element_at("__e", (low + 1).cast("int")), F.element_at("__e", (high + 1).cast("int"))
        return F.when(low == high, a).otherwise((high - at) * a + (at - low) * b)
    return sorted_.select(*keys, F.size("__e").cast("bigint").alias("subsets"), quantile(0.5).alias("median_error"), quantile(0.95).alias("q95_error"))
