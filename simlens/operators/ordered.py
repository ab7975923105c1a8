"""Order-based primitives that stay distributed when one group holds a large share of the rows.

Each primitive has two exact routes. A proven-small input is ordered with a plain window.
Otherwise the large groups are split into ranges by edges taken from a bounded sample of every
such group, the ranges are ordered on their own, and per-range totals give each range its offset.
The sample is chosen by row hash, so a recomputed task sees the same edges. A computed input is written once
before it is split, since sample, edges, totals and ranges all read it; the edges are written as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from simlens.session import cut, is_small, settled

LEVELS = 10                 # 2**10 ranges per large group
SAMPLE = 16 << LEVELS       # sampled rows per large group
RANGE_ROWS = 200_000        # groups up to this many rows are one range
BINS = 1024                 # bins that an interval of values is divided into for quantiles
ROUNDS = 4                  # divisions of an interval before its values are put in ranges


def keys_equal(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where NULL equals NULL; without keys the right side must be one row, or none."""
    if not keys:
        one = right.agg(*[F.first(c).alias(c) for c in right.columns], F.count(F.lit(1)).alias("__rows"))
        held = F.when(F.col("__rows") <= 1, F.col("__rows") == 1).otherwise(F.raise_error(F.lit("a join without keys met several rows")).cast("boolean"))
        return left.join(F.broadcast(one.where(held).drop("__rows")), F.lit(True), "left" if how == "left" else "inner")
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    condition = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def attach(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Group aggregates next to every row: partial aggregation plus a join, no window over whole groups."""
    agg = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggregates.items()])
    return keys_equal(df, agg, keys)


def _find_range(edges: Column, key: Column) -> Column:
    """Number of edges below the key, by binary search in a sorted array of 2**m-1 edges."""
    steps = F.array(*[F.lit(1 << i) for i in range(LEVELS - 1, -1, -1)])
    return F.aggregate(
        steps, F.lit(0),
        lambda pos, step: F.when((pos + step <= F.size(edges)) & (F.element_at(edges, F.least(pos + step, F.size(edges))) < key),
                                 pos + step).otherwise(pos))


def _ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], range_rows: int | None = None) -> DataFrame:
    """Adds ``__range``: an order-preserving split of every large group into about equal ranges."""
    rows = RANGE_ROWS if range_rows is None else range_rows
    order_key = F.struct(*[F.col(c) for c in order])
    hashed = F.xxhash64(F.lit(17), *[F.col(c) for c in order])
    large = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.approx_count_distinct(hashed).alias("__d"))
             .where(F.col("__n") > rows).drop("__n"))
    pick = W.partitionBy(*keys).orderBy("__h", *order)
    sampled = (keys_equal(df.select(*keys, *[c for c in order if c not in keys]), large, keys)
               .withColumn("__h", hashed)
               .where(F.pmod("__h", F.greatest(F.col("__d"), F.lit(1))) < 2 * SAMPLE)
               .select(*keys, *[c for c in order if c not in keys], "__h").distinct()
               .withColumn("__s", F.row_number().over(pick)).where(F.col("__s") <= SAMPLE))
    edges = (sampled.groupBy(*keys)
             .agg(F.array_sort(F.collect_set(order_key)).alias("__sample"))
             .withColumn("__stride", F.ceil(F.size("__sample") / F.lit(float(1 << LEVELS))).cast("int"))
             .select(*keys, F.expr("filter(__sample, (x, i) -> i % __stride = __stride - 1)").alias("__edges"))
             .withColumn("__edges", F.slice("__edges", 1, (1 << LEVELS) - 1)))
    joined = keys_equal(df, cut(edges), keys, "left")
    position = F.when(F.col("__edges").isNull(), F.lit(0)).otherwise(_find_range(F.col("__edges"), order_key))
    return joined.withColumn("__range", position).drop("__edges")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], number: str | None = "rn",
            sums: dict[str, Column] | None = None, bound: int | None = None,
            range_rows: int | None = None) -> DataFrame:
    """Row number and inclusive running sums inside each group; ``order`` must be a total order."""
    sums = {n: (F.col(c) if isinstance(c, str) else c) for n, c in (sums or {}).items()}
    if is_small(df, bound):
        w = W.partitionBy(*keys).orderBy(*order)
        out = df
        if number:
            out = out.withColumn(number, F.row_number().over(w).cast("bigint"))
        for name, e in sums.items():
            out = out.withColumn(name, F.sum(e).over(w.rowsBetween(W.unboundedPreceding, 0)))
        return out
    split = _ranges(settled(df), keys, order, range_rows)
    offsets = _offsets(split, keys, {"__run_n": F.lit(1), **{f"__run_s_{n}": e for n, e in sums.items()}})
    joined = keys_equal(split, offsets, [*keys, "__range"])
    w = W.partitionBy(*keys, "__range").orderBy(*order)
    out = joined
    if number:
        out = out.withColumn(number, F.row_number().over(w).cast("bigint") + F.col("__run_n"))
    for name, e in sums.items():
        out = out.withColumn(name, F.sum(e).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col(f"__run_s_{name}"))
    return out.drop("__range", "__run_n", *[f"__run_s_{n}" for n in sums])


def _offsets(split: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Sums of all lower ranges of the group: at most 2**LEVELS rows per group meet in the window."""
    totals = split.groupBy(*keys, "__range").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*keys, "__range",
                         *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def windowed(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int,
             build: Callable[[W], dict[str, Column]], block: int = 100_000, bound: int | None = None) -> DataFrame:
    """Columns over a frame of at most ``before`` preceding and ``after`` following rows.

    Large groups are cut into blocks of rows, and each block also receives its neighbours' edge rows.
    ``build`` gets the ordered window (no frame) and returns the new columns.
    """
    if is_small(df, bound):
        w = W.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[e.alias(n) for n, e in build(w).items()])
    if block < max(before, after):
        raise ValueError("block must not be shorter than the frame")
    numbered = running(df, keys, order, number="__rn", bound=bound)
    zero = F.col("__rn") - 1
    own = F.floor(zero / block).cast("bigint")
    inside = F.pmod(zero, F.lit(block))
    homes = F.array_compact(F.array(
        own,
        F.when(inside >= block - before, own + 1) if before else F.lit(None).cast("bigint"),
        F.when((inside < after) & (own > 0), own - 1) if after else F.lit(None).cast("bigint")))
    placed = (numbered.withColumn("__own", own).withColumn("__block", F.explode(homes)))
    w = W.partitionBy(*keys, "__block").orderBy("__rn")
    out = placed.select("*", *[e.alias(n) for n, e in build(w).items()])
    return out.where(F.col("__own") == F.col("__block")).drop("__own", "__block", "__rn")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their multiplicity; copies collapse before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              name: str = "q", bound: int | None = None, range_rows: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group as an array column, NULLs ignored.

    Large groups are counted in bins between their least and largest value; only bins that hold a wanted rank are
    looked at again, divided anew or, once they are short, value by value. No row is shuffled before that.
    """
    probs = [float(p) for p in probs]
    present = df.where(F.col(value).isNotNull())
    if is_small(df, bound):
        return present.groupBy(*keys).agg(
            F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias(name))
    most = RANGE_ROWS if range_rows is None else range_rows
    given, keys = keys, list(keys) or ["__all"]
    data = settled(present.withColumn("__all", F.lit(0)).select(*keys, F.col(value).cast("double").alias("__v")))
    wanted = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(F.lit(p) * (F.col("__n") - 1)).cast("bigint") + 1,
                F.ceil(F.lit(p) * (F.col("__n") - 1)).cast("bigint") + 1) for p in probs])))
    facts = cut(data.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__a"), F.max("__v").alias("__b")))
    # an interval holds __k rows from __a to __b, __below rows of its group lie lower, __want are the ranks looked for
    interval = [*keys, "__a", "__b", "__k", "__below", "__want"]
    open_now = facts.select(*keys, "__a", "__b", F.col("__n").alias("__k"), F.lit(0).cast("bigint").alias("__below"), wanted.alias("__want"))
    done, resolved = [], []
    for _ in range(ROUNDS):
        done.append(open_now.where(F.col("__k") <= most))
        large = open_now.where(F.col("__k") > most)
        if large.isEmpty():
            break
        open_now = cut(_divided(data, large, keys).select(*interval))
        resolved.append(open_now.where(F.col("__a") == F.col("__b")).select(*keys, F.explode("__want").alias("__rank"), F.col("__a").alias("__v")))
        open_now = open_now.where(F.col("__a") < F.col("__b"))
    else:
        done.append(open_now)
    left = reduce(DataFrame.unionByName, done)
    held = _inside(data, left.select(*keys, "__a", "__b"), keys)
    copies = held.groupBy(*keys, "__a", "__v").agg(F.count(F.lit(1)).alias("__k"))
    if left.where(F.col("__k") > most).isEmpty():
        upto = W.partitionBy(*keys, "__a").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
        counted = copies.withColumn("__hi", F.sum("__k").over(upto))
    else:                   # values so far apart that even bins of bins do not tell them from each other
        counted = running(copies, [*keys, "__a"], ["__v"], number=None, sums={"__hi": F.col("__k")}, bound=0)
    placed = keys_equal(counted, left.select(*keys, "__a", "__below", "__want"), [*keys, "__a"]).withColumn("__hi", F.col("__hi") + F.col("__below"))
    found = placed.withColumn("__rank", F.explode(F.filter("__want", lambda r: (r > F.col("__hi") - F.col("__k")) & (r <= F.col("__hi")))))
    found = reduce(DataFrame.unionByName, resolved, found.select(*keys, "__rank", "__v"))
    table = keys_equal(found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("__rank", "__v"))).alias("__at")), facts.select(*keys, "__n"), keys)
    picks = []
    for p in probs:
        h = F.lit(p) * (F.col("__n") - 1)
        low, high = F.floor(h).cast("bigint"), F.ceil(h).cast("bigint")
        a, b = F.element_at("__at", low + 1), F.element_at("__at", high + 1)
        picks.append(F.when(low == high, a).otherwise((high - h) * a + (h - low) * b))
    return cut(table.select(*given, F.array(*picks).alias(name)))


def _inside(data: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, __v) beside every interval of their group that holds them; the intervals' columns come along."""
    return keys_equal(data, intervals, keys).where((F.col("__v") >= F.col("__a")) & (F.col("__v") <= F.col("__b")))


def _divided(data: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bins of the intervals that hold a wanted rank, as new intervals between their least and largest value.

    Any bins that keep the order will do, so infinities and NaN, the largest value, are cut off for the division.
    """
    def bounded(c):
        return F.least(F.greatest(c, F.lit(-8e307)), F.lit(8e307))
    low = bounded(F.col("__a"))
    share = F.try_divide(bounded(F.col("__v")) - low, bounded(F.col("__b")) - low)
    bin_of = F.coalesce(F.least(F.lit(BINS - 1), F.floor(share * BINS).cast("int")), F.lit(0))
    rows = _inside(data, intervals.select(*keys, "__a", "__b"), keys)
    bins = rows.groupBy(*keys, F.col("__a").alias("__from"), bin_of.alias("__bin")).agg(
        F.count(F.lit(1)).alias("__k"), F.min("__v").alias("__a"), F.max("__v").alias("__b"))
    before = W.partitionBy(*keys, "__from").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("__sum", F.coalesce(F.sum("__k").over(before), F.lit(0)))        # at most BINS rows an interval
    known = keys_equal(bins, intervals.select(*keys, F.col("__a").alias("__from"), "__below", "__want"), [*keys, "__from"])
    known = known.withColumn("__below", F.col("__below") + F.col("__sum"))
    return known.withColumn("__want", F.filter("__want", lambda r: (r > F.col("__below")) & (r <= F.col("__below") + F.col("__k")))).where(F.size("__want") > 0)


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", bound: int | None = None) -> DataFrame:
    q = quantiles(df, keys, value, [0.5], "__q", bound)
    return q.select(*keys, F.element_at("__q", 1).alias(name))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, bound: int | None = None) -> DataFrame:
    """Per distinct value: copies, min rank, average rank, dense rank (ascending)."""
    counts = value_counts(df, keys, value)
    ranked = running(counts, keys, [value], number="dense_rank", sums={"__cum": F.col("copies")}, bound=bound)
    return (ranked.withColumn("min_rank", F.col("__cum") - F.col("copies") + 1)
            .withColumn("avg_rank", F.col("__cum") - (F.col("copies") - 1) / 2.0)
            .drop("__cum"))


def with_ranks(df: DataFrame, keys: Sequence[str], value: str, bound: int | None = None,
               descending: bool = False) -> DataFrame:
    """Dense, min and average rank beside every row (NULL values get NULL ranks)."""
    sort_by = "__sort"
    data = df.withColumn(sort_by, -F.col(value) if descending else F.col(value))
    if is_small(df, bound):
        w = W.partitionBy(*keys).orderBy(sort_by)
        same = F.count(F.lit(1)).over(W.partitionBy(*keys, sort_by))
        ranked = data.where(F.col(sort_by).isNotNull()).select(
            "*", F.dense_rank().over(w).cast("bigint").alias("dense_rank"),
            F.rank().over(w).cast("bigint").alias("min_rank"), same.alias("copies"))
        ranked = ranked.withColumn("avg_rank", F.col("min_rank") + (F.col("copies") - 1) / 2.0)
        missing = data.where(F.col(sort_by).isNull())
        return ranked.unionByName(missing, allowMissingColumns=True).drop(sort_by)
    ranks = value_ranks(data, keys, sort_by, bound)
    return keys_equal(data, ranks, [*keys, sort_by], "left").drop(sort_by)


def nearest_rows(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, number: str = "rank") -> DataFrame:
    """First k rows of each group. Spark prunes to k rows per group before the shuffle (window group limit)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(number, F.row_number().over(w).cast("bigint")).where(F.col(number) <= k)
