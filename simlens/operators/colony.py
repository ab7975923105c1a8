"""Reduction of per-agent snapshots to replicate metrics and parameter-set metrics.

Snapshot rows carry the keys (folder, seed, t_min). All metrics of one side are one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simlens.functions import exprs as X
from simlens.operators.ordered import keys_equal, quantiles

# State names and the six hexagonal images of a position.
STATES = ["UNDEFINED", "QUIESCENT", "MIGRATORY", "PROLIFERATIVE", "APOPTOTIC", "NECROTIC", "SENESCENT"]
ACTIVE = ["PROLIFERATIVE", "MIGRATORY"]
INACTIVE = ["NECROTIC", "APOPTOTIC"]
IMAGES = [("-w", "-u", "-v"), ("v", "w", "u"), ("-u", "-v", "-w"), ("w", "u", "v"), ("-v", "-w", "-u")]

KEYS = ("folder", "seed", "t_min")
LATTICE = 30.0


def _alive(name: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col("state") != "NECROTIC", F.col(name))), F.lit(0.0))


def _cycle_mean() -> Column:
    total = F.aggregate("cycles", F.lit(0.0), lambda a, c: a + c)
    return F.when(F.size("cycles") > 0, total / F.size("cycles"))


def _active() -> Column:
    return F.count_if(F.col("state").isin(ACTIVE))


def _states() -> Column:
    return F.map_from_arrays(F.array(*[F.lit(s) for s in STATES]),
                             F.array(*[F.count_if(F.col("state") == s).cast("int") for s in STATES]))


#: Cell metrics by name. A list of names compiles to one aggregation.
CELL_METRICS: dict[str, Callable[[], Column]] = {
    "vol": lambda: _alive("volume"),
    "age": lambda: _alive("age"),
    "cycle_length": lambda: F.coalesce(F.avg(_cycle_mean()), F.lit(0.0)) / 60,
    "n_cells": lambda: F.count(F.lit(1)).cast("double"),
    "act_ratio": lambda: F.avg(F.col("state").isin(ACTIVE).cast("double")),
    "activity": lambda: 2 * F.try_divide(_active(), F.count_if(F.col("state").isin(ACTIVE + INACTIVE))) - 1,
    "states": _states,
}
LOCATION_METRICS = ("colony_diameter", "symmetry")
SEPARATE = ("shannon",)


def cell_metrics(cells: DataFrame, names: Sequence[str] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    names = [*CELL_METRICS, "shannon"] if names is None else list(names)
    unknown = [n for n in names if n not in CELL_METRICS and n not in SEPARATE]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    plain = [n for n in names if n in CELL_METRICS]
    out = cells.groupBy(*keys).agg(*[CELL_METRICS[n]().alias(n) for n in plain]) if plain else None
    if "shannon" in names:
        index = shannon(cells, keys)
        out = index if out is None else keys_equal(out, index, keys)
    return out


def shannon(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Diversity of states: counts per state first, then ln(N) - sum(c ln c)/N over the few states."""
    counts = cells.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    return counts.groupBy(*keys).agg((F.ln(n) - F.sum(F.col("c") * F.ln("c")) / n).alias("shannon"))


def with_hex(locations: DataFrame, coordinate: str = "coordinate") -> DataFrame:
    return locations.select("*", *[F.element_at(coordinate, i + 1).alias(a) for i, a in enumerate("uvw")])


def colony_diameter(locations: DataFrame, keys: Sequence[str] = KEYS, scale: float = LATTICE) -> DataFrame:
    """Mean extent over the three hexagonal axes; expects columns u, v, w."""
    extent = sum((F.max(a) - F.min(a) + 1 for a in "uvw"), F.lit(0))
    return locations.groupBy(*keys).agg((F.lit(scale) * extent / 3).alias("colony_diameter"))


def symmetry(locations: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """1 minus the mean share of missing hexagonal images of the occupied positions.

    An occupied position counts how many of its five images are occupied. Every image map permutes the orbit,
    so positions are grouped by orbit (the smallest image) and counted there: one grouping, no self join.
    """
    here = locations.select(*keys, "u", "v", "w").distinct()
    images = F.array(F.struct("u", "v", "w"), *[
        F.struct(*[F.expr(e).alias(n) for e, n in zip(image, "uvw")]) for image in IMAGES])
    placed = here.withColumn("__images", images).withColumn("__orbit", F.array_min("__images"))
    present = F.collect_list(F.struct("u", "v", "w"))            # at most six positions per orbit
    orbits = placed.groupBy(*keys, "__orbit").agg(present.alias("__here"), F.collect_list("__images").alias("__all"))
    found = F.aggregate("__all", F.lit(0), lambda a, six: a + F.size(F.filter(
        F.slice(six, 2, 5), lambda p: F.array_contains(F.col("__here"), p))))
    per = orbits.select(*keys, F.size("__here").alias("__n"), found.alias("__found"))
    score = 1 - F.try_divide(5 * F.sum("__n") - F.sum("__found"), 5 * F.sum("__n"))
    return per.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("symmetry"))


def location_metrics(locations: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    hexed = locations if {"u", "v", "w"} <= set(locations.columns) else with_hex(locations)
    return keys_equal(colony_diameter(hexed, keys), symmetry(hexed, keys), keys)


def pair_by_seed(cells: DataFrame, locations: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cell and location metrics of the same folder, seed and time; both sides are already one row per key."""
    return keys_equal(cells, locations, keys)


def unpaired(cells: DataFrame, locations: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return cells.select(*keys).join(locations.select(*keys), list(keys), "left_anti")


def doubling_time(n1, n2, minutes) -> Column:
    """Hours; infinite without growth."""
    n1, n2, dt = X.col(n1), X.col(n2), X.col(minutes)
    return F.when((n2 <= n1) | (n1 <= 0), F.lit(X.INF)).otherwise(dt * F.ln(F.lit(2.0)) / F.ln(n2 / n1) / 60)


def growth(per_time: DataFrame, keys: Sequence[str] = ("folder", "seed")) -> DataFrame:
    """Doubling time between first and last time, and slope and r of the diameter on days."""
    days = F.col("t_min") / 60.0 / 24.0
    out = per_time.groupBy(*keys).agg(
        F.min("t_min").alias("__t1"), F.max("t_min").alias("__t2"),
        F.min_by("n_cells", "t_min").alias("__n1"), F.max_by("n_cells", "t_min").alias("__n2"),
        F.regr_slope("colony_diameter", days).alias("colony_growth"), X.safe_corr("colony_diameter", days).alias("colony_growth_r"))
    return out.select(*keys, doubling_time("__n1", "__n2", F.col("__t2") - F.col("__t1")).alias("doub_time"), "colony_growth", "colony_growth_r")


def over_seeds(per_seed: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("folder",), bound: int | None = None) -> DataFrame:
    """Median and population spread of every metric over the replicates; infinite values take part."""
    wide = per_seed.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    spread = wide.groupBy(*keys).agg(*[F.stddev_pop(m).alias(f"{m}_std") for m in metrics])
    long = wide.unpivot(list(keys), list(metrics), "metric", "value")
    med = quantiles(long, [*keys, "metric"], "value", [0.5], "__q", bound)
    pivoted = med.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.element_at("__q", 1))).alias(m) for m in metrics])
    return keys_equal(pivoted, spread, keys)


def state_medians(per_seed: DataFrame, keys: Sequence[str] = ("folder",), bound: int | None = None) -> DataFrame:
    """Integer median count of each state over the replicates, as a map."""
    long = per_seed.select(*keys, F.explode("states").alias("state", "value"))
    med = quantiles(long, [*keys, "state"], "value", [0.5], "__q", bound)
    entries = F.collect_list(F.struct("state", F.element_at("__q", 1).cast("int")))     # one entry per state name
    return med.groupBy(*keys).agg(F.map_from_entries(F.array_sort(entries)).alias("states"))


def seed_summary(per_seed: DataFrame, keys: Sequence[str], means: Sequence[str], spreads: Sequence[str], bound: int | None = None) -> DataFrame:
    """Median for mean-type metrics and sample spread for spread-type metrics per parameter set."""
    wide = per_seed.select(*keys, *[F.col(m).cast("double").alias(m) for m in dict.fromkeys([*means, *spreads])])
    out = wide.groupBy(*keys).agg(*[F.stddev_samp(m).alias(f"{m}_std") for m in spreads])
    long = wide.unpivot(list(keys), list(means), "metric", "value")
    med = quantiles(long, [*keys, "metric"], "value", [0.5], "__q", bound)
    pivoted = med.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.element_at("__q", 1))).alias(m) for m in means])
    return keys_equal(pivoted, out, keys)


def missing_snapshots(present: DataFrame, seeds: Sequence[int], times: Sequence[int]) -> DataFrame:
    """Expected (folder, seed, t_min) without a snapshot: folders times a short list of seeds and times."""
    spark = present.sparkSession
    grid = present.select("folder").distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))) \
        .withColumn("t_min", F.explode(F.array(*[F.lit(t) for t in times])))
    return grid.join(present.select("folder", "seed", "t_min"), ["folder", "seed", "t_min"], "left_anti")


def complete_particles(present: DataFrame, last_seed: int, last_time: int) -> DataFrame:
    """Folders whose last seed reached the last time."""
    return present.where((F.col("seed") == last_seed) & (F.col("t_min") == last_time)).select("folder").distinct()


def remaining_particles(expected: DataFrame, present: DataFrame, last_seed: int, last_time: int) -> DataFrame:
    return expected.join(complete_particles(present, last_seed, last_time), "folder", "left_anti")
