"""Whole reduction: snapshots -> per-seed table -> per-parameter-set table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlens.operators import clean, colony
from simlens.operators.ordered import keys_equal
from simlens.session import cut
from simlens.sources import snapshots

FINAL = ["vol", "age", "cycle_length", "n_cells", "symmetry", "shannon", "colony_diameter", "act_ratio", "activity",
         "doub_time", "colony_growth", "colony_growth_r"]
AT_TIME = FINAL[:9]


def per_time(cells: DataFrame, locations: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """All metrics per (extra keys, folder, seed, time)."""
    keys = [*extra, *colony.KEYS]
    return colony.pair_by_seed(colony.cell_metrics(cells, keys=keys), colony.location_metrics(locations, keys), keys)


def per_seed(at_times: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Metrics at the last time of each folder beside growth over all its times."""
    keys = [*extra, "folder", "seed"]
    last = at_times.groupBy(*extra, "folder").agg(F.max("t_min").alias("t_min"))
    final = keys_equal(at_times, last, [*extra, "folder", "t_min"])
    return keys_equal(final, colony.growth(at_times, keys), keys)


def per_parameter_set(seeds: DataFrame, extra: tuple[str, ...] = (), digits: int = 3) -> DataFrame:
    """Median and spread over seeds, rounded, with integer state medians; columns in sorted order."""
    keys = [*extra, "folder"]
    out = clean.round_metrics(colony.over_seeds(seeds, FINAL, keys), digits)
    out = keys_equal(out, colony.state_medians(seeds, keys), keys)
    return ordered_columns(out, keys)


def temporal(at_times: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The same summary at every time, unrounded."""
    return colony.over_seeds(at_times, AT_TIME, [*extra, "folder", "t_min"])


def campaign(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every folder below a root: the small files are parsed once and compacted, later steps read the compact tables."""
    cells, locations = snapshots.cells(spark, root), snapshots.locations(spark, root)
    compact = cut(snapshots.readable(cells).select(*colony.KEYS, "state", "volume", "age", "cycles"))
    places = cut(colony.with_hex(snapshots.readable(locations)).select(*colony.KEYS, "u", "v", "w"))
    times = cut(per_time(compact, places))
    seeds = cut(per_seed(times))
    return {"times": times, "seeds": seeds, "final": per_parameter_set(seeds), "temporal": temporal(times),
            "unpaired": colony.unpaired(compact.select(*colony.KEYS).distinct(), places.select(*colony.KEYS).distinct())}


def ordered_columns(df: DataFrame, last: list[str]) -> DataFrame:
    tail = [c for c in (*last, "states") if c in df.columns]
    return df.select(*sorted(c for c in df.columns if c not in tail), *tail)
