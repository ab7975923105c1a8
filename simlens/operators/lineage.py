"""Ancestry over generations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlens.operators.ordered import keys_equal, quantiles
from simlens.session import cut


def trace_founders(edges: DataFrame, last: int, first: int = 1) -> DataFrame:
    """(founder, particle) for every particle of the last generation; one equi-join per generation.

    ``edges``: (gen, child, parent). A parent with very many children is only ever on the unique side of a join.
    """
    current = edges.where(F.col("gen") == last).select(F.col("child").alias("particle"), F.col("parent").alias("founder"))
    for hop, g in enumerate(range(last - 1, first - 1, -1), 1):
        step = edges.where(F.col("gen") == g).select(F.col("child").alias("founder"), F.col("parent").alias("__up"))
        current = current.join(step, "founder").select("particle", F.col("__up").alias("founder"))
        if hop % 8 == 0:
            current = cut(current)
    return current


def check_lineage(edges: DataFrame, n: int) -> DataFrame:
    """Per generation: rows, distinct children and parents outside 1..n."""
    return edges.groupBy("gen").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("child").alias("children"),
                                    F.count_distinct("parent").alias("parents"),
                                    F.count_if(~F.col("parent").between(1, n)).alias("bad_parents"))


def steps(edges: DataFrame, particles: DataFrame, columns: Sequence[str], spacings: Sequence[str] = ()) -> DataFrame:
    """Child-minus-parent differences; particles: (gen, particle, columns...)."""
    child = particles.select("gen", F.col("particle").alias("child"), *[F.col(c).alias(f"c_{c}") for c in [*columns, *spacings]])
    parent = particles.select((F.col("gen") + 1).alias("gen"), F.col("particle").alias("parent"),
                              *[F.col(c).alias(f"p_{c}") for c in [*columns, *spacings]])
    joined = edges.join(child, ["gen", "child"]).join(parent, ["gen", "parent"])
    d = [F.col(f"c_{c}") - F.col(f"p_{c}") for c in columns]
    l1 = sum((F.abs(F.col(f"c_{c}") - F.col(f"p_{c}")) for c in spacings), F.lit(0))
    sq = sum((x * x for x in d), F.lit(0.0))
    return joined.select("gen", "child", "parent", F.sqrt(sq).alias("step"), sq.alias("step2"), l1.alias("spacing_l1"))


def transition_geometry(edges: DataFrame, particles: DataFrame, columns: Sequence[str], spacings: Sequence[str] = ()) -> DataFrame:
    moved = steps(edges, particles, columns, spacings)
    base = moved.groupBy("gen").agg(
        F.avg((F.col("step") > 0).cast("double")).alias("nonzero_step_fraction"),
        F.sqrt(F.avg("step2") / len(columns)).alias("rms_step"),
        F.avg((F.col("spacing_l1") > 0).cast("double")).alias("spacing_changed_fraction"), F.max("step").alias("step_max"))
    q = quantiles(moved, ["gen"], "step", [0.05, 0.5, 0.95], "__q")
    vectors = particles.groupBy("gen").agg(F.count_distinct(F.struct(*columns)).alias("distinct_vectors"))
    out = keys_equal(keys_equal(base, q, ["gen"]), vectors, ["gen"])
    return out.select("gen", "distinct_vectors", "nonzero_step_fraction", "rms_step", "spacing_changed_fraction",
                      *[F.element_at("__q", i + 1).alias(n) for i, n in enumerate(("step_p05", "step_median", "step_p95"))], "step_max")


def founder_geometry(traced: DataFrame, particles: DataFrame, founders: DataFrame, columns: Sequence[str], mode: str) -> DataFrame:
    """Descendants, distinct modes, distance quantiles and central-90 % spans per founder.

    particles: last generation (particle, mode, columns...); founders: first generation (founder, columns...).
    """
    origin = founders.select("founder", *[F.col(c).alias(f"f_{c}") for c in columns])
    joined = traced.join(particles, "particle").join(origin, "founder")
    d2 = sum((F.pow(F.col(c) - F.col(f"f_{c}"), F.lit(2.0)) for c in columns), F.lit(0.0))
    joined = joined.withColumn("distance", F.sqrt(d2))
    base = joined.groupBy("founder").agg(
        F.count(F.lit(1)).alias("descendants"), F.count_distinct(mode).alias("distinct_modes"),
        F.concat_ws(";", F.transform(F.array_sort(F.collect_set(mode)), lambda m: m.cast("string"))).alias("modes"))
    dist = quantiles(joined, ["founder"], "distance", [0.5, 0.95], "__d")
    long = joined.unpivot(["founder"], list(columns), "parameter", "value")
    spans = quantiles(long, ["founder", "parameter"], "value", [0.05, 0.95], "__s").select(
        "founder", "parameter", (F.element_at("__s", 2) - F.element_at("__s", 1)).alias("span"))
    # one span per parameter: a few dozen values per founder
    span = spans.groupBy("founder").agg(F.median("span").alias("span_median"), F.min("span").alias("span_min"), F.max("span").alias("span_max"))
    out = keys_equal(keys_equal(base, dist, ["founder"]), span, ["founder"])
    return out.select("founder", "descendants", "distinct_modes", "modes", F.element_at("__d", 1).alias("distance_median"),
                      F.element_at("__d", 2).alias("distance_p95"), "span_median", "span_min", "span_max")
