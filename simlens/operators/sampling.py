"""Prior draws, low-discrepancy designs, perturbation kernels and lattice source geometry."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from simlens.functions import exprs as X
from simlens.operators.clean import valid_samples
from simlens.operators.ordered import keys_equal, running
from simlens.operators.reduce import apply_models
from simlens.operators.weights import resample
from simlens.session import cut

BITS = 52           # exact in a double

# Initial direction numbers of the first Sobol dimensions after the first (Joe and Kuo 2008).
INITIAL = [
    [1], [1, 3], [1, 3, 1], [1, 1, 1], [1, 1, 3, 3], [1, 3, 5, 13], [1, 1, 5, 5, 17], [1, 1, 5, 5, 5], [1, 1, 7, 11, 19], [1, 1, 5, 1, 1],
    [1, 1, 1, 3, 11], [1, 3, 5, 5, 31], [1, 3, 3, 9, 7, 49], [1, 1, 1, 15, 21, 21], [1, 3, 1, 13, 27, 49], [1, 1, 1, 15, 7, 5],
    [1, 3, 1, 15, 13, 25], [1, 1, 5, 5, 19, 61], [1, 3, 7, 11, 23, 15, 103], [1, 3, 7, 13, 13, 15, 69],
]


def _primitive_polynomials(count: int) -> list[int]:
    """Primitive polynomials over GF(2) by degree, then by value, as bit masks."""
    found: list[int] = []
    degree = 1
    while len(found) < count:
        order = (1 << degree) - 1
        factors = {p for p in range(2, order + 1) if order % p == 0 and all(p % d for d in range(2, int(p ** 0.5) + 1))} if order > 1 else set()

        def power(poly, e):
            result, base = 1, 2 if degree > 1 else 1
            while e:
                if e & 1:
                    result = _times(result, base, poly, degree)
                base = _times(base, base, poly, degree)
                e >>= 1
            return result
        for low in range(1, 1 << degree, 2):
            poly = (1 << degree) | low
            if power(poly, order) == 1 and all(power(poly, order // p) != 1 for p in factors if order // p >= 1 and order > 1):
                found.append(poly)
        degree += 1
    return found[:count]


def _times(a: int, b: int, poly: int, degree: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a <<= 1
        if a >> degree & 1:
            a ^= poly
        b >>= 1
    return out


def direction_numbers(dims: int) -> list[list[int]]:
    """Direction numbers per dimension, scaled to BITS bits; the first dimension is plain bit reversal."""
    if dims > len(INITIAL) + 1:
        raise ValueError(f"direction numbers are given for {len(INITIAL) + 1} dimensions")
    out = [[1 << (BITS - 1 - b) for b in range(BITS)]]
    for d, poly in enumerate(_primitive_polynomials(max(dims - 1, 1))[:dims - 1]):
        s = poly.bit_length() - 1
        m = list(INITIAL[d])
        while len(m) < BITS:
            k = len(m)
            new = m[k - s] ^ (m[k - s] << s)
            for j in range(1, s):
                if poly >> (s - j) & 1:
                    new ^= m[k - j] << j
            m.append(new)
        out.append([m[b] << (BITS - 1 - b) for b in range(BITS)])
    return out


def sobol(df: DataFrame, index: str, names: Sequence[str], scramble: int | None = None) -> DataFrame:
    """Adds one low-discrepancy coordinate in [0,1) per name, from a non-negative row index (Gray-code order).

    A row needs only its own index. ``scramble`` is the seed of a digital shift, None leaves the points as they are.
    """
    numbers = direction_numbers(len(names))
    i = F.col(index).cast("bigint")
    gray = i.bitwiseXOR(F.shiftright(i, 1))
    cols = {}
    for name, v in zip(names, numbers):
        terms = F.array(*[F.lit(x).cast("bigint") for x in v])
        bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(
            F.pmod(F.floor(gray / F.pow(F.lit(2.0), b)), F.lit(2)) == 1, F.element_at(terms, b + 1))), lambda x: x.isNotNull())
        word = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))
        if scramble is not None:
            word = word.bitwiseXOR(F.floor(X.uniform(scramble, F.lit(name)) * (1 << BITS)).cast("bigint"))
        cols[name] = word / float(1 << BITS)
    return df.withColumns(cols)


def scale(unit: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * unit


def scale_integer(unit: Column, low: int, high: int) -> Column:
    return F.bround(scale(unit, low, high), 0).cast("int")


def from_specs(units: DataFrame, specs: dict) -> DataFrame:
    """Replaces unit columns by their spec: a (low, high) pair is a range, a list is a choice."""
    cols = {}
    for name, spec in specs.items():
        if isinstance(spec, list):
            k = F.least(F.floor(F.col(name) * len(spec)), F.lit(len(spec) - 1)).cast("int")
            cols[name] = F.element_at(F.array(*[F.lit(v) for v in spec]), k + 1)
        else:
            cols[name] = scale(F.col(name), *spec)
    return units.withColumns(cols)


def sobol_design(spark: SparkSession, n: int, specs: dict, seed: int | None = None, ident: str = "particle") -> DataFrame:
    points = sobol(spark.range(n).withColumnRenamed("id", ident), ident, list(specs), seed)
    return from_specs(points, specs)


def mixed_design(spark: SparkSession, specs: dict, per_combination: int, seed: int) -> DataFrame:
    """Every combination of the choices with its own continuous draws (choices are few by design)."""
    choices = {k: v for k, v in specs.items() if isinstance(v, list)}
    ranged = {k: v for k, v in specs.items() if not isinstance(v, list)}
    df = spark.range(1).select(F.lit(0).cast("bigint").alias("combination"))
    for name, values in choices.items():
        df = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("__p", name))
        df = df.withColumn("combination", F.col("combination") * len(values) + F.col("__p")).drop("__p")
    draws = per_combination if ranged else 1
    df = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    if not ranged:
        return df
    shifted = sobol(df, "draw", list(ranged))
    # each combination gets its own shift
    shifted = shifted.withColumns({r: F.pmod(F.col(r) + X.uniform(seed, F.lit(r), "combination"), F.lit(1.0)) for r in ranged})
    return from_specs(shifted, ranged)


def constrained_prior(spark: SparkSession, n: int, rates: dict, pair: dict, seed: int, limit: float = 1.0, ident: str = "particle") -> DataFrame:
    """n draws: log-uniform rates, and a pair uniform on the part of its box where it sums to at most ``limit``.

    The first of the pair comes from its marginal by inverting the area, the second is uniform in what is left.
    """
    df = spark.range(n).withColumnRenamed("id", ident)
    df = df.withColumns({p: F.exp(math.log(lo) + X.uniform(seed, F.lit(p), ident) * (math.log(hi) - math.log(lo))) for p, (lo, hi) in rates.items()})
    (a, (alo, ahi)), (b, (blo, bhi)) = pair.items()

    full = min(max(limit - bhi, alo), ahi)          # up to here all of the second range is open
    last = min(max(limit - blo, alo), ahi)          # from here on none is
    height = bhi - blo
    whole, slanted = (full - alo) * height, (limit - blo) * (last - full) - (last ** 2 - full ** 2) / 2
    if whole + slanted <= 0:
        raise ValueError("the pair constraint leaves nothing of the box")
    area = X.uniform(seed, F.lit(a), ident) * (whole + slanted)
    top = limit - blo - full                        # open length where the slant begins
    rest = F.greatest(F.lit(top * top) - 2 * (area - whole), F.lit(0.0))
    first = F.when(area < whole, alo + area / (height or 1.0)).otherwise(full + top - F.sqrt(rest))
    out = df.withColumn(a, F.least(F.greatest(first, F.lit(float(alo))), F.lit(float(last))))
    return out.withColumn(b, blo + X.uniform(seed, F.lit(b), ident) * (F.least(F.lit(float(bhi)), limit - F.col(a)) - blo))


def from_densities(df: DataFrame, columns: Sequence[str], n: int, seed: int, ident: str) -> DataFrame:
    """n draws per column from its kernel density: a uniform pick of a row plus Scott-scaled noise, columns independent."""
    count = df.groupBy().agg(F.count(F.lit(1)).alias("__n"), *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns])
    rows = running(df.select(ident, *columns), [], [ident], "__rn")
    long = rows.unpivot(["__rn"], list(columns), "parameter", "value")
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("parameter", F.explode(F.array(*[F.lit(c) for c in columns])))
    draws = keys_equal(draws, count, []).withColumn("__rn", (F.floor(X.uniform(seed, "parameter", "draw") * F.col("__n")) + 1).cast("bigint"))
    picked = draws.join(long, ["parameter", "__rn"])
    sd = F.lit(None).cast("double")
    for c in columns:
        sd = F.when(F.col("parameter") == c, F.col(f"__s_{c}")).otherwise(sd)
    value = F.col("value") + X.normal(seed + 1, "parameter", "draw") * sd * F.pow(F.col("__n"), F.lit(-0.2))
    return picked.withColumn("__v", value).groupBy("draw").agg(*[F.max(F.when(F.col("parameter") == c, F.col("__v"))).alias(c) for c in columns])


# --- perturbation ---------------------------------------------------------------------------------------

def kernel_width(t: int, generations: int, schedule: Sequence[float] | None = None) -> float:
    if schedule is not None and 1 <= t <= len(schedule):
        return float(schedule[t - 1])
    return max(0.01, 0.1 * (1 - t / generations))


def perturb(df: DataFrame, ranges: dict[str, tuple[float, float]], width: float, seed: int, ids: Sequence[str],
            spacings: Sequence[str] = (), reach: int = 4) -> DataFrame:
    """Normal steps of ``width`` times the range; integer steps for the spacings, which stay in order (first not above second)."""
    cols = {p: F.col(p) + X.normal(seed, F.lit(p), *ids) * ((hi - lo) * width) for p, (lo, hi) in ranges.items() if p not in spacings}
    step = {s: F.col(s) + F.floor(X.uniform(seed, F.lit(s), *ids) * (2 * reach + 1)).cast("int") - reach for s in spacings}
    if len(spacings) == 2:
        a, b = step.values()
        step = dict(zip(spacings, (F.least(a, b), F.greatest(a, b))))
    return df.withColumns({**cols, **step})


def perturb_rates(df: DataFrame, rates: dict, pair: dict, t: int, seed: int, ids: Sequence[str], limit: float = 1.0) -> DataFrame:
    """Log-space steps of rates and small linear steps of a constrained pair, clipped to range, the pair rescaled into the simplex."""
    s = 0.2 / math.sqrt(1 + t)

    def clip(e, lo, hi):
        return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), e))
    out = df.withColumns({
        **{p: clip(F.exp(F.ln(p) + X.normal(seed, F.lit(p), *ids) * s), *r) for p, r in rates.items()},
        **{p: clip(F.col(p) + X.normal(seed, F.lit(p), *ids) * (s * 0.1), *r) for p, r in pair.items()}})
    a, b = pair
    total = F.col(a) + F.col(b)
    over = total > limit
    return out.withColumns({p: F.when(over, F.col(p) / total * 0.99).otherwise(F.col(p)) for p in (a, b)})


# --- source lattice -----------------------------------------------------------------------------------------

def source_density(length_spacing, width_spacing, radius: float, side: float) -> Column:
    """Sources per mm² of a hexagonal lattice with the given spacings."""
    length, width = 6 * radius - 3, 4 * radius - 2
    area = ((length + 1) / 2 * side) * (width * side) * 1e-6
    return F.floor(F.lit(float(length)) / X.col(length_spacing)) * F.floor(F.lit(float(width)) / X.col(width_spacing)) / area


def spacing_for_density(df: DataFrame, density: str, radius: float, side: float) -> DataFrame:
    """Spacing pair (first not above second) with the least spread, then the nearest density, then the first.

    The least spread is always 0, so only equal pairs can win: one short array per row.
    """
    length, width = int(6 * radius - 3), int(4 * radius - 2)
    k = F.sequence(F.lit(1), F.lit(min(length, width)))
    best = F.array_min(F.transform(k, lambda s: F.struct(F.abs(source_density(s, s, radius, side) - F.col(density)).alias("d"), s.alias("s"))))
    return df.withColumn("__b", best).select(*df.columns, F.col("__b.s").alias("length_spacing"), F.col("__b.s").alias("width_spacing"))


def spacing_by_ratio(density, radius: float, side: float, ratio: float = 1.2) -> tuple[Column, Column]:
    length, width = 6 * radius - 3, 4 * radius - 2
    area = ((length + 1) / 2 * side) * (width * side) * 1e-6
    a = F.sqrt(F.lit(float(length * width)) / (X.col(density) * (ratio * area)))
    return a, a * ratio


def to_hex(x, y, z, radius: int, depth: int = 1, offset: int = 0) -> Column:
    """struct(u, v, w, z) of a rectangular position, NULL outside the lattice."""
    x, y, z = (X.col(c).cast("int") for c in (x, y, z))
    zz = z - depth + 1
    zo = F.pmod(F.abs(F.lit(offset) + zz), F.lit(3))
    u = F.bround((x - F.when(zo == 2, -1).otherwise(zo) + 2) / F.lit(3.0) - radius, 0).cast("int")
    vw = y - 2 * radius + 2 - F.when(zo == 0, 0).otherwise(1)
    v = F.floor(-(vw + u) / F.lit(2.0)).cast("int")
    w = -(u + v)
    return F.when((F.abs(v) <= radius) & (F.abs(w) <= radius), F.struct(u.alias("u"), v.alias("v"), w.alias("w"), zz.alias("z")))


def hex_distance(a: Column, b: Column, side: float) -> Column:
    """Millimetres between two lattice positions."""
    steps = sum((F.abs(a[c] - b[c]) for c in "uvwz"), F.lit(0))
    return steps / 2.0 * side * math.sqrt(3.0) * 1e-3


def source_sites(units: DataFrame, specs: dict, radius: int, side: float, point_based: bool, interval: int = 4) -> DataFrame:
    """Source layouts from unit columns: spacing strings, density and distance to the centre."""
    length, width = int(6 * radius - 3), int(4 * radius - 2)
    rest = {k: v for k, v in specs.items() if k not in ("X_SPACING", "Y_SPACING")}
    df = from_specs(units, rest)
    if point_based:
        lo, hi = specs["Y_SPACING"]
        if 1 + (hi - 1) * interval > width:
            hi = (width - 1) / interval + 1
        y = 1 + (F.bround(scale(F.col("Y_SPACING"), lo, hi), 0).cast("int") - 1) * interval
        centre = int(length / 2)
        df = df.withColumn("__y", y)
        here = to_hex(F.lit(length // 2), F.col("__y") + 1, F.lit(0), radius)
        middle = to_hex(F.lit(length // 2), F.lit(width // 2), F.lit(0), radius)
        return df.withColumns({
            "X_SPACING": F.lit(f"{centre - 1}:{centre + 1}"), "Y_SPACING": F.concat_ws(":", F.col("__y").cast("string"), (F.col("__y") + 1).cast("string")),
            "CAPILLARY_DENSITY": source_density(F.lit(length), F.lit(width), radius, side), "DISTANCE_TO_CENTER": hex_distance(middle, here, side)}).drop("__y")
    a, b = scale_integer(F.col("X_SPACING"), *specs["X_SPACING"]), scale_integer(F.col("Y_SPACING"), *specs["Y_SPACING"])
    df = df.withColumns({"__a": F.least(a, b), "__b": F.greatest(a, b)})
    return df.withColumns({
        "X_SPACING": F.concat(F.lit("*:"), F.col("__a").cast("string")), "Y_SPACING": F.concat(F.lit("*:"), F.col("__b").cast("string")),
        "CAPILLARY_DENSITY": source_density("__a", "__b", radius, side), "DISTANCE_TO_CENTER": F.lit(None).cast("double")}).drop("__a", "__b")


def percentage_grid(spark: SparkSession, defaults: dict[str, float], reach: int = 50, step: int = 10) -> DataFrame:
    """Two-way grid of percent changes around the defaults of two parameters."""
    (a, va), (b, vb) = defaults.items()
    pct = F.sequence(F.lit(-reach), F.lit(reach), F.lit(step))
    df = spark.range(1).select(F.explode(pct).alias(f"{a}_pct")).withColumn(f"{b}_pct", F.explode(pct))
    return df.withColumns({a: F.lit(float(va)) * (1 + F.col(f"{a}_pct") / 100), b: F.lit(float(vb)) * (1 + F.col(f"{b}_pct") / 100)})


def two_way_design(scores: DataFrame, defaults: DataFrame, score: str = "mi", keys: Sequence[str] = (), reach: int = 50, step: int = 10) -> DataFrame:
    """Percent-change grid around the defaults of the two parameters with the largest score of each key.

    ``scores`` has (keys, parameter, score), ``defaults`` (parameter, value); names break ties. A key with fewer than two
    scored parameters that have a default gives no design.
    """
    known = scores.join(defaults.select("parameter", F.col("value").cast("double").alias("__v")), "parameter").where(F.col(score).isNotNull())
    ranked = known.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), "parameter"))).where("__r <= 2")        # a table of parameters, not rows
    pair = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", "parameter", "__v"))).alias("__p")).where(F.size("__p") == 2)
    pct = F.sequence(F.lit(-reach), F.lit(reach), F.lit(step))
    grid = pair.select(*keys, F.element_at("__p", 1).alias("__a"), F.element_at("__p", 2).alias("__b")).withColumn("first_pct", F.explode(pct)).withColumn("second_pct", F.explode(pct))
    return grid.select(*keys, F.col("__a.parameter").alias("first"), F.col("__b.parameter").alias("second"), "first_pct", "second_pct",
                       (F.col("__a.__v") * (1 + F.col("first_pct") / 100)).alias("first_value"), (F.col("__b.__v") * (1 + F.col("second_pct") / 100)).alias("second_value"))


# --- posterior scoring ----------------------------------------------------------------------------------------

def parameter_error(df: DataFrame, truth: dict[str, float], ranges: dict[str, tuple[float, float]], weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error of the weighted mean in units of the prior range."""
    w = F.col(weight)
    parts = [F.abs(F.try_divide(F.sum(w * F.col(p)), F.sum(w)) - float(t)) / (ranges[p][1] - ranges[p][0]) for p, t in truth.items()]
    return df.groupBy(*keys).agg((sum(parts, F.lit(0.0)) / len(parts)).alias("parameter_error"))


def predictive_error(df: DataFrame, targets: dict[str, float], n: int, seed: int, ident: str, weight: str = "weight", keys: Sequence[str] = ()) -> DataFrame:
    """Mean relative error of the statistics over a weighted resample, invalid rows left out."""
    drawn = resample(df.withColumnRenamed(weight, "weight"), n, seed, ident, keys)
    for m in targets:
        drawn = drawn.where(X.finite(m).isNotNull())
    rel = sum((F.abs(F.col(m) - float(t)) / abs(float(t)) for m, t in targets.items()), F.lit(0.0)) / len(targets)
    return drawn.groupBy(*keys).agg(F.avg(rel).alias("statistic_error"), F.count(F.lit(1)).alias("n_used"))


def chain_samples(spark: SparkSession, n: int, specs: dict, models: Sequence[tuple[str, str, float, float]], ranged: Sequence[str], seed: int,
                  ident: str = "particle", most: int = 4096) -> DataFrame:
    """n complete samples: independent and root parameters from a design, derived ones predicted, invalid rows passed over.

    When too few points are valid the design is doubled; its first points stay the same, so the result does not change.
    """
    points = 2 * n
    while True:
        design = sobol_design(spark, points, specs, seed, "__i")
        valid = cut(valid_samples(apply_models(design, models), ranged))
        if valid.count() >= n:
            break
        points *= 2
        if points > most * n:
            raise RuntimeError("almost no predicted sample is valid")
    kept = running(valid, [], ["__i"], ident).where(F.col(ident) <= n)
    return kept.drop("__i")
