"""Principal components, kernel densities, density modes and their stability."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from simlens.functions import exprs as X
from simlens.operators import neighbours as N
from simlens.operators.clean import melt
from simlens.operators.dependence import WIDE, from_moments, moments
from simlens.operators.ordered import keys_equal, medians, nearest_rows, running
from simlens.operators.weights import resample
from simlens.session import cut, settled

FLUSH = 400      # densities held at once by one task


# --- principal components --------------------------------------------------------------------------------

def fit_pca(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), components: int = 2, standardise: bool = True,
            weight: str | None = None) -> DataFrame:
    """One model row per group: mean, spread, loadings (component-major, largest loading positive), explained share."""
    def solve(n, mean, cov):
        sd = np.sqrt(np.diag(cov)) if standardise else np.ones(len(mean))
        sd = np.where(sd > 0, sd, 1.0)
        values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
        order = np.argsort(values)[::-1][:components]
        load = vectors[:, order].T
        sign = np.sign(load[np.arange(len(load)), np.abs(load).argmax(axis=1)])
        load = load * np.where(sign == 0, 1, sign)[:, None]
        total = values.sum()
        return [(mean.tolist(), sd.tolist(), load.ravel().tolist(), (values[order] / total).tolist())]
    return from_moments(moments(df, columns, keys, weight), keys, solve,
                        "mean array<double>, sd array<double>, loadings array<double>, explained array<double>")


def project(df: DataFrame, model: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), components: int = 2) -> DataFrame:
    """Rows with pc1, pc2, ... under a model fitted on this or another cloud."""
    joined = keys_equal(df, model, keys)
    p = len(columns)
    for k in range(components):
        if p > WIDE:         # the same sum as a fold: one short expression, however many columns
            x = F.array(*[F.col(c).cast("double") for c in columns])
            score = F.aggregate(F.sequence(F.lit(1), F.lit(p)), F.lit(0.0), lambda a, i: a + (
                F.element_at(x, i) - F.element_at("mean", i)) / F.element_at("sd", i) * F.element_at("loadings", i + k * p))
        else:
            score = sum(((F.col(c) - F.element_at("mean", i + 1)) / F.element_at("sd", i + 1) * F.element_at("loadings", k * p + i + 1)
                         for i, c in enumerate(columns)), F.lit(0.0))
        joined = joined.withColumn(f"pc{k + 1}", score)
    return joined.drop("mean", "sd", "loadings", "explained")


def invert(points: DataFrame, model: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), components: int = 2) -> DataFrame:
    """Parameter values at positions (pc1, pc2, ...)."""
    joined = keys_equal(points, model, keys)
    p = len(columns)
    for i, c in enumerate(columns):
        back = sum((F.col(f"pc{k + 1}") * F.element_at("loadings", k * p + i + 1) for k in range(components)), F.lit(0.0))
        joined = joined.withColumn(c, F.element_at("mean", i + 1) + F.element_at("sd", i + 1) * back)
    return joined.drop("mean", "sd", "loadings", "explained")


# --- kernel density -----------------------------------------------------------------------------------------

def kde(df: DataFrame, coords: Sequence[str], keys: Sequence[str] = (), size: int = 100, pad: Sequence[float] = (0.0, 0.0),
        weight: str | None = None, factor: float | None = None, multiple: str | None = None,
        limits: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """Gaussian density of one or two coordinates on a regular grid: (keys, ix[, iy], x[, y], density).

    Bandwidth: Scott factor n^(-1/(d+4)) with the effective size when weighted, a fixed ``factor``, or Scott times the
    key column ``multiple``. Every task adds its rows into one grid per group and emits grid cells; a sum finishes it.
    """
    dims = len(coords)
    data = df
    for c in coords:
        data = data.where(X.finite(c).isNotNull())
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    m = moments(data, coords, keys, weight).withColumnRenamed("n", "__n")
    box = data.groupBy(*keys).agg(F.sum(w).alias("__w"), F.sum(w * w).alias("__w2"),
                                  *[f(c).alias(f"__{n}{i}") for i, c in enumerate(coords) for n, f in (("lo", F.min), ("hi", F.max))])
    model = keys_equal(m, box, keys)
    ess = F.col("__w") * F.col("__w") / F.col("__w2")
    scott = F.pow(ess, F.lit(-1.0 / (dims + 4)))
    h = F.lit(float(factor)) if factor is not None else scott
    if multiple:
        h = scott * F.col(multiple)
    # sample covariance: 1/(1 - sum w²) of the normalised weights
    model = model.withColumn("__c", F.transform("cov", lambda v: v / (1 - F.col("__w2") / (F.col("__w") * F.col("__w"))) * h * h))
    for i in range(dims):
        lo = F.lit(float(limits[i][0])) if limits else F.col(f"__lo{i}") - float(pad[i])
        hi = F.lit(float(limits[i][1])) if limits else F.col(f"__hi{i}") + float(pad[i])
        model = model.withColumn(f"__a{i}", lo).withColumn(f"__s{i}", (hi - lo) / (size - 1))
    model = model.select(*keys, "__w", "__c", *[f"__{n}{i}" for i in range(dims) for n in "as"])
    rows = keys_equal(data.select(*keys, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(coords)], w.alias("__v")), model, keys)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "ix int, iy int, x double, y double, part double"])
    names = list(keys)

    def add(batches):
        import pandas as pd
        held: dict = {}

        def emit():
            ix = np.tile(np.arange(size), size if dims == 2 else 1)
            iy = np.repeat(np.arange(size), size) if dims == 2 else np.zeros(size, dtype=int)
            for key, (grid, a, s) in held.items():
                out = {n: [v] * len(ix) for n, v in zip(names, key)}
                yield pd.DataFrame({**out, "ix": ix.astype("int32"), "iy": iy.astype("int32"), "x": a[0] + s[0] * ix,
                                    "y": a[1] + s[1] * iy if dims == 2 else np.zeros(len(ix)), "part": grid.ravel()})
            held.clear()

        for pdf in batches:
            groups = pdf.groupby(names, sort=False, dropna=False) if names else [((), pdf)]
            for key, g in groups:
                key = key if isinstance(key, tuple) else (key,)
                if key not in held:
                    if len(held) >= FLUSH:
                        yield from emit()
                    held[key] = (np.zeros((size, size) if dims == 2 else size),
                                 [float(g[f"__a{i}"].iloc[0]) for i in range(dims)], [float(g[f"__s{i}"].iloc[0]) for i in range(dims)])
                grid, a, s = held[key]
                cov = np.asarray(g["__c"].iloc[0], dtype=float).reshape(dims, dims)
                total, v = float(g["__w"].iloc[0]), g["__v"].to_numpy(float)
                if dims == 1:
                    axis = a[0] + s[0] * np.arange(size)
                    for b in range(0, len(g), 2048):
                        d = g["__x0"].to_numpy(float)[b:b + 2048, None] - axis
                        grid += v[b:b + 2048] @ np.exp(-0.5 * d * d / cov[0, 0]) / (total * math.sqrt(2 * math.pi * cov[0, 0]))
                    continue
                inv = np.linalg.inv(cov)
                scale = 1.0 / (total * 2 * math.pi * math.sqrt(np.linalg.det(cov)))
                xa, ya = a[0] + s[0] * np.arange(size), a[1] + s[1] * np.arange(size)
                x0, x1 = g["__x0"].to_numpy(float), g["__x1"].to_numpy(float)
                plain = abs(inv[0, 1]) < 1e-12 * math.sqrt(inv[0, 0] * inv[1, 1])
                step = 2048 if plain else 128
                for b in range(0, len(g), step):
                    dx, dy = xa - x0[b:b + step, None], ya - x1[b:b + step, None]
                    if plain:      # uncorrelated kernel: the two axes separate
                        ex = np.exp(-0.5 * inv[0, 0] * dx * dx)
                        ey = np.exp(-0.5 * inv[1, 1] * dy * dy) * v[b:b + step, None]
                        grid += scale * (ey.T @ ex)
                    else:
                        q = (-0.5 * inv[0, 0] * dx * dx)[:, None, :] + (-0.5 * inv[1, 1] * dy * dy)[:, :, None] - inv[0, 1] * dy[:, :, None] * dx[:, None, :]
                        grid += scale * np.einsum("n,nyx->yx", v[b:b + step], np.exp(q))
        yield from emit()

    parts = rows.mapInPandas(add, schema)
    out = parts.groupBy(*keys, "ix", "iy").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.sum("part").alias("density"))
    return out if dims == 2 else out.drop("iy", "y")


def grid_mode(density: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First grid point of the largest density (one-dimensional grid)."""
    best = F.struct(-F.col("density"), F.col("ix"))
    return density.groupBy(*keys).agg(F.min_by("x", best).alias("mode"), F.max("density").alias("density"))


def metric_modes(long: DataFrame, keys: Sequence[str], size: int = 1000, weight: str | None = None) -> DataFrame:
    """Density mode and population spread of each metric."""
    modes = grid_mode(kde(long, ["value"], keys, size, weight=weight), keys).drop("density")
    return keys_equal(modes, long.groupBy(*keys).agg(F.stddev_pop("value").alias("std")), keys)


def density_interval(density: DataFrame, keys: Sequence[str] = (), mass: float = 0.95) -> DataFrame:
    """Highest-density interval and mode from a one-dimensional grid.

    Cells are taken from the densest down until their share reaches the mass; the interval spans the cells at least as
    dense as the last one taken. The grid is at most a few hundred cells per group.
    """
    group = W.partitionBy(*keys)
    share = F.col("density") / F.sum("density").over(group)
    ranked = density.withColumn("__share", share)
    ranked = ranked.withColumn("__cum", F.sum("__share").over(group.orderBy(F.desc("density"), F.col("ix")).rowsBetween(W.unboundedPreceding, 0)))
    cut_at = F.max(F.when(F.col("__cum") >= mass, F.col("density"))).over(group)
    inside = ranked.withColumn("__t", cut_at).where(F.col("density") >= F.col("__t"))
    mode = grid_mode(density, keys).drop("density")
    return keys_equal(inside.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi")), mode, keys)


def find_peaks(density: DataFrame, keys: Sequence[str] = (), threshold: float = 0.1, reach: int = 2) -> DataFrame:
    """Grid maxima over a square of 2*reach+1 cells above a share of the largest density, numbered row by row."""
    row = W.partitionBy(*keys, "iy").orderBy("ix").rowsBetween(-reach, reach)
    column = W.partitionBy(*keys, "ix").orderBy("iy").rowsBetween(-reach, reach)
    filtered = density.withColumn("__m", F.max("density").over(row)).withColumn("__m", F.max("__m").over(column))
    top = keys_equal(filtered, density.groupBy(*keys).agg(F.max("density").alias("__top")), keys)
    peaks = top.where((F.col("density") == F.col("__m")) & (F.col("density") > threshold * F.col("__top")))
    number = F.row_number().over(W.partitionBy(*keys).orderBy("iy", "ix")).cast("bigint")
    return peaks.select(*keys, number.alias("peak"), "x", "y", "density")


def ordered_modes(peaks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Peaks numbered by falling density (a handful per group)."""
    w = W.partitionBy(*keys).orderBy(F.desc("density"), F.col("peak"))
    return peaks.withColumn("mode", F.row_number().over(w).cast("bigint"))


def assign(points: DataFrame, centres: DataFrame, keys: Sequence[str] = (), coords: Sequence[str] = ("pc1", "pc2"),
           at: Sequence[str] = ("x", "y"), label: str = "peak") -> DataFrame:
    """Nearest centre of each point (first on ties). The centres of a group travel as one array, so nothing is paired."""
    packed = centres.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("k"), *[F.col(a).cast("double").alias(f"c{i}") for i, a in enumerate(at)]))).alias("__c"))
    joined = keys_equal(points, packed, keys, "left")

    def scored(c):
        d2 = sum(((F.col(x) - c[f"c{i}"]) * (F.col(x) - c[f"c{i}"]) for i, x in enumerate(coords)), F.lit(0.0))
        return F.struct(d2.alias("d2"), c["k"].alias("k"))
    best = F.array_min(F.transform("__c", scored))
    return joined.withColumn("__b", best).select(*points.columns, F.col("__b.k").alias(label), F.sqrt("__b.d2").alias("distance"))


def match_centres(centres: DataFrame, reference: DataFrame, keys: Sequence[str] = (), tolerance: float = 1.0) -> DataFrame:
    """Each reference centre with its nearest detected centre when that lies within the tolerance."""
    packed = centres.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "peak", "density")).alias("__c"))
    names = reference.select(F.col("peak").alias("reference"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    both = packed.join(F.broadcast(names), F.lit(True))       # a few reference centres
    near = F.array_min(F.transform("__c", lambda c: F.struct(
        F.sqrt(F.pow(c["x"] - F.col("rx"), F.lit(2.0)) + F.pow(c["y"] - F.col("ry"), F.lit(2.0))).alias("d"), c["peak"].alias("peak"), c["x"].alias("x"), c["y"].alias("y"), c["density"].alias("density"))))
    out = both.withColumn("__n", near)
    return out.select(*keys, "reference", F.col("__n.d").alias("distance"), (F.col("__n.d") <= tolerance).alias("recovered"),
                      *[F.when(F.col("__n.d") <= tolerance, F.col(f"__n.{c}")).alias(c) for c in ("peak", "x", "y", "density")])


def cloud_peaks(points: DataFrame, keys: Sequence[str] = (), coords: Sequence[str] = ("pc1", "pc2"), size: int = 100, pad=(2.0, 1.0),
                threshold: float = 0.1, reach: int = 2, **density) -> DataFrame:
    return find_peaks(kde(points, coords, keys, size, pad, **density), keys, threshold, reach)


def posterior_peaks(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), **options):
    """(points with pc1, pc2 and peak; peaks; model) of a posterior cloud."""
    model = fit_pca(df, columns, keys)
    points = project(df, model, columns, keys)
    peaks = cloud_peaks(points, keys, **options)
    return assign(points, peaks, keys), peaks, model


def members(points: DataFrame, peak: str, order: Sequence[str], n: int) -> DataFrame:
    return nearest_rows(points, [peak], order, n, "member")


def largest_mode(points: DataFrame, peaks: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Mode with most members, whether it also has most weight and the highest density."""
    size = points.groupBy(*keys, "peak").agg(F.count(F.lit(1)).alias("members"), F.sum(weight).alias("mass"))
    j = keys_equal(size, peaks.select(*keys, "peak", "density"), [*keys, "peak"])
    tie = lambda c: F.struct(F.col(c), -F.col("peak"))
    out = j.groupBy(*keys).agg(F.max_by("peak", tie("members")).alias("peak"), F.max_by("peak", tie("mass")).alias("__m"),
                               F.max_by("peak", tie("density")).alias("__d"), F.max("members").alias("members"))
    return out.select(*keys, "peak", "members", ((F.col("peak") == F.col("__m")) & (F.col("peak") == F.col("__d"))).alias("unanimous"))


def bandwidth_sweep(points: DataFrame, reference: DataFrame, multiples: Sequence[float], keys: Sequence[str] = (), coords=("pc1", "pc2"),
                    tolerance: float = 1.0, **options) -> DataFrame:
    """Number of modes and recovered reference centres per bandwidth multiple; the multiple is one more key."""
    spread = points.withColumn("multiple", F.explode(F.array(*[F.lit(float(m)) for m in multiples])))
    peaks = cloud_peaks(spread, [*keys, "multiple"], coords, multiple="multiple", **options)
    return _sweep_table(peaks, reference, [*keys, "multiple"], tolerance)


def threshold_sweep(density: DataFrame, reference: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = (), tolerance: float = 1.0, reach: int = 2) -> DataFrame:
    """The same over peak thresholds; maxima are found once and repeated for each threshold."""
    all_peaks = find_peaks(density, keys, 0.0, reach)
    top = all_peaks.groupBy(*keys).agg(F.max("density").alias("__top"))
    t = keys_equal(all_peaks, top, keys).withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    return _sweep_table(t.where(F.col("density") > F.col("threshold") * F.col("__top")).drop("__top"), reference, [*keys, "threshold"], tolerance)


def _sweep_table(peaks, reference, keys, tolerance):
    count = peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("modes"), F.try_divide(F.min("density"), F.max("density")).alias("density_ratio"))
    found = match_centres(peaks, reference, keys, tolerance).groupBy(*keys).agg(F.count_if("recovered").alias("recovered"))
    return keys_equal(count, found, keys)


def histogram_modes(long: DataFrame, keys: Sequence[str], value: str = "value", bins: int = 30) -> DataFrame:
    """Fullest equal-width bin (first on ties): centre, edges and count."""
    span = long.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    counts = histogram(long, span, keys, value, bins)
    best = counts.groupBy(*keys).agg(F.min_by(F.struct("bin", "count"), F.struct(-F.col("count"), F.col("bin"))).alias("__b"))
    j = keys_equal(best, span, keys)
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.col("__b.bin")
    return j.select(*keys, (F.col("lo") + width * (b + 0.5)).alias("mode"), (F.col("lo") + width * b).alias("bin_lo"),
                    (F.col("lo") + width * (b + 1)).alias("bin_hi"), F.col("__b.count").alias("count"))


def histogram(long: DataFrame, span: DataFrame, keys: Sequence[str], value: str = "value", bins: int = 30, weight: str | None = None,
              extra: Sequence[str] = ()) -> DataFrame:
    """Counts (or weight sums) over bins shared by all rows of a key; the last bin is closed."""
    j = keys_equal(long.where(F.col(value).isNotNull()), span, keys)
    u = F.try_divide(F.col(value) - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    k = F.when(u.isNull(), F.lit(0)).otherwise(F.least(F.floor(u * bins), F.lit(bins - 1))).cast("int")
    inside = j.where(F.col(value).between(F.col("lo"), F.col("hi"))).withColumn("bin", k)
    what = F.sum(weight).alias("weight") if weight else F.count(F.lit(1)).alias("count")
    return inside.groupBy(*keys, *extra, "bin").agg(what)


def hexagonal_bins(df: DataFrame, x: str, y: str, size_x: float, size_y: float, keys: Sequence[str] = ()) -> DataFrame:
    """Counts on a hexagonal lattice: each point goes to the nearer of two interleaved rectangular lattices."""
    u, v = F.col(x) / size_x, F.col(y) / size_y
    a, b = F.floor(u + 0.5), F.floor(v + 0.5)
    c, d = F.floor(u) + 0.5, F.floor(v) + 0.5
    d1 = F.pow(u - a, F.lit(2.0)) + 3 * F.pow(v - b, F.lit(2.0))
    d2 = F.pow(u - c, F.lit(2.0)) + 3 * F.pow(v - d, F.lit(2.0))
    q = F.when(d1 < d2, a.cast("double")).otherwise(c)
    r = F.when(d1 < d2, b.cast("double")).otherwise(d)
    return df.select(*keys, (q * size_x).alias("cx"), (r * size_y).alias("cy")).groupBy(*keys, "cx", "cy").agg(F.count(F.lit(1)).alias("count"))


def representatives(df: DataFrame, ident: str, columns: Sequence[str], keys: Sequence[str] = (), **options) -> DataFrame:
    """Mean, mode-bin and peak rows of a posterior: parameters, position, nearest sample, size and share."""
    points, peaks, model = posterior_peaks(df, columns, keys, **options)
    mean = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns]).withColumn("kind", F.lit("posterior_mean"))
    modes = histogram_modes(melt(df, keys, columns, "parameter"), [*keys, "parameter"])
    mode = modes.groupBy(*keys).agg(*[F.max(F.when(F.col("parameter") == c, F.col("mode"))).alias(c) for c in columns]).withColumn("kind", F.lit("posterior_mode"))
    flat = project(mean.unionByName(mode), model, columns, keys)
    at = invert(peaks.select(*keys, F.col("peak").alias("cluster"), F.col("x").alias("pc1"), F.col("y").alias("pc2")), model, columns, keys).withColumn("kind", F.lit("pca_peak_inverse"))
    size = points.groupBy(*keys, F.col("peak").alias("cluster")).agg(
        F.count(F.lit(1)).alias("cluster_size"), F.min_by(ident, F.struct("distance", ident)).alias("nearest_sample"), F.min("distance").alias("nearest_distance"))
    total = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    at = keys_equal(keys_equal(at, size, [*keys, "cluster"]), total, keys).withColumn("cluster_fraction", F.col("cluster_size") / F.col("__n")).drop("__n")
    return flat.unionByName(at, allowMissingColumns=True)


# --- bandwidth choice -----------------------------------------------------------------------------------------

def whiten(df: DataFrame, coords: Sequence[str], keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Adds z1, z2: two coordinates with unit covariance (inverse Cholesky factor of the sample covariance)."""
    w = F.col(weight) if weight else F.lit(1.0)
    m = moments(df, coords, keys, weight)
    s = df.groupBy(*keys).agg((1 - F.sum(w * w) / F.pow(F.sum(w), F.lit(2.0))).alias("__u"))
    model = keys_equal(m, s, keys).select(*keys, *[(F.element_at("cov", i) / F.col("__u")).alias(n) for i, n in ((1, "__a"), (2, "__b"), (4, "__d"))])
    j = keys_equal(df, model, keys)
    l11 = F.sqrt("__a")
    l21 = F.col("__b") / l11
    l22 = F.sqrt(F.col("__d") - l21 * l21)
    z1 = F.col(coords[0]) / l11
    return j.withColumn("z1", z1).withColumn("z2", (F.col(coords[1]) - l21 * z1) / l22).drop("__a", "__b", "__d")


def leave_one_out(df: DataFrame, ident: str, factors: Sequence[float], keys: Sequence[str] = (), weight: str | None = None,
                  coords: Sequence[str] = ("z1", "z2"), block: int = N.BLOCK, bound: int | None = None) -> DataFrame:
    """(keys, factor, score): weighted mean log density of each point under the density of all others."""
    dims = len(coords)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    data = keys_equal(df.select(*keys, ident, *coords, w.alias("__w0")), df.groupBy(*keys).agg(F.sum(w).alias("__t")), keys)
    placed = data.withColumn("__w", F.col("__w0") / F.col("__t")).where(F.col("__w") > 0).withColumn("__lw", F.ln("__w"))
    sums = N.log_kernel_sums(placed, keys, coords, ident, factors, "__lw", block=block, bound=bound)
    j = keys_equal(placed.select(*keys, ident, "__w"), sums, [*keys, ident])
    cells = F.array(*[F.struct(F.lit(float(f)).alias("factor"), (
        F.element_at("log_sums", i + 1) - dims * math.log(f) - 0.5 * dims * math.log(2 * math.pi) - F.log1p(-F.col("__w"))).alias("log_density")) for i, f in enumerate(factors)])
    long = j.select(*keys, "__w", F.explode(cells).alias("__c")).select(*keys, "__w", "__c.*")
    return long.groupBy(*keys, "factor").agg(F.sum(F.col("__w") * F.col("log_density")).alias("score"))


def best_factor(df: DataFrame, ident: str, coarse: Sequence[float], half_width: float, step: float, weight: str | None = None) -> tuple[float, float]:
    """Coarse then fine search of the bandwidth with the largest leave-one-out score."""
    def top(factors):
        scores = leave_one_out(df, ident, factors, weight=weight)
        row = scores.orderBy(F.desc("score"), F.col("factor")).first()      # one row per factor
        return float(row["factor"]), float(row["score"])
    centre, _ = top(coarse)
    fine = np.round(np.arange(max(step, centre - half_width), centre + half_width + step / 2, step), 6)
    return top([float(f) for f in fine])


def bootstrap_peaks(points: DataFrame, ident: str, reference: DataFrame, replicates: int, seed: int, n: int, coords=("pc1", "pc2"),
                    weight: str | None = None, tolerance: float = 1.0, bound: int | None = None, **options) -> DataFrame:
    """Share of resamples (n draws each) in which each reference centre is found again, and the spread of the hits.

    The replicate is a key of the draws only: all of them meet one order of the particles, and their densities are
    summed in one job.
    """
    base = points.select(ident, *coords, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    draws = points.sparkSession.range(replicates * n).select(F.col("id").alias("draw"), (F.floor(F.col("id") / n) + 1).cast("int").alias("replicate"))
    uniforms = draws.select("draw", X.uniform(seed, "replicate", F.pmod("draw", F.lit(n))).alias("u"))
    drawn = resample(base, n, seed, ident, uniforms=uniforms, bound=bound).withColumn("replicate", (F.floor(F.col("draw") / n) + 1).cast("int"))
    peaks = cloud_peaks(drawn, ["replicate"], coords, **options)
    hit = match_centres(peaks, reference, ["replicate"], tolerance)
    return hit.groupBy("reference").agg(
        F.count_if("recovered").alias("recovered"), (F.count_if("recovered") / F.lit(float(replicates))).alias("recovery_fraction"),
        F.stddev_pop("x").alias("sd_x"), F.stddev_pop("y").alias("sd_y"))


def group_permutations(df: DataFrame, ident: str, label: str, permutations: int, seed: int, bound: int | None = None) -> DataFrame:
    """(permutation, id, label): labels dealt to the rows in a hash-random order; permutation 0 is the observed one.

    Labels keep their counts. Both orders are running row numbers, joined on (permutation, position).
    """
    base = df.select(F.col(ident).alias("__id"), F.col(label).alias("__l"))
    place = settled(running(base, [], ["__id"], "__p", bound=bound))        # its copies below are unfolded anew, not written
    copies = place.withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("__h", X.uniform(seed, "permutation", "__id"))
    shuffled = running(copies, ["permutation"], ["__h", "__id"], "__q", bound=bound).select("permutation", F.col("__q").alias("__p"), F.col("__id").alias(ident))
    dealt = shuffled.join(place.select("__p", F.col("__l").alias(label)), "__p").select("permutation", ident, label)
    return dealt.unionByName(base.select(F.lit(0).alias("permutation"), F.col("__id").alias(ident), F.col("__l").alias(label)))


def profile_statistics(profiles: DataFrame, keys: Sequence[str], group: str, cutoff: float = 0.7) -> DataFrame:
    """Spread, exclusive parameters and peakedness of group profiles: (keys, group, parameter, strength).

    A profile is a few dozen numbers and groups are few, so group pairs are made inside one small array.
    """
    packed = profiles.groupBy(*keys, "parameter").agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), F.col("strength").alias("s")))).alias("__v"))
    above = F.size(F.filter("__v", lambda v: v["s"] > cutoff))
    pairs = F.flatten(F.transform("__v", lambda a: F.transform(F.filter("__v", lambda b: b["g"] > a["g"]), lambda b: F.struct(
        a["g"].alias("a"), b["g"].alias("b"), F.pow(a["s"] - b["s"], F.lit(2.0)).alias("d2")))))
    distance = packed.select(*keys, F.explode(pairs).alias("__p")).groupBy(*keys, "__p.a", "__p.b").agg(F.sqrt(F.sum("__p.d2")).alias("d"))
    spread = distance.groupBy(*keys).agg(F.avg("d").alias("spread"))
    exclusive = packed.groupBy(*keys).agg(F.count_if(above == 1).alias("exclusive"))
    peak = profiles.groupBy(*keys, group).agg(F.max("strength").alias("__m")).groupBy(*keys).agg(F.avg("__m").alias("peakedness"))
    return keys_equal(keys_equal(spread, exclusive, keys), peak, keys)


def permutation_p(statistics: DataFrame, names: Sequence[str] = ("spread", "exclusive", "peakedness")) -> DataFrame:
    """Observed value (permutation 0) against the others: (1 + not smaller) / (1 + permutations)."""
    long = melt(statistics, ["permutation"], names, "statistic", "value")
    observed = long.where("permutation = 0").select("statistic", F.col("value").alias("observed"))
    null = long.where("permutation > 0").join(observed, "statistic")
    return null.groupBy("statistic").agg(
        F.first("observed").alias("observed"), F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_sd"), F.percentile("value", F.lit(0.95)).alias("null_p95"),
        ((1 + F.count_if(F.col("value") >= F.col("observed"))) / (1 + F.count(F.lit(1)))).alias("p_one_sided"), F.count(F.lit(1)).alias("permutations"))


def permutation_test(df: DataFrame, ident: str, parameters, metrics, labels: DataFrame, group: str, k: int = 3, cutoff: float = 0.7, bound: int | None = None) -> DataFrame:
    """Whether groups differ in what informs on the metrics: profile statistics of the observed labels against permuted ones."""
    from simlens.operators.dependence import permutation_information

    profiles = cut(permutation_information(df, ident, parameters, metrics, labels, group, k, bound))
    return permutation_p(profile_statistics(profiles, ["permutation"], group, cutoff))


def mode_target_errors(points: DataFrame, peak: str, metrics: Sequence[str], targets: DataFrame) -> DataFrame:
    med = medians(melt(points, [peak], metrics), [peak, "metric"], "value")
    return med.join(targets.select("metric", "target"), "metric").withColumn("error_pct", X.absolute_percent_error("median", "target"))


def peak_changes(points: DataFrame, peak: str, distance: str, ident: str, columns: Sequence[str], prior: DataFrame, n: int = 50) -> DataFrame:
    """Median percent change from the prior mean of the n particles nearest each peak."""
    near = melt(nearest_rows(points, [peak], [distance, ident], n), [peak], columns, "parameter")
    mean = melt(prior, [], columns, "parameter").groupBy("parameter").agg(F.avg("value").alias("__m"))
    changed = near.join(mean, "parameter").withColumn("change", X.percent_change("value", "__m"))
    return medians(changed, [peak, "parameter"], "change", "median_change_pct")
