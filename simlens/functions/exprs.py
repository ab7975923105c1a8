"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- missing values -------------------------------------------------------------------------

def finite(c) -> Column:
    """NaN and +-inf become NULL."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(INF)), None).otherwise(x)


def finite_round(c, digits: int = 6) -> Column:
    return F.bround(finite(c), digits)


# --- moments that do not raise on constant input ---------------------------------------------

def safe_corr(x, y) -> Column:
    return F.try_divide(F.covar_pop(col(x), col(y)), F.stddev_pop(col(x)) * F.stddev_pop(col(y)))


def pair_corr(x, y) -> Column:
    """Correlation over rows where both sides are present."""
    both = col(x).isNotNull() & col(y).isNotNull()
    return safe_corr(F.when(both, col(x)), F.when(both, col(y)))


def safe_r2(y, x) -> Column:
    r = pair_corr(x, y)
    return r * r


# --- errors -----------------------------------------------------------------------------------

def signed_percent_error(value, target) -> Column:
    return F.try_divide(col(value) - col(target), F.abs(col(target))) * 100.0


def absolute_percent_error(value, target) -> Column:
    return F.abs(signed_percent_error(value, target))


def squared_error(value, target) -> Column:
    return F.pow(col(value) - col(target), F.lit(2.0))


def absolute_error(value, target) -> Column:
    return F.abs(col(value) - col(target))


def percent_change(value, reference) -> Column:
    return F.try_divide(col(value) - col(reference), col(reference)) * 100.0


# --- ids and names ----------------------------------------------------------------------------

def folder_number(c, strict: bool = False) -> Column:
    """``input_12`` -> 12; without a match -1, or an error when strict."""
    digits = F.regexp_extract(col(c), r"input_(\d+)", 1)
    number = F.when(digits != "", digits.cast("int"))
    if strict:
        return F.coalesce(number, F.raise_error(F.concat(F.lit("no particle id in "), col(c))).cast("int"))
    return F.coalesce(number, F.lit(-1))


def embedded_number(c) -> Column:
    """First run of digits of a string, as an integer, for sorting."""
    return F.when(F.regexp_extract(col(c), r"(\d+)", 1) != "", F.regexp_extract(col(c), r"(\d+)", 1).cast("bigint"))


def spacing(c) -> Column:
    """``"*:n"`` or ``"a:b"`` -> last part as an integer."""
    return F.element_at(F.split(col(c), ":"), -1).cast("int")


def base_name(c) -> Column:
    return F.regexp_replace(col(c), "(_MU|_SIGMA)$", "")


def display_name(c) -> Column:
    words = F.lower(F.regexp_replace(base_name(c), "_", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1000000))


def title_name(c) -> Column:
    return F.initcap(F.regexp_replace(base_name(c), "_", " "))


def bounded(c, low: float | None = 0.0, high: float | None = 1.0, digits: int = 3) -> Column:
    x = col(c)
    if high is not None:
        x = F.least(F.lit(float(high)), x)
    if low is not None:
        x = F.greatest(F.lit(float(low)), x)
    return F.bround(x, digits)


def signed_r(r, slope) -> Column:
    return F.when(col(slope) < 0, -F.abs(col(r))).otherwise(F.abs(col(r)))


# --- ranges and priors --------------------------------------------------------------------------

def to_unit(c, lo, hi, clip: tuple[float, float] | None = None) -> Column:
    """Position inside a range; NULL when the range is empty."""
    u = F.try_divide(col(c) - col(lo), F.nullif(col(hi) - col(lo), F.lit(0.0)))
    if clip is not None:
        u = F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), u))
    return u


def in_box(bounds: dict[str, tuple[float, float]]) -> Column:
    return reduce(lambda a, b: a & b,
                  [F.coalesce(F.col(p).between(float(lo), float(hi)), F.lit(False)) for p, (lo, hi) in bounds.items()])


def uniform_density(bounds: dict[str, tuple[float, float]]) -> Column:
    volume = math.prod(hi - lo for lo, hi in bounds.values() if hi > lo)
    return F.when(in_box(bounds), F.lit(1.0 / volume)).otherwise(F.lit(0.0))


def log_uniform_triangle_density(rates: dict[str, tuple[float, float]],
                                 pair: dict[str, tuple[float, float]], limit: float = 1.0) -> Column:
    """Log-uniform rates times a uniform density on the part of a box where the pair sums to at most ``limit``."""
    (a, (alo, ahi)), (b, (blo, bhi)) = pair.items()
    area = _area_under_line(alo, ahi, blo, bhi, limit)
    density = reduce(lambda x, y: x * y,
                     [F.try_divide(F.lit(1.0), F.col(p) * math.log(hi / lo)) for p, (lo, hi) in rates.items()],
                     F.lit(1.0 / area))
    inside = in_box({**rates, **pair}) & (F.col(a) + F.col(b) <= limit)
    return F.when(inside, density).otherwise(F.lit(0.0))


def _area_under_line(alo, ahi, blo, bhi, limit) -> float:
    """Area of {a in [alo,ahi], b in [blo,bhi], a+b <= limit}."""
    full_until = min(max(limit - bhi, alo), ahi)
    empty_from = min(max(limit - blo, alo), ahi)
    slanted = (limit - blo) * (empty_from - full_until) - (empty_from ** 2 - full_until ** 2) / 2
    return (full_until - alo) * (bhi - blo) + slanted


# --- draws that depend only on seed and ids -------------------------------------------------------

def uniform(seed: int, *ids) -> Column:
    """Uniform in [0,1), a pure function of the seed and the ids, so any partitioning gives the same draw."""
    h = F.xxhash64(F.lit(seed), *[col(i) for i in ids])
    return F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53)


def normal(seed: int, *ids) -> Column:
    """Standard normal by Box-Muller on two hash uniforms."""
    u1 = F.greatest(uniform(seed, F.lit("r"), *ids), F.lit(2.0 ** -53))
    u2 = uniform(seed, F.lit("a"), *ids)
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * math.pi * u2)


def poisson_one(seed: int, *ids) -> Column:
    return poisson(1.0, seed, *ids)


def poisson_steps(mean: float) -> list[float]:
    """Cumulative probabilities of a Poisson variable until the rest is below the resolution of a uniform."""
    if not 0 <= mean <= 700:
        raise ValueError("the Poisson mean must lie between 0 and 700")
    out, term, acc, k = [], math.exp(-mean), 0.0, 0
    while k <= mean or term > 2.0 ** -60:
        acc += term
        out.append(acc)
        k += 1
        term *= mean / k
    return out


def poisson(mean: float, seed: int, *ids) -> Column:
    """Poisson draw by inversion: number of cumulative probabilities not above the uniform."""
    u = uniform(seed, *ids)
    return F.size(F.filter(F.array(*[F.lit(c) for c in poisson_steps(mean)]), lambda c: c <= u))


# --- the same draws for numpy code inside tasks: ids are (format, value) pairs or strings ------------

def hash_of(*ids) -> int:
    """The signed 64-bit hash that ``xxhash64`` gives for int ("i"), bigint ("q") and string values."""
    import struct

    import xxhash
    h = 42
    for own in ids:
        h = xxhash.xxh64_intdigest(own.encode() if isinstance(own, str) else struct.pack("<" + own[0], int(own[1])), h)
    return h - 2 ** 64 if h >= 2 ** 63 else h


def uniform_of(seed: int, *ids) -> float:
    return (hash_of(("i", seed), *ids) % (1 << 53)) / float(1 << 53)


def normal_of(seed: int, *ids) -> float:
    u1 = max(uniform_of(seed, "r", *ids), 2.0 ** -53)
    return math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * uniform_of(seed, "a", *ids))


def poisson_of(mean: float, seed: int, *ids) -> int:
    u = uniform_of(seed, *ids)
    return sum(c <= u for c in poisson_steps(mean))


def uniforms_of(ids: np.ndarray):
    """A function of the hash of all ids before: the uniforms of many rows whose last id is an int32, an int64 or a string."""
    from functools import partial

    if ids.dtype.kind not in "iu":
        return partial(_uniforms_of_strings, [v.encode() for v in ids])
    first, second, third, fourth, fifth = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    wide = ids.dtype.itemsize == 8
    if wide:
        word, turn, times, plus = ids.astype(np.int64).view(np.uint64) * second, 27, first, fourth
        word = (word << np.uint64(31) | word >> np.uint64(33)) * first
    else:
        word, turn, times, plus = ids.astype(np.int32).view(np.uint32).astype(np.uint64) * first, 23, second, third

    def draw(at: int) -> np.ndarray:
        h = word ^ np.uint64((at + int(fifth) + (8 if wide else 4)) % (1 << 64))
        more = h << np.uint64(turn)
        h >>= np.uint64(64 - turn)
        h |= more
        h *= times
        h += plus
        for shift, factor in ((33, second), (29, third), (32, None)):
            np.right_shift(h, np.uint64(shift), out=more)
            h ^= more
            if factor is not None:
                h *= factor
        h &= np.uint64((1 << 53) - 1)
        return h / float(1 << 53)
    return draw


def counts_of(u: np.ndarray, steps) -> np.ndarray:
    """Number of steps not above each uniform; few of them are above the first ones."""
    out = np.zeros(len(u), dtype=np.int64)
    for k, step in enumerate(steps):
        if k < 4:
            out += u >= step
        else:
            high = np.flatnonzero(u >= steps[k])
            out[high] += np.searchsorted(steps[k:], u[high], side="right")
            break
    return out


def _uniforms_of_strings(ids: list[bytes], at: int) -> np.ndarray:
    import xxhash
    h = np.fromiter((xxhash.xxh64_intdigest(v, at % (1 << 64)) for v in ids), np.uint64, len(ids))
    return (h & np.uint64((1 << 53) - 1)) / float(1 << 53)


# --- special functions ------------------------------------------------------------------------------

def digamma_int(n) -> Column:
    """psi(n) for integers: exact harmonic sum below 32, asymptotic series above (error below 1e-15)."""
    x = col(n).cast("double")
    table, h = [F.lit(None).cast("double")], -0.57721566490153286061
    for k in range(1, 33):
        table.append(F.lit(h))
        h += 1.0 / k
    inv2 = 1.0 / (x * x)
    series = F.ln(x) - 0.5 / x - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    return F.when(x < 33, F.element_at(F.array(*table), x.cast("int") + 1)).otherwise(series)


#: Complementary error function, element by element.
complement = np.vectorize(math.erfc, otypes=[float])


@F.pandas_udf(DoubleType())
def normal_below(z: pd.Series) -> pd.Series:
    """Share of the standard normal distribution below z."""
    return pd.Series(0.5 * complement(-z.to_numpy(float) / math.sqrt(2.0)))


@F.pandas_udf(DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    return pd.Series(complement(np.abs(z.to_numpy(float)) / math.sqrt(2.0)))


def _betacf(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation of n rows (t distribution with n-2 degrees)."""
    def one(rv, nv):
        if rv != rv or nv is None or nv < 3:
            return None
        if abs(rv) >= 1:
            return 0.0
        df = nv - 2
        return _betainc(df / 2, 0.5, 1 - rv * rv)
    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")
