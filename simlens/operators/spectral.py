"""Cross-correlation of two long series by a Fourier transform that is spread over tasks.

A series of n rows is padded to M = N1 * N2 >= 2n and read as a table of N1 rows and N2 columns. Transforms of columns,
a twist, and transforms of rows give the spectrum; the product of spectra goes back the same way. Columns and rows are
dealt to tasks in strips of ``STRIP``, so a task holds about STRIP * sqrt(2n) numbers, three shuffles move each number
once as blocks of STRIP * STRIP, and the work is n log n. No two rows of the series are ever paired.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlens.operators.ordered import keys_equal, running
from simlens.session import cut

STRIP = 64
#: Sums closer than this share of the largest possible one are equal: rounding of the transforms does not choose among them.
EQUAL = 1e-9


def _shape(n: int) -> tuple[int, int]:
    """Rows and columns of the table for n values: powers of two, about equal."""
    bits = max(0, int(2 * n - 2).bit_length())
    return 1 << (bits + 1) // 2, 1 << bits // 2


def _rows_of(strip: int, n1: int) -> np.ndarray:
    """Rows of the spectrum in a strip; row r is always with row N1 - r, which holds the mirrored frequencies."""
    m = np.arange(strip * STRIP, min((strip + 1) * STRIP, n1 // 2 + 1))
    return np.unique(np.concatenate([m, (n1 - m) % n1]))


def _spectrum(z: np.ndarray, rows: np.ndarray, n1: int) -> np.ndarray:
    """Product of the spectrum of the real part's series and the conjugate one of the imaginary part's, row by row."""
    mirror = np.searchsorted(rows, (n1 - rows) % n1)
    other = np.conj(z[mirror][:, ::-1])                     # frequency M - k of row r, column c lies in row N1 - r, column N2 - 1 - c
    zero = np.flatnonzero(rows == 0)
    other[zero] = np.roll(other[zero], 1, axis=1)           # in row 0 the columns count from 0
    return (z + other) / 2 * np.conj((z - other) / 2j)


def cross_correlation(series: DataFrame, keys: Sequence[str], order: Sequence[str], a: str, b: str, bound: int | None = None) -> DataFrame:
    """(keys, n, scale, lags, sums): sum of (a[t + lag] - mean a) * (b[t] - mean b) for all lags of each group, in strips.

    Rows are numbered by ``order``; those without a or b are left out. ``scale`` is the largest value a sum can take.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    base = series.select(*keys, *[c for c in order if c not in keys], x.alias("__a"), y.alias("__b")).where("__a IS NOT NULL AND __b IS NOT NULL")
    numbered = running(base, keys, order, number="__p", bound=bound)
    moments = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("__a").alias("__ma"), F.avg("__b").alias("__mb"),
                                      F.sqrt(F.var_pop("__a") * F.var_pop("__b")).alias("__s"))
    rows = keys_equal(numbered, moments, keys)
    bits = F.when(F.col("n") > 1, F.length(F.bin(2 * F.col("n") - 2))).otherwise(0)         # as in _shape
    columns = F.pow(F.lit(2.0), F.floor(bits / 2)).cast("bigint")
    place = F.col("__p") - 1
    rows = rows.select(*keys, "n", (F.col("__s") * F.col("n")).alias("scale"), place.alias("__p"), (F.col("__a") - F.col("__ma")).alias("__a"),
                       (F.col("__b") - F.col("__mb")).alias("__b"), F.floor(F.pmod(place, columns) / STRIP).cast("int").alias("g"))
    types = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    head = [*keys, "n", "scale"]
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "n bigint, scale double, "
    block = schema + "g int, h int, re array<double>, im array<double>"

    def emitted(pdf: pd.DataFrame, parts: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
        out = pd.concat([pdf[head].iloc[:1]] * len(parts), ignore_index=True)
        out["g"], out["h"] = np.array([p[0] for p in parts], np.int32), np.array([p[1] for p in parts], np.int32)
        out["re"] = [p[2].real.ravel() for p in parts]
        out["im"] = [p[2].imag.ravel() for p in parts]
        return out

    def blocks(pdf: pd.DataFrame, name: str) -> dict[int, np.ndarray]:
        return {int(k): np.asarray(re) + 1j * np.asarray(im) for k, re, im in zip(pdf[name], pdf["re"], pdf["im"])}

    def columns_forward(pdf: pd.DataFrame) -> pd.DataFrame:
        n1, n2 = _shape(int(pdf["n"].iloc[0]))
        g = int(pdf["g"].iloc[0])
        own = np.arange(g * STRIP, min((g + 1) * STRIP, n2))
        z = np.zeros((n1, len(own)), dtype=complex)
        p = pdf["__p"].to_numpy(np.int64)
        z[p // n2, p % n2 - own[0]] = pdf["__a"].to_numpy() + 1j * pdf["__b"].to_numpy()
        z = np.fft.fft(z, axis=0) * np.exp(-2j * np.pi / (n1 * n2) * (np.arange(n1)[:, None] * own))
        return emitted(pdf, [(g, h, z[_rows_of(h, n1)]) for h in range(n1 // 2 // STRIP + 1)])

    def rows_round(pdf: pd.DataFrame) -> pd.DataFrame:
        n1, n2 = _shape(int(pdf["n"].iloc[0]))
        h = int(pdf["h"].iloc[0])
        rows_, held = _rows_of(h, n1), blocks(pdf, "g")
        strips = range(-(-n2 // STRIP))
        width = {g: min((g + 1) * STRIP, n2) - g * STRIP for g in strips}
        z = np.concatenate([held[g].reshape(len(rows_), width[g]) if g in held else np.zeros((len(rows_), width[g])) for g in strips], axis=1)
        s = _spectrum(np.fft.fft(z, axis=1), rows_, n1)
        back = np.fft.ifft(s, axis=1) * np.exp(2j * np.pi / (n1 * n2) * (rows_[:, None] * np.arange(n2)))
        return emitted(pdf, [(g, h, back[:, g * STRIP:(g + 1) * STRIP]) for g in strips])

    def columns_back(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        n1, n2 = _shape(n)
        g = int(pdf["g"].iloc[0])
        own = np.arange(g * STRIP, min((g + 1) * STRIP, n2))
        z = np.zeros((n1, len(own)), dtype=complex)
        for h, values in blocks(pdf, "h").items():
            z[_rows_of(h, n1)] = values.reshape(-1, len(own))
        sums = np.fft.ifft(z, axis=0).real
        at = np.arange(n1)[:, None] * n2 + own
        lags = np.where(at < n, at, at - n1 * n2)
        kept = np.abs(lags) < n
        out = pdf[head].iloc[:1].reset_index(drop=True)
        out["lags"], out["sums"] = [lags[kept]], [sums[kept]]
        return out

    spectra = rows.groupBy(*head, "g").applyInPandas(columns_forward, block)
    back = spectra.groupBy(*head, "h").applyInPandas(rows_round, block)
    return back.groupBy(*head, "g").applyInPandas(columns_back, schema + "lags array<bigint>, sums array<double>")


def best_lag(series: DataFrame, keys: Sequence[str], order: Sequence[str], a: str, b: str, name: str = "lag", bound: int | None = None) -> DataFrame:
    """(keys, lag): by how many rows ``a`` follows ``b`` where their full cross-correlation is largest; the smallest such lag.

    Sums that differ by less than ``EQUAL`` of the largest possible one count as equal, so a constant series gives 1 - n.
    """
    strips = cut(cross_correlation(series, keys, order, a, b, bound))
    top = strips.groupBy(*keys).agg(F.max(F.array_max("sums")).alias("__top"))
    near = keys_equal(strips, top, keys).select(*keys, F.array_min(F.transform(F.filter(
        F.arrays_zip("lags", "sums"), lambda s: s["sums"] >= F.col("__top") - EQUAL * F.col("scale")), lambda s: s["lags"])).alias("__lag"))
    return near.groupBy(*keys).agg(F.min("__lag").alias(name))
