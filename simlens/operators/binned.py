"""Regression forests over binned parameters.

A split can only fall between bins, so a tree sees a row by its bins alone: rows of one cell (a bin on every parameter)
meet as three sums per tree. Equal rows are counted first; k of them weigh Poisson(k) in a tree, the sum of k bootstrap
draws of Poisson(1). The sums of a tree are at most one row per cell, and a tree is grown in one task from them.
All draws are hashes of seed, tree, row and node.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simlens.operators.ordered import keys_equal
from simlens.session import cut

BINS = 32
CELLS = 1 << 20         # cells of a forest, each at most one row of a task that grows a tree (about 100 MB and copies)
CODED = 12              # parameters in one bigint, five bits each
NODES = 1 << 15         # nodes whose histograms are held at once
BLOCK = 1 << 16         # cells that one tree predicts at once
TREE = "tree int, feature array<int>, split array<int>, below array<int>, above array<int>, value array<double>, gain array<double>"


def edges(df: DataFrame, parameters: Sequence[str]) -> list[list[float]]:
    """Per parameter the places of at most 31 splits: between all values if these are few, else near equal shares of the rows."""
    ps = list(parameters)
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    row = df.agg(*[F.percentile_approx(F.col(p).cast("double"), shares, F.lit(10000)).alias(f"q{i}") for i, p in enumerate(ps)],
                 *[F.approx_count_distinct(p).alias(f"n{i}") for i, p in enumerate(ps)]).first()
    lower = []
    for i, p in enumerate(ps):
        values = sorted(set(row[f"q{i}"] or []))
        if row[f"n{i}"] <= 2 * BINS:
            exact = sorted(float(r[0]) for r in df.select(p).distinct().collect())
            values = exact if len(exact) <= BINS else values
        lower.append(values)
    held = list(lower)

    def spans(batches):
        for pdf in batches:
            for i, p in enumerate(ps):
                x = pdf[p].to_numpy(float)
                out = pd.DataFrame({"p": i, "b": np.searchsorted(held[i], x), "x": x}).groupby(["p", "b"], as_index=False)["x"].min()
                yield out.astype({"p": "int32", "b": "int32"})
    first = {(r["p"], r["b"]): r["x"] for r in df.select(*[F.col(p).cast("double").alias(p) for p in ps]).mapInPandas(spans, "p int, b int, x double").groupBy("p", "b").agg(F.min("x").alias("x")).collect()}
    out = []
    for i, values in enumerate(lower):
        mine = []
        for b, low in enumerate(values):
            high = min((x for (p, c), x in first.items() if p == i and c > b), default=None)
            if high is not None:                                            # nothing lies above the largest value
                middle = low / 2 + high / 2
                mine.append(middle if low <= middle < high else low)
        out.append(sorted(set(mine)))
    return out


def _codes(d: int) -> list[str]:
    return [f"__c{i}" for i in range((d + CODED - 1) // CODED)]


def _splits_below(x: Column, places: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(v)) for v in places]), lambda v: v < x)) if places else F.lit(0)


def with_cells(df: DataFrame, parameters: Sequence[str], places: list[list[float]]) -> DataFrame:
    """Adds the cell of each row: one bigint for every twelve parameters. A value on a split lies below it."""
    d, out = len(parameters), df
    for j, c in enumerate(_codes(d)):
        code = F.lit(0).cast("bigint")
        for i in range(j * CODED, min((j + 1) * CODED, d)):
            code = code.bitwiseOR(F.shiftleft(_splits_below(F.col(parameters[i]).cast("double"), places[i]).cast("bigint"), 5 * (i - j * CODED)))
        out = out.withColumn(c, code)
    return out


def _bins(codes: list[np.ndarray], d: int) -> np.ndarray:
    return np.stack([(codes[i // CODED] >> (5 * (i % CODED))) & 31 for i in range(d)], axis=1).astype(np.int8)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson(u: np.ndarray, mean: int) -> np.ndarray:
    """Poisson draws from uniforms by the inverse distribution function."""
    wide = int(12 * math.sqrt(mean)) + 25
    at = np.arange(max(0, mean - wide), mean + wide)
    logs = at * math.log(mean) - mean - np.array([math.lgamma(j + 1.0) for j in at])
    return at[0] + np.minimum(np.searchsorted(np.cumsum(np.exp(logs)), u, side="right"), len(at) - 1)


def _drawn(seed: int, trees: int, codes: list[str], mean: float):
    """Sums of weights, weighted differences to about the mean and their squares of each tree and cell, from counted rows in the order of the cells."""
    def run(batches):
        lane = _mix(np.arange(trees, dtype=np.uint64) + (np.uint64(seed & 0xFFFFFFFF) << np.uint64(20)))
        for pdf in batches:
            for a in range(0, len(pdf), 8192):
                own = pdf.iloc[a:a + 8192]
                cell, y, count = own[codes].to_numpy(np.int64), own["__y"].to_numpy(float) - mean, own["__k"].to_numpy(np.int64)
                u = (_mix(own["__h"].to_numpy(np.int64).view(np.uint64)[:, None] ^ lane[None, :]) >> np.uint64(11)) * 2.0 ** -53
                w = np.empty(u.shape)
                for k in np.unique(count):
                    at = count == k
                    w[at] = _poisson(u[at], int(k))
                starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
                sums = [np.add.reduceat(v, starts, axis=0) for v in (w, w * y[:, None], w * (y * y)[:, None])]
                row, tree = np.nonzero(sums[0])
                yield pd.DataFrame({"tree": tree.astype(np.int32), **{c: cell[starts[row], i] for i, c in enumerate(codes)},
                                    **{n: s[row, tree] for n, s in zip(("w", "s", "q"), sums)}})
    return run


def _grow(bins: np.ndarray, w: np.ndarray, s: np.ndarray, q: np.ndarray, seed: int, tree: int, take: int, depth: int, mean: float) -> dict:
    """A tree level by level: at each node the best cut of ``take`` hash-drawn parameters, as long as it lowers the variance."""
    d = bins.shape[1]
    feature, split, below, above, value, gains = [], [], [], [], [], []
    node, path, made = np.zeros(len(w), dtype=np.int64), np.ones(1, dtype=np.uint64), 1
    lane = _mix(np.uint64([seed & 0xFFFFFFFF]) + (np.uint64(tree) << np.uint64(32)))
    for level in range(depth + 1):
        size = len(path)
        f, cut_at, best = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        total = [np.bincount(node, v, size) for v in (w, s, q)]
        if level < depth:
            draws = _mix(_mix(path ^ lane)[:, None] + np.arange(d, dtype=np.uint64)[None, :])
            tried = np.argsort(draws, axis=1, kind="stable")[:, :take]
            for a in range(0, size, NODES):                                 # cells lie in the order of their nodes
                b = min(a + NODES, size)
                lo, hi = np.searchsorted(node, [a, b])
                local, full = node[lo:hi] - a, [t[a:b, None] for t in total]
                noise = 4 * np.finfo(float).eps * full[2][:, 0]             # differences that rounding alone can make
                for j in range(take):
                    key = local * BINS + bins[np.arange(lo, hi), tried[node[lo:hi], j]]
                    wl, sl = (np.bincount(key, v[lo:hi], (b - a) * BINS).reshape(b - a, BINS).cumsum(axis=1) for v in (w, s))
                    wr, sr = full[0] - wl, full[1] - sl
                    ok = (wl > 0.5) & (wr > 0.5)                            # weights are whole numbers
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(ok, sl * sl / wl + sr * sr / wr - full[1] ** 2 / full[0], 0.0)
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(b - a), at]
                    better = (top > best[a:b]) & (top > noise)
                    best[a:b] = np.where(better, top, best[a:b])
                    f[a:b] = np.where(better, tried[a:b, j], f[a:b])
                    cut_at[a:b] = np.where(better, at, cut_at[a:b])
        inner = f >= 0
        place = np.cumsum(inner) - 1
        feature.append(f)
        split.append(cut_at)
        below.append(np.where(inner, made + 2 * place, -1))
        above.append(np.where(inner, made + 2 * place + 1, -1))
        value.append(total[1] / total[0] + mean)
        gains.append(best)
        if not inner.any():
            break
        made += 2 * int(inner.sum())
        open_ = inner[node]
        bins, w, s, q, node = bins[open_], w[open_], s[open_], q[open_], node[open_]
        right = bins[np.arange(len(node)), f[node]] > cut_at[node]
        node = 2 * place[node] + right
        order = np.argsort(node, kind="stable")
        bins, w, s, q, node = bins[order], w[order], s[order], q[order], node[order]
        path = np.stack([path[inner] * np.uint64(2), path[inner] * np.uint64(2) + np.uint64(1)], axis=1).ravel()
    names = ("feature", "split", "below", "above", "value", "gain")
    return {n: np.concatenate(v).astype(float if n in ("value", "gain") else np.int32) for n, v in zip(names, (feature, split, below, above, value, gains))}


class BinnedForest:
    """A grown forest: a table of trees, a row each, and the places of the splits."""

    def __init__(self, trees: DataFrame, parameters: Sequence[str], places: list[list[float]], number: int):
        self.trees, self.parameters, self.places, self.number = trees, list(parameters), places, number

    def importances(self) -> list[float]:
        """Shares of the variance that the splits of each parameter removed, averaged over the trees."""
        per = self.trees.select("tree", F.explode(F.arrays_zip("feature", "gain")).alias("n")).where("n.feature >= 0").groupBy("tree", "n.feature").agg(F.sum("n.gain").alias("g"))
        scores = np.zeros((self.number, len(self.parameters)))
        for r in per.collect():                                             # a row per tree and parameter
            scores[r["tree"], r["feature"]] = r["g"]
        sums = scores.sum(axis=1, keepdims=True)
        mean = np.divide(scores, sums, out=np.zeros_like(scores), where=sums > 0).sum(axis=0)
        return [float(v) for v in (mean / mean.sum() if mean.sum() > 0 else mean)]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``. Rows of one cell have one prediction, so cells meet the trees, not rows."""
        d, codes = len(self.parameters), _codes(len(self.parameters))
        rows = with_cells(df, self.parameters, self.places)
        cells = rows.select(*codes).distinct()
        lots = cells.withColumn("__lot", F.pmod(F.xxhash64(*codes), F.lit(max(1, math.ceil(cells.count() / BLOCK)))))
        blocks = lots.groupBy("__lot").agg(F.collect_list(F.struct(*codes)).alias("__cells")).select(*[F.col(f"__cells.{c}").alias(c) for c in codes])

        def run(batches):
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    own = [np.asarray(getattr(r, f"code{i}"), dtype=np.int64) for i in range(len(codes))]
                    bins, at = _bins(own, d), np.zeros(len(own[0]), dtype=np.int64)
                    f, split, below, above = (np.asarray(v) for v in (r.feature, r.split, r.below, r.above))
                    while (f[at] >= 0).any():
                        own_f = f[at]
                        go = np.where(bins[np.arange(len(at)), np.maximum(own_f, 0)] <= split[at], below[at], above[at])
                        at = np.where(own_f >= 0, go, at)
                    yield pd.DataFrame({**{c: v for c, v in zip(codes, own)}, "y": np.asarray(r.value, dtype=float)[at]})
        pairs = self.trees.drop("gain").crossJoin(blocks.select(*[F.col(c).alias(f"code{i}") for i, c in enumerate(codes)]))
        guessed = pairs.mapInPandas(run, ", ".join(f"{c} bigint" for c in codes) + ", y double").groupBy(*codes).agg(F.avg("y").alias("prediction"))
        return keys_equal(rows, guessed, codes).drop(*codes)


def grow(data: DataFrame, parameters: Sequence[str], metric: str, trees: int, seed: int, depth: int) -> BinnedForest | None:
    """The forest of complete rows (Poisson bootstrap, a third of the parameters at each node), or nothing where the cells are too many for tasks of their own."""
    ps, codes = list(parameters), _codes(len(parameters))
    about = data.agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("m")).first()
    if not about["n"]:
        return None
    places, mean = edges(data, ps), float(f"{about['m']:.6g}")        # near the mean; its last digits hang on the order of the rows
    binned = with_cells(data.withColumn("__y", F.col(metric).cast("double")), ps, places)
    counted = cut(binned.groupBy(*codes, "__y").agg(F.count(F.lit(1)).alias("__k")).withColumn("__h", F.xxhash64(F.lit(seed), *codes, "__y")))
    if counted.select(*codes).distinct().limit(CELLS + 1).count() > CELLS:
        return None
    dealt = counted.repartitionByRange(*codes, "__h").sortWithinPartitions(*codes, "__h")
    sums = dealt.mapInPandas(_drawn(seed, trees, codes, mean), "tree int, " + ", ".join(f"{c} bigint" for c in codes) + ", w double, s double, q double")
    d = len(ps)
    take = d if trees == 1 else math.ceil(d / 3)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        own = pdf.sort_values([*codes, "w", "s", "q"]).groupby(codes, sort=True, as_index=False)[["w", "s", "q"]].sum()
        sums_of = [own[n].to_numpy(float) for n in ("w", "s", "q")]
        grown = _grow(_bins([own[c].to_numpy(np.int64) for c in codes], d), *sums_of, seed, tree, take, depth, mean)
        return pd.DataFrame({"tree": [tree], **{n: [v] for n, v in grown.items()}})
    return BinnedForest(cut(sums.groupBy("tree").applyInPandas(one, TREE)), ps, places, trees)
