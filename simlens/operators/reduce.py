"""Model reduction: correlation graphs, prediction chains, loading similarity and Ward groups.

Spark reduces the rows to one moment matrix per group; a matrix over parameters (a few dozen) is the largest thing a
helper sees.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from simlens.functions import exprs as X
from simlens.operators.dependence import from_moments, moments
from simlens.operators.ordered import keys_equal
from simlens.session import cut


def _correlation(cov: np.ndarray) -> np.ndarray:
    """Correlation with 0 for constant columns and a unit diagonal."""
    sd = np.sqrt(np.diag(cov))
    r = np.divide(cov, np.outer(sd, sd), out=np.zeros_like(cov), where=np.outer(sd, sd) > 0)
    r = np.clip((r + r.T) / 2, -1, 1)
    np.fill_diagonal(r, 1.0)
    return r


def correlation_edges(df: DataFrame, columns: Sequence[str], threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """Undirected edges (a, b, r) with |r| above the threshold."""
    names = list(columns)

    def edges(n, mean, cov):
        r = _correlation(cov)
        return [(names[i], names[j], abs(float(r[i, j]))) for i in range(len(names)) for j in range(i + 1, len(names)) if abs(r[i, j]) > threshold]
    return from_moments(moments(df, names, keys), keys, edges, "a string, b string, r double")


def components(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, component): smallest reachable name, by passing labels along edges until none changes."""
    both = cut(edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(*keys, F.col("b").alias("node"), F.col("a").alias("other"))))
    labels = cut(both.select(*keys, "node").distinct().withColumn("component", F.col("node")))
    while True:          # a label moves at least one edge a round, so this ends
        seen = keys_equal(both, labels.withColumnRenamed("node", "other"), [*keys, "other"])
        best = seen.groupBy(*keys, "node").agg(F.min("component").alias("__best"))
        step = cut(keys_equal(labels, best, [*keys, "node"], "left").withColumn("__new", F.least("component", F.coalesce("__best", F.col("component")))))
        changed = not step.where(F.col("__new") < F.col("component")).isEmpty()
        labels = step.select(*keys, "node", F.col("__new").alias("component"))
        if not changed:
            return labels


def component_roots(edges: DataFrame, labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Root of each component: most edges, then largest mean |r|, then name."""
    ends = edges.select(*keys, F.col("a").alias("node"), "r").unionByName(edges.select(*keys, F.col("b").alias("node"), "r"))
    degree = ends.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("degree"), F.avg("r").alias("mean_r"))
    j = keys_equal(labels, degree, [*keys, "node"])
    key = F.struct(-F.col("degree"), -F.col("mean_r"), F.col("node"))
    return j.groupBy(*keys, "component").agg(F.min_by("node", key).alias("root"), F.count(F.lit(1)).alias("size"))


def prediction_models(df: DataFrame, columns: Sequence[str], threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """Greedy spanning prediction: (target, predictor, step, slope, intercept, r, r2), in the order of prediction.

    From the root of each component the strongest edge that leaves the predicted set is taken next.
    """
    names = list(columns)

    def span(n, mean, cov):
        r = np.abs(_correlation(cov))
        p = len(names)
        link = (r > threshold) & ~np.eye(p, dtype=bool)
        out, seen = [], set()
        for start in range(p):
            if start in seen:
                continue
            group, stack = {start}, [start]
            while stack:
                for j in np.flatnonzero(link[stack.pop()]):
                    if int(j) not in group:
                        group.add(int(j))
                        stack.append(int(j))
            seen |= group
            if len(group) < 2:
                continue
            root = min(group, key=lambda i: (-link[i].sum(), -r[i][link[i]].mean(), i))
            known, step = [root], 0
            while len(known) < len(group):
                strength, x, y = max(((r[i, j], -known.index(i), -j) for i in known for j in group if j not in known and link[i, j]), default=(None, 0, 0))
                x, y = known[-x], -y
                slope = cov[x, y] / cov[x, x]
                step += 1
                out.append((names[y], names[x], step, float(slope), float(mean[y] - slope * mean[x]), float(strength), float(strength ** 2)))
                known.append(y)
        return out
    return from_moments(moments(df, names, keys), keys, span, "target string, predictor string, step int, slope double, intercept double, r double, r2 double")


def apply_models(df: DataFrame, models: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """Adds each target from its predictor, in dependency order; targets whose predictor never appears stay absent.

    ``models``: a short list of (target, predictor, slope, intercept).
    """
    waiting, out = list(models), df
    while waiting:
        ready = [m for m in waiting if m[1] in out.columns]
        if not ready:
            break
        out = out.withColumns({t: F.col(p) * float(s) + float(i) for t, p, s, i in ready})
        waiting = [m for m in waiting if m not in ready]
    return out


def prediction_quality(df: DataFrame, pairs: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """(target, r2, rmse, mae, lo, hi) of predicted columns against observed ones over present pairs."""
    cells = []
    for observed, predicted in pairs.items():
        both = F.col(observed).isNotNull() & F.col(predicted).isNotNull()
        e = F.when(both, F.col(observed) - F.col(predicted))
        y = F.when(both, F.col(observed))
        cells.append(F.struct(F.lit(observed).alias("target"), (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"),
                              F.avg(F.abs(e)).alias("mae"), F.min(predicted).alias("lo"), F.max(predicted).alias("hi"), F.count(e).alias("n")))
    return df.groupBy(*keys).agg(F.array(*cells).alias("__c")).select(*keys, F.explode("__c").alias("__c")).select(*keys, "__c.*")


def prediction_paths(models: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All paths root -> ... -> parameter through the model table: (root, node, path, r2s), cycle-safe."""
    targets = models.select(*keys, F.col("target").alias("predictor")).distinct()
    roots = models.select(*keys, "predictor").distinct().join(targets, [*keys, "predictor"], "left_anti")
    edge = cut(models.select(*keys, F.col("predictor").alias("node"), F.col("target").alias("__next"), F.col("r2").alias("__r2")))
    front = roots.select(*keys, F.col("predictor").alias("root"), F.col("predictor").alias("node"), F.array("predictor").alias("path"), F.array().cast("array<double>").alias("r2s"))
    out = front
    while True:          # paths visit no node twice, so this ends
        step = keys_equal(front, edge, [*keys, "node"]).where(~F.array_contains("path", F.col("__next")))
        front = cut(step.select(*keys, "root", F.col("__next").alias("node"), F.concat("path", F.array("__next")).alias("path"), F.concat("r2s", F.array("__r2")).alias("r2s")))
        if front.isEmpty():
            return out
        out = out.unionByName(front)


def parameter_chains(pairs: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Greedy chains over strong pairs: (chain, position, parameter, r2 to the previous one).

    ``pairs``: (keys, a, b, r2), a row per parameter pair. Roots go by number of strong pairs, then order of appearance.
    """
    rows = F.array_sort(F.collect_list(F.struct((-F.col("r2")).alias("m"), F.col("a").alias("a"), F.col("b").alias("b"))))
    packed = pairs.where(F.col("r2") >= threshold).groupBy(*keys).agg(rows.alias("__p"))
    types = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    names = list(keys)

    def chain(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                near: dict[str, list] = {}
                for e in rec["__p"]:
                    near.setdefault(e["a"], []).append((-e["m"], e["b"]))
                    near.setdefault(e["b"], []).append((-e["m"], e["a"]))
                taken: set = set()
                number = 0
                for root in sorted(near, key=lambda p: (-len(near[p]), list(near).index(p))):
                    if root in taken:
                        continue
                    line = [(root, None)]
                    while True:
                        free = [(r2, q) for r2, q in near[line[-1][0]] if q not in taken and all(q != x for x, _ in line)]
                        if not free:
                            break
                        r2, q = max(free, key=lambda x: x[0])
                        line.append((q, r2))
                    if len(line) > 1:
                        number += 1
                        taken |= {x for x, _ in line}
                        out += [(*[rec[k] for k in names], number, i, x, r2) for i, (x, r2) in enumerate(line)]
            yield pd.DataFrame(out, columns=[*names, "chain", "position", "parameter", "r2"])
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in names], "chain int, position int, parameter string, r2 double"])
    return packed.mapInPandas(chain, schema)


def classify_parameters(chains: DataFrame, parameters: Sequence[str], groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each parameter of each group as root, derived or independent."""
    grid = groups.select(*keys).distinct().withColumn("parameter", F.explode(F.array(*[F.lit(p) for p in parameters])))
    j = keys_equal(grid, chains.select(*keys, "parameter", "position"), [*keys, "parameter"], "left")
    return j.select(*keys, "parameter", F.when(F.col("position") == 0, "root").when(F.col("position") > 0, "derived").otherwise("independent").alias("role"))


# --- Ward and loadings ------------------------------------------------------------------------------------

def ward_merges(points: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Ward linkage of a few dozen points: (left, right, height, size), ids above the number of points are merges."""
    d2 = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    return _ward(d2)


def _ward(d2: np.ndarray) -> list[tuple[int, int, float, int]]:
    n = len(d2)
    d2 = d2.astype(float).copy()
    np.fill_diagonal(d2, np.inf)
    ids, size, merges = list(range(n)), [1] * n, []
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(d2)), len(d2))
        i, j = min(i, j), max(i, j)
        height2, ni, nj = d2[i, j], size[i], size[j]
        merges.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(np.sqrt(height2)), ni + nj))
        nk = np.array(size, dtype=float)
        joined = ((ni + nk) * d2[i] + (nj + nk) * d2[j] - nk * height2) / (ni + nj + nk)
        d2[i], d2[:, i] = joined, joined
        d2[i, i] = np.inf
        d2 = np.delete(np.delete(d2, j, 0), j, 1)
        ids[i], size[i] = n + step, ni + nj
        del ids[j], size[j]
    return merges


def cut_tree(merges, n: int, height: float) -> np.ndarray:
    """Labels 1.. in order of first member after all merges up to the height."""
    parent = list(range(2 * n))
    for k, (a, b, h, _) in enumerate(merges):
        if h <= height:
            parent[a] = parent[b] = n + k

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    order: dict[int, int] = {}
    return np.array([order.setdefault(top(i), len(order) + 1) for i in range(n)])


def ward_groups(df: DataFrame, columns: Sequence[str], thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Ward clusters of correlation rows at several heights: (threshold, parameter, cluster, representative, is_representative)."""
    names = list(columns)

    def group(n, mean, cov):
        r = _correlation(cov)
        merges = ward_merges(r)
        out = []
        for t in thresholds:
            labels = cut_tree(merges, len(names), t)
            for label in np.unique(labels):
                members = np.flatnonzero(labels == label)
                centre = r[members].mean(axis=0)
                rep = members[int(np.argmin(((r[members] - centre) ** 2).sum(axis=1)))]
                out += [(float(t), names[i], int(label), names[rep], bool(i == rep)) for i in members]
        return out
    return from_moments(moments(df, names, keys), keys, group, "threshold double, parameter string, cluster int, representative string, is_representative boolean")


def ward_tree(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Linkage rows with the members of each merge."""
    names = list(columns)

    def tree(n, mean, cov):
        below = {i: [names[i]] for i in range(len(names))}
        out = []
        for k, (a, b, h, size) in enumerate(ward_merges(_correlation(cov))):
            below[len(names) + k] = below[a] + below[b]
            out.append((k, a, b, h, size, sorted(below[len(names) + k])))
        return out
    return from_moments(moments(df, names, keys), keys, tree, "step int, left_id int, right_id int, height double, size int, members array<string>")


def ward_height_for(df: DataFrame, columns: Sequence[str], groups: int, members: int, keys: Sequence[str] = ()) -> DataFrame:
    """Largest merge height that leaves at least ``groups`` clusters of at least ``members`` parameters."""
    names = list(columns)

    def search(n, mean, cov):
        merges = ward_merges(_correlation(cov))
        for h in sorted({m[2] for m in merges}, reverse=True):
            labels = cut_tree(merges, len(names), h)
            if (np.bincount(labels)[1:] >= members).sum() >= groups:
                return [(h, int(labels.max()))]
        return [(None, None)]
    return from_moments(moments(df, names, keys), keys, search, "height double, clusters int")


def closest_rows(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), n: int = 10) -> DataFrame:
    """Parameter pairs with the nearest correlation rows."""
    names = list(columns)

    def pairs(count, mean, cov):
        r = _correlation(cov)
        found = sorted((float(((r[i] - r[j]) ** 2).sum()), names[i], names[j]) for i in range(len(names)) for j in range(i + 1, len(names)))
        return [(k + 1, a, b, d) for k, (d, a, b) in enumerate(found[:n])]
    return from_moments(moments(df, names, keys), keys, pairs, "rank int, a string, b string, d2 double")


def _loadings(cov: np.ndarray):
    r = _correlation(cov)
    values, vectors = np.linalg.eigh(r)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return r, values, vectors * np.where(sign == 0, 1, sign)


def spectrum(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Singular values of the standardised sample and explained shares (running sum included)."""
    def values(n, mean, cov):
        _, v, _ = _loadings(cov)
        share = v / v.sum()
        return [(i + 1, float(np.sqrt(v[i] * n)), float(share[i]), float(share[:i + 1].sum())) for i in range(len(v))]
    return from_moments(moments(df, columns, keys), keys, values, "component int, singular_value double, explained double, cumulative double")


def loading_importance(df: DataFrame, columns: Sequence[str], components_used: int, keys: Sequence[str] = ()) -> DataFrame:
    """Sum over leading components of |loading| weighted by explained variance."""
    names = list(columns)

    def score(n, mean, cov):
        _, v, q = _loadings(cov)
        w = (v / v.sum())[:components_used]
        s = np.abs(q[:, :components_used]) @ w
        return [(p, float(x)) for p, x in zip(names, s)]
    return from_moments(moments(df, names, keys), keys, score, "parameter string, importance double")


def redundancy_groups(df: DataFrame, columns: Sequence[str], threshold: float = 0.7, method: str = "loading_similarity", keys: Sequence[str] = (),
                      explained: float = 0.8, most: int | None = None) -> DataFrame:
    """Groups of parameters with alike weighted loadings (Ward) or linked correlations: (group, parameter, similarity, representative).

    ``similarity`` is the mean similarity to the other members; the representative has the largest one.
    """
    names = list(columns)
    if method not in ("loading_similarity", "correlation_clustering"):
        raise ValueError("method must be loading_similarity or correlation_clustering")

    def group(n, mean, cov):
        r, v, q = _loadings(cov)
        if method == "loading_similarity":
            share = v / v.sum()
            k = int(np.argmax(np.cumsum(share) >= explained)) + 1
            k = k if most is None else min(k, most)
            if k < 2:
                return []
            weighted = q[:, :k] * np.sqrt(share[:k])
            sim = np.abs(np.nan_to_num(np.corrcoef(weighted)))
            np.fill_diagonal(sim, 1.0)
            labels = cut_tree(_ward((1 - sim) ** 2), len(names), 1 - threshold)
        else:
            sim = np.abs(r)
            labels = np.arange(len(names))
            for _ in names:
                labels = np.array([labels[sim[i] >= threshold].min() for i in range(len(names))])
        out, number = [], 0
        for label in dict.fromkeys(labels.tolist()):
            m = np.flatnonzero(labels == label)
            if len(m) < 2:
                continue
            number += 1
            mean_sim = (sim[np.ix_(m, m)].sum(axis=1) - 1) / (len(m) - 1)
            out += [(number, names[i], float(s), bool(j == int(np.argmax(mean_sim)))) for j, (i, s) in enumerate(zip(m, mean_sim))]
        return out
    return from_moments(moments(df, names, keys), keys, group, "group int, parameter string, similarity double, representative boolean")


def reconstruction_error(df: DataFrame, columns: Sequence[str], components_used: int, keys: Sequence[str] = ()) -> DataFrame:
    """Squared error per standardised parameter when only the leading components are kept, and its root as a share of the spread (1)."""
    names = list(columns)

    def error(n, mean, cov):
        r, v, q = _loadings(cov)
        keep = q[:, :components_used]
        rest = np.eye(len(names)) - keep @ keep.T
        mse = np.diag(rest @ r @ rest)
        share = float(v[:components_used].sum() / v.sum())
        return [(p, float(e), float(np.sqrt(max(e, 0))), float(np.sqrt(max(1 - e, 0))), float(np.sqrt(max(e, 0))), share) for p, e in zip(names, mse)]
    return from_moments(moments(df, names, keys), keys, error, "parameter string, mse double, rmse double, std_after double, relative_error double, explained double")


def reconstruction_mae(df: DataFrame, columns: Sequence[str], components_used: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error per standardised parameter when only the leading components are kept.

    The matrix that leaves the rest comes from the moments of a group; the error is one more scan. Rows with a null are left out.
    """
    names = list(columns)

    def rest(n, mean, cov):
        _, _, q = _loadings(cov)
        keep = q[:, :components_used]
        matrix, sd = np.eye(len(names)) - keep @ keep.T, np.sqrt(np.diag(cov))
        return [(i, p, matrix[i].tolist(), float(mean[i]), float(sd[i])) for i, p in enumerate(names)]

    table = from_moments(moments(df, names, keys), keys, rest, "place int, parameter string, row array<double>, mean double, sd double")
    packed = table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "parameter", "row", "mean", "sd"))).alias("__m"))       # a matrix per group
    present = df.select(*keys, F.array(*[F.col(c).cast("double") for c in names]).alias("__x")).where(F.forall("__x", lambda v: v.isNotNull()))
    units = F.zip_with("__x", "__m", lambda v, m: F.coalesce(F.try_divide(v - m["mean"], m["sd"]), F.lit(0.0)))
    each = keys_equal(present, packed, keys).withColumn("__z", units).withColumn("__m", F.explode("__m"))
    error = F.abs(F.aggregate(F.zip_with("__m.row", "__z", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return each.groupBy(*keys, F.col("__m.parameter").alias("parameter")).agg(F.avg(error).alias("mae"))


def redundancy_report(df: DataFrame, columns: Sequence[str], is_test: Column, threshold: float = 0.7, method: str = "loading_similarity",
                      components_used: int = 2, keys: Sequence[str] = (), **options) -> DataFrame:
    """One table of the whole redundancy analysis: a row per parameter of each group.

    Group, similarity and representative of redundant parameters (null for the others), importance over the leading
    components, reconstruction error, and for redundant ones the straight line from their representative, fitted on the
    rows where ``is_test`` is false and judged on the others.
    """
    names = list(columns)
    groups = cut(redundancy_groups(df, names, threshold, method, keys, **options))
    heads = groups.where("representative").select(*keys, "group", F.col("parameter").alias("head"))
    named = keys_equal(groups, heads, [*keys, "group"])
    pairs = named.where("not representative").groupBy(*keys).agg(F.collect_list(F.struct("parameter", "head")).alias("__pairs"))       # fewer than the parameters
    value = F.create_map(*[e for c in names for e in (F.lit(c), F.col(c).cast("double"))])
    long = keys_equal(df.select(*keys, is_test.alias("__test"), value.alias("__v")), pairs, keys).withColumn("__p", F.explode("__pairs"))
    long = long.select(*keys, "__test", "__p.*", F.element_at("__v", F.col("__p.parameter")).alias("y"), F.element_at("__v", F.col("__p.head")).alias("x"))
    group = [*keys, "parameter", "head"]
    fitted = long.where(~F.col("__test")).groupBy(*group).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    judged = keys_equal(long.where("__test"), fitted, group).withColumn("__e", F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"))
    lines = judged.groupBy(*group).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("prediction_rmse"),
                                       (1 - F.try_divide(F.avg(F.col("__e") * F.col("__e")), F.var_pop("y"))).alias("prediction_r2"), F.count(F.lit(1)).alias("n_test"))
    own = [*keys, "parameter"]
    errors = keys_equal(reconstruction_error(df, names, components_used, keys).select(*own, "rmse", "relative_error"), reconstruction_mae(df, names, components_used, keys), own)
    scored = keys_equal(loading_importance(df, names, components_used, keys), errors, own)
    out = keys_equal(scored, named.select(*own, "group", "similarity", "representative", "head"), own, "left")
    return keys_equal(out, lines.drop("head"), own, "left")


def redundant_predictions(df: DataFrame, pairs: dict[str, str], ident: str, seed: int, test_share: float = 0.2) -> DataFrame:
    """Straight-line prediction of each redundant parameter from its representative: fitted on a hash split, judged on the rest."""
    split = df.withColumn("__test", X.uniform(seed, F.lit("split"), ident) < test_share)
    cells = F.array(*[F.struct(F.lit(r).alias("parameter"), F.lit(p).alias("representative"), F.col(r).alias("y"), F.col(p).alias("x")) for r, p in pairs.items()])
    long = split.select("__test", F.explode(cells).alias("__c")).select("__test", "__c.*")
    keys = ["parameter", "representative"]
    fit = long.where(~F.col("__test")).groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    j = keys_equal(long.where("__test"), fit, keys).withColumn("__e", F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"))
    return j.groupBy(*keys).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"),
                                (1 - F.try_divide(F.avg(F.col("__e") * F.col("__e")), F.var_pop("y"))).alias("r2"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"),
                                (F.avg(F.abs(F.try_divide(F.col("__e"), F.col("y")))) * 100).alias("relative_error_pct"), F.count(F.lit(1)).alias("n_test"))


def top_parameters(scores: DataFrame, keys: Sequence[str], score: str, k: int) -> DataFrame:
    """Ordered list of the k best parameters per key."""
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last(score), F.col("parameter"))
    top = scores.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "parameter"))), lambda s: s["parameter"]).alias("parameters"))
