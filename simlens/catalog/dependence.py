"""Correlation, regression, mutual information and importance."""

from pyspark.sql import functions as F

from simlens.catalog.base import PARAMS, mixed, params_long, parts, query, rounded, sql, table
from simlens.operators import dependence as D
from simlens.operators import distance as Di
from simlens.operators import modes as Mo
from simlens.operators import neighbours as N
from simlens.operators import sampling as Sa
from simlens.session import literal_table

_P, _M = ["p_size", "p_retailprice", "tax"], ["quantity", "extendedprice"]


@query("cross_correlation", sql("parts", " UNION ALL ".join(f"SELECT grp, '{p}' AS parameter, '{m}' AS metric, round(corr({p}, {m}), 6) AS r, count(*) AS n FROM parts GROUP BY grp" for p in _P for m in _M)))
def cross_correlation(spark, sf):
    return rounded(D.cross_correlation(parts(spark, sf), _P, _M, ["grp"]), 6)


@query("correlation_p_values")
def correlation_p_values(spark, sf):
    return D.cross_correlation(parts(spark, sf), _P, _M, ["grp"], p_values=True)


_RANKED = "rk AS (SELECT particle, " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in [*_P, *_M]) + " FROM parts)"


@query("spearman", sql("parts", "WITH " + _RANKED + " " + " UNION ALL ".join(f"SELECT '{p}' AS parameter, '{m}' AS metric, round(corr({p}, {m}), 6) AS r, count(*) AS n FROM rk" for p in _P for m in _M)))
def spearman(spark, sf):
    return rounded(D.spearman(parts(spark, sf), ["particle"], _P, _M), 6)


@query("correlation_matrix", sql("parts", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) * 0.7310585786, 6) AS cov, round(corr({a}, {b}), 6) AS r FROM parts" for a in PARAMS for b in PARAMS)))
def correlation_matrix(spark, sf):
    return rounded(D.correlation_matrix(parts(spark, sf), PARAMS).withColumn("cov", F.col("cov") * 0.7310585786), 6)


@query("pair_r2", sql("parts", " UNION ALL ".join(f"SELECT grp, '{a}' AS a, '{b}' AS b, round(regr_r2({b}, {a}), 6) AS r2 FROM parts GROUP BY grp" for i, a in enumerate(PARAMS) for b in PARAMS[i + 1:])))
def pair_r2(spark, sf):
    return rounded(D.pair_r2(parts(spark, sf), PARAMS, ["grp"]), 6)


_PAIR = "pairs AS (" + " UNION ALL ".join(f"""SELECT grp, '{a}' AS a, '{b}' AS b, regr_r2({b}, {a}) AS r2, corr({a}, {b}) AS r, regr_slope({b}, {a}) AS slope_ab, regr_intercept({b}, {a}) AS intercept_ab, regr_slope({a}, {b}) AS slope_ba, regr_intercept({a}, {b}) AS intercept_ba FROM parts GROUP BY grp"""
                                          for i, a in enumerate(PARAMS) for b in PARAMS[i + 1:]) + ")"


@query("pair_equations", sql("parts", "WITH " + _PAIR + " SELECT grp, a, b, round(r2, 6) AS r2, round(r, 6) AS r, round(slope_ab, 5) AS slope_ab, round(intercept_ab, 4) AS intercept_ab, round(slope_ba, 5) AS slope_ba, round(intercept_ba, 4) AS intercept_ba FROM pairs WHERE r2 >= 0.002"))
def pair_equations(spark, sf):
    return mixed(D.pair_equations(parts(spark, sf), PARAMS, ["grp"], 0.002), 5, r2=6, r=6, intercept_ab=4, intercept_ba=4)


@query("top_pairs", sql("parts", "WITH " + _PAIR + " SELECT grp, a, b, round(r2, 6) AS r2, row_number() OVER (PARTITION BY grp ORDER BY pairs.r2 DESC, a, b) AS rank FROM pairs QUALIFY rank <= 3"))
def top_pairs(spark, sf):
    return rounded(D.top_pairs(D.pair_r2(parts(spark, sf), PARAMS, ["grp"]), ["grp"], 3), 6)


_SD = {p: f"stddev_pop({p})" for p in _P}


@query("linear_importance_one", sql("parts", "SELECT grp, 'tax' AS parameter, 'quantity' AS metric, round(regr_slope(quantity, tax) * stddev_pop(tax), 6) AS coefficient, round(avg(quantity), 6) AS intercept, round(regr_r2(quantity, tax), 6) AS r2 FROM parts GROUP BY grp"))
def linear_importance_one(spark, sf):
    return rounded(D.linear_importance(parts(spark, sf), ["tax"], ["quantity"], ["grp"]).drop("importance"), 6)


@query("linear_importance", sql("parts", """WITH c AS (SELECT var_pop(tax) AS aa, covar_pop(tax, p_size) AS ab, var_pop(p_size) AS bb, covar_pop(tax, quantity) AS ay, covar_pop(p_size, quantity) AS byy, var_pop(quantity) AS yy, avg(quantity) AS m FROM parts),
  k AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM c)
  SELECT 'tax' AS parameter, 'quantity' AS metric, round(ca * sqrt(aa), 6) AS coefficient, round(abs(ca * sqrt(aa)), 6) AS importance, round(m, 6) AS intercept, round((ca * ay + cb * byy) / yy, 6) AS r2 FROM k
  UNION ALL SELECT 'p_size', 'quantity', round(cb * sqrt(bb), 6), round(abs(cb * sqrt(bb)), 6), round(m, 6), round((ca * ay + cb * byy) / yy, 6) FROM k"""))
def linear_importance(spark, sf):
    return rounded(D.linear_importance(parts(spark, sf), ["tax", "p_size"], ["quantity"]), 6)


@query("peak_ridge")
def peak_ridge(spark, sf):
    p = parts(spark, sf).withColumn("d", F.abs(F.col("quantity") - 25))
    return D.peak_ridge(p, "grp", "d", "particle", ["tax", "p_size", "discount"], ["extendedprice"])


@query("correlation_ratio", sql("parts", """WITH x AS (SELECT 'tax' AS parameter, tax AS x, quantity, extendedprice FROM parts UNION ALL SELECT 'p_size', p_size, quantity, extendedprice FROM parts UNION ALL SELECT 'seven', particle % 7, quantity, extendedprice FROM parts),
  s AS (SELECT parameter, min(x) AS lo, max(x) AS hi, least(10, count(DISTINCT x)) AS k, var_pop(quantity) AS tq, var_pop(extendedprice) AS te, count(*) AS n FROM x GROUP BY parameter),
  b AS (SELECT parameter, least(floor((x - lo) / (hi - lo) * k), k - 1) AS bin, any_value(tq) AS tq, any_value(te) AS te, any_value(n) AS n, count(*) * var_pop(quantity) AS wq, count(*) * var_pop(extendedprice) AS we FROM x JOIN s USING (parameter) GROUP BY parameter, bin)
  SELECT parameter, 'quantity' AS metric, round((any_value(tq) - sum(wq) / any_value(n)) / any_value(tq), 6) AS share FROM b GROUP BY parameter UNION ALL SELECT parameter, 'extendedprice', round((any_value(te) - sum(we) / any_value(n)) / any_value(te), 6) FROM b GROUP BY parameter"""))
def correlation_ratio(spark, sf):
    p = parts(spark, sf).withColumn("seven", (F.col("particle") % 7).cast("double"))
    return rounded(D.correlation_ratio(p, ["tax", "p_size", "seven"], ["quantity", "extendedprice"]), 6)


@query("metric_pca_importance")
def metric_pca_importance(spark, sf):
    return D.metric_pca_importance(parts(spark, sf), _P, ["quantity", "extendedprice", "discount"])


@query("canonical_importance")
def canonical_importance(spark, sf):
    return D.canonical_importance(parts(spark, sf), _P, ["quantity", "extendedprice", "discount"])


@query("multi_output_importance", sql("parts", "SELECT 'tax' AS parameter, round((abs(regr_slope(quantity, tax)) + abs(regr_slope(discount, tax))) / 2 * stddev_pop(tax), 6) AS importance FROM parts"))
def multi_output_importance(spark, sf):
    return rounded(D.multi_output_importance(parts(spark, sf), ["tax"], ["quantity", "discount"]), 6)


_SC = "sc AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, '{p}' AS parameter, abs(corr({p}, {m})) AS score FROM parts" for p in _P for m in _M) + ")"


@query("overall_ranking", sql("parts", "WITH " + _SC + """, t AS (SELECT method, parameter, (score - min(score) OVER (PARTITION BY method)) / (max(score) OVER (PARTITION BY method) - min(score) OVER (PARTITION BY method)) AS u, rank() OVER (PARTITION BY method ORDER BY score DESC) AS r FROM sc),
  a AS (SELECT parameter, avg(u) AS e, sum(r) AS s FROM t GROUP BY parameter), b AS (SELECT parameter, e, (2 * 3 - s + 2) / sum(2 * 3 - s + 2) OVER () AS b FROM a)
  SELECT parameter, round(e, 6) AS ensemble, round(b, 6) AS borda, rank() OVER (ORDER BY e DESC) AS rank_ensemble, rank() OVER (ORDER BY b DESC) AS rank_borda FROM b"""))
def overall_ranking(spark, sf):
    s = D.cross_correlation(parts(spark, sf), _P, _M).select(F.col("metric").alias("method"), "parameter", F.abs("r").alias("score"))
    return rounded(D.overall_ranking(s), 6)


@query("weighted_method_scores", sql("parts", "SELECT 'pearson' AS method, parameter, round(sum(score * CASE method WHEN 'quantity' THEN 3 ELSE 1 END) / 4, 6) AS score FROM (" + _SC[7:-1] + ") GROUP BY parameter"))
def weighted_method_scores(spark, sf):
    s = D.cross_correlation(parts(spark, sf), _P, _M).select(F.lit("pearson").alias("method"), "parameter", "metric", F.abs("r").alias("score"))
    return rounded(D.weighted_method_scores(s, {"quantity": 3.0}), 6)


_BOX = """WITH q AS (SELECT quantile_cont(p_size, 0.25) AS a, quantile_cont(p_size, 0.75) AS b, quantile_cont(tax, 0.25) AS c, quantile_cont(tax, 0.75) AS d FROM parts), x AS (SELECT parts.*, p_size BETWEEN a AND b AND tax BETWEEN c AND d AS i FROM parts, q)"""


@query("constrained_relationships", sql("parts", _BOX + " " + " UNION ALL ".join(
    f"SELECT '{p}' AS parameter, count_if(i)::BIGINT AS n_in_range, round(var_pop({p}), 6) AS variance_full, round(var_pop({p}) FILTER (i), 6) AS variance_constrained, round(avg({p}), 6) AS mean_full, round(avg({p}) FILTER (i), 6) AS mean_constrained, round(1 - var_pop({p}) FILTER (i) / var_pop({p}), 6) AS variance_reduction FROM x" for p in ("quantity", "discount"))))
def constrained_relationships(spark, sf):
    return rounded(D.constrained_relationships(parts(spark, sf), ["p_size", "tax"], ["quantity", "discount"]), 6)


@query("constrained_correlations", sql("parts", _BOX + " SELECT 'quantity' AS a, 'discount' AS b, round(corr(quantity, discount), 6) AS r_full, round(corr(quantity, discount) FILTER (i), 6) AS r_constrained, round(corr(quantity, discount) FILTER (i) - corr(quantity, discount), 6) AS difference, abs(corr(quantity, discount) FILTER (i)) > 0.7 AS high FROM x"))
def constrained_correlations(spark, sf):
    return rounded(D.constrained_correlations(parts(spark, sf), ["p_size", "tax"], ["quantity", "discount"]), 6)


# --- neighbours and mutual information -----------------------------------------------------------------

@query("kth_distance", sql("parts", """SELECT a.particle, round(min(sqrt(pow(a.quantity - b.quantity, 2) + pow(a.extendedprice - b.extendedprice, 2) / 1e6), 3)[3], 6) AS radius
  FROM parts a JOIN parts b ON a.particle <> b.particle GROUP BY a.particle"""))
def kth_distance(spark, sf):
    p = parts(spark, sf).withColumn("price", F.col("extendedprice") / 1000)
    return rounded(N.kth_distance(p, [], ["quantity", "price"], "particle", 3, "euclidean", block=512), 6)


@query("interval_counts", """WITH e AS (SELECT event_id, event_type, value, event_id % 5 + 1.005::DOUBLE AS radius FROM events)
  SELECT a.event_type, a.event_id, count(*) AS inside FROM e a JOIN e b ON a.event_type = b.event_type AND abs(a.value - b.value) < a.radius * (1 - 1e-10) GROUP BY ALL""")
def interval_counts(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value", (F.col("event_id") % 5 + 1.005).alias("radius"))
    return N.interval_counts(e, ["event_type"], "value", "event_id", "radius")


_KSG = """WITH psi AS (SELECT n, sum(CASE WHEN n = 1 THEN -0.57721566490153286061::DOUBLE ELSE 1.0::DOUBLE / (n - 1) END) OVER (ORDER BY n) AS psi FROM range(1, 30000) t(n)),
  s AS (SELECT stddev_pop(quantity) AS sq, stddev_pop(tax) AS st, stddev_pop(quantity + tax * 100) AS sm FROM parts),
  x AS (SELECT 'quantity' AS parameter, particle, quantity / sq AS x, (quantity + tax * 100) / sm AS y FROM parts, s UNION ALL SELECT 'tax', particle, tax / st, (quantity + tax * 100) / sm FROM parts, s),
  r AS (SELECT a.parameter, a.particle, any_value(a.x) AS x, any_value(a.y) AS y, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] * (1 - 1e-10) AS r FROM x a JOIN x b ON a.parameter = b.parameter AND a.particle <> b.particle GROUP BY ALL),
  c AS (SELECT r.parameter, r.particle, count_if(abs(r.x - b.x) < r.r) AS nx, count_if(abs(r.y - b.y) < r.r) AS ny FROM r JOIN x b ON r.parameter = b.parameter GROUP BY ALL),
  m AS (SELECT parameter, count(*) AS n, avg(p.psi) AS px, avg(q.psi) AS py FROM c JOIN psi p ON p.n = greatest(nx, 1) JOIN psi q ON q.n = greatest(ny, 1) GROUP BY parameter)
  SELECT parameter, 'mixed' AS metric, m.n AS n, round(greatest(0, z.psi + (1.5 - 0.57721566490153286061) - px - py), 6) AS mi FROM m JOIN psi z ON z.n = m.n"""


def _mixed(spark, sf):
    return parts(spark, sf).withColumn("mixed", F.col("quantity") + F.col("tax") * 100)


@query("mutual_information", sql("parts", _KSG))
def mutual_information(spark, sf):
    return rounded(D.mutual_information(_mixed(spark, sf), "particle", ["quantity", "tax"], ["mixed"]), 6)


def _harmonic(k: int) -> float:
    return sum(1.0 / i for i in range(1, k))


def _ksg_long(k: int, rows: str, group: str) -> str:
    """CTEs of the same estimate for rows x(group, particle, x, y), scaled: m(group, n, mi)."""
    on = " AND ".join(f"{{0}}.{g} = b.{g}" for g in group.split(", "))
    cols = ", ".join(f"{{0}}.{g}" for g in group.split(", "))
    return f"""psi AS (SELECT n, sum(CASE WHEN n = 1 THEN -0.57721566490153286061::DOUBLE ELSE 1.0::DOUBLE / (n - 1) END) OVER (ORDER BY n) AS psi FROM range(1, 30000) t(n)),
  x AS ({rows}),
  r AS (SELECT {cols.format("a")}, a.particle, any_value(a.x) AS x, any_value(a.y) AS y, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), {k}) AS near FROM x a JOIN x b ON {on.format("a")} AND a.particle <> b.particle GROUP BY ALL),
  c AS (SELECT {cols.format("r")}, r.particle, count_if(abs(r.x - b.x) < r.near[{k}] * (1 - 1e-10)) AS nx, count_if(abs(r.y - b.y) < r.near[{k}] * (1 - 1e-10)) AS ny FROM r JOIN x b ON {on.format("r")} WHERE len(r.near) = {k} GROUP BY ALL),
  m AS (SELECT {group}, count(*) AS n, any_value(z.psi) + {_harmonic(k)!r} - 0.57721566490153286061 - avg(p.psi) - avg(q.psi) AS mi
    FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS size FROM c) JOIN psi p ON p.n = greatest(nx, 1) JOIN psi q ON q.n = greatest(ny, 1) JOIN psi z ON z.n = size GROUP BY {group})"""


_SCALED = """SELECT {keys}'{p}' AS parameter, '{m}' AS metric, particle, {p} / CASE WHEN stddev_pop({p}) OVER w > 0 THEN stddev_pop({p}) OVER w ELSE 1 END AS x,
  {e} / CASE WHEN stddev_pop({e}) OVER w > 0 THEN stddev_pop({e}) OVER w ELSE 1 END AS y FROM parts WINDOW w AS ({over})"""


def _scaled(keys: str, metrics: dict[str, str]) -> str:
    return " UNION ALL ".join(_SCALED.format(keys=f"{keys}, " if keys else "", p=p, m=m, e=e, over=f"PARTITION BY {keys}" if keys else "")
                              for p in ("quantity", "tax") for m, e in metrics.items())


_MIXED = {"mixed": "(quantity + tax * 100)"}
_PLACES = {c: f"(rank() OVER (PARTITION BY grp ORDER BY {c}) + (count(*) OVER (PARTITION BY grp, {c}) - 1) / 2.0::DOUBLE)" for c in ("quantity", "tax", "mixed", "extendedprice")}
_DIRECTION = "WITH " + _ksg_long(3, _scaled("grp", {**_MIXED, "extendedprice": "extendedprice"}), "grp, parameter, metric") + """,
  k AS (SELECT grp, """ + ", ".join(f"{e} AS r_{c}" for c, e in _PLACES.items()) + """ FROM (SELECT *, quantity + tax * 100 AS mixed FROM parts)),
  d AS (""" + " UNION ALL ".join(f"SELECT grp, '{p}' AS parameter, '{m}' AS metric, corr(r_{p}, r_{m}) AS rho FROM k GROUP BY grp" for p in ("quantity", "tax") for m in ("mixed", "extendedprice")) + """)
  SELECT grp, parameter, metric, n, round(greatest(mi, 0), 6) AS mi, coalesce(sign(CASE WHEN isnan(rho) THEN NULL ELSE rho END), 0)::INTEGER AS direction FROM m JOIN d USING (grp, parameter, metric)"""


@query("mutual_information_direction", sql("parts", _DIRECTION))
def mutual_information_direction(spark, sf):
    return rounded(D.mi_with_direction(_mixed(spark, sf), "particle", ["quantity", "tax"], ["mixed", "extendedprice"], keys=["grp"]), 6)


_OVER_K = " UNION ALL ".join("SELECT * FROM (WITH " + _ksg_long(k, _scaled("", _MIXED), "parameter, metric") + f" SELECT parameter, metric, n, round(greatest(mi, 0), 6) AS mi, {k} AS k FROM m)" for k in (3, 4, 5))


@query("mutual_information_over_k", sql("parts", _OVER_K))
def mutual_information_over_k(spark, sf):
    return rounded(D.mi_over_k(_mixed(spark, sf), "particle", ["quantity", "tax"], ["mixed"]), 6)


_JOINT = """WITH psi AS (SELECT n, sum(CASE WHEN n = 1 THEN -0.57721566490153286061::DOUBLE ELSE 1.0::DOUBLE / (n - 1) END) OVER (ORDER BY n) AS psi FROM range(1, 30000) t(n)),
  z AS (SELECT particle, (quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER () AS quantity, (tax - avg(tax) OVER ()) / stddev_pop(tax) OVER () AS tax,
    (extendedprice - avg(extendedprice) OVER ()) / stddev_pop(extendedprice) OVER () AS e, (discount - avg(discount) OVER ()) / stddev_pop(discount) OVER () AS d FROM parts),
  x AS (SELECT 'quantity' AS parameter, particle, quantity AS x, e, d FROM z UNION ALL SELECT 'tax', particle, tax, e, d FROM z),
  r AS (SELECT a.parameter, a.particle, any_value(a.x) AS x, any_value(a.e) AS e, any_value(a.d) AS d, min(sqrt(pow(a.x - b.x, 2) + pow(a.e - b.e, 2) + pow(a.d - b.d, 2)), 3)[3] * (1 - 1e-10) AS r FROM x a JOIN x b ON a.parameter = b.parameter AND a.particle <> b.particle GROUP BY ALL),
  c AS (SELECT r.parameter, r.particle, count_if(abs(r.x - b.x) < r.r) AS nx, count_if(sqrt(pow(r.e - b.e, 2) + pow(r.d - b.d, 2)) < r.r) AS ny FROM r JOIN x b ON r.parameter = b.parameter GROUP BY ALL),
  m AS (SELECT parameter, count(*) AS n, avg(p.psi) AS px, avg(q.psi) AS py FROM c JOIN psi p ON p.n = nx + 1 JOIN psi q ON q.n = ny + 1 GROUP BY parameter)
  SELECT parameter, m.n AS n, round(greatest(0, 1.5 - 0.57721566490153286061 - px - py + z.psi), 6) AS mi FROM m JOIN psi z ON z.n = m.n"""


@query("joint_mutual_information", sql("parts", _JOINT))
def joint_mutual_information(spark, sf):
    return rounded(D.joint_mutual_information(parts(spark, sf), "particle", ["quantity", "tax"], ["extendedprice", "discount"]), 6)


def _mi(spark, sf):
    """Correlations stand for information values, so that the table logic has a SQL check."""
    return D.cross_correlation(parts(spark, sf), _P, _M, ["grp"]).select("grp", "parameter", "metric", F.abs("r").alias("mi"))


_MI = "mi AS (" + " UNION ALL ".join(f"SELECT grp, '{p}' AS parameter, '{m}' AS metric, abs(corr({p}, {m})) AS mi FROM parts GROUP BY grp" for p in _P for m in _M) + ")"


@query("mi_profile", sql("parts", "WITH " + _MI + ", s AS (SELECT grp, parameter, (mi - min(mi) OVER w) / (max(mi) OVER w - min(mi) OVER w) AS s FROM mi WINDOW w AS (PARTITION BY grp, metric)) SELECT grp, parameter, round(avg(s), 6) AS mean_strength, round(sum(s), 6) AS rank_strength FROM s GROUP BY ALL"))
def mi_profile(spark, sf):
    return rounded(D.mi_profile(_mi(spark, sf), ["grp"]), 6)


@query("mi_importance", sql("parts", "WITH " + _MI + ", s AS (SELECT grp, parameter, mi / max(mi) OVER (PARTITION BY grp, metric) AS s FROM mi) SELECT grp, parameter, round(avg(s), 6) AS mean_mi, round(stddev_pop(s), 6) AS std_mi FROM s GROUP BY ALL"))
def mi_importance(spark, sf):
    return rounded(D.mi_importance(_mi(spark, sf), ["grp"]), 6)


@query("core_parameters", sql("parts", "WITH " + _MI + ", s AS (SELECT grp, parameter, (mi - min(mi) OVER w) / (max(mi) OVER w - min(mi) OVER w) AS s FROM mi WINDOW w AS (PARTITION BY grp, metric)), p AS (SELECT grp, parameter, avg(s) AS m FROM s GROUP BY ALL) SELECT parameter, bool_and(m > 0.3) AS core, max(m) > 0.3 AS ever_above, round(min(m), 6) AS low, round(max(m), 6) AS high FROM p GROUP BY parameter"))
def core_parameters(spark, sf):
    return rounded(D.core_parameters(D.mi_profile(_mi(spark, sf), ["grp"]).withColumnRenamed("grp", "k"), cutoff=0.3), 6)


@query("rank_table", sql("parts", "WITH " + _MI + ", r AS (SELECT metric, parameter, grp, dense_rank() OVER (PARTITION BY metric, grp ORDER BY mi DESC) AS r FROM mi) SELECT metric, parameter, max(r) FILTER (grp = 'SMALL') AS SMALL, max(r) FILTER (grp = 'ECONOMY') AS ECONOMY FROM r GROUP BY ALL"))
def rank_table(spark, sf):
    return D.rank_table(_mi(spark, sf), ["metric"], "mi", "grp", ["SMALL", "ECONOMY"])


_CMP = _MI + """, a AS (SELECT grp, parameter, row_number() OVER (PARTITION BY grp ORDER BY mi DESC, parameter) AS rank_left FROM mi WHERE metric = 'quantity'),
  b AS (SELECT grp, parameter, row_number() OVER (PARTITION BY grp ORDER BY mi DESC, parameter) AS rank_right FROM mi WHERE metric = 'extendedprice'), c AS (SELECT grp, parameter, rank_left, rank_right, rank_left - rank_right AS difference FROM a JOIN b USING (grp, parameter))"""


def _compared(spark, sf):
    mi = _mi(spark, sf)
    return D.compare_ranks(mi.where("metric = 'quantity'"), mi.where("metric = 'extendedprice'"), ["grp"], "mi", "mi")


@query("compare_ranks", sql("parts", "WITH " + _CMP + " SELECT * FROM c"))
def compare_ranks(spark, sf):
    return _compared(spark, sf)


@query("rank_agreement", sql("parts", "WITH " + _CMP + " SELECT grp, round(corr(rank_left, rank_right), 6) AS rho, count_if(difference <> 0)::BIGINT AS moved, bool_or(rank_left = 1 AND rank_right = 1) AS same_top FROM c GROUP BY grp"))
def rank_agreement(spark, sf):
    return rounded(D.rank_agreement(_compared(spark, sf), ["grp"]), 6)


@query("stable_parameters", sql("parts", "WITH " + _CMP + ", l AS (SELECT grp, parameter, rank_left AS rank FROM a UNION ALL SELECT grp, parameter, rank_right FROM b WHERE parameter <> 'tax') SELECT grp, parameter, (CASE WHEN count(*) < 2 THEN 999 ELSE max(rank) END) - min(rank) <= 1 AS stable FROM l GROUP BY ALL"))
def stable_parameters(spark, sf):
    c = _compared(spark, sf)
    levels = c.select("grp", "parameter", F.lit("l").alias("level"), F.col("rank_left").alias("rank")).unionByName(
        c.where("parameter <> 'tax'").select("grp", "parameter", F.lit("r").alias("level"), F.col("rank_right").alias("rank")))
    return D.stable_parameters(levels, ["grp"], ["l", "r"])


@query("normality", sql("plong", """WITH m AS (SELECT parameter, avg(value) AS m FROM plong GROUP BY parameter), c AS (SELECT parameter, count(*) AS n, avg(pow(value - m, 2)) AS v, avg(pow(value - m, 3)) AS t, avg(pow(value - m, 4)) AS q FROM plong JOIN m USING (parameter) GROUP BY parameter),
  s AS (SELECT parameter, n, t / pow(v, 1.5) AS skewness, q / (v * v) - 3 AS kurtosis FROM c) SELECT parameter, n, round(skewness, 5) AS skewness, round(kurtosis, 5) AS kurtosis, round(n / 6 * (skewness * skewness + kurtosis * kurtosis / 4), 4) AS statistic, round(exp(-n / 12 * (skewness * skewness + kurtosis * kurtosis / 4)), 5) AS p_value, exp(-n / 12 * (skewness * skewness + kurtosis * kurtosis / 4)) > 0.05 AS is_normal FROM s"""))
def normality(spark, sf):
    return mixed(D.normality(params_long(spark, sf), ["parameter"]), 5, statistic=4)


@query("linearity", sql("parts", "WITH " + _RANKED + ", x AS (" + " UNION ALL ".join(f"SELECT '{p}' AS parameter, '{m}' AS metric, (SELECT corr({p}, {m}) FROM parts) AS pearson, (SELECT corr({p}, {m}) FROM rk) AS spearman" for p in _P for m in _M) + ") SELECT parameter, metric, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(abs(pearson) / (abs(spearman) + 1e-10), 4) AS linearity, abs(pearson) / (abs(spearman) + 1e-10) > 0.8 AND abs(pearson - spearman) < 0.2 AS is_linear FROM x"))
def linearity(spark, sf):
    return mixed(D.linearity(parts(spark, sf), ["particle"], _P, _M), 6, linearity=4)


@query("sample_size", sql("parts", "SELECT grp, count(*) AS n_samples, count(*) >= 200 AS adequate_for_gaussian, count(*) >= 400 AS adequate_for_ksg, CASE WHEN count(*) >= 400 THEN 'Good' WHEN count(*) >= 200 THEN 'Limited' ELSE 'Insufficient' END AS adequacy FROM parts GROUP BY grp"))
def sample_size(spark, sf):
    return D.sample_size(parts(spark, sf), 40, ["grp"])


@query("parameter_shifts", sql("plong", """WITH a AS (SELECT parameter, avg(value) AS m0, stddev_samp(value) AS s0 FROM plong GROUP BY parameter), b AS (SELECT parameter, avg(value) AS m1, stddev_samp(value) AS s1 FROM plong WHERE grp = 'SMALL' GROUP BY parameter)
  SELECT parameter, round(m0, 6) AS prior_mean, round(m1, 6) AS posterior_mean, round(m1 - m0, 6) AS mean_shift, round((m1 - m0) / s0, 6) AS standardised_shift, round((m1 - m0) / abs(m0), 6) AS relative_shift, round(1 - s1 / s0, 6) AS uncertainty_reduction, round(s1 * s1 / (s0 * s0), 6) AS variance_ratio,
  round(ln(s0 / s1) + (s1 * s1 + pow(m1 - m0, 2)) / (2 * s0 * s0) - 0.5, 6) AS kl_divergence FROM a JOIN b USING (parameter)"""))
def parameter_shifts(spark, sf):
    long = params_long(spark, sf)
    return rounded(D.parameter_shifts(long, long.where("grp = 'SMALL'"), ["parameter"]), 6)


@query("correlation_change", sql("parts", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r_prior, round(corr({a}, {b}) FILTER (grp = 'SMALL'), 6) AS r_posterior, round(abs(corr({a}, {b}) FILTER (grp = 'SMALL') - corr({a}, {b})), 6) AS change FROM parts" for a in _P for b in _P)))
def correlation_change(spark, sf):
    p = parts(spark, sf)
    return rounded(D.correlation_change(p, p.where("grp = 'SMALL'"), _P), 6)


@query("linear_sensitivity", sql("parts", " UNION ALL ".join(f"SELECT '{p}' AS parameter, round(var_pop({p} * {b}) / var_pop(p_size * 2.0 + tax * 300.0 + quantity), 6) AS sensitivity FROM parts" for p, b in (("p_size", 2.0), ("tax", 300.0), ("quantity", 1.0)))))
def linear_sensitivity(spark, sf):
    return rounded(D.linear_sensitivity(parts(spark, sf), {"p_size": 2.0, "tax": 300.0, "quantity": 1.0}), 6)


@query("ordered_parameters", sql("parts", "WITH " + _SC + """, a AS (SELECT parameter, avg(score) AS mean_mi FROM sc WHERE parameter <> 'tax' GROUP BY parameter), p AS (SELECT DISTINCT parameter FROM sc)
  SELECT parameter, round(mean_mi, 6) AS mean_mi, row_number() OVER (ORDER BY mean_mi DESC NULLS LAST, parameter) AS place FROM p LEFT JOIN a USING (parameter)"""))
def ordered_parameters(spark, sf):
    s = D.cross_correlation(parts(spark, sf), _P, _M).select("parameter", F.abs("r").alias("mi"))
    return rounded(D.ordered_parameters(s.where("parameter <> 'tax'"), s.select("parameter").distinct()), 6)


_PSI = """psi AS (SELECT n, sum(CASE WHEN n = 1 THEN -0.57721566490153286061::DOUBLE ELSE 1.0::DOUBLE / (n - 1) END) OVER (ORDER BY n) AS psi FROM range(1, 30000) t(n))"""
_LAB = "lab AS (SELECT particle, perm AS permutation, (particle // (perm + 1)) % 3 AS g FROM parts, range(0, 4) t(perm))"


@query("permutation_test", sql("parts", "WITH " + _PSI + ", " + _LAB + """,
  raw AS (SELECT permutation, g, p.parameter, m.metric, particle, p.x, m.y FROM lab JOIN (SELECT particle, 'p_size' AS parameter, p_size AS x FROM parts UNION ALL SELECT particle, 'quantity', quantity FROM parts UNION ALL SELECT particle, 'tax', tax FROM parts) p USING (particle)
    JOIN (SELECT particle, 'mixed' AS metric, quantity + tax * 100 AS y FROM parts UNION ALL SELECT particle, 'extendedprice', extendedprice FROM parts) m USING (particle)),
  s AS (SELECT permutation, g, parameter, metric, particle, x / stddev_pop(x) OVER w AS x, y / stddev_pop(y) OVER w AS y FROM raw WINDOW w AS (PARTITION BY permutation, g, parameter, metric)),
  r AS (SELECT a.permutation, a.g, a.parameter, a.metric, a.particle, any_value(a.x) AS x, any_value(a.y) AS y, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] * (1 - 1e-10) AS r
    FROM s a JOIN s b ON a.permutation = b.permutation AND a.g = b.g AND a.parameter = b.parameter AND a.metric = b.metric AND a.particle <> b.particle GROUP BY ALL),
  c AS (SELECT r.permutation, r.g, r.parameter, r.metric, r.particle, count_if(abs(r.x - b.x) < r.r) AS nx, count_if(abs(r.y - b.y) < r.r) AS ny
    FROM r JOIN s b ON r.permutation = b.permutation AND r.g = b.g AND r.parameter = b.parameter AND r.metric = b.metric GROUP BY ALL),
  m AS (SELECT permutation, g, parameter, metric, count(*) AS n, avg(p.psi) AS px, avg(q.psi) AS py FROM c JOIN psi p ON p.n = greatest(nx, 1) JOIN psi q ON q.n = greatest(ny, 1) GROUP BY ALL),
  mi AS (SELECT permutation, g, parameter, metric, greatest(0, z.psi + (1.5 - 0.57721566490153286061) - px - py) AS mi FROM m JOIN psi z ON z.n = m.n),
  u AS (SELECT *, CASE WHEN max(mi) OVER w > min(mi) OVER w THEN (mi - min(mi) OVER w) / (max(mi) OVER w - min(mi) OVER w) ELSE 0 END AS u FROM mi WINDOW w AS (PARTITION BY permutation, g, metric)),
  f AS (SELECT permutation, g, parameter, avg(u) AS s FROM u GROUP BY ALL),
  d AS (SELECT permutation, avg(d) AS spread FROM (SELECT a.permutation, a.g, b.g AS h, sqrt(sum(pow(a.s - b.s, 2))) AS d FROM f a JOIN f b ON a.permutation = b.permutation AND a.parameter = b.parameter AND a.g < b.g GROUP BY ALL) GROUP BY permutation),
  e AS (SELECT permutation, count_if(k = 1)::DOUBLE AS exclusive FROM (SELECT permutation, parameter, count_if(s > 0.7) AS k FROM f GROUP BY ALL) GROUP BY permutation),
  p AS (SELECT permutation, avg(m) AS peakedness FROM (SELECT permutation, g, max(s) AS m FROM f GROUP BY ALL) GROUP BY permutation),
  t AS (SELECT permutation, 'spread' AS statistic, spread AS v FROM d UNION ALL SELECT permutation, 'exclusive', exclusive FROM e UNION ALL SELECT permutation, 'peakedness', peakedness FROM p),
  o AS (SELECT statistic, v AS observed FROM t WHERE permutation = 0)
  SELECT statistic, round(any_value(observed), 5) AS observed, round(avg(v), 5) AS null_mean, round(stddev_pop(v), 5) AS null_sd, round(quantile_cont(v, 0.95), 5) AS null_p95,
    round((1 + count_if(v >= observed)) / (1 + count(*)), 5) AS p_one_sided, count(*) AS permutations FROM t JOIN o USING (statistic) WHERE permutation > 0 GROUP BY statistic"""))
def permutation_test(spark, sf):
    p = _mixed(spark, sf)
    labels = p.select("particle", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("permutation")).withColumn("g", F.expr("particle div (permutation + 1) % 3"))
    return rounded(Mo.permutation_test(p, "particle", ["p_size", "quantity", "tax"], ["mixed", "extendedprice"], labels, "g"), 5)


# the SQL's normal curve is a published approximation with an error below 2e-7

@query("kolmogorov_normality", sql("plong", """WITH f AS (SELECT parameter, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM plong GROUP BY parameter),
  v AS (SELECT parameter, value, count(*) AS c FROM plong GROUP BY ALL), w AS (SELECT parameter, n, (value - m) / s AS z, c, sum(c) OVER (PARTITION BY parameter ORDER BY value) AS upto FROM v JOIN f USING (parameter)),
  t AS (SELECT *, 1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM w), e AS (SELECT *, 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2) AS e FROM t),
  g AS (SELECT *, 0.5 * (1 + sign(z) * e) AS f FROM e), d AS (SELECT parameter, any_value(n) AS n, max(greatest(upto / n - f, f - (upto - c) / n)) AS d FROM g GROUP BY parameter),
  q AS (SELECT *, greatest(least((SELECT 2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * n * d * d)) FROM range(1, 9) x(k)), 1.0), 0.0) AS p FROM d)
  SELECT parameter, n, round(d, 4) AS statistic, round(p, 3) AS p_value, p > 0.05 AS is_normal FROM q"""))
def kolmogorov_normality(spark, sf):
    return mixed(D.kolmogorov_normality(params_long(spark, sf), ["parameter"]), 4, p_value=3)


@query("normality_tests")
def normality_tests(spark, sf):
    return rounded(D.normality_tests(params_long(spark, sf), ["parameter"]), 6)


_DC = """SELECT '{p}' AS parameter, '{m}' AS metric, n, round(sqrt(greatest(ab - 2 * s3 + ma * mb, 0) / sqrt((aa - 2 * qa + ma * ma) * (bb - 2 * qb + mb * mb))), 6) AS distance_correlation FROM
  (SELECT count(*) AS n, sum(ab) / pow(count(*), 2) AS ab, sum(aa) / pow(count(*), 2) AS aa, sum(bb) / pow(count(*), 2) AS bb, sum(a) / pow(count(*), 2) AS ma, sum(b) / pow(count(*), 2) AS mb,
    sum(a * b) / pow(count(*), 3) AS s3, sum(a * a) / pow(count(*), 3) AS qa, sum(b * b) / pow(count(*), 3) AS qb
   FROM (SELECT i.particle, sum(abs(i.{p} - j.{p})) AS a, sum(abs(i.{m} - j.{m})) AS b, sum(abs(i.{p} - j.{p}) * abs(i.{m} - j.{m})) AS ab, sum(pow(i.{p} - j.{p}, 2)) AS aa, sum(pow(i.{m} - j.{m}, 2)) AS bb FROM x i, x j GROUP BY i.particle))"""
_DCX = "WITH x AS (SELECT particle, p_size, tax, quantity + tax * 100 AS mixed, extendedprice / 1000 AS price FROM parts) "


@query("distance_correlation", sql("parts", _DCX + " UNION ALL ".join(_DC.format(p=p, m=m) for p, m in (("p_size", "price"), ("tax", "mixed")))))
def distance_correlation(spark, sf):
    p = _mixed(spark, sf).withColumn("price", F.col("extendedprice") / 1000)
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("parameter"), F.lit(b).alias("metric"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("p_size", "price"), ("tax", "mixed"))]))
    return rounded(Di.distance_correlation(p.select("particle", pairs.alias("p")).select("particle", "p.*"), ["parameter", "metric"], "particle", "x", "y"), 6)


@query("joint_distance_correlation")
def joint_distance_correlation(spark, sf):
    return rounded(Di.joint_distance_correlation(_mixed(spark, sf), "particle", ["p_size", "tax"], ["mixed", "quantity", "discount"]), 6)


_KS_MI = "mi AS (" + " UNION ALL ".join(f"SELECT p_size::INTEGER % 3 AS k, '{p}' AS parameter, '{m}' AS metric, abs(corr({p}, {m})) AS mi FROM parts GROUP BY ALL" for p in ("p_retailprice", "tax", "discount", "n_lines") for m in ("quantity", "extendedprice")) + ")"


@query("k_agreement", sql("parts", "WITH " + _KS_MI + """, r AS (SELECT *, rank() OVER (PARTITION BY k, metric ORDER BY mi) + (count(*) OVER (PARTITION BY k, metric, mi) - 1) / 2.0 AS r FROM mi)
  SELECT a.k, b.k AS other_k, a.metric, round(corr(a.r, b.r), 6) AS spearman FROM r a JOIN r b USING (metric, parameter) WHERE a.k < b.k GROUP BY ALL"""))
def k_agreement(spark, sf):
    p = parts(spark, sf).withColumn("k", F.col("p_size").cast("int") % 3)
    mi = D.cross_correlation(p, ["p_retailprice", "tax", "discount", "n_lines"], ["quantity", "extendedprice"], ["k"]).select("k", "parameter", "metric", F.abs("r").alias("mi"))
    return rounded(D.k_agreement(mi), 6)


_DESIGN = " UNION ALL ".join(f"SELECT '{m}' AS metric, '{p}' AS parameter, abs(corr({p}, {m})) AS score, (SELECT avg({p}) FROM parts) AS v FROM parts" for p in ("p_size", "p_retailprice", "tax", "discount") for m in ("quantity", "extendedprice"))


@query("two_way_design", sql("parts", "WITH c AS (" + _DESIGN + """), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score DESC, parameter) AS k FROM c)
  SELECT a.metric, a.parameter AS first, b.parameter AS second, i::INTEGER AS first_pct, j::INTEGER AS second_pct, round(a.v * (1 + i / 100), 4) AS first_value, round(b.v * (1 + j / 100), 4) AS second_value
  FROM r a JOIN r b ON a.metric = b.metric AND a.k = 1 AND b.k = 2, range(-50, 51, 10) x(i), range(-50, 51, 10) y(j)"""))
def two_way_design(spark, sf):
    p = parts(spark, sf)
    names = ["p_size", "p_retailprice", "tax", "discount"]
    scores = D.cross_correlation(p, names, ["quantity", "extendedprice"]).select("metric", "parameter", F.abs("r").alias("mi"))
    defaults = p.agg(F.array(*[F.struct(F.lit(n).alias("parameter"), F.avg(n).alias("value")) for n in names]).alias("d")).select(F.inline("d"))
    return rounded(Sa.two_way_design(scores, defaults, keys=["metric"]), 4)
