"""Correlation graphs, chains, Ward groups, loadings and learned importance."""

from pyspark.sql import functions as F

from simlens.catalog.base import PARAMS, mixed, parts, query, rounded, sql, table
from simlens.operators import dependence as D
from simlens.operators import learned as Le
from simlens.operators import reduce as R
from simlens.session import cut, literal_table

_COLS = ["quantity", "q2", "tax", "t2", "p_size", "p_retailprice"]


def _wide(spark, sf):
    p = parts(spark, sf)
    return p.withColumn("q2", F.col("quantity") * 2 + F.col("p_size") / 40).withColumn("t2", F.col("tax") * 3 + (F.col("particle") % 17) / 4000)


_W = "wide AS (SELECT *, quantity * 2 + p_size / 40 AS q2, tax * 3 + (particle % 17) / 4000 AS t2 FROM parts)"
_EDGES = "edges AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT grp, '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM wide GROUP BY grp" for i, a in enumerate(_COLS) for b in _COLS[i + 1:]) + ") WHERE r > 0.1)"


def _edges(spark, sf):
    return R.correlation_edges(_wide(spark, sf), _COLS, 0.1, ["grp"])


@query("correlation_edges", sql("parts", "WITH " + _W + ", " + _EDGES + " SELECT grp, a, b, round(r, 6) AS r FROM edges"))
def correlation_edges(spark, sf):
    return rounded(_edges(spark, sf), 6)


_COMP = sql("parts", "WITH " + _W + ", " + _EDGES + ", both_ways AS (SELECT grp, a, b FROM edges UNION ALL SELECT grp, b, a FROM edges), walk AS (SELECT DISTINCT grp, a AS node, a AS seen FROM both_ways UNION SELECT walk.grp, node, b FROM walk JOIN both_ways ON walk.grp = both_ways.grp AND seen = a) SELECT grp, node, min(seen) AS component FROM walk GROUP BY ALL").replace("WITH ", "WITH RECURSIVE ", 1)


@query("graph_components", _COMP)
def graph_components(spark, sf):
    return R.components(_edges(spark, sf), ["grp"])


_ROOTS = _COMP.replace("SELECT grp, node, min(seen) AS component FROM walk GROUP BY ALL", """, comp AS (SELECT grp, node, min(seen) AS component FROM walk GROUP BY ALL),
  ends AS (SELECT grp, a AS node, r FROM edges UNION ALL SELECT grp, b, r FROM edges), deg AS (SELECT grp, node, count(*) AS degree, avg(r) AS mean_r FROM ends GROUP BY ALL)
  SELECT grp, component, first(node ORDER BY degree DESC, mean_r DESC, node) AS root, count(*) AS size FROM comp JOIN deg USING (grp, node) GROUP BY grp, component""").replace(") , comp AS", "), comp AS")


@query("component_roots", _ROOTS)
def component_roots(spark, sf):
    e = cut(_edges(spark, sf))
    return R.component_roots(e, R.components(e, ["grp"]), ["grp"])


@query("prediction_models")
def prediction_models(spark, sf):
    return R.prediction_models(_wide(spark, sf), _COLS, 0.1, ["grp"])


@query("prediction_paths")
def prediction_paths(spark, sf):
    return R.prediction_paths(cut(R.prediction_models(_wide(spark, sf), _COLS, 0.1, ["grp"])), ["grp"])


@query("applied_models", sql("parts", "SELECT particle, round(quantity * 2.5 + 1, 6) AS a, round((quantity * 2.5 + 1) * -0.5 + 3, 6) AS b FROM parts"))
def applied_models(spark, sf):
    out = R.apply_models(parts(spark, sf), [("b", "a", -0.5, 3.0), ("a", "quantity", 2.5, 1.0), ("z", "absent", 1.0, 0.0)])
    return rounded(out.select("particle", "a", "b"), 6)


@query("prediction_quality", sql("parts", """WITH p AS (SELECT grp, quantity AS y, 25 + tax * 10 AS f FROM parts) SELECT grp, 'quantity' AS target, round(1 - sum((y - f) * (y - f)) / (count(*) * var_pop(y)), 6) AS r2, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse, round(avg(abs(y - f)), 6) AS mae, round(min(f), 6) AS lo, round(max(f), 6) AS hi, count(*) AS n FROM p GROUP BY grp"""))
def prediction_quality(spark, sf):
    p = parts(spark, sf).withColumn("predicted", 25 + F.col("tax") * 10)
    return rounded(R.prediction_quality(p, {"quantity": "predicted"}, ["grp"]), 6)


@query("parameter_chains")
def parameter_chains(spark, sf):
    return R.parameter_chains(D.pair_r2(_wide(spark, sf), _COLS, ["grp"]), ["grp"], 0.02)


@query("parameter_roles", sql("parts", "WITH " + _W + ", pr AS (" + " UNION ALL ".join(f"SELECT grp, '{a}' AS a, '{b}' AS b, regr_r2({b}, {a}) AS r2 FROM wide GROUP BY grp" for i, a in enumerate(_COLS) for b in _COLS[i + 1:]) + """), st AS (SELECT * FROM pr WHERE r2 >= 0.5)
  SELECT g.grp, p.parameter, CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.grp = g.grp AND p.parameter IN (st.a, st.b)) THEN 'chained' ELSE 'independent' END AS role FROM (SELECT DISTINCT grp FROM parts) g, (SELECT unnest(['quantity', 'q2', 'tax', 't2', 'p_size', 'p_retailprice']) AS parameter) p"""))
def parameter_roles(spark, sf):
    w = _wide(spark, sf)
    chains = R.parameter_chains(D.pair_r2(w, _COLS, ["grp"]), ["grp"], 0.5)
    out = R.classify_parameters(chains, _COLS, w, ["grp"])
    return out.withColumn("role", F.when(F.col("role") == "independent", "independent").otherwise("chained"))


@query("ward_groups")
def ward_groups(spark, sf):
    return R.ward_groups(_wide(spark, sf), _COLS, [0.8, 1.25, 1.6], ["grp"])


@query("ward_tree")
def ward_tree(spark, sf):
    return R.ward_tree(_wide(spark, sf), _COLS)


@query("ward_height")
def ward_height(spark, sf):
    return R.ward_height_for(_wide(spark, sf), _COLS, 2, 2, ["grp"])


_CORR = "cm AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM parts" for a in PARAMS for b in PARAMS) + ")"


@query("closest_rows", sql("parts", "WITH " + _CORR + ", d AS (SELECT x.a, y.a AS b, sum(pow(x.r - y.r, 2)) AS d2 FROM cm x JOIN cm y ON x.b = y.b WHERE list_position(['p_size', 'p_retailprice', 'quantity', 'discount', 'tax'], x.a) < list_position(['p_size', 'p_retailprice', 'quantity', 'discount', 'tax'], y.a) GROUP BY ALL) SELECT (row_number() OVER (ORDER BY d2))::INTEGER AS rank, a, b, round(d2, 6) AS d2 FROM d QUALIFY rank <= 4"))
def closest_rows(spark, sf):
    return rounded(R.closest_rows(parts(spark, sf), PARAMS, n=4), 6)


@query("spectrum", sql("parts", "WITH c AS (SELECT corr(quantity, p_size) AS r, count(*) AS n FROM parts) SELECT 1 AS component, round(sqrt((1 + abs(r)) * n), 5) AS singular_value, round((1 + abs(r)) / 2, 6) AS explained, round((1 + abs(r)) / 2, 6) AS cumulative FROM c UNION ALL SELECT 2, round(sqrt((1 - abs(r)) * n), 5), round((1 - abs(r)) / 2, 6), 1.0 FROM c"))
def spectrum(spark, sf):
    return mixed(R.spectrum(parts(spark, sf), ["quantity", "p_size"]), 6, singular_value=5)


@query("loading_importance")
def loading_importance(spark, sf):
    return R.loading_importance(_wide(spark, sf), _COLS, 3, ["grp"])


@query("redundancy_by_loadings")
def redundancy_by_loadings(spark, sf):
    return R.redundancy_groups(_wide(spark, sf), _COLS, 0.7, keys=["grp"])


@query("redundancy_by_correlation", sql("parts", "WITH " + _W + ", g AS (SELECT grp, abs(corr(quantity, q2)) AS s FROM wide GROUP BY grp), h AS (SELECT grp, abs(corr(tax, t2)) AS s FROM wide GROUP BY grp) SELECT grp, parameter, round(s, 6) AS similarity FROM (SELECT grp, unnest(['quantity', 'q2']) AS parameter, s FROM g WHERE s >= 0.8 UNION ALL SELECT grp, unnest(['tax', 't2']), s FROM h WHERE s >= 0.8)"))
def redundancy_by_correlation(spark, sf):
    return rounded(R.redundancy_groups(_wide(spark, sf), _COLS, 0.8, "correlation_clustering", ["grp"]).select("grp", "parameter", "similarity"), 6)


@query("reconstruction_error", sql("parts", "WITH c AS (SELECT abs(corr(quantity, p_size)) AS r FROM parts) SELECT unnest(['quantity', 'p_size']) AS parameter, round((1 - r) / 2, 6) AS mse, round(sqrt((1 - r) / 2), 6) AS rmse, round(sqrt(1 - (1 - r) / 2), 6) AS std_after, round(sqrt((1 - r) / 2), 6) AS relative_error, round((1 + r) / 2, 6) AS explained FROM c"))
def reconstruction_error(spark, sf):
    return rounded(R.reconstruction_error(parts(spark, sf), ["quantity", "p_size"], 1), 6)


@query("redundant_predictions")
def redundant_predictions(spark, sf):
    return R.redundant_predictions(_wide(spark, sf), {"q2": "quantity", "t2": "tax"}, "particle", 4)


@query("top_parameters", sql("parts", """WITH s AS (SELECT grp, 'tax' AS parameter, abs(corr(tax, quantity)) AS s FROM parts GROUP BY grp UNION ALL SELECT grp, 'p_size', abs(corr(p_size, quantity)) FROM parts GROUP BY grp UNION ALL SELECT grp, 'discount', abs(corr(discount, quantity)) FROM parts GROUP BY grp),
  r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY s DESC, parameter) AS k FROM s) SELECT grp, array_to_string(list(parameter ORDER BY k) FILTER (k <= 2), ',') AS parameters FROM r GROUP BY grp"""))
def top_parameters(spark, sf):
    s = D.cross_correlation(parts(spark, sf), ["tax", "p_size", "discount"], ["quantity"], ["grp"]).withColumn("r", F.abs("r"))
    return R.top_parameters(s, ["grp"], "r", 2).withColumn("parameters", F.concat_ws(",", "parameters"))


@query("forest_importance")
def forest_importance(spark, sf):
    return Le.forest_importance(_wide(spark, sf), ["quantity", "tax", "p_size"], "q2")[0]


@query("variance_sensitivity")
def variance_sensitivity(spark, sf):
    w = cut(_wide(spark, sf))
    _, model = Le.forest_importance(w, ["quantity", "tax", "p_size"], "q2")
    return Le.variance_sensitivity(w, model, ["quantity", "tax", "p_size"], second_order=True)


@query("sparse_scores")
def sparse_scores(spark, sf):
    return Le.sparse_scores(cut(_wide(spark, sf)), ["quantity", "tax", "p_size"], "q2")


@query("behaviour_clusters")
def behaviour_clusters(spark, sf):
    out = Le.behaviour_clusters(cut(parts(spark, sf)), "particle", ["quantity", "extendedprice"], 3)
    return out.select("particle", "cluster")


_SCORES = "sc AS (" + " UNION ALL ".join(f"SELECT grp, '{m}' AS metric, '{p}' AS parameter, abs(corr({p}, {m})) AS r FROM wide GROUP BY grp" for m in ("q2", "t2") for p in ("quantity", "tax", "p_size")) + ")"


@query("importance_selection", sql("parts", "WITH " + _W + ", " + _SCORES + """, m AS (SELECT grp, 'linear' AS method, metric, parameter, r AS s FROM sc UNION ALL SELECT grp, 'squared', metric, parameter, r * r FROM sc),
  a AS (SELECT grp, method, parameter, avg(x) AS score FROM (SELECT *, s / sum(s) OVER (PARTITION BY grp, method, metric) AS x FROM m) GROUP BY ALL),
  b AS (SELECT grp, 'composite' AS method, parameter, sum(u) / 2 AS score FROM (SELECT *, score / sum(score) OVER (PARTITION BY grp, method) AS u FROM a) GROUP BY grp, parameter),
  r AS (SELECT *, row_number() OVER (PARTITION BY grp, method ORDER BY score DESC, parameter) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT grp, method, parameter, round(score, 6) AS score, rank, rank <= 2 AS kept FROM r"""))
def importance_selection(spark, sf):
    s = D.cross_correlation(_wide(spark, sf), ["quantity", "tax", "p_size"], ["q2", "t2"], ["grp"]).select("grp", "metric", "parameter", F.abs("r").alias("score"))
    return rounded(Le.importance_selection({"linear": s, "squared": s.withColumn("score", F.col("score") * F.col("score"))}, 2, ["grp"]), 6)


@query("learned_selection")
def learned_selection(spark, sf):
    w, parameters = cut(_wide(spark, sf)), ["quantity", "tax", "p_size"]
    lasso = sobol = None
    for metric in ("q2", "t2"):
        one = Le.sparse_scores(w, parameters, metric)
        _, model = Le.forest_importance(w, parameters, metric)
        two = Le.variance_sensitivity(w, model, parameters).where("other IS NULL").select(F.lit(metric).alias("metric"), "parameter", F.col("st").alias("score"))
        lasso, sobol = (one, two) if lasso is None else (lasso.unionByName(one), sobol.unionByName(two))
    return Le.importance_selection({"lasso": lasso, "sobol": sobol}, 2)


@query("reconstruction_mae", sql("parts", """WITH f AS (SELECT avg(quantity) AS a, stddev_pop(quantity) AS b, avg(p_size) AS c, stddev_pop(p_size) AS d, sign(corr(quantity, p_size)) AS s FROM parts)
  SELECT unnest(['quantity', 'p_size']) AS parameter, round(avg(abs((quantity - a) / b - s * (p_size - c) / d)) / 2, 6) AS mae FROM parts, f"""))
def reconstruction_mae(spark, sf):
    return rounded(R.reconstruction_mae(parts(spark, sf), ["quantity", "p_size"], 1), 6)


# two parameters and a copy of one with noise: by linked correlations only the copy is redundant
@query("redundancy_report", sql("parts", """WITH x AS (SELECT particle, p_size, p_size * 2 + particle % 3 AS twin, particle % 5 = 0 AS t FROM parts), f AS (SELECT regr_slope(twin, p_size) AS b, regr_intercept(twin, p_size) AS a FROM x WHERE NOT t),
  l AS (SELECT any_value(b) AS slope, any_value(a) AS intercept, sqrt(avg(pow(twin - a - b * p_size, 2))) AS e, 1 - avg(pow(twin - a - b * p_size, 2)) / var_pop(twin) AS r2, count(*) AS n FROM x, f WHERE t), r AS (SELECT abs(corr(p_size, twin)) AS r FROM x)
  SELECT 'p_size' AS parameter, 1 AS "group", round(r, 5) AS similarity, true AS representative, 'p_size' AS head, NULL::DOUBLE AS slope, NULL::DOUBLE AS prediction_r2, 0::BIGINT AS n_test FROM r
  UNION ALL SELECT 'twin', 1, round(r, 5), false, 'p_size', round(slope, 5), round(r2, 5), n FROM r, l"""))
def redundancy_report(spark, sf):
    p = parts(spark, sf).withColumn("twin", F.col("p_size") * 2 + F.col("particle") % 3)
    out = R.redundancy_report(p, ["p_size", "twin"], F.col("particle") % 5 == 0, method="correlation_clustering", components_used=1)
    return rounded(out.select("parameter", "group", "similarity", "representative", "head", "slope", "prediction_r2", F.coalesce("n_test", F.lit(0)).alias("n_test")), 5)
