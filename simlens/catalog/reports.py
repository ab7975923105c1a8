"""Rejection, distances, error reports, weights and lineage."""

from pyspark.sql import functions as F

from simlens.catalog.base import (TARGETS, lines, metrics_long, part_metrics_long, mixed, params_long, parts, query, rounded, sql, table, targets)
from simlens.operators import clean as C
from simlens.operators import errors as E
from simlens.operators import lineage as L
from simlens.operators import ordered as O
from simlens.operators import weights as Wt
from simlens.session import literal_table
from simlens.plans.rejection import rejection_report

_NORM = """WITH n AS (SELECT metric, CASE WHEN max(value) > min(value) THEN max(value) - min(value) ELSE 1.0 END AS norm FROM mlong GROUP BY metric),
  d AS (SELECT particle, sum(abs(value - target) / norm * weight) / sum(weight) AS distance FROM mlong JOIN targets USING (metric) JOIN n USING (metric) GROUP BY particle)"""


@query("rejection", sql("mlong targets", _NORM + " SELECT particle, round(distance, 6) AS distance, distance < 0.2 AS accepted FROM d"))
def rejection(spark, sf):
    return rounded(E.rejection(part_metrics_long(spark, sf), targets(spark), ["particle"], 0.2), 6)


@query("rejection_report", sql("mlong targets", _NORM + """, a AS (SELECT * FROM mlong WHERE particle IN (SELECT particle FROM d WHERE distance < 0.2)),
  q AS (SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM a GROUP BY metric),
  m AS (SELECT metric, median(value) AS v FROM a JOIN q USING (metric) WHERE q3 - q1 <= 0 OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY metric)
  SELECT metric, round(v, 4) AS median, round(abs(v - target) / abs(target) * 100, 4) AS error_pct FROM m JOIN targets USING (metric)"""))
def rejection_report_query(spark, sf):
    return rounded(rejection_report(part_metrics_long(spark, sf), targets(spark), "particle", 0.2))


_T = {m: t * 1.0000123457 for m, t in TARGETS.items()}      # no target on a rounding tie
_D = {m: f"({m} - {t!r})" for m, t in _T.items()}


@query("distances", sql("parts", f"""WITH s AS (SELECT grp, count(*) AS n, {', '.join(f'var_pop({m}) AS v_{m}, avg({_D[m]}) AS m_{m}' for m in _T)} FROM parts GROUP BY grp)
  SELECT particle, round(sqrt({' + '.join(f'{d} * {d}' for d in _D.values())}), 5) AS euclidean_raw,
  round(sqrt({' + '.join(f'pow({d} / {abs(_T[m])!r}, 2)' for m, d in _D.items())}), 5) AS euclidean_normalized,
  round(sqrt({' + '.join(f'pow({d}, 2) / (n * v_{m} / (n + 1) + n * m_{m} * m_{m} / pow(n + 1, 2))' for m, d in _D.items())}), 5) AS euclidean_standardized,
  round({' + '.join(f'abs({d})' for d in _D.values())}, 5) AS manhattan_raw FROM parts JOIN s USING (grp)"""))
def distances(spark, sf):
    return rounded(E.distances(parts(spark, sf), _T, ["grp"]).select("particle", "euclidean_raw", "euclidean_normalized", "euclidean_standardized", "manhattan_raw"), 5)


@query("distance_mahalanobis", sql("parts", f"""WITH c AS (SELECT covar_samp(discount, discount) AS a, covar_samp(discount, quantity) AS b, covar_samp(quantity, quantity) AS d FROM parts)
  SELECT particle, round(sqrt(({_D['discount']} * {_D['discount']} * d - 2 * {_D['discount']} * {_D['quantity']} * b + {_D['quantity']} * {_D['quantity']} * a) / (a * d - b * b)), 4) AS mahalanobis FROM parts, c"""))
def distance_mahalanobis(spark, sf):
    two = {m: _T[m] for m in ("discount", "quantity")}
    return rounded(E.distances(parts(spark, sf), two).select("particle", "mahalanobis"))


@query("distance_summary", sql("parts", f"""WITH d AS (SELECT grp, sqrt({' + '.join(f'{d} * {d}' for d in _D.values())}) AS e, {' + '.join(f'abs({d})' for d in _D.values())} AS m FROM parts)
  SELECT grp, 'euclidean_raw' AS distance, round(avg(e), 3) AS mean, round(stddev_pop(e), 3) AS std, round(median(e), 3) AS median FROM d GROUP BY grp
  UNION ALL SELECT grp, 'manhattan_raw', round(avg(m), 3), round(stddev_pop(m), 3), round(median(m), 3) FROM d GROUP BY grp"""))
def distance_summary(spark, sf):
    out = E.distance_summary(parts(spark, sf), _T, ["grp"])
    return rounded(out.where(F.col("distance").isin("euclidean_raw", "manhattan_raw")), 3)


@query("best_sample", sql("parts", f"""WITH s AS (SELECT grp, {', '.join(f'stddev_pop({m}) AS s_{m}' for m in _T)} FROM parts GROUP BY grp),
  d AS (SELECT parts.*, sqrt({' + '.join(f'pow({d} / s_{m}, 2)' for m, d in _D.items())}) AS distance FROM parts JOIN s USING (grp))
  SELECT grp, particle, round(distance, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY grp ORDER BY distance, particle) = 1"""))
def best_sample(spark, sf):
    return rounded(E.best_sample(parts(spark, sf), _T, "particle", ["grp"]).select("grp", "particle", "distance"), 5)


@query("posterior_summary", sql("plong ranges", """SELECT grp, parameter, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_pop(value), 4) AS std,
  round(quantile_cont(value, 0.025), 4) AS ci_lo, round(quantile_cont(value, 0.975), 4) AS ci_hi, round(avg(value) - any_value(lo), 4) AS bias, round((avg(value) - any_value(lo)) / any_value(lo), 4) AS relative_bias,
  any_value(lo) BETWEEN quantile_cont(value, 0.025) AND quantile_cont(value, 0.975) AS in_ci FROM plong JOIN ranges USING (parameter) GROUP BY ALL"""))
def posterior_summary(spark, sf):
    from simlens.catalog.base import ranges
    truth = ranges(spark).select("parameter", F.col("lo").alias("true_value"))
    return rounded(E.posterior_summary(params_long(spark, sf), truth, ["grp", "parameter"]))


@query("metric_summary", sql("long targets", """SELECT gen, metric, round(any_value(target), 4) AS target, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS std, round(median(value), 6) AS median,
  round(avg(value) - any_value(target), 3) AS bias, round(avg((value - target) * (value - target)) / 1e6, 3) AS mse_m, round(avg(abs(value - target)), 3) AS mae, round((avg(value) - any_value(target)) / abs(any_value(target)) * 100, 3) AS relative_bias_pct,
  round(quantile_cont(value, 0.025), 6) AS p025, round(quantile_cont(value, 0.975), 6) AS p975, any_value(target) BETWEEN quantile_cont(value, 0.025) AND quantile_cont(value, 0.975) AS target_in_interval
  FROM long JOIN targets USING (metric) GROUP BY gen, metric"""))
def metric_summary(spark, sf):
    out = E.metric_summary(metrics_long(spark, sf), targets(spark), ["gen"])
    return mixed(out.withColumn("mse_m", F.col("mse") / 1e6).drop("mse"), 3, median=6, p025=6, p975=6, target=4)


@query("generation_statistics", sql("long targets", """SELECT run, gen, metric, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS std, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75,
  min(value) AS min, max(value) AS max, round(avg((value - target) / target * 100), 3) AS err_mean, round(stddev_pop((value - target) / target * 100), 3) AS err_std,
  round(quantile_cont((value - target) / target * 100, 0.25), 6) AS err_q25, round(quantile_cont((value - target) / target * 100, 0.75), 6) AS err_q75,
  round(min((value - target) / target * 100), 3) AS err_min, round(max((value - target) / target * 100), 3) AS err_max FROM long JOIN targets USING (metric) GROUP BY run, gen, metric"""))
def generation_statistics(spark, sf):
    return mixed(E.generation_statistics(metrics_long(spark, sf), targets(spark), ["run", "gen"]), 3, q25=6, q75=6, err_q25=6, err_q75=6)


_FENCED = """WITH q AS (SELECT run, gen, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL),
  m AS (SELECT run, gen, metric, median(value) AS v FROM long JOIN q USING (run, gen, metric) WHERE q3 - q1 <= 0 OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL),
  e AS (SELECT run, gen, metric, abs(v - target) / abs(target) * 100 AS e FROM m JOIN targets USING (metric))"""


@query("generation_error", sql("long targets", _FENCED + " SELECT run, gen, round(avg(e), 4) AS error_mean, round(stddev_pop(e), 4) AS error_std FROM e GROUP BY run, gen"))
def generation_error(spark, sf):
    return rounded(E.generation_error(metrics_long(spark, sf), targets(spark), ["run", "gen"]))


_MEANS = """WITH m AS (SELECT run, gen, metric, avg(value) AS v FROM long GROUP BY ALL),
  e AS (SELECT run, gen, avg(abs(v - target) / abs(target) * 100) AS em, stddev_pop(abs(v - target) / abs(target) * 100) AS es FROM m JOIN targets USING (metric) GROUP BY run, gen)"""


@query("mean_error", sql("long targets", _MEANS + " SELECT run, gen, round(em, 4) AS error_mean, round(es, 4) AS error_std FROM e"))
def mean_error(spark, sf):
    return rounded(E.mean_error(metrics_long(spark, sf), targets(spark), ["run", "gen"]))


@query("generation_change", sql("long targets", _MEANS + """ SELECT run, gen, round(em, 4) AS error_mean, round(em - lag(em) OVER w, 4) AS change,
  round((em - lag(em) OVER w) / lag(em) OVER w * 100, 3) AS change_pct FROM e WINDOW w AS (PARTITION BY run ORDER BY gen)"""))
def generation_change(spark, sf):
    errors = E.mean_error(metrics_long(spark, sf), targets(spark), ["run", "gen"]).drop("error_std")
    return E.change_between(errors, ["run"], "gen", "error_mean").select(
        "run", "gen", F.round("error_mean", 4).alias("error_mean"), F.round("change", 4).alias("change"), F.round("change_pct", 3).alias("change_pct"))


@query("error_contribution", sql("long targets", "SELECT gen, metric, round(avg(abs(value - target) / abs(target) * 100), 3) AS contribution_pct FROM long JOIN targets USING (metric) GROUP BY gen, metric"))
def error_contribution(spark, sf):
    return rounded(E.error_contribution(metrics_long(spark, sf), targets(spark), ["gen"]), 3)


@query("best_summed_error", sql("mlong targets", """WITH e AS (SELECT grp, particle, metric, abs(value - target) / abs(target) * 100 AS e FROM mlong JOIN targets USING (metric)),
  t AS (SELECT grp, particle, sum(e) AS s FROM e GROUP BY ALL), b AS (SELECT grp, particle FROM t QUALIFY row_number() OVER (PARTITION BY grp ORDER BY s, particle) = 1)
  SELECT grp, particle, metric, round(e, 4) AS error_pct FROM e JOIN b USING (grp, particle)"""))
def best_summed_error(spark, sf):
    return rounded(E.best_summed_error(part_metrics_long(spark, sf), targets(spark), ["grp"], "particle"))


@query("total_error", sql("long targets", """WITH m AS (SELECT run, gen, metric, avg(value) AS v, stddev_pop(value) AS s FROM long GROUP BY ALL),
  e AS (SELECT run, gen, abs(v - target) / target AS e, s / target AS ci FROM m JOIN targets USING (metric))
  SELECT run, gen, round(avg(e), 4) AS total_error, round(sqrt(sum(ci * ci)) / count(*), 4) AS total_ci, round(sum(e), 4) AS summed_error FROM e GROUP BY run, gen"""))
def total_error(spark, sf):
    m = metrics_long(spark, sf).groupBy("run", "gen", "metric").agg(F.avg("value").alias("v"), F.stddev_pop("value").alias("s"))
    e = E.with_targets(m, targets(spark)).select("run", "gen", (F.abs(F.col("v") - F.col("target")) / F.col("target")).alias("error"), (F.col("s") / F.col("target")).alias("ci"))
    return rounded(E.total_error(e, ["run", "gen"]))


@query("metric_records", sql("long targets", """WITH grid AS (SELECT * FROM (VALUES ('F'), ('O'), ('Z')) r(run), (VALUES ('quantity'), ('extendedprice'), ('discount')) m(metric)),
  q AS (SELECT run, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM long GROUP BY ALL),
  u AS (SELECT run, metric, any_value(n) AS n_raw, count(*) AS n_used, quantile_cont(value, 0.25) AS a, median(value) AS b, quantile_cont(value, 0.75) AS c FROM long JOIN q USING (run, metric)
        WHERE n < 4 OR q3 <= q1 OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL)
  SELECT run, metric, target, n_raw IS NOT NULL AS available, CASE WHEN n_raw IS NULL THEN 'source_missing' END AS missing_reason, n_raw, n_used, round(a, 4) AS value_q25, round(b, 4) AS value_median, round(c, 4) AS value_q75,
  round((a - target) / target * 100, 4) AS signed_q25, round((b - target) / target * 100, 4) AS signed_median, round((c - target) / target * 100, 4) AS signed_q75, round(abs(b - target) / target * 100, 4) AS absolute_median
  FROM grid JOIN targets USING (metric) LEFT JOIN u USING (run, metric)"""))
def metric_records(spark, sf):
    return rounded(_records(spark, sf))


def _records(spark, sf):
    grid = literal_table(spark, [(r,) for r in "FOZ"], "run string").join(targets(spark).select("metric"), F.lit(True))
    return E.metric_records(metrics_long(spark, sf).drop("gen"), targets(spark), ["run"], grid)


@query("record_summaries", sql("long targets", """WITH q AS (SELECT run, gen, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM long GROUP BY ALL),
  u AS (SELECT run, gen, metric, median(value) AS b FROM long JOIN q USING (run, gen, metric) WHERE n < 4 OR q3 <= q1 OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL),
  r AS (SELECT run, gen, metric, (b - target) / target * 100 AS s FROM u JOIN targets USING (metric))
  SELECT run, gen, metric, count(*) AS records, round(avg(s), 4) AS mean_signed_error_pct, round(avg(abs(s)), 4) AS mean_absolute_error_pct FROM r GROUP BY GROUPING SETS ((run, gen), (run, metric), (run))"""))
def record_summaries(spark, sf):
    long = metrics_long(spark, sf)
    grid = long.select("run", "gen", "metric").distinct()
    return rounded(E.record_summaries(E.metric_records(long, targets(spark), ["run", "gen"], grid), "run", "gen"))


@query("padded_ranges", sql("long targets", """WITH r AS (SELECT metric, min(value) - (max(value) - min(value)) * 0.05 AS lo, max(value) + (max(value) - min(value)) * 0.05 AS hi FROM long GROUP BY metric)
  SELECT metric, round(target - greatest(abs(hi - target), abs(target - lo)), 4) AS lo, round(target + greatest(abs(hi - target), abs(target - lo)), 4) AS hi FROM r JOIN targets USING (metric)"""))
def padded_ranges(spark, sf):
    return rounded(E.padded_ranges(metrics_long(spark, sf), ["metric"], targets=targets(spark)))


@query("mode_errors", sql("long targets", """WITH s AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM long GROUP BY metric), m AS (SELECT gen::VARCHAR AS label, metric, median(value) AS mode, stddev_pop(value) AS std FROM long GROUP BY gen, metric
   UNION ALL SELECT run, metric, median(value), stddev_pop(value) FROM long GROUP BY run, metric)
  SELECT label, metric, round(abs((mode - lo) / (hi - lo) - (target - lo) / (hi - lo)), 6) AS error, round(std / (hi - lo), 6) AS error_std FROM m JOIN s USING (metric) JOIN targets USING (metric)"""))
def mode_errors(spark, sf):
    long = metrics_long(spark, sf)

    def side(key, name):
        med = O.medians(long, [key, "metric"], "value", "mode")
        sd = long.groupBy(key, "metric").agg(F.stddev_pop("value").alias("std"))
        return med.join(sd, [key, "metric"]).withColumnRenamed(key, name)
    return rounded(E.mode_errors(side("gen", "n"), side("run", "reference"), targets(spark), C.fit_minmax(long, ["metric"])), 6)


_ARMS = """WITH arm AS (SELECT run || '-' || gen AS arm, run AS method, gen, l_partkey, extendedprice, discount FROM li),
  al AS (SELECT arm, method, gen, 'extendedprice' AS metric, extendedprice AS value FROM arm UNION ALL SELECT arm, method, gen, 'discount', discount FROM arm
     UNION ALL SELECT arm, method, gen, 'extendedprice_std', s FROM (SELECT arm, method, gen, l_partkey, stddev_pop(extendedprice) AS s FROM arm GROUP BY ALL)),
  q AS (SELECT arm, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM al GROUP BY ALL),
  m AS (SELECT arm, any_value(method) AS method, any_value(gen) AS gen, metric, median(value) AS v FROM al JOIN q USING (arm, metric) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY arm, metric),
  s AS (SELECT arm, any_value(method) AS method, any_value(gen) AS gen, avg(CASE WHEN metric = 'extendedprice' THEN abs(v - 51000) / 51000 * 100 END) AS primary_mae_pct,
     avg(CASE WHEN metric = 'extendedprice' THEN abs(v - 51000) / 51000 * 100 WHEN metric = 'discount' THEN abs(v - 0.04) / 0.04 * 100 END) AS all_target_mae_pct,
     avg(CASE WHEN metric = 'extendedprice_std' THEN v / 51000 * 100 END) AS mean_seed_sd_pct FROM m GROUP BY arm)"""


def _arms(spark, sf):
    li = lines(spark, sf).withColumn("arm", F.concat_ws("-", "run", F.col("gen").cast("string")))
    long = C.melt(li, ["arm"], ["extendedprice", "discount"])
    sd = li.groupBy("arm", "l_partkey").agg(F.stddev_pop("extendedprice").alias("extendedprice_std"))
    long = long.unionByName(C.melt(sd, ["arm"], ["extendedprice_std"]))
    scores = E.arm_scores(long, targets(spark), ["extendedprice"], ["arm"])
    return scores.withColumn("method", F.split("arm", "-")[0]).withColumn("gen", F.split("arm", "-")[1].cast("int"))


@query("arm_scores", sql("li", _ARMS + " SELECT arm, round(primary_mae_pct, 4) AS primary_mae_pct, round(all_target_mae_pct, 4) AS all_target_mae_pct, round(mean_seed_sd_pct, 4) AS mean_seed_sd_pct FROM s"))
def arm_scores(spark, sf):
    return rounded(_arms(spark, sf).drop("method", "gen"))


@query("ranked_selections", sql("li", _ARMS + """, g AS (SELECT method, count(*) AS arms, avg(primary_mae_pct) AS a, stddev_samp(primary_mae_pct) AS b, avg(all_target_mae_pct) AS c, stddev_samp(all_target_mae_pct) AS d, avg(mean_seed_sd_pct) AS e FROM s GROUP BY method)
  SELECT method, arms, round(a, 4) AS mean_primary_mae_pct, round(b, 4) AS sd_primary_mae_pct, round(c, 4) AS mean_all_target_mae_pct, round(d, 4) AS sd_all_target_mae_pct, round(e, 4) AS mean_seed_sd_pct, row_number() OVER (ORDER BY a, b, method) AS rank FROM g"""))
def ranked_selections(spark, sf):
    return rounded(E.ranked_selections(_arms(spark, sf), ["method"]))


@query("paired_methods", sql("li", _ARMS + """ SELECT a.gen, round(a.all_target_mae_pct, 4) AS all_target_mae_pct_F, round(b.all_target_mae_pct, 4) AS all_target_mae_pct_O, round(b.all_target_mae_pct - a.all_target_mae_pct, 4) AS delta_all_target_mae_pct,
  CASE WHEN b.all_target_mae_pct < a.all_target_mae_pct THEN 'O' WHEN b.all_target_mae_pct > a.all_target_mae_pct THEN 'F' ELSE 'tie' END AS winner FROM s a JOIN s b USING (gen) WHERE a.method = 'F' AND b.method = 'O'"""))
def paired_methods(spark, sf):
    return rounded(E.paired_methods(_arms(spark, sf), ["gen"], "F", "O", ["all_target_mae_pct"]))


@query("peak_comparison", sql("li", _ARMS + """, p AS (SELECT a.gen % 2 AS peak, a.all_target_mae_pct AS x, b.all_target_mae_pct AS y FROM s a JOIN s b USING (gen) WHERE a.method = 'F' AND b.method = 'O')
  SELECT peak, round(avg(x), 4) AS mean_first, round(avg(y), 4) AS mean_second, round(avg(y) - avg(x), 4) AS delta, round(100 * (avg(y) - avg(x)) / nullif(avg(x), 0), 4) AS relative_change_pct,
  count_if(y < x)::BIGINT AS second_wins, count(*) AS pairs, CASE WHEN avg(y) < avg(x) THEN 'O' WHEN avg(y) > avg(x) THEN 'F' ELSE 'tie' END AS winner FROM p GROUP BY peak"""))
def peak_comparison(spark, sf):
    paired = E.paired_methods(_arms(spark, sf), ["gen"], "F", "O", ["all_target_mae_pct"]).withColumn("peak", F.col("gen") % 2)
    return rounded(E.peak_comparison(paired, ["peak"], "all_target_mae_pct", "F", "O"))


_MW = """WITH pr AS (SELECT a.e AS first, b.e AS second FROM (SELECT DISTINCT event_type AS e FROM events) a JOIN (SELECT DISTINCT event_type AS e FROM events) b ON a.e < b.e),
  x AS (SELECT first, second, event_type, value FROM pr JOIN events ON event_type IN (first, second)),
  k AS (SELECT *, rank() OVER (PARTITION BY first, second ORDER BY value) + (count(*) OVER (PARTITION BY first, second, value) - 1) / 2.0::DOUBLE AS r FROM x)
  SELECT first, second, sum(CASE WHEN event_type = first THEN r END) - count_if(event_type = first) * (count_if(event_type = first) + 1) / 2.0::DOUBLE AS u FROM k GROUP BY first, second"""


@query("scenario_tests", sql("", _MW))
def scenario_tests(spark, sf):
    return E.scenario_tests(table(spark, sf, "events"), [], "event_type", "value").select("first", "second", "u")


# erfc by its series below 2 and by its continued fraction above
_MWP = _MW.replace("\n  SELECT first, second, sum(", """,
  t AS (SELECT first, second, sum(c * c * c - c)::DOUBLE AS ties, sum(c)::DOUBLE AS n FROM (SELECT first, second, value, count(*)::DOUBLE AS c FROM x GROUP BY ALL) GROUP BY ALL),
  u AS (SELECT first, second, count_if(event_type = first)::DOUBLE AS n1, sum(""").replace(" AS u FROM k GROUP BY first, second", """ AS u FROM k GROUP BY first, second),
  z AS (SELECT first, second, u, greatest(0, (abs(u - n1 * (n - n1) / 2) - 0.5) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1))))) AS z FROM u JOIN t USING (first, second)),
  p AS (SELECT *, z / sqrt(2::DOUBLE) AS q, CASE WHEN z / sqrt(2::DOUBLE) < 2 THEN 1 - 2 / sqrt(pi()) * list_sum([CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * pow(z / sqrt(2::DOUBLE), 2 * i + 1) / (gamma(i + 1.0) * (2 * i + 1)) for i in range(0, 60)])
    ELSE exp(-z * z / 2) / sqrt(pi()) / list_reduce(list_prepend(z / sqrt(2::DOUBLE), [(80 - i)::DOUBLE for i in range(0, 80)]), lambda f, i: z / sqrt(2::DOUBLE) + i / 2 / f) END AS p FROM z)
  SELECT first, second, u, round(z, 6) AS z, round(p, 8) AS p, p < 0.05 / (SELECT count(*) FROM pr) AS significant FROM p""")


@query("scenario_test_p_values", sql("", _MWP))
def scenario_test_p_values(spark, sf):
    out = E.scenario_tests(table(spark, sf, "events"), [], "event_type", "value")
    return out.withColumn("z", F.round("z", 6)).withColumn("p", F.round("p", 8))


@query("pairwise_metrics", sql("parts", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r, round(regr_slope({b}, {a}), 4) AS slope, round(regr_intercept({b}, {a}), 4) AS intercept FROM parts"
    for a in ("quantity", "extendedprice", "tax") for b in ("quantity", "extendedprice", "tax") if a != b)))
def pairwise_metrics(spark, sf):
    return E.pairwise_metrics(parts(spark, sf), ["quantity", "extendedprice", "tax"]).select("x", "y", F.round("r", 6).alias("r"), F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


# --- weights -----------------------------------------------------------------------------------------

@query("effective_size", sql("li", """SELECT run, gen, count(*) AS n_particles, round(pow(sum(extendedprice), 2) / sum(extendedprice * extendedprice), 3) AS ess, round(pow(sum(extendedprice), 2) / sum(extendedprice * extendedprice) / count(*), 6) AS ess_fraction,
  count_if(extendedprice > 0)::BIGINT AS support, max(extendedprice) AS max_weight FROM li GROUP BY run, gen"""))
def effective_size(spark, sf):
    out = Wt.effective_size(lines(spark, sf), ["run", "gen"], "extendedprice")
    return out.withColumns({"ess": F.round("ess", 3), "ess_fraction": F.round("ess_fraction", 6)})


@query("normalised_weights", sql("parts", "SELECT particle, round(n_lines / sum(n_lines) OVER (PARTITION BY grp), 8) AS weight FROM parts"))
def normalised_weights(spark, sf):
    out = Wt.normalise(parts(spark, sf).select("particle", "grp", F.col("n_lines").cast("double").alias("weight")), ["grp"])
    return rounded(out.select("particle", "weight"), 8)


@query("normalised_log_weights", sql("parts", """WITH m AS (SELECT particle, grp, exp(quantity - max(quantity) OVER (PARTITION BY grp)) AS w FROM parts)
  SELECT particle, round(w / sum(w) OVER (PARTITION BY grp), 8) AS weight FROM m"""))
def normalised_log_weights(spark, sf):
    out = Wt.normalise_log(parts(spark, sf).select("particle", "grp", F.col("quantity").alias("log_weight")), ["grp"])
    return rounded(out.select("particle", "weight"), 8)


@query("aligned_weights", sql("parts", """WITH w AS (SELECT particle, CASE WHEN p_size <= 15 THEN n_lines ELSE 0 END::DOUBLE AS w, grp FROM parts)
  SELECT particle, round(w / sum(w) OVER (PARTITION BY grp), 8) AS weight FROM w"""))
def aligned_weights(spark, sf):
    p = parts(spark, sf)
    w = p.where("p_size <= 15").select("particle", F.col("n_lines").cast("double").alias("weight"))
    return rounded(Wt.align(p.select("particle", "grp"), w, ["particle"], ["grp"]).select("particle", "weight"), 8)


@query("weighted_geometry", sql("parts", """WITH c AS (SELECT grp, sum(n_lines * quantity) / sum(n_lines) AS a, sum(n_lines * tax) / sum(n_lines) AS b FROM parts GROUP BY grp)
  SELECT grp, round(any_value(a), 6) AS centre_quantity, round(any_value(b), 6) AS centre_tax, round(sum(n_lines * (pow(quantity - a, 2) + pow(tax - b, 2))) / sum(n_lines), 5) AS trace,
  round(sqrt(pow(any_value(a) - 25, 2) + pow(any_value(b) - 0.04, 2)), 6) AS centroid_shift FROM parts JOIN c USING (grp) GROUP BY grp"""))
def weighted_geometry(spark, sf):
    out = Wt.weighted_geometry(parts(spark, sf), ["grp"], ["quantity", "tax"], "n_lines", {"quantity": 25.0, "tax": 0.04})
    return rounded(out, 6).withColumn("trace", F.round("trace", 5))


@query("family_spread", sql("parts", """WITH c AS (SELECT grp, sum(n_lines * quantity) / sum(n_lines) AS a FROM parts GROUP BY grp) SELECT round(stddev_samp(a), 6) AS sd_centre_quantity, count(*) AS families FROM c"""))
def family_spread(spark, sf):
    return rounded(Wt.spread_across(Wt.weighted_geometry(parts(spark, sf), ["grp"], ["quantity"], "n_lines"), [], ["centre_quantity"]), 6)


@query("weighted_errors", sql("mlong parts targets", """WITH e AS (SELECT mlong.grp, metric, sum(n_lines * abs(value - target) / target * 100) / sum(n_lines) AS wm, avg(abs(value - target) / target * 100) AS pm,
  abs(sum(n_lines * value) / sum(n_lines) - any_value(target)) / any_value(target) * 100 AS pe FROM mlong JOIN parts USING (particle) JOIN targets USING (metric) GROUP BY mlong.grp, metric)
  SELECT grp, round(avg(wm), 4) AS weighted_mae, round(avg(pm), 4) AS prior_mae, round(avg(pe), 4) AS predictive_mean_error FROM e GROUP BY grp"""))
def weighted_errors(spark, sf):
    p = parts(spark, sf)
    long = C.melt(p, ["particle", "grp", "n_lines"], ["quantity", "extendedprice", "discount"])
    return rounded(Wt.weighted_errors(long, targets(spark), ["grp"], "n_lines"))


_RESAMPLE = """WITH c AS (SELECT particle, grp, sum(n_lines) OVER (PARTITION BY grp ORDER BY particle) AS hi, n_lines, sum(n_lines) OVER (PARTITION BY grp) AS t FROM parts),
  u AS (SELECT grp, i AS draw, (i * 0.6180339887 + 0.05) % 1 AS u FROM (SELECT DISTINCT grp FROM parts), range(0, 500) t(i))
  SELECT grp, draw, particle FROM u JOIN c USING (grp) WHERE u * t > hi - n_lines AND u * t <= hi"""


def _resample(spark, sf, **options):
    p = parts(spark, sf).select("grp", "particle", F.col("n_lines").cast("double").alias("weight"))
    u = p.select("grp").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(499)).cast("array<bigint>")))
    u = u.withColumn("u", (F.col("draw") * 0.6180339887 + 0.05) % 1)
    return Wt.resample(p, 500, 0, "particle", ["grp"], uniforms=u, **options).select("grp", "draw", "particle")


@query("weighted_resample", sql("parts", _RESAMPLE))
def weighted_resample(spark, sf):
    return _resample(spark, sf)


@query("weighted_resample_large_groups", sql("parts", _RESAMPLE))
def weighted_resample_large_groups(spark, sf):
    return _resample(spark, sf, bound=0)


# --- lineage -----------------------------------------------------------------------------------------

def _edges(spark, sf):
    o = table(spark, sf, "orders").select(F.lit(3).alias("gen"), F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("parent"))
    c = table(spark, sf, "customer").select(F.lit(2).alias("gen"), F.col("c_custkey").alias("child"), F.col("c_nationkey").cast("bigint").alias("parent"))
    n = table(spark, sf, "nation").select(F.lit(1).alias("gen"), F.col("n_nationkey").cast("bigint").alias("child"), F.col("n_regionkey").cast("bigint").alias("parent"))
    return o.unionByName(c).unionByName(n)


@query("trace_founders", sql("", "SELECT o_orderkey AS particle, n_regionkey::BIGINT AS founder FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"))
def trace_founders(spark, sf):
    return L.trace_founders(_edges(spark, sf), 3)


@query("check_lineage", sql("", """SELECT 3 AS gen, count(*) AS rows, count(DISTINCT o_orderkey) AS children, count(DISTINCT o_custkey) AS parents, count_if(NOT o_custkey BETWEEN 1 AND 1000)::BIGINT AS bad_parents FROM orders
  UNION ALL SELECT 2, count(*), count(DISTINCT c_custkey), count(DISTINCT c_nationkey), count_if(NOT c_nationkey BETWEEN 1 AND 1000)::BIGINT FROM customer
  UNION ALL SELECT 1, count(*), count(DISTINCT n_nationkey), count(DISTINCT n_regionkey), count_if(NOT n_regionkey BETWEEN 1 AND 1000)::BIGINT FROM nation"""))
def check_lineage(spark, sf):
    return L.check_lineage(_edges(spark, sf), 1000)


def _generations(spark, sf):
    """Customers are the children of generation 1, suppliers with the same number the parents."""
    s = table(spark, sf, "supplier").select(F.lit(0).alias("gen"), F.col("s_suppkey").alias("particle"), (F.col("s_acctbal") / 1000).alias("a"), (F.col("s_nationkey") / 25.0).alias("b"), F.col("s_nationkey").alias("x"))
    c = table(spark, sf, "customer").select(F.lit(1).alias("gen"), F.col("c_custkey").alias("particle"), (F.col("c_acctbal") / 1000).alias("a"), (F.col("c_nationkey") / 25.0).alias("b"), F.col("c_nationkey").alias("x"))
    e = table(spark, sf, "customer").select(F.lit(1).alias("gen"), F.col("c_custkey").alias("child"), (F.col("c_custkey") % 100).alias("parent"))
    return e, s.unionByName(c)


_STEP = """WITH d AS (SELECT c_custkey % 100 AS founder, c_mktsegment AS mode, c_acctbal / 1000 AS a, c_nationkey / 25.0::DOUBLE AS b, pow(c_acctbal / 1000 - s_acctbal / 1000, 2) + pow(c_nationkey / 25.0::DOUBLE - s_nationkey / 25.0::DOUBLE, 2) AS d2,
  abs(c_nationkey - s_nationkey) AS l1 FROM customer JOIN supplier ON s_suppkey = c_custkey % 100)"""


@query("transition_geometry", sql("", _STEP + """ SELECT 1 AS gen, (SELECT count(DISTINCT (c_acctbal, c_nationkey)) FROM customer) AS distinct_vectors, round(avg((d2 > 0)::INT), 4) AS nonzero_step_fraction, round(sqrt(avg(d2) / 2), 4) AS rms_step, round(avg((l1 > 0)::INT), 4) AS spacing_changed_fraction,
  round(quantile_cont(sqrt(d2), 0.05), 4) AS step_p05, round(median(sqrt(d2)), 4) AS step_median, round(quantile_cont(sqrt(d2), 0.95), 4) AS step_p95, round(max(sqrt(d2)), 4) AS step_max FROM d"""))
def transition_geometry(spark, sf):
    e, p = _generations(spark, sf)
    return rounded(L.transition_geometry(e, p, ["a", "b"], ["x"]))


@query("founder_geometry", sql("", _STEP + """, s AS (SELECT founder, quantile_cont(a, 0.95) - quantile_cont(a, 0.05) AS sa, quantile_cont(b, 0.95) - quantile_cont(b, 0.05) AS sb FROM d GROUP BY founder)
  SELECT founder, count(*) AS descendants, count(DISTINCT mode) AS distinct_modes, array_to_string(list_sort(list(DISTINCT mode)), ';') AS modes, round(median(sqrt(d2)), 4) AS distance_median, round(quantile_cont(sqrt(d2), 0.95), 4) AS distance_p95,
  round((any_value(sa) + any_value(sb)) / 2, 4) AS span_median, round(least(any_value(sa), any_value(sb)), 4) AS span_min, round(greatest(any_value(sa), any_value(sb)), 4) AS span_max FROM d JOIN s USING (founder) GROUP BY founder"""))
def founder_geometry(spark, sf):
    e, p = _generations(spark, sf)
    traced = L.trace_founders(e, 1)
    modes = table(spark, sf, "customer").select(F.col("c_custkey").alias("particle"), F.col("c_mktsegment").alias("mode"))
    last = p.where("gen = 1").drop("gen").join(modes, "particle")
    return rounded(L.founder_geometry(traced, last, p.where("gen = 0").drop("gen").withColumnRenamed("particle", "founder"), ["a", "b"], "mode"))


@query("nearest_rows", sql("parts", "SELECT grp, particle, row_number() OVER (PARTITION BY grp ORDER BY abs(quantity - 27), particle) AS rank FROM parts QUALIFY rank <= 50"))
def nearest_rows(spark, sf):
    p = parts(spark, sf).withColumn("d", F.abs(F.col("quantity") - 27))
    return O.nearest_rows(p, ["grp"], ["d", "particle"], 50).select("grp", "particle", "rank")


# --- errors by sample size ---------------------------------------------------------------------------

_SIZES = """s AS (SELECT 4 AS size, * FROM mlong UNION ALL SELECT 2, * FROM mlong WHERE particle % 2 = 0 UNION ALL SELECT 1, * FROM mlong WHERE particle % 4 = 0)"""


def _sizes(spark, sf):
    """Nested samples of the particles: all, every second, every fourth."""
    return part_metrics_long(spark, sf).withColumn("size", F.explode(F.expr("filter(array(4, 2, 1), s -> particle % (4 / s) = 0)")))


@query("size_errors", sql("mlong targets", "WITH " + _SIZES + """, c AS (SELECT size, metric, avg(value) AS centre, stddev_pop(value) AS spread FROM s GROUP BY ALL),
  k AS (SELECT metric, min(abs(value - target)) AS lo, max(abs(value - target)) AS hi, any_value(target) AS target FROM s JOIN targets USING (metric) WHERE size = 4 GROUP BY metric),
  r AS (SELECT 'posterior' AS source, size, metric, centre, spread FROM c UNION ALL SELECT 'prior', NULL, metric, avg(value), stddev_pop(value) FROM mlong WHERE grp < 'M' GROUP BY metric UNION ALL SELECT 'default', NULL, metric, min(value), 0 FROM mlong GROUP BY metric)
  SELECT source, size::INTEGER AS size, metric, round((abs(centre - target) - lo) / (hi - lo), 6) AS error, round(spread / (hi - lo), 6) AS error_spread FROM r JOIN k USING (metric)"""))
def size_errors(spark, sf):
    values, whole = _sizes(spark, sf), part_metrics_long(spark, sf)
    centres = values.groupBy("size", "metric").agg(F.avg("value").alias("centre"), F.stddev_pop("value").alias("spread"))
    references = (whole.where("grp < 'M'").groupBy("metric").agg(F.avg("value").alias("centre"), F.stddev_pop("value").alias("spread")).withColumn("source", F.lit("prior"))
                  .unionByName(whole.groupBy("metric").agg(F.min("value").alias("centre"), F.lit(0.0).alias("spread")).withColumn("source", F.lit("default"))))
    return rounded(E.size_errors(values.select("size", "metric", "value"), centres, references, targets(spark)), 6)


@query("final_size_errors", sql("long targets", """WITH t AS (SELECT run AS size, metric, value FROM long QUALIFY gen = max(gen) OVER (PARTITION BY run)),
  p AS (SELECT size, metric, abs(avg(value) - any_value(target)) / any_value(target) * 100 AS error, stddev_pop(value) / any_value(target) * 100 AS ci FROM t JOIN targets USING (metric) GROUP BY size, metric),
  q AS (SELECT size, avg(error) AS total_error, sqrt(sum(ci * ci)) / count(*) AS total_ci, sum(error) AS summed_error FROM p GROUP BY size)
  SELECT size, metric, round(error, 5) AS error, round(ci, 5) AS ci, round(total_error, 5) AS total_error, round(total_ci, 5) AS total_ci, round(summed_error, 5) AS summed_error FROM p JOIN q USING (size)"""))
def final_size_errors(spark, sf):
    return rounded(E.final_size_errors(metrics_long(spark, sf).withColumnRenamed("run", "size"), targets(spark)), 5)
