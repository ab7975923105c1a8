"""Filters, fences, scalers, labels and scalar expressions."""

from pyspark.sql import functions as F

from simlens.catalog.base import (PARAMS, RANGES, lines, metrics_long, params_long, part_metrics_long, parts, query, ranges, rounded, sql, table)
from simlens.functions import exprs as X
from simlens.operators import clean as C
from simlens.operators import ordered as O
from simlens.session import literal_table


@query("round_metrics", sql("parts", "SELECT particle, round_even(extendedprice, 2) AS extendedprice, round_even(tax, 2) AS tax FROM parts"))
def round_metrics(spark, sf):
    return C.round_metrics(parts(spark, sf).select("particle", "extendedprice", "tax"), 2)


@query("drop_constant_columns", sql("", "SELECT event_id, value FROM events"))
def drop_constant_columns(spark, sf):
    return C.drop_constant_columns(table(spark, sf, "events").select("event_id", "value", F.lit(3.0).alias("fixed")))


@query("varying_columns", sql("", "SELECT event_id, value FROM events"))
def varying_columns(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", F.lit(3.0).alias("fixed"))
    return df.select(*C.varying_columns(df))


@query("drop_invalid_rows", sql("", """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0"""))
def drop_invalid_rows(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("a"),
        F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax")).alias("b"))
    return C.drop_invalid_rows(df, ["a", "b"]).drop("a", "b")


@query("valid_seeds", sql("", """SELECT l_suppkey, count(*) AS seed_count, round(avg(l_quantity), 4) AS l_quantity, round(avg(x), 4) AS x
  FROM (SELECT l_suppkey, l_quantity, CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS x FROM lineitem) WHERE x IS NOT NULL GROUP BY l_suppkey"""))
def valid_seeds(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("x"))
    return rounded(C.count_valid_seeds(df, ["l_suppkey"], ["l_quantity", "x"]))


_BOUNDS = """WITH q AS (SELECT run, gen, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM long GROUP BY ALL)"""


@query("fence_long", sql("long", _BOUNDS + """ SELECT run, gen, metric, count(*) AS n, round(sum(value) / 1000, 5) AS total FROM long JOIN q USING (run, gen, metric)
  WHERE NOT (value < q1 - 0.5 * (q3 - q1) OR value > q3 + 0.5 * (q3 - q1)) GROUP BY ALL"""))
def fence_long(spark, sf):
    kept = C.fence(metrics_long(spark, sf), ["run", "gen", "metric"], multiplier=0.5)
    return kept.groupBy("run", "gen", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value") / 1000, 5).alias("total"))


@query("fence_guarded", sql("long", _BOUNDS + """ SELECT run, gen, metric, count(*) AS rows, count_if(n >= 4 AND q3 > q1 AND (value < q1 - 0.4 * (q3 - q1) OR value > q3 + 0.4 * (q3 - q1)))::BIGINT AS outside
  FROM long JOIN q USING (run, gen, metric) GROUP BY ALL"""))
def fence_guarded(spark, sf):
    flagged = C.flag_outliers(metrics_long(spark, sf), ["run", "gen", "metric"], multiplier=0.4, min_n=4, guard_iqr=True)
    return flagged.groupBy("run", "gen", "metric").agg(F.count(F.lit(1)).alias("rows"), F.count_if("outside").alias("outside"))


@query("fence_rows", sql("parts", """WITH q AS (SELECT quantile_cont(quantity, [0.25, 0.75]) AS a, quantile_cont(extendedprice, [0.25, 0.75]) AS b FROM parts)
  SELECT particle, quantity, extendedprice FROM parts, q WHERE NOT (quantity < a[1] - 1.5 * (a[2] - a[1]) OR quantity > a[2] + 1.5 * (a[2] - a[1]))
  AND NOT (extendedprice < b[1] - 1.5 * (b[2] - b[1]) OR extendedprice > b[2] + 1.5 * (b[2] - b[1]))"""))
def fence_rows(spark, sf):
    return C.fence_rows(parts(spark, sf).select("particle", "quantity", "extendedprice"), ["quantity", "extendedprice"])


@query("outlier_report_iqr", sql("mlong", """WITH q AS (SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM mlong GROUP BY metric),
  f AS (SELECT metric, (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS o FROM mlong JOIN q USING (metric))
  SELECT metric, count_if(o)::BIGINT AS n_outliers, round(100.0 * count_if(o) / count(*), 4) AS outlier_percentage, 100.0 * count_if(o) / count(*) > 5 AS has_many_outliers FROM f GROUP BY metric"""))
def outlier_report_iqr(spark, sf):
    return rounded(C.outlier_report(part_metrics_long(spark, sf), ["metric"]))


@query("outlier_report_zscore", sql("mlong", """WITH s AS (SELECT metric, avg(value) AS m, stddev_pop(value) AS s FROM mlong GROUP BY metric),
  f AS (SELECT metric, abs((value - m) / s) > 3 AS o FROM mlong JOIN s USING (metric))
  SELECT metric, count_if(o)::BIGINT AS n_outliers, round(100.0 * count_if(o) / count(*), 4) AS outlier_percentage, 100.0 * count_if(o) / count(*) > 5 AS has_many_outliers FROM f GROUP BY metric"""))
def outlier_report_zscore(spark, sf):
    return rounded(C.outlier_report(part_metrics_long(spark, sf), ["metric"], method="zscore"))


@query("percentile_labels", sql("parts", """WITH q AS (SELECT grp, quantile_cont(quantity, 0.1) AS lo, quantile_cont(quantity, 0.9) AS hi FROM parts GROUP BY grp)
  SELECT particle, quantity, CASE WHEN quantity >= hi THEN 'high_metric' WHEN quantity <= lo THEN 'low_metric' ELSE 'not_assigned' END AS percentile_label FROM parts JOIN q USING (grp)"""))
def percentile_labels(spark, sf):
    return C.percentile_labels(parts(spark, sf).select("particle", "grp", "quantity"), "quantity", 10, ["grp"]).drop("grp")


_BOX = " AND ".join(f"{p} BETWEEN {lo} AND {hi}" for p, (lo, hi) in RANGES.items())
_VOLUME = 1.0
for _lo, _hi in RANGES.values():
    _VOLUME *= _hi - _lo


@query("uniform_prior_density", sql("parts", f"SELECT particle, CASE WHEN {_BOX} THEN round({1 / _VOLUME!r}, 4) ELSE 0 END::DOUBLE AS density FROM parts"))
def uniform_prior_density(spark, sf):
    return rounded(parts(spark, sf).select("particle", X.uniform_density(RANGES).alias("density")))


@query("triangle_prior_density", sql("", """SELECT event_id, CASE WHEN value BETWEEN 1 AND 100 AND a BETWEEN 0 AND 0.8 AND b BETWEEN 0 AND 0.7 AND a + b <= 1
   THEN round(1 / (value * ln(100)) / 0.435, 6) ELSE 0 END::DOUBLE AS density FROM (SELECT event_id, value, (event_id % 90) / 100.0::DOUBLE AS a, (event_id % 73) / 100.0::DOUBLE AS b FROM events)"""))
def triangle_prior_density(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", ((F.col("event_id") % 90) / 100.0).alias("a"), ((F.col("event_id") % 73) / 100.0).alias("b"))
    return rounded(df.select("event_id", X.log_uniform_triangle_density({"value": (1.0, 100.0)}, {"a": (0.0, 0.8), "b": (0.0, 0.7)}).alias("density")), 6)


@query("out_of_box", sql("parts", f"SELECT grp, count_if(NOT ({_BOX}))::BIGINT AS outside, 5 AS columns_checked FROM parts GROUP BY grp"))
def out_of_box(spark, sf):
    return C.out_of_box(parts(spark, sf), ["grp"], RANGES)


@query("prior_range_units", sql("plong ranges", "SELECT particle, parameter, round(greatest(-0.05, least(1.05, (value - lo) / (hi - lo))) * 0.7310585786, 6) AS unit FROM plong JOIN ranges USING (parameter)"))
def prior_range_units(spark, sf):
    out = C.to_prior_range(params_long(spark, sf), ranges(spark), clip=(-0.05, 1.05))
    return rounded(out.select("particle", "parameter", (F.col("unit") * 0.7310585786).alias("unit")), 6)


@query("frozen_zscore", sql("mlong", """WITH f AS (SELECT metric, avg(value) AS mu, stddev_pop(value) AS sd FROM mlong WHERE grp = 'SMALL' GROUP BY metric)
  SELECT particle, metric, round((value - mu) / sd, 4) AS z FROM mlong JOIN f USING (metric)"""))
def frozen_zscore(spark, sf):
    long = part_metrics_long(spark, sf)
    scaler = C.fit_scaler(long.where("grp = 'SMALL'"), ["metric"])
    return rounded(C.apply_scaler(long, scaler, ["metric"]).select("particle", "metric", "z"))


@query("minmax_scale", sql("mlong", """WITH f AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM mlong GROUP BY metric)
  SELECT particle, metric, round((value - lo) / (hi - lo), 6) AS scaled FROM mlong JOIN f USING (metric)"""))
def minmax_scale(spark, sf):
    long = part_metrics_long(spark, sf)
    return rounded(C.apply_minmax(long, C.fit_minmax(long, ["metric"]), ["metric"]).select("particle", "metric", "scaled"), 6)


@query("error_expressions", sql("", """SELECT l_orderkey, l_linenumber, round((l_quantity - 27) / 27 * 100, 6) AS signed_pct, round(abs(l_quantity - 27) / 27 * 100, 6) AS absolute_pct,
  (l_quantity - 27) * (l_quantity - 27) AS squared, abs(l_quantity - 27) AS absolute FROM lineitem"""))
def error_expressions(spark, sf):
    t = F.lit(27.0)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(X.signed_percent_error("l_quantity", t), 6).alias("signed_pct"),
        F.round(X.absolute_percent_error("l_quantity", t), 6).alias("absolute_pct"),
        X.squared_error("l_quantity", t).alias("squared"), X.absolute_error("l_quantity", t).alias("absolute"))


@query("change_from_prior_mean", sql("plong", """WITH m AS (SELECT parameter, avg(value) AS m FROM plong WHERE grp <> 'SMALL' GROUP BY parameter)
  SELECT particle, parameter, round((value - m) / m * 100, 4) AS change_pct FROM plong JOIN m USING (parameter) WHERE grp = 'SMALL'"""))
def change_from_prior_mean(spark, sf):
    long = params_long(spark, sf)
    out = C.change_from_mean(long.where("grp = 'SMALL'"), long.where("grp <> 'SMALL'"), ["parameter"])
    return rounded(out.select("particle", "parameter", "change_pct"))


@query("name_and_id_parsing", sql("", """SELECT p_partkey, (p_partkey % 9)::INTEGER AS spacing, (p_partkey % 11)::INTEGER AS pair_last, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE -1 END::INTEGER AS particle,
  'CELL_VOLUME' AS base, 'Cell volume' AS display, 'Cell Volume' AS title, p_partkey AS number FROM part"""))
def name_and_id_parsing(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", X.spacing(F.concat(F.lit("*:"), (k % 9).cast("string"))).alias("spacing"),
        X.spacing(F.concat(F.lit("4:"), (k % 11).cast("string"))).alias("pair_last"),
        X.folder_number(F.concat(F.when(k % 2 == 0, "run/input_").otherwise("other_"), k.cast("string"))).alias("particle"),
        X.base_name(F.lit("CELL_VOLUME_MU")).alias("base"), X.display_name(F.lit("CELL_VOLUME_SIGMA")).alias("display"),
        X.title_name(F.lit("CELL_VOLUME_MU")).alias("title"), X.embedded_number(F.concat(F.lit("input_"), k.cast("string"))).alias("number"))


@query("format_parameters", sql("parts", """SELECT particle, 'quantity' AS parameter, round_even(quantity, 1) AS formatted FROM parts
  UNION ALL SELECT particle, 'discount', round_even(least(1, discount), 3) FROM parts"""))
def format_parameters(spark, sf):
    long = params_long(spark, sf)
    dictionary = literal_table(spark, [("quantity", False, 1), ("discount", True, 3)], "parameter string, bounded boolean, digits int")
    return C.format_parameters(long, dictionary).select("particle", "parameter", "formatted")


@query("split_family", sql("plong", "SELECT particle, parameter, value FROM plong WHERE parameter IN ('p_size', 'tax')"))
def split_family(spark, sf):
    d = literal_table(spark, [(p, "source" if p in ("p_size", "tax") else "cellular") for p in PARAMS], "parameter string, family string")
    return C.split_family(params_long(spark, sf), d, "source").select("particle", "parameter", "value")


@query("wide_to_long", sql("li", """SELECT run, metric, count(*) AS n, round(sum(value) / 1000, 5) AS total FROM (
  SELECT run, 'quantity' AS metric, quantity AS value FROM li UNION ALL SELECT run, 'tax', tax FROM li) GROUP BY ALL"""))
def wide_to_long(spark, sf):
    long = C.melt(lines(spark, sf), ["run"], ["quantity", "tax"])
    return long.groupBy("run", "metric").agg(F.count("value").alias("n"), F.round(F.sum("value") / 1000, 5).alias("total"))


@query("valid_predicted_samples", sql("parts", "SELECT particle, quantity - 25 AS quantity FROM parts WHERE quantity - 25 >= 0"))
def valid_predicted_samples(spark, sf):
    df = parts(spark, sf).select("particle", (F.col("quantity") - 25).alias("quantity"), F.lit(-1.0).alias("quantity_r2"))
    return C.valid_samples(df, ["quantity", "quantity_r2", "absent"]).drop("quantity_r2")


@query("log_rates", sql("parts", "SELECT particle, round(ln(quantity), 6) AS z, round(quantity * 0.7310585786, 6) AS back FROM parts"))
def log_rates(spark, sf):
    z = C.to_log(parts(spark, sf).select("particle", F.col("quantity").alias("z")), ["z"])
    return z.select("particle", F.round("z", 6).alias("z"), F.round(F.exp("z") * 0.7310585786, 6).alias("back"))


@query("finite_or_null", sql("", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE round_even(value, 1) END AS value FROM events"))
def finite_or_null(spark, sf):
    x = F.when(F.col("event_type") == "error", F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", X.finite_round(x, 1).alias("value"))


@query("signed_r", sql("", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -value ELSE value END AS r FROM events"))
def signed_r(spark, sf):
    slope = F.when(F.col("event_id") % 2 == 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return table(spark, sf, "events").select("event_id", X.signed_r("value", slope).alias("r"))


# --- ordered primitives, also on the route for large groups ----------------------------------------

_RANKS = """SELECT event_id, dense_rank() OVER w AS dense_rank, rank() OVER w AS min_rank, rank() OVER w + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS avg_rank
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)"""


@query("ranks", sql("", _RANKS))
def ranks(spark, sf):
    out = O.with_ranks(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return out.select("event_id", "dense_rank", "min_rank", "avg_rank")


@query("ranks_large_groups", sql("", _RANKS))
def ranks_large_groups(spark, sf):
    out = O.with_ranks(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value", bound=0)
    return out.select("event_id", "dense_rank", "min_rank", "avg_rank")


_QUANT = """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95
  FROM lineitem GROUP BY l_returnflag"""


def _three(df):
    return rounded(df.select("l_returnflag", *[F.element_at("q", i + 1).alias(n) for i, n in enumerate(("p05", "p50", "p95"))]))


@query("quantiles", sql("", _QUANT))
def quantiles(spark, sf):
    return _three(O.quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95]))


@query("quantiles_large_groups", sql("", _QUANT))
def quantiles_large_groups(spark, sf):
    return _three(O.quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95], bound=0, range_rows=5000))


_TRACE = """WITH r AS (SELECT event_type, event_id, row_number() OVER w AS rn, avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running_mean
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) SELECT event_type, event_id, rn, round(running_mean, 6) AS running_mean FROM r WHERE rn % 50 = 0"""


def _trace(spark, sf, **options):
    out = O.running(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"], sums={"s": F.col("value")}, **options)
    return out.where(F.col("rn") % 50 == 0).select("event_type", "event_id", "rn", F.round(F.col("s") / F.col("rn"), 6).alias("running_mean"))


@query("trace_running_mean", sql("", _TRACE))
def trace_running_mean(spark, sf):
    return _trace(spark, sf)


@query("trace_running_mean_large_groups", sql("", _TRACE))
def trace_running_mean_large_groups(spark, sf):
    return _trace(spark, sf, bound=0, range_rows=500)
