"""Snapshot reduction and time series."""

from pyspark.sql import functions as F

from simlens.catalog.base import mixed, part_metrics_long, query, rounded, sql, table
from simlens.operators import colony as K
from simlens.operators import series as S
from simlens.operators.spectral import best_lag

# events play cells: folder = user, seed = hour parity, time = day; event type plays the state.
_CELLS = """cells AS (SELECT user_id AS folder, (event_id % 4)::INTEGER AS seed, ((day(ts) - 1) // 10 * 14400)::INTEGER AS t_min, value AS volume, value / 2 AS age,
  CASE event_type WHEN 'view' THEN 'PROLIFERATIVE' WHEN 'click' THEN 'MIGRATORY' WHEN 'signup' THEN 'QUIESCENT' WHEN 'error' THEN 'NECROTIC' ELSE 'APOPTOTIC' END AS state,
  CASE WHEN event_id % 3 = 0 THEN [event_id % 100, event_id % 70] WHEN event_id % 3 = 1 THEN [event_id % 50] ELSE []::BIGINT[] END AS cycles FROM events)"""
_LOCS = """locs AS (SELECT l_suppkey AS folder, 0 AS seed, 0 AS t_min, (l_partkey % 11 - 5)::INTEGER AS u, (l_quantity::INTEGER % 11 - 5) AS v FROM lineitem),
  hex AS (SELECT folder, u, v, -(u + v) AS w FROM locs)"""


def _cells(spark, sf):
    k = F.col("event_id")
    state = (F.when(F.col("event_type") == "view", "PROLIFERATIVE").when(F.col("event_type") == "click", "MIGRATORY")
             .when(F.col("event_type") == "signup", "QUIESCENT").when(F.col("event_type") == "error", "NECROTIC").otherwise("APOPTOTIC"))
    cycles = F.when(k % 3 == 0, F.array(k % 100, k % 70)).when(k % 3 == 1, F.array(k % 50)).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("folder"), (k % 4).cast("int").alias("seed"), (F.floor((F.dayofmonth("ts") - 1) / 10) * 14400).cast("int").alias("t_min"),
        F.col("value").alias("volume"), (F.col("value") / 2).alias("age"), state.alias("state"), cycles.alias("cycles"))


def _locs(spark, sf):
    u, v = (F.col("l_partkey") % 11 - 5).cast("int"), (F.col("l_quantity").cast("int") % 11 - 5)
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("folder"), F.lit(0).alias("seed"), F.lit(0).alias("t_min"),
                                               u.alias("u"), v.alias("v"), (-(u + v)).alias("w"))


@query("cell_metrics", "WITH " + _CELLS + """ SELECT folder, seed, t_min, round(coalesce(avg(volume) FILTER (state <> 'NECROTIC'), 0), 6) AS vol, round(coalesce(avg(age) FILTER (state <> 'NECROTIC'), 0), 6) AS age,
  round(coalesce(avg(CASE WHEN len(cycles) > 0 THEN list_sum(cycles) / len(cycles) END), 0) / 60, 6) AS cycle_length, count(*)::DOUBLE AS n_cells, round(avg((state IN ('PROLIFERATIVE', 'MIGRATORY'))::INT), 6) AS act_ratio,
  round(2 * count_if(state IN ('PROLIFERATIVE', 'MIGRATORY')) / nullif(count_if(state IN ('PROLIFERATIVE', 'MIGRATORY', 'NECROTIC', 'APOPTOTIC')), 0) - 1, 6) AS activity FROM cells GROUP BY ALL""")
def cell_metrics(spark, sf):
    return rounded(K.cell_metrics(_cells(spark, sf), ["vol", "age", "cycle_length", "n_cells", "act_ratio", "activity"]), 6)


@query("cell_states", "WITH " + _CELLS + " SELECT folder, seed, t_min, count_if(state = 'PROLIFERATIVE')::INTEGER AS proliferative, count_if(state = 'NECROTIC')::INTEGER AS necrotic, 0 AS senescent FROM cells GROUP BY ALL")
def cell_states(spark, sf):
    out = K.cell_metrics(_cells(spark, sf), ["states"])
    return out.select("folder", "seed", "t_min", *[F.element_at("states", s).alias(s.lower()) for s in ("PROLIFERATIVE", "NECROTIC", "SENESCENT")])


@query("shannon", "WITH " + _CELLS + """, c AS (SELECT folder, seed, t_min, state, count(*) AS c FROM cells GROUP BY ALL), p AS (SELECT folder, seed, t_min, c / sum(c) OVER (PARTITION BY folder, seed, t_min) AS p FROM c)
  SELECT folder, seed, t_min, round(abs(-sum(p * ln(p))), 6) AS shannon FROM p GROUP BY ALL""")
def shannon(spark, sf):
    return K.shannon(_cells(spark, sf)).withColumn("shannon", F.round(F.abs("shannon"), 6))


@query("colony_diameter", "WITH " + _LOCS + " SELECT folder, 30.0::DOUBLE * (max(u) - min(u) + max(v) - min(v) + max(w) - min(w) + 3) / 3 AS colony_diameter FROM hex GROUP BY folder")
def colony_diameter(spark, sf):
    return K.colony_diameter(_locs(spark, sf), ["folder"])


@query("symmetry", "WITH " + _LOCS + """, h AS (SELECT DISTINCT folder, u, v, w FROM hex), im AS (
  SELECT folder, -w AS u, -u AS v, -v AS w FROM h UNION ALL SELECT folder, v, w, u FROM h UNION ALL SELECT folder, -u, -v, -w FROM h UNION ALL SELECT folder, w, u, v FROM h UNION ALL SELECT folder, -v, -w, -u FROM h)
  SELECT im.folder, round(1 - count_if(h.u IS NULL) / count(*), 6) AS symmetry FROM im LEFT JOIN h USING (folder, u, v, w) GROUP BY im.folder""")
def symmetry(spark, sf):
    return rounded(K.symmetry(_locs(spark, sf), ["folder"]), 6)


_TIMES = _CELLS + """, per AS (SELECT folder, seed, t_min, count(*) AS n, 10 * sqrt(sum(volume)) AS d FROM cells GROUP BY ALL)"""


def _per_time(spark, sf):
    return _cells(spark, sf).groupBy("folder", "seed", "t_min").agg(F.count(F.lit(1)).alias("n_cells"), (10 * F.sqrt(F.sum("volume"))).alias("colony_diameter"))


@query("growth", "WITH " + _TIMES + """, g AS (SELECT folder, seed, arg_min(n, t_min) AS n1, arg_max(n, t_min) AS n2, max(t_min) - min(t_min) AS dt, CASE WHEN count(*) > 1 THEN regr_slope(d, t_min / 1440.0::DOUBLE) END AS s, CASE WHEN count(*) > 1 THEN corr(d, t_min / 1440.0::DOUBLE) END AS r FROM per GROUP BY ALL)
  SELECT folder, seed, CASE WHEN n2 <= n1 THEN -1.0 ELSE round(dt * ln(2) / ln(n2 / n1) / 60, 4) END::DOUBLE AS doub_time, round(s, 4) AS colony_growth, round(r, 4) AS colony_growth_r FROM g""")
def growth(spark, sf):
    out = K.growth(_per_time(spark, sf))
    return rounded(out.withColumn("doub_time", F.when(F.col("doub_time") == F.lit(float("inf")), F.lit(-1.0)).otherwise(F.col("doub_time"))))


@query("seed_aggregation", sql("", """SELECT l_suppkey AS folder, round(median(l_extendedprice), 4) AS price, round(stddev_pop(l_extendedprice), 3) AS price_std, median(l_quantity) AS quantity, round(stddev_pop(l_quantity), 6) AS quantity_std FROM lineitem GROUP BY l_suppkey"""))
def seed_aggregation(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("folder"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return mixed(K.over_seeds(df, ["price", "quantity"]), 4, price_std=3, quantity_std=6)


@query("state_medians", "WITH " + _CELLS + """, c AS (SELECT folder, seed, t_min, count_if(state = 'PROLIFERATIVE') AS p, count_if(state = 'NECROTIC') AS n FROM cells GROUP BY ALL)
  SELECT folder, trunc(median(p))::INTEGER AS proliferative, trunc(median(n))::INTEGER AS necrotic FROM c GROUP BY folder""")
def state_medians(spark, sf):
    out = K.state_medians(K.cell_metrics(_cells(spark, sf), ["states"]))
    return out.select("folder", F.element_at("states", "PROLIFERATIVE").alias("proliferative"), F.element_at("states", "NECROTIC").alias("necrotic"))


@query("seed_summary", sql("", "SELECT l_suppkey AS folder, round(median(l_extendedprice), 4) AS price, round(stddev_samp(l_quantity), 6) AS quantity_std FROM lineitem GROUP BY l_suppkey"))
def seed_summary(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("folder"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return mixed(K.seed_summary(df, ["folder"], ["price"], ["quantity"]), 4, quantity_std=6)


_PRESENT = "present AS (SELECT DISTINCT user_id AS folder, (event_id % 4)::INTEGER AS seed, ((day(ts) - 1) // 3 * 1440)::INTEGER AS t_min FROM events)"


def _present(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("folder"), (F.col("event_id") % 4).cast("int").alias("seed"),
                                             (F.floor((F.dayofmonth("ts") - 1) / 3) * 1440).cast("int").alias("t_min")).distinct()


@query("missing_snapshots", "WITH " + _PRESENT + """ SELECT folder, seed, t_min FROM (SELECT DISTINCT folder FROM present) f, (SELECT unnest([0, 1, 2, 3]) AS seed) s, (SELECT unnest([0, 1440, 2880, 4320]) AS t_min) t
  WHERE (folder, seed, t_min) NOT IN (SELECT (folder, seed, t_min) FROM present)""")
def missing_snapshots(spark, sf):
    return K.missing_snapshots(_present(spark, sf), [0, 1, 2, 3], [0, 1440, 2880, 4320])


@query("complete_particles", "WITH " + _PRESENT + " SELECT DISTINCT folder FROM present WHERE seed = 3 AND t_min = 12960")
def complete_particles(spark, sf):
    return K.complete_particles(_present(spark, sf), 3, 12960)


@query("remaining_particles", "WITH " + _PRESENT + " SELECT c_custkey AS folder FROM customer WHERE c_custkey NOT IN (SELECT folder FROM present WHERE seed = 3 AND t_min = 12960)")
def remaining_particles(spark, sf):
    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("folder"))
    return K.remaining_particles(expected, _present(spark, sf), 3, 12960)


@query("unpaired_snapshots", "WITH " + _PRESENT + " SELECT folder, seed, t_min FROM present WHERE folder NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def unpaired_snapshots(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("folder"))
    p = _present(spark, sf)
    return K.unpaired(p, p.join(c, "folder", "left_semi"))


# --- series: one trajectory per user, or one long trajectory per event type ----------------------------

_EV = "ev AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 - 1704067200 AS t, value, event_id FROM events)"


def _ev(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type", (F.unix_micros(F.to_timestamp("ts")) / 1e6 - 1704067200).alias("t"), "value", "event_id")


_EPI = "WITH " + _EV + """, s AS (SELECT *, lead(t) OVER w AS t2, lead(value) OVER w AS v2, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {k}) AS n FROM ev WINDOW w AS (PARTITION BY {k} ORDER BY t))
  SELECT {k}, max(value) AS peak_i, round(arg_min(t, (-value, t)), 3) AS time_to_peak, arg_max(event_id, t) AS final_r, count(*) AS n_points, round(sum((value + v2) / 2 * (t2 - t)) / (max(t) - min(t)), 5) AS area_i,
  round(coalesce(1e6 * regr_slope(ln(value + 1e-10), t) FILTER (rn <= greatest(2, floor(n * 0.2)) AND greatest(2, floor(n * 0.2)) > 2), 0), 5) AS growth_rate FROM s GROUP BY {k}"""


def _epidemic(spark, sf, key, **options):
    out = S.epidemic_statistics(_ev(spark, sf), [key], "t", "value", "event_id", **options)
    return mixed(out.withColumn("growth_rate", F.col("growth_rate") * 1e6), 5, peak_i=6, time_to_peak=3)


@query("epidemic_statistics", _EPI.replace("{k}", "user_id"))
def epidemic_statistics(spark, sf):
    return _epidemic(spark, sf, "user_id")


@query("epidemic_statistics_large_groups", _EPI.replace("{k}", "event_type"))
def epidemic_statistics_large_groups(spark, sf):
    return _epidemic(spark, sf, "event_type", bound=0)


@query("area_under", "WITH " + _EV + """, s AS (SELECT event_type, t, value, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY t))
  SELECT event_type, round(sum((value + v2) / 2 * (t2 - t)) / 1e6, 4) AS area FROM s GROUP BY event_type""")
def area_under(spark, sf):
    return S.area_under(_ev(spark, sf), ["event_type"], "t", "value").select("event_type", F.round(F.col("area") / 1e6, 4).alias("area"))


@query("local_peaks", "WITH " + _EV + ", s AS (SELECT event_id, user_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, user_id, value FROM s WHERE a < value AND value > b")
def local_peaks(spark, sf):
    return S.local_peaks(_ev(spark, sf), ["user_id"], ["t"], "value").select("event_id", "user_id", "value")


#: Lag by a self join over all pairs of rows; sums within 1e-9 of the largest possible one are equal.
_LAG = """d AS (SELECT {k}, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS p, a - avg(a) OVER (PARTITION BY {k}) AS a, b - avg(b) OVER (PARTITION BY {k}) AS b FROM ev),
  scales AS (SELECT {k}, 1e-9 * sqrt(sum(a * a) * sum(b * b)) AS near FROM d GROUP BY {k}), pairs AS (SELECT x.{k}, x.p - y.p AS lag, sum(x.a * y.b) AS s FROM d x JOIN d y ON x.{k} = y.{k} GROUP BY ALL),
  tops AS (SELECT {k}, max(s) AS top FROM pairs GROUP BY {k}), lags AS (SELECT {k}, min(lag)::BIGINT AS lag FROM pairs JOIN tops USING ({k}) JOIN scales USING ({k}) WHERE s >= top - near GROUP BY {k})"""


@query("two_species_statistics", "WITH ev AS (SELECT user_id, ts, value AS a, (event_id % 37)::DOUBLE AS b FROM events), s AS (SELECT *, lag(a) OVER w AS pa, lead(a) OVER w AS na, lag(b) OVER w AS pb, lead(b) OVER w AS nb FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)), " + _LAG.format(k="user_id", o="ts") + """
  SELECT user_id, any_value(lag) AS lag, round(avg(a), 5) AS a_mean, round(stddev_pop(a), 5) AS a_std, min(a) AS a_min, max(a) AS a_max, count_if(pa < a AND a > na)::BIGINT AS a_peaks, round(avg(b), 5) AS b_mean, round(stddev_pop(b), 5) AS b_std, min(b) AS b_min, max(b) AS b_max,
  count_if(pb < b AND b > nb)::BIGINT AS b_peaks, round(corr(a, b), 5) AS correlation FROM s JOIN lags USING (user_id) GROUP BY user_id""")
def two_species_statistics(spark, sf):
    df = table(spark, sf, "events").select("user_id", "ts", F.col("value").alias("a"), (F.col("event_id") % 37).cast("double").alias("b"))
    return rounded(S.two_species_statistics(df, ["user_id"], ["ts"], "a", "b"), 5)


@query("correlation_lags_large_groups", "WITH ev AS (SELECT event_type, event_id, value AS a, sin(event_id / 40.0) * 50 + (event_id % 11) AS b FROM events), " + _LAG.format(k="event_type", o="event_id") + " SELECT event_type, lag FROM lags")
def correlation_lags_large_groups(spark, sf):
    df = table(spark, sf, "events").select("event_type", "event_id", F.col("value").alias("a"), (F.sin(F.col("event_id") / 40.0) * 50 + F.col("event_id") % 11).alias("b"))
    return best_lag(df, ["event_type"], ["event_id"], "a", "b", bound=0)


_EQ = "WITH " + _EV + """, s AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, max(value) OVER w AS hi, min(value) OVER w AS lo FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
  SELECT user_id, round(coalesce(min(t) FILTER (n = 5 AND greatest(hi - m, m - lo) / m < 0.6), max(t)), 3) AS equilibrium_time FROM s GROUP BY user_id"""


@query("equilibrium_time", _EQ)
def equilibrium_time(spark, sf):
    return rounded(S.equilibrium_time(_ev(spark, sf), ["user_id"], "t", "value", threshold=0.6), 3)


@query("equilibrium_time_large_groups", _EQ)
def equilibrium_time_large_groups(spark, sf):
    return rounded(S.equilibrium_time(_ev(spark, sf), ["user_id"], "t", "value", threshold=0.6, bound=0), 3)


@query("nearest_in_time", "WITH " + _EV + " SELECT user_id, round(arg_min(t, (abs(t - 1000000), t)), 3) AS t, arg_min(value, (abs(t - 1000000), t)) AS value FROM ev GROUP BY user_id")
def nearest_in_time(spark, sf):
    return S.nearest_in_time(_ev(spark, sf), ["user_id"], "t", 1000000.0, ["value"]).withColumn("t", F.round("t", 3))


_GRID = "WITH " + _EV + """, g AS (SELECT user_id, i * 100000.0::DOUBLE AS time FROM (SELECT DISTINCT user_id FROM ev), range(0, 31) r(i)),
  a AS (SELECT g.user_id, time, max(t) FILTER (t <= time) AS t1, arg_max(value, t) FILTER (t <= time) AS v1, min(t) FILTER (t > time) AS t2, arg_min(value, t) FILTER (t > time) AS v2 FROM g JOIN ev USING (user_id) GROUP BY g.user_id, time),
  y AS (SELECT user_id, time, CASE WHEN t1 IS NULL THEN v2 WHEN t2 IS NULL THEN CASE WHEN t1 = time THEN v1 ELSE 0 END ELSE v1 + (v2 - v1) * (time - t1) / (t2 - t1) END AS value FROM a)"""


@query("interpolate_to_grid", _GRID + " SELECT user_id, time, round(value, 5) AS value FROM y")
def interpolate_to_grid(spark, sf):
    return rounded(S.on_grid(_ev(spark, sf), ["user_id"], "t", "value", 0.0, 3000000.0, 100000.0), 5)


@query("grid_quartiles", _GRID + " SELECT time, round(quantile_cont(value, 0.25), 5) AS q25, round(median(value), 5) AS median, round(quantile_cont(value, 0.75), 5) AS q75, count(*) AS n FROM y GROUP BY time")
def grid_quartiles(spark, sf):
    return rounded(S.grid_quartiles(S.on_grid(_ev(spark, sf), ["user_id"], "t", "value", 0.0, 3000000.0, 100000.0), []), 5)


@query("time_course", "SELECT event_type, day(ts) AS day, count(value) AS n_seeds, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY ALL")
def time_course(spark, sf):
    df = table(spark, sf, "events").select("event_type", F.dayofmonth("ts").alias("day"), "value")
    return rounded(S.time_course(df, ["event_type", "day"]), 6)


_DAYS = "d AS (SELECT event_type, (event_id % 4) AS seed, day(ts)::DOUBLE AS day, sum(value) AS y FROM events GROUP BY ALL)"


def _days(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", (F.col("event_id") % 4).alias("seed"), F.dayofmonth("ts").cast("double").alias("day")).agg(F.sum("value").alias("y"))


@query("kinetic_fit_log", "WITH " + _DAYS + """, f AS (SELECT event_type, regr_slope(ln(y), day) AS b, regr_intercept(ln(y), day) AS a, avg(y) AS m FROM d GROUP BY event_type)
  SELECT event_type, round(any_value(b), 6) AS slope, count(*) AS n_timepoints, round(1 - sum(pow(y - exp(a + b * day), 2)) / sum(pow(y - m, 2)), 6) AS r_squared, round(exp(any_value(a)), 4) AS intercept, round(24 * ln(2) / any_value(b) / 1000, 4) AS doubling_time_h
  FROM d JOIN f USING (event_type) GROUP BY event_type""")
def kinetic_fit_log(spark, sf):
    out = S.kinetic_fit(_days(spark, sf), ["event_type"], "day", "y", log=True)
    return mixed(out.withColumn("doubling_time_h", F.col("doubling_time_h") / 1000), 6, intercept=4, doubling_time_h=4)


@query("kinetic_fit_linear", "WITH " + _DAYS + """, f AS (SELECT event_type, regr_slope(y, day) AS b, regr_intercept(y, day) AS a, avg(y) AS m FROM d GROUP BY event_type)
  SELECT event_type, round(any_value(b), 6) AS slope, count(*) AS n_timepoints, round(1 - sum(pow(y - (a + b * day), 2)) / sum(pow(y - m, 2)), 6) AS r_squared, round(any_value(a), 4) AS intercept FROM d JOIN f USING (event_type) GROUP BY event_type""")
def kinetic_fit_linear(spark, sf):
    return mixed(S.kinetic_fit(_days(spark, sf), ["event_type"], "day", "y", log=False), 6, intercept=4)


@query("fit_variability", "WITH " + _DAYS + ", f AS (SELECT event_type, seed, regr_slope(y, day) AS b FROM d GROUP BY ALL) SELECT event_type, count(*) AS n_seed_fits, round(stddev_pop(b), 6) AS seed_fit_sd FROM f GROUP BY event_type")
def fit_variability(spark, sf):
    return rounded(S.fit_variability(_days(spark, sf), ["event_type"], "seed", "day", "y", log=False), 6)


@query("extinction_summary", "SELECT event_type, round(avg((value > 60)::INT), 6) AS fraction, count(*) AS n, median(day(ts)) FILTER (value > 60) AS median_time FROM events GROUP BY event_type")
def extinction_summary(spark, sf):
    df = table(spark, sf, "events").select("event_type", (F.col("value") > 60).alias("x"), F.dayofmonth("ts").cast("double").alias("d"))
    return S.extinction_summary(df, ["event_type"], "x", "d").withColumn("fraction", F.round("fraction", 6))


@query("fits_with_variability", "WITH " + _DAYS + """, c AS (SELECT event_type, day, avg(y) AS y FROM d GROUP BY ALL), f AS (SELECT event_type, regr_slope(y, day) AS b, regr_intercept(y, day) AS a, avg(y) AS m FROM c GROUP BY event_type),
  v AS (SELECT event_type, count(*) AS n_seed_fits, stddev_pop(b) AS sd FROM (SELECT event_type, seed, regr_slope(y, day) AS b FROM d GROUP BY ALL) GROUP BY event_type)
  SELECT event_type, round(any_value(b), 4) AS slope, count(*) AS n_timepoints, round(1 - sum(pow(y - (a + b * day), 2)) / sum(pow(y - m, 2)), 4) AS r_squared, round(any_value(a), 4) AS intercept, any_value(n_seed_fits) AS n_seed_fits, round(any_value(sd), 4) AS seed_fit_sd
  FROM c JOIN f USING (event_type) JOIN v USING (event_type) GROUP BY event_type""")
def fits_with_variability(spark, sf):
    return rounded(S.fits_with_variability(_days(spark, sf), ["event_type"], "seed", "day", "y", log=False), 4)


@query("case_spread", sql("mlong", "SELECT grp, metric, round(avg(value), 6) AS centre, round(avg(value) - stddev_samp(value), 6) AS lower, round(avg(value) + stddev_samp(value), 6) AS upper, count(value) AS n FROM mlong GROUP BY grp, metric"))
def case_spread(spark, sf):
    return rounded(S.case_summary(part_metrics_long(spark, sf), ["grp", "metric"]), 6)
