"""Components, densities, modes and their stability."""

import math

from pyspark.sql import functions as F

from simlens.catalog.base import PARAMS, mixed, params_long, parts, query, rounded, sql, table, targets
from simlens.operators import clean as C
from simlens.operators import modes as M
from simlens.session import literal_table


def _cloud(spark, sf):
    return parts(spark, sf).select("particle", "grp", F.col("quantity").alias("pc1"), (F.col("extendedprice") / 5000).alias("pc2"), "n_lines", "quantity", "extendedprice", "discount")


_C = "cl AS (SELECT particle, grp, quantity AS pc1, extendedprice / 5000 AS pc2, n_lines, quantity, extendedprice, discount FROM parts)"
_KDE = _C + """, s AS (SELECT count(*) AS n, min(pc1) - 1 AS x0, max(pc1) + 1 AS x1, min(pc2) - 0.5 AS y0, max(pc2) + 0.5 AS y1, covar_samp(pc1, pc1) * pow(count(*), -1 / 3.0::DOUBLE) AS a, covar_samp(pc1, pc2) * pow(count(*), -1 / 3.0::DOUBLE) AS b, covar_samp(pc2, pc2) * pow(count(*), -1 / 3.0::DOUBLE) AS d FROM cl),
  g AS (SELECT ix::INTEGER AS ix, iy::INTEGER AS iy, x0 + (x1 - x0) / 19 * ix AS x, y0 + (y1 - y0) / 19 * iy AS y, s.* FROM s, range(0, 20) i(ix), range(0, 20) j(iy)),
  k AS (SELECT ix, iy, any_value(x) AS x, any_value(y) AS y, sum(exp(-0.5 * ((x - pc1) * (x - pc1) * d - 2 * (x - pc1) * (y - pc2) * b + (y - pc2) * (y - pc2) * a) / (a * d - b * b))) / any_value(n * 2 * pi() * sqrt(a * d - b * b)) AS density FROM g, cl GROUP BY ix, iy)"""


def _density(spark, sf):
    return M.kde(_cloud(spark, sf), ["pc1", "pc2"], size=20, pad=(1.0, 0.5))


@query("density_grid", sql("parts", "WITH " + _KDE + " SELECT ix, iy, round(x, 5) AS x, round(y, 5) AS y, round(density, 7) AS density FROM k"))
def density_grid(spark, sf):
    return mixed(_density(spark, sf), 5, density=7)


_PEAKS = _KDE + """, f AS (SELECT a.ix, a.iy, a.x, a.y, a.density, max(b.density) AS m FROM k a JOIN k b ON abs(a.ix - b.ix) <= 2 AND abs(a.iy - b.iy) <= 2 GROUP BY ALL),
  p AS (SELECT row_number() OVER (ORDER BY iy, ix) AS peak, x, y, density FROM f WHERE density = m AND density > 0.05 * (SELECT max(density) FROM k))"""


@query("density_peaks", sql("parts", "WITH " + _PEAKS + " SELECT peak, round(x, 5) AS x, round(y, 5) AS y, round(density, 7) AS density FROM p"))
def density_peaks(spark, sf):
    return mixed(M.find_peaks(_density(spark, sf), threshold=0.05), 5, density=7)


@query("ordered_modes", sql("parts", "WITH " + _PEAKS + " SELECT peak, row_number() OVER (ORDER BY density DESC, peak) AS mode FROM p"))
def ordered_modes(spark, sf):
    return M.ordered_modes(M.find_peaks(_density(spark, sf), threshold=0.05)).select("peak", "mode")


_CENTRES = [(1, 24.0, 10.0), (2, 26.0, 10.5), (3, 25.0, 11.5)]
_CEN = "ce(peak, x, y) AS (VALUES (1, 24.0::DOUBLE, 10.0::DOUBLE), (2, 26.0::DOUBLE, 10.5::DOUBLE), (3, 25.0::DOUBLE, 11.5::DOUBLE))"
_ASG = _C + ", " + _CEN + """, a AS (SELECT cl.*, peak, sqrt(pow(pc1 - x, 2) + pow(pc2 - y, 2)) AS distance FROM cl, ce QUALIFY row_number() OVER (PARTITION BY particle ORDER BY pow(pc1 - x, 2) + pow(pc2 - y, 2), peak) = 1)"""


def _centres(spark):
    return literal_table(spark, _CENTRES, "peak int, x double, y double")


def _assigned(spark, sf):
    return M.assign(_cloud(spark, sf), _centres(spark))


@query("nearest_centre", sql("parts", "WITH " + _ASG + " SELECT particle, peak, round(distance, 6) AS distance FROM a"))
def nearest_centre(spark, sf):
    return rounded(_assigned(spark, sf).select("particle", "peak", "distance"), 6)


@query("peak_members", sql("parts", "WITH " + _ASG + " SELECT peak, particle, row_number() OVER (PARTITION BY peak ORDER BY distance, particle) AS member FROM a QUALIFY member <= 50"))
def peak_members(spark, sf):
    return M.members(_assigned(spark, sf), "peak", ["distance", "particle"], 50).select("peak", "particle", "member")


@query("match_centres", sql("parts", "WITH " + _PEAKS + ", " + _CEN.replace("ce(", "rf(") + """, d AS (SELECT rf.peak AS reference, sqrt(pow(p.x - rf.x, 2) + pow(p.y - rf.y, 2)) AS d, p.peak FROM rf, p)
  SELECT reference, round(min(d), 5) AS distance, min(d) <= 1.0 AS recovered, CASE WHEN min(d) <= 1.0 THEN arg_min(peak, d) END AS peak FROM d GROUP BY reference"""))
def match_centres(spark, sf):
    return rounded(M.match_centres(M.find_peaks(_density(spark, sf), threshold=0.05), _centres(spark)).select("reference", "distance", "recovered", "peak"), 5)


@query("mode_target_errors", sql("parts targets", "WITH " + _ASG + """, m AS (SELECT peak, 'quantity' AS metric, median(quantity) AS v FROM a GROUP BY peak UNION ALL SELECT peak, 'extendedprice', median(extendedprice) FROM a GROUP BY peak)
  SELECT peak, metric, round(v, 6) AS median, target, round(abs(v - target) / target * 100, 5) AS error_pct FROM m JOIN targets USING (metric)"""))
def mode_target_errors(spark, sf):
    return mixed(M.mode_target_errors(_assigned(spark, sf), "peak", ["quantity", "extendedprice"], targets(spark)), 6, error_pct=5)


@query("peak_changes", sql("parts", "WITH " + _ASG + """, n AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY peak ORDER BY distance, particle) <= 50)
  SELECT peak, 'quantity' AS parameter, round(median((quantity - m) / m * 100), 5) AS median_change_pct FROM n, (SELECT avg(quantity) AS m FROM parts) GROUP BY peak"""))
def peak_changes(spark, sf):
    return rounded(M.peak_changes(_assigned(spark, sf), "peak", "distance", "particle", ["quantity"], parts(spark, sf)), 5)


@query("largest_mode", sql("parts", "WITH " + _ASG + """, s AS (SELECT peak, count(*) AS members, sum(n_lines) AS mass, 4 - peak AS density FROM a GROUP BY peak)
  SELECT arg_max(peak, (members, -peak)) AS peak, max(members) AS members, arg_max(peak, (members, -peak)) = arg_max(peak, (mass, -peak)) AND arg_max(peak, (members, -peak)) = arg_max(peak, (density, -peak)) AS unanimous FROM s"""))
def largest_mode(spark, sf):
    peaks = _centres(spark).withColumn("density", F.lit(4.0) - F.col("peak"))
    return M.largest_mode(_assigned(spark, sf), peaks, [], "n_lines")


_KDE1 = """s AS (SELECT grp, count(*) AS n, sum(n_lines) AS w, min(quantity) AS lo, max(quantity) AS hi, var_samp(quantity) * pow(count(*), -0.4) AS v FROM parts GROUP BY grp),
  k AS (SELECT grp, ix::INTEGER AS ix, any_value(lo + (hi - lo) / 99 * ix) AS x, sum(exp(-0.5 * pow(lo + (hi - lo) / 99 * ix - quantity, 2) / v) / sqrt(2 * pi() * v)) / count(*) AS density FROM parts JOIN s USING (grp), range(0, 100) i(ix) GROUP BY grp, ix)"""


def _line(spark, sf):
    return M.kde(parts(spark, sf).withColumnRenamed("quantity", "value"), ["value"], ["grp"], size=100)


@query("density_line", sql("parts", "WITH " + _KDE1 + " SELECT grp, ix, round(x, 5) AS x, round(density, 7) AS density FROM k"))
def density_line(spark, sf):
    return mixed(_line(spark, sf), 5, density=7)


@query("metric_modes", sql("parts", "WITH " + _KDE1 + " SELECT k.grp, round(arg_max(x, density), 5) AS mode, round(any_value(d), 5) AS std FROM k JOIN (SELECT grp, stddev_pop(quantity) AS d FROM parts GROUP BY grp) t USING (grp) GROUP BY k.grp"))
def metric_modes(spark, sf):
    return rounded(M.metric_modes(parts(spark, sf).withColumnRenamed("quantity", "value"), ["grp"], size=100), 5)


@query("density_interval", sql("parts", "WITH " + _KDE1 + """, c AS (SELECT *, sum(density) OVER (PARTITION BY grp ORDER BY density DESC, ix) / sum(density) OVER (PARTITION BY grp) AS cum FROM k), t AS (SELECT grp, max(density) FILTER (cum >= 0.95) AS t FROM c GROUP BY grp)
  SELECT grp, round(min(x) FILTER (density >= t), 5) AS lo, round(max(x) FILTER (density >= t), 5) AS hi, round(arg_max(x, density), 5) AS mode FROM c JOIN t USING (grp) GROUP BY grp"""))
def density_interval(spark, sf):
    return rounded(M.density_interval(_line(spark, sf), ["grp"]), 5)


@query("weighted_density_line", sql("parts", """WITH s AS (SELECT sum(n_lines) AS w, sum(n_lines * n_lines) AS w2, sum(n_lines * quantity) / sum(n_lines) AS m, min(quantity) AS lo, max(quantity) AS hi FROM parts),
  v AS (SELECT any_value(w) AS w, any_value(lo) AS lo, any_value(hi) AS hi, sum(n_lines * pow(quantity - m, 2)) / any_value(w) / (1 - any_value(w2) / pow(any_value(w), 2)) * pow(pow(any_value(w), 2) / any_value(w2), -0.4) AS v FROM parts, s)
  SELECT ix::INTEGER AS ix, round(any_value(lo + (hi - lo) / 49 * ix), 5) AS x, round(sum(n_lines * exp(-0.5 * pow(lo + (hi - lo) / 49 * ix - quantity, 2) / v) / sqrt(2 * pi() * v)) / any_value(w), 6) AS density FROM parts, v, range(0, 50) i(ix) GROUP BY ix"""))
def weighted_density_line(spark, sf):
    return mixed(M.kde(parts(spark, sf), ["quantity"], size=50, weight="n_lines"), 5, density=6)


@query("histogram_modes", sql("plong", """WITH s AS (SELECT parameter, min(value) AS lo, max(value) AS hi FROM plong GROUP BY parameter), b AS (SELECT parameter, least(floor((value - lo) / (hi - lo) * 30), 29) AS b, count(*) AS c FROM plong JOIN s USING (parameter) GROUP BY ALL)
  SELECT parameter, round(lo + (hi - lo) / 30 * (b + 0.5), 5) AS mode, round(lo + (hi - lo) / 30 * b, 5) AS bin_lo, round(lo + (hi - lo) / 30 * (b + 1), 5) AS bin_hi, c AS count FROM b JOIN s USING (parameter) QUALIFY row_number() OVER (PARTITION BY parameter ORDER BY c DESC, b) = 1"""))
def histogram_modes(spark, sf):
    return rounded(M.histogram_modes(params_long(spark, sf), ["parameter"]), 5)


@query("shared_histograms", sql("plong", """WITH s AS (SELECT parameter, min(value) AS lo, max(value) AS hi FROM plong GROUP BY parameter)
  SELECT parameter, grp, least(floor((value - lo) / (hi - lo) * 20), 19)::INTEGER AS bin, count(*) AS count FROM plong JOIN s USING (parameter) GROUP BY ALL"""))
def shared_histograms(spark, sf):
    long = params_long(spark, sf)
    span = long.groupBy("parameter").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return M.histogram(long, span, ["parameter"], bins=20, extra=["grp"])


@query("weighted_histogram", sql("parts", "WITH s AS (SELECT min(tax) AS lo, max(tax) AS hi FROM parts) SELECT grp, least(floor((tax - lo) / (hi - lo) * 12), 11)::INTEGER AS bin, sum(n_lines)::BIGINT AS weight FROM parts, s GROUP BY ALL"))
def weighted_histogram(spark, sf):
    p = parts(spark, sf)
    span = p.agg(F.min("tax").alias("lo"), F.max("tax").alias("hi"))
    return M.histogram(p, span, [], "tax", 12, weight="n_lines", extra=["grp"])


@query("hexagonal_bins", sql("parts", """WITH p AS (SELECT quantity / 0.77 AS u, tax / 0.0021 AS v FROM parts), c AS (SELECT *, floor(u + 0.5) AS a, floor(v + 0.5) AS b, floor(u) + 0.5 AS c, floor(v) + 0.5 AS d FROM p),
  h AS (SELECT CASE WHEN pow(u - a, 2) + 3 * pow(v - b, 2) < pow(u - c, 2) + 3 * pow(v - d, 2) THEN a ELSE c END AS q, CASE WHEN pow(u - a, 2) + 3 * pow(v - b, 2) < pow(u - c, 2) + 3 * pow(v - d, 2) THEN b ELSE d END AS r FROM c)
  SELECT round(q * 0.77, 5) AS cx, round(r * 0.0021, 6) AS cy, count(*) AS count FROM h GROUP BY ALL"""))
def hexagonal_bins(spark, sf):
    return mixed(M.hexagonal_bins(parts(spark, sf), "quantity", "tax", 0.77, 0.0021), 5, cy=6)


@query("plain_components", sql("parts", """WITH s AS (SELECT avg(quantity) AS mx, avg(p_size) AS my, var_pop(quantity) AS a, covar_pop(quantity, p_size) AS b, var_pop(p_size) AS d FROM parts), e AS (SELECT *, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS l FROM s)
  SELECT particle, round(((quantity - mx) * b + (p_size - my) * (l - a)) / sqrt(b * b + (l - a) * (l - a)) * sign(CASE WHEN abs(b) > abs(l - a) THEN b ELSE l - a END), 5) AS pc1 FROM parts, e"""))
def plain_components(spark, sf):
    p = parts(spark, sf)
    cols = ["quantity", "p_size"]
    model = M.fit_pca(p, cols, components=1, standardise=False)
    return rounded(M.project(p, model, cols, components=1).select("particle", "pc1"), 5)


@query("component_round_trip", sql("parts", "SELECT particle, round(quantity, 8) AS quantity, round(tax, 8) AS tax FROM parts"))
def component_round_trip(spark, sf):
    p = parts(spark, sf)
    cols = ["quantity", "tax"]
    model = M.fit_pca(p, cols, ["grp"])
    points = M.project(p, model, cols, ["grp"]).select("particle", "grp", "pc1", "pc2")
    return mixed(M.invert(points, model, cols, ["grp"]).select("particle", "quantity", "tax"), 8)


@query("posterior_peaks")
def posterior_peaks(spark, sf):
    emb = table(spark, sf, "embeddings")
    dims = [f"d{i}" for i in range(1, 65)]
    df = emb.select("vec_id", *[F.element_at("embedding", i).cast("double").alias(d) for i, d in enumerate(dims, 1)])
    points, _, _ = M.posterior_peaks(df, dims)
    return points.select("vec_id", "peak")


@query("representatives")
def representatives(spark, sf):
    return M.representatives(parts(spark, sf), "particle", PARAMS)


_FACTORS = [0.1, 0.2, 0.4]


@query("leave_one_out", sql("parts", """WITH z AS (SELECT particle, quantity / stddev_samp(quantity) OVER () AS a, p_size / stddev_samp(p_size) OVER () AS b FROM parts), f(factor) AS (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.4::DOUBLE)),
  t AS (SELECT x.particle, factor, -0.5 * (pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) / (factor * factor) AS e FROM z x JOIN z y ON x.particle <> y.particle, f), m AS (SELECT particle, factor, max(e) AS m FROM t GROUP BY ALL),
  s AS (SELECT t.particle, t.factor, any_value(m) + ln(sum(exp(e - m))) AS l FROM t JOIN m USING (particle, factor) GROUP BY ALL)
  SELECT factor, round(avg(l - 2 * ln(factor) - ln(2 * pi()) - ln((SELECT count(*) FROM parts) - 1)), 6) AS score FROM s GROUP BY factor"""))
def leave_one_out(spark, sf):
    p = parts(spark, sf)
    sd = p.agg(F.stddev_samp("quantity").alias("s1"), F.stddev_samp("p_size").alias("s2"))
    z = p.join(F.broadcast(sd), F.lit(True)).select("particle", (F.col("quantity") / F.col("s1")).alias("z1"), (F.col("p_size") / F.col("s2")).alias("z2"))
    return rounded(M.leave_one_out(z, "particle", _FACTORS), 6)


@query("bandwidth_sweep")
def bandwidth_sweep(spark, sf):
    return M.bandwidth_sweep(_cloud(spark, sf), _centres(spark), [0.5, 1.0, 1.5], ["grp"])


@query("threshold_sweep", sql("parts", "WITH " + _PEAKS.replace("density > 0.05 * (SELECT max(density) FROM k)", "density > 0") + ", t(threshold) AS (VALUES (0.05::DOUBLE), (0.3::DOUBLE)), q AS (SELECT threshold, p.* FROM p, t WHERE density > threshold * (SELECT max(density) FROM p)), " + _CEN.replace("ce(", "rf(") + """,
  r AS (SELECT threshold, rf.peak, min(sqrt(pow(q.x - rf.x, 2) + pow(q.y - rf.y, 2))) AS d FROM q, rf GROUP BY ALL)
  SELECT threshold, modes, round(ratio, 6) AS density_ratio, recovered FROM (SELECT threshold, count(*) AS modes, min(density) / max(density) AS ratio FROM q GROUP BY threshold) JOIN (SELECT threshold, count_if(d <= 1)::BIGINT AS recovered FROM r GROUP BY threshold) USING (threshold)"""))
def threshold_sweep(spark, sf):
    return rounded(M.threshold_sweep(_density(spark, sf), _centres(spark), [0.05, 0.3]), 6)


@query("bootstrap_peaks")
def bootstrap_peaks(spark, sf):
    return M.bootstrap_peaks(_cloud(spark, sf), "particle", _centres(spark), 200, 11, 2000, weight="n_lines", size=50)


@query("group_permutations", sql("parts", "SELECT permutation, grp, count(*) AS n FROM parts, range(0, 4) t(permutation) GROUP BY ALL"))
def group_permutations(spark, sf):
    return M.group_permutations(parts(spark, sf), "particle", "grp", 3, 5).groupBy("permutation", "grp").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("permutation", F.col("permutation").cast("bigint"))


_PROF = """l AS (SELECT particle, grp, 0 AS permutation FROM parts UNION ALL SELECT particle, p_brand, 1 FROM parts JOIN part ON p_partkey = particle), x AS (SELECT permutation, l.grp, parameter, abs(corr(value, quantity)) AS s FROM l JOIN (SELECT particle, 'tax' AS parameter, tax AS value, quantity FROM parts UNION ALL SELECT particle, 'p_size', p_size, quantity FROM parts) USING (particle) GROUP BY ALL)"""


@query("profile_statistics", sql("parts", "WITH " + _PROF + """, d AS (SELECT a.permutation, a.grp AS g, b.grp AS h, sqrt(sum(pow(a.s - b.s, 2))) AS d FROM x a JOIN x b ON a.permutation = b.permutation AND a.parameter = b.parameter AND a.grp < b.grp GROUP BY ALL),
  e AS (SELECT permutation, count_if(k = 1)::BIGINT AS exclusive FROM (SELECT permutation, parameter, count_if(s > 0.04) AS k FROM x GROUP BY ALL) GROUP BY permutation), p AS (SELECT permutation, avg(m) AS m FROM (SELECT permutation, grp, max(s) AS m FROM x GROUP BY ALL) GROUP BY permutation)
  SELECT permutation, round(avg(d), 6) AS spread, any_value(exclusive) AS exclusive, round(any_value(m), 6) AS peakedness FROM d JOIN e USING (permutation) JOIN p USING (permutation) GROUP BY permutation"""))
def profile_statistics(spark, sf):
    from simlens.operators.dependence import cross_correlation
    p = parts(spark, sf)
    brand = table(spark, sf, "part").select(F.col("p_partkey").alias("particle"), F.col("p_brand").alias("grp"))
    both = p.withColumn("permutation", F.lit(0)).unionByName(p.drop("grp").join(brand, "particle").withColumn("permutation", F.lit(1)))
    prof = cross_correlation(both, ["tax", "p_size"], ["quantity"], ["permutation", "grp"]).select("permutation", "grp", "parameter", F.abs("r").alias("strength"))
    return rounded(M.profile_statistics(prof, ["permutation"], "grp", 0.04), 6)
