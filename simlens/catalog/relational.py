"""Joins, set operations, pivots and sources on the given tables."""

from pyspark.sql import functions as F

from simlens.catalog.base import lines, metrics_long, mixed, params_long, part_metrics_long, parts, query, rounded, sql, table, targets
from simlens.operators import clean as C
from simlens.operators import errors as E
from simlens.operators import ordered as O
from simlens.operators import weights as Wt
from simlens.sources import tables as S


@query("aligned_posterior", sql("", "SELECT c_custkey, c_acctbal, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'"))
def aligned_posterior(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit(1.0).alias("fixed"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).otherwise(F.lit(float("inf"))).alias("o_totalprice"))
    return S.load_posterior(c, o, ["o_totalprice"], key="c_custkey")


@query("selected_metrics", sql("", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY l_partkey"))
def selected_metrics(spark, sf):
    kept = table(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(kept, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("positional_zip", sql("", """WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) SELECT rn, s_suppkey, c_custkey FROM a JOIN b USING (rn)"""))
def positional_zip(spark, sf):
    a = O.running(table(spark, sf, "supplier").select("s_suppkey"), [], ["s_suppkey"])
    b = O.running(table(spark, sf, "customer").select("c_custkey"), [], ["c_custkey"])
    return a.join(b, "rn").select("rn", "s_suppkey", "c_custkey")


@query("best_fit_replicates", sql("parts", """WITH b AS (SELECT particle FROM parts ORDER BY abs(quantity - 27), particle LIMIT 1) SELECT b.particle, median(l_quantity) AS median, round(stddev_pop(l_quantity), 6) AS std, count(*) AS seeds FROM lineitem JOIN b ON l_partkey = b.particle GROUP BY b.particle"""))
def best_fit_replicates(spark, sf):
    best = parts(spark, sf).agg(F.min_by("particle", F.struct(F.abs(F.col("quantity") - 27), F.col("particle"))).alias("particle"))
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("particle"), "l_quantity").join(F.broadcast(best), "particle")   # one row
    med = O.medians(rows, ["particle"], "l_quantity", "median")
    return med.join(rows.groupBy("particle").agg(F.round(F.stddev_pop("l_quantity"), 6).alias("std"), F.count(F.lit(1)).alias("seeds")), "particle")


@query("key_difference", sql("", "SELECT 'left' AS side, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'right', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"))
def key_difference(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    count = lambda d, n: d.agg(F.count_distinct("k").alias("n")).select(F.lit(n).alias("side"), "n")
    return count(a.join(b, "k", "left_anti"), "left").unionByName(count(b.join(a, "k", "left_anti"), "right"))


@query("unparsable_skipped", sql("", "SELECT p_type, count(*) AS n, sum(p_size)::BIGINT AS total FROM part WHERE p_size % 3 <> 0 GROUP BY p_type"))
def unparsable_skipped(spark, sf):
    text = F.when(F.col("p_size") % 3 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string"))
    p = table(spark, sf, "part").select("p_type", text.try_cast("int").alias("size")).na.drop(subset=["size"])
    return p.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))


@query("unioned_generations", sql("", "SELECT 'customer' AS source, count(*) AS n, round(sum(c_acctbal), 2) AS total, 0 AS extra FROM customer UNION ALL SELECT 'supplier', count(*), round(sum(s_acctbal), 2), count(s_suppkey) FROM supplier"))
def unioned_generations(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("key"))
    return c.unionByName(s, allowMissingColumns=True).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("bal"), 2).alias("total"), F.count("key").alias("extra"))


@query("common_keys", sql("", "SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)"))
def common_keys(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey").intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))).agg(F.count(F.lit(1)).alias("n"))


@query("fixed_parameters", sql("", "SELECT p_brand AS parameter FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50)"))
def fixed_parameters(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("parameter")).distinct().join(p.where("p_size = 50").select(F.col("p_brand").alias("parameter")), "parameter", "left_anti")


@query("distinct_vectors", sql("", "SELECT l_linestatus AS run, count(DISTINCT (l_quantity, l_discount, l_tax)) AS vectors FROM lineitem GROUP BY 1"))
def distinct_vectors(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("run")).agg(F.count_distinct(F.struct("l_quantity", "l_discount", "l_tax")).alias("vectors"))


@query("measure_pivot", sql("li", "SELECT gen, round(avg(quantity) FILTER (run = 'F'), 5) AS F, round(avg(quantity) FILTER (run = 'O'), 5) AS O FROM li GROUP BY gen"))
def measure_pivot(spark, sf):
    return rounded(lines(spark, sf).groupBy("gen").pivot("run", ["F", "O"]).agg(F.avg("quantity")), 5)


@query("setting_averages", sql("li", "SELECT run, round(avg(quantity), 5) AS quantity, round(avg(tax), 6) AS tax FROM li GROUP BY run"))
def setting_averages(spark, sf):
    return mixed(Wt.average_over(lines(spark, sf), ["run"], ["quantity", "tax"]), 5, tax=6)


@query("parameter_ranges", sql("plong", "SELECT parameter, min(value) AS min_value, max(value) AS max_value FROM plong GROUP BY parameter"))
def parameter_ranges(spark, sf):
    return S.parameter_ranges(params_long(spark, sf))


@query("prior_posterior_table", sql("plong", """SELECT parameter, round(avg(value), 6) AS prior_mean, round(stddev_samp(value), 6) AS prior_std, round(avg(value) FILTER (grp = 'SMALL'), 6) AS posterior_mean, round(stddev_samp(value) FILTER (grp = 'SMALL'), 6) AS posterior_std,
  round(avg(value) FILTER (grp = 'SMALL') - avg(value), 6) AS delta_mean FROM plong GROUP BY parameter"""))
def prior_posterior_table(spark, sf):
    long = params_long(spark, sf)

    def side(df, n):
        return df.groupBy("parameter").agg(F.avg("value").alias(f"{n}_mean"), F.stddev_samp("value").alias(f"{n}_std"))
    j = side(long, "prior").join(side(long.where("grp = 'SMALL'"), "posterior"), "parameter")
    return rounded(j.withColumn("delta_mean", F.col("posterior_mean") - F.col("prior_mean")), 6)


@query("panel_summary", sql("", "SELECT trim(p_brand) AS panel, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS std, count(*) AS n FROM part GROUP BY 1"))
def panel_summary(spark, sf):
    p = table(spark, sf, "part").groupBy(F.trim("p_brand").alias("panel")).agg(F.avg("p_retailprice").alias("mean"), F.stddev_samp("p_retailprice").alias("std"), F.count(F.lit(1)).alias("n"))
    return rounded(p, 6)


@query("case_summary", sql("mlong", "SELECT grp, metric, count(value) AS n, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75 FROM mlong GROUP BY grp, metric"))
def case_summary(spark, sf):
    from simlens.operators.series import time_course
    return rounded(time_course(part_metrics_long(spark, sf), ["grp", "metric"]), 6).withColumnRenamed("n_seeds", "n")


@query("row_dispersion", sql("parts", """WITH r AS (SELECT min(quantity) AS a, max(quantity) AS b, min(tax) AS c, max(tax) AS d FROM parts), u AS (SELECT particle, (quantity - a) / (b - a) AS x, (tax - c) / (d - c) AS y FROM parts, r)
  SELECT particle, round(-(x / (x + y) * ln(x / (x + y) + 1e-10) + y / (x + y) * ln(y / (x + y) + 1e-10)), 5) AS entropy FROM u WHERE x + y > 0"""))
def row_dispersion(spark, sf):
    p = parts(spark, sf)
    span = p.agg(*[f(c).alias(f"{n}_{c}") for c in ("quantity", "tax") for n, f in (("lo", F.min), ("hi", F.max))])
    j = O.keys_equal(p, span, [])
    u = {c: (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) for c in ("quantity", "tax")}
    total = u["quantity"] + u["tax"]
    entropy = -sum(((x / total) * F.ln(x / total + 1e-10) for x in u.values()), F.lit(0.0))
    return j.where(total > 0).select("particle", F.round(entropy, 5).alias("entropy"))


@query("partial_dependence", "SELECT p_size % 4 AS first, p_size % 3 AS second, round(avg(p_retailprice), 6) AS metric FROM part GROUP BY ALL")
def partial_dependence(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_size") % 4).alias("first"), (F.col("p_size") % 3).alias("second"), "p_retailprice")
    varying = C.varying_columns(p, ["first", "second"])
    if len(varying) != 2:
        raise ValueError("exactly two parameters must vary")
    return p.groupBy("first", "second").agg(F.round(F.avg("p_retailprice"), 6).alias("metric"))


@query("run_health", sql("li parts", """WITH b AS (SELECT run, gen, count(*) AS particles, count_if(NOT quantity BETWEEN 5 AND 45)::BIGINT AS outside, pow(sum(extendedprice), 2) / sum(extendedprice * extendedprice) AS ess FROM li GROUP BY run, gen)
  SELECT run, gen, particles, outside, round(ess, 3) AS ess FROM b"""))
def run_health(spark, sf):
    li = lines(spark, sf)
    box = C.out_of_box(li, ["run", "gen"], {"quantity": (5.0, 45.0)}).drop("columns_checked")
    ess = Wt.effective_size(li, ["run", "gen"], "extendedprice").select("run", "gen", F.col("n_particles").alias("particles"), F.round("ess", 3).alias("ess"))
    return box.join(ess, ["run", "gen"])


@query("unique_keys", sql("", "SELECT count(*) AS n FROM part"))
def unique_keys(spark, sf):
    return E.require_unique(table(spark, sf, "part").select("p_partkey"), ["p_partkey"]).agg(F.count(F.lit(1)).alias("n"))


@query("sorted_by_number", sql("", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS place FROM part"))
def sorted_by_number(spark, sf):
    from simlens.functions.exprs import embedded_number
    named = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("input_"), F.col("p_partkey").cast("string")).alias("input_folder"))
    return O.running(named.withColumn("number", embedded_number("input_folder")), [], ["number"], "place").select("p_partkey", "place")


@query("combined_digest", sql("", """WITH f AS (SELECT doc_id::VARCHAR AS o, sha256(text) AS d FROM documents), l AS (SELECT substr(sha256(o), 1, 2) AS b, sha256(string_agg(d, chr(10) ORDER BY o)) AS d FROM f GROUP BY 1),
  i AS (SELECT substr(b, 1, 1) AS b, sha256(string_agg(d, chr(10) ORDER BY b)) AS d FROM l GROUP BY substr(b, 1, 1)) SELECT count(*) AS files, (SELECT sha256(string_agg(d, chr(10) ORDER BY b)) FROM i) AS sha256 FROM documents"""))
def combined_digest(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return S.combined_digest(d, levels=2).join(d.agg(F.count(F.lit(1)).alias("files")), F.lit(True)).select("files", "sha256")


@query("trajectory_sample", sql("", "SELECT 20 AS trajectories, true AS whole"))
def trajectory_sample(spark, sf):
    e = table(spark, sf, "events")
    kept = S.sample_trajectories(e, "user_id", 20, 7).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    whole = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("all"))
    return kept.join(whole, "user_id").agg(F.count(F.lit(1)).cast("int").alias("trajectories"), F.bool_and(F.col("n") == F.col("all")).alias("whole"))


@query("seed_subsets", sql("", """WITH s AS (SELECT l_orderkey AS folder, l_quantity AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem), k AS (SELECT folder FROM s GROUP BY folder HAVING count(*) = 4), t AS (SELECT s.* FROM s JOIN k USING (folder)),
  c AS (SELECT m FROM range(0, 16) r(m) WHERE bit_count(m) = 2), e AS (SELECT folder, m, median(value) AS est FROM t, c WHERE (m >> i) & 1 = 1 GROUP BY ALL), f AS (SELECT folder, median(value) AS ref FROM t GROUP BY folder), d AS (SELECT folder, abs(est - ref) AS a FROM e JOIN f USING (folder))
  SELECT folder, count(*) AS subsets, median(a) AS median_error, round(quantile_cont(a, 0.95), 6) AS q95_error FROM d GROUP BY folder"""))
def seed_subsets(spark, sf):
    from simlens.operators.subsets import subset_errors
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("folder"), F.col("l_quantity").alias("value"), F.struct(*order).alias("place"))
    return rounded(subset_errors(li, ["folder"], "place", "value", 4, 2, "median"), 6)
