"""Forests, designs, kernels and sequential inference."""

import uuid

from pyspark.sql import functions as F

from simlens.catalog.base import RANGES, mixed, parts, query, rounded, sql, table
from simlens.functions import exprs as X
from simlens.operators import forest as Fo
from simlens.operators import sampling as S
from simlens.operators import weights as Wt
from simlens.plans import smc
from simlens.session import checkpoint_root, cut, literal_table

_ST = ["quantity", "discount", "tax"]
_OBS = [(25.5, 0.051, 0.041)]


def _observed(spark):
    return literal_table(spark, _OBS, "quantity double, discount double, tax double")


_SPLIT = """WITH s AS (SELECT particle, 1 AS tree, 0 AS node, 0 AS stat, quantity AS cut_value, p_size, extendedprice / 1000 AS price FROM parts UNION ALL SELECT particle, 1, 0, 1, discount, p_size, extendedprice / 1000 FROM parts UNION ALL SELECT particle, 1, 0, 2, tax, p_size, extendedprice / 1000 FROM parts),
  c AS (SELECT stat, cut_value, count(*) AS c, sum(p_size) AS a, sum(price) AS b FROM s GROUP BY ALL), r AS (SELECT stat, cut_value, sum(c) OVER w AS l, sum(a) OVER w AS la, sum(b) OVER w AS lb, sum(c) OVER (PARTITION BY stat) AS n, sum(a) OVER (PARTITION BY stat) AS ta, sum(b) OVER (PARTITION BY stat) AS tb FROM c WINDOW w AS (PARTITION BY stat ORDER BY cut_value)),
  q AS (SELECT stat, cut_value, l * (n - l) / (n * n) * (pow((ta - la) / (n - l) - la / l, 2) + pow((tb - lb) / (n - l) - lb / l, 2)) AS score FROM r WHERE l >= 5 AND n - l >= 5)
  SELECT 1 AS tree, 0 AS node, stat, round(cut_value, 8) AS cut_value, round(score, 6) AS score FROM q ORDER BY q.score DESC LIMIT 1"""


def _first_split(spark, sf, **options):
    p = parts(spark, sf).withColumn("price", F.col("extendedprice") / 1000)
    rows = p.select("p_size", "price", *_ST).withColumns({"tree": F.lit(1), "node": F.lit(0), "role": F.lit(0), "copies": F.lit(1)})
    return mixed(Fo.best_splits(rows, [], _ST, ["p_size", "price"], 5, **options), 6, cut_value=8)


@query("first_split", sql("parts", _SPLIT))
def first_split(spark, sf):
    return _first_split(spark, sf)


@query("first_split_large_groups", sql("parts", _SPLIT))
def first_split_large_groups(spark, sf):
    return _first_split(spark, sf, bound=0)


@query("forest_weights")
def forest_weights(spark, sf):
    w = Fo.forest_weights(cut(parts(spark, sf)), _observed(spark), "particle", ["p_size", "extendedprice"], _ST)
    return w


@query("forest_weights_cosine")
def forest_weights_cosine(spark, sf):
    w = Fo.forest_weights(cut(parts(spark, sf)), _observed(spark), "particle", ["p_size", "p_retailprice"], _ST, criterion="mmd")
    return w


@query("univariate_forest_weights")
def univariate_forest_weights(spark, sf):
    w = Fo.univariate_weights(cut(parts(spark, sf)), _observed(spark), "particle", ["p_size", "p_retailprice"], _ST)
    return w


@query("split_frequency")
def split_frequency(spark, sf):
    nodes, _ = Fo.grow(cut(parts(spark, sf)), _observed(spark), "particle", ["p_size", "extendedprice"], _ST, full=True, with_members=False)
    return Fo.split_frequency(nodes, _ST)


@query("refit_grid")
def refit_grid(spark, sf):
    return Fo.refit_grid(cut(parts(spark, sf)), _observed(spark), "particle", ["p_size", "extendedprice"], _ST, [5, 20], [5, 20], [1, 2])


# lines play stored refits: line number = trees, supplier parity = leaf size, quantity = effective size
@query("refit_summary", """WITH g AS (SELECT l_linenumber AS n_trees, l_suppkey % 2 AS leaf, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, avg(l_tax) AS support FROM lineitem GROUP BY ALL), t AS (SELECT avg(o_orderkey % 60) AS e FROM orders)
  SELECT n_trees, leaf, round(m, 6) AS ess_mean, round(s, 6) AS ess_sd, round(support, 6) AS support, round(e, 6) AS stored_ess, abs(e - m) <= 2 * s AS inside FROM g, t""")
def refit_summary(spark, sf):
    grid = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("n_trees"), (F.col("l_suppkey") % 2).alias("leaf"), F.col("l_quantity").alias("ess"), F.col("l_tax").alias("support"))
    stored = table(spark, sf, "orders").agg(F.avg(F.col("o_orderkey") % 60).alias("ess"))
    return rounded(Fo.refit_summary(grid, stored), 6)


# lines play leaf members: line number = tree, supplier = leaf, order = particle with its price as weight
@query("leaf_average_weights", """SELECT l_linenumber AS tree, l_suppkey AS node, round(avg(o_totalprice), 4) AS mean_weight, count(*) AS members
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def leaf_average_weights(spark, sf):
    members = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("tree"), F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("particle"), F.lit(1).alias("role"))
    weights = table(spark, sf, "orders").select(F.col("o_orderkey").alias("particle"), F.col("o_totalprice").alias("weight"))
    return rounded(Fo.leaf_average_weights(members, weights, "particle"), 4)


# Direction numbers of the first three dimensions, from their recurrences, with 30 bits.
_VALUES = """RECURSIVE m(b, x, y, z) AS (SELECT 0, 1::BIGINT, 1::BIGINT, 3::BIGINT UNION ALL SELECT b + 1, xor(2 * x, x), z, xor(xor(2 * z, 4 * y), y) FROM m WHERE b < 29),
  v(d, b, v) AS (SELECT 0, b, 1::BIGINT << (29 - b) FROM m UNION ALL SELECT 1, b, x << (29 - b) FROM m UNION ALL SELECT 2, b, y << (29 - b) FROM m)"""


@query("sobol_points", f"""WITH {_VALUES}, g AS (SELECT p_partkey AS i, xor(p_partkey, p_partkey >> 1) AS g FROM part), w AS (SELECT i, d, coalesce(bit_xor(v) FILTER ((g >> b) & 1 = 1), 0) / 1073741824.0::DOUBLE AS x FROM g, v GROUP BY i, d)
  SELECT i AS p_partkey, max(x) FILTER (d = 0) AS a, max(x) FILTER (d = 1) AS b, max(x) FILTER (d = 2) AS c FROM w GROUP BY i""")
def sobol_points(spark, sf):
    return S.sobol(table(spark, sf, "part").select("p_partkey"), "p_partkey", ["a", "b", "c"])


@query("spec_samples", f"""WITH {_VALUES}, g AS (SELECT p_partkey AS i, xor(p_partkey, p_partkey >> 1) AS g FROM part), w AS (SELECT i, d, coalesce(bit_xor(v) FILTER ((g >> b) & 1 = 1), 0) / 1073741824.0::DOUBLE AS x FROM g, v GROUP BY i, d),
  p AS (SELECT i, max(x) FILTER (d = 0) AS a, max(x) FILTER (d = 1) AS b FROM w GROUP BY i) SELECT i AS p_partkey, round(2 + 5 * a, 6) AS a, (['x', 'y', 'z'])[least(floor(b * 3), 2)::INTEGER + 1] AS b FROM p""")
def spec_samples(spark, sf):
    points = S.sobol(table(spark, sf, "part").select("p_partkey"), "p_partkey", ["a", "b"])
    return rounded(S.from_specs(points, {"a": (2.0, 7.0), "b": ["x", "y", "z"]}), 6)


@query("source_density", "SELECT p_partkey, round(floor(57.0::DOUBLE / (p_size % 9 + 1)) * floor(38.0::DOUBLE / (p_size % 7 + 1)) / (29 * 30.0::DOUBLE * 38 * 30 * 1e-6), 5) AS density FROM part")
def source_density(spark, sf):
    return rounded(table(spark, sf, "part").select("p_partkey", S.source_density(F.col("p_size") % 9 + 1, F.col("p_size") % 7 + 1, 10, 30.0).alias("density")), 5)


@query("spacing_for_density", """WITH k AS (SELECT p_partkey, s::INTEGER AS s, abs(floor(57.0::DOUBLE / s) * floor(38.0::DOUBLE / s) / (29 * 30.0::DOUBLE * 38 * 30 * 1e-6) - p_retailprice / 10) AS d FROM part, range(1, 39) t(s))
  SELECT p_partkey, s AS length_spacing, s AS width_spacing FROM k QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY d, s) = 1""")
def spacing_for_density(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 10).alias("density"))
    return S.spacing_for_density(df, "density", 10, 30.0).select("p_partkey", "length_spacing", "width_spacing")


@query("hex_coordinates", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 58 AS x, l_suppkey % 39 AS y FROM lineitem), q AS (SELECT *, round_even((x + 2) / 3.0::DOUBLE - 10, 0)::INTEGER AS u, y - 18 AS vw FROM p), r AS (SELECT *, floor(-(vw + u) / 2.0::DOUBLE)::INTEGER AS v FROM q)
  SELECT l_orderkey, l_linenumber, u, v, -(u + v) AS w FROM r WHERE abs(v) <= 10 AND abs(u + v) <= 10""")
def hex_coordinates(spark, sf):
    h = S.to_hex(F.col("l_partkey") % 58, F.col("l_suppkey") % 39, F.lit(0), 10)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", h.alias("h")).where("h IS NOT NULL").select("l_orderkey", "l_linenumber", "h.u", "h.v", "h.w")


@query("parameter_error", sql("parts", "SELECT grp, round((abs(sum(n_lines * quantity) / sum(n_lines) - 25) / 10 + abs(sum(n_lines * tax) / sum(n_lines) - 0.04) / 0.0199987655) / 2, 7) AS parameter_error FROM parts GROUP BY grp"))
def parameter_error(spark, sf):
    return rounded(S.parameter_error(parts(spark, sf), {"quantity": 25.0, "tax": 0.04}, RANGES, "n_lines", ["grp"]), 7)


@query("predictive_error")
def predictive_error(spark, sf):
    p = parts(spark, sf).withColumn("weight", F.col("n_lines").cast("double"))
    return S.predictive_error(p, {"quantity": 25.0, "tax": 0.04}, 500, 3, "particle", keys=["grp"])


@query("perturbed_particles", sql("parts", "SELECT grp, count(*) AS n, true AS ordered, true AS moved FROM parts GROUP BY grp"))
def perturbed_particles(spark, sf):
    p = parts(spark, sf).withColumn("a", F.col("p_size").cast("int")).withColumn("b", F.col("p_size").cast("int") + 2).withColumn("q0", F.col("quantity"))
    out = S.perturb(p, {"quantity": (20.0, 30.0)}, 0.1, 5, ["particle"], ["a", "b"])
    return out.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("a") <= F.col("b")).alias("ordered"), F.bool_and(F.col("quantity") != F.col("q0")).alias("moved"))


@query("perturbed_rates", sql("parts", "SELECT count(*) AS n, true AS inside FROM parts"))
def perturbed_rates(spark, sf):
    p = parts(spark, sf).select("particle", (F.col("quantity") / 10).alias("r"), (F.col("discount") * 10).alias("a"), (F.col("tax") * 10).alias("b"))
    out = S.perturb_rates(p, {"r": (0.1, 10.0)}, {"a": (0.0, 1.0), "b": (0.0, 1.0)}, 1, 4, ["particle"])
    return out.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("a") + F.col("b") <= 1) & F.col("r").between(0.1, 10)).alias("inside"))


@query("density_samples")
def density_samples(spark, sf):
    return S.from_densities(parts(spark, sf), ["quantity", "tax"], 1000, 9, "particle")


_IW = """WITH prev AS (SELECT * FROM parts WHERE grp < 'M'), cur AS (SELECT * FROM parts WHERE grp >= 'M'), t AS (SELECT sum(n_lines) AS t FROM prev),
  k AS (SELECT c.particle, ln(p.n_lines / t) - 0.5 * (pow((c.quantity - p.quantity) / 1.0, 2) + pow((c.tax - p.tax) / 0.002, 2)) - ln(1.0 * sqrt(2 * pi())) - ln(0.002 * sqrt(2 * pi())) - ln(9) AS e FROM cur c JOIN prev p ON abs(c.p_size - p.p_size) <= 4, t),
  m AS (SELECT particle, max(e) AS m FROM k GROUP BY particle), l AS (SELECT k.particle, any_value(m) + ln(sum(exp(e - m))) AS l FROM k JOIN m USING (particle) GROUP BY k.particle)
  SELECT particle, round(l, 6) AS log_denominator FROM l"""


@query("importance_weights", sql("parts", _IW))
def importance_weights(spark, sf):
    p = cut(parts(spark, sf)).withColumn("weight", F.col("n_lines").cast("double"))
    prev, cur = p.where("grp < 'M'"), p.where("grp >= 'M'")
    out = smc.importance_weights(cur, prev, {"quantity": (20.0, 30.0), "tax": (0.03, 0.05)}, 0.1, spacings=["p_size"])
    return rounded(out.select("particle", "log_denominator"), 6)


@query("sequential_inference")
def sequential_inference(spark, sf):
    """Particles are parts; the statistic of a draw comes from the observed regression of quantity on tax."""
    fit = parts(spark, sf).agg(F.regr_slope("quantity", "tax").alias("b"), F.regr_intercept("quantity", "tax").alias("a"), F.count(F.lit(1)).alias("n"))
    fit = cut(fit)
    n = fit.first()["n"]

    def simulate(df, seed):
        return df.join(F.broadcast(fit), F.lit(True)).select("particle", (F.col("a") + F.col("b") * F.col("x") + X.normal(seed, F.lit("y"), "particle") * 0.01).alias("y"))
    run = smc.Smc(
        parameters=["x"], targets={"y": 25.5},
        sampler=lambda s, k, seed: S.sobol_design(s, k, {"x": (0.0, 0.1)}, seed),
        simulate=simulate, density=lambda: X.uniform_density({"x": (0.0, 0.1)}),
        kernel=lambda df, t, seed: S.perturb(df, {"x": (0.0, 0.1)}, S.kernel_width(t, 2), seed, ["draw"]),
        root=f"{checkpoint_root(spark).rstrip('/')}/smc-{uuid.uuid4().hex}", n=int(n), generations=2)
    out = smc.run_smc(spark, run)
    return out["particles"].join(out["weights"].select("particle", "weight"), "particle").join(out["lineage"], "particle")
