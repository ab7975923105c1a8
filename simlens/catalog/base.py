"""Registry and the views that play the roles of particles, metrics, targets and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlens.operators.clean import melt
from simlens.session import literal_table

QUERIES: dict = {}
SQL: dict[str, str] = {}

TARGETS = {"discount": 0.04, "extendedprice": 51000.0, "quantity": 27.0}
WEIGHTS = {"discount": 1.0, "extendedprice": 2.0, "quantity": 1.0}
PARAMS = ["p_size", "p_retailprice", "quantity", "discount", "tax"]
RANGES = {"p_size": (1.0, 50.0), "p_retailprice": (900.0, 1000.0), "quantity": (20.0, 30.0),
          "discount": (0.04, 0.06), "tax": (0.0300012345, 0.05)}

_values = ", ".join(f"('{m}', {t}::DOUBLE, {WEIGHTS[m]}::DOUBLE)" for m, t in TARGETS.items())
_ranges = ", ".join(f"('{p}', {lo}::DOUBLE, {hi}::DOUBLE)" for p, (lo, hi) in RANGES.items())


def _union(source: str, keys: str, columns, name: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS {name}, {c}::DOUBLE AS value FROM {source}" for c in columns)


CTE = {
    "targets": f"targets(metric, target, weight) AS (VALUES {_values})",
    "ranges": f"ranges(parameter, lo, hi) AS (VALUES {_ranges})",
    "li": """li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS folder, l_linestatus AS run, year(l_shipdate)::INTEGER AS gen,
             l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax FROM lineitem)""",
    "long": "long AS (" + _union("li", "run, gen, folder", ["quantity", "extendedprice", "discount"], "metric") + ")",
    "parts": """parts AS (SELECT l_partkey AS particle, any_value(p_type) AS grp, any_value(p_size)::DOUBLE AS p_size, any_value(p_retailprice) AS p_retailprice,
             round(avg(l_quantity), 8) AS quantity, round(avg(l_discount), 8) AS discount, round(avg(l_tax), 8) AS tax, round(avg(l_extendedprice), 8) AS extendedprice,
             count(*) AS n_lines FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey)""",
    "plong": "plong AS (" + _union("parts", "particle, grp", PARAMS, "parameter") + ")",
    "mlong": "mlong AS (" + _union("parts", "particle, grp", ["quantity", "extendedprice", "discount"], "metric") + ")",
}
NEEDS = {"long": ["li"], "plong": ["parts"], "mlong": ["parts"]}


def sql(names: str, body: str) -> str:
    """SQL with the named view definitions in front."""
    order: list[str] = []
    for n in names.split():
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    body = body.strip()
    if not order:
        return body
    extra = body.startswith("WITH ")
    return "WITH " + ", ".join(CTE[x] for x in order) + (", " + body[5:] if extra else " " + body)


def query(name: str, check: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            SQL[name] = check
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    from simlens.operators.clean import float_columns
    return df.withColumns({c: F.round(c, digits) for c in float_columns(df)})


def mixed(df: DataFrame, digits: int, **special: int) -> DataFrame:
    from simlens.operators.clean import float_columns
    return df.withColumns({c: F.round(c, special.get(c, digits)) for c in float_columns(df)})


def targets(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(m, float(t), float(WEIGHTS[m])) for m, t in TARGETS.items()], "metric string, target double, weight double")


def ranges(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(p, float(a), float(b)) for p, (a, b) in RANGES.items()], "parameter string, lo double, hi double")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("folder"), F.col("l_linestatus").alias("run"),
        F.year("l_shipdate").alias("gen"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


def metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    return melt(lines(spark, sf), ["run", "gen", "folder"], ["quantity", "extendedprice", "discount"])


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per particle: five parameters and three metrics."""
    agg = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("particle")).agg(
        F.round(F.avg("l_quantity"), 8).alias("quantity"), F.round(F.avg("l_discount"), 8).alias("discount"),
        F.round(F.avg("l_tax"), 8).alias("tax"), F.round(F.avg("l_extendedprice"), 8).alias("extendedprice"), F.count(F.lit(1)).alias("n_lines"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("particle"), F.col("p_type").alias("grp"),
                                        F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return agg.join(p, "particle")


def params_long(spark: SparkSession, sf: str) -> DataFrame:
    return melt(parts(spark, sf), ["particle", "grp"], PARAMS, "parameter", "value")


def part_metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    return melt(parts(spark, sf), ["particle", "grp"], ["quantity", "extendedprice", "discount"])
