"""Importance and sensitivity through MLlib models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from simlens.functions import exprs as X
from simlens.operators.binned import grow
from simlens.operators.clean import drop_invalid_rows
from simlens.operators.ordered import attach
from simlens.operators.sampling import sobol
from simlens.session import literal_table, settled


def forest_importance(df: DataFrame, parameters: Sequence[str], metric: str, trees: int = 100, seed: int = 42, depth: int = 30):
    """(importance table, fitted model) of a regression forest for one metric over parameters in 32 bins.

    Trees are grown in tasks of their own from sums per cell of bins; where the cells are too many for that, MLlib grows
    the forest level by level over all rows.
    """
    data = settled(drop_invalid_rows(df, [*parameters, metric]).select(*parameters, metric))
    model = grow(data, parameters, metric, trees, seed, depth)
    if model is not None:
        scores = model.importances()
    else:
        rows = VectorAssembler(inputCols=list(parameters), outputCol="features").transform(data)
        model = RandomForestRegressor(featuresCol="features", labelCol=metric, numTrees=trees, seed=seed, maxDepth=depth).fit(rows)
        scores = model.featureImportances.toArray()
    table = literal_table(df.sparkSession, [(metric, p, float(s)) for p, s in zip(parameters, scores)], "metric string, parameter string, importance double")
    return table, model


def forest_fit(df: DataFrame, model, parameters: Sequence[str], metric: str) -> DataFrame:
    """R² and RMSE of a fitted model."""
    rows = model.transform(VectorAssembler(inputCols=list(parameters), outputCol="features").transform(drop_invalid_rows(df, [*parameters, metric])))
    e = F.col(metric) - F.col("prediction")
    return rows.agg(F.lit(metric).alias("metric"), (1 - F.try_divide(F.avg(e * e), F.var_pop(metric))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"))


def variance_sensitivity(df: DataFrame, model, parameters: Sequence[str], base: int = 2048, second_order: bool = False) -> DataFrame:
    """First-order, total and optionally pair indices of a model over the observed parameter box.

    Design rows are (base index, block): the two base matrices and their column swaps. One transform evaluates all rows,
    one grouping by base index brings the blocks of a row together, one aggregation gives every index.
    """
    spark, d = df.sparkSession, len(parameters)
    box = df.agg(*[f(p).alias(f"{p}__{n}") for p in parameters for n, f in (("lo", F.min), ("hi", F.max))]).first()
    names = [f"__a{i}" for i in range(d)] + [f"__b{i}" for i in range(d)]
    points = sobol(spark.range(1, base + 1).withColumnRenamed("id", "__i"), "__i", names)
    blocks = ["A", "B", *[f"AB{i}" for i in range(d)], *([f"BA{i}" for i in range(d)] if second_order else [])]
    rows = points.withColumn("block", F.explode(F.array(*[F.lit(b) for b in blocks])))
    for i, p in enumerate(parameters):
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        from_b = (F.col("block") == "B") | (F.col("block") == f"AB{i}") | (F.col("block").startswith("BA") & (F.col("block") != f"BA{i}"))
        rows = rows.withColumn(p, float(box[f"{p}__lo"]) + F.when(from_b, b).otherwise(a) * float(box[f"{p}__hi"] - box[f"{p}__lo"]))
    y = model.transform(VectorAssembler(inputCols=list(parameters), outputCol="features").transform(rows)).select("__i", "block", F.col("prediction").alias("y"))
    wide = y.groupBy("__i").agg(*[F.max(F.when(F.col("block") == b, F.col("y"))).alias(b) for b in blocks])
    # variance of both base blocks together: their own variances and the spread of their means
    var = (F.var_pop("A") + F.var_pop("B")) / 2 + F.pow((F.avg("A") - F.avg("B")) / 2, F.lit(2.0))
    one = [F.try_divide(F.avg(F.col("B") * (F.col(f"AB{i}") - F.col("A"))), var) for i in range(d)]
    total = [F.try_divide(F.avg(F.pow(F.col("A") - F.col(f"AB{i}"), F.lit(2.0))) / 2, var) for i in range(d)]
    cells = [F.struct(F.lit(p).alias("parameter"), F.lit(None).cast("string").alias("other"), one[i].alias("s1"), total[i].alias("st"), F.lit(None).cast("double").alias("s2")) for i, p in enumerate(parameters)]
    if second_order:
        for i in range(d):
            for j in range(i + 1, d):
                both = F.try_divide(F.avg(F.col(f"BA{i}") * F.col(f"AB{j}") - F.col("A") * F.col("B")), var)
                cells.append(F.struct(F.lit(parameters[i]).alias("parameter"), F.lit(parameters[j]).alias("other"), F.lit(None).cast("double").alias("s1"),
                                      F.lit(None).cast("double").alias("st"), (both - one[i] - one[j]).alias("s2")))
    return wide.agg(F.array(*cells).alias("__c")).select(F.explode("__c").alias("__c")).select("__c.*")


def sparse_scores(df: DataFrame, parameters: Sequence[str], metric: str, folds: int = 5, seed: int = 0,
                  shares: Sequence[float] = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0)) -> DataFrame:
    """|coefficient| of a cross-validated L1 regression of the standardised metric on standardised parameters.

    Strengths are shares of the largest absolute correlation, at which all coefficients vanish.
    """
    data = drop_invalid_rows(df, [*parameters, metric])
    spread = data.agg(F.avg(metric).alias("m"), F.stddev_samp(metric).alias("s"), *[F.corr(p, metric).alias(f"r{i}") for i, p in enumerate(parameters)]).first()
    known = [abs(spread[f"r{i}"]) for i in range(len(parameters)) if spread[f"r{i}"] is not None and spread[f"r{i}"] == spread[f"r{i}"]]
    if not known or not spread["s"] or max(known) == 0:
        return literal_table(df.sparkSession, [(metric, p, 0.0) for p in parameters], "metric string, parameter string, score double")
    strengths = [max(known) * share for share in shares]
    data = data.withColumn(metric, (F.col(metric) - float(spread["m"])) / float(spread["s"]))
    raw = VectorAssembler(inputCols=list(parameters), outputCol="raw").transform(data)
    rows = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw).transform(raw)
    lasso = LinearRegression(featuresCol="features", labelCol=metric, elasticNetParam=1.0, standardization=False)
    grid = ParamGridBuilder().addGrid(lasso.regParam, list(strengths)).build()
    cv = CrossValidator(estimator=lasso, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=metric), numFolds=folds, seed=seed)
    best = cv.fit(rows).bestModel
    return literal_table(df.sparkSession, [(metric, p, abs(float(c))) for p, c in zip(parameters, best.coefficients.toArray())], "metric string, parameter string, score double")


def method_shares(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, parameter, score): each metric's non-negative scores as shares of their sum, averaged over the metrics."""
    positive = scores.select(*keys, "metric", "parameter", F.greatest(F.coalesce(X.finite("score"), F.lit(0.0)), F.lit(0.0)).alias("score"))
    shared = attach(positive, [*keys, "metric"], __t=F.sum("score")).withColumn("score", F.col("score") / F.when(F.col("__t") > 0, F.col("__t")).otherwise(F.lit(1.0)))
    return shared.groupBy(*keys, "parameter").agg(F.avg("score").alias("score"))


def importance_selection(methods: dict[str, DataFrame], k: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, method, parameter, score, rank, kept): each method's mean shares, their composite, and the k best of each.

    ``methods`` maps a name to its scores (keys, metric, parameter, score). The composite averages the methods'
    scores after each is scaled to sum 1.
    """
    rows = None
    for name, scores in methods.items():
        one = method_shares(scores, keys).withColumn("method", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    unit = attach(rows, [*keys, "method"], __t=F.sum("score")).withColumn("__u", F.col("score") / F.when(F.col("__t") > 0, F.col("__t")).otherwise(F.lit(1.0)))
    both = unit.groupBy(*keys, "parameter").agg((F.sum("__u") / len(methods)).alias("score")).withColumn("method", F.lit("composite"))
    place = W.partitionBy(*keys, "method").orderBy(F.desc("score"), "parameter")           # a table of parameters, not rows
    ranked = rows.unionByName(both).withColumn("rank", F.row_number().over(place).cast("bigint"))
    return ranked.select(*keys, "method", "parameter", "score", "rank", (F.col("rank") <= k).alias("kept"))


def behaviour_clusters(df: DataFrame, ident: str, columns: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """k-means label of each complete row in standardised space; -1 for rows with a missing value."""
    raw = VectorAssembler(inputCols=list(columns), outputCol="raw").transform(drop_invalid_rows(df, columns))
    rows = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw).transform(raw)
    labels = KMeans(k=k, seed=seed).fit(rows).transform(rows).select(ident, F.col("prediction").alias("cluster"))
    return df.join(labels, ident, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
