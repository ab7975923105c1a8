"""Scans and sinks of run folders: ``<run>/iter_<g>/<file>``. Paths may live on any Hadoop file system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql import types as T

from simlens.functions import exprs as X
from simlens.operators.clean import drop_constant_columns, drop_invalid_rows, float_columns, melt, numeric_columns
from simlens.operators.ordered import keys_equal
from simlens.operators.weights import effective_size
from simlens.session import literal_table


def path_column() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "%20", " ")


def read_csv(spark: SparkSession, path, schema=None) -> DataFrame:
    reader = spark.read.option("header", True).option("nanValue", "nan").option("positiveInf", "inf").option("negativeInf", "-inf")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def generation_tables(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    """One scan of ``<root>/iter_*/<name>`` with ``gen`` from the path."""
    return read_csv(spark, f"{root.rstrip('/')}/iter_*/{name}", schema).withColumn("gen", F.regexp_extract(path_column(), r"iter_(\d+)", 1).cast("int"))


def run_tables(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    """Every run and generation present below a root, in one job."""
    df = read_csv(spark, f"{root.rstrip('/')}/*/iter_*/{name}", schema)
    return df.withColumns({"run": F.regexp_extract(path_column(), r"([^/]+)/iter_\d+/", 1), "gen": F.regexp_extract(path_column(), r"iter_(\d+)", 1).cast("int")})


def with_forest_settings(df: DataFrame, run: str = "run") -> DataFrame:
    """``..._t<trees>_l<leaf>`` in the run name as columns."""
    found = {n: F.regexp_extract(run, p, 1) for n, p in (("n_trees", r"_t(\d+)_l\d+"), ("leaf", r"_t\d+_l(\d+)"))}
    return df.withColumns({n: F.when(e != "", e.cast("int")) for n, e in found.items()})


def run_key(run) -> dict[str, Column]:
    """(series, threshold, peak) of ``...grid_<series>_<threshold>_p<peak>_mean_only``."""
    pattern = r"grid_(.+)_([^_]+)_p(\d+)_mean_only$"
    part = [F.regexp_extract(X.col(run), pattern, i) for i in (1, 2, 3)]
    return {n: F.when(part[2] != "", p) for n, p in zip(("series", "threshold", "peak"), (part[0], part[1], part[2].cast("int")))}


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Manifest (path, length) of files whose name matches a glob, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")


def digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) per file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return raw.select("path", F.sha2("content", 256).alias("sha256"))


def combined_digest(table: DataFrame, order: str = "path", levels: int | None = None) -> DataFrame:
    """One digest over all file digests: a tree over the hexadecimal digits of the names' digests.

    Leaves hold the files whose name digests share ``levels`` digits, in order of the names; every inner node
    digests its at most 16 children. By default the number of levels grows with the files, about 64 to a leaf.
    """
    if levels is None:
        levels, files_ = 0, table.count()
        while files_ > 64 * 16 ** levels:
            levels += 1
    node = table.select(F.substring(F.sha2(F.col(order).cast("binary"), 256), 1, levels).alias("b"), F.col(order).alias("o"), F.col("sha256").alias("d"))
    for level in range(levels, -1, -1):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda s: s["d"]), "\n")
        node = node.groupBy("b").agg(F.sha2(joined, 256).alias("d")).select(F.substring("b", 1, level - 1).alias("b") if level > 1 else F.lit("").alias("b"), F.col("b").alias("o"), "d")
    return node.select(F.col("d").alias("sha256"))


# --- small configuration tables ----------------------------------------------------------------------

def load_targets(spark: SparkSession, path: str) -> DataFrame:
    """JSON object {metric: value} as (metric, target)."""
    wide = spark.read.option("multiLine", True).json(path)
    return melt(wide, [], wide.columns, "metric", "target").where(F.col("target").isNotNull())


def save_targets(targets: DataFrame, path: str) -> None:
    targets.groupBy().pivot("metric").agg(F.max("target")).coalesce(1).write.mode("overwrite").json(path)


def save_ranges(long: DataFrame, path: str) -> None:
    parameter_ranges(long).write.mode("overwrite").option("header", True).csv(path)


def parameter_ranges(long: DataFrame) -> DataFrame:
    return long.groupBy("parameter").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def catalogue(spark: SparkSession, rows) -> DataFrame:
    """(bundle, method, threshold, peak, path) rows of known runs."""
    return literal_table(spark, rows, "bundle string, method string, threshold string, peak int, path string")


def select_runs(table: DataFrame, method: str | None = None, peak: int | None = None, bundle: str | None = None) -> DataFrame:
    for name, value in (("method", method), ("peak", peak), ("bundle", bundle)):
        if value is not None:
            table = table.where(F.col(name) == value)
    return table


def require_generations(present: DataFrame, n: int) -> DataFrame:
    """Generations of 0..n-1 that are absent."""
    spark = present.sparkSession
    return spark.range(n).select(F.col("id").cast("int").alias("gen")).join(present.select("gen").distinct(), "gen", "left_anti")


# --- parameters ---------------------------------------------------------------------------------------

def nested_parameters(spark: SparkSession, path, names: Sequence[str], population: str = "cancerous") -> DataFrame:
    """Named parameters of nested JSON files, sorted by folder number by the caller.

    A name is looked up as is and under the three process prefixes; a prefix in the wanted name is dropped from the column.
    """
    schema = T.StructType([T.StructField("populations", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    values = F.col("populations")[population]
    out = raw.withColumn("__v", values).withColumn("input_folder", F.regexp_extract(path_column(), r"([^/]+)/[^/]+$", 1))
    cols = []
    for name in names:
        base = name.split("/")[-1]
        looked = [F.try_element_at("__v", F.lit(k)) for k in dict.fromkeys([name, f"metabolism/{base}", f"proliferation/{base}", f"signaling/{base}"])]
        cols.append(F.coalesce(*looked).alias(base))
    return out.select("input_folder", X.folder_number("input_folder").alias("particle"), *cols)


def join_source_parameters(parameters: DataFrame, log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parameter table with source columns of the parameter log, joined on the particle number; constants dropped."""
    keyed = log.select(X.embedded_number("file_name").cast("int").alias("particle"), *columns)
    return drop_constant_columns(parameters.join(keyed, "particle"), keep=["particle", "input_folder"])


def parse_spacings(df: DataFrame, columns: Sequence[str] = ("X_SPACING", "Y_SPACING")) -> DataFrame:
    return df.withColumns({c: X.spacing(c) for c in columns if c in df.columns})


def load_particles(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Particles with their number; missing columns and repeated ids fail."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    from simlens.operators.errors import require_unique
    return require_unique(df.withColumn("particle", X.folder_number("input_folder", strict=True)), ["particle"])


# --- metrics and posteriors -----------------------------------------------------------------------------

def discover_metrics(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if not c.endswith("_std")]


def load_posterior(parameters: DataFrame, metrics: DataFrame, targets: Sequence[str], drop: Sequence[str] = (), key: str = "input_folder") -> DataFrame:
    """Varying parameters beside the target metrics, inner-joined on the key, rows with a non-finite metric left out."""
    p = drop_constant_columns(parameters, keep=[key]).drop(*drop)
    return drop_invalid_rows(p.join(metrics.select(key, *targets), key), targets)


def write_metrics(df: DataFrame, path: str, last: Sequence[str] = ("input_folder", "states")) -> None:
    """Metric table with sorted columns, the identifying ones last."""
    tail = [c for c in last if c in df.columns]
    df.select(*sorted(c for c in df.columns if c not in tail), *tail).write.mode("overwrite").parquet(path)


def write_samples(df: DataFrame, path: str, parameters: Sequence[str], metrics: Sequence[str]) -> None:
    write_csv(df.select(*parameters, *metrics, "distance", "accepted"), path)


def write_weights(particles: DataFrame, weights: DataFrame, root: str) -> None:
    """Weights and effective size, partitioned by run and generation; both tables must hold the same particles."""
    keys = ["run", "gen", "particle"]
    unmatched = particles.select(*keys).exceptAll(weights.select(*keys)).unionByName(weights.select(*keys).exceptAll(particles.select(*keys)))
    if not unmatched.isEmpty():
        raise ValueError("particles and weights do not match")
    weights.select(*keys, "weight").write.mode("overwrite").partitionBy("run", "gen").parquet(f"{root.rstrip('/')}/weights")
    effective_size(weights, ["run", "gen"]).write.mode("overwrite").partitionBy("run", "gen").parquet(f"{root.rstrip('/')}/ess")


def write_lineage(edges: DataFrame, path: str) -> None:
    """Lineage is written once: an existing table is left alone."""
    edges.write.mode("ignore").parquet(path)


def load_clouds(parts: dict[str, tuple[DataFrame, DataFrame]], ident: str) -> DataFrame:
    """Several clouds with their weights under a ``cloud`` column; every particle needs its weight."""
    out = None
    for name, (points, weights) in parts.items():
        joined = points.join(weights.select(ident, "weight"), ident, "left")
        checked = joined.withColumn("weight", F.coalesce("weight", F.raise_error(F.lit(f"{name}: particle without weight")).cast("double"))).withColumn("cloud", F.lit(name))
        out = checked if out is None else out.unionByName(checked)
    return out


# --- summaries stored as JSON -----------------------------------------------------------------------------

def cluster_profiles(spark: SparkSession, path: str, parameters: Sequence[str]) -> DataFrame:
    """Peak rows of a posterior summary: position and parameter profile as a map."""
    df = spark.read.option("multiLine", True).json(path).where(F.col("kind") == "pca_peak_inverse")
    profile = F.map_from_arrays(F.array(*[F.lit(p) for p in parameters]), F.array(*[F.col(p).cast("double") for p in parameters]))
    return df.select("cluster", "pc1", "pc2", profile.alias("profile"))


def representative_inputs(summary: DataFrame, expected: int = 4) -> DataFrame:
    """Cluster -> folder of its nearest sample (zero-based row + 1); another number of clusters fails."""
    rows = summary.where(F.col("cluster").isNotNull()).select("cluster", F.concat(F.lit("input_"), (F.col("nearest_sample_index") + 1).cast("string")).alias("input_folder"))
    count = rows.agg(F.count(F.lit(1)).alias("__n"))
    ok = F.when(F.col("__n") != expected, F.raise_error(F.lit(f"expected {expected} representatives")).cast("boolean")).otherwise(F.lit(True))
    return keys_equal(rows, count, []).where(ok).drop("__n")


def independent_in_all(tables: DataFrame) -> DataFrame:
    """Parameters listed as independent in every file; rows: (path, parameters array)."""
    n = tables.select("path").distinct().agg(F.count(F.lit(1)).alias("__files"))
    long = tables.select("path", F.explode("parameters").alias("parameter")).distinct()
    counted = long.groupBy("parameter").agg(F.count(F.lit(1)).alias("__n"))
    return keys_equal(counted, n, []).where(F.col("__n") == F.col("__files")).select("parameter")


def prediction_summary(models: DataFrame, roles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nested summary per key: categories, models and counts (a model per parameter at most)."""
    m = models.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col("step"), F.col("target").alias("target_parameter"), F.col("predictor").alias("predictor_parameter"),
        F.struct("slope", "intercept").alias("linear_model"), F.struct(F.col("r").alias("correlation_r"), F.col("r2").alias("r_squared")).alias("prediction_quality")))).alias("models"))
    names = {r: F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("parameter")))) for r in ("independent", "root", "derived")}
    c = roles.groupBy(*keys).agg(F.struct(*[e.alias(n) for n, e in names.items()]).alias("parameter_categorization"))
    return keys_equal(c, m, keys, "left").select(*keys, "parameter_categorization", F.struct("models").alias("prediction_models"))


def flatten_equations(summary: DataFrame, keys: Sequence[str], digits: int = 4) -> DataFrame:
    """Equation rows of nested summaries, rounded."""
    m = summary.select(*keys, F.explode("prediction_models.models").alias("m"))
    return m.select(*keys, "m.target_parameter", "m.predictor_parameter", F.bround("m.linear_model.slope", digits).alias("slope"),
                    F.bround("m.linear_model.intercept", digits).alias("intercept"), F.bround("m.prediction_quality.correlation_r", digits).alias("r"),
                    F.bround("m.prediction_quality.r_squared", digits).alias("r_squared"))


def latest_summaries(spark, root: str, schema, keys: Sequence[str], threshold: str | None = None) -> DataFrame:
    """Newest nested summary of each key below ``root``, from files ``<run folder>/.../*.json``.

    The newest is the file that was written last, the larger path on a tie. ``threshold`` keeps run folders with
    ``_linear_<threshold>_`` in their name. Adds ``summary_path``.
    """
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    rows = found.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_modification_time").alias("__time"))
    if threshold is not None:
        rows = rows.where(F.col("__path").contains(f"_linear_{threshold}_"))
    columns = [c for c in found.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns, F.col("__path").alias("summary_path")), F.struct("__time", "__path")).alias("__s"))
    return newest.select(*keys, "__s.*")


def strongest_models(summary: DataFrame, keys: Sequence[str], n: int | None = 3) -> DataFrame:
    """Equation rows of each summary in order of |r|, the first n of them; the target's name breaks ties."""
    rows = flatten_equations(summary, keys, 12)
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last(F.abs("r")), "target_parameter", "predictor_parameter")        # models of a summary: one per parameter
    ranked = rows.withColumn("place", F.row_number().over(w).cast("bigint"))
    return ranked if n is None else ranked.where(F.col("place") <= n)


def derived_names(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Model targets together with the listed derived parameters."""
    a = summary.select(*keys, F.explode("prediction_models.models.target_parameter").alias("parameter"))
    b = summary.select(*keys, F.explode("parameter_categorization.derived").alias("parameter"))
    return a.unionByName(b).distinct()


# --- trajectories ----------------------------------------------------------------------------------------

def trajectories(df: DataFrame) -> DataFrame:
    """Time and infected columns under either of their names."""
    time = [F.col(c) for c in ("time", "t") if c in df.columns]
    infected = [F.col(c) for c in ("infected", "I") if c in df.columns]
    rest = [c for c in df.columns if c not in ("time", "t", "infected", "I")]
    return df.select(*rest, F.coalesce(*time).cast("double").alias("time"), F.coalesce(*infected).cast("double").alias("infected"))


def sample_trajectories(df: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """All rows of n distinct trajectories chosen by hash order, without replacement."""
    ids = df.select(ident).distinct().withColumn("__u", X.uniform(seed, ident)).orderBy("__u", ident).limit(n).select(ident)
    return df.join(ids, ident, "left_semi")


def rounded_floats(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: X.finite_round(c, digits) for c in float_columns(df)})
