"""Sources and sinks: tables are written in the run layout below the shared folder, scanned back, and checked against the given tables."""

import json
import uuid

import pandas as pd
from pyspark.sql import functions as F

from simlens.catalog.base import lines, mixed, part_metrics_long, parts, query, rounded, sql, table, targets
from simlens.catalog.simulation import _cells
from simlens.plans import reduction
from simlens.session import checkpoint_root
from simlens.sources import snapshots
from simlens.sources import tables as S




def _root(spark, kind: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/runs/{kind}-{uuid.uuid4().hex}"


def _store_files(df, root: str, names: str, content) -> None:
    """One file for each value of the column ``names``, made by ``content`` from its rows."""
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs
        files, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        path = f"{base}/{pdf[names].iloc[0]}"
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(path) as out:
            out.write(content(pdf).encode())
        return pd.DataFrame({"path": [path], "rows": [len(pdf)]})
    df.groupBy(names).applyInPandas(write, "path string, rows long").count()


# --- snapshots: events play cells, line items play locations; 16 folders ------------------------------

_FOLDS = """cells AS (SELECT 'input_' || (user_id % 16) AS folder, (event_id % 4)::INTEGER AS seed, ((day(ts) - 1) // 10 * 14400)::INTEGER AS t_min, event_id, value AS volume, value / 2 AS age,
  CASE event_type WHEN 'view' THEN 'PROLIFERATIVE' WHEN 'click' THEN 'MIGRATORY' WHEN 'signup' THEN 'QUIESCENT' WHEN 'error' THEN 'NECROTIC' ELSE 'APOPTOTIC' END AS state,
  CASE WHEN event_id % 3 = 0 THEN [event_id % 100, event_id % 70] WHEN event_id % 3 = 1 THEN [event_id % 50] ELSE []::BIGINT[] END AS cycles FROM events WHERE day(ts) <= 30),
  locs AS (SELECT 'input_' || (l_suppkey % 16) AS folder, (l_partkey % 4)::INTEGER AS seed, (l_orderkey % 3 * 14400)::INTEGER AS t_min, (l_partkey % 11 - 5)::INTEGER AS x, (l_quantity::INTEGER % 11 - 5)::INTEGER AS y FROM lineitem)"""


def _cell_rows(spark, sf):
    c = _cells(spark, sf).where(F.col("t_min") <= 28800)
    return c.withColumn("folder", F.concat(F.lit("input_"), (F.col("folder") % 16).cast("string")))


def _location_rows(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("input_"), (F.col("l_suppkey") % 16).cast("string")).alias("folder"), (F.col("l_partkey") % 4).cast("int").alias("seed"),
        (F.col("l_orderkey") % 3 * 14400).cast("int").alias("t_min"), (F.col("l_partkey") % 11 - 5).cast("int").alias("x"), (F.col("l_quantity").cast("int") % 11 - 5).cast("int").alias("y"))


def _file_name(kind: str):
    return F.concat("folder", F.lit("/exp_run_"), F.lpad(F.col("seed").cast("string"), 4, "0"), F.lit("_"), F.lpad(F.col("t_min").cast("string"), 6, "0"), F.lit(f".{kind}.json"))


def _store_cells(spark, sf) -> str:
    root = _root(spark, "cells")
    _store_files(_cell_rows(spark, sf).withColumn("file", _file_name("CELLS")), root, "file", lambda pdf: json.dumps(
        [{"state": s, "volume": float(v), "age": float(a), "cycles": [int(x) for x in c]} for s, v, a, c in zip(pdf["state"], pdf["volume"], pdf["age"], pdf["cycles"])]))
    return root


def _store_locations(spark, sf, root: str) -> str:
    _store_files(_location_rows(spark, sf).withColumn("file", _file_name("LOCATIONS")), root, "file", lambda pdf: json.dumps(
        [{"coordinate": [int(x), int(y), int(-x - y), 0]} for x, y in zip(pdf["x"], pdf["y"])]))
    return root


@query("scanned_cells", "WITH " + _FOLDS + " SELECT 'exp' AS exp_group, folder, seed, t_min, state, round(volume, 6) AS volume, round(age, 6) AS age, len(cycles) AS cycles FROM cells")
def scanned_cells(spark, sf):
    found = snapshots.readable(snapshots.cells(spark, _store_cells(spark, sf)))
    return rounded(found.select("exp_group", "folder", "seed", "t_min", "state", "volume", "age", F.size("cycles").cast("bigint").alias("cycles")), 6)


@query("scanned_cells_at_time", "WITH " + _FOLDS + " SELECT folder, seed, count(*) AS n, round(sum(volume), 4) AS volume FROM cells WHERE t_min = 14400 GROUP BY ALL")
def scanned_cells_at_time(spark, sf):
    found = snapshots.readable(snapshots.cells(spark, _store_cells(spark, sf), 14400))
    return rounded(found.groupBy("folder", "seed").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")), 4)


@query("scanned_locations", "WITH " + _FOLDS + " SELECT folder, seed, t_min, x, y, count(*) AS n FROM locs GROUP BY ALL")
def scanned_locations(spark, sf):
    found = snapshots.readable(snapshots.locations(spark, _store_locations(spark, sf, _root(spark, "locations"))))
    return found.groupBy("folder", "seed", "t_min", F.get("coordinate", F.lit(0)).alias("x"), F.get("coordinate", F.lit(1)).alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_manifest", "WITH " + _FOLDS + " SELECT DISTINCT exp, folder, seed, t_min FROM (SELECT 'exp' AS exp, folder, seed, t_min FROM cells)")
def snapshot_manifest(spark, sf):
    return snapshots.manifest(spark, _store_cells(spark, sf)).select(F.col("exp_group").alias("exp"), "folder", "seed", "t_min")


_AT = """snap AS (SELECT folder, seed, t_min, count(*) AS n_cells, coalesce(avg(volume) FILTER (state <> 'NECROTIC'), 0) AS vol FROM cells GROUP BY ALL),
  paired AS (SELECT snap.* FROM snap WHERE EXISTS (SELECT 1 FROM locs l WHERE l.folder = snap.folder AND l.seed = snap.seed AND l.t_min = snap.t_min))"""


@query("paired_snapshots", "WITH " + _FOLDS + ", " + _AT + " SELECT folder, seed, t_min, n_cells, round(vol, 5) AS vol FROM paired")
def paired_snapshots(spark, sf):
    """Cells and locations of the same folder, seed and time, from the stored files."""
    root = _store_locations(spark, sf, _store_cells(spark, sf))
    return rounded(reduction.campaign(spark, root)["times"].select("folder", "seed", "t_min", F.col("n_cells").cast("bigint").alias("n_cells"), "vol"), 5)


@query("temporal_summary", "WITH " + _FOLDS + ", " + _AT + " SELECT folder, t_min, median(n_cells)::DOUBLE AS n_cells, round(stddev_pop(n_cells), 5) AS n_cells_std, round(median(vol), 5) AS vol, round(stddev_pop(vol), 5) AS vol_std FROM paired GROUP BY ALL")
def temporal_summary(spark, sf):
    root = _store_locations(spark, sf, _store_cells(spark, sf))
    return rounded(reduction.campaign(spark, root)["temporal"].select("folder", "t_min", "n_cells", "n_cells_std", "vol", "vol_std"), 5)


@query("campaign_summary", "WITH " + _FOLDS + ", " + _AT + """, last AS (SELECT * FROM paired QUALIFY t_min = max(t_min) OVER (PARTITION BY folder))
  SELECT folder, round(median(n_cells), 3)::DOUBLE AS n_cells, round(stddev_pop(n_cells), 3) AS n_cells_std, round(median(vol), 3) AS vol, round(stddev_pop(vol), 3) AS vol_std FROM last GROUP BY folder""")
def campaign_summary(spark, sf):
    root = _store_locations(spark, sf, _store_cells(spark, sf))
    return reduction.campaign(spark, root)["final"].select("folder", "n_cells", "n_cells_std", "vol", "vol_std")


# --- run folders ---------------------------------------------------------------------------------------

def _generations(spark, sf):
    """Line items of a run and year play the metric table of a generation."""
    return lines(spark, sf).groupBy("run", "gen", "folder").agg(F.avg("quantity").alias("quantity"), F.avg("discount").alias("discount"))


_GENS = "g AS (SELECT run, gen, folder, avg(quantity) AS quantity, avg(discount) AS discount FROM li GROUP BY ALL)"
_GEN_SCHEMA = "folder bigint, quantity double, discount double"


def _store_generations(spark, sf, names: dict[str, str]) -> str:
    root, rows = _root(spark, "generations"), _generations(spark, sf)
    for run, gen in sorted((r["run"], r["gen"]) for r in rows.select("run", "gen").distinct().collect()):      # a folder for each generation
        S.write_csv(rows.where((F.col("run") == run) & (F.col("gen") == gen)).select("folder", "quantity", "discount"), f"{root}/{names[run]}/iter_{gen}/final_metrics.csv")
    return root


@query("scanned_generations", sql("li", "WITH " + _GENS + " SELECT gen, folder, round(quantity, 6) AS quantity, round(discount, 6) AS discount FROM g WHERE run = 'O'"))
def scanned_generations(spark, sf):
    root = _store_generations(spark, sf, {"O": "O", "F": "F"})
    return rounded(S.generation_tables(spark, f"{root}/O", "final_metrics.csv", _GEN_SCHEMA).select("gen", "folder", "quantity", "discount"), 6)


@query("scanned_runs", sql("li", "WITH " + _GENS + " SELECT CASE run WHEN 'O' THEN 'open_t50_l5' ELSE 'full_t100_l10' END AS run, gen, CASE run WHEN 'O' THEN 50 ELSE 100 END AS n_trees, CASE run WHEN 'O' THEN 5 ELSE 10 END AS leaf, folder, round(quantity, 6) AS quantity FROM g"))
def scanned_runs(spark, sf):
    root = _store_generations(spark, sf, {"O": "open_t50_l5", "F": "full_t100_l10"})
    found = S.with_forest_settings(S.run_tables(spark, root, "final_metrics.csv", _GEN_SCHEMA))
    return rounded(found.select("run", "gen", "n_trees", "leaf", "folder", "quantity"), 6)


@query("missing_generations", sql("li", "WITH g AS (SELECT DISTINCT gen - 1990 AS gen FROM li) SELECT i::INTEGER AS gen FROM range(0, 12) r(i) WHERE i NOT IN (SELECT gen FROM g)"))
def missing_generations(spark, sf):
    return S.require_generations(lines(spark, sf).select((F.col("gen") - 1990).alias("gen")), 12)


@query("csv_round_trip", sql("parts", "SELECT particle, grp, round(p_size, 6) AS p_size, round(quantity, 6) AS quantity, round(tax, 6) AS tax, n_lines FROM parts"))
def csv_round_trip(spark, sf):
    path, df = f"{_root(spark, 'csv')}/parts.csv", parts(spark, sf).select("particle", "grp", "p_size", "quantity", "tax", "n_lines")
    S.write_csv(df, path)
    return rounded(S.read_csv(spark, path, "particle bigint, grp string, p_size double, quantity double, tax double, n_lines bigint"), 6)


@query("json_round_trip", sql("parts", "SELECT particle, grp, round(quantity, 6) AS quantity FROM parts"))
def json_round_trip(spark, sf):
    path = f"{_root(spark, 'json')}/parts"
    S.write_json(parts(spark, sf).select("particle", "grp", "quantity"), path)
    return rounded(spark.read.schema("particle bigint, grp string, quantity double").json(path), 6)


@query("stored_files", sql("parts", "SELECT count(DISTINCT grp) AS folders FROM parts"))
def stored_files(spark, sf):
    path = f"{_root(spark, 'files')}/parts"
    parts(spark, sf).select("grp", "particle").repartition("grp").write.partitionBy("grp").parquet(path)
    return S.files(spark, path, "*.parquet").agg(F.count_distinct(F.regexp_extract("path", "grp=([^/]+)/", 1)).alias("folders"))


@query("stored_targets", sql("mlong targets", "SELECT metric, round(avg(value) + any_value(target), 6) AS target FROM mlong JOIN targets USING (metric) GROUP BY metric"))
def stored_targets(spark, sf):
    path = f"{_root(spark, 'targets')}/targets.json"
    wanted = part_metrics_long(spark, sf).join(targets(spark), "metric").groupBy("metric").agg((F.avg("value") + F.first("target")).alias("target"))
    S.save_targets(wanted, path)
    return rounded(S.load_targets(spark, path), 6)


@query("stored_weights", sql("li", """WITH w AS (SELECT run, gen, folder AS particle, sum(quantity) AS q FROM li GROUP BY ALL), n AS (SELECT *, q / sum(q) OVER (PARTITION BY run, gen) AS weight FROM w)
  SELECT run, gen, count(*) AS rows, round(sum(weight), 6) AS total, round(1 / sum(weight * weight), 4) AS ess FROM n GROUP BY ALL"""))
def stored_weights(spark, sf):
    from simlens.operators.weights import normalise
    root = _root(spark, "weights")
    w = normalise(lines(spark, sf).groupBy("run", "gen", F.col("folder").alias("particle")).agg(F.sum("quantity").alias("weight")), ["run", "gen"])
    S.write_weights(w.select("run", "gen", "particle"), w, root)
    total = spark.read.parquet(f"{root}/weights").groupBy("run", "gen").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("total"))
    return mixed(total.join(spark.read.parquet(f"{root}/ess").select("run", "gen", "ess"), ["run", "gen"]), 6, ess=4)


@query("stored_lineage", "SELECT DISTINCT l_orderkey AS particle, l_partkey AS parent FROM lineitem")
def stored_lineage(spark, sf):
    """The first table stays: a second write is ignored."""
    path, edges = f"{_root(spark, 'lineage')}/edges", table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("particle"), F.col("l_partkey").alias("parent")).distinct()
    S.write_lineage(edges, path)
    S.write_lineage(edges.where("particle < 0"), path)
    return spark.read.parquet(path)


@query("stored_metrics", sql("parts", "SELECT 'discount,quantity,tax,input_folder' AS columns, count(*) AS n, round(sum(quantity), 4) AS quantity FROM parts"))
def stored_metrics(spark, sf):
    path = f"{_root(spark, 'metrics')}/metrics"
    S.write_metrics(parts(spark, sf).select("tax", F.concat(F.lit("input_"), F.col("particle").cast("string")).alias("input_folder"), "quantity", "discount"), path)
    back = spark.read.parquet(path)
    return rounded(back.agg(F.lit(",".join(back.columns)).alias("columns"), F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity")), 4)


@query("stored_samples", sql("parts", "SELECT round(tax, 6) AS tax, round(quantity, 6) AS quantity, round(abs(quantity - 25), 6) AS distance, abs(quantity - 25) < 2 AS accepted FROM parts"))
def stored_samples(spark, sf):
    path = f"{_root(spark, 'samples')}/samples.csv"
    rows = parts(spark, sf).withColumn("distance", F.abs(F.col("quantity") - 25)).withColumn("accepted", F.col("distance") < 2)
    S.write_samples(rows, path, ["tax"], ["quantity"])
    return rounded(S.read_csv(spark, path, "tax double, quantity double, distance double, accepted boolean"), 6)


@query("source_parameters", sql("parts", "SELECT particle, round(quantity, 6) AS quantity, (p_size::INTEGER % 7) AS X_SPACING FROM parts"))
def source_parameters(spark, sf):
    p = parts(spark, sf)
    log = p.select(F.concat(F.lit("input_"), F.col("particle").cast("string"), F.lit(".xml")).alias("file_name"), (F.col("p_size").cast("int") % 7).alias("X_SPACING"), F.lit(1).alias("DEPTH"))
    own = p.select(F.col("particle").cast("int").alias("particle"), "quantity")
    return rounded(S.join_source_parameters(own, log, ["X_SPACING", "DEPTH"]), 6).withColumn("particle", F.col("particle").cast("bigint")).select("particle", "quantity", "X_SPACING")


@query("scanned_particles", sql("parts", "SELECT particle::INTEGER AS particle, 'input_' || particle AS input_folder, round(quantity, 6) AS quantity FROM parts"))
def scanned_particles(spark, sf):
    path = f"{_root(spark, 'particles')}/all_param_df.csv"
    S.write_csv(parts(spark, sf).select(F.concat(F.lit("input_"), F.col("particle").cast("string")).alias("input_folder"), "quantity"), path)
    found = S.load_particles(S.read_csv(spark, path, "input_folder string, quantity double"), ["input_folder", "quantity"])
    return rounded(found.select(F.col("particle").cast("int").alias("particle"), "input_folder", "quantity"), 6)


@query("nested_parameters", sql("parts", "SELECT grp AS input_folder, round(avg(quantity), 6) AS rate, round(avg(tax), 6) AS uptake FROM parts GROUP BY grp"))
def nested_parameters(spark, sf):
    root = _root(spark, "nested")
    rows = parts(spark, sf).groupBy("grp").agg(F.avg("quantity").alias("rate"), F.avg("tax").alias("uptake")).withColumn("file", F.concat("grp", F.lit("/setup.json")))
    _store_files(rows, root, "file", lambda pdf: json.dumps({"populations": {"cancerous": {"rate": float(pdf["rate"].iloc[0]), "metabolism/uptake": float(pdf["uptake"].iloc[0])}}}))
    return rounded(S.nested_parameters(spark, f"{root}/*/setup.json", ["rate", "uptake"]).select("input_folder", "rate", "uptake"), 6)


_EQ = """m AS (SELECT grp, 1 AS step, 'discount' AS target, 'quantity' AS predictor, regr_slope(discount, quantity) AS slope, regr_intercept(discount, quantity) AS intercept, corr(discount, quantity) AS r FROM parts GROUP BY grp
  UNION ALL SELECT grp, 2, 'tax', 'quantity', regr_slope(tax, quantity), regr_intercept(tax, quantity), corr(tax, quantity) FROM parts GROUP BY grp)"""


def _made_summaries(spark, sf):
    """Prediction summaries, one nested row per group."""
    p, models = parts(spark, sf), None
    for step, target in enumerate(("discount", "tax"), 1):
        one = p.groupBy("grp").agg(F.lit(step).alias("step"), F.lit(target).alias("target"), F.lit("quantity").alias("predictor"), F.regr_slope(target, "quantity").alias("slope"),
                                   F.regr_intercept(target, "quantity").alias("intercept"), F.corr(target, "quantity").alias("r")).withColumn("r2", F.col("r") * F.col("r"))
        models = one if models is None else models.unionByName(one)
    roles = p.select("grp").distinct().withColumn("r", F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.lit(r).alias("role")) for n, r in (
        ("quantity", "root"), ("discount", "derived"), ("tax", "derived"), ("p_size", "independent"))]))).select("grp", "r.*")
    return S.prediction_summary(models, roles, ["grp"])


def _summaries(spark, sf):
    """The same, stored and read back."""
    path, made = f"{_root(spark, 'summaries')}/summary", _made_summaries(spark, sf)
    S.write_json(made, path)
    return spark.read.schema(made.schema).json(path)


# two stored summaries of each group: an older one without its last model, then the full one, beside one of another threshold
@query("latest_models", sql("parts", "WITH " + _EQ + """ SELECT grp, target AS target_parameter, predictor AS predictor_parameter, round(slope, 3) AS slope, round(intercept, 3) AS intercept, round(r, 3) AS r,
  row_number() OVER (PARTITION BY grp ORDER BY abs(round(m.r, 12)) DESC, target, predictor) AS place FROM m"""))
def latest_models(spark, sf):
    root, made = _root(spark, "thresholds"), _made_summaries(spark, sf)
    short = made.withColumn("prediction_models", F.struct(F.slice("prediction_models.models", 1, 1).alias("models")))
    S.write_json(short, f"{root}/run_linear_0.7_b/old")
    S.write_json(made, f"{root}/run_linear_0.7_a/new")
    S.write_json(short, f"{root}/run_linear_0.9_c/other")
    latest = S.latest_summaries(spark, root, made.schema, ["grp"], "0.7")
    return rounded(S.strongest_models(latest, ["grp"], 3).drop("r_squared"), 3)


@query("stored_equations", sql("parts", "WITH " + _EQ + " SELECT grp, target AS target_parameter, predictor AS predictor_parameter, round(slope, 3) AS slope, round(intercept, 3) AS intercept, round(r, 3) AS r FROM m"))
def stored_equations(spark, sf):
    return rounded(S.flatten_equations(_summaries(spark, sf), ["grp"], 9).drop("r_squared"), 3)


@query("derived_parameter_names", sql("parts", "SELECT DISTINCT grp, unnest(['discount', 'tax']) AS parameter FROM parts"))
def derived_parameter_names(spark, sf):
    return S.derived_names(_summaries(spark, sf), ["grp"])


@query("independent_in_all", sql("parts", """WITH t AS (SELECT grp AS path, p AS parameter FROM (SELECT grp, avg(p_size) AS s, avg(tax) AS t FROM parts GROUP BY grp), (VALUES ('p_size'), ('tax'), ('quantity')) v(p) WHERE p <> 'tax' OR t > 0.04)
  SELECT parameter FROM t GROUP BY parameter HAVING count(DISTINCT path) = (SELECT count(DISTINCT path) FROM t)"""))
def independent_in_all(spark, sf):
    names = F.filter(F.array(F.lit("p_size"), F.when(F.avg("tax") > 0.04, F.lit("tax")), F.lit("quantity")), lambda x: x.isNotNull())
    return S.independent_in_all(parts(spark, sf).groupBy(F.col("grp").alias("path")).agg(names.alias("parameters")))


@query("cluster_profiles", sql("parts", "SELECT grp AS cluster, round(avg(quantity), 6) AS pc1, round(avg(tax), 6) AS pc2, round(avg(p_size), 6) AS p_size FROM parts GROUP BY grp"))
def cluster_profiles(spark, sf):
    root = _root(spark, "profiles")
    mean = parts(spark, sf).groupBy(F.col("grp").alias("cluster")).agg(F.avg("quantity").alias("pc1"), F.avg("tax").alias("pc2"), F.avg("p_size").alias("p_size"))
    rows = mean.withColumn("kind", F.lit("pca_peak_inverse")).unionByName(mean.withColumn("kind", F.lit("mean"))).withColumn("file", F.lit("summary.json"))     # two rows for each group
    _store_files(rows, root, "file", lambda pdf: json.dumps(pdf.drop(columns="file").to_dict("records")))
    return rounded(S.cluster_profiles(spark, f"{root}/summary.json", ["p_size"]).select("cluster", "pc1", "pc2", F.col("profile")["p_size"].alias("p_size")), 6)


@query("weighted_clouds", sql("parts", "SELECT CASE WHEN grp < 'M' THEN 'first' ELSE 'second' END AS cloud, particle, round(quantity, 6) AS quantity, n_lines::DOUBLE AS weight FROM parts"))
def weighted_clouds(spark, sf):
    p = parts(spark, sf)
    cloud = {n: (p.where(c).select("particle", "quantity"), p.where(c).select("particle", F.col("n_lines").cast("double").alias("weight"))) for n, c in (("first", "grp < 'M'"), ("second", "grp >= 'M'"))}
    return rounded(S.load_clouds(cloud, "particle").select("cloud", "particle", "quantity", "weight"), 6)


@query("representative_inputs", sql("parts", "WITH c AS (SELECT grp, min(particle) AS i FROM parts GROUP BY grp) SELECT grp AS cluster, 'input_' || (i + 1) AS input_folder FROM c"))
def representative_inputs(spark, sf):
    nearest = parts(spark, sf).groupBy(F.col("grp").alias("cluster")).agg(F.min("particle").alias("nearest_sample_index"))
    return S.representative_inputs(nearest, nearest.count())


@query("renamed_trajectories", "SELECT user_id, day(ts)::DOUBLE AS time, round(value, 6) AS infected FROM events")
def renamed_trajectories(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.dayofmonth("ts").alias("t"), F.col("value").alias("I"))
    return rounded(S.trajectories(e), 6)


@query("selected_runs", sql("li", "SELECT DISTINCT run AS bundle, gen AS peak FROM li WHERE gen = 1995"))
def selected_runs(spark, sf):
    runs = lines(spark, sf).select(F.col("run").alias("bundle"), F.col("gen").alias("peak")).distinct()
    known = S.catalogue(spark, [(r["bundle"], "drf", "0.9", r["peak"], f"{r['bundle']}/iter_{r['peak']}") for r in runs.collect()])     # a row for each run folder
    return S.select_runs(known, method="drf", peak=1995).select("bundle", "peak")
