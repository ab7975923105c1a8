"""Files in, tables out: snapshot reduction, run folders and sequential inference."""

import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from simlens.functions import exprs as X
from simlens.operators import colony as K
from simlens.operators import sampling as S
from simlens.plans import reduction, smc
from simlens.session import literal_table
from simlens.sources import snapshots, tables


@pytest.fixture(scope="module")
def campaign(tmp_path_factory):
    root = tmp_path_factory.mktemp("campaign")
    ring = [(1, -1, 0), (1, 0, -1), (0, 1, -1), (-1, 1, 0), (-1, 0, 1), (0, -1, 1)]
    for folder in (1, 2):
        d = root / f"input_{folder}"
        d.mkdir()
        for seed in (0, 1, 2):
            for t, n in ((0, 2), (1440, 4), (2880, 8)):
                cells = [{"state": "PROLIFERATIVE" if i % 2 else "NECROTIC", "volume": 10.0 + i, "age": 5.0 + seed, "cycles": [120, 240] if i == 1 else []} for i in range(n)]
                where = ring if folder == 1 else [(3, -2, -1)]
                json.dump(cells, open(d / f"run_x_{seed}_{t:06d}.CELLS.json", "w"))
                json.dump([{"coordinate": [*c, 0]} for c in where], open(d / f"run_x_{seed}_{t:06d}.LOCATIONS.json", "w"))
    open(root / "input_2" / "run_x_9_000000.CELLS.json", "w").write("{ broken")
    return str(root)


def test_reduction_end_to_end(spark, campaign):
    assert [(r.folder, r.seed) for r in snapshots.unreadable_folders(snapshots.cells(spark, campaign)).collect()] == [("input_2", 9)]
    done = reduction.campaign(spark, campaign)
    out = {r.folder: r for r in done["final"].collect()}
    assert set(out) == {"input_1", "input_2"}
    a, b = out["input_1"], out["input_2"]
    assert a.symmetry == 1.0 and b.symmetry == 0.0
    assert a.doub_time == 24.0 and a.doub_time_std == 0.0 and a.n_cells == 8.0
    assert a.colony_diameter == 90.0 and a.cycle_length == 3.0 and a.activity == 0.0
    assert a.states["NECROTIC"] == 4 and a.states["SENESCENT"] == 0
    assert math.isclose(a.shannon, round(math.log(2), 3))
    assert done["temporal"].count() == 6 and done["seeds"].count() == 6 and done["unpaired"].count() == 0
    assert snapshots.cells(spark, campaign, 1440).select("t_min").distinct().count() == 1
    assert K.complete_particles(snapshots.manifest(spark, campaign), 2, 2880).count() == 2


def test_run_folders(spark, tmp_path):
    for g in (0, 1):
        d = tmp_path / "r_t50_l5" / f"iter_{g}"
        os.makedirs(d)
        pd.DataFrame({"input_folder": ["input_1", "input_2"], "doub_time": [40.0, np.inf], "symmetry": [0.5, 0.7]}).to_csv(d / "final_metrics.csv", index=False)
        pd.DataFrame({"input_folder": ["input_1", "input_2"], "P": [1.0, 2.0], "fixed": [3, 3], "X_SPACING": ["*:4", "*:9"]}).to_csv(d / "all_param_df.csv", index=False)
    one = tables.generation_tables(spark, str(tmp_path / "r_t50_l5"), "final_metrics.csv")
    assert one.groupBy("gen").count().count() == 2 and tables.require_generations(one, 3).collect()[0].gen == 2
    runs = tables.with_forest_settings(tables.run_tables(spark, str(tmp_path), "final_metrics.csv"))
    assert {(r.n_trees, r.leaf) for r in runs.select("n_trees", "leaf").collect()} == {(50, 5)}
    params = tables.read_csv(spark, str(tmp_path / "r_t50_l5" / "iter_0" / "all_param_df.csv"))
    post = tables.load_posterior(params, one.where("gen = 0"), ["doub_time", "symmetry"])
    assert post.columns == ["input_folder", "P", "X_SPACING", "doub_time", "symmetry"] and post.count() == 1
    assert [r.X_SPACING for r in tables.parse_spacings(params).orderBy("input_folder").collect()] == [4, 9]
    assert tables.discover_metrics(one.withColumn("a_std", F.lit(1.0)).drop("gen")) == ["doub_time", "symmetry"]
    json.dump({"doub_time": 45.5, "symmetry": 0.8}, open(tmp_path / "targets.json", "w"))
    assert {r.metric: r.target for r in tables.load_targets(spark, str(tmp_path / "targets.json")).collect()} == {"doub_time": 45.5, "symmetry": 0.8}
    assert tables.digests(spark, str(tmp_path), "*.csv").count() == 4
    key = spark.range(1).select(F.lit("N512_combined_grid_r_0.9_p2_mean_only").alias("run")).select(*[c.alias(n) for n, c in tables.run_key("run").items()]).first()
    assert (key.series, key.threshold, key.peak) == ("r", "0.9", 2)


def test_weights_and_lineage_sinks(spark, tmp_path):
    p = literal_table(spark, [("r", 0, 1), ("r", 0, 2)], "run string, gen int, particle int")
    tables.write_weights(p, p.withColumn("weight", F.lit(0.5)), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "ess")).first().ess == 2.0
    with pytest.raises(ValueError):
        tables.write_weights(p, p.limit(1).withColumn("weight", F.lit(1.0)), str(tmp_path))
    path = str(tmp_path / "lineage")
    tables.write_lineage(literal_table(spark, [(1, 2)], "particle int, parent int"), path)
    tables.write_lineage(literal_table(spark, [(1, 9)], "particle int, parent int"), path)
    assert spark.read.parquet(path).first().parent == 2


def test_nested_parameters(spark, tmp_path):
    d = tmp_path / "input_7"
    d.mkdir()
    json.dump({"populations": {"cancerous": {"affinity_mu": 1.23, "metabolism/volume_mu": 4.56}}}, open(d / "x.json", "w"))
    row = tables.nested_parameters(spark, str(d / "x.json"), ["affinity_mu", "volume_mu", "signaling/none"]).first()
    assert (row.particle, row.affinity_mu, row.volume_mu, row.none) == (7, 1.23, 4.56, None)


def test_sequential_inference_moves_to_the_target_and_resumes(spark, tmp_path):
    calls = []

    def simulate(df, seed):
        calls.append(seed)
        return df.select("particle", (F.col("x") * 2 + X.normal(seed, "particle") * 0.05).alias("y"))
    run = smc.Smc(["x"], {"y": 1.0}, lambda s, n, seed: S.sobol_design(s, n, {"x": (0.0, 1.0)}, seed), simulate,
                  lambda: X.uniform_density({"x": (0.0, 1.0)}), lambda df, t, seed: S.perturb(df, {"x": (0.0, 1.0)}, 0.05, seed, ["draw"]),
                  str(tmp_path), 128, 2, forest={"trees": 6})
    out = smc.run_smc(spark, run)
    j = out["particles"].join(out["weights"], "particle")
    mean = j.agg(F.sum(F.col("x") * F.col("weight")).alias("m"), F.sum("weight").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    assert mean.n == 128 and math.isclose(mean.s, 1.0) and abs(mean.m - 0.5) < 0.1 and mean.lo >= 0 and mean.hi <= 1
    assert 1 <= out["ess"].first().ess <= 128
    assert out["lineage"].join(out["particles"].select("particle"), "particle").count() == 128
    before = len(calls)
    again = smc.run_smc(spark, run)
    assert len(calls) == before and again["weights"].count() == 128


def test_user_function_as_simulator(spark):
    def fn(pdf):
        return pd.DataFrame({"particle": pdf.particle, "y": pdf.x * 2})
    sim = smc.simulate_rows(fn, "particle bigint, y double")
    assert {r.y for r in sim(literal_table(spark, [(1, 0.5), (2, 1.0)], "particle bigint, x double"), 3).collect()} == {1.0, 2.0}
