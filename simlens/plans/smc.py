"""Sequential inference around a simulator that the user supplies.

Every generation is a set of tables under ``root/<table>/gen=<g>``; a finished generation is read, not repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlens.functions import exprs as X
from simlens.operators import neighbours as N
from simlens.operators import sampling
from simlens.operators.clean import drop_invalid_rows
from simlens.operators.forest import forest_weights, univariate_weights
from simlens.operators.ordered import keys_equal, running
from simlens.operators.weights import effective_size, resample
from simlens.session import cut, literal_table, settled


@dataclass
class Smc:
    """Settings of a run. Callables see DataFrames and Columns only.

    sampler(spark, n, seed) -> rows (particle, parameters...)
    simulate(rows, seed) -> rows with the statistics; failed particles are missing or NULL
    density() -> Column, positive inside the prior
    kernel(rows, t, seed) -> perturbed rows (ids: draw)
    """
    parameters: Sequence[str]
    targets: dict[str, float]
    sampler: Callable[[SparkSession, int, int], DataFrame]
    simulate: Callable[[DataFrame, int], DataFrame]
    density: Callable[[], Column]
    kernel: Callable[[DataFrame, int, int], DataFrame]
    root: str
    n: int
    generations: int
    seed: int = 42
    method: str = "drf"
    forest: dict = field(default_factory=dict)
    derive: Callable[[DataFrame], DataFrame] | None = None


def _finished(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)      # an unfinished earlier attempt has no marker and is replaced
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table(run: Smc, spark: SparkSession, name: str, gen: int, build: Callable[[], DataFrame]) -> DataFrame:
    path = f"{run.root.rstrip('/')}/{name}/gen={gen}"
    if _finished(spark, path):
        return spark.read.parquet(path)
    return _store(build(), path)


def _check_settings(run: Smc, spark: SparkSession) -> None:
    """Settings are stored beside the tables; a folder made with others is refused."""
    own = repr((list(run.parameters), sorted(run.targets.items()), run.n, run.seed, run.method, sorted(run.forest.items())))
    path = f"{run.root.rstrip('/')}/settings"
    if _finished(spark, path):
        kept = spark.read.parquet(path).first()["settings"]
        if kept != own:
            raise ValueError(f"the run folder holds tables made with other settings: {kept}")
    else:
        _store(literal_table(spark, [(own,)], "settings string"), path)


def simulate_rows(fn, schema: str) -> Callable[[DataFrame, int], DataFrame]:
    """Turns a pandas function (rows, seed) -> rows into a simulate callable; each row's seed is a hash of run and id."""
    def run(df: DataFrame, seed: int) -> DataFrame:
        seeded = df.withColumn("seed", F.floor(X.uniform(seed, F.lit("sim"), "particle") * (1 << 31)).cast("int"))
        return seeded.mapInPandas(lambda batches: (fn(b) for b in batches), schema)
    return run


def propose(prev: DataFrame, weights: DataFrame, run: Smc, t: int, room: float = 1.5) -> DataFrame:
    """n accepted children with their parent: resample, perturb, keep those inside the prior, number them by attempt.

    Attempts are oversampled; when too few survive, the number of attempts doubles and the same first attempts recur.
    """
    cloud = prev.select("particle", *run.parameters).join(weights.select("particle", "weight"), "particle")
    attempts = int(run.n * room) + 16
    while True:
        drawn = resample(cloud, attempts, run.seed + 1000 * t, "particle").withColumnRenamed("particle", "parent").drop("weight")
        moved = run.kernel(drawn, t, run.seed + 1000 * t + 1)
        if run.derive is not None:
            moved = run.derive(moved)
        inside = cut(moved.where(run.density() > 0))
        if inside.count() >= run.n:
            break
        if attempts > 4096 * run.n:
            raise RuntimeError("almost no perturbed particle falls inside the prior")
        attempts *= 2
    kept = running(inside, [], ["draw"], "__rn").where(F.col("__rn") <= run.n)
    return kept.select(F.col("__rn").alias("particle"), "parent", *run.parameters)


def scaled(stats: DataFrame, scaler: DataFrame, names: Sequence[str]) -> DataFrame:
    joined = keys_equal(stats, scaler, [])
    return joined.withColumns({m: (F.col(m) - F.col(f"mu_{m}")) / F.when(F.col(f"sd_{m}") > 0, F.col(f"sd_{m}")).otherwise(1.0) for m in names}) \
        .drop(*[f"{p}_{m}" for m in names for p in ("mu", "sd")])


def weigh(run: Smc, rows: DataFrame, scaler: DataFrame, seed: int) -> DataFrame:
    names = list(run.targets)
    table = cut(scaled(rows, scaler, names))
    spark = rows.sparkSession
    goal = cut(scaled(literal_table(spark, [tuple(float(v) for v in run.targets.values())], ", ".join(f"{m} double" for m in names)), scaler, names))
    method = forest_weights if run.method == "drf" else univariate_weights
    return method(table, goal, "particle", list(run.parameters), names, seed=seed, **run.forest)


def run_smc(spark: SparkSession, run: Smc) -> dict[str, DataFrame]:
    """Tables of the last generation: particles (with statistics), weights, ess, lineage."""
    _check_settings(run, spark)
    names = list(run.targets)
    out: dict[str, DataFrame] = {}
    scaler = None
    for g in range(run.generations):
        seed = run.seed + g
        if g == 0:
            parents = _table(run, spark, "parameters", 0, lambda: run.sampler(spark, run.n, seed).select("particle", *run.parameters))
        else:
            prev, prev_w, at = out["particles"], out["weights"], g
            proposed = _table(run, spark, "proposals", g, lambda: propose(prev, prev_w, run, at))
            out["lineage"] = _table(run, spark, "lineage", g, lambda: proposed.select("particle", "parent"))
            parents = proposed.select("particle", *run.parameters)
        rows = _table(run, spark, "particles", g, lambda: drop_invalid_rows(
            parents.join(run.simulate(parents, seed).select("particle", *names), "particle"), names))
        if scaler is None:
            scaler = _table(run, spark, "scaler", 0, lambda: rows.agg(*[f(m).alias(f"{p}_{m}") for m in names for p, f in (("mu", F.avg), ("sd", F.stddev_pop))]))
        weights = _table(run, spark, "weights", g, lambda: weigh(run, rows, scaler, seed))
        out.update(particles=rows, weights=weights, ess=_table(run, spark, "ess", g, lambda: effective_size(weights, [])))
    return out


def posterior_sample(particles: DataFrame, weights: DataFrame, n: int, seed: int) -> DataFrame:
    return resample(particles.join(weights, "particle"), n, seed, "particle")


def importance_weights(current: DataFrame, previous: DataFrame, ranges: dict[str, tuple[float, float]], width: float, density: Column | None = None,
                       spacings: Sequence[str] = (), reach: int = 4, forest: str | None = None, ident: str = "particle",
                       block: int = 4 * N.BLOCK, bound: int | None = None) -> DataFrame:
    """(ident, log_denominator, weight): prior (or forest weight) over the mixture of kernels around the previous generation.

    ``previous`` carries ``weight``. Normal kernels per parameter; the spacings must lie within ``reach`` steps. A wide
    kernel meets most shards, and a query is written once for each of them, so shards are larger than elsewhere.
    """
    import math
    names = list(ranges)
    sd = {p: (hi - lo) * width for p, (lo, hi) in ranges.items()}
    # both tables and the sums below are read several times: what made them runs once
    previous, current = settled(previous), settled(current)
    total = previous.agg(F.sum("weight").alias("__t"))
    points = keys_equal(previous.where("weight > 0"), total, []).select(
        F.col(ident), *[(F.col(p) / sd[p]).alias(p) for p in names], *spacings, F.ln(F.col("weight") / F.col("__t")).alias("__lw"), F.lit(False).alias("__query"))
    queries = current.select(F.col(ident), *[(F.col(p) / sd[p]).alias(p) for p in names], *spacings, F.lit(0.0).alias("__lw"), F.lit(True).alias("__query"))
    both = points.unionByName(queries)
    sums = N.log_kernel_sums(both, [], [*names, *spacings], ident, [1.0], "__lw", False, F.col("__query"), ~F.col("__query"),
                             boxed=len(spacings), width=float(reach), block=block, bound=bound)
    norm = -sum(math.log(s * math.sqrt(2 * math.pi)) for s in sd.values()) - len(spacings) * math.log(2 * reach + 1)
    j = current.join(sums, ident).withColumn("log_denominator", F.element_at("log_sums", 1) + norm)
    top = F.col(forest) if forest else (density if density is not None else F.lit(1.0))
    j = j.withColumn("__num", top.cast("double"))
    logw = F.when((F.col("__num") > 0) & (F.col("log_denominator") > F.lit(float("-inf"))), F.ln("__num") - F.col("log_denominator"))
    j = cut(j.select(ident, "log_denominator", logw.alias("__l")))
    peak = j.agg(F.max("__l").alias("__m"))
    j = keys_equal(j, peak, []).withColumn("__w", F.coalesce(F.exp(F.col("__l") - F.col("__m")), F.lit(0.0)))
    sum_ = j.agg(F.sum("__w").alias("__s"))
    return keys_equal(j, sum_, []).select(ident, "log_denominator", F.coalesce(F.try_divide(F.col("__w"), F.col("__s")), F.lit(0.0)).alias("weight"))
