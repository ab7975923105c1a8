"""Session helpers: size checks and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Inputs may be ordered inside one task per group if their scanned bytes stay below the first bound and a
#: count proves that their rows, whatever joins or explosions made them, stay below the second.
#: Override the first with the Spark setting ``simlens.smallBytes``.
SMALL_BYTES = 64 << 20
SMALL_ROWS = 2_000_000


def small_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get("simlens.smallBytes", str(SMALL_BYTES)))


def scanned_bytes(df: DataFrame) -> int | None:
    """Bytes of all leaves of the optimised plan (files after column pruning, ranges, local rows).

    Returns None when a leaf has no statistics, e.g. on a remote session.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except AttributeError:      # a remote session has no plan to look at
        return None


def is_small(df: DataFrame, bound: int | None = None) -> bool:
    """True only when the input is proven to lie under both bounds; the count stops once it passes its bound."""
    bound = small_bytes(df.sparkSession) if bound is None else bound
    size = scanned_bytes(df)
    if size is None or size > bound:
        return False
    return df.select(F.lit(1)).limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A few literal rows as a local relation, whose size the optimiser knows."""
    fields = T._parse_datatype_string(schema).fields
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    if not structs:
        return spark.createDataFrame([], schema)
    return spark.range(1).select(F.inline(F.array(*structs)))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written cuts: the cluster's ``spark.checkpoint.dir``.

    A machine-local folder is used only for a local master, where driver and executors share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="simlens-cut-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write the frame to the shared checkpoint folder and read it back.

    Ends the lineage with files that outlive any executor, and gives the reader real sizes.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/simlens/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def rescans(df: DataFrame) -> bool:
    """True if reading the frame again only scans and unfolds its inputs: no join, grouping, order or Python step."""
    try:
        nodes = [df._jdf.queryExecution().optimizedPlan()]
    except AttributeError:
        return False
    while nodes:
        children = nodes[-1].children()
        if children.size() and nodes[-1].nodeName() not in ("Project", "Filter", "Generate", "Expand", "Union"):
            return False
        nodes = nodes[:-1] + [children.apply(i) for i in range(children.size())]
    return True


def settled(df: DataFrame) -> DataFrame:
    """A frame that several steps read: its joins and groupings run once and are written, plain scans are read again."""
    return df if rescans(df) else cut(df)


def forget(df: DataFrame) -> None:
    """Delete the files of a cut that later cuts have replaced; nothing that is still to run may read it."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
