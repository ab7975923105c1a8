"""Scans of per-agent snapshot files.

File name: ``<group>_<name>_<seed>_<minutes>.CELLS.json`` (or LOCATIONS) inside a folder ``input_<n>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "state string, volume double, age double, cycles array<bigint>, _corrupt_record string"
LOCATIONS = "coordinate array<int>, _corrupt_record string"


def _path() -> Column:
    return F.replace(F.col("_metadata.file_path"), F.lit("%20"), F.lit(" "))


def file_keys(path: Column, kind: str) -> dict[str, Column]:
    # every row of a file asks for its keys: the pattern meets the short file name, not each place of a long path
    pattern = rf"([^/_]+)_([^/]+)_(\d+)_(\d+)\.{kind}\.json$"
    name = F.substring_index(path, "/", -1)
    part = [F.regexp_extract(name, pattern, i) for i in range(1, 5)]
    return {"exp_group": part[0], "exp_name": part[1], "seed": F.when(part[2] != "", part[2].cast("int")),
            "t_min": F.when(part[3] != "", part[3].cast("int")), "folder": F.when(F.contains(path, F.lit("/")), F.substring_index(F.substring_index(path, "/", -2), "/", 1)).otherwise(F.lit(""))}


def _scan(spark: SparkSession, root: str, kind: str, schema: str, t_min: int | None) -> DataFrame:
    stamp = "*" if t_min is None else f"*_{t_min:06d}"
    df = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("recursiveFileLookup", True).option("pathGlobFilter", f"{stamp}.{kind}.json").json(root))
    keyed = df.select("*", *[c.alias(n) for n, c in file_keys(_path(), kind).items()])
    return keyed.where(F.col("seed").isNotNull())


def cells(spark: SparkSession, root: str, t_min: int | None = None) -> DataFrame:
    """Cells of all folders, seeds and times (or one time); unreadable files become rows with ``_corrupt_record``."""
    return _scan(spark, root, "CELLS", CELLS, t_min)


def locations(spark: SparkSession, root: str, t_min: int | None = None) -> DataFrame:
    return _scan(spark, root, "LOCATIONS", LOCATIONS, t_min)


def readable(df: DataFrame) -> DataFrame:
    return df.where(F.col("_corrupt_record").isNull() & F.col(df.columns[0]).isNotNull()).drop("_corrupt_record")


def unreadable_folders(df: DataFrame) -> DataFrame:
    # the parser must see a data column next to the raw record
    return df.where(F.col("_corrupt_record").isNotNull() & F.col(df.columns[0]).isNull()).select("folder", "seed", "t_min").distinct()


def manifest(spark: SparkSession, root: str, kind: str = "CELLS") -> DataFrame:
    """Snapshot files present, keyed by name, without reading their content."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", f"*.{kind}.json").load(root).select("path", "length"))
    keyed = files.select("path", "length", *[c.alias(n) for n, c in file_keys(F.col("path"), kind).items()])
    return keyed.where(F.col("seed").isNotNull())
