"""Writing results: versions of a table, JSON lines with a manifest, CSV and resumable logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, root: str, version: str, partition_by: tuple[str, ...] = ()) -> str:
    """``df`` as a new version under ``root``; it becomes current when a pointer file is written, after all data is there."""
    path = f"{root}/{version}"
    df.write.mode("overwrite" if not has_version(df.sparkSession, root, version) else "errorifexists").partitionBy(*partition_by).parquet(path)
    spark = df.sparkSession
    turn = _last_turn(spark, root) + 1
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("errorifexists").text(f"{root}/_versions/{_TURN}={turn}")
    return path


_TURN = "turn"


def _turns(spark: SparkSession, root: str) -> DataFrame | None:
    """``value, turn``: the versions with their numbers; None before the first."""
    try:
        return spark.read.text(f"{root}/_versions")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _last_turn(spark: SparkSession, root: str) -> int:
    turns = _turns(spark, root)
    return 0 if turns is None else turns.agg(F.max(_TURN)).first()[0] or 0


def has_version(spark: SparkSession, root: str, version: str | None = None) -> bool:
    """Whether a version, or any, was written to its end."""
    turns = _turns(spark, root)
    return turns is not None and not (turns if version is None else turns.where(F.col("value") == version)).isEmpty()


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The version that was written last."""
    turns = _turns(spark, root)
    if turns is None:
        raise FileNotFoundError(f"{root} has no version")
    last = turns.agg(F.max_by("value", _TURN)).first()[0]
    return spark.read.parquet(f"{root}/{last}")


def overwrite_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Replaces only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> DataFrame:
    """Writes JSON lines and returns ``file, lines, bytes, checksum`` for each file, read again line by line from storage.

    The checksum is the sum of :func:`line_hash` over the file's lines, so files are never held whole and their sums add up to the table's.
    """
    df.write.mode("overwrite").json(path)
    lines = df.sparkSession.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), "value")
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.sum(line_hash(F.col("value"))).alias("checksum"))


def line_hash(line: F.Column) -> F.Column:
    """The first 40 bits of a line's MD5 as a number."""
    return F.conv(F.substring(F.md5(line), 1, 10), 16, 10).cast("bigint")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """``name, n, checksum``: the rows of each table and the sum of their hashes as JSON, whatever their order."""
    out = None
    for name, df in tables.items():
        one = df.select(line_hash(F.to_json(F.struct(*df.columns))).alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("checksum")).select(F.lit(name).alias("name"), "n", "checksum")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose ``key`` the log does not have yet, so that a stopped run goes on where it was."""
    try:
        done = df.sparkSession.read.schema(df.schema).json(path).select(key).distinct()
        df = df.join(done, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").json(path)
