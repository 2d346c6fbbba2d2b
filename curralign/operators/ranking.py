"""Rows in order within groups and over all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """``df`` with the row number within ``keys``; give a total order for a result that ties cannot change."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark drops the rest before the shuffle (WindowGroupLimit)."""
    return ranked(df, keys, order, "_rn").where(F.col("_rn") <= n).drop("_rn")


def fill_forward(df: DataFrame, keys: Sequence[str], position: str, col: str) -> DataFrame:
    """The last value of ``col`` that is not null, at or before each row of the group."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(col, F.last(col, ignorenulls=True).over(w))


def chunked(df: DataFrame, keys: Sequence[str], position: str, text: str, size: int) -> DataFrame:
    """Every ``size`` consecutive rows of a group as one text: ``keys, chunk, text``, joined with line breaks in order."""
    numbered = ranked(df, keys, [F.col(position)], "_rn")
    parts = numbered.groupBy(*keys, F.floor((F.col("_rn") - 1) / size).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(F.col("_rn"), F.col(text)))).alias("_p"))
    return parts.select(*keys, "chunk", F.array_join(F.transform("_p", lambda x: x[text]), "\n").alias("text"))


def sampled(df: DataFrame, keys: Sequence[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each group in the order of a hash, the same in every run."""
    return top_per_group(df, keys, [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col))), F.col(id_col)], n)
