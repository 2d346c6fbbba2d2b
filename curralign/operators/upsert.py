"""Writes as frames: what a table holds after an insert, update, delete or merge. Parquet has no such statements, so the
result is written to a new version (see ``sources.sinks``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_rows(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last write wins: rows of ``new`` replace those of ``base`` with the same keys. ``new`` has each key once."""
    return base.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_missing(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First write wins: rows of ``new`` whose keys ``base`` lacks are added, one of each key (the smallest row)."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_m")).select(*keys, "_m.*") if rest else new.distinct()
    return base.unionByName(once.join(base.select(*keys), list(keys), "left_anti").select(*base.columns))


def update_set(base: DataFrame, patch: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``cols`` from ``patch`` where it has the key and a value; ``patch`` has each key once."""
    p = patch.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in cols))
    joined = base.join(p, list(keys), "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns))


def merge_rows(base: DataFrame, new: DataFrame, keys: Sequence[str], merged: dict[str, Column]) -> DataFrame:
    """Insert or update: a full outer join on ``keys``. ``merged`` gives columns from ``b.`` (old) and ``n.`` (new) where both
    may exist; other columns take the new value if there is one."""
    b = base.select(F.struct(*base.columns).alias("b"), *keys)
    n = new.select(F.struct(*new.columns).alias("n"), *keys)
    j = b.join(n, list(keys), "full")
    cols = [F.col(c) if c in keys else (merged[c] if c in merged else F.coalesce(F.col(f"n.{c}"), F.col(f"b.{c}"))).alias(c) for c in base.columns]
    return j.select(*cols)


def delete_where(base: DataFrame, condition: Column) -> DataFrame:
    """All rows for which the condition is not true."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def cascade(child: DataFrame, parent: DataFrame, *fields: str) -> DataFrame:
    """Rows of ``child`` whose references all exist in ``parent``."""
    ids = parent.select("id").distinct()
    for f in fields:
        child = child.join(ids.select(F.col("id").alias(f)), f, "left_semi")
    return child


def with_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that ``df`` lacks, added as nulls of the given types; running it twice changes nothing."""
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns))
