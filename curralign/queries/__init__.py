"""All queries of the core by name, with the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, graph, maintain, relational, similarity, text, tools, ingest, whole  # isort: skip
from .registry import ALL

__all__ = ["audits", "graph", "ingest", "maintain", "oracle_sql", "queries", "relational", "similarity", "text", "tools", "whole"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
