"""The register of queries, the tables they read, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import current_vectors
from ..plans.crosswalk import vector_rows
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, tuple[Query, str | None]] = {}

#: The hub of the test tables, for every subject.
HUB = "valm-core"
SUBJECTS = ("mathematics", "science", "ela", "social-studies", "cs")
HUBS = dict.fromkeys(SUBJECTS, HUB)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` gives the same rows in DuckDB."""

    def add(f: Query) -> Query:
        ALL[f.__name__] = (f, sql)
        return f

    return add


class Tables:
    """The curriculum tables under a root, each row once, of restated mappings the latest."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def standards(self, *cols: str) -> DataFrame:
        return self.raw("standards").select(*(cols or ["*"])).distinct()

    def subs(self, *cols: str) -> DataFrame:
        return self.raw("sub_standards").select(*(cols or ["*"])).distinct()

    def edges(self, *cols: str) -> DataFrame:
        return self.raw("standard_relationships").select(*(cols or ["*"])).distinct()

    def mappings(self, *cols: str) -> DataFrame:
        c = self.raw("crosswalk_mappings")
        rest = [x for x in (cols or c.columns) if x not in ("id", "updated_at")]
        best = c.groupBy("id").agg(F.max(F.struct("updated_at", *rest)).alias("m"))
        return best.select("id", *(["m.updated_at"] if not cols or "updated_at" in cols else []), *(f"m.{x}" for x in rest))

    def vectors(self) -> DataFrame:
        return current_vectors(self.raw("standard_embeddings"), "gradus-embed", 64)

    def vector_rows(self) -> DataFrame:
        return vector_rows(self.vectors(), self.standards("id", "system", "subject", "grade"))


S = "s AS (SELECT DISTINCT * FROM standards)"
U = "u AS (SELECT DISTINCT * FROM sub_standards)"
E = "e AS (SELECT DISTINCT * FROM standard_relationships)"
C = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM crosswalk_mappings) WHERE rn = 1)"
V = """v AS (SELECT standard_id AS id, list_transform(vector, lambda x: x::DOUBLE) AS vec FROM (SELECT *, row_number() OVER (PARTITION BY standard_id ORDER BY created_at DESC) AS rn
 FROM standard_embeddings WHERE model = 'gradus-embed' AND standard_id IS NOT NULL) WHERE rn = 1 AND len(vector) = 64
 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""
#: Finite scores.
OK_SCORE = "confidence_score IS NOT NULL AND NOT isnan(confidence_score)"


def rank_sql(x: str) -> str:
    return f"coalesce(list_position(['K','1','2','3','4','5','6','7','8','HS'], {x}) - 1, 99)"


def year_sql(x: str) -> str:
    def one(g: str) -> str:
        words = "['kindergarten','first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth']"
        return f"(CASE WHEN {g} = 'K' THEN 0 WHEN {g} = 'HS' THEN 9 ELSE coalesce(list_position({words}, lower({g})) - 1, try_cast({g} AS INTEGER)) END)"

    return f"coalesce({one(f'trim({x})')}, CASE WHEN {x} LIKE '%-%' THEN {one(f'''trim(split_part(trim({x}), '-', 1))''')} END, 99)::INTEGER"


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
