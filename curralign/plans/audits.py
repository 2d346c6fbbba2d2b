"""Data-quality audits. Each gives the offending rows or the figures that a check compares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grades import GRADE_ORDER
from ..functions.notes import is_scored


def counts(standards: DataFrame) -> DataFrame:
    """``system, n``: distinct standards of each system."""
    return standards.select("id", "system").distinct().groupBy("system").agg(F.count("*").alias("n"))


def below(counts_by_system: DataFrame, expected: DataFrame) -> DataFrame:
    """Systems with fewer rows than expected (``system, least``), absent ones with 0."""
    return expected.join(counts_by_system, "system", "left").select("system", F.coalesce("n", F.lit(0)).alias("n"), "least").where("n < least")


def missing_ids(standards: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("id").distinct().join(standards.select("id"), "id", "left_anti")


def short_texts(standards: DataFrame) -> DataFrame:
    """``id, kind``: null or blank, shorter than 5, or 5 to 9 characters, trimmed."""
    n = F.length(F.trim("standard_text"))
    kind = F.when(n.isNull() | (n == 0), "empty").when(n < 5, "tiny").when(n < 10, "short")
    return standards.select("id", kind.alias("kind")).distinct().where("kind is not null")


def dangling(child: DataFrame, parents: DataFrame, key: str, *fields: str) -> DataFrame:
    """``fld, key, ref``: references that are no id of ``parents``; null ones are not counted."""
    refs = child.select(F.col(key).cast("string").alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("fld"), F.col(f).alias("ref")) for f in fields))).alias("x")).select("x.fld", "key", "x.ref").where("ref is not null")
    return refs.join(parents.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").select("fld", "key", "ref").distinct()


def without_vectors(standards: DataFrame, vectors: DataFrame) -> DataFrame:
    """``system, n, missing, pct``: standards without a vector in each system."""
    s = standards.select("id", "system").distinct()
    have = vectors.select(F.col("standard_id").alias("id")).distinct().withColumn("has", F.lit(1))
    g = s.join(have, "id", "left").groupBy("system").agg(F.count("*").alias("n"), F.count_if(F.col("has").isNull()).alias("missing"))
    return g.withColumn("pct", F.round(100.0 * F.col("missing") / F.col("n"), 2))


def repeated_ids(rows: DataFrame) -> DataFrame:
    """``id, n``: ids of more than one different row."""
    return rows.distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def dimensions(vectors: DataFrame) -> DataFrame:
    """``dims, n``: how many vectors have each length; one row is what is wanted."""
    return vectors.where("vector is not null").groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"))


def out_of_range(rows: DataFrame) -> DataFrame:
    """``id``: scores outside 0..1, NaN included, null not."""
    return rows.where("confidence_score is not null and (isnan(confidence_score) or confidence_score < 0 or confidence_score > 1)").select("id").distinct()


def low_coverage(standards: DataFrame, crosswalks: DataFrame, least: int = 20, share: float = 0.5, worst: int = 10) -> DataFrame:
    """``system, n, mapped, coverage``: the ``worst`` systems of ``least`` rows with less than ``share`` mapped. Joined rows count, so a standard counts for each mapping."""
    s = standards.select("id", "system").distinct()
    m = crosswalks.select(F.col("id").alias("cid"), F.col("source_id").alias("id")).distinct()
    j = s.join(m, "id", "left").groupBy("system").agg(F.count("*").alias("n"), F.count("cid").alias("mapped"))
    return j.withColumn("coverage", F.round(F.col("mapped") / F.col("n"), 4)).where((F.col("n") >= least) & (F.col("mapped") < share * F.col("n"))).orderBy("coverage", "system").limit(worst)


def invalid_grades(standards: DataFrame) -> DataFrame:
    """``grade, n``: grades outside the ten."""
    g = standards.select("id", "grade").distinct()
    return g.where(F.col("grade").isNull() | ~F.col("grade").isin(*GRADE_ORDER)).groupBy("grade").agg(F.count("*").alias("n"))


def confidence_bands(crosswalks: DataFrame) -> DataFrame:
    """``band, n, pct``: mappings by confidence; null and NaN are no band."""
    c = F.col("confidence_score")
    band = F.when(c >= 0.9, ">=.90").when(c >= 0.8, ".80-.90").when(c >= 0.7, ".70-.80").otherwise("<.70")
    rows = crosswalks.where("confidence_score is not null and not isnan(confidence_score)")
    g = rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))


def collisions(crosswalks: DataFrame, more_than: int = 3, top: int = 20) -> DataFrame:
    """``target_id, source_system, n``: targets that many sources of one system share, the ``top`` most shared."""
    g = crosswalks.where("target_id is not null").groupBy("target_id", "source_system").agg(F.countDistinct("source_id").alias("n"))
    return g.where(F.col("n") > more_than).orderBy(F.col("n").desc(), "target_id", "source_system").limit(top)


def unmapped_systems(standards: DataFrame, crosswalks: DataFrame, hubs: list[str]) -> DataFrame:
    """``system``: systems that are no hub and have no mapping at all."""
    s = standards.select("system").distinct().where(~F.col("system").isin(*hubs))
    return s.join(crosswalks.select(F.col("source_system").alias("system")).distinct(), "system", "left_anti")


def misrouted(crosswalks: DataFrame, standards: DataFrame, hubs: dict[str, str]) -> DataFrame:
    """``subject, target_system, n``: mappings of a subject into another system than its hub."""
    s = standards.select(F.col("id").alias("source_id"), "subject").distinct()
    hub = F.create_map(*(F.lit(x) for kv in hubs.items() for x in kv))
    j = crosswalks.join(s, "source_id").withColumn("hub", F.try_element_at(hub, F.col("subject")))
    return j.where("hub is not null and target_system <> hub").groupBy("subject", "target_system").agg(F.count("*").alias("n"))


def score_coverage(crosswalks: DataFrame) -> DataFrame:
    """``source_system, n, scored, pct``."""
    g = crosswalks.groupBy("source_system").agg(F.count("*").alias("n"), F.count_if(is_scored(F.col("notes"))).alias("scored"))
    return g.withColumn("pct", F.round(100.0 * F.col("scored") / F.col("n"), 2))


def gaps(standards: DataFrame, crosswalks: DataFrame, hubs: list[str], threshold: float = 0.7, worst: int = 20) -> DataFrame:
    """``system, n, unmapped, below, usable, coverage``: what share of a system's standards has a usable mapping, worst first."""
    s = standards.select("id", "system").distinct().where(~F.col("system").isin(*hubs))
    best = crosswalks.where("not isnan(confidence_score)").groupBy(F.col("source_id").alias("id")).agg(F.max("confidence_score").alias("best"))
    g = s.join(best, "id", "left").groupBy("system").agg(
        F.count("*").alias("n"), F.count_if(F.col("best").isNull()).alias("unmapped"), F.count_if(F.col("best") < threshold).alias("below"), F.count_if(F.col("best") >= threshold).alias("usable")
    )
    return g.withColumn("coverage", F.round(F.col("usable") / F.col("n"), 4)).orderBy("coverage", "system").limit(worst)


def delta_outliers(crosswalks: DataFrame, limit: int = 12) -> DataFrame:
    return crosswalks.where(F.abs("grade_delta") > limit).select("id").distinct()


def absent_codes(standards: DataFrame, codes: list[str]) -> DataFrame:
    """``system``: expected two-letter systems that have no standards."""
    rows = standards.sparkSession.range(1).select(F.explode(F.array(*(F.lit(c) for c in codes))).alias("system"))
    return rows.join(standards.select("system").distinct(), "system", "left_anti")
