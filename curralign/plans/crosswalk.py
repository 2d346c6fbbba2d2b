"""Crosswalks between curricula: nearest hub standards, families, bridges and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grades import alignment, grade_year
from ..functions.notes import is_scored, quality
from ..operators.ranking import top_per_group
from ..operators.upsert import merge_rows
from ..operators.vectors import similarity_join

# Fixed values.
SUBJECT_HUB = {"mathematics": "ccss", "science": "ngss", "ela": "ccss-ela", "social-studies": "c3", "cs": "csta"}
THRESHOLD, TOP_N, MAX_DELTA = 0.70, 1, 5
FAMILIES = {
    "commonwealth": ["uk-nc", "au-acara", "nz-moe", "sg-moe", "in-ncert", "ke-kicd", "tz-tie", "ug-ncdc", "gh-nacca", "ng-nerdc", "za-caps", "zm-cdc", "na-nied"],
    "atomic_style": ["cl-mineduc", "jp-mext", "kr-ncf"],
    "iberian_continental": ["pe-minedu", "co-men", "es-lomloe", "pt-dge", "de-kmk", "it-miur", "fi-oph", "gb-sco", "rw-reb"],
    "latin_southern": ["mx-sep-2017", "br-bncc", "uy-anep", "cz-msmt"],
    "anglophone_distinct": ["ca-on", "ie-ncca", "hk-edb", "zw-zimsec"],
}


def hub_of(subject: Column, hubs: dict[str, str], default: str = "ccss") -> Column:
    """The hub of a subject; subjects without one go to the default."""
    out = None
    for s, h in hubs.items():
        out = F.when(subject == s, h) if out is None else out.when(subject == s, h)
    return F.lit(default) if out is None else out.otherwise(default)


def vector_rows(vectors: DataFrame, standards: DataFrame) -> DataFrame:
    """``id, vec, rank, system, subject, grade``: vectors with their standards; ``rank`` is the grade's year."""
    s = standards.select("id", "system", "subject", "grade").distinct()
    return vectors.join(s, "id").select("id", "vec", grade_year(F.col("grade")).alias("rank"), "system", "subject", "grade")


def hub_crosswalk(rows: DataFrame, hubs: dict[str, str], threshold: float = THRESHOLD, top_n: int = TOP_N, max_delta: int = MAX_DELTA, default: str = "ccss") -> DataFrame:
    """``source_id, target_id, source_system, target_system, relationship, confidence_score, grade_delta, notes``: of every
    standard outside its hub the ``top_n`` nearest hub standards of its subject. Filters come before the ranking; ties by target id.

    A standard whose subject has no hub goes to the default hub, where all subjects of the hub are candidates.
    """
    names = sorted({*hubs.values(), default})
    keyed = rows.withColumn("hub", hub_of(F.col("subject"), hubs, default)).withColumn("system", F.col("system"))
    spokes = keyed.where(~F.col("system").isin(*names))
    hub_rows = rows.where(F.col("system").isin(*names)).withColumn("hub", F.col("system"))
    found = similarity_join(spokes, hub_rows, "hub", threshold, ("system", "grade"), f"within:{max_delta}", top_n)
    best = top_per_group(found, ["a"], [F.col("cosine").desc(), F.col("b")], top_n)
    return _mappings(best, "nlp_pass")


def _mappings(pairs: DataFrame, method: str) -> DataFrame:
    delta = grade_year(F.col("b_grade")) - grade_year(F.col("a_grade"))
    return pairs.select(
        F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("a_system").alias("source_system"), F.col("b_system").alias("target_system"),
        F.lit("equivalent").alias("relationship"), F.col("cosine").alias("confidence_score"), delta.cast("int").alias("grade_delta"),
        F.format_string(f"{method} cosine=%.4f", F.col("cosine")).alias("notes"),
    )


def family_crosswalk(rows: DataFrame, families: dict[str, list[str]], threshold: float = THRESHOLD, max_delta: int = MAX_DELTA, subject: str = "mathematics") -> DataFrame:
    """The same for all ordered pairs of systems within a family, but the nearest standard is taken first and dropped if it fails a filter."""
    members = [F.struct(F.lit(f).alias("family"), F.lit(s).alias("system")) for f, names in families.items() for s in names]
    fam = rows.sparkSession.range(1).select(F.explode(F.array(*members)).alias("m")).select("m.*")
    r = rows.where(F.col("subject") == subject).join(F.broadcast(fam), "system")
    partner = fam.select("family", F.col("system").alias("other"))
    sides = r.join(F.broadcast(partner), "family").where("system <> other")
    left = sides.withColumn("pair", F.concat_ws("|", "family", "system", "other"))
    right = sides.withColumn("pair", F.concat_ws("|", "family", "other", "system"))
    found = similarity_join(left, right, "pair", -2.0, ("system", "grade"), None, 1)
    best = top_per_group(found, ["a", "b_system"], [F.col("cosine").desc(), F.col("b")], 1)
    near = F.abs(grade_year(F.col("b_grade")) - grade_year(F.col("a_grade"))) <= max_delta
    return _mappings(best.where((F.col("cosine") >= threshold) & near), "direct_family")


def prerequisite_candidates(rows: DataFrame, floor: float = 0.45, window: int = 3, k: int = 6) -> DataFrame:
    """``target_id, prereq_id, cosine``: for each standard the ``k`` most similar of 1 to ``window`` grades below, by its ``scope``."""
    found = similarity_join(rows, rows, "scope", floor, (), f"below:{window}", k)
    best = top_per_group(found, ["a"], [F.col("cosine").desc(), F.col("b")], k)
    return best.select(F.col("a").alias("target_id"), F.col("b").alias("prereq_id"), "cosine")


def near_duplicates(rows: DataFrame, threshold: float = 0.97) -> DataFrame:
    """``id_a, id_b, cosine``: pairs of one system and grade, smaller id first. All rows take part."""
    keyed = rows.withColumn("scope", F.concat_ws("|", "system", "grade"))
    return similarity_join(keyed, keyed, "scope", threshold, (), "after:0").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "cosine")


def precomputed(crosswalks: DataFrame, threshold: float = 0.7, include_flagged: bool = False) -> DataFrame:
    """Mappings at the threshold, flagged ones only on request, with ``quality`` (3 for none), ``alignment`` and their rank within source and target system."""
    rows = crosswalks.where(F.col("confidence_score") >= threshold).where(~F.isnan("confidence_score"))
    if not include_flagged:
        rows = rows.where("flagged_for_review = 0")
    q = F.coalesce(quality(F.col("notes")), F.lit(3))
    rows = rows.select("source_id", "source_system", "target_id", "target_system", "confidence_score", q.alias("quality"), alignment(F.col("grade_delta")).alias("alignment"))
    from ..operators.ranking import ranked

    return ranked(rows, ["source_id", "target_system"], [F.col("quality").desc(), F.col("confidence_score").desc(), F.col("target_id")], "rank_no")


def best_any(crosswalks: DataFrame) -> DataFrame:
    """The best mapping of each source and target system whatever its confidence and flag."""
    scored = crosswalks.where(F.col("confidence_score").isNotNull() & ~F.isnan("confidence_score"))
    return top_per_group(scored, ["source_id", "target_system"], [F.col("confidence_score").desc(), F.col("target_id")], 1).select("source_id", "target_system", "target_id", "confidence_score")


def two_hop(crosswalks: DataFrame, hub: str, fan: int = 3, keep: int = 5) -> DataFrame:
    """``source_id, to_system, target_id, confidence``: over the hub, ``fan`` best mappings into it and ``fan`` best of each hub standard back
    in each system; the product of both confidences, the best for each target, ``keep`` of them. Ties by id."""
    ok = crosswalks.where(F.col("confidence_score").isNotNull() & ~F.isnan("confidence_score") & (F.col("target_system") == hub) & (F.col("source_system") != hub))
    ok = ok.groupBy("source_id", "source_system", "target_id").agg(F.max("confidence_score").alias("c"))
    one = top_per_group(ok, ["source_id"], [F.col("c").desc(), F.col("target_id")], fan).select("source_id", F.col("source_system").alias("from_system"), F.col("target_id").alias("hub_id"), F.col("c").alias("c1"))
    two = top_per_group(ok, ["target_id", "source_system"], [F.col("c").desc(), F.col("source_id")], fan).select(F.col("target_id").alias("hub_id"), F.col("source_id").alias("target_id"), F.col("source_system").alias("to_system"), F.col("c").alias("c2"))
    both = one.join(two, "hub_id").where("from_system <> to_system").groupBy("source_id", "to_system", "target_id").agg(F.round(F.max(F.col("c1") * F.col("c2")), 4).alias("confidence"))
    return top_per_group(both, ["source_id", "to_system"], [F.col("confidence").desc(), F.col("target_id")], keep)


def hub_reverse(crosswalks: DataFrame, hub: str, keep: int = 5) -> DataFrame:
    """For a hub standard the best sources of each system that map to it."""
    into = crosswalks.where((F.col("target_system") == hub) & F.col("confidence_score").isNotNull() & ~F.isnan("confidence_score"))
    return top_per_group(into, ["target_id", "source_system"], [F.col("confidence_score").desc(), F.col("source_id")], keep).select(
        F.col("target_id").alias("source_id"), F.col("source_system").alias("to_system"), F.col("source_id").alias("target_id"), F.col("confidence_score").alias("confidence")
    )


def upsert_mappings(base: DataFrame, new: DataFrame) -> DataFrame:
    """New mappings by (source, target): scored notes and the marks of people stay, everything else is the new row's."""
    kept = F.when(is_scored(F.col("b.notes")), F.col("b.notes")).otherwise(F.coalesce("n.notes", "b.notes"))
    merged = {"notes": kept, "verified_by_human": F.coalesce("b.verified_by_human", "n.verified_by_human"), "flagged_for_review": F.coalesce("b.flagged_for_review", "n.flagged_for_review")}
    return merge_rows(base, new, ["source_id", "target_id"], {k: v for k, v in merged.items() if k in base.columns})
