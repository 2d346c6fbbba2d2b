"""Maintenance: de-duplication, merges, scores, flags and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.notes import LLM_SCORED, SCORED, llm_quality, mismatch, quality, score_note
from ..functions.text import exact_text, plain_text, stem_id
from ..operators.ranking import top_per_group
from ..operators.upsert import update_set


def connectivity(crosswalks: DataFrame) -> DataFrame:
    """``id, degree``: how many mapping ends name an id."""
    return crosswalks.select(F.explode(F.array("source_id", "target_id")).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def duplicate_map(standards: DataFrame, crosswalks: DataFrame) -> DataFrame:
    """``loser, survivor``: double ingests, which agree in system, grade, domain (any case) and text (not blank), and whose ids differ
    only in a last segment of four or more digits. The best connected survives, then the shortest id, then the smallest."""
    s = standards.select("id", "system", "grade", "domain", "standard_text").where("trim(standard_text) <> ''").distinct()
    empty = F.lit("")  # a null system, grade or domain equals another null
    key = [F.coalesce("system", empty).alias("system"), F.coalesce("grade", empty).alias("grade"), F.coalesce(F.upper("domain"), empty).alias("d"), F.md5("standard_text").alias("t")]
    rows = s.select("id", *key, stem_id(F.col("id")).alias("stem")).join(connectivity(crosswalks), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    k = ["system", "grade", "d", "t"]
    g = rows.groupBy(*k).agg(F.min(F.struct((-F.col("degree")).alias("x"), F.length("id").alias("y"), "id")).alias("m"), F.min("stem").alias("s0"), F.max("stem").alias("s1"), F.count("*").alias("n"), F.min((F.col("stem") != F.col("id")).cast("int")).alias("all_changed"))
    groups = g.where("n > 1 and s0 = s1 and all_changed = 1").select(*k, F.col("m.id").alias("survivor"))
    return rows.join(groups, k).select(F.col("id").alias("loser"), "survivor").where("loser <> survivor")


def remap(df: DataFrame, losers: DataFrame, *fields: str) -> DataFrame:
    """References to losers become references to their survivors."""
    for f in fields:
        m = losers.select(F.col("loser").alias(f), F.col("survivor").alias("_s"))
        df = df.join(m, f, "left").withColumn(f, F.coalesce("_s", f)).drop("_s").select(*df.columns)
    return df


def deduplicated_mappings(crosswalks: DataFrame, losers: DataFrame) -> DataFrame:
    """Mappings after a remap: no self-references, and of each (source, target) the smallest id."""
    moved = remap(crosswalks, losers, "source_id", "target_id").where("source_id <> target_id")
    return top_per_group(moved, ["source_id", "target_id"], [F.col("id")], 1)


def merged_notes(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Notes and flags of an overlay's scored mappings, by (source, target), on the base; other rows as they are."""
    scored = overlay.where(F.col("notes").rlike(SCORED))
    patch = top_per_group(scored, ["source_id", "target_id"], [F.col("id").desc()], 1).select("source_id", "target_id", "notes", "flagged_for_review")
    return update_set(base, patch, ["source_id", "target_id"], ["notes", "flagged_for_review"])


def missing_mappings(base: DataFrame, overlay: DataFrame, standards: DataFrame) -> DataFrame:
    """Overlay mappings that the base lacks and whose ends are standards."""
    ids = standards.select("id").distinct()
    new = overlay.join(base.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    return new.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(*overlay.columns)


def exact_matches(crosswalks: DataFrame, standards: DataFrame) -> DataFrame:
    """``id, kind, action``: mappings between equal texts: ``identical`` or ``same words``; ``score`` if unscored, ``fix`` if scored 2 or less."""
    text = standards.select("id", "standard_text").where("standard_text is not null").groupBy("id").agg(F.min("standard_text").alias("t"))
    j = crosswalks.join(text.select(F.col("id").alias("source_id"), F.col("t").alias("a")), "source_id").join(text.select(F.col("id").alias("target_id"), F.col("t").alias("b")), "target_id")
    same = j.where(exact_text(F.col("a")) == exact_text(F.col("b")))
    q = quality(F.col("notes"))
    kind = F.when(F.col("a") == F.col("b"), "identical").otherwise("same words")
    return same.select("id", kind.alias("kind"), F.when(q.isNull(), "score").when(q <= 2, "fix").otherwise("keep").alias("action"))


def unscored_batch(crosswalks: DataFrame, n: int, prefix: str = "nlp_pass") -> DataFrame:
    """The next ``n`` mappings to score: placeholders with the best cosine first."""
    return crosswalks.where(F.col("notes").startswith(prefix)).orderBy(F.col("confidence_score").desc_nulls_last(), "id").limit(n)


def apply_scores(crosswalks: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores (``id, score, rationale, mismatch``) as notes; 2 or less is flagged."""
    patch = scores.select("id", score_note(F.col("score"), F.col("rationale"), F.col("mismatch")).alias("notes"), F.when(F.col("score") <= 2, 1).otherwise(0).alias("flagged_for_review"))
    return update_set(crosswalks, patch, ["id"], ["notes", "flagged_for_review"])


def flag_policy(crosswalks: DataFrame, hubs: list[str]) -> DataFrame:
    """``id, flag``: mappings into a hub are flagged at 1, direct ones at 2 or less; unscored ones are not."""
    q = quality(F.col("notes"))
    limit = F.when(F.col("target_system").isin(*hubs), 1).otherwise(2)
    return crosswalks.select("id", F.when(q <= limit, 1).otherwise(0).alias("flag"))


def flagged_export(crosswalks: DataFrame, standards: DataFrame, max_score: int | None = None) -> DataFrame:
    """Flagged mappings with both texts, score and mismatch, of at most ``max_score``."""
    text = standards.groupBy("id").agg(F.min("standard_text").alias("t"))
    f = crosswalks.where("flagged_for_review = 1").select("id", "source_id", "target_id", "source_system", "target_system", llm_quality(F.col("notes")).alias("score"), mismatch(F.col("notes")).alias("mismatch"))
    if max_score is not None:
        f = f.where(F.col("score") <= max_score)
    return f.join(text.select(F.col("id").alias("source_id"), F.col("t").alias("source_text")), "source_id").join(text.select(F.col("id").alias("target_id"), F.col("t").alias("target_text")), "target_id")


def flagged_summary(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("source_system", "target_system", "mismatch").agg(F.count("*").alias("n"))


def export_standards(standards: DataFrame, subs: DataFrame, keywords: DataFrame, withheld: list[str]) -> DataFrame:
    """One JSON object a standard, with its parts and keywords; systems in ``withheld`` give codes without text."""
    parts = subs.distinct().groupBy(F.col("parent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "id", "text"))), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))).alias("sub_standards"))
    words = keywords.groupBy(F.col("standard_id").alias("id")).agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    closed = F.col("system").isin(*withheld)
    out = standards.join(parts, "id", "left").join(words, "id", "left")
    return out.select(
        "id", "system", "subject", "grade", "domain", "cluster", F.when(closed, None).otherwise(F.col("standard_text")).alias("standard_text"), closed.alias("codes_only"),
        F.when(closed, None).otherwise(F.col("sub_standards")).alias("sub_standards"), "keywords",
    )


def exact_duplicates(standards: DataFrame) -> DataFrame:
    """``id, first_id``: standards whose system, grade and normalised text occur before, under a smaller id."""
    s = standards.where("trim(standard_text) <> ''").select("id", "system", F.md5(F.concat_ws("|", plain_text(F.col("standard_text")), "grade")).alias("k")).distinct()
    w = Window.partitionBy("system", "k")
    return s.withColumn("first_id", F.min("id").over(w)).where("id <> first_id").select("id", "first_id")


def label_queue(candidates: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """The next ``n`` candidates (``target_id, prereq_id``) without a label (``key``)."""
    keyed = candidates.withColumn("key", F.concat_ws("|", "target_id", "prereq_id"))
    return keyed.join(labels.select("key").distinct(), "key", "left_anti").orderBy("key").limit(n)


def labelled_edges(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """Prerequisite edges of labelled candidates, both ways: HARD is 0.9, SOFT 0.5, NONE gives none."""
    j = candidates.withColumn("key", F.concat_ws("|", "target_id", "prereq_id")).join(labels, "key").where("label <> 'NONE'")
    note = F.format_string("llm_prereq cosine=%.4f %s: %s", F.col("cosine"), F.lower("label"), F.coalesce("reason", F.lit("")))
    conf = F.when(F.col("label") == "HARD", 0.9).otherwise(0.5)
    from ..operators.graph import mirrored

    return mirrored(j.select(F.col("target_id").alias("source_id"), F.col("prereq_id").alias("target_id"), F.lit("prerequisite").alias("relationship"), conf.alias("confidence_score"), note.alias("notes")))


def gate(gold: DataFrame, predicted: DataFrame, needed: float = 0.85) -> DataFrame:
    """``rows, binary, exact, traps, passed``: agreement of labels by ``key``; a trap is a gold NONE marked ``trap`` that was predicted HARD."""
    j = gold.select("key", F.col("label").alias("g"), "trap").join(predicted.select("key", F.col("label").alias("p")), "key")
    binary = F.avg(((F.col("g") == "NONE") == (F.col("p") == "NONE")).cast("double"))
    a = j.agg(F.count("*").alias("rows"), binary.alias("binary"), F.avg((F.col("g") == F.col("p")).cast("double")).alias("exact"), F.count_if(F.col("trap") & (F.col("p") == "HARD")).alias("traps"))
    return a.withColumn("passed", (F.col("binary") >= needed) & (F.col("traps") == 0))


def direct_pairs(candidates: DataFrame, mapped: DataFrame, floor: float = 0.55, least: float = 0.7, max_delta: int = 5) -> DataFrame:
    """Both ways, pairs (``a, b, cosine, delta``) of standards without a mapping, confidence at least ``least``."""
    ok = candidates.where((F.col("cosine") >= floor) & (F.abs("delta") <= max_delta))
    for c in ("a", "b"):
        ok = ok.join(mapped.select(F.col("id").alias(c)), c, "left_anti")
    one = ok.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.greatest("cosine", F.lit(least)).alias("confidence_score"), "delta")
    return one.unionByName(one.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "confidence_score", (-F.col("delta")).alias("delta")))


def run_steps(steps: list[tuple[str, Callable[[], object]]], fresh: set[str] = frozenset(), tries: int = 2) -> list[tuple[str, str]]:
    """Runs named steps in order, each up to ``tries`` times, and skips those in ``fresh``: ``(name, done | skipped | failed)``.

    A step that fails for good does not stop the later ones; a retry that works counts as done.
    """
    out = []
    for name, step in steps:
        if name in fresh:
            out.append((name, "skipped"))
            continue
        for n in range(tries):
            try:
                step()
                out.append((name, "done"))
                break
            except Exception:
                if n == tries - 1:
                    out.append((name, "failed"))
    return out


SCORE_FORMS = {"any": SCORED, "export": LLM_SCORED}
