"""Maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans import crosswalk as cw
from ..plans import maintain
from .registry import HUB, C, S, Tables, query, with_

_Q = "try_cast(nullif(regexp_extract(notes, '\\[(?:LLM score|exact-match) (\\d)/5\\]', 1), '') AS INTEGER)"
_LQ = "try_cast(nullif(regexp_extract(notes, '\\[LLM score (\\d)/5\\]', 1), '') AS INTEGER)"
_MIS = "CASE WHEN notes IS NULL THEN 'unknown' ELSE coalesce(nullif(regexp_extract(notes, 'MISMATCH:\\s*(.+?)\\.?\\s*$', 1), ''), 'unknown') END"
_TEXT = "x AS (SELECT id, min(standard_text) AS t FROM standards WHERE standard_text IS NOT NULL GROUP BY id)"
_NORM = "replace(replace(replace(lower(trim({})), chr(10), ' '), chr(9), ' '), '  ', ' ')"
_DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM c UNION ALL SELECT target_id FROM c) WHERE id IS NOT NULL GROUP BY id)"
_DUP = """y AS (SELECT s.id, coalesce(system, '') AS system, coalesce(grade, '') AS grade, coalesce(upper(domain), '') AS d, standard_text AS t, regexp_replace(s.id, '[.][0-9]{4,}$', '') AS stem, coalesce(degree, 0) AS degree
 FROM (SELECT DISTINCT id, system, grade, domain, standard_text FROM standards WHERE trim(standard_text) <> '') s LEFT JOIN deg ON deg.id = s.id),
 g AS (SELECT system, grade, d, t FROM y GROUP BY ALL HAVING count(*) > 1 AND min(stem) = max(stem) AND min((stem <> id)::INTEGER) = 1),
 z AS (SELECT y.*, first_value(id) OVER (PARTITION BY system, grade, d, t ORDER BY degree DESC, length(id), id) AS survivor FROM y JOIN g USING (system, grade, d, t)),
 losers AS (SELECT id AS loser, survivor FROM z WHERE id <> survivor)"""


@query(with_(C, _DEG) + "SELECT id, degree FROM deg")
def mt_conn_score(spark, root) -> DataFrame:
    return maintain.connectivity(Tables(spark, root).mappings("source_id", "target_id"))


def _losers(t: Tables) -> DataFrame:
    return maintain.duplicate_map(t.raw("standards"), t.mappings("source_id", "target_id"))


@query(with_(C, _DEG, _DUP) + "SELECT loser, survivor FROM losers")
def mt_dedup(spark, root) -> DataFrame:
    return _losers(Tables(spark, root))


@query(
    with_(C, _DEG, _DUP, "m AS (SELECT c.id, coalesce(a.survivor, c.source_id) AS source_id, coalesce(b.survivor, c.target_id) AS target_id FROM c LEFT JOIN losers a ON a.loser = c.source_id LEFT JOIN losers b ON b.loser = c.target_id)")
    + "SELECT source_id, target_id, min(id) AS id FROM m WHERE source_id <> target_id GROUP BY ALL"
)
def jn_remap(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return maintain.deduplicated_mappings(t.mappings("source_id", "target_id"), _losers(t)).select("source_id", "target_id", "id")


@query(
    with_(C, "o AS (SELECT source_id, target_id, notes, flagged_for_review FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY id DESC) AS r FROM c WHERE regexp_matches(notes, '\\[(?:LLM score|exact-match) (\\d)/5\\]')) WHERE r = 1)")
    + "SELECT c.id, coalesce(o.notes, c.notes) AS notes, coalesce(o.flagged_for_review, c.flagged_for_review) AS flagged_for_review FROM c LEFT JOIN o ON o.source_id = c.source_id AND o.target_id = c.target_id"
)
def mt_merge(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("source_id", "target_id", "notes", "flagged_for_review")
    return maintain.merged_notes(c, c).select("id", "notes", "flagged_for_review")


@query(
    with_(C)
    + "SELECT id FROM c WHERE source_id IN (SELECT id FROM standards) AND target_id IN (SELECT id FROM standards) AND flagged_for_review = 1 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.flagged_for_review = 0 AND b.source_id = c.source_id AND b.target_id = c.target_id)"
)
def snk_insert_select(spark, root) -> DataFrame:
    t = Tables(spark, root)
    c = t.mappings("source_id", "target_id", "flagged_for_review")
    return maintain.missing_mappings(c.where("flagged_for_review = 0"), c.where("flagged_for_review = 1"), t.raw("standards")).select("id")


@query(with_(C, _TEXT) + f"SELECT c.id, CASE WHEN a.t = b.t THEN 'identical' ELSE 'same words' END AS kind, CASE WHEN {_Q} IS NULL THEN 'score' WHEN {_Q} <= 2 THEN 'fix' ELSE 'keep' END AS action FROM c JOIN x a ON a.id = c.source_id JOIN x b ON b.id = c.target_id WHERE {_NORM.format('a.t')} = {_NORM.format('b.t')}")
def mt_exact(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return maintain.exact_matches(t.mappings("source_id", "target_id", "notes"), t.raw("standards"))


@query(with_(C) + "SELECT id FROM c WHERE starts_with(notes, 'nlp_pass') AND NOT isnan(confidence_score) ORDER BY confidence_score DESC NULLS LAST, id LIMIT 100")
def mt_score_export(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("notes", "confidence_score").where("not isnan(confidence_score)")
    return maintain.unscored_batch(c, 100).select("id")


@query(with_(C) + "SELECT id, CASE WHEN id % 7 = 0 THEN '[LLM score ' || (id % 5 + 1)::VARCHAR || '/5] Read.' ELSE notes END AS notes, CASE WHEN id % 7 = 0 THEN (id % 5 + 1 <= 2)::INTEGER ELSE flagged_for_review END AS flagged_for_review FROM c")
def mt_score_apply(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("notes", "flagged_for_review")
    scores = c.where("id % 7 = 0").select("id", (F.col("id") % 5 + 1).cast("int").alias("score"), F.lit("Read.").alias("rationale"), F.lit("").alias("mismatch"))
    return maintain.apply_scores(c, scores)


@query(with_(C) + f"SELECT id, CASE WHEN {_Q} <= CASE WHEN target_system = '{HUB}' THEN 1 ELSE 2 END THEN 1 ELSE 0 END AS flag FROM c")
def mt_flag_policy(spark, root) -> DataFrame:
    return maintain.flag_policy(Tables(spark, root).mappings("notes", "target_system"), [HUB])


@query(with_(C) + f"SELECT CASE WHEN confidence_score >= 0.85 THEN 'high' WHEN confidence_score >= 0.7 THEN 'mid' ELSE 'low' END AS band, {_Q} AS score, count(*) AS n FROM c WHERE confidence_score IS NOT NULL AND NOT isnan(confidence_score) GROUP BY ALL")
def mt_rationale(spark, root) -> DataFrame:
    from ..functions.notes import quality

    x = F.col("confidence_score")
    c = Tables(spark, root).mappings("notes", "confidence_score").where(x.isNotNull() & ~F.isnan(x))
    return c.groupBy(F.when(x >= 0.85, "high").when(x >= 0.7, "mid").otherwise("low").alias("band"), quality(F.col("notes")).alias("score")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id, parent_id FROM sub_standards WHERE parent_id IN (SELECT id FROM standards WHERE length(trim(standard_text)) >= 5)")
def mt_glossary(spark, root) -> DataFrame:
    from ..operators.upsert import cascade

    t = Tables(spark, root)
    return cascade(t.subs("id", "parent_id"), t.raw("standards").where("length(trim(standard_text)) >= 5"), "parent_id").select("id", "parent_id")


@query(with_(C, "x AS (SELECT id, min(standard_text) AS t FROM standards GROUP BY id)") + f"SELECT c.id, source_id, target_id, source_system, target_system, {_LQ} AS score, {_MIS} AS mismatch, a.t AS source_text, b.t AS target_text FROM c JOIN x a ON a.id = source_id JOIN x b ON b.id = target_id WHERE flagged_for_review = 1")
def mt_flag_export(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return maintain.flagged_export(t.mappings(), t.raw("standards"))


@query(with_(C) + f"SELECT source_system, target_system, {_MIS} AS mismatch, count(*) AS n FROM c WHERE flagged_for_review = 1 AND source_id IN (SELECT id FROM standards) AND target_id IN (SELECT id FROM standards) GROUP BY ALL")
def agg_summary3(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return maintain.flagged_summary(maintain.flagged_export(t.mappings(), t.raw("standards")))


@query(
    with_(S, "p AS (SELECT parent_id, count(*) AS n FROM (SELECT DISTINCT * FROM sub_standards) GROUP BY 1)")
    + "SELECT s.id, CASE WHEN system IN ('heim-plan') THEN NULL ELSE standard_text END AS standard_text, system IN ('heim-plan') AS codes_only, CASE WHEN system IN ('heim-plan') THEN NULL ELSE n END::INTEGER AS parts FROM s LEFT JOIN p ON p.parent_id = s.id"
)
def mt_export_json(spark, root) -> DataFrame:
    t = Tables(spark, root)
    s = t.standards()
    words = s.select(F.col("id").alias("standard_id"), F.explode(text.keywords(F.col("standard_text"))).alias("keyword"))
    out = maintain.export_standards(s, t.subs(), words, ["heim-plan"])
    return out.select("id", "standard_text", "codes_only", F.when(F.col("sub_standards").isNotNull(), F.size("sub_standards")).alias("parts"))


@query(with_("g AS (SELECT DISTINCT target_id, prereq_id FROM prereq_gold_sample)", "l AS (SELECT source_id || '|' || target_id AS k FROM standard_relationships WHERE method = 'llm_prereq')") + "SELECT target_id || '|' || prereq_id AS key FROM g WHERE target_id || '|' || prereq_id NOT IN (SELECT k FROM l WHERE k IS NOT NULL) ORDER BY 1 LIMIT 50")
def mt_label_queue(spark, root) -> DataFrame:
    t = Tables(spark, root)
    labels = t.raw("standard_relationships").where("method = 'llm_prereq'").select(F.concat_ws("|", "source_id", "target_id").alias("key"))
    return maintain.label_queue(t.raw("prereq_gold_sample").select("target_id", "prereq_id").distinct(), labels, 50).select("key")


_LAB = "l AS (SELECT DISTINCT target_id, prereq_id, CASE WHEN md5(target_id) < '8' THEN 'HARD' WHEN md5(target_id) < 'c' THEN 'SOFT' ELSE 'NONE' END AS label FROM prereq_gold_sample)"


def _labels(t: Tables) -> DataFrame:
    h = F.md5("target_id")
    g = t.raw("prereq_gold_sample").select("target_id", "prereq_id").distinct()
    return g.withColumn("label", F.when(h < "8", "HARD").when(h < "c", "SOFT").otherwise("NONE"))


@query(with_(_LAB) + "SELECT target_id AS source_id, prereq_id AS target_id, 'prerequisite' AS relationship, CASE label WHEN 'HARD' THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence_score FROM l WHERE label <> 'NONE' UNION ALL SELECT prereq_id, target_id, 'successor', CASE label WHEN 'HARD' THEN 0.9 ELSE 0.5 END::DOUBLE FROM l WHERE label <> 'NONE'")
def mt_prereq_insert(spark, root) -> DataFrame:
    g = _labels(Tables(spark, root))
    labels = g.select(F.concat_ws("|", "target_id", "prereq_id").alias("key"), "label", F.lit("why").alias("reason"))
    out = maintain.labelled_edges(g.select("target_id", "prereq_id", F.lit(0.5).alias("cosine")), labels)
    return out.select("source_id", "target_id", "relationship", "confidence_score")


@query(
    with_(_LAB, "p AS (SELECT target_id, prereq_id, CASE WHEN md5(prereq_id) < '8' THEN 'HARD' ELSE 'NONE' END AS p, same FROM (SELECT DISTINCT target_id, prereq_id, md5(target_id) >= 'f' AS same FROM prereq_gold_sample))")
    + "SELECT count(*) AS rows, round(avg(((label = 'NONE') = (p = 'NONE'))::INTEGER), 6)::DOUBLE AS binary, round(avg((label = p)::INTEGER), 6)::DOUBLE AS exact, count(CASE WHEN same AND p = 'HARD' THEN 1 END) AS traps FROM l JOIN p ON l.target_id = p.target_id AND l.prereq_id = p.prereq_id"
)
def mt_prereq_gate(spark, root) -> DataFrame:
    g = _labels(Tables(spark, root)).withColumn("key", F.concat_ws("|", "target_id", "prereq_id")).where("target_id is not null and prereq_id is not null")
    gold = g.select("key", "label", (F.md5("target_id") >= "f").alias("trap"))
    predicted = g.select("key", F.when(F.md5("prereq_id") < "8", "HARD").otherwise("NONE").alias("label"))
    return maintain.gate(gold, predicted).select("rows", F.round("binary", 6).alias("binary"), F.round("exact", 6).alias("exact"), "traps")


