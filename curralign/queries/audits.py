"""Audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import audits, maintain
from .registry import HUB, HUBS, OK_SCORE, C, S, Tables, query, with_


@query("SELECT system, count(*) AS n FROM (SELECT DISTINCT id, system FROM standards) GROUP BY system")
def dq_counts(spark, root) -> DataFrame:
    return audits.counts(Tables(spark, root).raw("standards"))


@query("SELECT system, coalesce(n, 0) AS n, least FROM (VALUES ('valm-core', 1000000000), ('heim-plan', 1), ('none-such', 5)) x(system, least) LEFT JOIN (SELECT system, count(*) AS n FROM (SELECT DISTINCT id, system FROM standards) GROUP BY system) USING (system) WHERE coalesce(n, 0) < least")
def dq_low_counts(spark, root) -> DataFrame:
    expected = spark.sql("select * from values ('valm-core', 1000000000), ('heim-plan', 1), ('none-such', 5) as x(system, least)")
    return audits.below(audits.counts(Tables(spark, root).raw("standards")), expected)


@query("SELECT DISTINCT target_id AS id FROM crosswalk_mappings WHERE trim(target_id) <> '' AND target_id NOT IN (SELECT id FROM standards)")
def dq_required_ids(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return audits.missing_ids(t.raw("standards"), t.raw("crosswalk_mappings").where("trim(target_id) <> ''").select(F.col("target_id").alias("id")))


@query("SELECT DISTINCT id, CASE WHEN standard_text IS NULL OR trim(standard_text) = '' THEN 'empty' WHEN length(trim(standard_text)) < 5 THEN 'tiny' ELSE 'short' END AS kind FROM standards WHERE standard_text IS NULL OR length(trim(standard_text)) < 10")
def dq_short(spark, root) -> DataFrame:
    return audits.short_texts(Tables(spark, root).raw("standards"))


@query("SELECT DISTINCT 'source_id' AS fld, id::VARCHAR AS key, source_id AS ref FROM crosswalk_mappings WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT id FROM standards) UNION SELECT DISTINCT 'target_id', id::VARCHAR, target_id FROM crosswalk_mappings WHERE target_id IS NOT NULL AND target_id NOT IN (SELECT id FROM standards)")
def dq_orphans(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return audits.dangling(t.raw("crosswalk_mappings"), t.raw("standards"), "id", "source_id", "target_id")


@query("SELECT DISTINCT 'standard_id' AS fld, standard_id AS key, standard_id AS ref FROM standard_embeddings WHERE standard_id IS NOT NULL AND standard_id NOT IN (SELECT id FROM standards)")
def dq_orphan_vectors(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return audits.dangling(t.raw("standard_embeddings"), t.raw("standards"), "standard_id", "standard_id")


@query("SELECT system, count(*) AS n, count(CASE WHEN e.id IS NULL THEN 1 END) AS missing, round(100.0 * count(CASE WHEN e.id IS NULL THEN 1 END) / count(*), 2)::DOUBLE AS pct FROM (SELECT DISTINCT id, system FROM standards) s LEFT JOIN (SELECT DISTINCT standard_id AS id FROM standard_embeddings) e ON e.id = s.id GROUP BY system")
def dq_missing_emb(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return audits.without_vectors(t.raw("standards"), t.raw("standard_embeddings"))


@query(with_(C) + "SELECT id, count(*) AS n FROM (SELECT DISTINCT * FROM crosswalk_mappings) GROUP BY id HAVING count(*) > 1")
def dq_dup_ids(spark, root) -> DataFrame:
    return audits.repeated_ids(Tables(spark, root).raw("crosswalk_mappings"))


@query("SELECT len(vector)::INTEGER AS dims, count(*) AS n FROM standard_embeddings WHERE vector IS NOT NULL GROUP BY ALL")
def dq_dims(spark, root) -> DataFrame:
    return audits.dimensions(Tables(spark, root).raw("standard_embeddings"))


@query("SELECT DISTINCT id FROM crosswalk_mappings WHERE confidence_score IS NOT NULL AND (isnan(confidence_score) OR confidence_score < 0 OR confidence_score > 1)")
def dq_conf_range(spark, root) -> DataFrame:
    return audits.out_of_range(Tables(spark, root).raw("crosswalk_mappings"))


@query(with_("s AS (SELECT DISTINCT id, system FROM standards)", "m AS (SELECT DISTINCT id AS cid, source_id FROM crosswalk_mappings)", "j AS (SELECT system, count(*) AS n, count(cid) AS mapped FROM s LEFT JOIN m ON m.source_id = s.id GROUP BY system)") + "SELECT system, n, mapped, round(mapped / n, 4)::DOUBLE AS coverage FROM j WHERE n >= 20 AND mapped < 0.9 * n ORDER BY mapped / n, system LIMIT 10")
def dq_low_coverage(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return audits.low_coverage(t.raw("standards"), t.raw("crosswalk_mappings"), share=0.9)


@query("SELECT grade, count(*) AS n FROM (SELECT DISTINCT id, grade FROM standards) WHERE grade IS NULL OR grade NOT IN ('K','1','2','3','4','5','6','7','8','HS') GROUP BY grade")
def dq_grades(spark, root) -> DataFrame:
    return audits.invalid_grades(Tables(spark, root).raw("standards"))


@query(with_(C, f"b AS (SELECT CASE WHEN confidence_score >= 0.9 THEN '>=.90' WHEN confidence_score >= 0.8 THEN '.80-.90' WHEN confidence_score >= 0.7 THEN '.70-.80' ELSE '<.70' END AS band, count(*) AS n FROM c WHERE {OK_SCORE} GROUP BY ALL)") + "SELECT band, n, round(100.0 * n / (SELECT sum(n) FROM b), 2)::DOUBLE AS pct FROM b")
def dq_bands(spark, root) -> DataFrame:
    return audits.confidence_bands(Tables(spark, root).mappings("confidence_score"))


@query(with_(C) + "SELECT target_id, source_system, count(DISTINCT source_id) AS n FROM c WHERE target_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT source_id) > 3 ORDER BY n DESC, target_id, source_system LIMIT 20")
def dq_collisions(spark, root) -> DataFrame:
    return audits.collisions(Tables(spark, root).mappings("target_id", "source_system", "source_id"))


@query(f"SELECT DISTINCT system FROM standards WHERE system <> '{HUB}' AND system NOT IN (SELECT source_system FROM crosswalk_mappings WHERE source_system IS NOT NULL)")
def dq_no_crosswalk(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return audits.unmapped_systems(t.raw("standards"), t.raw("crosswalk_mappings"), [HUB])


@query(with_(C) + f"SELECT subject, target_system, count(*) AS n FROM c JOIN (SELECT DISTINCT id, subject FROM standards) s ON s.id = c.source_id WHERE subject IN ('mathematics','science','ela','social-studies','cs') AND target_system <> '{HUB}' GROUP BY ALL")
def dq_routing(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return audits.misrouted(t.mappings("source_id", "target_system"), t.raw("standards"), HUBS)


@query(with_(C) + "SELECT source_system, count(*) AS n, count(CASE WHEN regexp_matches(notes, '\\[(?:LLM score|exact-match) (\\d)/5\\]') THEN 1 END) AS scored, round(100.0 * count(CASE WHEN regexp_matches(notes, '\\[(?:LLM score|exact-match) (\\d)/5\\]') THEN 1 END) / count(*), 2)::DOUBLE AS pct FROM c GROUP BY ALL")
def dq_score_cov(spark, root) -> DataFrame:
    return audits.score_coverage(Tables(spark, root).mappings("source_system", "notes"))


@query(with_("y AS (SELECT DISTINCT id, system, md5(trim(lower(regexp_replace(standard_text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) || '|' || grade) AS k FROM standards WHERE trim(standard_text) <> '' AND grade IS NOT NULL)", "z AS (SELECT id, min(id) OVER (PARTITION BY system, k) AS first_id FROM y)") + "SELECT id, first_id FROM z WHERE id <> first_id")
def dq_exact_dupes(spark, root) -> DataFrame:
    return maintain.exact_duplicates(Tables(spark, root).raw("standards").where("grade is not null"))


@query(with_(C, "b AS (SELECT source_id AS id, max(confidence_score) AS best FROM c WHERE NOT isnan(confidence_score) GROUP BY 1)", f"g AS (SELECT system, count(*) AS n, count(CASE WHEN best IS NULL THEN 1 END) AS unmapped, count(CASE WHEN best < 0.7 THEN 1 END) AS below, count(CASE WHEN best >= 0.7 THEN 1 END) AS usable FROM (SELECT DISTINCT id, system FROM standards WHERE system <> '{HUB}') s LEFT JOIN b ON b.id = s.id GROUP BY system)") + "SELECT *, round(usable / n, 4)::DOUBLE AS coverage FROM g ORDER BY usable / n, system LIMIT 20")
def dq_gap(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return audits.gaps(t.raw("standards"), t.mappings("source_id", "confidence_score"), [HUB])


@query("SELECT DISTINCT id FROM crosswalk_mappings WHERE abs(grade_delta) > 2")
def dq_delta_outliers(spark, root) -> DataFrame:
    return audits.delta_outliers(Tables(spark, root).raw("crosswalk_mappings"), 2)


@query("SELECT system FROM (VALUES ('valm-core'), ('zz'), ('yy')) x(system) WHERE system NOT IN (SELECT system FROM standards)")
def dq_states(spark, root) -> DataFrame:
    return audits.absent_codes(Tables(spark, root).raw("standards"), ["valm-core", "zz", "yy"])


@query(with_(S) + "SELECT DISTINCT id FROM s WHERE contains(lower(standard_text), 'fraction') AND id IN (SELECT source_id FROM standard_relationships)")
def dq_spot(spark, root) -> DataFrame:
    t = Tables(spark, root)
    hit = t.raw("standards").where(F.lower("standard_text").contains("fraction")).select("id").distinct()
    return hit.join(t.raw("standard_relationships").select(F.col("source_id").alias("id")), "id", "left_semi")
