"""Scans, filters, projections, joins, aggregates, rankings and set operations over the curriculum tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grades import GRADE_ORDER, alignment, grade_export_rank, grade_rank
from ..functions.notes import quality
from ..operators import orphans, ranking, upsert
from ..plans.tools import filtered, scoped
from .registry import ALL, HUB, HUBS, OK_SCORE, C, E, S, Tables, U, query, rank_sql, with_



def _n() -> Column:
    return F.count("*").alias("n")


@query()
def p6_found(spark, root) -> DataFrame:
    t = Tables(spark, root)
    refs = orphans.reference_fields(t.raw("crosswalk_mappings"), t.raw("standard_relationships"), t.raw("sub_standards"))
    return orphans.find_orphans(refs, t.raw("standards"), t.raw("retired_standards"))


_REFS = """refs AS (SELECT 'crosswalk_mappings' AS tbl, 'target_id' AS fld, id::VARCHAR AS row_key, target_id AS ref, created_at FROM crosswalk_mappings
 UNION ALL SELECT 'standard_relationships', 'source_id', id::VARCHAR, source_id, created_at FROM standard_relationships
 UNION ALL SELECT 'standard_relationships', 'target_id', id::VARCHAR, target_id, created_at FROM standard_relationships
 UNION ALL SELECT 'sub_standards', 'parent_id', id, parent_id, created_at FROM sub_standards),
 p AS (SELECT id, min(created_at) AS born FROM standards GROUP BY id),
 found AS (SELECT DISTINCT tbl, fld, row_key, coalesce(strftime(created_at, '%Y-%m'), 'unknown') AS period,
 CASE WHEN p.id IS NOT NULL THEN 'late' WHEN ref IN (SELECT id FROM retired_standards WHERE id IS NOT NULL) THEN 'deleted' ELSE 'missing' END AS kind
 FROM refs LEFT JOIN p ON ref = p.id WHERE trim(ref) <> '' AND (p.id IS NULL OR created_at < born))"""
ALL["p6_found"] = (p6_found, with_(_REFS) + "SELECT * FROM found")


@query(with_(_REFS) + "SELECT tbl, fld, period, kind, count(*) AS n FROM found GROUP BY ALL")
def p6_report(spark, root) -> DataFrame:
    return orphans.orphan_report(p6_found(spark, root))


@query("SELECT DISTINCT id, system, grade, domain FROM standards WHERE system = 'valm-core' AND subject = 'mathematics'")
def src_table(spark, root) -> DataFrame:
    return Tables(spark, root).raw("standards").where("system = 'valm-core' and subject = 'mathematics'").select("id", "system", "grade", "domain").distinct()


@query("SELECT DISTINCT s.id, s.system, s.standard_text FROM standards s WHERE id IN (SELECT target_id FROM prereq_gold_sample)")
def src_pk_lookup(spark, root) -> DataFrame:
    t = Tables(spark, root)
    keys = t.raw("prereq_gold_sample").select(F.col("target_id").alias("id"))
    return t.standards("id", "system", "standard_text").join(keys, "id", "left_semi")


@query(with_(S) + "SELECT id, system, subject FROM s WHERE system = 'valm-core'")
def flt_scope(spark, root) -> DataFrame:
    return scoped(Tables(spark, root).standards("id", "system", "subject"), HUBS, subject="science")


@query(with_(S) + "SELECT id, grade FROM s WHERE grade IN ('3','4','5','6')")
def flt_grade_set(spark, root) -> DataFrame:
    return filtered(Tables(spark, root).standards("id", "grade"), "3 to 6")


@query(with_(S) + "SELECT id, domain FROM s WHERE contains(lower(domain), 'science')")
def flt_domain_contains(spark, root) -> DataFrame:
    return filtered(Tables(spark, root).standards("id", "domain"), None, "Science")


@query(with_(C) + f"SELECT id, confidence_score FROM c WHERE {OK_SCORE} AND confidence_score >= 0.7")
def flt_threshold(spark, root) -> DataFrame:
    return Tables(spark, root).mappings("confidence_score").where("confidence_score >= 0.7 and not isnan(confidence_score)")


@query(with_(C) + "SELECT id, source_id FROM c WHERE flagged_for_review = 0")
def flt_flagged(spark, root) -> DataFrame:
    return Tables(spark, root).mappings("source_id", "flagged_for_review").where("flagged_for_review = 0").select("id", "source_id")


@query(with_(C) + "SELECT id, notes FROM c WHERE notes ILIKE 'nlp_pass%'")
def flt_like(spark, root) -> DataFrame:
    return Tables(spark, root).mappings("notes").where(F.col("notes").ilike("nlp_pass%"))


@query(with_(S) + "SELECT id, source_url FROM s WHERE NOT (source_url LIKE '%mirror%') AND NOT (id LIKE '%.K.%')")
def flt_not_like(spark, root) -> DataFrame:
    return Tables(spark, root).standards("id", "source_url").where(~F.col("source_url").like("%mirror%") & ~F.col("id").like("%.K.%"))


@query(with_(S) + "SELECT id, system FROM s WHERE system IN ('valm-core','dorn-state','heim-plan')")
def flt_in_list(spark, root) -> DataFrame:
    return Tables(spark, root).raw("standards").where(F.col("system").isin("valm-core", "dorn-state", "heim-plan")).select("id", "system").distinct()


@query(with_(S) + "SELECT id FROM s WHERE (contains(lower(subject || ' ' || domain), 'science') OR contains(lower(subject || ' ' || domain), 'data')) AND NOT contains(lower(subject || ' ' || domain), 'life')")
def flt_subject_kw(spark, root) -> DataFrame:
    text = F.lower(F.concat(F.col("subject"), F.lit(" "), F.col("domain")))
    want = F.exists(F.array(F.lit("science"), F.lit("data")), lambda k: F.contains(text, k))
    return Tables(spark, root).standards("id", "subject", "domain").where(want & ~text.contains("life")).select("id")


@query(with_(S) + "SELECT id FROM s WHERE length(trim(standard_text)) < 20")
def flt_text_len(spark, root) -> DataFrame:
    return Tables(spark, root).standards("id", "standard_text").where("length(trim(standard_text)) < 20").select("id")


@query(with_(S) + "SELECT id FROM s WHERE standard_text IS NULL OR standard_text = ''")
def flt_null_empty(spark, root) -> DataFrame:
    return Tables(spark, root).standards("id", "standard_text").where("standard_text is null or standard_text = ''").select("id")


@query(with_(C) + f"SELECT id FROM c WHERE {OK_SCORE} AND confidence_score >= 0.7 AND confidence_score < 0.85 AND source_system = 'dorn-state' AND flagged_for_review = 0")
def flt_conf_band(spark, root) -> DataFrame:
    asked = {"system": "dorn-state", "low": 0.7, "high": 0.85, "review": False}
    tests = [F.col("source_system") == asked["system"], F.col("confidence_score") >= asked["low"], F.col("confidence_score") < asked["high"], F.col("flagged_for_review") == int(asked["review"])]
    out = Tables(spark, root).mappings("source_system", "confidence_score", "flagged_for_review")
    for test in tests:
        out = out.where(test)
    return out.select("id")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND NOT len(regexp_extract_all(text, '[.]{4,}[ ]*[0-9]+')) >= 5")
def flt_page(spark, root) -> DataFrame:
    from ..functions.text import is_content_page

    return Tables(spark, root).raw("documents").where(is_content_page(F.col("text"))).select("doc_id")


@query(with_(S) + "SELECT id, CASE WHEN grade IN ('K','1','2','3','4','5','6','7','8','HS') THEN grade ELSE 'other' END AS grade_code FROM s WHERE regexp_matches(id, '^[A-Z]{4}[.]')")
def flt_enum(spark, root) -> DataFrame:
    s = Tables(spark, root).standards("id", "grade").where(F.col("id").rlike(r"^[A-Z]{4}[.]"))
    return s.select("id", F.when(F.col("grade").isin(*GRADE_ORDER), F.col("grade")).otherwise("other").alias("grade_code"))


@query(with_(U) + "SELECT DISTINCT id FROM u WHERE id NOT IN (SELECT parent_id FROM u WHERE parent_id IS NOT NULL)")
def flt_leaf(spark, root) -> DataFrame:
    u = Tables(spark, root).subs("id", "parent_id")
    return u.select("id").distinct().join(u.where("parent_id is not null").select(F.col("parent_id").alias("id")), "id", "left_anti")


@query(with_(E) + "SELECT source_id, target_id, relationship, id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, relationship ORDER BY id) AS r FROM e) WHERE r = 1")
def flt_first_seen(spark, root) -> DataFrame:
    e = Tables(spark, root).edges("source_id", "target_id", "relationship", "id")
    return e.groupBy("source_id", "target_id", "relationship").agg(F.min("id").alias("id"))


@query(
    with_(C)
    + "SELECT id, CASE WHEN grade_delta = 0 THEN 'exact' WHEN grade_delta IS NULL THEN NULL ELSE abs(grade_delta)::VARCHAR || CASE WHEN abs(grade_delta) = 1 THEN ' year ' ELSE ' years ' END"
    " || CASE WHEN grade_delta > 0 THEN 'later in target' ELSE 'earlier in target' END END AS alignment FROM c"
)
def prj_case_align(spark, root) -> DataFrame:
    return Tables(spark, root).mappings("grade_delta").select("id", alignment(F.col("grade_delta")).alias("alignment"))


@query(with_(C) + f"SELECT id, CASE WHEN confidence_score >= 0.9 THEN 'high' WHEN confidence_score >= 0.7 THEN 'mid' ELSE 'low' END AS bucket FROM c WHERE {OK_SCORE}")
def prj_case_bucket(spark, root) -> DataFrame:
    c = F.col("confidence_score")
    return Tables(spark, root).mappings("confidence_score").where(c.isNotNull() & ~F.isnan(c)).select("id", F.when(c >= 0.9, "high").when(c >= 0.7, "mid").otherwise("low").alias("bucket"))


@query(with_(C) + "SELECT id, coalesce(notes, 'none') AS notes FROM c")
def prj_coalesce(spark, root) -> DataFrame:
    return Tables(spark, root).mappings("notes").select("id", F.coalesce("notes", F.lit("none")).alias("notes"))


@query(with_(S) + "SELECT id, system || chr(31) || grade || chr(31) || upper(domain) AS k FROM s")
def prj_concat_key(spark, root) -> DataFrame:
    return Tables(spark, root).standards("id", "system", "grade", "domain").select("id", F.concat(F.col("system"), F.lit("\x1f"), F.col("grade"), F.lit("\x1f"), F.upper("domain")).alias("k"))


@query(with_(S) + "SELECT id, id || ' — ' || substr(standard_text, 1, 80) AS label FROM s")
def prj_label(spark, root) -> DataFrame:
    from ..functions.text import label

    return Tables(spark, root).standards("id", "standard_text").select("id", label(F.col("id"), F.col("standard_text")).alias("label"))


@query(with_(S) + "SELECT id, CASE WHEN system IN ('heim-plan','lusk-prov') THEN NULL ELSE standard_text END AS standard_text, system IN ('heim-plan','lusk-prov') AS codes_only FROM s")
def prj_codes_only(spark, root) -> DataFrame:
    closed = F.col("system").isin("heim-plan", "lusk-prov")
    return Tables(spark, root).standards("id", "system", "standard_text").select("id", F.when(closed, None).otherwise(F.col("standard_text")).alias("standard_text"), closed.alias("codes_only"))


@query(with_(S) + "SELECT id, coalesce(nullif(concat_ws('.', nullif(cluster, ''), nullif(domain, '')), ''), md5(coalesce(standard_text, ''))) AS notation FROM s")
def prj_notation_chain(spark, root) -> DataFrame:
    joined = F.nullif(F.concat_ws(".", F.nullif("cluster", F.lit("")), F.nullif("domain", F.lit(""))), F.lit(""))
    return Tables(spark, root).standards("id", "cluster", "domain", "standard_text").select("id", F.coalesce(joined, F.md5(F.coalesce("standard_text", F.lit("")))).alias("notation"))


@query(with_(S) + "SELECT id, unnest(CASE WHEN grade_band = '6-8' THEN ['6','7','8'] WHEN grade_band = '9-12' THEN ['HS'] ELSE [grade] END) AS grade FROM s")
def prj_fanout_grades(spark, root) -> DataFrame:
    arr = lambda *g: F.array(*(F.lit(x) for x in g))
    grades = F.when(F.col("grade_band") == "6-8", arr("6", "7", "8")).when(F.col("grade_band") == "9-12", arr("HS")).otherwise(F.array("grade"))
    return Tables(spark, root).standards("id", "grade_band", "grade").select("id", F.explode(grades).alias("grade"))


@query(with_(S) + "SELECT id, unnest(CASE WHEN subject = 'cs' THEN ['cs-a','cs-b'] WHEN subject = 'mathematics' THEN ['math'] ELSE [] END) AS course FROM s")
def prj_route_targets(spark, root) -> DataFrame:
    arr = lambda *g: F.array(*(F.lit(x) for x in g))
    to = F.when(F.col("subject") == "cs", arr("cs-a", "cs-b")).when(F.col("subject") == "mathematics", arr("math"))
    return Tables(spark, root).standards("id", "subject").select("id", F.explode(to).alias("course"))


# Joins.


@query(with_(S, "m AS (SELECT DISTINCT standard_id, created_at FROM standard_embeddings WHERE model = 'gradus-embed')") + "SELECT DISTINCT s.id, s.system, m.created_at FROM m JOIN s ON s.id = m.standard_id WHERE subject = 'mathematics'")
def jn_inner_emb(spark, root) -> DataFrame:
    t = Tables(spark, root)
    m = t.raw("standard_embeddings").where("model = 'gradus-embed'").select(F.col("standard_id").alias("id"), "created_at").distinct()
    return m.join(t.raw("standards").where("subject = 'mathematics'").select("id", "system").distinct(), "id").select("id", "system", "created_at").distinct()


@query(with_(C, S) + "SELECT DISTINCT c.id, s.grade, s.standard_text FROM c JOIN s ON s.id = c.target_id")
def jn_inner_target(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return t.mappings("target_id").join(t.standards("id", "grade", "standard_text").withColumnRenamed("id", "target_id"), "target_id").select("id", "grade", "standard_text")


@query(with_(C, S) + "SELECT s.system, s.subject, count(*) AS n FROM c JOIN (SELECT DISTINCT id, system, subject FROM s) s ON s.id = c.source_id GROUP BY ALL")
def jn_inner_source(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return t.mappings("source_id").join(t.standards("id", "system", "subject").withColumnRenamed("id", "source_id"), "source_id").groupBy("system", "subject").agg(_n())


@query(with_(C, "x AS (SELECT DISTINCT id, standard_text FROM standards)") + "SELECT c.id, a.standard_text AS source_text, b.standard_text AS target_text FROM c JOIN x a ON a.id = c.source_id JOIN x b ON b.id = c.target_id")
def jn_double(spark, root) -> DataFrame:
    t = Tables(spark, root)
    x = t.standards("id", "standard_text")
    a, b = x.select(F.col("id").alias("source_id"), F.col("standard_text").alias("source_text")), x.select(F.col("id").alias("target_id"), F.col("standard_text").alias("target_text"))
    return t.mappings("source_id", "target_id").join(a, "source_id").join(b, "target_id").select("id", "source_text", "target_text")


@query(
    with_(C, "h AS (SELECT DISTINCT source_id, source_system, target_id FROM c WHERE relationship = 'equivalent' AND trim(target_id) <> '' AND source_id IS NOT NULL)")
    + "SELECT a.source_id AS left_id, b.source_id AS right_id, a.target_id AS hub_id FROM h a JOIN h b ON a.target_id = b.target_id AND a.source_system < b.source_system"
)
def jn_self_bridge(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("source_id", "source_system", "target_id", "relationship").where("relationship = 'equivalent' and trim(target_id) <> '' and source_id is not null")
    h = c.select("source_id", "source_system", "target_id").distinct()
    a, b = h.select(F.col("source_id").alias("left_id"), F.col("source_system").alias("x"), "target_id"), h.select(F.col("source_id").alias("right_id"), F.col("source_system").alias("y"), "target_id")
    return a.join(b, "target_id").where("x < y").select("left_id", "right_id", F.col("target_id").alias("hub_id"))


@query(with_(S) + "SELECT DISTINCT id FROM s WHERE id NOT IN (SELECT standard_id FROM standard_embeddings WHERE standard_id IS NOT NULL)")
def jn_left_pending(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return t.standards("id").join(t.raw("standard_embeddings").select(F.col("standard_id").alias("id")), "id", "left_anti")


@query(with_(C) + "SELECT system, count(DISTINCT s.id) AS n, count(DISTINCT c.source_id) AS mapped FROM (SELECT DISTINCT id, system FROM standards) s LEFT JOIN c ON c.source_id = s.id GROUP BY system")
def jn_left_count(spark, root) -> DataFrame:
    t = Tables(spark, root)
    mapped = t.raw("crosswalk_mappings").select(F.col("source_id").alias("id")).distinct().withColumn("m", F.lit(1))
    return t.standards("id", "system").join(mapped, "id", "left").groupBy("system").agg(_n(), F.count("m").alias("mapped"))


@query(with_(S) + "SELECT DISTINCT system, CASE WHEN system LIKE 'valm%' THEN 'Valmere' WHEN system LIKE '%-moe' THEN 'ministry' ELSE NULL END AS country FROM s")
def jn_left_meta(spark, root) -> DataFrame:
    s = Tables(spark, root).standards("system")
    meta = spark.sql("select * from values ('valm-core', 'Valmere') as m(system, country)")
    return s.join(F.broadcast(meta), "system", "left").select("system", F.coalesce("country", F.when(F.col("system").like("valm%"), "Valmere").when(F.col("system").endswith("-moe"), "ministry")).alias("country"))


@query(with_(S) + "SELECT country, region, count(*) AS n FROM (SELECT DISTINCT id, system FROM s) x JOIN (VALUES ('valm-core','Valmere'),('dorn-state','Dornwick'),('heim-plan','Heimbruck')) m(system, country) USING (system) JOIN (VALUES ('Valmere','West'),('Heimbruck','East')) r(country, region) USING (country) GROUP BY ALL")
def jn_country(spark, root) -> DataFrame:
    country = spark.sql("select * from values ('valm-core','Valmere'),('dorn-state','Dornwick'),('heim-plan','Heimbruck') as m(system, country)")
    region = spark.sql("select * from values ('Valmere','West'),('Heimbruck','East') as r(country, region)")
    return Tables(spark, root).standards("id", "system").join(F.broadcast(country), "system").join(F.broadcast(region), "country").groupBy("country", "region").agg(_n())


@query(with_(U) + "SELECT id, parent_id FROM u WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM standards WHERE id IS NOT NULL)")
def jn_anti_notin(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return t.subs("id", "parent_id").where("parent_id is not null").join(t.raw("standards").select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "parent_id")


@query(with_(E) + "SELECT id FROM e WHERE NOT EXISTS (SELECT 1 FROM standards s WHERE s.id = e.target_id)")
def jn_anti_notexists(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return t.edges("id", "target_id").join(t.raw("standards").select(F.col("id").alias("target_id")), "target_id", "left_anti").select("id")


@query(with_(C) + "SELECT id FROM c WHERE source_id IN (SELECT id FROM standards) AND target_id IN (SELECT id FROM standards)")
def jn_semi_in(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return upsert.cascade(t.mappings("source_id", "target_id"), t.raw("standards"), "source_id", "target_id").select("id")


@query(with_(S) + "SELECT DISTINCT id FROM s WHERE EXISTS (SELECT 1 FROM sub_standards u WHERE u.parent_id = s.id)")
def jn_semi_exists(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return t.standards("id").join(t.raw("sub_standards").select(F.col("parent_id").alias("id")), "id", "left_semi")


@query(with_(E) + "SELECT a.id FROM e a LEFT JOIN (SELECT DISTINCT source_id, target_id, relationship FROM e WHERE method = 'llm_prereq') b ON a.source_id = b.source_id AND a.target_id = b.target_id AND a.relationship = b.relationship WHERE b.source_id IS NULL")
def jn_loj_isnull(spark, root) -> DataFrame:
    e = Tables(spark, root).edges("id", "source_id", "target_id", "relationship", "method")
    k = ["source_id", "target_id", "relationship"]
    return e.join(e.where("method = 'llm_prereq'").select(*k), k, "left_anti").select("id")


@query(with_(S, "k AS (SELECT id, regexp_replace(upper(id), '[.][A-Z]([.][0-9])', '\\1', 'g') AS loose FROM (SELECT DISTINCT id FROM s))") + "SELECT loose, min(id) AS id, count(*) AS n FROM k GROUP BY loose")
def jn_loose_id(spark, root) -> DataFrame:
    from ..functions.text import loose_id

    return Tables(spark, root).standards("id").select("id", loose_id(F.col("id")).alias("loose")).groupBy("loose").agg(F.min("id").alias("id"), _n())


@query(with_(U, "d AS (SELECT DISTINCT id, domain, cluster FROM standards)") + "SELECT u.id, u.parent_id, d.domain, d.cluster FROM u JOIN d ON d.id = u.parent_id")
def jn_ancestor(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return t.subs("id", "parent_id").join(t.standards("id", "domain", "cluster").withColumnRenamed("id", "parent_id"), "parent_id").select("id", "parent_id", "domain", "cluster")


@query(
    with_(E, "g AS (SELECT DISTINCT target_id, prereq_id FROM prereq_gold_sample)", "l AS (SELECT source_id || '|' || target_id AS k, max(confidence_score) AS conf FROM e WHERE relationship = 'prerequisite' AND NOT isnan(confidence_score) GROUP BY 1)")
    + "SELECT g.target_id, g.prereq_id, l.conf FROM g LEFT JOIN l ON l.k = g.target_id || '|' || g.prereq_id"
)
def jn_label_join(spark, root) -> DataFrame:
    t = Tables(spark, root)
    g = t.raw("prereq_gold_sample").select("target_id", "prereq_id").distinct().withColumn("k", F.concat(F.col("target_id"), F.lit("|"), F.col("prereq_id")))
    e = t.edges("id", "source_id", "target_id", "relationship", "confidence_score").where("relationship = 'prerequisite' and not isnan(confidence_score)")
    labels = e.groupBy(F.concat(F.col("source_id"), F.lit("|"), F.col("target_id")).alias("k")).agg(F.max("confidence_score").alias("conf"))
    return g.join(labels, "k", "left").select("target_id", "prereq_id", "conf")


@query(
    with_(E, "d AS (SELECT DISTINCT id, domain FROM standards WHERE domain <> '')")
    + "SELECT a.domain AS from_domain, b.domain AS to_domain, max(CASE WHEN e.confidence_score >= 0.9 AND NOT isnan(e.confidence_score) THEN 1 ELSE 0 END)::INTEGER AS hard FROM e JOIN d a ON a.id = e.source_id JOIN d b ON b.id = e.target_id WHERE a.domain <> b.domain GROUP BY ALL"
)
def jn_concept_expand(spark, root) -> DataFrame:
    t = Tables(spark, root)
    d = t.standards("id", "domain").where("domain <> ''")
    e = t.edges("source_id", "target_id", "confidence_score")
    j = e.join(d.select(F.col("id").alias("source_id"), F.col("domain").alias("from_domain")), "source_id").join(d.select(F.col("id").alias("target_id"), F.col("domain").alias("to_domain")), "target_id")
    hard = (F.col("confidence_score") >= 0.9) & ~F.isnan("confidence_score")
    return j.where("from_domain <> to_domain").groupBy("from_domain", "to_domain").agg(F.max(F.when(hard, 1).otherwise(0)).alias("hard"))


# Aggregates.


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM standards)) AS standards, (SELECT count(DISTINCT id) FROM crosswalk_mappings) AS crosswalks")
def agg_count(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return t.standards().agg(F.count("*").alias("standards")).join(t.raw("crosswalk_mappings").agg(F.countDistinct("id").alias("crosswalks")), F.lit(True))


@query("SELECT count(DISTINCT system) AS systems, count(DISTINCT id) AS standards FROM standards")
def agg_count_distinct(spark, root) -> DataFrame:
    return Tables(spark, root).raw("standards").agg(F.countDistinct("system").alias("systems"), F.countDistinct("id").alias("standards"))


@query(with_(S) + "SELECT system, subject, grade, count(*) AS n FROM s GROUP BY ALL")
def agg_group_count(spark, root) -> DataFrame:
    return Tables(spark, root).standards().groupBy("system", "subject", "grade").agg(_n())


@query("SELECT system, string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects FROM standards GROUP BY system")
def agg_group_concat(spark, root) -> DataFrame:
    return Tables(spark, root).raw("standards").groupBy("system").agg(F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("subjects"))


@query(with_(S) + "SELECT system, domain, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 10")
def agg_having(spark, root) -> DataFrame:
    return Tables(spark, root).standards().groupBy("system", "domain").agg(_n()).where("n > 10")


@query(with_(C) + "SELECT source_system, count(*) AS n, count(CASE WHEN flagged_for_review = 1 THEN 1 END) AS flagged, count(DISTINCT CASE WHEN confidence_score >= 0.9 AND NOT isnan(confidence_score) THEN source_id END) AS strong FROM c GROUP BY ALL")
def agg_conditional(spark, root) -> DataFrame:
    strong = (F.col("confidence_score") >= 0.9) & ~F.isnan("confidence_score")
    c = Tables(spark, root).mappings("source_system", "source_id", "flagged_for_review", "confidence_score")
    return c.groupBy("source_system").agg(_n(), F.count_if(F.col("flagged_for_review") == 1).alias("flagged"), F.countDistinct(F.when(strong, F.col("source_id"))).alias("strong"))


@query(with_(C) + f"SELECT target_system, round(avg(confidence_score), 6) AS mean FROM c WHERE {OK_SCORE} GROUP BY ALL")
def agg_avg(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("target_system", "confidence_score").where("confidence_score is not null and not isnan(confidence_score)")
    return c.groupBy("target_system").agg(F.round(F.avg("confidence_score"), 6).alias("mean"))


@query(with_(C) + f"SELECT source_id, max(confidence_score) AS best FROM c WHERE {OK_SCORE} GROUP BY ALL")
def agg_max_group(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("source_id", "confidence_score").where("confidence_score is not null and not isnan(confidence_score)")
    return c.groupBy("source_id").agg(F.max("confidence_score").alias("best"))


@query(with_(C) + f"SELECT source_id, target_system, target_id, confidence_score FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_system ORDER BY confidence_score DESC, target_id NULLS LAST, id) AS r FROM c WHERE {OK_SCORE}) WHERE r = 1")
def agg_argmax(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("source_id", "target_system", "target_id", "confidence_score").where("confidence_score is not null and not isnan(confidence_score)")
    m = F.min(F.struct((-F.col("confidence_score")).alias("x"), F.col("target_id").isNull().alias("y"), "target_id", "id")).alias("m")
    return c.groupBy("source_id", "target_system").agg(m).select("source_id", "target_system", "m.target_id", (-F.col("m.x")).alias("confidence_score"))


@query(with_(C) + f"SELECT t::INTEGER AS pct, count(CASE WHEN confidence_score * 100 >= t THEN 1 END) AS n FROM c, range(70, 101) r(t) WHERE {OK_SCORE} GROUP BY t")
def agg_cum_threshold(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("confidence_score").where("confidence_score is not null and not isnan(confidence_score)")
    top = F.least(F.floor(F.col("confidence_score") * 100), F.lit(100)).cast("int")
    steps = c.groupBy(top.alias("top")).agg(F.count("*").alias("k"))  # one row a percent, before thresholds multiply anything
    grid = spark.range(70, 101).select(F.col("id").cast("int").alias("pct"))
    j = grid.join(F.broadcast(steps), F.col("top") >= F.col("pct"), "left")
    return j.groupBy("pct").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


@query(with_(C) + f"SELECT (floor(confidence_score * 20) / 20)::DOUBLE AS bucket, count(*) AS n FROM c WHERE {OK_SCORE} GROUP BY ALL")
def agg_histogram(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("confidence_score").where("confidence_score is not null and not isnan(confidence_score)")
    return c.groupBy((F.floor(F.col("confidence_score") * 20) / 20).alias("bucket")).agg(_n())


@query(with_(S) + "SELECT system, depth FROM (SELECT system, depth, row_number() OVER (PARTITION BY system ORDER BY n DESC, depth) AS r FROM (SELECT system, len(string_split(id, '.'))::INTEGER AS depth, count(*) AS n FROM (SELECT DISTINCT id, system FROM s) GROUP BY ALL)) WHERE r = 1")
def agg_mode_depth(spark, root) -> DataFrame:
    s = Tables(spark, root).standards("id", "system").groupBy("system", F.size(F.split("id", r"\.")).alias("depth")).agg(_n())
    return ranking.top_per_group(s, ["system"], [F.col("n").desc(), F.col("depth")], 1).select("system", "depth")


@query(with_(C, S) + "SELECT subject, count(DISTINCT source_system)::BIGINT AS systems, sum(n)::BIGINT AS mappings, string_agg(source_system || '=' || n::VARCHAR, ',' ORDER BY source_system) AS by_system FROM (SELECT x.subject, source_system, count(*) AS n FROM c JOIN (SELECT DISTINCT id, subject FROM s) x ON x.id = c.target_id GROUP BY ALL) GROUP BY subject")
def agg_hub_nested(spark, root) -> DataFrame:
    t = Tables(spark, root)
    one = t.mappings("target_id", "source_system").join(t.standards("id", "subject").withColumnRenamed("id", "target_id"), "target_id").groupBy("subject", "source_system").agg(_n())
    pair = F.concat(F.col("source_system"), F.lit("="), F.col("n").cast("string"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("source_system", pair.alias("p")))), lambda x: x["p"])
    return one.groupBy("subject").agg(F.countDistinct("source_system").alias("systems"), F.sum("n").alias("mappings"), F.array_join(parts, ",").alias("by_system"))


@query(with_(C) + "SELECT source_system, count(CASE WHEN verified_by_human = 0 AND flagged_for_review = 0 THEN 1 END) AS v0_f0, count(CASE WHEN verified_by_human = 0 AND flagged_for_review = 1 THEN 1 END) AS v0_f1, count(CASE WHEN verified_by_human = 1 AND flagged_for_review = 0 THEN 1 END) AS v1_f0, count(CASE WHEN verified_by_human = 1 AND flagged_for_review = 1 THEN 1 END) AS v1_f1 FROM c GROUP BY ALL")
def agg_crosstab(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("source_system", "verified_by_human", "flagged_for_review")
    cells = [F.count_if((F.col("verified_by_human") == v) & (F.col("flagged_for_review") == f)).alias(f"v{v}_f{f}") for v in (0, 1) for f in (0, 1)]
    return c.groupBy("source_system").agg(*cells)


@query(with_(C) + "SELECT source_system, round(100.0 * count(CASE WHEN relationship = 'equivalent' THEN 1 END) / count(*), 4)::DOUBLE AS pct FROM c GROUP BY ALL")
def agg_ratio(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("source_system", "relationship")
    return c.groupBy("source_system").agg(F.round(F.lit(100.0) * F.count_if(F.col("relationship") == "equivalent") / F.count("*"), 4).alias("pct"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL")
def agg_quantile(spark, root) -> DataFrame:
    e = Tables(spark, root).raw("events")
    return e.groupBy("event_type").agg(*(F.expr(f"percentile_disc({p}) within group (order by value)").alias(f"p{round(100 * p)}") for p in (0.5, 0.95)))


@query(with_(S) + f"SELECT system, min_by(grade, {rank_sql('grade')}) AS lowest FROM s WHERE {rank_sql('grade')} < 99 GROUP BY system")
def agg_min_grade(spark, root) -> DataFrame:
    s = Tables(spark, root).standards("system", "grade").withColumn("r", grade_rank(F.col("grade"))).where("r < 99")
    return s.groupBy("system").agg(F.min_by("grade", "r").alias("lowest"))


@query(
    with_(S, "d AS (SELECT DISTINCT system, subject, grade, domain FROM s WHERE domain <> '')", "k AS (SELECT system, domain, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT system, domain FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY n DESC, domain) AS r FROM k) WHERE r = 1)")
    + "SELECT d.system, d.domain, count(*) AS n FROM d JOIN t ON d.system = t.system AND d.domain = t.domain GROUP BY ALL"
)
def agg_dominant_doc(spark, root) -> DataFrame:
    d = Tables(spark, root).standards("system", "subject", "grade", "domain").where("domain <> ''")
    return ranking.top_per_group(d.groupBy("system", "domain").agg(_n()), ["system"], [F.col("n").desc(), F.col("domain")], 1)


@query(with_(S) + "SELECT system, min_by(grade, x) AS lowest, max_by(grade, x) AS highest FROM (SELECT DISTINCT system, grade, CASE WHEN grade = 'K' THEN 0 WHEN grade = 'HS' THEN 13 ELSE try_cast(grade AS INTEGER) END AS x FROM s) WHERE x IS NOT NULL GROUP BY system")
def agg_min_max_grade(spark, root) -> DataFrame:
    s = Tables(spark, root).standards("system", "grade").withColumn("x", grade_export_rank(F.col("grade"))).where("x < 99")
    return s.groupBy("system").agg(F.min_by("grade", "x").alias("lowest"), F.max_by("grade", "x").alias("highest"))


# Rankings.


@query(with_(C) + f"SELECT id, confidence_score FROM c WHERE {OK_SCORE} AND confidence_score <= 1 ORDER BY confidence_score DESC, id DESC LIMIT 50")
def topk_global(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("confidence_score").where("confidence_score <= 1 and not isnan(confidence_score)")
    return c.orderBy(F.col("confidence_score").desc(), F.col("id").desc()).limit(50)


@query(with_(C) + f"SELECT source_id, target_id, r::INTEGER AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY confidence_score DESC, id) AS r FROM c WHERE {OK_SCORE} AND abs(grade_delta) <= 2) WHERE r <= 3")
def topk_group(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("source_id", "target_id", "confidence_score", "grade_delta").where("not isnan(confidence_score) and confidence_score is not null and abs(grade_delta) <= 2")
    return ranking.ranked(c, ["source_id"], [F.col("confidence_score").desc(), F.col("id")], "rank_no").where("rank_no <= 3").select("source_id", "target_id", "rank_no")


@query(with_(C) + f"SELECT source_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY confidence_score DESC, id) AS r FROM c WHERE {OK_SCORE}) WHERE r = 1 AND abs(grade_delta) <= 1")
def top1_group_post(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("source_id", "target_id", "confidence_score", "grade_delta").where("not isnan(confidence_score) and confidence_score is not null")
    return ranking.top_per_group(c, ["source_id"], [F.col("confidence_score").desc(), F.col("id")], 1).where("abs(grade_delta) <= 1").select("source_id", "target_id")


@query(with_(C) + f"SELECT id, source_id FROM c WHERE {OK_SCORE} ORDER BY confidence_score, id LIMIT 1")
def first_row(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("source_id", "confidence_score").where("not isnan(confidence_score) and confidence_score is not null")
    return c.orderBy("confidence_score", "id").limit(1).select("id", "source_id")


@query(with_(C) + f"SELECT target_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY confidence_score DESC, id) AS r FROM c WHERE {OK_SCORE} AND trim(target_id) <> '') WHERE r = 1 ORDER BY confidence_score DESC, target_id LIMIT 100")
def dedupe_keep_best(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("source_id", "target_id", "confidence_score").where("not isnan(confidence_score) and confidence_score is not null and trim(target_id) <> ''")
    best = ranking.top_per_group(c, ["target_id"], [F.col("confidence_score").desc(), F.col("id")], 1)
    return best.orderBy(F.col("confidence_score").desc(), "target_id").limit(100).select("target_id", "source_id")


@query(with_(S, f"g AS (SELECT DISTINCT system, domain, {rank_sql('grade')} AS rank FROM s WHERE {rank_sql('grade')} < 99)") + "SELECT system, domain, rank::INTEGER AS rank, (lead(rank) OVER (PARTITION BY system, domain ORDER BY rank))::INTEGER AS next_rank FROM g")
def win_lead_grade(spark, root) -> DataFrame:
    g = Tables(spark, root).standards("system", "domain", "grade").select("system", "domain", grade_rank(F.col("grade")).alias("rank")).where("rank < 99").distinct()
    return g.withColumn("next_rank", F.lead("rank").over(Window.partitionBy("system", "domain").orderBy("rank")))


@query("SELECT event_id, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN event_type END AS h FROM events)")
def win_fill_forward(spark, root) -> DataFrame:
    e = Tables(spark, root).raw("events").select("event_id", "user_id", F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("header"))
    return ranking.fill_forward(e, ["user_id"], "event_id", "header").select("event_id", "header")


@query(with_(U, "x AS (SELECT id, parent_id, position, text, row_number() OVER (PARTITION BY parent_id ORDER BY position, id) AS r FROM u WHERE parent_id IS NOT NULL AND text IS NOT NULL)") + "SELECT parent_id, ((r - 1) // 3)::INTEGER AS chunk, string_agg(text, chr(10) ORDER BY r) AS text FROM x GROUP BY ALL")
def win_chunk(spark, root) -> DataFrame:
    u = Tables(spark, root).subs("id", "parent_id", "position", "text").where("parent_id is not null and text is not null")
    return ranking.chunked(u.withColumn("at", F.struct("position", "id")), ["parent_id"], "at", "text", 3)


@query(with_(U) + "SELECT id, parent_id || '-' || lpad((row_number() OVER (PARTITION BY parent_id ORDER BY position, id))::VARCHAR, 3, '0') AS seq_id FROM u WHERE parent_id IS NOT NULL")
def win_seq(spark, root) -> DataFrame:
    u = Tables(spark, root).subs("id", "parent_id", "position").where("parent_id is not null")
    r = ranking.ranked(u, ["parent_id"], [F.col("position"), F.col("id")], "r")
    return r.select("id", F.concat(F.col("parent_id"), F.lit("-"), F.lpad(F.col("r").cast("string"), 3, "0")).alias("seq_id"))


@query("SELECT system, id FROM (SELECT system, id, row_number() OVER (PARTITION BY system ORDER BY md5('42:' || id), id) AS r FROM (SELECT DISTINCT system, id FROM standards)) WHERE r <= 10")
def win_topn_sample(spark, root) -> DataFrame:
    return ranking.sampled(Tables(spark, root).standards("system", "id"), ["system"], "id", 10)


@query(with_(C) + f"SELECT id, row_number() OVER (ORDER BY coalesce(try_cast(nullif(regexp_extract(notes, '\\[(?:LLM score|exact-match) (\\d)/5\\]', 1), '') AS INTEGER), 3) DESC, confidence_score DESC, id) AS pos FROM c WHERE {OK_SCORE} AND target_system = 'valm-core' AND source_system = 'dorn-state'")
def sort_multi(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("notes", "confidence_score", "source_system", "target_system").where("not isnan(confidence_score) and confidence_score is not null and target_system = 'valm-core' and source_system = 'dorn-state'")
    w = Window.partitionBy("target_system").orderBy(F.coalesce(quality(F.col("notes")), F.lit(3)).desc(), F.col("confidence_score").desc(), "id")
    return c.select("id", F.row_number().over(w).cast("long").alias("pos"))


@query(with_(S) + f"SELECT id, row_number() OVER (PARTITION BY system ORDER BY {rank_sql('grade')}, id) AS pos FROM (SELECT DISTINCT id, system, grade FROM s)")
def sort_grade_id(spark, root) -> DataFrame:
    s = Tables(spark, root).standards("id", "system", "grade")
    return s.select("id", F.row_number().over(Window.partitionBy("system").orderBy(grade_rank(F.col("grade")), "id")).cast("long").alias("pos"))


# Set operations and sampling.


@query("SELECT source_id AS id FROM standard_relationships WHERE source_id IS NOT NULL UNION SELECT target_id FROM standard_relationships WHERE target_id IS NOT NULL")
def set_union_distinct(spark, root) -> DataFrame:
    e = Tables(spark, root).raw("standard_relationships")
    return e.select(F.explode(F.array("source_id", "target_id")).alias("id")).where("id is not null").distinct()


@query(with_(C) + "SELECT source_id, target_id FROM c UNION ALL SELECT target_id, source_id FROM c")
def set_union_all(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("source_id", "target_id").select("source_id", "target_id")
    return c.unionByName(c.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))


@query("SELECT source_id AS id FROM crosswalk_mappings WHERE source_id IS NOT NULL INTERSECT SELECT target_id FROM standard_relationships WHERE target_id IS NOT NULL")
def set_intersect(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return t.raw("crosswalk_mappings").select(F.col("source_id").alias("id")).distinct().join(t.raw("standard_relationships").select(F.col("target_id").alias("id")), "id", "left_semi")


@query("SELECT id FROM standards WHERE id IS NOT NULL EXCEPT SELECT source_id FROM crosswalk_mappings")
def set_difference(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return t.standards("id").join(t.raw("crosswalk_mappings").select(F.col("source_id").alias("id")), "id", "left_anti")


@query("SELECT system, string_agg(DISTINCT grade, ',' ORDER BY grade) AS grades FROM standards GROUP BY system")
def set_dedupe(spark, root) -> DataFrame:
    return Tables(spark, root).raw("standards").groupBy("system").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_set("grade"))), ",").alias("grades"))


@query(with_(C) + f"SELECT tier, id FROM (SELECT CASE WHEN confidence_score >= 0.85 THEN 'high' WHEN confidence_score >= 0.7 THEN 'mid' ELSE 'low' END AS tier, id, row_number() OVER (PARTITION BY CASE WHEN confidence_score >= 0.85 THEN 'high' WHEN confidence_score >= 0.7 THEN 'mid' ELSE 'low' END ORDER BY id) AS r FROM c WHERE {OK_SCORE}) WHERE r <= 20")
def smp_tier(spark, root) -> DataFrame:
    x = F.col("confidence_score")
    c = Tables(spark, root).mappings("confidence_score").where("not isnan(confidence_score) and confidence_score is not null").select("id", F.when(x >= 0.85, "high").when(x >= 0.7, "mid").otherwise("low").alias("tier"))
    return ranking.top_per_group(c, ["tier"], [F.col("id")], 20).select("tier", "id")


@query(with_(C) + "SELECT id, (id % 4)::INTEGER AS part FROM c")
def smp_residue(spark, root) -> DataFrame:
    return Tables(spark, root).mappings("source_id").select("id", F.pmod("id", F.lit(4)).cast("int").alias("part"))


@query("SELECT id FROM (SELECT DISTINCT id FROM standards) ORDER BY id LIMIT 25")
def smp_first_n(spark, root) -> DataFrame:
    return Tables(spark, root).standards("id").orderBy("id").limit(25)


# Writes as frames.


@query(
    "WITH b AS (SELECT DISTINCT id, grade, system FROM standards), n AS (SELECT id, 'X' AS grade, system FROM b WHERE system = 'heim-plan' UNION ALL SELECT id, 'R', system FROM retired_standards WHERE id NOT IN (SELECT id FROM b)) SELECT * FROM b WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n"
)
def snk_replace(spark, root) -> DataFrame:
    t = Tables(spark, root)
    base = t.standards("id", "grade", "system")
    new = base.where("system = 'heim-plan'").withColumn("grade", F.lit("X")).unionByName(t.raw("retired_standards").select("id", F.lit("R").alias("grade"), "system").join(base.select("id"), "id", "left_anti"))
    return upsert.replace_rows(base, new.select(*base.columns), ["id"])


@query(with_(S) + "SELECT id, system FROM s WHERE NOT (system = 'heim-plan' AND subject = 'cs')")
def snk_delete_scope(spark, root) -> DataFrame:
    s = Tables(spark, root).standards("id", "system", "subject")
    return upsert.delete_where(s, (F.col("system") == "heim-plan") & (F.col("subject") == "cs")).select("id", "system")


@query(with_(C) + "SELECT id, CASE WHEN confidence_score < 0.5 AND NOT isnan(confidence_score) THEN 1 ELSE flagged_for_review END AS flagged_for_review FROM c")
def snk_update_set(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("flagged_for_review", "confidence_score")
    patch = c.where("confidence_score < 0.5 and not isnan(confidence_score)").select("id", F.lit(1).alias("flagged_for_review"))
    return upsert.update_set(c, patch, ["id"], ["flagged_for_review"]).select("id", "flagged_for_review")


@query("SELECT DISTINCT id, parent_id FROM sub_standards WHERE parent_id IN (SELECT id FROM standards)")
def snk_cascade(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return upsert.cascade(t.subs("id", "parent_id"), t.raw("standards"), "parent_id").select("id", "parent_id")


@query("SELECT c_mktsegment, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def star_join(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return t.raw("customer").join(F.broadcast(t.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


assert HUB
