"""Sources, sinks and the remaining operators; inputs that the test tables lack are built from them by rule."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grades, text
from ..operators import graph, upsert, vectors
from ..operators.lineage import ensure_checkpoint_dir
from ..plans import maintain, tools
from ..sources import hierarchy, sinks
from ..streaming import incremental
from .registry import HUB, C, E, S, Tables, U, V, query, with_
from .similarity import _R, _SP, _SQ, _cos, standard_probe

def scratch(spark) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


@query("SELECT (event_id // 100)::BIGINT AS page, (row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1)::INTEGER AS at, event_id FROM events")
def src_rest_paged(spark, root) -> DataFrame:
    e = Tables(spark, root).raw("events").select(F.floor(F.col("event_id") / 100).alias("page"), "event_id")
    body = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("event_id"))).alias("items")))
    landed = e.groupBy("page").agg(body.alias("json")).withColumn("service", F.lit("events"))
    return hierarchy.paged_items(landed, "service", "page", "json", "struct<event_id:bigint>").select("page", "at", "item.event_id")


@query(with_(U) + "SELECT DISTINCT parent_id, id, text FROM u WHERE parent_id IS NOT NULL AND text IS NOT NULL")
def src_map_or_list(spark, root) -> DataFrame:
    u = Tables(spark, root).subs("parent_id", "id", "text").where("parent_id is not null and text is not null")
    node = F.struct(F.col("id"), F.col("text").alias("description"))
    g = u.groupBy("parent_id").agg(F.collect_list(node).alias("ns"))
    as_map = F.to_json(F.struct(F.struct(F.map_from_entries(F.transform("ns", lambda n: F.struct(n["id"], n))).alias("standards")).alias("data")))
    as_list = F.to_json(F.struct(F.struct(F.col("ns").alias("standards")).alias("data")))
    j = g.select("parent_id", F.when(F.length("parent_id") % 2 == 0, as_map).otherwise(as_list).alias("json"))
    return j.select("parent_id", F.explode(hierarchy.node_set(F.col("json"))).alias("n")).select("parent_id", "n.id", F.col("n.description").alias("text"))


def _nodes(t: Tables) -> DataFrame:
    """Domains (depth 0), clusters (1), standards (2) and their parts (3) as one tree for each system."""
    s = t.standards("id", "system", "domain", "cluster").select("id", "system", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("cluster", F.lit("")).alias("cluster"))
    none, names = F.lit(None).cast("string"), F.array().cast("array<string>")
    dom, clu = F.concat_ws("|", "system", "domain"), F.concat_ws("|", "system", "domain", "cluster")

    def node(df, ident, notation, description, depth, parent, ancestors):
        return df.select(F.col("system").alias("set_id"), ident.alias("id"), notation.alias("notation"), description.alias("description"), F.lit(depth).alias("depth"), parent.alias("parent"), ancestors.alias("ancestors"), F.lit(0).alias("position"))

    u = t.subs("id", "parent_id", "text").groupBy("id").agg(F.min("parent_id").alias("parent_id"), F.min("text").alias("text")).join(s.select(F.col("id").alias("parent_id"), "system"), "parent_id")
    return (
        node(s.select("system", "domain").distinct(), dom, none, F.col("domain"), 0, none, names)
        .unionByName(node(s.select("system", "domain", "cluster").distinct(), clu, none, F.col("cluster"), 1, dom, F.array(dom)))
        .unionByName(node(s, F.col("id"), F.col("id"), F.col("id"), 2, clu, F.array(dom, clu)))
        .unionByName(node(u, F.col("id"), F.lit(None).cast("string"), F.col("text"), 3, F.col("parent_id"), names))
    )


_TREE = "SELECT DISTINCT system AS set_id, id, coalesce(domain, '') AS domain, coalesce(cluster, '') AS cluster FROM standards"


@query(_TREE)
def src_hier_auto(spark, root) -> DataFrame:
    return hierarchy.flatten_tree(_nodes(Tables(spark, root))).select("set_id", "id", "domain", "cluster")


@query("SELECT DISTINCT id, CASE WHEN regexp_matches(replace(id, '.', '-'), '(?:^|-)PS') THEN 'Physical' WHEN regexp_matches(replace(id, '.', '-'), '(?:^|-)LS') THEN 'Life' ELSE 'Science' END AS domain FROM standards WHERE contains(id, '.SCI.')")
def src_hier_regex(spark, root) -> DataFrame:
    s = Tables(spark, root).standards("id").select("id", F.replace("id", F.lit("."), F.lit("-")).alias("notation"))
    return hierarchy.coded_rows(s, "-SCI-", [("PS", "Physical"), ("LS", "Life")], "Science").select("id", "domain")


@query("SELECT doc_id::VARCHAR AS id, length(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def src_llm_extract(spark, root) -> DataFrame:
    """The service is a rule that counts characters: no model is called."""
    d = Tables(spark, root).raw("documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return hierarchy.extracted_rows(d, lambda texts: [f'```json\n[{{"n": {len(t)}}}]\n```' for t in texts], "n bigint").select("id", "n")


@query("SELECT system, max(try_strptime(last_verified_date, '%Y-%m-%d'))::DATE AS last FROM standards GROUP BY system HAVING max(try_strptime(last_verified_date, '%Y-%m-%d')) > DATE '2026-06-24'")
def src_fresh_gate(spark, root) -> DataFrame:
    return incremental.fresh_systems(Tables(spark, root).raw("standards"), "2026-06-30")


@query(with_(C) + "SELECT id, source_id, target_id FROM c WHERE flagged_for_review = 1 AND source_id IS NOT NULL AND trim(target_id) <> ''")
def snk_csv(spark, root) -> DataFrame:
    path = scratch(spark)
    c = Tables(spark, root).mappings("source_id", "target_id", "flagged_for_review").where("flagged_for_review = 1 and source_id is not null and trim(target_id) <> ''")
    sinks.write_csv(c.select("id", "source_id", "target_id"), path)
    return spark.read.option("header", True).schema("id bigint, source_id string, target_id string").csv(path)


@query(with_(C) + "SELECT id, '{\"id\":' || id::VARCHAR || ',\"flagged\":' || flagged_for_review::VARCHAR || '}' AS json FROM c")
def snk_json(spark, root) -> DataFrame:
    return Tables(spark, root).mappings("flagged_for_review").select("id", F.to_json(F.struct("id", F.col("flagged_for_review").alias("flagged"))).alias("json"))


@query("SELECT DISTINCT id, system FROM standards")
def snk_checkpoint(spark, root) -> DataFrame:
    path, s = scratch(spark), Tables(spark, root).standards("id", "system")
    sinks.append_log(s.where("system < 'n'"), path, "id")
    sinks.append_log(s, path, "id")
    return spark.read.schema("id string, system string").json(path)


@query("SELECT DISTINCT id, system FROM standards WHERE system <> 'heim-plan'")
def snk_txn(spark, root) -> DataFrame:
    path, s = scratch(spark), Tables(spark, root).standards("id", "system")
    sinks.write_version(s, path, "v1")
    sinks.write_version(upsert.delete_where(sinks.read_current(spark, path), F.col("system") == "heim-plan"), path, "v2")
    return sinks.read_current(spark, path)


_KEYS = "source_id, target_id, relationship"


@query(with_(E, f"k AS (SELECT {_KEYS}, max(CASE WHEN method = 'llm_prereq' THEN 1 ELSE 0 END) AS up FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY ALL)") + f"SELECT {_KEYS}, CASE WHEN up = 1 THEN 'llm_prereq' ELSE 'other' END AS method FROM k")
def snk_upsert_edges(spark, root) -> DataFrame:
    k = ["source_id", "target_id", "relationship"]
    e = Tables(spark, root).edges(*k, "method").where("source_id is not null and target_id is not null")
    old = e.where("method <> 'llm_prereq' or method is null").select(*k).distinct().withColumn("method", F.lit("other"))
    new = e.where("method = 'llm_prereq'").distinct()
    return upsert.merge_rows(old, new, k, {})


@query("SELECT DISTINCT id FROM standards a WHERE system = 'valm-core' AND NOT EXISTS (SELECT 1 FROM standards b WHERE b.system = 'dorn-state' AND b.grade = a.grade AND b.standard_text = a.standard_text)")
def snk_skip_exists(spark, root) -> DataFrame:
    s = Tables(spark, root).standards("id", "system", "grade", "standard_text")
    return s.where(f"system = '{HUB}'").join(s.where("system = 'dorn-state'").select("grade", "standard_text"), ["grade", "standard_text"], "left_anti").select("id").distinct()


@query(with_(V, _SP, _R) + f"SELECT a.id AS a, b.id AS b, {_cos('a.vec', 'b.vec')} AS cosine FROM r a JOIN r b ON a.subject = b.subject WHERE a.system <> '{HUB}' AND b.system = '{HUB}' AND {_cos('a.vec', 'b.vec')} >= 0.9")
def jn_cross_cosine(spark, root) -> DataFrame:
    r = Tables(spark, root).vector_rows()
    return vectors.similarity_join(r.where(F.col("system") != HUB), r.where(F.col("system") == HUB), "subject", 0.9)


@query(with_(V, _SP, _SQ) + f"SELECT grade, max_by(v.id, {{'s': {_cos('vec', 'qv')}, 'i': v.id}}) AS id FROM v JOIN sp ON v.id = sp.id, q WHERE system = '{HUB}' AND {_cos('vec', 'qv')} >= 0.4 GROUP BY grade")
def best1_per_grade(spark, root) -> DataFrame:
    t = Tables(spark, root)
    rows = t.vectors().join(t.standards("id", "system", "grade").where(F.col("system") == HUB), "id")
    scored = rows.select("id", "grade", F.round(vectors.cosine_to(F.col("vec"), standard_probe(t)), 4).alias("s")).where("s >= 0.4")
    return scored.groupBy("grade").agg(F.max_by("id", F.struct("s", "id")).alias("id"))


@query("SELECT doc_id, regexp_extract_all(text, 'Fig[.] [0-9]+')[-1] AS header FROM documents WHERE text IS NOT NULL")
def win_header_rule(spark, root) -> DataFrame:
    return Tables(spark, root).raw("documents").where("text is not null").select("doc_id", hierarchy.last_header(F.col("text"), r"Fig[.] [0-9]+").alias("header"))


@query(with_(S) + "SELECT system, grade, row_number() OVER (PARTITION BY system ORDER BY CASE WHEN grade = 'K' THEN 0 WHEN grade = 'HS' THEN 99 ELSE coalesce(try_cast(grade AS INTEGER), 100) END, grade) AS pos FROM (SELECT DISTINCT system, grade FROM s WHERE grade IS NOT NULL)")
def sort_case(spark, root) -> DataFrame:
    s = Tables(spark, root).standards("system", "grade").where("grade is not null")
    key = F.when(F.col("grade") == "K", 0).when(F.col("grade") == "HS", 99).otherwise(F.coalesce(F.col("grade").try_cast("int"), F.lit(100)))
    return s.select("system", "grade", F.row_number().over(Window.partitionBy("system").orderBy(key, "grade")).cast("long").alias("pos"))


@query("SELECT DISTINCT grade_band, string_split(grade_band, '-')[1] AS lo, string_split(grade_band, '-')[2] AS hi FROM standards WHERE grade_band IS NOT NULL")
def txt_range_split(spark, root) -> DataFrame:
    ends = grades.range_ends(F.col("grade_band"))
    return Tables(spark, root).standards("grade_band").where("grade_band is not null").select("grade_band", F.get(ends, F.lit(0)).alias("lo"), F.get(ends, F.lit(1)).alias("hi"))


@query("SELECT DISTINCT domain, CASE domain WHEN 'READING LITERATURE' THEN 'Reading Literature' WHEN 'STATISTICS' THEN 'Statistics' ELSE domain END AS canon FROM standards")
def txt_canon_case(spark, root) -> DataFrame:
    fixed = F.create_map(*(F.lit(x) for x in ("READING LITERATURE", "Reading Literature", "STATISTICS", "Statistics")))
    return Tables(spark, root).standards("domain").select("domain", F.coalesce(F.try_element_at(fixed, F.coalesce("domain", F.lit(""))), "domain").alias("canon"))


@query("SELECT event_id, '[' || event_id::VARCHAR || ']' AS body FROM events")
def txt_fence(spark, root) -> DataFrame:
    e = Tables(spark, root).raw("events")
    return e.select("event_id", text.json_body(F.concat(F.lit("Sure:\n```json\n["), F.col("event_id").cast("string"), F.lit("]\n```"))).alias("body"))


@query("SELECT DISTINCT id, replace(standard_text, chr(65533), '') AS t FROM standards")
def txt_mojibake(spark, root) -> DataFrame:
    return Tables(spark, root).standards("id", "standard_text").select("id", text.without_replacement_char(F.col("standard_text")).alias("t")).distinct()


@query(with_("g AS (SELECT DISTINCT target_id, prereq_id, cosine FROM prereq_gold_sample)", "s AS (SELECT id, min(grade) AS grade FROM standards GROUP BY id)") + "SELECT replace(target_id, '.MATH', '') AS short, prereq_id, s.grade FROM g JOIN s ON s.id = g.target_id")
def mt_gold_sample(spark, root) -> DataFrame:
    t = Tables(spark, root)
    g = t.raw("prereq_gold_sample").select("target_id", "prereq_id", "cosine").distinct()
    s = t.raw("standards").groupBy(F.col("id").alias("target_id")).agg(F.min("grade").alias("grade"))
    return g.join(s, "target_id").select(F.replace("target_id", F.lit(".MATH"), F.lit("")).alias("short"), "prereq_id", "grade")


_ORPHAN = "o AS (SELECT r.* FROM r WHERE id NOT IN (SELECT source_id FROM crosswalk_mappings WHERE source_id IS NOT NULL))"


@query(
    with_(V, _SP, _R, _ORPHAN, f"x AS (SELECT a.id AS a, b.id AS b, {_cos('a.vec', 'b.vec')} AS c, (b.rank - a.rank)::INTEGER AS d FROM o a JOIN o b ON a.subject = b.subject AND a.id < b.id AND a.system <> b.system)", "y AS (SELECT * FROM x WHERE c >= 0.55 AND abs(d) <= 5)")
    + "SELECT a AS source_id, b AS target_id, greatest(c, 0.7)::DOUBLE AS confidence_score, d AS delta FROM y UNION ALL SELECT b, a, greatest(c, 0.7)::DOUBLE, -d FROM y"
)
def mt_direct_pilot(spark, root) -> DataFrame:
    t = Tables(spark, root)
    mapped = t.raw("crosswalk_mappings").select(F.col("source_id").alias("id")).where("id is not null").distinct()
    free = t.vector_rows().join(mapped, "id", "left_anti")
    pairs = vectors.similarity_join(free, free, "subject", 0.55, ("grade", "system"), "after:0").where("a_system <> b_system")
    delta = (grades.grade_year(F.col("b_grade")) - grades.grade_year(F.col("a_grade"))).cast("int")
    return maintain.direct_pairs(pairs.select("a", "b", "cosine", delta.alias("delta")), mapped)


@query(with_(S) + "SELECT id FROM s WHERE standard_text IS NULL OR trim(standard_text) = ''")
def dq_empty(spark, root) -> DataFrame:
    return Tables(spark, root).standards().where("standard_text is null or trim(standard_text) = ''").select("id")


