"""Graph queries over prerequisite edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grades import grade_rank
from ..operators import graph
from .registry import C, E, Tables, query, rank_sql, with_

_P = "p AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM e WHERE relationship = 'prerequisite' AND confidence_score >= 0.9 AND NOT isnan(confidence_score) AND source_id IS NOT NULL AND target_id IS NOT NULL)"

def _roots(t: Tables, edges: DataFrame) -> DataFrame:
    """``root``: every standard with an outgoing edge."""
    return edges.join(t.raw("standards").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("root")).distinct()


@query(
    with_(f"x AS (SELECT DISTINCT id, system, domain, {rank_sql('grade')} AS rank FROM standards WHERE {rank_sql('grade')} < 99)", "g AS (SELECT DISTINCT system, domain, rank FROM x)", "l AS (SELECT *, lead(rank) OVER (PARTITION BY system, domain ORDER BY rank) AS nx FROM g)", "y AS (SELECT a.id AS lo, b.id AS hi, a.system FROM l JOIN x a ON a.system = l.system AND a.domain = l.domain AND a.rank = l.rank JOIN x b ON b.system = l.system AND b.domain = l.domain AND b.rank = l.nx WHERE nx - l.rank <= 2)")
    + "SELECT lo AS source_id, hi AS target_id, 'successor' AS relationship, system FROM y UNION ALL SELECT hi, lo, 'prerequisite', system FROM y"
)
def gr_relate(spark, root) -> DataFrame:
    return graph.related_by_grade(Tables(spark, root).standards("id", "system", "domain", "grade"))


@query(with_(E) + "SELECT source_id, target_id, relationship FROM e WHERE method = 'llm_prereq' UNION ALL SELECT target_id, source_id, CASE relationship WHEN 'prerequisite' THEN 'successor' WHEN 'successor' THEN 'prerequisite' ELSE relationship END FROM e WHERE method = 'llm_prereq'")
def gr_mirror(spark, root) -> DataFrame:
    e = Tables(spark, root).edges().where("method = 'llm_prereq'").select("source_id", "target_id", "relationship")
    return graph.mirrored(e)


@query(with_(E) + "SELECT id, source_id, target_id, relationship FROM (SELECT *, max(CASE WHEN method = 'llm_prereq' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, relationship) AS m FROM e) WHERE m = 0 OR method = 'llm_prereq'")
def gr_related(spark, root) -> DataFrame:
    return graph.prefer_validated(Tables(spark, root).edges(), "llm_prereq").select("id", "source_id", "target_id", "relationship")


@query(
    with_(E)
    + "SELECT id, coalesce(nullif(regexp_extract(notes, '\\b(hard|soft)\\b(?:\\s*\\[[^\\]]*\\])?:', 1), ''), CASE WHEN isnan(confidence_score) THEN NULL WHEN confidence_score >= 0.9 THEN 'hard' WHEN confidence_score IS NOT NULL THEN 'soft' END) AS strength, CASE WHEN regexp_matches(notes, '\\b(hard|soft)\\b(?:\\s*\\[[^\\]]*\\])?:') THEN regexp_extract(notes, '\\b(hard|soft)\\b(?:\\s*\\[[^\\]]*\\])?:\\s*(.*)$', 2, 's') ELSE notes END AS why FROM e WHERE relationship = 'prerequisite'"
)
def gr_rationales(spark, root) -> DataFrame:
    from ..functions.notes import reason, strength

    e = Tables(spark, root).edges("id", "notes", "confidence_score", "relationship").where("relationship = 'prerequisite'")
    s = F.when(F.isnan("confidence_score"), None).otherwise(F.col("confidence_score"))
    return e.select("id", F.coalesce(strength(F.col("notes")), F.when(s >= graph.HARD, "hard").when(s.isNotNull(), "soft")).alias("strength"), reason(F.col("notes")).alias("why"))


@query("WITH RECURSIVE " + ", ".join((E, _P, "w(node, ancestor) AS (SELECT src, dst FROM p WHERE src <> dst UNION SELECT w.node, p.dst FROM w JOIN p ON p.src = w.ancestor WHERE p.src <> p.dst)")) + " SELECT DISTINCT node, ancestor FROM w WHERE node <> ancestor")
def gr_transitive(spark, root) -> DataFrame:
    return graph.all_pairs_closure(graph.prerequisites(Tables(spark, root).edges()))


_GOLD = "gold AS (SELECT DISTINCT target_id AS src, prereq_id AS dst FROM prereq_gold_sample)"
_SOFT = "o AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM e WHERE relationship = 'prerequisite' AND method = 'llm_prereq')"


def _ours_and_gold(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.edges("source_id", "target_id", "relationship", "method").where("relationship = 'prerequisite' and method = 'llm_prereq'")
    gold = t.raw("prereq_gold_sample").select(F.col("target_id").alias("src"), F.col("prereq_id").alias("dst")).distinct()
    return e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct(), gold


@query(with_(E, _SOFT, _GOLD) + "SELECT src, dst FROM o WHERE EXISTS (SELECT 1 FROM gold g WHERE g.src = o.dst AND g.dst = o.src) AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.src = o.src AND g.dst = o.dst)")
def gr_contradict(spark, root) -> DataFrame:
    return graph.contradicted(*_ours_and_gold(Tables(spark, root)))


@query(
    "WITH RECURSIVE " + ", ".join((E, _SOFT, _GOLD, "w(node, ancestor) AS (SELECT src, dst FROM gold WHERE src <> dst UNION SELECT w.node, g.dst FROM w JOIN gold g ON g.src = w.ancestor WHERE g.src <> g.dst)"))
    + " SELECT (SELECT count(*) FROM o) AS edges, (SELECT count(*) FROM o JOIN gold USING (src, dst)) AS direct, (SELECT count(*) FROM o JOIN (SELECT DISTINCT node AS src, ancestor AS dst FROM w WHERE node <> ancestor) USING (src, dst)) AS transitive, (SELECT count(*) FROM o JOIN gold g ON g.src = o.dst AND g.dst = o.src WHERE NOT EXISTS (SELECT 1 FROM gold h WHERE h.src = o.src AND h.dst = o.dst)) AS reversed, (SELECT count(*) FROM gold) AS reference_edges, (SELECT count(*) FROM o JOIN gold USING (src, dst)) AS recalled"
)
def gr_corroborate(spark, root) -> DataFrame:
    return graph.corroboration(*_ours_and_gold(Tables(spark, root)))


@query(
    with_(E, _GOLD, "d AS (SELECT src, dst FROM gold WHERE src IS NOT NULL AND dst IS NOT NULL)", "b AS (SELECT src, dst FROM d UNION SELECT dst, src FROM d)")
    + "SELECT id, CASE WHEN confidence_score = 0.5 AND EXISTS (SELECT 1 FROM b WHERE b.src = e.source_id AND b.dst = e.target_id) THEN 0.9 ELSE confidence_score END AS confidence_score FROM e WHERE confidence_score IS NOT NULL AND NOT isnan(confidence_score)"
)
def gr_promote(spark, root) -> DataFrame:
    t = Tables(spark, root)
    _, gold = _ours_and_gold(t)
    return graph.promoted(t.edges(), gold, gold.limit(0), "gold").where("confidence_score is not null and not isnan(confidence_score)").select("id", "confidence_score")


@query(
    with_(E, "n AS (SELECT source_id AS id FROM e UNION SELECT target_id FROM e)", "x AS (SELECT id, min(domain) AS domain, min(subject) AS subject FROM standards GROUP BY id)")
    + "SELECT subject, count(*) AS nodes FROM n JOIN x USING (id) GROUP BY ALL"
)
def gr_nodes_edges(spark, root) -> DataFrame:
    t = Tables(spark, root)
    nodes = t.edges("source_id", "target_id").select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return nodes.join(t.raw("standards").groupBy("id").agg(F.min("subject").alias("subject")), "id").groupBy("subject").agg(F.count("*").alias("nodes"))


@query("SELECT DISTINCT domain, CASE WHEN lower(domain) IN ('geometry','measurement and data') THEN 'Geometry' WHEN lower(domain) LIKE '%statistics%' THEN 'Statistics & Probability' WHEN lower(domain) LIKE '%ratio%' THEN 'Ratios & Proportions' WHEN lower(domain) LIKE '%number%' THEN 'Number & Quantity' ELSE 'Other' END AS category FROM standards WHERE subject = 'mathematics'")
def gr_category(spark, root) -> DataFrame:
    d = F.lower("domain")
    cat = F.when(d.isin("geometry", "measurement and data"), "Geometry").when(d.contains("statistics"), "Statistics & Probability").when(d.contains("ratio"), "Ratios & Proportions").when(d.contains("number"), "Number & Quantity").otherwise("Other")
    return Tables(spark, root).raw("standards").where("subject = 'mathematics'").select("domain", cat.alias("category")).distinct()


@query(with_(C, "x AS (SELECT id, min(domain) AS domain FROM standards GROUP BY id)") + "SELECT domain, source_system, source_id, confidence_score FROM (SELECT x.domain, c.source_system, c.source_id, c.confidence_score, row_number() OVER (PARTITION BY x.domain, c.source_system ORDER BY c.confidence_score DESC, c.id) AS r FROM c JOIN x ON x.id = c.target_id WHERE c.confidence_score IS NOT NULL AND NOT isnan(c.confidence_score)) WHERE r = 1")
def gr_intl_best(spark, root) -> DataFrame:
    from ..operators.ranking import top_per_group

    t = Tables(spark, root)
    c = t.mappings("source_id", "source_system", "target_id", "confidence_score").where("confidence_score is not null and not isnan(confidence_score)")
    j = c.join(t.raw("standards").groupBy(F.col("id").alias("target_id")).agg(F.min("domain").alias("domain")), "target_id")
    return top_per_group(j, ["domain", "source_system"], [F.col("confidence_score").desc(), F.col("id")], 1).select("domain", "source_system", "source_id", "confidence_score")


@query(with_(E, _P) + "SELECT src, dst FROM p WHERE src < dst AND EXISTS (SELECT 1 FROM p q WHERE q.src = p.dst AND q.dst = p.src)")
def gr_two_cycle(spark, root) -> DataFrame:
    return graph.two_cycles(graph.prerequisites(Tables(spark, root).edges()))


@query(with_(E, _P, "d AS (SELECT src, count(*) AS n FROM p GROUP BY src)") + "SELECT max(n) AS most, round(avg(n), 6) AS mean FROM d")
def gr_degree(spark, root) -> DataFrame:
    p = graph.prerequisites(Tables(spark, root).edges()).where("src is not null and dst is not null").distinct()
    return p.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query(with_(E, _P, f"g AS (SELECT id, min({rank_sql('grade')}) AS r FROM standards GROUP BY id)") + "SELECT src, dst FROM p JOIN g a ON a.id = src JOIN g b ON b.id = dst WHERE b.r > a.r")
def gr_upward(spark, root) -> DataFrame:
    t = Tables(spark, root)
    p = graph.prerequisites(t.edges()).distinct()
    g = t.raw("standards").groupBy("id").agg(F.min(grade_rank(F.col("grade"))).alias("r"))
    return p.join(g.select(F.col("id").alias("src"), F.col("r").alias("a")), "src").join(g.select(F.col("id").alias("dst"), F.col("r").alias("b")), "dst").where("b > a").select("src", "dst")
