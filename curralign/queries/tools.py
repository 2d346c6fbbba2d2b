"""The six tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import crosswalk as cw
from ..plans import tools
from .registry import HUB, HUBS, OK_SCORE, C, Tables, V, query, rank_sql, with_
from .similarity import _SP, _SQ, _cos, standard_probe
from .text import FTS

_Q = "coalesce(try_cast(nullif(regexp_extract(notes, '\\[(?:LLM score|exact-match) (\\d)/5\\]', 1), '') AS INTEGER), 3)"
_PRE = f"pre AS (SELECT source_id, target_system, target_id, confidence_score, row_number() OVER (PARTITION BY source_id, target_system ORDER BY {_Q} DESC, confidence_score DESC, target_id) AS rank_no FROM c WHERE {OK_SCORE} AND confidence_score >= 0.7 AND flagged_for_review = 0)"
_BEST = f"best AS (SELECT source_id, target_system, target_id, confidence_score FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_system ORDER BY confidence_score DESC, target_id) AS r FROM c WHERE {OK_SCORE}) WHERE r = 1)"
_HOP = f"""k AS (SELECT source_id, source_system, target_id, max(confidence_score) AS c FROM c WHERE {OK_SCORE} AND target_system = '{HUB}' AND source_system <> '{HUB}' GROUP BY ALL),
 h1 AS (SELECT source_id, source_system, target_id, c FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY c DESC, target_id) AS r FROM k) WHERE r <= 3),
 h2 AS (SELECT source_id, source_system, target_id, c FROM (SELECT *, row_number() OVER (PARTITION BY target_id, source_system ORDER BY c DESC, source_id) AS r FROM k) WHERE r <= 3),
 hh AS (SELECT h1.source_id, h2.source_system AS to_system, h2.source_id AS target_id, round(max(h1.c * h2.c), 4) AS confidence FROM h1 JOIN h2 ON h1.target_id = h2.target_id AND h1.source_system <> h2.source_system GROUP BY ALL),
 hop AS (SELECT source_id, to_system, target_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source_id, to_system ORDER BY confidence DESC, target_id) AS r FROM hh) WHERE r <= 5)"""
_REV = f"rev AS (SELECT target_id AS source_id, source_system AS to_system, source_id AS target_id, confidence_score AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY target_id, source_system ORDER BY confidence_score DESC, source_id) AS r FROM c WHERE {OK_SCORE} AND target_system = '{HUB}') WHERE r <= 5)"


@query(with_(C, _PRE) + "SELECT source_id, target_system, target_id, confidence_score, rank_no::INTEGER AS rank_no FROM pre")
def map_precomputed(spark, root) -> DataFrame:
    return cw.precomputed(Tables(spark, root).mappings()).select("source_id", "target_system", "target_id", "confidence_score", "rank_no")


@query(with_(C, _BEST) + "SELECT * FROM best")
def map_best_below(spark, root) -> DataFrame:
    return cw.best_any(Tables(spark, root).mappings())


@query(with_(C, _HOP) + "SELECT * FROM hop")
def jn_two_hop(spark, root) -> DataFrame:
    return cw.two_hop(Tables(spark, root).mappings(), HUB)


@query(with_(C, _REV) + "SELECT * FROM rev")
def map_hub_reverse(spark, root) -> DataFrame:
    return cw.hub_reverse(Tables(spark, root).mappings(), HUB)


def _inputs(t: Tables) -> DataFrame:
    """Every source with a vector, to one system."""
    return t.vectors().select(F.col("id").alias("source_id"), F.lit("dorn-state").alias("to_system"))


_IN = "i AS (SELECT id AS source_id, 'dorn-state' AS to_system FROM v)"
_NEAR = f"near AS (SELECT source_id, to_system, target_id, score, k FROM (SELECT i.source_id, i.to_system, b.id AS target_id, {_cos('a.vec', 'b.vec')} AS score, row_number() OVER (PARTITION BY i.source_id ORDER BY {_cos('a.vec', 'b.vec')} DESC, b.id DESC) AS k FROM rest i JOIN v a ON a.id = i.source_id JOIN (SELECT v.id, vec FROM v JOIN sp ON v.id = sp.id WHERE system = 'dorn-state') b ON true) WHERE k <= 3 AND score >= 0.35)"


@query(with_(V, _SP, "rest AS (SELECT id AS source_id, 'dorn-state' AS to_system FROM v)", _NEAR) + "SELECT source_id, target_id, score, k::INTEGER AS rank_no FROM near")
def vec_fallback(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return tools.nearest_in_system(t.vectors(), t.standards("id", "system"), _inputs(t)).select("source_id", "target_id", "score", "rank_no")


_THREE = "three AS (SELECT *, row_number() OVER (PARTITION BY source_id, to_system ORDER BY confidence DESC, target_id) AS k FROM (SELECT * FROM hop UNION ALL SELECT * FROM rev) JOIN rest USING (source_id, to_system))"
_MAP = with_(C, V, _SP, _IN, _PRE, _BEST, _HOP, _REV, "one AS (SELECT source_id, to_system, 'precomputed' AS strategy, target_id, confidence_score AS score, rank_no FROM i JOIN (SELECT source_id, target_system AS to_system, target_id, confidence_score, rank_no FROM pre) USING (source_id, to_system))", "rest AS (SELECT * FROM i WHERE source_id NOT IN (SELECT source_id FROM one))", _NEAR, _THREE,
             "every AS (SELECT source_id, to_system, strategy, target_id, score, rank_no FROM one UNION ALL SELECT source_id, to_system, 'below_threshold', target_id, confidence_score, 1 FROM rest JOIN (SELECT source_id, target_system AS to_system, target_id, confidence_score FROM best) USING (source_id, to_system) UNION ALL SELECT source_id, to_system, 'two_hop', target_id, confidence, k FROM three WHERE k <= 5 UNION ALL SELECT source_id, to_system, 'nearest', target_id, score, k FROM near)")


@query(_MAP + "SELECT source_id, to_system, strategy, target_id, score, rank_no::INTEGER AS rank_no FROM every UNION ALL SELECT source_id, to_system, 'none', NULL, NULL, 1 FROM i WHERE source_id NOT IN (SELECT source_id FROM every)")
def tool_map(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return tools.map_standards(t.mappings(), t.vectors(), t.standards("id", "system"), _inputs(t), HUB)


@query(with_(V, _SP, _SQ, "m AS (SELECT DISTINCT id, domain, standard_text FROM standards)") + f"SELECT v.id, {_cos('vec', 'qv')} AS score, system, grade, domain, standard_text FROM v JOIN sp ON v.id = sp.id JOIN m ON m.id = v.id, q WHERE system = '{HUB}' AND grade IN ('3','4','5','6') ORDER BY score DESC, v.id DESC LIMIT 10")
def tool_search(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return tools.search(t.standards(), t.vectors(), standard_probe(t), HUBS, subject="science", grade="3-6", limit=10)


@query(with_(*FTS) + f"SELECT r.id, score, system, grade, domain FROM r JOIN (SELECT DISTINCT id, system, grade, domain FROM standards) m ON m.id = r.id WHERE system = '{HUB}' AND grade IN ('K','1','2','3','4','5') ORDER BY score DESC, r.id LIMIT 20")
def tool_fts_search(spark, root) -> DataFrame:
    return tools.search_text(Tables(spark, root).standards(), "fractions measure volume", HUBS, subject="mathematics", grade=["K", 1, 2, 3, 4, 5], limit=20)


@query(with_(V, _SP, _SQ) + f"SELECT grade, grade_no::INTEGER AS grade_no, id, score FROM (SELECT grade, {rank_sql('grade')} AS grade_no, v.id, {_cos('vec', 'qv')} AS score, row_number() OVER (PARTITION BY grade ORDER BY {_cos('vec', 'qv')} DESC, v.id DESC) AS k FROM v JOIN sp ON v.id = sp.id, q WHERE system = '{HUB}' AND {rank_sql('grade')} BETWEEN 1 AND 8 AND {_cos('vec', 'qv')} >= 0.5) WHERE k <= 3")
def tool_progression(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return tools.progression(t.standards("id", "system", "grade"), t.vectors(), standard_probe(t), HUB, "1-8")


@query(with_(*FTS, f"x AS (SELECT r.id, score, grade FROM r JOIN (SELECT DISTINCT id, system, grade FROM standards) m ON m.id = r.id WHERE system = '{HUB}' ORDER BY score DESC, r.id LIMIT 60)") + f"SELECT grade, id, score FROM (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY score DESC, id) AS k FROM x WHERE {rank_sql('grade')} BETWEEN 3 AND 6) WHERE k <= 3")
def topk_fts_grade(spark, root) -> DataFrame:
    return tools.progression_text(Tables(spark, root).standards(), "fractions measure volume", HUB, "3-6")




@query(with_("ids AS (SELECT DISTINCT id FROM standards)", "w AS (SELECT lower(id) || ' .' AS input FROM ids)", "cand AS (SELECT w.input, ids.id, CASE WHEN ids.id = rtrim(w.input, ' .,;:') THEN 2 WHEN upper(ids.id) = upper(rtrim(w.input, ' .,;:')) THEN 3 ELSE 5 END AS tier FROM w JOIN ids ON regexp_replace(upper(ids.id), '[.][A-Z]([.][0-9])', '\\1', 'g') = regexp_replace(upper(rtrim(w.input, ' .,;:')), '[.][A-Z]([.][0-9])', '\\1', 'g'))") + "SELECT input, id FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY tier, id) AS r FROM cand) WHERE r = 1")
def txt_resolve_id(spark, root) -> DataFrame:
    s = Tables(spark, root).standards("id", "system")
    return tools.resolve_ids(s, s.select(F.concat(F.lower("id"), F.lit(" .")).alias("input")).distinct())


@query(with_("ids AS (SELECT DISTINCT id, system FROM standards)", "i AS (SELECT DISTINCT parent_id AS input FROM sub_standards WHERE trim(parent_id) <> '' AND parent_id NOT IN (SELECT id FROM ids))") + f"SELECT input, id FROM (SELECT i.input, ids.id, row_number() OVER (PARTITION BY i.input ORDER BY ids.id) AS r FROM i JOIN ids ON system = '{HUB}' AND string_split(ids.id, '.')[3] = string_split(i.input, '.')[3]) WHERE r <= 5")
def txt_suggest(spark, root) -> DataFrame:
    t = Tables(spark, root)
    s = t.standards("id", "system")
    inputs = t.raw("sub_standards").where("trim(parent_id) <> ''").select(F.col("parent_id").alias("input")).distinct().join(s.select(F.col("id").alias("input")), "input", "left_anti")
    return tools.suggestions(s, inputs, HUB)


_SNAP = "SELECT x.system, string_agg(DISTINCT x.subject, ',' ORDER BY x.subject) AS subjects, count(DISTINCT x.id) AS standards, coalesce(max(l.n), 0) AS crosswalks FROM (SELECT DISTINCT id, system, subject FROM standards) x LEFT JOIN (SELECT source_system, count(DISTINCT id) AS n FROM crosswalk_mappings GROUP BY 1) l ON l.source_system = x.system GROUP BY x.system"


@query(_SNAP)
def agg_sys_snapshot(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return tools.list_systems(t.raw("standards"), t.raw("crosswalk_mappings"))


@query(f"SELECT * FROM ({_SNAP}) WHERE list_contains(string_split(subjects, ','), 'cs')")
def tool_list(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return tools.list_systems(t.raw("standards"), t.raw("crosswalk_mappings"), subject="cs")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT id, system, subject FROM standards)) AS standards, (SELECT count(DISTINCT system) FROM standards) AS systems, (SELECT count(DISTINCT subject) FROM standards) AS subjects, (SELECT count(DISTINCT id) FROM crosswalk_mappings) AS crosswalks")
def instr(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return tools.totals(t.raw("standards"), t.raw("crosswalk_mappings"))
