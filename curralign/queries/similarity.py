"""Vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grades import grade_delta as delta_of
from ..functions.grades import grade_rank
from ..operators import vectors as vec
from ..operators.ranking import top_per_group
from ..plans import crosswalk as cw
from .registry import HUB, HUBS, S, Tables, V, query, rank_sql, with_, year_sql

#: The stored vector that stands for a query.
PROBE = 0
_SP = "sp AS (SELECT DISTINCT id, system, subject, grade FROM standards)"
_R = f"r AS (SELECT v.id, vec, system, subject, grade, {year_sql('grade')} AS rank FROM v JOIN sp ON v.id = sp.id)"
_FAMILY = {"east": ["heim-plan", "quell-moe", "korv-dept"], "west": ["dorn-state", "valm-core", "pelu-mat"]}


def _cos(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}, {b}), 4)"


_Q = "q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS qv FROM embeddings WHERE vec_id = 0)"


def probe(spark, root) -> list[float]:
    """The query vector: a stored one, since there is no model here. One row."""
    return [float(x) for x in Tables(spark, root).raw("embeddings").where(F.col("vec_id") == PROBE).first()["embedding"]]


def standard_probe(t: Tables) -> list[float]:
    """The vector of the smallest id that has a usable one. One row."""
    return [float(x) for x in t.vectors().orderBy("id").limit(1).first()["vec"]]


_SQ = "q AS (SELECT vec AS qv FROM v ORDER BY id LIMIT 1)"


@query(with_(V, _SP, _SQ) + f"SELECT v.id, {_cos('vec', 'qv')} AS score FROM v JOIN sp ON v.id = sp.id, q WHERE subject = 'mathematics' ORDER BY score DESC, v.id DESC LIMIT 20")
def vec_cos_topk(spark, root) -> DataFrame:
    t = Tables(spark, root)
    ids = t.raw("standards").where("subject = 'mathematics'").select("id").distinct()
    return vec.cosine_top_k(t.vectors().join(ids, "id", "left_semi"), standard_probe(t), 20)


@query(with_(_Q) + f"SELECT vec_id, {_cos('list_transform(embedding, lambda x: x::DOUBLE)', 'qv')} AS score FROM embeddings, q")
def vec_norm(spark, root) -> DataFrame:
    e = Tables(spark, root).raw("embeddings")
    q = probe(spark, root)
    n = vec.normalised(F.col("embedding"))
    unit = [x / sum(y * y for y in q) ** 0.5 for x in q]
    return e.select("vec_id", F.round(vec.dot(n, F.array(*(F.lit(x) for x in unit))), 4).alias("score"))


@query("SELECT len(vector)::INTEGER AS dims, count(*) AS n FROM (SELECT DISTINCT * FROM standard_embeddings WHERE vector IS NOT NULL) GROUP BY ALL")
def vec_dim_check(spark, root) -> DataFrame:
    e = Tables(spark, root).raw("standard_embeddings").where("vector is not null").distinct()
    return e.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"))


_PAIR = f"x AS (SELECT a.id AS a, b.id AS b, a.system AS sa, b.system AS sb, a.rank AS ra, b.rank AS rb, {_cos('a.vec', 'b.vec')} AS cosine FROM r a JOIN r b ON true WHERE "


@query(
    with_(V, _SP, _R, _PAIR + f"a.system <> '{HUB}' AND b.system = '{HUB}')")
    + f"SELECT a AS source_id, b AS target_id, sa AS source_system, sb AS target_system, 'equivalent' AS relationship, cosine AS confidence_score, (rb - ra)::INTEGER AS grade_delta, printf('nlp_pass cosine=%.4f', cosine) AS notes FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS k FROM x WHERE cosine >= 0.7 AND abs(rb - ra) <= 5) WHERE k <= 2"
)
def vec_crosswalk_hub(spark, root) -> DataFrame:
    return cw.hub_crosswalk(Tables(spark, root).vector_rows(), HUBS, top_n=2, default=HUB)


@query(
    with_(V, _SP, _R, _PAIR + f"a.system <> '{HUB}' AND b.system = '{HUB}')") + "SELECT sa AS source_system, count(DISTINCT a) AS mapped FROM x WHERE cosine >= 0.7 AND abs(rb - ra) <= 5 GROUP BY ALL"
)
def vec_crosswalk_all(spark, root) -> DataFrame:
    m = cw.hub_crosswalk(Tables(spark, root).vector_rows(), HUBS, default=HUB)
    return m.groupBy("source_system").agg(F.countDistinct("source_id").alias("mapped"))


@query(with_(S) + "SELECT DISTINCT subject, CASE subject WHEN 'mathematics' THEN 'ccss' WHEN 'science' THEN 'ngss' WHEN 'ela' THEN 'ccss-ela' WHEN 'social-studies' THEN 'c3' WHEN 'cs' THEN 'csta' ELSE 'ccss' END AS hub FROM s")
def vec_hub_infer(spark, root) -> DataFrame:
    return Tables(spark, root).standards("subject").select("subject", cw.hub_of(F.col("subject"), cw.SUBJECT_HUB).alias("hub"))


@query(
    with_(V, _SP, _R, "f AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}','{s}')" for k, v in _FAMILY.items() for s in v) + ") t(family, system))",
          "x AS (SELECT a.id AS a, b.id AS b, a.system AS sa, b.system AS sb, a.rank AS ra, b.rank AS rb, " + _cos("a.vec", "b.vec") + " AS cosine FROM r a JOIN f fa ON fa.system = a.system JOIN f fb ON fb.family = fa.family AND fb.system <> fa.system JOIN r b ON b.system = fb.system WHERE a.subject = 'mathematics' AND b.subject = 'mathematics')")
    + "SELECT a AS source_id, b AS target_id, sa AS source_system, sb AS target_system, 'equivalent' AS relationship, cosine AS confidence_score, (rb - ra)::INTEGER AS grade_delta, printf('direct_family cosine=%.4f', cosine) AS notes FROM (SELECT *, row_number() OVER (PARTITION BY a, sb ORDER BY cosine DESC, b) AS k FROM x) WHERE k = 1 AND cosine >= 0.7 AND abs(rb - ra) <= 5"
)
def vec_crosswalk_family(spark, root) -> DataFrame:
    return cw.family_crosswalk(Tables(spark, root).vector_rows(), _FAMILY)


@query(
    with_(V, _SP, f"r AS (SELECT v.id, vec, system, {rank_sql('grade')} AS rank FROM v JOIN sp ON v.id = sp.id WHERE {rank_sql('grade')} < 99)", f"x AS (SELECT a.id AS a, b.id AS b, {_cos('a.vec', 'b.vec')} AS cosine FROM r a JOIN r b ON a.system = b.system AND b.rank < a.rank AND b.rank >= a.rank - 3)")
    + "SELECT a AS target_id, b AS prereq_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS k FROM x WHERE cosine >= 0.45) WHERE k <= 6"
)
def vec_prereq_cand(spark, root) -> DataFrame:
    t = Tables(spark, root)
    rows = t.vectors().join(t.standards("id", "system", "grade"), "id").select("id", "vec", grade_rank(F.col("grade")).alias("rank"), F.col("system").alias("scope"))
    return cw.prerequisite_candidates(rows.where("rank < 99"))


@query(with_(V, _SP, _R, f"x AS (SELECT a.id AS id_a, b.id AS id_b, {_cos('a.vec', 'b.vec')} AS cosine FROM r a JOIN r b ON a.system = b.system AND a.grade = b.grade AND a.id < b.id)") + "SELECT * FROM x WHERE cosine >= 0.97")
def vec_near_dup(spark, root) -> DataFrame:
    return cw.near_duplicates(Tables(spark, root).vector_rows())


@query(with_(V, _SP, _SQ) + f"SELECT system, max({_cos('vec', 'qv')}) AS best, max({_cos('vec', 'qv')}) >= 0.45 AS reached FROM v JOIN sp ON v.id = sp.id, q GROUP BY system")
def vec_reach(spark, root) -> DataFrame:
    t = Tables(spark, root)
    scored = t.vectors().join(t.standards("id", "system"), "id").select("system", F.round(vec.cosine_to(F.col("vec"), standard_probe(t)), 4).alias("s"))
    return scored.groupBy("system").agg(F.max("s").alias("best"), (F.max("s") >= 0.45).alias("reached"))


_RECALL = f"""g AS (SELECT DISTINCT target_id, prereq_id FROM prereq_gold_sample WHERE target_id <> prereq_id),
 y AS (SELECT t.id AS t, c.id AS c, {_cos('t.vec', 'c.vec')} AS s FROM v t JOIN v c ON t.id <> c.id WHERE t.id IN (SELECT target_id FROM g)),
 z AS (SELECT t, c, row_number() OVER (PARTITION BY t ORDER BY s DESC, c) AS k FROM y)"""


@query(with_(V, _RECALL) + "SELECT count(*) AS pairs, count(CASE WHEN k <= 1 THEN 1 END) AS at_1, count(CASE WHEN k <= 5 THEN 1 END) AS at_5, count(CASE WHEN k <= 10 THEN 1 END) AS at_10 FROM g LEFT JOIN (SELECT * FROM z WHERE k <= 10) z ON g.target_id = z.t AND g.prereq_id = z.c")
def vec_recall(spark, root) -> DataFrame:
    t = Tables(spark, root)
    g = t.raw("prereq_gold_sample").select("target_id", "prereq_id").where("target_id <> prereq_id").distinct()
    v = t.vectors().select("id", "vec", F.lit(0).alias("rank"), F.lit("all").alias("scope"))
    asked = v.join(g.select(F.col("target_id").alias("id")), "id", "left_semi")
    near = vec.similarity_join(asked, v, "scope", -2.0, (), None, 11).where("a <> b")
    top = top_per_group(near, ["a"], [F.col("cosine").desc(), F.col("b")], 10)
    from ..operators.ranking import ranked

    top = ranked(top, ["a"], [F.col("cosine").desc(), F.col("b")], "k")
    j = g.join(top.select(F.col("a").alias("target_id"), F.col("b").alias("prereq_id"), "k"), ["target_id", "prereq_id"], "left")
    return j.agg(F.count("*").alias("pairs"), *(F.count_if(F.col("k") <= n).alias(f"at_{n}") for n in (1, 5, 10)))


@query(with_("c AS (SELECT DISTINCT source_id, target_id FROM crosswalk_mappings)", "sp AS (SELECT DISTINCT id, grade FROM standards)") + f"SELECT c.source_id, c.target_id, ({year_sql('b.grade')} - {year_sql('a.grade')})::INTEGER AS grade_delta FROM c JOIN sp a ON a.id = c.source_id JOIN sp b ON b.id = c.target_id")
def grade_delta(spark, root) -> DataFrame:
    t = Tables(spark, root)
    g = t.standards("id", "grade")
    c = t.raw("crosswalk_mappings").select("source_id", "target_id").distinct()
    j = c.join(g.select(F.col("id").alias("source_id"), F.col("grade").alias("a")), "source_id").join(g.select(F.col("id").alias("target_id"), F.col("grade").alias("b")), "target_id")
    return j.select("source_id", "target_id", delta_of(F.col("a"), F.col("b")).cast("int").alias("grade_delta"))
