"""Walks over every root, texts of every language, and operators whose inputs are built from the tables by rule."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grades, notes, text
from ..operators import fts, graph, ranking, upsert, vectors
from ..plans import crosswalk as cw
from ..plans import maintain, tools
from ..sources import hierarchy, pages, sinks
from ..streaming import incremental
from .graph import _P, _roots
from .ingest import _nodes, scratch
from .registry import HUB, OK_SCORE, C, E, S, Tables, U, V, query, rank_sql, with_, year_sql
from .similarity import _FAMILY, _R, _SP, _SQ, _cos, standard_probe
from .text import _WORDS

# Walks. The depth of a walk is its shortest, as in a breadth-first search.

_T = "t AS (SELECT DISTINCT src AS root FROM p WHERE src IN (SELECT id FROM standards))"
_W = "w(root, node, d) AS (SELECT root, root, 0 FROM t UNION SELECT w.root, p.dst, d + 1 FROM w JOIN p ON p.src = w.node WHERE d < 20)"
_SEEN = "seen AS (SELECT root, node, min(d)::INTEGER AS depth FROM w GROUP BY ALL)"
_GRADE = "g AS (SELECT id, min(grade) AS grade FROM standards GROUP BY id)"
_SOFT = _P.replace(">= 0.9", ">= 0.5")


def _walk(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join((E, *ctes)) + " "


@query(_walk(_P, _T, _W, _SEEN) + "SELECT root, node, depth FROM seen")
def gr_closure(spark, root) -> DataFrame:
    t = Tables(spark, root)
    p = graph.prerequisites(t.edges())
    return graph.reachable(p, _roots(t, p))


@query(_walk(_P.replace("source_id AS src, target_id AS dst", "target_id AS src, source_id AS dst"), _T, _W, _SEEN) + "SELECT root, node, depth FROM seen")
def gr_forward(spark, root) -> DataFrame:
    t = Tables(spark, root)
    ahead = graph.prerequisites(t.edges()).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reachable(ahead, _roots(t, ahead))


@query(_walk(_P, _T, _W, _SEEN, _GRADE) + f"SELECT s.root, row_number() OVER (PARTITION BY s.root ORDER BY {rank_sql('g.grade')}, node) AS step, node AS id, g.grade, depth FROM seen s JOIN g ON g.id = node")
def gr_path(spark, root) -> DataFrame:
    t = Tables(spark, root)
    edges = graph.prerequisites(t.edges())
    p = graph.learning_path(edges, t.standards("id", "grade"), _roots(t, edges))
    return p.select("root", F.col("step").cast("long").alias("step"), "id", "grade", "depth")


@query(_walk(_P, _T, _W, _SEEN) + "SELECT s.root, count(*) AS steps, CASE WHEN count(*) = 1 THEN 'no prerequisites recorded' ELSE 'ordered by grade' END AS note FROM seen s WHERE node IN (SELECT id FROM standards) GROUP BY s.root")
def gr_path_notes(spark, root) -> DataFrame:
    t = Tables(spark, root)
    p = graph.prerequisites(t.edges())
    return tools.path_notes(graph.learning_path(p, t.standards("id", "grade"), _roots(t, p)))


_LINKS = "links AS (SELECT s.root, p.src, p.dst FROM seen s JOIN p ON p.src = s.node JOIN seen z ON z.root = s.root AND z.node = p.dst WHERE s.depth < 20)"


@query(
    _walk(_SOFT, _T, _W, _SEEN, _GRADE, _LINKS, "pre AS (SELECT root, src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS prerequisites FROM links GROUP BY ALL)")
    + f"SELECT s.root, (row_number() OVER (PARTITION BY s.root ORDER BY {rank_sql('g.grade')}, node))::INTEGER AS step, node AS id, g.grade, coalesce(prerequisites, '') AS prerequisites FROM seen s JOIN g ON g.id = node LEFT JOIN pre ON pre.root = s.root AND pre.src = s.node"
)
def tool_path(spark, root) -> DataFrame:
    t = Tables(spark, root)
    p = tools.path(t.standards("id", "grade"), t.edges(), _roots(t, graph.prerequisites(t.edges(), include_soft=True)), include_soft=True)
    return p.select("root", F.col("step").cast("int").alias("step"), "id", "grade", F.coalesce(F.array_join("prerequisites", ","), F.lit("")).alias("prerequisites"))


@query(
    _walk(
        _P, _T, _W, _SEEN, _GRADE, _LINKS, "first AS (SELECT root, max_by(node, {'d': depth, 'n': node}) AS start FROM seen WHERE depth > 0 GROUP BY root)",
        "a(root, node, d) AS (SELECT root, start, 0 FROM first UNION SELECT a.root, l.src, d + 1 FROM a JOIN links l ON l.root = a.root AND l.dst = a.node WHERE d < 20)",
        "way AS (SELECT DISTINCT root, node FROM a UNION SELECT root, root FROM t)", "kept AS (SELECT s.* FROM seen s JOIN way USING (root, node))",
        "pre AS (SELECT l.root, src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS prerequisites FROM links l JOIN kept x ON x.root = l.root AND x.node = l.src JOIN kept y ON y.root = l.root AND y.node = l.dst GROUP BY ALL)",
    )
    + f"SELECT s.root, (row_number() OVER (PARTITION BY s.root ORDER BY {rank_sql('g.grade')}, node))::INTEGER AS step, node AS id, coalesce(prerequisites, '') AS prerequisites FROM kept s JOIN g ON g.id = node LEFT JOIN pre ON pre.root = s.root AND pre.src = s.node"
)
def gr_prune(spark, root) -> DataFrame:
    t = Tables(spark, root)
    p = graph.prerequisites(t.edges())
    targets = _roots(t, p)
    far = graph.reachable(p, targets)
    start = far.where("depth > 0").groupBy("root").agg(F.max_by("node", F.struct("depth", "node")).alias("start"))
    out = graph.learning_path(p, t.standards("id", "grade"), targets, start)
    return out.select("root", F.col("step").cast("int").alias("step"), "id", F.coalesce(F.array_join("prerequisites", ","), F.lit("")).alias("prerequisites"))


@query(
    with_("sp AS (SELECT DISTINCT id, system, subject, grade, domain, cluster, standard_text FROM standards)", U, "parts AS (SELECT parent_id, string_agg(coalesce(text, '-'), '|' ORDER BY position, id) AS parts FROM u GROUP BY 1)", E,
          "p AS (SELECT *, max(CASE WHEN method = 'llm_prereq' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, relationship) AS m FROM e)",
          "l AS (SELECT DISTINCT source_id, relationship, CASE WHEN confidence_score IS NULL OR isnan(confidence_score) THEN 1.0 ELSE -confidence_score END AS o, target_id, coalesce(nullif(regexp_extract(notes, '\\b(hard|soft)\\b(?:\\s*\\[[^\\]]*\\])?:', 1), ''), CASE WHEN isnan(confidence_score) THEN NULL WHEN confidence_score >= 0.9 THEN 'hard' WHEN confidence_score IS NOT NULL THEN 'soft' END, '-') AS strength, coalesce(CASE WHEN regexp_matches(notes, '\\b(hard|soft)\\b(?:\\s*\\[[^\\]]*\\])?:') THEN regexp_extract(notes, '\\b(hard|soft)\\b(?:\\s*\\[[^\\]]*\\])?:\\s*(.*)$', 2, 's') ELSE notes END, '-') AS why FROM p WHERE (m = 0 OR method = 'llm_prereq') AND target_id IS NOT NULL)",
          "n AS (SELECT source_id, string_agg(CASE WHEN relationship = 'prerequisite' THEN target_id || ':' || strength || ':' || why END, '|' ORDER BY o, target_id, strength, why) AS pre, string_agg(CASE WHEN relationship = 'successor' THEN target_id || ':' || strength || ':' || why END, '|' ORDER BY o, target_id, strength, why) AS suc FROM l GROUP BY 1)")
    + "SELECT sp.id, grade, standard_text, coalesce(parts, '') AS parts, coalesce(pre, '') AS prerequisites, coalesce(suc, '') AS successors FROM sp LEFT JOIN parts ON parts.parent_id = sp.id LEFT JOIN n ON n.source_id = sp.id"
)
def tool_lookup(spark, root) -> DataFrame:
    """Texts of the parts, and of each neighbour its id, strength and reason."""
    t = Tables(spark, root)
    s = t.standards()
    found = tools.lookup(s, t.subs("id", "parent_id", "position", "text"), t.edges().where("target_id is not null"), s.select(F.col("id").alias("input")).distinct(), "", validated="llm_prereq")

    def shown(c: str) -> F.Column:
        one = lambda x: F.concat_ws(":", x["id"], F.coalesce(x["strength"], F.lit("-")), F.coalesce(x["why"], F.lit("-")))
        return F.coalesce(F.array_join(F.transform(c, one), "|"), F.lit("")).alias(c)

    return found.select("id", "grade", "standard_text", F.coalesce(F.array_join("sub_standards", "|", "-"), F.lit("")).alias("parts"), shown("prerequisites"), shown("successors"))


# Joins, ranks and sums with plans of their own.


@query(with_(V, _SP, _R, "f AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}','{s}')" for k, v in _FAMILY.items() for s in v) + ") t(family, system))") + f"SELECT fa.family, count(*) AS pairs, count(CASE WHEN {_cos('a.vec', 'b.vec')} >= 0.9 THEN 1 END) AS near FROM r a JOIN f fa ON fa.system = a.system JOIN f fb ON fb.family = fa.family AND fb.system > fa.system JOIN r b ON b.system = fb.system AND b.subject = a.subject WHERE {_cos('a.vec', 'b.vec')} >= 0.8 GROUP BY ALL")
def jn_cross_family(spark, root) -> DataFrame:
    """Pairs of different systems of one family, and how many are near."""
    family = F.when(F.col("system").isin(*_FAMILY["east"]), "east").when(F.col("system").isin(*_FAMILY["west"]), "west")
    r = Tables(spark, root).vector_rows().withColumn("family", family).where("family is not null").withColumn("scope", F.concat_ws("|", "family", "subject"))
    pairs = vectors.similarity_join(r, r, "scope", 0.8, ("family", "system")).where("a_system < b_system")
    return pairs.groupBy(F.col("a_family").alias("family")).agg(F.count("*").alias("pairs"), F.count_if(F.col("cosine") >= 0.9).alias("near"))


@query(with_(f"x AS (SELECT DISTINCT id, system, cluster, {rank_sql('grade')} AS rank FROM standards WHERE cluster IS NOT NULL AND {rank_sql('grade')} < 99)") + "SELECT a.id AS target_id, b.id AS prereq_id FROM x a JOIN x b ON a.system = b.system AND a.cluster = b.cluster AND b.rank < a.rank AND b.rank >= a.rank - 1 AND left(a.id, 10) = left(b.id, 10)")
def jn_theta_window(spark, root) -> DataFrame:
    """Candidates one grade below, among ids with the same beginning."""
    x = Tables(spark, root).standards("id", "system", "cluster", "grade").where("cluster is not null").select("id", "system", "cluster", grades.grade_rank(F.col("grade")).alias("rank"), F.substring("id", 1, 10).alias("head")).where("rank < 99").distinct()
    y = x.select(F.col("id").alias("prereq_id"), "system", "cluster", "head", F.col("rank").alias("low"))
    return x.join(y, ["system", "cluster", "head"]).where("low < rank and low >= rank - 1").select(F.col("id").alias("target_id"), "prereq_id")


@query(with_("x AS (SELECT DISTINCT id, system, md5(lower(trim(standard_text))) AS h FROM standards WHERE trim(standard_text) <> '')") + "SELECT a.id AS id_a, b.id AS id_b FROM x a JOIN x b ON a.system = b.system AND a.h = b.h AND a.id < b.id")
def jn_theta_upper(spark, root) -> DataFrame:
    """Each pair of one system with the same text once, the smaller id first."""
    x = Tables(spark, root).standards("id", "system", "standard_text").where("trim(standard_text) <> ''").select("id", "system", F.md5(F.lower(F.trim("standard_text"))).alias("h")).distinct()
    return x.select(F.col("id").alias("id_a"), "system", "h").join(x.select(F.col("id").alias("id_b"), "system", "h"), ["system", "h"]).where("id_a < id_b").select("id_a", "id_b")


@query(with_(f"x AS (SELECT system, domain, {rank_sql('grade')} AS rank, count(DISTINCT id) AS n FROM standards WHERE {rank_sql('grade')} < 99 GROUP BY ALL)") + "SELECT a.system, a.domain, a.rank::INTEGER AS rank, (a.n * b.n)::BIGINT AS pairs FROM x a JOIN x b ON a.system = b.system AND a.domain = b.domain AND b.rank = a.rank + 1")
def jn_adjacent_grade(spark, root) -> DataFrame:
    """Pairs of standards of adjacent grades, by system, domain and the lower grade."""
    s = Tables(spark, root).standards("id", "system", "domain", "grade").withColumn("rank", grades.grade_rank(F.col("grade"))).where("rank < 99")
    n = s.groupBy("system", "domain", "rank").agg(F.countDistinct("id").alias("n"))
    above = n.select("system", "domain", (F.col("rank") - 1).alias("rank"), F.col("n").alias("m"))
    return n.join(above, ["system", "domain", "rank"]).select("system", "domain", F.col("rank").cast("int").alias("rank"), (F.col("n") * F.col("m")).alias("pairs"))


@query("SELECT target_id, prereq_id, k::INTEGER AS rank_no FROM (SELECT target_id, prereq_id, row_number() OVER (PARTITION BY target_id ORDER BY cosine DESC, prereq_id) AS k FROM (SELECT DISTINCT target_id, prereq_id, cosine FROM prereq_gold_sample WHERE cosine BETWEEN -1 AND 1)) WHERE k <= 6")
def topk_prereq(spark, root) -> DataFrame:
    g = Tables(spark, root).raw("prereq_gold_sample").where("cosine between -1 and 1").select("target_id", "prereq_id", "cosine").distinct()
    return ranking.ranked(g, ["target_id"], [F.col("cosine").desc(), F.col("prereq_id")], "rank_no").where("rank_no <= 6").select("target_id", "prereq_id", "rank_no")


@query(with_(V, _SP, _SQ) + f"SELECT system, grade, id, score FROM (SELECT system, grade, v.id, {_cos('vec', 'qv')} AS score, row_number() OVER (PARTITION BY system, grade ORDER BY {_cos('vec', 'qv')} DESC, v.id DESC) AS k FROM v JOIN sp ON v.id = sp.id, q) WHERE k <= 2")
def topk_per_grade(spark, root) -> DataFrame:
    t = Tables(spark, root)
    scored = t.vectors().join(t.standards("id", "system", "grade"), "id").select("system", "grade", "id", F.round(vectors.cosine_to(F.col("vec"), standard_probe(t)), 4).alias("score"))
    return ranking.top_per_group(scored, ["system", "grade"], [F.col("score").desc(), F.col("id").desc()], 2)


_ASKED = "asked AS (SELECT id AS q, vec AS qv, CASE WHEN hash_no % 3 = 0 THEN '1-5' WHEN hash_no % 3 = 1 THEN 'K to 8' END AS span FROM (SELECT *, length(id) AS hash_no FROM v))"


@query(
    with_(V, _SP, _ASKED, f"x AS (SELECT q, grade, v.id, {_cos('qv', 'vec')} AS score, CASE span WHEN '1-5' THEN 1 ELSE 0 END AS lo, CASE span WHEN '1-5' THEN 5 WHEN 'K to 8' THEN 8 ELSE 98 END AS hi FROM asked, v JOIN sp ON v.id = sp.id WHERE system = '{HUB}')")
    + f"SELECT q, grade, id, score FROM (SELECT *, row_number() OVER (PARTITION BY q, grade ORDER BY score DESC, id DESC) AS k FROM x WHERE score >= 0.5 AND {rank_sql('grade')} BETWEEN lo AND hi) WHERE k <= 3"
)
def vec_progression(spark, root) -> DataFrame:
    """The progression of every standard with a vector through the hub, with three kinds of bounds."""
    t = Tables(spark, root)
    span = F.when(F.length("id") % 3 == 0, "1-5").when(F.length("id") % 3 == 1, "K to 8")
    asked = t.vectors().select(F.col("id").alias("q"), "vec", F.lit(HUB).alias("scope"), span.alias("start"), F.lit(None).cast("string").alias("end"))
    rows = t.vectors().join(t.standards("id", "system", "grade").where(F.col("system") == HUB), "id").select("id", "vec", F.col("system").alias("scope"), "grade")
    return tools.progression_many(rows, asked)


@query(with_(V, _SP) + f"SELECT q, id, score, k::INTEGER AS rank_no FROM (SELECT a.id AS q, b.id, {_cos('a.vec', 'b.vec')} AS score, row_number() OVER (PARTITION BY a.id ORDER BY {_cos('a.vec', 'b.vec')} DESC, b.id DESC) AS k FROM v a, v b JOIN sp ON sp.id = b.id WHERE sp.system = 'dorn-state') WHERE k <= 5")
def tool_search_many(spark, root) -> DataFrame:
    """The search of every standard with a vector in one system."""
    t = Tables(spark, root)
    asked = t.vectors().select(F.col("id").alias("q"), "vec", F.lit("dorn-state").alias("scope"))
    rows = t.vectors().join(t.standards("id", "system").where("system = 'dorn-state'"), "id").select("id", "vec", F.col("system").alias("scope"))
    return tools.search_many(rows, asked)


_POST = "post AS (SELECT word, id, count(*) AS tf, any_value(len) AS len FROM (SELECT id, len(ws) AS len, unnest(ws) AS word FROM d) GROUP BY ALL)"


@query(with_(_WORDS, _POST) + "SELECT word, id, tf, len::INTEGER AS len FROM post")
def fts_index(spark, root) -> DataFrame:
    rows = Tables(spark, root).standards("id", "system", "subject", "grade", "domain", "cluster", "standard_text")
    return fts.postings(rows, "id", "standard_text", "domain", "cluster")


_TERMS = "a AS (SELECT q, substr(lower(w), 1, 6) AS term FROM (SELECT q, unnest(regexp_extract_all(query, '[A-Za-z]{5,}')) AS w FROM asked))"
_HITS = "h AS (SELECT term, id, sum(tf)::DOUBLE AS tf, any_value(len)::DOUBLE AS len FROM post JOIN (SELECT DISTINCT term FROM a) t ON length(word) >= 5 AND starts_with(word, term) GROUP BY ALL), df AS (SELECT term, count(*)::DOUBLE AS df FROM h GROUP BY 1), z AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS al FROM d WHERE len(ws) > 0)"
_BM = "sc AS (SELECT q, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM a JOIN h USING (term) JOIN df USING (term), z GROUP BY ALL)"
_DOCS = _WORDS.replace("SELECT DISTINCT id, system, subject, grade, domain, cluster, standard_text FROM standards", "SELECT DISTINCT id, system, domain, cluster, standard_text FROM standards")


@query(with_(_DOCS, _POST, "asked AS (SELECT DISTINCT concat_ws('|', domain, system) AS q, domain AS query, system FROM standards WHERE trim(domain) <> '')", _TERMS, _HITS, _BM) + "SELECT q, id, score, k::INTEGER AS rank_no FROM (SELECT sc.q, sc.id, score, row_number() OVER (PARTITION BY sc.q ORDER BY score DESC, sc.id) AS k FROM sc JOIN asked ON asked.q = sc.q JOIN (SELECT DISTINCT id, system FROM standards) s ON s.id = sc.id AND s.system = asked.system) WHERE k <= 5")
def fts_scope(spark, root) -> DataFrame:
    """The five best of each system for the names of its domains, by words."""
    t = Tables(spark, root)
    asked = t.standards("domain", "system").where("trim(domain) <> ''").select(F.concat_ws("|", "domain", "system").alias("q"), F.col("domain").alias("query"), "system").distinct()
    return tools.search_text_many(t.standards(), asked)


@query("SELECT DISTINCT domain, array_to_string(list_transform(regexp_extract_all(domain, '[A-Za-z]{5,}'), lambda w: lower(substr(w, 1, 6))), ',') AS terms FROM standards WHERE domain IS NOT NULL")
def fts_query(spark, root) -> DataFrame:
    return Tables(spark, root).standards("domain").where("domain is not null").select("domain", F.array_join(fts.terms_of(F.col("domain")), ",").alias("terms"))


@query("SELECT upper(regexp_replace(id, '[.][0-9]{4,}$', '')) AS name, count(DISTINCT id) AS n FROM (SELECT id FROM sub_standards UNION ALL SELECT id FROM standards) GROUP BY 1 HAVING count(DISTINCT id) > 1")
def agg_collisions(spark, root) -> DataFrame:
    """Ids that differ in letter case or in a last segment of digits only."""
    t = Tables(spark, root)
    ids = t.raw("sub_standards").select("id").unionByName(t.raw("standards").select("id"))
    return ids.groupBy(F.upper(text.stem_id(F.col("id"))).alias("name")).agg(F.countDistinct("id").alias("n")).where("n > 1")


@query(with_(C) + f"SELECT target_system, count(*) AS n, round(100.0 * count(CASE WHEN confidence_score >= 0.9 THEN 1 END) / count(*), 2) AS top, round(100.0 * count(CASE WHEN confidence_score < 0.7 THEN 1 END) / count(*), 2) AS low FROM c WHERE {OK_SCORE} GROUP BY ALL")
def agg_band_pct(spark, root) -> DataFrame:
    """The share of each target system's mappings in the first and the last band."""
    x = F.col("confidence_score")
    c = Tables(spark, root).mappings("target_system", "confidence_score").where(x.isNotNull() & ~F.isnan(x))
    pct = lambda cond: F.round(F.lit(100.0) * F.count_if(cond) / F.count("*"), 2)
    return c.groupBy("target_system").agg(F.count("*").alias("n"), pct(x >= 0.9).alias("top"), pct(x < 0.7).alias("low"))


@query("SELECT grade, id FROM (SELECT grade, id, row_number() OVER (PARTITION BY grade ORDER BY md5('7:' || id), id) AS r FROM (SELECT DISTINCT grade, id FROM standards WHERE grade IS NOT NULL)) WHERE r <= 5")
def smp_random(spark, root) -> DataFrame:
    return ranking.sampled(Tables(spark, root).standards("grade", "id").where("grade is not null"), ["grade"], "id", 5, seed=7)


@query(with_(C) + f"SELECT id, confidence_score FROM c WHERE {OK_SCORE} AND verified_by_human = 0 ORDER BY confidence_score, id LIMIT 25")
def limit_worst(spark, root) -> DataFrame:
    """The 25 least confident mappings that nobody has looked at."""
    x = F.col("confidence_score")
    return Tables(spark, root).mappings("confidence_score", "verified_by_human").where(x.isNotNull() & ~F.isnan(x) & (F.col("verified_by_human") == 0)).orderBy("confidence_score", "id").limit(25).select("id", "confidence_score")


@query(with_(C) + f"SELECT source_id, round(product(confidence_score), 6) AS p FROM c WHERE {OK_SCORE} AND confidence_score BETWEEN 0 AND 1 AND source_id IS NOT NULL AND target_system = '{HUB}' GROUP BY 1")
def fn_product(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("source_id", "target_system", "confidence_score").where(f"confidence_score between 0 and 1 and not isnan(confidence_score) and source_id is not null and target_system = '{HUB}'")
    return c.groupBy("source_id").agg(F.round(F.product("confidence_score"), 6).alias("p"))


@query(with_(C) + f"SELECT target_id, count(*) AS n, count(DISTINCT source_system) AS systems FROM c WHERE target_system = '{HUB}' AND target_id IS NOT NULL GROUP BY 1")
def map_hubvol(spark, root) -> DataFrame:
    """How many mappings, of how many systems, every hub standard has."""
    c = Tables(spark, root).mappings("target_id", "target_system", "source_system").where((F.col("target_system") == HUB) & F.col("target_id").isNotNull())
    return c.groupBy("target_id").agg(F.count("*").alias("n"), F.countDistinct("source_system").alias("systems"))


@query(with_(V, _SP, _R, f"x AS (SELECT a.system, {_cos('a.vec', 'b.vec')} AS cosine FROM r a JOIN r b ON a.system = b.system AND a.grade = b.grade AND a.id < b.id)") + "SELECT system, count(*) AS pairs, max(cosine) AS most FROM x WHERE cosine >= 0.95 GROUP BY 1")
def dq_near_dupes(spark, root) -> DataFrame:
    """Near duplicates by system, with a lower threshold than the pairs of :func:`vec_near_dup`."""
    r = Tables(spark, root).vector_rows()
    rows = r.where("grade is not null").withColumn("scope", F.concat_ws("|", "system", "grade"))
    pairs = vectors.similarity_join(rows, rows, "scope", 0.95, ("system",), "after:0")
    return pairs.groupBy(F.col("a_system").alias("system")).agg(F.count("*").alias("pairs"), F.max("cosine").alias("most"))


@query("SELECT system, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT subject) FILTER (subject IS NOT NULL), list(DISTINCT grade_band) FILTER (grade_band IS NOT NULL)))), ',') AS names FROM standards GROUP BY 1")
def set_union_py(spark, root) -> DataFrame:
    """The union of two sets of each group, as arrays."""
    s = Tables(spark, root).raw("standards").groupBy("system").agg(F.collect_set("subject").alias("a"), F.collect_set("grade_band").alias("b"))
    return s.select("system", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("names"))


# Texts of every language.

_STOP, _MORE = (", ".join(f"'{w}'" for w in words) for words in (text.STOP_WORDS, (*text.STOP_WORDS, "science", "including")))
#: A word of ASCII letters whose neighbours are no letters of any kind: those beyond ASCII are digits first, for a boundary knows ASCII only.
_KEY = "w AS (SELECT id, list_filter(regexp_extract_all(regexp_replace(lower(standard_text), '[^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{N}}]', '0', 'g'), '\\b[a-zA-Z][a-zA-Z-]{{3,}}\\b'), lambda x: NOT list_contains([{}], x)) AS ws FROM s WHERE standard_text IS NOT NULL)"


@query(with_(S, _KEY.format(_STOP), "k AS (SELECT id, unnest(ws) AS keyword, unnest(range(len(ws))) AS p FROM w)", "f AS (SELECT id, keyword, min(p) AS p FROM k GROUP BY ALL)") + "SELECT id, keyword FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM f) WHERE r <= 20")
def txt_keywords(spark, root) -> DataFrame:
    s = Tables(spark, root).standards()
    return s.select("id", "system", "grade", "last_verified_date", F.explode(text.keywords(F.col("standard_text"))).alias("keyword")).select("id", "keyword")


@query(with_(S, _KEY.format(_MORE), "k AS (SELECT id, unnest(ws) AS keyword, unnest(range(len(ws))) AS p FROM w)", "f AS (SELECT id, keyword, min(p) AS p FROM k GROUP BY ALL)") + "SELECT id, string_agg(keyword, ',' ORDER BY p) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM f) WHERE r <= 20 GROUP BY id")
def txt_stop_variants(spark, root) -> DataFrame:
    """The words that are left with a longer list."""
    s = Tables(spark, root).standards().where("standard_text is not null")
    words = F.array_join(text.keywords(F.col("standard_text"), (*text.STOP_WORDS, "science", "including")), ",")
    return s.select("id", "system", "grade", "last_verified_date", words.alias("keywords")).where("keywords <> ''").select("id", "keywords")


_WS = "[ \\t\\n\\r\\f\\x0B]+"


def _escaped(col: F.Column) -> F.Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL")
def txt_html(spark, root) -> DataFrame:
    """Every document as a page with tags, a script and escaped signs, and back."""
    d = Tables(spark, root).raw("documents").where("text is not null")
    page = F.concat(F.lit('<style>p {x: "<y>"}</style><p class="a">'), _escaped(F.col("text")), F.lit("</p><script>x < y</script>"))
    return d.select("doc_id", text.html_text(page).alias("t"))


@query(with_(S) + f"SELECT id, 'Standard ' || id || ' ' || trim(regexp_replace(standard_text, '{_WS}', ' ', 'g')) AS t FROM s WHERE trim(regexp_replace(standard_text, '{_WS}', ' ', 'g')) <> ''")
def src_html_text(spark, root) -> DataFrame:
    """The text of pages that were made of the standards."""
    s = Tables(spark, root).standards().where("standard_text is not null")
    page = F.concat(F.lit("<html><body><h1>Standard "), F.col("id"), F.lit("</h1>\n<div>"), _escaped(F.col("standard_text")), F.lit("</div></body></html>"))
    plain = F.trim(F.regexp_replace("standard_text", r"\s+", " "))
    return s.where(plain != "").select("id", text.html_text(page).alias("t"))


@query(with_(U) + f"SELECT DISTINCT parent_id, id AS anchor, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS text FROM u WHERE parent_id IS NOT NULL AND trim(text) <> ''")
def src_html_anchor(spark, root) -> DataFrame:
    u = Tables(spark, root).subs("parent_id", "id", "text").where("parent_id is not null and trim(text) <> ''")
    part = F.concat(F.lit('<a name="'), F.col("id"), F.lit('"></a>'), _escaped(F.col("text")))
    page = u.groupBy("parent_id").agg(F.array_join(F.array_sort(F.collect_list(part)), "<br>").alias("html"))
    return page.select("parent_id", F.explode(text.html_anchors(F.col("html"))).alias("a")).select("parent_id", "a.anchor", "a.text")


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, 'Aims and Outcomes', ''), '^[ \\t\\n\\r\\f\\x0B]*[0-9]{{1,4}}{_WS}', ''), '{_WS}[0-9]{{1,4}}[ \\t\\n\\r\\f\\x0B]*$', '')) AS t FROM documents WHERE text IS NOT NULL")
def txt_page_header(spark, root) -> DataFrame:
    return Tables(spark, root).raw("documents").where("text is not null").select("doc_id", text.page_header(F.col("text"), ["Aims and Outcomes"]).alias("t"))


@query("SELECT doc_id, pos - 1 AS at, part FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(text, '•'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL))")
def txt_bullets(spark, root) -> DataFrame:
    d = Tables(spark, root).raw("documents").where("text is not null")
    return d.select("doc_id", F.posexplode(text.bullets(F.col("text"))).alias("at", "part")).select("doc_id", F.col("at").cast("long").alias("at"), "part")


@query(with_(U, "x AS (SELECT DISTINCT id, trim(regexp_extract(text, '^(.*?)(?:\\n[ \\t\\n\\r\\f\\x0B]*\\n|$)', 1, 's')) AS body FROM u WHERE text IS NOT NULL)") + "SELECT id, '«' || id || '»' AS code, body AS text FROM x WHERE length(body) > 10")
def txt_code_split(spark, root) -> DataFrame:
    """The text of each code of a page, up to the next code or an empty line."""
    u = Tables(spark, root).subs("id", "text").where("text is not null").select("id", F.concat(F.lit("«"), F.col("id"), F.lit("» "), F.col("text")).alias("page")).distinct()
    return u.select("id", F.explode(text.coded_items(F.col("page"), "«[^»]+»")).alias("c")).select("id", "c.code", "c.text")


@query(
    with_(U, "x AS (SELECT DISTINCT id, string_split(text, ' ') AS ws FROM u WHERE text IS NOT NULL AND NOT regexp_matches(text, '[ \\t\\n\\r\\f\\x0B]{2,}|[\\t\\n\\r\\f\\x0B]|^ | $'))")
    + "SELECT id, rtrim('the and of ' || array_to_string(ws, ' ')) AS text FROM x WHERE len(list_filter(ws, lambda w: list_contains(['the','and','for','are','with','to','of','learners'], reverse(lower(regexp_replace(w, '[^A-Za-z]', '', 'g')))))) = 0"
)
def txt_reversed(spark, root) -> DataFrame:
    """Texts stored backwards, word by word, and forwards again. Texts with other white space than single blanks come back with those, and are a fixture's."""
    u = Tables(spark, root).subs("id", "text").where("text is not null").distinct()
    u = u.where(~F.col("text").rlike(r"\s{2,}|[\t\n\r\f\x0B]|^ | $"))
    back = F.concat(F.lit("eht dna fo "), F.array_join(F.transform(F.split("text", " "), lambda w: F.reverse(w)), " "))
    odd = F.exists(F.split("text", " "), lambda w: F.reverse(F.lower(F.regexp_replace(w, "[^A-Za-z]", ""))).isin(*text.FORWARD))
    return u.where(~odd).select("id", text.unreversed(back).alias("text"))


@query("SELECT DISTINCT id, position::INTEGER AS n FROM sub_standards WHERE position BETWEEN 1 AND 89")
def txt_roman(spark, root) -> DataFrame:
    """Positions written as Roman numerals and read again."""
    tens, ones = (F.array(*(F.lit(x) for x in xs)) for xs in (("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")))
    p = F.col("position")
    u = Tables(spark, root).subs("id", "position").where("position between 1 and 89")
    written = F.concat(F.lit(" "), F.get(tens, F.floor(p / 10).cast("int")), F.get(ones, (p % 10).cast("int")))
    return u.select("id", text.roman_value(written).alias("n")).distinct()


@query("SELECT DISTINCT id, position, CASE position % 8 + 1 WHEN 1 THEN 'K' WHEN 2 THEN '1' WHEN 3 THEN '2' WHEN 4 THEN '3' WHEN 5 THEN '4' WHEN 6 THEN '5' ELSE 'x' END AS grade FROM sub_standards WHERE position IS NOT NULL")
def txt_stage_regrade(spark, root) -> DataFrame:
    u = Tables(spark, root).subs("id", "position").where("position is not null")
    stage = F.concat(F.lit("CAMBRIDGE.MATH."), (F.col("position") % 8 + 1).cast("string"), F.lit(".A"))
    return u.select("id", "position", text.stage_grade(stage, F.lit("x")).alias("grade"))


@query("SELECT DISTINCT grade, grade || '.' || p::VARCHAR AS practice FROM standards, range(1, 9) r(p) WHERE grade IN ('K','1','2','3','4','5','6','7','8','HS')")
def mt_mp_expand(spark, root) -> DataFrame:
    """The eight practices of every grade that the table has."""
    g = Tables(spark, root).standards("grade").where(F.col("grade").isin(*grades.GRADE_ORDER))
    return g.select("grade", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("p")).select("grade", F.concat_ws(".", "grade", F.col("p").cast("string")).alias("practice"))


@query("SELECT DISTINCT grade_band, g.grade, g.grade IN (SELECT unnest(['K','1','2','3','4','5','6','7','8','HS'])) AND (CASE WHEN grade_band LIKE '%-%' THEN " + f"{rank_sql('g.grade')} BETWEEN {rank_sql('''split_part(grade_band, '-', 1)''')} AND {rank_sql('''split_part(grade_band, '-', 2)''')} ELSE g.grade = grade_band END) AS inside FROM standards, (SELECT DISTINCT grade FROM standards WHERE grade IS NOT NULL) g WHERE regexp_matches(grade_band, '^(?:K|[1-8]|HS)-(?:K|[1-8]|HS)$')")
def txt_grade_filter(spark, root) -> DataFrame:
    """Which written grade every band lets through."""
    s = Tables(spark, root).standards("grade_band", "grade")
    bands = s.where(F.col("grade_band").rlike("^(?:K|[1-8]|HS)-(?:K|[1-8]|HS)$")).select("grade_band").distinct()
    every = s.where("grade is not null").select(F.lit(1).alias("k"), "grade").distinct()  # a few dozen values, as the bands are
    both = bands.withColumn("k", F.lit(1)).join(every, "k")
    inside = grades.within(F.col("grade"), grades.written_bounds(F.col("grade_band"), F.lit(None).cast("string")), unknown=False)
    return both.select("grade_band", "grade", inside.alias("inside"))


@query("SELECT DISTINCT grade_band, nullif(split_part(grade_band, '-', 1), '') AS lo, nullif(split_part(grade_band, '-', 2), '') AS hi FROM standards WHERE regexp_matches(grade_band, '^(?:K|[1-8]|HS)-(?:K|[1-8]|HS)$')")
def txt_norm_bounds(spark, root) -> DataFrame:
    """The bounds of every band, written loosely: in lower case with a word between them."""
    loose = F.lower(F.replace("grade_band", F.lit("-"), F.lit(" to ")))
    b = Tables(spark, root).standards("grade_band").where(F.col("grade_band").rlike("^(?:K|[1-8]|HS)-(?:K|[1-8]|HS)$"))
    return b.select("grade_band", grades.written_bounds(F.lit(None).cast("string"), loose).alias("b")).select("grade_band", "b.lo", "b.hi")


@query(with_(C) + "SELECT mismatch, count(*) AS n FROM (SELECT coalesce(nullif(regexp_extract(notes || ' | MISMATCH: ' || relationship || '. ', 'MISMATCH:\\s*(.+?)\\.?\\s*$', 1), ''), 'unknown') AS mismatch FROM c) GROUP BY 1")
def txt_mismatch(spark, root) -> DataFrame:
    """The mismatches of notes that have one, by their wording."""
    c = Tables(spark, root).mappings("notes", "relationship")
    note = F.concat(F.col("notes"), F.lit(" | MISMATCH: "), F.col("relationship"), F.lit(". "))
    return c.groupBy(notes.mismatch(note).alias("mismatch")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id, CASE WHEN regexp_matches(substr(last_verified_date, 1, 4), '^[0-9]{4}$') THEN substr(last_verified_date, 1, 4)::INTEGER END AS year FROM standards")
def fn_substr_int(spark, root) -> DataFrame:
    head = F.substring("last_verified_date", 1, 4)
    return Tables(spark, root).standards("id", "last_verified_date").select("id", F.when(head.rlike("^[0-9]{4}$"), head.try_cast("int")).alias("year")).distinct()


@query(f"SELECT count(DISTINCT n) <= 100000 AS bounded, count(*) AS rows, min(n) >= 0 AS positive FROM (SELECT DISTINCT id, standard_text, 0 AS n FROM standards)")
def fn_synthetic_id(spark, root) -> DataFrame:
    """Numbers of texts: bounded, and equal for equal beginnings, which is checked on the spot."""
    s = Tables(spark, root).standards("id", "standard_text").distinct()
    n = s.select("id", text.synthetic_id(F.col("standard_text")).alias("n"), text.synthetic_id(F.substring("standard_text", 1, 40)).alias("m"))
    return n.agg((F.countDistinct("n") <= 100_000).alias("bounded"), F.count_if(F.col("n").eqNullSafe(F.col("m"))).alias("rows"), (F.coalesce(F.min("n"), F.lit(0)) >= 0).alias("positive"))


@query("SELECT system, count(*) AS n, bool_and(created_at < now()::TIMESTAMP) AS past, max(created_at) AS last FROM (SELECT DISTINCT id, system, created_at FROM standards) GROUP BY 1")
def fn_now(spark, root) -> DataFrame:
    s = Tables(spark, root).standards("id", "system", "created_at")
    return s.groupBy("system").agg(F.count("*").alias("n"), F.bool_and(F.col("created_at") < F.current_timestamp()).alias("past"), F.max("created_at").alias("last"))


@query("SELECT DISTINCT id, CASE split_part(id, '.', 4) WHEN 'PS' THEN 'Physical Science' WHEN 'LS' THEN 'Life Science' WHEN 'ES' THEN 'Earth Science' ELSE 'Science' END AS domain FROM standards WHERE split_part(id, '.', 2) = 'SCI'")
def txt_ngss_domain(spark, root) -> DataFrame:
    """The domain that the fourth segment of a science id names."""
    names = F.create_map(*(F.lit(x) for x in ("PS", "Physical Science", "LS", "Life Science", "ES", "Earth Science")))
    parts = F.split("id", r"\.")
    s = Tables(spark, root).standards("id").where(F.get(parts, F.lit(1)) == "SCI")
    return s.select("id", F.coalesce(F.try_element_at(names, F.coalesce(F.get(parts, F.lit(3)), F.lit(""))), F.lit("Science")).alias("domain"))


@query(with_(C) + "SELECT id, round(CAST(confidence_score AS DECIMAL(20,8)), 2)::DOUBLE AS score FROM c WHERE confidence_score IS NOT NULL AND NOT isnan(confidence_score) AND abs(confidence_score) < 1e9")
def prj_round(spark, root) -> DataFrame:
    """Finite scores to 2 places, halves away from zero, as decimals."""
    c = F.col("confidence_score")
    return Tables(spark, root).mappings("confidence_score").where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e9)).select("id", F.round(c.cast("decimal(20,8)"), 2).cast("double").alias("score"))


# Sources.


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def src_rest_json(spark, root) -> DataFrame:
    """Bodies of a service that was asked once for each key; a second run is answered by the cache alone."""
    e = Tables(spark, root).raw("events").select(F.col("event_id").cast("string").alias("key"), "props")
    cache = scratch(spark)
    keys = e.select(F.to_json(F.struct(F.col("key").alias("id"), "props")).alias("key"))

    def service(request: str) -> str:
        asked = json.loads(request)
        return json.dumps({"id": int(asked["id"]), "body": json.loads(asked["props"])})

    def silent(request: str) -> str:
        raise ConnectionError(request)

    pages.fetched(keys, service, cache)
    body = F.from_json("body", "id bigint, body struct<k: bigint>")
    return pages.fetched(keys, silent, cache).select(body.alias("b")).select(F.col("b.id").alias("event_id"), "b.body.k")


def _documents(t: Tables) -> DataFrame:
    """Documents of pages, one for each parent, as a service would deliver them: JSON in bytes, a page a part, with a running header."""
    u = t.subs("id", "parent_id", "text").where("parent_id is not null").select("id", "parent_id", "text").distinct()
    page = F.struct("id", F.coalesce("text", F.lit("")).alias("text"))
    return u.groupBy(F.col("parent_id").alias("path")).agg(F.encode(F.to_json(F.array_sort(F.collect_list(page))), "UTF-8").alias("content"))


def _pages(content: bytes) -> list[str]:
    return [f"Aims and Outcomes {p['text']} {i}" for i, p in enumerate(json.loads(content), 1)]


@query(with_("u AS (SELECT DISTINCT id, parent_id, text FROM sub_standards WHERE parent_id IS NOT NULL)") + "SELECT parent_id AS path, (row_number() OVER (PARTITION BY parent_id ORDER BY id, coalesce(text, '')))::INTEGER AS page, length('Aims and Outcomes ' || coalesce(text, '') || ' ' || (row_number() OVER (PARTITION BY parent_id ORDER BY id, coalesce(text, '')))::VARCHAR)::INTEGER AS n FROM u")
def src_pdf_text(spark, root) -> DataFrame:
    """The texts of all pages of all documents."""
    found = pages.page_texts(_documents(Tables(spark, root)), _pages)
    return found.where("error is null").select("path", "page", F.length("text").alias("n"))


@query(with_("u AS (SELECT DISTINCT id, parent_id, text FROM sub_standards WHERE parent_id IS NOT NULL)") + "SELECT parent_id AS path, id, trim(coalesce(text, '')) AS text FROM u")
def src_pdf_text_mupdf(spark, root) -> DataFrame:
    """Blocks of pages, a reader's other form: each with its id, headers and page numbers taken off; a document that cannot be read gives an error."""

    def blocks(content: bytes) -> list[str]:
        return [f"{p['id']}\t{p['text']}" for p in json.loads(content)]

    docs = _documents(Tables(spark, root)).unionByName(spark.createDataFrame([("broken", bytearray(b"%PDF"))], "path string, content binary"))
    found = pages.page_texts(docs, blocks).where("error is null")
    return found.select("path", F.substring_index("text", "\t", 1).alias("id"), F.trim(F.substring(F.col("text"), F.instr("text", "\t") + 1, F.length("text"))).alias("text"))


@query(with_(S) + "SELECT system AS path, id, grade, coalesce(domain, '') AS domain FROM (SELECT DISTINCT system, id, grade, CASE WHEN trim(domain) <> '' THEN trim(domain) END AS domain FROM s WHERE grade IS NOT NULL AND trim(grade) <> '')")
def src_pdf_table(spark, root) -> DataFrame:
    """Tables over several pages whose header stands on the first one; repeated cells are left empty and carried down."""
    s = Tables(spark, root).standards("system", "id", "grade", "domain").where("trim(grade) <> ''").select("system", F.coalesce(F.trim("domain"), F.lit("")).alias("domain"), "grade", "id").distinct()
    rows = s.groupBy("system", "grade", F.floor(F.pmod(F.xxhash64("id"), F.lit(1000)) / 20).alias("part")).agg(F.array_sort(F.collect_list(F.struct("domain", "id"))).alias("r"))
    docs = rows.select(F.concat_ws("#", "system", "grade", F.col("part").cast("string")).alias("path"), F.encode(F.to_json(F.struct("grade", "r")), "UTF-8").alias("content"))

    def read(content: bytes) -> list[list[list[str | None]]]:
        doc = json.loads(content)
        out, last = [["Grade", "Domain", "Id"]], None
        for i, r in enumerate(doc["r"]):
            domain = r["domain"] or "none"
            out.append([doc["grade"] if i == 0 else "", "" if domain == last else domain, r["id"]])
            last = domain
        return [out[i : i + 7] for i in range(0, len(out), 7)]

    found = pages.page_tables(docs, read, lambda cells: cells[0] == "Grade", ["grade", "domain", "id"])
    return found.select(F.substring_index("path", "#", 1).alias("path"), "id", "grade", F.when(F.col("domain") == "none", "").otherwise(F.col("domain")).alias("domain"))


@query("SELECT standard_id, model, len(vector)::INTEGER AS n, round(list_sum(list_transform(vector, lambda x: x::DOUBLE)), 6) AS total FROM (SELECT DISTINCT * FROM standard_embeddings) WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0")
def src_vector_blob(spark, root) -> DataFrame:
    """Vectors as the bytes that a store has of them, and read again."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    e = Tables(spark, root).raw("standard_embeddings").distinct().where((F.size("vector") == 64) & ~bad).select("standard_id", "model", "vector")
    blobs = hierarchy.encoded_vectors(e, "vector", "blob").select("standard_id", "model", "blob")
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return hierarchy.decoded_vectors(blobs, "blob", 64).select("standard_id", "model", F.size("vec").alias("n"), F.round(total, 6).alias("total"))


@query("SELECT 'standard' AS kind, system AS set_id, id, coalesce(domain, '') AS domain, coalesce(cluster, '') AS cluster FROM (SELECT DISTINCT system, id, domain, cluster FROM standards) UNION ALL SELECT 'part', s.system, u.id, u.parent_id, u.text FROM (SELECT id, min(parent_id) AS parent_id, min(text) AS text FROM sub_standards GROUP BY id) u JOIN (SELECT DISTINCT id, system FROM standards) s ON s.id = u.parent_id")
def src_hier_ccss(spark, root) -> DataFrame:
    """The standards and the parts of a tree with fixed levels."""
    standards, parts = hierarchy.fixed_roles(_nodes(Tables(spark, root)))
    one = standards.select(F.lit("standard").alias("kind"), "set_id", "id", "domain", "cluster")
    return one.unionByName(parts.select(F.lit("part").alias("kind"), "set_id", "id", F.col("parent_id").alias("domain"), F.col("text").alias("cluster")))


@query("SELECT DISTINCT id FROM retired_standards WHERE id NOT IN (SELECT id FROM standards)")
def src_attach(spark, root) -> DataFrame:
    """A second database beside the first: its table is read from another root and compared."""
    t, other = Tables(spark, root), scratch(spark)
    t.raw("retired_standards").write.parquet(f"{other}/standards.parquet")
    return Tables(spark, other).standards("id").join(t.standards("id"), "id", "left_anti")


_GOLD = "l AS (SELECT DISTINCT target_id || '|' || prereq_id AS key, CASE WHEN same_grade THEN 'HARD' ELSE 'SOFT' END AS label FROM prereq_gold_sample WHERE target_id IS NOT NULL AND prereq_id IS NOT NULL)"


@query(with_(_GOLD) + "SELECT key, CASE WHEN length(key) % 5 = 0 THEN 'NONE' ELSE label END AS label FROM l")
def src_jsonl(spark, root) -> DataFrame:
    """Labels as lines of JSON in two deliveries; the later line of a key counts, others do not."""
    g = Tables(spark, root).raw("prereq_gold_sample").where("target_id is not null and prereq_id is not null")
    path = scratch(spark)
    first = g.select(F.concat_ws("|", "target_id", "prereq_id").alias("key"), F.when(F.col("same_grade"), "HARD").otherwise("SOFT").alias("label"), F.lit("x").alias("reason")).distinct()
    first.write.json(f"{path}/1")
    first.where(F.length("key") % 5 == 0).withColumn("label", F.lit("NONE")).write.json(f"{path}/2")
    return hierarchy.last_labels(spark, [f"{path}/1", f"{path}/2"]).select("key", "label")


@query("SELECT id, system FROM retired_standards")
def src_json_file(spark, root) -> DataFrame:
    """Documents of several lines, each an array of at most about fifty records."""
    path = scratch(spark)
    rows = Tables(spark, root).raw("retired_standards").select("id", "system")
    part = F.pmod(F.xxhash64("id"), F.lit(-(-rows.count() // 50) or 1)).cast("int").alias("part")
    text_ = F.replace(F.to_json(F.collect_list(F.struct("id", "system"))), F.lit("},"), F.lit("},\n"))
    rows.groupBy(part).agg(text_.alias("value")).write.partitionBy("part").text(path)
    return hierarchy.json_documents(spark, path, "id string, system string").select("id", "system")


@query(with_("t AS (SELECT DISTINCT id, coalesce(standard_text, '') AS x FROM standards WHERE id NOT IN (SELECT standard_id FROM standard_embeddings WHERE standard_id IS NOT NULL))") + "SELECT id, 64 AS dims, max(greatest(1, length(x) - 2))::DOUBLE AS total FROM t GROUP BY id")
def vec_embed_inc(spark, root) -> DataFrame:
    """Vectors for standards that have none, from hashed trigrams in place of a model; the sum counts a text's trigrams."""
    t = Tables(spark, root)
    longest = F.max_by("standard_text", F.length(F.coalesce("standard_text", F.lit(""))))
    pending = t.raw("standards").groupBy("id").agg(longest.alias("text")).join(t.raw("standard_embeddings").select(F.col("standard_id").alias("id")), "id", "left_anti")
    vec = hierarchy.embedded(pending, hierarchy.hashed_ngrams(64))
    return vec.select("id", F.size("vec").alias("dims"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query("SELECT doc_id::VARCHAR AS id, greatest(1, length(coalesce(text, '')) - 2)::DOUBLE AS total FROM documents")
def vec_embed(spark, root) -> DataFrame:
    """A vector for every document."""
    d = Tables(spark, root).raw("documents").select(F.col("doc_id").alias("id"), "text")
    return hierarchy.embedded(d, hierarchy.hashed_ngrams(64)).select("id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


# Sinks.

_HASH = "('0x' || substr(md5({}), 1, 10))::BIGINT"
_SUBS = "to_json({'id': id, 'system': system, 'text': coalesce(text, ''), 'position': position})"


def _sub_lines(t: Tables) -> DataFrame:
    return t.subs("id", "system", "text", "position").where("position is not null and id is not null and system is not null").select("id", "system", F.coalesce("text", F.lit("")).alias("text"), "position").distinct()


_SUB_ROWS = "x AS (SELECT DISTINCT id, system, coalesce(text, '') AS text, position FROM sub_standards WHERE position IS NOT NULL AND id IS NOT NULL AND system IS NOT NULL)"


@query(with_(_SUB_ROWS, f"j AS (SELECT replace({_SUBS}::VARCHAR, '\\/', '/') AS j FROM x)") + f"SELECT count(*)::BIGINT AS lines, sum(octet_length(encode(j)) + 1)::BIGINT AS bytes, sum({_HASH.format('j')})::BIGINT AS checksum FROM j")
def snk_jsonl_hash(spark, root) -> DataFrame:
    files = sinks.write_json_lines(_sub_lines(Tables(spark, root)), scratch(spark))
    return files.agg(*(F.sum(c).cast("bigint").alias(c) for c in ("lines", "bytes", "checksum")))


@query(
    with_("a AS (SELECT DISTINCT id, system FROM standards)", "b AS (SELECT DISTINCT id, system FROM retired_standards)")
    + "".join(f" SELECT '{n}' AS name, count(*) AS n, sum({_HASH.format('''to_json({'id': id, 'system': system})::VARCHAR''')})::BIGINT AS checksum FROM {t} {u}" for n, t, u in (("standards", "a", "UNION ALL"), ("retired_standards", "b", "")))
)
def snk_manifest(spark, root) -> DataFrame:
    t = Tables(spark, root)
    return sinks.manifest({"standards": t.standards("id", "system"), "retired_standards": t.raw("retired_standards").select("id", "system").distinct()})


@query("SELECT to_json({'system': system, 'grades': list_sort(list(DISTINCT grade) FILTER (grade IS NOT NULL))})::VARCHAR AS json FROM standards WHERE system IS NOT NULL GROUP BY system")
def fn_json_out(spark, root) -> DataFrame:
    """An object with an array for each system."""
    s = Tables(spark, root).raw("standards").where("system is not null").groupBy("system").agg(F.array_sort(F.collect_set("grade")).alias("grades"))
    return s.select(F.to_json(F.struct("system", "grades")).alias("json"))


_PAIR = "source_id, target_id, relationship"


@query(with_(E, f"x AS (SELECT {_PAIR}, id FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL)", f"b AS (SELECT {_PAIR}, max(id) AS id FROM x WHERE id % 2 = 0 GROUP BY ALL)") + f"SELECT {_PAIR}, id FROM b UNION ALL SELECT {_PAIR}, min(id) FROM x WHERE ({_PAIR}) NOT IN (SELECT {_PAIR} FROM b) GROUP BY ALL")
def snk_ignore(spark, root) -> DataFrame:
    """Edges inserted into a table that has some of their keys: the rows that are there stay."""
    k = ["source_id", "target_id", "relationship"]
    e = Tables(spark, root).edges(*k, "id").where("source_id is not null and target_id is not null and relationship is not null")
    base = e.where("id % 2 = 0").groupBy(*k).agg(F.max("id").alias("id"))
    return upsert.insert_missing(base, e, k)


@query(
    with_(C, "x AS (SELECT source_id, target_id, min(id) AS id FROM c WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY ALL)", "y AS (SELECT x.source_id, x.target_id, c.id, c.notes, c.verified_by_human AS v, c.flagged_for_review AS f FROM x JOIN c ON c.id = x.id)")
    + "SELECT source_id, target_id, CASE WHEN id % 3 = 0 THEN 'nlp_pass cosine=0.9999' WHEN id % 3 = 2 THEN notes WHEN regexp_matches(notes, '\\[(?:LLM score|exact-match) (\\d)/5\\]') THEN notes ELSE 'nlp_pass cosine=0.9999' END AS notes, CASE WHEN id % 3 = 0 THEN 0 ELSE v END AS verified_by_human, CASE WHEN id % 3 = 0 THEN 0 ELSE f END AS flagged_for_review FROM y"
)
def snk_upsert_crosswalk(spark, root) -> DataFrame:
    """A third of the pairs is new, a third is restated, a third untouched; scored notes and the marks of people stay."""
    cols = ["notes", "verified_by_human", "flagged_for_review"]
    c = Tables(spark, root).mappings("source_id", "target_id", *cols).where("source_id is not null and target_id is not null")
    one = ranking.top_per_group(c, ["source_id", "target_id"], [F.col("id")], 1)
    base = one.where("id % 3 <> 0").select("source_id", "target_id", *cols)
    new = one.where("id % 3 <> 2").select("source_id", "target_id", F.lit("nlp_pass cosine=0.9999").alias("notes"), F.lit(0).alias("verified_by_human"), F.lit(0).alias("flagged_for_review"))
    return cw.upsert_mappings(base, new)


@query(with_(U, "n AS (SELECT parent_id AS id, max(position) AS most FROM u WHERE parent_id IS NOT NULL GROUP BY 1)") + "SELECT s.id, coalesce(n.most, 0)::INTEGER AS parts FROM (SELECT DISTINCT id FROM standards) s LEFT JOIN n ON n.id = s.id")
def snk_update_from(spark, root) -> DataFrame:
    """A column set from what another table says, where it says something."""
    t = Tables(spark, root)
    base = t.standards("id").withColumn("parts", F.lit(0))
    patch = t.subs("parent_id", "position").where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.max("position").alias("parts"))
    return upsert.update_set(base, patch, ["id"], ["parts"])


@query(with_(E, f"x AS (SELECT {_PAIR}, CASE WHEN isnan(confidence_score) THEN NULL ELSE confidence_score END AS s, method FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL)") + f"SELECT {_PAIR}, max(s) AS confidence_score FROM x GROUP BY ALL")
def mt_edge_merge(spark, root) -> DataFrame:
    """Edges of two methods merged by their ends: the higher score stays."""
    k = ["source_id", "target_id", "relationship"]
    score = F.when(~F.isnan("confidence_score"), F.col("confidence_score"))
    e = Tables(spark, root).edges(*k, "method", "confidence_score").where("source_id is not null and target_id is not null and relationship is not null")
    one = lambda df: df.groupBy(*k).agg(F.max(score).alias("confidence_score"))
    old, new = one(e.where("method = 'manual'")), one(e.where("method <> 'manual' or method is null"))
    return upsert.merge_rows(old, new, k, {"confidence_score": F.greatest("b.confidence_score", "n.confidence_score")})


@query("SELECT id, system, reason, reviewer FROM (SELECT id, system, reason, CASE WHEN reason IS NULL THEN 'open' END AS reviewer FROM retired_standards)")
def mt_schema_migrate(spark, root) -> DataFrame:
    """A column added twice, and filled in between: the second run leaves it."""
    r = upsert.with_missing_columns(Tables(spark, root).raw("retired_standards").select("id", "system", "reason"), {"reviewer": "string"})
    filled = r.withColumn("reviewer", F.when(F.col("reason").isNull(), "open"))
    return upsert.with_missing_columns(filled, {"reviewer": "string"})


@query("SELECT 'count' AS name, 'done' AS status, count(DISTINCT id) AS n FROM standards UNION ALL SELECT 'fresh', 'skipped', 0 UNION ALL SELECT 'broken', 'failed', 0 UNION ALL SELECT 'flaky', 'done', count(DISTINCT id) FROM retired_standards")
def mt_orchestrate(spark, root) -> DataFrame:
    """Steps of a night's run: one is fresh, one fails for good, one works the second time; later steps run in any case."""
    t, n, tried = Tables(spark, root), {}, []

    def flaky() -> None:
        tried.append(1)
        if len(tried) == 1:
            raise ConnectionError("once")
        n["flaky"] = t.raw("retired_standards").select("id").distinct().count()

    def broken() -> None:
        raise ValueError("always")

    steps = [("count", lambda: n.update(count=t.standards("id").count())), ("fresh", broken), ("broken", broken), ("flaky", flaky)]
    done = maintain.run_steps(steps, {"fresh"})
    return spark.createDataFrame([(name, status, n.get(name, 0)) for name, status in done], "name string, status string, n bigint")


@query("SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_upsert(spark, root) -> DataFrame:
    """The last event of each user, upserted from a stream whose checkpoint is read twice."""
    at = scratch(spark)
    schema = spark.read.parquet(f"{root}/events.parquet").schema
    for _ in range(2):
        source = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(root).select("user_id", F.struct("ts", "event_id").alias("at"), "event_type", "value")
        incremental.upsert_new(source, ["user_id"], "at", f"{at}/table", f"{at}/state").awaitTermination()
    return sinks.read_current(spark, f"{at}/table").select("user_id", "at.event_id", "event_type", F.round("value", 4).alias("value"))
