"""The queries of the operators in this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import components, consensus, encoding, neardup, neighbours, packing, scans, sentences, topn


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return topn.best_mappings(table(spark, root, "crosswalk_mappings"), 3)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    vectors = neighbours.usable_vectors(table(spark, root, "standard_embeddings"), "gradus-embed", 64)
    return neighbours.nearest_pairs(vectors, 5, 64)


def _scanned(spark: SparkSession, root: str) -> DataFrame:
    standards = table(spark, root, "standards").select(F.lit("standards").alias("tbl"), "id", F.col("standard_text").alias("text"), F.col("system").alias("family"))
    subs = table(spark, root, "sub_standards").select(F.lit("sub_standards").alias("tbl"), "id", "text", F.col("system").alias("family"))
    return standards.unionAll(subs)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return scans.find_noise(_scanned(spark, root)).select("tbl", "id")


def p3_repaired(spark: SparkSession, root: str) -> DataFrame:
    return scans.repair_texts(_scanned(spark, root)).distinct()


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return components.match_groups(table(spark, root, "crosswalk_mappings"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return consensus.best_records(table(spark, root, "standards"), table(spark, root, "source_trust"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, root, "standards"), "id", "standard_text", 0.8, 25)


def p7_groups(spark: SparkSession, root: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, root, "standards"), "id", "standard_text", 0.8, 25)


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return encoding.encode_texts(table(spark, root, "documents"))


def p9_packed(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(table(spark, root, "documents"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return sentences.split_sentences(table(spark, root, "documents"))


def p2_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The five most similar standards of each, with their cosines to 4 places."""
    vectors = neighbours.usable_vectors(table(spark, root, "standard_embeddings"), "gradus-embed", 64)
    return neighbours.exact_cosines(neighbours.nearest(vectors, 5, 64), vectors).select("id", "nb", "rank_no", F.round("cosine", 4).alias("cosine"))


def p5_consensus(spark: SparkSession, root: str) -> DataFrame:
    """For each group of double ingests the existing text closest to the consensus of its tokens, all copies voting alike."""
    s = table(spark, root, "standards").where(F.col("id").rlike(r"(?s)^.*\.[0-9]{4,}$")).select("id", "standard_text").distinct()
    keyed = s.select(F.regexp_extract("id", r"(?s)^(.*)\.[0-9]{4,}$", 1).alias("stem"), "id", "standard_text")
    return consensus.consensus_representatives(keyed, "stem", "id", "standard_text").select("stem", "id", "weight")


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers are."""
    return packing.container_report(packing.pack_documents(table(spark, root, "documents")))


QUERIES = (p1_found, p2_found, p2_neighbours, p3_found, p3_repaired, p4_found, p5_found, p5_consensus, p7_found, p7_groups, p8_ids, p9_packed, p9_report, p10_found)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_P1 = """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM crosswalk_mappings) WHERE rn = 1)
SELECT source_id, rank_no::INTEGER AS rank_no, id FROM (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY confidence_score DESC, abs(grade_delta) ASC NULLS LAST, id) AS rank_no
FROM c WHERE source_id IS NOT NULL AND confidence_score BETWEEN 0 AND 1 AND NOT isnan(confidence_score)) WHERE rank_no <= 3"""

_P5 = """WITH s AS (SELECT DISTINCT id, regexp_replace(id, '[.][0-9]{4,}$', '') AS stem, standard_text, trim(last_verified_date) AS d, lower(trim(source_url)) AS u
 FROM standards WHERE regexp_matches(id, '[.][0-9]{4,}$')),
 f AS (SELECT *, coalesce(try_strptime(left(d, 10), '%Y-%m-%d'), try_strptime(d, '%Y/%m/%d'), try_strptime(d, '%d.%m.%Y'), CASE WHEN length(d) = 8 THEN try_strptime(d, '%Y%m%d') END, try_strptime(d, '%d %b %Y'))::DATE AS day0,
 regexp_replace(regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1), '^www[.]', '') AS host FROM s),
 r AS (SELECT f.*, CASE WHEN day0 <= DATE '2026-06-30' THEN day0 END AS day, t.trust_rank AS tr, regexp_replace(standard_text, '^\\s+|\\s+$', '', 'g') AS body FROM f LEFT JOIN source_trust t ON t.host = f.host),
 g AS (SELECT stem FROM r GROUP BY stem HAVING count(DISTINCT id) > 1),
 a AS (SELECT stem, id FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY length(body) DESC, day DESC NULLS LAST, id) AS k FROM r WHERE length(body) >= 20 AND NOT body LIKE '%…' AND NOT body LIKE '%...') WHERE k = 1),
 b AS (SELECT stem, id FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY tr, day DESC NULLS LAST, id) AS k FROM r WHERE tr IS NOT NULL) WHERE k = 1),
 e AS (SELECT stem, id FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY day DESC, id) AS k FROM r WHERE day IS NOT NULL) WHERE k = 1)
SELECT g.stem, a.id AS text_id, b.id AS url_id, e.id AS date_id FROM g LEFT JOIN a USING (stem) LEFT JOIN b USING (stem) LEFT JOIN e USING (stem)"""

_P2 = """WITH v AS (SELECT standard_id AS id, list_transform(vector, lambda x: x::DOUBLE) AS vec FROM (SELECT *, row_number() OVER (PARTITION BY standard_id ORDER BY created_at DESC) AS rn FROM standard_embeddings
 WHERE model = 'gradus-embed' AND standard_id IS NOT NULL) WHERE rn = 1 AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
 k AS (SELECT a, b FROM (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.vec, b.vec) DESC, b.id) AS r FROM v a JOIN v b ON a.id <> b.id) WHERE r <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM k"""

_P7 = """WITH s AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(standard_text), '[\\p{L}\\p{N}]+'))) AS w FROM (SELECT DISTINCT id, standard_text FROM standards WHERE id IS NOT NULL AND standard_text IS NOT NULL)),
 t AS (SELECT id, w, len(w) AS n FROM s WHERE len(w) >= 25)
SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM t a JOIN t b ON a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) AND len(list_intersect(a.w, b.w)) >= 0.8 * (a.n + b.n - len(list_intersect(a.w, b.w)))"""


_P4 = """WITH RECURSIVE c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM crosswalk_mappings) WHERE rn = 1),
 m AS (SELECT DISTINCT source_id AS a, target_id AS b FROM c WHERE lower(trim(relationship)) = 'equivalent' AND flagged_for_review = 0 AND trim(source_id) <> '' AND trim(target_id) <> '' AND source_id <> target_id),
 e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), w(id, other) AS (SELECT a, a FROM e UNION SELECT w.id, e.b FROM w JOIN e ON e.a = w.other)
SELECT id AS standard_id, min(other) AS group_id FROM w GROUP BY 1"""

#: Brute force over all pairs.
_P2N = _P2[: _P2.index("SELECT DISTINCT least")].replace("SELECT a, b FROM (SELECT a.id AS a, b.id AS b,", "SELECT a, b, s, r FROM (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.vec, b.vec) AS s,") + "SELECT a AS id, b AS nb, r::INTEGER AS rank_no, round(s, 4) AS cosine FROM k"


def oracle_sql() -> dict[str, str]:
    return {"p4_found": _P4, "p2_neighbours": _P2N, "p1_found": _P1, "p2_found": _P2, "p5_found": _P5, "p7_found": _P7}
