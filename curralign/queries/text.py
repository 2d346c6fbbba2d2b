"""Text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grades, notes, text
from ..operators import fts
from .registry import C, E, S, Tables, U, query, rank_sql, with_, year_sql

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(with_(S) + "SELECT DISTINCT id, regexp_replace(upper(id), '[.][A-Z]([.][0-9])', '\\1', 'g') AS loose FROM s")
def txt_loose_id(spark, root) -> DataFrame:
    return Tables(spark, root).standards("id").select("id", text.loose_id(F.col("id")).alias("loose"))


@query("SELECT DISTINCT id, CASE WHEN upper(trim(id)) LIKE 'CCSS.%' OR contains(upper(trim(id)), '.MATH.') THEN trim(id) ELSE 'CCSS.MATH.' || trim(id) END AS full_id FROM standards")
def txt_expand_id(spark, root) -> DataFrame:
    return Tables(spark, root).standards("id").select("id", text.expand_id(F.col("id")).alias("full_id"))


@query("SELECT DISTINCT id, regexp_replace(id, '[.][0-9]{4,}$', '') AS stem FROM standards")
def txt_stem_id(spark, root) -> DataFrame:
    return Tables(spark, root).standards("id").select("id", text.stem_id(F.col("id")).alias("stem"))


@query(
    "SELECT DISTINCT grade, CASE WHEN g IN ('K','1','2','3','4','5','6','7','8','HS') THEN g WHEN g IN ('KG','KINDERGARTEN') THEN 'K' WHEN g = 'HIGH SCHOOL' THEN 'HS' WHEN n BETWEEN 1 AND 8 THEN n::VARCHAR WHEN n >= 9 THEN 'HS' WHEN n < 0 THEN 'K' END AS code FROM (SELECT grade, g, trunc(try_cast(g AS DOUBLE))::INTEGER AS n FROM (SELECT grade, regexp_replace(upper(trim(grade)), '^(?:GRADES?|GR)[.]?\\s*', '') AS g FROM standards))"
)
def txt_coerce_grade(spark, root) -> DataFrame:
    return Tables(spark, root).standards("grade").select("grade", grades.coerce_grade(F.col("grade")).alias("code"))


@query(f"SELECT DISTINCT grade, {year_sql('grade')} AS year, {rank_sql('grade')}::INTEGER AS rank FROM standards")
def txt_grade_year(spark, root) -> DataFrame:
    g = F.col("grade")
    return Tables(spark, root).standards("grade").select("grade", grades.grade_year(g).alias("year"), grades.grade_rank(g).alias("rank"))


@query("SELECT DISTINCT grade, CASE WHEN upper(trim(grade)) IN ('K','KG','KINDERGARTEN') THEN 'K' WHEN upper(trim(grade)) IN ('9','10','11','12','9-10','11-12','9-12','HS','HIGH SCHOOL') THEN 'HS' ELSE trim(grade) END AS code FROM standards")
def txt_norm_grade_pdf(spark, root) -> DataFrame:
    return Tables(spark, root).standards("grade").select("grade", grades.pdf_grade(F.col("grade")).alias("code"))


@query("SELECT DISTINCT grade, CASE WHEN grade IN ('KG','K') THEN 'K' WHEN try_cast(grade AS INTEGER) = 0 THEN 'K' WHEN try_cast(grade AS INTEGER) BETWEEN 1 AND 8 THEN try_cast(grade AS INTEGER)::VARCHAR WHEN try_cast(grade AS INTEGER) BETWEEN 9 AND 12 THEN 'HS' END AS code FROM standards")
def txt_edlevel(spark, root) -> DataFrame:
    return Tables(spark, root).standards("grade").select("grade", grades.education_level(F.col("grade")).alias("code"))


@query(with_(C) + "SELECT id, try_cast(nullif(regexp_extract(notes, '\\[(?:LLM score|exact-match) (\\d)/5\\]', 1), '') AS INTEGER) AS quality, CASE WHEN notes IS NULL THEN 'unknown' ELSE coalesce(nullif(regexp_extract(notes, 'MISMATCH:\\s*(.+?)\\.?\\s*$', 1), ''), 'unknown') END AS mismatch FROM c")
def txt_quality(spark, root) -> DataFrame:
    n = F.col("notes")
    return Tables(spark, root).mappings("notes").select("id", notes.quality(n).alias("quality"), notes.mismatch(n).alias("mismatch"))


@query(with_(C) + "SELECT id, try_cast(nullif(regexp_extract(notes, 'cosine=([0-9.]+)', 1), '') AS DOUBLE) AS cosine FROM c")
def txt_note_cosine(spark, root) -> DataFrame:
    return Tables(spark, root).mappings("notes").select("id", notes.cosine(F.col("notes")).alias("cosine"))


@query(with_(E) + "SELECT id, nullif(regexp_extract(notes, '\\b(hard|soft)\\b(?:\\s*\\[[^\\]]*\\])?:', 1), '') AS strength FROM e")
def txt_prereq_note(spark, root) -> DataFrame:
    return Tables(spark, root).edges("id", "notes").select("id", notes.strength(F.col("notes")).alias("strength"))


@query(with_(E) + "SELECT id, trim(regexp_extract(notes, '(?:hard|soft):\\s*(.*)$', 1, 's')) AS why FROM e WHERE notes IS NOT NULL")
def txt_extract_why(spark, root) -> DataFrame:
    return Tables(spark, root).edges("id", "notes").where("notes is not null").select("id", notes.export_reason(F.col("notes")).alias("why"))


@query(with_(C) + "SELECT id, '[LLM score ' || score::VARCHAR || '/5] ' || 'Checked' || '.' || CASE WHEN score <= 2 THEN ' | MISMATCH: scope.' ELSE '' END AS note, score <= 2 AS flag FROM (SELECT id, (id % 5 + 1)::INTEGER AS score FROM c)")
def txt_note_build(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("source_id").select("id", (F.pmod("id", F.lit(5)) + 1).cast("int").alias("score"))
    note = notes.score_note(F.col("score"), F.lit("Checked.."), F.when(F.col("score") <= 2, F.lit("scope")))
    return c.select("id", note.alias("note"), (F.col("score") <= 2).alias("flag"))


@query(with_(S) + "SELECT DISTINCT id, replace(replace(replace(lower(trim(standard_text)), chr(10), ' '), chr(9), ' '), '  ', ' ') AS t FROM s")
def txt_norm_ws(spark, root) -> DataFrame:
    return Tables(spark, root).standards("id", "standard_text").select("id", text.exact_text(F.col("standard_text")).alias("t")).distinct()


@query(with_(S) + "SELECT id, md5(trim(lower(regexp_replace(standard_text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) || '|' || grade) AS k FROM s WHERE standard_text IS NOT NULL AND grade IS NOT NULL")
def txt_norm_re(spark, root) -> DataFrame:
    s = Tables(spark, root).standards().where("standard_text is not null and grade is not null")
    return s.select("id", F.md5(F.concat_ws("|", text.plain_text(F.col("standard_text")), "grade")).alias("k"))


@query(with_(S) + "SELECT id, regexp_extract(id, '^([A-Z]+)[.]([A-Z]+)[.]', 2) AS area, lpad(coalesce(try_cast(nullif(regexp_extract(id, '[.]([0-9]+)[.]', 1), '') AS INTEGER), 0)::VARCHAR, 2, '0') AS band FROM s")
def txt_code_parse(spark, root) -> DataFrame:
    i = F.col("id")
    band = F.coalesce(F.nullif(F.regexp_extract(i, r"[.]([0-9]+)[.]", 1), F.lit("")).try_cast("int"), F.lit(0))
    return Tables(spark, root).standards().select("id", F.regexp_extract(i, r"^([A-Z]+)[.]([A-Z]+)[.]", 2).alias("area"), F.lpad(band.cast("string"), 2, "0").alias("band"))


@query("SELECT DISTINCT domain, CASE WHEN starts_with(lower(domain), 'geo') THEN 'Geometria' WHEN starts_with(lower(domain), 'number') THEN 'Números' ELSE domain END AS canon FROM standards")
def txt_prefix_map(spark, root) -> DataFrame:
    return Tables(spark, root).standards("domain").select("domain", text.mapped_prefix(F.col("domain"), [("geo", "Geometria"), ("number", "Números")]).alias("canon"))


@query("SELECT DISTINCT system, CASE WHEN system LIKE '%-sci' THEN 'science' WHEN system LIKE '%-ela' THEN 'ela' WHEN system LIKE '%-ss' THEN 'ss' WHEN system LIKE '%-cs' OR system = 'csta' THEN 'cs' ELSE 'math' END AS kind FROM standards")
def txt_classify_sys(spark, root) -> DataFrame:
    return Tables(spark, root).standards("system").select("system", text.system_subject(F.col("system")).alias("kind"))


@query(with_(U) + "SELECT id, md5(coalesce(text, '')) AS h, sha256(coalesce(text, '')) AS h2 FROM u")
def fn_hash(spark, root) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return Tables(spark, root).subs().select("id", F.md5(t).alias("h"), F.sha2(t, 256).alias("h2"))


@query(with_(C) + "SELECT id, verified_by_human = 1 AS verified, flagged_for_review = 1 AS flagged, try_cast(substr(notes, 12, 1) AS INTEGER) AS digit FROM c")
def fn_bool(spark, root) -> DataFrame:
    c = Tables(spark, root).mappings("verified_by_human", "flagged_for_review", "notes")
    return c.select("id", (F.col("verified_by_human") == 1).alias("verified"), (F.col("flagged_for_review") == 1).alias("flagged"), F.substring("notes", 12, 1).try_cast("int").alias("digit"))


@query(with_(U, "x AS (SELECT parent_id, list(id ORDER BY position, id) AS ids FROM u WHERE parent_id IS NOT NULL GROUP BY parent_id)") + "SELECT parent_id, array_to_string(ids, ',') AS ids FROM x")
def arr_concat_paths(spark, root) -> DataFrame:
    u = Tables(spark, root).subs("id", "parent_id", "position").where("parent_id is not null")
    return u.groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]), ",").alias("ids"))


_TERMS = fts.query_terms("fractions measure volume")
_WORDS = "d AS (SELECT id, regexp_extract_all(regexp_replace(lower(concat_ws(' ', standard_text, domain, cluster)), '\\p{M}+', '', 'g'), '[\\p{L}\\p{N}]+') AS ws FROM (SELECT DISTINCT id, system, subject, grade, domain, cluster, standard_text FROM standards))"
_TF = "t AS (SELECT id, len(ws)::DOUBLE AS len, " + ", ".join(f"len(list_filter(ws, lambda x: starts_with(x, '{t}')))::DOUBLE AS f{i}" for i, t in enumerate(_TERMS)) + " FROM d)"
_STAT = "z AS (SELECT count(*)::DOUBLE AS n, avg(len) AS al, " + ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS d{i}" for i in range(len(_TERMS))) + " FROM t)"
_SCORE = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / al))" for i in range(len(_TERMS)))
_HIT = " OR ".join(f"f{i} > 0" for i in range(len(_TERMS)))
FTS = (_WORDS, _TF, _STAT, f"r AS (SELECT id, round({_SCORE}, 6) AS score FROM t, z WHERE {_HIT} ORDER BY 2 DESC, id LIMIT 1000)")


@query(with_(*FTS) + "SELECT id, score FROM r")
def fts_rank(spark, root) -> DataFrame:
    rows = Tables(spark, root).standards("id", "system", "subject", "grade", "domain", "cluster", "standard_text")
    return fts.bm25(fts.index(rows, "id", "standard_text", "domain", "cluster"), _TERMS)


