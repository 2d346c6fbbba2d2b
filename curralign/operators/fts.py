"""Full-text search: an inverted index as a frame, and BM25 over prefix terms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, CAP, IDF_FLOOR = 1.2, 0.75, 1_000, 1e-6
#: Letters of a query term.
PREFIX = 6


def query_terms(query: str) -> list[str]:
    """The first ``PREFIX`` letters of each word of five or more ASCII letters, in lower case, repeats kept."""
    return [w[:PREFIX].lower() for w in re.findall(r"[A-Za-z]{5,}", query)]


def tokens(*cols: Column) -> Column:
    """Lower-cased runs of letters and digits of all columns, accents taken off."""
    folded = F.regexp_replace(F.call_function("lower", F.concat_ws(" ", *cols)), r"\p{M}+", "")
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), 0)


def index(docs: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """``id, words``: the tokens of each document, from which term and document counts follow without a second scan."""
    return docs.select(F.col(id_col).alias("id"), tokens(*(F.col(c) for c in cols)).alias("words"))


def terms_of(query: Column) -> Column:
    """:func:`query_terms` of a column."""
    return F.transform(F.regexp_extract_all(query, F.lit("[A-Za-z]{5,}"), 0), lambda w: F.lower(F.substring(w, 1, PREFIX)))


def postings(docs: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """The inverted index: ``word, id, tf, len``, how often each word stands in each document and the document's number of words.

    Written once, partitioned or sorted by word, it answers any number of queries; a word's rows are counted in each task before they are shuffled.
    """
    words = index(docs, id_col, *cols).select("id", F.size("words").alias("len"), F.explode("words").alias("word"))
    return words.groupBy("word", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def bm25_many(posted: DataFrame, queries: DataFrame) -> DataFrame:
    """``q, id, score`` of every hit of ``queries`` (``q, query``), scored as in :func:`bm25` and without a cap.

    Only words that share a query's prefix are joined; the sizes of the corpus are one row of sums, the document counts one row a term.
    """
    asked = queries.select("q", F.posexplode(terms_of(F.col("query"))).alias("at", "term"))
    words = posted.where(F.length("word") >= 5).withColumn("key", F.substring("word", 1, 5))
    terms = asked.select("term").distinct().withColumn("key", F.substring("term", 1, 5))
    hits = words.join(terms, "key").where(F.col("word").startswith(F.col("term"))).groupBy("term", "id").agg(F.sum("tf").cast("double").alias("tf"), F.first("len").cast("double").alias("len"))
    df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    sizes = posted.groupBy("id").agg(F.first("len").alias("len")).agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg_len"))  # one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = hits.join(df, "term").join(F.broadcast(sizes), F.lit(True)).select("term", "id", part.alias("part"))
    return asked.join(scored, "term").groupBy("q", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def _count(term: str) -> Column:
    """How many words begin with the term."""
    return F.size(F.filter("words", lambda w: w.startswith(term))).cast("double")


def bm25(indexed: DataFrame, terms: list[str], cap: int = CAP) -> DataFrame:
    """``id, score``: the best ``cap`` documents for prefix terms; score to 6 places, ties by id.

    A term's frequency counts all words that begin with it. The corpus counts are one row of sums.
    """
    if not terms:
        return indexed.select("id", F.lit(0.0).alias("score")).limit(0)
    names = {t: f"tf{i}" for i, t in enumerate(dict.fromkeys(terms))}
    d = indexed.select("id", F.size("words").cast("double").alias("len"), *(_count(t).alias(n) for t, n in names.items()))
    stats = d.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg_len"), *(F.sum(F.when(F.col(n) > 0, 1.0).otherwise(0.0)).alias(f"df_{n}") for n in names.values()))
    hit = None
    for n in names.values():
        hit = (F.col(n) > 0) if hit is None else hit | (F.col(n) > 0)
    scored = d.where(hit).join(F.broadcast(stats), F.lit(True))  # one row
    score: Column = F.lit(0.0)
    for t in terms:
        n = names[t]
        idf = F.greatest(F.log((F.col("n") - F.col(f"df_{n}") + 0.5) / (F.col(f"df_{n}") + 0.5)), F.lit(IDF_FLOOR))
        score = score + idf * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return scored.select("id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(cap)
