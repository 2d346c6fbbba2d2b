from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from curralign.llm import components, topn


def brute(data, n):
    out = []
    for g in {d[0] for d in data}:
        part = sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2]))[:n]
        out += [(g, d[2], i + 1) for i, d in enumerate(part)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 3, 50])
def test_top_n_matches_brute_force_with_a_hot_group_ties_and_nulls(spark, n):
    r = random.Random(n)
    data = [(r.choice(["hot"] * 5 + ["a", "b", None, ""]), r.choice([0.1, 0.5, 0.9]), i) for i in range(600)]
    df = spark.createDataFrame(data, "g string, s double, id long").repartition(7).withColumn("rank_no", F.lit("clash"))
    got = topn.top_n_per_group(df, ["g"], [F.col("s").desc(), F.col("id").asc()], n)
    assert rows(got, "g", "id", "rank_no") == brute(data, n)


def test_top_n_of_small_batches_goes_on_across_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(40).select((F.col("id") % 2).alias("g"), F.col("id"))
        got = topn.top_n_per_group(df, ["g"], [F.col("id").asc()], 5)
        assert rows(got, "g", "id", "rank_no") == sorted([(i % 2, i, i // 2 + 1) for i in range(10)], key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "g string, s double")
    assert topn.top_n_per_group(df, ["g"], [F.col("s")], 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, ["g"], [F.col("s")], 0)


def test_best_mappings(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    data = [
        (1, "a", 0.9, 2, t(1)), (1, "a", 0.1, 2, t(2)), (2, "a", 0.5, -1, t(1)), (3, "a", 0.5, 1, t(1)), (4, "a", 0.5, None, t(1)), (5, "a", 0.5, 0, t(1)), (5, "a", 0.5, 0, t(1)),
        (6, "a", float("nan"), 0, t(1)), (7, "a", 1.5, 0, t(1)), (8, "a", None, 0, t(1)), (9, None, 0.5, 0, t(1)),
    ]
    df = spark.createDataFrame(data, "id long, source_id string, confidence_score double, grade_delta int, updated_at timestamp")
    assert rows(topn.best_mappings(df)) == [("a", 1, 5), ("a", 2, 2), ("a", 3, 3)]


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted(((x, find(x)) for x in parent), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(120):03}", f"n{r.randrange(120):03}") for _ in range(70)]
    pairs += [("hub", f"leaf{i:03}") for i in range(80)] + [(f"chain{i:03}", f"chain{i + 1:03}") for i in range(60)]
    pairs += [(None, "x"), ("x", None), ("self", "self"), *pairs[:10], *[(b, a) for a, b in pairs[:10]]]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1)).repartition(5)
    assert rows(components.boruvka_components(df, "a", "b")) == union_find(pairs)


def test_components_of_nothing_and_of_numbers(spark):
    none = components.boruvka_components(spark.createDataFrame([], "a string, b string"), "a", "b")
    assert none.columns == ["id", "group_id"] and none.count() == 0
    assert components.boruvka_components(spark.createDataFrame([("a", "a"), (None, "b")], "a string, b string"), "a", "b").count() == 0
    df = spark.createDataFrame([(3, 2), (2, 9), (5, 4)], "a long, b long")
    assert rows(components.boruvka_components(df, "a", "b")) == [(2, 2), (3, 2), (4, 4), (5, 4), (9, 2)]


def test_matches_are_valid_mappings_only(spark):
    t = dt.datetime(2024, 1, 1)
    data = [(1, "a", "b", " Equivalent ", 0), (2, "b", "c", "equivalent", 1), (3, "c", "d", "overlapping", 0), (4, "e", " ", "equivalent", 0), (5, "gone", "b", "EQUIVALENT", 0), (6, "x", "y", None, 0)]
    df = spark.createDataFrame([(*d, t) for d in data], "id long, source_id string, target_id string, relationship string, flagged_for_review int, updated_at timestamp")
    assert rows(components.match_groups(df)) == [("a", "a"), ("b", "a"), ("gone", "a")]
