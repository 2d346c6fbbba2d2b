from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from curralign.operators import fts, graph, orphans, ranking, upsert, vectors
from curralign.plans import audits, crosswalk, maintain, tools
from curralign.sources import hierarchy, sinks


def test_orphans_kinds_nulls_copies_and_empty_tables(spark):
    t = lambda m: dt.datetime(2024, m, 1)
    refs = spark.createDataFrame(
        [("t", "f", "1", "a", t(1)), ("t", "f", "1", "a", t(1)), ("t", "f", "2", "gone", t(2)), ("t", "f", "3", "no", None), ("t", "f", "4", None, t(1)), ("t", "f", "5", "  ", t(1)), ("t", "f", "6", "a", None), ("t", "f", "7", "a", t(9))],
        "tbl string, fld string, row_key string, ref string, created_at timestamp",
    )
    parents = spark.createDataFrame([("a", t(5)), ("a", t(5))], "id string, created_at timestamp")
    retired = spark.createDataFrame([("gone",), ("a",)], "id string")
    want = [("t", "f", "1", "2024-01", "late"), ("t", "f", "2", "2024-02", "deleted"), ("t", "f", "3", "unknown", "missing")]
    assert rows(orphans.find_orphans(refs, parents, retired)) == want
    none = orphans.find_orphans(refs, parents.limit(0), retired.limit(0))
    assert {r["kind"] for r in none.collect()} == {"missing"}
    assert orphans.find_orphans(refs.limit(0), parents, retired).count() == 0


def test_a_full_bloom_filter_loses_no_orphan(spark):
    parents = spark.range(5000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.lit(None).cast("timestamp").alias("created_at"))
    refs = spark.range(4000, 6000).select(F.lit("t").alias("tbl"), F.lit("f").alias("fld"), F.col("id").cast("string").alias("row_key"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("ref"), F.lit(None).cast("timestamp").alias("created_at"))
    assert orphans.find_orphans(refs, parents, parents.select("id").limit(0), max_bits=1024).count() == 1000


def test_no_text_of_a_plan_holds_the_bloom_filter(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    known = orphans.bloom_filter(keys, "k")
    asked = spark.range(19_000, 40_000).select(F.col("id").cast("string").alias("k")).where(known.might_contain(F.col("k")))
    assert 1000 <= asked.count() < 2000
    assert len(asked._jdf.queryExecution().toString()) < 20_000
    assert spark.range(5).where(orphans.bloom_filter(keys.limit(0), "k").might_contain(F.col("id"))).count() == 0


def test_cosines_of_a_join_are_rounded_without_a_constant():
    import pyarrow as pa

    a, b = np.float32([1.0, 0.0]), np.array([0.97105 + 1e-10, np.sqrt(1 - (0.97105 + 1e-10) ** 2)])
    t = pa.table({"side": [False, True], "vec": pa.array([list(a), list(b)], pa.list_(pa.float64())), "id": ["a", "b"], "rank": pa.array([0, 0], pa.int32())})
    assert [vectors._block_pairs(t, -1.0, [], None, top, 1)["cosine"].to_pylist() for top in (None, 1)] == [[0.9711], [0.9711]]


@pytest.mark.parametrize(("rule", "threshold", "top", "ties"), [(None, -1.0, 5, -1), ("within:2", 0.1, 1, 1), ("below:3", 0.05, 4, 1), (None, -2.0, 300, 1)])
def test_the_best_few_are_found_without_sorting_all_pairs(monkeypatch, rule, threshold, top, ties):
    import pyarrow as pa

    r = np.random.default_rng(5)
    x = r.normal(size=(700, 8)).astype(np.float32)
    x[r.integers(0, 700, 200)] = x[5]
    x[11], x[13, 2] = 0, np.nan
    t = pa.table({"side": np.arange(700) >= 100, "vec": pa.array(list(x), pa.list_(pa.float32())), "id": [f"i{k * 17 % 700:03}" for k in range(700)], "rank": pa.array([k % 7 for k in range(700)], pa.int32())})
    length = np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    y = x.astype(float) / np.where(length == 0, 1, length)
    cos = np.round(y[:100] @ y[100:].T, 4)
    ids, rank, want = t["id"].to_pylist(), np.arange(700) % 7, set()
    for i in range(100):
        gap = rank[100:] - rank[i]
        ok = (cos[i] >= threshold) & {None: gap < 99, "within:2": abs(gap) <= 2, "below:3": (gap < 0) & (gap >= -3)}[rule]
        best = sorted((ids[100 + j] for j in np.flatnonzero(ok)), reverse=ties < 0)
        want |= {(ids[i], b) for b in sorted(best, key=lambda b: -cos[i][ids.index(b) - 100])[:top]}
    sizes, lexsort = [], np.lexsort
    monkeypatch.setattr(vectors.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or lexsort(keys))
    for width in (64, 4096):
        monkeypatch.setattr(vectors, "WIDTH", width, raising=False)
        got = vectors._block_pairs(t, threshold, [], rule, top, ties)
        assert set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == want and got.num_rows == len(want)
    assert rule or top > 100 or max(sizes) < 20_000


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("b", 1, None)], "k string, p int, h string")
    assert [r[2] for r in rows(ranking.fill_forward(df, ["k"], "p", "h"), "k", "p", "h")] == [None, "x", "x", None]
    text = spark.createDataFrame([("a", i, str(i)) for i in range(5)], "k string, p int, t string")
    assert rows(ranking.chunked(text, ["k"], "p", "t", 3)) == [("a", 0, "0\n1\n2"), ("a", 1, "3\n4")]


def test_writes(spark):
    base = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    new = spark.createDataFrame([("2", "c"), ("3", "d"), ("3", "e")], "id string, v string")
    assert rows(upsert.insert_missing(base, new, ["id"])) == [("1", "a"), ("2", "b"), ("3", "d")]
    assert rows(upsert.replace_rows(base, new.where("v <> 'e'"), ["id"])) == [("1", "a"), ("2", "c"), ("3", "d")]
    assert rows(upsert.update_set(base, new.where("v = 'c'"), ["id"], ["v"])) == [("1", "a"), ("2", "c")]
    assert rows(upsert.delete_where(base, F.col("v") == "a")) == [("2", "b")]
    assert upsert.with_missing_columns(base, {"v": "string", "w": "int"}).columns == ["id", "v", "w"]


def test_upsert_keeps_scored_notes(spark):
    schema = "source_id string, target_id string, notes string, verified_by_human int, flagged_for_review int"
    base = spark.createDataFrame([("a", "b", "[exact-match 5/5] x", 1, 0), ("a", "c", "nlp_pass cosine=0.7000", 0, 1)], schema)
    new = spark.createDataFrame([("a", "b", "nlp_pass cosine=0.9000", 0, 0), ("a", "c", "nlp_pass cosine=0.8000", 0, 0), ("a", "d", "nlp_pass cosine=0.9000", 0, 0)], schema)
    got = rows(crosswalk.upsert_mappings(base, new))
    assert got == [("a", "b", "[exact-match 5/5] x", 1, 0), ("a", "c", "nlp_pass cosine=0.8000", 0, 1), ("a", "d", "nlp_pass cosine=0.9000", 0, 0)]


@pytest.fixture
def diamond(spark):
    return spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("a", "d"), ("x", "y")], "src string, dst string")


def test_closure_is_cycle_safe_and_bounded(spark, diamond):
    root = spark.createDataFrame([("d",)], "root string")
    assert rows(graph.reachable(diamond, root, 9)) == [("d", "a", 2), ("d", "b", 1), ("d", "c", 1), ("d", "d", 0)]
    assert rows(graph.reachable(diamond, root, 0)) == [("d", "d", 0)]
    assert ("a", "a") not in rows(graph.all_pairs_closure(diamond))
    assert len(rows(graph.all_pairs_closure(diamond))) == 4 * 3 + 1


def test_learning_path_invariants(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")], "src string, dst string")
    std = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "3")], "id string, grade string")
    target = spark.createDataFrame([("d",)], "root string")
    path = [(r["step"], r["id"], r["prerequisites"]) for r in graph.learning_path(edges, std, target).orderBy("step").collect()]
    assert path == [(1, "a", []), (2, "b", ["a"]), (3, "c", ["a"]), (4, "d", ["b", "c"])]
    via = graph.learning_path(edges, std, target, spark.createDataFrame([("d", "b")], "root string, start string"))
    assert [(r["id"], r["prerequisites"]) for r in via.orderBy("step").collect()] == [("b", []), ("d", ["b"])]
    far = graph.learning_path(edges, std, target, spark.createDataFrame([("d", "zz")], "root string, start string"))
    assert [r["id"] for r in far.collect()] == ["d"]


def test_relate_links_consecutive_ranked_grades_only(spark):
    std = spark.createDataFrame([("k", "s", "d", "K"), ("2", "s", "d", "2"), ("5", "s", "d", "5"), ("10", "s", "d", "10")], "id string, system string, domain string, grade string")
    got = rows(graph.related_by_grade(std))
    assert got == [("2", "k", "prerequisite", "s"), ("k", "2", "successor", "s")]


def test_promotion_rewrites_both_directions(spark):
    e = spark.createDataFrame([("a", "b", 0.5, "llm soft: why"), ("b", "a", 0.5, "llm soft: why"), ("c", "d", 0.5, "llm soft: why")], "source_id string, target_id string, confidence_score double, notes string")
    yes, no = spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string"), spark.createDataFrame([("c", "d")], "src string, dst string")
    got = rows(graph.promoted(e, yes, no, "x"))
    assert got[0] == ("a", "b", 0.9, "llm hard [promoted_soft_to_hard via x]: why")
    assert got[2][2] == 0.5


def test_similarity_join_matches_brute_force_over_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(f"i{i:02}", [float(v) for v in x[i]], i % 4, "k") for i in range(60)], "id string, vec array<double>, rank int, scope string")
    got = {(a, b) for a, b, _ in rows(vectors.similarity_join(df, df, "scope", 0.3, (), "after:0", block=16))}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"i{i:02}", f"i{j:02}") for i in range(60) for j in range(i + 1, 60) if round(float(u[i] @ u[j]), 4) >= 0.3}
    assert got == want


def test_zero_vectors_have_no_direction(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0])], "id string, vec array<double>")
    assert rows(vectors.cosine_top_k(df, [2.0, 0.0], 5)) == [("a", 0.0), ("b", 1.0)]


def test_family_takes_the_nearest_before_it_filters_and_the_hub_after(spark):
    data = [("s1", [1.0, 0.0], "3", "spoke"), ("h1", [1.0, 0.01], "HS", "hub"), ("h2", [1.0, 0.2], "3", "hub")]
    v = spark.createDataFrame([(i, vec, s, "mathematics", g) for i, vec, g, s in data], "id string, vec array<double>, system string, subject string, grade string")
    v = v.withColumn("rank", crosswalk.grade_year(F.col("grade")))
    hub = crosswalk.hub_crosswalk(v, {"mathematics": "hub"}, default="hub")
    assert rows(hub, "source_id", "target_id") == [("s1", "h2")]
    fam = crosswalk.family_crosswalk(v, {"f": ["spoke", "hub"]})
    assert ("s1", "h1") not in rows(fam, "source_id", "target_id")
    assert ("s1", "h2") not in rows(fam, "source_id", "target_id")


def test_flagged_best_is_returned_below_threshold(spark):
    c = spark.createDataFrame([("a", "s", "b", "t", 0.9, 1, None, 0)], "source_id string, source_system string, target_id string, target_system string, confidence_score double, flagged_for_review int, notes string, grade_delta int")
    assert crosswalk.precomputed(c).count() == 0
    assert crosswalk.precomputed(c, include_flagged=True).count() == 1
    assert rows(crosswalk.best_any(c)) == [("a", "t", "b", 0.9)]


def test_resolution_tiers(spark):
    std = spark.createDataFrame([("A.6.RP.A.3", "s"), ("a.6.rp.a.3", "s"), ("B.1", "s")], "id string, system string")
    ask = spark.createDataFrame([("a.6.rp.a.3",), ("A.6.RP.3",), (" B.1. ",), ("none",), ("b.1",)], "input string")
    assert rows(tools.resolve_ids(std, ask)) == [(" B.1. ", "B.1"), ("A.6.RP.3", "A.6.RP.A.3"), ("a.6.rp.a.3", "a.6.rp.a.3"), ("b.1", "B.1")]
    assert tools.suggestions(std, ask, "s").count() >= 0


def test_full_text_caps_before_it_scopes(spark):
    docs = [(f"d{i}", "s1" if i < 5 else "s2", "mathematics", "1", "x", None, "fraction " * (6 - i % 6) + "filler words") for i in range(10)]
    std = spark.createDataFrame(docs, "id string, system string, subject string, grade string, domain string, cluster string, standard_text string")
    assert fts.query_terms("Fractions of an apple, fractions") == ["fracti", "apple", "fracti"]
    assert tools.search_text(std, "fractions", {}, system="s2", cap=3).count() < 5
    assert tools.search_text(std, "no", {}, system="s2").count() == 0


def test_deduplication_spares_structured_suffixes(spark):
    std = spark.createDataFrame([("A.1.1234", "s", "1", "d", "same"), ("A.1.5678", "s", "1", "D", "same"), ("B.4.a", "s", "1", "d", "like"), ("B.4.c", "s", "1", "d", "like"), ("C.1111", "s", "1", "d", " ")], "id string, system string, grade string, domain string, standard_text string")
    c = spark.createDataFrame([("1", "A.1.5678", "z"), ("2", "A.1.1234", "A.1.5678"), ("3", "A.1.5678", "y"), ("4", "A.1.1234", "y")], "id string, source_id string, target_id string")
    losers = maintain.duplicate_map(std, c)
    assert rows(losers) == [("A.1.1234", "A.1.5678")]
    assert rows(maintain.deduplicated_mappings(c, losers), "id") == [("1",), ("3",)]


def test_exact_text_is_one_pass(spark):
    std = spark.createDataFrame([("a", "One   two"), ("b", "one  two"), ("c", "one\ttwo"), ("d", "one two")], "id string, standard_text string")
    c = spark.createDataFrame([(1, "a", "b", None), (2, "c", "d", "[LLM score 1/5] x")], "id int, source_id string, target_id string, notes string")
    assert rows(maintain.exact_matches(c, std)) == [(2, "same words", "fix")]


def test_scores_and_gate(spark):
    c = spark.createDataFrame([(1, "old", 0), (2, "old", 0)], "id int, notes string, flagged_for_review int")
    s = spark.createDataFrame([(1, 2, "Why..", "scope")], "id int, score int, rationale string, mismatch string")
    assert rows(maintain.apply_scores(c, s)) == [(1, "[LLM score 2/5] Why. | MISMATCH: scope.", 1), (2, "old", 0)]
    gold = spark.createDataFrame([("a", "HARD", False), ("b", "NONE", True)], "key string, label string, trap boolean")
    bad = spark.createDataFrame([("a", "HARD"), ("b", "HARD")], "key string, label string")
    assert maintain.gate(gold, bad).first()["passed"] is False


def test_empty_tables_give_empty_audits(spark):
    std = spark.createDataFrame([], "id string, system string, subject string, grade string, domain string, standard_text string")
    cw = spark.createDataFrame([], "id long, source_id string, target_id string, source_system string, target_system string, confidence_score double, notes string, grade_delta int")
    assert audits.counts(std).count() == 0
    assert audits.confidence_bands(cw).count() == 0
    assert audits.gaps(std, cw, ["h"]).count() == 0
    assert tools.totals(std, cw).first()["standards"] == 0


def test_tree(spark):
    nodes = [("s", "r", None, "Root", 0, None, [], 0), ("s", "c", None, "Cluster", 1, "r", ["r"], 1), ("s", "l1", "A.1", "Leaf", 2, "c", ["r", "c"], 2), ("s", "l2", "A.1", "Copy", 2, "c", ["r", "c"], 3), ("s", "l3", "A.2", "Parent", 2, "c", ["r", "c"], 4), ("s", "m", "A.2.a", "Part", 3, "l3", ["r", "c", "l3"], 5)]
    df = spark.createDataFrame(nodes, "set_id string, id string, notation string, description string, depth int, parent string, ancestors array<string>, position int")
    assert rows(hierarchy.leaf_depth(df, "set_id")) == [("s", 2)]
    assert rows(hierarchy.flatten_tree(df)) == [("s", "l1", "A.1", "Leaf", "Root", "Cluster")]
    standards, subs = hierarchy.fixed_roles(df)
    assert rows(standards, "id", "domain", "cluster")[0] == ("l1", "Root", "Cluster")
    assert rows(subs, "id", "parent_id", "position") == [("m", "l3", 1)]


def test_node_sets_as_object_or_array(spark):
    node = '{"id":"a","statementNotation":"N","description":"d","depth":1}'
    df = spark.createDataFrame([('{"data":{"standards":{"a":%s}}}' % node,), ('{"data":{"standards":[%s]}}' % node,)], "j string")
    assert [[n["id"] for n in r["n"]] for r in df.select(hierarchy.node_set(F.col("j")).alias("n")).collect()] == [["a"], ["a"]]


def test_dominant_document(spark):
    sets = [("j", "d1", f"s{i}", str(i), 2000 + i) for i in range(1, 6)] + [("j", "d1", "s1b", "1", 2020), ("j", "d2", "t", "1", 2024), ("j", "d1", "h1", "HS", 1), ("j", "d1", "h2", "HS", 2)]
    df = spark.createDataFrame(sets, "jurisdiction string, document string, set_id string, grade string, year int")
    assert [r[0] for r in rows(hierarchy.dominant_document(df), "set_id")] == ["h1", "h2", "s1b", "s2", "s3", "s4", "s5"]


def test_model_boundaries(spark):
    texts = spark.createDataFrame([("a", "one"), ("b", None)], "id string, text string")
    got = hierarchy.extracted_rows(texts, lambda ts: ['```json\n[{"code": "X"}]\n```' if t else "sorry" for t in ts], "code string")
    assert rows(got) == [("a", 0, "X")]
    assert [len(r["vec"]) for r in hierarchy.embedded(texts, hierarchy.hashed_ngrams(8)).collect()] == [8, 8]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    files = sinks.write_json_lines(df.coalesce(1), str(tmp_path / "j")).collect()
    assert sum(f["lines"] for f in files) == 2 and all(f["checksum"] > 0 and f["bytes"] > 0 for f in files)
    again = sinks.write_json_lines(df.repartition(2), str(tmp_path / "j2")).collect()  # the same rows in other files have the same sum
    assert sum(f["checksum"] for f in again) == sum(f["checksum"] for f in files)
    assert [r["checksum"] for r in sinks.manifest({"t": df}).collect()] == [sum(f["checksum"] for f in files)]
    sinks.append_log(df, str(tmp_path / "log"), "id")
    sinks.append_log(df, str(tmp_path / "log"), "id")
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_version(df, str(tmp_path / "t"), "v1")
    sinks.write_version(df.limit(1), str(tmp_path / "t"), "v2")
    assert sinks.read_current(spark, str(tmp_path / "t")).count() == 1


def test_incremental_embedding_adds_nothing_twice(spark, tmp_path):
    from curralign.streaming import incremental

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, text string"
    done = lambda: spark.read.schema("id string, vec array<float>").parquet(out)
    spark.createDataFrame([], "id string, vec array<float>").write.parquet(out)
    for batch in ([("a", "x")], [("a", "x"), ("b", "y")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        q = incremental.embed_new(spark.readStream.schema(schema).parquet(src), done, lambda d: hierarchy.embedded(d, hierarchy.hashed_ngrams(4)), out, str(tmp_path / "cp"))
        q.awaitTermination()
    assert rows(done(), "id") == [("a",), ("b",)]
