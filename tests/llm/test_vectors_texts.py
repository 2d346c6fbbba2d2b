from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from curralign.llm import neardup, neighbours


def test_usable_vectors(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    good, zero = [1.0, 2.0], [0.0, 0.0]
    data = [("a", "m", "1", good, t(1)), ("a", "m", "1", good, t(1)), ("b", "m", "1", good, t(1)), ("b", "m", "2", zero, t(2)), ("c", "m", None, [1.0, None], t(1)), ("d", "m", "1", [1.0, float("inf")], t(1)), ("e", "m", "1", [1.0], t(1)), ("f", "m", "1", None, t(1)), ("g", "x", "1", good, t(1)), (None, "m", "1", good, t(1)), ("h", "m", "1", [], t(1))]
    df = spark.createDataFrame(data, "standard_id string, model string, model_version string, vector array<float>, created_at timestamp")
    assert rows(neighbours.usable_vectors(df, "m", 2)) == [("a", [1.0, 2.0])]


def exact(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {ids[i]: {ids[j] for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k]} for i in range(len(ids))}


def test_one_cell_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 16)) * rng.uniform(0.1, 30, size=(120, 1))
    ids = [f"v{i:03}" for i in range(120)]
    df = spark.createDataFrame([(i, [float(v) for v in row], "extra") for i, row in zip(ids, x, strict=True)], "id string, vec array<double>, cosine string")
    got: dict = {}
    for i, nb, *_ in rows(neighbours.nearest(df, 5, 16, cells=1)):
        got.setdefault(i, set()).add(nb)
    assert got == exact(x, ids, 5)


def test_recall_over_cells_and_split_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 600)] + 0.3 * rng.normal(size=(600, 16))
    x[:200] = centres[0] + 0.3 * rng.normal(size=(200, 16))  # a third in one cell
    ids = [f"v{i:03}" for i in range(600)]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "id string, vec array<double>")
    want = exact(x, ids, 5)
    got: dict = {}
    for i, nb, *_ in rows(neighbours.nearest(df, 5, 16)):
        got.setdefault(i, set()).add(nb)
    assert all(len(v) == 5 for v in got.values()) and len(got) == 600
    assert sum(len(got[i] & want[i]) for i in ids) / 3000 > 0.97


def test_two_levels_and_split_cells(spark, monkeypatch):
    for name, value in (("MEMBERS", 24), ("FLAT", 4), ("TILE", 64), ("ASKING", 128)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 500)] + 0.3 * rng.normal(size=(500, 16))
    x[:170] = centres[0] + 0.05 * rng.normal(size=(170, 16))
    ids = [f"v{i:03}" for i in range(500)]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "id string, vec array<double>")
    want = exact(x, ids, 5)
    got: dict = {}
    for i, nb, *_ in rows(neighbours.nearest(df, 5, 16)):
        assert nb not in got.setdefault(i, set())
        got[i].add(nb)
    assert all(len(v) == 5 for v in got.values()) and len(got) == 500
    assert sum(len(got[i] & want[i]) for i in ids) / 2500 > 0.9


def test_equal_directions_and_few_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [3.0, 0.0])], "id string, vec array<double>")
    got = rows(neighbours.nearest(df, 1, 2), "id", "nb")
    assert got == [("a", "b"), ("b", "a"), ("c", "a")]
    assert neighbours.nearest(df.limit(1), 5, 2).count() == 0
    assert neighbours.nearest(df.limit(0), 5, 2).count() == 0
    assert neighbours.nearest(df, 9, 2).count() == 6


def test_dart_signatures_estimate_jaccard():
    sketch = neardup.DartMinHash(512)
    base = neardup._mix(np.arange(100, dtype=np.uint64))
    a, b = base[:80], base[20:100]
    sa, sb = sketch.signatures([a, b])
    assert abs((sa == sb).mean() - 0.6) < 0.08
    assert sketch.signatures([a[::-1]])[0].tolist() == sa.tolist()
    assert sketch.signatures([a[:0]]) == [None]


def test_dart_signatures_estimate_weighted_jaccard():
    sketch = neardup.DartMinHash(512)
    e = neardup._mix(np.arange(40, dtype=np.uint64))
    w1, w2 = np.full(40, 1.0), np.full(40, 1.0)
    w1[:10], w2[:10] = 2.5, 0.5
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    got = (sketch.signature(e, w1) == sketch.signature(e, w2)).mean()
    assert abs(got - want) < 0.08
    assert sketch.signature(e, np.zeros(40)) is None


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(60):
        base = r.sample(words, 45)
        texts.append((f"a{i:03}", " ".join(base)))
        for j in range(r.randrange(3)):
            edited = list(base)
            for _ in range(r.randrange(9)):
                edited[r.randrange(45)] = r.choice(words)
            texts.append((f"b{i:03}{j}", " ".join(edited)))
    texts += [(f"c{i}", texts[0][1].upper()) for i in range(4)]
    texts += [("n", None), ("e", ""), ("short", "one two"), texts[3], texts[3], (None, texts[5][1])]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs_match_brute_force(spark, seed):
    texts = corpus(seed)
    sets = {i: frozenset(t.lower().split()) for i, t in texts if i and t and len(set(t.split())) >= 25}
    ids = sorted(sets)
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    df = spark.createDataFrame([(*t, "x") for t in texts], "id string, txt string, rep string").repartition(6)
    assert set(rows(neardup.similar_pairs(df, "id", "txt"))) == want
    groups = {r[0]: r[1:] for r in rows(neardup.near_duplicate_groups(df, "id", "txt"), "id", "rep", "class_id", "n_links")}
    assert set(groups) == set(ids)
    assert all(groups[a][1] == groups[b][1] for a, b in want)


def test_classes_of_all_tasks_are_spread_over_targets(spark):
    df = spark.createDataFrame([(f"i{i}", f"word{i} word{i + 1} word{i + 2}") for i in range(80)], "id string, txt string").repartition(8)
    signed = neardup.word_sets(df, "id", "txt", 1).mapInArrow(lambda it: neardup._sign(it, neardup.ROWS, neardup.BANDS, 1_000), "part int, blob binary, ids array<string>")
    sent = signed.where("part < 0").select("part", "ids").collect()
    assert sorted(i for r in sent for i in r.ids) == sorted(f"i{i}" for i in range(80))
    assert len(sent) == 8 and len({r.part for r in sent}) > 4 and min(r.part for r in sent) >= -1_000


def test_plans_hold_no_filter_of_candidates(spark):
    df = spark.createDataFrame([t for t in corpus(1) if t[0]], "id string, txt string")
    plan = neardup.similar_classes(df, "id", "txt", 0.8, 25)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "might_contain(" in plan and "might_contain(0x" not in plan


def test_no_texts(spark):
    df = spark.createDataFrame([], "id string, txt string")
    assert neardup.similar_pairs(df, "id", "txt").count() == 0
    assert neardup.near_duplicate_groups(df, "id", "txt").count() == 0


def test_band_probability_loses_no_link():
    assert 1 - (1 - 0.8**neardup.ROWS) ** neardup.BANDS > 0.9999


def test_words_are_hashed_apart(spark):
    df = spark.createDataFrame([("a", "Ça, ça! 3rd x-ray")], "id string, t string")
    assert len(neardup.word_sets(df, "id", "t", 1).select(F.explode("words")).collect()) == 4
