from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from curralign.llm import consensus


def test_alignment_is_cheapest():
    path = consensus.align("a b c d".split(), "a c x d".split())
    cost = sum(i is None or j is None or "a b c d".split()[i] != "a c x d".split()[j] for i, j in path)
    assert cost == 2
    assert consensus.align([], ["a"]) == [(None, 0)]
    assert consensus.align(["a"], []) == [(0, None)]


def test_majority_and_weights():
    v = [t.split() for t in ("the cat sat down", "the cat sat", "the dog sat", "a cat sat")]
    assert consensus.representative(v, [1, 1, 1, 1]) == 1
    assert consensus.representative(v, [1, 1, 9, 1]) == 2
    assert consensus.representative([["a"]], [0]) == 0


def test_priority_is_the_first_in_order_however_it_is_chunked(spark, monkeypatch):
    data = [("g", f"i{i:04}", f"text {i % 50} of length " + "x" * (i % 37)) for i in range(400)] + [("h", "one", "only"), (None, "z", "q"), ("g", "n", None), ("g", "i0001", "text 1 of length x")]
    df = spark.createDataFrame(data, "grp string, id string, val string").withColumn("weight", F.lit("clash"))
    best = max((d for d in data if d[0] == "g" and d[2]), key=lambda d: (len(d[2]), [-ord(c) for c in d[1]]))
    for chunk in (4, 1000):
        monkeypatch.setattr(consensus, "CHUNK", chunk)
        got = rows(consensus.consensus_representatives(df, "grp", "id", "val", priority=[-F.length("val")]), "grp", "id")
        assert got == [("g", best[1]), ("h", "one")]


def test_votes_of_copies_count(spark):
    df = spark.createDataFrame([("g", "1", "a b c"), ("g", "2", "a b c"), ("g", "3", "a x c"), ("g", "4", "a x d")], "grp string, id string, val string")
    assert rows(consensus.consensus_representatives(df, "grp", "id", "val"), "id") == [("1",)]
    assert consensus.consensus_representatives(df.limit(0), "grp", "id", "val").count() == 0


def test_dates_and_hosts(spark):
    dates = {"2024-12-01": "2024-12-01", "2024/8/5": "2024-08-05", "12.04.2024": "2024-04-12", "2026-02-05T00:00:00Z": "2026-02-05", "20250725": "2025-07-25", "30 Aug 2024": "2024-08-30", "4 August 2024": "2024-08-04", "2024-13-05": None, "2023-02-29": None, "2026-07-01": None, "n/a": None, "": None, None: None}
    got = spark.createDataFrame([(d,) for d in dates], "d string").select("d", consensus.valid_date(F.col("d")).cast("string").alias("v")).collect()
    assert {r["d"]: r["v"] for r in got} == dates
    urls = {"https://www.a.example/x": "a.example", " HTTP://A.EXAMPLE:8443/y ": "a.example", "https://": None, None: None, "": None}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", consensus.url_host(F.col("u")).alias("h")).collect()
    assert {r["u"]: r["h"] for r in got} == urls


def test_best_records(spark):
    long, cut_off = "a usable text of some length", "a much longer text that is cut off …"
    data = [("S.1.1111", long, "2024-01-01", "http://x.example/"), ("S.1.2222", cut_off, "1 Feb 2024", "http://www.T.example:80/"), ("S.1.2222", cut_off, "1 Feb 2024", "http://www.T.example:80/"), ("S.1.3333", long, "2024-03-01", None), ("S.2.1111", long, None, None), ("S.3.123", long, None, None), ("S.3.124", long, None, None), ("S.4.1111", None, "n/a", ""), ("S.4.2222", " short ", None, None)]
    std = spark.createDataFrame(data, "id string, standard_text string, last_verified_date string, source_url string")
    trust = spark.createDataFrame([("t.example", 1), ("other", 2)], "host string, trust_rank int")
    assert rows(consensus.best_records(std, trust), "stem", "text_id", "url_id", "date_id") == [("S.1", "S.1.3333", "S.1.2222", "S.1.3333"), ("S.4", None, None, None)]


def test_planted_majority_survives_any_chunking(spark, monkeypatch):
    base = "each learner measures the length of two objects with the same unit and compares".split()
    data = [("g", "true", " ".join(base))]
    for i in range(260):
        row = list(base)
        row[i % len(base)] = f"w{i}"
        if i % 3 == 0:
            row.insert(i % 7, f"more{i}")
        if i % 5 == 0:
            del row[(i + 4) % len(row)]
        data.append(("g", f"i{i:03}", " ".join(row)))
    data += [("h", f"h{i}", t) for i, t in enumerate(["a b c d", "a b x d", "a y c d", "z b c d", "a b c", "q"])]
    df = spark.createDataFrame(data, "grp string, id string, val string")
    for chunk in (5, 64, 1000):
        monkeypatch.setattr(consensus, "CHUNK", chunk)
        assert rows(consensus.consensus_representatives(df, "grp", "id", "val"), "grp", "id") == [("g", "true"), ("h", "h0")]


def test_halved_alignment_costs_the_same(monkeypatch):
    import random

    r = random.Random(7)
    cost = lambda a, b: sum(i is None or j is None or a[i] != b[j] for i, j in consensus.align(a, b))
    for _ in range(30):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(40))] for _ in range(2))
        path = consensus.align(a, b)
        assert [i for i, _ in path if i is not None] == list(range(len(a))) and [j for _, j in path if j is not None] == list(range(len(b)))
        whole = cost(a, b)
        monkeypatch.setattr(consensus, "CELLS", 6)
        assert cost(a, b) == whole == consensus.distance(a, b)
        monkeypatch.undo()
