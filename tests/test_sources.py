from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from curralign.functions import text
from curralign.operators import fts, lineage
from curralign.plans import tools
from curralign.sources import pages, sinks
from curralign.streaming import incremental


def test_page_texts_and_unreadable_files(spark):
    docs = spark.createDataFrame([("a", b'["one","two"]'), ("b", b"broken"), ("c", b"[]"), ("d", None)], "path string, content binary")
    got = rows(pages.page_texts(docs, lambda b: json.loads(b)), "path", "page", "text")
    assert got == [("a", 1, "one"), ("a", 2, "two"), ("b", 0, None), ("d", 0, None)]
    assert pages.page_texts(docs.limit(0), lambda b: json.loads(b)).count() == 0


def test_headers_and_cells_are_carried_down_over_pages(spark):
    table = [[["stray"], ["Id", "Grade"], ["x", "3"], ["y", ""]], [["z", None]], [["Grade", "Id"], ["4", "w"]]]
    docs = spark.createDataFrame([("a", json.dumps(table).encode()), ("n", None)], "path string, content binary")
    got = rows(pages.page_tables(docs, lambda b: json.loads(b), lambda c: "Id" in c, ["id", "grade"]))
    assert got == [("a", 1, 1, "x", "3"), ("a", 1, 2, "y", "3"), ("a", 2, 3, "z", "3"), ("a", 3, 4, "w", "4")]


def test_services_are_asked_once_and_failures_again(spark, tmp_path):
    keys = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "key string")

    def call(key):
        if key == "bad":
            raise ConnectionError("no")
        return f"<{key}>"

    def silent(key):
        if key == "bad":
            return "now"
        raise AssertionError(key)

    assert [r[:2] for r in rows(pages.fetched(keys, call, str(tmp_path / "c")))] == [("a", "<a>"), ("bad", None)]
    assert rows(pages.fetched(keys, silent, str(tmp_path / "c"))) == [("a", "<a>", None), ("bad", "now", None)]


def test_versions_are_numbered(spark, tmp_path):
    at = str(tmp_path / "t")
    for i in range(1, 12):
        sinks.write_version(spark.range(i), at, f"v{i}")
    assert sinks.read_current(spark, at).count() == 11
    assert sinks.has_version(spark, at, "v3") and not sinks.has_version(spark, at, "v12")
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, str(tmp_path / "none"))


def test_stream_upserts_once(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "t")
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, at int, v string").coalesce(1).write.parquet(source)
    for i in range(3):
        stream = spark.readStream.schema("id string, at int, v string").parquet(source)
        incremental.upsert_new(stream, ["id"], "at", at, str(tmp_path / "state")).awaitTermination()
        if i == 1:
            spark.createDataFrame([("a", 0, "late"), ("c", 5, "new")], "id string, at int, v string").coalesce(1).write.mode("append").parquet(source)
    assert rows(sinks.read_current(spark, at)) == [("a", 2, "y"), ("b", 1, "z"), ("c", 5, "new")]
    assert spark.read.text(f"{at}/_versions").count() == 2


def test_first_seen_and_late_rows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:01:00", 2), ("b", "2024-01-01 00:02:00", 3)], "id string, t string, n int").select("id", F.to_timestamp("t").alias("t"), "n").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id string, t timestamp, n int").parquet(source)
    incremental.first_seen(stream, ["id"], "t", "1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    assert rows(spark.read.parquet(out), "id") == [("a",), ("b",)]


def test_many_queries_rank_as_single_ones(spark):
    docs = spark.createDataFrame([("1", "measuring volume and volumes"), ("2", "fractions of volume"), ("3", "nothing here"), ("4", None)], "id string, t string")
    posted = fts.postings(docs, "id", "t")
    asked = spark.createDataFrame([("q", "volume measures"), ("e", "a b"), ("n", None)], "q string, query string")
    single = rows(fts.bm25(fts.index(docs.where("t is not null"), "id", "t"), fts.query_terms("volume measures")), "id", "score")
    assert rows(fts.bm25_many(posted, asked).where("q = 'q'"), "id", "score") == single and single
    assert fts.bm25_many(posted, asked).where("q <> 'q'").count() == 0


def test_many_progressions_keep_their_bounds(spark):
    std = spark.createDataFrame([(f"s{g}{i}", [1.0, i / 10], "x", g) for g in ("K", "1", "2", "odd") for i in range(5)], "id string, vec array<double>, scope string, grade string")
    asked = spark.createDataFrame([("a", [1.0, 0.0], "x", "K to 1", None), ("b", [1.0, 0.0], "x", None, None), ("c", [0.0, -1.0], "x", None, None)], "q string, vec array<double>, scope string, start string, end string")
    got = rows(tools.progression_many(std, asked), "q", "grade", "id")
    assert {r[1] for r in got if r[0] == "a"} == {"K", "1"} and {r[1] for r in got if r[0] == "b"} == {"K", "1", "2"}
    assert [r for r in got if r[0] == "a" and r[1] == "1"] == [("a", "1", "s10"), ("a", "1", "s11"), ("a", "1", "s12")] and not [r for r in got if r[0] == "c"]
    found = rows(tools.search_many(std, asked.select("q", "vec", "scope"), 2), "q", "rank_no")
    assert found == [(q, n) for q in "abc" for n in (1, 2)]


def test_reversed_texts_with_other_white_space(spark):
    df = spark.createDataFrame([("eht  dna\tfo\neht kooB",), ("the and of",), (None,)], "t string")
    assert rows(df.select(text.unreversed(F.col("t")).alias("u"))) == [("the and of",), ("the and of\nthe Book",), (None,)]


def test_checkpoints_need_a_shared_folder_off_a_single_machine():
    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

            class getConf:
                get = staticmethod(lambda *a: None)

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError):
        lineage.ensure_checkpoint_dir(Fake)
