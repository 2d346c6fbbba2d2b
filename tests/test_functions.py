from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from curralign.functions import grades, notes, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("g", "want"), [("5.0", "5"), ("Grade 3", "3"), ("GR. 7", "7"), ("kg", "K"), ("high school", "HS"), ("11", "HS"), ("0", None), ("-1", "K"), ("x", None), (None, None)])
def test_coerce_grade(spark, g, want):
    assert one(spark, g, grades.coerce_grade) == want


@pytest.mark.parametrize(("g", "want"), [("K", 0), ("HS", 9), ("6-8", 6), ("K-12", 0), ("Fifth", 5), ("10", 10), ("", 99), (None, 99)])
def test_grade_year(spark, g, want):
    assert one(spark, g, grades.grade_year) == want


def test_three_grade_orders_differ(spark):
    assert one(spark, "HS", grades.grade_rank) == 9
    assert one(spark, "HS", grades.grade_export_rank) == 13
    assert one(spark, "10", grades.grade_rank) == 99
    assert one(spark, "10", grades.grade_year) == 10


@pytest.mark.parametrize(("d", "want"), [(0, "exact"), (1, "1 year later in target"), (-2, "2 years earlier in target"), (None, None)])
def test_alignment(spark, d, want):
    assert one(spark, d, grades.alignment, "int") == want


def test_bounds_take_a_range_in_either_slot(spark):
    def bounds(start, end):
        return tuple(spark.range(1).select(grades.written_bounds(*(F.lit(x).cast("string") for x in (start, end))).alias("b")).select("b.*").first())

    assert bounds("3-6", None) == ("3", "6")
    assert bounds(None, "K to 2") == ("K", "2")
    assert bounds(4, "HS") == ("4", "HS")
    g = spark.createDataFrame([(x,) for x in [*grades.GRADE_ORDER, "8-6", "x", None]], "g string")
    let = lambda wanted: [r["g"] for r in g.where(grades.allowed(F.col("g"), wanted)).collect()]
    assert let("6-8") == ["6", "7", "8"]
    assert let([8, "k"]) == ["K", "8"]
    assert let("8-6") == ["8-6"]
    assert let("grade 3") == ["3"]


def test_lowest_grade(spark):
    assert one(spark, ["05", "03"], grades.lowest_grade, "array<string>") == "3"
    assert one(spark, ["03", "11"], grades.lowest_grade, "array<string>") == "HS"
    assert one(spark, ["??"], grades.lowest_grade, "array<string>") is None


def test_notes(spark):
    assert one(spark, "[exact-match 5/5] same", notes.quality) == 5
    assert one(spark, "[exact-match 5/5] same", notes.llm_quality) is None
    assert one(spark, "[LLM score 2/5] why. | MISMATCH: other scope.", notes.mismatch) == "other scope"
    assert one(spark, None, notes.mismatch) == "unknown"
    note = "llm_prereq cosine=0.5 hard [promoted_soft_to_hard via qwen]: builds\non it"
    assert one(spark, note, notes.strength) == "hard"
    assert one(spark, note, notes.reason) == "builds\non it"
    assert one(spark, note, notes.export_reason) == ""
    assert one(spark, "plain", notes.reason) == "plain"


def test_ids(spark):
    assert one(spark, "6.RP.3", text.expand_id) == "CCSS.MATH.6.RP.3"
    assert one(spark, "tx.math.5", text.expand_id) == "tx.math.5"
    assert one(spark, "CCSS.MATH.6.RP.A.3", text.loose_id) == "CCSS.MATH.6.RP.3"
    assert one(spark, "A.B.1234", text.stem_id) == "A.B"
    assert one(spark, "A.B.123", text.stem_id) == "A.B.123"


def test_keywords_are_distinct_in_order_and_bounded(spark):
    got = one(spark, "Students compare well-known FRACTIONS with fractions and cat", text.keywords)
    assert got == ["compare", "well-known", "fractions"]
    many = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    assert len(one(spark, many, text.keywords)) == 20


def test_html(spark):
    page = "<style>p{}</style><p>a&nbsp;&amp;\n b</p><SCRIPT>x()</SCRIPT>"
    assert one(spark, page, text.html_text) == "a & b"
    anchors = one(spark, '<a name="g1">One</a> first <a name="g2">Two</a> second', text.html_anchors)
    assert [(a["anchor"], a["text"]) for a in anchors] == [("g1", "One first"), ("g2", "Two second")]


def test_pages(spark):
    assert one(spark, "\n".join(f"Part {i} ........ {i}" for i in range(5)), text.is_content_page) is False
    assert one(spark, "All rights reserved", text.is_content_page) is False
    assert one(spark, "All rights reserved\n1. Count", text.is_content_page) is True
    assert one(spark, "eht srenrael dna eht", text.unreversed) == "the learners and the"
    assert one(spark, "the learners", text.unreversed) == "the learners"
    assert one(spark, "•a • •b", text.bullets) == ["a", "b"]
    items = one(spark, "AB1 first long text AB2 second long text", lambda c: text.coded_items(c, r"AB\d"))
    assert [(i["code"], i["text"]) for i in items] == [("AB1", "first long text"), ("AB2", "second long text")]


def test_json_body(spark):
    assert one(spark, '```json\n[{"a": 1}]\n```', text.json_body) == '[{"a": 1}]'
    assert one(spark, "no json", text.json_body) is None


def test_roman_and_steps(spark):
    assert one(spark, " xiv ", text.roman_value) == 14
    assert one(spark, "IIII", text.roman_value) is None
    from curralign.plans.maintain import run_steps

    calls = []

    def flaky():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError

    assert run_steps([("a", flaky), ("b", lambda: 1 / 0), ("c", print)], {"c"}) == [("a", "done"), ("b", "failed"), ("c", "skipped")]


def test_vector_blobs(spark):
    import struct

    from curralign.sources.hierarchy import decoded_vectors

    df = spark.createDataFrame([(bytearray(struct.pack("<2f", 1.5, -2.0)),), (bytearray(b"xyz"),), (None,)], "b binary")
    assert [r["vec"] for r in decoded_vectors(df, "b", 2).collect()] == [[1.5, -2.0], None, None]
