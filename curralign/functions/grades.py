"""Grades as column expressions. There are three orders, which are never mixed: rank, year and export rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
GRADE_ORDER = ["K", "1", "2", "3", "4", "5", "6", "7", "8", "HS"]
GRADE_WORDS = {
    "kindergarten": 0, "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9,
    "tenth": 10, "eleventh": 11, "twelfth": 12,
}
UNKNOWN = 99
EXPORT_HS = 13
#: Fixed value: what stands between the ends of a range.
RANGE = r"(?i)\s*(?:-|–|—|\.\.|to|through)\s*"


def _lookup(col: Column, pairs: dict[str, object]) -> Column:
    """The value of ``col`` in a fixed map, null where it is absent."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), F.coalesce(col, F.lit("\0")))


def grade_rank(col: Column) -> Column:
    """Position in ``K, 1..8, HS``; 99 for anything else, null included."""
    return F.coalesce(_lookup(col, {g: i for i, g in enumerate(GRADE_ORDER)}), F.lit(UNKNOWN))


def grade_export_rank(col: Column) -> Column:
    """The order of exports: K is 0, numbers are themselves, HS is 13, anything else 99."""
    return F.when(col == "K", 0).when(col == "HS", EXPORT_HS).otherwise(F.coalesce(col.try_cast("int"), F.lit(UNKNOWN)))


def grade_year(col: Column) -> Column:
    """The school year of a grade: K is 0, HS 9, words and numbers their year, a range its low end; 99 if unknown."""

    def one(g: Column) -> Column:
        return F.when(g == "K", 0).when(g == "HS", 9).otherwise(F.coalesce(_lookup(F.lower(g), GRADE_WORDS), g.try_cast("int")))

    g = F.trim(col)
    return F.coalesce(one(g), F.when(g.contains("-"), one(F.trim(F.substring_index(g, "-", 1)))), F.lit(UNKNOWN)).cast("int")


def grade_delta(source: Column, target: Column) -> Column:
    """Year of the target less year of the source."""
    return grade_year(target) - grade_year(source)


def alignment(delta: Column) -> Column:
    """``exact``, ``2 years later in target``, ``1 year earlier in target``; null for null."""
    n = F.abs(delta)
    words = F.concat(n.cast("string"), F.when(n == 1, " year ").otherwise(" years "), F.when(delta > 0, "later in target").otherwise("earlier in target"))
    return F.when(delta == 0, "exact").when(delta.isNotNull(), words)


def coerce_grade(col: Column) -> Column:
    """A canonical code for a loosely written grade: ``Grade 3``, ``5.0``, ``kg``, ``high school``; years from 9 are HS, below 0 K; else null."""
    s = F.regexp_replace(F.upper(F.trim(col.cast("string"))), r"^(?:GRADES?|GR)\.?\s*", "")
    n = s.try_cast("double").cast("int")
    number = F.when(n.between(1, 8), n.cast("string")).when(n >= 9, "HS").when(n < 0, "K")
    return F.when(s.isin(*GRADE_ORDER), s).when(s.isin("K", "KG", "KINDERGARTEN"), "K").when(s.isin("HS", "HIGH SCHOOL"), "HS").otherwise(number)


def range_ends(col: Column) -> Column:
    """The two ends of a written range as an array, or the value alone."""
    return F.split(F.trim(col), RANGE, 2)


def pdf_grade(col: Column) -> Column:
    """K and HS in their written forms, 1..8, and anything else trimmed."""
    g = F.upper(F.trim(col))
    high = ("9", "10", "11", "12", "9-10", "11-12", "9-12", "HS", "HIGH SCHOOL")
    return F.when(g.isin("K", "KG", "KINDERGARTEN"), "K").when(g.isin(*high), "HS").when(g.isin(*GRADE_ORDER[1:9]), g).otherwise(F.trim(col))


def education_level(col: Column) -> Column:
    """``KG, 00..12`` to a grade; null for other codes."""
    n = col.try_cast("int")
    return F.when(col.isin("KG", "K"), "K").when(n == 0, "K").when(n.between(1, 8), n.cast("string")).when(n.between(9, 12), "HS")


def lowest_grade(levels: Column) -> Column:
    """The lowest grade of an array of level codes; any high-school code makes it HS; null for no known code."""
    codes = F.filter(F.transform(levels, education_level), lambda g: g.isNotNull())
    low = F.array_min(F.transform(codes, grade_rank))
    return F.when(F.array_contains(codes, "HS"), "HS").otherwise(F.get(F.array(*(F.lit(g) for g in GRADE_ORDER)), low))


def written_bounds(start: Column, end: Column) -> Column:
    """``lo, hi`` of two loosely written arguments: the ends of the first of them that is a range, else a code of each."""

    def ends(col: Column) -> Column:
        two = F.filter(range_ends(col), lambda x: x != "")
        return F.when(F.size(two) == 2, F.struct(coerce_grade(F.get(two, F.lit(0))).alias("lo"), coerce_grade(F.get(two, F.lit(1))).alias("hi")))

    return F.coalesce(ends(start), ends(end), F.struct(coerce_grade(start).alias("lo"), coerce_grade(end).alias("hi")))


def within(grade: Column, bounds: Column, unknown: bool = True) -> Column:
    """Whether a grade lies between written bounds, of which a missing one is open. ``unknown``: whether grades off the list are above all others, or nowhere."""
    rank, lo, hi = grade_rank(grade), bounds["lo"], bounds["hi"]
    inside = (lo.isNull() | (rank >= grade_rank(lo))) & (hi.isNull() | (rank <= grade_rank(hi)))
    return inside if unknown else inside & (rank < UNKNOWN)


def allowed(grade: Column, wanted: object) -> Column:
    """Whether a filter lets a grade through: any of a list, a range whose ends are in order, or one grade as far as it can be read."""
    if isinstance(wanted, list | tuple | set):
        return grade.isin(*(coerce_grade(F.lit(x)) for x in wanted))
    text = F.lit(str(wanted))
    both = written_bounds(text, F.lit(None).cast("string"))
    ordered = grade_rank(both["lo"]) <= grade_rank(both["hi"])
    return F.when(both["lo"].isNotNull() & both["hi"].isNotNull() & ordered, within(grade, both)).otherwise(grade == F.coalesce(coerce_grade(text), text))
