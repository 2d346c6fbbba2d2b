"""The grammar of the ``notes`` columns: scores, mismatches and reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of notes.
SCORED = r"\[(?:LLM score|exact-match) (\d)/5\]"
LLM_SCORED = r"\[LLM score (\d)/5\]"
#: What the crosswalk passes write.
PLACEHOLDER = ("nlp_pass", "direct_family")


MISMATCH = r"MISMATCH:\s*(.+?)\.?\s*$"
COSINE = r"cosine=([0-9.]+)"
STRENGTH = r"(?s)\b(hard|soft)\b(?:\s*\[[^\]]*\])?:\s*(.*)$"
EXPORTED = r"(?s)(?:hard|soft):\s*(.*)$"


def _first(col: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def quality(col: Column) -> Column:
    """The score 1..5 of a note, of either writer; null for none."""
    return _first(col, SCORED).cast("int")


def llm_quality(col: Column) -> Column:
    """The score as exporters read it, without exact matches."""
    return _first(col, LLM_SCORED).cast("int")


def is_scored(col: Column) -> Column:
    """Whether a note has a score; placeholders of the crosswalk passes have none."""
    return F.coalesce(col.rlike(SCORED), F.lit(False))


def mismatch(col: Column) -> Column:
    """The text after ``MISMATCH:`` without a final stop; ``unknown`` for a note without one."""
    return F.coalesce(_first(col, MISMATCH), F.lit("unknown"))


def cosine(col: Column) -> Column:
    """The cosine that a pass wrote into a note."""
    return _first(col, COSINE).cast("double")


def strength(col: Column) -> Column:
    """``hard`` or ``soft`` of a prerequisite's note; null for other notes."""
    return _first(col, STRENGTH)


def reason(col: Column) -> Column:
    """The reason after the strength, or the whole note without one."""
    return F.when(strength(col).isNotNull(), F.regexp_extract(col, STRENGTH, 2)).otherwise(col)


def export_reason(col: Column) -> Column:
    """The reason as the concept map reads it, which misses promoted notes."""
    return F.trim(F.regexp_extract(col, EXPORTED, 1))


def score_note(score: Column, rationale: Column, mismatch_text: Column) -> Column:
    """``[LLM score N/5] why.`` with a mismatch, if there is one."""
    why = F.concat(F.regexp_replace(F.trim(rationale), r"\.+$", ""), F.lit("."))
    tail = F.when(F.coalesce(F.trim(mismatch_text), F.lit("")) != "", F.concat(F.lit(" | MISMATCH: "), F.trim(mismatch_text), F.lit("."))).otherwise("")
    return F.concat(F.lit("[LLM score "), score.cast("string"), F.lit("/5] "), why, tail)
