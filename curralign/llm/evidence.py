"""Counts of a whole corpus for functions that read one text at a time.

The counts are a table ``key, n``. Its most frequent rows travel with the tasks; a text that asks for another key is read
again once that key was looked up in the whole table by a join, as often as its reading asks for new ones. So the result is the same
whatever the number of rows that travel, and nothing that grows with the corpus is collected or broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

#: Rows of the table that travel, at most.
KEEP = 250_000
#: Distinct keys that a task counts before it sends them on.
HELD = 300_000


class Counts:
    """``n(key)``, 0 for a key that the corpus lacks. Keys that are not known here are noted in ``asked`` and taken as 0."""

    def __init__(self, known: Mapping[str, int], complete: bool = True) -> None:
        self.known, self.complete = known, complete
        self.extra: dict[str, int] = {}
        self.asked: set[str] = set()

    def n(self, key: str) -> int:
        got = self.known.get(key)
        if got is not None:
            return got
        if self.complete:
            return 0
        got = self.extra.get(key)
        if got is None:
            self.asked.add(key)
            return 0
        return got


@dataclass(frozen=True)
class Evidence:
    """The table, what travels of it, and whether that is all."""

    table: DataFrame
    known: Broadcast
    complete: bool


def _counted(batches: Iterator[pa.RecordBatch], keys: Callable[[str], Iterable[str]]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def send() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["key", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(keys(text))
        if len(counts) > HELD:
            yield send()
    yield send()


def counted(texts: DataFrame, text_col: str, keys: Callable[[str], Iterable[str]], least: int = 1) -> DataFrame:
    """``key, n``: the counts of all ``keys`` of all texts; keys that occur less than ``least`` times are left out."""
    part = texts.select(text_col).mapInArrow(lambda it: _counted(it, keys), "key string, n bigint")
    return cut(part.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def learn(texts: DataFrame, text_col: str, keys: Callable[[str], Iterable[str]], least: int = 1, keep: int | None = None, always: Iterable[str] = ()) -> Evidence:
    """The evidence of :func:`counted`."""
    return evidence_of(counted(texts, text_col, keys, least), keep, always)


def evidence_of(table: DataFrame, keep: int | None = None, always: Iterable[str] = ()) -> Evidence:
    """The evidence of a table ``key, n`` that was written already; the few keys ``always`` travel in any case, since every text asks for them."""
    keep = KEEP if keep is None else keep
    rows = table.orderBy(F.col("n").desc(), "key").limit(keep + 1).toPandas()
    known = dict(zip(rows["key"].head(keep), rows["n"].head(keep).tolist(), strict=True))
    fixed = list(always)
    known |= dict.fromkeys(fixed, 0) | {r["key"]: r["n"] for r in table.where(F.col("key").isin(fixed)).collect()} if fixed else {}
    return Evidence(table, table.sparkSession.sparkContext.broadcast(known), len(rows) <= keep)


#: What a worker's last task read with, for the next one on the same counts; what it remembers is then whole.
_kept: dict[str, tuple[Mapping[str, int], Callable]] = {}


def _read(batches: Iterator[pa.RecordBatch], known: Broadcast, make: Callable[[Counts], Callable], kept: list[str], text_col: str, kind: pa.DataType, complete: bool) -> Iterator[pa.RecordBatch]:
    counts = Counts(known.value, complete)
    name = f"{make.__module__}.{make.__qualname__}"
    read = _kept[name][1] if complete and name in _kept and _kept[name][0] is counts.known else make(counts)
    if complete:
        _kept[name] = counts.known, read
    for batch in batches:
        texts = batch.column(text_col).to_pylist()
        columns, names = [batch.column(c) for c in kept], list(kept)
        if complete:
            yield pa.RecordBatch.from_arrays([*columns, pa.array([read(t) for t in texts], kind)], names=[*names, "result"])
            continue
        answers = batch.column("answers").to_pylist() if "answers" in batch.schema.names else [None] * len(texts)
        results, asked, extras = [], [], []
        for text, answer in zip(texts, answers, strict=True):
            if answer:
                counts.extra = dict(answer)
                read = make(counts)
            counts.asked = set()
            got = read(text)
            results.append(None if counts.asked else got)
            asked.append(sorted(counts.asked))
            extras.append(list(counts.extra.items()))
            if counts.asked or counts.extra:
                counts.extra = {}
                read = make(counts)  # what it remembers may rest on keys that were missing, or are this text's alone
        open_ = [bool(a) for a in asked]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(results, kind), pa.array([t if o else None for t, o in zip(texts, open_, strict=True)], pa.string()), pa.array(asked, pa.list_(pa.string())), pa.array([e if o else [] for e, o in zip(extras, open_, strict=True)], pa.map_(pa.string(), pa.int64()))],
            names=[*names, "result", text_col, "asked", "answers"],
        )


def read_texts(texts: DataFrame, text_col: str, evidence: Evidence, make: Callable[[Counts], Callable], sql_type: str, kind: pa.DataType) -> DataFrame:
    """The other columns of ``texts`` and ``result``: ``make(counts)(text)``, null texts included, with the corpus's counts.

    ``make`` gives a function of one text, which may remember what it asked. ``sql_type`` and ``kind`` are the type of its result.
    """
    kept = [c for c in texts.columns if c != text_col]
    types = dict(texts.dtypes)
    head = ", ".join(f"`{c}` {types[c]}" for c in kept) + f", result {sql_type}"
    known, complete = evidence.known, evidence.complete
    if complete:
        return texts.mapInArrow(lambda it: _read(it, known, make, kept, text_col, kind, True), head)
    schema = f"{head}, `{text_col}` string, asked array<string>, answers map<string, bigint>"
    done: list[DataFrame] = []
    todo = texts
    while True:
        step = cut(todo.mapInArrow(lambda it: _read(it, known, make, kept, text_col, kind, False), schema))
        done.append(step.where("size(asked) = 0").select(*kept, "result"))
        rest = step.where("size(asked) > 0")
        if rest.isEmpty():
            break
        rest = cut(rest.withColumn("row_", F.monotonically_increasing_id()))
        wanted = rest.select("row_", F.explode("asked").alias("key"))
        found = wanted.select("key").distinct().join(evidence.table, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
        # a key that many texts ask for is answered in many places
        salt = 16
        near = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        got = wanted.withColumn("salt", F.pmod(F.xxhash64("row_"), F.lit(salt)).cast("int")).join(near, ["key", "salt"])
        per = got.groupBy("row_").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("new"))
        todo = rest.join(per, "row_").select(*kept, text_col, F.map_concat("answers", "new").alias("answers"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
