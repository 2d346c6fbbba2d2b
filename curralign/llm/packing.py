"""Filling fixed-capacity containers: bounded-space online packing.

Each partition keeps a fixed number of open containers. An item goes to the fullest open one that has room (best fit);
when none has, the fullest is emitted and a new one opened. The items of containers that are still open at a partition's end
are left over; the next level packs them anew over a sixteenth of the partitions, until one partition is left, which takes
them largest first and emits everything. A level's input is what fits into ``open_windows`` containers for each partition before it.
"""

from __future__ import annotations

import bisect
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .encoding import encoder

CAPACITY, OPEN = 2_048, 64


class OpenWindows:
    """At most ``limit`` open containers with their items, kept sorted by fill."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.fills: list[int] = []
        self.items: list[list[int]] = []

    def place(self, item: int, size: int) -> list[int] | None:
        """Puts an item into a container; the items of a container that became full or was emitted for it."""
        done = None
        at = bisect.bisect_right(self.fills, self.capacity - size) - 1
        if at < 0:
            if len(self.fills) >= self.limit:
                self.fills.pop()
                done = self.items.pop()
            held, fill = [item], size
        else:
            held, fill = self.items.pop(at), self.fills.pop(at) + size
            held.append(item)
        if fill >= self.capacity and done is None:
            return held
        to = bisect.bisect_left(self.fills, fill)
        self.fills.insert(to, fill)
        self.items.insert(to, held)
        return done


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, limit: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows (item, size) to (item, size, container); those left over come out last, without a container."""
    context = TaskContext.get()
    prefix = f"{level}-{context.partitionId() if context else 0}"
    windows = OpenWindows(capacity, sys.maxsize if last else limit)  # the last level's input is bounded by the levels before
    made = 0
    waiting: dict[int, pa.RecordBatch] = {}  # batches that still have rows in open containers
    base = 0
    starts: list[int] = []

    def rows_of(groups: list[list[int]], named: bool) -> Iterator[pa.RecordBatch]:
        """The rows of whole containers, taken from each waiting batch at once."""
        nonlocal made
        by_batch: dict[int, tuple[list[int], list[str | None]]] = {}
        for group in groups:
            name = f"{prefix}-{made}" if named else None
            made += named
            for row in group:
                at = starts[bisect.bisect_right(starts, row) - 1]
                rows, names = by_batch.setdefault(at, ([], []))
                rows.append(row - at)
                names.append(name)
        for at, (rows, names) in by_batch.items():
            part = waiting[at].take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string())], names=["item", "size", "container"])

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting[base] = batch
        starts.append(base)
        closed = [g for i, size in enumerate(batch.column(1).to_pylist()) if (g := windows.place(base + i, size)) is not None]
        base += batch.num_rows
        yield from rows_of(closed, True)
        needed = {starts[bisect.bisect_right(starts, r) - 1] for held in windows.items for r in held}
        waiting = {s: b for s, b in waiting.items() if s in needed}
    yield from rows_of(windows.items, last)


def pack(items: DataFrame, item_col: str, size_col: str, capacity: int = CAPACITY, open_windows: int = OPEN) -> DataFrame:
    """``item_col, container``: every item with a positive size in exactly one container whose sizes sum to at most ``capacity``.

    A size above ``capacity`` has a container to itself, so split such items first; a null, zero or negative size takes no
    room and gives no row. Items may repeat; each row is placed on its own.
    """
    kind = dict(items.dtypes)[item_col]
    left = items.where(F.col(size_col) > 0).select(F.col(item_col).alias("item"), F.col(size_col).cast("long").alias("size"))
    schema = f"item {kind}, size bigint, container string"
    parts = max(1, left.rdd.getNumPartitions())
    level, placed = 0, None
    while True:
        last = parts == 1
        step = cut(left.mapInArrow(lambda it, lv=level, end=last: _pack(it, capacity, open_windows, lv, end), schema))
        done = step.where("container is not null").select("item", "container")
        placed = done if placed is None else placed.unionByName(done)
        if last:
            return placed.select(F.col("item").alias(item_col), "container")
        level, parts = level + 1, -(-parts // 16)
        left = step.where("container is null").select("item", "size").repartition(parts, F.xxhash64("item"))
        order = [F.col("size").desc(), F.col("item")] if parts == 1 else [F.xxhash64(F.lit(level), "item"), F.col("item")]
        left = left.sortWithinPartitions(*order)


def _count(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        n = np.array([len(enc.encode(t)) if t else 0 for t in batch.column(1).to_pylist()], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["doc_id", "n_tokens"])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, open_windows: int = OPEN, path: str | None = None) -> DataFrame:
    """``doc_id, start_token, end_token, container``: every token of every text in one container.

    A text that exceeds the capacity is cut into full pieces and a rest; no other is split. Null and empty texts have no
    tokens and give no row. ``doc_id`` is unique.
    """
    sizes = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _count(it, path), "doc_id bigint, n_tokens bigint"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(capacity).cast("long"))
    pieces = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(starts).alias("start_token"))
    pieces = pieces.select("doc_id", "start_token", F.least(F.col("start_token") + capacity, "n_tokens").alias("end_token"))
    items = pieces.select(F.struct("doc_id", "start_token", "end_token").alias("piece"), (F.col("end_token") - F.col("start_token")).alias("size"))
    return pack(items, "piece", "size", capacity, open_windows).select("piece.doc_id", "piece.start_token", "piece.end_token", "container")


def container_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``containers, tokens, fill``: how many containers there are and which share of their room is used."""
    used = packed.groupBy("container").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("used"))
    return used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"))
