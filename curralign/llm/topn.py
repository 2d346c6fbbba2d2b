"""Top N rows of every group by a secondary sort.

Rows are sorted within partitions by group and order, and Arrow batches stream through a function that only knows the
current group and how many of its rows it has emitted; no group is ever held. The same pass runs twice: before the
shuffle it leaves at most N rows of a group per partition, so a group with a third of all rows is spread over all tasks
first and costs at most N rows per task afterwards; after the shuffle on the group it gives the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _emit(batches: Iterator[pa.RecordBatch], keys: Sequence[str], n: int, rank: str | None) -> Iterator[pa.RecordBatch]:
    last: tuple | None = None
    seen = 0
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        new = np.zeros(size, dtype=bool)
        for k in keys:
            col = batch.column(k)
            if size > 1:
                a, b = col.slice(1), col.slice(0, size - 1)
                same = pc.fill_null(pc.equal(a, b), False)
                both = pc.and_(pc.is_null(a), pc.is_null(b))
                new[1:] |= ~np.asarray(pc.or_(same, both).to_numpy(zero_copy_only=False), dtype=bool)
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        new[0] = first != last
        index = np.arange(size)
        start = np.maximum.accumulate(np.where(new, index, -1))
        pos = np.where(start < 0, index + seen, index - start)  # rows before the first change go on with the last group
        last = tuple(batch.column(k)[size - 1].as_py() for k in keys)
        seen = int(pos[-1]) + 1
        keep = pos < n
        if not keep.any():
            continue
        out = batch.filter(pa.array(keep))
        if rank is not None:
            out = out.append_column(rank, pa.array((pos[keep] + 1).astype(np.int32)))
        yield out


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank_no") -> DataFrame:
    """The first ``n`` rows of every group of ``keys`` in ``order``, numbered from 1 in the int column ``rank``.

    ``order`` must be total within a group for a result that ties cannot change; rows equal in all of ``order`` come out
    in an undefined order among themselves. Rows whose key is null form a group of their own; drop them first if they
    are none. A column of ``df`` that has the name ``rank`` is replaced. An empty frame gives an empty result.
    Floating-point keys are compared by equality, so a NaN key is a group for each row.
    """
    if n < 1:
        raise ValueError("n must be positive")
    keys = list(keys)
    df = df.drop(rank) if rank in df.columns and rank not in keys else df
    sort = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    few = df.sortWithinPartitions(*sort).mapInArrow(lambda it: _emit(it, keys, n, None), df.schema)
    schema = df.select("*", F.lit(1).cast("int").alias(rank)).schema
    return few.repartition(*keys).sortWithinPartitions(*sort).mapInArrow(lambda it: _emit(it, keys, n, rank), schema)


def latest_delivery(df: DataFrame, key: str = "id", at: str = "updated_at", columns: Sequence[str] = ()) -> DataFrame:
    """Of the rows of each ``key`` the one with the latest ``at`` (null is earliest); equal times by the other columns.

    One aggregate with partial sums before the shuffle, so a restated row moves once per task.
    """
    rest = [c for c in (columns or df.columns) if c not in (key, at)]
    best = F.max(F.struct(F.col(at), *(F.col(c) for c in rest))).alias("best")
    return df.groupBy(key).agg(best).select(key, *(F.col(f"best.`{c}`").alias(c) for c in [at, *rest]))


def best_mappings(crosswalks: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best mappings of every source: ``source_id, rank_no, id``.

    Mappings with a null source or a score that is null, NaN or outside 0..1 are left out. Order: higher score, smaller
    absolute grade_delta with null last, smaller id.
    """
    latest = latest_delivery(crosswalks, "id", "updated_at", ["source_id", "confidence_score", "grade_delta"])
    usable = latest.where("source_id is not null and confidence_score >= 0 and confidence_score <= 1 and not isnan(confidence_score)")
    slim = usable.select("source_id", "id", "confidence_score", F.abs("grade_delta").alias("gap"))
    order = [F.col("confidence_score").desc(), F.col("gap").asc_nulls_last(), F.col("id").asc()]
    return top_n_per_group(slim, ["source_id"], order, n).select("source_id", "rank_no", "id")
