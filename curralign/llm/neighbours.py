"""Most similar vectors for every vector: block matrix join with int8 tiles.

Vectors are placed in cells around centroids; each vector is a query in its own cell and in every cell whose centroid is almost
as near (``MARGIN``). Cells grow in number with the vectors, about ``MEMBERS`` to a cell; beyond ``FLAT`` of them there are two levels. A
cell is one tile, a hot one as many as its size needs.

A vector travels as fixed-point numbers of 24 bits: an int8 plane and 16 bits of remainder. A tile multiplies the int8 planes of
its queries and members (as floats, in which such sums are exact), which gives every cosine within a bound that follows from
the measured quantisation errors; only members whose upper bound reaches a query's k-th largest lower bound are
recomputed with the remainders. The tiles' best lists are merged per query with a heap.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.vectors import dot, norm

#: Vectors from which centroids are fitted, at most: of all, and of each cell of the first level; chosen by the hash of their ids.
SAMPLE = 20_000
#: Vectors of a cell, about; cells of one level, at most.
MEMBERS, FLAT = 1_024, 256
#: Members, and queries, of one tile.
TILE, ASKING = 4_096, 16_384
#: A cell is asked if its centroid's cosine is at most so much below that of the nearest.
MARGIN = 0.1
#: Largest products of int8 planes that float32 adds exactly.
EXACT = 1_040


def usable_vectors(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """``id, vec``: of each standard the vector of ``model`` with the latest time, if it is usable.

    Usable: ``dim`` finite elements, none null, not all zero. Null ids are left out; equal times are decided by version
    and vector. If the latest vector is not usable, the standard has none.
    """
    latest = (
        vectors.where((F.col("model") == model) & F.col("standard_id").isNotNull())
        .groupBy("standard_id")
        .agg(F.max(F.struct("created_at", "model_version", "vector")).alias("m"))
        .select(F.col("standard_id").alias("id"), F.col("m.vector").alias("vec"))
    )
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return latest.where((F.size("vec") == dim) & ~bad & F.exists("vec", lambda x: x != 0))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    flat = col.flatten() if isinstance(col, pa.ListArray | pa.LargeListArray) else col.values
    return np.asarray(flat, dtype=np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # first, as squares of very large or small elements leave the range
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray) -> list[bytes]:
    """Unit vectors as bytes: the int8 plane, the remainders and the step."""
    step = np.abs(x).max(axis=1, keepdims=True) / (127 << 16)
    fixed = np.rint(x / step).astype(np.int32)
    high = (fixed + (1 << 15)) >> 16
    low = (fixed - (high << 16)).astype("<i2")
    both = np.concatenate([high.astype(np.int8).view(np.uint8), low.view(np.uint8), step.astype("<f8").view(np.uint8)], axis=1)
    return [row.tobytes() for row in both]


def decode(codes: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 planes, steps of them, vectors) of :func:`encode`."""
    raw = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), 3 * dim + 8)
    high = raw[:, :dim].view(np.int8)
    low = np.ascontiguousarray(raw[:, dim : 3 * dim]).view("<i2")
    step = np.ascontiguousarray(raw[:, 3 * dim :]).view("<f8")
    return high, step * (1 << 16), (high.astype(np.float64) * (1 << 16) + low) * step


def _encode(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(encode(_unit(_matrix(batch.column("vec"), dim))), pa.binary())], names=["id", "code"])


def k_means(x: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced rows, the same for the same rows."""
    x = x.astype(np.float32)
    cells = max(1, min(cells, len(x)))
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 2048] @ c.T, axis=1) for i in range(0, len(x), 2048)])
        order = np.argsort(near, kind="stable")
        counts = np.bincount(near, minlength=cells)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        full = counts > 0
        sums = np.add.reduceat(x[order], starts[full], axis=0)
        c = c.copy()
        c[full] = sums
        norms = np.linalg.norm(c, axis=1, keepdims=True)
        c = np.where(norms > 0, c / np.maximum(norms, 1e-12), c).astype(np.float32)
    return c


def _sample(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.xxhash64("id"), "id").limit(n)


def _near(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's own) for every cell that each row asks."""
    sim = x.astype(np.float32) @ centroids.T
    own = np.argmax(sim, axis=1)
    ask = sim >= np.take_along_axis(sim, own[:, None], axis=1) - np.float32(MARGIN)
    row, cell = np.nonzero(ask)
    return row, cell, cell == own[row]


def _copies(ids: list[str], codes: list[bytes], hashes: np.ndarray, row: np.ndarray, cell: np.ndarray, own: np.ndarray, split: dict[int, tuple[int, int]]) -> pa.RecordBatch:
    """A row for each tile in which a vector is a member (role 1), a query (2) or both (3)."""
    out: list[tuple[np.ndarray, ...]] = []
    large = np.isin(cell, np.fromiter(split, dtype=np.int64, count=len(split))) if split else np.zeros(len(cell), dtype=bool)
    plain = ~large
    zero = np.zeros(int(plain.sum()), dtype=np.int64)
    out.append((row[plain], cell[plain].astype(np.int64), zero, zero, np.where(own[plain], 3, 2)))
    for c in np.unique(cell[large]).tolist():
        m, q = split[c]
        at = np.flatnonzero(cell == c)
        r, mine = row[at], own[at]
        mb, qb = hashes[r] % m, (hashes[r] >> 20) % q
        wide, ask = np.repeat(r, m), np.tile(np.arange(m), len(r))
        both = np.repeat(mine, m) & (ask == np.repeat(mb, m))
        out.append((wide, np.full(len(wide), c), ask, np.repeat(qb, m), np.where(both, 3, 2)))
        r, mb, qb = r[mine], mb[mine], qb[mine]
        tall, by = np.repeat(r, q), np.tile(np.arange(q), len(r))
        other = by != np.repeat(qb, q)
        out.append((tall[other], np.full(int(other.sum()), c), np.repeat(mb, q)[other], by[other], np.ones(int(other.sum()), dtype=np.int64)))
    row, cell, mb, qb, role = (np.concatenate(x) for x in zip(*out, strict=True))
    at = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(mb.astype(np.int32)), pa.array(qb.astype(np.int32)), pa.array(role.astype(np.int8)), pa.array(ids, pa.string()).take(at), pa.array(codes, pa.binary()).take(at)], names=["cell", "mb", "qb", "role", "id", "code"])


_COPY = "cell bigint, mb int, qb int, role tinyint, id string, code binary"


def _placed(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dim: int) -> Iterator[tuple[list[str], list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, codes, hashes of the ids, row, cell, own) of every batch with ``id, code, h`` and, where there are two levels, the
    centroids of ``cell`` in rows without id before its vectors; ``own`` there tells whether the vector is a member of it."""
    held: dict[int, list[bytes]] = {}
    inner: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, codes, h = batch.column("id").to_pylist(), batch.column("code").to_pylist(), np.asarray(batch.column("h").to_numpy(zero_copy_only=False)).astype(np.int64) & 0x7FFFFFFFFFFF
        if "cell" not in batch.schema.names:
            row, cell, own = _near(decode(codes, dim)[2], centroids)
            yield ids, codes, h, row, cell, own
            continue
        outer, mine = np.asarray(batch.column("cell")), np.asarray(batch.column("own").to_numpy(zero_copy_only=False), dtype=bool)
        parts = []
        for c in outer[np.sort(np.unique(outer, return_index=True)[1])].tolist():
            at = np.flatnonzero(outer == c)
            heads = [i for i in at.tolist() if ids[i] is None]
            if heads:
                held.setdefault(c, []).extend(codes[i] for i in heads)
            at = at[len(heads) :]
            if not len(at):
                continue
            if c not in inner:
                inner = {c: decode(held.pop(c), dim)[2].astype(np.float32)}
            row, cell, own = _near(decode([codes[i] for i in at], dim)[2], inner[c])
            parts.append((at[row], (np.int64(c) << 32) + cell, own & mine[at[row]]))
        if parts:
            row, cell, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield ids, codes, h, row, cell, own


def _counted(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    for _, _, _, _, cell, own in _placed(batches, centroids, dim):
        cells, at = np.unique(cell, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(np.bincount(at, weights=own).astype(np.int64)), pa.array(np.bincount(at))], names=["cell", "members", "queries"])


def _copied(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dim: int, split: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for x in _placed(batches, centroids, dim):
        yield _copies(*x, split)


def _outer(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    """The first of two levels: ``id, code, h, cell, own``."""
    for ids, codes, h, row, cell, own in _placed(batches, centroids, dim):
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()).take(at), pa.array(codes, pa.binary()).take(at), pa.array(h[row]), pa.array(cell.astype(np.int64)), pa.array(own)], names=["id", "code", "h", "cell", "own"])


def _inner(table: pa.Table, dim: int, members: int) -> pa.Table:
    """Centroids of the second level, from the sampled members of one cell of the first and their number ``n``."""
    x = decode(table.column("code").to_pylist(), dim)[2]
    c = k_means(x, -(-table.column("n")[0].as_py() // members))
    good = np.linalg.norm(c, axis=1) > 0
    return pa.table({"cell": pa.array([table.column("cell")[0].as_py()] * int(good.sum()), pa.int64()), "code": pa.array(encode(c[good].astype(np.float64)), pa.binary())})


def _tile(table: pa.Table, k: int, dim: int) -> pa.Table:
    role = np.asarray(table.column("role"))
    ids = np.asarray(table.column("id").to_pylist(), dtype=object)
    high, step, x = decode(table.column("code").to_pylist(), dim)
    kind = np.float32 if dim <= EXACT else np.float64
    err = np.linalg.norm(x - high * step, axis=1)
    q, m = np.flatnonzero(role >= 2), np.flatnonzero(role != 2)
    place = np.unique(ids.astype(str), return_inverse=True)[1]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(q) and len(m):
        planes, step_m = high[m].astype(kind).T.copy(), step[m, 0].astype(kind)
        column = np.full(len(ids), -1)
        column[m] = np.arange(len(m))
        kk = min(k, len(m))
        for i in range(0, len(q), 512):
            part = q[i : i + 512]
            near = high[part].astype(kind) @ planes
            near *= step[part].astype(kind)
            near *= step_m
            bound = (err[part, None] + (1 + err[part, None]) * err[None, m] + 1e-6).astype(kind)
            itself = np.flatnonzero(column[part] >= 0)
            near[itself, column[part[itself]]] = -4
            least = np.partition(near - bound, len(m) - kk, axis=1)[:, len(m) - kk]
            r, c = np.nonzero(near + bound >= np.maximum(least, -3)[:, None])
            cos = np.einsum("ij,ij->i", x[part[r]], x[m[c]])
            order = np.lexsort((place[m[c]], -cos, r))
            r, c, cos = r[order], c[order], cos[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
            out.append((part[r[keep]], m[c[keep]], cos[keep]))
    a, b, cos = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
    ends = pa.array(np.concatenate([new, [len(a)]]).astype(np.int32))
    return pa.table({"id": pa.array(ids[a[new]], pa.string()), "nbs": pa.ListArray.from_arrays(ends, pa.array(ids[b], pa.string())), "cosines": pa.ListArray.from_arrays(ends, pa.array(cos.astype(np.float32)))})


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by id, each with one tile's list, to the ``k`` first of all lists of an id."""
    last: str | None = None
    lists: list[list[tuple[float, str]]] = []
    rows: list[tuple[str, str, float, int]] = []

    def close() -> None:
        rows.extend((last, nb, -c, i + 1) for i, (c, nb) in enumerate(islice(heapq.merge(*lists), k)))

    def batch_of() -> pa.RecordBatch:
        ids, nbs, cos, rank = zip(*rows, strict=True) if rows else ([], [], [], [])
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nbs, pa.string()), pa.array(cos, pa.float64()), pa.array(rank, pa.int32())], names=["id", "nb", "cosine", "rank_no"])

    for batch in batches:
        for i, nbs, cos in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if i != last:
                if lists:
                    close()
                last, lists = i, []
            lists.append([(-c, nb) for c, nb in zip(cos, nbs, strict=True)])
        if len(rows) > 50_000:
            yield batch_of()
    if lists:
        close()
    yield batch_of()


def nearest(vectors: DataFrame, k: int, dim: int, cells: int | None = None) -> DataFrame:
    """``id, nb, cosine, rank_no``: the ``k`` most similar other ids of every id; equal cosines by smaller id.

    ``vectors`` has ``id`` (string, unique, not null) and ``vec`` (``dim`` finite elements, not all zero); other columns
    are ignored, and copies of an id would be neighbours' duplicates, so pass it through :func:`usable_vectors`. With
    fewer than ``k`` other vectors all of those in the asked cells come out; one vector or none gives no row. All vectors are indexed;
    neighbours outside the asked cells are the accuracy loss (measured in the README against brute force). Cosines are
    those of the 24-bit vectors as floats, within about 3e-7.
    """
    coded = vectors.mapInArrow(lambda it: _encode(it, dim), "id string, code binary").persist()  # read by four passes; one aggregate makes it again
    n = coded.count()
    if n < 2:
        return vectors.sparkSession.createDataFrame([], "id string, nb string, cosine double, rank_no int")
    cells = cells or max(1, n // MEMBERS)
    first = cells if cells <= FLAT else min(math.isqrt(cells) + 1, SAMPLE // 8)
    sample = [bytes(r["code"]) for r in _sample(coded, SAMPLE).select("code").collect()]
    centroids = k_means(decode(sample, dim)[2], first)
    rows = coded.select("id", "code", F.xxhash64("id").alias("h"))
    if first < cells:
        rows = _second_level(rows, centroids, dim, -(-n // cells))
    counts = rows.mapInArrow(lambda it: _counted(it, centroids, dim), "cell bigint, members bigint, queries bigint").groupBy("cell").agg(F.sum("members").alias("m"), F.sum("queries").alias("q"))
    hot = counts.where((F.col("m") > TILE) | (F.col("q") > ASKING)).collect()  # at most one row for so many vectors
    split = {r["cell"]: (max(1, -(-r["m"] // TILE)), max(1, -(-r["q"] // ASKING))) for r in hot}
    tiles = rows.mapInArrow(lambda it: _copied(it, centroids, dim, split), _COPY)
    best = tiles.groupBy("cell", "mb", "qb").applyInArrow(lambda t: _tile(t, k, dim), "id string, nbs array<string>, cosines array<float>")
    return best.repartition("id").sortWithinPartitions("id").mapInArrow(lambda it: _merged(it, k), "id string, nb string, cosine double, rank_no int")


def _second_level(rows: DataFrame, centroids: np.ndarray, dim: int, members: int) -> DataFrame:
    """Copies of the vectors by cell of the first level, sorted after the cell's centroids of the second; a cell of more than
    a million copies is spread over several tasks, each with the centroids."""
    schema = "id string, code binary, h bigint, cell bigint, own boolean"
    outer = cut(rows.mapInArrow(lambda it: _outer(it, centroids, dim), schema))
    sizes = outer.groupBy("cell").agg(F.count("*").alias("copies"), F.sum(F.col("own").cast("int")).alias("n"))
    spread = {r["cell"]: -(-r["copies"] // 1_000_000) for r in sizes.collect()}  # one row a cell of the first level
    flat = F.array(*(F.lit(spread.get(c, 1)) for c in range(len(centroids))))
    owners = outer.where("own").join(sizes.select("cell", "n"), "cell")
    few = owners.where(F.pmod("h", F.col("n")) < SAMPLE).select("cell", "code", "n")
    inner = cut(few.groupBy("cell").applyInArrow(lambda t: _inner(t, dim, members), "cell bigint, code binary"))
    heads = inner.select(F.lit(None).cast("string").alias("id"), "code", F.lit(0).cast("bigint").alias("h"), "cell", F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0), F.get(flat, F.col("cell").cast("int")) - 1)).alias("turn"))
    # a cell that is asked but has no members has no second level and no answer
    asked = outer.join(inner.select("cell").distinct(), "cell", "left_semi").withColumn("turn", F.pmod("h", F.get(flat, F.col("cell").cast("int"))).cast("int"))
    both = heads.unionByName(asked).repartition("cell", "turn").sortWithinPartitions("cell", "turn", F.col("id").isNotNull())
    return both.select("id", "code", "h", "cell", "own")


def exact_cosines(near: DataFrame, vectors: DataFrame) -> DataFrame:
    """``near`` with the cosine of the vectors as they are, in double, in place of that of the coded ones."""
    one, other = (vectors.select(F.col("id").alias(c), F.col("vec").alias(f"v_{c}")) for c in ("id", "nb"))
    return near.join(one, "id").join(other, "nb").select("id", "nb", (dot(F.col("v_id"), F.col("v_nb")) / (norm(F.col("v_id")) * norm(F.col("v_nb")))).alias("cosine"), "rank_no")


def nearest_pairs(vectors: DataFrame, k: int = 5, dim: int = 64) -> DataFrame:
    """``id_a, id_b`` with ``id_a < id_b``: at least one is among the ``k`` most similar of the other."""
    near = nearest(vectors, k, dim)
    return near.select(F.least("id", "nb").alias("id_a"), F.greatest("id", "nb").alias("id_b")).distinct()
