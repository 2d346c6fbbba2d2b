"""Cosine similarity: one query vector, and blocked joins of two sets of vectors.

The few-against-many form is a projection and TakeOrderedAndProject. The many-against-many form groups both sides into
blocks that agree on an equality key, and multiplies one block pair in each task; nothing but pairs above the threshold, or
the best few of each row, leaves a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 4_096
#: Columns that a task multiplies at once when it looks for the best few.
WIDTH = 4_096
#: Pairs that are multiplied again at once.
PAIRS = 32_768
EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """The vector over its length plus a small constant, so that a zero vector stays zero."""
    n = norm(v) + EPSILON
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine of a column and one given vector."""
    q = np.asarray(query, dtype=np.float64)
    q = q / (np.linalg.norm(q) + EPSILON)
    return dot(v, F.array(*(F.lit(float(x)) for x in q))) / (norm(v) + EPSILON)


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, floor: float | None = None) -> DataFrame:
    """``id, score``: the ``k`` most similar ids; ties by id descending. Filters on ``vectors`` come before the sort."""
    scored = vectors.select("id", F.round(cosine_to(F.col("vec"), query), 4).alias("score"))
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    return scored.orderBy(F.col("score").desc(), F.col("id").desc()).limit(k)


def current_vectors(embeddings: DataFrame, model: str, dim: int) -> DataFrame:
    """``id, vec``: of each standard the latest vector of a model, if all its ``dim`` elements are finite and not all zero."""
    latest = (
        embeddings.where((F.col("model") == model) & F.col("standard_id").isNotNull())
        .groupBy("standard_id")
        .agg(F.max(F.struct("created_at", "model_version", "vector")).alias("m"))
        .select(F.col("standard_id").alias("id"), F.col("m.vector").alias("vec"))
    )
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return latest.where((F.size("vec") == dim) & ~bad & F.exists("vec", lambda x: x != 0))


def _allowed(rule: str, ranks: np.ndarray, ids: np.ndarray, part: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the rule of :func:`similarity_join` allows each pair of two lists of rows."""
    kind, limit = rule.split(":")
    if kind == "after":
        return ids[part][:, None] < ids[right][None, :]
    gap = ranks[right][None, :] - ranks[part][:, None]
    return np.abs(gap) <= float(limit) if kind == "within" else (gap < 0) & (gap >= -float(limit))


def _nearest(x: np.ndarray, short: np.ndarray, ranks: np.ndarray, ids: np.ndarray, part: np.ndarray, right: np.ndarray, threshold: float, rule: str | None, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``part``, place in ``right``, cosine to 4 places) of at least the ``top`` best allowed pairs of each row, equal cosines included.

    Products in single precision drop what surely isn't among them: the ``top`` best maxima of disjoint groups of columns bound the
    last cosine wanted from below. What is left is multiplied again in double precision.
    """
    slack = np.float32(1.01e-4 + (x.shape[1] + 8) * 2.0**-22)
    groups = WIDTH // 16
    while groups < min(4 * top, WIDTH):
        groups *= 2
    a, cos = short[part], np.empty((len(part), WIDTH), dtype=np.float32)
    floor = np.full(len(part), threshold, dtype=np.float32)
    rs, cs = [], []
    for j in range(0, len(right), WIDTH):
        some = right[j : j + WIDTH]
        np.matmul(a, short[some].T, out=cos[:, : len(some)])
        cos[:, len(some) :] = -np.inf
        if rule is not None:
            np.copyto(cos[:, : len(some)], -np.inf, where=~_allowed(rule, ranks, ids, part, some))
        if top <= groups:
            most = cos.reshape(len(part), WIDTH // groups, groups).max(axis=1)
            np.maximum(floor, np.partition(most, groups - top, axis=1)[:, groups - top], out=floor)
        r, c = np.divmod(np.flatnonzero(cos >= (floor - slack)[:, None]), WIDTH)
        rs.append(r)
        cs.append(c + j)
    r, c = np.concatenate(rs), np.concatenate(cs)
    value = np.empty(len(r))
    for i in range(0, len(r), PAIRS):
        at = slice(i, i + PAIRS)
        value[at] = np.round(np.einsum("ij,ij->i", x[part[r[at]]], x[right[c[at]]]), 4)
    keep = value >= threshold
    return r[keep], c[keep], value[keep]


def _block_pairs(table: pa.Table, threshold: float, meta: list[str], rule: str | None, top: int | None, ties: int) -> pa.Table:
    side = np.asarray(table.column("side"))
    vec = table.column("vec").combine_chunks()
    flat = np.asarray(vec.flatten(), dtype=np.float64)
    x = flat.reshape(table.num_rows, -1) if table.num_rows else flat.reshape(0, 1)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(length == 0, 1, length)  # no constant is added: near the middle of two roundings it would decide
    finite = np.isfinite(x).all(axis=1)
    left, right = np.flatnonzero(~side & finite), np.flatnonzero(side & finite)
    ids = np.asarray(table.column("id").to_pylist(), dtype=object)
    place = np.unique(ids.astype(str), return_inverse=True)[1] if len(ids) else np.zeros(0, int)
    cols = {m: np.asarray(table.column(m).to_pylist(), dtype=object) for m in meta}
    ranks = np.asarray(table.column("rank").to_numpy(zero_copy_only=False), dtype=np.float64)
    short = x.astype(np.float32) if top is not None else None
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(left), 512):
        part = left[i : i + 512]
        if not len(right):
            break
        if top is not None:
            r, c, value = _nearest(x, short, ranks, ids, part, right, threshold, rule, top)
            order = np.lexsort((ties * place[right[c]], -value, r))
            r, c, value = r[order], c[order], value[order]
            first = np.searchsorted(r, r, side="left")
            stay = np.arange(len(r)) - first < top
            r, c, value = r[stay], c[stay], value[stay]
        else:
            cos = np.round(x[part] @ x[right].T, 4)
            keep = cos >= threshold
            if rule is not None:
                keep &= _allowed(rule, ranks, ids, part, right)
            r, c = np.nonzero(keep)
            value = cos[r, c]
        if len(r):
            out.append((part[r], right[c], value))
    a, b, v = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    fields = {"a": pa.array(ids[a], pa.string()), "b": pa.array(ids[b], pa.string()), "cosine": pa.array(v, pa.float64())}
    for m in meta:
        fields[f"a_{m}"] = pa.array(cols[m][a], pa.string())
        fields[f"b_{m}"] = pa.array(cols[m][b], pa.string())
    return pa.table(fields)


def similarity_join(
    left: DataFrame, right: DataFrame, key: str, threshold: float, meta: tuple[str, ...] = (), rule: str | None = None, top: int | None = None, block: int = BLOCK, ties: int = 1, numbers: int = 0
) -> DataFrame:
    """``a, b, cosine`` and the ``meta`` columns of both, for pairs that agree on ``key`` with cosine (to 4 places) at least ``threshold``.

    Both sides have ``id`` (string), ``vec``, ``rank`` (int), ``key`` and the string columns ``meta``. ``rule`` limits the pairs by rank:
    ``within:n`` (at most n apart), ``below:n`` (the right is 1 to n lower), ``after:0`` (the right id is larger). ``top`` keeps the best
    few of each left row of a block pair (equal cosines by smaller id, or by larger id with ``ties`` -1), which the caller ranks again. A hot key is cut
    into as many block pairs as its size needs, from counts that are one row a key. A block has about ``block`` rows, or more where ``numbers`` elements
    of short vectors allow it: fewer blocks are fewer copies of both sides in the shuffle.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        n = F.count("*") / block
        n = F.least(n, F.sum(F.size("vec")) / numbers) if numbers else n
        return df.groupBy(key).agg(F.greatest(F.ceil(n), F.lit(1)).cast("int").alias(name))

    blocks = counted(left, "nl").join(counted(right, "nr"), key)
    h = F.xxhash64("id")
    cols = ["id", "vec", "rank", key, *meta]
    a = left.select(*cols).join(blocks, key).withColumn("lb", F.pmod(h, F.col("nl")).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    b = right.select(*cols).join(blocks, key).withColumn("rb", F.pmod(h, F.col("nr")).cast("int")).withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)))
    picked = [*cols, "lb", "rb"]
    both = a.select(*picked, F.lit(False).alias("side")).unionByName(b.select(*picked, F.lit(True).alias("side")))
    names = list(meta)
    schema = "a string, b string, cosine double" + "".join(f", a_{m} string, b_{m} string" for m in names)
    return both.groupBy(key, "lb", "rb").applyInArrow(lambda t: _block_pairs(t, threshold, names, rule, top, ties), schema)
