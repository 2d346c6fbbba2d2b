"""Near-duplicate records: DartMinHash signatures in a banded join.

Each (element, weight) owns the strip [0, weight) of the plane. Darts with positions that depend on the element alone are
thrown at it, with uniform density; a dart that lands in the strip belongs to the set. The darts of a set are the
union of its elements' darts. Every dart is hashed to one of ``k`` coordinates, and each coordinate keeps the rank of its earliest
dart: a weighted min-hash of the set, whose agreement probability is the weighted Jaccard similarity. Only darts up to
a rank at which all coordinates are almost surely filled are thrown; a set with an empty coordinate doubles the rank. Elements
of weight 1 keep their earliest darts in a table, so a set's signature is the minimum over its rows.

What is shuffled is one entry of 15 bytes for each text and band, packed by target: five bytes of the band's key and ten of the text's class
(48 bits of a parity sketch of its words, its size, 24 bits of a hash). The popcount of two sketches' difference never exceeds the
number of words that only one of the texts has, so it drops pairs without losing any; what is left is verified on the whole word sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.orphans import bloom_filter

#: A pair at the threshold shares a band with a probability of about ``SHARED`` each, and none at all with ``MISS``.
SHARED, MISS = 0.262, 3.3e-5
#: Bits of the parity sketch, and the largest size that is told apart.
SKETCH, SIZES = 48, 255
#: Entries of one target of the shuffle, about; entries that a task holds before it sends them; texts of a band's key that are paired in one go.
ENTRIES, HELD, HOT = 128_000, 1_000_000, 1_024
#: Elements whose darts a worker keeps.
KEPT = 16_384

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ENTRY = np.dtype([("key", "<u4"), ("key_high", "u1"), ("low", "<u8"), ("high", "<u2")])
_INFO = np.dtype([("low", "<u8"), ("high", "<u2"), ("hash", "<u8")])
_MEMBER = np.dtype([("low", "<u8"), ("high", "<u2")])


def bands_for(threshold: float) -> tuple[int, int]:
    """Rows of a band and number of bands: a band agrees with probability ``SHARED`` at the threshold, and enough bands leave ``MISS``."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    rows = max(1, min(32, round(math.log(SHARED) / math.log(threshold)))) if threshold < 1 else 32
    return rows, max(1, math.ceil(math.log(MISS) / math.log1p(-(min(threshold, 0.999999) ** rows))))


#: For a threshold of 0.8.
ROWS, BANDS = bands_for(0.8)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=64)
def _poisson_table(mean: float) -> np.ndarray:
    """Cumulated probabilities of the counts 0, 1, 2 ... of a Poisson variable."""
    size = int(mean + 12 * math.sqrt(mean) + 24)
    logs = np.arange(size) * math.log(mean) - mean - np.cumsum(np.log(np.maximum(np.arange(size), 1)))
    return np.cumsum(np.exp(logs))


def _fraction(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / 2**53


class DartMinHash:
    """Signatures of ``k`` coordinates for sets of (64-bit element, positive weight): the rank of each coordinate's earliest dart."""

    def __init__(self, k: int, seed: int = 1) -> None:
        self.k, self.seed = k, seed
        self.total = k * math.log(k) + 2 * k
        self._known = np.zeros(0, dtype=np.uint64)
        self._rank = np.zeros((0, k), dtype=np.float32)
        self._layers = 0

    def _throw(self, elements: np.ndarray, row: int, layer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Darts of each element with weights in [row, row + 1) and ranks of one dyadic layer: [0,1), [1,2), [2,4), [4,8) ...

        Returned as (index of the element, weight position, rank, coordinate). Their number is Poisson with the area of the cell as its mean.
        """
        low, width = (0.0, 1.0) if layer == 0 else (float(2 ** (layer - 1)), float(2 ** (layer - 1)))
        place = (row * 0x9E3779B97F4A7C15 ^ layer * 0xC2B2AE3D27D4EB4F ^ self.seed * 0x165667B19E3779F9) & (2**64 - 1)
        head = _mix(elements ^ np.uint64(place))
        counts = np.searchsorted(_poisson_table(width), _fraction(head), side="right")
        which = np.repeat(np.arange(len(elements)), counts)
        nth = (np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
        with np.errstate(over="ignore"):
            start = head[which] + nth * np.uint64(3) * _GOLD
            coord = (_mix(start + np.uint64(2) * _GOLD) % np.uint64(self.k)).astype(np.int64)
            rank = low + width * _fraction(_mix(start + _GOLD))
            pos = row + _fraction(_mix(start + np.uint64(3) * _GOLD))
        return which, pos, rank.astype(np.float32), coord

    def _learn(self, elements: np.ndarray) -> None:
        """Ranks of the earliest darts of elements of weight 1, as rows of a table that is kept for later sets."""
        new = np.setdiff1d(elements, self._known)
        if not len(new):
            return
        if len(self._known) + len(new) > KEPT:
            self._known, self._rank = self._known[:0], self._rank[:0]
            new = np.unique(elements)
        rank = np.full((len(new), self.k), np.inf, dtype=np.float32)
        for layer in range(self._layers):
            which, _, r, coord = self._throw(new, 0, layer)
            np.minimum.at(rank, (which, coord), r)
        order = np.argsort(known := np.concatenate([self._known, new]), kind="stable")
        self._known, self._rank = known[order], np.concatenate([self._rank, rank])[order]

    def signatures(self, sets: list[np.ndarray]) -> list[np.ndarray | None]:
        """Signatures of sets whose elements all have weight 1; None for an empty set."""
        full = [s for s in sets if len(s)]
        signed = iter(self.signed(np.concatenate(full) if full else np.zeros(0, dtype=np.uint64), np.cumsum([0, *map(len, full)])))
        return [next(signed) if len(s) else None for s in sets]

    def signed(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Signatures, one a row, of the sets ``flat[ends[i]:ends[i + 1]]``, none empty, whose elements all have weight 1."""
        sizes = np.diff(ends)
        out = np.empty((len(sizes), self.k), dtype=np.float32)
        if not len(sizes):
            return out
        layers = 1 + max(1, math.ceil(math.log2(self.total / max(1, sizes.min()))))
        if layers > self._layers:
            self._layers, self._known, self._rank = layers, self._known[:0], self._rank[:0]
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + min(KEPT, 8_192), side="right")) - 1)
            part = flat[ends[at] : ends[to]]
            self._learn(part)
            rows = self._rank[np.searchsorted(self._known, part)]
            out[at:to] = np.minimum.reduceat(rows, ends[at:to] - ends[at], axis=0)
            at = to
        for i in np.flatnonzero(np.isinf(out).any(axis=1)):
            out[i] = self.signature(flat[ends[i] : ends[i + 1]])
        return out

    def signature(self, elements: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray | None:
        """The signature of one weighted set; None for a set without weight."""
        weights = np.ones(len(elements)) if weights is None else np.asarray(weights, dtype=np.float64)
        elements, weights = elements[weights > 0], weights[weights > 0]
        mass = float(weights.sum())
        if not mass:
            return None
        layers = 1 + max(1, math.ceil(math.log2(max(2.0, self.total / mass))))
        best, layer = np.full(self.k, np.inf, dtype=np.float32), 0
        while layer < layers or np.isinf(best).any():
            for row in range(math.ceil(weights.max())):
                tall = weights > row
                which, pos, rank, coord = self._throw(elements[tall], row, layer)
                inside = pos < weights[tall][which]
                np.minimum.at(best, coord[inside], rank[inside])
            layer += 1
        return best


@functools.lru_cache(maxsize=4)
def _sketch(k: int) -> DartMinHash:
    """One for all tasks of a worker."""
    return DartMinHash(k)


def _classes(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each set its parity sketch with its size and eight bits of a hash, 16 more bits of it, and a second hash."""
    out = np.zeros(len(ends) - 1, dtype=_INFO)
    if not len(out):
        return out
    sums = [np.add.reduceat(_mix(flat ^ np.uint64(salt)), ends[:-1]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    bit = np.uint64(1) << (_mix(flat ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(SKETCH))
    size = np.minimum(np.diff(ends), SIZES).astype(np.uint64)
    one = _mix(sums[0])
    out["low"] = np.bitwise_xor.reduceat(bit, ends[:-1]) | size << np.uint64(48) | (one >> np.uint64(56)) << np.uint64(56)
    out["high"] = (one & np.uint64(0xFFFF)).astype(np.uint16)
    out["hash"] = _mix(sums[1])
    return out


def _sign(batches: Iterator[pa.RecordBatch], rows: int, bands: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, words) to packed entries for each target, and to the packed classes of the ids (``part`` below 0)."""
    sketch = _sketch(rows * bands)
    salt = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    held: list[tuple[np.ndarray, np.ndarray]] = []
    seen: set[tuple[int, int]] = set()
    # classes go to targets by task and turn: by turn alone the first few targets would get those of the whole table
    task = TaskContext.get()
    place, turn = np.uint64(task.partitionId() if task else 0) << np.uint64(32), 0

    def packed(part: list[int], blob: list[bytes], ids: list[list[str] | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blob, pa.binary()), pa.array(ids, pa.list_(pa.string()))], names=["part", "blob", "ids"])

    def send() -> pa.RecordBatch:
        to, entry = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(to, kind="stable")
        to, entry = to[order], entry[order]
        cuts = np.flatnonzero(np.diff(to)) + 1
        return packed(to[np.concatenate([[0], cuts])].tolist(), [x.tobytes() for x in np.split(entry, cuts)], [None] * (len(cuts) + 1))

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column("words")
        ends = np.asarray(col.offsets).astype(np.int64)
        flat, ends = np.asarray(col.values)[ends[0] : ends[-1]].view(np.uint64), ends - ends[0]
        info = _classes(flat, ends)
        turn += 1
        yield packed([-1 - int(_mix(place | np.uint64(turn)) % np.uint64(parts))], [info.tobytes()], [batch.column("id").to_pylist()])
        keys = list(zip(info["low"].tolist(), info["hash"].tolist(), strict=True))
        fresh = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]  # copies in a task are signed once
        if len(seen) > KEPT:
            seen.clear()
        if not fresh:
            continue
        pick = np.array(fresh)
        sizes = np.diff(ends)[pick]
        some = np.concatenate([flat[ends[i] : ends[i + 1]] for i in fresh])
        sig = sketch.signed(some, np.concatenate([[0], np.cumsum(sizes)])).view(np.uint32)
        mixed = np.tile(salt, (len(pick), 1))
        for r in range(rows):
            mixed = _mix(mixed ^ sig[:, r * bands : (r + 1) * bands])
        entry = np.empty(mixed.size, dtype=_ENTRY)
        key = mixed.ravel()
        entry["key"], entry["key_high"] = key & np.uint64(0xFFFFFFFF), (key >> np.uint64(32)) & np.uint64(0xFF)
        entry["low"], entry["high"] = np.repeat(info["low"][pick], bands), np.repeat(info["high"][pick], bands)
        held.append((((key >> np.uint64(40)) % np.uint64(parts)).astype(np.int32), entry))
        if sum(len(e) for _, e in held) > HELD:
            yield send()
    if held:
        yield send()


def _possible(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sizes and sketches of two arrays of classes allow the similarity."""
    na, nb = ((x["low"] >> np.uint64(48)) & np.uint64(0xFF) for x in (a, b))
    open_ = (na == SIZES) | (nb == SIZES)
    na, nb = na.astype(np.float64), nb.astype(np.float64)
    sketch = np.uint64((1 << SKETCH) - 1)
    apart = np.bitwise_count((a["low"] ^ b["low"]) & sketch)
    fits = (np.minimum(na, nb) >= threshold * np.maximum(na, nb)) & (apart <= (1 - threshold) / (1 + threshold) * (na + nb) + 1e-9)
    return (fits | open_) & (a != b)


def _pairs(one: np.ndarray, other: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Possible pairs as rows, each once."""
    both = np.empty(len(one), dtype=[("al", "<i8"), ("ah", "<i4"), ("bl", "<i8"), ("bh", "<i4")])
    keep = _possible(one, other, threshold)
    one, other = one[keep], other[keep]
    both = both[: len(one)]
    turned = (one["low"] > other["low"]) | (one["low"] == other["low"]) & (one["high"] > other["high"])
    for x, l, h in ((np.where(turned, other, one), "al", "ah"), (np.where(turned, one, other), "bl", "bh")):
        both[l], both[h] = x["low"].view(np.int64), x["high"]
    both = np.unique(both)
    n = len(both)
    none = [pa.nulls(n, t) for t in (pa.string(), pa.int64(), pa.int64(), pa.binary())]
    return pa.RecordBatch.from_arrays([none[0], *(pa.array(both[c]) for c in ("al", "ah", "bl", "bh")), *none[1:]], names=_NAMES)


_NAMES = ["id", "al", "ah", "bl", "bh", "hot", "chunk", "blob"]
_SCHEMA = "id string, al bigint, ah int, bl bigint, bh int, hot bigint, chunk bigint, blob binary"


def _gather(table: pa.Table, threshold: float) -> pa.Table:
    """One target: classes pass through; entries with equal keys are paired, those of a hot key sent on in chunks."""
    out: list[pa.RecordBatch] = []
    part = table.column("part")[0].as_py()
    blobs = table.column("blob").to_pylist()
    if part < 0:
        for blob, ids in zip(blobs, table.column("ids").to_pylist(), strict=True):
            info = np.frombuffer(blob, dtype=_INFO)
            none = [pa.nulls(len(ids), t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.binary())]
            out.append(pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(info["low"].view(np.int64)), pa.array(info["high"].astype(np.int32)), pa.array(info["hash"].view(np.int64)), *none], names=_NAMES))
        return pa.Table.from_batches(out)
    entry = np.frombuffer(b"".join(blobs), dtype=_ENTRY)
    key = entry["key"].astype(np.uint64) | entry["key_high"].astype(np.uint64) << np.uint64(32)
    order = np.argsort(key, kind="stable")
    key, entry = key[order], entry[order]
    alone = np.ones(len(key), dtype=bool)
    same = key[1:] == key[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    key, entry = key[~alone], entry[~alone]
    order = np.lexsort((entry["high"], entry["low"], key))
    key, entry = key[order], entry[order]
    member = np.empty(len(entry), dtype=_MEMBER)
    member["low"], member["high"] = entry["low"], entry["high"]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])  # copies of a class from several tasks
    key, member = key[new], member[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=int)
    size = np.diff(np.concatenate([start, [len(key)]]))
    for s, n in zip(start[size > HOT], size[size > HOT], strict=True):
        for c in range(0, n, HOT):
            blob = member[s + c : min(s + n, s + c + HOT)].tobytes()
            out.append(pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32())] + [pa.array([part << 40 | int(key[s])], pa.int64()), pa.array([c // HOT], pa.int64()), pa.array([blob], pa.binary())], names=_NAMES))
    small = np.repeat(size <= HOT, size)
    key, member = key[small], member[small]
    step = 1
    while step < len(key):
        at = np.flatnonzero(key[step:] == key[:-step])
        if not len(at):
            break
        out.append(_pairs(member[at], member[at + step], threshold))
        step += 1
    return pa.Table.from_batches(out) if out else pa.Table.from_batches([_pairs(member[:0], member[:0], threshold)])


def _hot_pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Chunks of a hot key (blob_a, blob_b) to their possible pairs."""
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = np.frombuffer(x, dtype=_MEMBER), np.frombuffer(y, dtype=_MEMBER)
            for i in range(0, len(a), 64):
                block = a[i : i + 64]
                yield _pairs(np.repeat(block, len(b)), np.tile(b, len(block)), threshold).select(["al", "ah", "bl", "bh"])


def word_sets(texts: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``id, words``: the distinct lower-cased runs of letters or digits of each text, as sorted 64-bit hashes.

    Texts with fewer than ``min_words`` words, null ones included, give no row.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}]+"), 0))
    return (
        texts.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("id"), words.alias("w"))
        .where(F.size("w") >= min_words)
        .select("id", F.array_sort(F.transform("w", lambda x: F.xxhash64(x))).alias("words"))
    )


def similar_classes(texts: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: ``id, rep``, the smallest id with the same word set; links: ``a, b, similarity`` with
    ``a < b`` over representatives whose Jaccard similarity is at least ``threshold``.

    Equal word sets are one class, so copies cost one entry a task and band; candidates share a band and have sizes and
    sketches that allow the similarity; each is verified on the whole word sets. The number of bands follows from the threshold
    (:func:`bands_for`). Copies of a row count once. Null texts and ids, and texts under ``min_words`` words, belong to no class.
    """
    texts = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows, bands = bands_for(threshold)
    parts = max(1, -(-texts.count() * bands // ENTRIES))
    signed = word_sets(texts, "id", "t", max(1, min_words)).mapInArrow(lambda it: _sign(it, rows, bands, parts), "part int, blob binary, ids array<string>")
    found = cut(signed.groupBy("part").applyInArrow(lambda t: _gather(t, threshold), _SCHEMA))
    info = found.where("id is not null").select("id", F.col("al").alias("low"), F.col("ah").alias("high"), F.col("bl").alias("hash"))
    hot = found.where("hot is not null").select("hot", "chunk", "blob")
    chunks = hot.alias("a").join(hot.alias("b"), "hot").where("a.chunk <= b.chunk").select(F.col("a.blob").alias("x"), F.col("b.blob").alias("y"))
    pairs = found.where("id is null and hot is null").select("al", "ah", "bl", "bh").unionByName(chunks.mapInArrow(lambda it: _hot_pairs(it, threshold), "al bigint, ah int, bl bigint, bh int")).distinct()
    key = ["low", "high", "hash"]
    classes = info.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    members = info.join(classes.drop("n"), key).select("id", "rep").distinct()
    ra = classes.select(F.col("low").alias("al"), F.col("high").alias("ah"), F.col("rep").alias("ra"))
    rb = classes.select(F.col("low").alias("bl"), F.col("high").alias("bh"), F.col("rep").alias("rb"))
    candidates = cut(pairs.join(ra, ["al", "ah"]).join(rb, ["bl", "bh"]).select("ra", "rb").where("ra <> rb"))
    asked = bloom_filter(candidates.select(F.explode(F.array("ra", "rb")).alias("id")), "id")
    sets = word_sets(texts.where(asked.might_contain(F.col("id"))), "id", "t", max(1, min_words))
    wa, wb = (sets.select(F.col("id").alias(f"r{x}"), F.col("words").alias(f"w{x}")) for x in "ab")
    shared = F.size(F.array_intersect("wa", "wb"))
    similarity = shared / (F.size("wa") + F.size("wb") - shared)
    checked = candidates.join(wa, "ra").join(wb, "rb").select("ra", "rb", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    links = checked.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.max("similarity").alias("similarity"))
    return members, links


def similar_pairs(texts: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_words: int = 25) -> DataFrame:
    """``id_a, id_b`` with ``id_a < id_b``: all pairs of different ids whose texts are alike enough, copies included."""
    members, links = similar_classes(texts, id_col, text_col, threshold, min_words)
    members, links = cut(members), cut(links.select("a", "b"))
    ma, mb = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.join(ma, "a").join(mb, "b").select("x", "y")
    within = ma.join(mb, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(texts: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_words: int = 25) -> DataFrame:
    """``id, rep, class_id, n_links``: one row for each text, its class of equal word sets, the smallest id of the group
    that links join, and the number of other classes that its class is linked to."""
    from .components import boruvka_components

    members, links = similar_classes(texts, id_col, text_col, threshold, min_words)
    links = cut(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    groups = boruvka_components(links, "a", "b").withColumnRenamed("id", "rep")
    return (
        members.join(degree, "rep", "left")
        .join(groups, "rep", "left")
        .select("id", "rep", F.coalesce("group_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
