"""Encoding of a corpus with a public byte-level tokenizer, by tree reduction over the text.

An encoded piece of text is an element of a monoid: long texts are halved down to leaves, the leaves are encoded, and
neighbours are joined up the tree. A join re-encodes only a window around the cut, which grows until it begins and ends
at places where the tokenizer's splitting pattern must break whatever lies beyond: before a blank that follows a
non-blank, and after a letter that a non-letter follows. No token crosses such a place, so all tokens outside stay.
Most texts are one leaf.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of a leaf, at most, and of the first window on each side of a cut.
LEAF, WINDOW = 8_192, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class TreeEncoder:
    """Encodes and decodes with the rank file at ``path``; ``None`` stands for the installed 50k vocabulary."""

    def __init__(self, path: str | None = None, leaf: int = LEAF) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(path or default_vocabulary(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.leaf = leaf
        self.coding = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for b, r in ranks.items():
            self.width[r] = len(b)
        self._break = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])")

    def encode(self, text: str) -> list[int]:
        """The ids of the whole text, without special tokens; their strings are ordinary text. Unpaired surrogates are replaced."""
        if len(text) <= self.leaf:
            return self.coding.encode_ordinary(text)
        return self._range(text, 0, len(text))

    def _range(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.coding.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._range(text, lo, mid), self._range(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        start, w = lo, WINDOW
        while mid - w > lo:  # the last sure break before the cut, searched in growing windows
            at = max((m.start() for m in self._break.finditer(text, mid - w, mid)), default=-1)
            if at > mid - w:
                start = at
                break
            w *= 2
        stop, w = hi, WINDOW
        while mid + w < hi:  # the first sure break after it
            m = self._break.search(text, mid + 1, mid + w)
            if m and m.start() < mid + w:
                stop = m.start()
                break
            w *= 2
        keep = len(left) - self._tail(left, len(text[start:mid].encode("utf-8", "replace")))
        skip = self._head(right, len(text[mid:stop].encode("utf-8", "replace")))
        return left[:keep] + self.coding.encode_ordinary(text[start:stop]) + right[skip:]

    def _head(self, ids: list[int], size: int) -> int:
        n = 0
        while size > 0:
            size -= int(self.width[ids[n]])
            n += 1
        if size:
            raise AssertionError("a token crosses a sure break")
        return n

    def _tail(self, ids: list[int], size: int) -> int:
        n = 0
        while size > 0:
            n += 1
            size -= int(self.width[ids[-n]])
        if size:
            raise AssertionError("a token crosses a sure break")
        return n

    def decode(self, ids: list[int]) -> str:
        """Tokens are bytes, so decoding concatenates halves up the tree and reads UTF-8 once at the root."""

        def part(lo: int, hi: int) -> bytes:
            if hi - lo <= self.leaf:
                return self.coding.decode_bytes(ids[lo:hi])
            mid = (lo + hi) // 2
            return part(lo, mid) + part(mid, hi)

        return part(0, len(ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str | None = None) -> TreeEncoder:
    """One encoder for each worker process and vocabulary."""
    return TreeEncoder(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        parts = [np.asarray(enc.encode(t) if t else [], dtype=np.int32) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], names=[batch.schema.names[0], "ids"])


def encode_texts(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col, ids``: the token ids of each text; an empty list for an empty or null text. Other columns are left out.

    No shuffle: texts stream through Arrow batches where they are read. Repeated rows come out repeated.
    """
    kind = dict(texts.dtypes)[id_col]
    return texts.select(id_col, text_col).mapInArrow(lambda it: _encode(it, path), f"`{id_col}` {kind}, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        texts = [enc.decode(ids or []) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[batch.schema.names[0], "text"])


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``id_col, text``: the texts of lists of ids; null and empty lists give an empty text."""
    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, ids_col).mapInArrow(lambda it: _decode(it, path), f"`{id_col}` {kind}, text string")
