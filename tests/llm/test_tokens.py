from __future__ import annotations

import base64
from collections import defaultdict

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from curralign.llm import encoding, packing

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def small():
    return encoding.TreeEncoder(leaf=16)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab cé漢字\n\t'。!1३ ̀🙂s" + chr(0xE01), max_size=300))
def test_tree_encoding_is_the_plain_encoding(text):
    enc = encoding.encoder()
    tree = _small()
    assert tree.encode(text) == enc.coding.encode_ordinary(text)
    assert tree.decode(tree.encode(text)) == text


_CACHE: list = []


def _small():
    if not _CACHE:
        _CACHE.append(encoding.TreeEncoder(leaf=16))
    return _CACHE[0]


def test_long_texts_without_breaks(small):
    for text in ("a" * 5000, " " * 3000, "漢" * 3000, "word " * 4000, "<|endoftext|>" * 50):
        assert small.encode(text) == encoding.encoder().coding.encode_ordinary(text)


def test_ids_agree_with_the_other_library(small):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ("Hello  world's 12 cats\n\n", "¿Qué? naïve 漢字 ก็", "<|endoftext|> x"):
        assert small.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_frames(spark):
    df = spark.createDataFrame([(1, "hi there", "en"), (2, "", "x"), (3, None, None), (1, "hi there", "en")], "doc_id long, text string, ids string")
    got = encoding.encode_texts(df)
    ids = encoding.encoder().encode("hi there")
    assert rows(got) == sorted([(1, ids), (1, ids), (2, []), (3, [])], key=repr)
    assert rows(encoding.decode_ids(got))[0] == (1, "hi there")
    assert encoding.encode_texts(df.limit(0)).count() == 0


def test_vocabulary_is_a_parameter(spark):
    path = public.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        assert len(base64.b64decode(f.readline().split()[0])) >= 1
    df = spark.createDataFrame([(1, "größer")], "doc_id long, text string")
    back = encoding.decode_ids(encoding.encode_texts(df, path=path), path=path)
    assert rows(back) == [(1, "größer")]


def test_packing_is_whole_and_tight(spark):
    sizes = [(i, (i * 37) % 90 + 1) for i in range(800)] + [(900, 0), (901, None), (902, 100)]
    df = spark.createDataFrame(sizes, "item long, size long").repartition(6)
    packed = rows(packing.pack(df, "item", "size", 100, open_windows=32))
    size = dict(sizes)
    assert sorted(i for i, _ in packed) == sorted(i for i, s in sizes if s)
    fill = defaultdict(int)
    for i, c in packed:
        fill[c] += size[i]
    assert max(fill.values()) <= 100
    assert sum(fill.values()) / (100 * len(fill)) > 0.93


def test_only_texts_above_the_capacity_are_split(spark):
    df = spark.createDataFrame([(1, "word " * 500), (2, "short text"), (3, ""), (4, None), (5, "x")], "doc_id long, text string")
    got = rows(packing.pack_documents(df, capacity=100, open_windows=4), "doc_id", "start_token", "end_token")
    n = len(encoding.encoder().encode("word " * 500))
    pieces = [g for g in got if g[0] == 1]
    assert sorted(pieces) == [(1, s, min(s + 100, n)) for s in range(0, n, 100)]
    assert sorted({g[0] for g in got}) == [1, 2, 5]
    report = packing.container_report(packing.pack_documents(df, capacity=100, open_windows=4), 100).first()
    assert report["fullest"] <= 100
    assert packing.pack_documents(df.limit(0)).count() == 0
