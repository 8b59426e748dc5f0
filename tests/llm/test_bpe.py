import hashlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import bpe_monoid as M
from seqloom.llm import token_count as C

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXT = st.text(alphabet=" \n\t'sreld12é.,　\x1c\x85\xa0日<|>", max_size=60)


@pytest.fixture(scope="module")
def codec():
    return M.Codec.of(PATH, P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_tree_equals_the_library_at_any_leaf_size(codec, text, leaf):
    ids = codec.encoding.encode_ordinary(text)
    assert codec.encode(text, leaf) == ids
    assert codec.decode(ids, leaf) == text.encode()
    assert codec._encode_long(text) == ids


def test_every_character_class_splits_like_the_library(codec):
    for at in range(0, 0x30000, 61):
        if not 0xD800 <= at < 0xE000:
            text = f"a{chr(at)}b 1{chr(at)}{chr(at)} c"
            assert codec._encode_long(text) == codec.encoding.encode_ordinary(text), hex(at)


def test_shipped_leaf_joins_ordinary_texts(spark, codec):
    """Equal to the library at the leaf size that the query uses; most rows of the table meet a join."""
    rows = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert sum(len(t) > M.LEAF for t in rows) > 0.9 * len(rows)
    for t in rows[:400]:
        ids = codec.encode(t)
        assert ids == codec.encoding.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_rows(spark, edges, edge_rows, empty, codec):
    got = M.round_trip(edges, PATH, P.PATTERN).collect()
    want = []
    for i, t in edge_rows:
        ids = codec.piece(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert M.round_trip(empty, PATH, P.PATTERN).collect() == []
    back = M.decode(M.encode(edges, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t in edge_rows)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXT, st.just("<|endoftext|>")), max_size=4).map("".join))
def test_counts_equal_the_library(library, text):
    assert C.Counter.of(P.path("byte_bpe_50k.json")).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_whole_tokens_are_proven(library):
    counter = C.Counter.of(P.path("byte_bpe_50k.json"))
    assert len(counter.sizes.whole) > 40_000
    for name in counter.sizes.whole[:: len(counter.sizes.whole) // 200]:
        assert len(library.encode(name, add_special_tokens=False).ids) == 1


def test_cache_is_bounded(monkeypatch):
    merged = []
    cache = C.Cache(["a"], lambda p: merged.append(p) or 2)
    cache.limit = 4
    assert [cache[p] for p in ("b", "c", "d", "e", "a", "b")] == [2, 2, 2, 2, 1, 2] and len(cache) <= 4


def test_count_rows(edges, edge_rows, empty, library):
    path = P.path("byte_bpe_50k.json")
    got = sorted(map(tuple, C.token_counts(edges, path).collect()), key=str)
    want = []
    for i, t in edge_rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)
    assert C.token_counts(empty, path).count() == 0
