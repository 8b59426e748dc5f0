"""Texts beyond a block: the same results piece by piece, and memory that doesn't grow with the kernels' temporaries."""

import random
import re
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from seqloom.llm import bpe_monoid, simhash, token_count
from seqloom.llm import language_id as L
from seqloom.llm import quality_mil as Q
from seqloom.llm import spotsigs as S
from seqloom.llm import toxicity as T
from seqloom.llm import winnowing as W
from seqloom.llm.batches import blocks, joined, lowered, pieces

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def mixed(seed, n=3000, words=("der", "the", "Haus", "baum,", "é", "日本", " ", "\n", "   ", "a.b", "Σας ", "ΑΣ", "of", "1")):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, n))) for _ in range(8)] + ["", None, " ", "x" * 50, " " * 5000 + "a"]


def test_pieces_and_blocks_lose_nothing():
    for seed in range(20):
        values = mixed(seed, 60)
        for limit in (8, 50, 10_000):
            got = [t for b in blocks(values, limit) for t in b.texts()]
            assert got == [(v or "").encode() for v in values]
            for v in got:
                cuts = pieces(np.frombuffer(v, np.uint8), limit)
                assert b"".join(v[s:e] for s, e in cuts) == v and all(e - s <= limit for s, e in cuts)
                [v[s:e].decode() for s, e in cuts]
    assert [b.first for b in blocks(pa.array(["a", None, "bb"]).slice(1), 1)] == [0, 1]


def test_lower_case_is_that_of_the_text():
    values = mixed(1, 500)
    low = [t for b in blocks(values, 1 << 16) for t in lowered(b).texts()]
    assert low == [(v or "").lower().encode() for v in values]


def test_signatures():
    values = mixed(2)
    want = [set(s.tolist()) for s in S.signatures(values)]
    for limit in (64, 1000):
        assert [set(s.tolist()) for s in S.signatures(values, limit=limit)] == want


def test_quality():
    r, k = np.random.default_rng(0), Q.HIDDEN
    p = {"E": r.normal(0, 0.05, (Q.SIZE, k)), "e": np.zeros(k), "V": r.normal(0, 1, (k, k)), "U": r.normal(0, 1, (k, k)), "a": r.normal(0, 1, k), "c": r.normal(0, 1, k), "b": np.zeros(1)}
    m = Q.Model(p, np.zeros(Q.SIZE), np.ones(Q.SIZE) * 0.1)
    values = [" ".join(mixed(s, 40_000)[0:2]) for s in (3, 4)] + ["x" * 300_000, " " * 200_000, "y " * 100_000]
    assert max(len(v) for v in values) > 1 << 17
    assert np.allclose(m.score(values, limit=1 << 17), m.score(values, limit=1 << 27), atol=1e-6)


def test_languages_and_toxicity(monkeypatch):
    values = mixed(5)
    r = np.random.default_rng(1)
    m = L.Model(["a", "b", "c"], L.codewords(3), r.normal(0, 1, (L.DIMS, 3)).astype(np.float32), r.normal(0, 1, 3).astype(np.float32), np.ones(3, np.float32))
    t = T.Model(np.where(r.random(1 << T.BITS) < 0.1, r.normal(0, 1, 1 << T.BITS), 0).astype(np.float32), 0.1)
    want = (m.predict(values), t.score(values))
    monkeypatch.setattr(L, "BLOCK", 100)
    names, scores, unsure = m.predict(values)
    assert names == want[0][0] and unsure == want[0][2] and np.allclose(scores, want[0][1], atol=1e-5)
    whole = list(T.blocks(values, 100))
    assert any(len(b.data) > 100 for b in whole)
    monkeypatch.setattr(T, "BLOCK_BYTES", 100)
    monkeypatch.setattr(T, "blocks", lambda v: blocks(v, 100))
    monkeypatch.setattr(T, "pieces", lambda d: pieces(d, 100))
    assert np.allclose(t.score(values), want[1])


@pytest.mark.parametrize("limit", [16, 64, 300, 1 << 18])
def test_windows(limit):
    for seed in range(15):
        rng = random.Random(seed)
        v = ["a", "B", "c-d", "é", "7", "x" * 40, "y" * 1500, "zz,"]
        texts = [rng.choice([" ", ",", ""]).join(rng.choice(v) for _ in range(rng.randint(0, 60))) for _ in range(4)]
        for text, (n, found) in zip(texts, W.windows(texts, [2, 8], None, limit), strict=True):
            low = text.encode().lower()
            spans = [m.span() for m in WORD.finditer(low)]
            words = [W._short(low[a:b]) for a, b in spans]
            want = sorted((i, z, spans[i][0], spans[i + z - 1][1], b" ".join(words[i : i + z])) for z in (2, 8) for i in range(len(words) - z + 1))
            assert n == len(words) and sorted((w.at, w.size, w.begin, w.stop, w.words) for w in found) == want


def test_memory_does_not_follow_the_length_of_a_text():
    """8 MB here; kernels that looked at it whole took 217 to 912 MB."""
    unit = "The quick brown fox and the lazy dog, of Überlingen. " * 20
    size = 8 << 20
    text = (unit * (size // len(unit.encode()) + 1))[: size - size // 40]
    column = pa.array([text])
    del text
    r, k = np.random.default_rng(0), Q.HIDDEN
    p = {"E": r.normal(0, 0.05, (Q.SIZE, k)), "e": np.zeros(k), "V": r.normal(0, 1, (k, k)), "U": r.normal(0, 1, (k, k)), "a": r.normal(0, 1, k), "c": r.normal(0, 1, k), "b": np.zeros(1)}
    quality = Q.Model(p, np.zeros(Q.SIZE), np.ones(Q.SIZE))
    language = L.Model(["a", "b"], L.codewords(2), np.ones((L.DIMS, 15), np.float32)[:, :1], np.zeros(1, np.float32), np.ones(1, np.float32))
    toxicity = T.Model(np.ones(1 << T.BITS, np.float32), 0.0)
    bitmap = np.zeros(1 << (W.BITMAP_BITS - 3), np.uint8)
    raw = column.cast(pa.binary())[0].as_py()
    codec = bpe_monoid.Codec.of(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    counter = token_count.Counter.of(P.path("byte_bpe_50k.json"))
    whole = raw.decode()
    runs = {
        "fingerprint": lambda: simhash.fingerprint(raw), "count": lambda: counter.count(whole), "encode": lambda: sum(map(len, codec.decoded(codec.tokens(whole)))),
        "quality": lambda: quality.score(column), "language": lambda: language.predict(column), "toxicity": lambda: toxicity.score(column),
        "signatures": lambda: list(S.signatures(column)), "windows": lambda: list(W.windows(column, [8], bitmap)), "edited": lambda: len(S.edited(raw, raw)),
    }
    for name, run in runs.items():
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 300 * size // 64, (name, peak)


def test_fingerprints_part_by_part():
    for text in (v for v in mixed(6, 200) if v):
        want = simhash.fingerprint(text.encode())
        assert [simhash.fingerprint(text.encode(), n) for n in (1, 7, 100)] == [want] * 3


def test_tokens_of_long_texts():
    codec = bpe_monoid.Codec.of(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    text = " ".join(mixed(7, 20_000)[:3])
    ids = codec.encoding.encode_ordinary(text)
    assert len(ids) > 2 * bpe_monoid._PACKED and codec.encode(text) == ids and list(codec.tokens(text)) == ids
    assert b"".join(codec.decoded(codec.tokens(text))) == text.encode() == codec.decode(ids)


def test_counts_of_long_texts(monkeypatch):
    counter = token_count.Counter.of(P.path("byte_bpe_50k.json"))
    values = [v or "" for v in mixed(8, 300)] + ["<|endoftext|> a <|endoftext|>"]
    want = [counter.count(v) for v in values]
    monkeypatch.setattr(token_count, "_LISTED", 10)
    assert [counter.count(v) for v in values] == want


def test_joined_is_a_block():
    b = joined([b"ab", b"", b"c"], 4)
    assert (b.first, b.end, list(b.texts())) == (4, 7, [b"ab", b"", b"c"])
