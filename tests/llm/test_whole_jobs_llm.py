"""Whole texts and proofs over whole vocabularies."""

import json
import random

from seqloom.llm import quality_mil, token_count


def letters(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghij") for _ in range(n))


def test_quality_learns_from_every_passage():
    text = " ".join(letters(5, i) for i in range(quality_mil.PASSAGE * 40 + 1))
    (x, firsts), = quality_mil.passages(["short text", text])
    got = list(quality_mil.bag(["short text", text]))
    assert [len(b) for b in got] == [1, 41] and firsts[-1] == 42
    assert (got[1] == x[1:]).all()


def test_whole_tokens_are_proven_by_the_merges(tmp_path):
    names = [*token_count.byte_alphabet(), "abc", "de"]
    spec = {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"type": "BPE", "vocab": {n: i for i, n in enumerate(names)}, "merges": ["ab c", "d e"]}}
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(spec))
    counter = token_count.Counter.of(str(path))
    assert counter.count("de") == 1 and counter.count("abc") == 3
