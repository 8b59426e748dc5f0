"""Registered queries do the whole job: small tables of their own against brute force."""

import random

from seqloom.operators import profile
from seqloom.plans import catalog
from seqloom.plans.inputs import K
from seqloom.plans.modes import mode


def letters(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghij") for _ in range(n))


def grams(text):
    return {text[i : i + K] for i in range(len(text) - K + 1)}


def test_whole_file_searches_every_conversation(spark, tmp_path):
    a = letters(500, 1)
    turns = [(1, 0, a[:250]), (1, 1, a[250:]), (2, 0, a[:200] + letters(300, 2)), (5, 0, letters(400, 3)), (7, 0, letters(100, 4)), (7, 1, a[250:] + letters(300, 5))]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    texts = {c: ("N" * (K - 1)).join(t for x, _, t in turns if x == c) for c in (1, 2, 5, 7)}
    want = set()
    for q, x in texts.items():
        for t, y in texts.items():
            m = len(grams(x) & grams(y))
            if m >= 10 and m > 0.2 * len(grams(x)):
                want.add((q, t, m))
    assert {(1, 2), (2, 1), (1, 7), (7, 1), (5, 5)} <= {w[:2] for w in want}
    got = catalog.QUERIES["search_whole_file"](spark, str(tmp_path)).collect()
    assert {(r.query, r.target, r.m_kmers) for r in got} == want and len(got) == len(want)


def test_sketch_similarity_lists_equal_texts_and_single_shared_hashes(spark, tmp_path):
    texts = ["short", "short", letters(60, 6), letters(60, 6), letters(300, 7), letters(300, 7), letters(900, 8), "other", None, None]
    texts.append(texts[6][:40] + letters(500, 9))
    docs = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog.QUERIES["fracminhash_sketch"](spark, str(tmp_path)).collect()
    sets = {i: {r.kmer for r in rows if r.ref_id == i} for i, _ in docs}
    group = {}
    for i, x in docs:
        group[i] = min(j for j, y in docs if (sets[i] or sets[j]) and sets[i] == sets[j] or not sets[i] and not sets[j] and (i == j or x is not None and x == y))
    want = {}
    for i in sets:
        for j in sets:
            m = len(sets[i] & sets[j])
            if i < j and m and group[i] == i and group[j] == j:
                want[i, j] = (m, round(m / len(sets[i] | sets[j]), 6))
    assert [group[i] for i in (1, 3, 5, 9)] == [0, 2, 4, 9]
    assert 0 < want[6, 10][0] < 3
    got = catalog.QUERIES["sketch_similarity"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b): (r.m, r.jacc) for r in got} == want and len(got) == len(want)
    named = catalog.QUERIES["sketch_classes"](spark, str(tmp_path)).collect()
    assert {r.ref_id: getattr(r, "class") for r in named} == group and len(named) == len(docs)


def test_ambiguity_correction_goes_target_by_target(spark):
    data = [(t, 0.9) for t, n in (("a", 20), ("b", 16), ("c", 12)) for _ in range(n)]
    found = [(i, t, c) for i, (t, c) in enumerate(data)]
    found += [(100 + i, t, c) for i in range(4) for t, c in (("a", 0.9), ("c", 0.7))]
    found += [(200, t, c) for t, c in (("a", 0.9), ("b", 0.8), ("c", 0.7))]
    df = spark.createDataFrame([(q, t, 0, 1, 100, c, 0.0, i) for i, (q, t, c) in enumerate(found)], "query long, target string, chunk_idx int, chunks int, q_len int, q_cov double, fpr double, line int")
    sizes = spark.createDataFrame([(t, 1000) for t in "abc"], "target string, size long")

    def kept(**changes):
        p = mode(3, dominance=0.9, mismatch=0.9, **changes)
        return {r.target for r in profile.before_em(df, None, sizes, p)[0].filter("query = 200").collect()}

    assert kept() == {"a", "c"}
