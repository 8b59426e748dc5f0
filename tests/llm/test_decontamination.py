import random
import re

import numpy as np
import pytest

from seqloom.llm import winnowing as W

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(items, text):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").encode().lower())
        for k in range(max(1, len(w) - 7)) if w else ():
            windows.setdefault(tuple(w[k : k + 8]), set()).add(i)
    w, hit, found = WORD.findall((text or "").encode().lower()), set(), set()
    for n in {len(k) for k in windows}:
        for k in range(len(w) - n + 1):
            if s := windows.get(tuple(w[k : k + n])):
                found |= s
                hit.update(range(k, k + n))
    return len(w), len(hit), sorted(found)


def cases(seed, n_docs=25):
    rng = random.Random(seed)
    v = ["a", "B", "c-d", "é", "7"]
    items = [(str(i), " ".join(rng.choice(v) for _ in range(rng.randint(0, 14)))) for i in range(6)]
    return items, [" ".join(rng.choice(v) for _ in range(rng.randint(0, 60))) for _ in range(n_docs)]


def test_windows_of_shared_runs_share_fingerprints():
    for seed in range(60):
        items, docs = cases(seed)
        every = [list(W.windows([t], [8]))[0][1] for t in [*docs, *(t for _, t in items)]]
        names = {}
        for w in (w for ws in every for w in ws):
            assert names.setdefault(w.words, w.fp) == w.fp


def test_fingerprints_are_least_gram_hashes():
    h = np.random.default_rng(0).integers(0, 9, 500).astype(np.uint64)
    grams = [int(W.gram_hashes(h[i : i + 5], 5)[0]) for i in range(496)]
    assert W.window_fingerprints(h, 8).tolist() == [min(grams[i : i + 4]) for i in range(493)]


def run(docs, bench, **options):
    found = W.contamination(docs, bench, **options)
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in W.report(found).collect()], key=str)


@pytest.mark.parametrize("seed", [77, 78])
def test_broadcast_or_shuffled(spark, edges, seed):
    items, docs = cases(seed, 80)
    bench = spark.createDataFrame([*[(int(i), t) for i, t in items], (90, None), (91, "")], "item_id long, text string")
    df = spark.createDataFrame([*enumerate(docs), (3, docs[3]), (900, None)], "doc_id long, text string")
    whole = run(df, bench)
    assert whole == run(df, bench, broadcast_windows=0) and len(whole) == len(docs) + 2
    by = {r[0]: r for r in whole}
    assert [by[i][1:4] for i in range(len(docs))] == [(n, h, len(s)) for n, h, s in (brute(items, t) for t in docs)]
    assert by[900][1:4] == (0, 0, 0)


def test_edge_rows(spark, edges, edge_rows, empty):
    bench = spark.createDataFrame([(1, "word " * 9), (2, "One short text."), (3, "one SHORT text")], "item_id long, text string")
    got = {r[0]: r for r in run(edges, bench)}
    assert got[7][1:4] == (40_000, 40_000, 1) and got[5][2:4] == (3, 2) and got[5][5] and got[1][1] == 0
    assert len(run(edges, bench)) == len(edge_rows) and run(empty, bench) == []
    assert all(r[3] == 0 for r in run(edges, bench.limit(0)))


def test_clean_cuts_single_leaks_and_drops_double_ones(spark, edges):
    passage = "alpha beta gamma delta epsilon zeta eta theta"
    other = "one two three four five six seven eight"
    bench = spark.createDataFrame([(1, passage), (2, other)], "item_id long, text string")
    rows = [(1, f"Before {passage}, after.", 0), (2, f"{passage} {other}", 0), (3, "nothing here", 12), (4, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in W.clean(df, bench).collect()}
    assert got == {1: ("Before , after.", 15), 3: ("nothing here", 12), 4: (None, 0)}
    assert {r.doc_id: (r.text, r.n_chars) for r in W.clean(df, bench, broadcast_windows=0).collect()} == got
    assert W.clean(edges, bench).columns == edges.columns


def test_clean_until_nothing_is_left(spark):
    """A cut may bring words together that are a leak again; what is left has none, and columns of any name stay."""
    a = "alpha beta gamma delta epsilon zeta eta theta"
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    nested = f"alpha beta gamma {a} delta epsilon zeta eta theta end"
    df = spark.createDataFrame([(1, nested, 5, 7, "k"), (1, nested, 5, 7, "k"), (None, a, 0, 0, None)], "doc_id long, text string, key int, at int, runs string")
    got = W.clean(df, bench).collect()
    assert sorted((str(r.doc_id), r.text.split(), r.key, r.at, r.runs) for r in got) == [("1", ["end"], 5, 7, "k")] * 2 + [("None", [], 0, 0, None)]


def test_large_benchmarks_read_documents_once(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(400)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [" ".join([rng.choice(words), *items[i].split()[k : k + 9], rng.choice(words)]) for i, k in ((rng.randrange(400), rng.randrange(31)) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    by = {r[0]: r for r in run(df, bench, broadcast_windows=10)}
    known = {}
    for i, t in enumerate(items):
        w = t.split()
        for k in range(len(w) - 7):
            known.setdefault(tuple(w[k : k + 8]), set()).add(i)
    for i, t in enumerate(docs):
        w = t.split()
        hit = [(k, known[tuple(w[k : k + 8])]) for k in range(len(w) - 7) if tuple(w[k : k + 8]) in known]
        assert by[i][2:4] == (len({x for k, _ in hit for x in range(k, k + 8)}), len({x for _, s in hit for x in s}))


def test_repetitive_texts_take_linear_time(spark):
    bench = spark.createDataFrame([(1, "word " * 300)], "item_id long, text string")
    df = spark.createDataFrame([(1, "word " * 100_000)], "doc_id long, text string")
    assert run(df, bench)[0][1:4] == (100_000, 100_000, 1)
