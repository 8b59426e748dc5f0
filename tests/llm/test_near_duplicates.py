import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import simhash as S
from seqloom.llm import spotsigs as G


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps):
    """Smallest index reachable by links of at most three bits."""
    left, out = set(range(len(fps))), {}
    while left:
        todo, group = [min(left)], []
        left.discard(todo[0])
        while todo:
            x = todo.pop()
            group.append(x)
            near = {y for y in left if (fps[x] ^ fps[y]).bit_count() <= 3}
            left -= near
            todo += near
        out |= dict.fromkeys(group, min(group))
    return out


def test_fingerprints(edge_rows):
    for _, t in edge_rows:
        if len(t or "") < 1000:
            assert S.fingerprint((t or "").encode()) == brute_fp(t)


def clouds(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            out.append(base)
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(64)
    return out[:n]


def linked(spark, fps, limit):
    nodes = spark.createDataFrame([(S.signed(f),) for f in set(fps)], "fp long")
    comp = {r.node: r.root for r in S.components(S.links(nodes, limit)).collect()}
    root = [comp.get(S.signed(f), S.signed(f)) for f in fps]
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    return {i: least[r] for i, r in enumerate(root)}


def test_links_and_components_equal_brute_force(spark):
    fps = clouds()
    assert linked(spark, fps, 4096) == brute_components(fps)


def test_overfull_buckets_lose_nothing(spark):
    fps = clouds(150, 8)
    assert linked(spark, fps, 3) == brute_components(fps)


def test_masks_leave_few_free_bits():
    assert len(S.block_masks(6)) == 20 and len(S.block_masks(16)) == 560
    assert all((m % (1 << 64)).bit_count() == 52 for m in S.block_masks(16))


def test_bucket_links_span():
    fps = np.array([0, 1, 3, 0b111000, 1 << 40, (1 << 40) | 1], np.int64)
    assert {a for a, _ in S.bucket_links(fps)} | {b for _, b in S.bucket_links(fps)} == {0, 1, 3, 0b111000, 1 << 40, (1 << 40) | 1}


def test_rows(edges, edge_rows, empty):
    got = S.near_duplicates(edges).select("doc_id", S.fp_hex("fp").alias("f"), "component_id").collect()
    assert sorted(str((r.doc_id, r.f)) for r in got) == sorted(str((i, f"{brute_fp(t):016x}")) for i, t in edge_rows)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[5] == 5
    assert S.near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(edges, empty):
    kept = S.keep_one(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted(set(ids), key=str) and 1 in ids and 2 not in ids and 3 not in ids and ids.count(5) == 1
    assert S.keep_one(empty).count() == 0


def sig(text):
    return set(next(G.signatures([text or ""])).tolist())


def alike(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_chains_follow_anchors():
    a, b = sig("The quick brown fox. Of mice and tall men"), sig("the QUICK, brown fox! of mice and tall men")
    assert a == b and len(a) == 3
    assert sig("zig zag zoom") and sig("!!") == set() and sig(None) == set()
    many = ["the cat sat on the mat", "", "of the", "x"]
    assert [set(s.tolist()) for s in G.signatures(many)] == [sig(t) for t in many]


def brute_signatures(text):
    """Chains word by word, without arrays."""
    full = 1 << 64
    factors = [int(f) for f in G._FACTORS]

    def word_hash(w):
        h = (sum((b + 1) * 0x9E3779B97F4A7C15 * pow(0x100000001B3, i, full) for i, b in enumerate(w)) + len(w)) % full
        h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD % full
        return h ^ (h >> 29)

    anchors = {a.encode() for a in G.ANCHORS}
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())

    def chain(i, follow):
        h = (word_hash(words[i]) * factors[0] + sum(word_hash(w) * factors[1 + j] for j, w in enumerate(follow))) % full
        return (h ^ (h >> 29)) * factors[2] % full >> 32

    out = set()
    for i, w in enumerate(words):
        follow = [x for x in words[i + 1 :] if x not in anchors][: G.CHAIN]
        if w in anchors and follow:
            out.add(chain(i, follow))
    return out or {chain(i, words[i + 1 : i + 1 + G.CHAIN]) for i in range(len(words))}


def test_chains_equal_brute_force():
    rng = random.Random(4)
    words = ["the", "of", "und", "fox", "Haus", "élan", "x1", "A", "größe", "in"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(150)] + ["the", "the of", "fox", "fox hat house", "zzz the"]
    assert [sig(t) for t in texts] == [brute_signatures(t) for t in texts]
    # One anchored chain is enough for a text to have no others; none, and every word has one.
    assert len(sig("a1 b1 c1 d1 the e1")) == 1 and len(sig("a1 b1 c1 d1 e1")) == 5


def test_ids_of_other_types_are_dealt_out(spark):
    texts = [f"the cat {i} sat of mats {i}" for i in range(200)]
    df = spark.createDataFrame([(f"k{i:04}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {r.doc_id: r.near_next for r in G.compare_with_next(df).collect()}
    assert got == {f"k{i:04}": alike(sig(t), sig(texts[(i + 1) % 200])) for i, t in enumerate(texts)}
    assert len(G._quantiles(df.select("doc_id"), 4)) == 3
    days = df.selectExpr("date_add(date'2020-01-01', CAST(substr(doc_id, 2) AS INT)) AS doc_id", "text")
    assert [r.near_next for r in G.compare_with_next(days).orderBy("doc_id").collect()] == [got[k] for k in sorted(got)]


def test_compare_with_next(spark, edges, edge_rows, empty):
    import hashlib

    rows = [(i, t) for i, t in edge_rows if i != 5]
    df = edges.filter("doc_id is null or doc_id <> 5")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), alike(sig(t), sig(e)), alike(sig(t), sig(n)))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in G.compare_with_next(df).collect()}
    assert got == want
    assert G.compare_with_next(edges).count() == len(edge_rows) and G.compare_with_next(empty).count() == 0
    sole = G.compare_with_next(df.filter("doc_id = 6")).first()
    assert sole.near_next == 1.0


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 20
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    texts = []
    for t in base:
        for k in range(4):
            w = t.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, pairs = G.similar_pairs(df, 0.6)
    name = {r.doc_id: r.class_id for r in members.collect()}
    sets = {name[i]: sig(t) for i, t in enumerate(texts)}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and alike(sets[a], sets[b]) >= 0.6}
    assert {frozenset((r.class_a, r.class_b)) for r in pairs.collect()} == want and want
    assert df.select(F.count("*")).first()[0] == len(name)
