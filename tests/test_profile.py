"""The whole of profiling, to convergence, against a plain Python version that goes query by query."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.operators import profile
from seqloom.plans.modes import mode


def grouped(rows, keep):
    """query: target: its rows, best first."""
    out = defaultdict(lambda: defaultdict(list))
    for r in rows:
        if keep is None or r["target"] in keep:
            out[r["query"]][r["target"]].append(r)
    for targets in out.values():
        for found in targets.values():
            found.sort(key=lambda r: (-r["q_cov"], r["chunk_idx"], r["line"]))
    return out


def same_species(targets, species):
    kinds = {species.get(t) for t in targets}
    return len(kinds) == 1 and None not in kinds


def add_up(queries, species, sizes, p, share=None, every=False):
    """Reads, bases, unique and confident reads by target and chunk; then what they say of a target.

    share: the part of a query that a target gets; without it bases are divided evenly and reads count
    in full, with every also the unique ones."""
    reads, bases, uniq, hic, chunks = (defaultdict(lambda: defaultdict(float)) for _ in range(5))
    for q, targets in queries.items():
        many, alike = len(targets) > 1, same_species(targets, species)
        for t, found in targets.items():
            part = 1.0 if not many else share(q, t) if share else 1.0 / len(targets)
            count = part if share else 1.0
            for i, r in enumerate(found):
                c = r["chunk_idx"]
                chunks[t] = r["chunks"]
                reads[t][c] += count / len(found)
                bases[t][c] += r["q_len"] * part / len(found)
                if i == 0 and (not many or alike):
                    one = 1.0 if not many or every else count / len(found)
                    uniq[t][c] += one
                    if r["q_cov"] >= p.hic_cov:
                        hic[t][c] += one
    out = {}
    for t in reads:
        n, total = chunks[t], sum(bases[t].values())
        rel = [bases[t].get(c, 0.0) / total * n for c in range(n)]
        mean = sum(rel) / n
        out[t] = {
            "reads": sum(reads[t].values()), "uniq": sum(uniq[t].values()), "hic": sum(hic[t].values()), "bases": total,
            "chunks_frac": sum(x >= p.min_reads for x in reads[t].values()) / n, "depth_sd": (sum((x - mean) ** 2 for x in rel) / n) ** 0.5, "coverage": total / sizes[t],
            "any": sum(x > 0 for x in reads[t].values()) / n,
        }
    return out


def exist(t, p):
    return {k for k, v in t.items() if v["uniq"] >= p.min_uniq and v["hic"] >= p.min_hic and v["hic"] >= p.min_hic_prop * v["uniq"] and v["chunks_frac"] >= p.min_chunks_frac and v["depth_sd"] <= p.max_depth_sd}


def brute_profile(rows, species, sizes, p):
    queries = grouped(rows, None)
    first = add_up(queries, species, sizes, p, every=True)
    alive = {t for t, v in first.items() if v["uniq"] >= 1 and v["hic"] >= 1 and v["any"] >= p.min_chunks_frac}
    queries = grouped(rows, alive)
    shared = defaultdict(int)
    for targets in queries.values():
        for a in targets:
            for b in targets:
                shared[a, b] += a != b
    beats = lambda a, b: first[a]["reads"] * (1 - p.dominance) >= shared[a, b] and first[b]["uniq"] < first[a]["uniq"] * p.mismatch
    for targets in queries.values():
        line, gone = sorted(targets, key=lambda t: (-targets[t][0]["q_cov"], t)), set()
        for i, a in enumerate(line):
            if a not in gone:
                for b in line[i + 1 :]:
                    if b not in gone and (beats(a, b) or beats(b, a)):
                        gone.add(b if beats(a, b) else a)
        for t in gone:
            del targets[t]
    third = add_up(queries, species, sizes, p)
    alive = exist(third, p)
    cover, last = {t: third[t]["coverage"] for t in alive}, None
    queries = grouped(rows, alive)
    for i in range(p.max_iters + 1):
        old = cover
        share = lambda q, t, old=old, queries=queries: old[t] / sum(old[x] for x in queries[q])
        now = add_up(queries, species, sizes, p, share)
        used = queries
        if i == 0:
            now = {t: now[t] for t in exist(now, p)}
        cover = {t: v["coverage"] for t, v in now.items()}
        if not now:
            return {}
        top = min(cover, key=lambda t: (-cover[t], t))
        pct = cover[top] / sum(cover.values()) * 100
        if last is not None and abs(pct - last) < p.pct_threshold:
            break
        last = pct
        if i == 0:
            queries = grouped(rows, set(now))
    for t in now:
        own = sorted(f[t][0]["q_cov"] for f in used.values() if t in f and (len(f) == 1 or same_species(f, species)))
        place = 0.9 * (len(own) - 1) if own else 0
        low = int(place)
        now[t]["score"] = 100 * (own[low] + (own[min(low + 1, len(own) - 1)] - own[low]) * (place - low)) if own else 0.0
        now[t]["percentage"] = cover[t] / sum(cover.values()) * 100
    return now


def matches(seed, n=900):
    """Reads of six targets, some alike, that hit one or several chunks of one or several targets."""
    rng, rows = random.Random(seed), []
    likes = {"A": "B", "B": "A", "C": "D", "D": "C", "E": "F", "F": "A"}
    for q in range(n):
        t = rng.choices("ABCDEF", [30, 12, 20, 3, 8, 1])[0]
        hit = {t} | ({likes[t]} if rng.random() < 0.4 else set()) | ({rng.choice("ABCDEF")} if rng.random() < 0.1 else set())
        for x in sorted(hit):
            for c in rng.sample(range(5), rng.choice([1, 1, 1, 2])):
                rows.append({"query": q, "target": x, "chunk_idx": c, "chunks": 5, "q_len": rng.randint(80, 150), "q_cov": round(rng.uniform(0.9, 1) if x == t else rng.uniform(0.55, 0.95), 3), "fpr": 0.0, "line": rng.randint(0, 3)})
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("level", ["species", "strain"])
def test_profile_to_convergence(spark, seed, level):
    rows, sizes = matches(seed), {t: 3000 + 500 * i for i, t in enumerate("ABCDEF")}
    species = {"A": 1, "B": 1, "C": 2, "D": 2, "E": 3}
    p = mode(3, min_reads=1, min_uniq=2, min_hic=1, min_hic_prop=0.01, min_chunks_frac=0.4, max_depth_sd=4, dominance=0.3, mismatch=0.5, level=level, pct_threshold=0.001, max_iters=30, main_gap=None)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "query long, target string, chunk_idx int, chunks int, q_len int, q_cov double, fpr double, line int")
    kinds = spark.createDataFrame(list(species.items()), "target string, species long")
    got = profile.profile(df, kinds, spark.createDataFrame(list(sizes.items()), "target string, size long"), p).collect()
    want = brute_profile(rows, species if level == "species" else {}, sizes, p)
    assert {r.target for r in got} == set(want) and len(want) >= 3
    for r in got:
        for c in ("reads", "uniq", "hic", "bases", "chunks_frac", "depth_sd", "coverage", "score", "percentage"):
            assert r[c] == pytest.approx(want[r.target][c], rel=1e-7, abs=1e-7), (r.target, c)


@pytest.mark.parametrize("mismatch", [0.3, 0.9, 1.5])
@pytest.mark.parametrize("least", [0, 40])
def test_correction_in_rows_is_the_one_by_pairs(spark, monkeypatch, mismatch, least):
    """Meetings from unique reads alone keep what those from a table of pairs keep; with least, some pairs are held back."""
    rng = random.Random(11)
    found = []
    for q in range(300):
        for t in rng.sample("abcdefghij", rng.choice([1, 2, 3, 5, 8])):
            found.append((q, t, rng.choice([0.6, 0.7, 0.8]), True))
    df = spark.createDataFrame(found, "query long, target string, q_cov double, is_first boolean")
    df = df.join(df.groupBy("query").agg(F.count("*").alias("n_targets")), "query")
    totals = spark.createDataFrame([(t, float(rng.choice([least + 5, 300])), float(i % 4 * 10 + 5)) for i, t in enumerate("abcdefghij")], "target string, sum_match double, uniq double")
    p = mode(3, dominance=0.05, mismatch=mismatch)
    pairs = profile.cooccurrence(df)
    held = {tuple(h) for h in profile.held_back(totals, pairs, p).collect()}
    assert held
    want = sorted(map(tuple, profile.corrected(df, profile.dominated(totals, pairs, p)).select("query", "target").collect()))
    got = sorted(map(tuple, profile.corrected_in_rows(df, totals, held, p).select("query", "target").collect()))
    assert got == want and len(got) < len(found)
