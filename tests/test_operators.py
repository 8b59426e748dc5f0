import random
import statistics

import pytest
from pyspark.sql import functions as F

from seqloom.functions import rates
from seqloom.functions.hashing import max_hash
from seqloom.operators import bloom, dna, profile, search, sketch, split, taxonomy
from seqloom.operators import matches as M
from seqloom.operators import regions as R
from seqloom.plans.modes import PRESETS, mode
from seqloom.streaming import search_stream


def letters(alphabet, n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


def values(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("n", "h", "m", "want"), [(145, 1, 6395, 0.022419), (208, 1, 6395, 0.032002), (207084, 1, 2089979, 0.094334), (745638, 1, 2599648, 0.249355)])
def test_bloom_fpr(spark, n, h, m, want):
    assert values(spark, rates.bloom_fpr(F.lit(float(n)), h, F.lit(float(m)))) == pytest.approx(want, abs=5e-7)


@pytest.mark.parametrize(("n", "h", "p", "want"), [(300000, 1, 0.25, 1042818), (300000, 1, 0.3, 841102), (1000, 3, 0.01, 12365)])
def test_signature_size(spark, n, h, p, want):
    assert values(spark, rates.signature_size(F.lit(float(n)), h, p)) == want


@pytest.mark.parametrize(("n", "k", "want"), [(70, 35, 1.4322e-4), (130, 72, 5.2969e-10), (100, 55, 5.8505e-8), (10, 5, 4.7349e-2)])
def test_query_fpr(spark, n, k, want):
    assert values(spark, rates.query_fpr(F.lit(n), F.lit(k), 0.3)) == pytest.approx(want, rel=1e-4)


def test_query_fpr_is_monotone_and_survives_underflow(spark):
    got = [values(spark, rates.query_fpr(F.lit(60), F.lit(k), 0.3)) for k in range(0, 60, 6)]
    assert got == sorted(got, reverse=True)
    assert values(spark, rates.query_fpr(F.lit(5000), F.lit(3000), 0.3)) == 0.0


@pytest.mark.parametrize(("q", "want"), [(0.3, 93.596055), (0.55, 96.542777), (0.75, 97.974234), (1.0, 99.183)])
def test_similarity(spark, q, want):
    assert values(spark, rates.cov_to_similarity(F.lit(q))) == pytest.approx(want, abs=1e-6)


def test_functions_work_from_sql(spark):
    rates.register(spark)
    row = spark.sql("SELECT signature_size(300000, 1, 0.3D) s, round(query_fpr(70, 35, 0.3D), 7) f, kmers('ACGTA', 3) k, reverse_complement('AACG') r, round(cov_to_similarity(1D), 3) c, bloom_fpr(145, 1, 6395) b").first()
    assert (row.s, row.f, row.k, row.r, row.c) == (841102, 0.0001432, ["ACG", "CGT", "GTA"], "CGTT", 99.183)


def test_byte_sizes():
    assert [rates.byte_size(x) for x in ("10M", "100K", "7", "1.5G", "2kb")] == [10_000_000, 100_000, 7, 1_500_000_000, 2000]


def test_kmers_across_strides(spark):
    s = letters("abcé", 700, 0)
    for k, stride in ((5, 256), (21, 64), (3, 1)):
        got = values(spark, sketch.kmer_array(F.lit(s), k, "text", stride))
        assert got == [s[i : i + k] for i in range(len(s) - k + 1)]
    assert values(spark, sketch.kmer_array(F.lit("ab"), 3, "text")) == []


def test_chunks_by_number_and_size(spark):
    df = spark.createDataFrame([("r", "a" * 1000), ("s", "b" * 20), ("t", "")], "ref_id string, seq string")
    got = sketch.chunks(df, 21, number=10, overlap=20).filter("ref_id = 'r'").orderBy("chunk_idx").collect()
    assert len(got) == 10 and len(got[0].seq) == 118 and got[1].begin == 98 and got[0].chunks == 10
    assert sketch.chunks(df, 21, number=10).filter("ref_id <> 'r'").count() == 0
    assert sketch.chunks(df, 20).filter("ref_id = 's'").count() == 1
    with pytest.raises(ValueError, match="not both"):
        sketch.chunks(df, 21, number=2, size=100)
    with pytest.raises(ValueError, match="exceed"):
        sketch.chunks(df, 21, size=25, overlap=30)


def test_fracminhash_is_nested(spark):
    df = spark.createDataFrame([("r", letters("acgt", 3000, 1))], "ref_id string, seq string")
    sets = {s: set(sketch.kmer_sets(df, 15, "md5", s, keep=("ref_id",)).first().kmers) for s in (1, 5, 50)}
    assert sets[50] < sets[5] < sets[1] and max(sets[50]) <= max_hash(50)


def test_query_kmers_dedup_and_length(spark):
    df = spark.createDataFrame([("a", "ab" * 20), ("b", "ab" * 200), ("c", "ab")], "query string, seq string")
    got = {r.query: r.q_kmers for r in sketch.query_kmers(df, 4, min_len=10).collect()}
    assert got == {"a": 37, "b": 2, "c": 0}


def community(seed=4, size=5000):
    rng = random.Random(seed)
    g = {n: "".join(rng.choice("ACGT") for _ in range(size)) for n in "ABCD"}
    g["B"] = g["A"][: size * 6 // 10] + g["B"][size * 6 // 10 :]
    reads = []
    for name, depth in (("A", 4), ("B", 2), ("C", 1)):
        reads += [g[name][i : i + 100] for i in range(0, size - 99, 100 // depth)]
    return g, reads


def test_planted_community(spark):
    genomes, reads = community()
    refs = spark.createDataFrame(list(genomes.items()), "target string, seq string")
    chunked = sketch.chunks(refs, 21, number=10, overlap=20, id_col="target")
    queries = spark.createDataFrame([(i, r) for i, r in enumerate(reads)], "query long, seq string")
    found = search.search(queries, chunked.select("target", "chunk_idx", "seq"), 21)
    found = found.withColumns({"chunks": F.lit(10)}).select("query", "target", "chunk_idx", "chunks", "q_len", "q_cov", "fpr").withColumn("line", F.lit(1))
    sizes = refs.select("target", F.length("seq").cast("long").alias("size"))
    p = mode(3, min_reads=1, min_uniq=3, min_hic=1, hic_cov=0.75, max_depth_sd=3, level="strain")
    got = {r.target: r.percentage for r in profile.profile(found, None, sizes, p).collect()}
    assert set(got) == {"A", "B", "C"} and sum(got.values()) == pytest.approx(100)
    assert got["A"] == pytest.approx(57, abs=8) and got["B"] == pytest.approx(29, abs=8) and got["C"] == pytest.approx(14, abs=5)


def test_exact_search_lies_within_bloom_search(spark):
    genomes, reads = community(9, 2000)
    refs = spark.createDataFrame([(n, 0, s) for n, s in genomes.items()], "target string, chunk_idx int, seq string")
    q = sketch.query_kmers(spark.createDataFrame([(i, r) for i, r in enumerate(reads[:30])], "query long, seq string"), 15, "md5")
    sets = sketch.kmer_sets(refs, 15, "md5", keep=("target", "chunk_idx"))
    exact = {(r.query, r.target): r.m_kmers for r in search.matches(q, sets).collect()}
    for h in (1, 3):
        packed = bloom.pack(sets, 8, fpr=0.05, num_hash=h)
        near = {(r.query, r.target): r.m_kmers for r in bloom.search(q, bloom.bit_matrix(sets, packed, h), packed, h).collect()}
        assert all(near.get(k, 0) >= v for k, v in exact.items()) and near
    by_shuffle = {(r.query, r.target): r.m_kmers for r in search.matches(q, sets, broadcast_kmers=1).collect()}
    assert by_shuffle == exact


def test_merge_of_halves_equals_the_whole(spark):
    genomes, reads = community(2, 1500)
    refs = spark.createDataFrame([(n, 0, s) for n, s in genomes.items()], "target string, chunk_idx int, seq string")
    q = spark.createDataFrame([(i, r) for i, r in enumerate(reads[:20])], "query long, seq string")
    whole = search.ranked(search.search(q, refs, 21))
    halves = search.merge_databases([search.search(q, refs.filter(c), 21) for c in ("target < 'C'", "target >= 'C'")])
    cols = ["query", "target", "m_kmers", "hits", "rank"]
    assert sorted(map(tuple, whole.select(cols).collect())) == sorted(map(tuple, halves.select(cols).collect()))
    clash = whole.withColumn("query_idx", F.lit(0).cast("long"))
    with pytest.raises(ValueError, match="different queries"):
        search.merge_databases([clash, clash.withColumn("query", F.col("query") + 1000)], check=True)


def rows(spark, data):
    return spark.createDataFrame([(q, t, 0, 10, 100, c, 0.0, i) for i, (q, t, c) in enumerate(data)], "query long, target string, chunk_idx int, chunks int, q_len int, q_cov double, fpr double, line int")


def test_prefix_filters(spark):
    df = rows(spark, [(1, "a", 1.0), (1, "b", 1.0), (1, "c", 0.98), (2, "a", 0.9), (2, "b", 0.45), (2, "c", 0.44), (3, "a", 0.8), (3, "b", 0.8), (3, "c", 0.7), (3, "d", 0.6)])
    kept = lambda **o: sorted((r.query, r.target) for r in M.prefix(df, **o).collect())
    assert [k for k in kept(perfect=True) if k[0] == 1] == [(1, "a"), (1, "b")]
    assert [k for k in kept(main_gap=0.4) if k[0] == 2] == [(2, "a")]
    assert [k for k in kept(top_n=2) if k[0] == 3] == [(3, "a"), (3, "b"), (3, "c")]
    assert len(kept()) == 10
    assert {r.q_cov for r in M.refilter(df, 0.8).collect()} == {1.0, 0.98, 0.9, 0.8}


NODES = [(1, 1, "no rank"), (2, 1, "superkingdom"), (3, 2, "genus"), (4, 3, "no rank"), (5, 4, "species"), (6, 5, "strain"), (7, 5, "strain"), (8, 3, "species"), (9, 8, "strain"), (10, 2, "genus"), (11, 10, "species"), (12, 1, "superkingdom")]


@pytest.fixture(scope="module")
def tree(spark):
    nodes = spark.createDataFrame(NODES, "taxid long, parent long, rank string")
    return taxonomy.closure(nodes).cache()


def ancestors(t):
    up = {a: p for a, p, _ in NODES}
    out = [t]
    while up[out[-1]] != out[-1]:
        out.append(up[out[-1]])
    return out


def test_closure_and_lca(spark, tree):
    got = {(r.taxid, r.ancestor, r.depth) for r in tree.collect()}
    assert got == {(t, a, len(ancestors(a)) - 1) for t, _, _ in NODES for a in ancestors(t)}
    ids = [t for t, _, _ in NODES]
    members = [(f"{a}-{b}", x) for a in ids for b in ids for x in (a, b)]
    got = {r.k: r.lca for r in taxonomy.lca(spark.createDataFrame(members, "k string, taxid long"), tree, "k").collect()}
    assert all(got[f"{a}-{b}"] == next(x for x in ancestors(a) if x in ancestors(b)) for a in ids for b in ids)


def test_merged_deleted_and_specific(spark, tree):
    ids = spark.createDataFrame([(99,), (6,), (13,)], "taxid long")
    merged, deleted = spark.createDataFrame([(99, 7)], "old long, new long"), spark.createDataFrame([(13,)], "taxid long")
    assert sorted(r.taxid for r in taxonomy.current(ids, merged, deleted).collect()) == [6, 7]
    df = rows(spark, [(1, "a", 0.9), (2, "a", 0.9), (2, "b", 0.8), (3, "a", 0.9), (3, "c", 0.8)])
    ids = spark.createDataFrame([("a", 6), ("b", 7), ("c", 9)], "target string, taxid long")
    assert {r.query for r in taxonomy.specific(df, ids, tree).collect()} == {1, 2}
    assert {r.query for r in taxonomy.specific(df, ids, tree, "strain").collect()} == {1}
    with pytest.raises(Exception, match="no taxid"):
        taxonomy.with_taxids(df, ids.filter("target <> 'c'")).collect()
    up = {r.taxid: r.percentage for r in taxonomy.rolled_up(spark.createDataFrame([(6, 60.0), (9, 40.0)], "taxid long, percentage double"), tree).collect()}
    assert up[1] == up[2] == up[3] == 100 and up[5] == 60


def fold_regions(items, min_overlap=1, max_gap=0, ignore=False):
    out, prev = [], None
    for ref, b, e, kind, s in items:
        if prev and ref == prev[0] and b + min_overlap - 1 <= prev[2] and (ignore or kind == cur[3]) and (not max_gap or b - prev[1] <= max_gap):
            cur[2] = e
            if cur[3] != kind:
                cur[3] = R.SPECIES
            if cur[3] == R.SPECIES:
                cur[4] = (cur[4] + s) / 2
        else:
            if prev:
                out.append(tuple(cur))
            cur = [ref, b - 1, e, kind, s]
        prev = (ref, b, e)
    return [*out, tuple(cur)]


@pytest.mark.parametrize("options", [{}, {"ignore": True}, {"max_gap": 60}, {"min_overlap": 30, "ignore": True}])
def test_regions_equal_the_sequential_fold(spark, options):
    rng = random.Random(6)
    items = sorted({(f"r{rng.randint(0, 2)}", b, b + 99, rng.choice([R.SPECIES, R.ASSEMBLY]), round(rng.random(), 4)) for b in (1 + 20 * rng.randint(0, 200) for _ in range(150))})
    items = [x for i, x in enumerate(items) if i == 0 or items[i - 1][:2] != x[:2]]
    df = spark.createDataFrame(items, "ref string, begin int, end int, type string, score double")
    got = R.merge(df, options.get("max_gap", 0), options.get("min_overlap", 1), options.get("ignore", False)).collect()
    want = fold_regions(items, **options)
    assert sorted(tuple(r)[:4] for r in got) == sorted(w[:4] for w in want)
    assert sorted(r.score for r in got) == pytest.approx(sorted(w[4] for w in want))
    assert R.bed(R.merge(df)).columns == ["ref", "begin", "end", "type", "score", "strand"]


def test_region_names(spark):
    df = rows(spark, [(1, "a", 0.9)]).withColumn("query", F.lit("chr1_sliding:11-110"))
    assert tuple(R.windows(df).first()) == ("chr1", 11, 110, R.ASSEMBLY, 0.9)
    with pytest.raises(Exception, match="no region"):
        R.windows(df.withColumn("query", F.lit("x"))).collect()


def test_depth_deviation_counts_empty_chunks(spark):
    df = spark.createDataFrame([("t", 0, 4, 3.0, 30.0, 3.0, 3.0), ("t", 2, 4, 1.0, 10.0, 1.0, 1.0)], "target string, chunk_idx int, chunks int, reads double, bases double, uniq double, hic double")
    sizes = spark.createDataFrame([("t", 100)], "target string, size long")
    got = profile.targets_of(df, sizes, PRESETS[0]).first()
    assert got.depth_sd == pytest.approx(statistics.pstdev([3, 0, 1, 0])) and got.coverage == 0.4 and got.chunks_frac == 0.5
    assert profile.targets_of(df, sizes, PRESETS[0].but(norm="min")).first().coverage == 0.4
    assert profile.targets_of(df, sizes, PRESETS[0].but(norm="max")).first().coverage == 1.2
    assert {r.reason for r in profile.failures(profile.targets_of(df, sizes, PRESETS[3]), PRESETS[3], "em").collect()} == {"uniq", "hic", "chunks_frac"}


def brute_corrected(queries, lost):
    """What stays of each query: targets by coverage, one meeting after the other."""
    out = set()
    for q, targets in queries.items():
        line = sorted(targets, key=lambda t: (-targets[t], t))
        gone = set()
        for x in line:
            if x in gone:
                continue
            for y in line[line.index(x) + 1 :]:
                if y not in gone:
                    if (y, x) in lost:
                        gone.add(y)
                    elif (x, y) in lost:
                        gone.add(x)
        out |= {(q, t) for t in targets if t not in gone}
    return out


def test_correction_goes_target_by_target(spark):
    df = rows(spark, [(q, t, c) for q in range(5) for t, c in (("a", 0.9), ("b", 0.8), ("c", 0.7))])
    lost = spark.createDataFrame([("b", "a"), ("c", "b")], "loser string, winner string")
    assert {r.target for r in profile.corrected(df, lost).collect()} == {"a", "c"}
    rng = random.Random(8)
    names = list("abcdefgh")
    for share in (0.1, 0.5):
        pairs = [(x, y) for x in names for y in names if x != y and rng.random() < share]
        queries = {q: {t: rng.choice([0.6, 0.7, 0.8, 0.9]) for t in rng.sample(names, rng.randint(1, 8))} for q in range(150)}
        df = rows(spark, [(q, t, c) for q, ts in queries.items() for t, c in ts.items()])
        got = profile.corrected(df, spark.createDataFrame(pairs, "loser string, winner string")).collect()
        assert {(r.query, r.target) for r in got} == brute_corrected(queries, set(pairs))
    assert profile.corrected(df, lost.limit(0)).count() == df.count()


def test_cooccurrence_counts_equal_target_sets_once(spark):
    queries = [{"a", "b", "c"}] * 40 + [{"a", "b"}] * 3 + [{"c"}] + [{"b", "d"}]
    df = rows(spark, [(q, t, 0.9) for q, ts in enumerate(queries) for t in sorted(ts)])
    marked = profile.annotated(df, None, mode(3))
    got = {(r.a, r.b): r.shared for r in profile.cooccurrence(marked).collect()}
    assert got == {("a", "b"): 43, ("a", "c"): 40, ("b", "c"): 40, ("b", "d"): 1}


def test_bloom_search_of_many_blocks(spark):
    """5,000 blocks of one slot: no block is a literal of the plan, and no row is made for a k-mer and a block."""
    rng = random.Random(5)
    refs = [(i, 0, [rng.randrange(1, 1 << 60) for _ in range(12)]) for i in range(5000)]
    sets = spark.createDataFrame([(t, c, 12, k) for t, c, k in refs], "target long, chunk_idx int, n_kmers long, kmers array<long>")
    packed = spark.createDataFrame([(t, 0, 12, 0, f"0_{t}", 0, 200) for t, _, _ in refs], "target long, chunk_idx int, n_kmers long, regime int, block string, slot int, num_sigs long")
    queries = [("x", refs[17][2]), ("y", refs[4000][2][:6] + refs[18][2][:6])]
    q = spark.createDataFrame([(n, 50, len(k), k) for n, k in queries], "query string, q_len int, q_kmers int, kmers array<long>")
    bits = {t: {x % 200 for x in k} for t, _, k in refs}
    want = {(n, t, m) for n, k in queries for t in bits if (m := sum(x % 200 in bits[t] for x in k)) >= 4}
    for matrix in (bloom.bit_matrix(sets, packed), bloom.dense_rows(bloom.bit_matrix(sets, packed)), bloom.filled(sets, packed)):
        found = bloom.search(q, matrix, packed, min_kmers=4)
        assert "0_4000" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = found.collect()
        assert {(r.query, r.target, r.m_kmers) for r in got} == want and len(got) == len(want)
    grouped = bloom.search(q, bloom.bit_matrix(sets, packed), packed, min_kmers=4, query_kmers=13)
    assert {(r.query, r.target, r.m_kmers) for r in grouped.collect()} == want


def test_bloom_words_hold_64_slots(spark):
    sets = spark.createDataFrame([(i, 0, 40, [(i * 977 + j * 31) % 5000 + 1 for j in range(40)]) for i in range(150)], "target long, chunk_idx int, n_kmers long, kmers array<long>")
    packed = bloom.pack(sets, 150, num_hash=2)
    assert packed.select("block").distinct().count() == 1
    matrix = bloom.bit_matrix(sets, packed, 2)
    q = spark.createDataFrame([(i, 60, 40, [(i * 977 + j * 31) % 5000 + 1 for j in range(40)]) for i in (0, 63, 64, 149)], "query long, q_len int, q_kmers int, kmers array<long>")
    got = {(r.query, r.target): r.m_kmers for r in bloom.search(q, matrix, packed, 2, min_kmers=40).collect()}
    assert all(got[i, i] == 40 for i in (0, 63, 64, 149))
    words = bloom.dense(bloom.filled(sets, packed), packed, 2)
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, bloom.dense_rows(matrix).collect()))
    assert {(r.query, r.target): r.m_kmers for r in bloom.search(q, words, packed, 2, min_kmers=40).collect()} == got
    assert sorted(map(tuple, bloom.bits_of(bloom.dense_rows(matrix)).collect())) == sorted(map(tuple, matrix.select("block", "loc", "slot").distinct().collect()))


def test_both_strands_have_the_same_sketch(spark):
    s = letters("ACGT", 400, 11) + "N" + letters("acgt", 300, 12)
    back = s.upper().translate(str.maketrans("ACGT", "TGCA"))[::-1]
    df = spark.createDataFrame([("s", s), ("t", back)], "target string, seq string")
    for o in ({}, {"minimizer_w": 7}, {"syncmer_s": 11}, {"kind": "nt"}, {"kind": "nt", "scale": 4}, {"scale": 5}, {"kind": "roll"}, {"ks": (15, 33)}):
        made = sketch.Settings(**({"ks": (21,), "canonical": True} | o))
        a, b = (set(r.kmers) for r in sketch.sets_of(df, made, ("target",)).orderBy("target").collect())
        assert a == b and a, o
        q = {r.query: set(r.kmers) for r in sketch.query_sets(df.withColumnRenamed("target", "query"), made, made.ks[0]).collect()}
        assert q["s"] == q["t"] and q["s"] <= a
    ring = sketch.sets_of(df.filter("target = 's'"), sketch.Settings((21,), "md5", True), ("target",), circular=True).first()
    assert ring.n_kmers == 380 + 280 + 20  # the 20 windows across the end; none across the N


def test_canonical_kmers_are_the_lesser_texts(spark):
    s = letters("ACGTN", 300, 3) + "ac"
    rc = lambda x: x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    df = spark.createDataFrame([("s", s)], "ref_id string, seq string")
    for k, circular in ((5, False), (35, False), (5, True)):
        u = s.upper() + (s.upper()[: k - 1] if circular else "")
        want = [(i, min(u[i : i + k], rc(u[i : i + k]))) for i in range(len(u) - k + 1) if set(u[i : i + k]) <= set("ACGT")]
        assert sorted((r.pos, r.kmer) for r in sketch.canonical_kmers(df, k, circular).collect()) == want


def test_the_last_map_counts_and_missing_names_stay(spark):
    maps = spark.createDataFrame([("a", "A1", 0, 0), ("a", "A2", 1, 0), ("b", "B1", 0, 1), ("b", "B0", 0, 0)], "key string, value string, file int, line int")
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "target string")
    assert {r.target: r.name for r in M.named(df, M.latest(maps)).collect()} == {"a": "A2", "b": "B1", "c": "c"}


def test_closure_of_tall_trees_and_cycles(spark):
    tall = spark.createDataFrame([(i, max(i - 1, 0), "x") for i in range(300)], "taxid long, parent long, rank string")
    got = taxonomy.closure(tall)
    assert got.count() == 300 * 301 // 2 and got.filter("taxid = 299 and ancestor = 0").first().depth == 0
    ring = spark.createDataFrame([(0, 0, "x"), (1, 3, "x"), (2, 1, "x"), (3, 2, "x")], "taxid long, parent long, rank string")
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.closure(ring)


def test_table_functions(spark):
    from seqloom.functions import tables

    tables.register(spark)
    s = letters("acgt", 200, 2)
    df = spark.createDataFrame([("r", s)], "ref_id string, seq string")
    want = {(r.pos, r.kmer) for r in sketch.minimizers(df, 15, 6).collect()}
    assert {(r.pos, r.kmer) for r in spark.sql(f"SELECT * FROM minimizers('{s}', 15, 6)").collect()} == want
    want = {(r.pos, r.kmer) for r in sketch.syncmers(df, 15, 8).collect()}
    assert {(r.pos, r.kmer) for r in spark.sql(f"SELECT * FROM syncmers('{s}', 15, 8)").collect()} == want


def test_rates_are_looked_up(spark):
    df = spark.createDataFrame([(70, 35), (130, 72), (70, 35), (5000, 3000)], "n int, k int")
    got = [r.x for r in df.select(search.rate_of(0.3)("n", "k").alias("x")).collect()]
    want = [r.x for r in df.select(rates.query_fpr(F.col("n"), F.col("k"), 0.3).alias("x")).collect()]
    assert got == pytest.approx(want, abs=1e-12)


def test_fragments(spark):
    s = letters("ACGT", 1200, 3)
    ref = spark.createDataFrame([("g", s)], "ref_id string, seq string")
    other = spark.createDataFrame([("g", s[:150] + "T" * 40 + s[900:960] + "T" * 300)], "ref_id string, seq string")
    frags = split.fragments(other, 21)
    got = split.assign_fragments(sketch.chunks(ref, 21, number=4, overlap=20), frags, 21, all_if_none=True).collect()
    assert {r.chunk_idx for r in got if r.m_kmers > 0} <= {0, 3} and sum(r.m_kmers == 0 for r in got) % 4 == 0
    names = spark.createDataFrame([("X.2.fasta.gz",), ("y.kset",), ("z.fq",)], "n string")
    assert [r.x for r in names.select(split.trim_extension(F.col("n")).alias("x")).collect()] == ["X.2", "y", "z"]


def test_numbering_is_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = sketch.numbered(df, ["v"]).collect()
    assert all(r.v == r.query_idx for r in got) and len(got) == 1000


def test_stream_equals_batch(spark, tmp_path):
    genomes, reads = community(12, 1500)
    refs = spark.createDataFrame([(n, 0, s) for n, s in genomes.items()], "target string, chunk_idx int, seq string")
    sets = sketch.kmer_sets(refs, 21, keep=("target", "chunk_idx"))
    q = spark.createDataFrame([(i, r) for i, r in enumerate(reads[:24])], "query long, seq string")
    q.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    search_stream.search_each_batch(stream, sets, 21, lambda df, n: out.extend(df.select("query", "target", "m_kmers", "hits").collect()), str(tmp_path / "cp")).awaitTermination()
    want = search.search(q, refs, 21).select("query", "target", "m_kmers", "hits").collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, want)) and want


def test_rolling_hash_is_rolling():
    s = b"ACGTTGCAAC"
    _, whole = dna.nucleotide_hashes(s, 4)
    assert whole.tolist() == [dna.nucleotide_hashes(s[i : i + 4], 4)[1][0] for i in range(7)]
    assert len(dna.nucleotide_hashes(b"ACG", 4)[1]) == 0
