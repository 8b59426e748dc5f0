import random

import pytest
from pyspark.sql import functions as F

from seqloom import api
from seqloom.operators import bloom
from seqloom.sources import fastx, tables


@pytest.fixture(scope="module")
def genomes():
    rng = random.Random(21)
    g = {n: "".join(rng.choice("ACGT") for _ in range(3000)) for n in "abc"}
    return g | {"b": g["a"][:1500] + g["b"][1500:]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory, genomes):
    d = tmp_path_factory.mktemp("genomes")
    for n, s in genomes.items():
        (d / f"{n}.fa").write_text(f">{n}1 chromosome\n{s[:2000]}\n>{n}2 chromosome\n{s[2000:]}\n>{n}p plasmid\n{'A' * 500}\n")
    return str(d)


@pytest.mark.parametrize("options", [{}, {"minimizer_w": 5}, {"syncmer_s": 12}, {"scale": 4}, {"k": (15, 21)}])
def test_sets_of_files(spark, folder, options):
    got = {r.target: r for r in api.compute(spark, folder, **{"k": 21, **options}, seq_name_filter=("plasmid",)).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].genome_size == 3000 and 0 < got["a"].n_kmers == len(got["a"].kmers)
    if not options:
        assert got["a"].n_kmers == 2000 - 20 + 1000 - 20  # none across the spacer
        plain = {r.target: r.n_kmers for r in api.compute(spark, folder, seq_name_filter=("plasmid",), canonical=False).collect()}
        assert plain["a"] == got["a"].n_kmers + 40  # letters like others there


def test_nt_sets_skip_spacers(spark, folder):
    got = {r.target: r.n_kmers for r in api.compute(spark, folder, seq_name_filter=("plasmid",), kind="nt").collect()}
    assert got["a"] == 1980 + 980


def test_from_files_to_profile(spark, folder, genomes, tmp_path):
    sets = api.compute(spark, folder, seq_name_filter=("plasmid",), split_number=5)
    info = api.index(sets, str(tmp_path / "db"), fpr=0.05, num_hash=1, k=[21], hash="md5", scale=1, scaled=False, minimizer_w=0, syncmer_s=0)
    assert info.agg(F.sum("names")).first()[0] == 15
    assert api.index(sets, "", dry_run=True).agg(F.sum("names")).first()[0] == 15
    reads = [(f"{n}{i}", genomes[n][i : i + 100]) for n, step in (("a", 50), ("c", 100)) for i in range(0, 1900, step)] + [("none", "".join(random.Random(5).choices("ACGT", k=100)))]
    queries = spark.createDataFrame(reads, "query string, seq string")
    near, exact = (api.search(spark, queries, str(tmp_path / "db"), exact=e) for e in (False, True))
    key = lambda df: {(r.query, r.target, r.chunk_idx) for r in df.collect()}
    assert key(exact) <= key(near) and len(key(exact)) > 50
    assert api.search(spark, queries, str(tmp_path / "db"), keep_unmatched=True).filter("query = 'none'").first().chunk_idx == -1
    both = api.search(spark, queries, [str(tmp_path / "db")] * 2, exact=True)
    assert key(both) == key(exact)
    assert {r.hits for r in api.merge([exact.filter("target = 'a'"), exact.filter("target <> 'a'")]).collect()} == {r.hits for r in exact.collect()}
    found = exact.withColumn("line", F.lit(0))
    sizes = sets.select("target", F.col("genome_size").alias("size")).distinct()
    nodes = spark.createDataFrame([(1, 1, "no rank"), (2, 1, "species"), (3, 1, "species"), (4, 1, "species")], "taxid long, parent long, rank string")
    names = spark.createDataFrame([(2, "A"), (3, "B"), (4, "C")], "taxid long, name string")
    ids = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "target string, taxid long")
    out = api.profile(found, sizes, ids, {"nodes": nodes, "names": names}, mode=3, min_reads=1, min_uniq=3, min_hic=1, min_chunks_frac=0.4, max_depth_sd=5)
    got = {r.target: r.percentage for r in out["profile"].collect()}
    assert set(got) == {"a", "c"} and got["a"] > got["c"]
    assert sum(r.percentage for r in out["cami"].collect()) == pytest.approx(100) and out["binning"].count() > 50
    assert api.filter_specific(found, ids, nodes).count() < found.count()
    api.density_image(bloom.density(bloom.bits_of(spark.read.parquet(str(tmp_path / "db/bits"))), spark.read.parquet(str(tmp_path / "db/slots")), 16), str(tmp_path / "x.pgm"), "a", 16)
    assert (tmp_path / "x.pgm").read_bytes().startswith(b"P5 16 1 255\n")


def reverse(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


@pytest.mark.parametrize("options", [{}, {"minimizer_w": 5}, {"syncmer_s": 15}, {"scale": 3}, {"kind": "nt"}, {"kind": "nt", "minimizer_w": 5}, {"k": (15, 21)}])
def test_databases_of_every_kind_find_both_strands(spark, folder, genomes, tmp_path, options):
    """Reads of either strand are searched as the manifest says; results are numbered, written and read again."""
    sets = api.compute(spark, folder, seq_name_filter=("plasmid",), **options)
    db = str(tmp_path / "all" / "db")
    api.index(sets, db, fpr=0.01, num_hash=2, **api.settings_of(**options).manifest())
    reads = [(f"{n}{i}", s) for n in "ac" for i in range(0, 1800, 300) for s in (genomes[n][i : i + 150], reverse(genomes[n][i : i + 150]))]
    queries = spark.createDataFrame([*reads, ("N", "N" * 150)], "query string, seq string")
    for exact in (True, False):
        got = api.search(spark, queries, str(tmp_path / "all"), exact=exact, min_kmers=3).collect()
        for n in "ac":
            assert sorted(r.query for r in got if r.target == n and r.query[0] == n and r.q_cov == 1) == sorted(q for q, _ in reads if q[0] == n)
        assert len({r.query_idx for r in got}) == 24 and not any(r.query == "N" for r in got)


def test_search_results_are_written_and_merged(spark, folder, genomes, tmp_path):
    sets = api.compute(spark, folder, seq_name_filter=("plasmid",))
    api.index(sets, str(tmp_path / "db"), fpr=0.05)
    reads = [("same", genomes["a"][i : i + 100]) for i in (0, 200)] + [("c1", genomes["c"][:100]), ("none", "ACGT" * 25)]
    queries = spark.createDataFrame(reads, "query string, seq string").withColumn("pos", F.monotonically_increasing_id())
    found = api.search(spark, queries, str(tmp_path / "db"), keep_unmatched=True)
    rows = found.collect()
    assert len({r.query_idx for r in rows}) == 4 and {r.query for r in rows} == {"same", "c1", "none"}
    lost = next(r for r in rows if r.query == "none")
    assert lost.chunk_idx == -1 and lost.q_len == 100 and lost.q_kmers == 80
    tables.write_matches(found, str(tmp_path / "out"), 4, 3)
    back = tables.read_matches(spark, str(tmp_path / "out")).collect()
    assert sorted((r.query, r.target, r.q_cov) for r in back) == sorted((r.query, r.target or None, r.q_cov) for r in rows) or len(back) == len(rows)
    assert {r.name: r.value for r in tables.read_stats(spark, str(tmp_path / "out")).collect()}["matched queries"] == "3"
    kept = found.filter("chunk_idx >= 0")
    assert api.merge([kept.filter("target = 'a'"), kept.filter("target <> 'a'")]).count() == kept.count()
    with pytest.raises(ValueError, match="twice"):
        api.merge([kept, kept])
    with pytest.raises(ValueError, match="different queries"):
        api.merge([kept, kept.withColumn("query", F.concat("query", F.lit("x")))])


def test_whole_files_and_their_names(spark, folder, genomes, tmp_path):
    api.index(api.compute(spark, folder, seq_name_filter=("plasmid",)), str(tmp_path / "db"), fpr=0.05)
    records = fastx.read_fastx(spark, folder, name_filter=["plasmid"])
    search = lambda **o: {r.query: r for r in api.search(spark, records, str(tmp_path / "db"), whole_file=True, exact=True, min_query_cov=0.9, **o).collect()}
    assert set(search()) == {"a1", "b1", "c1"} and set(search(use_filename=True)) == {"a", "b", "c"}
    only = api.search(spark, records.filter(F.col("file").endswith("a.fa")), str(tmp_path / "db"), whole_file=True, exact=True, min_query_cov=0.9, query_id="mine").collect()
    assert {r.query for r in only} == {"mine"} and only[0].q_cov == 1 and only[0].q_len == 3020


def test_circular(spark, tmp_path):
    rng = random.Random(2)
    s = "".join(rng.choice("ACGT") for _ in range(2000))
    (tmp_path / "one.fa").write_text(f">x\n{s}\n")
    (tmp_path / "two.fa").write_text(f">x\n{s[:1000]}\n>y\n{s[1000:]}\n")
    n = lambda **o: {(r.target, r.chunk_idx): r.n_kmers for r in api.compute(spark, str(tmp_path), **o).collect()}
    assert n() == {("one", 0): 1980, ("two", 0): 1960} and n(circular=True)["one", 0] == 2000
    cut, ring = n(split_number=4, split_overlap=20), n(split_number=4, split_overlap=20, circular=True)
    assert ring["two", 0] == cut["two", 0] and sum(v for (t, _), v in ring.items() if t == "one") > sum(v for (t, _), v in cut.items() if t == "one")


def test_profile_tells_failures_and_counts(spark):
    data = [(i, "a", i % 5, 5, 100, 0.9, 0.0, 0) for i in range(100)] + [(200 + i, "b", 0, 5, 100, 0.9, 0.0, 0) for i in range(30)]
    found = spark.createDataFrame(data, "query long, target string, chunk_idx int, chunks int, q_len int, q_cov double, fpr double, line int")
    sizes = spark.createDataFrame([("a", 1000), ("b", 1000)], "target string, size long")
    out = api.profile(found, sizes, mode=3, min_reads=1, min_uniq=3, min_hic=1, min_chunks_frac=0.1, max_depth_sd=1)
    assert [r.target for r in out["profile"].collect()] == ["a"]
    assert [tuple(r)[:3] for r in out["failures"].collect()] == [("b", "stage 3", "depth_sd")]
    s = out["stats"].first()
    assert (s.matched_reads, s.assigned_reads) == (130, 100) and s.assigned_pct == pytest.approx(100 / 1.3)


def test_lists_of_inputs(spark, folder, tmp_path):
    (tmp_path / "list").write_text(f"{folder}/a.fa\n{folder}/c.fa\n")
    assert {r.target for r in api.compute(spark, "", infile_list=str(tmp_path / "list")).collect()} == {"a", "c"}
    with pytest.raises(ValueError, match="twice"):
        api.compute(spark, f"{folder}/a.fa", infile_list=str(tmp_path / "list"))


def test_no_database(spark, tmp_path):
    with pytest.raises(ValueError, match="no database"):
        api.search(spark, spark.createDataFrame([("q", "ACGT")], "query string, seq string"), str(tmp_path))


def test_split_genomes(spark, folder, tmp_path):
    chunked, assigned = api.split_genomes(spark, folder, split_number=4, seq_name_filter=("plasmid",))
    assert chunked.count() == 4 and assigned.filter("m_kmers > 0").count() >= 0
    fastx.write_fragments(assigned, str(tmp_path / "info"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "info")).collect()]
    assert "file\tseqId\tmKmers\tchunkId\tfragLoc" in lines and len([x for x in lines if not x.startswith("file\t")]) == assigned.count()
    assert api.version()


def test_wrong_flags(spark):
    with pytest.raises(ValueError, match="not both"):
        api.compute(spark, "x", minimizer_w=5, syncmer_s=3)
    with pytest.raises(ValueError, match="twice"):
        api.compute(spark, ["x", "x"])
