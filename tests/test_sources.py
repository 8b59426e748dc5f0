import gzip

from pyspark.sql import functions as F

from seqloom.operators import bloom, dna, matches, sketch
from seqloom.sources import fastx, reports, tables


def write(path, text, pack=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    if pack:
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)


def test_fastx_reads_plain_gzip_and_fastq(spark, tmp_path):
    write(tmp_path / "in/a.fa", ">r1 first\nACG\nTAC\n>r2\n\n>plasmid x\nAAAA\n")
    write(tmp_path / "in/sub/b.fq.gz", "@q1 one\nACGT\n+\nIIII\n@q2\nAC\nGT\n+q2\nII\n@I\n", pack=True)
    write(tmp_path / "in/c.txt", ">no\nA\n")
    got = {(r.seq_id, r.name, r.seq, r.qual) for r in fastx.read_fastx(spark, str(tmp_path / "in"), name_filter=["PLASMID"]).collect()}
    assert got == {("r1", "r1 first", "ACGTAC", None), ("r2", "r2", "", None), ("q1", "q1 one", "ACGT", "IIII"), ("q2", "q2", "ACGT", "II@I")}
    fastx.register(spark)
    n = spark.read.format("fastx").load(str(tmp_path / "in")).count()
    assert n == 5


def test_match_file_round_trip(spark, tmp_path):
    rows = [("q", 100, 80, 0.00012345, 1, "t", 0, 1, 1000, 21, 60, 0.75, 0.01, 0.0123456, 0), ("p", 90, 70, 0.0, 1, "u", 2, 10, 2000, 21, 70, 1.0, 0.1, 0.1, 1)]
    cols = "query string, q_len int, q_kmers int, fpr double, hits int, target string, chunk_idx int, chunks int, t_len long, k_size int, m_kmers int, q_cov double, t_cov double, jacc double, query_idx long"
    tables.write_matches(spark.createDataFrame(rows, cols), str(tmp_path / "m"), 3, 2)
    back = tables.read_matches(spark, str(tmp_path / "m")).orderBy("query_idx").collect()
    assert [r.query for r in back] == ["q", "p"] and back[0].fpr == 1.2345e-4 and back[0].jacc == 0.0123 and back[1].t_len == 2000
    stats = {r.name: r.value for r in tables.read_stats(spark, str(tmp_path / "m")).collect()}
    assert stats == {"input queries": "3", "matched queries": "2", "matched percentage": "66.6667%"}


def test_maps_later_file_wins(spark, tmp_path):
    write(tmp_path / "a.tsv", "x\t1\ny\t2\n")
    write(tmp_path / "b.tsv", "x\t3\n")
    got = {r.key: r.value for r in tables.read_map(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")]).collect()}
    assert got == {"x": "3", "y": "2"}
    named = matches.named(spark.createDataFrame([("x",), ("z",)], "target string"), tables.read_map(spark, [str(tmp_path / "a.tsv")]))
    assert {(r.target, r.name) for r in named.collect()} == {("x", "1"), ("z", "z")}


def test_taxdump(spark, tmp_path):
    write(tmp_path / "t/nodes.dmp", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tspecies\t|\n")
    write(tmp_path / "t/names.dmp", "2\t|\tBug\t|\t\t|\tscientific name\t|\n2\t|\tOther\t|\t\t|\tsynonym\t|\n")
    t = tables.read_taxdump(spark, str(tmp_path / "t"))
    assert {(r.taxid, r.parent, r["rank"]) for r in t["nodes"].collect()} == {(1, 1, "no rank"), (2, 1, "species")}
    assert [r["name"] for r in t["names"].collect()] == ["Bug"] and t["merged"].isEmpty() and t["deleted"].isEmpty()


def test_database_round_trip_and_version(spark, tmp_path):
    refs = spark.createDataFrame([("a", 0, "the quick brown fox jumps over the lazy dog"), ("b", 0, "pack my box with five dozen liquor jugs")], "target string, chunk_idx int, seq string")
    sets = sketch.kmer_sets(refs, 5, "md5", keep=("target", "chunk_idx"))
    packed = bloom.pack(sets, 8)
    tables.write_database(str(tmp_path / "db"), sets, bloom.bit_matrix(sets, packed), packed, {"k": [5], "hash": "md5"})
    db = tables.read_database(spark, str(tmp_path / "db"))
    assert db["manifest"]["k"] == [5] and db["sets"].count() == 2 and db["bits"].count() > 10
    tables.check_same_settings([db, db])


def test_nucleotide_hashes_ignore_strand(spark):
    s = "ACGTTGCANACCGTTAGC"
    rc = s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    df = spark.createDataFrame([("f", s), ("r", rc), ("n", None)], "ref_id string, seq string")
    got = {r.ref_id: set(r.kmers) for r in dna.nucleotide_sets(df, 5).collect()}
    assert got["f"] == got["r"] and len(got["f"]) > 5 and got["n"] == set()


def test_report_files(spark, tmp_path):
    closed = spark.createDataFrame([(2, 2, "species", 1), (2, 1, "superkingdom", 0), (1, 1, "superkingdom", 0)], "taxid long, ancestor long, rank string, depth int")
    names = spark.createDataFrame([(1, "Top"), (2, "Bug")], "taxid long, name string")
    amounts = spark.createDataFrame([(2, 100.0)], "taxid long, percentage double")
    reports.write_cami(reports.cami(amounts, closed, names), str(tmp_path / "c"), "s1")
    lines = [r.value for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert lines[0] == "@SampleID:s1" and any(x.startswith("2\tspecies\t1|2\tTop|Bug\t100.0") for x in lines)
    clades = {r.clade_name for r in reports.metaphlan(amounts, closed, names).collect()}
    assert clades == {"k__Top", "k__Top|s__Bug"}
    fastx.write_chunks(spark.createDataFrame([("r", 0, "A" * 150)], "ref_id string, chunk_idx int, seq string"), str(tmp_path / "f"), gzip_files=False)
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "f")).select(F.col("value")).collect())
    assert text == ">r_chunk0\n" + "A" * 70 + "\n" + "A" * 70 + "\n" + "A" * 10


def test_large_files_are_read_by_lines(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">s{i} x\n{'ACGT' * 20}\n{'TTGA' * 5}\n" for i in range(3000)))
    (tmp_path / "b.fq").write_text("".join(f"@r{i}\nACGTN\n+\n@@III\n" for i in range(500)))
    key = lambda df: sorted((r.file.rsplit("/", 1)[-1], r.pos, r.seq_id, r.seq, r.qual) for r in df.collect())
    whole = key(fastx.read_fastx(spark, str(tmp_path)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert key(fastx.read_fastx(spark, str(tmp_path), whole_bytes=1000)) == whole and len(whole) == 3500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_list_files(spark, tmp_path):
    (tmp_path / "list").write_text("/a/b.fa\n\n /c.fa \n")
    assert tables.read_list(spark, str(tmp_path / "list")) == ["/a/b.fa", "/c.fa"]


def test_files_are_unpacked_by_their_first_bytes(spark, tmp_path):
    import bz2
    import lzma

    import zstandard

    text = b">r one\nACGT\n"
    for name, pack in (("a", gzip.compress), ("b", bz2.compress), ("c", lzma.compress), ("d", zstandard.ZstdCompressor().compress), ("e", bytes)):
        (tmp_path / f"{name}.fa").write_bytes(pack(text))
    assert [(r.seq_id, r.seq) for r in fastx.read_fastx(spark, str(tmp_path)).collect()] == [("r", "ACGT")] * 5
