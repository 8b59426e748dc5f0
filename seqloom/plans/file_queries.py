"""Queries that go through files: databases, result files, taxonomy dumps, sequences and reports, written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom import api
from seqloom.operators import regions as R
from seqloom.operators import search, sketch
from seqloom.operators import taxonomy as T
from seqloom.plans import inputs as I
from seqloom.plans import profile_queries as PQ
from seqloom.plans import search_queries as SQ
from seqloom.plans.inputs import K, kmers_sql
from seqloom.session import shared_folder
from seqloom.sources import fastx, reports, tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE_SQL[name] = fn, sql
        return fn

    return add


@query("database_search", SQ.ORACLE_SQL["search_canonical"])
def database_search(spark, d):
    """compute, index and search: documents as DNA in a database folder, benchmark texts of the other strand as queries."""
    text = F.col("ref_id").cast("string")
    records = SQ.dna(spark, d).select(F.lit("documents").alias("file"), F.col("ref_id").alias("pos"), text.alias("seq_id"), text.alias("name"), "seq")
    place = shared_folder(spark, "database")
    api.index(api.compute(spark, records, k=K, by_seq=True, texts=True), f"{place}/one", **api.settings_of(K).manifest())
    queries = SQ._reversed_queries(spark, d).withColumn("pos", F.col("query"))
    found = api.search(spark, queries, place, min_kmers=5, exact=True)
    return SQ.shaped(found.withColumn("target", F.col("target").cast("long")))


@query("search_min_query_len", f"{SQ.BASE_SQL} SELECT {SQ.OUT_SQL}, {SQ.HITS_SQL} FROM found WHERE q_len >= 280")
def search_min_query_len(spark, d):
    return SQ.shaped(search.search(I.queries(spark, d), I.refs(spark, d), K, min_query_len=280))


FILE_SQL = "CAST(l_orderkey AS VARCHAR) AS query, CAST(l_suppkey AS VARCHAR) AS target, CAST(l_partkey % 10 AS INTEGER) AS chunk_idx, CAST(l_linenumber AS INTEGER) AS m_kmers, round(0.5::DOUBLE + 4 * l_discount + 1.25::DOUBLE * l_tax, 4) AS q_cov, CAST(l_tax AS DOUBLE) AS t_cov, CAST(l_discount AS DOUBLE) AS jacc, CAST(l_orderkey AS BIGINT) AS query_idx"


def _result_file(spark, d):
    m = I.table(spark, d, "lineitem")
    found = m.select(
        F.col("l_orderkey").cast("string").alias("query"), (50 + F.col("l_quantity").cast("int")).alias("q_len"), (30 + F.col("l_quantity").cast("int")).alias("q_kmers"), F.lit(0.0).alias("fpr"), F.lit(1).alias("hits"),
        F.col("l_suppkey").cast("string").alias("target"), (F.col("l_partkey") % 10).cast("int").alias("chunk_idx"), F.lit(10).alias("chunks"), F.lit(1000).alias("t_len"), F.lit(K).alias("k_size"), F.col("l_linenumber").cast("int").alias("m_kmers"),
        F.round(0.5 + 4 * F.col("l_discount") + 1.25 * F.col("l_tax"), 4).alias("q_cov"), F.col("l_tax").cast("double").alias("t_cov"), F.col("l_discount").cast("double").alias("jacc"), F.col("l_orderkey").cast("long").alias("query_idx"),
    )
    place = shared_folder(spark, "results")
    n = m.select("l_orderkey").distinct().count()
    tables.write_matches(found, place, 2 * n, n)
    return place


@query("result_file_round_trip", f"SELECT {FILE_SQL} FROM lineitem")
def result_file_round_trip(spark, d):
    return tables.read_matches(spark, _result_file(spark, d)).select("query", "target", "chunk_idx", "m_kmers", "q_cov", "t_cov", "jacc", "query_idx")


@query(
    "result_file_stats",
    "WITH n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem) SELECT 'input queries' AS name, CAST(2 * n AS VARCHAR) AS value FROM n UNION ALL SELECT 'matched queries', CAST(n AS VARCHAR) FROM n UNION ALL SELECT 'matched percentage', '50.0000%'",
)
def result_file_stats(spark, d):
    return tables.read_stats(spark, _result_file(spark, d))


@query("taxdump_round_trip", f"WITH {I.TAXONOMY_SQL} SELECT taxid, parent, rank, name FROM taxonomy")
def taxdump_round_trip(spark, d):
    t, place = I.taxonomy(spark, d), shared_folder(spark, "taxdump")
    line = lambda *cols: F.concat(F.concat_ws("\t|\t", *[c.cast("string") for c in cols]), F.lit("\t|")).alias("value")
    t.select(line(F.col("taxid"), F.col("parent"), F.col("rank"))).write.text(f"{place}/nodes.dmp")
    scientific = t.select(line(F.col("taxid"), F.col("name"), F.lit(""), F.lit("scientific name")))
    scientific.unionByName(t.select(line(F.col("taxid"), F.lower("name"), F.lit(""), F.lit("synonym")))).write.text(f"{place}/names.dmp")
    dump = tables.read_taxdump(spark, place)
    return dump["nodes"].join(dump["names"], "taxid").select("taxid", "parent", "rank", "name")


@query(
    "fasta_round_trip",
    f"WITH d AS (SELECT ref_id, seq AS text FROM ({SQ.DNA_SQL})), p AS (SELECT ref_id, text, length(text) >= 1000 AS cut, CASE WHEN length(text) >= 1000 THEN 300 ELSE length(text) END AS size, unnest(CASE WHEN length(text) >= 1000 THEN range(0, length(text), 280) ELSE [0] END) AS b FROM d), "
    f"k AS (SELECT ref_id, b, substr(text, b + 1, size) AS seq, cut FROM p), f AS (SELECT * FROM k WHERE length(seq) >= {K} AND (NOT cut OR length(seq) - 1 > 20)) "
    "SELECT ref_id || '_chunk' || (row_number() OVER (PARTITION BY ref_id ORDER BY b) - 1) AS seq_id, md5(seq) AS digest FROM f",
)
def fasta_round_trip(spark, d):
    """Chunks as packed FASTA files, a folder for each chunk number, read by pattern."""
    place = shared_folder(spark, "chunks")
    fastx.write_chunks(sketch.chunks(SQ.dna(spark, d), K, size=300, overlap=20), place)
    return fastx.read_fastx(spark, place, r"\.txt(\.gz)?$").select("seq_id", F.md5("seq").alias("digest"))


@query("set_summary_round_trip", f"SELECT 'documents' AS path, CAST(doc_id AS VARCHAR) AS name, 0 AS \"chunkIdx\", 1 AS \"idxNum\", CAST(length(text) AS BIGINT) AS \"genomeSize\", CAST(len(list_distinct({kmers_sql('text')})) AS BIGINT) AS kmers FROM documents")
def set_summary_round_trip(spark, d):
    r = I.refs(spark, d).withColumn("genome_size", F.length("seq").cast("long"))
    s = sketch.kmer_sets(r, K, keep=("target", "genome_size"))
    place = shared_folder(spark, "summary")
    tables.write_summary(s.select(F.lit("documents").alias("path"), F.col("target").cast("string").alias("name"), F.lit(0).alias("chunkIdx"), F.lit(1).alias("idxNum"), F.col("genome_size").alias("genomeSize"), F.col("n_kmers").alias("kmers")), place)
    return tables.read_summary(spark, place)


@query("binning_file", f"WITH {PQ.TAX}, {PQ.LCA_SQL} SELECT query, lca AS taxid FROM lca")
def binning_file(spark, d):
    place = shared_folder(spark, "binning")
    reports.write_binning(T.binning(I.matches(spark, d), I.taxid_map(spark, d), T.closure(I.taxonomy(spark, d))), place, "sample")
    rows = spark.read.text(place).filter(~F.col("value").startswith("@"))
    part = F.split("value", "\t")
    return rows.select(part[0].cast("long").alias("query"), part[1].cast("long").alias("taxid"))


@query("bed_file", f"SELECT ref, begin_, end_, type FROM ({PQ.region_sql(False)})")
def bed_file(spark, d):
    place = shared_folder(spark, "bed")
    reports.write_bed(R.bed(R.merge(R.windows(I.regions(spark, d)))), place)
    names = ["ref", "begin_", "end_", "type", "score", "strand"]
    rows = spark.read.option("sep", "\t").csv(place).toDF(*names)
    return rows.select("ref", F.col("begin_").cast("int").alias("begin_"), F.col("end_").cast("int").alias("end_"), "type")


@query("profile_file", f"WITH RECURSIVE {PQ.em_sql(0)} SELECT CAST(target AS VARCHAR) AS ref, CAST(printf('%.6f', percentage) AS DOUBLE) AS percentage, CAST(printf('%.6f', coverage) AS DOUBLE) AS coverage FROM em0")
def profile_file(spark, d):
    place = shared_folder(spark, "profile")
    reports.write_tsv(reports.profile_table(PQ._em(spark, d, 0)), place)
    rows = spark.read.option("sep", "\t").option("header", True).csv(place)
    return rows.select("ref", *[F.col(c).cast("double").alias(c) for c in ("percentage", "coverage")])
