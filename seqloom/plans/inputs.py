"""The engine's inputs derived from the standard tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores over all cores, as one row group is one task whatever the split size.

    Tables of more files stay where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, chunk_idx, seq): each document as one reference of one chunk."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("target"), F.lit(0).alias("chunk_idx"), F.col("text").alias("seq"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("ref_id"), F.col("text").alias("seq"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("seq"))


def matches(spark: SparkSession, sf_dir: str, cov: Column | None = None) -> DataFrame:
    """Search results made from order lines: one row for each line, several targets and chunks for a query.

    cov, where it isn't null, is the coverage instead."""
    li = table(spark, sf_dir, "lineitem")
    own = F.round(0.5 + 4 * F.col("l_discount") + 1.25 * F.col("l_tax"), 4)
    return li.select(
        F.col("l_orderkey").alias("query"),
        F.col("l_suppkey").alias("target"),
        (F.col("l_partkey") % 10).cast("int").alias("chunk_idx"),
        F.lit(10).alias("chunks"),
        (50 + F.col("l_quantity").cast("int")).cast("int").alias("q_len"),
        (own if cov is None else F.coalesce(cov, own)).alias("q_cov"),
        F.lit(0.0).alias("fpr"),
        F.col("l_linenumber").alias("line"),
    )


MATCHES_SQL = """
matches AS (
  SELECT l_orderkey AS query, l_suppkey AS target, CAST(l_partkey % 10 AS INTEGER) AS chunk_idx, 10 AS chunks,
         CAST(50 + CAST(trunc(l_quantity) AS INTEGER) AS INTEGER) AS q_len,
         round(0.5::DOUBLE + 4 * l_discount + 1.25::DOUBLE * l_tax, 4) AS q_cov, 0.0::DOUBLE AS fpr, l_linenumber AS line
  FROM lineitem)"""


def ref_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"), (1000 + 10 * F.col("s_suppkey")).cast("long").alias("size"))


SIZES_SQL = "sizes AS (SELECT s_suppkey AS target, CAST(1000 + 10 * s_suppkey AS BIGINT) AS size FROM supplier)"


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(taxid, parent, rank, name): root, regions, nations as species, suppliers as strains."""
    root = spark.range(1).select(F.lit(1).cast("long").alias("taxid"), F.lit(1).cast("long").alias("parent"), F.lit("no rank").alias("rank"), F.lit("root").alias("name"))
    region = table(spark, sf_dir, "region").select((100 + F.col("r_regionkey")).cast("long").alias("taxid"), F.lit(1).cast("long").alias("parent"), F.lit("phylum").alias("rank"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select((1000 + F.col("n_nationkey")).cast("long").alias("taxid"), (100 + F.col("n_regionkey")).cast("long").alias("parent"), F.lit("species").alias("rank"), F.col("n_name").alias("name"))
    supplier = table(spark, sf_dir, "supplier").select((100000 + F.col("s_suppkey")).cast("long").alias("taxid"), (1000 + F.col("s_nationkey")).cast("long").alias("parent"), F.lit("strain").alias("rank"), F.col("s_name").alias("name"))
    return root.unionByName(region).unionByName(nation).unionByName(supplier)


TAXONOMY_SQL = """
taxonomy AS (
  SELECT 1::BIGINT AS taxid, 1::BIGINT AS parent, 'no rank' AS rank, 'root' AS name
  UNION ALL SELECT CAST(100 + r_regionkey AS BIGINT), 1, 'phylum', r_name FROM region
  UNION ALL SELECT CAST(1000 + n_nationkey AS BIGINT), CAST(100 + n_regionkey AS BIGINT), 'species', n_name FROM nation
  UNION ALL SELECT CAST(100000 + s_suppkey AS BIGINT), CAST(1000 + s_nationkey AS BIGINT), 'strain', s_name FROM supplier),
closure AS (
  SELECT taxid, taxid AS ancestor, rank, CAST(CASE WHEN taxid = 1 THEN 0 WHEN taxid < 1000 THEN 1 WHEN taxid < 100000 THEN 2 ELSE 3 END AS INTEGER) AS depth FROM taxonomy
  UNION ALL SELECT t.taxid, 1::BIGINT, 'no rank', 0 FROM taxonomy t WHERE t.taxid <> 1
  UNION ALL SELECT t.taxid, t.parent, 'phylum', 1 FROM taxonomy t WHERE t.rank = 'species'
  UNION ALL SELECT t.taxid, t.parent, 'species', 2 FROM taxonomy t WHERE t.rank = 'strain'
  UNION ALL SELECT t.taxid, p.parent, 'phylum', 1 FROM taxonomy t JOIN taxonomy p ON p.taxid = t.parent WHERE t.rank = 'strain')"""


def taxid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"), (100000 + F.col("s_suppkey")).cast("long").alias("taxid"))


TAXIDS_SQL = "taxids AS (SELECT s_suppkey AS target, CAST(100000 + s_suppkey AS BIGINT) AS taxid FROM supplier)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 100 along each supplier: (query, ref, begin, end, target, q_cov)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.col("l_suppkey").cast("string"), F.lit("_sliding:"), (1 + F.col("l_partkey") * 10).cast("string"), F.lit("-"), (100 + F.col("l_partkey") * 10).cast("string")).alias("query"),
        F.col("l_linenumber").cast("long").alias("target"),
        F.round(0.5 + 4 * F.col("l_discount") + 1.25 * F.col("l_tax"), 4).alias("q_cov"),
        F.lit(0.0).alias("fpr"),
    )


REGIONS_SQL = """
region_rows AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ref, CAST(1 + l_partkey * 10 AS INTEGER) AS begin_, CAST(100 + l_partkey * 10 AS INTEGER) AS end_,
         CAST(l_linenumber AS BIGINT) AS target, round(0.5::DOUBLE + 4 * l_discount + 1.25::DOUBLE * l_tax, 4) AS q_cov
  FROM lineitem)"""


def kmers_sql(text: str, k: int = K) -> str:
    """DuckDB list of all k-mers of a text."""
    return f"CASE WHEN length({text}) >= {k} THEN list_transform(range(1, length({text}) - {k} + 2), lambda i: substr({text}, i, {k})) ELSE [] END"


def canonical_sql(text: str, k: int = K) -> str:
    """DuckDB list of the lesser of each k-mer and its reverse complement."""
    return f"list_transform({kmers_sql(text, k)}, lambda own: least(own, reverse(translate(own, 'ACGT', 'TGCA'))))"


def md5_sql(text: str) -> str:
    """The 60-bit MD5 hash in DuckDB."""
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def query_kmers_sql(source: str = "SELECT item_id AS query, text AS seq FROM benchmark", k: int = K, above: int = 256, name: str = "qk", of=kmers_sql) -> str:
    """CTEs: {name}(query, q_len, q_kmers, ks) with duplicates kept up to ``above`` k-mers."""
    return f"""
{name}_all AS (SELECT query, length(seq) AS q_len, {of("seq", k)} AS ks FROM ({source})),
{name} AS (SELECT query, CAST(q_len AS INTEGER) AS q_len, CAST(len(ks2) AS INTEGER) AS q_kmers, ks2 AS ks
       FROM (SELECT query, q_len, CASE WHEN len(ks) > {above} THEN list_distinct(ks) ELSE ks END AS ks2 FROM {name}_all))"""


def ref_kmers_sql(source: str = "SELECT doc_id AS target, text AS seq FROM documents", k: int = K, name: str = "rk", of=kmers_sql) -> str:
    """CTEs: {name}(target, t_kmers, ks) with distinct k-mers."""
    return f"{name} AS (SELECT target, CAST(len(ks) AS BIGINT) AS t_kmers, ks FROM (SELECT target, list_distinct({of('seq', k)}) AS ks FROM ({source})))"


def found_sql(q: str = "qk", r: str = "rk", name: str = "found", min_kmers: int = 10, min_q_cov: float = 0.55) -> str:
    """CTE: the matches that pass the thresholds, with their scores."""
    return f"""
{name} AS (
  SELECT query, q_len, q_kmers, target, 0 AS chunk_idx, t_kmers, CAST(count(*) AS INTEGER) AS m_kmers,
         count(*) / q_kmers AS q_cov, count(*) / t_kmers AS t_cov, count(*) / (q_kmers + t_kmers - count(*)) AS jacc
  FROM (SELECT query, q_len, q_kmers, unnest(ks) AS kmer FROM {q}) JOIN (SELECT target, t_kmers, unnest(ks) AS kmer FROM {r}) USING (kmer)
  GROUP BY query, q_len, q_kmers, target, t_kmers HAVING count(*) >= {min_kmers} AND count(*) > q_kmers * {min_q_cov}::DOUBLE)"""
