"""Names, reference choice and the assignment of fragments to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import sketch
from seqloom.session import settle

#: K-mers of chunks up to which they are broadcast; beyond, fragments' k-mers are shuffled to them.
BROADCAST_KMERS = 1_000_000


def blacklist(records: DataFrame, name_col: str, patterns: list[str]) -> DataFrame:
    """Records whose name no pattern matches, whatever the case."""
    return records.filter(~F.col(name_col).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))) if patterns else records


def reference_name(path: Column, pattern: str, suffix: str = r"(?i)\.(fa|fq|fna|fasta|fastq)(\.gz)?$") -> Column:
    """The pattern's first group, or else the name without its known suffix."""
    return F.coalesce(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), F.regexp_replace(path, suffix, ""))


def trim_extension(name: Column, set_suffix: str = "kset") -> Column:
    """Without .gz, the ending of set files and one of sequence files; a name's other dots stay."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(?i)\.gz$", ""), rf"(?i)\.{set_suffix}$", "")
    return F.regexp_replace(bare, r"(?i)\.(fasta|fastq|fna|fa|fq)$", "")


def choose_reference(genomes: DataFrame, id_col: str, contigs: str = "contigs", size: str = "size", by: tuple[str, ...] = ()) -> DataFrame:
    """Of each group the genome of fewest contigs, then of the largest size."""
    best = F.min(F.struct(F.col(contigs), (-F.col(size)).alias("s"), F.col(id_col).alias("id")))
    return genomes.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.id").alias(id_col))


def fragments(seqs: DataFrame, k: int, size: int = 100, keep: tuple[str, ...] = ("ref_id",), seq_col: str = "seq") -> DataFrame:
    """(keep, begin, seq): windows of ``size`` that overlap by k-1; those shorter than k are left out."""
    rows = seqs.select(*keep, F.coalesce(F.col(seq_col), F.lit("")).alias("_s"))

    def cut(text: str) -> list[tuple]:
        return [(at, text[at : at + size]) for at in range(0, len(text) - k + 1, size - k + 1)]

    return sketch.cut_up(rows, keep, "begin int, seq string", ("_s",), cut)


def assign_fragments(chunked: DataFrame, frags: DataFrame, k: int, keep: tuple[str, ...] = (), all_if_none: bool = False) -> DataFrame:
    """(ref_id, keep, begin, chunk_idx, m_kmers): each fragment's chunks of most shared k-mers, ties all kept.

    Fragments that a chunk contains whole are dropped; those that share nothing go
    to all chunks if asked for."""
    c = settle(sketch.exploded(sketch.kmer_sets(chunked, k), ("ref_id", "chunk_idx")))
    # The chunks of a few genomes go to the fragments, so that no k-mer of a fragment is shuffled but shared ones.
    c = F.broadcast(c) if c.count() <= BROADCAST_KMERS else c
    sets = sketch.kmer_sets(frags, k, keep=("ref_id", *keep, "begin"))
    f = sets.select("ref_id", *keep, "begin", "n_kmers", F.explode("kmers").alias("kmer"))
    shared = f.join(c, ["ref_id", "kmer"]).groupBy("ref_id", *keep, "begin", "n_kmers", "chunk_idx").agg(F.count("*").alias("m_kmers"))
    top = F.max("m_kmers").over(Window.partitionBy("ref_id", *keep, "begin"))
    best = shared.withColumn("_t", top).filter((F.col("m_kmers") == F.col("_t")) & (F.col("_t") < F.col("n_kmers"))).select("ref_id", *keep, "begin", "chunk_idx", "m_kmers")
    if all_if_none:
        lost = sets.join(shared.select("ref_id", *keep, "begin").distinct(), ["ref_id", *keep, "begin"], "left_anti").select("ref_id", *keep, "begin")
        every = lost.join(chunked.select("ref_id", "chunk_idx").distinct(), "ref_id").withColumn("m_kmers", F.lit(0).cast("long"))
        best = best.unionByName(every)
    return best
