"""Containment search of queries in reference sets, exact by k-mer join."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.rates import query_fpr_value
from seqloom.operators import pairs, sketch

#: Distinct query k-mers up to which they are sent to every task to thin the reference
#: side before it is shuffled; beyond it both sides are shuffled by k-mer.
BROADCAST_KMERS = 1_000_000

SORTS = {"qcov": ("q_cov", "t_cov"), "tcov": ("t_cov", "m_kmers"), "jacc": ("jacc", "m_kmers")}


def matches(queries: DataFrame, sets: DataFrame, ref: tuple[str, ...] = ("target", "chunk_idx"), broadcast_kmers: int = BROADCAST_KMERS) -> DataFrame:
    """(query, q_len, q_kmers, *ref, t_kmers, m_kmers): shared k-mers of each pair that has any.

    queries: as of query_kmers(); sets: ref columns, n_kmers, kmers. Duplicate query
    k-mers count each time. Equal positions are counted once before the join, so a
    frequent k-mer is one row for each query and each reference, not for each
    occurrence; how often it occurs goes along as a weight."""
    q = queries.select("query", "q_len", "q_kmers", F.explode("kmers").alias("kmer"))
    q = q.groupBy("query", "q_len", "q_kmers", "kmer").agg(F.count("*").alias("times"))
    r = sets.select(*ref, F.col("n_kmers").alias("t_kmers"), F.explode("kmers").alias("kmer"))
    wanted = q.select("kmer").distinct()
    if wanted.limit(broadcast_kmers + 1).count() <= broadcast_kmers:
        r = r.join(F.broadcast(wanted), "kmer", "left_semi")
    joined = r.join(q, "kmer")
    return joined.groupBy("query", "q_len", "q_kmers", *ref, "t_kmers").agg(F.sum("times").cast("int").alias("m_kmers"))


def scored(found: DataFrame) -> DataFrame:
    """Adds query coverage, target coverage and Jaccard index."""
    m, q, t = F.col("m_kmers"), F.col("q_kmers"), F.col("t_kmers")
    return found.withColumns({"q_cov": m / q, "t_cov": m / t, "jacc": m / (q + t - m)})


def filtered(found: DataFrame, min_kmers: int = 10, min_q_cov: float = 0.55, min_t_cov: float = 0.0, db_fpr: float | None = None, max_fpr: float = 0.01) -> DataFrame:
    """Matches that pass every threshold (coverage strictly), with their false-positive rate.

    The rate depends on (q_kmers, m_kmers) alone and is looked up after all cheaper tests."""
    if db_fpr is not None and min_q_cov <= db_fpr:
        raise ValueError("the query coverage threshold must exceed the false-positive rate of the database")
    kept = scored(found.filter((F.col("m_kmers") >= min_kmers) & (F.col("m_kmers") > F.col("q_kmers") * min_q_cov)))
    if min_t_cov > 0:
        kept = kept.filter(F.col("t_cov") >= min_t_cov)
    if db_fpr is None:
        return kept.withColumn("fpr", F.lit(0.0))
    return kept.withColumn("fpr", rate_of(db_fpr)("q_kmers", "m_kmers")).filter(F.col("fpr") <= max_fpr)


_RATES: dict[tuple[int, int, float], float] = {}


def rate_of(p: float):
    """The false-positive rate of a match as a function of its numbers of k-mers; each pair of them is worked out once in a process."""

    @F.pandas_udf("double")
    def rate(n: pd.Series, k: pd.Series) -> pd.Series:
        if len(_RATES) > 1 << 20:
            _RATES.clear()
        out = []
        for key in zip(n.tolist(), k.tolist(), [p] * len(n), strict=True):
            if key not in _RATES:
                _RATES[key] = query_fpr_value(*key)
            out.append(_RATES[key])
        return pd.Series(out, dtype="float64")

    return rate


def with_hits(found: DataFrame, key: str = "query") -> DataFrame:
    """hits: the number of matches of the query."""
    return found.withColumn("hits", F.count("*").over(Window.partitionBy(key)).cast("int"))


def order_of(sort_by: str = "qcov", ref: tuple[str, ...] = ("target", "chunk_idx")) -> list[Column]:
    """A total order of a query's matches."""
    if sort_by not in SORTS:
        raise ValueError(f"sort by one of {', '.join(SORTS)}")
    return [*(F.col(c).desc() for c in SORTS[sort_by]), *(F.col(c) for c in ref)]


def ranked(found: DataFrame, sort_by: str = "qcov", ref: tuple[str, ...] = ("target", "chunk_idx")) -> DataFrame:
    """rank: place of a match among those of its query, from 1."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order_of(sort_by, ref))).cast("int"))


def top_scores(found: DataFrame, n: int, sort_by: str = "qcov") -> DataFrame:
    """Matches of the n highest distinct scores of each query."""
    if n <= 0:
        return found
    level = F.dense_rank().over(Window.partitionBy("query").orderBy(F.col(SORTS[sort_by][0]).desc()))
    return found.withColumn("_l", level).filter(F.col("_l") <= n).drop("_l")


def keep_unmatched(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Every query; those without a match have an empty target, chunk -1 and zeros."""
    cols = [c for c in found.columns if c not in ("query", "q_len", "q_kmers")]
    out = queries.select("query", "q_len", "q_kmers").join(found.drop("q_len", "q_kmers"), "query", "left")
    kinds = dict(found.dtypes)
    fill = {c: "" if kinds[c] == "string" else (-1 if c in ("chunk_idx", "target") else 0) for c in cols}
    return out.select("query", "q_len", "q_kmers", *[F.coalesce(F.col(c), F.lit(fill[c]).cast(kinds[c])).alias(c) for c in cols])


def search(queries: DataFrame, refs: DataFrame, k: int = 21, min_query_len: int = 30, seq2_col: str | None = None, kind: str = "roll", scale: float = 1, dedup_above: int = 256, db_fpr: float | None = None, **limits) -> DataFrame:
    """Matches of queries (query, seq) in refs (target, chunk_idx, seq) that pass the limits of filtered()."""
    q = sketch.query_kmers(queries, k, kind, dedup_above, seq2_col=seq2_col, scale=scale, min_len=min_query_len)
    sets = sketch.kmer_sets(refs, k, kind, scale, keep=("target", "chunk_idx"))
    return with_hits(filtered(matches(q, sets), db_fpr=db_fpr, **limits))


def search_all(texts: DataFrame, size: int, k: int = 21, min_query_len: int = 30, kind: str = "roll", dedup_above: int = 256, min_kmers: int = 10, min_q_cov: float = 0.55) -> DataFrame:
    """As search() of all texts (id, seq) in all of them, without chunks: pairs are counted in tiles, no k-mer is shuffled.

    size: the number of their characters, about."""
    found = pairs.text_pairs(texts, size, sketch.Settings((k,), kind), k, min_kmers, min_q_cov, min_query_len, dedup_above)
    return with_hits(filtered(found, min_kmers, min_q_cov))


def fall_back(attempts: list[DataFrame], note: str = "attempt") -> DataFrame:
    """Of several searches the first in which a query has matches; the list's order is their priority."""
    tagged = [a.withColumn(note, F.lit(i)) for i, a in enumerate(attempts)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    best = F.min(note).over(Window.partitionBy("query"))
    return every.withColumn("_b", best).filter(F.col("_b") == F.col(note)).drop("_b")


def multi_k(queries: DataFrame, refs: DataFrame, ks: list[int], **options) -> DataFrame:
    """From the largest k down, the first k with matches answers a query."""
    ks = sorted(ks, reverse=True)
    return with_hits(fall_back([search(queries, refs, k, **options).drop("hits").withColumn("k_size", F.lit(k)) for k in ks]).drop("attempt"))


def paired(queries: DataFrame, refs: DataFrame, k: int = 21, try_single: bool = True, **options) -> DataFrame:
    """Mates (query, seq, seq2) together; then, if asked for, the first alone, then the second."""
    tries = [search(queries, refs, k, seq2_col="seq2", **options)]
    if try_single:
        tries += [search(queries.select("query", F.col(c).alias("seq")), refs, k, **options) for c in ("seq", "seq2")]
    return with_hits(fall_back([t.drop("hits") for t in tries]))


def intersect_databases(found: list[DataFrame], ref: tuple[str, ...] = ("target", "chunk_idx")) -> DataFrame:
    """Matches that every database reports; of each the row with the smallest coverage counts."""
    tagged = [f.withColumn("_d", F.lit(i)) for i, f in enumerate(found)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    cols = [c for c in every.columns if c not in ("query", *ref, "_d")]
    order = F.struct("q_cov", "_d", *[c for c in cols if c != "q_cov"])
    least = every.groupBy("query", *ref).agg(F.countDistinct("_d").alias("_n"), F.min(order).alias("_m")).filter(F.col("_n") == len(found))
    return least.select("query", *ref, *[F.col(f"_m.{c}").alias(c) for c in cols])


def merge_databases(found: list[DataFrame], sort_by: str = "qcov", check: bool = False) -> DataFrame:
    """Matches of the same queries from several databases, hits and ranks anew.

    With check, queries of equal index but different ids are an error."""
    every = reduce(lambda a, b: a.unionByName(b), [f.drop("hits", "rank") for f in found])
    if check and "query_idx" in every.columns:
        clash = every.groupBy("query_idx").agg(F.min("query").alias("a"), F.max("query").alias("b")).filter("a <> b")
        if not clash.isEmpty():
            raise ValueError("one query index, different queries: the results are of different inputs")
    return ranked(with_hits(every), sort_by)


def query_stats(queries: DataFrame, found: DataFrame) -> DataFrame:
    """One row: number of queries, of matched ones, their share in percent."""
    some = found.select("query").distinct().withColumn("_m", F.lit(1))
    out = queries.select("query").join(some, "query", "left").agg(F.count("*").alias("queries"), F.count("_m").alias("matched"))
    return out.withColumn("matched_pct", F.when(F.col("queries") > 0, F.col("matched") / F.col("queries") * 100).otherwise(0.0))
