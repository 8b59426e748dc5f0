"""Table functions for SQL: what a sequence's sketch picks.

    register(spark)
    SELECT * FROM minimizers('ACGT…', 21, 10)
    SELECT r.id, m.* FROM reads r, LATERAL syncmers(r.seq, 21, 15) m
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from seqloom.functions.hashing import kmer_hashes
from seqloom.operators.sketch import minimizer_spots, syncmer_spots


class Minimizers:
    """(pos, kmer): positions that hold the least MD5 hash of some window of k-mers."""

    def eval(self, seq: str, k: int, window: int) -> Iterator[tuple[int, int]]:
        h = kmer_hashes([seq or ""], k, "md5")[0]
        yield from ((int(i), int(h[i])) for i in minimizer_spots(h, window))


class Syncmers:
    """(pos, kmer): k-mers whose s-mer of least MD5 hash stands first or last."""

    def eval(self, seq: str, k: int, s: int) -> Iterator[tuple[int, int]]:
        h, inner = kmer_hashes([seq or ""], k, "md5")[0], kmer_hashes([seq or ""], s, "md5")[0]
        yield from ((int(i), int(h[i])) for i in syncmer_spots(h, inner, k, s))


def register(spark: SparkSession) -> None:
    for name, kind in (("minimizers", Minimizers), ("syncmers", Syncmers)):
        spark.udtf.register(name, udtf(kind, returnType="pos: bigint, kmer: bigint"))
