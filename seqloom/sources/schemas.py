"""Fixed record schemas; readers always pass one."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "ARRAY<INT>": T.ArrayType(T.IntegerType())}


def _fields(text: str) -> T.StructType:
    """A flat schema from its text; usable without a session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in text.split(","))])


#: Search result, as written: coverages and Jaccard index have four decimals.
SEARCH_RESULT = _fields(
    "query STRING, qLen INT, qKmers INT, FPR DOUBLE, hits INT, target STRING, chunkIdx INT, chunks INT, tLen BIGINT, kSize INT, mKmers INT, qCov DOUBLE, tCov DOUBLE, jacc DOUBLE, queryIdx BIGINT"
)
SET_SUMMARY = _fields("path STRING, name STRING, chunkIdx INT, idxNum INT, genomeSize BIGINT, kmers BIGINT")
KEY_VALUE = _fields("key STRING, value STRING")
SEQUENCE = _fields("file STRING, pos BIGINT, seq_id STRING, name STRING, seq STRING, qual STRING")
MANIFEST = _fields(
    "version INT, alias STRING, k ARRAY<INT>, canonical BOOLEAN, hashed BOOLEAN, scaled BOOLEAN, scale INT, minimizer_w INT, syncmer_s INT, split_number INT, split_size INT, split_overlap INT, num_hash INT, fpr DOUBLE, block_size INT, kmers BIGINT, names BIGINT, hash STRING"
)

#: Version of the database layout; others are refused.
DB_VERSION = 5
