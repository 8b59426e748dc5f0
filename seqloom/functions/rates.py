"""False-positive rates, filter sizes and similarity, as Column expressions and as SQL functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Coefficients of the cubic that maps query coverage to percent identity (fixed values of a published fit).
SIMILARITY = (87.456, 26.410, -22.008, 7.325)

#: (name, parameters, type, body) of the functions that register() makes usable from SQL.
SQL_FUNCTIONS = (
    ("signature_size", "n DOUBLE, h DOUBLE, p DOUBLE", "BIGINT", "CAST(ceil(n * (-h / ln(1 - pow(p, 1 / h)))) AS BIGINT)"),
    ("bloom_fpr", "n DOUBLE, h DOUBLE, m DOUBLE", "DOUBLE", "pow(1 - exp(-h * n / m), h)"),
    (
        "query_fpr",
        "n INT, k INT, p DOUBLE",
        "DOUBLE",
        "CASE WHEN pow(1 - p, n) = 0 THEN IF(k > n * p, 0D, 1D) ELSE greatest(0D, 1D - aggregate(sequence(0, k), named_struct('t', pow(1 - p, n), 's', 0D), "
        "(a, i) -> named_struct('t', a.t * (n - i) / (i + 1) * (p / (1 - p)), 's', a.s + a.t), a -> a.s)) END",
    ),
    ("chernoff_fpr", "l INT, k DOUBLE, p DOUBLE", "DOUBLE", "exp(-l * pow(k - p, 2) / (2 * (1 - p)))"),
    ("cov_to_similarity", "q DOUBLE", "DOUBLE", f"{SIMILARITY[0]}D + {SIMILARITY[1]}D * q + {SIMILARITY[2]}D * q * q + {SIMILARITY[3]}D * q * q * q"),
)


def register(spark: SparkSession) -> None:
    """Makes the functions of this module, and a few of sequences, temporary SQL functions of the session."""
    for name, args, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmers(s STRING, k INT) RETURNS ARRAY<STRING> RETURN CASE WHEN length(s) >= k THEN transform(sequence(1, length(s) - k + 1), i -> substring(s, i, k)) ELSE array() END")


def signature_size(n: Column, h: int, p: float) -> Column:
    """Bits of a Bloom filter for n elements, h hashes and false-positive rate p."""
    return F.ceil(n * F.lit(-h / math.log(1 - p ** (1 / h)))).cast("long")


def bloom_fpr(n: Column, h: int, m: Column) -> Column:
    """False-positive rate of a filter of m bits that holds n elements by h hashes."""
    return F.pow(1 - F.exp(-F.lit(float(h)) * n / m), F.lit(float(h)))


def query_fpr(n: Column, k: Column, p: float) -> Column:
    """Chance of more than k false hits among n: the upper tail of a binomial.

    The terms are folded by their ratio. Where (1-p)^n underflows, the tail is 0
    above the mean. Below about 1e-14 the value is rounding noise."""
    odds = p / (1 - p)
    first = F.pow(F.lit(1 - p), n)
    start = F.struct(first.alias("t"), F.lit(0.0).alias("s"))
    fold = F.aggregate(F.sequence(F.lit(0), k.cast("int")), start, lambda a, i: F.struct((a["t"] * (n - i) / (i + 1) * odds).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"])
    return F.when(first == 0, F.when(k > n * p, 0.0).otherwise(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - fold))


def query_fpr_value(n: int, k: int, p: float) -> float:
    """query_fpr() of single values."""
    term, odds, total = (1 - p) ** n, p / (1 - p), 0.0
    if term == 0:
        return 0.0 if k > n * p else 1.0
    for i in range(k + 1):
        total += term
        term = term * (n - i) / (i + 1) * odds
    return max(0.0, 1 - total)


def binomial(n: int, k: int) -> int:
    return math.comb(n, k)


def chernoff_fpr(length: Column, k: Column, p: float) -> Column:
    """An upper bound of the query's false-positive rate at coverage k."""
    return F.exp(-length * F.pow(k - p, F.lit(2.0)) / (2 * (1 - p)))


def cov_to_similarity(q: Column) -> Column:
    """Percent identity from query coverage."""
    a, b, c, d = SIMILARITY
    return F.lit(a) + b * q + c * q * q + d * q * q * q


def byte_size(text: str) -> int:
    """10M, 100K, 1.5G as a number."""
    units = {"": 1, "K": 1000, "M": 1000**2, "G": 1000**3}
    text = text.strip().upper().removesuffix("B")
    unit = text[-1:] if text[-1:] in units else ""
    return int(float(text.removesuffix(unit)) * units[unit])
