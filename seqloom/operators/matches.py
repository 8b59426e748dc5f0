"""Filters of search results before profiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The total order of a query's matches.
ORDER = ("q_cov", "target", "chunk_idx", "line")


def _order(df: DataFrame) -> list[Column]:
    return [F.col("q_cov").desc(), *(F.col(c) for c in ORDER[1:] if c in df.columns)]


def refilter(found: DataFrame, min_q_cov: float = 0.55, max_fpr: float = 0.01) -> DataFrame:
    return found.filter((F.col("q_cov") >= min_q_cov) & (F.col("fpr") <= max_fpr))


def prefix(found: DataFrame, perfect: bool = False, main_gap: float | None = None, top_n: int = 0) -> DataFrame:
    """The best matches of each query up to the first stop.

    perfect stops after full coverage; otherwise main_gap stops at a larger drop of
    coverage; top_n stops after so many distinct coverages."""
    if not perfect and main_gap is None and top_n <= 0:
        return found
    w = Window.partitionBy("query").orderBy(*_order(found))
    prev, cur = F.lag("q_cov").over(w), F.col("q_cov")
    stop = F.lit(False)
    if perfect:
        stop = (prev == 1) & (cur < 1)
    elif main_gap is not None:
        stop = prev - cur > main_gap
    rows = found.withColumn("_stop", F.coalesce(stop, F.lit(False)).cast("int"))
    if top_n > 0:
        level = F.dense_rank().over(Window.partitionBy("query").orderBy(cur.desc()))
        rows = rows.withColumn("_stop", F.greatest("_stop", (level > top_n).cast("int")))
    stopped = F.max("_stop").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_s", stopped).filter("_s = 0").drop("_s", "_stop")


def latest(pairs: DataFrame, key: str = "key", value: str = "value", order: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """(key, value) of a map read from several files: the last one given counts."""
    last = F.max(F.struct(*order, value)).alias("_l")
    return pairs.groupBy(key).agg(last).select(key, F.col(f"_l.{value}").alias(value))


def named(found: DataFrame, mapping: DataFrame, col: str = "target", key: str = "key", value: str = "value") -> DataFrame:
    """found with a name for each target; targets that the map lacks keep their own."""
    m = mapping.select(F.col(key).alias(col), F.col(value).alias("_v"))
    return found.join(m, col, "left").withColumn("name", F.coalesce("_v", F.col(col).cast("string"))).drop("_v")
