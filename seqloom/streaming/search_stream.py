"""Search over a stream of queries: a stream-static join, stateless for each query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators import search, sketch


def search_each_batch(queries: DataFrame, sets: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, kind: str = "roll", min_query_len: int = 30, **limits) -> StreamingQuery:
    """Starts a query that searches each micro-batch of (query, seq) in the reference sets and hands the matches to sink.

    All k-mers of a query arrive in one row, so a batch is complete for its queries
    and needs no state; the sink gets (matches, batch id) and is exactly-once if it
    is idempotent by batch id."""

    def on_batch(batch: DataFrame, number: int) -> None:
        q = sketch.query_kmers(batch, k, kind, min_len=min_query_len)
        sink(search.with_hits(search.filtered(search.matches(q, sets), **limits)), number)

    return queries.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(queries: DataFrame) -> DataFrame:
    """Running numbers of queries and letters of a stream with an event time, by ten minutes."""
    return queries.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "10 minutes")).agg(F.count("*").alias("queries"), F.sum(F.length("seq")).alias("letters"))
