"""Helpers shared by the operators: Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that vectorised kernels look at together; bounds their temporaries.
BLOCK_BYTES = 1 << 18
#: Longest text, in bytes, of a learning sample's row; longer texts are scored, not learned from.
LEARN_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what an operator reads, under fixed names, so that no other column can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(salt_of: str, modulus: int):
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(salt_of).cast("string"), F.lit(""))) % modulus


#: Parts in which the rows of a class are ranked, so that no class is ranked in one task.
RANKS = 16


def sampled(rows: DataFrame, by: str, n: dict, each: int, salt: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """At most ``each`` rows of each value of ``by``, those of the least hash of doc_id; n: rows by value.

    A threshold on the hash thins the rows first, to about twice the bound. They are ranked by
    ranges of the hash, each after the number of those before. Rows of equal hash are ordered
    by id, then by the hash of ``ties``."""
    rank = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(salt))
    chance = F.pmod(rank, F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*[F.lit(v) for k, c in n.items() for v in (k, min(1.0, 2 * each / c + 64 / c))]), F.col(by))
    some = rows.filter(chance < share).withColumn("_part", F.floor(chance / share * RANKS).cast("int"))
    sizes = {(r[by], r["_part"]): r["n"] for r in some.groupBy(by, "_part").agg(F.count("*").alias("n")).collect()}
    before = [(k, i, sum(sizes.get((k, j), 0) for j in range(i))) for k, i in sizes]
    if not before:
        return some.drop("_part").limit(0)
    start = F.element_at(F.create_map(*[F.lit(v) for k, i, m in before for v in (f"{k}:{i}", m)]), F.concat_ws(":", F.col(by).cast("string"), F.col("_part").cast("string")))
    place = F.row_number().over(Window.partitionBy(by, "_part").orderBy(chance, F.col("doc_id").cast("string"), F.xxhash64(*ties) if ties else F.lit(0)))
    return some.withColumn("_place", place + start).filter(F.col("_place") <= each).drop("_place", "_part")


def map_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array | list]], schema: str) -> DataFrame:
    """mapInArrow for a function from one batch to columns by name, in the order of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for batch in it:
            for part in sliced(batch):
                cols = fn(part)
                arrays = [c if isinstance(c, pa.Array) and c.type == f.type else (c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)) for f, c in ((f, cols[f.name]) for f in arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, out)


def sliced(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of a bounded number of rows; an empty one yields nothing."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def raw(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value, nulls as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def strings(col: pa.Array) -> list[str]:
    return [x or "" for x in col.to_pylist()]


class Block(NamedTuple):
    """Consecutive rows: first, end, their bytes one after the other, and where each begins (and the last ends)."""

    first: int
    end: int
    data: np.ndarray
    offsets: np.ndarray

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            yield self.data[a:b].tobytes()


def joined(values: list[bytes], first: int = 0) -> Block:
    lens = np.fromiter((len(v) for v in values), np.int64, len(values))
    return Block(first, first + len(values), np.frombuffer(b"".join(values), np.uint8), np.concatenate(([0], np.cumsum(lens))))


def blocks(values: pa.Array | list, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Rows in blocks of at most ``limit`` bytes, nulls as empty; a longer text is a block of its own.

    Blocks are views of the column's buffer. Kernels whose temporaries are many times
    their input walk a longer text by pieces()."""
    if isinstance(values, list):
        kind = pa.binary() if any(isinstance(v, bytes) for v in values) else pa.string()
        values = pa.array(values, kind)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = pc.fill_null(values, pa.scalar(b"" if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) else "", values.type))
    n = len(values)
    if n == 0:
        return
    _, ends, chars = values.buffers()
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    data = np.frombuffer(chars, np.uint8) if chars is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield Block(i, j, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def pieces(data: np.ndarray, limit: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """Where a long text is cut into pieces of at most ``limit`` bytes: after white space, or, where
    half a piece has none, between characters. The cuts depend on the text alone."""
    out, at, n = [], 0, len(data)
    while n - at > limit:
        low = at + limit // 2
        white = np.flatnonzero(_WHITE[data[low : at + limit]])
        if len(white):
            stop = low + int(white[-1]) + 1
        else:
            stop = at + limit
            while stop > low and data[stop] & 0xC0 == 0x80:
                stop -= 1
        out.append((at, stop))
        at = stop
    return [*out, (at, n)]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(block: Block) -> Block:
    """The block with each text in lower case."""
    if len(block.data) == 0 or block.data.max() < 128:
        return block._replace(data=_LOWER[block.data])
    return joined([t.decode("utf-8", "replace").lower().encode() for t in block.texts()], block.first)
