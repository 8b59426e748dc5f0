"""FASTA and FASTQ files, plain or gzip, as a Spark data source.

    register(spark)
    spark.read.format("fastx").option("fileNameRegexp", r"\\.fa(\\.gz)?$").load("/dir")

One partition reads one file as a stream of records; gzip, bzip2, xz and zstandard
are recognised by their magic bytes, not by name. Files are found and opened through Spark's file
system layer when read by ``read_fastx``, so any store that Spark knows works. Files of
more than ``WHOLE_BYTES`` are read there as lines, one file a task from front to end
(gzip by its name); a single sequence must fit a string.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqloom.sources.schemas import SEQUENCE

#: Fixed value: the default pattern of sequence files.
FILES = r"(?i)\.(f[aq](st[aq])?|fna)(.gz)?$"
#: Largest file that is read as one row of bytes; rows have a limit of 2 GB.
WHOLE_BYTES = 1 << 30
_BATCH = 4096


def records(stream: io.BufferedIOBase) -> Iterator[tuple[str, str, str, str | None]]:
    """(id, name, seq, qual) of each record; sequence lines may wrap, letters aren't checked."""
    head, seq, line = None, [], stream.readline()
    while line:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text.startswith("@") and head is None and not seq:
            name, parts = text[1:], []
            line = stream.readline()
            while line and not line.startswith(b"+"):
                parts.append(line.decode("utf-8", "replace").strip())
                line = stream.readline()
            bases, qual = "".join(parts), ""
            while line and len(qual) < len(bases):
                line = stream.readline()
                qual += line.decode("utf-8", "replace").strip()
            if not bases:
                stream.readline()
            yield name.split(None, 1)[0] if name.split() else "", name, bases, qual
            line = stream.readline()
            continue
        if text.startswith(">"):
            if head is not None:
                yield head.split(None, 1)[0] if head.split() else "", head, "".join(seq), None
            head, seq = text[1:], []
        elif head is not None:
            seq.append(text.strip())
        line = stream.readline()
    if head is not None:
        yield head.split(None, 1)[0] if head.split() else "", head, "".join(seq), None


def opened(raw: io.BufferedIOBase) -> io.BufferedIOBase:
    """The stream, unpacked if it starts like gzip, bzip2, xz or zstandard."""
    buffered = raw if isinstance(raw, io.BufferedReader) else io.BufferedReader(raw)
    start = buffered.peek(6)[:6]
    if start.startswith(b"\x1f\x8b"):
        return io.BufferedReader(gzip.GzipFile(fileobj=buffered))
    if start.startswith(b"BZh"):
        return io.BufferedReader(bz2.BZ2File(buffered))
    if start.startswith(b"\xfd7zXZ\x00"):
        return io.BufferedReader(lzma.LZMAFile(buffered))
    if start.startswith(b"\x28\xb5\x2f\xfd"):
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(buffered, read_across_frames=True))
    return buffered


def read_fastx(spark: SparkSession, paths: str | list[str], file_regexp: str = FILES, name_filter: list[str] | None = None, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(file, pos, seq_id, name, seq, qual) of all records in files and folders (searched through).

    Spark lists and reads the files, so the paths may lie in any store it knows; a
    file is one row until it is parsed, on the executor, as a stream of batches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).filter(F.col("path").rlike(file_regexp))
    large = [r.path for r in files.filter(F.col("length") > whole_bytes).select("path").collect()]

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                yield from _batches(path, opened(io.BytesIO(content.as_buffer())))

    out = files.filter(F.col("length") <= whole_bytes).select("path", "content").mapInArrow(parse, SEQUENCE)
    for path in sorted(large):
        out = out.unionByName(_by_lines(spark, path))
    if name_filter:
        out = out.filter(~F.col("name").rlike("(?i)" + "|".join(f"(?:{p})" for p in name_filter)))
    return out


class _Lines:
    """Lines of text batches, as a stream of bytes has them."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.last = -1
        self.lines = self._lines(batches)

    def _lines(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for line, at in zip(batch["value"].to_pylist(), batch["at"].to_pylist(), strict=True):
                if at < self.last:
                    raise ValueError("the parts of a file came out of order")
                self.last = at
                yield line.encode() + b"\n"

    def readline(self) -> bytes:
        return next(self.lines, b"")


def _by_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of one large file: its splits, in order, in one task that holds a record at a time."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("at")).coalesce(1)
    return lines.mapInArrow(lambda it: _batches(path, _Lines(it)), SEQUENCE)


def _batches(path: str, stream) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for pos, (i, name, seq, qual) in enumerate(records(stream)):
        rows.append((path, pos, i, name, seq, qual))
        if len(rows) >= _BATCH or sum(len(r[4]) for r in rows[-1:]) > 1 << 24:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=SEQUENCE.names)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FastxReader(DataSourceReader):
    """Reads files of a folder that driver and executors share, one partition each."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path.removeprefix("file://"), pattern

    def partitions(self) -> list[InputPartition]:
        import os

        if os.path.isfile(self.path):
            return [_File(self.path)]
        found = [os.path.join(d, f) for d, _, names in os.walk(self.path, followlinks=True) for f in names if re.search(self.pattern, f)]
        return [_File(f) for f in sorted(found)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            yield from _batches(partition.path, opened(f))


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self):
        return SEQUENCE

    def reader(self, schema) -> DataSourceReader:
        return FastxReader(self.options.get("path", ""), self.options.get("fileNameRegexp", FILES))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxSource)


def write_fragments(assigned: DataFrame, path: str) -> None:
    """The table of which fragment went to which chunk: file, fragment, shared k-mers, chunk, place."""
    rows = assigned.select("file", F.concat(F.regexp_extract("file", r"([^/]+)$", 1), F.lit("_frag"), F.col("begin").cast("string")).alias("seqId"), F.col("m_kmers").alias("mKmers"), (F.col("chunk_idx") + 1).alias("chunkId"), F.col("begin").alias("fragLoc"))
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_chunks(chunked: DataFrame, path: str, width: int = 70, gzip_files: bool = True, id_col: str = "ref_id") -> None:
    """One folder of FASTA text for each chunk number; sequences wrapped."""
    wrapped = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), r"\n$", "")
    head = F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("_chunk"), F.col("chunk_idx").cast("string"))
    rows = chunked.select(F.concat(head, F.lit("\n"), wrapped).alias("value"), F.format_string("%03d", F.col("chunk_idx")).alias("chunk"))
    rows.write.mode("overwrite").partitionBy("chunk").option("compression", "gzip" if gzip_files else "none").text(path)
