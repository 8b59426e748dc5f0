"""Sequences to chunks, k-mers and sketches.

Everything stays in the row, so nothing here shuffles. Chunks are built-in
expressions; k-mers are hashed with numpy over Arrow batches, where a k-mer costs
nanoseconds, while the built-in higher-order functions walk strings from the start
and box each value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from seqloom.functions.hashing import canonical_hashes, hashed, kmer_hashes, letter_numbers, letters_of, max_hash, segments, strands
from seqloom.session import settle

#: Rows that are turned to k-mers together, and the bytes of text that end such a group earlier.
GROUP_ROWS, GROUP_CHARS = 1024, 1 << 18

#: Characters that are cut out of a long sequence at a time: substring() walks from the start,
#: so k-mers taken straight from the whole would cost its length squared.
STRIDE = 256


def kmer_array(seq: Column, k: int, kind: str = "text", stride: int = STRIDE) -> Column:
    """Array of all k-mers of a sequence in order, or of their hashes, by built-in functions; empty if it is shorter than k."""
    pieces = F.transform(F.sequence(F.lit(0), F.length(seq) - k, F.lit(stride)), lambda at: F.substring(seq, at + 1, F.lit(stride + k - 1)))
    grams = F.flatten(F.transform(pieces, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (k - 1)), lambda i: hashed(F.substring(w, i, F.lit(k)), kind))))
    kind_of = "string" if kind == "text" else "long"
    return F.when(F.length(seq) >= k, grams).otherwise(F.array().cast(f"array<{kind_of}>"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def _groups(batch: pa.RecordBatch, cols: tuple[str, ...]) -> Iterator[tuple[int, int, list[tuple[str, ...]]]]:
    """Consecutive rows of a batch: first, end and their texts (nulls as empty), of bounded size.

    Only a group's texts are ever Python strings, whatever the batch."""
    sizes = sum(pc.fill_null(pc.binary_length(batch[c]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols)
    ends = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + GROUP_CHARS)) + 1
        end = min(full, first + GROUP_ROWS, batch.num_rows)
        texts = ([t or "" for t in batch[c].slice(first, end - first).to_pylist()] for c in cols)
        yield first, end, list(zip(*texts, strict=True))
        first = end


def _row_lists(rows: DataFrame, keep: tuple[str, ...], texts: tuple[str, ...], count: StructField, codes: Callable[[list[tuple[str, ...]]], list[np.ndarray]]) -> DataFrame:
    """keep columns, the number of codes and the codes (longs) of each row's texts as an array."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType([*(rows.schema[c] for c in keep), count, StructField("kmers", ArrayType(LongType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for batch in it:
            for first, end, values in _groups(batch, texts):
                found = codes(values)
                sizes = np.array([len(h) for h in found], np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                kept = [batch[c].slice(first, end - first) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes).cast(arrow.field(count.name).type), lists.cast(arrow.field("kmers").type)], schema=arrow)

    return rows.mapInArrow(run, out)


def _row_places(rows: DataFrame, id_col: str, seq_col: str, value: StructField, places: Callable[[list[str]], list[tuple[np.ndarray, pa.Array]]]) -> DataFrame:
    """(id, pos, value): for each row one line for each of its places."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = rows.select(id_col, seq_col)
    out = StructType([rows.schema[id_col], StructField("pos", LongType()), value])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for batch in it:
            for first, end, values in _groups(batch, (seq_col,)):
                found = places([v[0] for v in values])
                owner = np.repeat(np.arange(first, end), [len(p) for p, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [batch[id_col].take(pa.array(owner)), pa.array(np.concatenate([p for p, _ in found]), pa.int64()), pa.concat_arrays([v for _, v in found]).cast(arrow.field(value.name).type)],
                    schema=arrow,
                )

    return rows.mapInArrow(run, out)


def canonical_kmers(seqs: DataFrame, k: int, circular: bool = False, id_col: str = "ref_id", seq_col: str = "seq") -> DataFrame:
    """(id, pos, kmer): the smaller of each DNA k-mer and its reverse complement; windows with other letters are skipped."""

    def place(text: str) -> tuple[np.ndarray, pa.Array]:
        spots, texts = [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
        for begin, run in segments(text + text[: k - 1] if circular and len(text) >= k else text):
            data, starts = strands(run, k)
            spots.append(begin + np.arange(len(starts)))
            texts.append(np.frombuffer(data, np.uint8)[starts[:, None] + np.arange(k)].ravel() if len(starts) else texts[0])
        at = np.concatenate(spots)
        ends = np.arange(len(at) + 1, dtype=np.int32) * k
        return at, pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.concatenate(texts)))

    return _row_places(seqs, id_col, seq_col, StructField("kmer", StringType()), lambda texts: [place(t) for t in texts])


def canonical_summary(seqs: DataFrame, k: int, id_col: str = "ref_id", seq_col: str = "seq") -> DataFrame:
    """(id, kmers, distinct_kmers, least_kmer): what canonical_kmers() of each id come to, those without a k-mer left out.

    All is found inside the row, so that no k-mer is shuffled; the texts of an id that has
    several rows are put together first, with a letter between them that no k-mer has."""
    several = settle(seqs.groupBy(id_col).agg(F.count("*").alias("_n")).filter("_n > 1").select(id_col))
    rows = seqs.select(id_col, seq_col)
    if not several.isEmpty():
        joined = rows.join(several, id_col, "left_semi").groupBy(id_col).agg(F.array_join(F.collect_list(seq_col), "N").alias(seq_col))
        rows = rows.join(several, id_col, "left_anti").unionByName(joined)
    out = StructType([rows.schema[id_col], StructField("kmers", LongType()), StructField("distinct_kmers", LongType()), StructField("least_kmer", StringType())])

    def summary(text: str) -> tuple[int, int, str | None]:
        total, numbers, least = 0, [], None
        for _, run in segments(text):
            data, starts = strands(run, k)
            if len(starts) == 0:
                continue
            total += len(starts)
            if k <= 32:  # two bits a letter: the numbers have the order of the texts
                numbers.append(_distinct(letter_numbers(data, k)[starts].view(np.int64)))
            else:
                numbers.append(np.unique(np.array([data[a : a + k] for a in starts.tolist()], f"S{k}")))
        if total:
            codes = np.unique(np.concatenate(numbers))
            first = codes.view(np.uint64).min() if k <= 32 else codes[0]
            least = letters_of(int(first), k) if k <= 32 else first.decode()
            return total, len(codes), least
        return 0, 0, None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for first, end, texts in _groups(batch, (seq_col,)):
                found = [summary(t) for (t,) in texts]
                kept = [i for i, f in enumerate(found) if f[0]]
                cols = [pa.array([found[i][j] for i in kept], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch[id_col].slice(first, end - first).take(pa.array(kept, pa.int64())), *cols], names=out.names)

    return rows.mapInArrow(run, out)


_DNA_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def as_dna(rows: DataFrame, seq_col: str = "seq") -> DataFrame:
    """rows with each character of the sequence as a letter of DNA, by its code point modulo four; nulls stay."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = rows.schema

    def letters(text: str | None) -> str | None:
        return text and _DNA_LETTERS[np.frombuffer(text.encode("utf-32-le"), np.uint32) & 3].tobytes().decode()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in it:
            for first, end, _ in _groups(batch, (seq_col,)):
                part = batch.slice(first, end - first)
                made = pa.array([letters(t) for t in part[seq_col].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([made if c == seq_col else part[c] for c in schema.names], schema=arrow)

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Settings:
    """What makes a sequence's k-mers: the same for databases and for queries, as a database's manifest says.

    canonical: of DNA the lesser of a k-mer and its reverse complement, windows with other
    letters skipped; otherwise any letters, one strand. kind "nt" is always canonical."""

    ks: tuple[int, ...] = (21,)
    kind: str = "md5"
    canonical: bool = False
    scale: float = 1
    minimizer_w: int = 0
    syncmer_s: int = 0

    def __post_init__(self):
        if self.minimizer_w and self.syncmer_s:
            raise ValueError("minimizers or syncmers, not both")
        if (self.minimizer_w or self.syncmer_s) and len(self.ks) > 1:
            raise ValueError("one k only for minimizers and syncmers")

    @classmethod
    def of(cls, manifest: dict) -> Settings:
        return cls(tuple(manifest["k"] or (21,)), manifest["hash"] or "md5", bool(manifest["canonical"]), manifest["scale"] or 1, manifest["minimizer_w"] or 0, manifest["syncmer_s"] or 0)

    def manifest(self) -> dict:
        return {"k": list(self.ks), "hash": self.kind, "canonical": self.canonical or self.kind == "nt", "hashed": True, "scaled": self.scale > 1, "scale": int(self.scale), "minimizer_w": self.minimizer_w, "syncmer_s": self.syncmer_s}

    def runs(self, texts: list[str], k: int, circular: int = 0) -> list[list[tuple[int, np.ndarray]]]:
        """For each text (begin, hashes) of its runs of letters that k-mers may have."""
        texts = [t + t[:circular] if len(t) > circular else t for t in texts]
        if self.canonical or self.kind == "nt":
            return canonical_hashes(texts, k, self.kind)
        return [[(0, h)] for h in kmer_hashes(texts, k, self.kind)]

    def codes(self, texts: list[str], k: int, circular: bool = False) -> list[np.ndarray]:
        """The hashes that stand for each text, in order and with repeats: of all k-mers, of minimizers or of
        closed syncmers; not zeros, nor those beyond the sketch's largest."""
        wrap = k - 1 if circular else 0
        whole = self.runs(texts, k, wrap)
        if self.minimizer_w:
            whole = [[(b, h[minimizer_spots(h, self.minimizer_w)]) for b, h in runs] for runs in whole]
        elif self.syncmer_s:
            inner = self.runs(texts, self.syncmer_s, wrap)
            whole = [[(b, h[syncmer_spots(h, s, k, self.syncmer_s)]) for (b, h), (_, s) in zip(runs, shorter, strict=True)] for runs, shorter in zip(whole, inner, strict=True)]
        top = max_hash(self.scale, self.kind) if self.scale > 1 else None
        return [_selected(np.concatenate([np.empty(0, np.int64), *(h for _, h in runs)]), top, self.kind == "nt") for runs in whole]

    def union(self, texts: list[str], circular: bool = False, distinct: bool = True) -> list[np.ndarray]:
        """codes() of all k of each text in one, each once."""
        every = (np.concatenate(hs) for hs in zip(*(self.codes(texts, k, circular) for k in self.ks), strict=True))
        return [_distinct(h) if distinct else h for h in every]


def concatenated(records: DataFrame, key: str, order: str, k: int, seq_col: str = "seq", spacer: str = "N") -> DataFrame:
    """One sequence for each key: its records in order, with k-1 spacers between them."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(seq_col), F.lit("")).alias("s"))))
    return records.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["s"]), spacer * (k - 1)).alias("seq"), F.count("*").alias("contigs"))


def chunks(seqs: DataFrame, k: int, number: int = 0, size: int = 0, overlap: int | None = None, min_ref: int = 1000, circular: bool = False, id_col: str = "ref_id", seq_col: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, chunk_idx, chunks, begin, seq): overlapping windows, by number or by size; shorter references stay whole.

    Windows of at most the overlap, or shorter than k, are left out unless they
    are the whole reference; chunk_idx counts those kept."""
    if number and size:
        raise ValueError("give a number or a size of chunks, not both")
    o = k - 1 if overlap is None else overlap
    if size and (size < k or size <= o):
        raise ValueError("the size must be at least k and exceed the overlap")
    length = F.length(seq_col)
    if number > 1:
        if circular:
            window = F.expr(f"CAST((length(`{seq_col}`) + {number * o + number - 1}) DIV {number} AS INT)")
        else:
            window = F.expr(f"CAST((length(`{seq_col}`) + {(number - 1) * o + number - 1}) DIV {number} AS INT)")
    else:
        window = F.lit(size)
    split = (length >= min_ref) & (window > o) if number > 1 or size else F.lit(False)
    round_ = circular and number > 1
    rows = seqs.select(F.col(id_col), *keep, F.col(seq_col).alias("_s"), F.when(split, window).otherwise(length).cast("long").alias("_w"), split.alias("_split")).filter("_s is not null")

    def cut(text: str, w: int, parted: bool) -> list[tuple]:
        if not parted:
            found = [(0, text)] if len(text) >= k else []
        else:
            whole = text + text[:w] if round_ else text
            found = [(at, whole[at : at + w]) for at in range(0, len(text), w - o)]
            # Windows that go round the end: exactly so many, all of full length.
            found = found[:number] if round_ else [(at, x) for at, x in found if len(x) - 1 > o and len(x) >= k]
        return [(i, len(found), at, x) for i, (at, x) in enumerate(found)]

    return cut_up(rows, (id_col, *keep), "chunk_idx int, chunks int, begin int, seq string", ("_s", "_w", "_split"), cut)


#: Characters of pieces that leave a task together.
_SENT = 1 << 24


def cut_up(rows: DataFrame, keep: tuple[str, ...], schema: str, given: tuple[str, ...], cut: Callable[..., list[tuple]]) -> DataFrame:
    """keep and what cut(given …) lists for each row, its last field a text.

    In Python a piece of a text costs its own length; substring() walks from the start of the text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType([*(rows.schema[c] for c in keep), *StructType.fromDDL(schema)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for batch in it:
            owner, found, size = [], [], 0
            for i, row in enumerate(zip(*(batch[c].to_pylist() for c in given), strict=True)):
                for piece in cut(*row):
                    owner.append(i)
                    found.append(piece)
                    size += len(piece[-1])
                    if size > _SENT:
                        yield sent(batch, owner, found, arrow)
                        owner, found, size = [], [], 0
            if found:
                yield sent(batch, owner, found, arrow)

    def sent(batch: pa.RecordBatch, owner: list[int], found: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
        kept = [batch[c].take(pa.array(owner)) for c in keep]
        cols = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(arrow)[len(keep) :], strict=True)]
        return pa.RecordBatch.from_arrays([*kept, *cols], schema=arrow)

    return rows.select(*keep, *given).mapInArrow(run, out)


def _selected(codes: np.ndarray, top: int | None, unsigned: bool = False) -> np.ndarray:
    """Without zeros and without those beyond the sketch's largest hash."""
    if top is None:
        return codes[codes != 0]
    return codes[(codes != 0) & ((codes.view(np.uint64) <= np.uint64(top)) if unsigned else (codes <= top))]


def _distinct(codes: np.ndarray) -> np.ndarray:
    if len(codes) == 0:
        return codes
    ranked = np.sort(codes)  # far faster here than a hash table
    return ranked[np.concatenate(([True], ranked[1:] != ranked[:-1]))]


def kmer_sets(chunked: DataFrame, k: int | list[int], kind: str = "roll", scale: float = 1, keep: tuple[str, ...] = ("ref_id", "chunk_idx"), seq_col: str = "seq") -> DataFrame:
    """keep columns, n_kmers and the distinct hashes of each row as an array.

    Distinctness is settled inside the row, so building sets shuffles nothing.
    Several k give the union of their sets; a scale above 1 keeps the smallest
    hashes (FracMinHash); zero hashes are dropped."""
    return sets_of(chunked, Settings((k,) if isinstance(k, int) else tuple(k), kind, scale=scale), keep, seq_col)


def sets_of(chunked: DataFrame, settings: Settings, keep: tuple[str, ...] = ("ref_id", "chunk_idx"), seq_col: str = "seq", circular: bool = False) -> DataFrame:
    """As kmer_sets(), by any settings; circular sequences go on with their beginning."""

    def codes(rows: list[tuple[str, ...]]) -> list[np.ndarray]:
        return settings.union([r[0] for r in rows], circular)

    rows = chunked.select(*keep, F.col(seq_col).alias("_seq"))
    return _row_lists(rows, keep, ("_seq",), StructField("n_kmers", LongType()), codes)


def exploded(sets: DataFrame, keep: tuple[str, ...] = ("ref_id", "chunk_idx")) -> DataFrame:
    return sets.select(*keep, F.explode("kmers").alias("kmer"))


def minimizer_spots(h: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least hash of some window (the first of equals); none in a run shorter than one."""
    if len(h) < window:
        return np.empty(0, np.int64)
    return np.unique(sliding_window_view(h, window).argmin(axis=1) + np.arange(len(h) - window + 1))


def syncmer_spots(h: np.ndarray, inner: np.ndarray, k: int, s: int) -> np.ndarray:
    """Positions of k-mers (hashes h) whose least s-mer (hashes inner) stands first or last."""
    if len(h) == 0:
        return np.empty(0, np.int64)
    inside = sliding_window_view(inner, k - s + 1)
    least = inside.min(axis=1)
    return np.flatnonzero((inside[:, 0] == least) | (inside[:, -1] == least))


def minimizers(seqs: DataFrame, k: int, window: int, kind: str = "md5", id_col: str = "ref_id", seq_col: str = "seq") -> DataFrame:
    """(id, pos, kmer): positions that hold the least hash of some window of ``window`` k-mers."""

    def place(h: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        spots = minimizer_spots(h, window)
        return spots, pa.array(h[spots])

    return _row_places(seqs, id_col, seq_col, StructField("kmer", LongType()), lambda texts: [place(h) for h in kmer_hashes(texts, k, kind)])


def syncmers(seqs: DataFrame, k: int, s: int, kind: str = "md5", id_col: str = "ref_id", seq_col: str = "seq") -> DataFrame:
    """(id, pos, kmer): closed syncmers, k-mers whose least s-mer stands first or last."""

    def place(h: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        spots = syncmer_spots(h, inner, k, s)
        return spots, pa.array(h[spots])

    return _row_places(seqs, id_col, seq_col, StructField("kmer", LongType()), lambda texts: list(map(place, kmer_hashes(texts, k, kind), kmer_hashes(texts, s, kind))))


def query_kmers(queries: DataFrame, k: int, kind: str = "roll", dedup_above: int = 256, id_col: str = "query", seq_col: str = "seq", seq2_col: str | None = None, scale: float = 1, min_len: int = 0) -> DataFrame:
    """(query, q_len, q_kmers, kmers): duplicates stay unless there are more than ``dedup_above`` k-mers.

    Mates add their k-mers to the same list. Queries shorter than min_len, with no
    mate that long either, have none."""
    return query_sets(queries, Settings((k,), kind, scale=scale), k, dedup_above, id_col, seq_col, seq2_col, min_len)


def query_sets(queries: DataFrame, settings: Settings, k: int, dedup_above: int = 256, id_col: str = "query", seq_col: str = "seq", seq2_col: str | None = None, min_len: int = 0) -> DataFrame:
    """As query_kmers(), by the settings of a database; queries are never circular."""
    mate = F.coalesce(F.col(seq2_col), F.lit("")) if seq2_col else F.lit("")
    length = F.length(seq_col) + F.length(mate)

    def codes(pairs: list[tuple[str, ...]]) -> list[np.ndarray]:
        usable = [p if max(map(len, p)) >= min_len else ("", "") for p in pairs]
        return list(map(chosen, *(settings.codes([p[i] for p in usable], k) for i in (0, 1))))

    def chosen(own: np.ndarray, other: np.ndarray) -> np.ndarray:
        h = np.concatenate((own, other))
        return _distinct(h) if len(h) > dedup_above else h

    rows = queries.select(F.col(id_col).alias("query"), length.cast("int").alias("q_len"), F.col(seq_col).alias("_seq"), mate.alias("_mate"))
    return _row_lists(rows, ("query", "q_len"), ("_seq", "_mate"), StructField("q_kmers", IntegerType()), codes)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds query_idx: 0, 1, 2 … in the given order, without one task for all rows.

    Rows are dealt by ranges of the order; a range's numbers start after the count of those
    before. The ranges come from a sample that differs from one computation to the next, so
    they are settled before they are counted."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = settle(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").count()
    before = counts.select("_p", (F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_n", inside).join(F.broadcast(before), "_p").withColumn("query_idx", (F.col("_b") + F.col("_n") - 1).cast("long")).drop("_p", "_n", "_b")
