"""Benchmark decontamination by winnowing.

Words are runs of letters and digits of the text with A-Z lower-cased. Of the hashes of
``GRAM`` = 5 consecutive words the least of every ``SPAN`` = 4 neighbouring ones is the
fingerprint of the 5 + 4 - 1 = ``WINDOW`` = 8 words they cover, in documents and in
benchmark items alike, so a shared run of 8 words always shares a fingerprint. An item of
fewer words has one window, the whole item, with the hash of so many words. Documents keep
the windows whose fingerprint is in a bitmap of all the benchmark's (``BITMAP_BITS``, the
same size for any benchmark); these are joined to the benchmark's by fingerprint and words,
compared as bytes, so no hash decides alone. Neighbouring hits are one run.

The documents are read once, whatever the size of the benchmark. Its windows are sent to
all executors if there are at most ``BROADCAST_WINDOWS``; beyond, both sides are shuffled
by fingerprint, each fingerprint dealt over ``SALTS`` parts. Defined results: null and
word-less texts have zero counts; items without words never hit, items without an id are
left out; items of equal text all count; repeated rows keep one output row each; texts and
words of any length are taken whole, piece by piece (a word of over ``LONG`` bytes is
compared by its 128-bit digest); an empty table gives an empty result, an empty benchmark
no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.batches import BLOCK_BYTES, Block, blocks, map_columns, pieces, texts
from seqloom.llm.durable import settle

WINDOW = 8
GRAM = 5
SPAN = WINDOW - GRAM + 1
BITMAP_BITS = 26
BROADCAST_WINDOWS = 200_000
SALTS = 8
LONG = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_CODE = (_LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_P = 0x100000001B3
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _powers(n: int, base: int = _P) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_POWERS = _powers(4096)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts, and the first word of each text."""
    inside = _IS_WORD[_LOWER[data]]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    if len(starts) == 0:
        return starts, starts, np.zeros(len(offsets), np.int64)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    cuts = cuts[cuts > 0] - 1
    after[cuts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word, lower-cased."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    lens = ends - starts
    total = np.concatenate(([0], np.cumsum(lens)))
    at = np.arange(total[-1]) - np.repeat(total[:-1], lens)
    longest = int(lens.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    codes = _CODE[data[at + np.repeat(starts, lens)]] * powers[at]
    return _mix(np.add.reduceat(codes, total[:-1]) + lens.astype(np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(_P) + words[j : j + m]
    return _mix(out)


def window_fingerprints(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of each window of ``size`` words, by its first word: the least gram hash, or the hash of a shorter window."""
    if size < WINDOW:
        return gram_hashes(words, size)
    grams = gram_hashes(words, GRAM)
    m = len(grams) - SPAN + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    least = grams[:m].copy()
    for j in range(1, SPAN):
        np.minimum(least, grams[j : j + m], out=least)
    return least


class Window(NamedTuple):
    at: int  # its first word
    size: int
    begin: int  # its bytes
    stop: int
    fp: int  # signed
    words: bytes  # with one space between


def _digest(state, size: int) -> bytes:
    return b"\xff" + state.digest() + size.to_bytes(8, "big")


def _short(word: bytes) -> bytes:
    """A word, or the digest of a long one, which no UTF-8 text equals."""
    return word if len(word) <= LONG else _digest(hashlib.blake2b(word, digest_size=16), len(word))


def _hash_of(word: bytes) -> np.uint64:
    data = np.frombuffer(word, np.uint8)
    return word_hashes(data, np.array([0]), np.array([len(data)]))[0]


class _Words:
    """The words of the texts of a block, after the words (word, begin, stop) of ``front``; base: bytes before the block."""

    def __init__(self, block: Block, front: list[tuple[bytes, int, int]] = (), base: int = 0, drop: tuple[int, int] = (0, 0)):
        """drop: how many words at both ends of a sole text are fragments and left out."""
        self.low = _LOWER[block.data]
        starts, ends, bounds = word_spans(self.low, block.offsets)
        if any(drop):
            keep = slice(drop[0], len(starts) - drop[1])
            starts, ends = starts[keep], ends[keep]
            bounds = np.array([0, len(starts)])
        hashes = word_hashes(self.low, starts, ends)
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            hashes[i] = _hash_of(_short(self.low[starts[i] : ends[i]].tobytes()))
        self.front, self.starts, self.ends = list(front), starts, ends
        self.hashes = np.concatenate((np.array([_hash_of(w) for w, _, _ in front], np.uint64), hashes))
        offset = np.repeat(block.offsets[:-1], np.diff(bounds)) - base
        self.begin = np.concatenate((np.array([b for _, b, _ in front], np.int64), starts - offset))
        self.stop = np.concatenate((np.array([e for _, _, e in front], np.int64), ends - offset))
        self.bounds = bounds + len(self.front)
        self.bounds[0] = 0

    def word(self, i: int) -> bytes:
        i -= len(self.front)
        return self.front[i][0] if i < 0 else _short(self.low[self.starts[i] : self.ends[i]].tobytes())

    def windows(self, sizes: list[int], bitmap: np.ndarray | None) -> Iterator[tuple[int, Window]]:
        """(text, window) of the windows whose fingerprint may be in the bitmap, or of all."""
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        for size in sizes:
            fps = window_fingerprints(self.hashes, size)
            if len(fps) == 0:
                continue
            ok = owner[: len(fps)] == owner[size - 1 :]
            if bitmap is not None:
                bit = (fps >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                ok &= (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
            for i in np.flatnonzero(ok).tolist():
                o = int(owner[i])
                yield o, Window(i - int(self.bounds[o]), size, int(self.begin[i]), int(self.stop[i + size - 1]), int(fps[i].astype(np.int64)), b" ".join(map(self.word, range(i, i + size))))


def windows(values, sizes: list[int], bitmap: np.ndarray | None = None, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[Window]]]:
    """For each text: its number of words, and its windows of the sizes (all, or those the bitmap may know)."""
    for b in blocks(values, limit):
        if len(b.data) > limit:
            yield _of_long(b.data, sizes, bitmap, limit)
            continue
        words = _Words(b)
        out: list[list[Window]] = [[] for _ in range(b.end - b.first)]
        for o, w in words.windows(sizes, bitmap):
            out[o].append(w)
        yield from zip(np.diff(words.bounds).tolist(), out, strict=True)


class _Open:
    """A word that goes on beyond its piece."""

    def __init__(self, begin: int):
        self.begin, self.size, self.head, self.state = begin, 0, b"", hashlib.blake2b(digest_size=16)

    def add(self, part: np.ndarray) -> None:
        low = _LOWER[part].tobytes()
        self.state.update(low)
        self.size += len(low)
        self.head = (self.head + low)[: LONG + 1]

    def close(self) -> tuple[bytes, int, int]:
        return self.head if self.size <= LONG else _digest(self.state, self.size), self.begin, self.begin + self.size


def _of_long(data: np.ndarray, sizes: list[int], bitmap: np.ndarray | None, limit: int) -> tuple[int, list[Window]]:
    """As windows(), of one text, piece by piece: the last words of a piece stand before the next one's."""
    total, out, front, word = 0, [], [], None
    cuts = pieces(data, limit)
    for n, (s, e) in enumerate(cuts):
        part = data[s:e]
        inside = _IS_WORD[_LOWER[part]]
        goes_on = n + 1 < len(cuts) and bool(inside[-1]) and bool(_IS_WORD[_LOWER[data[e]]])
        carried, begun = len(front), word is not None
        if begun:
            stop = len(part) if inside.all() else int(np.argmin(inside))
            word.add(part[:stop])
            if stop == len(part) and goes_on:
                continue
            front, word = [*front, word.close()], None
        if goes_on:
            start = 0 if inside.all() else len(part) - int(np.argmin(inside[::-1]))
            word = _Open(s + start)
            word.add(part[start:])
        words = _Words(Block(0, 1, part, np.array([0, len(part)])), front, s, (int(begun), int(goes_on)))
        out += [w._replace(at=w.at + total - carried) for _, w in words.windows(sizes, bitmap) if w.at + w.size > carried]
        count = len(words.hashes)
        total += count - carried
        front = [(words.word(i), int(words.begin[i]), int(words.stop[i])) for i in range(max(0, count - WINDOW + 1), count)]
    return total, out


class Index(NamedTuple):
    """The benchmark's windows (size, fp, words, item), the sizes there are, a bitmap of fingerprints sent to all, whether rows may be too."""

    rows: DataFrame
    sizes: list[int]
    bitmap: Broadcast
    small: bool


def index(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> Index:
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("item is not null and text is not null")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            names = batch["item"].to_pylist()
            found = []
            for i, (n, ws) in enumerate(windows(batch["text"], [WINDOW])):
                # An item of fewer words than a window has the one window that is all of them.
                found += [(i, w) for w in (next(windows([batch["text"][i].as_py()], [n]))[1] if 0 < n < WINDOW else ws)]
            for at in range(0, max(1, len(found)), 8192):
                some = found[at : at + 8192]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in some], pa.string()), pa.array([w.size for _, w in some], pa.int32()), pa.array([w.fp for _, w in some], pa.int64()), pa.array([w.words for _, w in some], pa.binary())], names=["item", "size", "fp", "words"])

    rows = settle(items.mapInArrow(run, "item string, size int, fp long, words binary").distinct())
    per = rows.groupBy("size").agg(F.count("*").alias("n")).collect()
    bit = F.shiftrightunsigned("fp", 64 - BITMAP_BITS)
    # At most 2^(BITMAP_BITS - 6) rows, whatever the benchmark.
    masks = rows.select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(fp, {64 - BITMAP_BITS}) & 63 AS INT))").alias("mask")).groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), "<i8")
    bitmap[masks["at"].to_numpy()] = masks["mask"].to_numpy()
    shared = benchmark.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))
    return Index(rows, sorted(r["size"] for r in per), shared, sum(r["n"] for r in per) <= broadcast_windows)


_AT = "array<struct<at:int,size:int,begin:bigint,stop:bigint,fp:bigint,words:binary>>"


def _found(rows: DataFrame, idx: Index, keys: tuple[str, ...]) -> DataFrame:
    """keys, n_words and at, the windows that the bitmap may know, of each row (keys, text)."""
    kinds, sizes, shared = dict(rows.dtypes), idx.sizes, idx.bitmap

    def run(batch: pa.RecordBatch) -> dict:
        got = list(windows(batch["text"], sizes, shared.value))
        return {k: batch[k] for k in keys} | {"n_words": [n for n, _ in got], "at": [[w._asdict() for w in ws] for _, ws in got]}

    return map_columns(rows.select(*keys, "text"), run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", n_words long, at {_AT}")


_PLACE = ("at", "size", "begin", "stop")


def _hits(found: DataFrame, idx: Index, keys: tuple[str, ...]) -> DataFrame:
    """keys, at, size, begin, stop, item of the windows that the benchmark has indeed."""
    flat = found.select(*keys, F.explode("at").alias("w")).select(*keys, "w.*")
    on = ["size", "fp", "words"]
    if idx.small:
        return flat.join(F.broadcast(idx.rows), on).select(*keys, *_PLACE, "item")
    salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")
    return flat.withColumn("_salt", salt).join(idx.rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"]).select(*keys, *_PLACE, "item")


def merged(hits: list[dict]) -> list[list[int]]:
    """Runs [first word, end, first byte, end] of windows that overlap or follow one another."""
    out: list[list[int]] = []
    for h in sorted(hits, key=lambda h: (h["at"], h["size"])):
        end = h["at"] + h["size"]
        if out and h["at"] <= out[-1][1]:
            if end > out[-1][1]:
                out[-1][1], out[-1][3] = end, h["stop"]
        else:
            out.append([h["at"], end, h["begin"], h["stop"]])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, n_words, runs, items) for each row: hit word runs [from, to) and the items that occur.

    Rows are known by id and hash of the text; repeated rows are counted and written out again."""
    rows = texts(docs, id_col, text_col).withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")), F.length("text")))
    kind, keys = dict(rows.dtypes)["doc_id"], ("doc_id", "h")
    idx = index(benchmark, item_col, "text", broadcast_windows)
    found = settle(_found(rows, idx, keys))
    none = F.lit(None)
    base = found.select(*keys, "n_words", none.cast("struct<at:int,size:int,begin:bigint,stop:bigint>").alias("hit"), none.cast("string").alias("item"))
    hits = _hits(found, idx, keys).select(*keys, none.cast("long").alias("n_words"), F.struct(*_PLACE).alias("hit"), "item")
    grouped = base.unionByName(hits).groupBy(*keys).agg(F.count("n_words").alias("n"), F.max("n_words").alias("n_words"), F.collect_set("hit").alias("runs"), F.collect_set("item").alias("items"))

    def merge(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"], "n": batch["n"], "n_words": batch["n_words"], "runs": [[r[:2] for r in merged(x)] for x in batch["runs"].to_pylist()], "items": [sorted(x) for x in batch["items"].to_pylist()]}

    flat = map_columns(grouped.drop("h"), merge, f"doc_id {kind}, n long, n_words long, runs array<array<int>>, items array<string>")
    return flat.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))), "n_words", "runs", "items").drop("col")


def report(found: DataFrame) -> DataFrame:
    """Counts and the digest of the items that occur."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + (r[1] - r[0]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def cut(text: bytes, runs: list[list[int]]) -> bytes:
    """The text without the bytes of the runs."""
    keep, at = [], 0
    for _, _, begin, stop in runs:
        keep.append(text[at:begin])
        at = stop
    return b"".join([*keep, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, at_least: int = 2, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs, all columns, without leaks: rows in which ``at_least`` items occur go, and
    from the others the hit runs are cut, again until none is left; n_chars, if there, follows.

    Rows without a window that the bitmap may know stay where they lie; only the others,
    about as many as have leaks, are settled, numbered and joined."""
    idx = index(benchmark, broadcast_windows=broadcast_windows)
    shared, sizes = idx.bitmap, idx.sizes

    def part(known: bool) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                text = batch["text"]
                may = [len(ws) > 0 for _, ws in windows(text if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else text.cast(pa.string()), sizes, shared.value)]
                yield batch.filter(pa.array([m == known for m in may], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    # The other columns as one struct, so that no name clashes; rows that may have hits have a text.
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_"))
    left = settle(part(True).select(row.alias("row"), F.col("text").cast("string").alias("text"))).select(F.monotonically_increasing_id().alias("key"), "row", "text", F.lit(False).alias("changed"))
    out, first = [part(False)], True
    while not left.isEmpty():
        hits = _hits(_found(left, idx, ("key",)), idx, ("key",)).groupBy("key").agg(F.collect_set(F.struct(*_PLACE)).alias("runs"), F.count_distinct("item").alias("n"))
        marked = settle(left.join(hits, "key", "left"))
        out.append(_restored(marked.filter("runs is null"), docs))
        some = marked.filter("runs is not null" + (f" and n < {int(at_least)}" if first else ""))
        left, first = _cut_rows(some), False
    whole = out[0]
    for other in out[1:]:
        whole = whole.unionByName(other)
    return whole


def _cut_rows(rows: DataFrame) -> DataFrame:
    """(key, row, text, changed) without the runs of each row."""
    out = rows.select("key", "row", "text", "changed").schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            left = [cut(t.encode(), merged(r)).decode() for t, r in zip(batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["row"], pa.array(left, batch["text"].type), pa.array([True] * batch.num_rows, pa.bool_())], names=["key", "row", "text", "changed"])

    return rows.mapInArrow(run, out)


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    kinds = dict(docs.dtypes)

    def value(c: str) -> Column:
        if c == "text":
            return F.col("text").cast(kinds[c]).alias(c)
        own = F.col("row").getField(c)
        return (F.when(F.col("changed"), F.length("text").cast(kinds[c])).otherwise(own) if c == "n_chars" else own).alias(c)

    return rows.select(*[value(c) for c in docs.columns])
