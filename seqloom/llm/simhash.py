"""SimHash near-duplicate detection: pigeonhole blocks and connected components.

Fingerprints that differ in at most ``MAX_BITS`` = 3 of 64 bits agree on at
least three of six blocks, so joining on every choice of three blocks finds all
close pairs. Exact copies collapse to one fingerprint first. A bucket whose
members exceed ``BUCKET`` is never compared as a whole: its members are keyed
anew on every choice of thirteen of sixteen 4-bit blocks, where only twelve bits
stay free, so that a bucket holds 4,096 different fingerprints at the very most.
A bucket yields one link from each member to the smallest member it reaches
inside the bucket, never all pairs; components join these links.

Defined results: null, empty and white-space texts have fingerprint zero and
link like any other; texts of any length are hashed whole, part by part;
bits set in exactly half of the shingles are 0; repeated rows keep one output row each; a null id is never
the smallest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.batches import map_columns, raw, texts
from seqloom.llm.durable import settle

SEED = 42
SHINGLE = 3
MAX_BITS = 3
BUCKET = 4096
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int32)
_CHUNK = 1 << 16
#: Bytes of text whose words are held at once.
_PART = 1 << 18
_WHITE = re.compile(rb"[ \t-\r]")


def _parts(text: bytes, limit: int) -> Iterator[bytes]:
    """The text in parts of about ``limit`` bytes, cut at white space alone."""
    at = 0
    while len(text) - at > limit:
        white = _WHITE.search(text, at + limit)
        if white is None:
            break
        yield text[at : white.start()]
        at = white.end()
    yield text[at:] if at else text


def fingerprint(text: bytes, limit: int = _PART) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text over its word shingles, repeats included."""
    histogram, n, words = np.zeros(2048, np.int64), 0, []
    for part in _parts(text, limit):
        # For bytes lower() is A-Z, and split() is white space \x20 \x09-\x0D; the last words begin the next part's shingles.
        words = [*words[1 - SHINGLE :], *part.lower().split()]
        if len(words) >= SHINGLE:
            count = len(words) - SHINGLE + 1
            n += count
            histogram += _histogram(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)), count)
    if n == 0:
        if not words:
            return 0
        n = 1
        histogram += _histogram([b" ".join(words)], 1)
    ones = np.einsum("lv,lvb->lb", histogram.reshape(8, 256), np.broadcast_to(_BITS, (8, 256, 8)))
    return int.from_bytes(np.packbits(2 * ones > n, axis=1, bitorder="little").tobytes(), "big")


def _histogram(shingles, n: int) -> np.ndarray:
    """How often each byte of the hash has each value."""
    joined = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(n, 8)
    out = np.zeros(2048, np.int64)
    for at in range(0, n, _CHUNK):
        out += np.bincount((joined[at : at + _CHUNK] + _LANES).ravel(), minlength=2048)
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) for each row; fp as a signed long."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "fp": [signed(fingerprint(t)) for t in raw(batch["text"])]}

    rows = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    kind = dict(rows.dtypes)["doc_id"]
    return map_columns(rows, run, f"doc_id {kind}, text_hash long, fp long")


def block_masks(blocks: int) -> list[int]:
    """Masks (signed) that keep all but MAX_BITS of so many blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [signed(sum(keep)) for keep in combinations(parts, blocks - MAX_BITS)]


def bucket_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """From each member of a bucket to the smallest that it reaches by close steps inside it."""
    left, out = np.unique(fps), []
    while len(left) > 1:
        seed, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for x in frontier:
                near |= np.bitwise_count((left ^ x).view(np.uint64)) <= MAX_BITS
            frontier, left = left[near], left[~near]
            out += zip(frontier.tolist(), repeat(int(seed)), strict=False)
    return out


def _links(keyed: DataFrame, limit: int) -> DataFrame:
    """Streams sorted buckets: links (a, b), or the members a of an over-full bucket with b null."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)
        over: tuple[int, int] | None = None  # the over-full bucket that is still arriving

        def close(rows: np.ndarray, last: bool) -> tuple[list, list]:
            nonlocal held, over
            a: list[int] = []
            b: list[int | None] = []
            if over is not None:
                same = (rows[:, 0] == over[0]) & (rows[:, 1] == over[1])
                a += rows[same, 2].tolist()
                b += [None] * int(same.sum())
                if len(rows) and not same[-1]:
                    over = None
                rows = rows[~same]
            if len(rows) == 0:
                held = rows
                return a, b
            new = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
            starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(rows)]))
            held = rows[:0]
            if not last:
                if ends[-1] - starts[-1] <= limit:
                    held = rows[starts[-1] :]
                    starts, ends = starts[:-1], ends[:-1]
                else:
                    over = (int(rows[-1, 0]), int(rows[-1, 1]))
            sizes = ends - starts
            pair = starts[sizes == 2]
            x, y = rows[pair, 2], rows[pair + 1, 2]
            close_by = np.bitwise_count((x ^ y).view(np.uint64)) <= MAX_BITS
            a += np.maximum(x, y)[close_by].tolist()
            b += np.minimum(x, y)[close_by].tolist()
            for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=False):
                fps = rows[s:e, 2]
                if e - s > limit:
                    a += fps.tolist()
                    b += [None] * (e - s)
                else:
                    for m, r in bucket_links(fps):
                        a.append(m)
                        b.append(r)
            return a, b

        for batch in it:
            rows = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("combo", "key", "fp")], axis=1)
            a, b = close(np.concatenate((held, rows)), False)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = close(held, True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    parts = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keyed.repartition(parts, "combo", "key").sortWithinPartitions("combo", "key").mapInArrow(run, "a long, b long")


def _keyed(nodes: DataFrame, blocks: int) -> DataFrame:
    masks = F.array(*[F.lit(m) for m in block_masks(blocks)])
    return nodes.select("fp", F.posexplode(masks).alias("combo", "mask")).select("combo", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def links(nodes: DataFrame, limit: int = BUCKET) -> DataFrame:
    """Links (a, b), b smaller, whose components are those of all pairs of fp within MAX_BITS."""
    first = settle(_links(_keyed(nodes, 6), limit))
    hot = first.filter("b is null").select(F.col("a").alias("fp")).distinct()
    found = first.filter("b is not null")
    if not hot.isEmpty():
        found = found.unionByName(_links(_keyed(hot, 16), 1 << 12))
    return found.distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for nodes (long) that have edges (a, b): alternating large and small stars.

    Each round reads and writes the shared checkpoint folder; minima are aggregated
    before they are joined back, so that no node's neighbours meet in one row."""
    state = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = settle(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("v"), "m", "a")
        state = settle(small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for each row; root is a fingerprint of the component."""
    rows = settle(fingerprints(docs, id_col, text_col))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp")))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(low, "root").select("fp", "root", "component_id")
    return rows.join(by_fp, "fp", "left").select("doc_id", "text_hash", "fp", "root", "component_id")


def fp_hex(col: str):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: the smallest doc_id, then the smallest text hash.

    The text is shuffled once, by (doc_id, text hash); the window reuses that layout."""
    from pyspark.sql import Window

    found = near_duplicates(docs)
    # Plain keys without nulls: the window below then finds its rows where the join has put them.
    name = F.concat(F.col("doc_id").isNull().cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    first = F.min(F.struct("doc_id", "text_hash")).alias("k")
    stay = found.groupBy("root").agg(first).select(F.col("k.doc_id").alias("doc_id"), F.col("k.text_hash").alias("hash")).select(name.alias("id"), "hash").distinct()
    # The row as one struct, so that no column of the caller's can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(name.alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"), row)
    joined = keyed.join(stay, ["id", "hash"], "left_semi")
    one = joined.withColumn("n", F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(1))))
    return one.filter("n = 1").select("row.*")
