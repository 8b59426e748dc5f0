"""SpotSigs document fingerprints.

A signature is a common word (anchor) with the next ``CHAIN`` content words
after it, hashed to 32 bits; near the end of a text the chain may be shorter. A
text's fingerprint is the set of its distinct signatures. Words are runs of
letters and digits, lower-cased. A text without any anchored chain takes every
word as an anchor of the words after it, so junk and unlisted languages have
fingerprints too.

Fingerprints are compared by Jaccard similarity, pruned: sets whose sizes alone
rule a threshold out are never intersected. ``similar_pairs`` deals sets out by
ranges of set length such that only equal and neighbouring ranges can meet,
joins the rarest signatures of each set (as many as a similar set must share one
of) and verifies candidates.

Defined results: null counts as empty; a text without words has the empty
fingerprint, alike (1) only to the empty one; rows of equal ids are ordered by a
hash of their texts, null ids first; a sole row is its own next; texts of any length
are read whole, piece by piece (a word of more than half a piece without white space
counts as several); one anchored chain is enough for a text to have no others; repeated
rows keep a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.llm.batches import BLOCK_BYTES, blocks, joined, lowered, map_columns, pieces, raw, texts
from seqloom.llm.winnowing import word_hashes, word_spans

CHAIN = 3
_STEP = 1 << 20

#: Common words that serve as anchors.
ANCHORS = (
    "the of and to a in is it that for on was with as be by at this are from or an not but have had he she they you we his her its which were been "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "le la les de des et un une du en que qui dans pour sur par avec est au pas ce il sont plus se ne aux ou son sa ses cette "
    "el los las del y se con por una su para como al lo más pero sus"
).split()

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _hash_words(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        data = np.frombuffer(w.lower().encode(), np.uint8)
        s, e, _ = word_spans(data, np.array([0, len(data)]))
        out.append(word_hashes(data, s, e))
    return np.unique(np.concatenate([*out, np.empty(0, np.uint64)]))


_ANCHOR_HASHES = _hash_words(ANCHORS)


def signatures(values, anchors: np.ndarray = _ANCHOR_HASHES, chain: int = CHAIN, limit: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text."""
    for b in blocks(values, limit):
        if len(b.data) > limit:
            yield _of_long(b.data, anchors, chain, limit)
            continue
        low, n = lowered(b), b.end - b.first
        starts, ends, bounds = word_spans(low.data, low.offsets)
        h = word_hashes(low.data, starts, ends)
        if len(h) == 0:
            yield from (np.empty(0, np.uint32) for _ in range(n))
            continue
        owner = np.repeat(np.arange(n), np.diff(bounds))
        anchor = _member(h, anchors)
        content = np.flatnonzero(~anchor)
        spots = np.flatnonzero(anchor)
        sig, has = _chains(h, spots, content, owner, chain)
        spots, sig = spots[has], sig[has]
        bare = np.flatnonzero(np.bincount(owner[spots], minlength=n) == 0)
        if len(bare):  # every word of such a text is an anchor of the words after it
            own = np.flatnonzero(np.isin(owner, bare))
            more, _ = _chains(h, own, np.arange(len(h)), owner, chain)
            spots, sig = np.concatenate((spots, own)), np.concatenate((sig, more))
        keys = np.unique(owner[spots].astype(np.uint64) << np.uint64(32) | sig)
        cut = np.searchsorted(keys, np.arange(n + 1).astype(np.uint64) << np.uint64(32))
        small = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for i in range(n):
            yield small[cut[i] : cut[i + 1]]


def _of_long(data: np.ndarray, anchors: np.ndarray, chain: int, limit: int) -> np.ndarray:
    """As signatures(), of one text, from its last piece to its first, with the words that follow a piece at hand."""
    for bare in (False, True):
        found, after = np.empty(0, np.uint64), np.empty(0, np.uint64)
        for s, e in reversed(pieces(data, limit)):
            low = lowered(joined([data[s:e].tobytes()]))
            h = word_hashes(low.data, *word_spans(low.data, low.offsets)[:2])
            anchor = np.full(len(h), bare) | _member(h, anchors)
            here = np.concatenate((h, after))
            content = np.concatenate((np.arange(len(h)) if bare else np.flatnonzero(~anchor), np.arange(len(h), len(here))))
            spots = np.arange(len(h)) if bare else np.flatnonzero(anchor)
            sig, has = _chains(here, spots, content, np.zeros(len(here), np.int64), chain)
            found = np.union1d(found, sig if bare else sig[has])
            after = here[content[:chain]]
        if len(found):
            break
    return found.astype(np.uint32)


def _member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def _chains(h: np.ndarray, spots: np.ndarray, content: np.ndarray, owner: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature of each spot, and whether any word follows it in its text."""
    at = np.searchsorted(content, spots, side="right")
    sig, has = h[spots] * _FACTORS[0], np.zeros(len(spots), bool)
    for j in range(chain):
        k = at + j
        ok = k < len(content)
        ok[ok] = owner[content[k[ok]]] == owner[spots[ok]]
        sig[ok] += h[content[k[ok]]] * _FACTORS[1 + j % 4] * np.uint64(2 * (j // 4) + 1)
        has |= ok
    sig ^= sig >> np.uint64(29)
    return (sig * _FACTORS[2]) >> np.uint64(32), has


def jaccard(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Similarity of two sorted sets; 0 without looking where their sizes rule ``floor`` out."""
    small, large = sorted((len(a), len(b)))
    if large == 0:
        return 1.0
    if small < floor * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def as_text(sig: np.ndarray) -> str:
    """The set as text: its members in order, four bytes each, base64."""
    return base64.b64encode(np.ascontiguousarray(sig, "<u4").tobytes()).decode()


def _characters(text: bytes) -> int:
    return sum(int(np.count_nonzero((np.frombuffer(text, np.uint8, min(_STEP, len(text) - at), at) & 0xC0) != 0x80)) for at in range(0, len(text), _STEP))


def _place(text: bytes, k: int) -> int:
    """The byte at which the k-th character (from 0) begins, or the end."""
    for at in range(0, len(text), _STEP):
        begins = np.flatnonzero((np.frombuffer(text, np.uint8, min(_STEP, len(text) - at), at) & 0xC0) != 0x80)
        if k < len(begins):
            return at + int(begins[k])
        k -= len(begins)
    return len(text)


def edited(text: bytes, following: bytes) -> bytes:
    """The last half of the text's characters replaced by as many of the beginning of the following one."""
    n = _characters(text)
    return text[: _place(text, n - n // 2)] + following[: _place(following, n // 2)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, signatures) for each row."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"], "signatures": [s.astype(np.int64).tolist() for s in signatures(batch["text"])]}

    rows = texts(docs, id_col, text_col)
    return map_columns(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, signatures array<long>")


_NEXT = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _quantiles(ids: DataFrame, parts: int) -> list:
    """Ids that deal the rows into about equal ranges; they decide where rows are compared, not how.

    Numbers have quantiles of their own; strings (as bytes) those of some thousand chosen by
    hash. Ids of other types make one range."""
    kind, at = ids.dtypes[0][1], [i / parts for i in range(1, parts)]
    if parts < 2:
        return []
    if kind in ("bigint", "int", "smallint", "tinyint", "double", "float"):
        return sorted(set(ids.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", at, 0.1 / parts)))
    if kind != "string":
        return []
    n = ids.count()
    share = min(1.0, 40 * parts / max(n, 1))
    some = sorted(r[0].encode() for r in ids.filter(F.pmod(F.xxhash64("doc_id", F.lit("range")), F.lit(1 << 30)) < share * (1 << 30)).filter("doc_id is not null").distinct().limit(200 * parts).collect())
    return sorted({some[int(q * len(some))] for q in at}) if some else []


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its half-replaced version, and their likeness, by ascending id.

    Ids are dealt into ranges by their quantiles. Each row goes to its range; the
    first row of a range also goes to the range before it (the very first to the
    last), so that one shuffle of the texts suffices and every range, sorted, is
    streamed with one row of memory across batches. What the driver holds is one
    id for each range."""
    rows = texts(docs, id_col, text_col).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    kind = dict(rows.dtypes)["doc_id"]
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _quantiles(rows.select("doc_id"), parts)
    limits = np.array(cuts, object if kind == "string" else np.float64)

    @F.pandas_udf("int")
    def range_of(ids):
        import pandas as pd

        found = ids.fillna("").str.encode("utf-8").to_numpy() if kind == "string" else ids.astype("float64").fillna(-np.inf).to_numpy()
        return pd.Series(np.searchsorted(limits, found, side="right").astype(np.int32))

    rows = rows.withColumn("range", range_of("doc_id") if cuts else F.lit(0))
    heads = rows.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")).alias("k")).select("range", "k.doc_id", "k.h").orderBy("range").collect()
    before = [heads[i - 1]["range"] for i in range(len(heads))]
    schema = T.StructType([T.StructField("hid", rows.schema["doc_id"].dataType), T.StructField("hh", T.LongType()), T.StructField("before", T.IntegerType())])
    guests = F.broadcast(spark.createDataFrame([(r["doc_id"], r["h"], b) for r, b in zip(heads, before, strict=True)], schema))
    tagged = rows.join(guests, rows["doc_id"].eqNullSafe(guests["hid"]) & (rows["h"] == guests["hh"]), "left")
    own, other = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(1).alias("guest"))
    dealt = tagged.select("doc_id", "h", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("to"))
    dealt = dealt.select("doc_id", "h", "text", F.col("to.range").alias("range"), F.col("to.guest").alias("guest"))

    arrow = to_arrow_schema(T.StructType.fromDDL(_NEXT.format(kind=kind)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last own row of the range that is being read
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = []
                for row in zip(part["range"].to_pylist(), part["guest"].to_pylist(), part["doc_id"].to_pylist(), raw(part["text"]), strict=True):
                    if held is not None and held[0] == row[0]:
                        found.append((held, row))
                    held = row if row[1] == 0 else None
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(_compared(found), arrow, strict=True)], schema=arrow)

    ordered = dealt.repartitionById(parts, "range").sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_first(), "h")
    return ordered.mapInArrow(run, _NEXT.format(kind=kind))


def _compared(found: list[tuple[tuple, tuple]]) -> list[list]:
    changed = [edited(a[3], b[3]) for a, b in found]
    # Neighbours follow one another, so a text is mostly both this row's next and the next row's own.
    sequence = [a[3] for a, _ in found]
    own = list(signatures([*sequence, *(b[3] for _, b in found[-1:])]))
    new = list(signatures(changed))
    out: list[list] = [[] for _ in range(7)]
    for i, (a, b) in enumerate(found):
        follows = own[i + 1] if i + 1 == len(found) or found[i + 1][0] is b else next(signatures([b[3]]))
        row = (a[2], _characters(a[3]), hashlib.sha256(changed[i]).hexdigest(), as_text(own[i]), as_text(new[i]), jaccard(own[i], new[i]), jaccard(own[i], follows))
        for c, v in zip(out, row, strict=True):
            c.append(v)
    return out


def similar_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class_id) of equal fingerprints, and pairs (class_a, class_b, similarity) of classes.

    A class is named by the digest of its set, so exact copies never meet in the
    join. Sets go to the length range of their size and the one above; in each a
    set is found through its ``size - ceil(t * size) + 1`` rarest signatures."""
    step = -math.log(threshold)
    found = fingerprints(docs, id_col, text_col).withColumn("class_id", F.sha2(F.concat_ws(",", "signatures"), 256))
    members = found.select("doc_id", "class_id")
    sets = found.groupBy("class_id").agg(F.first("signatures").alias("s")).withColumn("n", F.size("s")).filter("n > 0")
    count = sets.select(F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    ranked = sets.select("class_id", "n", F.explode("s").alias("g")).join(count, "g").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("r"))
    keys = ranked.select("class_id", "n", F.explode(F.slice("r", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1)).alias("k"))
    bucket = F.floor(F.log("n") / F.lit(step) + F.lit(1e-9)).cast("int")
    keys = keys.select("class_id", "n", F.col("k.g").alias("g"), bucket.alias("len"))
    left = keys.select(F.col("class_id").alias("class_a"), F.col("n").alias("na"), "g", F.explode(F.array(F.col("len"), F.col("len") + 1)).alias("len"))
    right = keys.select(F.col("class_id").alias("class_b"), F.col("n").alias("nb"), "g", "len")
    near = left.join(right, ["g", "len"]).filter((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("class_a") < F.col("class_b")))).filter(F.col("na") >= F.col("nb") * F.lit(threshold) - F.lit(1e-9))
    near = near.select("class_a", "class_b").distinct()
    full = near.join(sets.select(F.col("class_id").alias("class_a"), F.col("s").alias("sa")), "class_a").join(sets.select(F.col("class_id").alias("class_b"), F.col("s").alias("sb")), "class_b")
    both = F.size(F.array_intersect("sa", "sb"))
    full = full.withColumn("similarity", both / (F.size("sa") + F.size("sb") - both))
    return members, full.filter(F.col("similarity") >= F.lit(threshold) - F.lit(1e-12)).select("class_a", "class_b", "similarity")
