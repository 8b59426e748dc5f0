"""Regions from sliding-window hits: gaps and islands with a folded score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Fixed value: the default pattern of window names.
NAME = r"^(.+)_sliding:(\d+)\-(\d+)$"
#: Positions of a reference whose windows are joined together.
_BUCKET = 1 << 18
SPECIES, ASSEMBLY = "species-specific", "assembly-specific"


def windows(found: DataFrame, pattern: str = NAME, min_q_cov: float = 0.55, max_fpr: float = 0.05, species: str = SPECIES, assembly: str = ASSEMBLY) -> DataFrame:
    """(ref, begin, end, type, score) of each query: the mean over targets of their best coverage.

    Names that the pattern doesn't match are an error."""
    rows = found.filter((F.col("q_cov") >= min_q_cov) & (F.col("fpr") <= max_fpr)).select("query", "target", "q_cov").repartition("query").groupBy("query", "target").agg(F.max("q_cov").alias("q_cov"))
    per = rows.groupBy("query").agg(F.avg("q_cov").alias("score"), F.count("*").alias("_n"))
    ref = F.regexp_extract("query", pattern, 1)
    ref = F.when(ref == "", F.raise_error(F.concat(F.lit("no region in the name "), F.col("query")))).otherwise(ref)
    return per.select(ref.alias("ref"), F.regexp_extract("query", pattern, 2).try_cast("int").alias("begin"), F.regexp_extract("query", pattern, 3).try_cast("int").alias("end"), F.when(F.col("_n") == 1, assembly).otherwise(species).alias("type"), "score")


_ORDER = ("ref", "_bucket", "begin", "end", "type", "score")
#: What a run of overlapping windows is known by where it may go on in another bucket.
_EDGE = "bucket long, n long, species_at long, first_score double, later double, every double, first_begin long, first_type string, last_begin long, last_type string"
_NONE = np.iinfo(np.int64).max


@dataclass
class _Run:
    """Windows that follow each other, each overlapping the one before: all of a region, or what a batch or a bucket has of it.

    A region's score is that of its first window, halved towards each window from its first
    one of several targets on: a sum with weights that are powers of two. later: that sum
    without the first window; every: the same over all windows."""

    ref: str | None
    begin: int
    end: int
    type: str | None
    species: bool
    bucket: int
    n: int
    species_at: int  # from 1; 0: none
    first_score: float
    later: float
    every: float
    first_begin: int
    first_type: str | None
    last_begin: int
    last_type: str | None
    head: bool = False

    def joined(self, o: _Run) -> _Run:
        """This run and the one that goes on with it."""
        half = 0.5**o.n
        if self.species_at:
            later, at = self.later * half + o.every, self.species_at
        else:
            later, at = o.later + (o.first_score * half if o.species_at == 1 else 0.0), o.species_at and self.n + o.species_at
        kind = min((t for t in (self.type, o.type) if t is not None), default=None)
        return replace(self, begin=min(self.begin, o.begin), end=o.end, bucket=o.bucket, type=kind, species=self.species or o.species, n=self.n + o.n, species_at=at, later=later, every=self.every * half + o.every, last_begin=o.last_begin, last_type=o.last_type)

    def score(self) -> float:
        at = max(2, self.species_at)
        return self.first_score if not self.species_at or at > self.n else self.first_score * 0.5 ** (self.n - at + 1) + self.later


def merge(items: DataFrame, max_gap: int = 0, min_overlap: int = 1, ignore_type: bool = False, species: str = SPECIES) -> DataFrame:
    """(ref, begin, end, type, score): windows joined while each overlaps the one before it; begin counts from 0.

    A region of windows of several targets halves its score towards each window it
    takes up. Windows are dealt by reference and bucket of their beginning, so that a
    reference of any length is spread over tasks, and joined in one pass in order; only the
    first and the last run of a bucket meet those of the buckets beside it. With max_gap,
    starts may be at most so far apart."""
    rows = items.select("ref", F.coalesce(F.floor(F.col("begin") / _BUCKET), F.lit(-1)).cast("long").alias("_bucket"), F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "type", F.col("score").cast("double").alias("score"))
    rows = rows.repartition("ref", "_bucket").sortWithinPartitions(*_ORDER)
    out = StructType([items.schema["ref"], *StructType.fromDDL("begin int, end int, type string, score double"), StructField("edge", StructType.fromDDL(_EDGE))])

    def follows(prev: _Run, o: _Run) -> bool:
        if prev.ref is None or prev.ref != o.ref or o.first_begin == _NONE or prev.end == _NONE or o.first_begin + min_overlap - 1 > prev.end:
            return False
        if not ignore_type and (prev.last_type is None or prev.last_type != o.first_type):
            return False
        return max_gap <= 0 or (prev.last_begin != _NONE and o.first_begin - prev.last_begin <= max_gap)

    def sent(cols: dict) -> pa.RecordBatch:
        arrow = to_arrow_schema(out)
        n = len(cols["begin"])
        begin, end = (np.asarray(cols[c], np.int64) for c in ("begin", "end"))
        made = {"ref": pa.array(cols["ref"]) if isinstance(cols["ref"], list) else cols["ref"], "begin": pa.array(begin - 1, mask=begin == _NONE), "end": pa.array(end, mask=end == _NONE)}
        made |= {"type": pa.array(cols["type"], pa.string()) if isinstance(cols["type"], list) else cols["type"], "score": pa.array(cols["score"], pa.float64()), "edge": pa.array(cols.get("edge") or [None] * n, arrow.field("edge").type)}
        return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in arrow], schema=arrow)

    def sent_runs(runs: list[_Run], edges: bool) -> pa.RecordBatch:
        edge = [{c.split()[0]: getattr(r, c.split()[0]) for c in _EDGE.split(", ")} for r in runs] if edges else None
        return sent({"ref": [r.ref for r in runs], "begin": [r.begin for r in runs], "end": [r.end for r in runs], "type": [species if r.species and not edges else r.type for r in runs], "score": [r.score() for r in runs], "edge": edge})

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Run | None = None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            refs, kinds = batch["ref"].dictionary_encode(), batch["type"].dictionary_encode()
            ref, kind = (c.indices.fill_null(-1).to_numpy() for c in (refs, kinds))
            begin, end = (batch[c].fill_null(_NONE).to_numpy() for c in ("begin", "end"))
            bucket, score = batch["_bucket"].to_numpy(), batch["score"].to_numpy(zero_copy_only=False)
            apart = (ref[1:] != ref[:-1]) | (bucket[1:] != bucket[:-1])
            on = ~apart & (ref[1:] >= 0) & (begin[1:] != _NONE) & (end[:-1] != _NONE) & (begin[1:] + min_overlap - 1 <= end[:-1])
            if not ignore_type:
                on &= (kind[1:] == kind[:-1]) & (kind[1:] >= 0)
            if max_gap > 0:
                on &= (begin[:-1] != _NONE) & (begin[1:] - begin[:-1] <= max_gap)
            starts = np.concatenate(([0], np.flatnonzero(~on) + 1))
            ends = np.concatenate((starts[1:], [n]))
            lengths, row = ends - starts, np.arange(n)
            first = np.repeat(starts, lengths)
            names = kinds.dictionary.to_pylist()
            special = kind == (names.index(species) if species in names else -2)
            at = np.minimum.reduceat(np.where(special, row, _NONE), starts)
            part = score * 0.5 ** (np.repeat(ends, lengths) - row)
            every = np.add.reduceat(part, starts)
            later = np.add.reduceat(np.where((row > first) & (row >= np.repeat(at, lengths)), part, 0.0), starts)
            up = np.argsort(np.argsort(names)) if names else np.empty(0, np.int64)
            rank = np.where(kind >= 0, up[kind] if names else 0, _NONE)
            least = np.minimum.reduceat(rank, starts)
            ordered = sorted(names)
            low = np.minimum.reduceat(begin, starts)
            heads = np.concatenate(([False], apart))[starts]
            tails = np.concatenate((heads[1:], [False]))

            def run(i: int) -> _Run:
                a, z = int(starts[i]), int(ends[i]) - 1
                kind_of = lambda r: names[kind[r]] if kind[r] >= 0 else None
                return _Run(refs.dictionary[int(ref[a])].as_py() if ref[a] >= 0 else None, int(low[i]), int(end[z]), ordered[least[i]] if least[i] != _NONE else None, at[i] != _NONE, int(bucket[a]), z - a + 1, int(at[i]) - a + 1 if at[i] != _NONE else 0, float(score[a]), float(later[i]), float(every[i]), int(begin[a]), kind_of(a), int(begin[z]), kind_of(z), bool(heads[i]))

            # The run that the batch before left open, and the first of this one.
            edges, one = [], run(0)
            if held is None:
                one.head = True
            elif held.ref != one.ref or held.bucket != one.bucket:
                edges.append(held)
                one.head = True
            elif follows(held, one):
                one = held.joined(one)
            else:
                edges += [held] if held.head else []
                if not held.head:
                    yield sent_runs([held], False)
            last = len(starts) - 1
            if last == 0:
                held = one
            else:
                if one.head or tails[0]:
                    edges.append(one)
                else:
                    yield sent_runs([one], False)
                edges += [run(i) for i in (np.flatnonzero((heads | tails)[1:last]) + 1).tolist()]
                i = np.flatnonzero(~(heads | tails)[1:last]) + 1
                if len(i):
                    whole = (at[i] != _NONE) & (np.maximum(at[i], starts[i] + 1) < ends[i])
                    folded = np.where(whole, score[starts[i]] * 0.5 ** (ends[i] - np.maximum(at[i], starts[i] + 1)).clip(0, 2000) + later[i], score[starts[i]])
                    spots = np.where(at[i] != _NONE, len(ordered), np.minimum(least[i], len(ordered) + 1))
                    kind_names = pa.array([*ordered, species, None], pa.string()).take(pa.array(spots))
                    yield sent({"ref": batch["ref"].take(pa.array(starts[i])), "begin": low[i], "end": end[ends[i] - 1], "type": kind_names, "score": folded})
                held = run(last)
            if edges:
                yield sent_runs(edges, True)
        if held is not None:
            yield sent_runs([held], True)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = []
        for batch in batches:
            inner = pc.is_null(batch["edge"])
            yield batch.filter(inner)
            for r in batch.filter(pc.invert(inner)).to_pylist():
                begin = _NONE if r["begin"] is None else r["begin"] + 1
                e = r["edge"]
                runs.append(_Run(r["ref"], begin, _NONE if r["end"] is None else r["end"], r["type"], e["species_at"] > 0, **e))
        runs.sort(key=lambda r: (r.ref is not None, r.ref or "", r.bucket, -1 if r.first_begin == _NONE else r.first_begin, r.end, r.first_type or ""))
        done = []
        for r in runs:
            if done and done[-1].bucket != r.bucket and follows(done[-1], r):  # in a bucket all that follow are one run
                done[-1] = done[-1].joined(r)
            else:
                done.append(r)
        for i in range(0, len(done), 1 << 14):
            yield sent_runs(done[i : i + (1 << 14)], False)

    found = rows.mapInArrow(in_buckets, out)
    # Runs at the edges of buckets meet by reference; the others only go along, evenly dealt.
    found = found.repartition("ref", F.when(F.col("edge").isNull(), F.col("begin"))).mapInArrow(across, out)
    return found.select("ref", "begin", "end", "type", "score")


def bed(regions: DataFrame) -> DataFrame:
    """Six columns of BED; the score in thousandths, halves to even."""
    return regions.select("ref", "begin", "end", "type", F.bround(F.col("score") * 1000, 0).cast("int").alias("score"), F.lit(".").alias("strand"))
