"""From matches to a profile: existence tests, ambiguity correction, abundances by expectation-maximisation.

Rows of a query are shuffled together and written once (``keyed``); every stage works
in that layout, and tables of targets, far fewer, are sent to it while their number is
at most ``BROADCAST_TARGETS``. Between passes what stays is settled in the shared
checkpoint folder, as the loop of the last stage would otherwise repeat all before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from seqloom.operators import matches as M
from seqloom.session import settle


@dataclass(frozen=True)
class Params:
    """Thresholds of profiling; modes.PRESETS has the named sets."""

    min_reads: float = 50  # r: reads of a chunk that counts
    min_chunks_frac: float = 0.8  # p
    max_depth_sd: float = 2  # d
    min_uniq: float = 20  # u
    min_hic: float = 5  # U
    hic_cov: float = 0.75  # H
    min_hic_prop: float = 0.1  # P
    dominance: float = 0.05  # D
    mismatch: float = 0.05  # R
    perfect: bool = False
    main_gap: float | None = None
    top_n: int = 0
    level: str = "species"
    norm: str = "mean"  # mean, min or max coverage
    max_iters: int = 10
    pct_threshold: float = 0.01
    ambiguity: bool = True

    def but(self, **changes) -> Params:
        return replace(self, **changes)


#: Targets up to which a table of them is broadcast; beyond, rows are shuffled to it.
BROADCAST_TARGETS = 500_000

#: Pairs held back from ambiguity correction up to which they are sent to every task; beyond, pairs are shuffled.
HELD_PAIRS = 100_000


def to_all(t: DataFrame) -> DataFrame:
    """A settled table of targets, broadcast if it is small enough."""
    return F.broadcast(t) if t.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS else t


def keyed(found: DataFrame, species: DataFrame | None, p: Params) -> DataFrame:
    """found with the species of each target (null: none), rows of a query together."""
    if species is not None and p.level == "species":
        rows = found.join(species.select("target", F.col("species").cast("long").alias("species")), "target", "left")
    else:
        rows = found.withColumn("species", F.lit(None).cast("long"))
    return rows.repartition("query").sortWithinPartitions("query", "target", *_first(rows))


def _first(rows: DataFrame) -> list[Column]:
    """The order of a target's rows in a query."""
    return [F.col("q_cov").desc(), *(F.col(c) for c in ("chunk_idx", "line") if c in rows.columns)]


def annotated(found: DataFrame, species: DataFrame | None, p: Params) -> DataFrame:
    """Rows that the prefix filters keep, with n_qt, n_targets, is_first and same (one species holds all targets).

    species: (target, species), null where there is none."""
    return marked(keyed(found, species, p), species is not None and p.level == "species", p)


def marked(rows: DataFrame, by_species: bool, p: Params) -> DataFrame:
    """annotated() of rows that are keyed() already; its windows need no further shuffle."""
    rows = M.prefix(rows, p.perfect, p.main_gap, p.top_n)
    pair, q = Window.partitionBy("query", "target").orderBy(*_first(rows)), Window.partitionBy("query")
    whole = pair.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"n_qt": F.count("*").over(whole), "is_first": F.row_number().over(pair) == 1})
    known = F.count("species").over(q) == F.count("*").over(q)
    same = known & (F.min("species").over(q) == F.max("species").over(q)) & F.lit(by_species)
    return rows.withColumns({"n_targets": F.sum(F.col("is_first").cast("int")).over(q), "same": same})


def stage1_chunks(rows: DataFrame, p: Params) -> DataFrame:
    """(target, chunk_idx, chunks, reads, uniq, hic): each row counts for its target in full."""
    single = F.col("is_first") & ((F.col("n_targets") == 1) | F.col("same"))
    return rows.groupBy("target", "chunk_idx", "chunks").agg(
        F.sum(1.0 / F.col("n_qt")).alias("reads"),
        F.sum(single.cast("double")).alias("uniq"),
        F.sum((single & (F.col("q_cov") >= p.hic_cov)).cast("double")).alias("hic"),
    )


def stage1(rows: DataFrame, p: Params) -> DataFrame:
    """Targets that exist at all: (target, sum_match, uniq, hic, chunks_frac)."""
    t = stage1_chunks(rows, p).groupBy("target", "chunks").agg(
        F.sum("reads").alias("sum_match"), F.sum("uniq").alias("uniq"), F.sum("hic").alias("hic"), (F.sum((F.col("reads") > 0).cast("int")) / F.first("chunks")).alias("chunks_frac")
    )
    return t.filter((F.col("uniq") >= 1) & (F.col("hic") >= 1) & (F.col("chunks_frac") >= p.min_chunks_frac)).drop("chunks")


def cooccurrence(rows: DataFrame) -> DataFrame:
    """(a, b, shared), a < b: queries that hold both targets.

    Queries of the same targets are counted as one before pairs are made, so a group of
    copies costs the pairs of one query."""
    held = rows.filter("is_first and n_targets > 1").groupBy("query").agg(F.sort_array(F.collect_list("target")).alias("t"))
    kinds = held.groupBy("t").agg(F.count("*").alias("n")).select("t", "n", F.posexplode("t").alias("i", "a"))
    pairs = kinds.select("a", "n", F.explode(F.expr("slice(t, i + 2, size(t))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("shared"))


def dominated(totals: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """(loser, winner): pairs of which one loses every query that has both.

    The winner has enough matches besides the shared ones, the loser far fewer unique reads."""
    t = totals.select("target", "sum_match", "uniq")
    a, b = (t.select(F.col("target").alias(x), F.col("sum_match").alias(f"m{x}"), F.col("uniq").alias(f"u{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    keep = F.lit(1 - p.dominance)
    beats = lambda x, y: (F.col(f"m{x}") * keep >= F.col("shared")) & (F.col(f"u{y}") < F.col(f"u{x}") * p.mismatch)
    return both.filter(beats("a", "b")).select(F.col("b").alias("loser"), F.col("a").alias("winner")).unionByName(both.filter(beats("b", "a")).select(F.col("a").alias("loser"), F.col("b").alias("winner")))


def held_back(totals: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """(winner, loser): pairs that differ enough in unique reads, but of which the first has too few matches besides the shared ones."""
    t = totals.select("target", "sum_match", "uniq")
    both = pairs
    for x in "ab":
        both = both.join(to_all(t.select(F.col("target").alias(x), F.col("sum_match").alias(f"m{x}"), F.col("uniq").alias(f"u{x}"))), x)
    keep = F.lit(1 - p.dominance)

    def side(x: str, y: str) -> Column:
        held = (F.col(f"u{y}") < F.col(f"u{x}") * p.mismatch) & ~(F.col(f"m{x}") * keep >= F.col("shared"))
        return F.when(held, F.struct(F.col(x).alias("winner"), F.col(y).alias("loser")))

    return both.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).filter("s is not null").select("s.winner", "s.loser")


def corrected_in_rows(rows: DataFrame, totals: DataFrame, held: set[tuple], p: Params) -> DataFrame:
    """As corrected(), from the targets' unique reads: one wins where they differ enough, unless that pair is held back.

    A query's meetings then need nothing but its own targets, so no pair is shuffled."""
    firsts = rows.filter("is_first and n_targets > 1").join(to_all(totals.select("target", "uniq")), "target")
    line = firsts.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("q_cov")).alias("c"), "target", "uniq"))).alias("t")).filter("size(t) > 1")
    line = line.select("query", F.transform("t", lambda x: x["target"]).alias("t"), F.transform("t", lambda x: x["uniq"]).alias("u"))
    out = StructType([line.schema["query"], StructField("gone", line.schema["t"].dataType)])
    mismatch, sides = p.mismatch, {t for pair in held for t in pair}

    def alike(u: np.ndarray) -> np.ndarray:
        """Which targets are gone, of queries that have equally many: a row for each."""
        lost = np.zeros(u.shape, bool)
        for i in range(u.shape[1]):
            turn = ~lost[:, i]
            for j in range(i + 1, u.shape[1]):
                both = turn & ~lost[:, j]
                wins = both & (u[:, j] < u[:, i] * mismatch)
                lost[:, i] |= both & ~wins & (u[:, i] < u[:, j] * mismatch)
                lost[:, j] |= wins
        return lost

    def single(t: list, u: list[float]) -> list[bool]:
        """The same of one query, looking at the pairs that are held back."""
        lost = [False] * len(u)
        for i in range(len(u)):
            if lost[i]:
                continue
            for j in range(i + 1, len(u)):
                if lost[j]:
                    continue
                if u[j] < u[i] * mismatch and (t[i], t[j]) not in held:
                    lost[j] = True
                elif u[i] < u[j] * mismatch and (t[j], t[i]) not in held:
                    lost[i] = True
        return lost

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, t, u = (pc.list_value_length(batch["t"]).to_numpy(), batch["t"].flatten(), batch["u"].flatten().to_numpy())
            starts = np.cumsum(n) - n
            lost, slow = np.zeros(len(u), bool), np.zeros(len(n), bool)
            if sides:
                slow[np.repeat(np.arange(len(n)), n)[pc.is_in(t, pa.array(list(sides), t.type)).to_numpy(zero_copy_only=False)]] = True
            for size in np.unique(n[~slow]).tolist():
                own = starts[(n == size) & ~slow][:, None] + np.arange(size)
                lost[own] = alike(u[own])
            for i in np.flatnonzero(slow).tolist():
                end = starts[i] + n[i]
                lost[starts[i] : end] = single(t[starts[i] : end].to_pylist(), u[starts[i] : end].tolist())
            number = np.add.reduceat(lost.astype(np.int32), starts) if len(n) else n
            gone = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(number))), pa.int32()), t.filter(pa.array(lost)))
            yield pa.RecordBatch.from_arrays([batch["query"], gone.cast(to_arrow_schema(out).field("gone").type)], names=out.names).filter(pa.array(number > 0))

    per_query = line.mapInArrow(run, out)
    return rows.join(per_query, "query", "left").filter("gone is null or not array_contains(gone, target)").drop("gone")


def corrected(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """Rows without those whose target loses to another of the same query.

    A query's targets meet in the order of their best coverage: each in its turn, unless it
    is gone by then, with all later ones that aren't. What a meeting removes is gone for all
    that follow, so a target that is gone removes no other. Only targets that win or lose
    anywhere take part; the meetings of a query are folded in order over its own array."""
    sides = settle(lost.select(F.least("loser", "winner").alias("x"), F.greatest("loser", "winner").alias("y"), (F.col("winner") < F.col("loser")).alias("x_wins")).groupBy("x", "y").agg(F.max("x_wins").alias("x_wins"), F.min("x_wins").alias("x_only")))
    concerned = sides.select(F.col("x").alias("target")).unionByName(sides.select(F.col("y").alias("target"))).distinct()
    firsts = rows.filter("is_first and n_targets > 1") if "is_first" in rows.columns else rows.groupBy("query", "target").agg(F.max("q_cov").alias("q_cov"))
    best = firsts.join(to_all(settle(concerned)), "target", "left_semi").select("query", "target", F.col("q_cov").alias("c"))
    line = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "target"))).alias("t")).filter("size(t) > 1")
    line = settle(line.select("query", F.transform("t", lambda x: x["target"]).alias("t")), laid_out=True)
    # Meetings (i, j) of a place with a later one; queries with the same line have the same.
    kinds = settle(line.select("t").distinct()).select(F.monotonically_increasing_id().alias("id"), "t")
    meet = kinds.select("id", "t", F.posexplode("t").alias("i", "a")).select("id", "i", "a", F.posexplode(F.expr("slice(t, i + 2, size(t))")).alias("k", "b"))
    meet = meet.select("id", "i", (F.col("i") + F.col("k") + 1).alias("j"), "a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    # Where both would win, the one whose turn it is does.
    first_wins = F.when(F.col("a") == F.col("x"), F.col("x_wins")).otherwise(~F.col("x_only"))
    met = meet.join(to_all(sides), ["x", "y"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "j", first_wins.alias("w")))).alias("m"))

    def step(state: Column, m: Column) -> Column:
        turn = m["i"] == state["i"]
        out = F.when(turn, state["out"]).otherwise(F.array_contains(state["gone"], m["i"]))  # gone when its turn came
        removed = F.when(m["w"], m["j"]).otherwise(m["i"])
        gone = F.when(out | F.array_contains(state["gone"], m["j"]), state["gone"]).otherwise(F.array_union(state["gone"], F.array(removed)))
        return F.struct(m["i"].alias("i"), out.alias("out"), gone.alias("gone"))

    start = F.struct(F.lit(-1).alias("i"), F.lit(False).alias("out"), F.array().cast("array<int>").alias("gone"))
    gone = met.select("id", F.aggregate("m", start, step)["gone"].alias("g")).join(kinds, "id").select("t", F.transform("g", lambda g: F.col("t")[g]).alias("gone"))
    per_query = line.join(gone, "t").select("query", "gone")
    return rows.join(per_query, "query", "left").filter("gone is null or not array_contains(gone, target)").drop("gone")


def weighed_chunks(rows: DataFrame, p: Params, shares: Column | None) -> DataFrame:
    """(target, chunk_idx, chunks, reads, bases, uniq, hic): a query of several targets is divided among them.

    shares is the part of a query that a row's target gets; without it (stage 3)
    bases are divided evenly, and reads and unique reads count in full."""
    many = F.col("n_targets") > 1
    first = F.col("is_first") & (~many | F.col("same"))
    part = F.when(many, (shares if shares is not None else F.lit(1.0)) / F.col("n_qt"))
    reads = F.coalesce(part, 1.0 / F.col("n_qt"))
    bases = F.col("q_len") * F.when(many, (shares if shares is not None else 1.0 / F.col("n_targets")) / F.col("n_qt")).otherwise(1.0 / F.col("n_qt"))
    single = F.when(first, F.when(many, part).otherwise(1.0)).otherwise(0.0)
    return rows.groupBy("target", "chunk_idx", "chunks").agg(
        F.sum(reads).alias("reads"), F.sum(bases).alias("bases"), F.sum(single).alias("uniq"), F.sum(F.when(F.col("q_cov") >= p.hic_cov, single).otherwise(0.0)).alias("hic")
    )


def targets_of(chunked: DataFrame, sizes: DataFrame, p: Params) -> DataFrame:
    """(target, reads, uniq, hic, bases, chunks_frac, depth_sd, coverage).

    Chunks without reads count as zeros: depth_sd is the population deviation of the
    chunks' share of bases times their number, worked out from two sums."""
    t = chunked.groupBy("target").agg(
        F.first("chunks").alias("chunks"),
        F.sum("reads").alias("reads"),
        F.sum("uniq").alias("uniq"),
        F.sum("hic").alias("hic"),
        F.sum("bases").alias("bases"),
        F.sum(F.col("bases") * F.col("bases")).alias("_sq"),
        F.sum((F.col("reads") >= p.min_reads).cast("int")).alias("_n"),
        F.min(F.when(F.col("bases") > 0, F.col("bases"))).alias("_lo"),
        F.max("bases").alias("_hi"),
    )
    t = t.join(sizes, "target")
    cover = {"mean": F.col("bases") / F.col("size"), "min": F.col("_lo") * F.col("chunks") / F.col("size"), "max": F.col("_hi") * F.col("chunks") / F.col("size")}[p.norm]
    var = F.col("chunks") * F.col("_sq") / (F.col("bases") * F.col("bases")) - 1
    return t.select("target", "reads", "uniq", "hic", "bases", (F.col("_n") / F.col("chunks")).alias("chunks_frac"), F.sqrt(F.greatest(F.lit(0.0), var)).alias("depth_sd"), cover.alias("coverage"))


def existing(t: DataFrame, p: Params) -> DataFrame:
    """Targets that pass the existence tests."""
    return t.filter((F.col("uniq") >= p.min_uniq) & (F.col("hic") >= p.min_hic) & (F.col("hic") >= p.min_hic_prop * F.col("uniq")) & (F.col("chunks_frac") >= p.min_chunks_frac) & (F.col("depth_sd") <= p.max_depth_sd))


def failures(t: DataFrame, p: Params, stage: str) -> DataFrame:
    """(target, stage, reason, value) for each test that a target fails."""
    tests = [("uniq", F.col("uniq") < p.min_uniq), ("hic", F.col("hic") < p.min_hic), ("hic_prop", F.col("hic") < p.min_hic_prop * F.col("uniq")), ("chunks_frac", F.col("chunks_frac") < p.min_chunks_frac), ("depth_sd", F.col("depth_sd") > p.max_depth_sd)]
    each = F.array(*[F.struct(bad.alias("bad"), F.lit(n).alias("reason"), F.col("hic" if n == "hic_prop" else n).cast("double").alias("value")) for n, bad in tests])
    return t.select("target", F.lit(stage).alias("stage"), F.explode(each).alias("_f")).filter("_f.bad").select("target", "stage", "_f.reason", "_f.value")


def em_step(rows: DataFrame, coverage: DataFrame, sizes: DataFrame, p: Params) -> DataFrame:
    """One pass: targets with new coverage, each query divided by the coverage of its targets."""
    r = rows.join(to_all(coverage.select("target", F.col("coverage").alias("_cov"))), "target")
    total = F.sum(F.when(F.col("is_first"), F.col("_cov")).otherwise(0.0)).over(Window.partitionBy("query"))
    return targets_of(weighed_chunks(r.withColumn("_share", F.col("_cov") / total), p, F.col("_share")), sizes, p)


def scores(rows: DataFrame) -> DataFrame:
    """(target, score): the 90th percentile of the coverage of queries that are the target's alone."""
    own = rows.filter(F.col("is_first") & ((F.col("n_targets") == 1) | F.col("same")))
    return own.groupBy("target").agg((F.expr("percentile(q_cov, 0.9D)") * 100).alias("score"))


def restricted(found: DataFrame, targets: DataFrame) -> DataFrame:
    return found.join(to_all(targets.select("target")), "target", "left_semi")


def with_percentage(t: DataFrame) -> DataFrame:
    """Adds each target's share of all coverage in percent; the sum comes by join, not through one task's window."""
    total = t.agg(F.sum("coverage").alias("_all")).withColumn("_j", F.lit(1))
    return t.withColumn("_j", F.lit(1)).join(F.broadcast(total), "_j").withColumn("percentage", F.col("coverage") / F.col("_all") * 100).drop("_j", "_all")


def before_em(found: DataFrame, species: DataFrame | None, sizes: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stages 1 to 3: (rows after correction, targets of stage 3 untested, those that exist)."""
    return _before_em(settle(keyed(found, species, p), laid_out=True), species is not None and p.level == "species", sizes, p)


def _before_em(base: DataFrame, by_species: bool, sizes: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    first = settle(stage1(marked(base, by_species, p), p))
    rows = settle(marked(restricted(base, first), by_species, p), laid_out=True)
    if p.ambiguity:
        held = settle(held_back(first, cooccurrence(rows), p)).limit(HELD_PAIRS + 1).collect()
        if len(held) <= HELD_PAIRS:
            kept = corrected_in_rows(rows, first, {tuple(h) for h in held}, p)
        else:
            kept = corrected(rows, settle(dominated(first, cooccurrence(rows), p)))
        rows = marked(kept.drop("n_qt", "is_first", "n_targets", "same"), by_species, p.but(perfect=False, main_gap=None, top_n=0))
    t = targets_of(weighed_chunks(rows, p, None), sizes, p)
    return rows, t, existing(t, p)


class Profiled(NamedTuple):
    """The profile, what each target that didn't exist failed, and one row of statistics."""

    profile: DataFrame
    failures: DataFrame
    stats: DataFrame


def profiled(found: DataFrame, species: DataFrame | None, sizes: DataFrame, p: Params, iters: int | None = None) -> Profiled:
    """profile (target, reads, uniq, hic, bases, chunks_frac, depth_sd, coverage, score, percentage) of the targets that exist.

    Passes repeat until the percentage of the most covered target moves less than
    the threshold, or max_iters times (exactly ``iters`` times if given)."""
    by_species = species is not None and p.level == "species"
    base = settle(keyed(found, species, p), laid_out=True)
    _, untested, _ = _before_em(base, by_species, sizes, p)
    untested = settle(untested)
    bad = failures(untested, p, "stage 3")
    coverage = existing(untested, p).select("target", "coverage")
    rows = settle(marked(restricted(base, coverage), by_species, p), laid_out=True)
    last, result, used = None, None, rows
    for i in range((iters if iters is not None else p.max_iters) + 1):
        step = em_step(rows, coverage, sizes, p)
        used = rows
        if i == 0:
            step = settle(step)
            bad = bad.unionByName(failures(step, p, "abundance"))
            step = existing(step, p)
        result = settle(with_percentage(step))
        coverage = result.select("target", "coverage")
        top = result.orderBy(F.col("coverage").desc(), "target").select("percentage").first()
        if top is None or (iters is None and last is not None and abs(top[0] - last) < p.pct_threshold):
            break
        last = top[0]
        if i == 0:
            rows = settle(marked(restricted(base, result), by_species, p), laid_out=True)
    out = result.join(scores(used), "target", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    out = out.select(*[c for c in out.columns if c not in ("score", "percentage")], "score", "percentage")
    return Profiled(out, bad, statistics(base, result))


def profile(found: DataFrame, species: DataFrame | None, sizes: DataFrame, p: Params, iters: int | None = None) -> DataFrame:
    """The profile alone of profiled()."""
    return profiled(found, species, sizes, p, iters).profile


def statistics(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: queries with matches, queries with a match in one of the targets, their share in percent."""
    assigned = restricted(rows, targets).select("query").distinct().agg(F.count("*").alias("assigned_reads")).withColumn("_j", F.lit(1))
    matched = rows.select("query").distinct().agg(F.count("*").alias("matched_reads")).withColumn("_j", F.lit(1))
    out = matched.join(F.broadcast(assigned), "_j").drop("_j")
    return out.withColumn("assigned_pct", F.when(F.col("matched_reads") > 0, F.col("assigned_reads") / F.col("matched_reads") * 100).otherwise(0.0))


def tail_cut(t: DataFrame, pct: float, order: list[Column] | None = None) -> DataFrame:
    """Without the least targets that together hold at most pct percent; the rest adds to 100 again.

    Targets of a profile are as many as references that exist, a small table."""
    up = [F.col("coverage").asc(), F.col("chunks_frac").asc(), F.col("target").desc()] if order is None else order
    tail = F.sum("percentage").over(Window.orderBy(*up).rowsBetween(Window.unboundedPreceding, 0))
    kept = t.withColumn("_t", tail).filter(F.col("_t") > pct).drop("_t")
    return with_percentage(kept)


def pathogen_order(t: DataFrame) -> list[Column]:
    """The order of mode 0: by score and spread before abundance."""
    return [(F.col("score") * F.col("chunks_frac")).desc(), F.col("score").desc(), F.col("chunks_frac").desc(), F.col("reads").desc(), F.col("target").asc()]
