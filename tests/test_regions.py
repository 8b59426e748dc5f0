"""Regions joined in one pass, however their windows fall into batches and buckets."""

import random

import pytest
from test_growth import shuffled

from seqloom.operators import regions as R


def plain(rows, max_gap, min_overlap, ignore):
    """The fold window by window."""
    done = []
    for ref, begin, end, kind, score in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2], r[3])):
        if done:
            p = done[-1]
            near = begin is not None and p["ref"] == ref and begin + min_overlap - 1 <= p["end"] and (ignore or p["kind"] == kind)
            if near and (max_gap <= 0 or p["at"] is not None and begin - p["at"] <= max_gap):
                p["special"] = p["special"] or kind == R.SPECIES
                p.update(end=end, at=begin, kind=kind, least=min(p["least"], kind), score=(p["score"] + score) / 2 if p["special"] else p["score"], begin=begin if p["begin"] is None else p["begin"])
                continue
        done.append({"ref": ref, "begin": begin, "at": begin, "end": end, "kind": kind, "least": kind, "special": kind == R.SPECIES, "score": score})
    return [(p["ref"], None if p["begin"] is None else p["begin"] - 1, p["end"], R.SPECIES if p["special"] else p["least"], round(p["score"], 9)) for p in done]


def windows_of(seed):
    rng, rows = random.Random(seed), {}
    for _ in range(700):
        begin = rng.randrange(1, 9000)
        rows["c", begin, begin + 99] = (rng.choice([R.SPECIES, R.ASSEMBLY, R.ASSEMBLY]), rng.random())
    for i in range(300):
        rows["a", 1 + i * 30, 100 + i * 30] = (R.SPECIES if i > 200 else R.ASSEMBLY, rng.random())
    for i in range(60):
        rows[f"r{i}", 1 + i, 90 + i] = (R.ASSEMBLY, rng.random())
        rows[f"r{i}", 50 + i, 190 + i] = (R.SPECIES, rng.random())
    rows["b", None, 50] = (R.ASSEMBLY, 0.5)
    rows["b", 20, 80] = (R.ASSEMBLY, 0.25)
    return [(*k, *v) for k, v in rows.items()]


@pytest.mark.parametrize("bucket", [R._BUCKET, 64, 1000])
@pytest.mark.parametrize("options", [(0, 1, False), (0, 1, True), (40, 20, True), (25, 1, False)])
def test_merge_over_batches_and_buckets(spark, monkeypatch, bucket, options):
    monkeypatch.setattr(R, "_BUCKET", bucket)
    items = windows_of(3)
    df = spark.createDataFrame(items, "ref string, begin int, end int, type string, score double")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for rows in ("3", "10000"):
            spark.conf.set(size, rows)
            got = [(r.ref, r.begin, r.end, r.type, round(r.score, 9)) for r in R.merge(df, *options).collect()]
            assert sorted(got, key=str) == sorted(plain(items, *options), key=str)
    finally:
        spark.conf.set(size, before)


def test_merge_shuffles_windows_twice_and_settles_nothing(spark):
    items = windows_of(4)
    df = spark.createDataFrame(items, "ref string, begin int, end int, type string, score double")
    records, _ = shuffled(spark, lambda: R.merge(df).collect())
    assert records <= 2 * len(items)
