"""Pairs counted in tiles: equal to the join of k-mers, and nothing is shuffled for a k-mer or a pair."""

import random

import numpy as np
import pytest
from test_growth import RECORDS, shuffled

from pyspark.sql import functions as F
from seqloom.operators import pairs, search
from seqloom.operators.sketch import Settings
from seqloom.plans import catalog

K = 21


def texts_of(n, length, seed):
    rng = random.Random(seed)
    line = "".join(rng.choice("abcdefgh") for _ in range(60))
    out = ["".join(rng.choice("abcdefgh") for _ in range(length + i)) for i in range(n)]
    for i in range(0, n, 3):
        out[i] = line + out[i]
    for i in range(1, n, 4):
        out[i] = out[i - 1][: length // 2] + out[i][: length // 3]
    return [*out, "", "abcd" * 20, "abcd" * 25 + out[0][:40], "x" * 28, "x" * 60, "x" * 90, "é" * 40 + "😀" * 40, "é" * 40, out[0]]


@pytest.mark.parametrize("slice_chars", [pairs.SLICE, 700])
def test_all_in_all_is_the_join_of_kmers(spark, slice_chars):
    texts = spark.createDataFrame(list(enumerate(texts_of(30, 500, 4))), "id long, seq string")
    refs = texts.select(F.col("id").alias("target"), F.lit(0).alias("chunk_idx"), "seq")
    want = search.search(texts.select(F.col("id").alias("query"), "seq"), refs, K, min_q_cov=0.1)
    got = pairs.text_pairs(texts, 20_000, Settings((K,), "roll"), K, 10, 0.1, slice_chars=slice_chars)
    cols = ["query", "q_len", "q_kmers", "target", "t_kmers", "m_kmers"]
    found = sorted(map(tuple, got.select(cols).collect()))
    assert found == sorted(map(tuple, want.select(cols).collect())) and len(found) > 60


def test_counts_of_frequent_and_rare_codes_in_stripes():
    rng = np.random.default_rng(5)
    held = rng.random((50, 40)) < np.linspace(0.02, 0.9, 40)
    weights = np.where(held, rng.integers(1, 5, held.shape), 0)
    owner, code = np.nonzero(held)
    for weight, want in ((None, held.astype(int) @ held.T), (weights[owner, code], weights @ held.T)):
        for cells in (60, 1 << 20):
            parts = list(pairs.counts((owner, code, weight), 50, (owner, code), 50, 40, cells))
            assert (np.concatenate([m for _, m in parts]) == want).all() and [f for f, _ in parts] == list(range(0, 50, max(1, cells // 50)))


def test_whole_file_search_shuffles_texts_not_kmers(spark, tmp_path):
    texts = texts_of(40, 3000, 6)
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    records, _ = shuffled(spark, lambda: catalog.QUERIES["search_whole_file"](spark, str(tmp_path)).collect())
    assert records < RECORDS * len(texts)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_code_pairs_are_the_join_by_code(spark, kind):
    rng = random.Random(8)
    places = [(i, h) for h in range(400) for i in rng.sample(range(90), rng.choice([1, 1, 2, 3, 40, 88]))]
    n = {i: sum(j == i for j, _ in places) for i in range(90)}
    df = spark.createDataFrame([(i, n[i], h << 33) for i, h in places], "id long, n long, h long").withColumn("id", F.col("id").cast(kind))
    x, y = (df.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), "h") for c in "ab")
    want = sorted(map(tuple, x.join(y, "h").filter("a < b").groupBy("a", "b", "na", "nb").count().select("a", "b", "count", "na", "nb").collect()))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for rows in ("1", "7", "10000"):
            spark.conf.set(size, rows)
            assert sorted(map(tuple, pairs.code_pairs(df, blocks=3).collect())) == want
    finally:
        spark.conf.set(size, before)
    assert len(pairs.code_pairs(df, 100, blocks=3).collect()) == sum(w[2] >= 100 for w in want)


def test_sketch_similarity_shuffles_hashes_not_pairs(spark, tmp_path):
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh") for _ in range(2000))
    docs = [(i, line + f" {i} " + "".join(rng.choice("abcdefgh") for _ in range(100))) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = []
    records, _ = shuffled(spark, lambda: found.extend(catalog.QUERIES["sketch_similarity"](spark, str(tmp_path)).collect()))
    hashes = catalog.QUERIES["fracminhash_sketch"](spark, str(tmp_path)).count()
    classes = catalog.QUERIES["sketch_classes"](spark, str(tmp_path)).select("class").distinct().count()
    assert len(found) == classes * (classes - 1) // 2 > hashes and records < 1.2 * hashes
