"""What queries shuffle, keep and hold grows no faster than their texts."""

import random
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest

from seqloom import api
from seqloom.functions import hashing
from seqloom.operators import sketch
from seqloom.plans import catalog
from seqloom.plans.inputs import K

DOCS, LETTERS = 40, 3000


def shuffled(spark, run):
    """(records, bytes) that the stages of a run write to shuffles."""
    sc = spark.sparkContext
    store, nothing = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, nothing, None)
        each = [stages.apply(i) for i in range(stages.size())]
        return sum(s.shuffleWriteRecords() for s in each), sum(s.shuffleWriteBytes() for s in each)

    before = total()
    run()
    return tuple(b - a for a, b in zip(before, total(), strict=True))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Different texts of two sources, and queries from them."""
    place, rng = tmp_path_factory.mktemp("tables"), random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(LETTERS + 10 * i)) for i in range(DOCS)]
    docs = [(i, t, f"source {i % 2}") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(place / "documents.parquet"))
    spark.createDataFrame([(i, t[100:400]) for i, t in enumerate(texts[:5])], "item_id long, text string").write.parquet(str(place / "benchmark.parquet"))
    return str(place)


#: Records of a text at most; a text has some 3,000 k-mers and filter bits.
RECORDS = 60


@pytest.mark.parametrize("name", ["canonical_kmers", "bloom_bit_matrix", "bloom_dense_rows", "bloom_search", "bloom_search_multihash", "index_density", "assign_fragments"])
def test_no_row_for_each_kmer_is_shuffled(spark, tables, name):
    records, size = shuffled(spark, lambda: catalog.QUERIES[name](spark, tables).collect())
    assert records <= RECORDS * DOCS
    assert size <= 4 * DOCS * LETTERS  # a k-mer alone would take eight bytes a letter


def test_a_database_of_texts_is_no_larger_than_they_are(spark, tmp_path):
    rng = random.Random(4)
    texts = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(2000)) for i in range(20)}
    rows = [("f", i, n, n, t) for i, (n, t) in enumerate(texts.items())]
    records = spark.createDataFrame(rows, "file string, pos int, seq_id string, name string, seq string")
    found = {}
    for form in (False, True):
        place = tmp_path / f"db{form}"
        api.index(api.compute(spark, records, by_seq=True, texts=form), str(place), num_hash=2, **api.settings_of().manifest())
        queries = spark.createDataFrame([(n, t[300:500]) for n, t in list(texts.items())[:7]], "query string, seq string")
        found[form] = [sorted((r.query, r.target, r.t_kmers, r.m_kmers, r.t_len) for r in api.search(spark, queries, str(place), exact=e).collect()) for e in (False, True)]
        kept = sum(p.stat().st_size for p in Path(place / "sets").glob("*.parquet"))
        assert (kept < 2 * 20 * 2000) == form
    assert found[True] == found[False] and {r[0] for r in found[True][1]} == set(list(texts)[:7])


def test_database_of_equal_names_keeps_each_set_once(spark):
    rows = [("f", 0, "same", "same", "ACGTTGCA" * 20), ("g", 0, "same", "same", "AACCGGTTA" * 30)]
    sets = api.compute(spark, spark.createDataFrame(rows, "file string, pos int, seq_id string, name string, seq string"), by_seq=True)
    assert sorted(r.genome_size for r in sets.collect()) == [160, 270]


def test_canonical_summary_puts_rows_of_an_id_together(spark):
    rng = random.Random(5)
    data = [(i % 4, "".join(rng.choice("ACGT") for _ in range(60)) + "N" + "ACGTTTGACC" * 6) for i in range(6)] + [(7, "ACG"), (8, None)]
    df = spark.createDataFrame(data, "ref_id long, seq string")
    for k in (5, 21, 32, 40):
        want = {}
        for r in sketch.canonical_kmers(df, k).collect():
            want.setdefault(r.ref_id, []).append(r.kmer)
        got = {r.ref_id: (r.kmers, r.distinct_kmers, r.least_kmer) for r in sketch.canonical_summary(df, k).collect()}
        assert got == {i: (len(x), len(set(x)), min(x)) for i, x in want.items()}


def test_texts_are_hashed_side_by_side(monkeypatch):
    calls = []
    for name in ("_md5_lanes", "_rolled"):
        monkeypatch.setattr(hashing, name, lambda *a, f=getattr(hashing, name): calls.append(1) or f(*a))
    texts = ["".join(random.Random(i).choice("ACGT") for _ in range(60)) for i in range(200)]
    for run in (lambda: hashing.canonical_hashes(texts, K, "md5"), lambda: hashing.canonical_hashes(texts, K, "roll"), lambda: hashing.kmer_hashes(texts, K, "roll")):
        calls.clear()
        run()
        assert len(calls) == 1


def test_a_batch_is_read_by_groups():
    batch = pa.RecordBatch.from_pydict({"seq": [c * 20_000 for c in "abcd" * 500], "other": [None, "x"] * 1000})
    tracemalloc.start()
    ends = [(a, b) for a, b, _ in sketch._groups(batch, ("seq", "other"))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [a for a, _ in ends] == [0, *(b for _, b in ends[:-1])] and ends[-1][1] == 2000
    assert peak < 4_000_000  # of 40 MB
