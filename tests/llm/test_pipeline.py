import hashlib
import re
import zlib

import public_tokenizers as P
import pytest
import tiktoken
import tiktoken.load
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from seqloom.llm import language_id, toxicity
from seqloom.llm.batches import table

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op")}


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_fingerprint(text):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_leaks(windows, text):
    """Byte runs of hit words, and items, by plain comparison of all windows."""
    data = text.encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    spans = [m.span() for m in WORD.finditer(low)]
    words = [low[a:b] for a, b in spans]
    hit, items = set(), set()
    for n in {len(k) for k in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                items |= windows[tuple(words[i : i + n])]
    runs = []
    for i in sorted(hit):
        if runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    return [(spans[a][0], spans[b - 1][1]) for a, b in runs], items


def test_run_equals_stages_one_by_one_in_plain_python(spark):
    """Rows, token counts and digests of what is left, by stages of plain Python; models are those of the modules,
    whose scores have brute-force tests of their own."""
    rows = table(spark, SF, "documents").collect()
    frame = table(spark, SF, "documents")
    lang = language_id.learn(frame)
    names, _, unsure = lang.predict([r.text for r in rows])
    kept = {r.doc_id: r.text for r, n, u in zip(rows, names, unsure, strict=True) if n != "und" and not u}
    tox = toxicity.learn(frame.filter(frame.doc_id.isin(list(kept))), table(spark, SF, "labels"))
    kept = {i: t for (i, t), s in zip(kept.items(), tox.score(list(kept.values())), strict=True) if s < 0.3}
    fps = {i: brute_fingerprint(t) for i, t in kept.items()}
    left, stay = set(kept), []
    while left:
        todo, group = [min(left)], set()
        left -= set(todo)
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (fps[x] ^ fps[y]).bit_count() <= 3}
            left -= near
            todo += near
        stay.append(min(group))
    windows = {}
    for r in table(spark, SF, "benchmark").collect():
        w = WORD.findall(r.text.encode().lower())
        for k in range(max(1, len(w) - 7)):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(r.item_id)
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=tiktoken.load.load_tiktoken_bpe(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want, cuts = {}, 0
    for i in stay:
        data = kept[i].encode()
        runs, items = brute_leaks(windows, data.decode())
        if len(items) >= 2:
            continue
        cuts += bool(runs)
        while runs:
            for a, b in reversed(runs):
                data = data[:a] + data[b:]
            runs, _ = brute_leaks(windows, data.decode())
        ids = library.encode_ordinary(data.decode())
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest())
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want) < len(rows) and cuts


CLASHING = "h id hash n row at key text_hash fp item size words doc runs changed y place __hash __id __n _place root".split()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_each_stage_takes_edge_rows(spark, edges, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = edges.select("doc_id", "text", "lang", "source", "n_chars", "score", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    out = stage(spark, docs, SF)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
        assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in out.collect())
    assert 0 < out.count() <= docs.count() and stage(spark, docs.limit(0), SF).count() == 0


def test_held_out_fold_is_crc32(spark):
    got = __spark_entry__.queries()["op9_language_id"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and any(r.held_out for r in got)
