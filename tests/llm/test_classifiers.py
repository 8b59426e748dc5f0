import functools
import math
import random
import re
import unicodedata
import zlib

import numpy as np

from seqloom.llm import language_id as L
from seqloom.llm import quality_mil as Q
from seqloom.llm import toxicity as T
from seqloom.llm.batches import table
from seqloom.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def held(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


def test_codewords_differ():
    for k in (2, 3, 4, 5, 7, 20):
        c = L.codewords(k)
        assert len({tuple(r) for r in c}) == k and all(abs(c.sum(0)) < k)


def test_language_accuracy_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    model = L.learn(docs)
    got = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r.lang == r.lang_pred for r in got if held(r.doc_id, 4, 2)]
    assert len(out) > 150 and np.mean(out) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, edges, edge_rows, empty):
    model = L.learn(table(spark, SF, "documents"))
    got = L.identify(edges, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(edge_rows) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 4))
    assert by[5].lang_pred in model.names
    kept = L.accept(edges, model)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} & {1, 2, 3, 4} == set()
    assert L.identify(empty, model).count() == 0
    nothing = L.learn(empty)
    assert {r.lang_pred for r in L.identify(edges, nothing).collect()} == {"und"}
    one = L.learn(edges.filter("doc_id = 5"))
    assert {r.lang_pred for r in L.identify(edges.filter("doc_id = 5"), one).collect()} <= {"en", "und"}


def two_languages():
    rng = random.Random(0)
    a = ["".join(rng.choice("abcde ") for _ in range(300)) for _ in range(30)]
    b = ["".join(rng.choice("vwxyz ") for _ in range(300)) for _ in range(30)]
    return a, b, L.Model.fit(np.stack([L.profile(t) for t in a + b]), ["a"] * 30 + ["b"] * 30)


def brute_language(model, text):
    """Margins, losses and the flag of one text, one trigram and one codeword after the other."""
    data = [c if 97 <= c <= 122 or c >= 128 else 32 for c in b" " + text.lower().encode() + b" "]
    total, n = [0.0] * len(model.bias), max(1, len(data) - 2)
    for x, y, z in zip(data, data[1:], data[2:], strict=False):
        h = (x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) % (1 << 32)
        h = (h ^ (h >> 15)) * 0x2C1B3C6D % (1 << 32) >> 19
        total = [t + float(w) for t, w in zip(total, model.weights[h], strict=True)]
    margin = [min(8.0, max(-8.0, t / n + float(b))) for t, b in zip(total, model.bias, strict=True)]
    loss = [sum(float(w) * math.log1p(math.exp(-m * float(c))) for m, c, w in zip(margin, code, model.trust, strict=True)) for code in model.code]
    p = [math.exp(min(loss) - x) for x in loss]
    order = sorted(range(len(p)), key=lambda i: -p[i])
    if not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0, False
    return model.names[order[0]], p[order[0]] / sum(p), p[order[1]] > L.AMBIGUOUS * p[order[0]]


def test_ambiguous_texts_are_flagged():
    a, b, m = two_languages()
    names, scores, unsure = m.predict([a[0], b[0]])
    assert names == ["a", "b"] and min(scores) > 0.9 and not any(unsure)
    # From one language's words to the other's, word by word, the flag comes and goes.
    words = [*zip(a[0].split(), b[0].split(), strict=False)]
    mixed = [" ".join([y for _, y in words[:k]] + [x for x, _ in words[k:]]) for k in range(len(words) + 1)]
    got = list(zip(*m.predict(mixed), strict=True))
    assert any(u for _, _, u in got) and not got[0][2] and not got[-1][2]
    for text, (name, score, flag) in zip(mixed, got, strict=True):
        want = brute_language(m, text)
        assert (name, flag) == (want[0], want[2]) and abs(score - want[1]) < 1e-5


def test_ambiguous_rows_go(spark):
    a, b, m = two_languages()
    words = [*zip(a[0].split(), b[0].split(), strict=False)]
    mixed = [" ".join([y for _, y in words[:k]] + [x for x, _ in words[k:]]) for k in range(len(words) + 1)]
    df = spark.createDataFrame([*enumerate(mixed), (900, "½ ②")], "doc_id long, text string")
    keep = {i for i, t in enumerate(mixed) if not brute_language(m, t)[2]}
    assert {r.doc_id for r in L.accept(df, m).collect()} == keep and len(keep) < len(mixed)


def test_language_equals_plain_decoding(spark):
    docs = table(spark, SF, "documents")
    model = L.learn(docs)
    some = {r.doc_id: r.text for r in docs.limit(120).collect()}
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    for i, t in some.items():
        name, score, flag = brute_language(model, t or "")
        assert got[i].lang_pred == name and got[i].ambiguous == flag and abs(got[i].score - score) < 1e-4


def test_numbers_and_marks_are_no_letters():
    _, _, m = two_languages()
    texts = ["½", "②", "Ⅷ", "٣ 12 _ ,", "日本", "ª", "é", None, ""]
    assert [n == "und" for n in m.predict(texts)[0]] == [True, True, True, True, False, False, False, True, True]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = T.score(docs, T.learn(docs, labels)).join(labels, "doc_id").collect()
    out = [(r.score, r.toxic) for r in got if held(r.doc_id, 4, 2)]
    pos, neg = [s for s, y in out if y], [s for s, y in out if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert len(pos) > 5 and auc > 0.8
    assert sum(s >= 0.3 for s in neg) <= 0.05 * len(neg)


def test_counterfactual_penalty_clears_group_mentions():
    rng = random.Random(1)
    filler = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(800):
        y = i % 2
        words = [rng.choice(filler) for _ in range(15)]
        if y and rng.random() < 0.6:
            words.append(rng.choice(["scum", "filth"]))
        if rng.random() < (0.8 if y else 0.05):  # the group is named mostly in toxic texts
            words.append("muslim")
        elif rng.random() < 0.4:
            words.append("christian")
        texts.append(" ".join(words))
        labels.append(y)
    table_ = T.swaps()
    got = list(T.bags(texts, list(table_)))
    base, named = [b for b, _ in got], [t for _, t in got]
    plain = T.fit_named(base, named, labels, list(table_), table_, 0.5, 0.0)
    shipped = T.fit_named(base, named, labels, list(table_), table_, 0.5)
    fair = T.fit_named(base, named, labels, list(table_), table_, 0.5, penalty=20)
    assert plain.twins == fair.twins > 400
    neutral = " ".join(filler[:15]) + " muslim"
    other = " ".join(filler[:15]) + " christian"
    gap = lambda m: m.score([neutral])[0] - m.score([other])[0]
    assert gap(plain) > 0.2 and gap(fair) < gap(plain) / 2 and gap(shipped) < gap(plain) - 0.02
    assert fair.score(["w1 w2 scum"])[0] > 0.5


def test_swaps_stay_in_their_row():
    table_ = T.swaps()
    terms = list(table_)
    (base, named), (rest, none) = T.bags(["Women and the OLD!", "nothing"], terms)
    assert {table_[terms[i]] for i in named} == {"men", "young"} and len(none) == 0 and len(rest) and len(base)
    f = T.term_features(terms)
    at = {t: i for i, t in enumerate(terms)}
    swapped = T.with_terms(base, np.array([at["men"], at["young"]]), f)
    (whole, _), = T.bags(["men and the young"])
    assert (swapped == whole).all()


def test_neutral_terms_are_paired_by_the_texts_they_share():
    have = np.zeros((40, 5), bool)
    have[:20, [0, 2]] = True
    have[20:, [1, 3]] = True
    have[::7, 4] = True
    assert T.pairs_of(have).tolist() == [2, 3, 0, 1, 4]


def test_shipped_penalty_acts_on_the_tables(spark):
    """Every score of the query against a plain scorer, with and without the penalty."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    shipped, plain = T.learn(docs, labels), T.learn(docs, labels, penalty=0.0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, SF).collect()}
    assert shipped.twins == plain.twins > 100 and len(got) == len(texts)
    for i, t in texts.items():
        s = brute_toxicity(shipped, t)
        assert abs(got[i].score - s) < 1e-9 and got[i].predicted == int(s >= 0.3) and got[i].held_out == held(i, 4, 2)
    assert max(abs(a - b) for a, b in zip(shipped.score(list(texts.values())), plain.score(list(texts.values())), strict=True)) > 0.01


def brute_word_hash(word):
    full = 1 << 64
    h = sum((b + 1) * 0x9E3779B97F4A7C15 * pow(0x100000001B3, i, full) for i, b in enumerate(word)) + len(word)
    h = ((h % full) ^ (h % full >> 33)) * 0xFF51AFD7ED558CCD % full
    return h ^ (h >> 29)


@functools.cache
def brute_features(word):
    full, out = 1 << 64, set()
    for size, salt in ((None, 0), (4, 0x51ED270B), (5, 0x7FEB352D)):
        h = brute_word_hash(word[:size]) ^ (salt * 0x9E3779B97F4A7C15 % full)
        out.add(h * 0xD6E8FEB86659FD93 % full >> (64 - T.BITS))
    return out


def brute_toxicity(model, text):
    found = set().union(*(brute_features(w) for w in set(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()))))
    x = sum(float(model.weights[f]) for f in sorted(found)) + model.bias
    return 1 / (1 + math.exp(-min(30, max(-30, x))))


def test_toxicity_edges(spark, edges, edge_rows, empty):
    labels = spark.createDataFrame([(5, 0), (5, 1), (7, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = T.learn(edges, labels)
    got = T.score(edges, model).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert T.score(empty, model).count() == 0 and T.accept(edges, model).columns == edges.columns
    assert {r.score < 0.01 for r in T.score(edges, T.learn(edges, labels.limit(0))).collect()} == {True}


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = Q.score(docs, Q.learn(docs, labels)).join(labels, "doc_id").collect()
    out = [(r.predicted, r.quality) for r in got if held(r.doc_id, 3, 1)]
    assert len(out) > 80 and np.mean([p == y for p, y in out]) > 0.95


def test_quality_edges(spark, edges, edge_rows, empty):
    labels = spark.createDataFrame([(5, 0), (5, 1), (7, 0), (6, 1), (8, 1), (None, 1)], "doc_id long, quality int")
    model = Q.learn(edges, labels)
    got = Q.score(edges, model).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    assert Q.score(empty, model).count() == 0
    assert {r.score for r in Q.score(edges, Q.learn(edges, labels.limit(0))).collect()} == {0.5}


def brute_quality(model, text):
    """Features, attention and score of one text, a word and a passage at a time."""
    data = (text or "").encode()
    words, at = [], 0  # with what follows them up to the next
    for m in re.finditer(rb"[\t-\r ]*[^\t-\r ]+[\t-\r ]*|[\t-\r ]+", data):
        words += [m.group()[i : i + Q.WORD] for i in range(0, len(m.group()), Q.WORD)]
        at += len(m.group())
    assert at == len(data)
    bags = [words[i : i + Q.PASSAGE] for i in range(0, len(words), Q.PASSAGE)] or [[]]
    bare = lambda w: (w.translate(None, b" \t\n\v\f\r") if w[:1].strip() else w)
    seen = len({bare(w) for w in words})
    p, hs, ss = model.params, [], []
    for bag in bags:
        whole = b"".join(bag)
        x = np.zeros(Q.SIZE)
        for c in whole:
            x[Q._KIND[c]] += 1
        x[4] += not whole
        size = max(1, len(whole))
        x[: Q.KINDS] = np.sqrt(x[: Q.KINDS] / size)
        own = [bare(w) for w in bag]
        n = max(1, len(bag))
        x[Q.KINDS : Q.KINDS + Q.WORD_FEATURES] = np.log1p(n) / 5, math.log(size / n) / 3, len(set(own)) / n, seen / max(1, len(words)), sum(a == b for a, b in zip(own, own[1:], strict=False)) / n, math.log1p(len(words)) / 10
        for a, b in zip(whole, whole[1:], strict=False):
            x[Q.KINDS + Q.WORD_FEATURES + ((a * 31 + b) * 0x9E3779B1 % (1 << 32) >> 24)] += 1
        x[Q.KINDS + Q.WORD_FEATURES :] = np.sqrt(x[Q.KINDS + Q.WORD_FEATURES :] / size)
        h = np.tanh(((x - model.mean) / model.scale) @ p["E"] + p["e"])
        hs.append(h)
        ss.append(float(np.clip((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["a"], -20, 20)))
    w = np.exp(np.array(ss))
    z = (w / w.sum()) @ np.array(hs)
    return float(1 / (1 + np.exp(-(z @ p["c"] + p["b"])))[0])


def test_quality_equals_a_plain_forward_pass(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = Q.learn(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, SF).collect()}
    for r in docs.limit(150).collect():
        s = brute_quality(model, r.text)
        assert abs(got[r.doc_id].score - s) < 1e-4 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
    texts = ["", " ", " a", "a " * 200, "x" * 5000 + " y", "é ü\n" * 70 + "the the the", None]
    assert np.allclose(model.score(texts), [brute_quality(model, t) for t in texts], atol=1e-5)


def test_passages_cover_every_byte():
    values = ["a b c " * 100, "", "x" * 5000, " lead and trail ", None]
    for x, firsts in Q.passages(values):
        assert len(firsts) == len(values) + 1 and x.shape == (firsts[-1], Q.SIZE)
        assert firsts[1] - firsts[0] == -(-300 // Q.PASSAGE)
        assert np.allclose((x[:, : Q.KINDS] ** 2).sum(1), 1, atol=1e-5)


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(120):
        b = rng.normal(0, 0.1, (rng.integers(2, 12), Q.SIZE)).astype(np.float32)
        if i % 2:
            b[rng.integers(len(b)), :5] += 3
        bags.append(b)
        labels.append(i % 2)
    m = Q.Model.fit(bags, labels, 0.5)
    x = np.concatenate(bags)
    firsts = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    out = m._forward(m.params, (x - m.mean) / m.scale, firsts)[-1]
    assert np.mean((out > 0) == np.array(labels)) > 0.95
