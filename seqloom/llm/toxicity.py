"""Toxicity by a counterfactually regularised classifier.

A logistic model over hashed words, word beginnings of four and five letters
and their presence in the text is learned from a bounded sample of labelled rows
(``PER_CLASS`` of each class, those of the least hash of the id, of at most
``LEARN_BYTES`` bytes). Every learning text that has identity terms is rewritten with
each of them swapped for another of its group; the squared change of the score between
the two is penalised with weight ``PENALTY``, so that a mere mention doesn't move the
score.

Which terms: groups that the caller gives (``IDENTITY_TERMS``, words for groups of
people), and neutral terms found in the learning texts themselves: words of at least
``TERM_LETTERS`` letters in ``TERM_SHARE`` of the clean texts that the classes don't
differ in. Two of them that stand in the same texts most often are interchangeable,
and a pair. The features of all terms are in the model, so that the penalty has
weights to hold.

Scores are probabilities at the share of toxic rows among the labelled. Defined
results: null and empty texts get the score of a text without any feature;
several labels of one document count as one, toxic if any is; of several texts of
one id the one of the least hash is learned from; with no labelled
rows every score is 0; a text of any length is scored whole, piece by piece (a word of
more than a piece without white space counts as several); terms of equal frequency go by
their spelling, features of equal association by their number; repeated rows keep a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.batches import BLOCK_BYTES, LEARN_BYTES, Block, blocks, fold, joined, lowered, map_columns, pieces, sampled, texts
from seqloom.llm.durable import settle
from seqloom.llm.winnowing import word_hashes, word_spans

BITS = 20
#: Bound of the learning sample, in rows of each class.
PER_CLASS = 2500
PENALTY = 4.0
THRESHOLD = 0.3
#: Features kept for the model, those that tell the classes apart best.
FEATURES = 20000
#: Neutral terms: letters at least, share of clean learning texts at least, how many at most,
#: and the most by which the classes may differ in them (G statistic; chance exceeds it once in a thousand).
TERM_LETTERS, TERM_SHARE, TERMS, TERM_G = 4, 0.02, 200, 10.83

#: Words for groups of people by kind; each is swapped for the next of its own row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("immigrants", "citizens", "refugees"),
    ("blind", "deaf", "disabled"), ("old", "young"), ("elderly", "teenage"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def swaps(groups=IDENTITY_TERMS) -> dict[str, str]:
    return {a: b for g in groups for a, b in zip(g, (*g[1:], g[0]), strict=True)}


def _word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Three hashed features for each word: itself, and its beginnings (of the word where it is shorter)."""
    cols = []
    for size, salt in ((None, 0), (4, 0x51ED270B), (5, 0x7FEB352D)):
        e = ends if size is None else np.minimum(ends, starts + size)
        h = word_hashes(data, starts, e) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        cols.append(((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.stack(cols, axis=1)


def term_features(terms: list[str]) -> np.ndarray:
    """The three features of each term, a word each."""
    b = joined([t.encode() for t in terms])
    return _word_features(b.data, *word_spans(b.data, b.offsets)[:2]) if terms else np.empty((0, 3), np.int64)


def term_keys(terms: list[str]) -> np.ndarray:
    b = joined([t.encode() for t in terms])
    return word_hashes(b.data, *word_spans(b.data, b.offsets)[:2])


def bags(values, terms: list[str] | tuple[str, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: the distinct features of its words that are no terms, and the terms it has, by number."""
    keys = term_keys(list(terms))
    order = np.argsort(keys)
    for b in blocks(values, LEARN_BYTES):
        b = lowered(b)
        starts, ends, bounds = word_spans(b.data, b.offsets)
        f = _word_features(b.data, starts, ends) if len(starts) else np.empty((0, 3), np.int64)
        number = np.full(len(starts), -1)
        if len(keys) and len(starts):
            h = word_hashes(b.data, starts, ends)
            at = order[np.minimum(np.searchsorted(keys, h, sorter=order), len(keys) - 1)]
            number = np.where(keys[at] == h, at, -1)
        for i in range(b.end - b.first):
            own = slice(bounds[i], bounds[i + 1])
            yield np.unique(f[own][number[own] < 0]), np.unique(number[own][number[own] >= 0])


def with_terms(base: np.ndarray, named: np.ndarray, features: np.ndarray) -> np.ndarray:
    """A bag of features with those of its terms."""
    return np.union1d(base, features[named].ravel())


def words_of(block: Block) -> Iterator[list[str]]:
    """The distinct words of each text of a lower-cased block."""
    starts, ends, bounds = word_spans(block.data, block.offsets)
    low = block.data.tobytes()
    for i in range(block.end - block.first):
        own = slice(bounds[i], bounds[i + 1])
        yield list({low[s:e].decode("utf-8", "replace") for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)})


def likelihood_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """G statistic of each feature's presence against the class."""
    out, n = np.zeros(len(pos)), n_pos + n_neg
    for seen, size in ((pos, n_pos), (neg, n_neg)):
        for have, want in ((seen, (pos + neg) * size / n), (size - seen, (n - pos - neg) * size / n)):
            out += 2 * have * np.log(np.maximum(have, 1e-9) / np.maximum(want, 1e-9))
    return out


def pairs_of(have: np.ndarray) -> np.ndarray:
    """The partner of each term by a matrix (texts, terms) of what occurs where: from the most
    frequent down, each free term takes the free one most alike in its texts (cosine). A term
    left over is its own partner."""
    x = have.astype(np.float64)
    size = np.sqrt(np.maximum(x.sum(0), 1))
    like = x.T @ x / np.outer(size, size)
    partner, free = np.arange(have.shape[1]), np.ones(have.shape[1], bool)
    for i in np.argsort(-x.sum(0), kind="stable").tolist():
        if not free[i]:
            continue
        free[i] = False
        if free.any():
            j = int(np.where(free, like[i], -1).argmax())
            free[j], partner[i], partner[j] = False, j, i
    return partner


_NONE = np.empty(0, np.int64)


class Model:
    """Weights by feature bucket; most are zero. twins: how many learning texts had a counterfactual."""

    twins = 0

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: list[int], twins: list[np.ndarray | None], share: float, penalty: float = PENALTY, rounds: int = 400, terms: np.ndarray = _NONE) -> Model:
        """bags: features of each text; twins: those of its counterfactual; share: of toxic rows among all; terms: features that the model has in any case."""
        w = np.zeros(1 << BITS, np.float32)
        y = np.array(labels, np.float64)
        if len(y) == 0:
            return cls(w, -30.0)
        if y.min() == y.max():
            return cls(w, 30.0 if y[0] else -30.0)
        pos = np.bincount(np.concatenate([b for b, t in zip(bags, labels, strict=True) if t]), minlength=1 << BITS).astype(np.float64)
        neg = np.bincount(np.concatenate([b for b, t in zip(bags, labels, strict=True) if not t]), minlength=1 << BITS).astype(np.float64)
        z = likelihood_ratio(pos, neg, y.sum(), len(y) - y.sum())
        chosen = np.flatnonzero(z > 2 * np.log(max(2, np.count_nonzero(pos + neg))))  # above what chance gives among so many
        chosen = np.union1d(chosen[np.argsort(-z[chosen], kind="stable")[:FEATURES]], terms)
        slot = np.full(1 << BITS, -1, np.int64)
        slot[chosen] = np.arange(len(chosen))

        def rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            got = [s[s >= 0] for s in (slot[b] for b in sets)]
            return np.concatenate([*got, np.empty(0, np.int64)]), np.repeat(np.arange(len(got)), [len(g) for g in got])

        col, row = rows(bags)
        have = [i for i, t in enumerate(twins) if t is not None]
        tcol, trow = rows([twins[i] for i in have])
        weight = np.where(y > 0, share / y.sum(), (1 - share) / (len(y) - y.sum()))
        weight *= 1 / weight.sum()
        theta, b = np.zeros(len(chosen)), float(np.log(share / (1 - share)))
        g2, gb2 = np.full(len(chosen), 1e-10), 1e-10
        for _ in range(rounds):
            s = np.bincount(row, theta[col], len(y)) + b
            prob = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            r = (prob - y) * weight
            grad, gb = np.bincount(col, r[row], len(chosen)) + 2e-6 * theta, r.sum()
            if have:
                other = 1 / (1 + np.exp(-np.clip(np.bincount(trow, theta[tcol], len(have)) + b, -30, 30)))
                mine = prob[have]
                d = 2 * penalty * (mine - other) * weight[have]
                here = np.zeros(len(y))
                here[have] = d * mine * (1 - mine)
                grad += np.bincount(col, here[row], len(chosen)) - np.bincount(tcol, (d * other * (1 - other))[trow], len(chosen))
                gb += (d * (mine * (1 - mine) - other * (1 - other))).sum()
            g2 += grad * grad
            gb2 += gb * gb
            theta -= 0.15 * grad / np.sqrt(g2)
            b -= 0.15 * gb / np.sqrt(gb2)
        w[chosen] = np.where(np.abs(theta) > 0.02, theta, 0)
        return cls(w, b)

    def score(self, values) -> list[float]:
        """Probability of each text, from all of its words."""
        out: list[float] = []
        for b in blocks(values):
            total = np.zeros(b.end - b.first)
            if len(b.data) > BLOCK_BYTES:
                found = _NONE  # features with a weight, at most as many as the model has
                for s, e in pieces(b.data):
                    found = np.union1d(found, self._pairs(joined([b.data[s:e].tobytes()])))
                total[0] = np.bincount(np.zeros(len(found), np.int64), self.weights[found], 1)[0]
            else:
                found = self._pairs(b)
                total += np.bincount(found >> BITS, self.weights[found & ((1 << BITS) - 1)], b.end - b.first)
            out += (1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))).tolist()
        return out

    def _pairs(self, b: Block) -> np.ndarray:
        """Number of the text times 2^BITS plus the feature, for the features with a weight, each once."""
        b = lowered(b)
        starts, ends, bounds = word_spans(b.data, b.offsets)
        if len(starts) == 0:
            return _NONE
        f = _word_features(b.data, starts, ends)
        at, k = np.nonzero(self.weights[f])
        return np.unique((np.searchsorted(bounds, at, side="right") - 1) * (1 << BITS) + f[at, k])


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 2, modulus: int = 4, per_class: int = PER_CLASS, groups=IDENTITY_TERMS, penalty: float = PENALTY) -> Model:
    """Fits on at most ``per_class`` labelled rows of each class outside the held-out fold."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    marks = marks.filter(fold("doc_id", modulus) != held_out)
    n = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Model.fit([], [], [], 0.0)
    # The sample is bounded, 2 * per_class ids, so it goes to the texts and not they to it.
    ids = F.broadcast(sampled(marks, "y", n, per_class, "toxic"))
    rows = texts(docs).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LEARN_BYTES).join(ids, "doc_id")
    text = F.coalesce("text", F.lit(""))
    rows = settle(rows.groupBy("doc_id", "y").agg(F.min_by(text, F.xxhash64(text)).alias("text")).select("y", "text"))
    table = swaps(groups)
    terms = [*table, *(t for t in neutral_terms(rows) if t not in table)]

    def run(batch: pa.RecordBatch) -> dict:
        got = list(bags(batch["text"], terms))
        return {"y": batch["y"], "bag": [b.tolist() for b, _ in got], "named": [t.tolist() for _, t in got]}

    got = map_columns(rows, run, "y int, bag array<int>, named array<int>").toArrow()
    lists = {c: [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in got[c]] for c in ("bag", "named")}
    return fit_named(lists["bag"], lists["named"], got["y"].to_pylist(), terms, table, n.get(1, 0) / sum(n.values()), penalty)


def fit_named(base: list[np.ndarray], named: list[np.ndarray], labels: list[int], terms: list[str], table: dict[str, str], share: float, penalty: float = PENALTY) -> Model:
    """Fits on bags and terms of bags(): terms of the table are swapped by it, the others by pairs_of()."""
    have = np.zeros((len(base), len(terms)), bool)
    for i, t in enumerate(named):
        have[i, t] = True
    partner = np.arange(len(terms))
    at = {t: i for i, t in enumerate(terms)}
    found = np.array([i for i, t in enumerate(terms) if t not in table], np.int64)
    partner[found] = found[pairs_of(have[:, found])]
    for a, b in table.items():
        partner[at[a]] = at[b]
    features = term_features(terms)
    whole = [with_terms(b, t, features) for b, t in zip(base, named, strict=True)]
    twins = [with_terms(b, partner[t], features) if (partner[t] != t).any() else None for b, t in zip(base, named, strict=True)]
    used = np.flatnonzero(have.any(0) | have.any(0)[partner])
    model = Model.fit(whole, labels, twins, share, penalty, terms=np.unique(features[used]))
    model.twins = sum(t is not None for t in twins)
    return model


def neutral_terms(rows: DataFrame) -> list[str]:
    """Terms of the learning rows (y, text) that both classes use alike, the most frequent first."""
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if 0 not in size or 1 not in size:
        return []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            seen = (Counter(), Counter())
            y = batch["y"].to_pylist()
            for b in blocks(batch["text"], LEARN_BYTES):
                for label, words in zip(y[b.first : b.end], words_of(lowered(b)), strict=True):
                    seen[label > 0].update(w for w in words if len(w) >= TERM_LETTERS and w.isalpha())
            words = list(seen[0])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[0][w] for w in words], pa.int64()), pa.array([seen[1][w] for w in words], pa.int64())], names=["word", "clean", "toxic"])

    counts = rows.mapInArrow(run, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    common = counts.filter(F.col("clean") >= TERM_SHARE * size[0]).orderBy(F.col("clean").desc(), "word").limit(2 * TERMS).collect()
    if not common:
        return []
    g = likelihood_ratio(np.array([r["toxic"] for r in common], np.float64), np.array([r["clean"] for r in common], np.float64), size[1], size[0])
    return [r["word"] for r, x in zip(common, g, strict=True) if x < TERM_G][:TERMS]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        s = shared.value.score(batch["text"])
        return {"doc_id": batch["doc_id"], "score": s, "predicted": [int(x >= threshold) for x in s]}

    rows = texts(docs, id_col, text_col)
    return map_columns(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")


def accept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows scored toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            s = shared.value.score(batch["text"])
            yield batch.filter(pa.array([x < threshold for x in s], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
