"""Quality by gated attention over passages (multiple-instance learning).

A text is a bag of passages of ``PASSAGE`` words. Each passage is described by
counts of its bytes by kind, of its words, of how often words repeat in the
passage, the neighbouring word and the whole text, and by hashed byte pairs; an
encoder maps this to ``HIDDEN`` values, gated attention weighs the passages, and
a linear layer scores the weighted sum. Encoder, attention and scorer are
learned together, from labels of whole documents only, on a bounded sample
(``PER_CLASS`` of each class, those of the least hash of the id, of at most
``LEARN_BYTES`` bytes). Learning and scoring take every passage of a text.

A word is a run of bytes up to the next word, white space at the beginning of a text goes
with the first; runs of more than ``WORD`` bytes are several words, so that a passage is
bounded. Longer texts are read twice, piece by piece: once for what is counted over the
whole, once to encode passages and add them up under weights that are scaled as the
highest attention rises.

Defined results: null and empty texts are one empty passage; several labels of a
document count as one, the lowest; of several texts of one id the one of the least hash is
learned from; with no labelled rows every score is 0.5; texts of any length are scored
whole; a score of exactly the threshold predicts 1; repeated rows keep a row each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.batches import BLOCK_BYTES, LEARN_BYTES, Block, blocks, fold, map_columns, sampled, texts
from seqloom.llm.durable import settle

PASSAGE = 64
WORD = 1024
HIDDEN = 24
PAIRS = 256
#: Bound of the learning sample: rows of each class.
PER_CLASS = 1200
THRESHOLD = 0.5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Kinds of bytes: lower, upper, digit, beyond ASCII, space, line end, then each mark on its own.
_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[_SPACE], _KIND[10] = 4, 5
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_KIND[_MARKS] = np.arange(6, 6 + len(_MARKS))
_KIND[[*range(9), *range(14, 32), 127]] = 6 + len(_MARKS)
KINDS = 7 + len(_MARKS)
WORD_FEATURES = 6
SIZE = KINDS + WORD_FEATURES + PAIRS


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin: with every text, after white space, and every WORD bytes of a longer run."""
    begins = ~_SPACE[data]
    begins[1:] &= _SPACE[data[:-1]]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[full] = True
    starts = np.flatnonzero(begins)
    # A text that begins with white space: its first run belongs to the word after that.
    late = np.searchsorted(starts, full[_SPACE[data[full]]]) + 1
    late = late[late < len(starts)]
    late = late[~np.isin(starts[late], full)]
    starts = np.delete(starts, late)
    gaps = np.diff(np.concatenate((starts, [len(data)])))
    ends = np.searchsorted(offsets, starts, side="right")
    gaps = np.minimum(gaps, offsets[np.minimum(ends, len(offsets) - 1)] - starts)
    if len(gaps) and gaps.max() > WORD:
        more = [np.arange(s, s + g, WORD)[1:] for s, g in zip(starts[gaps > WORD].tolist(), gaps[gaps > WORD].tolist(), strict=True)]
        starts = np.sort(np.concatenate((starts, *more)))
    return starts


def passages(values, limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of texts: a row of features for each passage, and the first passage of each text."""
    for b in blocks(values, limit):
        x, firsts, _ = _encoded(b)
        yield x, firsts


def _encoded(b: Block, whole: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the passages of a block, the first passage of each text, the words' hashes.

    whole: number of words, and of distinct ones, of the text of which the block is a part."""
    data, offsets, texts_ = b.data, b.offsets, b.end - b.first
    starts = word_starts(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    number = np.diff(bounds)
    bags = np.maximum(1, -(-number // PASSAGE))
    firsts = np.concatenate(([0], np.cumsum(bags)))
    n = int(firsts[-1])
    owner = np.repeat(np.arange(texts_), number)
    of_word = firsts[:-1][owner] + (np.arange(len(starts)) - bounds[:-1][owner]) // PASSAGE
    of_byte = np.repeat(of_word, np.diff(np.concatenate((starts, [len(data)]))))
    kinds = np.bincount(of_byte * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS)
    kinds[kinds.sum(1) == 0, 4] = 1  # an empty text counts as a blank
    size = kinds.sum(1, keepdims=True)
    x = np.zeros((n, SIZE), np.float32)
    x[:, :KINDS] = np.sqrt(kinds / size)
    same = of_byte[1:] == of_byte[:-1]
    pair = (((data[:-1].astype(np.uint32) * 31 + data[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(24))[same]
    pairs = np.bincount(of_byte[:-1][same] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS)
    x[:, KINDS + WORD_FEATURES :] = np.sqrt(pairs / size)
    h = _hashes(data, starts) if len(starts) else np.empty(0, np.uint64)
    w = x[:, KINDS : KINDS + WORD_FEATURES]
    words = np.maximum(np.bincount(of_word, minlength=n), 1)
    w[:, 0] = np.log1p(words) / 5
    w[:, 1] = np.log(size[:, 0] / words) / 3
    w[:, 2] = _distinct(of_word, h, n) / words
    total, different = (number, _distinct(owner, h, texts_)) if whole is None else (np.array([whole[0]]), np.array([whole[1]]))
    w[:, 3] = np.repeat(different / np.maximum(total, 1), bags)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    w[:, 4] = np.bincount(of_word[again], minlength=n) / words
    w[:, 5] = np.repeat(np.log1p(total) / 10, bags)
    return x, firsts, h


def parts(data: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A long text in blocks of whole passages."""
    at = 0
    while at < len(data):
        view = data[at : at + limit]
        if at + len(view) < len(data):
            starts = word_starts(view, np.array([0, len(view)]))
            # The last word may go on beyond the view; what begins with it is for the next block.
            view = view[: int(starts[(len(starts) - 1) // PASSAGE * PASSAGE])]
        yield Block(0, 1, view, np.array([0, len(view)]))
        at += len(view)


def _hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word: a polynomial over its bytes, where white space counts zero."""
    ends = np.concatenate((starts[1:], [len(data)]))
    pos = np.arange(len(data)) - np.repeat(starts, ends - starts)
    code = np.where(_SPACE[data], 0, data).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(31)
    mult = (pos.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return np.add.reduceat(code * (mult | np.uint64(1)), starts)


def _distinct(group: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, group))
    g, h = group[order], h[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
    return np.bincount(g[new], minlength=n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder (E, e), gated attention (V, U, a), scorer (c, b), over standardised features."""

    def __init__(self, params: dict[str, np.ndarray] | None, mean: np.ndarray | None = None, scale: np.ndarray | None = None):
        self.params, self.mean, self.scale = params, mean, scale

    @staticmethod
    def _passages(p: dict[str, np.ndarray], x: np.ndarray) -> tuple:
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, v, u, np.clip((v * u) @ p["a"], -20, 20)

    @classmethod
    def _forward(cls, p: dict[str, np.ndarray], x: np.ndarray, firsts: np.ndarray) -> tuple:
        h, v, u, s = cls._passages(p, x)
        lens = np.diff(firsts)
        top = np.repeat(np.maximum.reduceat(s, firsts[:-1]), lens)
        w = np.exp(s - top)
        w /= np.repeat(np.add.reduceat(w, firsts[:-1]), lens)
        z = np.add.reduceat(w[:, None] * h, firsts[:-1], axis=0)
        return h, v, u, w, z, z @ p["c"] + p["b"]

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: list[int], share: float, rounds: int = 200, seed: int = 5) -> Model:
        if not bags:
            return cls(None)
        y = np.array(labels, np.float32)
        x = np.concatenate(bags)
        lens = np.array([len(b) for b in bags])
        mean, scale = x.mean(0), x.std(0) + 0.02
        x = ((x - mean) / scale).astype(np.float32)
        starts = np.concatenate(([0], np.cumsum(lens)))
        rng = np.random.default_rng(seed)
        d, k = x.shape[1], HIDDEN
        p = {"E": rng.normal(0, d**-0.5, (d, k)), "e": np.zeros(k), "V": rng.normal(0, k**-0.5, (k, k)), "U": rng.normal(0, k**-0.5, (k, k)), "a": rng.normal(0, 0.1, k), "c": rng.normal(0, k**-0.5, k), "b": np.zeros(1)}
        p = {n: v.astype(np.float32) for n, v in p.items()}
        m, q = {n: np.zeros_like(v) for n, v in p.items()}, {n: np.zeros_like(v) for n, v in p.items()}
        n_pos = max(1, int(y.sum()))
        n_neg = max(1, len(y) - n_pos)
        weight = np.where(y > 0, share / n_pos, (1 - share) / n_neg).astype(np.float32) * len(y)
        step = 0
        per = max(1, min(len(y), 128))
        for _ in range(max(1, rounds * per // len(y)) * 4):
            order = rng.permutation(len(y))
            for at in range(0, len(order), per):
                take = order[at : at + per]
                rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in take])
                firsts = np.concatenate(([0], np.cumsum(lens[take])))
                xs = x[rows]
                h, v, u, w, z, out = cls._forward(p, xs, firsts)
                r = (_sigmoid(out) - y[take]) * weight[take] / len(take)
                owner = np.repeat(np.arange(len(take)), lens[take])
                g = {"c": z.T @ r, "b": np.array([r.sum()], np.float32)}
                dz = r[:, None] * p["c"][None]
                dw = (dz[owner] * h).sum(1)
                ds = w * (dw - np.add.reduceat(w * dw, firsts[:-1])[owner])
                g["a"] = (v * u).T @ ds
                dv, du = ds[:, None] * p["a"] * u * (1 - v * v), ds[:, None] * p["a"] * v * u * (1 - u)
                g["V"], g["U"] = h.T @ dv, h.T @ du
                dh = w[:, None] * dz[owner] + dv @ p["V"].T + du @ p["U"].T
                dh *= 1 - h * h
                g["E"], g["e"] = xs.T @ dh + 1e-4 * p["E"], dh.sum(0)
                step += 1
                for n in p:
                    m[n] += 0.1 * (g[n] - m[n])
                    q[n] += 0.001 * (g[n] * g[n] - q[n])
                    p[n] -= 0.01 * (m[n] / (1 - 0.9**step)) / (np.sqrt(q[n] / (1 - 0.999**step)) + 1e-8)
        return cls({n: v.astype(np.float32) for n, v in p.items()}, mean.astype(np.float32), scale.astype(np.float32))

    def score(self, values, limit: int = BLOCK_BYTES) -> list[float]:
        if self.params is None:
            return [0.5] * len(values)
        out: list[float] = []
        for b in blocks(values, limit):
            if len(b.data) > limit:
                out.append(self._score_long(b.data, limit))
                continue
            x, firsts, _ = _encoded(b)
            out += _sigmoid(self._forward(self.params, (x - self.mean) / self.scale, firsts)[-1]).astype(float).tolist()
        return out

    def _score_long(self, data: np.ndarray, limit: int) -> float:
        number, seen = 0, np.empty(0, np.uint64)
        for b in parts(data, limit):
            h = _hashes(b.data, word_starts(b.data, b.offsets))
            number += len(h)
            seen = np.union1d(seen, h)
        whole, p = (number, len(seen)), self.params
        del seen
        top, weight, z = -np.inf, 0.0, np.zeros(HIDDEN)
        for b in parts(data, limit):
            h, _, _, s = self._passages(p, (_encoded(b, whole)[0] - self.mean) / self.scale)
            new = max(top, float(s.max()))
            w = np.exp(s - new)
            keep = np.exp(top - new)
            weight, z, top = weight * keep + w.sum(), z * keep + w @ h, new
        return float(_sigmoid(z / weight @ p["c"] + p["b"])[0])


def bag(values) -> Iterator[np.ndarray]:
    """All passages of each text; only learning uses this."""
    for x, firsts in passages(values, LEARN_BYTES):
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            yield x[a:b]


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 1, modulus: int = 3, per_class: int = PER_CLASS) -> Model:
    """Fits on at most ``per_class`` labelled rows of each class outside the held-out fold."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y"))
    marks = marks.filter(fold("doc_id", modulus) != held_out)
    n = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Model(None)

    def run(batch: pa.RecordBatch) -> dict:
        return {"y": batch["y"], "bag": [b.astype(np.float32).tobytes() for b in bag(batch["text"])]}

    # The sample is bounded, 2 * per_class ids, so it goes to the texts and not they to it.
    ids = F.broadcast(sampled(marks, "y", n, per_class, "quality"))
    rows = texts(docs).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LEARN_BYTES).join(ids, "doc_id")
    text = F.coalesce("text", F.lit(""))
    rows = rows.groupBy("doc_id", "y").agg(F.min_by(text, F.xxhash64(text)).alias("text")).select("doc_id", "y", "text")
    got = map_columns(settle(rows).orderBy("doc_id"), run, "y int, bag binary").toArrow()
    bags = [np.frombuffer(b, np.float32).reshape(-1, SIZE) for b in got["bag"].to_pylist()]
    return Model.fit(bags, got["y"].to_pylist(), n.get(1, 0) / sum(n.values()))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        s = shared.value.score(batch["text"])
        return {"doc_id": batch["doc_id"], "score": s, "predicted": [int(x >= threshold) for x in s]}

    rows = texts(docs, id_col, text_col)
    return map_columns(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")
