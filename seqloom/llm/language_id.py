"""Language identification by error-correcting output codes.

Every language has a codeword; a binary classifier for each bit is a linear
model over hashed byte trigrams of the lower-cased text, learned from a bounded
sample (``PER_LANGUAGE`` rows of each language, those of the least hash of the id, of
at most ``LEARN_BYTES`` bytes). Decoding sums a loss for each codeword over the margins
of all bits, weighted by how well each bit's classifier separates, and takes the nearest
codeword; two codewords that come out close flag the text as ambiguous. Up to five
languages get the exhaustive code, more of them a code of greatest distance among seeded
random ones.

Defined results: null texts and texts without a letter (Unicode category L) are ``und``
with score 0; rows of null language are never learned from; with nothing to learn from
every text is ``und``; texts of any length are read whole, piece by piece; of equally
near codewords the first language by name is taken, and the text is ambiguous; repeated
rows keep a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.batches import LEARN_BYTES, blocks, fold, joined, lowered, map_columns, pieces, sampled, texts

UNKNOWN = "und"
DIMS = 1 << 13
#: Bound of the learning sample, in rows of each language.
PER_LANGUAGE = 400
#: Share of the second-best language's probability in the best's above which a text is ambiguous.
AMBIGUOUS = 0.8
#: Bytes of text that are scored together; their trigrams have a row of weights each.
BLOCK = 1 << 16
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_TABLE = np.full(256, 32, np.uint8)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1; no column is constant or repeated."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 5:
        bits = [[1 if not (c >> (k - 2 - j)) & 1 else -1 for j in range(k - 1)] for c in range(1, 1 << (k - 1))]
        return np.array([[1] * len(bits), *zip(*bits, strict=True)], np.float32)
    rng, best, far = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.float32), (k, length))
        m = m[:, np.abs(m.sum(0)) < k]
        d = (m.shape[1] - m @ m.T) / 2 + 1e9 * np.eye(k)
        if d.min() > far:
            best, far = m, d.min()
    return best


def prepared(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode() + b" "


def trigram_codes(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each position but the last two."""
    x = _TABLE[data].astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(19)).astype(np.int64)


def profile(text: str | None) -> np.ndarray:
    data = np.frombuffer(prepared(text), np.uint8)
    return np.bincount(trigram_codes(data), minlength=DIMS).astype(np.float32) if len(data) > 2 else np.zeros(DIMS, np.float32)


class Model:
    """Languages, their codewords, a linear model for each bit, the weights of bits."""

    def __init__(self, names: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.names, self.code, self.weights, self.bias, self.trust = names, code, weights, bias, trust

    @classmethod
    def fit(cls, counts: np.ndarray, labels: list[str], rounds: int = 150) -> Model:
        names = sorted(set(labels))
        code = codewords(len(names))
        if len(names) < 2:
            return cls(names, code, np.zeros((DIMS, code.shape[1]), np.float32), np.ones(code.shape[1], np.float32) * 4, np.ones(code.shape[1], np.float32))
        y = np.array([names.index(x) for x in labels])
        x = counts.astype(np.float32)
        x /= np.maximum(x.sum(1, keepdims=True), 1)
        scale = np.sqrt(x.mean(0) + 1e-5)
        x /= scale
        del counts
        share = np.bincount(y, minlength=len(names))[y].astype(np.float32)
        t, weight = code[y], (1 / share / len(names))[:, None]
        w, b = np.zeros((DIMS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
        for _ in range(rounds):
            g = -t / (1 + np.exp(np.clip(t * (x @ w + b), -30, 30))) * weight
            dw, db = x.T @ g + 1e-5 * w, g.sum(0)
            gw += dw * dw
            gb += db * db
            w -= 0.3 * dw / np.sqrt(gw)
            b -= 0.3 * db / np.sqrt(gb)
        margin = t * np.clip(x @ w + b, -8, 8)
        good = 1 / (1 + (np.log1p(np.exp(-margin)) * weight).sum(0) * 4)
        return cls(names, code, (w / scale[:, None]).astype(np.float32), b, (good / good.sum() * len(good)).astype(np.float32))

    def margins(self, values) -> tuple[np.ndarray, np.ndarray]:
        """Margins of the bits for each text, from all of its trigrams, and which texts have a letter."""
        n = len(values)
        total, size, known = np.zeros((n, len(self.bias))), np.zeros(n), np.zeros(n, bool)
        for b in blocks(values, BLOCK):
            own = slice(b.first, b.end)
            if len(b.data) <= BLOCK:
                self._add(joined([b" " + t + b" " for t in lowered(b).texts()]), total[own], size[own])
                known[own] = _with_letter(b)
                continue
            before = b" "
            for s, e in pieces(b.data, BLOCK):
                piece = joined([b.data[s:e].tobytes()])
                known[own] |= _with_letter(piece)
                text = before + lowered(piece).data.tobytes() + (b" " if e == len(b.data) else b"")
                self._add(joined([text]), total[own], size[own])
                before = text[-2:]  # the trigrams that begin here end in the next piece
        return total / np.maximum(size, 1)[:, None] + self.bias, known

    def _add(self, block, total: np.ndarray, size: np.ndarray) -> None:
        got = np.zeros((len(block.data), total.shape[1]), np.float32)
        if len(block.data) > 2:
            got[:-2] = self.weights[trigram_codes(block.data)]
        for back in (1, 2):
            got[np.maximum(block.offsets[1:] - back, 0)] = 0  # reaches into the next text
        total += np.add.reduceat(got, block.offsets[:-1], axis=0, dtype=np.float64)
        size += np.maximum(np.diff(block.offsets) - 2, 0)

    def predict(self, values) -> tuple[list[str], list[float], list[bool]]:
        if not self.names or len(values) == 0:
            return [UNKNOWN] * len(values), [0.0] * len(values), [False] * len(values)
        margins, known = self.margins(values)
        best, scores, unsure = self.decoded(margins)
        names = [self.names[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
        return names, np.where(known, scores, 0.0).tolist(), (known & unsure).tolist()

    def decoded(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss-weighted decoding: the nearest codeword, its probability, whether the second is close to it."""
        m = np.clip(margins, -8, 8)
        loss = (np.log1p(np.exp(-m[:, None, :] * self.code[None])) * self.trust).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, axis=1)
        second = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return p.argmax(1), np.minimum(top[:, -1], 1.0), second > AMBIGUOUS * top[:, -1]


def _with_letter(block) -> np.ndarray:
    """Which texts of the block have a letter of any script."""
    counts = np.concatenate(([0], np.cumsum(_ASCII_LETTER[block.data])))
    known = counts[block.offsets[1:]] > counts[block.offsets[:-1]]
    for i in np.flatnonzero(~known).tolist():
        part = block.data[block.offsets[i] : block.offsets[i + 1]]
        if len(part) and part.max() > 127:
            known[i] = _LETTER.search(part.tobytes().decode("utf-8", "replace")) is not None
    return known


def learn(docs: DataFrame, held_out: int = 2, modulus: int = 4, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on at most ``per_language`` rows of each language outside the held-out fold."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", modulus) != held_out))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Model.fit(np.zeros((0, DIMS), np.float32), [])
    chosen = sampled(rows.filter(F.octet_length("text") <= LEARN_BYTES), "lang", n, per_language, "lang", ("text",))

    def run(batch: pa.RecordBatch) -> dict:
        p = [profile(t) for t in batch["text"].to_pylist()]
        at = [np.flatnonzero(x) for x in p]
        return {"lang": batch["lang"], "at": [a.tolist() for a in at], "n": [x[a].tolist() for x, a in zip(p, at, strict=True)]}

    got = map_columns(chosen.select("lang", "text"), run, "lang string, at array<int>, n array<float>").toArrow()
    counts = np.zeros((got.num_rows, DIMS), np.float32)
    for i, (at, seen) in enumerate(zip(got["at"], got["n"], strict=True)):
        counts[i, at.values.to_numpy()] = seen.values.to_numpy()
    return Model.fit(counts, got["lang"].to_pylist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        names, scores, unsure = shared.value.predict(batch["text"])
        return {"doc_id": batch["doc_id"], "lang_pred": names, "score": scores, "ambiguous": unsure}

    rows = texts(docs, id_col, text_col)
    return map_columns(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, ambiguous boolean")


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, without the rows rejected: no language, or an ambiguous one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            names, _, unsure = shared.value.predict(batch["text"])
            yield batch.filter(pa.array([n != UNKNOWN and not u for n, u in zip(names, unsure, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
