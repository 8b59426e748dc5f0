"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until pieces are at most ``LEAF`` characters; leaves are
encoded alone and neighbours joined up the tree. At a join only a window around
the seam is encoded again. It grows, doubling, until both of its ends stand at a
change from a character that is no white space to a space or newline. No match
of the splitting pattern ever reaches across such a change and no decision
before it looks beyond it, so pre-tokens, and with them tokens, outside the
window are those of the joined text: a proof, not a heuristic. Without such a
change the window is the whole of that side. Decoding concatenates the bytes of
halves up the same kind of tree.

Defined results: null counts as empty, which has no tokens; texts of any length
are encoded whole; runs that overflow the library's own pattern engine (it stops
on about a million spaces) are split here by an equal pattern and merged by the
same ranks; of equally ranked merges the first is done, as there; repeated rows keep a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm.batches import map_columns, strings, texts

#: Longest leaf in characters: short enough that ordinary texts are joined from several.
LEAF = 256
_WINDOW = 32
#: Tokens from which on they are kept as an array, and digested in parts.
_PACKED = 1 << 14
#: The library's engine is trusted with pieces of so many characters; beyond, see _encode_long.
_ENGINE = 1 << 16
#: A change after which encoding starts afresh; deliberately narrower than the pattern's own classes.
_SEAM = re.compile(r"[^\s\x1c-\x1f\x85](?=[ \n])")

_CODECS: dict[tuple[str, str], Codec] = {}


class Codec:
    """Encoder and decoder for a rank file and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.decimal = [str(i) for i in range(len(self.pieces))]

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        """The codec of a rank file that this process can open."""
        with open(path, "rb") as f:
            return cls.load(path, f.read(), pattern)

    @classmethod
    def load(cls, name: str, content: bytes, pattern: str) -> Codec:
        """One codec for each file and process, from the file's content."""
        if (name, pattern) not in _CODECS:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
            _CODECS[name, pattern] = cls(ranks, pattern)
        return _CODECS[name, pattern]

    def piece(self, text: str) -> list[int]:
        """Tokens of a piece encoded alone."""
        return self.encoding.encode_ordinary(text) if len(text) <= _ENGINE else self._encode_long(text)

    def _encode_long(self, text: str) -> list[int]:
        import regex

        out: list[int] = []
        for m in regex.finditer(self.pattern, text):
            out += self.encoding._encode_single_piece(m.group().encode())
        return out

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        return list(self.tokens(text, leaf))

    def tokens(self, text: str, leaf: int = LEAF) -> list[int] | array:
        """As encode(); those of a long text as an array of four bytes each."""
        return self._tree(text, 0, len(text), leaf)

    def _tree(self, text: str, lo: int, hi: int, leaf: int) -> list[int] | array:
        if hi - lo <= leaf:
            return self.piece(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._tree(text, lo, mid, leaf), self._tree(text, mid, hi, leaf))

    def join(self, text: str, lo: int, mid: int, hi: int, left, right) -> list[int] | array:
        """Tokens of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        a, b = self._before(text, lo, mid), self._after(text, mid, hi)
        keep = self._count(reversed(left), len(text[a:mid].encode()))
        drop = self._count(iter(right), len(text[mid:b].encode()))
        seam = self.piece(text[a:b])
        if len(left) + len(right) < _PACKED:
            return [*left[: len(left) - keep], *seam, *right[drop:]]
        out = array("I", left[: len(left) - keep])
        out.extend(seam)
        out.extend(right[drop:])
        return out

    def _count(self, ids, size: int) -> int:
        """How many of the next tokens make up so many bytes; seams are ends of tokens, so it comes out even."""
        n = 0
        while size > 0:
            size -= len(self.pieces[next(ids)])
            n += 1
        return n

    @staticmethod
    def _before(text: str, lo: int, mid: int) -> int:
        size = _WINDOW
        while True:
            start = max(lo, mid - size)
            found = [m.end() for m in _SEAM.finditer(text, start, min(mid + 1, len(text)))]
            if found and found[-1] <= mid:
                return found[-1]
            if start == lo:
                return lo
            size *= 2

    @staticmethod
    def _after(text: str, mid: int, hi: int) -> int:
        size = _WINDOW
        while True:
            end = min(hi, mid + size)
            found = _SEAM.search(text, max(0, mid - 1), end)
            if found and found.end() >= mid:
                return found.end()
            if end == hi:
                return hi
            size *= 2

    def decode(self, ids: list[int], leaf: int = 8 * LEAF) -> bytes:
        return b"".join(self.decoded(ids, leaf))

    def decoded(self, ids, leaf: int = 8 * LEAF) -> Iterator[bytes]:
        """decode() in parts: the leaves of its tree from left to right, whose concatenation is the text."""
        if len(ids) <= leaf:
            yield b"".join(map(self.pieces.__getitem__, ids))
            return
        mid = len(ids) // 2
        yield from self.decoded(ids[:mid], leaf)
        yield from self.decoded(ids[mid:], leaf)


def shared_codec(spark: SparkSession, path: str, pattern: str) -> Callable[[], Codec]:
    """What gives the codec on an executor: the file, a vocabulary, is read by the driver and sent along."""
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    return lambda: Codec.load(path, content.value, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row."""
    codec_of = shared_codec(docs.sparkSession, path, pattern)

    def run(batch: pa.RecordBatch) -> dict:
        codec = codec_of()
        return {"doc_id": batch["doc_id"], "ids": [codec.encode(t) for t in strings(batch["text"])]}

    rows = texts(docs, id_col, text_col)
    return map_columns(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) for each row of (doc_id, ids)."""
    codec_of = shared_codec(encoded.sparkSession, path, pattern)

    def run(batch: pa.RecordBatch) -> dict:
        codec = codec_of()
        return {"doc_id": batch["doc_id"], "bytes": [codec.decode(x or []) for x in batch["ids"].to_pylist()]}

    return map_columns(encoded.select("doc_id", "ids"), run, f"doc_id {dict(encoded.dtypes)['doc_id']}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, decoded again from the ids, digested."""
    codec_of = shared_codec(docs.sparkSession, path, pattern)

    def run(batch: pa.RecordBatch) -> dict:
        codec = codec_of()
        n, sent, back = [], [], []
        for t in strings(batch["text"]):
            ids = codec.tokens(t)
            n.append(len(ids))
            digest = hashlib.sha256()
            for at in range(0, len(ids), _PACKED):
                digest.update(("," * (at > 0) + ",".join(map(codec.decimal.__getitem__, ids[at : at + _PACKED]))).encode())
            sent.append(digest.hexdigest())
            digest = hashlib.sha256()
            for part in codec.decoded(ids):
                digest.update(part)
            back.append(digest.hexdigest())
        return {"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": sent, "decoded_sha256": back}

    rows = texts(docs, id_col, text_col)
    return map_columns(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
