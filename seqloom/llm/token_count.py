"""Token counts with the whole-token shortcut.

Offline, once for each vocabulary, every vocabulary string is merged alone, from its
bytes by the file's merge pairs; those that come out as one token are proven whole tokens. A pre-token among them
counts as one without any merging; only the rest is merged, by its ranks, and
remembered in a cache of bounded size. Special strings in a text count as their
one token and split it, which is the library's default.

Defined results: null and empty texts have zero bytes and tokens; texts of any
length are counted whole; of equally ranked merges the first is done, as the library does;
repeated rows keep a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seqloom.llm.batches import map_columns, raw, texts

#: Splitting pattern of byte-level BPE pre-tokenisation.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens that are remembered, in number and in characters; a longer one than REMEMBERED never is.
CACHE, CACHE_CHARS, REMEMBERED = 1 << 18, 1 << 24, 1 << 8

#: Characters of a text whose pre-tokens are listed at once.
_LISTED = 1 << 18

_COUNTERS: dict[str, Counter] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands
    for itself, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Cache(dict):
    """Tokens of each pre-token: the proven whole tokens for good, others as they are merged."""

    def __init__(self, whole: list[str], merge):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merge, self.limit, self.chars = whole, merge, len(whole) + CACHE, 0

    def __missing__(self, piece: str) -> int:
        n = self.merge(piece)
        if len(piece) <= REMEMBERED:
            if len(self) >= self.limit or self.chars > CACHE_CHARS:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
                self.chars = 0
            self[piece] = n
            self.chars += len(piece)
        return n


class Counter:
    """Counts tokens by a tokenizer file of byte-level BPE."""

    def __init__(self, spec: dict):
        import tiktoken

        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError("not a plain byte-level BPE file")
        alphabet = byte_alphabet()
        specials = [t for t in spec["added_tokens"] if not t["normalized"]]
        names = {t["content"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in specials) or len(specials) != len(names):
            raise ValueError("added tokens with conditions")
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(names, key=len, reverse=True))) if names else None
        # Ranks: single bytes first, then in the order of the merges, which need not be that of the ids.
        ranks = {bytes([b]): i for i, b in enumerate(sorted(alphabet.values()))}
        self.pairs: dict[tuple[str, str], int] = {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((a, b), len(self.pairs))
            ranks.setdefault(bytes(alphabet[c] for c in a + b), len(ranks))
        self.encoding = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        #: Vocabulary strings that no merges lead to, which the library would still take for one token.
        self.unreached: dict[str, int] = {}
        self.sizes = Cache(self.proven(model["vocab"], alphabet), self.merged)

    def merged(self, piece: str) -> int:
        return self.unreached.get(piece) or len(self.encoding._encode_single_piece(piece.encode()))

    def plainly(self, name: str) -> int:
        """Tokens of a vocabulary string by the merge pairs alone, without a look at the table of whole tokens."""
        parts = list(name)
        while len(parts) > 1:
            rank, at = min((self.pairs.get(p, len(self.pairs)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.pairs):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts)

    def proven(self, vocab: dict[str, int], alphabet: dict[str, int]) -> list[str]:
        """Vocabulary strings that are UTF-8 texts and, merged alone, come out as one token."""
        out = []
        for name in vocab:
            if all(c in alphabet for c in name):
                try:
                    text = bytes(alphabet[c] for c in name).decode()
                except UnicodeDecodeError:
                    continue
                n = self.plainly(name)
                if n == 1:
                    out.append(text)
                else:
                    self.unreached[text] = n
        return out

    def split(self, text: str):
        """The pre-tokens; of a long text one after the other, so that they are never all there."""
        return self.pattern.findall(text) if len(text) <= _LISTED else (m.group() for m in self.pattern.finditer(text))

    def count(self, text: str) -> int:
        if self.special is None:
            return sum(map(self.sizes.__getitem__, self.split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.sizes.__getitem__, self.split(p))) for p in parts if p)

    @classmethod
    def of(cls, path: str) -> Counter:
        """The counter of a tokenizer file that this process can open."""
        with open(path, encoding="utf-8") as f:
            return cls.load(path, f.read())

    @classmethod
    def load(cls, name: str, content: str) -> Counter:
        """One counter for each file and process, from the file's content."""
        if name not in _COUNTERS:
            _COUNTERS[name] = cls(json.loads(content))
        return _COUNTERS[name]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; the driver reads the file and sends it along."""
    with open(path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> dict:
        count = Counter.load(path, content.value).count
        values = raw(batch["text"])
        n = [count(v.decode()) for v in values]
        return {"doc_id": batch["doc_id"], "n_bytes": [len(v) for v in values], "n_tokens": n, "over_limit": [x > limit for x in n]}

    rows = texts(docs, id_col, text_col)
    return map_columns(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
