"""Chat formatting by token-level assembly.

Role and text of a turn are encoded separately as ordinary text and spliced
between reserved ids that no text encodes to:

    BOS (TURN role TEXT text END)* EOS

Which tokens carry loss follows from prefix sums over the segment lengths: those
of the texts of the roles that are learned. Control strings inside contents are
escaped before encoding, by one more backslash after their first character, so
that the written form stays unambiguous; reading back removes one. Whatever
number of backslashes stands there already, this is undone exactly.

Rows are formatted where they lie and only then ordered within conversations;
nothing ever holds a whole conversation: its digests are fed turn by turn from a
sorted stream, so a conversation of any length takes constant memory. (The rows
of one conversation pass through one task in order, as its SHA-256 requires.)

Defined results: null texts and roles count as empty; turns of equal number are
ordered by role, then text, null turns first; repeated rows are repeated turns;
conversations without rows don't exist; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.llm.batches import map_columns, strings
from seqloom.llm.bpe_monoid import Codec, shared_codec

#: Written forms of the reserved tokens, in the order of their ids after the vocabulary.
RESERVED = ("<s>", "</s>", "<|turn|>", "<|text|>", "<|end|>")
BOS, EOS, TURN, TEXT, END = range(5)
#: Control strings of this template and of other common ones; all are escaped inside contents.
CONTROL = (*RESERVED, "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNED = ("assistant",)

_REST = "|".join(sorted({re.escape(c[1:]) for c in CONTROL if c[0] == "<"}, key=len, reverse=True))
_BRACKET = "|".join(sorted({re.escape(c[1:]) for c in CONTROL if c[0] == "["}, key=len, reverse=True))
_PLAIN = re.compile(rf"(?:(<)(?=\\*(?:{_REST}))|(\[)(?=\\*(?:{_BRACKET})))")
_ESCAPED = re.compile(rf"(?:(<)\\(?=\\*(?:{_REST}))|(\[)\\(?=\\*(?:{_BRACKET})))")


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or m[2], text)


class Assembler:
    """Splices encoded segments and reserved ids; reads them back."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.base = len(codec.pieces)

    def reserved(self, which: int) -> int:
        return self.base + which

    def turn(self, role: str, text: str, learned=LEARNED) -> tuple[list[int], list[bool]]:
        """Ids of a turn, and which of them carry loss."""
        r, t = self.codec.encode(escape(role)), self.codec.encode(escape(text))
        segments = [([self.reserved(TURN)], False), (r, False), ([self.reserved(TEXT)], False), (t, role in learned), ([self.reserved(END)], False)]
        ends = np.cumsum([len(s) for s, _ in segments])
        mask = np.zeros(int(ends[-1]) + 1, np.int64)
        for end, (s, on) in zip(ends.tolist(), segments, strict=True):
            if on:
                mask[end - len(s)] += 1
                mask[end] -= 1
        return [i for s, _ in segments for i in s], np.cumsum(mask)[:-1].astype(bool).tolist()

    def back(self, ids: list[int], mask: list[bool]) -> list[tuple[str, str, str, int]]:
        """(role, text, text under the mask, characters written) of each turn in ids; every segment is decoded once."""
        out, at, start = [], 0, 0
        role, size = "", 0
        for at, i in enumerate(ids):
            which = i - self.base
            if which < 0:
                continue
            size += len(RESERVED[which])
            if which == TURN:
                size = len(RESERVED[TURN])
            elif which in (TEXT, END):
                written = self.codec.decode(ids[start:at]).decode()
                size += len(written)
                if which == TEXT:
                    role = unescape(written)
                else:
                    text = unescape(written)
                    on = mask[start:at]
                    # A whole segment carries loss or none of it does; of a part only that part is read.
                    under = text if all(on) and on else self.learned_text(ids[start:at], on) if any(on) else ""
                    out.append((role, text, under, size))
            start = at + 1
        return out

    def written(self, ids: list[int]) -> str:
        """The formatted text of ids."""
        out, run = [], []
        for i in ids:
            if i < self.base:
                run.append(i)
            else:
                out += [self.codec.decode(run).decode(), RESERVED[i - self.base]]
                run = []
        return "".join([*out, self.codec.decode(run).decode()])

    def read(self, ids: list[int]) -> list[tuple[str, str]]:
        """(role, text) of each turn in ids."""
        return [(r, t) for r, t, _, _ in self.back(ids, [False] * len(ids))]

    def learned_text(self, ids: list[int], mask: list[bool]) -> str:
        """All text under the loss mask, unescaped segment by segment."""
        out, run = [], []
        for i, on in zip([*ids, self.base], [*mask, False], strict=True):
            if on:
                run.append(i)
            elif run:
                out.append(unescape(self.codec.decode(run).decode()))
                run = []
        return "".join(out)


_ASSEMBLERS: dict[int, Assembler] = {}


def assembler(codec: Codec) -> Assembler:
    """One for each codec and process."""
    if id(codec) not in _ASSEMBLERS:
        _ASSEMBLERS[id(codec)] = Assembler(codec)
    return _ASSEMBLERS[id(codec)]


def format_turns(turns: DataFrame, path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conv_id, turn, role, text, ids, loss_mask) for each row; a conversation is BOS, its rows' ids by turn, EOS."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    kinds = dict(rows.dtypes)

    codec_of = shared_codec(turns.sparkSession, path, pattern)

    def run(batch: pa.RecordBatch) -> dict:
        a = assembler(codec_of())
        out = [a.turn(r, t, learned) for r, t in zip(strings(batch["role"]), strings(batch["text"]), strict=True)]
        return {"conv_id": batch["conv_id"], "turn": batch["turn"], "role": batch["role"], "text": batch["text"], "ids": [x[0] for x in out], "loss_mask": [x[1] for x in out]}

    return map_columns(rows, run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, ids array<int>, loss_mask array<boolean>")


_DIGESTS = "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(turns: DataFrame, path: str, pattern: str, learned: tuple[str, ...] = LEARNED, formatted: bool = False) -> DataFrame:
    """One row for each conversation, read back from ids and loss masks alone.

    turns: rows (conv_id, turn, role, text), which are formatted and read back in one pass, so
    that ids never leave the worker, or, if formatted, rows of format_turns(). Only what the
    digests need is shuffled."""
    kinds = dict(turns.dtypes)
    codec_of = shared_codec(turns.sparkSession, path, pattern)

    # What a turn reads back as, computed where the row lies, before anything is ordered.
    def back(batch: pa.RecordBatch) -> dict:
        a = assembler(codec_of())
        if formatted:
            made = zip(batch["ids"].to_pylist(), batch["loss_mask"].to_pylist(), strict=True)
        else:
            made = (a.turn(r, t, learned) for r, t in zip(strings(batch["role"]), strings(batch["text"]), strict=True))
        (role, text, loss, chars) = zip(*(x for ids, mask in made for x in a.back(ids, mask)), strict=True)
        same = [x == y for x, y in zip(text, loss, strict=True)]
        return {"conv_id": batch["conv_id"], "turn": batch["turn"], "role": role, "text": text, "all": same, "loss": ["" if s else x for s, x in zip(same, loss, strict=True)], "chars": chars}

    columns = ["conv_id", "turn", *(["ids", "loss_mask"] if formatted else ["role", "text"])]
    rows = turns.select(*[F.col(c).cast("string").alias(c) if c in ("role", "text") else F.col(c) for c in columns])
    rows = map_columns(rows, back, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, all boolean, loss string, chars long")
    schema = T.StructType.fromDDL(_DIGESTS.format(kind=kinds["conv_id"]))
    arrow = to_arrow_schema(schema)
    frame = len(RESERVED[BOS]) + len(RESERVED[EOS])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def close() -> None:
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [[]] * len(arrow)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            done.clear()
            return out

        for batch in it:
            for conv, role, text, same, part, chars in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text", "all", "loss", "chars")), strict=True):
                loss = text if same else part
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), frame]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += chars
            yield flush()
        close()
        yield flush()

    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, schema)
