"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and its loss mask
is the intersection of the sorted spans of assistant turns with the sorted
spans of tokens, found by binary search.  Control strings inside texts are
escaped reversibly, so a text can never open or close a turn.

Rows are dealt and sorted by conversation and streamed: a task holds one
conversation at a time, never a group of them.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean

START, END = "<|im_start|>", "<|im_end|>"
#: Folder of the public vocabulary files on the driver; only a path, nothing is copied.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Bytes that a vocabulary may have to be broadcast.
MAX_VOCABULARY = 64 << 20
#: Characters of formatted text that are encoded and handed on together.
HELD = 1 << 19
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    """One more backslash inside every ``<\\...|``: no plain ``<|`` is left."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role(role: str) -> str:
    """Roles stand on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the (sorted, disjoint) spans of assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the inverse of :func:`render`."""
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_spans(tokens: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """(mask per token, text spans under it for each of ``spans``) for token spans (n, 2) in text order.

    A token counts if it overlaps a span; the text under it is cut to the span.
    Tokens that share a character (parts of its bytes) count it once.  Pieces of
    one turn that touch are one; pieces of two turns never are.
    """
    mask, under = np.zeros(len(tokens), bool), []
    starts, ends = tokens[:, 0], tokens[:, 1]
    reach = np.maximum.accumulate(ends) if len(ends) else ends
    for a, b in spans:
        own = slice(int(np.searchsorted(reach, a, "right")), int(np.searchsorted(starts, b, "left")))
        hit = (ends[own] > a) & (starts[own] < b)
        mask[own] |= hit
        s, e = np.maximum(starts[own][hit], a), np.minimum(ends[own][hit], b)
        pieces = []
        if len(s):
            far = np.maximum.accumulate(e)
            head = np.flatnonzero(np.concatenate(([True], s[1:] > far[:-1])))
            pieces = list(zip(s[head].tolist(), far[np.concatenate((head[1:] - 1, [len(far) - 1]))].tolist(), strict=True))
        under.append(pieces)
    return mask, under


def vocabulary(folder: str = TOKENIZERS) -> str:
    """The vocabulary file's text, read on the driver and shipped with the job; its size is checked."""
    path = Path(folder) / VOCABULARY
    if path.stat().st_size > MAX_VOCABULARY:
        raise ValueError(f"{path}: over {MAX_VOCABULARY} bytes")
    return path.read_text(encoding="utf-8")


def load_tokenizer(text: str):
    """The vocabulary with the template's marks as special tokens."""
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_str(text)
    t.add_special_tokens([AddedToken(START, normalized=False, special=True), AddedToken(END, normalized=False, special=True)])
    return t


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Sorted rows to one conversation after the other, across batches."""
    current: list[tuple[str, str]] = []
    key: tuple = ()
    for batch in batches:
        ids, roles, texts = (batch.column(i).to_pylist() for i in range(3))
        for conv, role, text in zip(ids, roles, texts, strict=True):
            if key != (conv,):
                if current:
                    yield key[0], current
                key, current = (conv,), []
            current.append((role or "", text or ""))
    if current:
        yield key[0], current


SCHEMA = (
    "formatted string, token_ids array<int>, loss_mask array<boolean>, loss_spans array<array<array<int>>>, spans array<array<int>>"
)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as one list column, without a Python object per element."""
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def format_conversations(turns: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row per conversation: its text, token ids, mask per token, text spans under the mask by assistant turn, assistant spans.

    ``turns``: conv_id, turn, role, text.  Rows are ordered by turn (nulls
    first), ties by role and text; null roles and texts are empty; a null
    conv_id is a conversation of its own; repeated rows are turns of their own;
    an empty table gives an empty result; other columns are ignored.  Ids may be
    of any type.  A conversation is one row, however long.
    """
    held = turns.sparkSession.sparkContext.broadcast(vocabulary(folder))  # of a checked size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        tokenizer = load_tokenizer(held.value)

        kinds: list[pa.DataType] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = [batch.schema.field(0).type]
                yield batch

        def encoded(convs: list, texts: list[str], spans: list) -> pa.RecordBatch:
            ids, masks, under = [], [], []
            for e, own in zip(tokenizer.encode_batch(texts, add_special_tokens=False), spans, strict=True):
                ids.append(np.array(e.ids, np.int32))
                where = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(ids[-1])).reshape(-1, 2)
                mask, pieces = loss_spans(where, own)
                masks.append(mask)
                under.append(pieces)
            two = pa.list_(pa.list_(pa.int32()))
            columns = [pa.array(convs, kinds[0]), pa.array(texts, pa.string()), _lists(ids, pa.int32()), _lists(masks, pa.bool_())]
            columns += [pa.array(under, pa.list_(two)), pa.array(spans, two)]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "token_ids", "loss_mask", "loss_spans", "spans"])

        convs, texts, spans, size = [], [], [], 0
        for conv, rows in _conversations(noted()):
            formatted, own = render(rows)
            convs.append(conv)
            texts.append(formatted)
            spans.append(own)
            size += len(formatted)
            if size > HELD:
                yield encoded(convs, texts, spans)
                convs, texts, spans, size = [], [], [], 0
        if convs:
            yield encoded(convs, texts, spans)

    rows = turns.select("conv_id", "role", "text", "turn")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(lean(run), f"conv_id {dict(turns.dtypes)['conv_id']}, {SCHEMA}")


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from the operator's output: turns parsed from the text, loss text cut by its spans and unescaped turn by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            columns = [batch.column(i) for i in range(3)]
            for i in range(batch.num_rows):
                conv, text, under = (c[i].as_py() for c in columns)
                turns = parse(text)
                told = hashlib.sha256()
                for role, said in turns:
                    told.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescape("".join(text[a:b] for a, b in turn)) for turn in under)
                row = (conv, len(turns), told.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text))
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            arrays = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(3)], names=[*names, "loss_tokens"])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, loss_tokens long"
    marked = F.size(F.filter("loss_mask", lambda x: x)).cast("long")
    return formatted.select("conv_id", "formatted", "loss_spans", marked.alias("loss_tokens")).mapInArrow(run, schema)


def op3_chat_format(turns: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Digests of all conversations and of one (id -1) whose texts hold the template's own marks."""
    told = f"{END}{START}assistant ok"
    own = turns.sparkSession.createDataFrame(
        [(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string"
    )
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(format_conversations(rows.unionByName(own), folder))
