"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered as one string, encoded once with offsets, and the sorted
spans of its turns are found among the sorted spans of the tokens by binary search.
Marks are tokens of their own, so no token lies across the end of a turn's text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
BEGIN, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"
#: Characters rendered and encoded at once; a longer conversation is cut between turns.
PART = 1 << 20

_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)


def escape(text: str) -> str:
    """Put a backslash into every ``<|`` (and one more into every ``<\\|``, and so on)."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string of (role, text) turns and the spans of the texts that are learned."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{BEGIN}{escape(role)}{MIDDLE}", escape(text)
        if role == LEARNED and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens inside the spans; tokens and spans are sorted. An empty token is in none."""
    mask = np.zeros(len(starts) + 1, np.int64)
    if spans:
        low, high = np.array(spans).T
        np.add.at(mask, np.searchsorted(starts, low, "left"), 1)
        np.add.at(mask, np.searchsorted(ends, high, "right"), -1)
    return np.cumsum(mask[:-1]) > 0


def tokenizer(text: str):
    """A tokenizer whose marks are tokens, with offsets that keep leading spaces."""
    from tokenizers import AddedToken, Tokenizer, processors

    made = Tokenizer.from_str(text)
    made.post_processor = processors.ByteLevel(trim_offsets=False)
    made.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (BEGIN, MIDDLE, END)])
    return made


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    for batch in batches:
        ids, roles, texts = (batch.column(n) for n in range(3))
        for n in range(batch.num_rows):
            yield ids[n].as_py(), roles[n].as_py() or "", texts[n].as_py() or ""


def _parts(turns: Iterator[tuple[int | None, str, str]]) -> Iterator[tuple[int | None, int, list[tuple[str, str]]]]:
    """(conversation, part, turns): one part each, but for very long conversations."""
    for conv, own in groupby(turns, key=lambda x: x[0]):
        part, held, size = 0, [], 0
        for _, role, text in own:
            if held and size + len(text) > PART:
                yield conv, part, held
                part, held, size = part + 1, [], 0
            held.append((role, text))
            size += len(text)
        yield conv, part, held


def _format(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    encoder = tokenizer(text)
    names = ("conv_id", "part", "formatted", "ids", "starts", "ends", "loss")
    whole = pa.list_(pa.int32())
    kinds = (pa.int64(), pa.int32(), pa.string(), whole, whole, whole, pa.list_(pa.bool_()))
    rows, size = [], 0
    for conv, part, turns in _parts(_turns(batches)):
        formatted, spans = render(turns)
        encoded = encoder.encode(formatted, add_special_tokens=False)
        starts, ends = np.array(encoded.offsets, np.int32).reshape(-1, 2).T
        rows.append((conv, part, formatted, encoded.ids, starts, ends, token_mask(starts, ends, spans)))
        size += len(formatted)
        if size > PART:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
            rows, size = [], 0
    if rows:
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def format_chat(turns: DataFrame, tokenizer_json: str) -> DataFrame:
    """Rows (conv_id, part, formatted, ids, starts, ends, loss) of turns (conv_id, turn, role, text).

    ``starts`` and ``ends`` are the tokens' places in ``formatted``, in code points;
    ``loss`` marks the tokens of assistants' texts. Turns stand in the order of
    ``turn``, equal or null ones by role and text. Null role and text count as empty;
    rows with a null conv_id are one conversation. A conversation of more than 2**20
    characters comes in several parts, cut between turns; parts are neighbours and in
    order. Further columns do not matter; an empty table gives no rows.
    """
    held = turns.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
        F.col("turn").alias("turn"),
    )
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(
            lambda it: _format(it, held.value),
            "conv_id long, part int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>",
        )
    )


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """What the mask covers, one string for each run of tokens, as it was before formatting."""
    edge = np.diff(np.concatenate([[0], loss.astype(np.int8), [0]]))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            columns = [batch.column(n) for n in ("conv_id", "formatted", "starts", "ends", "loss")]
            for n in range(batch.num_rows):
                conv, formatted, *spans = (c[n] for c in columns)
                yield conv.as_py(), formatted.as_py(), *(s.values.to_numpy(zero_copy_only=False) for s in spans)

    out = []
    for conv, parts in groupby(rows(), key=lambda x: x[0]):
        turns_sha, loss_sha, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for _, formatted, starts, ends, loss in parts:
            for role, text in parse(formatted):
                turns_sha.update(f"{role}\n{text}\n".encode())
                n_turns += 1
            for text in masked_texts(formatted, starts, ends, loss):
                loss_sha.update(text.encode())
                loss_chars += len(text)
            chars += len(formatted)
        out.append((conv, n_turns, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    if out:
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and learned texts, read from what ``format_chat`` gives."""
    return formatted.mapInArrow(
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
