"""Row-local preparation of a text stream.

Only row-local operators apply to an unbounded input: there is no global order to
pack or score by.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import basic_tokens
from tagloom.operators.lookup import TASK_ROWS, lookup_ids
from tagloom.workspace import BROADCAST_ROWS


def stream_tokens(lines: DataFrame, text: str = "value", lower: bool = True) -> DataFrame:
    """Basic tokens of every incoming line, as ``(…, token_pos, token)`` rows."""
    kept = [c for c in lines.columns if c != text]
    return lines.select(*kept, F.posexplode(basic_tokens(F.col(text), lower)).alias("token_pos", "token"))


def stream_ids(
    items: DataFrame,
    vocab: DataFrame,
    weight: str,
    strict: bool = False,
    batch_rows: int = 100_000_000,
    small: int = BROADCAST_ROWS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Id of every incoming ``piece``, null (``strict``: an error) for an unknown one.

    A stream cannot be counted, so the share of a piece comes from ``weight``, a column of
    the written ``vocab(piece, id, weight)`` with how often the piece occurred before: a
    piece that should fill more than ``task_rows`` rows of a micro-batch of
    ``batch_rows`` is spread over several tasks. A wrong weight costs balance, never rows.
    A vocabulary of up to ``small`` rows is broadcast and its weights are not read.
    """
    total = vocab.agg(F.sum(weight)).first()[0] or 0
    heavy = max(1, ceil(total * task_rows / batch_rows))
    return lookup_ids(items, vocab, strict, weight=weight, small=small, task_rows=heavy)
