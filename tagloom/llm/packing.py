"""Packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm.configurations import configurations
from tagloom.llm.tokens import Encoder
from tagloom.workspace import store

CAPACITY = 2048
END = 0  # id after every document
#: Rows ranked in one window.
RANKED = 100_000


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(tokenizer, added=True)
    end = END.to_bytes(4, "little")
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            rows, nth, starts, lengths, crcs, kept = [], [], [], [], [], []
            for n, text in enumerate(part.column(1)):
                ids = encoder.encode(text.as_py()) + end
                total = len(ids) // 4
                at, piece = 0, 0
                while at < total:
                    size = total % capacity or capacity if not at else capacity
                    cut = ids[4 * at : 4 * (at + size)]
                    rows.append(n)
                    nth.append(piece)
                    starts.append(at)
                    lengths.append(size)
                    crcs.append(zlib.crc32(cut))
                    if keep_ids:
                        kept.append(cut)
                    at, piece = at + size, piece + 1
            columns = {
                "id": part.column(0).take(pa.array(rows, pa.int64())),
                "piece": pa.array(nth, pa.int32()),
                "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(crcs, pa.int64()),
            }
            yield pa.record_batch(columns | ({"ids": pa.array(kept, pa.binary())} if keep_ids else {}))


def token_pieces(
    docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): every document's ids and a final 0, cut from the end.

    Only documents of more than ``capacity`` ids are cut; all their pieces are full
    but the first. A null text counts as empty and gives one piece of one id. Rows with
    null or repeated ids are documents like any other; an empty table gives no rows.
    ``ids`` holds little-endian unsigned 32-bit numbers.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())  # one vocabulary
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lambda it: _pieces(it, tokenizer.value, capacity, keep_ids), schema
    )


def _slots(histogram: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: the ``start``-th one and those after it go to the place
    ``offset`` of the sequences from ``sequence`` on. Sorted by length and start."""
    rows: list[tuple[int, int, int, int]] = []
    given = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for lengths, times in configurations(histogram, capacity):
        offset = 0
        for n in lengths:
            rows.append((n, int(given[n]), sequence, offset))
            given[n] += times
            offset += n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "start": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _place(batches: Iterator[pa.RecordBatch], slots: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nth = batch.column("nth").to_numpy()
        at = np.searchsorted(slots["key"], (batch.column("length").to_numpy() << 44) + nth, "right") - 1
        yield pa.record_batch(
            {name: batch.column(name) for name in batch.schema.names if name != "nth"}
            | {
                "sequence_id": pa.array(slots["sequence"][at] + nth - slots["start"][at]),
                "offset": pa.array(slots["offset"][at]),
            }
        )


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces with a ``length`` of 1 to ``capacity``.

    Pieces of one length are interchangeable, so a piece needs only its number among
    those of its length; it is counted in buckets, so that a length that a third of
    all pieces share is not ranked in one task. Sequences are gapless from 0.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    for n, count in counts.items():
        histogram[n] = count
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(histogram, capacity))
    buckets = max(1, -(-int(histogram.max(initial=0)) // RANKED))
    order = ["id", "piece", "ids_crc32"]
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("length", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy(*order))
    rows = rows.withColumn("nth", rank).join(sizes, ["length", "bucket"])
    rows = rows.select(*pieces.columns, (F.col("nth") - 1 + F.col("ahead")).cast("long").alias("nth"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return rows.mapInArrow(lambda it: _place(it, slots.value), f"{fields}, sequence_id long, offset long")


def pack(
    docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Pieces of all documents (see ``token_pieces``) with their places in sequences."""
    return place(store(token_pieces(docs, id_col, text_col, tokenizer_path, capacity, keep_ids), "pieces"), capacity)
