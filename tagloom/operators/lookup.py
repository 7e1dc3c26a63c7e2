"""Equality lookups that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.workspace import BROADCAST_ROWS, is_small, store

# Rows of one key that a task may get; a key with more is spread over several tasks.
TASK_ROWS = 1_000_000
# Bytes of the largest table of vectors that executors hold whole.
VECTOR_BYTES = 192 << 20


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    weight: str | None = None,
    small: int = BROADCAST_ROWS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Join ``rows`` to a written ``table`` holding each ``key`` once.

    A table that is small in rows and bytes goes to every executor and nothing is
    shuffled. With a larger one, a key that more than ``task_rows`` rows carry is
    spread: its entry is repeated once for every ``task_rows`` of them, and its rows
    choose one of the copies by a hash of all their columns. The number of rows of a
    key is ``weight`` where the table has such a column; else it is counted, which
    moves one row for each key and task. No more than one key in ``task_rows`` rows can
    be so heavy, so the list of such keys is broadcast if it is small itself.
    """
    value_columns = [c for c in table.columns if c not in (key, weight)]
    values = table.select(key, *value_columns)
    if is_small(table, small):
        return rows.join(F.broadcast(values), key, how)
    uses = (
        rows.groupBy(key).agg(F.count("*").alias("_uses"))
        if weight is None
        else table.select(key, F.col(weight).alias("_uses"))
    )
    heavy = store(
        uses.where(f"_uses > {task_rows} AND `{key}` IS NOT NULL").select(
            key, F.ceil(F.col("_uses") / task_rows).cast("int").alias("_copies")
        ),
        "heavy",
    )
    if heavy.isEmpty():
        return rows.join(values, key, how)
    heavy = F.broadcast(heavy) if is_small(heavy, small) else heavy
    one = F.coalesce("_copies", F.lit(1))
    copies = values.join(heavy, key, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), one - 1)))
    mark = F.pmod(F.xxhash64(*rows.columns), one).cast("int")  # the same when a task is run again
    spread = rows.join(heavy, key, "left").withColumn("_copy", mark).drop("_copies")
    return spread.join(copies.drop("_copies"), [key, "_copy"], how).drop("_copy")


def lookup_ids(
    items: DataFrame, vocab: DataFrame, strict: bool = False, weight: str | None = None, **limits: int
) -> DataFrame:
    """Piece to id; in strict mode a piece missing from the vocabulary is an error.

    ``weight`` and ``limits`` are those of :func:`lookup`.
    """
    table = vocab.select("piece", "id", *([weight] if weight else []))
    return _checked(lookup(items, table, "piece", weight=weight, **limits), "id", "piece", strict)


def lookup_pieces(items: DataFrame, vocab: DataFrame, strict: bool = False) -> DataFrame:
    """Id to piece through the inverse dictionary."""
    return _checked(lookup(items, vocab.select("id", "piece"), "id"), "piece", "id", strict)


def _checked(joined: DataFrame, found: str, key: str, strict: bool) -> DataFrame:
    if not strict:
        return joined
    named = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    missing = F.raise_error(F.concat(F.lit(f"unknown {key}: "), named))
    kind = joined.schema[found].dataType
    return joined.withColumn(found, F.coalesce(found, missing.cast(kind)))


def gather_vectors(items: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Attach to every item the vector with its id; an id without one is an error.

    A table of up to ``VECTOR_BYTES`` goes to every executor, and items stay where they are.
    """
    if _held(vectors, vector):
        values = vectors.select(key, *[c for c in vectors.columns if c != key])
        return _checked(items.join(F.broadcast(values), key, "left"), vector, key, strict=True)
    return _checked(lookup(items, vectors, key), vector, key, strict=True)


def _held(vectors: DataFrame, vector: str) -> bool:
    """True when a table of numeric vectors takes at most ``VECTOR_BYTES``, its key included."""
    size = 4 if vectors.schema[vector].dataType.elementType == T.FloatType() else 8
    sums = vectors.agg(F.count("*").alias("rows"), F.sum(F.size(vector)).alias("cells")).first()
    return sums["rows"] * 8 + (sums["cells"] or 0) * size <= VECTOR_BYTES


def add_vectors(items: DataFrame, others: Sequence[tuple[DataFrame, str]], vector: str = "embedding") -> DataFrame:
    """Add further vectors, each found by its own key column, to ``vector``.

    ``others`` are ``(table(key, vec), key)`` pairs, e.g. token-type and position
    vectors; their size is fixed by the number of types and the longest sequence. A
    key without a vector is an error.
    """
    for n, (table, key) in enumerate(others):
        extra = f"_vec{n}"
        joined = _checked(lookup(items, table.withColumnRenamed("vec", extra), key), extra, key, strict=True)
        items = joined.withColumn(vector, F.zip_with(vector, extra, lambda a, b: a + b)).drop(extra)
    return items


def sum_vectors(items: DataFrame, tables: Sequence[tuple[DataFrame, str, str]], vector: str = "embedding") -> DataFrame:
    """Items with ``vector``, the sum of one vector from each ``(table, key, column)``.

    Tables of up to ``VECTOR_BYTES`` become a matrix that every executor holds; rows then
    stay where they are and all sums are made in one Arrow pass. A larger table is looked
    up first. A key that is null, or without a vector, is an error; the sum is of doubles.
    """
    held, joined = [], []
    spark = items.sparkSession
    for n, (table, key, column) in enumerate(tables):
        table = table.select(key, F.col(column).alias(f"_vec{n}"))
        if table.schema[f"_vec{n}"].dataType.elementType != T.FloatType():
            table = table.withColumn(f"_vec{n}", F.col(f"_vec{n}").cast("array<double>"))
        if _held(table, f"_vec{n}"):
            held.append((key, _matrix(table.where(f"_vec{n} IS NOT NULL").toArrow())))
        else:
            items = _checked(lookup(items, table, key), f"_vec{n}", key, strict=True)
            joined.append(f"_vec{n}")
    shared = spark.sparkContext.broadcast(held)
    kept = [c for c in items.columns if c not in (*joined, vector)]
    fields = [items.schema[c] for c in kept] + [T.StructField(vector, T.ArrayType(T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [rows[_places(ids, batch.column(key), key)] for key, (ids, rows) in shared.value]
            parts += [_rows(batch.column(c)) for c in joined]
            total = parts[0].astype(np.float64)
            for part in parts[1:]:
                total = total + part
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * total.shape[1]
            sums = pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], sums], [*kept, vector])

    return items.mapInArrow(run, T.StructType(fields))


def _rows(lists: pa.Array) -> np.ndarray:
    """A list column of one width as a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their vectors in the same order."""
    ids = table.column(0).to_numpy()
    order = np.argsort(ids)
    return ids[order], _rows(table.column(1).combine_chunks())[order]


def _places(ids: np.ndarray, keys: pa.Array, name: str) -> np.ndarray:
    if keys.null_count:
        raise ValueError(f"unknown {name}: null")
    wanted = keys.to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(ids, wanted), max(len(ids) - 1, 0))
    wrong = np.flatnonzero(ids[at] != wanted) if len(ids) else np.arange(len(wanted))
    if len(wrong):
        raise ValueError(f"unknown {name}: {wanted[wrong[0]]}")
    return at
