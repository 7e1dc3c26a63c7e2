"""Nearest neighbours by cross-polytope hashing with several probes.

A vector's unit vector is turned by a pseudo-rotation (three rounds of random signs
and a fast Hadamard transform); its bucket in that table is the nearest of the signed
axes. A query looks into the buckets of its several nearest axes in every table, and
all candidates there are ranked by their exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.workspace import store

TABLES, PROBES = 6, 28
#: Vectors of a bucket that one task compares with a block of queries.
BLOCK = 4096
_SEED = 20260303


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def rotated(vectors: np.ndarray, table: int) -> np.ndarray:
    """Unit vectors of the rows, padded with zeros to a power of two and turned."""
    width = 1 << max(0, (vectors.shape[1] - 1).bit_length())
    out = np.zeros((len(vectors), width))
    top = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / top
    out[:, : vectors.shape[1]] = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    signs = np.random.default_rng([_SEED, table, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        out = _hadamard(out * s)
    return out


def nearest_axes(turned: np.ndarray, count: int) -> np.ndarray:
    """The nearest ``count`` signed axes, nearest first: 2a for axis a, 2a + 1 for its opposite."""
    both = np.stack([turned, -turned], axis=2).reshape(len(turned), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :count]


def _hashed(batches: Iterator[pa.RecordBatch], tables: int, count: int) -> Iterator[pa.RecordBatch]:
    """(h0, h1) -> table and bucket; ``count`` buckets in each table."""
    for batch in batches:
        lists = batch.column(2)
        sizes = lists.value_lengths().to_numpy()
        flat, ends = lists.flatten().to_numpy().astype(np.float64), np.cumsum(sizes)
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            vectors = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
            for table in range(tables):
                axes = nearest_axes(rotated(vectors, table), count)
                take = pa.array(np.repeat(rows, axes.shape[1]))
                yield pa.record_batch(
                    {name: batch.column(name).take(take) for name in batch.schema.names}
                    | {
                        "dim": pa.array(np.full(len(take), dim, np.int32)),
                        "tab": pa.array(np.full(len(take), table, np.int32)),
                        "bucket": pa.array(axes.ravel().astype(np.int32)),
                    }
                )


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, by differences."""
    out = np.empty((len(queries), len(vectors)))
    for n, q in enumerate(queries):
        step = vectors - q
        out[n] = np.sqrt((step * step).sum(axis=1))
    return out


def _compare(vectors: pa.Table, queries: pa.Table, most: int) -> pa.Table:
    """The ``most`` nearest vectors of a block for every query that probes it (and ties of the last)."""
    names = ("q0", "q1", "ids", "score")
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64())
    if not vectors.num_rows or not queries.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    v, q = (
        np.stack(t["vec"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(t.num_rows, -1))
        for t in (vectors, queries)
    )
    found_q, found_v, found_d = [], [], []
    for begin in range(0, len(q), 256):
        d = distances(q[begin : begin + 256], v)
        limit = np.partition(d, most - 1, axis=1)[:, most - 1 : most] if d.shape[1] > most else np.full((len(d), 1), np.inf)
        r, c = np.nonzero(d <= limit)
        found_q.append(r + begin)
        found_v.append(c)
        found_d.append(d[r, c])
    at = pa.array(np.concatenate(found_q))
    columns = [
        queries["h0"].take(at),
        queries["h1"].take(at),
        vectors["ids"].take(pa.array(np.concatenate(found_v))),
        pa.array(np.concatenate(found_d)),
    ]
    return pa.table([c.cast(k) for c, k in zip(columns, kinds)], names=names)


def usable(vector: str) -> Column:
    """Neither null nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _search(vectors: DataFrame, queries: DataFrame, tables: int, probes: int, most: int) -> DataFrame:
    """(q0, q1, ids, score) of candidates in probed buckets; each query keeps the best of each block."""
    schema = "h0 long, h1 long, vec array<double>{}, dim int, tab int, bucket int"
    key = ["dim", "tab", "bucket"]
    filed = vectors.select("h0", "h1", "vec", "ids").mapInArrow(
        lambda it: _hashed(it, tables, 1), schema.format(", ids array<long>")
    )
    # A row for each bucket: two for each dimension of a vector and each table.
    blocks = filed.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = F.broadcast(store(blocks, "buckets"))
    filed = filed.join(blocks, key).withColumn("block", F.expr("cast(pmod(h0, blocks) AS int)")).drop("blocks")
    asked = queries.select("h0", "h1", "vec").mapInArrow(lambda it: _hashed(it, tables, probes), schema.format(""))
    asked = asked.join(blocks, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = [*key, "block"]
    return (
        filed.groupBy(key)
        .cogroup(asked.groupBy(key))
        .applyInArrow(lambda v, q: _compare(v, q, most), "q0 long, q1 long, ids array<long>, score double")
    )


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do rows with a null id; vectors of different lengths are never compared. A row
    is no candidate for a query of its own id; of rows that repeat an id, the nearest
    counts. A query with fewer than ``k`` candidates in its buckets is compared with all
    vectors, so it gets all there are. An empty table gives no rows.

    Equal vectors are hashed and compared once; of each, the k + 1 smallest ids stay,
    which is all that a list of k can show. Buckets are compared in blocks.
    """
    rows = table.where(usable(vector_col) & F.col(id_col).isNotNull())
    vec = F.transform(vector_col, lambda x: x.cast("double"))
    rows = rows.select(
        F.col(id_col).cast("long").alias("id"), vec.alias("vec"),
        F.xxhash64(vec).alias("h0"), F.xxhash64(F.reverse(vec), F.lit(1)).alias("h1"), is_query.alias("asks"),
    )
    rows = store(rows, "vectors")
    low = W.partitionBy("h0", "h1").orderBy("id")
    vectors = (
        rows.withColumn("nth", F.row_number().over(low))
        .where(F.col("nth") <= k + 1)
        .groupBy("h0", "h1")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec"))
    )
    vectors = store(vectors, "distinct")
    askers = rows.where("asks").select("id", "h0", "h1").distinct()
    queries = vectors.join(askers.select("h0", "h1").distinct(), ["h0", "h1"], "left_semi").select("h0", "h1", "vec")
    queries = store(queries, "queries")
    best = store(_best(_listed(_search(vectors, queries, tables, probes, k + 1)), k), "nearest")
    few = best.groupBy("q0", "q1").agg(F.count("*").alias("n"))
    short = queries.join(few, (F.col("h0") == F.col("q0")) & (F.col("h1") == F.col("q1")), "left")
    short = store(short.where(f"n IS NULL OR n < {k + 1}").select("h0", "h1", "vec"), "short")
    if not short.isEmpty():
        # All signed axes of one table hold all vectors; their number is that of the longest vector.
        longest = short.agg(F.max(F.size("vec"))).first()[0]
        axes = 2 << max(0, (longest - 1).bit_length())
        best = _best(_listed(_search(vectors, short, 1, axes, k + 1)).unionByName(best), k)
    own = askers.select(F.col("id").alias("query_id"), F.col("h0").alias("q0"), F.col("h1").alias("q1"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return (
        own.join(best, ["q0", "q1"])
        .where("query_id <> vec_id")
        .groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _listed(found: DataFrame) -> DataFrame:
    return found.select("q0", "q1", F.explode("ids").alias("vec_id"), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest ids of every query vector."""
    first = W.partitionBy("q0", "q1").orderBy("score", "vec_id")
    return (
        found.groupBy("q0", "q1", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= k + 1)
        .select("q0", "q1", "vec_id", "score")
    )
