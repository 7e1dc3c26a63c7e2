"""Shards by fixed virtual slots and a versioned map from slots to shards.

A record's slot is a hash of its key and never changes. Which shard holds a slot is
written in a map; rebalancing and growing edit few entries of it and write the
result as a new version, so that only the records of moved slots move.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.workspace import store

SLOTS = 4096
#: Rows numbered in one window.
NUMBERED = 100_000


def slot_of(keys: Sequence[str], slots: int = SLOTS) -> Column:
    """Slot of a record: 0 to ``slots`` - 1. Null keys hash like any other value."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame, slot: str, size: str, slots: int = SLOTS) -> np.ndarray:
    """Total size of every slot: one number a slot, however large the table is."""
    out = np.zeros(slots, np.int64)
    for r in rows.groupBy(slot).agg(F.sum(size).alias("n")).collect():
        out[r[0]] = r[1] or 0
    return out


def first_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """Slots dealt to shards in turn."""
    return np.arange(slots) % shards


def rebalance(held: np.ndarray, sizes: np.ndarray, shards: int, moves: int = 100_000) -> np.ndarray:
    """Edit a map until no move of a slot, nor exchange of two, brings two shards closer.

    Always between the fullest shard and another one, beginning with the emptiest.
    ``shards`` may be larger than before: the new shards take slots only. Equal
    sizes are told apart by slot number, so the result is the same every time.
    """
    owner = held.copy()
    loads = np.bincount(owner, sizes, shards).astype(np.int64)
    for _ in range(moves):
        top = int(loads.argmax())
        mine = np.flatnonzero((owner == top) & (sizes > 0))
        for low in np.argsort(loads, kind="stable"):
            gap = int(loads[top] - loads[low])
            if low == top or gap <= 1:
                continue
            best, out, back = 0, -1, -1
            wide = sizes[mine]
            fit = np.minimum(wide, gap - wide)  # what a move takes off the gap, halved
            if len(fit) and fit.max() > best:
                k = int(fit.argmax())
                best, out = int(fit[k]), int(mine[k])
            theirs = np.flatnonzero((owner == low) & (sizes > 0))
            if len(theirs) and len(mine):
                theirs = theirs[np.argsort(sizes[theirs], kind="stable")]
                at = np.clip(np.searchsorted(sizes[theirs], wide - gap // 2), 0, len(theirs) - 1)
                for place in (at, np.maximum(at - 1, 0)):
                    step = wide - sizes[theirs[place]]
                    fit = np.minimum(step, gap - step)
                    if fit.max() > best:
                        k = int(fit.argmax())
                        best, out, back = int(fit[k]), int(mine[k]), int(theirs[place[k]])
            if out >= 0:
                break
        else:
            return owner
        owner[out] = low
        loads[top] -= sizes[out]
        loads[low] += sizes[out]
        if back >= 0:
            owner[back] = top
            loads[low] -= sizes[back]
            loads[top] += sizes[back]
    return owner


def grow(held: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """Edit a map for one more shard: it takes slots from the fullest shards, nothing else moves."""
    owner = held.copy()
    loads = np.bincount(owner, sizes, shards + 1).astype(np.float64)
    share = loads.sum() / (shards + 1)
    for slot in np.argsort(-sizes, kind="stable"):
        if loads[shards] + sizes[slot] <= share and loads[owner[slot]] - sizes[slot] >= share - sizes[slot]:
            if loads[owner[slot]] > share and sizes[slot]:
                loads[owner[slot]] -= sizes[slot]
                loads[shards] += sizes[slot]
                owner[slot] = shards
    return owner


def write_map(spark: SparkSession, path: str, version: int, owner: np.ndarray) -> None:
    """Write a version of the map; a version that exists is never changed (it raises)."""
    rows = [(slot, int(shard)) for slot, shard in enumerate(owner)]
    frame = spark.createDataFrame(rows, "slot int, shard int").coalesce(1)
    frame.write.mode("error").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(slot, shard) of one version."""
    return spark.read.schema("slot int, shard int").parquet(f"{path}/version={version}")


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Slots that two versions put into different shards: (slot, from_shard, to_shard)."""
    was = before.select("slot", F.col("shard").alias("from_shard"))
    return was.join(after.select("slot", F.col("shard").alias("to_shard")), "slot").where("from_shard <> to_shard")


def place(rows: DataFrame, slot: str, owner: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``shard`` and ``position``, gapless from 0 in every shard, to a written table of rows.

    Rows of a shard stand by slot, and in a slot by ``order``. They are numbered in
    each slot apart, and a slot of very many rows in buckets, so no shard meets in
    one task. ``owner`` has one row a slot, which bounds what is broadcast.
    """
    counts = rows.groupBy(slot).agg(F.count("*").alias("n"))
    counts = counts.withColumn("buckets", F.ceil(F.col("n") / NUMBERED).cast("int"))
    held = F.broadcast(owner.join(counts.withColumnRenamed(slot, "slot"), "slot"))
    tagged = (
        rows.withColumn("_row", F.monotonically_increasing_id())
        .join(held.select(F.col("slot").alias(slot), "shard", "buckets"), slot)
        .withColumn("_bucket", F.expr("cast(_row div 8192 % buckets AS int)"))
    )
    tagged = store(tagged, "tagged")
    sizes = tagged.groupBy("shard", slot, "_bucket").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(W.partitionBy("shard").orderBy(slot, "_bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(slot, "_bucket", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    nth = F.row_number().over(W.partitionBy(slot, "_bucket").orderBy(*order, "_row"))
    return (
        tagged.withColumn("_nth", nth)
        .join(sizes, [slot, "_bucket"])
        .select(*rows.columns, "shard", (F.col("_ahead") + F.col("_nth") - 1).alias("position"))
    )
