"""Assembling training input and choosing runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.operators.scan import BLOCK, rank_ids, row_index


def training_union(train: DataFrame, devel: DataFrame) -> DataFrame:
    """Training reads both splits; ``split`` stays visible."""
    return train.unionByName(devel)


def repeat_epochs(rows: DataFrame, epochs: int) -> DataFrame:
    """Every row once per epoch, without a join."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def shuffle_order(
    rows: DataFrame, keys: Sequence[str], seed: int, key: Column | None = None, rank: str | None = None
) -> DataFrame:
    """Full deterministic shuffle: rows sorted by a seeded hash of their key, or by ``key``.

    With ``rank`` the place of each row, from 0, is added under this name.
    """
    key = F.xxhash64(*keys, F.lit(seed)) if key is None else key
    if rank is None:
        return rows.orderBy(key, *keys)
    return rank_ids(rows.withColumn("_key", key), ["_key", *keys], rank).drop("_key")


def assign_batches(
    rows: DataFrame, keys: Sequence[str], size: int, within: Sequence[str] = (), drop_last: bool = True
) -> DataFrame:
    """Batch number in ``keys`` order, optionally without a short last batch."""
    within = list(within)
    placed = row_index(rows, keys, within).withColumn("batch", F.expr(f"idx div {size}"))
    # Whole batches are known from the number of rows alone.
    if not drop_last:
        return placed
    totals = rows.groupBy(*within).agg(F.count("*").alias("_all"))
    kept = F.col("batch") < F.expr(f"_all div {size}")
    if within:
        return placed.join(totals, within).where(kept).drop("_all")
    return placed.where(F.col("batch") < F.lit(totals.first()["_all"] // size))


def step_budget(counts: DataFrame, batch: int, epochs: int, mode: str = "combine") -> DataFrame:
    """Steps and save interval from a ``records`` count."""
    # Step caps and save intervals of the two packing modes.
    raw = F.expr(f"cast(records / {batch} * {epochs} as bigint)")
    steps = F.least(raw, F.lit(8000 if mode == "combine" else 30000)).alias("steps")
    s = F.col("steps")
    if mode == "combine":
        every = F.when(s >= 5000, 1000).when(s < 2000, 300).otherwise(500)
    else:
        every = F.when(s < 5000, 500).when(s <= 10000, 1000).otherwise(2000)
    return counts.select("records", steps).withColumn("save_steps", every)


def candidate_runs(runs: DataFrame, share: float = 0.2) -> DataFrame:
    """Runs past ``share`` of the step budget, in step order."""
    return runs.where(F.col("step") > share * F.col("max_steps")).orderBy("step")


def last_run(runs: DataFrame) -> DataFrame:
    """Only the latest run."""
    best = F.max_by(F.struct(*runs.columns), F.col("step"))
    return runs.agg(best.alias("r")).select("r.*")


def context_features(
    rows: DataFrame,
    value: Column,
    widths: Sequence[int],
    seq: Sequence[str],
    pos: str,
    block: int = BLOCK,
) -> DataFrame:
    """For each odd or even width, the values around a position ("same" padding).

    Width ``k`` sees ``(k - 1) // 2`` positions before and ``k // 2`` after; positions
    outside the sequence count as 0. Adds one array ``ctx_k`` per width. Positions are
    dense; a sequence is cut into blocks, and rows near a cut are copied to the
    neighbouring block, so a sequence of any length spreads over many tasks.
    """
    lo = max((k - 1) // 2 for k in widths)
    hi = max(k // 2 for k in widths)
    home = F.expr(f"`{pos}` div {block}")
    wanted_from, wanted_to = F.expr(f"greatest(0, `{pos}` - {hi}) div {block}"), F.expr(f"(`{pos}` + {lo}) div {block}")
    copies = rows.withColumn("_v", value).withColumn("_blk", F.explode(F.sequence(wanted_from, wanted_to)))
    order = W.partitionBy(*seq, "_blk").orderBy(pos)
    zero = F.lit(0).cast(copies.schema["_v"].dataType)
    near = {}
    for d in range(-lo, hi + 1):
        shifted = F.lead("_v", d) if d >= 0 else F.lag("_v", -d)
        near[d] = F.coalesce(shifted.over(order), zero)
    copies = copies.withColumns({f"_near_{d + lo}": c for d, c in near.items()}).where(F.col("_blk") == home)
    picked = {
        f"ctx_{k}": F.array(*[F.col(f"_near_{d + lo}") for d in range(-((k - 1) // 2), k // 2 + 1)])
        for k in widths
    }
    return copies.withColumns(picked).drop("_v", "_blk", *[f"_near_{d + lo}" for d in near])
