"""Running values over a globally ordered table without a one-task window.

A window ordered over a whole table (or over one very large group) runs in one
task. Here rows are cut into blocks by integer division of their order keys; each
block is scanned on its own, and the block totals are scanned the same way one
level up, so only a short list of totals ever meets in one place. Keys with wide gaps
make many nearly empty blocks; then the totals get dense numbers by a range sort
and go through the same steps under these.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.workspace import broadcast_if_small, store

BLOCK = 1 << 16
# Totals that one window may hold.
TOP = 1 << 18


def prior_values(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, tuple[str, Column]],
    within: Sequence[str] = (),
    block: int = BLOCK,
    top: int = TOP,
) -> DataFrame:
    """Add, for every row, a value over all rows strictly before it.

    ``keys`` are non-negative integer columns giving the order (first key most
    significant) inside each ``within`` group; together they identify a row. They may
    have gaps of any width.
    ``values`` maps a new column to ``("sum", expr)`` (running total, 0 at the
    start) or ``("last", expr)`` (latest non-null value, null at the start).
    """
    keys, within = list(keys), list(within)
    kinds = {name: kind for name, (kind, _) in values.items()}
    table = df.select("*", *[expr.alias(f"_v_{n}") for n, (_, expr) in values.items()])
    order = [keys[-1]]
    levels = []
    for depth in range(len(keys), 0, -1):
        cut = f"_cut{depth}"
        table = table.withColumn(cut, F.expr(f"`{keys[depth - 1]}` div {block}"))
        group = within + keys[: depth - 1] + [cut]
        levels.append((table, group, order))
        table = _totals(table, group, order, kinds)
        if not levels[1:]:
            table = store(table, "totals")
        order = [keys[depth - 2], cut] if depth > 1 else [cut]
    sizes = table.groupBy(*within).agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= top:
        levels.append((table, within, order))
        carried = None
    else:
        ranked = rank_ids(table, [*within, *order], "_rank")
        cuts = {c: f"_of{c}" for c in ranked.columns if c.startswith("_cut")}
        ranked = ranked.withColumnsRenamed({f"_v_{n}": f"_total_{n}" for n in kinds} | cuts)
        again = {n: (kind, F.col(f"_total_{n}")) for n, kind in kinds.items()}
        carried = prior_values(ranked, ["_rank"], again, within, block, top).drop("_rank")
        carried = carried.withColumnsRenamed({new: old for old, new in cuts.items()})
    for table, group, order in reversed(levels):
        before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        table = table.withColumns(
            {
                n: F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0))
                if kind == "sum"
                else F.last(f"_v_{n}", ignorenulls=True).over(before)
                for n, kind in kinds.items()
            }
        )
        if carried is not None:
            start = carried.select(*group, *[F.col(n).alias(f"_c_{n}") for n in kinds])
            table = table.join(start, group, "left").withColumns(
                {
                    n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
                    if kind == "sum"
                    else F.coalesce(F.col(n), F.col(f"_c_{n}"))
                    for n, kind in kinds.items()
                }
            )
        carried = table
    return carried.select(*df.columns, *kinds)


def _totals(table, group, order, kinds):
    rank = F.struct(*[F.col(c) for c in order])
    aggs = []
    for n, kind in kinds.items():
        held = F.col(f"_v_{n}")
        total = F.sum(held) if kind == "sum" else F.max_by(held, F.when(held.isNotNull(), rank))
        aggs.append(total.alias(f"_v_{n}"))
    return table.groupBy(*group).agg(*aggs)


def row_index(
    df: DataFrame, keys: Sequence[str], within: Sequence[str] = (), name: str = "idx"
) -> DataFrame:
    """Dense 0-based index in ``keys`` order inside each ``within`` group."""
    return prior_values(df, keys, {name: ("sum", F.lit(1).cast("long"))}, within)


def rank_ids(df: DataFrame, order: Sequence[Column | str], name: str = "id") -> DataFrame:
    """Dense 0-based id in sort order, for keys that are not integers.

    A range sort gives ordered partitions; the id is the rank inside a partition
    plus the number of rows in the partitions before it.
    """
    mark = F.monotonically_increasing_id()
    # A range sort reads its input twice, once to sample it.
    placed = store(store(df, "unranked").orderBy(*order).withColumn("_mark", mark), "ranked").withColumns(
        {"_part": F.expr("shiftright(_mark, 33)"), "_at": F.expr("_mark & ((1L << 33) - 1)")}
    )
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_ahead") + F.col("_at")).alias(name)
    )


def count_in_place(rows: DataFrame, group: str, segment: str, flag: Column) -> DataFrame:
    """Number rows where they are read: adds ``idx``, ``flags`` and ``last_flag``.

    ``idx`` is the 0-based number of a row in its ``group`` (text), ``flags`` the number of
    rows before it for which ``flag`` holds, ``last_flag`` the ``idx`` of the latest of them
    (null without one). The rows of one integer ``segment`` of a group must come one after
    another in one task, in their order, as the splits of a text file do.

    Counts run inside the reading task and are written with the rows, so the input is read
    once and no row is exchanged; only one total a segment is, to start each segment.
    """
    counted = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    added = [T.StructField(c, T.LongType()) for c in ("_at", "_flags", "_last")]
    schema = T.StructType([*counted.schema.fields, *added])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at, flags, last = None, 0, 0, -1  # the open segment, and its counts so far
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(group).dictionary_encode()
            name, part = names.indices.to_numpy(), batch.column(segment).to_numpy()
            on = batch.column("_flag").to_numpy(zero_copy_only=False)
            row = np.arange(len(part))
            new = np.append(True, (name[1:] != name[:-1]) | (part[1:] != part[:-1]))
            goes_on = (names.dictionary[name[0]].as_py(), part[0]) == place
            start = np.maximum.accumulate(np.where(new, row, 0))
            opened = goes_on & (start == 0)
            total = np.append(0, np.cumsum(on))
            own_at = row - start + np.where(opened, at, 0)
            own_flags = total[:-1] - total[start] + np.where(opened, flags, 0)
            latest = np.append(-1, np.maximum.accumulate(np.where(on, row, -1))[:-1])
            own_last = np.where(latest >= start, own_at[latest], np.where(opened, last, -1))
            place = (names.dictionary[name[-1]].as_py(), part[-1])
            at, flags = int(own_at[-1]) + 1, int(own_flags[-1]) + int(on[-1])
            last = int(own_at[-1] if on[-1] else own_last[-1])
            more = [pa.array(own_at), pa.array(own_flags), pa.array(own_last, mask=own_last < 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    counted = store(counted.mapInArrow(count, schema), "counted")
    totals = counted.groupBy(group, segment).agg(
        F.count("*").alias("_n"),
        F.sum(F.col("_flag").cast("long")).alias("_on"),
        F.max(F.when(F.col("_flag"), F.col("_at"))).alias("_final"),
    )
    before = W.partitionBy(group).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    totals = totals.withColumns(
        {"_rows": F.coalesce(F.sum("_n").over(before), none), "_on": F.coalesce(F.sum("_on").over(before), none)}
    )
    latest = F.last(F.col("_rows") + F.col("_final"), ignorenulls=True).over(before)
    starts = store(totals.select(group, segment, "_rows", "_on", latest.alias("_early")), "starts")
    placed = counted.join(broadcast_if_small(starts), [group, segment])
    return placed.select(
        *rows.columns,
        (F.col("_rows") + F.col("_at")).alias("idx"),
        (F.col("_on") + F.col("_flags")).alias("flags"),
        F.coalesce(F.col("_rows") + F.col("_last"), "_early").alias("last_flag"),
    )
