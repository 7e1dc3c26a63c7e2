"""Greedy packing of ordered sentences into sequences of limited length.

Sentences are appended to a buffer until the next one no longer fits; one that can
never fit flushes the buffer, is cut into full-length chunks and leaves an empty
buffer. The rule is sequential, but its only memory is how full the buffer is, a
number between 0 and the limit. A block of sentences is therefore a table from
incoming to outgoing fill (and pack ids used); tables of consecutive blocks compose.
Every block computes its table independently, a short chain of tables gives each
block its starting point, and the blocks are then packed in parallel. One shard of
any size is packed exactly, with no task holding more than one block or one
composition step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.scan import rank_ids
from tagloom.workspace import broadcast_if_small, is_small, store

BLOCK = 8192
FAN = 1024
# Ids that leave out more than so many for each one they use are numbered anew.
SPARSE = 64


class _Links:
    """Where the next pack starts, for every sentence at which a pack can start.

    ``firsts`` are the first rows of consecutive groups of sentences, each packed on its
    own. A group has a node for each of its sentences (an empty buffer before it) and one
    for its end. The sentences that still fit are found in the running total by binary
    search, for all nodes at once. ``to`` is the next node, or the node itself if all that
    follows fits; ``cost`` is the number of pack ids used on the way.
    """

    def __init__(self, sizes: np.ndarray, firsts: np.ndarray, limit: int, keep_empty: bool):
        self.sizes, self.firsts, self.limit = sizes, firsts, limit
        self.ends = np.append(firsts[1:], len(sizes))
        # A sentence above the limit makes the total jump too far to be passed over.
        self.total = np.concatenate([[0], np.cumsum(sizes)])
        self.over, self.parts = sizes > limit, -(-sizes // limit)
        group = np.repeat(np.arange(len(firsts)), self.ends - firsts)
        rows = np.arange(len(sizes))
        self.node = rows + group
        nodes = len(sizes) + len(firsts)
        self.row = np.empty(nodes, np.int64)  # the row a node stands before
        self.row[self.node] = rows
        self.row[self.ends + np.arange(len(firsts))] = self.ends
        self.to, self.cost = np.arange(nodes), np.zeros(nodes, np.int64)
        to, cost = self._next(group, rows, np.zeros(len(sizes), np.int64))
        self.to[self.node] = np.where(to < 0, self.node, to)
        self.cost[self.node] = np.where(self.over, self.parts + keep_empty, cost)

    def _next(self, group: np.ndarray, rows: np.ndarray, fill: np.ndarray):
        """Next node after a pack that holds ``fill`` before ``rows``, -1 if all fits, and ids used."""
        reach = np.searchsorted(self.total, self.total[rows] + self.limit - fill, "right") - 1
        done = reach >= self.ends[group]
        reach = np.where(done, self.firsts[group], reach)
        flushed = self.over[reach]
        cost = np.where(done, 0, 1 + np.where(flushed, self.parts[reach], 0))
        return np.where(done, -1, reach + group + flushed), cost

    def enter(self, group: np.ndarray, fill: np.ndarray):
        """First node with an empty buffer for groups that begin with ``fill``, and ids used."""
        to, cost = self._next(group, self.firsts[group], fill)
        empty = fill == 0
        return np.where(empty, self.firsts[group] + group, to), np.where(empty, 0, cost)


def _block_table(sizes: np.ndarray, limit: int, keep_empty: bool):
    """Outgoing fill and pack ids used, for each incoming fill 0..limit.

    Links are doubled until all of them lead to the last pack of the block.
    """
    links = _Links(sizes, np.zeros(1, np.int64), limit, keep_empty)
    to, used = links.to, links.cost
    while True:
        further = to[to]
        if (further == to).all():
            break
        to, used = further, used + used[to]
    fill = np.arange(limit + 1)
    node, cost = links.enter(np.zeros(limit + 1, np.int64), fill)
    total = links.total
    left = total[-1] - total[links.row[to]]
    return np.where(node < 0, fill + total[-1], left[node]), np.where(node < 0, 0, cost + used[node])


def _walk(tables: pd.DataFrame, fill: int, pack: int) -> list[tuple[int, int]]:
    """Starting fill and pack id of each table in order."""
    starts = []
    for out, used in zip(tables["fill_out"], tables["used"]):
        starts.append((fill, pack))
        fill, pack = int(out[fill]), pack + int(used[fill])
    return starts


def _compose(tables: pd.DataFrame):
    fill = used = None
    for out, ids in zip(tables["fill_out"], tables["used"]):
        out, ids = np.asarray(out), np.asarray(ids)
        if fill is None:
            fill, used = out, ids
        else:
            used = used + ids[fill]
            fill = out[fill]
    return fill, used


def _block_starts(rows: DataFrame, shard: list[str], limit: int, keep_empty: bool, fan: int) -> DataFrame:
    """``(shard…, block, fill_in, pack_in)`` for every block of ``rows``.

    Tables are composed ``fan`` at a time until one level has no more than ``fan`` of
    them in any shard; starts then go down the levels again.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keys = "".join(f"{c} {kinds[c]}, " for c in shard)
    table = "fill_out array<int>, used array<bigint>"

    def to_table(key, pdf):
        sizes = pdf.sort_values("idx")["n"].to_numpy()
        return pd.DataFrame([[*key, *_block_table(sizes, limit, keep_empty)]])

    def to_group(key, pdf):
        return pd.DataFrame([[*key, *_compose(pdf.sort_values("block"))]])

    def starts_in_group(key, pdf):
        pdf = pdf.sort_values("block")
        fill, pack = int(pdf["fill_in"].iloc[0]), int(pdf["pack_in"].iloc[0])
        rows = zip(pdf["block"], _walk(pdf, fill, pack))
        return pd.DataFrame([[*key[:-1], b, f, p] for b, (f, p) in rows])

    level = rows.groupBy(*shard, "block").applyInPandas(to_table, f"{keys}block bigint, {table}")
    levels = [store(level, "blocks")]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) >= fan:
        grouped = levels[-1].withColumn("grp", F.expr(f"block div {fan}")).groupBy(*shard, "grp")
        level = grouped.applyInPandas(to_group, f"{keys}grp bigint, {table}")
        levels.append(store(level.withColumnRenamed("grp", "block"), "blocks"))
    starts = None
    for level in reversed(levels):
        level = level.withColumn("grp", F.expr(f"block div {fan}"))
        if starts is None:
            level = level.withColumns({"fill_in": F.lit(0), "pack_in": F.lit(0).cast("long")})
        else:
            level = level.join(starts.withColumnRenamed("block", "grp"), [*shard, "grp"])
        starts = level.groupBy(*shard, "grp").applyInPandas(
            starts_in_group, f"{keys}block bigint, fill_in int, pack_in bigint"
        )
    return starts


def _fill(sizes: np.ndarray, firsts: np.ndarray, fill: np.ndarray, pack: np.ndarray, limit: int, keep_empty: bool):
    """Pack, offset and empty-buffer flag of the sentences of consecutive groups, all at once.

    A group starts at its row in ``firsts`` with its ``fill`` and ``pack``. Also gives the fill
    and pack after the last group. Starts of packs are found by doubling the links.
    """
    links = _Links(sizes, firsts, limit, keep_empty)
    groups = np.arange(len(firsts))
    node, cost = links.enter(groups, fill)
    reached = np.zeros(len(links.to), bool)
    reached[node[node >= 0]] = True
    jump = links.to
    while True:
        reached[jump[reached]] = True
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    starts = np.flatnonzero(reached)
    # A group's opening pack comes first, at the fill it starts with; then its reached nodes.
    of = np.searchsorted(links.ends + groups, starts)
    # A group's opening pack comes first, at the fill it starts with; then its reached nodes.
    keys = np.concatenate([2 * (firsts + groups), 2 * starts + 1])
    order = np.argsort(keys)
    owner = np.concatenate([groups, of])[order]
    fresh = order >= len(groups)
    base = np.concatenate([links.total[firsts] - fill, links.total[links.row[starts]]])[order]
    used = np.cumsum(np.concatenate([cost, links.cost[starts]])[order])
    ahead = np.append(0, used[:-1])
    number = pack[owner] + ahead - ahead[~fresh][owner]
    segment = np.searchsorted(keys[order], 2 * links.node + 1, "right") - 1
    own = fresh[segment] & (keys[order][segment] == 2 * links.node + 1)
    packs = number[segment] + np.where(links.over, np.where(own, int(keep_empty), 1), 0)
    offsets = np.where(links.over, 0, links.total[:-1] - base[segment])
    return packs, offsets, links.over & own, int(links.total[-1] - base[-1]), int(number[-1])


def pack_sentences(
    sizes: DataFrame,
    limit: int,
    shard: Sequence[str] = (),
    keep_empty: bool = True,
    block: int = BLOCK,
    fan: int = FAN,
) -> DataFrame:
    """Place each sentence of ``(shard…, sent_id, n)`` in a pack.

    Adds ``pack_id`` (0-based in the shard), ``offset`` of the sentence in its pack,
    and ``empty_before``. A sentence with ``n > limit`` fills the packs ``pack_id``,
    ``pack_id + 1``, … on its own; ``empty_before`` marks that it flushed an empty
    buffer, which with ``keep_empty`` is a pack of its own, numbered one lower.

    ``sent_id`` is any integer; ids with wide gaps are numbered densely first.
    """
    shard = list(shard)
    rows = store(sizes.select(*shard, "sent_id", F.col("n").cast("long").alias("n")).where("n > 0"), "sizes")
    span = rows.groupBy(*shard).agg(F.max("sent_id").alias("most"), F.min("sent_id").alias("least"), F.count("*").alias("rows"))
    wide = span.where(f"least < 0 OR most >= {SPARSE} * rows + {block}")
    if wide.isEmpty():
        rows = rows.withColumn("idx", F.col("sent_id"))
    else:
        ranked = rank_ids(rows, [*shard, "sent_id"], "rank")
        if shard:
            ranked = ranked.join(ranked.groupBy(*shard).agg(F.min("rank").alias("low")), shard)
            ranked = ranked.withColumn("rank", F.col("rank") - F.col("low")).drop("low")
        rows = store(ranked.withColumnRenamed("rank", "idx"), "sizes")
    rows = rows.withColumn("block", F.expr(f"idx div {block}"))
    later = store(rows.where("block > 0").select(*shard).distinct(), "long_shards") if shard else None
    if later is None:
        starts = _block_starts(rows, shard, limit, keep_empty, fan)
    elif is_small(later, 0):
        starts = None
    else:
        long_rows = rows.join(broadcast_if_small(later), shard, "left_semi")
        starts = _block_starts(long_rows, shard, limit, keep_empty, fan)
    if starts is not None:
        starts = broadcast_if_small(store(starts, "starts"))
        rows = rows.join(starts, [*shard, "block"], "left")
    else:
        rows = rows.withColumns({"fill_in": F.lit(0), "pack_in": F.lit(0).cast("long")})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fill_in", "pack_in")})
    ordered = rows.repartition(*shard, "block").sortWithinPartitions(*shard, "block", "idx")

    def fill_packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fill, pack = None, 0, 0
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pdf[[*shard, "block"]]
            firsts = np.flatnonzero(np.append(True, (keys.iloc[1:].to_numpy() != keys.iloc[:-1].to_numpy()).any(axis=1)))
            fills, opened = (pdf[c].to_numpy()[firsts].astype(np.int64) for c in ("fill_in", "pack_in"))
            if tuple(keys.iloc[0]) == at:  # the block goes on from the batch before
                fills[0], opened[0] = fill, pack
            at = tuple(keys.iloc[-1])
            *found, fill, pack = _fill(pdf["n"].to_numpy(), firsts, fills, opened, limit, keep_empty)
            packs, offsets, empties = found
            out = pdf[[*shard, "sent_id", "n"]].copy()
            yield out.assign(pack_id=packs, offset=offsets.astype(np.int32), empty_before=empties)

    kinds = ordered.select(*shard, "sent_id", "n").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.fields)
    return ordered.mapInPandas(
        fill_packs, f"{schema}, pack_id bigint, offset int, empty_before boolean"
    )


def oversize_chunks(placed: DataFrame, limit: int) -> DataFrame:
    """One row per pack a sentence occupies: ``chunk``, its pack and piece range."""
    chunks = F.explode(F.expr(f"sequence(0, cast(ceil(n / {limit}) as int) - 1)"))
    return placed.withColumn("chunk", chunks).withColumns(
        {
            "pack_id": F.col("pack_id") + F.col("chunk"),
            "first": F.col("chunk") * limit,
            "size": F.least(F.lit(limit).cast("long"), F.col("n") - F.col("chunk") * limit),
        }
    )
