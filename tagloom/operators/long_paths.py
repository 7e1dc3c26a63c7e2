"""Best paths and path likelihoods of sequences that do not fit one row.

A sequence is cut into blocks of positions. Whatever comes before it, a block maps the
scores of the classes at the last position before it to those at its own last position:
a matrix, in max-plus or in log-sum arithmetic. The matrices are made in parallel; one
small row a block is then carried along its sequence, and blocks are decoded in parallel
from the scores they start with and the class they end with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.decode import _stack
from tagloom.workspace import broadcast_if_small, is_small, store

#: Positions in one block.
BLOCK = 4096
# Blocks that take their steps together.
TOGETHER = 256
ARROW = {"array<double>": pa.list_(pa.float64()), "int": pa.int32(), "double": pa.float64()}


def _best(values: np.ndarray, axis: int) -> np.ndarray:
    return values.max(axis=axis)


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)


def _from_start(transitions: Sequence[Sequence[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Transitions, and the same with a last row for "nothing before"."""
    trans = np.asarray(transitions, dtype=float)
    return trans, np.vstack([trans, np.zeros(len(trans))])


def _changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Rows of a batch whose ``keys`` are not those of the row before, the first included."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in keys:
        here, before = batch.column(c).slice(1), batch.column(c).slice(0, max(batch.num_rows - 1, 0))
        same = pc.fill_null(pc.equal(here, before), False).to_numpy(zero_copy_only=False)
        both = here.is_null().to_numpy(zero_copy_only=False) & before.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= ~(same | both)
    return np.flatnonzero(new)


def _lists(flat: pa.Array, ends: np.ndarray) -> pa.ListArray:
    """``flat`` cut at the running numbers of its values."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), flat)


def _lots(scored: DataFrame, seq: list[str], pos: str, block: int, values: Sequence[str], classes: int) -> DataFrame:
    """One written row a lot of whole blocks, at least ``BLOCK`` positions, as ``runs`` of places and their values.

    Rows that lie together are gathered before they are exchanged, so rows in order move as
    one a lot; any other order only moves more of them.
    """
    names = [f"v{i}" for i in range(len(values))]
    cells = [F.col(v).cast("array<double>" if n == "v0" else "int").alias(n) for n, v in zip(names, values)]
    lot = F.floor(F.col(pos) / (block * -(-BLOCK // block))).cast("long").alias("lot")
    rows = scored.select(*seq, lot, F.col(pos).cast("long").alias("at"), *cells)
    keys = [*seq, "lot"]
    kinds = [T.StructField("at", T.ArrayType(T.LongType())), T.StructField("v0", T.ArrayType(T.DoubleType()))]
    kinds += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in names[1:]]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = _changes(batch, keys)
            ends = np.append(firsts[1:], batch.num_rows)[: len(firsts)]
            flat = batch.column("v0")
            if flat.null_count or (pc.list_value_length(flat).to_numpy() != classes).any():
                raise ValueError(f"every position needs {classes} scores")
            made = [_lists(batch.column("at"), ends), _lists(flat.flatten(), ends * classes)]
            made += [_lists(batch.column(n), ends) for n in names[1:]]
            found = [batch.column(c).take(pa.array(firsts)) for c in keys]
            yield pa.RecordBatch.from_arrays([*found, *made], [*keys, "at", *names])

    runs = rows.mapInArrow(gather, T.StructType([rows.schema[c] for c in keys] + kinds))
    return store(runs.groupBy(*keys).agg(F.collect_list(F.struct("at", *names)).alias("runs")), "lots", narrow=True)


def _cells(lots: pa.RecordBatch, classes: int):
    """Row, place, scores and further values of all positions of some lots, in order."""
    parts = lots.column("runs")
    inner = parts.flatten()
    at = inner.field("at")
    size = np.append(0, np.cumsum(pc.list_value_length(at).to_numpy()))
    ends = size[np.cumsum(pc.list_value_length(parts).to_numpy())]
    own = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    place = at.flatten().to_numpy()
    table = inner.field("v0").flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)
    more = [inner.field(i).flatten() for i in range(2, inner.type.num_fields)]
    if ((np.diff(place) <= 0) & (np.diff(own) == 0)).any():
        order = np.lexsort([*table.T[::-1], place, own])
        place, table, more = place[order], table[order], [m.take(pa.array(order)) for m in more]
    return own, place, table, more


def _cuts(place: np.ndarray, own: np.ndarray, block: int) -> np.ndarray:
    """First cells of blocks, for places in order within the rows they belong to."""
    blocks = place // block
    return np.flatnonzero(np.append(True, (np.diff(blocks) != 0) | (np.diff(own) != 0))[: len(place)])


def _blocks(lots: DataFrame, seq: list[str], block: int, classes: int) -> DataFrame:
    """One written row a block of the lots: its positions in order and, for each, the values."""
    kinds = [f.dataType for f in lots.schema["runs"].dataType.elementType]
    names = ["at", *[f"v{i}" for i in range(len(kinds) - 1)]]
    schema = T.StructType([lots.schema[c] for c in seq] + [T.StructField("blk", T.LongType())])
    schema = T.StructType(schema.fields + [T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                own, place, table, more = _cells(part, classes)
                cuts = _cuts(place, own, block)
                ends = np.append(cuts[1:], len(place))[: len(cuts)]
                made = [pa.array(place[cuts] // block), _lists(pa.array(place), ends), _lists(pa.array(table.ravel()), ends * classes)]
                found = [part.column(c).take(pa.array(own[cuts])) for c in seq]
                yield pa.RecordBatch.from_arrays([*found, *made, *[_lists(m, ends) for m in more]], [*seq, "blk", *names])

    return store(lots.mapInArrow(run, schema), "blocks")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, TOGETHER):
        yield batch.slice(first, TOGETHER)


def _map(df: DataFrame, kept: list[str], fields: list[T.StructField], fn: Callable) -> DataFrame:
    """``fn`` over slices of rows as pandas; ``kept`` columns stay as they are."""
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                made = fn(part.to_pandas())
                columns = [part.column(c) for c in kept] + [pa.array(made[n]) for n in names]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *names])

    return df.mapInArrow(run, schema)


def _carry(df: DataFrame, seq: list[str], back: bool, fields: list[T.StructField], step: Callable) -> DataFrame:
    """Go along the blocks of every sequence, in order or ``back``: one small row each.

    ``step(state, row) -> state, values`` has the state None where a sequence begins.
    The rows of a sequence pass through one task, one batch of them in memory.
    """
    kept, names = [*seq, "blk"], [f.name for f in fields]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    order = F.col("blk").desc() if back else F.col("blk")
    if seq:
        df = df.repartition(*seq).sortWithinPartitions(*seq, order)
    else:
        df = df.repartition(1).sortWithinPartitions(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made: dict[str, list] = {n: [] for n in names}
            for row in batch.to_pylist():
                keys = tuple(row[c] for c in seq)
                if keys != key:
                    key, state = keys, None
                state, values = step(state, row)
                for n, v in zip(names, values):
                    made[n].append(v)
            columns = [pa.array(made[f.name], ARROW[f.dataType.simpleString()]) for f in fields]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], [*kept, *names])

    return df.mapInArrow(run, schema)


def _links(stack: tuple, trans: np.ndarray, joined: np.ndarray, total: Callable) -> np.ndarray:
    """For each block of a stack the matrix from the classes before it (and "nothing") to its last."""
    scores, lengths, starts, order, running = stack
    link = joined[None] + scores[starts][:, None, :]
    if total is _best:  # one class before at a time, blocks side by side
        link = np.ascontiguousarray(np.moveaxis(link, 0, -1))
        for t in range(1, int(lengths[0])):
            now = link[:, :, : running[t]]
            top = now[:, 0, None] + trans[0][:, None]
            for c in range(1, len(trans)):
                np.maximum(top, now[:, c, None] + trans[c][:, None], out=top)
            now[:] = top + scores[starts[: running[t]] + t].T
        link = np.moveaxis(link, -1, 0)
    else:
        for t in range(1, int(lengths[0])):
            k = running[t]
            link[:k] = total(link[:k, :, :, None] + trans, 2) + scores[starts[:k] + t][:, None, :]
    out = np.empty(link.shape)
    out[order] = link
    return out


def _flat_links(flat: pd.Series, trans: np.ndarray, joined: np.ndarray, total: Callable) -> list[np.ndarray]:
    return [link.ravel() for link in _links(_stack(flat, len(trans)), trans, joined, total)]


def _in_place(scores: np.ndarray, cuts: np.ndarray) -> tuple:
    """What ``_stack`` gives, for blocks that lie one after another from ``cuts``; nothing moves."""
    sizes = np.diff(np.append(cuts, len(scores)))
    order = np.argsort(-sizes, kind="stable")
    lengths = sizes[order]
    running = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]) + 1)]
    return scores, lengths, cuts[order], order, running


def _enter(state: np.ndarray | None, link: Sequence[float], classes: int, total: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Scores before a block (the last place: nothing) and those after it."""
    if state is None:
        state = np.append(np.full(classes, -np.inf), 0.0)
    after = total(state[:, None] + np.asarray(link).reshape(classes + 1, classes), 0)
    return state, np.append(after, -np.inf)


def _forward(stack: tuple, enter: np.ndarray, trans: np.ndarray, joined: np.ndarray):
    """Best scores and the class before, for every position of blocks with known starts.

    The last value holds, for each step, the places of the blocks that reach it.
    """
    scores, lengths, starts, order, running = stack
    best, came = np.empty_like(scores), np.empty(scores.shape, dtype=np.int32)
    before = np.ascontiguousarray(enter[order].T)
    steps_at = [starts[: running[t]] + t for t in range(int(lengths[0]))]
    for t, at in enumerate(steps_at):
        links, rows = trans if t else joined, before[:, : len(at)]
        top, first = rows[0] + links[0][:, None], np.zeros((len(trans), len(at)), np.int32)
        for c in range(1, len(links)):
            other = rows[c] + links[c][:, None]
            np.copyto(first, c, where=~(other <= top) & (top == top))  # as argmax: the lowest, the first that is no number
            np.maximum(top, other, out=top)
        before = top + scores[at].T
        came[at], best[at] = first.T, before.T
    return best, came, lengths, starts, order, steps_at


def viterbi_long(
    scored: DataFrame,
    transitions: Sequence[Sequence[float]],
    seq: Sequence[str],
    pos: str = "pos",
    scores: str = "scores",
    block: int = BLOCK,
) -> DataFrame:
    """``scored(seq…, pos, scores array)`` -> ``(seq…, pos, pred, score)``.

    ``score`` is that of the best path up to the position, so the last one is the whole
    path's. Positions are non-negative integers, once each in a sequence, gaps allowed. On
    ties the lowest class wins, at every step and at the end, as in ``decode.viterbi``;
    scores of blocks are added in another order, which matters only to rounding.
    """
    seq = list(seq)
    trans, joined = _from_start(transitions)
    classes, kind = len(trans), scored.schema[pos].dataType
    lots = _lots(scored, seq, pos, block, [scores], classes)
    for c in seq:
        lots = lots.where(F.col(c).isNotNull())
    later = store(lots.where("lot > 0").select(*(seq or ["lot"])).distinct(), "long_sequences")
    if is_small(later, 0):
        return _short_paths(lots, trans, joined, seq, pos, kind, block)
    if not seq:
        return _long_paths(_blocks(lots, seq, block, classes), trans, joined, seq, pos, kind)
    later = broadcast_if_small(later)
    short, long = lots.join(later, seq, "left_anti"), lots.join(later, seq, "left_semi")
    found = _long_paths(_blocks(long, seq, block, classes), trans, joined, seq, pos, kind)
    return _short_paths(short, trans, joined, seq, pos, kind, block).unionByName(found)


def _short_paths(lots: DataFrame, trans: np.ndarray, joined: np.ndarray, seq: list[str], pos: str, kind, block: int) -> DataFrame:
    """Paths of sequences of one lot each: blocks are linked, entered and left where they are."""
    classes = len(trans)
    made = [T.StructField("at", T.LongType()), T.StructField("pred", T.IntegerType()), T.StructField("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                own, place, table, _ = _cells(part, classes)
                pred, score = _decoded(table, own, _cuts(place, own, block), trans, joined)
                found = [part.column(c).take(pa.array(own)) for c in seq]
                yield pa.RecordBatch.from_arrays([*found, pa.array(place), pa.array(pred), pa.array(score)], [*seq, "at", "pred", "score"])

    rows = lots.mapInArrow(run, T.StructType([lots.schema[c] for c in seq] + made))
    return rows.select(*seq, F.col("at").cast(kind).alias(pos), "pred", "score")


def _decoded(values: np.ndarray, own: np.ndarray, cuts: np.ndarray, trans: np.ndarray, joined: np.ndarray):
    """Classes and scores of the best paths of whole sequences that lie one after another in blocks from ``cuts``."""
    classes, count = len(trans), len(cuts)
    stack = _in_place(values, cuts)
    links = _links(stack, trans, joined, _best)
    # Blocks of one step of the carry: the k-th block of every sequence.
    seqs = own[cuts]
    number = np.arange(count) - np.searchsorted(seqs, seqs)
    steps = np.split(np.argsort(number, kind="stable"), np.cumsum(np.bincount(number))[:-1])
    enter = np.full((count, classes + 1), -np.inf)
    enter[steps[0], classes] = 0.0
    for at in steps[1:]:
        enter[at, :classes] = (enter[at - 1, :, None] + links[at - 1]).max(axis=1)
    best, came, lengths, starts, order, steps_at = _forward(stack, enter, trans, joined)
    label = np.tile(np.arange(classes), (count, 1))
    for at in reversed(steps_at):
        label[: len(at)] = came[at[:, None], label[: len(at)]]
    back = np.empty_like(label)
    back[order] = label
    last = best[np.append(cuts[1:], len(best)) - 1].argmax(axis=1)
    for at in reversed(steps[1:]):
        last[at - 1] = back[at, last[at]]
    label, path = last[order], np.empty(len(best), dtype=np.int32)
    for at in reversed(steps_at):
        path[at] = label[: len(at)]
        label[: len(at)] = came[at, label[: len(at)]]
    return path, best[np.arange(len(best)), path]


def _long_paths(blocks: DataFrame, trans: np.ndarray, joined: np.ndarray, seq: list[str], pos: str, kind) -> DataFrame:
    """Paths of sequences of any length, whose blocks meet through small rows."""
    classes = len(trans)
    numbers, whole = T.ArrayType(T.DoubleType()), T.IntegerType()
    links = _map(blocks, [*seq, "blk"], [T.StructField("link", numbers)], lambda b: {"link": _flat_links(b["v0"], trans, joined, _best)})

    def ahead(state, row):
        enter, after = _enter(state, row["link"], classes, _best)
        return after, [enter.tolist()]

    enters = store(_carry(store(links, "links"), seq, False, [T.StructField("enter", numbers)], ahead), "enters")
    known = blocks.join(broadcast_if_small(enters), [*seq, "blk"])

    def ends(b: pd.DataFrame) -> dict:
        best, came, lengths, starts, order, steps_at = _forward(_stack(b["v0"], classes), np.stack(list(b["enter"])), trans, joined)
        label = np.tile(np.arange(classes), (len(order), 1))
        for at in reversed(steps_at):
            label[: len(at)] = came[at[:, None], label[: len(at)]]
        back, tail = [None] * len(order), [None] * len(order)
        for row, i in enumerate(order):
            back[i], tail[i] = label[row].astype(float), best[starts[row] + lengths[row] - 1]
        return {"back": back, "tail": tail}

    tails = _map(known, [*seq, "blk"], [T.StructField("back", numbers), T.StructField("tail", numbers)], ends)

    def behind(state, row):
        label = int(np.argmax(row["tail"])) if state is None else state
        return int(row["back"][label]), [label]

    last = store(_carry(store(tails, "tails"), seq, True, [T.StructField("last", whole)], behind), "lasts")
    known = known.join(broadcast_if_small(last), [*seq, "blk"])

    def paths(b: pd.DataFrame) -> dict:
        best, came, lengths, starts, order, steps_at = _forward(_stack(b["v0"], classes), np.stack(list(b["enter"])), trans, joined)
        label, path = b["last"].to_numpy()[order].copy(), np.empty(len(best), dtype=np.int32)
        for at in reversed(steps_at):
            path[at] = label[: len(at)]
            label[: len(at)] = came[at, label[: len(at)]]
        along = best[np.arange(len(best)), path]
        pred, score = [None] * len(order), [None] * len(order)
        for row, i in enumerate(order):
            own = slice(starts[row], starts[row] + lengths[row])
            pred[i], score[i] = path[own], along[own]
        return {"pred": pred, "score": score}

    found = _map(known, [*seq, "at"], [T.StructField("pred", T.ArrayType(whole)), T.StructField("score", numbers)], paths)
    rows = found.select(*seq, F.explode(F.arrays_zip("at", "pred", "score")).alias("r"))
    return rows.select(*seq, F.col("r.at").cast(kind).alias(pos), "r.pred", "r.score")


def path_log_likelihood_long(
    scored: DataFrame,
    transitions: Sequence[Sequence[float]],
    seq: Sequence[str],
    pos: str = "pos",
    scores: str = "scores",
    label: str = "label_id",
    block: int = BLOCK,
) -> DataFrame:
    """``(seq…, log_likelihood)`` of the labelled path of every sequence."""
    seq = list(seq)
    trans, joined = _from_start(transitions)
    classes = len(trans)
    blocks = _blocks(_lots(scored, seq, pos, block, [scores, label], classes), seq, block, classes)

    def summary(b: pd.DataFrame) -> dict:
        inner, head, tail = [], [], []
        for flat, tags in zip(b["v0"], b["v1"]):
            tags = np.asarray(tags, dtype=int)
            own = np.asarray(flat).reshape(-1, classes)[np.arange(len(tags)), tags]
            inner.append(float(own.sum() + trans[tags[:-1], tags[1:]].sum()))
            head.append(int(tags[0]))
            tail.append(int(tags[-1]))
        link = _flat_links(b["v0"], trans, joined, _log_sum)
        return {"link": link, "inner": inner, "head": np.array(head, np.int32), "tail": np.array(tail, np.int32)}

    fields = [
        T.StructField("link", T.ArrayType(T.DoubleType())),
        T.StructField("inner", T.DoubleType()),
        T.StructField("head", T.IntegerType()),
        T.StructField("tail", T.IntegerType()),
    ]
    sums = store(_map(blocks, [*seq, "blk"], fields, summary), "links")

    def ahead(state, row):
        alpha, path, tag = state if state is not None else (None, 0.0, None)
        _, alpha = _enter(alpha, row["link"], classes, _log_sum)
        path += row["inner"] + (0.0 if tag is None else trans[tag, row["head"]])
        return (alpha, path, row["tail"]), [float(path - _log_sum(alpha[:-1], 0))]

    done = _carry(sums, seq, False, [T.StructField("ll", T.DoubleType())], ahead)
    return done.groupBy(*seq).agg(F.max_by("ll", "blk").alias("log_likelihood"))
