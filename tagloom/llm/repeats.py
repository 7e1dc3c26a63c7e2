"""Byte-exact removal of long strings that occur more than once in a corpus.

1. Every window of ``length`` bytes has one anchor: its k-gram of least hash (the
   first of equal ones). The anchor depends on the window's bytes only, so equal
   windows have equal anchors at equal places. Neighbouring windows share an
   anchor; such a run of windows is one row.
2. Only anchors that occur more than once can belong to repeated windows. The text
   around them is dealt out by anchor, equal contexts once.
3. The contexts of an anchor are aligned at it, which makes them a positional
   Burrows-Wheeler transform: column by column, from right to left, contexts are
   kept in the order of what follows. Inside a run of equal preceding bytes, order
   and match lengths carry over; only where runs end is a range minimum taken.
   The longer match with the two neighbours is the matching statistic of the
   window that begins in this column: at ``length`` or more, the window is
   repeated.
4. An anchor with more distinct contexts than one task should hold is not indexed:
   the digests of its windows are counted, with sums before the exchange.

``repeated_passages`` does the same with words in place of bytes, and so finds passages
by their number of words whatever the lengths of these.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tagloom.llm.buffers import U64, column_bytes, mix, prefix_hash, slices, word_hashes
from tagloom.workspace import settle, store

LENGTH = 400
GRAM = 32
#: An anchor with more occurrences is dealt out by two more minima of its windows as well.
HOT = 20_000
#: An anchor with more distinct contexts is not indexed; its windows are counted.
WIDE = 20_000
#: Contexts in one index.
BATCH = 8192
#: Words of a passage, and bytes that stand for each of them.
WORDS = 51
WORD = 4
_PLACE = U64((1 << 21) - 1)
_MOST = 1 << 18  # bytes hashed or aligned at once
_NONE = 256  # no byte here
_WORD = re.compile(rb"[^\t-\r ]+")


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by minima of blocks from both ends."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    sums, down = prefix_hash(data)
    return mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor: (row, first window, last window, anchor, anchor's hash).

    ``data`` has fewer than 2**21 bytes. Places count from the beginning of ``data``.
    """
    if len(data) < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    hashes = _gram_hashes(data, gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = _window_min((hashes & ~_PLACE) | place, length - gram + 1)
    anchor = (least & _PLACE).astype(np.int64)
    steps = np.zeros(len(anchor) + 1, np.int64)
    whole = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(steps, offsets[whole], 1)
    np.add.at(steps, offsets[whole + 1] - length + 1, -1)
    inside = np.cumsum(steps[:-1]) > 0
    same = np.zeros(len(anchor) + 1, bool)
    same[1:-1] = inside[1:] & inside[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(inside & ~same[:-1])
    last = np.flatnonzero(inside & ~same[1:])
    return (
        np.searchsorted(offsets, first, "right") - 1, first, last, anchor[first], hashes[anchor[first]],
    )


def _parse(
    batches: Iterator[pa.RecordBatch], length: int, gram: int, only: np.ndarray | None = None
) -> Iterator[pa.RecordBatch]:
    """Key of a text -> its runs of windows, each with the MD5 of its bytes; ``only`` those with these anchors."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for i, j in slices(offsets, _MOST):
            start, end = offsets[i], offsets[j]
            if end - start <= _MOST or j > i + 1:
                parts = [_kept(_runs(data[start:end], offsets[i : j + 1] - start, length, gram), only)]
                digests = _digests(data[start:end], parts[0], length)
            else:  # one very long text, in overlapping parts
                parts, digests = [], []
                for at in range(start, end - length + 1, _MOST):
                    cut = data[at : min(end, at + _MOST + length - 1)]
                    runs = _kept(_runs(cut, np.array([0, len(cut)]), length, gram), only)
                    digests += _digests(cut, runs, length)
                    row, first, last, anchor, key = runs
                    parts.append((row, first + at - start, last + at - start, anchor + at - start, key))
            row, first, last, anchor, key = (np.concatenate(x) for x in zip(*parts))
            base = offsets[i:j][row] - start
            ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
            runs = pa.StructArray.from_arrays(
                [
                    pa.array(key.astype(np.int64)),
                    *(pa.array((x - base).astype(np.int32)) for x in (first, last, anchor)),
                    pa.array(digests, pa.binary()),
                ],
                ["h", "first", "last", "anchor", "c"],
            )
            yield pa.record_batch(
                {"t": batch.column(0)[i:j], "runs": pa.ListArray.from_arrays(pa.array(ends), runs)}
            )


def _kept(runs: tuple, only: np.ndarray | None) -> tuple:
    if only is None:
        return runs
    found = np.isin(runs[4].astype(np.int64), only)
    return tuple(x[found] for x in runs)


def _digests(data: np.ndarray, runs: tuple, length: int) -> list[bytes]:
    """MD5 of the bytes of each run of windows."""
    raw = data.tobytes()
    return [hashlib.md5(raw[a : b + length]).digest() for a, b in zip(runs[1].tolist(), runs[2].tolist())]


def _split_hot(text: np.ndarray, run: tuple, length: int, gram: int) -> list[tuple]:
    """Parts of a run of windows with two more minima in common: (key, first, last)."""
    first, last, key = run
    hashes = _gram_hashes(text[first : last + length], gram)
    more = [_window_min(mix(hashes ^ U64(seed)), length - gram + 1) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    finer = mix(more[0] ^ mix(more[1] + U64(1))) ^ mix(np.array([key]).astype(np.int64).view(np.uint64) + U64(7))
    begin = np.flatnonzero(np.concatenate([[True], finer[1:] != finer[:-1]]))
    end = np.append(begin[1:], len(finer)) - 1
    return [(int(finer[b].astype(np.int64)), first + b, first + e) for b, e in zip(begin, end)]


def _finer(batches: Iterator[pa.RecordBatch], length: int, gram: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Places and digests of the contexts of hot anchors, dealt out by more minima."""
    names = ["key", "c", "at", "t", "first", "last"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        done = 0
        for parsed in _parse(iter([batch]), length, gram, hot):
            lists = parsed.column("runs")
            rows = np.repeat(np.arange(done, done + len(lists)), lists.value_lengths().to_numpy())
            done += len(lists)
            out = []
            for i, r in zip(rows.tolist(), lists.flatten().to_pylist()):
                text, t = data[offsets[i] : offsets[i + 1]], batch.column(0)[i].as_py()
                for key, a, b in _split_hot(text, (r["first"], r["last"], r["h"]), length, gram):
                    out.append((key, hashlib.md5(text[a : b + length].tobytes()).digest(), r["anchor"] - int(a), t, int(a), int(b)))
            if out:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted places of every text."""
    names = ["key", "at", "t", "first", "last"]
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        lists = batch.column(2)
        fields = lists.flatten()
        rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        first, last = (fields.field(n).to_numpy().astype(np.int64) for n in (2, 3))
        starts, stops = offsets[rows] + first, offsets[rows] + last + length
        sizes = np.append(0, np.cumsum(stops - starts))
        for i, j in slices(sizes, 1 << 22):
            some = fields.slice(i, j - i)
            context = pa.array([data[a:b].tobytes() for a, b in zip(starts[i:j].tolist(), stops[i:j].tolist())], pa.binary())
            t = batch.column(0).take(pa.array(rows[i:j]))
            yield pa.record_batch([some.field(0), some.field(1), t, some.field(2), some.field(3), context], names=[*names, "context"])


class RunLengthIndex:
    """Positional run-length transform of aligned contexts, read from right to left.

    ``order`` ranks the contexts of each group by what follows the current column,
    ``match[r]`` is the number of bytes that ranks r-1 and r share from there on.
    """

    def __init__(self, group: np.ndarray) -> None:
        self.group = group.astype(np.int64)
        self.order = np.arange(len(group))
        self.match = np.zeros(len(group) + 1, np.int32)

    def step(self, symbols: np.ndarray) -> None:
        """Go one column to the left; ``symbols`` are the bytes there by context."""
        before = symbols[self.order]
        key = self.group[self.order] * 512 + before
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        together = np.zeros(len(key), bool)
        together[1:] = (key[1:] == key[:-1]) & (before[moved][1:] != _NONE)
        match = np.zeros(len(key) + 1, np.int32)
        inner = np.flatnonzero(together)
        a, b = moved[inner - 1], moved[inner]
        shared = self.match[b].copy()
        ends = np.flatnonzero(b != a + 1)  # another run lay between: least match on the way
        if len(ends):
            spans = np.stack([a[ends] + 1, b[ends] + 1], axis=1).ravel()
            shared[ends] = np.minimum.reduceat(self.match, spans)[::2]
        match[inner] = shared + 1
        self.order, self.match = self.order[moved], match

    def statistics(self) -> np.ndarray:
        """Longest match of every context, from the current column, with another of its group."""
        out = np.empty(len(self.order), np.int32)
        out[self.order] = np.maximum(self.match[:-1], self.match[1:])
        return out


def repeated_windows(
    group: np.ndarray, data: np.ndarray, ends: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM
) -> np.ndarray:
    """(context, window) flags: does the window that begins in this column occur in another context?

    Contexts lie one after the other in ``data``; ``at`` is the place of the anchor in
    each; those of one group are neighbours. Column ``c`` is the window that begins
    ``length - gram - c`` bytes before the anchor.
    """
    left = length - gram
    lengths = np.diff(ends)
    columns = np.full((left + length, len(group)), _NONE, np.int16)
    shift = left - at - ends[:-1]
    for i, j in slices(ends, _MOST):  # places of all bytes at once would be many times the bytes
        rows = np.repeat(np.arange(i, j), lengths[i:j])
        place = np.arange(ends[i], ends[j]) + np.repeat(shift[i:j], lengths[i:j])
        columns[place, rows] = data[ends[i] : ends[j]]
    found = np.zeros((left + 1, len(group)), bool)
    index = RunLengthIndex(group)
    for c in range(left + length - 1, -1, -1):
        index.step(columns[c])
        if c <= left:
            found[c] = index.statistics() >= length
    return found.T


def _mark(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of contexts that come sorted by key."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < BATCH:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table["key"].to_numpy()
        cut = int(np.argmax(keys == keys[-1]))
        if cut == 0:
            continue
        yield from _mark_table(table.slice(0, cut), length, gram)
        held = table.slice(cut).to_batches()
        count = len(keys) - cut
    if held:
        yield from _mark_table(pa.Table.from_batches(held).combine_chunks(), length, gram)


def _mark_table(table: pa.Table, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    keys = table["key"].to_numpy()
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.cumsum(new)
    begins = np.append(np.flatnonzero(new), len(keys))
    for a in _pieces(begins, BATCH):
        part = table.slice(a[0], a[1] - a[0])
        data, ends = column_bytes(part["context"].combine_chunks())
        at, first, last = (part[n].to_numpy().astype(np.int64) for n in ("at", "first", "last"))
        found = repeated_windows(group[a[0] : a[1]], data, ends, at, length, gram)
        column = np.arange(found.shape[1])
        begin = (length - gram - at)[:, None]
        found &= (column >= begin) & (column <= begin + (last - first)[:, None])
        edge = np.zeros((len(found), found.shape[1] + 1), np.int8)
        edge[:, :-1] = found
        edge[:, 1:] -= found
        rows, starts = np.nonzero(edge == 1)
        stops = np.nonzero(edge == -1)[1] - 1
        shift = first[rows] - begin.ravel()[rows]
        yield pa.record_batch(
            {
                "t": part["t"].combine_chunks().take(pa.array(rows)),
                "first": pa.array((starts + shift).astype(np.int32)),
                "last": pa.array((stops + shift).astype(np.int32)),
            }
        )


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(t, w, d): place and digest of every window of contexts."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            first, last = (part[n].to_numpy().astype(np.int64) for n in ("first", "last"))
            counts = last - first + 1
            digests = [
                hashlib.md5(raw[i : i + length]).digest()
                for raw, n in zip(part["context"].to_pylist(), counts) for i in range(n)
            ]
            rows = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + first[rows]
            yield pa.record_batch(
                {"t": part["t"].take(pa.array(rows)), "w": pa.array(place.astype(np.int32)), "d": pa.array(digests, pa.binary())}
            )


def _counted_windows(contexts: DataFrame, length: int) -> DataFrame:
    """(t, first, last) of windows that occur in more than one of these distinct contexts.

    Equal windows have equal anchors at equal places, so their bytes alone tell them apart.
    """
    windows = contexts.select("t", "first", "last", "context").mapInArrow(
        lambda it: _windows(it, length), "t binary, w int, d binary"
    )
    twice = windows.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
    return windows.join(twice, "d", "left_semi").select("t", F.col("w").alias("first"), F.col("w").alias("last"))


def _pieces(begins: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole groups of about ``most`` rows."""
    at = 0
    while at < len(begins) - 1:
        to = max(at + 1, int(np.searchsorted(begins, begins[at] + most, "right")) - 1)
        yield int(begins[at]), int(begins[to])
        at = to


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.unhex(F.md5(text.cast("binary"))).alias("t"),
        text.alias("text"),
    )


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(t, spans): removed byte ranges ``[start, end)`` of every text that has any, by MD5 of the text.

    A byte is removed when a string of ``length`` bytes that covers it begins anywhere
    else too, in another row or elsewhere in the same one; overlapping places count.
    Texts are judged as they come in, as UTF-8 bytes; null counts as empty; rows with
    equal ids or null ids are rows like any other. Texts shorter than ``length`` and
    empty tables have no spans. Ranges are maximal and in order.
    """
    return _repeated(_keyed(docs, id_col, text_col), length, gram)


def _repeated(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for rows (t, text); ``text`` may be binary and ``t`` is its MD5."""
    parsed = keyed.select("t", "text").mapInArrow(
        lambda it: _parse(it, length, gram),
        "t binary, runs array<struct<h:long,first:int,last:int,anchor:int,c:binary>>",
    )
    # A text that has copies is repeated all over; one of them stands for it below.
    texts = keyed.where(f"octet_length(text) >= {length}").groupBy("t").agg(
        F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("n")
    )
    texts = store(texts, "texts")
    runs = parsed.where("size(runs) > 0").groupBy("t").agg(F.first("runs").alias("runs")).select("t", F.inline("runs"))
    runs = store(runs, "runs")
    counts = store(runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    held = runs.join(counts.where(f"n <= {HOT}").select("h"), "h").select(
        F.col("h").alias("key"), "c", (F.col("anchor") - F.col("first")).alias("at"), "t", "first", "last"
    )
    hot = counts.where(f"n > {HOT}").select("h")
    if not hot.isEmpty():
        hot = hot.toArrow()["h"].to_numpy()  # fewer than one in HOT runs
        finer = keyed.select("t", "text").mapInArrow(
            lambda it: _finer(it, length, gram, hot), "key long, c binary, at int, t binary, first int, last int"
        )
        held = held.union(finer.dropDuplicates(["t", "first"]))  # copies of a text give the same places
    contexts = store(held, "contexts")
    # Contexts are told apart by their MD5s; bytes are read again only for those of shared anchors, equal ones once.
    low = F.min(F.struct("t", "first", "last")).alias("low")
    distinct = store(contexts.groupBy("key", "c", "at").agg(low, F.count("*").alias("n")), "distinct")
    several = distinct.where("n > 1").select("key", "c", "at")
    whole = contexts.join(several, ["key", "c", "at"]).select("t", "first", "last")
    shared = store(distinct.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    places = distinct.select("key", "at", "low.t", "low.first", "low.last")

    def aligned(some: DataFrame) -> DataFrame:
        return _with_text(keyed, some, length).mapInArrow(
            lambda it: _contexts(it, length), "key long, at int, t binary, first int, last int, context binary"
        )

    wide = shared.where(f"n > {WIDE}").select("key")
    counted = None
    if not wide.isEmpty():
        wide = F.broadcast(store(wide, "wide"))  # fewer than one in WIDE contexts
        counted = _counted_windows(store(aligned(places.join(wide, "key")), "wide_contexts"), length)
    marked = (
        aligned(places.join(shared.where(f"n <= {WIDE}").select("key"), "key"))
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(lambda it: _mark(it, length, gram), "t binary, first int, last int")
    )
    found = whole.union(marked)
    if counted is not None:
        found = found.union(counted)
    found = found.join(texts.where("copies = 1").select("t"), "t", "left_semi")
    covered = (
        found.groupBy("t")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("end")))))
        .mapInArrow(_merge, "t binary, spans array<struct<start:int,end:int>>")
    )
    copies = texts.where("copies > 1").select(
        "t", F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end"))).alias("spans")
    )
    return covered.union(copies)


def _with_text(keyed: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(t, text, places) of the texts that have any of the ``places``; a text that has copies comes once."""
    lists = places.groupBy("t").agg(F.collect_list(F.struct("key", "at", "first", "last")).alias("places"))
    once = keyed.where(F.octet_length("text") >= length).groupBy("t").agg(F.first("text").alias("text"))
    return once.join(lists.hint("merge"), "t").select("t", "text", "places")


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with every word replaced by four bytes of its hash."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for i, j in slices(offsets, _MOST):
            start, end = offsets[i], offsets[j]
            hashes, rows = word_hashes(data[start:end], offsets[i : j + 1] - start)
            ends = (np.searchsorted(rows, np.arange(j - i + 1)) * WORD).astype(np.int32)
            coded = (hashes >> U64(32)).astype("<u4")
            symbols = pa.Array.from_buffers(
                pa.binary(), j - i, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(coded.tobytes())]
            )
            yield pa.record_batch({"u": batch.column(0)[i:j], "text": symbols})


def repeated_passages(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(u, spans): ranges ``[start, end)`` of words of every text, by its MD5, that has any.

    A word is in a range when ``words`` words in a row that hold it begin anywhere else
    too. Words are runs of bytes without ASCII white space, judged as they come in; the
    kind of white space between them does not count. Words are told apart by 32 bits of
    a hash, so two passages that differ in one word are taken for equal once in 2^32.
    Null and shorter texts, and empty tables, have no ranges.
    """
    coded = _keyed(docs, id_col, text_col).select(F.col("t").alias("u"), "text")
    coded = store(coded.mapInArrow(_symbols, "u binary, text binary"), "words")
    keyed = coded.withColumn("t", F.unhex(F.md5("text")))
    spans = _repeated(keyed, words * WORD, GRAM)
    spans = spans.select(
        "t",
        F.transform(
            "spans",
            lambda s: F.struct(
                F.ceil(s["start"] / WORD).cast("int").alias("start"), F.floor(s["end"] / WORD).cast("int").alias("end")
            ),
        ).alias("spans"),
    )
    texts = keyed.where(F.octet_length("text") >= words * WORD).select("t", "u").distinct()
    return texts.join(spans, "t").select("u", "spans")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join ranges that overlap or touch; they come in order of their starts."""
    for batch in batches:
        lists = batch.column(1)
        rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        start, end = (lists.flatten().field(n).to_numpy() for n in (0, 1))
        if len(rows):
            end = np.maximum.accumulate(end + (rows << 32)) - (rows << 32)
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (start[1:] > end[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rows)) - 1
        ends = np.searchsorted(rows[first], np.arange(batch.num_rows + 1)).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(end[last].astype(np.int32))], ["start", "end"])
        yield pa.record_batch({"t": batch.column(0), "spans": pa.ListArray.from_arrays(pa.array(ends), spans)})


def _cut(text: str | None, spans) -> bytes:
    raw = (text or "").encode()
    if spans is None:
        return raw
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*out, raw[at:]])


def _cut_words(text: str, spans) -> str:
    """``text`` without ranges of words and the white space after each of them."""
    raw = text.encode()
    starts = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    out, at = [], 0
    for s in spans:
        out.append(raw[at : starts[s["start"]]])
        at = starts[s["end"]]
    return b"".join([*out, raw[at:]]).decode()


def _kept_texts(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([_cut(x, s).decode("utf-8", "ignore") for x, s in zip(texts, spans)], dtype=object)


def _kept_words(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([x if s is None else _cut_words(x, s) for x, s in zip(texts, spans)], dtype=object)


def _kept_digests(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256(_cut(x, s)).hexdigest() for x, s in zip(texts, spans)], dtype=object)


kept_text = F.pandas_udf(_kept_texts, StringType())
kept_words = F.pandas_udf(_kept_words, StringType())
kept_digest = F.pandas_udf(_kept_digests, StringType())


def removal_report(
    docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM, words: int | None = None
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and SHA-256 of the remaining bytes.

    With ``words`` also ``n_passage_words``: words in passages of so many words or more that
    occur elsewhere too (``repeated_passages``). They are counted, not removed.
    """
    spark = docs.sparkSession
    spans = settle(spark, "spans", lambda: repeated_spans(docs, id_col, text_col, length, gram))
    keyed = _keyed(docs, id_col, text_col)
    rows = keyed.select(
        "id", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")
    )
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    counted = spans.select("t", F.size("spans").cast("long").alias("n_spans"), removed.alias("n_removed"))
    rows = rows.join(counted, "t", "left")
    # Only texts that lose a part and keep a part are needed once more.
    partly = rows.where("n_removed < n_bytes").select("t").distinct()
    digests = (
        keyed.select("t", "text")
        .join(spans.join(partly, "t", "left_semi").hint("merge"), "t")
        .select("t", kept_digest("text", "spans").alias("kept"))
    )
    empty = hashlib.sha256(b"").hexdigest()
    more = []
    if words:
        found = settle(spark, "passages", lambda: repeated_passages(docs, id_col, text_col, words))
        rows = rows.join(found.select(F.col("u").alias("t"), removed.alias("n")), "t", "left")
        more = [F.coalesce("n", F.lit(0).cast("long")).alias("n_passage_words")]
    return rows.join(digests, "t", "left").select(
        "id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.when(F.col("n_removed") == F.col("n_bytes"), empty).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        *more,
    )


def _without(docs: DataFrame, text_col: str, spans: DataFrame, cut) -> DataFrame:
    """``docs`` with what ``cut`` leaves of the texts that have ``spans`` (u, spans).

    A row travels as one struct, so no column of the table can clash with a helper.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("u"))
    text = F.col(f"row.`{text_col}`")
    kept = F.when(F.col("spans").isNull() | text.isNull(), text).otherwise(cut(text.cast("string"), F.col("spans")))
    columns = [(kept if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return rows.join(spans, "u", "left").select(columns)


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated strings cut out of the texts; all rows and columns stay.

    A character that loses some of its bytes goes as a whole. Null texts stay null.
    """
    spans = settle(
        docs.sparkSession, "spans", lambda: repeated_spans(docs, id_col, text_col, length, gram).withColumnRenamed("t", "u")
    )
    return _without(docs, text_col, spans, kept_text)


def remove_passages(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """``docs`` without passages of ``words`` or more words that occur more than once; all rows and columns stay.

    All occurrences go, with the white space after them; see ``repeated_passages``. Null texts stay null.
    """
    found = settle(docs.sparkSession, "passages", lambda: repeated_passages(docs, id_col, text_col, words))
    return _without(docs, text_col, found, kept_words)
