"""Benchmark passages in documents, by greedy string tiling.

Words are runs of letters and digits, in lower case. Runs of ``least`` words that a
document and a benchmark item share (found by running Karp-Rabin hashes and an
equality join on them) are the seeds. Neighbouring seeds on one diagonal make
maximal matches; the longest match of words that no tile covers yet becomes a tile,
again and again, until none of ``least`` words is left. The share of an item's words
under tiles is its coverage; as tiles may lie in any order, moved sentences are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.buffers import U64, column_bytes, mix, prefix_sums, slices
from tagloom.llm.letters import code_points, word_bounds
from tagloom.workspace import store

LEAST = 5  # words of a tile
COVERAGE = 0.5
#: Words under tiles that are enough, however long the item.
WORDS = 50
#: Largest benchmark, in bytes of text, that is sent whole to every task.
BROADCAST_BYTES = 16 << 20
FOUND = "item_id long, item_words int, matched_words int, n_tiles int, coverage double"


def word_sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row, and the rows' offsets among them."""
    points, ends = code_points(data, offsets)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    points, first, last, row = word_bounds(points, ends, numbers=True)
    sums, down = prefix_sums(mix(points.astype(np.uint64) + U64(0x2545F491)))
    hashes = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(row, np.arange(len(offsets)))


def running_hashes(words: np.ndarray, least: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``least`` words."""
    if len(words) < least:
        return np.zeros(0, np.uint64)
    sums, down = prefix_sums(words)
    return mix((sums[least:] - sums[:-least]) * down[: len(words) - least + 1])


def tiles(doc_at: np.ndarray, item_at: np.ndarray, doc_words: int, item_words: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in document, place in item, words) from the places of shared seeds.

    Of equally long matches the one earlier in the document goes first, then the one
    earlier in the item.
    """
    order = np.lexsort((doc_at, doc_at - item_at))
    doc_at, item_at = doc_at[order], item_at[order]
    new = np.ones(len(doc_at), bool)
    new[1:] = (np.diff(doc_at) != 1) | (np.diff(doc_at - item_at) != 0)
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(doc_at))) + least - 1
    heap = [(-int(n), int(doc_at[k]), int(item_at[k])) for n, k in zip(sizes, first)]
    heapify(heap)
    used_doc: set[int] = set()
    used_item = np.zeros(item_words, bool)
    found = []
    while heap:
        n, i, j = heappop(heap)
        n = -n
        free = [not used_item[j + k] and (i + k) not in used_doc for k in range(n)]
        if all(free):
            found.append((i, j, n))
            used_item[j : j + n] = True
            used_doc.update(range(i, i + n))
            continue
        k = 0
        while k < n:  # what is free of it competes again
            if not free[k]:
                k += 1
                continue
            end = k
            while end < n and free[end]:
                end += 1
            if end - k >= least:
                heappush(heap, (k - end, i + k, j + k))
            k = end
    return found


@dataclass(frozen=True)
class Benchmark:
    """Items' words and the places of their seeds, sorted by seed."""

    ids: np.ndarray
    sizes: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    #: Words -> sorted seeds and items of items that have no more: these match as one whole run.
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: list[int], texts: list[str | None], least: int) -> Benchmark:
        raw = [(x or "").encode() for x in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        words, ends = word_sequences(data, offsets)
        parts = [running_hashes(words[a:b], least) for a, b in zip(ends[:-1], ends[1:])]
        counts = [len(x) for x in parts]
        seeds = np.concatenate([*parts, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(ids)), counts)
        place = np.concatenate([*(np.arange(n) for n in counts), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(seeds, kind="stable")
        sizes, short = np.diff(ends), {}
        for size in range(1, least):
            few = np.flatnonzero(sizes == size)
            if len(few):
                whole = np.array([running_hashes(words[ends[n] : ends[n + 1]], size)[0] for n in few], np.uint64)
                by = np.argsort(whole, kind="stable")
                short[size] = whole[by], few[by]
        return Benchmark(np.array(ids, np.int64), sizes, seeds[order], item[order], place[order], short)


def _runs_inside(words: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and row of every run of ``size`` words inside a row."""
    runs = running_hashes(words, size)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    inside = np.flatnonzero(row[: len(runs)] == row[size - 1 :]) if len(runs) else np.zeros(0, np.int64)
    return runs[inside], inside, row[inside]


def _shared(runs: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair (run, seed) of equal hashes; ``seeds`` are sorted."""
    low = np.searchsorted(seeds, runs, "left")
    hit = np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == runs)
    times = np.searchsorted(seeds, runs[hit], "right") - low[hit]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(hit, times), np.repeat(low[hit], times) + nth


def _short_matches(words: np.ndarray, ends: np.ndarray, bench: Benchmark):
    """The same as ``_matches`` for items of fewer words than a seed: their first place in each row."""
    for size, (seeds, items) in bench.short.items():
        runs, at, row = _runs_inside(words, ends, size)
        run, seed = _shared(runs, seeds)
        _, first = np.unique(np.stack([row[run], items[seed]]), axis=1, return_index=True)
        for k in first:
            r = int(row[run[k]])
            yield r, int(items[seed[k]]), [(int(at[run[k]] - ends[r]), 0, size)]


def _matches(words: np.ndarray, ends: np.ndarray, bench: Benchmark, least: int):
    """(row, item, tiles) of every row and item that share a seed."""
    yield from _short_matches(words, ends, bench)
    if not len(bench.seeds):
        return
    runs, inside, row = _runs_inside(words, ends, least)
    run, seed = _shared(runs, bench.seeds)
    at, rows = inside[run], row[run]
    items, places = bench.item[seed], bench.place[seed]
    order = np.lexsort((items, rows))
    rows, items, places, at = rows[order], items[order], places[order], at[order]
    first = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(items, prepend=-1) != 0))
    for a, b in zip(first, np.append(first[1:], len(rows))):
        r, i = int(rows[a]), int(items[a])
        begin = ends[r]
        yield r, i, tiles(at[a:b] - begin, places[a:b], int(ends[r + 1] - begin), int(bench.sizes[i]), least)


def _tile(batches: Iterator[pa.RecordBatch], bench: Benchmark, least: int, coverage: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for i, j in slices(offsets):
            words, ends = word_sequences(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out = []
            for row, item, found in _matches(words, ends, bench, least):
                matched, size = sum(n for _, _, n in found), int(bench.sizes[item])
                if matched >= min(coverage * size - 1e-9, WORDS):
                    out.append((i + row, int(bench.ids[item]), size, matched, len(found), matched / size))
            if out:
                yield _found_batch(batch, out)


def _found_batch(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
    rows, *columns = zip(*out)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    names = ("item_id", "item_words", "matched_words", "n_tiles", "coverage")
    return pa.record_batch(
        {batch.schema.names[0]: batch.column(0).take(pa.array(rows))}
        | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)}
    )


def _seeds(batches: Iterator[pa.RecordBatch], least: int, short: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Distinct seeds of every row, and runs of the ``short`` sizes; without these, a shorter row gives one run of all its words."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for i, j in slices(offsets):
            words, ends = word_sequences(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            found = []
            for size in (*(range(1, least) if short is None else short), least):
                runs, _, row = _runs_inside(words, ends, size)
                if short is None and size < least:
                    whole = np.diff(ends)[row] == size
                    runs, row = runs[whole], row[whole]
                found.append(np.stack([row.astype(np.uint64), runs + U64(least - size)]))
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.record_batch(
                {
                    batch.schema.names[0]: batch.column(0)[i:j].take(pa.array(both[0].astype(np.int64))),
                    "seed": pa.array(both[1].astype(np.int64)),
                }
            )


def _sizes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Numbers of words below ``least`` that occur."""
    for batch in batches:
        sizes = np.diff(word_sequences(*column_bytes(batch.column(0)))[1])
        yield pa.record_batch({"size": pa.array(np.unique(sizes[(sizes > 0) & (sizes < least)]).astype(np.int32))})


def _tile_pairs(batches: Iterator[pa.RecordBatch], least: int, coverage: float) -> Iterator[pa.RecordBatch]:
    """Rows (text key, text, item, its text): the tiles of each pair."""
    for batch in batches:
        out = []
        for n in range(batch.num_rows):
            item = int(batch.column(2)[n].as_py())
            bench = Benchmark.of([item], [batch.column(3)[n].as_py()], least)
            data, offsets = column_bytes(batch.column(1).slice(n, 1))
            for _, _, found in _matches(*word_sequences(data, offsets), bench, least):
                matched, size = sum(t[2] for t in found), int(bench.sizes[0])
                if matched >= min(coverage * size - 1e-9, WORDS):
                    out.append((n, item, size, matched, len(found), matched / size))
        if out:
            yield _found_batch(batch, out)


def leaks(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    benchmark: DataFrame,
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = LEAST,
    coverage: float = COVERAGE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, item_id, item_words, matched_words, n_tiles, coverage) of documents that hold benchmark items.

    A row for every document and item with a coverage of at least ``coverage``, or with
    ``WORDS`` words under tiles. An item of fewer than ``least`` words matches as one
    whole run. Null and empty texts share nothing. Documents with null or repeated ids
    give rows like any other; items with equal ids, also with equal texts, are items of
    their own, items with a null id are left out. Empty tables give no rows.

    A benchmark of up to ``broadcast_bytes`` bytes goes to all tasks and documents are
    read once, without an exchange. A larger one meets the documents' seeds in a
    join, and only documents that share a seed are exchanged.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("item_text")
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("item_text") + 16)).first()[0] or 0
    if size <= broadcast_bytes:
        held = items.orderBy("item_id", "item_text").collect()
        bench = docs.sparkSession.sparkContext.broadcast(
            Benchmark.of([r.item_id for r in held], [r.item_text for r in held], least)
        )
        return rows.mapInArrow(lambda it: _tile(it, bench.value, least, coverage), f"id long, {FOUND}")
    # Equal texts have equal tiles: work by text, then give each row those of its text.
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    keyed = rows.withColumn("t", key)
    seeds = items.withColumn("n", F.monotonically_increasing_id())
    seeds = store(seeds, "items")
    sought = seeds.select("n", "item_text").mapInArrow(lambda it: _seeds(it, least), "n long, seed long").distinct()
    texts = keyed.groupBy("t").agg(F.min(F.coalesce("id", F.expr("-9223372036854775808L"))).alias("k"))
    first = keyed.withColumn("k", F.coalesce("id", F.expr("-9223372036854775808L"))).join(texts, ["t", "k"], "left_semi")
    sizes = seeds.select("item_text").mapInArrow(lambda it: _sizes(it, least), "size int").distinct()
    short = sorted(r.size for r in sizes.collect())  # fewer than ``least`` numbers
    own = first.select("t", "text").mapInArrow(lambda it: _seeds(it, least, short), "t binary, seed long")
    pairs = store(own.join(sought, "seed").select("t", "n").distinct(), "pairs")
    found = (
        first.select("t", "text")
        .join(pairs, "t")
        .join(seeds, "n")
        .select("t", "text", "n", "item_text")
        .mapInArrow(lambda it: _tile_pairs(it, least, coverage), f"t binary, {FOUND}")
        .withColumnRenamed("item_id", "n")
        .dropDuplicates(["t", "n"])  # a document that repeats both id and text comes twice
        .join(seeds.select("n", "item_id"), "n")
    )
    columns = ["item_id", "item_words", "matched_words", "n_tiles", "coverage"]
    return keyed.select("id", "t").join(found, "t").select("id", *columns)
