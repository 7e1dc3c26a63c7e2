"""Near-duplicate documents by DartMinHash signatures, banded links and exact checks.

DartMinHash (Christiani, 2020): every element owns a fixed random set of darts in
the plane weight x rank. A document of total weight ``W`` throws the darts of its
elements with weight coordinate up to the element's weight and rank up to about
``k log k / W``; each dart belongs to one of ``k`` coordinates, and the dart of least
rank in a coordinate is its signature there. Two documents agree in a coordinate
with the probability of their weighted Jaccard similarity, and the work is
O(elements + k log k) instead of O(k * elements).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tagloom.llm.buffers import U64, column_bytes, grams, mix, slices, unit, word_hashes
from tagloom.llm.components import components
from tagloom.workspace import store

SIZE = 5  # words of a shingle
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: Expected darts of a document for each coordinate; more are thrown if a coordinate stays empty.
DARTS = float(np.log(COORDINATES) + 3.0)
#: Signatures of pairs at the threshold agree in a share of coordinates with a deviation of
#: sqrt(0.8 * 0.2 / 192) = 0.029; a share lower by seven deviations rules a pair out.
RULED_OUT = 7.0
#: Rows of a bucket that are joined with each other, and of a block compared in one task.
FEW, BLOCK = 12, 512

# Rank cells: [0, 1/4), [1/4, 1), [1, 4), ... ; weight cells: [0, 1), [1, 2), [2, 4), ...
_RANK_EDGES = np.concatenate([[0.0], 0.25 * 4.0 ** np.arange(40)])
_WEIGHT_EDGES = np.concatenate([[0.0], 2.0 ** np.arange(50)])
_CDF: dict[float, np.ndarray] = {}


def _poisson(mean: float, u: np.ndarray) -> np.ndarray:
    """Poisson counts from uniform numbers; a large mean is rounded from the normal law."""
    if mean > 4096:
        from statistics import NormalDist

        quantile = np.vectorize(NormalDist().inv_cdf)
        return np.maximum(0, np.rint(mean + np.sqrt(mean) * quantile(np.clip(u, 1e-12, 1 - 1e-12)))).astype(np.int64)
    if mean not in _CDF:
        k = np.arange(int(mean + 12 * np.sqrt(mean) + 20))
        logs = np.cumsum(np.log(np.maximum(k, 1)))
        _CDF[mean] = np.cumsum(np.exp(k * np.log(mean) - mean - logs))
    return np.searchsorted(_CDF[mean], u, "right")


def dart_signatures(
    rows: np.ndarray, items: np.ndarray, weights: np.ndarray, n_rows: int, k: int = COORDINATES, darts: float = DARTS
) -> np.ndarray:
    """(n_rows, k) signature of weighted sets given as (row, item hash, positive weight).

    An item occurs once in a row. Rows without items get zeros. Two rows agree in a
    coordinate with the probability of their weighted Jaccard similarity.
    """
    best = np.full(n_rows * k, np.inf)
    out = np.zeros(n_rows * k, np.uint64)
    totals = np.bincount(rows, weights, n_rows)
    limit = np.where(totals > 0, darts * k / np.maximum(totals, 1e-300), 0.0)
    low = np.zeros(n_rows)
    pending = totals > 0
    while pending.any():
        chosen = pending[rows]
        _throw(rows[chosen], items[chosen], weights[chosen], low, limit, k, best, out)
        empty = np.isinf(best.reshape(n_rows, k)).any(axis=1)
        pending &= empty
        low, limit = np.where(pending, limit, low), np.where(pending, 2 * limit, limit)
    return out.reshape(n_rows, k)


def _throw(rows, items, weights, low, limit, k, best, out) -> None:
    """Throw the darts with ranks from ``low`` to below ``limit`` and keep the earliest."""
    if not len(rows):
        return
    lo, hi = low[rows], limit[rows]
    for nu in range(int(np.searchsorted(_WEIGHT_EDGES, weights.max(), "left"))):
        wide = weights > _WEIGHT_EDGES[nu]
        w0, w1 = _WEIGHT_EDGES[nu], _WEIGHT_EDGES[nu + 1]
        for rho in range(int(np.searchsorted(_RANK_EDGES, hi.max(), "left"))):
            r0, r1 = _RANK_EDGES[rho], _RANK_EDGES[rho + 1]
            at = np.flatnonzero(wide & (hi > r0) & (lo < r1))
            if not len(at):
                continue
            cell = mix(items[at] ^ U64((nu * 64 + rho + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1)))
            counts = _poisson((w1 - w0) * (r1 - r0), unit(cell))
            at, cell = np.repeat(at, counts), np.repeat(cell, counts)
            ends = np.cumsum(counts)
            nth = np.arange(len(at)) - np.repeat(ends - counts, counts)
            dart = mix(cell + (nth.astype(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15))
            rank = r0 + (r1 - r0) * unit(dart)
            kept = (rank >= lo[at]) & (rank < hi[at])
            if w1 > 1.0 or weights[at].min(initial=1.0) < 1.0:
                kept &= w0 + (w1 - w0) * unit(mix(dart ^ U64(0xA0761D6478BD642F))) < weights[at]
            dart, rank = dart[kept], rank[kept]
            key = rows[at[kept]] * k + (mix(dart ^ U64(0xE7037ED1A0B428DB)) % U64(k)).astype(np.int64)
            np.minimum.at(best, key, rank)
            won = best[key] == rank
            out[key[won]] = dart[won]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every row, sorted by row: (row, hash, times it occurs)."""
    hashes, rows = word_hashes(data, offsets)
    items, rows, _ = grams(hashes, rows, size, short=True)
    order = np.lexsort((items, rows))
    items, rows = items[order], rows[order]
    new = np.concatenate([[True], (items[1:] != items[:-1]) | (rows[1:] != rows[:-1])]) if len(items) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return rows[at], items[at], np.diff(np.append(at, len(items)))


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for j in range(parts.shape[2]):
        keys = mix(keys ^ parts[:, :, j]) + U64(j)
    return keys


def _sketches(batches: Iterator[pa.RecordBatch], counted: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for i, j in slices(offsets):
            cut = offsets[i : j + 1] - offsets[i]
            rows, items, times = shingle_sets(data[offsets[i] : offsets[j]], cut)
            weights = times.astype(np.float64) if counted else np.ones(len(times))
            signature = dart_signatures(rows, items, weights, j - i)
            bands = band_keys(signature).astype(np.int64)
            # The bag of shingles: equal for texts that differ in white space alone.
            digest = np.zeros((j - i, 2), np.uint64)
            for c in (0, 1):
                np.add.at(digest[:, c], rows, mix(items ^ U64(c + 77)) * (times.astype(np.uint64) if counted else U64(1)))
            sizes = np.bincount(rows, weights, j - i)
            yield pa.record_batch(
                {
                    "id": batch.column(0)[i:j],
                    "size": pa.array(sizes.astype(np.float64)),
                    "d0": pa.array(digest[:, 0].astype(np.int64)),
                    "d1": pa.array(digest[:, 1].astype(np.int64)),
                    "sig": _binary((signature >> U64(48)).astype(np.uint16)),
                    "bands": pa.ListArray.from_arrays(
                        pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())
                    ),
                }
            )


def _binary(rows: np.ndarray) -> pa.Array:
    """Equal rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def sketches(docs: DataFrame, id_col: str, text_col: str, counted: bool = False) -> DataFrame:
    """One row a document: id, total weight, shingle digest, signature and band keys."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lambda it: _sketches(it, counted),
        "id long, size double, d0 long, d1 long, sig binary, bands array<long>",
    )


def _sets(batches: Iterator[pa.RecordBatch], counted: bool) -> Iterator[pa.RecordBatch]:
    """Sorted shingle hashes as binary values; with ``counted`` each occurrence of a shingle is an element.

    Rows come sorted by id out of a join; repeated rows of an id are left out.
    """
    current, seen = None, set()
    for batch in batches:
        new = []
        for n, (i, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
            if i != current:
                current, seen = i, set()
            digest = hashlib.md5((text.as_py() or "").encode()).digest()
            if digest not in seen:
                seen.add(digest)
                new.append(n)
        batch = batch.take(pa.array(new, pa.int64()))
        data, offsets = column_bytes(batch.column(1))
        for i, j in slices(offsets):
            rows, items, times = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if counted:
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                rows, items = np.repeat(rows, times), np.repeat(items, times)
                items = np.where(nth > 0, mix(items + nth.astype(np.uint64)), items)
                order = np.lexsort((items, rows))
                rows, items = rows[order], items[order]
            ends = np.searchsorted(rows, np.arange(j - i + 1)).astype(np.int32)
            yield pa.record_batch({"id": batch.column(0)[i:j], "items": _ragged(items, ends)})


def _ragged(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of sorted shingle sets."""
    out = np.zeros(len(a))
    for n, (x, y) in enumerate(zip(a, b)):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out[n] = both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0
    return pd.Series(out)


def _agreements(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal coordinates of signatures."""
    if not len(a):
        return pd.Series([], dtype=float)
    x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(len(a), -1)
    return pd.Series((x == y).mean(axis=1))


_jaccard = F.pandas_udf(_similarities, DoubleType())
_agreement = F.pandas_udf(_agreements, DoubleType())


def _least_agreement(threshold: float) -> float:
    return threshold - RULED_OUT * float(np.sqrt(threshold * (1 - threshold) / COORDINATES))


def _ends(pairs: DataFrame) -> DataFrame:
    """Ids in pairs; as many as the input has for all that is known, so they are never broadcast."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return ids.hint("shuffle_merge")


def _plausible(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures and sizes do not rule the threshold out."""
    sigs = sigs.join(_ends(pairs), "id", "left_semi").dropDuplicates(["id", "sig"])
    a = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("size").alias("na"))
    b = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("size").alias("nb"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
        .where(_agreement("sa", "sb") >= _least_agreement(threshold))
        .select("a", "b")
        .distinct()
    )


def _shingled(docs: DataFrame, ids: DataFrame, counted: bool) -> DataFrame:
    """(id, items) of some documents."""
    return docs.join(ids, "id", "left_semi").mapInArrow(lambda it: _sets(it, counted), "id long, items binary")


def _checked(pairs: DataFrame, docs: DataFrame, threshold: float, counted: bool) -> DataFrame:
    """Pairs whose exact similarity reaches the threshold."""
    sets = store(_shingled(docs, _ends(pairs), counted), "shingles")
    a = sets.select(F.col("id").alias("a"), F.col("items").alias("ia"))
    b = sets.select(F.col("id").alias("b"), F.col("items").alias("ib"))
    return pairs.join(a, "a").join(b, "b").where(_jaccard("ia", "ib") >= threshold - 1e-12).select("a", "b")


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: a product of incidence matrices.

    Elements of one set alone are left out; the others are taken some at a time.
    """
    sizes = [len(x) for x in sets]
    items, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    place = np.cumsum(counts > 1) - 1
    shared = counts[inverse] > 1
    row, column = row[shared], place[inverse[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (begin, begin + columns))
        held = np.zeros((len(sets), columns), np.float32)
        held[row[a:b], column[a:b] - begin] = 1
        out += held @ held.T
    return out


def _block_links(table: pa.Table, threshold: float) -> pa.Table:
    """Links that join components between two blocks of one bucket, by exact similarity.

    Of links between the same two components one is enough, so there are fewer links
    than rows.
    """
    ids, comps = table["id"].to_numpy(), table["comp"].to_numpy()
    left, right = (table[n].to_numpy(zero_copy_only=False) for n in ("left", "right"))
    sets = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
    sizes = np.array([len(x) for x in sets], np.float32)
    both = intersections(sets)
    close = both >= (threshold - 1e-6) * (sizes[:, None] + sizes[None, :] - both)
    _, root = np.unique(comps, return_inverse=True)
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(left):
        other = np.flatnonzero(close[i] & right & (root != root[i]))
        for j in other[np.unique(root[other], return_index=True)[1]]:
            found.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
        if len(other):
            root[np.isin(root, root[other])] = root[i]
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_groups(
    docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, counted: bool = False
) -> DataFrame:
    """(id, class_id, n_links): the class of every document under near-duplicate links.

    Two documents are linked when the Jaccard similarity of their sets of five-word
    shingles (``counted``: of the bags of them) is at least ``threshold``; a class is a
    connected component, named by its least id. ``n_links`` counts the different texts
    a text was found linked to before its class was closed. Words are separated by
    ASCII white space; a text of one to four words is one shingle.

    Null and empty texts and texts of white space have no shingles and stay alone, each
    in its own class. Rows that repeat an id count as one document when their texts
    are alike, and link their classes when not. Rows with a null id keep a null class.
    Other columns of ``docs`` do not matter. An empty table gives no rows.

    Copies (equal shingle sets) collapse to one representative first. In every band
    bucket all representatives are compared with two leaders, so a bucket of any
    size gives two pairs a row; only buckets that are left with different components
    are compared row with row, larger ones in blocks that give links and no pairs.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = store(sketches(docs, "id", "text", counted), "sketches")
    named = sketch.where("id IS NOT NULL")
    filled = named.where("size > 0")
    firsts = filled.groupBy("d0", "d1").agg(F.min("id").alias("rep"))
    members = store(filled.select("id", "d0", "d1").join(firsts, ["d0", "d1"]).select("id", "rep").distinct(), "members")
    reps = filled.join(firsts.select("d0", "d1", F.col("rep").alias("id")), ["d0", "d1", "id"], "left_semi")
    reps = store(reps.select("id", "size", "sig", "bands"), "representatives")
    sigs = reps.select("id", "size", "sig")

    rows = reps.select("id", F.posexplode("bands").alias("band", "key"))
    leaders = rows.groupBy("band", "key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    buckets = store(rows.join(leaders, ["band", "key"]), "buckets")
    pairs = (
        buckets.select(F.col("id").alias("a"), F.explode(F.array("low", "high")).alias("b"))
        .where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    tried = store(_plausible(store(pairs, "pairs"), sigs, threshold), "pairs")
    links = store(_checked(tried, docs, threshold, counted), "checked")

    # Rows of a bucket that the leaders did not bring together.
    comps = components(links.select("a", "b"))
    apart = (
        buckets.select("band", "key", "id")
        .join(comps, "id", "left")
        .select("band", "key", "id", F.coalesce("component", "id").alias("comp"))
    )
    mixed = (
        apart.groupBy("band", "key")
        .agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n"))
        .where("c0 <> c1 AND n > 2")
        .select("band", "key", "n")
    )
    apart = store(apart.join(mixed, ["band", "key"]), "apart")
    small = apart.where(f"n <= {FEW}")
    other = small.select("band", "key", F.col("id").alias("b"), F.col("comp").alias("comp_b"))
    rest = (
        small.withColumnRenamed("id", "a").join(other, ["band", "key"]).where("a < b AND comp <> comp_b").select("a", "b")
    )
    rest = _plausible(store(rest.distinct(), "pairs"), sigs, threshold)
    rest = store(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.union(_checked(rest, docs, threshold, counted))
    # Larger buckets in blocks; a pair inside one block or across two is seen once there.
    wide = apart.where(f"n > {FEW}")
    blocks = (
        wide.join(_shingled(docs, wide.select("id").distinct().hint("shuffle_merge"), counted), "id")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) AS int)"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "band", "key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
            "id", "comp", "items",
            (F.col("own") <= F.col("with")).alias("left"), (F.col("own") >= F.col("with")).alias("right"),
        )
    )
    far = blocks.groupBy("band", "key", "i", "j").applyInArrow(
        lambda table: _block_links(table, threshold), "a long, b long"
    )
    links = store(links.union(far.distinct()), "checked")

    ends = links.select(F.col("a").alias("rep"), "b").union(links.select(F.col("b").alias("rep"), F.col("a").alias("b")))
    degree = ends.groupBy("rep").agg(F.countDistinct("b").alias("n_links"))
    # Representatives that share an id link their classes as well.
    closed = components(links.select("a", "b").union(members.select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    found = (
        members.join(degree, "rep", "left")
        .groupBy("id")
        .agg(F.coalesce(F.max("n_links"), F.lit(0)).alias("n_links"))
        .join(closed, "id", "left")
    )
    return (
        sketch.select("id")
        .distinct()
        .join(found, "id", "left")
        .select("id", F.coalesce("component", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
