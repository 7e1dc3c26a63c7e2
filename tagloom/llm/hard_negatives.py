"""Hard negatives by an inverted multi-index over the two halves of vectors.

Each half space has a codebook; a pair of codewords is a cell. The inner product of an
anchor with any vector of a cell is at most the sum of two half bounds: the product with
the codeword, plus the length of the anchor's half times the radius of the codeword. A
multi-sequence heap visits cells by falling sums. A search stops when the next sum can
no longer change its answer, so answers are exact whatever the codebooks are.

Cells are dealt to shards of about ``SHARD_ROWS`` rows (a large cell to several). A task
holds one shard and streams the anchors that may find something there: first those whose
best shard it is, then, with what that gave as a floor, those whose bound reaches it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.workspace import store

SHARD_ROWS = 65_536
#: Codewords of a half at most, rows a cell should hold, and rows and numbers in the fitted sample at most.
CODES = 32
CELL_ROWS = 64
SAMPLE_ROWS = 20_000
SAMPLE_NUMBERS = 1 << 22
#: Rows scored at once by a search; each step doubles it.
FIRST_STEP, LAST_STEP = 512, 16_384
_EXACT = 2.0**53


def fit_codebook(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most ``codes`` groups of the points (Lloyd's rounds from a fixed random start)."""
    centres = np.unique(points, axis=0)
    if len(centres) > codes:
        centres = centres[np.sort(np.random.default_rng(20260711).choice(len(centres), codes, replace=False))]
    for _ in range(rounds):
        code, _ = nearest_code(points, centres)
        count = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest_code(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every point, and the distance from it."""
    square = (centres * centres).sum(axis=1)
    code = (square - 2 * points @ centres.T).argmin(axis=1)
    return code, np.sqrt(((points - centres[code]) ** 2).sum(axis=1))


def products(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where that is exact."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(anchor).max(initial=0)) * len(anchor)
    if most < _EXACT:
        return (vectors.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return (vectors * anchor).sum(axis=1)


class CellIndex:
    """Rows of one shard by cell."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codes: np.ndarray, books: list[np.ndarray]) -> None:
        order = np.lexsort((ids, codes[:, 1], codes[:, 0]))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        codes = codes[order]
        self.half = books[0].shape[1]
        self.centres, self.radii, at = [], [], []
        for n, part in enumerate((slice(0, self.half), slice(self.half, None))):
            present, place = np.unique(codes[:, n], return_inverse=True)
            centres = books[n][present]
            away = np.sqrt(((self.vectors[:, part] - centres[place]) ** 2).sum(axis=1))
            radius = np.zeros(len(present))
            np.maximum.at(radius, place, away)
            self.centres.append(centres)
            self.radii.append(radius)
            at.append(place)
        cell = at[0] * len(self.centres[1]) + at[1]
        begin = np.flatnonzero(np.diff(cell, prepend=-1))
        self.begin = dict(zip(cell[begin].tolist(), begin.tolist()))
        self.end = dict(zip(cell[begin].tolist(), np.append(begin[1:], len(cell)).tolist()))

    def half_bounds(self, anchor: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half the codewords by falling bounds, and the bounds."""
        orders, sums = [], []
        for part, centres, radius in zip((anchor[: self.half], anchor[self.half :]), self.centres, self.radii):
            part = part.astype(np.float64)
            bound = centres @ part + np.sqrt((part * part).sum()) * radius
            bound += 1e-9 * (np.abs(centres) @ np.abs(part) + np.abs(bound)) + 1e-6  # rounding
            order = np.argsort(-bound, kind="stable")
            orders.append(order)
            sums.append(bound[order])
        return orders, sums

    def visits(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Rows of the next cells, and the highest sum of all cells after them."""
        (first, second), (a, b) = self.half_bounds(anchor)
        width = len(self.centres[1])
        heap = [(-(a[0] + b[0]), 0, 0)]
        popped: set[tuple[int, int]] = set()
        rows: list[np.ndarray] = []
        size, step = 0, FIRST_STEP
        while heap:
            _, i, j = heapq.heappop(heap)
            popped.add((i, j))
            if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in popped):
                heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))
            if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in popped):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            cell = int(first[i]) * width + int(second[j])
            if cell in self.begin:
                rows.append(np.arange(self.begin[cell], self.end[cell]))
                size += len(rows[-1])
            if size >= step or not heap:
                if rows:
                    yield np.concatenate(rows), -heap[0][0] if heap else -np.inf
                rows, size, step = [], 0, min(2 * step, LAST_STEP)

    def best(self, rows: np.ndarray, scores: np.ndarray, held: tuple[np.ndarray, np.ndarray], k: int):
        """The first ``k`` of held and new (scores, ids)."""
        if len(held[0]) == k:
            keep = scores >= held[0][-1]
            rows, scores = rows[keep], scores[keep]
        score, ids = np.concatenate([held[0], scores]), np.concatenate([held[1], self.ids[rows]])
        order = np.lexsort((ids, -score))[:k]
        return score[order], ids[order]

    def positives(self, own: int, label: int, anchor: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First ``k`` rows of the label among those that score at least ``floor``."""
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rows, after in self.visits(anchor):
            rows = rows[(self.labels[rows] == label) & (self.ids[rows] != own)]
            held = self.best(rows, products(self.vectors[rows], anchor), held, k)
            if after < floor or (len(held[0]) == k and after < held[0][-1]):
                break
        return held

    def windows(self, own: int, label: int, anchor: np.ndarray, targets: list[int], low: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each target the first ``k`` rows of other labels from ``low`` percent of it up to it."""
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in targets]
        open_ = set(range(len(targets)))
        for rows, after in self.visits(anchor):
            rows = rows[(self.labels[rows] != label) & (self.ids[rows] != own)]
            scores = products(self.vectors[rows], anchor)
            for n in list(open_):
                inside = (100 * scores >= low * targets[n]) & (scores <= targets[n])
                held[n] = self.best(rows[inside], scores[inside], held[n], k)
                if 100 * after < low * targets[n] or (len(held[n][0]) == k and after < held[n][0][-1]):
                    open_.discard(n)
            if not open_:
                break
        return held


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(rows, -1)


def _filed(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Add codes and distances of both halves to (id, label, vec)."""
    half = books[0].shape[1]
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = _matrix(batch.column(2), batch.num_rows).astype(np.float64)
        added = {}
        for n, part in enumerate((vectors[:, :half], vectors[:, half:])):
            code, away = nearest_code(part, books[n])
            added |= {f"c{n}": pa.array(code.astype(np.int32)), f"d{n}": pa.array(away)}
        yield pa.record_batch({n: batch.column(n) for n in batch.schema.names} | added)


class Shards:
    """Which cells a shard holds, and the radius of every codeword."""

    def __init__(self, cells: list[tuple[int, int, int]], books: list[np.ndarray], radii: list[np.ndarray]) -> None:
        self.books, self.radii = books, radii
        self.rows: list[tuple[int, int, int, int]] = []  # c0, c1, first shard, number of shards
        shard, filled = 0, 0
        for c0, c1, n in sorted(cells):
            if filled and filled + n > SHARD_ROWS:
                shard, filled = shard + 1, 0
            parts = -(-n // SHARD_ROWS)
            self.rows.append((c0, c1, shard, parts))
            shard, filled = (shard, filled + n) if parts == 1 else (shard + parts, 0)
        self.count = shard + bool(filled)
        cell, place = [], []
        for n, (_, _, first, parts) in enumerate(self.rows):
            cell += [n] * parts
            place += range(first, first + parts)
        self.cell, self.place = np.array(cell, np.int64), np.array(place, np.int64)

    def bounds(self, anchors: np.ndarray) -> np.ndarray:
        """Highest possible score of every anchor in every shard."""
        half = self.books[0].shape[1]
        sums = []
        for part, book, radius in zip((anchors[:, :half], anchors[:, half:]), self.books, self.radii):
            part = part.astype(np.float64)
            bound = part @ book.T + np.sqrt((part * part).sum(axis=1))[:, None] * radius
            sums.append(bound + 1e-9 * (np.abs(part) @ np.abs(book).T + np.abs(bound)) + 1e-6)
        codes = np.array([r[:2] for r in self.rows])
        cells = sums[0][:, codes[:, 0]] + sums[1][:, codes[:, 1]]
        out = np.full((len(anchors), self.count), -np.inf)
        np.maximum.at(out.T, self.place, cells.T[self.cell])
        return out


def _asked(batches: Iterator[pa.RecordBatch], shards: Shards, which: str) -> Iterator[pa.RecordBatch]:
    """A row for each anchor and shard to search: the best one, the others, or all; only those that reach the floor."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            bounds = shards.bounds(_matrix(part.column("vec"), part.num_rows))
            floor = part.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
            best = bounds.argmax(axis=1)
            wanted = bounds >= floor[:, None]
            if which != "all":
                top = np.arange(bounds.shape[1]) == best[:, None]
                wanted = top if which == "best" else wanted & ~top
            rows, shard = np.nonzero(wanted)
            yield pa.record_batch(
                {"shard": pa.array(shard.astype(np.int32))} | {n: part.column(n).take(pa.array(rows)) for n in part.schema.names}
            )


def _searched(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], answer: Callable) -> Iterator[pa.RecordBatch]:
    """Answers of anchors; rows come by shard, those of the shard (kind 0) before its anchors (kind 1)."""
    held: list[pa.RecordBatch] = []
    index, current = None, None
    for batch in batches:
        shard, kind = (batch.column(n).to_numpy() for n in ("shard", "kind"))
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if begin == end:
                continue
            part = batch.slice(begin, end - begin)
            if shard[begin] != current:
                current, held, index = shard[begin], [], None
            if kind[begin] == 0:
                held.append(part)
                continue
            if index is None and held:
                rows = pa.Table.from_batches(held).combine_chunks()
                codes = np.stack([rows[n].to_numpy() for n in ("c0", "c1")], axis=1)
                vectors = _matrix(rows["vec"].combine_chunks(), rows.num_rows)
                index, held = CellIndex(rows["id"].to_numpy(), rows["label"].to_numpy(), vectors, codes, books), []
            if index is not None:
                yield answer(index, part)


def _positives(index: CellIndex, part: pa.RecordBatch, k: int) -> pa.RecordBatch:
    vectors = _matrix(part.column("vec"), part.num_rows)
    floors = part.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
    out: list[tuple] = []
    for own, label, anchor, floor in zip(part.column("id").to_pylist(), part.column("label").to_pylist(), vectors, floors):
        score, ids = index.positives(own, label, anchor, floor, k)
        out += zip([own] * len(ids), ids.tolist(), score.tolist())
    columns = list(zip(*out)) or [[]] * 3
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score"])


def _negatives(index: CellIndex, part: pa.RecordBatch, low: int, k: int) -> pa.RecordBatch:
    vectors = _matrix(part.column("vec"), part.num_rows)
    out: list[tuple] = []
    columns = (part.column(n).to_pylist() for n in ("id", "label", "targets"))
    for own, label, targets, anchor in zip(*columns, vectors):
        for target, (score, ids) in zip(targets, index.windows(own, label, anchor, targets, low, k)):
            out += zip([own] * len(ids), [target] * len(ids), ids.tolist(), score.tolist())
    columns = list(zip(*out)) or [[]] * 4
    names = ["anchor_id", "positive_score", "negative_id", "negative_score"]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)


class MultiIndex:
    """All rows of a table, filed by cell and dealt to shards."""

    def __init__(self, rows: DataFrame) -> None:
        """``rows`` is a written table of id, label and vec, with vectors of one length."""
        self.spark = rows.sparkSession
        size, dim = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
        most = min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // max(1, dim or 1)))
        sample = rows.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(most).toArrow()
        points = _matrix(sample["vec"].combine_chunks(), sample.num_rows).astype(np.float64)
        half = points.shape[1] // 2
        codes = int(np.clip(np.sqrt(size / CELL_ROWS), 1, CODES))
        books = [fit_codebook(part, codes) for part in (points[:, :half], points[:, half:])]
        schema = "id long, label long, vec array<long>, c0 int, d0 double, c1 int, d1 double"
        filed = store(rows.select("id", "label", "vec").mapInArrow(lambda it: _filed(it, books), schema), "filed")
        # One row for each cell: the square of CODES at most.
        cells = filed.groupBy("c0", "c1").agg(F.count("*").alias("n"), F.max("d0").alias("d0"), F.max("d1").alias("d1")).collect()
        radii = [np.zeros(len(b)) for b in books]
        for r in cells:
            for n in (0, 1):
                radii[n][r[f"c{n}"]] = max(radii[n][r[f"c{n}"]], r[f"d{n}"])
        self.books = books
        self.shards = Shards([(r.c0, r.c1, r.n) for r in cells], books, radii)
        homes = self.spark.createDataFrame(self.shards.rows, "c0 int, c1 int, first int, parts int")
        home = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
        self.filed = filed.join(F.broadcast(homes), ["c0", "c1"]).select(home.alias("shard"), "id", "label", "vec", "c0", "c1")

    def search(self, anchors: DataFrame, which: str, answer: Callable, schema: str) -> DataFrame:
        """Answers of (id, label, vec, floor, targets) in the shards they ask."""
        shards, books = self.shards, self.books
        given = "id long, label long, vec array<long>, floor double, targets array<long>"
        asked = anchors.select("id", "label", "vec", "floor", "targets").mapInArrow(
            lambda it: _asked(it, shards, which), "shard int, " + given
        )
        asked = asked.withColumn("kind", F.lit(1))
        both = self.filed.withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
        ordered = both.repartition("shard").sortWithinPartitions("shard", "kind")
        return ordered.mapInArrow(lambda it: _searched(it, books, answer), schema)


def _first(found: DataFrame, keys: list[str], score: str, row: str, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc(), row))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def usable(vector: str) -> Column:
    """Not null, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite


def mine(table: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    ``table`` has id, label and vec, an array of integers; scores are inner products, the
    higher the better, ties to the smaller id. An anchor's positives are its first
    ``k_positive`` other rows of the same label; each gets the first ``k_negative`` rows
    of other labels that score from ``low`` percent of the positive's score up to it.

    Rows with a null id, label, vector or component take no part; of rows with one id the
    least by label and vector stays; vectors of another length than most (the longer, if
    equally many) take no part. An anchor without positives, and a positive without
    negatives, give no rows, nor does an empty table. Extra columns are not read.
    """
    rows = table.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull()))
    rows = rows.select(
        F.col("id").cast("long").alias("id"),
        F.struct(F.col("label").cast("long").alias("label"), F.col("vec").cast("array<long>").alias("vec")).alias("row"),
        is_anchor.alias("asks"),
    )
    rows = rows.groupBy("id").agg(F.min("row").alias("row"), F.max("asks").alias("asks")).select("id", "row.*", "asks")
    rows = store(rows, "rows")
    common = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    made = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if common is None:
        return table.sparkSession.createDataFrame([], made)
    rows = rows.where(F.size("vec") == common.dim)
    index = MultiIndex(rows)
    none = F.lit(None)
    anchors = rows.where("asks").select("id", "label", "vec")
    asked = anchors.withColumn("floor", none.cast("double")).withColumn("targets", none.cast("array<long>"))
    found_as = "anchor_id long, positive_id long, positive_score long"
    answer = lambda i, p: _positives(i, p, k_positive)
    keys = ["anchor_id"]
    found = _first(index.search(asked, "best", answer, found_as), keys, "positive_score", "positive_id", k_positive)
    if index.shards.count > 1:
        found = store(found.drop("rank"), "near-positives")
        floors = found.groupBy("anchor_id").agg(
            F.when(F.count("*") == k_positive, F.min("positive_score").cast("double")).alias("floor")
        )
        asked = asked.drop("floor").join(floors, asked.id == floors.anchor_id, "left")
        more = index.search(asked, "others", answer, found_as)
        found = _first(found.unionByName(more), keys, "positive_score", "positive_id", k_positive)
    positives = store(found.drop("rank"), "positives")
    targets = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_set("positive_score")).alias("targets"))
    asked = anchors.join(targets, anchors.id == targets.anchor_id)
    asked = asked.withColumn("floor", F.array_min("targets") * (low / 100) - 1e-6 * F.abs(F.array_min("targets")) - 1)
    negatives = index.search(
        asked, "all", lambda i, p: _negatives(i, p, low, k_negative),
        "anchor_id long, positive_score long, negative_id long, negative_score long",
    )
    negatives = _first(negatives, ["anchor_id", "positive_score"], "negative_score", "negative_id", k_negative)
    found = positives.join(negatives, ["anchor_id", "positive_score"])
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
