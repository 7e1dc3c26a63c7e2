"""Document fingerprints that add up: a homomorphic hash of the multiset of paragraphs.

Every paragraph (text between line feeds) is hashed to a wide vector, and the vectors of
a document are added, each word modulo a power of two. The order of paragraphs does not
count; a paragraph is put in or taken out by adding or subtracting its vector.

A vector has two parts. ``CHECKS`` words modulo 2^64 are the BLAKE2 digest of the
paragraph: two documents with different paragraphs agree in all of them by chance only.
``COUNTERS`` words modulo 2^32 count the signed three-word shingles of the paragraph,
each in one place: their inner products estimate how many shingles two documents share,
so fingerprints alone tell how like two documents are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.buffers import U64, column_bytes, grams, word_hashes
from tagloom.workspace import store

CHECKS = 8
COUNTERS = 128
SHINGLE = 3
#: Rows and code points hashed at once; a longer text makes a step of its own.
ROWS = 256
CHARS = 1 << 20
_SCHEMA = (
    "id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary,"
    "near_edited double, near_next double, part int, edge int, text string"
)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Check words (uint64) and counters (uint32) of every text, one row each."""
    paragraphs, owner, digests = [], [], []
    for n, text in enumerate(texts):
        lines = text.split("\n")
        paragraphs += lines
        owner.append(len(lines))
        digests += [hashlib.blake2b(p.encode(), digest_size=8 * CHECKS).digest() for p in lines]
    starts = np.concatenate([[0], np.cumsum(owner)[:-1]]).astype(np.int64)
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, CHECKS)
    checks = np.add.reduceat(words, starts, axis=0)
    data, offsets = column_bytes(pa.array(paragraphs, pa.string()))
    hashes, rows, _ = grams(*word_hashes(data, offsets), SHINGLE, short=True)
    at = np.repeat(np.arange(len(texts)), owner)[rows] * COUNTERS + (hashes % U64(COUNTERS)).astype(np.int64)
    sign = np.where(hashes >> U64(63), 1.0, -1.0)
    counts = np.bincount(at, sign, len(texts) * COUNTERS).astype(np.int64)
    return checks, (counts & 0xFFFFFFFF).astype(np.uint32).reshape(-1, COUNTERS)


def packed(checks: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes: little-endian check words, then counters."""
    both = np.concatenate([checks.astype("<u8").view(np.uint8), counts.astype("<u4").view(np.uint8)], axis=1)
    return [row.tobytes() for row in both]


def unpacked(prints: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)
    cut = 8 * CHECKS
    return np.ascontiguousarray(flat[:, :cut]).view("<u8"), np.ascontiguousarray(flat[:, cut:]).view("<u4")


def combined(a: bytes, b: bytes, remove: bool = False) -> bytes:
    """Fingerprint of the paragraphs of both, or of ``a`` without those of ``b``."""
    (ca, na), (cb, nb) = unpacked([a]), unpacked([b])
    return packed(ca - cb, na - nb)[0] if remove else packed(ca + cb, na + nb)[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated share, 0 to 1, of the shingles of both that they have in common, row by row.

    Twice the inner product of the counters by the sum of their squares; 1 for equal
    fingerprints and 0 for different ones without shingles.
    """
    x, y = (np.ascontiguousarray(v[1]).astype(np.uint32).view(np.int32).astype(np.float64) for v in (a, b))
    whole = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    share = 2 * (x * y).sum(axis=1) / np.where(whole > 0, whole, 1)
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    return np.where(same, 1.0, np.clip(share, 0.0, 1.0))


def _edited(text: str, other: str) -> tuple[str, str, str]:
    """The text with its last half replaced, and the paragraphs that go and that come in."""
    half = len(text) // 2
    keep = len(text) - half
    made = text[:keep] + other[:half]
    begin = text.rfind("\n", 0, keep) + 1
    return made, text[begin:], made[begin:]


def _compared(ids: list, texts: list[str], following: str) -> dict[str, list]:
    """Columns of rows whose next document is the next in the list, and ``following`` for the last."""
    nexts = [*texts[1:], following]
    made, gone, new = zip(*map(_edited, texts, nexts))
    n = len(texts)
    checks, counts = vectors([*texts, following, *gone, *new])
    own, after = (checks[:n], counts[:n]), (checks[1 : n + 1], counts[1 : n + 1])
    minus, plus = slice(n + 1, 2 * n + 1), slice(2 * n + 1, 3 * n + 1)
    edited = (own[0] - checks[minus] + checks[plus], own[1] - counts[minus] + counts[plus])
    return {
        "id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in made],
        "fingerprint": packed(*own),
        "edited_fingerprint": packed(*edited),
        "near_edited": likeness(own, edited),
        "near_next": likeness(own, after),
    }


_KINDS = {
    "id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.binary(),
    "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64(),
    "part": pa.int32(), "edge": pa.int32(), "text": pa.string(),
}


def _batch(columns: dict[str, list], rows: int) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in _KINDS.items()], names=list(_KINDS)
    )


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a few rows at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(i)
            texts.append(text.as_py())
            size += len(texts[-1])
            if len(ids) >= ROWS or size >= CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compared rows of one sorted partition; its first and last texts go out as edges 0 and 1."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None  # the last row so far
    for ids, texts in _steps(batches):
        if held is None:
            yield _batch({"part": [part], "edge": [0], "text": texts[:1]}, 1)
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        if len(ids) > 1:
            yield _batch(_compared(ids[:-1], texts[:-1], texts[-1]), len(ids) - 1)
        held = ids[-1], texts[-1]
    if held is not None:
        yield _batch({"id": [held[0]], "part": [part], "edge": [1], "text": [held[1]]}, 1)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text, following in zip(*(batch.column(n).to_pylist() for n in range(3))):
            yield _batch(_compared([i], [text], following), 1)


def fingerprints(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with a column ``fingerprint``, in place of any they have; null texts count as empty."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for _, texts in _steps(iter([batch])) for p in packed(*vectors(texts))]
            yield pa.record_batch({"row": batch.column(2), "fingerprint": pa.array(found, pa.binary())})

    names = [c for c in docs.columns if c != "fingerprint"]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.lit(0).cast("long").alias("id"), text.alias("text"), F.struct(*names).alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, fingerprint binary"
    return rows.mapInArrow(made, schema).select("row.*", F.lower(F.hex("fingerprint")).alias("fingerprint"))


def edit_report(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fingerprints of all texts and of the same with their last half taken from the next document.

    Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal),
    near_edited, near_next. The next document is the one with the next smaller id; after
    the last comes the first, and a single row is its own next one. Null ids come last;
    rows with one id are ordered by a hash of their texts, and rows equal in both are
    interchangeable. Null texts count as empty. The edited fingerprint is made by taking
    out the paragraphs that go and putting in those that come, not from the edited text.
    No rows give no rows.

    Texts move once, in a range sort. Neighbours meet inside their sorted partition; only
    the first and last text of each partition meet in a join.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    order = [F.col("id").desc_nulls_last(), "h", "n"]  # the number keeps equal rows from falling into one task
    walked = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text").mapInArrow(_walk, _SCHEMA)
    walked = store(walked, "walked")
    # Partitions are few: their numbers, and the next one with rows, are known to the driver.
    parts = sorted(r.part for r in walked.where("edge = 0").select("part").collect())
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    heads = walked.where("edge = 0").select(F.col("part").alias("after"), F.col("text").alias("following"))
    last = walked.where("edge = 1").select("id", "text", "part").join(following, "part").join(heads, "after")
    rest = last.select("id", "text", "following").mapInArrow(_pairs, _SCHEMA)
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return walked.where("edge IS NULL").union(rest).select("id", "n_chars", "edited_sha256", *hexed, "near_edited", "near_next")
