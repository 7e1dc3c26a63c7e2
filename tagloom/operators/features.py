"""Fixed-length feature rows from labelled, tokenised sentences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.arrays import as_ints, count_ones, framed, from_line, kept_ones, ones_then_zeros, to_line, where_one
from tagloom.operators.packing import pack_sentences
from tagloom.operators.scan import BLOCK, prior_values
from tagloom.operators.word_lists import gathered_lists
from tagloom.workspace import is_small, store

# Words of one sentence kept in one row.
PART_WORDS = 4096
# Columns that hold one field of the pieces each begin so.
APART = "ps_"
# Bytes of dense matrices made at once.
DENSE_BYTES = 16 << 20


@dataclass(frozen=True)
class FeatureConfig:
    """Sequence length, ids of the special marks and label conventions."""

    max_len: int = 512
    cls_id: int = 3
    sep_id: int = 4
    pad_id: int = 0
    outside_id: int = 0
    x_id: int = 9
    keep_empty: bool = True

    @property
    def limit(self) -> int:
        return self.max_len - 2


ARRAYS = (
    "input_ids",
    "input_mask",
    "segment_ids",
    "label_ids",
    "is_start_label",
    "words_label",
    "label_x",
    "is_weight_focus",
    "label_x_mask",
    "weight_focus_mask",
    "weight_matrix_mask",
    "piece_list",
)


def sentence_pieces(tokenized: DataFrame, sentence: Sequence[str], label: str = "label") -> DataFrame:
    """Gather ``(sentence…, word_pos, label, pieces)`` word rows into ``(sentence…,
    part, ps, n, n_words)``: the pieces of each run of ``PART_WORDS`` words, in order.

    Rows of :func:`~tagloom.operators.word_lists.word_parts`, whose ``pieces`` are lists for a
    list of words, are gathered where they are. A file without blank lines is one sentence; parts keep every group small however
    long it gets. Words without pieces drop out.
    """
    if isinstance(tokenized.schema["pieces"].dataType.elementType, T.ArrayType):
        return gathered_lists(tokenized.withColumnRenamed(label, "label"), sentence, PART_WORDS)
    words = F.array_sort(F.collect_list(F.struct("word_pos", F.col(label).alias("label"), "pieces")))
    with_label = F.transform(
        words,
        lambda w: F.transform(
            w["pieces"],
            lambda p: F.struct(
                p["piece"].alias("piece"),
                p["id"].cast("int").alias("id"),
                w["label"].alias("label"),
                p["start"].alias("start"),
                p["focus"].alias("focus"),
                p["weight"].alias("weight"),
                w["word_pos"].alias("word_pos"),
            ),
        ),
    )
    rows = tokenized.where(F.size("pieces") > 0).withColumn("part", F.expr(f"word_pos div {PART_WORDS}"))
    parts = rows.groupBy(*sentence, "part").agg(
        F.flatten(with_label).alias("ps"), F.count("*").alias("n_words")
    )
    return parts.withColumn("n", F.size("ps").cast("long"))


def _part_offsets(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces and words before each part of its sentence, without the pieces themselves."""
    counts = parts.select(*keys, "part", F.col("n").alias("part_n"), "n", "n_words")
    if not is_small(parts.where(F.col("part") >= BLOCK), 0):
        sums = {"first_piece": ("sum", F.col("n")), "first_word": ("sum", F.col("n_words"))}
        return prior_values(counts, ["part"], sums, keys).drop("n", "n_words")
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return counts.select(
        *keys,
        "part",
        "part_n",
        F.coalesce(F.sum("n").over(before), zero).alias("first_piece"),
        F.coalesce(F.sum("n_words").over(before), zero).alias("first_word"),
    )


def piece_field(packs: DataFrame, name: str) -> Column:
    """One field of the pieces of each row as an array: its own column where there is one."""
    return F.col(APART + name) if APART + name in packs.columns else F.col("ps")[name]


def pack_combined(
    sentences: DataFrame, cfg: FeatureConfig, shard: Sequence[str], source: bool = False, apart: bool = False
) -> DataFrame:
    """Several sentences per sequence: ``(shard…, pack_id, ps, word_labels)``.

    Placement works on counts alone; pieces travel once to their sentence's place and
    once to their sequence, each field as an array of its own. With ``source`` each piece
    carries its ``sent_id`` besides its ``word_pos``, so a word that a border cuts can be
    put together again. ``apart`` adds these arrays as columns ``ps_<field>``: fields that
    nobody reads are then neither read nor moved.
    """
    keys = [*shard, "sent_id"]
    limit = cfg.limit
    sizes = sentences.groupBy(*keys).agg(F.sum("n").alias("n"))
    placed = pack_sentences(sizes, limit, shard, cfg.keep_empty)
    places = _part_offsets(sentences, keys).join(placed, keys)
    columns = _columns(sentences)
    rows = places.join(sentences.select(*keys, "part", *[_sent(c, t) for c, t in columns.items()]), [*keys, "part"])

    # A part of an oversize sentence spans one or more full-length chunks. Chunk -1
    # stands for the empty sequence that such a sentence flushed before it.
    oversize = F.col("n") > limit
    spanned = F.sequence(F.expr(f"first_piece div {limit}"), F.expr(f"(first_piece + part_n - 1) div {limit}"))
    chunks = F.when(oversize, spanned).otherwise(F.array(F.lit(0).cast("long")))
    if cfg.keep_empty:
        flushed = F.col("empty_before") & (F.col("first_piece") == 0)
        chunks = F.when(flushed, F.array_prepend(chunks, F.lit(-1).cast("long"))).otherwise(chunks)
    rows = rows.withColumn("chunk", F.explode(chunks))
    lo = F.greatest(F.lit(0).cast("long"), F.col("chunk") * limit - F.col("first_piece"))
    hi = F.least(F.col("part_n"), (F.col("chunk") + 1) * limit - F.col("first_piece"))
    size = F.when(F.col("chunk") < 0, 0).otherwise(hi - lo).cast("int")

    def sliced(column: str, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return to_line(F.slice(from_line(F.col(column)), (lo + 1).cast("int"), size))
        return F.slice(column, (lo + 1).cast("int"), size)

    cut = {c: F.when(oversize, sliced(c, t)).otherwise(F.col(c)) for c, t in columns.items()}
    if source:
        held = F.when(oversize, size).otherwise(F.col("part_n").cast("int"))
        cut[f"{APART}sent_id"] = F.array_repeat(F.col("sent_id"), held)
        columns[f"{APART}sent_id"] = sentences.schema["sent_id"].dataType
    place = F.when(oversize, F.col("first_piece") + lo).otherwise(F.col("offset") + F.col("first_piece"))
    runs = rows.select(
        *shard,
        (F.col("pack_id") + F.col("chunk")).alias("pack_id"),
        place.cast("long").alias("place"),
        *[c.alias(n) for n, c in cut.items()],
    )
    packs = _gather(runs, [*shard, "pack_id"], columns)
    packs = packs.withColumn("word_labels", _start_labels(packs))
    return packs if apart else packs.drop(*cut)


def _columns(sentences: DataFrame) -> dict[str, T.DataType]:
    """The fields of the pieces as columns, with their kinds."""
    return {APART + f.name: f.dataType for f in sentences.schema["ps"].dataType.elementType.fields}


def _sent(column: str, kind: T.DataType) -> Column:
    """One field of the pieces, as it travels: texts as lines."""
    values = F.col("ps")[column.removeprefix(APART)]
    return (to_line(values) if isinstance(kind, T.StringType) else values).alias(column)


def _gather(runs: DataFrame, keys: list[str], columns: dict[str, T.DataType]) -> DataFrame:
    """The arrays of all runs of a sequence put together by ``place``, and ``ps`` of them all.

    Arrays are collected side by side, so that one that is not used is not moved.
    """
    lists = runs.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in ("place", *columns)])
    at = F.transform("place", lambda p, i: F.struct(p.alias("place"), i.alias("i")))
    lists = lists.withColumn("place", F.transform(F.array_sort(at), lambda x: x["i"]))

    def whole(column: str, kind: T.DataType) -> Column:
        read = from_line if isinstance(kind, T.StringType) else lambda values: values
        return F.flatten(F.transform("place", lambda i: read(F.get(F.col(column), i)))).alias(column)

    packs = lists.select(*keys, *[whole(c, t) for c, t in columns.items()])
    return packs.withColumn("ps", F.arrays_zip(*[F.col(c).alias(c.removeprefix(APART)) for c in columns]))


def pack_simple(
    sentences: DataFrame, cfg: FeatureConfig, shard: Sequence[str], apart: bool = False
) -> DataFrame:
    """One sentence per sequence, cut at the limit; ``pack_id`` is the sentence id.
    Word labels are those of the whole sentence, cut at the same number. ``apart`` is that
    of :func:`pack_combined`."""
    keys, limit = [*shard, "sent_id"], F.lit(cfg.limit)
    heads = _part_offsets(sentences, keys).where(F.col("first_word") < limit)
    columns = _columns(sentences)
    rows = heads.join(sentences.select(*keys, "part", *[_sent(c, t) for c, t in columns.items()]), [*keys, "part"])
    whole = _gather(rows.select(*keys, F.col("first_piece").cast("long").alias("place"), *columns), keys, columns)
    done = whole.select(
        *shard,
        F.col("sent_id").alias("pack_id"),
        *[F.slice(c, F.lit(1), limit).alias(c) for c in ("ps", *columns)],
        F.slice(_start_labels(whole), F.lit(1), limit).alias("word_labels"),
    )
    return done if apart else done.drop(*columns)


def _start_labels(packs: DataFrame) -> Column:
    label = packs.schema["ps"].dataType.elementType["label"].dataType
    return kept_ones(as_ints(piece_field(packs, "start")), piece_field(packs, "label"), label)


def assemble(packs: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Padded arrays of length ``max_len`` for ``(…, ps, word_labels)`` rows.

    Each array is framed on Arrow batches, and only if it is used.
    """
    names = packs.schema["ps"].dataType.elementType.names
    keys = [c for c in packs.columns if c not in ("ps", "word_labels", *[APART + n for n in names])]
    size, out, x = cfg.max_len, cfg.outside_id, cfg.x_id
    ids, labels, starts, focus = (as_ints(piece_field(packs, c)) for c in ("id", "label", "start", "focus"))

    def numbers(values: Column, first: int, last: int, fill: int) -> Column:
        return framed(values, T.IntegerType(), first, last, fill, size)

    columns = {
        "input_ids": numbers(ids, cfg.cls_id, cfg.sep_id, cfg.pad_id),
        "input_mask": as_ints(ones_then_zeros(F.size(starts) + 2, size)),
        "segment_ids": F.array_repeat(F.lit(0), size),
        "label_ids": numbers(labels, out, out, out),
        "is_start_label": numbers(starts, 1, 1, 0),
        "words_label": numbers(as_ints(F.col("word_labels")), out, out, out),
        "label_x": numbers(where_one(starts, labels, x), out, out, out),
        "is_weight_focus": numbers(where_one(focus, labels, x), out, out, out),
        "label_x_mask": numbers(starts, 1, 1, 0),
        "weight_focus_mask": numbers(focus, 1, 1, 0),
        "weight_matrix_mask": as_ints(ones_then_zeros(count_ones(starts) + 2, size)),
        "piece_list": framed(piece_field(packs, "piece"), T.StringType(), "[CLS]", "[SEP]", "[PAD]", size),
    }
    return packs.select(
        *keys,
        *[c.alias(n) for n, c in columns.items()],
        piece_field(packs, "weight").cast("array<float>").alias("piece_weights"),
    )


def build_features(
    tokenized: DataFrame, cfg: FeatureConfig, shard: Sequence[str], mode: str = "combine"
) -> DataFrame:
    """Word rows ``(shard…, sent_id, word_pos, label, pieces)`` to feature rows."""
    sentences = store(sentence_pieces(tokenized, [*shard, "sent_id"]), "sentence_pieces")
    if mode == "combine":
        packs = pack_combined(sentences, cfg, shard, apart=True)
    elif mode == "simple":
        packs = pack_simple(sentences, cfg, shard, apart=True)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return assemble(packs, cfg)


def weight_matrix(packs: DataFrame, seq: Sequence[str], parity: bool = False) -> DataFrame:
    """Sparse word-by-piece weights ``(seq…, word_idx, piece_pos, w)``.

    Word 0 is the opening mark. By default every word that starts in the sequence is
    one row; pieces continuing a word of the previous chunk belong to none. With
    ``parity`` a piece of weight 1 closes its row even inside a word, leading
    continuations form a row, and the last row is kept only if it is such a piece.
    """
    seq = list(seq)
    if not parity:
        return _word_cells(packs, seq)
    opening = F.struct(F.lit(0).alias("start"), F.lit(1.0).alias("weight"))
    start, weight = piece_field(packs, "start"), piece_field(packs, "weight")
    cells = F.zip_with(start, weight, lambda s, w: F.struct(s.alias("start"), w.alias("weight")))
    rows = packs.select(*seq, F.posexplode(F.array_prepend(cells, opening)).alias("piece_pos", "p"))
    rows = rows.select(*seq, "piece_pos", "p.start", F.col("p.weight").alias("w"))
    order = W.partitionBy(*seq).orderBy("piece_pos")
    rows = rows.withColumn("word_no", F.sum("start").over(order).cast("int"))
    in_word = W.partitionBy(*seq, "word_no").orderBy("piece_pos").rowsBetween(W.unboundedPreceding, -1)
    broken = F.coalesce(F.max((F.col("w") != 1.0).cast("int")).over(in_word), F.lit(0))
    rows = rows.withColumn("opens", ((F.col("start") == 1) | (broken == 0)).cast("int"))
    rows = rows.withColumn("word_idx", (F.sum("opens").over(order) - 1).cast("int"))
    group = W.partitionBy(*seq, "word_idx")
    rows = rows.withColumns(
        {
            "whole": F.max(F.when(F.col("opens") == 1, (F.col("w") == 1.0).cast("int"))).over(group),
            "last": F.max("word_idx").over(W.partitionBy(*seq)),
        }
    )
    return rows.where("word_idx < last OR whole = 1").select(*seq, "word_idx", "piece_pos", "w")


def _word_cells(packs: DataFrame, seq: list[str]) -> DataFrame:
    """Words are numbered inside the record, on Arrow batches; nothing is exchanged or sorted."""
    start, weight = piece_field(packs, "start"), piece_field(packs, "weight")
    lists = [start.cast("array<int>").alias("_start"), weight.cast("array<double>").alias("_w")]
    rows = packs.where(start.isNotNull()).select(*seq, *lists)
    cells = [T.StructField("word_idx", T.IntegerType()), T.StructField("piece_pos", T.IntegerType()), T.StructField("w", T.DoubleType())]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("_start")).to_numpy()
            own = np.repeat(np.arange(len(sizes)), sizes)
            first = np.cumsum(sizes) - sizes
            place = np.arange(len(own)) - first[own] + 1
            opened = np.append(0, np.cumsum(pc.fill_null(batch.column("_start").flatten(), 0).to_numpy()))
            word = opened[1:] - opened[first][own]
            kept = np.flatnonzero(word > 0)
            # The opening mark of each record, then its words.
            order = np.argsort(np.append(np.arange(len(sizes)), own[kept]), kind="stable")
            of = np.append(np.arange(len(sizes)), own[kept])[order]
            at, word = (np.append(np.zeros(len(sizes), int), v[kept])[order] for v in (place, word))
            w = pa.concat_arrays([pa.array(np.ones(len(sizes))), batch.column("_w").flatten().take(pa.array(kept))]).take(pa.array(order))
            made = [pa.array(word, pa.int32()), pa.array(at, pa.int32()), w]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(of)) for c in seq], *made], [*seq, "word_idx", "piece_pos", "w"])

    return rows.mapInArrow(number, T.StructType([*[rows.schema[c] for c in seq], *cells]))


def dense_matrix(weights: DataFrame, seq: Sequence[str], size: int) -> DataFrame:
    """Flattened ``size * size`` view of the sparse weights, for export only.

    Cells are set in place on Arrow batches, ``DENSE_BYTES`` of matrices at a time.
    """
    at = (F.col("word_idx").cast("long") * size + F.col("piece_pos")).alias("k")
    cells = F.collect_list(F.struct(at, F.col("w").cast("float").alias("v"))).alias("cells")
    held = weights.groupBy(*seq).agg(cells)
    area = size * size
    step = max(1, DENSE_BYTES // (4 * area))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                lists = part.column("cells")
                rows, found = part.num_rows, lists.flatten()
                own = np.repeat(np.arange(rows), pc.list_value_length(lists).to_numpy())
                flat = np.zeros(rows * area, np.float32)
                flat[own * area + found.field("k").to_numpy()] = found.field("v").to_numpy(zero_copy_only=False)
                offsets = np.arange(rows + 1, dtype=np.int32) * area
                dense = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in seq], dense], [*seq, "weight_matrix"])

    kind = T.StructField("weight_matrix", T.ArrayType(T.FloatType()))
    return held.mapInArrow(fill, T.StructType([*[held.schema[c] for c in seq], kind]))


def length_violations(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], size: int) -> DataFrame:
    """Arrays whose length is not ``size``: ``(keys…, field, size)``."""
    sizes = F.array(*[F.struct(F.lit(n).alias("field"), F.size(n).alias("size")) for n in fields])
    return rows.select(*keys, F.inline(F.filter(sizes, lambda x: x["size"] != size)))


def feature_violations(features: DataFrame, keys: Sequence[str], cfg: FeatureConfig) -> DataFrame:
    """Feature arrays that are not exactly ``max_len`` long."""
    fields = [n for n in ARRAYS if n in features.columns]
    return length_violations(features, keys, fields, cfg.max_len)
