"""Named queries: each runs one operator, or a chain of them, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import arrays, tags, text
from tagloom.operators import (
    chunks,
    decode,
    evaluate,
    features,
    labels,
    long_paths,
    lookup,
    packing,
    run_scoring,
    scan,
    tagger,
    training,
)
from tagloom.operators import wordpiece as wp
from tagloom.plans import corpus
from tagloom.sources import readers, writers
from tagloom.streaming import rows as streams
from tagloom.workspace import by_key, new_path, spread, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

CFG = features.FeatureConfig(max_len=128)
FULL = features.FeatureConfig(max_len=512)
SEQ = ["doc_id", "sent_id"]
PACK = ["doc_id", "pack_id"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _metrics(df: DataFrame, *by: str) -> DataFrame:
    kept = df.select(
        *by, "level", "type", "gold", "guessed", "correct", "tokens", "precision", "recall", "f1", "accuracy"
    )
    return _rounded(kept, 6, "precision", "recall", "f1", "accuracy")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _checksum(values: Column) -> Column:
    """Position-weighted sum of an integer array."""
    return arrays.placed_total(values.cast("array<bigint>"))


# --- text -------------------------------------------------------------------


@query
def clean_text(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", F.md5(text.clean_text(F.col("html"))).alias("digest"))


@query
def cjk_space(spark, sf_dir):
    html = F.translate("html", "éñü", "中豈㐀")
    pages = _table(spark, sf_dir, "pages").select("page_id", text.space_cjk(html).alias("t"))
    return pages.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query
def punct_split(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", text.space_punctuation(F.col("html")).alias("t"))
    return pages.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query
def whitespace_tokens(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", text.split_space(F.col("html")).alias("w"))
    return rows.select(
        "page_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "|")).alias("digest")
    )


@query
def strip_accents(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.md5(text.strip_accents(F.lower("text"))).alias("digest"))


@query
def basic_tokenize(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    rows = rows.select("conv_id", "turn", text.basic_tokens(F.col("text")).alias("t"))
    return rows.select(
        "conv_id", "turn", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest")
    )


@query
def basic_tokenize_words(spark, sf_dir):
    rows = wp.basic_dictionary(corpus.counted_words(spark, sf_dir))
    return rows.select("word", F.array_join("tokens", " ").alias("tokens"))


@query
def normalize_text(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    done = text.normalize_text(F.col("text"), lower=True)
    return rows.select("conv_id", "turn", F.md5(done).alias("digest"))


@query
def utf8_text(spark, sf_dir):
    """Texts with stray bytes behind them, which must go and leave the whole text."""
    docs = spread(corpus.documents(spark, sf_dir))
    raw = F.expr("concat(cast(text as binary), X'C3')")
    done = text.utf8_text(raw)
    return docs.select("doc_id", F.length(done).cast("long").alias("n_chars"), F.md5(done).alias("digest"))


@query
def number_comma_split(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat(array(concat('▁', n_chars, ',')), split(text, ' ')) AS p"
    )
    rows = rows.select("doc_id", text.split_number_commas(F.col("p")).alias("p"))
    return rows.select(
        "doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("digest")
    )


# --- word pieces ------------------------------------------------------------


@query
def wordpiece(spark, sf_dir):
    tokens = corpus.counted_words(spark, sf_dir).select(F.lower("word").alias("token")).distinct()
    rows = wp.wordpiece(tokens, corpus.vocab(spark, sf_dir))
    return rows.select("token", F.array_join(F.transform("pieces", lambda p: p["piece"]), " ").alias("pieces"))


@query
def vocabulary(spark, sf_dir):
    return corpus.vocab(spark, sf_dir).select("piece", "id")


@query
def vocab_from_file(spark, sf_dir):
    """The vocabulary written as lines in id order, by several tasks, and read back by line number."""
    path = new_path(spark, "vocab-text")
    writers.write_vocab(corpus.vocab(spark, sf_dir), path)
    return readers.read_vocab(spark, path)


@query
def tokenize_sentences(spark, sf_dir):
    rows = corpus.tokenized(spark, sf_dir)
    ids = F.transform("pieces", lambda p: p["id"])
    return rows.select(*SEQ, "word_pos", ids.alias("ids")).groupBy(*SEQ).agg(
        F.sum(F.size("ids")).alias("n_pieces"),
        F.sum((F.col("word_pos") + 1) * _checksum(F.col("ids"))).alias("checksum"),
    )


@query
def tokenize_unseen(spark, sf_dir):
    """The devel and test splits tokenised with a dictionary of the train split's words."""
    rows = corpus.labelled_words(spark, sf_dir)
    vocab = corpus.vocab(spark, sf_dir)
    train = wp.word_dictionary(wp.word_counts(rows.where("split = 'train'")), vocab)
    rows = wp.tokenize(rows.where("split <> 'train'"), train, vocab)
    ids = F.transform("pieces", lambda p: p["id"])
    return rows.select(*SEQ, "word_pos", ids.alias("ids")).groupBy(*SEQ).agg(
        F.sum(F.size("ids")).alias("n_pieces"),
        F.sum((F.col("word_pos") + 1) * _checksum(F.col("ids"))).alias("checksum"),
    )


def letters(words: DataFrame) -> DataFrame:
    """A tokenizer of another kind: every character is a piece."""
    return words.withColumn("pieces", F.filter(F.split("word", ""), lambda x: x != ""))


@query
def tokenize_letters(spark, sf_dir):
    """All words cut by a tokenizer that is not the library's own."""
    rows = corpus.words(spark, sf_dir)
    counts = store(wp.word_counts(rows), "counts")
    found = letters(counts).select(F.explode("pieces").alias("piece")).distinct()
    vocab = store(found.select("piece", F.ascii("piece").cast("long").alias("id")), "letters")
    dictionary = wp.tokenizer_dictionary(counts, vocab, letters)
    ids = F.transform("pieces", lambda p: p["id"])
    return wp.tokenize(rows, dictionary).select(*SEQ, "word_pos", ids.alias("ids")).groupBy(*SEQ).agg(
        F.sum(F.size("ids")).cast("long").alias("n_pieces"),
        F.sum((F.col("word_pos") + 1) * F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("checksum"),
    )


@query
def piece_ids(spark, sf_dir):
    """Ids looked up piece by piece, an unknown piece being an error."""
    rows = corpus.pieces(spark, sf_dir).groupBy("piece").agg(F.count("*").alias("n"))
    return lookup.lookup_ids(rows, corpus.vocab(spark, sf_dir), strict=True).select("piece", "id", "n")


@query
def stream_piece_ids(spark, sf_dir):
    """Documents read as a stream of files: ids of their tokens, spread by stored piece counts."""
    vocab = store(piece_ids(spark, sf_dir), "weighted_vocab")
    kind = corpus.documents(spark, sf_dir).select("doc_id", "text").schema
    # A pattern, because a stream's path is a folder or a pattern.
    docs = spark.readStream.schema(kind).parquet(f"{sf_dir}/documents.parquet*")
    items = streams.stream_tokens(docs, "text").withColumnRenamed("token", "piece")
    out = new_path(spark, "stream_ids")
    sink = streams.stream_ids(items, vocab, "n").writeStream.format("parquet")
    sink = sink.option("checkpointLocation", new_path(spark, "stream_state")).trigger(availableNow=True)
    sink.start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("piece", "id").agg(F.count("*").alias("n"))


@query
def ids_to_pieces(spark, sf_dir):
    rows = corpus.pieces(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"))
    return lookup.lookup_pieces(rows, corpus.vocab(spark, sf_dir), strict=True).select("id", "piece", "n")


# --- labels -----------------------------------------------------------------


@query
def parse_tag(spark, sf_dir):
    rows = corpus.tagged(spark, sf_dir, by_doc=False)
    return rows.groupBy(
        tags.tag_prefix(F.col("pred")).alias("prefix"), tags.tag_type(F.col("pred")).alias("type")
    ).agg(F.count("*").alias("n"))


def _train_labels(spark, sf_dir):
    rows = corpus.tagged(spark, sf_dir, by_doc=False).where("split = 'train'")
    return rows, labels.label_dictionary(rows, ["doc_id", "sent_id", "pos"], "gold")


@query
def label_dict(spark, sf_dir):
    return _train_labels(spark, sf_dir)[1]


@query
def class_count(spark, sf_dir):
    return labels.class_count(_train_labels(spark, sf_dir)[1])


@query
def label_map_file(spark, sf_dir):
    """The label dictionary written as text and read back, with its inverse."""
    path = new_path(spark, "label-map")
    writers.write_label_map(_train_labels(spark, sf_dir)[1], path)
    back = readers.read_label_map(spark, path)
    pairs = F.map_from_entries(F.collect_list(F.struct("label", "id")))
    inverse = back.agg(arrays.invert_map(pairs).alias("m"))
    return inverse.select(F.explode("m").alias("id", "label")).select("label", "id")


@query
def label_encode(spark, sf_dir):
    rows = corpus.tagged(spark, sf_dir, by_doc=False)
    coded = labels.encode_labels(rows, _train_labels(spark, sf_dir)[1], "pred", "label_id")
    return coded.groupBy("label_id").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query
def label_decode(spark, sf_dir):
    rows = corpus.pieces(spark, sf_dir).select("label", "label_x", "piece_idx")
    decoded = labels.decode_labels(rows, corpus.labels(spark), ["label", "label_x"])
    return decoded.groupBy("label", "label_x").agg(F.count("*").alias("n"), F.sum("piece_idx").alias("idx_sum"))


@query
def first_seen_words(spark, sf_dir):
    rows = corpus.tagged(spark, sf_dir, by_doc=False)
    seen = labels.first_seen(rows, "word", ["doc_id", "sent_id", "pos"])
    return seen.select("word", "seen.doc_id", "seen.sent_id", "seen.pos")


@query
def align_first_piece(spark, sf_dir):
    rows = corpus.pieces(spark, sf_dir)
    at = F.col("word_pos") + 1
    return rows.groupBy(*SEQ).agg(
        F.count("*").alias("n"),
        F.sum("is_start").alias("starts"),
        F.sum(F.col("label") * at).alias("label_sum"),
        F.sum(F.col("label_x") * at * (F.col("piece_idx") + 1)).alias("label_x_sum"),
    )


@query
def piece_weights(spark, sf_dir):
    rows = corpus.pieces(spark, sf_dir)
    done = rows.groupBy("piece").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    return _rounded(done, 8, "weight")


@query
def focus_piece(spark, sf_dir):
    rows = corpus.pieces(spark, sf_dir)
    return rows.groupBy(*SEQ).agg(
        F.sum("focus_mask").alias("n_focus"),
        F.sum(F.col("focus_mask") * (F.col("piece_idx") + 1) * (F.col("word_pos") + 1)).alias("focus_at"),
        F.sum(F.col("focus_label") * (F.col("piece_idx") + 1)).alias("label_sum"),
    )


def _histogram(spark, sf_dir):
    train = corpus.tokenized(spark, sf_dir).where("split = 'train'")
    return labels.piece_histogram(train)


@query
def pieces_per_word_hist(spark, sf_dir):
    return _histogram(spark, sf_dir)


@query
def top4_widths(spark, sf_dir):
    """Of equally frequent widths the one seen first in the corpus wins."""
    train = corpus.tokenized(spark, sf_dir).where("split = 'train'")
    return labels.top_widths(labels.piece_histogram(train, [*SEQ, "word_pos"]), "seen")


@query
def histogram_json(spark, sf_dir):
    return writers.histogram_json(_histogram(spark, sf_dir))


@query
def histogram_file(spark, sf_dir):
    """The histogram written if absent and read back."""
    path = new_path(spark, "histogram")
    writers.write_histogram(_histogram(spark, sf_dir), path)
    return readers.read_histogram(spark, path)


# --- token files ------------------------------------------------------------


def _token_file(spark, sf_dir):
    """The labelled corpus as token files: one line per word, a blank line after
    every sentence, a third column that readers ignore."""
    rows = corpus.tagged_sentences(spark, sf_dir).select(
        *SEQ,
        F.concat(
            F.array_join(
                F.transform(F.arrays_zip("words", "gold"), lambda t: F.concat_ws("\t", t["words"], t["gold"], F.lit("-"))),
                "\n",
            ),
            F.lit("\n"),
        ).alias("lines"),
    )
    path = new_path(spark, "tokens")
    writers.write_lines(rows, "lines", path, ["doc_id"], SEQ)
    return readers.read_tokens(spark, path)


@query
def tokens_from_docs(spark, sf_dir):
    rows = _token_file(spark, sf_dir).where("n_cols >= 2")
    return rows.groupBy("label").agg(
        F.count("*").alias("n"), F.sum("word_pos").alias("pos_sum"), F.sum(F.length("word")).alias("chars")
    )


@query
def sentence_sizes(spark, sf_dir):
    rows = _token_file(spark, sf_dir).groupBy("file", "sent_id").agg(F.count("*").alias("n_words"))
    return rows.groupBy("n_words").agg(F.count("*").alias("n_sentences"))


def _text_lines(spark, sf_dir):
    docs = spread(corpus.documents(spark, sf_dir))
    lines = docs.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    cols = text.split_columns(F.col("value"))
    return lines.select("file", "line_no", F.size(cols).alias("n_cols"), (F.size(cols) == 0).alias("is_break"), "value")


@query
def format_violations(spark, sf_dir):
    """Documents read as column files: lines with an unexpected number of columns."""
    rows = readers.format_violations(_text_lines(spark, sf_dir).drop("value"))
    return rows.withColumnRenamed("file", "doc_id")


@query
def malformed_rows(spark, sf_dir):
    """Text lines read as token rows: those without a second column."""
    cols = text.split_columns(F.col("value"), "|")
    rows = _text_lines(spark, sf_dir).where("NOT is_break").withColumn("n_cols", F.size(cols))
    return readers.malformed(rows).groupBy(F.col("file").alias("doc_id")).agg(F.count("*").alias("n"))


@query
def real_tokens(spark, sf_dir):
    rows = corpus.tagged(spark, sf_dir, by_doc=False).select(
        "split", F.when(F.length("word") == 7, F.lit("**NULL**")).otherwise(F.col("word")).alias("token")
    )
    return writers.real_tokens(rows).groupBy("token").agg(F.count("*").alias("n"))


# --- packing and features ---------------------------------------------------


def _word_sizes(spark, sf_dir):
    return corpus.sentences(spark, sf_dir).select(*SEQ, F.size("words").cast("long").alias("n"))


@query
def pack_combine(spark, sf_dir):
    placed = packing.pack_sentences(_word_sizes(spark, sf_dir), 30, ["doc_id"])
    return placed.select(*SEQ, "n", "pack_id", "offset", "empty_before")


@query
def pack_stream(spark, sf_dir):
    """Each split packed as one ordered stream of sentences, however long."""
    rows = corpus.tagged_sentences(spark, sf_dir).select("split", *SEQ, F.size("words").cast("long").alias("n"))
    rows = scan.row_index(rows, SEQ, ["split"], "idx").select("split", F.col("idx").alias("sent_id"), "n")
    placed = packing.pack_sentences(rows, 510, ["split"])
    return placed.select("split", F.col("sent_id").alias("idx"), "n", "pack_id", "offset", "empty_before")


@query
def oversize_chunks(spark, sf_dir):
    placed = packing.pack_sentences(_word_sizes(spark, sf_dir), 30, ["doc_id"])
    rows = packing.oversize_chunks(placed.where("n > 30"), 30)
    return rows.select(*SEQ, "chunk", "pack_id", "first", "size")


@query
def pack_simple(spark, sf_dir):
    rows = features.pack_simple(corpus.packed_sentences(spark, sf_dir), CFG, ["doc_id"], apart=True)
    done = features.assemble(rows, CFG)
    return done.select(
        *PACK,
        _checksum(F.col("input_ids")).alias("input_ids"),
        _checksum(F.col("input_mask")).alias("input_mask"),
        _checksum(F.col("words_label")).alias("words_label"),
    )


@query
def padded_features(spark, sf_dir):
    rows = corpus.features(spark, sf_dir, FULL)
    numeric = [c for c in features.ARRAYS if c != "piece_list"]
    return rows.select(
        *PACK,
        *[_checksum(F.col(c)).alias(c) for c in numeric],
        F.md5(F.array_join("piece_list", " ")).alias("piece_list"),
    )


@query
def weight_matrix(spark, sf_dir):
    cells = features.weight_matrix(corpus.packs(spark, sf_dir, CFG), PACK)
    done = cells.groupBy(*PACK).agg(
        F.count("*").alias("n"),
        F.sum(F.col("word_idx") * F.col("piece_pos")).alias("place"),
        F.sum("w").alias("w"),
    )
    return _rounded(done, 8, "w")


@query
def weight_matrix_parity(spark, sf_dir):
    cells = features.weight_matrix(corpus.packs(spark, sf_dir, CFG), PACK, parity=True)
    done = cells.groupBy(*PACK).agg(
        F.count("*").alias("n"),
        F.sum(F.col("word_idx") * F.col("piece_pos")).alias("place"),
        F.sum("w").alias("w"),
    )
    return _rounded(done, 8, "w")


@query
def feature_violations(spark, sf_dir):
    """Features of length 128 checked against 96, counted by field."""
    found = features.feature_violations(corpus.features(spark, sf_dir, CFG), PACK, features.FeatureConfig(max_len=96))
    return found.groupBy("field", "size").agg(F.count("*").alias("n"))


_SUMS = T.StructType([T.StructField("n", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("total", "marked")]])


@F.arrow_udf(_SUMS)
def _matrix_sums(matrices: pa.Array) -> pa.Array:
    """Length, sum and a sum weighted by place of each flat matrix."""
    sizes = pc.list_value_length(matrices).to_numpy()
    flat, total, marked = matrices.flatten().to_numpy(), np.zeros(len(sizes)), np.zeros(len(sizes))
    marks = np.arange(sizes.max(initial=0)) % 97 + 1.0
    for i, first in enumerate(np.cumsum(sizes, dtype=np.int64) - sizes):
        row = flat[first : first + sizes[i]].astype(np.float64)
        total[i], marked[i] = row.sum(), row @ marks[: sizes[i]]
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(total), pa.array(marked)], ["n", "total", "marked"])


@query
def dense_matrix(spark, sf_dir):
    """The word-by-piece weights as flat 128 x 128 matrices: length, sum and a checksum of each."""
    cells = features.weight_matrix(corpus.packs(spark, sf_dir, CFG), PACK)
    rows = features.dense_matrix(cells, PACK, CFG.max_len)
    done = rows.select(*PACK, _matrix_sums(F.col("weight_matrix")).alias("s")).select(*PACK, "s.*")
    return _rounded(done, 3, "total", "marked")


@query
def length_violations(spark, sf_dir):
    """Unpadded sentences checked against a fixed length, counted by field and size."""
    rows = corpus.tagged_sentences(spark, sf_dir)
    found = features.length_violations(rows, SEQ, ["words", "gold", "pred"], 12)
    return found.groupBy("field", "size").agg(F.count("*").alias("n"))


@query
def feature_store(spark, sf_dir):
    """Features written by split, read back with partition pruning."""
    path = new_path(spark, "features")
    split = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'devel' ELSE 'test' END"
    made = corpus.features(spark, sf_dir, CFG).withColumn("split", F.expr(split))
    stored = writers.features_if_missing(spark, path, lambda: made).where("split = 'devel'")
    return stored.select(
        *PACK, _checksum(F.col("input_ids")).alias("input_ids"), _checksum(F.col("label_x")).alias("label_x")
    )


@query
def read_features(spark, sf_dir):
    """The test split of stored features, read with the declared schema and its pieces."""
    path = writers.feature_path(new_path(spark, "features"), "BC4CHEMD", CFG.max_len, "combine")
    split = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'devel' ELSE 'test' END"
    writers.write_features(corpus.features(spark, sf_dir, CFG).withColumn("split", F.expr(split)), path)
    rows = readers.read_features(spark, path, "test", pieces=True, keys=["doc_id"])
    return rows.select(
        *PACK,
        _checksum(F.col("input_ids")).alias("input_ids"),
        _checksum(F.col("is_start_label")).alias("is_start_label"),
        F.md5(F.array_join("piece_list", " ")).alias("piece_list"),
    )


@query
def preview(spark, sf_dir):
    """The first record, taken from its JSON."""
    rows = corpus.features(spark, sf_dir, CFG).select(*PACK, "piece_list", "label_ids")
    kind = "doc_id bigint, pack_id bigint, piece_list array<string>, label_ids array<int>"
    record = writers.preview(rows, PACK).select(F.from_json("value", kind).alias("r")).select("r.*")
    return record.select(
        *PACK, F.md5(F.array_join("piece_list", " ")).alias("piece_list"), _checksum(F.col("label_ids")).alias("label_ids")
    )


# --- scores to labels -------------------------------------------------------


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings")


def _vector_rows(spark, sf_dir):
    """Distinct use: pieces of the corpus with the id of their vector."""
    size = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    rows = corpus.pieces(spark, sf_dir)
    return rows.select(
        *SEQ, F.expr(f"id % {size}").alias("vec_id"), F.expr(f"word_pos % {size}").alias("pos_id"), "is_start"
    )


@F.arrow_udf(T.DoubleType())
def _placed_sum(vectors: pa.Array) -> pa.Array:
    """Sum of each vector's components times their places; null where the vector or a component is."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    cells = vectors.flatten()
    values = cells.to_numpy(zero_copy_only=False).astype(np.float64)
    if cells.null_count == 0 and len(sizes) and sizes[0] and (sizes == sizes[0]).all():
        return pa.array(values.reshape(len(sizes), -1) @ np.arange(1.0, sizes[0] + 1))
    own = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1.0
    total = np.bincount(own, weights=values * place, minlength=len(sizes))
    gaps = np.bincount(own, weights=cells.is_null().to_numpy(zero_copy_only=False), minlength=len(sizes)) > 0
    return pa.array(total, mask=gaps | vectors.is_null().to_numpy(zero_copy_only=False))


def _vector_sums(rows: DataFrame) -> DataFrame:
    """Sum over a document's vectors, each component weighted by its place."""
    total = _placed_sum(F.col("embedding"))
    done = rows.select("doc_id", total.alias("t")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("t").alias("total"))
    return _rounded(done, 3, "total")


@query
def embedding_gather(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).select("vec_id", "embedding")
    return _vector_sums(lookup.gather_vectors(_vector_rows(spark, sf_dir), vectors))


@query
def embedding_sum(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).select("vec_id", "embedding")
    types = vectors.where("vec_id < 2").select(F.col("vec_id").cast("int").alias("is_start"), "embedding")
    positions = vectors.withColumnRenamed("vec_id", "pos_id")
    tables = [(vectors, "vec_id"), (types, "is_start"), (positions, "pos_id")]
    rows = lookup.sum_vectors(_vector_rows(spark, sf_dir), [(*t, "embedding") for t in tables])
    return _vector_sums(rows)


WEIGHTS = [[((c * 7 + d * 3) % 11 - 5) / 8.0 for d in range(64)] for c in range(corpus.CLASSES)]
BIAS = [c / 4.0 for c in range(corpus.CLASSES)]


@query
def linear_scores(spark, sf_dir):
    rows = decode.linear_scores(_vectors(spark, sf_dir), WEIGHTS, BIAS)
    rows = rows.select("vec_id", F.posexplode("scores").alias("class_id", "score"))
    return _rounded(rows, 4, "score")


@query
def linear_tanh(spark, sf_dir):
    rows = decode.linear_scores(_vectors(spark, sf_dir), WEIGHTS, BIAS, tanh=True)
    rows = rows.select("vec_id", F.posexplode("scores").alias("class_id", "score"))
    return _rounded(rows, 4, "score")


def _pooled(spark, sf_dir) -> DataFrame:
    """Word scores of the packed corpus, pooled inside each record."""
    at = "doc_id * 3 + pack_id * 7 + i * 13"
    classes = ", ".join(f"cast(({at} + {c * 29}) % 17 / 4.0D AS double)" for c in range(corpus.CLASSES))
    emissions = F.expr(f"transform(ps_start, (p, i) -> array({classes}))")
    return decode.pool_records(corpus.packs(spark, sf_dir, CFG), PACK, emissions, corpus.CLASSES)


@query
def word_pool(spark, sf_dir):
    pooled = _pooled(spark, sf_dir).select(*PACK, F.posexplode("scores").alias("class_id", "score"))
    done = pooled.groupBy("doc_id", "class_id").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return _rounded(done, 8, "score")


@query
def pooled_labels(spark, sf_dir):
    """Pooling, softmax and argmax chained: the most likely class of every word."""
    rounded = F.transform("scores", lambda x: F.round(x, 6))
    rows = decode.classify(_pooled(spark, sf_dir).withColumn("scores", rounded))
    done = rows.groupBy("pred").agg(F.count("*").alias("n"), F.sum(F.array_max("probs")).alias("prob"))
    return _rounded(done, 2, "prob")


@query
def softmax_argmax(spark, sf_dir):
    rows = decode.classify(corpus.position_scores(spark, sf_dir))
    done = rows.groupBy("pred").agg(F.count("*").alias("n"), F.sum(F.element_at("probs", 1)).alias("p0"))
    return _rounded(done, 3, "p0")


@query
def masked_loss(spark, sf_dir):
    done = decode.masked_loss(corpus.position_scores(spark, sf_dir))
    return _rounded(done, 4, "total_loss", "mean_loss")


@query
def one_hot(spark, sf_dir):
    rows = corpus.position_scores(spark, sf_dir).select(arrays.one_hot(F.col("label_id"), corpus.CLASSES).alias("h"))
    rows = rows.select(F.posexplode("h").alias("class_id", "v"))
    return rows.groupBy("class_id").agg(F.sum("v").alias("n"))


@query
def viterbi(spark, sf_dir):
    rows = corpus.sentence_scores(spark, sf_dir)
    rows = rows.select(*SEQ, "n", decode.viterbi(F.col("flat"), corpus.TRANSITIONS).alias("v"))
    return rows.select(*SEQ, "n", "v.score", _checksum(F.col("v.path")).alias("path_sum"))


@query
def seq_loglik(spark, sf_dir):
    rows = corpus.sentence_scores(spark, sf_dir)
    done = decode.path_log_likelihood(F.col("flat"), F.col("tags"), corpus.TRANSITIONS)
    return _rounded(rows.select(*SEQ, done.alias("log_likelihood")), 4, "log_likelihood")


@query
def viterbi_long(spark, sf_dir):
    """``viterbi`` from one row a position, in blocks of 32 positions."""
    rows = long_paths.viterbi_long(corpus.position_scores(spark, sf_dir), corpus.TRANSITIONS, SEQ, block=32)
    return rows.groupBy(*SEQ).agg(
        F.count("*").cast("int").alias("n"),
        F.max_by("score", "pos").alias("score"),
        F.sum(F.col("pred").cast("long") * (F.col("pos") + 1)).alias("path_sum"),
    )


@query
def seq_loglik_long(spark, sf_dir):
    """``seq_loglik`` from one row a position, in blocks of 32 positions."""
    rows = corpus.position_scores(spark, sf_dir)
    return _rounded(long_paths.path_log_likelihood_long(rows, corpus.TRANSITIONS, SEQ, block=32), 4, "log_likelihood")


@query
def mean_loglik(spark, sf_dir):
    rows = corpus.sentence_scores(spark, sf_dir)
    done = decode.path_log_likelihood(F.col("flat"), F.col("tags"), corpus.TRANSITIONS)
    return _rounded(decode.mean_negative(rows.select(done.alias("log_likelihood"))), 4, "loss")


# --- scoring ----------------------------------------------------------------


@query
def chunk_spans(spark, sf_dir):
    return chunks.chunk_spans(corpus.tagged(spark, sf_dir), SEQ)


# A place in the whole corpus: document, line and word in one number.
_PLACE = "(doc_id * 65536 + sent_id) * 65536 + pos"


@query
def chunk_spans_long(spark, sf_dir):
    """Chunks of the whole corpus read as one sequence, in blocks of 64 documents."""
    rows = corpus.tagged(spark, sf_dir).select(F.expr(_PLACE).alias("place"), "gold")
    return chunks.chunk_spans(rows, [], "place", boundary="long_sequence", size=64 << 32)


@query
def conll_score(spark, sf_dir):
    return _metrics(chunks.score(corpus.tagged(spark, sf_dir), SEQ))


@query
def conll_score_stream(spark, sf_dir):
    return _metrics(chunks.score(corpus.tagged(spark, sf_dir), SEQ, boundary="none"))


@query
def conll_score_long(spark, sf_dir):
    """Sequence scoring in blocks, as for sequences without a length limit."""
    return _metrics(chunks.score(corpus.tagged(spark, sf_dir), SEQ, boundary="long_sequence"))


@query
def conll_file_score(spark, sf_dir):
    """Tagged column files with blank lines between sentences, read and scored."""
    rows = corpus.tagged_sentences(spark, sf_dir).select(
        *SEQ,
        F.concat(
            F.array_join(
                F.transform(
                    F.arrays_zip("words", "gold", "pred"),
                    lambda t: F.concat_ws(" ", t["words"], t["gold"], t["pred"]),
                ),
                "\n",
            ),
            F.lit("\n"),
        ).alias("lines"),
    )
    path = new_path(spark, "tagged")
    writers.write_lines(rows, "lines", path, ["doc_id"], SEQ)
    stream = readers.read_tagged(spark, path, with_number=False)
    return _metrics(chunks.score(stream, ["block"], "mark", boundary="none", streams=["file"]))


@query
def score_report(spark, sf_dir):
    return evaluate.report_lines(chunks.score(corpus.tagged(spark, sf_dir), SEQ))


@query
def score_by_run(spark, sf_dir):
    """Ten runs against gold tags that are read once."""
    return _metrics(run_scoring.score_runs(corpus.run_predictions(spark, sf_dir), SEQ, "step"), "step")


def _runs(spark, sf_dir):
    """One row per run with its overall F1; the budget is the last step."""
    scored = score_by_run(spark, sf_dir).where("level = 'overall'")
    return scored.select("step", F.lit(1000).alias("max_steps"), "f1")


@query
def run_select(spark, sf_dir):
    return training.candidate_runs(_runs(spark, sf_dir))


@query
def last_run(spark, sf_dir):
    return training.last_run(training.candidate_runs(_runs(spark, sf_dir)))


@query
def run_metrics(spark, sf_dir):
    """Run metrics appended as key and value rows and read back."""
    path = new_path(spark, "runs")
    long = _runs(spark, sf_dir).select("step", F.lit("f1").alias("key"), F.col("f1").alias("value"))
    writers.write_run_metrics(long, path)
    return spark.read.parquet(path)


def _evaluated(spark, sf_dir, mode, boundary="sequence"):
    preds = corpus.predictions(spark, sf_dir, CFG)
    return _metrics(evaluate.score_predictions(preds, corpus.labels(spark), mode, PACK, boundary))


@query
def vote_words(spark, sf_dir):
    return _evaluated(spark, sf_dir, "normal")


@query
def vote_source_words(spark, sf_dir):
    """Votes per source word over the pieces of the corpus, decoded and scored."""
    rows = corpus.pieces(spark, sf_dir).select(
        *SEQ,
        "word_pos",
        "piece_idx",
        F.col("label").alias("gold"),
        F.expr("cast((doc_id * 31 + sent_id * 17 + word_pos * 7 + piece_idx div 2) % 5 as int)").alias("pred"),
    )
    words = evaluate.vote_source_words(rows, [*SEQ, "word_pos"], "piece_idx")
    tagged = labels.decode_labels(words, corpus.labels(spark), ["gold", "pred"])
    return _metrics(chunks.score(tagged, SEQ, "word_pos"))


@query
def vote_packed_source_words(spark, sf_dir):
    """Piece predictions of packed sequences voted per source word, cut by a border or not."""
    packs = features.pack_combined(corpus.packed_sentences(spark, sf_dir), CFG, ["doc_id"], source=True, apart=True)
    # Only what is voted on travels, still packed, to the tasks that vote and score whole documents.
    packs = by_key(packs.select(*PACK, "ps_sent_id", "ps_word_pos", "ps_label"), "doc_id")
    rows = packs.selectExpr(*PACK, "posexplode(arrays_zip(ps_sent_id, ps_word_pos, ps_label)) AS (i, p)").selectExpr(
        "doc_id", "p.ps_sent_id AS sent_id", "p.ps_word_pos AS word_pos", "pack_id * 1000 + i AS place", "p.ps_label AS gold",
        "doc_id * 31 + pack_id * 17 + (i + 1) * 7 AS k",
    )
    rows = rows.withColumn("pred", F.expr("CASE WHEN k % 11 = 0 THEN 0 WHEN k % 13 = 0 THEN 5 ELSE gold END"))
    words = evaluate.vote_source_words(rows, [*SEQ, "word_pos"], "place")
    tagged = labels.decode_labels(words, corpus.labels(spark), ["gold", "pred"])
    return _metrics(chunks.score(tagged, SEQ, "word_pos"))


@query
def eval_x(spark, sf_dir):
    return _evaluated(spark, sf_dir, "X")


@query
def eval_focus(spark, sf_dir):
    return _evaluated(spark, sf_dir, "focus_weight")


@query
def eval_weight(spark, sf_dir):
    return _evaluated(spark, sf_dir, "weight")


@query
def eval_first_piece(spark, sf_dir):
    return _evaluated(spark, sf_dir, "first_piece")


@query
def eval_stream(spark, sf_dir):
    return _evaluated(spark, sf_dir, "X", boundary="none")


@query
def predictions_file(spark, sf_dir):
    """Prediction records written as JSON and read back with the declared schema."""
    path = new_path(spark, "predictions")
    writers.write_predictions(corpus.predictions(spark, sf_dir, CFG), path)
    rows = readers.read_predictions(spark, path, multi_line=False)
    return rows.agg(
        F.count("*").alias("n"),
        F.sum(_checksum(F.col("logits"))).alias("logits"),
        F.sum(_checksum(F.col("mask"))).alias("mask"),
        F.sum(_checksum(F.col("label_x"))).alias("label_x"),
    )


def _piece_predictions(spark, sf_dir):
    rows = corpus.predictions(spark, sf_dir, CFG)
    return rows.selectExpr(*PACK, "inline(arrays_zip(logits, labels, mask))")


@query
def weighted_accuracy(spark, sf_dir):
    done = evaluate.masked_accuracy(_piece_predictions(spark, sf_dir), "labels", "logits")
    return _rounded(done, 6, "accuracy")


@query
def micro_f1(spark, sf_dir):
    done = evaluate.micro_f1(_piece_predictions(spark, sf_dir), 8, "labels", "logits")
    return _rounded(done, 6, "f1")


@query
def inconsistent_words(spark, sf_dir):
    logit = F.expr("(doc_id * 31 + sent_id * 17 + word_pos * 7 + (piece_idx div 2)) % 5").alias("logit")
    rows = corpus.pieces(spark, sf_dir).select(*SEQ, "word_pos", logit)
    words = labels.mixed_words(rows, [*SEQ, "word_pos"])
    return words.groupBy("consistent").agg(F.count("*").alias("n"))


@query
def sequence_sizes(spark, sf_dir):
    rows = corpus.features(spark, sf_dir, CFG)
    return rows.select(
        *PACK,
        F.aggregate("is_start_label", F.lit(0), lambda a, x: a + x).alias("words"),
        F.aggregate("input_mask", F.lit(0), lambda a, x: a + x).alias("pieces"),
    )


# --- training input ---------------------------------------------------------


def _records(spark, sf_dir):
    return corpus.tagged_sentences(spark, sf_dir).select("split", *SEQ, F.size("words").alias("n"))


@query
def train_union(spark, sf_dir):
    rows = _records(spark, sf_dir)
    both = training.training_union(rows.where("split = 'train'"), rows.where("split = 'devel'"))
    return both.groupBy("split").agg(F.count("*").alias("records"), F.sum("n").alias("words"))


@query
def epoch_repeat(spark, sf_dir):
    rows = training.repeat_epochs(_records(spark, sf_dir).where("split = 'train'"), 3)
    return rows.groupBy("epoch").agg(F.count("*").alias("records"), F.sum("n").alias("words"))


@query
def batch_assign(spark, sf_dir):
    rows = training.assign_batches(_records(spark, sf_dir), SEQ, 16)
    return rows.groupBy("batch").agg(
        F.count("*").alias("records"), F.min("doc_id").alias("first_doc"), F.sum("n").alias("words")
    )


@query
def step_budget(spark, sf_dir):
    rows = _records(spark, sf_dir).where("split <> 'test'").agg(F.count("*").alias("records"))
    combine = training.step_budget(rows, 16, 10, "combine").withColumn("mode", F.lit("combine"))
    simple = training.step_budget(rows, 16, 10, "simple").withColumn("mode", F.lit("simple"))
    return combine.unionByName(simple)


@query
def shuffled_records(spark, sf_dir):
    """Records in shuffled order, with their places."""
    key = F.expr("((doc_id * 48271 + sent_id * 69621 + 42) % 2147483647 * 16807) % 2147483647")
    return training.shuffle_order(_records(spark, sf_dir), SEQ, 42, key, "place")


def _context(spark, sf_dir, seq=SEQ):
    rows = corpus.tagged(spark, sf_dir)
    return training.context_features(rows, F.length("word"), (1, 3, 5, 7, 2), seq, "pos")


@query
def context_window_features(spark, sf_dir):
    rows = _context(spark, sf_dir)
    return rows.groupBy("doc_id").agg(
        *[F.sum(_checksum(F.col(f"ctx_{k}"))).alias(f"ctx_{k}") for k in (1, 3, 5, 7, 2)]
    )


@query
def tagger_scores(spark, sf_dir):
    """A tagger learnt on the train split, scored on the devel split: rows of each true
    tag, and whether more of all rows are right than the commonest tag alone would get."""
    # A sentence is of one split: as a part of its key, a chosen split is taken before the windows are made.
    rows = _context(spark, sf_dir, ["split", *SEQ]).withColumn(
        "tag", F.when(F.col("gold") == "O", 0).otherwise(F.when(F.col("gold").startswith("S-"), 1).otherwise(2))
    )
    names = ["ctx_1", "ctx_3", "ctx_5", "ctx_7"]
    weights, bias = tagger.fit_tagger(rows.where("split = 'train'"), names, "tag")
    scored = tagger.score_tagger(rows.where("split = 'devel'"), names, weights, bias)
    done = decode.classify(scored.drop("pred")).groupBy("tag").agg(
        F.count("*").alias("n"), F.sum((F.col("pred") == F.col("tag")).cast("long")).alias("hits")
    )
    every = W.partitionBy(F.lit(0))  # three rows
    better = F.sum("hits").over(every) >= F.max("n").over(every)
    return done.select("tag", "n", better.alias("better"))
