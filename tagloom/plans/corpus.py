"""Labelled corpora derived from the given tables by fixed arithmetic rules.

The tables hold raw text; gold and predicted tags, splits and scores follow from
document, sentence and word numbers, so results can be recomputed in any engine.
Everything here is row-local: a sentence is an array until a job needs rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.arrays import sizes_and_nulls, to_lists
from tagloom.operators.features import PART_WORDS, FeatureConfig, assemble, pack_combined, sentence_pieces
from tagloom.operators.labels import align
from tagloom.operators.scan import rank_ids
from tagloom.operators.word_lists import RECORDS, word_parts
from tagloom.operators.wordpiece import tokenize, word_counts, word_dictionary
from tagloom.workspace import by_key, once, settle, spread, store

CLASSES = 5
# The label dictionary of the derived corpus.
LABELS = {
    "O": 0,
    "B-Chemical": 1,
    "I-Chemical": 2,
    "E-Chemical": 3,
    "S-Chemical": 4,
    "B-Disease": 5,
    "I-Disease": 6,
    "E-Disease": 7,
    "S-Disease": 8,
    "X": 9,
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def sentences(spark: SparkSession, sf_dir: str, by_doc: bool = False) -> DataFrame:
    """``(doc_id, sent_id, words)``: one row per non-empty text line.

    With ``by_doc`` the raw text is hash-distributed by document before it is
    exploded: later per-sentence windows and groupings then need no further
    exchange, and the exchange that remains moves plain text, not token rows.
    """
    docs = documents(spark, sf_dir)
    docs = by_key(docs, "doc_id") if by_doc else spread(docs)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_id", "line"))
    return lines.select(
        "doc_id",
        F.col("sent_id").cast("long").alias("sent_id"),
        F.filter(F.split("line", " "), lambda w: w != "").alias("words"),
    ).where(F.size("words") > 0)


# SQL over one sentence row: i is the 0-based word number, the word before it is
# element i and the word after it element i + 2 in 1-based array access.
_GOLD = f"""transform(words, (w, i) -> CASE
    WHEN length(w) < 9 THEN 'O'
    ELSE concat(
      CASE WHEN i > 0 AND length(try_element_at(words, i)) >= 9
           THEN CASE WHEN coalesce(length(try_element_at(words, i + 2)), 0) >= 9 THEN 'I-' ELSE 'E-' END
           ELSE CASE WHEN coalesce(length(try_element_at(words, i + 2)), 0) >= 9 THEN 'B-' ELSE 'S-' END
      END,
      CASE WHEN doc_id % 2 = 0 THEN 'Chemical' ELSE 'Disease' END)
  END)"""
_KEY = "(doc_id * 31 + sent_id * 17 + i * 7)"


def _pred(modulus: str) -> str:
    return f"""transform(gold, (g, i) -> CASE
      WHEN {_KEY} % {modulus} = 0 THEN 'O'
      WHEN {_KEY} % 13 = 0 THEN 'S-Gene' ELSE g END)"""


def tagged_sentences(spark: SparkSession, sf_dir: str, by_doc: bool = False) -> DataFrame:
    """Sentences with ``gold`` and ``pred`` tag arrays and the ``split`` name."""
    return (
        sentences(spark, sf_dir, by_doc)
        .selectExpr("*", f"{_GOLD} AS gold")
        .selectExpr(
            "*",
            f"{_pred('11')} AS pred",
            "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'devel'"
            " ELSE 'test' END AS split",
        )
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, sent_id, word_pos, word)``: one row per word."""
    return sentences(spark, sf_dir).selectExpr(
        "doc_id", "sent_id", "posexplode(words) AS (word_pos, word)"
    )


def tagged(spark: SparkSession, sf_dir: str, by_doc: bool = True) -> DataFrame:
    """``(doc_id, sent_id, pos, word, gold, pred, split)``: one row per word."""
    rows = tagged_sentences(spark, sf_dir, by_doc).select(
        "doc_id", "sent_id", "split", F.posexplode(F.arrays_zip("words", "gold", "pred")).alias("pos", "w")
    )
    return rows.select("doc_id", "sent_id", "split", "pos", "w.words", "w.gold", "w.pred").withColumnRenamed(
        "words", "word"
    )


def vocabulary(spark: SparkSession, sf_dir: str, counts: DataFrame) -> DataFrame:
    """Written ``(piece, id)`` table derived from distinct-word counts.

    Special marks, then frequent characters and their continuation forms, frequent
    short words, and frequent three-letter endings; ids follow (class, piece).
    """
    low = counts.select(F.lower("word").alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))
    chars = (
        low.select("n", F.explode(F.split("w", "")).alias("c"))
        .where(F.col("c") != "")
        .groupBy("c")
        .agg(F.sum("n").alias("n"))
        .where("n >= 50")
    )
    ends = (
        low.where(F.length("w") >= 6)
        .groupBy(F.expr("right(w, 3)").alias("c"))
        .agg(F.sum("n").alias("n"))
        .where("n >= 10")
    )
    special = spark.createDataFrame(
        [(0, f"{i}", p) for i, p in enumerate(("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"))],
        "class int, ord string, piece string",
    )
    parts = [
        chars.selectExpr("1 AS class", "c AS ord", "c AS piece"),
        chars.selectExpr("2 AS class", "concat('##', c) AS ord", "concat('##', c) AS piece"),
        low.where("n >= 5 AND length(w) BETWEEN 2 AND 12").selectExpr("3 AS class", "w AS ord", "w AS piece"),
        ends.selectExpr("4 AS class", "concat('##', c) AS ord", "concat('##', c) AS piece"),
    ]
    entries = special
    for part in parts:
        entries = entries.unionByName(part)
    return store(rank_ids(entries, ["class", "ord"]).select("piece", "id"), "vocab")


def _once(spark: SparkSession, sf_dir: str, name: str, build):
    """Tables written once per application and state of the documents, then re-read."""
    return once(spark, [f"{sf_dir}/documents.parquet"], name, build)


def counted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "counts", lambda: store(word_counts(words(spark, sf_dir)), "word_counts")
    )


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "vocab", lambda: vocabulary(spark, sf_dir, counted_words(spark, sf_dir))
    )


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of the corpus with their pieces."""
    return _once(
        spark,
        sf_dir,
        "dictionary",
        lambda: word_dictionary(counted_words(spark, sf_dir), vocab(spark, sf_dir)),
    )


def label_ids(tags: str) -> str:
    """SQL for the ids of an array of tags, unknown tags reading as outside."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in LABELS.items())
    return f"transform({tags}, t -> coalesce(try_element_at(map({pairs}), t), 0))"


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELS.items()), "label string, id int")


def labelled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, sent_id, split, word_pos, word, label)`` with gold label ids."""
    rows = tagged_sentences(spark, sf_dir).selectExpr(
        "doc_id", "sent_id", "split", "words", f"{label_ids('gold')} AS ids"
    )
    return rows.selectExpr(
        "doc_id", "sent_id", "split", "posexplode(arrays_zip(words, ids)) AS (word_pos, w)"
    ).selectExpr("doc_id", "sent_id", "split", "word_pos", "w.words AS word", "w.ids AS label")


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled words with their pieces."""
    return tokenize(labelled_words(spark, sf_dir), dictionary(spark, sf_dir))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece in all labelling schemes."""
    return align(tokenized(spark, sf_dir), LABELS["X"])


def packed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written table of sentences with their labelled pieces."""

    keys = ["doc_id", "sent_id"]

    def pieces():
        rows = tagged_sentences(spark, sf_dir).selectExpr(*keys, "words AS word", f"{label_ids('gold')} AS label")
        parts = word_parts(rows, keys, PART_WORDS)
        return sentence_pieces(tokenize(parts, dictionary(spark, sf_dir), near=["doc_id"]), keys)

    def build():
        dictionary(spark, sf_dir)  # written before: it stays, the tables of the steps go
        return settle(spark, "sentence_pieces", pieces, narrow=True, records=RECORDS)

    return _once(spark, sf_dir, "sentences", build)


def packs(spark: SparkSession, sf_dir: str, cfg: FeatureConfig) -> DataFrame:
    return pack_combined(packed_sentences(spark, sf_dir), cfg, ["doc_id"], apart=True)


def features(spark: SparkSession, sf_dir: str, cfg: FeatureConfig) -> DataFrame:
    return assemble(packs(spark, sf_dir, cfg), cfg)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _disturbed(labels: pa.Array, key: pa.Array) -> pa.Array:
    """At place i 0 where 11 divides key + 7 i, else 5 where 13 does, else the label."""
    sizes, nulls = sizes_and_nulls(labels)
    own = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = pc.fill_null(key, 0).to_numpy().astype(np.int64)[own] + place * 7
    known = ~key.is_null().to_numpy(zero_copy_only=False)[own]
    flat = pc.if_else(pa.array((at % 13 == 0) & known), pa.scalar(5, pa.int32()), labels.flatten())
    flat = pc.if_else(pa.array((at % 11 == 0) & known), pa.scalar(0, pa.int32()), flat)
    return to_lists(flat, sizes, nulls)


def predictions(spark: SparkSession, sf_dir: str, cfg: FeatureConfig) -> DataFrame:
    """Prediction records of the packed corpus: gold ids disturbed by position."""
    return features(spark, sf_dir, cfg).select(
        "doc_id",
        "pack_id",
        _disturbed("label_ids", F.expr("cast(doc_id * 31 + pack_id * 17 AS bigint)")).alias("logits"),
        F.col("label_ids").alias("labels"),
        F.col("input_mask").alias("mask"),
        "is_start_label",
        "piece_list",
        "label_x",
        F.col("is_weight_focus").alias("weight_focus_label"),
    )


def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, sent_id, n, flat, tags)``: class scores of every word, position-major.

    Scores are quarters, exact in binary; ties between classes occur.
    """
    at = "doc_id * 3 + sent_id * 7 + (x div {c}) * 13 + (x % {c}) * 29".format(c=CLASSES)
    return sentences(spark, sf_dir).selectExpr(
        "doc_id",
        "sent_id",
        "size(words) AS n",
        f"transform(sequence(0, size(words) * {CLASSES} - 1), x -> cast(({at}) % 17 / 4.0D AS double)) AS flat",
        f"transform(words, (w, i) -> cast((length(w) + i) % {CLASSES} AS int)) AS tags",
    )


TRANSITIONS = [[((i * 5 + j * 3) % 7) / 4.0 for j in range(CLASSES)] for i in range(CLASSES)]


def position_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, sent_id, pos, scores, label_id, mask)``: one row per word."""
    rows = sentences(spark, sf_dir).selectExpr("doc_id", "sent_id", "posexplode(words) AS (pos, word)")
    # The cells of ``sentence_scores``, from numbers alone and without a list of the sentence.
    cells = ", ".join(
        f"cast((doc_id * 3 + sent_id * 7 + pos * 13 + {k * 29}) % 17 / 4.0D AS double)" for k in range(CLASSES)
    )
    return rows.selectExpr(
        "doc_id",
        "sent_id",
        "pos",
        f"array({cells}) AS scores",
        f"cast((length(word) + pos) % {CLASSES} AS int) AS label_id",
        "CASE WHEN pos % 4 = 3 THEN 0 ELSE 1 END AS mask",
    )


def run_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, sent_id, step, tags)``: gold tags (null step) and those of ten runs.

    Each run disturbs the gold tags at its own rate.
    """
    rows = tagged_sentences(spark, sf_dir, by_doc=True).select("doc_id", "sent_id", "gold")
    steps = F.expr("concat(array(cast(NULL AS int)), sequence(100, 1000, 100))")
    rows = rows.withColumn("step", F.explode(steps))
    pred = _pred("(11 + step div 100)")
    return rows.selectExpr("doc_id", "sent_id", "step", f"CASE WHEN step IS NULL THEN gold ELSE {pred} END AS tags")
