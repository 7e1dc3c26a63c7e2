"""A corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import decontaminate, language, near_dups, packing, queries, repeats
from tagloom.workspace import store


#: Least mean probability of a document's language over its words. At sf0.1 it keeps 0.996 of the held-out documents;
#: of the documents of a language left out of training it keeps 0.01 (en, es, fr) to 0.4 (de, whose words resemble English).
CONFIDENT = 0.75


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language stay, and ``lang`` becomes the predicted one.

    Those without letters and those with no language that reaches this share go.
    """
    model = language.train(language.training_sample(docs, "doc_id", "text", "lang", ~queries.held_out()))
    kept = language.predict(docs, "doc_id", "text", model, whole_rows=True)
    kept = kept.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= CONFIDENT))
    columns = [F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns]
    return kept.select(columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the least id."""
    classes = near_dups.near_groups(docs, "doc_id", "text")
    surplus = store(classes.where("id <> class_id").select(F.col("id").alias("doc_id")), "surplus")
    kept = docs.join(surplus, "doc_id", "left_anti")
    # Rows that repeat both id and text are one document. A row travels as one struct: no helper column can clash.
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    kept = kept.select("doc_id", text.alias("t"), F.struct(*docs.columns).alias("row"))
    return kept.dropDuplicates(["doc_id", "t"]).select("row.*")


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur more than once are cut out; every document stays."""
    return repeats.remove_passages(docs, "doc_id", "text").withColumn("n_chars", F.length("text").cast("long"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half, or 50, of the words of a benchmark item go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = decontaminate.leaks(docs, "doc_id", "text", bench).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(store(leaked, "leaked"), "doc_id", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, "doc_id", "text", queries.TOKENIZER).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("repeat_removal", repeat_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
