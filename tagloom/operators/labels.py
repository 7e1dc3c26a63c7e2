"""Label dictionaries and the alignment of word labels to pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.operators.scan import rank_ids
from tagloom.workspace import broadcast_if_small, is_small, store

OUTSIDE = "O"
IGNORED = "X"


def first_seen(rows: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Distinct values with the order key where each is first seen."""
    return rows.groupBy(value).agg(F.min(F.struct(*order)).alias("seen"))


def label_dictionary(rows: DataFrame, order: Sequence[str], label: str = "label") -> DataFrame:
    """Written ``(label, id)``: outside label 0, the rest as first seen, ``X`` last.

    The outside label and ``X`` have these places whether or not the rows hold them.
    """
    others = first_seen(rows, label, order).where(~F.col(label).isin(OUTSIDE, IGNORED))
    others = others.select(F.col(label).alias("label"), "seen")
    ranked = rank_ids(others, ["seen"]).select("label", (F.col("id") + 1).cast("int").alias("id"))
    spark = rows.sparkSession
    ends = spark.range(1).select(F.lit(OUTSIDE).alias("label"), F.lit(0).alias("id"))
    last = ranked.agg((F.count("*") + 1).cast("int").alias("id")).select(F.lit(IGNORED).alias("label"), "id")
    return store(ends.unionByName(ranked).unionByName(last), "labels")


def class_count(labels: DataFrame) -> DataFrame:
    return labels.agg((F.count("*") - 1).alias("classes"))


def encode_labels(rows: DataFrame, labels: DataFrame, label: str = "label", to: str = "label_id") -> DataFrame:
    """Label to id; an unknown label gets the outside id. Labels occur once in ``labels``."""
    known = broadcast_if_small(labels.select(F.col("label").alias(label), F.col("id").alias("_id")))
    outside = labels.where(F.col("label") == OUTSIDE).first()["id"]
    return (
        rows.join(known, label, "left")
        .withColumn(to, F.coalesce("_id", F.lit(outside)))
        .drop("_id")
    )


def decode_labels(rows: DataFrame, labels: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Replace id columns by labels. The highest id (``X``) and unknown ids read ``O``."""
    top = labels.agg(F.max("id")).first()[0]
    known = labels.where(F.col("id") < top)
    small = is_small(known)
    for name in ids:
        names = (F.broadcast if small else lambda x: x)(known.select(F.col("id").alias(name), F.col("label").alias("_label")))
        rows = rows.join(names, name, "left").withColumn(name, F.coalesce("_label", F.lit(OUTSIDE)))
        rows = rows.drop("_label")
    return rows


def align(tokenized: DataFrame, x_id: int, label: str = "label") -> DataFrame:
    """One row per piece of ``tokenized(…, label, pieces)`` in all labelling schemes.

    ``label`` on every piece, ``label_x`` on the first piece only, ``focus_label`` on
    the longest piece only (``X`` elsewhere), with their masks and the weight.
    """
    kept = [c for c in tokenized.columns if c != "pieces"]
    rows = tokenized.select(*kept, F.posexplode("pieces").alias("piece_idx", "p"))
    return rows.select(
        *kept,
        "piece_idx",
        "p.piece",
        "p.id",
        F.col("p.start").alias("is_start"),
        F.when(F.col("p.start") == 1, F.col(label)).otherwise(x_id).alias("label_x"),
        F.when(F.col("p.focus") == 1, F.col(label)).otherwise(x_id).alias("focus_label"),
        F.col("p.focus").alias("focus_mask"),
        F.col("p.weight").alias("weight"),
    )


def piece_histogram(tokenized: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Number of words by number of pieces: ``(n_pieces, n_words)``.

    With ``order``, also ``seen``: the least of these columns among the words of each row.
    """
    counts = [F.count("*").alias("n_words")] + ([F.min(F.struct(*order)).alias("seen")] if order else [])
    return tokenized.where(F.size("pieces") > 0).groupBy(F.size("pieces").alias("n_pieces")).agg(*counts)


def top_widths(histogram: DataFrame, first_seen: str | None = None, top: int = 4, fixed: bool = False):
    """The most frequent piece counts, as ``(rank, width)``.

    Ties go to the count seen first when that column is given, else to the smaller
    one. ``fixed`` returns the constant widths instead.
    """
    # The constant widths.
    if fixed:
        return histogram.sparkSession.createDataFrame(
            [(i + 1, w) for i, w in enumerate((1, 3, 5, 7))], "rank int, width int"
        )
    best = histogram.orderBy(F.desc("n_words"), F.col(first_seen or "n_pieces")).limit(top)
    order = W.orderBy(F.desc("n_words"), F.col(first_seen or "n_pieces"))
    return best.select(F.row_number().over(order).alias("rank"), F.col("n_pieces").alias("width"))


def mixed_words(piece_labels: DataFrame, word: Sequence[str], label: str = "logit") -> DataFrame:
    """Words whose pieces carry more than one label.

    Smallest and largest label are kept per word instead of a distinct count: the
    partial sums stay two numbers wide.
    """
    spread = piece_labels.groupBy(*word).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    return spread.select(*word, (F.col("lo") == F.col("hi")).alias("consistent"))
