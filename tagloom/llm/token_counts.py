"""Token counts kept up to date by signed changes.

Totals by source, language and tokenizer version are sums, so a change to a document
is a signed row: an insert adds its counts, a delete takes them away, a revision adds
the difference. A batch of changes is summed and written once under its id; a batch
that is committed already is left as it is, so a retry changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.tokens import Encoder

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def _count(batches: Iterator[pa.RecordBatch], tokenizers: Mapping[str, str]) -> Iterator[pa.RecordBatch]:
    encoders = {name: Encoder(file, added=True) for name, file in tokenizers.items()}
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            texts, revised = (part.column(n).to_pylist() for n in (3, 4))
            for name, encoder in encoders.items():
                old = [len(encoder.encode(x)) // 4 for x in texts]
                new = [None if x is None else len(encoder.encode(x)) // 4 for x in revised]
                columns = [*part.columns[:3], pa.array([name] * part.num_rows), pa.array(old, pa.int64()), pa.array(new, pa.int64())]
                yield pa.record_batch(columns, names=["id", "source", "lang", "tokenizer", "n_tokens", "n_revised"])


def counted(
    docs: DataFrame,
    tokenizers: Mapping[str, str],
    revised: Column | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
) -> DataFrame:
    """(id, source, lang, tokenizer, n_tokens, n_revised) of every document and tokenizer version.

    ``tokenizers`` maps a version's name to its file's content; ``revised`` is a new text,
    null where a document stays as it is. A null text counts as empty; null ids,
    sources and languages are values of their own, and rows that repeat an id are
    documents of their own. Further columns do not matter; an empty table gives no rows.
    Texts are read once, here; changes and joins work on counts.
    """
    held = docs.sparkSession.sparkContext.broadcast(dict(tokenizers))  # a few vocabularies
    new = F.lit(None) if revised is None else revised
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source).cast("string").alias("source"),
        F.col(lang).cast("string").alias("lang"),
        F.col(text).cast("string").alias("text"),
        new.cast("string").alias("revised"),
    )
    schema = "id long, source string, lang string, tokenizer string, n_tokens long, n_revised long"
    return rows.mapInArrow(lambda it: _count(it, held.value), schema)


def _summed(rows: DataFrame, docs: int, tokens: Column) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum(F.lit(docs)).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    """Changes of documents that come in."""
    return _summed(counts, 1, F.col("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes of documents, as they were counted, that go."""
    return _summed(counts, -1, -F.col("n_tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Changes of documents that have a revised count; they stay where they are."""
    return _summed(counts.where("n_revised IS NOT NULL"), 0, F.col("n_revised") - F.col("n_tokens"))


class Rollup:
    """Totals in a folder: one sub-folder of summed changes for each committed batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _names(self) -> list[str]:
        """Committed batches: the writer's mark stands in their folders."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        found = [x.getPath() for x in files.listStatus(folder)]
        mark = context._jvm.org.apache.hadoop.fs.Path
        return sorted(x.getName() for x in found if files.exists(mark(x, "_SUCCESS")))

    def committed(self) -> list[str]:
        return [x.removeprefix("batch=") for x in self._names()]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False, without reading them, if its id is committed.

        A batch that was left half-written has no mark, counts for nothing and is
        written anew.
        """
        if batch in self.committed():
            return False
        summed = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all batches; groups with nothing left vanish."""
        paths = [f"{self.path}/{x}" for x in self._names()]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths)
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 OR n_tokens <> 0")
