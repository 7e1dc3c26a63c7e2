"""Dictionary lookups and gathering for rows that hold a list of words each.

A word that a part of the corpus uses a thousand times is looked up once for that part:
the distinct words of every group of rows are joined with the dictionary, and their
entries go to the task that holds the rows of the group. Words are then met with their
entries on Arrow batches, so no occurrence of a word is exchanged by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.arrays import from_line, sizes_and_nulls, to_line, to_lists
from tagloom.workspace import is_small, store

# Rows of an Arrow batch: each has the words of one part of a sentence.
RECORDS = 512
# Words of one group of rows, about, and words that are handled at once.
GROUP_WORDS = 4_000_000
STEP_WORDS = 1 << 18


def word_parts(sentences: DataFrame, sentence: Sequence[str], size: int) -> DataFrame:
    """``(sentence…, part, word, label, word_pos)`` from lists ``word`` and ``label``: runs of ``size`` words.

    Sentences with the same key are one sentence. Only then ``word_pos`` lists the places
    of the words; else it is null, and they are numbered from ``part * size``.
    """
    keys = [*sentence, "part"]
    runs = F.when(F.size("word") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.expr(f"(size(word) - 1) div {size}").cast("int")))
    rows = sentences.where(F.size("word") > 0).withColumn("part", F.explode(runs.cast("array<bigint>")))

    def cut(c: str) -> Column:
        first = (F.col("part") * size + 1).cast("int")
        return F.when(F.size("word") <= size, F.col(c)).otherwise(F.slice(c, first, size)).alias(c)

    rows = rows.select(*keys, cut("word"), cut("label"))
    again = store(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    nowhere = F.lit(None).cast("array<int>").alias("word_pos")
    if again.isEmpty():
        return rows.select("*", nowhere)
    again = again.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = None
    for k in keys:
        match = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = match if same is None else same & match
    place = F.transform("word", lambda w, i: (F.col("part") * size + i).cast("int"))
    held = rows.join(again, same, "left_semi").withColumn("word_pos", place)
    held = held.groupBy(*keys).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("word", "label", "word_pos")])
    return rows.join(again, same, "left_anti").select("*", nowhere).unionByName(held)


def lookup_lists(rows: DataFrame, dictionary: DataFrame, near: Sequence[str]) -> DataFrame:
    """Rows with a list ``word`` -> the same rows with ``pieces``, a list for each word, by ``dictionary(word, n, pieces)``.

    A null word has no pieces; one that is not in the dictionary is an error. A small
    dictionary goes to every executor. With a larger one rows lie together by ``near``.
    """
    values = dictionary.select("word", "pieces")
    lists = T.StructField("pieces", T.ArrayType(dictionary.schema["pieces"].dataType))
    schema = T.StructType([*rows.schema.fields, lists])
    names = rows.columns
    if is_small(dictionary):
        shared = rows.sparkSession.sparkContext.broadcast(values.where("word IS NOT NULL").toArrow().combine_chunks())

        def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            words, pieces = (_whole(known.column(c)) for c in ("word", "pieces"))
            for batch in _larger(batches):
                yield from _attached(batch, names, words, pieces)

        return rows.mapInArrow(attach, schema)

    uses = dictionary.agg(F.sum("n")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-uses // GROUP_WORDS))
    # Words travel as lines.
    placed = rows.select(_group(rows, near, parts).alias("_grp"), to_line(F.col("word")).alias("_line"), *[c for c in names if c != "word"])
    asked = placed.select("_grp", "_line").repartition(parts, "_grp").select("_grp", F.explode(from_line(F.col("_line"))).alias("word"))
    asked = store(asked.where("word IS NOT NULL").distinct(), "asked")
    kind = dictionary.schema["pieces"].dataType
    missing = F.raise_error(F.concat(F.lit("word not in the dictionary: "), F.col("word"))).cast(kind)
    # A group asks for a word once, so no word has more rows than there are groups.
    found = asked.join(values, "word", "left").withColumn("pieces", F.coalesce("pieces", missing))
    found = store(found.select("_grp", F.lit(0).alias("_kind"), F.col("word").alias("_word"), F.col("pieces").alias("_pieces")), "found")
    both = found.unionByName(placed.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(parts, "_grp").sortWithinPartitions("_grp", "_kind")
    both = both.withColumn("word", from_line(F.col("_line"))).drop("_line")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, words, pieces = None, [], None, None
        for batch in _larger(batches):
            if not batch.num_rows:
                continue
            grp, kinds = (batch.column(c).to_numpy() for c in ("_grp", "_kind"))
            cuts = np.flatnonzero(np.append(True, (grp[1:] != grp[:-1]) | (kinds[1:] != kinds[:-1])))
            for first, last in zip(cuts, np.append(cuts[1:], len(grp))):
                run = batch.slice(first, last - first)
                if grp[first] != group:
                    group, held, words = grp[first], [], None
                if kinds[first] == 0:
                    held.append((run.column("_word"), run.column("_pieces")))
                    continue
                if words is None:
                    words, pieces = (pa.concat_arrays([h[i] for h in held]) if held else run.column(c).slice(0, 0) for i, c in enumerate(("_word", "_pieces")))
                yield from _attached(run, names, words, pieces)

    return both.mapInArrow(meet, schema)


def _group(rows: DataFrame, near: Sequence[str], parts: int) -> Column:
    """A number for each partition that rows with equal ``near`` columns can go to, so that every one gets its share."""
    spark = rows.sparkSession
    tried = spark.range(0, 20 * parts + 100).select(F.col("id").cast("int").alias("k"))
    firsts = tried.groupBy(F.expr(f"pmod(hash(k), {parts})").alias("p")).agg(F.min("k").alias("k")).orderBy("p").collect()
    keys = ", ".join(str(r["k"]) for r in firsts)
    names = ", ".join(f"`{c}`" for c in near)
    return F.expr(f"element_at(array({keys}), pmod(hash({names}), {len(firsts)}) + 1)")


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``STEP_WORDS`` rows or words: a table of words is made for each of them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows + len(batch.column("word").flatten())
        if size >= STEP_WORDS:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _steps(sizes: np.ndarray) -> Iterable[tuple[int, int]]:
    """Runs of rows of about ``STEP_WORDS`` words, one row at least."""
    mark = (np.cumsum(sizes) - sizes) // STEP_WORDS
    cuts = np.flatnonzero(np.append(True, mark[1:] != mark[:-1])) if len(sizes) else np.array([], int)
    return zip(cuts, np.append(cuts[1:], len(sizes)))


def _attached(batch: pa.RecordBatch, names: list[str], words: pa.Array, pieces: pa.Array) -> Iterator[pa.RecordBatch]:
    for first, last in _steps(sizes_and_nulls(batch.column("word"))[0]):
        part = batch.slice(first, last - first)
        lists = part.column("word")
        sizes, nulls = sizes_and_nulls(lists)
        flat = lists.flatten()
        at = pc.index_in(flat, value_set=words)
        lost = np.flatnonzero((flat.is_valid().to_numpy(zero_copy_only=False)) & at.is_null().to_numpy(zero_copy_only=False))
        if len(lost):
            raise ValueError(f"word not in the dictionary: {flat[int(lost[0])].as_py()}")
        found = pieces.take(at)
        widths, _ = sizes_and_nulls(found)
        inner = to_lists(found.flatten(), widths, np.zeros(len(widths), bool))
        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], to_lists(inner, sizes, nulls)], [*names, "pieces"])


def gathered_lists(parts: DataFrame, sentence: Sequence[str], size: int) -> DataFrame:
    """``(sentence…, part, ps, n_words, n)`` from rows of :func:`word_parts` with the ``pieces`` of their words.

    Words that stand in another order than their ``word_pos`` are sorted by place, label and pieces.
    """
    keys = [*sentence, "part"]
    label = parts.schema["label"].dataType.elementType
    kind = {f.name: f.dataType for f in parts.schema["pieces"].dataType.elementType.elementType}
    cells = {"piece": kind["piece"], "id": T.IntegerType(), "label": label, "start": kind["start"], "focus": kind["focus"], "weight": kind["weight"], "word_pos": T.IntegerType()}
    fields = T.StructType([T.StructField(n, t) for n, t in cells.items()])
    counts = [T.StructField("n_words", T.LongType(), False), T.StructField("n", T.LongType(), False)]
    schema = T.StructType([*[parts.schema[k] for k in keys], T.StructField("ps", T.ArrayType(fields)), *counts])
    wanted = parts.select(*keys, "label", "word_pos", "pieces")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _steps(sizes_and_nulls(batch.column("pieces"))[0]):
                yield _gathered(batch.slice(first, last - first), keys, size)

    return wanted.mapInArrow(gather, schema)


def _gathered(batch: pa.RecordBatch, keys: list[str], size: int) -> pa.RecordBatch:
    lists = batch.column("pieces")
    sizes, _ = sizes_and_nulls(lists)
    words, labels = lists.flatten(), batch.column("label").flatten()
    own = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    place = batch.column("part").to_numpy()[own] * size + np.arange(len(own)) - begins[own]
    given = batch.column("word_pos")
    if given.null_count < len(given):
        listed = np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False)[own])
        place[listed] = given.flatten().to_numpy()
        order = np.arange(len(own))
        for row in np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False)):
            span = np.arange(begins[row], begins[row] + sizes[row])
            order[span] = sorted(span.tolist(), key=lambda i: (int(place[i]), _rank(labels[i].as_py()), [[_rank(v) for v in p.values()] for p in words[i].as_py()]))
        place, words, labels = place[order], words.take(pa.array(order)), labels.take(pa.array(order))
    widths, _ = sizes_and_nulls(words)
    of = np.repeat(np.arange(len(own)), widths)
    pieces = words.flatten()
    cells = {
        "piece": pieces.field("piece"),
        "id": pieces.field("id").cast(pa.int32(), safe=False),
        "label": labels.take(pa.array(of)),
        "start": pieces.field("start"),
        "focus": pieces.field("focus"),
        "weight": pieces.field("weight"),
        "word_pos": pa.array(place[of], pa.int32()),
    }
    n = np.bincount(own, weights=widths, minlength=len(sizes)).astype(np.int64)
    n_words = np.bincount(own[widths > 0], minlength=len(sizes)).astype(np.int64)
    ps = to_lists(pa.StructArray.from_arrays(list(cells.values()), list(cells)), n, np.zeros(len(n), bool))
    made = pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], ps, pa.array(n_words), pa.array(n)], [*keys, "ps", "n_words", "n"])
    return made.filter(pa.array(n > 0))


def _rank(value) -> tuple:
    """Nulls first, text by its bytes."""
    return (value is not None, value.encode() if isinstance(value, str) else value if value is not None else 0)
