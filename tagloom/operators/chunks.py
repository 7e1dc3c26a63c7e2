"""Chunk scoring of gold against predicted tags (CoNLL rules)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.functions.tags import chunk_ends, chunk_starts, tag_prefix, tag_type
from tagloom.operators.scan import BLOCK, prior_values
from tagloom.workspace import broadcast_if_small, store

COUNTS = ("gold", "guessed", "correct")
#: Sequences of a stream in one block.
SPAN = 256


def _split_tags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "gp": tag_prefix(F.col("gold")),
            "gt": tag_type(F.col("gold")),
            "pp": tag_prefix(F.col("pred")),
            "pt": tag_type(F.col("pred")),
        }
    )


def _parts() -> Column:
    return F.struct("gp", "gt", "pp", "pt")


def _with_events(df: DataFrame) -> DataFrame:
    """Add chunk starts/ends and the row's effect on "inside a correct chunk".

    Needs the current tag parts and ``prev``, the parts of the row before (null at
    the start). The effect is 1 (enter), 0 (leave) or null (unchanged).
    """
    prev = {c: F.coalesce(F.col(f"prev.{c}"), F.lit(d)) for c, d in
            (("gp", "O"), ("gt", ""), ("pp", "O"), ("pt", ""))}
    df = df.withColumns({f"prev_{c}": v for c, v in prev.items()})
    df = df.withColumns(
        {
            "gold_start": chunk_starts(*map(F.col, ("prev_gp", "prev_gt", "gp", "gt"))),
            "gold_end": chunk_ends(*map(F.col, ("prev_gp", "prev_gt", "gp", "gt"))),
            "pred_start": chunk_starts(*map(F.col, ("prev_pp", "prev_pt", "pp", "pt"))),
            "pred_end": chunk_ends(*map(F.col, ("prev_pp", "prev_pt", "pp", "pt"))),
        }
    )
    same_type = F.col("gt") == F.col("pt")
    closes = F.col("gold_end") & F.col("pred_end") & (F.col("prev_gt") == F.col("prev_pt"))
    breaks = (F.col("gold_end") != F.col("pred_end")) | ~same_type
    return df.withColumns(
        {
            "closes": closes,
            "effect": F.when(F.col("gold_start") & F.col("pred_start") & same_type, 1)
            .when(closes | breaks, 0),
        }
    )


def chunk_rows(
    tagged: DataFrame,
    seq: Sequence[str],
    pos: str = "pos",
    boundary: str = "sequence",
    streams: Sequence[str] = (),
) -> DataFrame:
    """Row-level scoring facts for ``tagged(seq…, pos, gold, pred)``.

    ``boundary="sequence"`` scores every sequence on its own, one window each (a
    sequence comes from one text line or one padded record); ``"long_sequence"`` does
    the same in blocks, for sequences without a length limit. ``boundary="none"`` reads
    all rows as one stream ordered by ``seq + pos`` with no breaks (one per
    ``streams`` group, e.g. per file); rows are then scanned in blocks, so no task
    holds a stream.
    """
    rows = _split_tags(tagged)
    seq = list(seq)
    if boundary == "sequence":
        order = W.partitionBy(*seq).orderBy(pos)
        rows = _with_events(rows.withColumn("prev", F.lag(_parts()).over(order)))
        before = order.rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("inside", F.last("effect", ignorenulls=True).over(before))
        ends = F.lead(F.lit(1)).over(order).isNull()
    elif boundary == "long_sequence":
        return _stream_rows(rows, [pos], seq)
    elif boundary == "none":
        return _stream_rows(rows, [c for c in seq if c not in streams] + [pos], list(streams))
    else:
        raise ValueError(f"unknown boundary {boundary!r}")
    return _with_closings(rows.withColumns({"inside": F.coalesce("inside", F.lit(0)), "is_last": ends}))


def _with_closings(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "closed": (F.col("inside") == 1) & F.col("closes"),
            "left_open": F.col("is_last") & (F.coalesce("effect", "inside") == 1),
        }
    )


def _stream_rows(rows: DataFrame, keys: list[str], streams: list[str]) -> DataFrame:
    """Scoring facts of whole streams.

    A block of rows is summed up by its first and last tags and its last effect, not
    counting the first row, whose effect depends on the block before. Scanning those
    summaries gives every block the tags and the state it starts from.
    """
    *outer, pos = keys
    rows = rows.withColumn("blk", F.expr(f"`{pos}` div {BLOCK}"))
    block = [*streams, *outer, "blk"]
    order = W.partitionBy(*block).orderBy(pos)
    rows = rows.withColumn("prev", F.lag(_parts()).over(order))
    known = _with_events(rows).withColumn("effect", F.when(F.col("prev").isNotNull(), F.col("effect")))
    summary = known.groupBy(*block).agg(
        F.min_by(_parts(), pos).alias("head"),
        F.max_by(_parts(), pos).alias("tail"),
        F.max_by("effect", F.when(F.col("effect").isNotNull(), F.col(pos))).alias("effect"),
    )
    at = [*outer, "blk"]
    summary = prior_values(store(summary, "summary"), at, {"prev": ("last", F.col("tail"))}, streams)
    heads = _with_events(summary.withColumnRenamed("effect", "later").select("*", "head.*"))
    heads = heads.select(*block, "prev", F.coalesce("later", "effect").alias("effect"))
    starts = prior_values(store(heads, "heads"), at, {"state": ("last", F.col("effect"))}, streams)
    last = starts.groupBy(*streams).agg(F.max(F.struct(*at)).alias("k")).select(*streams, "k.*")
    starts = starts.join(last.withColumn("is_tail", F.lit(True)), block, "left")
    starts = store(starts.select(*block, F.col("prev").alias("before"), "state", "is_tail"), "starts")

    rows = rows.join(broadcast_if_small(starts), block)
    rows = _with_events(rows.withColumn("prev", F.coalesce("prev", "before")))
    ahead = order.rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.last("effect", ignorenulls=True).over(ahead), F.col("state"), F.lit(0))
    is_last = F.coalesce("is_tail", F.lit(False)) & F.lead(F.lit(1)).over(order).isNull()
    return _with_closings(rows.withColumns({"inside": inside, "is_last": is_last}))


def _one(cond: Column) -> Column:
    return F.sum(cond.cast("long"))


SUMS = ("g", "p", "c", "o", "hits", "tokens")


def _counted(rows: DataFrame) -> Column:
    return ~F.col("is_break") if "is_break" in rows.columns else F.lit(True)


def _hit() -> Column:
    return (F.col("gp") == F.col("pp")) & (F.col("gt") == F.col("pt"))


def _stream_cells(
    tagged: DataFrame, keys: list[str], streams: list[str], by: list[str], blocks: str | None = None
) -> DataFrame:
    """Sums of whole streams per combination of types, without labelling rows.

    A block is a range of sequences (of positions, if the stream has no sequences). In
    it only two things depend on what comes before: its first row, and whether the first
    later row that closes a chunk closes a correct one. So a block is a function from
    the tags and state before it to counts and to the tags and state after it, made of
    sums, the two rows and its last row. Rows are read once and summed; then the
    functions are applied block after block by a scan of one row each.
    """
    *outer, pos = keys
    inner = [outer[-1], pos] if outer else [pos]
    at = [*outer[:-1], "blk"]
    block = [*streams, *at]
    number = F.col(blocks) if blocks else F.expr(f"`{inner[0]}` div {SPAN if outer else BLOCK}")
    rows = _split_tags(tagged).withColumn("blk", number)
    order = W.partitionBy(*block).orderBy(*inner)
    rows = _with_events(rows.withColumn("prev", F.lag(_parts()).over(order)))
    head, tail = F.col("prev").isNull(), F.lead(F.lit(1)).over(order).isNull()
    rows = rows.withColumns({"is_head": head, "is_tail": tail, "effect": F.when(~head, F.col("effect"))})
    inside = F.last("effect", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("inside", inside)
    rows = rows.withColumn("opens", ~F.col("is_head") & F.col("inside").isNull() & F.col("effect").isNotNull() & F.col("closes"))
    kept = F.col("is_head") | F.col("is_tail") | F.col("opens")
    rows = rows.withColumns(
        {
            "own": F.when(kept, F.struct(*inner)),  # these rows stay by themselves
            "head": F.when(F.col("is_head"), _parts()),
            "tail": F.when(F.col("is_tail"), _parts()),
            "state": F.when(F.col("is_tail"), F.coalesce("effect", "inside")),
            "prev_gt": F.when(F.col("is_head"), "").otherwise(F.col("prev_gt")),
        }
    )
    special = ["own", "head", "tail", "state", "opens"]
    later = ~F.col("is_head")
    cells = rows.groupBy(*block, "gt", "pt", "prev_gt", *special).agg(
        _one(later & F.col("gold_start")).alias("g"),
        _one(later & F.col("pred_start")).alias("p"),
        _one(later & F.col("closes") & (F.coalesce("inside", F.lit(0)) == 1)).alias("c"),
        F.lit(0).cast("long").alias("o"),
        _one(_counted(rows) & _hit()).alias("hits"),
        _one(_counted(rows)).alias("tokens"),
    )
    cells = store(cells, "cells")
    summary = cells.where("own IS NOT NULL").groupBy(*block).agg(
        F.max("head").alias("head"),
        F.max("tail").alias("tail"),
        F.max("state").alias("state"),
        F.max(F.when(F.col("opens"), F.col("prev_gt"))).alias("opened_gt"),
    )
    summary = prior_values(store(summary, "summary"), at, {"prev": ("last", F.col("tail"))}, streams)
    heads = _with_events(summary.select("*", "head.*"))
    heads = store(heads.drop("head").withColumn("after", F.coalesce("state", "effect")), "heads")
    heads = prior_values(heads, at, {"before": ("last", F.col("after"))}, streams)
    last = heads.groupBy(*streams).agg(F.max(F.struct(*at)).alias("k")).select(*streams, "k.*")
    heads = heads.join(last.withColumn("is_end", F.lit(True)), block, "left")
    before = F.coalesce("before", F.lit(0))
    entered = F.coalesce("effect", before) == 1

    def cell(gt: Column, pt: Column, prev_gt: Column, **sums: Column) -> Column:
        values = [sums.get(n, F.lit(False)).cast("long").alias(n) for n in SUMS]
        return F.struct(gt.alias("gt"), pt.alias("pt"), prev_gt.alias("prev_gt"), *values)

    none = F.lit("")
    ends = F.coalesce("is_end", F.lit(False)) & (F.coalesce("after", before) == 1)
    found = F.array(
        cell(F.col("gt"), F.col("pt"), F.col("prev_gt"), g=F.col("gold_start"), p=F.col("pred_start"), c=F.col("closes") & (before == 1)),
        cell(none, none, F.coalesce("opened_gt", none), c=F.col("opened_gt").isNotNull() & entered),
        cell(F.col("tail.gt"), none, none, o=ends),
    )
    names = [*by, "gt", "pt", "prev_gt", *SUMS]
    return cells.select(names).unionByName(heads.select(*by, F.inline(found)).select(names))


def chunk_counts(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gold, guessed and correct chunks per type and overall, plus token accuracy.

    Rows are first summed per combination of types (map-side, a handful of rows);
    the split into one row per type happens on those sums.
    """
    by = list(by)
    cells = rows.groupBy(*by, "gt", "pt", "prev_gt").agg(
        _one(F.col("gold_start")).alias("g"),
        _one(F.col("pred_start")).alias("p"),
        _one(F.col("closed")).alias("c"),
        _one(F.col("left_open")).alias("o"),
        _one(_counted(rows) & _hit()).alias("hits"),
        _one(_counted(rows)).alias("tokens"),
    )
    return _by_type(cells, by)


def _by_type(cells: DataFrame, by: list[str]) -> DataFrame:
    """One row per type and one overall from sums per combination of types."""
    sums = [F.sum(c).alias(c) for c in SUMS]
    cells = cells.groupBy(*by, "gt", "pt", "prev_gt").agg(*sums)

    def part(type_, g="0L", p="0L", c="0L", n="0L", h="0L"):
        return (
            f"named_struct('type',{type_},'gold',{g},'guessed',{p},'correct',{c},"
            f"'tokens',{n},'hits',{h})"
        )

    parts = ",".join(
        [
            part("gt", g="g", c="o", n="tokens", h="hits"),
            part("pt", p="p"),
            part("prev_gt", c="c"),
        ]
    )
    flat = cells.selectExpr(*by, f"inline(array({parts}))")
    if not by:  # an empty stream has an overall row as well
        none = [F.lit("").alias("type"), *[F.lit(0).cast("long").alias(c) for c in (*COUNTS, "tokens", "hits")]]
        flat = flat.unionByName(flat.sparkSession.range(1).select(*none))
    sums = [F.sum(c).alias(c) for c in (*COUNTS, "tokens", "hits")]
    whole = F.grouping("type") == 1
    return (
        flat.groupingSets([[*by, "type"], by], *by, "type")
        .agg(*sums, F.when(whole, "overall").otherwise("type").alias("level"))
        .where((F.col("level") == "overall") | (F.col("gold") > 0) | (F.col("guessed") > 0))
        .select(
            *by,
            "level",
            F.coalesce("type", F.lit("")).alias("type"),
            *COUNTS,
            *[F.when(F.col("level") == "overall", F.col(c)).alias(c) for c in ("tokens", "hits")],
        )
    )


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def add_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and token accuracy; 0 where a denominator is 0."""
    p, r = F.col("precision"), F.col("recall")
    return (
        counts.withColumns(
            {
                "tp": F.col("correct"),
                "fp": F.col("guessed") - F.col("correct"),
                "fn": F.col("gold") - F.col("correct"),
                "precision": ratio(F.col("correct"), F.col("guessed")),
                "recall": ratio(F.col("correct"), F.col("gold")),
                "accuracy": F.when(F.col("tokens").isNotNull(), ratio(F.col("hits"), F.col("tokens"))),
            }
        )
        .withColumn("f1", ratio(2 * p * r, p + r))
    )


def score(
    tagged: DataFrame,
    seq: Sequence[str],
    pos: str = "pos",
    boundary: str = "sequence",
    by: Sequence[str] = (),
    streams: Sequence[str] = (),
    blocks: str | None = None,
) -> DataFrame:
    """Per-type and overall chunk metrics of ``tagged(seq…, pos, gold, pred)``.

    Streams (``boundary="none"``) are scored in one pass over the rows when ``by`` tells
    no more apart than streams do; see ``_stream_cells``. ``blocks`` names a column that
    holds the block of a row of a stream, its last sequence number ``div SPAN``: rows that
    already lie together by it are not exchanged again.
    """
    streams = list(streams or by)
    if boundary == "none" and set(by) <= set(streams):
        keys = [c for c in seq if c not in streams] + [pos]
        return add_metrics(_by_type(_stream_cells(tagged, keys, streams, list(by), blocks), list(by)))
    return add_metrics(chunk_counts(chunk_rows(tagged, seq, pos, boundary, streams), by))


def _spanned(rows: DataFrame) -> DataFrame:
    """Add whether a chunk starts at a row and whether one ends before it, from ``prev``."""
    prev_p, prev_t = F.coalesce(F.col("prev.gp"), F.lit("O")), F.coalesce(F.col("prev.gt"), F.lit(""))
    return rows.withColumns(
        {
            "starts": chunk_starts(prev_p, prev_t, F.col("gp"), F.col("gt")),
            "ends": chunk_ends(prev_p, prev_t, F.col("gp"), F.col("gt")),
        }
    )


def _numbered_blocks(rows: DataFrame, seq: list[str], pos: str, size: int) -> DataFrame:
    """Rows with ``prev``, starts, ends, chunk numbers and ``is_last``, block by block.

    A block is summed up by its first and last row and by the number of chunks that start
    after its first row. Scanning those summaries tells each block the row before it and
    how many chunks started before it.
    """
    block = [*seq, "blk"]
    rows = rows.withColumn("blk", F.expr(f"`{pos}` div {size}"))
    order = W.partitionBy(*block).orderBy(pos)
    rows = _spanned(rows.withColumn("prev", F.lag("own").over(order)))
    later = F.col("prev").isNotNull() & F.col("starts")
    summary = rows.groupBy(*block).agg(
        F.min_by("own", pos).alias("own"), F.max_by("own", pos).alias("tail"), F.sum(later.cast("long")).alias("later")
    )
    heads = prior_values(store(summary, "summary"), ["blk"], {"prev": ("last", F.col("tail"))}, seq)
    heads = _spanned(heads.select("*", "own.gp", "own.gt"))
    heads = heads.select(*block, "prev", (F.col("later") + F.col("starts").cast("long")).alias("opened"))
    heads = prior_values(store(heads, "heads"), ["blk"], {"ahead": ("sum", F.col("opened"))}, seq)
    last = heads.groupBy(*seq).agg(F.max("blk").alias("blk")).withColumn("is_tail", F.lit(True))
    heads = heads.join(last, block, "left").select(*block, F.col("prev").alias("earlier"), "ahead", "is_tail")
    rows = rows.drop("starts", "ends").join(broadcast_if_small(store(heads, "starts")), block)
    rows = _spanned(rows.withColumn("prev", F.coalesce("prev", "earlier")))
    is_last = F.coalesce("is_tail", F.lit(False)) & F.lead(F.lit(1)).over(order).isNull()
    return rows.withColumns({"no": F.col("ahead") + F.sum(F.col("starts").cast("long")).over(order), "is_last": is_last})


def chunk_spans(
    tagged: DataFrame,
    seq: Sequence[str],
    pos: str = "pos",
    tag: str = "gold",
    boundary: str = "sequence",
    size: int = BLOCK,
) -> DataFrame:
    """One row per chunk: sequence, first and last position, type.

    Chunks are numbered by their starts. An end mark closes the chunk numbered last
    before it, at the position before the mark; the sequence's last position closes
    a chunk that is still open. ``boundary="long_sequence"`` does the same in blocks of
    ``size`` positions, for sequences without a length limit; without ``seq`` all rows are
    one sequence. Its positions are integers, once each in a sequence, gaps allowed.
    """
    seq = list(seq)
    rows = tagged.withColumns({"gp": tag_prefix(F.col(tag)), "gt": tag_type(F.col(tag))})
    rows = rows.withColumn("own", F.struct("gp", "gt", F.col(pos).alias("at")))
    if boundary == "sequence":
        order = W.partitionBy(*seq).orderBy(pos)
        rows = _spanned(rows.withColumn("prev", F.lag("own").over(order)))
        number = F.sum(F.col("starts").cast("int")).over(order)
        rows = rows.withColumns({"no": number, "is_last": F.lead(F.lit(1)).over(order).isNull()})
    elif boundary == "long_sequence":
        rows = _numbered_blocks(rows, seq, pos, size)
    else:
        raise ValueError(f"unknown boundary {boundary!r}")
    rows = rows.withColumn("before", F.col("prev.at"))

    def mark(when: Column, no: Column, start: Column, end: Column, kind: Column) -> Column:
        return F.when(
            when, F.struct(no.alias("no"), start.alias("start"), end.alias("end"), kind.alias("type"))
        )

    none, at = F.lit(None), F.col(pos)
    nothing, no_kind = none.cast(tagged.schema[pos].dataType), none.cast("string")
    marks = F.array(
        mark(F.col("starts"), F.col("no"), at, nothing, F.col("gt")),
        mark(F.col("ends"), F.col("no") - F.col("starts").cast("int"), nothing, F.col("before"), no_kind),
        mark(F.col("is_last"), F.col("no"), nothing, at, no_kind),
    )
    found = rows.select(*seq, F.inline(F.filter(marks, lambda m: m.isNotNull())))
    chunks = found.groupBy(*seq, "no").agg(
        F.min("start").alias("start"), F.min("end").alias("end"), F.max("type").alias("type")
    )
    return chunks.where("start IS NOT NULL").drop("no")
