"""Chunk scoring of many runs against one gold side.

The gold tags of a sequence are read once: their chunk starts, ends and types are worked
out for the gold row, and every run of the sequence adds only its own tags. Rows of a
sequence lie next to each other, gold first; the counting is done on whole Arrow batches
and a batch gives one row for each run and combination of types.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.chunks import SUMS, _by_type, add_metrics


class _Tags:
    """Numbers of tags, and what the chunk rules ask of a tag, as arrays by number.

    Number 0 is the outside tag, which also stands before a sequence.
    """

    def __init__(self):
        self.number = {"O": 0}
        self._derive()

    def codes(self, tags: pa.Array) -> np.ndarray:
        if tags.null_count:
            raise ValueError("a tag is null")
        coded = tags.dictionary_encode()
        before = len(self.number)
        known = [self.number.setdefault(t, len(self.number)) for t in coded.dictionary.to_pylist()]
        if len(self.number) > before:
            self._derive()
        return np.array(known, np.int64)[coded.indices.to_numpy()]

    def _derive(self):
        parts = [t.partition("-") for t in self.number]
        prefixes = np.array([p for p, _, _ in parts])
        self.types, self.type = np.unique([t for _, _, t in parts], return_inverse=True)
        self.prefix = np.unique(prefixes, return_inverse=True)[1]
        self.always = np.isin(prefixes, ["B", "S", "[", "]"])
        self.enters = np.isin(prefixes, ["E", "I"])
        self.after = np.isin(prefixes, ["E", "S", "O"])
        self.inside = ~np.isin(prefixes, ["O", "."])
        self.final = np.isin(prefixes, ["E", "S", "[", "]"])
        self.goes_on = np.isin(prefixes, ["B", "I"])
        self.cuts = np.isin(prefixes, ["B", "S", "O"])

    def starts(self, prev: np.ndarray, own: np.ndarray) -> np.ndarray:
        other = self.type[prev] != self.type[own]
        return self.always[own] | (self.after[prev] & self.enters[own]) | (self.inside[own] & other)

    def ends(self, prev: np.ndarray, own: np.ndarray) -> np.ndarray:
        other = self.type[prev] != self.type[own]
        return self.final[prev] | (self.goes_on[prev] & self.cuts[own]) | (self.inside[prev] & other)


def _before(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    prev = np.empty_like(codes)
    prev[1:] = codes[:-1]
    prev[firsts] = 0
    return prev


def _cells(tags: _Tags, gold, pred: np.ndarray, at: np.ndarray, sizes: np.ndarray, run: np.ndarray):
    """Sums per run and types of one batch; ``at`` is the gold position of every tag of ``pred``."""
    own, prev_gold, gold_start, gold_end = (side[at] for side in gold)
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    prev = _before(pred, first[sizes > 0])
    pred_start, pred_end = tags.starts(prev, pred), tags.ends(prev, pred)
    same = tags.type[own] == tags.type[pred]
    closes = gold_end & pred_end & (tags.type[prev_gold] == tags.type[prev])
    enters = gold_start & pred_start & same
    changes = enters | closes | (gold_end != pred_end) | ~same
    # A tag stands inside a correct chunk if the latest change before it in its row was an entry.
    place = np.arange(len(pred))
    latest = np.maximum.accumulate(np.where(changes, place, -1))
    earlier = np.append(-1, latest[:-1])
    row_first = np.repeat(first, sizes)
    inside = (earlier >= row_first) & enters[earlier]
    is_last = np.zeros(len(pred), bool)
    is_last[last[sizes > 0]] = True
    left_open = is_last & np.where(changes, enters, inside)
    hit = same & (tags.prefix[own] == tags.prefix[pred])

    n = len(tags.types)
    key = np.repeat(run, sizes)
    for part in (tags.type[own], tags.type[pred], tags.type[prev_gold]):
        key = key * n + part
    found, group = np.unique(key, return_inverse=True)
    sums = (gold_start, pred_start, inside & closes, left_open, hit, np.ones(len(pred), bool))
    counts = [np.bincount(group[s], minlength=len(found)) for s in sums]
    kinds = []
    for _ in range(3):
        found, kind = np.divmod(found, n)
        kinds.append(pa.array(tags.types[kind].tolist(), pa.string()))
    return found, kinds[::-1], counts


def run_cells(rows: DataFrame, seq: Sequence[str], run: str, tags: str) -> DataFrame:
    """Chunk sums per run and combination of types; see :func:`score_runs`."""
    order = W.partitionBy(*seq).orderBy(F.asc_nulls_first(run))
    same = F.coalesce(F.col(run) == F.lag(run).over(order), F.lit(False))
    orphan = (F.row_number().over(order) == 1) != F.col(run).isNull()
    # One window puts the rows of a sequence together and in order; batches then keep that order.
    ordered = rows.select(F.col(run).alias("run"), F.col(tags).alias("tags"), (same | orphan).alias("wrong"))
    fields = [T.StructField(run, rows.schema[run].dataType)]
    fields += [T.StructField(c, T.StringType()) for c in ("gt", "pt", "prev_gt")]
    fields += [T.StructField(c, T.LongType()) for c in SUMS]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tags()
        carried = np.empty(0, np.int64)  # gold tags of the sequence that the batch before ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, lists = batch.column("run"), batch.column("tags")
            if pc.any(batch.column("wrong")).as_py():
                raise ValueError("a sequence needs one gold row and each run at most once")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            codes = known.codes(lists.flatten())
            is_gold = runs.is_null().to_numpy(zero_copy_only=False)
            of_gold = np.repeat(is_gold, sizes)
            gold = np.concatenate([carried, codes[of_gold]])
            gold_sizes = np.append(len(carried), sizes[is_gold])
            gold_first = np.cumsum(gold_sizes) - gold_sizes
            prev = _before(gold, gold_first[gold_sizes > 0])
            sides = (gold, prev, known.starts(prev, gold), known.ends(prev, gold))
            mine = np.cumsum(is_gold)[~is_gold]  # 0 is the carried gold row
            carried = gold[gold_first[-1] :]
            own = sizes[~is_gold]
            if (own != gold_sizes[mine]).any():
                raise ValueError("a run has another number of tags than the gold row")
            if not own.sum():
                continue
            first = np.cumsum(own) - own
            at = np.repeat(gold_first[mine] - first, own) + np.arange(own.sum())
            names = runs.filter(pa.array(~is_gold)).dictionary_encode()
            code = names.indices.to_numpy().astype(np.int64)
            found, kinds, counts = _cells(known, sides, codes[~of_gold], at, own, code)
            values = [names.dictionary.take(pa.array(found)), *kinds, *[pa.array(c, pa.int64()) for c in counts]]
            yield pa.RecordBatch.from_arrays(values, [f.name for f in fields])

    return ordered.mapInArrow(count, T.StructType(fields))


def score_runs(rows: DataFrame, seq: Sequence[str], run: str = "run", tags: str = "tags") -> DataFrame:
    """Per-type and overall chunk metrics of every run, as ``chunks.score(by=[run])`` gives.

    ``rows(seq…, run, tags)`` has one array of tags for each sequence and run, and the gold
    tags of the sequence in the row whose run is null: usually a union of the gold table and
    the runs' tables. A run need not have every sequence. Null or empty arrays count
    nothing. A null tag, a sequence without a gold row or with two, a run that occurs twice
    in a sequence, or another number of tags than gold is an error. Sequences must fit an
    array; longer ones are for ``chunks.score``.
    """
    return add_metrics(_by_type(run_cells(rows, seq, run, tags), [run]))
