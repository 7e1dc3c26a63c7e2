"""Repair of the structure of conversations at the least cost.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Rows
are kept, given another role or deleted, and empty rows are inserted. The cheapest way,
and of equally cheap ones the one whose letters come first in ASCII order, is a shortest
path in an acyclic graph of (row, state of the pattern). Its weights are single big
integers: the high digits are the cost, the low digits, of fixed width, the letters of
the edits by position, with zeros at the end. So one integer minimum decides everything.

The path is found from the last row to the first, in blocks of ``BLOCK`` rows. What
follows a block is known by the cost and the rank of its letters for each state; the
rank takes one more digit at the end. (Every row takes one letter that is no insertion,
so no letters of a block begin with all of another's, and ranks decide rightly.) A
conversation of any length is thus streamed: backwards for the choices, forwards for
the edits, a block in memory at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 256
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Digits of the letters in ASCII order; 0 is padding.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = "_DIKR"
BASE = 5
#: State -> initial -> next state: 0 nothing yet, 1 after s, 2 after u, 3 after a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {"u": "user", "a": "assistant"}
#: State -> (initial, next state) of the only row that can be inserted there.
INSERTED = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
_TOP = BASE ** (3 * BLOCK + 3)  # letters of a block, at most three a row and two at the end, and the rank

# A row that is still there has one of these faults or none.
NONE_, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
FAULTS = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": CUT}


def _before(weight: int, cost: int, letter: str) -> int:
    """Weight of the path that begins with an edit and goes on as ``weight`` does."""
    high, low = divmod(weight, _TOP)
    return (high + cost) * _TOP + DIGIT[letter] * (_TOP // BASE) + low // BASE


def _inserts(plain: list[int], codes: list[str]) -> tuple[list[int], list[str]]:
    """Least weights by state when up to two rows may be inserted first."""
    once = [_before(plain[to], INSERT, "I") for _, to in INSERTED]
    twice = [_before(once[to], INSERT, "I") for _, to in INSERTED]
    weights, found = [], []
    for state in range(4):
        to = INSERTED[state][1]
        ways = [
            (plain[state], codes[state]),
            (once[state], "I" + codes[to]),
            (twice[state], "II" + codes[INSERTED[to][1]]),
        ]
        weight, code = min(ways)
        weights.append(weight)
        found.append(code)
    return weights, found


#: Weights and edits after the last row: nothing may follow only in the states 0 and 3.
_NEVER = 10**6 * _TOP
END = _inserts([0, _NEVER, _NEVER, 0], [""] * 4)


def step(weights: list[int], initial: str, fault: int) -> tuple[list[int], list[str]]:
    """Least weights before a row, and its edits by state, from the weights after it."""
    plain, codes = [], []
    extra = TRUNCATED if fault == CUT else 0
    for state in range(4):
        ways = [(_before(weights[state], DELETE, "D"), "D")]
        if fault not in (BLANK, DUPLICATE):
            if initial in NEXT[state]:
                ways.append((_before(weights[NEXT[state][initial]], KEEP + extra, "K"), "K"))
            for other in ROLE:
                if other in NEXT[state]:
                    ways.append((_before(weights[NEXT[state][other]], REROLE + extra, "R"), "R"))
        weight, code = min(ways)
        plain.append(weight)
        codes.append(code)
    return _inserts(plain, codes)


def ranked(weights: list[int]) -> list[int]:
    """The same costs with the rank of the letters in their place."""
    lows = sorted({w % _TOP for w in weights})
    return [w // _TOP * _TOP + lows.index(w % _TOP) for w in weights]


def fault_of(text: str, repeated: bool) -> int:
    body = text.rstrip(SPACE)
    return BLANK if not body else DUPLICATE if repeated else CUT if body[-1] not in ".!?" else NONE_


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to rows, from the last to the first of each conversation, their fault and edits by state."""
    conversation: object = _NEVER
    weights: list[int] = []
    count = 0
    for batch in batches:
        faults, choices = [], []
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "present", "role", "text", "repeated"))
        for conv, present, role, text, repeated in zip(*columns):
            if conv != conversation:
                conversation, weights, count = conv, END[0], 0
            if not present:
                faults.append(NONE_)
                choices.append("")
                continue
            if count == BLOCK:
                weights, count = ranked(weights), 0
            fault = fault_of(text, repeated)
            weights, codes = step(weights, role[:1], fault)
            count += 1
            faults.append(fault)
            choices.append(",".join(codes))
        added = {"fault": pa.array(faults, pa.int32()), "choices": pa.array(choices, pa.string())}
        yield pa.record_batch({n: batch.column(n) for n in batch.schema.names if n != "repeated"} | added)


class _Edits:
    """Edited rows of conversations that come in order."""

    NAMES = ("conv_id", "turn", "edit", "cost", "old_role", "fault", "role", "text")
    KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string())
    SCHEMA = "conv_id long, turn long, edit string, cost long, old_role string, fault int, role string, text string"

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.state = 0

    def insert(self, conv: object) -> None:
        initial, self.state = INSERTED[self.state]
        self.rows.append((conv, None, "I", INSERT, None, None, ROLE[initial], ""))

    def end(self, conv: object) -> None:
        for _ in END[1][self.state]:
            self.insert(conv)

    def row(self, conv: object, turn: int | None, role: str, text: str, fault: int, choices: str) -> None:
        code = choices.split(",")[self.state]
        for _ in code[:-1]:
            self.insert(conv)
        edit, made = code[-1], role
        extra = TRUNCATED if fault == CUT else 0
        if edit == "R":
            made = next(ROLE[i] for i in ROLE if i in NEXT[self.state])
        if edit != "D":
            self.state = NEXT[self.state][made[:1]]
        cost = {"K": KEEP + extra, "R": REROLE + extra, "D": DELETE}[edit]
        self.rows.append((conv, turn, edit, cost, role, fault, made, text))

    def take(self) -> pa.RecordBatch:
        made = pa.record_batch([pa.array(x, k) for x, k in zip(zip(*self.rows), self.KINDS)], names=self.NAMES)
        self.rows = []
        return made


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, with inserted rows at their places."""
    edits, conversation, open_ = _Edits(), None, False
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "present", "turn", "role", "text", "fault", "choices"))
        for conv, present, turn, role, text, fault, choices in zip(*columns):
            if not open_ or conv != conversation:
                if open_:
                    edits.end(conversation)
                conversation, open_, edits.state = conv, True, 0
            if present:
                edits.row(conv, turn, role, text, fault, choices)
            else:
                edits.rows.append((conv, None, "", 0, None, None, None, None))
            if len(edits.rows) >= 1024:
                yield edits.take()
    if open_:
        edits.end(conversation)
        if edits.rows:
            yield edits.take()


class _Summary:
    """Counts and digests of one conversation, row by row."""

    def __init__(self) -> None:
        self.least = self.most = self.last_turn = self.initial = None
        self.distinct = self.illegal = self.cost = 0
        self.faults = [0] * 4
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.rows = 0

    def add(self, turn: int | None, edit: str, cost: int, old_role: str | None, fault: int | None, role: str, text: str) -> None:
        self.cost += cost
        self.audit.append(edit)
        if edit in ("K", "R", "I"):
            self.digest.update((("\n" if self.rows else "") + f"{role}:{text}").encode())
            self.rows += 1
        if fault is None:
            return
        self.faults[fault] += 1
        if self.initial is not None and self.initial + old_role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = old_role[:1]
        if turn is not None:
            self.distinct += turn != self.last_turn
            self.least = turn if self.least is None else self.least
            self.most = self.last_turn = turn

    def row(self, conv: object) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
    "audit string, repaired_sha256 string"
)
_REPORT_KINDS = [pa.int64()] * 7 + [pa.string()] * 2
_REPORT_NAMES = [f.split()[0] for f in REPORT.split(",")]


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    summary, conversation = None, None
    done: list[tuple] = []

    def take() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(x, k) for x, k in zip(zip(*done), _REPORT_KINDS)], names=_REPORT_NAMES)
        done.clear()
        return made

    for batch in batches:
        for conv, *values in zip(*(batch.column(n).to_pylist() for n in _Edits.NAMES)):
            if summary is None or conv != conversation:
                if summary is not None:
                    done.append(summary.row(conversation))
                conversation, summary = conv, _Summary()
            summary.add(*values)
            if len(done) >= 1024:
                yield take()
    if summary is not None:
        done.append(summary.row(conversation))
        yield take()


def marked(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Rows of all conversations with their place and whether role and text were seen earlier in theirs.

    ``turns`` has conv_id, turn, role, text; null roles and texts count as one space. Rows
    come by turn, null turns first; rows of one turn by role and text. Rows that are not
    ``present`` only keep their conversation in the result.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        (F.lit(True) if present is None else present).alias("present"),
    )
    order = [F.col("present").asc(), F.col("turn").asc_nulls_first(), "role", "text"]
    # One exchange by conversation serves both windows; neither holds more than a row.
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)))
    same = W.partitionBy("conv_id", F.md5(F.concat_ws("\0", "role", "text").cast("binary")), "present")
    return rows.withColumn("repeated", F.row_number().over(same.orderBy("place")) > 1)


def repaired_rows(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Edited rows of every conversation, in order inside their partition.

    Columns: conv_id, turn, edit (K keep, R other role, D delete, I insert), cost,
    old_role, fault (0 none, 1 blank, 2 duplicate, 3 truncated), role, text. Rows with
    edit D are no longer part of the conversation. Extra columns of ``turns`` are not
    read. Roles count by their first character; a row with an empty role is never kept
    as it is. Rows without an id are one conversation. A conversation of which no row is
    ``present`` gives one row with an empty edit; no rows give no rows.
    """
    rows = marked(turns, present)
    kinds = "conv_id long, turn long, role string, text string, present boolean, place int, fault int, choices string"
    back = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("place").desc())
    chosen = back.mapInArrow(_choose, kinds)
    forth = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return forth.select("conv_id", "present", "turn", "role", "text", "fault", "choices").mapInArrow(_edit, _Edits.SCHEMA)


def repair_report(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Per conversation: gaps of turns, rows by first fault, adjacent roles that do not fit, cost, edits, digest.

    The digest of a conversation (``role:text`` of what is left, joined by line feeds) is
    sequential by nature, and is fed row by row. See ``repaired_rows`` for edge cases.
    """
    return repaired_rows(turns, present).mapInArrow(_summarise, REPORT)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with every twentieth row, by a hash of its key, lost, emptied, cut, doubled or given to the user.

    Rows that are lost stay with ``present`` false.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.pmod(F.crc32(F.concat(text[0], F.lit(":"), text[1]).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", text[2].alias("role"), text[3].alias("text"), kind.alias("kind"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("kind") != 0).alias("present"),
    )
