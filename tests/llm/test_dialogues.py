import hashlib
import heapq
import random
import re
import zlib

import pytest
from tagloom.llm import dialogues, queries

LEGAL = re.compile(r"(s?(ua)+)?\Z")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by a search in order of cost and letters."""
    bad = faults(rows)
    heap, seen = [(0, "", 0, "", ())], set()
    found = None
    while heap:
        cost, audit, at, last, made = heapq.heappop(heap)
        if found and (cost, audit) >= found[:2]:
            continue
        if at == len(rows) and last in ("", "a"):
            if found is None or (cost, audit) < found[:2]:
                found = cost, audit, made
        for new, role in (("u", "user"), ("a", "assistant")):
            if new in NEXT[last] and cost < 3 * len(rows) and not audit.endswith("III"):
                heapq.heappush(heap, (cost + 2, audit + "I", at, new, (*made, (role, ""))))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last, made))
            if bad[at] in ("", "truncated"):
                more = cost + (bad[at] == "truncated")
                if role[:1] in NEXT[last] and role[:1]:
                    heapq.heappush(heap, (more, audit + "K", at + 1, role[:1], (*made, (role, text))))
                for new, name in (("u", "user"), ("a", "assistant")):
                    if new in NEXT[last]:
                        heapq.heappush(heap, (more + 2, audit + "R", at + 1, new, (*made, (name, text))))
    return found


def exact(rows):
    """The same by dynamic programming over strings, for longer conversations."""
    bad = faults(rows)
    after = {s: {"": (0, "", ()), "a": (0, "", ())}.get(s) for s in ("", "s", "u", "a")}

    def inserted(best):
        out = {}
        for s in best:
            ways, at, made = [], s, ()
            for n in range(3):
                if best[at] is not None:
                    ways.append((best[at][0] + 2 * n, "I" * n + best[at][1], made + best[at][2]))
                at = "a" if at == "u" else "u"
                made = (*made, ("assistant" if at == "a" else "user", ""))
            out[s] = min(ways, key=lambda w: w[:2]) if ways else None
        return out

    after = inserted(after)
    for (role, text), fault in list(zip(rows, bad))[::-1]:
        now = {}
        for s in after:
            ways = [(3 + after[s][0], "D" + after[s][1], after[s][2])]
            if fault in ("", "truncated"):
                more = fault == "truncated"
                if role[:1] in NEXT[s] and role[:1]:
                    c, a, m = after[role[:1]]
                    ways.append((c + more, "K" + a, ((role, text), *m)))
                for new, name in (("u", "user"), ("a", "assistant")):
                    if new in NEXT[s]:
                        c, a, m = after[new]
                        ways.append((c + more + 2, "R" + a, ((name, text), *m)))
            now[s] = min(ways, key=lambda w: w[:2])
        after = inserted(now)
    return after[""]


def report(conv, rows):
    """Expected row of a conversation of (turn, role, text) in order."""
    plain = [(r, t) for _, r, t in rows]
    bad = faults(plain)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
    cost, audit, made = exact(plain)
    assert LEGAL.match("".join(r[:1] for r, _ in made))
    text = "\n".join(f"{r}:{t}" for r, t in made)
    counts = [bad.count(f) for f in ("blank", "duplicate", "truncated")]
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def key(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, text)


def damage(rows):
    """Rows of all conversations after damage, as the query does it."""
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        held += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {conv: sorted(held, key=key) for conv, held in out.items()}


ROLES = ["user", "assistant", "system", "tool", "User", ""]
TEXTS = ["Yes.", "No!", "why", "", " \t", "a?\n", "ok ", "é.", "a. "]


def test_both_searches_agree():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice(ROLES[:4]), rng.choice(TEXTS)) for _ in range(rng.randint(0, 5))]
        assert cheapest(rows) == exact(rows)


@pytest.mark.parametrize("block", [256, 1, 3])
def test_equals_search(spark, monkeypatch, block):
    rng = random.Random(block)
    rows = []
    for conv in range(60):
        size = rng.choice([1, 2, 3, 5, 8, 40])
        rows += [(conv, rng.choice([None, *range(size)]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(size)]
    rows += [(None, 1, "user", "x."), (None, 2, "assistant", "x."), (-3, None, None, None)]
    rng.shuffle(rows)
    schema = "conv_id long, turn long, role string, text string, place string, fault int, present string"
    df = spark.createDataFrame([(*r, "p", 9, "q") for r in rows], schema)
    monkeypatch.setattr(dialogues, "BLOCK", block)
    found = {r.conv_id: tuple(r) for r in dialogues.repair_report(df).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, *(" " if x is None else x for x in (role, text))))
    assert found == {conv: report(conv, sorted(held, key=key)) for conv, held in groups.items()}


def test_blocks_do_not_change_the_path():
    rng = random.Random(8)
    for _ in range(200):
        rows = [(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randint(1, 30))]
        seen = set()
        for block in (1, 2, 7, 100):
            weights, codes = dialogues.END[0], []
            for n, (initial, fault) in enumerate(rows[::-1]):
                if n and n % block == 0:
                    weights = dialogues.ranked(weights)
                weights, found = dialogues.step(weights, initial, fault)
                codes.append(found)
            seen.add((str(codes), weights[0] // dialogues._TOP))
        assert len(seen) == 1


def test_repaired_rows_are_the_conversation(spark):
    rows = [(1, 1, "assistant", "Hi."), (1, 2, "system", "Be kind."), (1, 3, "user", "a"), (1, 3, "user", "a"), (1, 9, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = dialogues.repaired_rows(df).collect()
    left = [(r.role, r.text) for r in found if r.edit != "D"]
    assert LEGAL.match("".join(role[0] for role, _ in left))
    assert sum(r.cost for r in found) == exact([r[2:] for r in rows])[0]
    assert [(r.old_role, r.fault) for r in found if r.edit != "I"] == [
        ("assistant", 0), ("system", 0), ("user", 3), ("user", 2), ("user", 1)
    ]


def test_no_rows_and_lost_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert dialogues.repair_report(spark.createDataFrame([], schema)).count() == 0
    gone = next(n for n in range(100) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x.")], schema)
    from pyspark.sql import functions as F

    (row,) = dialogues.repair_report(dialogues.damaged(df), F.col("present")).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation_is_streamed(spark):
    rng = random.Random(5)
    rows = [(7, n, rng.choice(ROLES[:3]), f"{n} {rng.choice(TEXTS)}") for n in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (found,) = dialogues.repair_report(df).collect()
    assert tuple(found) == report(7, [r[1:] for r in rows])


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r) for r in queries.op12_repair(spark, sf_dir).collect()}
    assert found == {conv: report(conv, held) for conv, held in damage(rows).items()}


def test_letters_are_in_ascii_order():
    assert sorted(dialogues.DIGIT, key=dialogues.DIGIT.get) == sorted(dialogues.DIGIT)
    assert all(i in NEXT[s] for s, (i, _) in zip(("", "s", "u", "a"), dialogues.INSERTED))
