import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tagloom.llm import repeats


def brute(texts, length):
    """n_bytes, n_removed, n_spans and digest of what is left, for each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    blocks = ["".join(rng.choice("abcé ") for _ in range(rng.randint(5, 120))) for _ in range(25)]
    texts = ["".join(rng.choice(blocks) for _ in range(rng.randint(0, 8))) for _ in range(n)]
    return [*texts, None, "", texts[0], texts[0], "ab" * 300, "x" * 500, "ba" * 40, "é" * 90]


@pytest.mark.parametrize("length, gram, hot", [(40, 8, 20_000), (40, 8, 2), (64, 32, 3)])
def test_equals_brute_force(spark, monkeypatch, length, gram, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = corpus(length + hot)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: tuple(r)[1:] for r in repeats.removal_report(df, "doc_id", "text", length, gram).collect()}
    assert [found[n] for n in range(len(texts))] == brute(texts, length)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_contexts_of_one_anchor_do_not_meet(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "WIDE", 3)
    held = []
    monkeypatch.setattr(repeats, "_counted_windows", lambda *x, made=repeats._counted_windows: held.append(1) or made(*x))
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh") for _ in range(60))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(50)) + passage + rng.choice("xy") * rng.randint(0, 30) for _ in range(40)]
    texts += corpus(11)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: tuple(r)[1:] for r in repeats.removal_report(df, "doc_id", "text", 40, 8).collect()}
    assert [found[n] for n in range(len(texts))] == brute(texts, 40) and held


def test_ranges_inside_others():
    import pyarrow as pa

    ranges = [[{"start": 0, "end": 700}, {"start": 3, "end": 410}, {"start": 500, "end": 900}], [], [{"start": 2, "end": 5}]]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    (made,) = repeats._merge(iter([pa.record_batch({"t": [b"a", b"b", b"c"], "spans": pa.array(ranges, kind)})]))
    assert made.column(1).to_pylist() == [[{"start": 0, "end": 900}], [], [{"start": 2, "end": 5}]]


def test_small_batches_and_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_MOST", 256)
    texts = corpus(9)
    batches = repeats._parse(
        iter([__import__("pyarrow").record_batch({"t": [b"x"] * len(texts), "text": texts})]), 40, 8
    )
    parts = [r for b in batches for r in b.column("runs").to_pylist()]
    assert len(parts) == len(texts)
    for text, runs in zip(texts, parts):
        covered = [s for r in runs for s in range(r["first"], r["last"] + 1)]
        assert sorted(covered) == list(range(max(0, len((text or "").encode()) - 39)))
        assert all(r["first"] <= r["anchor"] <= r["first"] + 32 for r in runs)


def test_index_equals_window_counts():
    rng = np.random.default_rng(4)
    for _ in range(30):
        length, gram = 12, 4
        group = np.sort(rng.integers(0, 4, 12))
        contexts = [rng.integers(0, 2, rng.integers(length, 2 * length - gram)).astype(np.uint8) for _ in group]
        at = np.array([rng.integers(max(0, len(c) - length), length - gram + 1) for c in contexts])
        ends = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        found = repeats.repeated_windows(group, np.concatenate(contexts), ends, at, length, gram)
        windows = Counter()
        for g, c, a in zip(group, contexts, at):
            for s in range(len(c) - length + 1):
                windows[g, s - a, c[s : s + length].tobytes()] += 1
        for n, (g, c, a) in enumerate(zip(group, contexts, at)):
            for s in range(len(c) - length + 1):
                assert found[n, length - gram - a + s] == (windows[g, s - a, c[s : s + length].tobytes()] > 1)


def test_rows_without_ids_and_repeated_ids(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(900))
    rows = [(None, text, 1), (None, text[:450] + "!" * 10, 2), (5, "unrelated " * 3, 3), (5, None, 4), (5, text, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    found = sorted((tuple(r) for r in repeats.removal_report(df, "doc_id", "text").collect()), key=str)
    expected = [(i, *x) for (i, _, _), x in zip(rows, brute([t for _, t, _ in rows], 400))]
    assert found == sorted(expected, key=str)
    kept = repeats.remove_repeats(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert {r.spans: r.text for r in kept.collect()} == {1: "", 2: "!" * 10, 3: "unrelated " * 3, 4: None, 5: ""}
    assert repeats.removal_report(df.limit(0), "doc_id", "text").count() == 0


def test_cut_characters_go_as_a_whole():
    assert repeats._kept_texts(__import__("pandas").Series(["aéb"]), [[{"start": 2, "end": 3}]])[0] == "ab"


def brute_passages(texts, words):
    """Texts without runs of words that occur more than once."""
    split = [list(re.finditer(r"[^\t-\r ]+", t or "")) for t in texts]
    seen = Counter(tuple(m.group() for m in w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for t, w in zip(texts, split):
        gone = [False] * len(w)
        for i in range(len(w) - words + 1):
            if seen[tuple(m.group() for m in w[i : i + words])] > 1:
                gone[i : i + words] = [True] * words
        ends = [m.start() for m in w[1:]] + [len(t or "")]
        head = (t or "")[: w[0].start()] if w else t or ""
        kept = head + "".join(t[m.start() : e] for m, e, g in zip(w, ends, gone) if not g)
        out.append((None if t is None else kept if any(gone) else t, sum(gone)))
    return out


def passages_corpus(seed):
    rng = random.Random(seed)
    blocks = [[rng.choice(["a", "bé", "the", "of,", "Ünd", "x" * 30]) for _ in range(rng.randint(3, 40))] for _ in range(20)]
    texts = [rng.choice([" ", "\n", "  "]).join(w for b in rng.choices(blocks, k=rng.randint(0, 5)) for w in b) for _ in range(50)]
    return [*texts, None, "", " \n ", texts[0], texts[0], "the " * 80, "\u00a0 ".join(["a"] * 60), " lead in " + texts[1] + "\t"]


@pytest.mark.parametrize("wide", [20_000, 2])
def test_passages_equal_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(repeats, "WIDE", wide)
    texts = passages_corpus(wide)
    df = spark.createDataFrame([(n, t, n, "s") for n, t in enumerate(texts)], "doc_id long, text string, _t int, _spans string")
    kept = repeats.remove_passages(df, "doc_id", "text", 12)
    assert kept.columns == df.columns
    wanted = brute_passages(texts, 12)
    got = {r.doc_id: r for r in kept.collect()}
    assert [got[n].text for n in range(len(texts))] == [t for t, _ in wanted]
    assert all(r._t == n and r._spans == "s" for n, r in got.items())
    report = {r.id: r.n_passage_words for r in repeats.removal_report(df, "doc_id", "text", words=12).collect()}
    assert [report[n] for n in range(len(texts))] == [n for _, n in wanted]
    assert repeats.remove_passages(df.limit(0), "doc_id", "text").count() == 0


def test_helper_columns_do_not_clash(spark):
    text = "".join(random.Random(2).choice("abcdef") for _ in range(600))
    df = spark.createDataFrame([(1, text, 7, "k", 1), (2, text + "!", 8, None, 2)], "doc_id long, text string, _t int, _spans string, u int")
    kept = {tuple(r) for r in repeats.remove_repeats(df, "doc_id", "text").collect()}
    assert kept == {(1, "", 7, "k", 1), (2, "!", 8, None, 2)}


def test_query_equals_brute_force(spark, sf_dir):
    from tagloom.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    wanted = dict(zip(texts, zip(brute(list(texts.values()), 400), brute_passages(list(texts.values()), 51))))
    rows = queries.op5_repeats(spark, sf_dir).collect()
    assert {r.doc_id: (tuple(r)[1:5], r.n_passage_words) for r in rows} == {i: (b, p[1]) for i, (b, p) in wanted.items()}
    assert len(rows) == len(texts)


def test_no_bytes_of_contexts_are_stored(spark, monkeypatch):
    stored = {}
    monkeypatch.setattr(repeats, "store", lambda df, name, made=repeats.store: stored.update({name: df.columns}) or made(df, name))
    texts = corpus(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    repeats.repeated_spans(df, "doc_id", "text", 40, 8).collect()
    assert stored and not [name for name, columns in stored.items() if {"context", "text"} & set(columns)]


def test_contexts_are_aligned_in_small_parts(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(repeats, "_MOST", 1 << 14)
    n, size = 1500, 500
    data = np.random.default_rng(2).integers(0, 4, n * size).astype(np.uint8)
    tracemalloc.start()
    repeats.repeated_windows(np.zeros(n), data, np.arange(n + 1) * size, np.full(n, 100), 400, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(data)
