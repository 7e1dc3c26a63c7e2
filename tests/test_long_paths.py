import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import decode, long_paths


def frame(spark, sequences, gap=1):
    rows = [(s, t * gap, x, y) for s, (xs, ys) in enumerate(sequences) for t, (x, y) in enumerate(zip(xs, ys))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "s int, pos long, scores array<double>, label_id int").repartition(5)


def in_rows(spark, sequences, trans):
    """Paths, scores and likelihoods by the operators that hold a sequence in one row."""
    rows = [(s, [v for x in xs for v in x], ys) for s, (xs, ys) in enumerate(sequences)]
    df = spark.createDataFrame(rows, "s int, flat array<double>, tags array<int>")
    df = df.select("s", decode.viterbi(F.col("flat"), trans).alias("v"), decode.path_log_likelihood(F.col("flat"), F.col("tags"), trans).alias("ll"))
    return {r["s"]: (list(r["v"]["path"]), r["v"]["score"], r["ll"]) for r in df.collect()}


def check(spark, sequences, trans, block, gap=1):
    df = frame(spark, sequences, gap)
    want = in_rows(spark, sequences, trans)
    got = {}
    for r in long_paths.viterbi_long(df, trans, ["s"], block=block).orderBy("s", "pos").collect():
        got.setdefault(r["s"], []).append((r["pos"], r["pred"], r["score"]))
    lls = {r["s"]: r["log_likelihood"] for r in long_paths.path_log_likelihood_long(df, trans, ["s"], block=block).collect()}
    assert set(got) == set(lls) == set(want)
    for s, (path, score, ll) in want.items():
        assert [p for p, _, _ in got[s]] == [t * gap for t in range(len(path))]
        assert [c for _, c, _ in got[s]] == path
        assert got[s][-1][2] == score and abs(lls[s] - ll) < 1e-6 * max(1.0, abs(ll))


@pytest.mark.parametrize("block,gap", [(1, 1), (7, 1), (16, 5)])
def test_blocks_agree_with_rows(spark, block, gap):
    """Scores are quarters, so ties occur and sums are exact."""
    rnd = random.Random(3)
    trans = [[rnd.randrange(-3, 4) / 4 for _ in range(4)] for _ in range(4)]
    sequences = []
    for n in [1, 2, 6, 7, 8, 50, 131]:
        sequences.append(([[rnd.randrange(4) / 4 for _ in range(4)] for _ in range(n)], [rnd.randrange(4) for _ in range(n)]))
    check(spark, sequences, trans, block, gap)


def test_one_long_sequence(spark):
    rnd = np.random.default_rng(5)
    n = 30_000
    trans = (rnd.integers(-4, 5, (3, 3)) / 4).tolist()
    xs, ys = (rnd.integers(0, 9, (n, 3)) / 4).tolist(), rnd.integers(0, 3, n).tolist()
    check(spark, [(xs, ys)], trans, 512)


def test_empty_and_no_sequence_columns(spark):
    none = frame(spark, [([[1.0, 0.0]], [0])]).limit(0)
    assert long_paths.viterbi_long(none, [[0.0, 0.0], [0.0, 0.0]], ["s"]).count() == 0
    assert long_paths.path_log_likelihood_long(none, [[0.0, 0.0], [0.0, 0.0]], ["s"]).count() == 0
    df = frame(spark, [([[1.0, 0.0], [0.0, 2.0], [3.0, 0.0]], [0, 1, 0])]).drop("s")
    rows = long_paths.viterbi_long(df, [[0.0, 0.0], [0.0, 0.0]], [], block=2).orderBy("pos").collect()
    assert [r["pred"] for r in rows] == [0, 1, 0] and rows[-1]["score"] == 6.0


def test_sequences_of_one_lot_need_no_links(spark, monkeypatch):
    """Rows in order are exchanged as one row a sequence; only longer sequences are joined block by block."""
    rnd = random.Random(8)
    trans = [[rnd.randrange(-3, 4) / 4 for _ in range(3)] for _ in range(3)]
    sequences = [([[rnd.randrange(4) / 4 for _ in range(3)] for _ in range(n)], [0] * n) for n in (1, 40, 33, 64)]
    rows = [(s, t, x) for s, (xs, _) in enumerate(sequences) for t, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "s int, pos long, scores array<double>").coalesce(1)
    stored, real = [], long_paths.store
    monkeypatch.setattr(long_paths, "store", lambda made, name, **how: stored.append((name, real(made, name, **how))) or stored[-1][1])
    want = in_rows(spark, sequences, trans)
    got = {}
    for r in long_paths.viterbi_long(df, trans, ["s"], block=8).orderBy("s", "pos").collect():
        got.setdefault(r["s"], []).append((r["pred"], r["score"]))
    assert [n for n, _ in stored] == ["lots", "long_sequences"]
    assert [len(r["runs"]) for r in stored[0][1].collect()] == [1] * 4
    assert {s: ([c for c, _ in v], v[-1][1]) for s, v in got.items()} == {s: v[:2] for s, v in want.items()}


def test_short_and_long_sequences_together(spark):
    rnd = random.Random(9)
    trans = [[rnd.randrange(-3, 4) / 4 for _ in range(2)] for _ in range(2)]
    sequences = [([[rnd.randrange(4) / 4 for _ in range(2)] for _ in range(n)], [0] * n) for n in (5, 9000, 4096, 4097)]
    check(spark, sequences, trans, 64)
