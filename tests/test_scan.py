import random

import pytest

from pyspark.sql import functions as F

from tagloom.operators import scan


def test_prior_values_across_blocks(spark):
    rnd = random.Random(1)
    rows = [(g, a, b, rnd.randint(0, 9), rnd.choice([None, "x", "y"]))
            for g in "pq" for a in range(9) for b in rnd.sample(range(40), 12)]
    df = spark.createDataFrame(rows, "g string, a long, b int, n long, s string").orderBy(F.rand(2))
    got = scan.prior_values(df, ["a", "b"], {"total": ("sum", F.col("n")), "seen": ("last", F.col("s"))}, ["g"], block=4)
    want = []
    for g in "pq":
        total, seen = 0, None
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3]):
            want.append((*r[:3], total, seen))
            total, seen = total + r[3], r[4] or seen
    assert sorted(tuple(r) for r in got.select("g", "a", "b", "total", "seen").collect()) == sorted(want)


def test_global_index(spark):
    df = spark.range(0, 5000, 3, numPartitions=7).select((4998 - F.col("id")).alias("k"))
    got = scan.row_index(df, ["k"]).orderBy("k").collect()
    assert [r["idx"] for r in got] == list(range(len(got)))


def test_rank_ids(spark):
    words = [f"w{i % 977:04d}{i}" for i in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(9)
    got = {r["w"]: r["id"] for r in scan.rank_ids(df, ["w"]).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


@pytest.mark.parametrize("top", [2, 1 << 18])
def test_keys_with_wide_gaps(spark, top):
    rng = random.Random(4)
    keys = sorted(rng.sample(range(1 << 50), 400))
    rows = [(k % 3, k, rng.randint(0, 9)) for k in keys]
    df = spark.createDataFrame(rows, "g long, k long, v long")
    values = {"total": ("sum", F.col("v")), "latest": ("last", F.when(F.col("v") > 6, F.col("k")))}
    got = {r["k"]: (r["total"], r["latest"]) for r in scan.prior_values(df, ["k"], values, ["g"], block=16, top=top).collect()}
    state = {}
    for g, k, v in rows:
        total, latest = state.get(g, (0, None))
        assert got[k] == (total, latest)
        state[g] = (total + v, k if v > 6 else latest)
