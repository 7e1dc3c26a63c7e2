import numpy as np
import pytest
from pyspark.sql import functions as F
from tagloom.llm import hard_negatives as hn
from tagloom.llm import queries


def brute(rows, is_anchor, k=5, low=80):
    """rows: {id: (label, vector)}"""
    out = set()
    for a, (label, vec) in rows.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, v)), i, other) for i, (other, v) in rows.items() if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:k]:
            fit = [(s, j) for s, j, other in scored if other != label and low * -p <= 100 * -s <= 100 * -p][:k]
            out |= {(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(fit)}
    return out


def corpus(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (6, dim))
    made = centres[rng.integers(0, 6, n)] + rng.integers(-spread, spread + 1, (n, dim))
    made[n // 2 :: 3] = made[0]  # one vector is very common
    return {int(i): (int(rng.integers(0, 4)), v.tolist()) for i, v in zip(rng.permutation(3 * n)[:n], made)}


SCHEMA = "id long, label long, vec array<long>, shard string, kind string"


@pytest.mark.parametrize("dim, spread", [(8, 30), (1, 5), (5, 0), (16, 400)])
def test_equals_brute_force(spark, dim, spread):
    rows = corpus(dim, 300, dim, spread)
    df = spark.createDataFrame([(i, label, v, "s", "k") for i, (label, v) in rows.items()], SCHEMA)
    found = hn.mine(df, F.col("id") % 5 == 0).collect()
    assert {tuple(r) for r in found} == brute(rows, lambda i: i % 5 == 0) and len(found) == len({tuple(r) for r in found})


def test_many_shards_and_split_cells(spark, monkeypatch):
    monkeypatch.setattr(hn, "SHARD_ROWS", 40)
    monkeypatch.setattr(hn, "CELL_ROWS", 4)
    rows = corpus(3, 400, 10, 60)
    df = spark.createDataFrame([(i, label, v, "s", "k") for i, (label, v) in rows.items()], SCHEMA)
    found = hn.mine(df, F.col("id") % 7 == 0).collect()
    assert {tuple(r) for r in found} == brute(rows, lambda i: i % 7 == 0)


def test_heap_visits_all_cells_by_falling_bounds(monkeypatch):
    monkeypatch.setattr(hn, "FIRST_STEP", 1)
    monkeypatch.setattr(hn, "LAST_STEP", 1)
    rng = np.random.default_rng(2)
    vectors = rng.integers(-90, 90, (200, 6))
    books = [hn.fit_codebook(vectors[:, part].astype(float), 5) for part in (slice(0, 3), slice(3, None))]
    codes = np.stack([hn.nearest_code(vectors[:, p].astype(float), b)[0] for p, b in zip((slice(0, 3), slice(3, None)), books)], 1)
    index = hn.CellIndex(np.arange(200), np.zeros(200, int), vectors, codes, books)
    anchor = rng.integers(-90, 90, 6)
    scores = index.vectors @ anchor
    seen, bound = [], np.inf
    for rows, after in index.visits(anchor):
        assert scores[rows].max() <= bound and after <= bound
        seen += rows.tolist()
        bound = after
        rest = np.setdiff1d(np.arange(200), seen)
        assert not len(rest) or scores[rest].max() <= after
    assert sorted(seen) == list(range(200))


def test_searches_stop_early():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (64, 16))
    vectors = (centres[rng.integers(0, 64, 20_000)] + rng.normal(0, 5, (20_000, 16))).astype(np.int64)
    books = [hn.fit_codebook(vectors[:2000, p].astype(float), 32) for p in (slice(0, 8), slice(8, None))]
    codes = np.stack([hn.nearest_code(vectors[:, p].astype(float), b)[0] for p, b in zip((slice(0, 8), slice(8, None)), books)], 1)
    index = hn.CellIndex(np.arange(20_000), np.zeros(20_000, int), vectors, codes, books)
    seen = []
    visits = index.visits
    index.visits = lambda a: (seen.append(len(v[0])) or v for v in visits(a))
    score, _ = index.positives(0, 0, index.vectors[0], -np.inf, 5)
    assert score.tolist() == sorted((index.vectors[1:] @ index.vectors[0]).tolist(), reverse=True)[:5]
    assert sum(seen) < 20_000 / 3


def test_large_numbers_are_exact():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-(2**27), 2**27, (5, 64)), rng.integers(-(2**27), 2**27, 64)
    assert hn.products(x, y).tolist() == [sum(int(a) * int(b) for a, b in zip(r, y)) for r in x]


def test_rows_that_take_no_part(spark):
    rows = [
        (100, 1, [3, 4], "", ""), (1, 1, [1, 1], "", ""), (2, 2, [1, 0], "", ""), (2, 2, [1, 0], "", ""), (2, 3, [9, 9], "", ""),
        (3, None, [1, 1], "", ""), (4, 2, None, "", ""), (5, 2, [1, None], "", ""), (6, 2, [1, 1, 1], "", ""), (None, 2, [1, 1], "", ""),
        (7, 2, [0, 0], "", ""), (8, 4, [1, 1], "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = hn.mine(df, F.col("id") % 100 == 0).collect()
    assert [tuple(r) for r in found] == [(100, 1, 1, 8, 7, 7)]
    assert hn.mine(df.limit(0), F.col("id") % 100 == 0).count() == 0
    alone = hn.mine(df.where("id = 100"), F.col("id") % 100 == 0)
    assert alone.count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    rows = {}
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect():
        if r.label is not None and r.embedding is not None and np.isfinite(np.array(r.embedding, float)).all():
            rows[r.vec_id] = ((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * x)) for x in r.embedding])
    found = queries.op11_hard_negatives(spark, sf_dir).collect()
    assert {tuple(r) for r in found} == brute(rows, lambda i: i % 100 == 0)
    assert len(found) == len(set(found))
