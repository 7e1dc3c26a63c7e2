"""Plans and files of steps that grow with the corpus."""

import re

from tagloom.operators import features, lookup
from tagloom.plans import registry
from tagloom.sources import writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_matrix_is_filled_in_place(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1.0), (1, 2, 3, 0.5), (2, 1, 1, 0.25)], "s int, word_idx int, piece_pos int, w double")
    rows = features.dense_matrix(cells, ["s"], 4)
    got = {r["s"]: r["weight_matrix"] for r in rows.collect()}
    assert got == {1: [1.0] + [0.0] * 10 + [0.5] + [0.0] * 4, 2: [0.0] * 5 + [0.25] + [0.0] * 10}
    assert "MapInArrow" in plan(rows) and "array_repeat" not in plan(rows)


def test_dense_matrices_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(features, "DENSE_BYTES", 1)
    cells = spark.range(50).selectExpr("id AS s", "cast(id % 3 AS int) AS word_idx", "1 AS piece_pos", "1.0D AS w")
    got = {r["s"]: r["weight_matrix"] for r in features.dense_matrix(cells, ["s"], 3).collect()}
    assert all(got[i][i % 3 * 3 + 1] == 1.0 and sum(got[i]) == 1.0 and len(got[i]) == 9 for i in range(50)) and len(got) == 50


def test_vectors_are_held_by_their_own_size(spark):
    """100,000 vectors of 64 floats take 26 MB: no row is exchanged for them."""
    vectors = spark.range(100_000).selectExpr("id AS vec_id", "transform(sequence(1, 64), x -> cast(id / 7.0 AS float)) AS embedding")
    items = spark.range(10).selectExpr("id", "id * 9999 AS vec_id")
    for rows in (lookup.gather_vectors(items, vectors), lookup.sum_vectors(items, [(vectors, "vec_id", "embedding")])):
        assert not re.search("SortMergeJoin|ShuffledHashJoin|Exchange hashpartitioning", plan(rows))
        assert all(len(r["embedding"]) == 64 for r in rows.collect()) and rows.count() == 10


def test_weighted_vector_sums(spark):
    values = [(1, [1.0, 2.0]), (1, [0.5]), (2, None), (3, [1.0, None]), (4, [])]
    rows = spark.createDataFrame(values, "doc_id int, embedding array<float>")
    got = {r["doc_id"]: (r["n"], r["total"]) for r in registry._vector_sums(rows).collect()}
    assert got == {1: (2, 5.5), 2: (1, None), 3: (1, None), 4: (1, 0.0)}


def test_predictions_are_compressed(spark, tmp_path):
    writers.write_predictions(spark.range(5), str(tmp_path / "p"))
    assert {p.suffix for p in (tmp_path / "p").glob("part-*")} == {".gz"}
    assert spark.read.json(str(tmp_path / "p")).count() == 5


def test_votes_travel_once(spark, sf_dir):
    """No exchange is keyed by words: votes and scores follow whole documents."""
    found = plan(registry.vote_packed_source_words(spark, sf_dir))
    assert not [k for k in re.findall(r"hashpartitioning\(([^)]*)\)", found) if "word_pos" in k]
