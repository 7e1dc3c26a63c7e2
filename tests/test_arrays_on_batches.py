"""Array columns that are made on Arrow batches."""

from conftest import one
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import arrays
from tagloom.operators import decode, features
from tagloom.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_framed_arrays(spark):
    values = [([5, None],), ([],), (None,), ([1, 2, 3, 4],)]
    col = arrays.framed(F.col("a"), T.IntegerType(), 7, 8, 0, 5)
    assert one(spark, "a array<int>", values, col) == [([7, 5, None, 8, 0],), ([7, 8, 0, 0, 0],), (None,), ([7, 1, 2, 3, 4, 8],)]
    col = arrays.framed(F.col("a"), T.StringType(), "<", ">", "_", 4)
    assert one(spark, "a array<string>", [(["é"],), ([],)], col) == [(["<", "é", ">", "_"],), (["<", ">", "_", "_"],)]


def test_flagged_values(spark):
    values = [([1, 0, 1], [4, 5, None]), ([], []), (None, None), ([0, None], [1, 2])]
    f, v = F.col("f"), F.col("v")
    got = one(spark, "f array<int>, v array<int>", values, arrays.where_one(f, v, 9), arrays.kept_ones(f, v, T.IntegerType()), arrays.count_ones(f))
    assert got == [([4, 9, None], [4, None], 2), ([], [], 0), (None, None, None), ([9, 9], [], 0)]


def test_placed_total(spark):
    values = [([3, 0, -2],), ([],), (None,), ([1, None],), ([1 << 40, 1],)]
    assert one(spark, "a array<bigint>", values, arrays.placed_total("a")) == [(-3,), (0,), (None,), (None,), ((1 << 40) + 2,)]


def test_rows_are_framed_without_lambdas(spark, sf_dir):
    """No array of a feature row is made or summed by an expression interpreted once an element."""
    for name in ("padded_features", "pack_simple", "feature_store"):
        found = plan(registry.QUERIES[name](spark, sf_dir))
        assert "aggregate(" not in found and "array_repeat(lambda" not in found
    packs = spark.createDataFrame([(1, [], [])], "k int, ps array<struct<piece:string,id:int,label:int,start:int,focus:int,weight:double>>, word_labels array<int>")
    rows = features.assemble(packs, features.FeatureConfig(max_len=4))
    assert "lambda" not in plan(rows)
    got = rows.first()
    assert got["input_ids"] == [3, 4, 0, 0] and got["weight_matrix_mask"] == [1, 1, 0, 0] and got["piece_weights"] == []


def test_words_are_pooled_on_batches(spark):
    """Words are summed without a lambda for every piece and class, with the same sums and nulls."""
    kind = "r int, ps array<struct<start:int,weight:double>>, s array<array<double>>"
    values = [
        (1, [(0, 9.0), (1, 0.5), (0, 0.25), (1, 1.0)], [[1.0, 1.0], [2.0, 4.0], [4.0, 8.0], [1.0, None]]),
        (2, [], []),
        (3, [(0, 1.0)], [[1.0, 1.0]]),
        (4, [(1, None), (1, 1.0), (1, 1.0)], [[1.0, 1.0], [3.0], None]),
        (None, [(1, 2.0), (1, 2.0)], [[1.0, 2.0]]),
        (5, [(1, 2.0)], [[1.0, 2.0], [1.0, 2.0]]),
    ]
    rows = decode.pool_records(spark.createDataFrame(values, kind).coalesce(1), ["r"], F.col("s"), 2)
    assert "MapInArrow" in plan(rows) and "lambda" not in plan(rows)
    got = [tuple(r) for r in rows.collect()]
    assert got == [
        (1, 1, [2.0, 4.0]), (1, 2, [1.0, None]),
        (4, 1, [None, None]), (4, 2, [3.0, None]), (4, 3, [None, None]),
        (None, 1, [2.0, 4.0]), (None, 2, [None, None]),
        (5, 1, [None, None]),
    ]
