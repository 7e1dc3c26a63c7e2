import random

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tagloom.operators import tagger
from tagloom.plans import registry


def test_equal_rows_are_learnt_from_once(spark, monkeypatch):
    """One example a distinct row, and the model that all rows give, whatever the numbers are."""
    rnd = random.Random(4)
    kinds = [([rnd.randrange(9)], [rnd.randrange(9) for _ in range(3)], rnd.randrange(3)) for _ in range(40)]
    rows = [k for i, k in enumerate(kinds) for _ in range(200 if i == 0 else 1 + i % 5)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, y int")
    stored, real = [], tagger.store
    monkeypatch.setattr(tagger, "store", lambda made, name: stored.append(real(made, name)) or stored[-1])
    weights, bias = tagger.fit_tagger(df, ["a", "b"], "y", steps=200)
    assert stored[0].count() == len({(*a, *b, y) for a, b, y in kinds})
    vectors = df.select(array_to_vector(F.concat("a", "b").cast("array<double>")).alias("features"), F.col("y").cast("double").alias("label"))
    want = LogisticRegression(family="multinomial", maxIter=200, regParam=0.01, standardization=True).fit(vectors)
    assert np.allclose(weights, want.coefficientMatrix.toArray(), atol=1e-3)
    assert np.allclose(bias, want.interceptVector.toArray(), atol=1e-3)


def test_a_feature_that_never_changes_has_no_weight(spark):
    df = spark.createDataFrame([([1, i % 2], i % 2) for i in range(8)], "a array<int>, y int")
    weights, _ = tagger.fit_tagger(df, ["a"], "y")
    assert all(w[0] == 0.0 for w in weights) and weights[1][1] > weights[0][1]


def test_a_split_is_chosen_before_the_windows(spark, sf_dir):
    rows = registry._context(spark, sf_dir, ["split", *registry.SEQ]).where("split = 'devel'")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("devel")
