"""A token tagger learnt from context features with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.decode import linear_scores
from tagloom.workspace import store


def fit_tagger(rows: DataFrame, features: Sequence[str], label: str, steps: int = 20, penalty: float = 0.01):
    """Class weights and biases of a multinomial regression over ``features`` arrays.

    Every step reads all examples again, so equal rows are written and learnt from once,
    weighted by their number.
    """
    same = [*features, F.col(label).cast("double").alias("label")]
    counted = store(rows.groupBy(*same).agg(F.count("*").cast("double").alias("weight")), "examples")
    joined = F.concat(*[F.col(c).cast("array<double>") for c in features])
    vectors = counted.select(array_to_vector(joined).alias("raw"), "label", "weight")
    # Features are scaled here, by the deviation over the rows: that of weighted examples has another divisor.
    known = vectors.agg(
        Summarizer.variance(F.col("raw"), F.col("weight")).alias("variance"),
        F.sum("weight").alias("rows"),
        F.sum(F.col("weight") * F.col("weight")).alias("squares"),
    ).first()
    n = known["rows"] or 0.0
    variance = known["variance"].toArray() * ((n - known["squares"] / n) / (n - 1) if n > 1 else 0.0)
    scale = np.where(variance > 0, 1 / np.sqrt(np.where(variance > 0, variance, 1.0)), 0.0)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="raw", outputCol="features").transform(vectors)
    model = LogisticRegression(
        family="multinomial", maxIter=steps, regParam=penalty, standardization=False, weightCol="weight"
    ).fit(scaled.select("features", "label", "weight"))
    return (model.coefficientMatrix.toArray() * scale).tolist(), model.interceptVector.toArray().tolist()


def score_tagger(rows: DataFrame, features: Sequence[str], weights, bias) -> DataFrame:
    """Class scores of a learnt tagger as an array column, inside the JVM."""
    joined = rows.withColumn("_x", F.concat(*[F.col(c).cast("array<double>") for c in features]))
    return linear_scores(joined, weights, bias, "_x").drop("_x")
