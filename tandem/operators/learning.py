"""Models on tables with grouped folds: every row is scored by a model that has not seen its group."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _folds(df: DataFrame, k: int, fit_one) -> DataFrame:
    return reduce(DataFrame.unionByName, [fit_one(df.filter(F.col("fold") != f), df.filter(F.col("fold") == f)) for f in range(k)])


def linear_oof(df: DataFrame, features: list[str], k: int) -> DataFrame:
    """Out-of-fold probabilities of a standardised, class-balanced logistic regression: the rows with score."""

    def one(train: DataFrame, test: DataFrame) -> DataFrame:
        share = train.agg(F.avg("y")).first()[0] or 0.5
        train = train.withColumn("w", F.when(F.col("y") == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6)))
        stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.01, maxIter=30)]
        return Pipeline(stages=stages).fit(train).transform(test).select(*df.columns, vector_to_array("probability")[1].alias("score"))

    return _folds(df, k, one)


def boosted_oof(df: DataFrame, features: list[str], k: int, most_weight: float = 10.0, rounds: int = 10) -> DataFrame:
    """Out-of-fold probabilities of boosted trees with a capped weight for the positive class."""

    def one(train: DataFrame, test: DataFrame) -> DataFrame:
        share = train.agg(F.avg("y")).first()[0] or 0.5
        train = train.withColumn("w", F.when(F.col("y") == 1, min(most_weight, (1 - share) / max(share, 1e-6))).otherwise(1.0))
        stages = [VectorAssembler(inputCols=features, outputCol="x"), GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=rounds, maxDepth=3, seed=1)]
        return Pipeline(stages=stages).fit(train).transform(test).select(*df.columns, vector_to_array("probability")[1].alias("score"))

    return _folds(df, k, one)


def boosted_regression(df: DataFrame, features: list[str], k: int, rounds: int = 10) -> DataFrame:
    """Out-of-fold predictions of boosted regression trees: the rows with pred."""

    def one(train: DataFrame, test: DataFrame) -> DataFrame:
        stages = [VectorAssembler(inputCols=features, outputCol="x"), GBTRegressor(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=3, seed=1)]
        return Pipeline(stages=stages).fit(train).transform(test).select(*df.columns, F.col("prediction").alias("pred"))

    return _folds(df, k, one)


def ablate(df: DataFrame, features: list[str], zeroed: list[str], k: int) -> DataFrame:
    """linear_oof with a group of features set to 0 on the same folds."""
    return linear_oof(df.withColumns({c: F.lit(0.0) for c in zeroed}), features, k)


def reduce_vectors(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n first principal components of an array column, as an array `components`."""
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_v", array_to_vector(column))
    return PCA(k=n, inputCol="_v", outputCol="_c").fit(rows).transform(rows).withColumn("components", vector_to_array("_c")).drop("_v", "_c")
