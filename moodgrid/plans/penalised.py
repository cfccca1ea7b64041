"""Elastic-net regression on sparse factor columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def elastic_net_predict(
    train: DataFrame,
    grid: DataFrame,
    y: str,
    numeric: Sequence[str],
    factors: Sequence[str],
    penalty: float = 0.01,
    mix: float = 0.5,
) -> DataFrame:
    """Penalised fit on the training rows, predictions for the grid rows."""
    indexed = [f"{f}_ix" for f in factors]
    hot = [f"{f}_hot" for f in factors]
    stages = [
        StringIndexer(inputCols=list(factors), outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=hot),
        VectorAssembler(inputCols=[*numeric, *hot], outputCol="features"),
        LinearRegression(labelCol="label", regParam=penalty, elasticNetParam=mix, maxIter=50),
    ]
    rows = train.select(*numeric, *factors, F.col(y).cast("double").alias("label")).na.drop("any")
    model = Pipeline(stages=stages).fit(rows)
    return model.transform(grid).select(*grid.columns, F.col("prediction"))
