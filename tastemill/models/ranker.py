"""Rating prediction from feature vectors: fitting with MLlib, scoring exported layers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tastemill.operators.vectors import stack_lists

Layers = list[tuple[np.ndarray, np.ndarray]]


def _vectors(features: DataFrame) -> DataFrame:
    return features.select("rating", array_to_vector("features").alias("vector"))


def fit_linear(features: DataFrame, reg: float = 0.01, iterations: int = 50) -> Layers:
    """Least squares as a one-layer network, so it scores like any other."""
    model = LinearRegression(featuresCol="vector", labelCol="rating", regParam=reg, maxIter=iterations).fit(_vectors(features))
    return [(np.array(model.coefficients.toArray())[:, None], np.array([model.intercept]))]


def fit_trees(features: DataFrame, iterations: int = 20, depth: int = 5, seed: int = 42):
    """Boosted trees on the same vectors (an MLlib model)."""
    return GBTRegressor(featuresCol="vector", labelCol="rating", maxIter=iterations, maxDepth=depth, seed=seed).fit(_vectors(features))


def score_trees(model, features: DataFrame) -> DataFrame:
    return model.transform(features.withColumn("vector", array_to_vector("features"))).drop("vector")


def forward(matrix: np.ndarray, layers: Layers) -> np.ndarray:
    """Dense layers with ReLU between them and one linear output."""
    for i, (weights, bias) in enumerate(layers):
        matrix = matrix @ weights + bias
        if i < len(layers) - 1:
            matrix = np.maximum(matrix, 0.0)
    return matrix[:, 0]


def score_layers(df: DataFrame, layers: Layers, output: str = "prediction") -> DataFrame:
    """Add `output` by running exported layers over the `features` column in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(layers)
    width = layers[0][0].shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = stack_lists(batch.column("features"), width).astype(np.float64)
            scores = pa.array(forward(matrix, shared.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, output])

    schema = T.StructType([*df.schema.fields, T.StructField(output, T.DoubleType())])
    return df.mapInArrow(run, schema)
