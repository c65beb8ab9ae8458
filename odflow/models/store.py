"""Models as Parquet: a row a layer, weights and optimizer state as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "layer int, w array<array<double>>, b array<double>, square array<double>, speed array<double>"


def save(spark: SparkSession, layers: list[tuple[np.ndarray, np.ndarray]], path: str, square: np.ndarray | None = None, speed: np.ndarray | None = None) -> None:
    flat = lambda a: [] if a is None else a.tolist()
    rows = [(k, w.tolist(), b.tolist(), flat(square) if k == 0 else [], flat(speed) if k == 0 else []) for k, (w, b) in enumerate(layers)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def load(spark: SparkSession, path: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Layers, and the optimizer's squares and speeds; as many rows as the model has layers."""
    rows = table(spark, path).orderBy("layer").collect()
    return [(np.array(r.w), np.array(r.b)) for r in rows], np.array(rows[0].square), np.array(rows[0].speed)
