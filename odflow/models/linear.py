"""Linear scores, their gradient as one aggregation, and RMSprop steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.choice import log_sums


def score(x: Column, weights: list[float], bias: float = 0.0) -> Column:
    """w x + b of an array column; one literal a weight, so the sum is compiled."""
    total = F.lit(float(bias))
    for k, w in enumerate(weights):
        total = total + x[k] * F.lit(float(w))
    return total


def loss_and_gradient(pairs: DataFrame, weights: list[float], bias: float = 0.0, trips: DataFrame | None = None) -> tuple[float, np.ndarray]:
    """Summed loss of pairs (origin, t, x) and its gradient in (weights, bias): one pass, one row to the driver.

    Pairs are added up by origin where they are made, and not shuffled. Where trips are
    given, they are the pairs that have a flow, and pairs need no t.
    """
    scored = pairs.withColumn("s", score(F.col("x"), weights, bias))
    names = [f"g{k}" for k in range(len(weights))]
    means = log_sums(scored, ("s",), {g: F.col("x")[k] for k, g in enumerate(names)})
    seen = scored if trips is None else trips.withColumn("s", score(F.col("x"), weights, bias))
    made = seen.groupBy("origin").agg(F.sum("t").alias("_t"), F.sum(F.col("t") * F.col("s")).alias("_ts"), *[F.sum(F.col("t") * F.col("x")[k]).alias(f"_t{g}") for k, g in enumerate(names)])
    both = means.join(made, "origin")  # origins without a flow add nothing
    row = both.agg(F.sum(F.col("_t") * F.col("ls_s") - F.col("_ts")).alias("loss"), *[F.sum(F.col("_t") * F.col(g) - F.col(f"_t{g}")).alias(g) for g in names]).first()
    return float(row["loss"] or 0), np.array([row[g] or 0.0 for g in names] + [0.0])  # a bias shifts all scores of an origin alike


class RmsProp:
    """Public defaults: smoothing 0.99, epsilon 1e-8; momentum as given."""

    def __init__(self, size: int, lr: float = 5e-6, momentum: float = 0.9, alpha: float = 0.99, eps: float = 1e-8):
        self.lr, self.momentum, self.alpha, self.eps = lr, momentum, alpha, eps
        self.square, self.speed = np.zeros(size), np.zeros(size)

    def step(self, values: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.square = self.alpha * self.square + (1 - self.alpha) * gradient * gradient
        self.speed = self.momentum * self.speed + gradient / (np.sqrt(self.square) + self.eps)
        return values - self.lr * self.speed


def train(pairs: DataFrame, size: int, epochs: int, lr: float, momentum: float = 0.9, start: np.ndarray | None = None, trips: DataFrame | None = None) -> tuple[np.ndarray, list[float], RmsProp]:
    """Full-gradient training; pairs, and trips as for loss_and_gradient, are used every epoch: they should be cheap to make or written."""
    values, optimizer, losses = np.zeros(size + 1) if start is None else start.copy(), RmsProp(size + 1, lr, momentum), []
    for _ in range(epochs):
        loss, gradient = loss_and_gradient(pairs, values[:-1].tolist(), float(values[-1]), trips)
        losses.append(loss)
        values = optimizer.step(values, gradient)
    return values, losses, optimizer
