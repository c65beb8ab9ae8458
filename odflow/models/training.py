"""Training of a net over origins, a batch of them a step.

Every task goes through its origins in order, a step a batch, as a sequential run
does; at the end of an epoch the tasks' parameters and optimizer states are averaged,
weighted by their origins. One worker is the sequential run. An epoch is one job
whatever the number of batches, and a task that is run again repeats its steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import RmsProp
from .mlp import PARTS, Layer, added_up, as_arrow, as_blocks, by_origin, flat, loss_of_origin, shaped


@dataclass
class State:
    """Parameters, and the optimizer's squares and speeds as vectors."""

    layers: list[Layer]
    square: np.ndarray
    speed: np.ndarray

    @classmethod
    def fresh(cls, layers: list[Layer]) -> State:
        size = len(flat(layers))
        return cls(layers, np.zeros(size), np.zeros(size))


def train_epoch(pairs: DataFrame, state: State, *, batch_size: int = 64, lr: float = 5e-6, momentum: float = 0.9, dropout: float = 0.0, seed: int = 1234, epoch: int = 1, workers: int = 8, each: Callable | None = None) -> tuple[float, State]:
    """(mean loss of an origin, new state) after each origin of pairs (origin, destination, t, x) was used once.

    The loss is the one before each step. Origins go to workers by hash and are used in
    the order of their ids. A worker sends three vectors of the model's size, so their
    number is a parameter. Without rows the state stays and the loss is 0. With each,
    pairs are packed rows, dealt to workers already, of whose Arrow batches it gives
    the origins' (x, t) in order.
    """
    if batch_size < 1 or workers < 1:
        raise ValueError("batch_size and workers are at least 1")
    layers, square, speed = state.layers, state.square, state.speed

    def run(origins: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
        values, optimizer = flat(layers), RmsProp(len(square), lr, momentum)
        optimizer.square, optimizer.speed = square, speed
        n, loss, gradient, now = 0, 0.0, np.zeros(len(values)), layers
        for x, t in origins:
            one, g = loss_of_origin(x, t, now, dropout, rng)
            n, loss, gradient = n + 1, loss + one, gradient + g
            if n % batch_size == 0:
                values, gradient = optimizer.step(values, gradient), np.zeros(len(values))
                now = shaped(values, layers)
        if n % batch_size:
            values = optimizer.step(values, gradient)
        if n:
            yield as_blocks(n, loss, n * np.concatenate([values, optimizer.square, optimizer.speed]))

    if each is None:
        rows = pairs.select("origin", "destination", "t", "x").repartition(workers, F.col("origin")).sortWithinPartitions("origin", "destination")
        parts = rows.mapInPandas(lambda batches: run(by_origin(batches)), PARTS)
    else:
        parts = pairs.mapInArrow(lambda batches: (as_arrow(p) for p in run(each(batches))), PARTS)
    n, loss, total = added_up(parts)
    if not n:
        return 0.0, state
    values, square, speed = np.split(total / n, 3)
    return loss / n, State(shaped(values, layers), square, speed)


def train(pairs_of: Callable[[int], DataFrame], state: State, epochs: int, report: Callable[[int, float, State], None] | None = None, **settings) -> tuple[State, list[float]]:
    """Epochs 1 to epochs over pairs_of(epoch), and their losses; report is called after each. Settings as for train_epoch."""
    losses = []
    for epoch in range(1, epochs + 1):
        loss, state = train_epoch(pairs_of(epoch), state, epoch=epoch, **settings)
        losses.append(loss)
        if report:
            report(epoch, loss, state)
    return state, losses
