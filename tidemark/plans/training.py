"""Models fitted on windows: a linear auto-encoder whose moments are aggregated in Spark, and a search over its parameters."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scoring import MeanReconstructor, window_errors
from tidemark.registry import register

register("reconstructor", "mean")(MeanReconstructor)


@register("reconstructor", "linear")
class LinearAutoEncoder:
    """X-01 .. X-04: a window's flat vector, projected on its k strongest directions and back."""

    def __init__(self, mean: Sequence[float] = (), basis: Sequence[Sequence[float]] = ()):
        self.mean, self.basis = np.asarray(mean, np.float64), np.asarray(basis, np.float64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        flat = x.reshape(len(x), -1) - self.mean
        return (flat @ self.basis.T @ self.basis + self.mean).reshape(x.shape)

    @classmethod
    def fit(cls, windows: DataFrame, k: int, *, window: str = "window") -> LinearAutoEncoder:
        """From full windows of one shape. Each task adds up counts, sums and products of its windows; the driver gets these alone, whose
        size depends on the window and not on the number of rows."""

        def moments(batches):
            n, total, square = 0, 0.0, 0.0
            for batch in batches:
                x = np.array([np.concatenate(w) for w in batch.column(0).to_pylist()], np.float64)
                if len(x):
                    n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([square.tobytes()], pa.binary())], ["n", "total", "square"])

        n, total, square = 0, 0.0, 0.0
        for r in windows.select(window).mapInArrow(moments, "n long, total binary, square binary").toLocalIterator():
            n, total, square = n + r["n"], total + np.frombuffer(r["total"]), square + np.frombuffer(r["square"])
        if not n:
            raise ValueError("there are no windows to learn from")
        mean = total / n
        width = len(mean)
        _, vectors = np.linalg.eigh(square.reshape(width, width) / n - np.outer(mean, mean))
        return cls(mean, vectors[:, ::-1][:, :k].T)

    def to_json(self) -> str:
        return json.dumps({"name": "linear", "params": {"mean": self.mean.tolist(), "basis": self.basis.tolist()}})


def loss(windows: DataFrame, model, *, key: str, window: str = "window") -> float:
    """The mean squared error of all windows."""
    errors = window_errors(windows.select(key, window), model, window=window)
    return errors.groupBy(key).agg(F.avg("mse").alias("mse")).agg(F.avg("mse")).first()[0]


def searched(train: DataFrame, validation: DataFrame, grid: Iterable[Mapping], *, key: str, window: str = "window") -> tuple[LinearAutoEncoder, list[dict]]:
    """X-06: the model with the least validation error over a grid of parameters, and all trials."""
    trials, best = [], None
    for params in grid:
        model = LinearAutoEncoder.fit(train, window=window, **params)
        trials.append({**params, "loss": loss(validation, model, key=key, window=window)})
        if best is None or trials[-1]["loss"] < best[0]:
            best = trials[-1]["loss"], model
    if best is None:
        raise ValueError("the grid is empty")
    return best[1], trials
