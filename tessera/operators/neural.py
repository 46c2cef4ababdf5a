"""A perceptron for regression: full-batch gradients added up across partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators.durable import free_name, stored
from tessera.operators.registry import IN, OUT, ParameterError, names, need, operator

_ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0.0), lambda z, a: (z > 0).astype(float)),
    "tanh": (np.tanh, lambda z, a: 1 - a * a),
    "logistic": (lambda z: 1 / (1 + np.exp(-z)), lambda z, a: a * (1 - a)),
    "identity": (lambda z: z, lambda z, a: np.ones_like(z)),
}


@dataclass
class Perceptron:
    """Layers of (weights, offsets); features are scaled to mean 0 and deviation 1, and so is the label."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    activation: str
    centre: np.ndarray
    spread: np.ndarray
    label_centre: float
    label_spread: float

    def _forward(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        f, out, a = _ACTIVATIONS[self.activation][0], [], (x - self.centre) / self.spread
        for i, (w, b) in enumerate(self.layers):
            z = a @ w + b
            a = z if i == len(self.layers) - 1 else f(z)
            out.append((z, a))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[-1][1][:, 0] * self.label_spread + self.label_centre

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums over the rows of the derivatives of half the squared error, and that error and the rows at the end."""
        steps, slope = self._forward(x), _ACTIVATIONS[self.activation][1]
        rest = steps[-1][1] - ((y - self.label_centre) / self.label_spread)[:, None]
        loss, out = float((rest * rest).sum()) / 2, []
        for i in range(len(self.layers) - 1, -1, -1):
            before = steps[i - 1][1] if i else (x - self.centre) / self.spread
            out.append(np.concatenate((rest.sum(axis=0), (before.T @ rest).ravel())))
            if i:
                rest = (rest @ self.layers[i][0].T) * slope(*steps[i - 1])
        return np.concatenate([*out[::-1], [loss, len(x)]])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit_perceptron(rows, sizes: list[int], activation: str, max_iter: int, rate: float, alpha: float, tol: float, seed: int) -> Perceptron:
    """Adam on whole-table gradients of rows(x array<double>, y); the driver gets one vector of weights a partition and round."""
    width = sizes[0]
    some = [*(f(F.col("x")[i]) for i in range(width) for f in (F.avg, F.stddev_pop)), F.avg("y"), F.stddev_pop("y")]
    found = [float(v or 0.0) for v in rows.agg(*(c.alias(f"c{i}") for i, c in enumerate(some))).first()]
    centre, spread = np.array(found[0:-2:2]), np.array(found[1:-2:2])
    rng = np.random.default_rng(seed)
    layers = [(rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    model = Perceptron(layers, activation, centre, np.where(spread > 0, spread, 1.0), found[-2], found[-1] or 1.0)
    first = second = 0.0
    best, waited = np.inf, 0
    for step in range(1, max_iter + 1):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def add(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    g = shared.value.gradient(_matrix(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False))
                    total = g if total is None else total + g
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

        parts = sorted(bytes(r.g) for r in rows.mapInArrow(add, "g binary").collect())  # one order, whatever task ends first
        shared.unpersist()
        if not parts:
            return model
        total = sum(np.frombuffer(g, np.float64) for g in parts)
        n, loss = total[-1], total[-2] / total[-1]
        weights = np.concatenate([np.concatenate((np.zeros_like(b), w.ravel())) for w, b in model.layers])
        g = total[:-2] / n + alpha * weights / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        new, at = [], 0
        for w, b in model.layers:
            new.append((w - move[at + len(b) : at + len(b) + w.size].reshape(w.shape), b - move[at : at + len(b)]))
            at += len(b) + w.size
        model = Perceptron(new, activation, model.centre, model.spread, model.label_centre, model.label_spread)
        waited = 0 if loss < best - tol else waited + 1
        best = min(best, loss)
        if waited >= 10:
            break
    return model


@operator("mlp-regressor", "mlp-regressor-model")
def mlp_regressor(inputs, features=None, label=None, prediction="prediction", layer_sizes="16", activation="relu", max_iter=200, learning_rate_init=0.01, alpha=0.0001, tol=1e-6, seed=0, **_):
    """A perceptron of these hidden layers. Rows with a null in a feature or the label teach nothing; where a feature is null so is
    the prediction."""
    df, found = inputs.get("train input data", inputs.get(IN)), names(need(features, "features"))
    if activation not in _ACTIVATIONS:
        raise ParameterError(f"unknown activation: {activation}")
    hidden = [int(x) for x in (str(layer_sizes).split(",") if not isinstance(layer_sizes, (list, tuple)) else layer_sizes)]
    x = F.array(*(F.col(f"`{c}`").cast("double") for c in found))
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
    rows = df.filter(whole & F.col(need(label, "label")).isNotNull()).select(x.alias("x"), F.col(label).cast("double").alias("y"))
    model = fit_perceptron(stored(rows, "perceptron"), [len(found), *hidden, 1], activation, int(max_iter), float(learning_rate_init), float(alpha), float(tol), int(seed))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(values):
        some = values.notna()
        out = pd.Series(np.nan, index=values.index, dtype=object).where(some, None)
        if some.any():
            out[some] = shared.value.predict(np.array(values[some].tolist(), float))
        return out

    (vector,) = free_name(df, "_vector")
    made = df.withColumn(vector, F.when(whole, x)).withColumn(prediction, predict(F.col(vector))).drop(vector)
    return {OUT: made, "model": model}
