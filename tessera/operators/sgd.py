"""Linear regression by stochastic gradient descent: passes over chunks of rows, whose models are averaged after each pass."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.durable import stored
from tessera.operators.registry import IN, OUT, ParameterError, names, need, operator

#: Distinct rows of a chunk, about, and of a gradient.
CHUNK, BATCH = 16_384, 32
LOSSES = ("squared_error", "huber", "epsilon_insensitive", "squared_epsilon_insensitive")
RATES = ("constant", "optimal", "invscaling", "adaptive")
PENALTIES = ("l2", "l1", "elasticnet", "none")


@dataclass
class Settings:
    loss: str
    epsilon: float
    l1: float
    l2: float
    rate: str
    eta0: float
    power_t: float
    intercept: bool
    shuffle: bool
    seed: int
    alpha: float = 0.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def slope(self, rest: np.ndarray) -> np.ndarray:
        """Derivative of the loss by the prediction, for prediction - label."""
        if self.loss == "squared_error":
            return rest
        if self.loss == "huber":
            return np.clip(rest, -self.epsilon, self.epsilon)
        over = np.sign(rest) * np.maximum(np.abs(rest) - self.epsilon, 0)
        return np.sign(over) if self.loss == "epsilon_insensitive" else 2 * over

    def cost(self, rest: np.ndarray) -> np.ndarray:
        a = np.abs(rest)
        if self.loss == "squared_error":
            return rest * rest / 2
        if self.loss == "huber":
            return np.where(a <= self.epsilon, rest * rest / 2, self.epsilon * a - self.epsilon**2 / 2)
        over = np.maximum(a - self.epsilon, 0)
        return over if self.loss == "epsilon_insensitive" else over * over

    def eta(self, t: float, shrunk: float) -> float:
        if self.rate == "invscaling":
            return self.eta0 / t**self.power_t
        if self.rate == "optimal":
            start = 1 / max(self.alpha, 1e-12) / np.sqrt(np.sqrt(max(self.alpha, 1e-12)))
            return 1 / (max(self.alpha, 1e-12) * (start + t - 1))
        return self.eta0 * shrunk


def _chunks(df: DataFrame, found: list[str], label: str) -> tuple[DataFrame, np.ndarray, np.ndarray, float]:
    """Rows of packed matrices (chunk, x, y, n), and the means, deviations and number of all rows.

    Equal rows are one with a weight, so no chunk is hot; which chunk a row is in, and where, depends on its values only."""
    x = [F.col(f).cast("double") for f in found]
    rows = df.select(F.array(*x).alias("x"), F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull() & ~F.isnan("y") & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    rows = stored(rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")), "distinct")
    d, w = len(found), F.col("n")
    told = rows.agg(F.count(F.lit(1)), F.sum(w), *(F.sum(w * F.col("x")[i]) for i in range(d))).first()
    total = told[1] or 0.0
    mean = np.array([told[2 + i] or 0.0 for i in range(d)]) / max(total, 1)
    spread = rows.agg(*(F.sum(w * (F.col("x")[i] - float(mean[i])) * (F.col("x")[i] - float(mean[i]))) for i in range(d))).first()
    scale = np.sqrt(np.array([v or 0.0 for v in spread]) / max(total, 1))
    scale[scale == 0] = 1.0
    name = F.xxhash64("x", "y")
    rows = rows.withColumn("chunk", F.pmod(name, F.lit(max(1, -(-told[0] // CHUNK)))).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        m = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        y, n = table["y"].to_numpy(), table["n"].to_numpy()
        order = np.lexsort((y, *m.T))
        cell = lambda v: pa.array([np.ascontiguousarray(v[order]).tobytes()], pa.binary())
        return pa.table({"chunk": table["chunk"].slice(0, 1), "x": cell(m), "y": cell(y), "n": cell(n)})

    packed = stored(rows.groupBy("chunk").applyInArrow(pack, "chunk int, x binary, y binary, n binary"), "chunks")
    return packed, mean, scale, float(total)


def _pass(s: Settings, weights: np.ndarray, bias: float, t0: float, epoch: int, shrunk: float):
    """One pass over each chunk from these weights; (place, value) to be added up: weights and bias times rows, the cost, rows."""
    d = len(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(d + 3)
        for batch in batches:
            for chunk, x, y, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "x", "y", "n")), strict=True):
                x = (np.frombuffer(x).reshape(-1, d) - s.mean) / s.scale
                y, n = np.frombuffer(y), np.frombuffer(n)
                w, b, t = weights.copy(), bias, t0
                cost = float((s.cost(x @ w + b - y) * n).sum())
                order = np.random.default_rng((s.seed, epoch, chunk)).permutation(len(y)) if s.shuffle else np.arange(len(y))
                for at in range(0, len(y), BATCH):
                    some = order[at : at + BATCH]
                    xs, ns = x[some], n[some]
                    g = s.slope(xs @ w + b - y[some]) * ns / ns.sum()
                    eta = s.eta(t, shrunk)
                    w = (w - eta * (xs.T @ g)) / (1 + eta * s.l2)
                    if s.l1:
                        w = np.sign(w) * np.maximum(np.abs(w) - eta * s.l1, 0)
                    if s.intercept:
                        b -= eta * g.sum()
                    t += 1
                out += np.concatenate([w, [b, 0.0, 0.0]]) * n.sum() + np.concatenate([np.zeros(d + 1), [cost, n.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 3, dtype=np.int32)), pa.array(out)], names=["place", "value"])

    return run


@dataclass
class LinearModel:
    features: list[str]
    coefficients: list[float]
    intercept: float
    prediction: str
    costs: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with their prediction; null where a feature is null."""
        made = sum((F.lit(c) * F.col(f).cast("double") for f, c in zip(self.features, self.coefficients, strict=True)), F.lit(self.intercept))
        return df.withColumn(self.prediction, made)


def descend(df: DataFrame, found: list[str], label: str, s: Settings, max_iter: int, tolerance: float, patience: int, average: bool, prediction: str) -> LinearModel:
    chunks, s.mean, s.scale, total = _chunks(df, found, label)
    d = len(found)
    w, b, best, waited, shrunk, costs, t = np.zeros(d), 0.0, np.inf, 0, 1.0, [], 1.0
    kept, kept_b, n_kept = np.zeros(d), 0.0, 0
    chosen = w, b
    for epoch in range(max_iter if total else 0):
        told = chunks.mapInArrow(_pass(s, w, b, t, epoch, shrunk), "place int, value double").groupBy("place").agg(F.sum("value")).collect()
        out = np.zeros(d + 3)
        for place, value in told:
            out[place] = value
        cost = out[d + 1] / total + s.l1 * np.abs(w).sum() + s.l2 * (w * w).sum() / 2  # of the weights this pass began with
        costs.append(float(cost))
        if cost < best:
            chosen = w, b
        waited = waited + 1 if cost > best - tolerance else 0
        best = min(best, cost)
        w, b = out[:d] / total, float(out[d] / total)
        t += max(1.0, total / max(BATCH, 1) if total < CHUNK else CHUNK / BATCH)
        if average and epoch >= max_iter // 2:
            kept, kept_b, n_kept = kept + w, kept_b + b, n_kept + 1
        if waited >= patience:
            if s.rate != "adaptive" or s.eta0 * shrunk < 1e-6:
                break
            shrunk, waited = shrunk / 5, 0
    w, b = (kept / n_kept, kept_b / n_kept) if n_kept else chosen if costs and waited >= patience else (w, b)
    coefficients = w / s.scale if d and total else w
    return LinearModel(found, [float(c) for c in coefficients], float(b - (coefficients * s.mean).sum()), prediction, costs)


class Descent:
    """The algorithm with its parameters, for operators that fit a given algorithm."""

    def __init__(self, **params):
        self.params = params

    def fit_rows(self, df: DataFrame, features: list[str], label: str, prediction: str) -> dict:
        return sgd_regressor({IN: df}, features=features, label=label, prediction=prediction, **self.params)


@operator("sgd-regressor")
def sgd_algorithm(inputs, **params):
    """The algorithm, or the fitted model where there are rows to fit."""
    return sgd_regressor(inputs, **params) if inputs else {"algorithm": Descent(**params)}


@operator("sgd-regressor-model")
def sgd_regressor(
    inputs, features=None, label=None, prediction="prediction", loss="squared_error", penalty="l2", alpha=0.0001, l1_ratio=0.15, max_iter=1000, tol=1e-3, learning_rate="invscaling", eta0=0.01, power_t=0.25,
    epsilon=0.1, fit_intercept=True, shuffle=True, random_state=0, n_iter_no_change=5, average=False, **_,
):
    """Linear regression by stochastic gradient descent on standardised features, with a model to label further rows.

    In each pass every chunk of about ``CHUNK`` distinct rows is walked in gradients of ``BATCH`` rows from the same weights, and the chunks'
    weights are averaged by their rows. Chunks and walks depend on the rows' values and ``random_state`` only, so how rows are laid out
    changes nothing but rounding. Passes end when the cost fell by less than ``tol`` for ``n_iter_no_change`` passes; with the adaptive
    rate that divides the rate by five instead, until it is below 1e-6. Penalties hold for standardised weights. Rows with a null or NaN are not learnt from."""
    found = names(need(features, "features"))
    for name, value, known in (("loss", loss, LOSSES), ("penalty", penalty or "none", PENALTIES), ("learning_rate", learning_rate, RATES)):
        if value not in known:
            raise ParameterError(f"{name} must be one of {known}")
    for name, value in (("max_iter", max_iter), ("alpha", alpha), ("n_iter_no_change", n_iter_no_change), ("eta0", eta0)):
        if float(value) < 0 or (name in ("max_iter", "n_iter_no_change", "eta0") and float(value) == 0):
            raise ParameterError(f"{name} must be greater than 0")
    share = {"l1": 1.0, "l2": 0.0, "elasticnet": float(l1_ratio)}.get(penalty, 0.0)
    a = float(alpha) if penalty in ("l1", "l2", "elasticnet") else 0.0
    on = lambda v: v in (True, 1, "1", "true", "True")
    s = Settings(loss, float(epsilon), a * share, a * (1 - share), learning_rate, float(eta0), float(power_t), on(fit_intercept), on(shuffle), int(random_state or 0), float(alpha))
    df = inputs.get("train input data", inputs.get(IN))
    model = descend(df, found, need(label, "label"), s, int(max_iter), float(tol), int(n_iter_no_change), on(average), prediction)
    return {OUT: model.transform(df), "model": model}
