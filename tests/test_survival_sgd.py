"""Cox regression and gradient descent against plain NumPy."""

import numpy as np
import pytest

from tessera.operators.registry import ParameterError, run

IN, OUT = "input data", "output data"


def survival(seed, n=160):
    rng = np.random.default_rng(seed)
    x, kind = rng.normal(0, 1, n).round(2), rng.integers(0, 3, n)
    time = np.ceil(rng.exponential(6 * np.exp(-0.7 * x - 0.5 * (kind == 2)))) + 0.0  # many ties
    event = (rng.random(n) < 0.75).astype(int)
    return time, event, x, kind


def plain(time, event, m, ties):
    """Newton steps over all rows; coefficients, covariance."""
    p = m.shape[1]
    beta = np.zeros(p)
    for _ in range(30):
        g, h = np.zeros(p), np.zeros((p, p))
        for t in sorted(set(time[event == 1])):
            risk, dead = m[time >= t], m[(time == t) & (event == 1)]
            r, q = np.exp(risk @ beta), np.exp(dead @ beta)
            g += dead.sum(axis=0)
            for n in range(len(dead)):
                f = n / len(dead) if ties == "efron" else 0
                s0 = r.sum() - f * q.sum()
                s1 = r @ risk - f * (q @ dead)
                s2 = (risk * r[:, None]).T @ risk - f * (dead * q[:, None]).T @ dead
                g -= s1 / s0
                h += s2 / s0 - np.outer(s1, s1) / s0**2
        beta = beta + np.linalg.solve(h, g)
    return beta, np.linalg.inv(h)


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_with_ties_and_categories(spark, ties):
    time, event, x, kind = survival(3)
    rows = [(float(t), int(e), float(v), "abc"[k]) for t, e, v, k in zip(time, event, x, kind, strict=True)]
    df = spark.createDataFrame([*rows, (None, 1, 0.5, "a"), (3.0, 1, None, "b")], "t double, e int, x double, kind string").repartition(5)
    made = run("cox-proportional-hazards", {IN: df}, attributes=["x", "kind"], time_attribute="t", y_attribute="e", ties=ties)
    m = np.stack([x, kind == 1, kind == 2], axis=1).astype(float)
    beta, covariance = plain(time, event, m, ties)
    got = made[OUT].collect()
    assert [r.covariate for r in got] == ["x", "kindb", "kindc"] and made["converged"]
    assert np.allclose([r.coefficient for r in got], beta, atol=1e-7)
    assert np.allclose([r.standard_error for r in got], np.sqrt(np.diag(covariance)), rtol=1e-6)
    want = []
    for i in np.nonzero(event)[0]:
        at = time >= time[i]
        r = np.exp(m[at] @ beta)
        want.append((time[i], *(event.sum() * covariance @ (m[i] - r @ m[at] / r.sum()))))
    told = sorted(map(tuple, made["schoenfeld residuals"].collect()))
    assert np.allclose(told, sorted(want), atol=1e-5)


def test_cox_limits(spark):
    df = spark.createDataFrame([(float(i), 1, f"v{i}") for i in range(300)], "t double, e int, k string")
    with pytest.raises(ParameterError, match="200"):
        run("cox-proportional-hazards", {IN: df}, attributes=["k"], time_attribute="t", y_attribute="e")


def regression(seed, n=4000):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(5, 2, n), rng.normal(-100, 30, n), rng.random(n)], axis=1)
    return x, x @ [1.5, -0.2, 4.0] + 7 + rng.normal(0, 0.5, n)


def frame(spark, x, y, parts):
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double").repartition(parts)


@pytest.mark.parametrize("rate", ["invscaling", "adaptive"])
def test_descent_reaches_the_closed_form(spark, rate):
    x, y = regression(1)
    made = run("sgd-regressor", {IN: frame(spark, x, y, 4)}, features=["a", "b", "c"], label="y", learning_rate=rate, alpha=0.0, tol=1e-7, max_iter=60)
    exact = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
    model = made["model"]
    assert np.allclose([*model.coefficients, model.intercept], exact, rtol=0.03, atol=0.02)
    assert model.costs[-1] < model.costs[0]
    rest = np.array([r.prediction - r.y for r in made[OUT].collect()])
    assert (rest**2).mean() < 1.01 * ((np.column_stack([x, np.ones(len(x))]) @ exact - y) ** 2).mean()


def test_descent_does_not_depend_on_the_layout(spark):
    x, y = regression(2, 900)
    x[500:], y[500:] = x[0], y[0]  # one row again and again
    found = [run("sgd-regressor", {IN: frame(spark, x, y, n)}, features=["a", "b", "c"], label="y", max_iter=5)["model"] for n in (1, 7)]
    assert np.allclose(found[0].coefficients, found[1].coefficients, rtol=1e-9) and np.allclose(found[0].costs, found[1].costs, rtol=1e-9)


def test_as_an_algorithm(spark):
    x, y = regression(4, 300)
    df = frame(spark, x, y, 2)
    algorithm = run("sgd-regressor", max_iter=3)["algorithm"]
    made = run("regression-model", {IN: df, "algorithm": algorithm}, features=["a", "b", "c"], label="y", prediction="p")
    assert made[OUT].columns == [*df.columns, "p"] and len(made["model"].costs) == 3


def test_penalties_and_losses(spark):
    x, y = regression(3, 1500)
    df = frame(spark, x, y, 3)
    fit = lambda **p: run("sgd-regressor", {IN: df}, features=["a", "b", "c"], label="y", max_iter=12, **p)["model"]
    free, ridge, lasso = fit(alpha=0.0), fit(penalty="l2", alpha=1.0), fit(penalty="l1", alpha=2.0)
    size = lambda m: sum(abs(c) for c in m.coefficients)
    assert size(ridge) < 0.8 * size(free)
    assert lasso.coefficients[2] == 0 and lasso.coefficients[1] != 0  # c is the weakest of the standardised features
    y[:30] += 1e4
    wild = frame(spark, x, y, 3)
    huber = run("sgd-regressor", {IN: wild}, features=["a", "b", "c"], label="y", loss="huber", epsilon=1.0, learning_rate="constant", eta0=0.05, max_iter=25)["model"]
    assert abs(huber.coefficients[0] - 1.5) < 0.2
    with pytest.raises(ParameterError):
        fit(loss="cubic")
