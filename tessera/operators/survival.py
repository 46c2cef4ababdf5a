"""Cox's proportional hazards with ties, coded categories and Schoenfeld residuals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.durable import stored
from tessera.operators.registry import IN, OUT, ParameterError, names, need, operator

#: Distinct values of a coded attribute, at most: each is a covariate.
FACTORS = 200


def _covariates(df: DataFrame, attributes: list[str], categorical: list[str]) -> tuple[list[str], list[Column]]:
    """Names and columns: numbers as they are; categories as one 0/1 column for each value but the smallest."""
    kinds, found, columns = dict(df.dtypes), [], []
    for a in attributes:
        if a not in categorical and kinds[a] not in ("string", "boolean"):
            found.append(a)
            columns.append(F.col(a).cast("double"))
            continue
        values = [r[0] for r in df.select(a).filter(F.col(a).isNotNull()).distinct().orderBy(a).limit(FACTORS + 1).collect()]
        if len(values) > FACTORS:
            raise ParameterError(f"{a} has more than {FACTORS} values: too many to code")
        found += [f"{a}{v}" for v in values[1:]]
        columns += [F.when(F.col(a).isNotNull(), (F.col(a) == v).cast("double")) for v in values[1:]]
    return found, columns


class _Likelihood:
    """Partial likelihood over rows (t, e, x0 ...) in a table by ranges of time; each evaluation is two aggregations, and neither
    writes anything."""

    def __init__(self, rows: DataFrame, p: int, ties: str):
        ranged = rows.repartitionByRange(F.desc("t")).withColumn("part", F.spark_partition_id())
        self.rows, self.p, self.ties = stored(ranged, "survival"), p, ties
        self.pairs = [(i, j) for i in range(p) for j in range(i, p)]
        self.parts = [r[0] for r in self.rows.select("part").distinct().orderBy("part").collect()]

    def _sums(self, beta: np.ndarray) -> dict[str, Column]:
        risk = F.exp(sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0)))
        out = {"s": F.sum(risk)}
        out |= {f"s_{i}": F.sum(risk * F.col(f"x{i}")) for i in range(self.p)}
        return out | {f"s_{i}_{j}": F.sum(risk * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in self.pairs}

    def at_times(self, beta: np.ndarray, dead: bool = True) -> DataFrame:
        """One row for each time with an event: d events, sums over those at risk (s...) and over those who die (m...)."""
        sums = self._sums(beta)
        before = {r.part: [r[n] for n in sums] for r in self.rows.groupBy("part").agg(*(c.alias(n) for n, c in sums.items())).collect()}  # one row a partition
        at, table = np.zeros(len(sums)), []
        for part in self.parts:
            table.append((part, *map(float, at)))
            at = at + np.array(before[part], np.float64)
        bases = self.rows.sparkSession.createDataFrame(table, "part int, " + ", ".join(f"b{n} double" for n in sums))
        dies = F.col("e") == 1
        byt = self.rows.groupBy("part", "t").agg(*(c.alias(n) for n, c in sums.items()), F.sum("e").alias("d"), *(F.sum(F.when(dies, F.col(f"x{i}")).otherwise(0.0)).alias(f"u{i}") for i in range(self.p)))
        w = Window.partitionBy("part").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
        byt = byt.join(F.broadcast(bases), "part")
        byt = byt.select("part", "t", "d", *(f"u{i}" for i in range(self.p)), *((F.sum(n).over(w) + F.col(f"b{n}")).alias(n) for n in sums)).filter("d > 0")
        if dead and self.ties == "efron":
            m = self.rows.filter(dies).groupBy("part", "t").agg(*(c.alias(f"m{n}") for n, c in sums.items()))
            byt = byt.join(m, ["part", "t"])
        return byt

    def slope(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient, information and the log likelihood."""
        p, at = self.p, self.at_times(beta)
        score = sum((F.lit(float(b)) * F.col(f"u{i}") for i, b in enumerate(beta)), F.lit(0.0))
        first = at.agg(*(F.sum(f"u{i}").alias(f"g{i}") for i in range(p)), F.sum(score).alias("l")).first()
        if self.ties == "efron":
            # of d who die at once, the n-th is drawn from those at risk without n / d of the d
            at = at.withColumn("n", F.explode(F.sequence(F.lit(0), (F.col("d") - 1).cast("int")))).withColumn("f", F.col("n") / F.col("d"))
            some, weight = (lambda n: F.col(n) - F.col("f") * F.col(f"m{n}")), F.lit(1.0)
        else:
            some, weight = F.col, F.col("d")
        mean = lambda i: some(f"s_{i}") / some("s")
        told = [F.sum(weight * mean(i)) for i in range(p)] + [F.sum(weight * (some(f"s_{i}_{j}") / some("s") - mean(i) * mean(j))) for i, j in self.pairs] + [F.sum(weight * F.log(some("s")))]
        row = at.agg(*(c.alias(f"c{k}") for k, c in enumerate(told))).first()
        value = lambda x: x or 0.0
        gradient = np.array([value(first[i]) - value(row[i]) for i in range(p)])
        info = np.zeros((p, p))
        for k, (i, j) in enumerate(self.pairs):
            info[i, j] = info[j, i] = value(row[p + k])
        return gradient, info, value(first["l"]) - value(row[len(told) - 1])


@operator("cox-proportional-hazards")
def cox(inputs, attributes=None, time_attribute=None, y_attribute=None, categorical=None, ties="efron", max_iter=25, tolerance=1e-9, **_):
    """Coefficients by Newton steps on the partial likelihood, with Efron's or Breslow's form for ties.

    Text and boolean attributes, and those listed as ``categorical``, are coded as one 0/1 covariate for each value but the smallest.
    Rows with a null are left out. The second output has one row for each event: its time, and for each covariate the scaled Schoenfeld
    residual, events x covariance x (own covariates - their mean over those at risk, weighted by risk)."""
    df = inputs[IN]
    if ties not in ("efron", "breslow"):
        raise ParameterError("ties must be efron or breslow")
    found, columns = _covariates(df, names(need(attributes, "attributes")), names(categorical))
    p = len(found)
    if not p:
        raise ParameterError("no covariate: each attribute has one value at most")
    rows = df.select(F.col(need(time_attribute, "time_attribute")).cast("double").alias("t"), F.col(need(y_attribute, "y_attribute")).cast("int").alias("e"), *(c.alias(f"x{i}") for i, c in enumerate(columns))).dropna()
    fit = _Likelihood(rows, p, ties)
    beta, best, done, info = np.zeros(p), -math.inf, False, np.eye(p)
    step = np.zeros(p)
    for _i in range(int(max_iter)):
        gradient, info, likelihood = fit.slope(beta + step)
        if likelihood < best - 1e-9 * abs(best):  # too far: half as far
            step = step / 2
            continue
        beta, best = beta + step, likelihood
        step = np.linalg.solve(info + 1e-12 * np.eye(p), gradient)
        if np.abs(step).max() < float(tolerance):
            done = True
            break
    covariance = np.linalg.inv(info + 1e-12 * np.eye(p))
    errors = np.sqrt(np.diag(covariance))
    made = [(c, float(b), float(math.exp(b)), float(s), float(b / s) if s else None) for c, b, s in zip(found, beta, errors, strict=True)]
    at = fit.at_times(beta, dead=False)
    at = at.select(F.col("part").alias("_p"), F.col("t").alias("_t"), *((F.col(f"s_{i}") / F.col("s")).alias(f"mean{i}") for i in range(p)))
    events = fit.rows.filter("e = 1")
    n = events.count()
    j = events.join(at, (events["part"] == at["_p"]) & (events["t"] == at["_t"]))
    rest = [F.col(f"x{i}") - F.col(f"mean{i}") for i in range(p)]
    scaled = [sum((F.lit(float(n * covariance[i, k])) * rest[k] for k in range(p)), F.lit(0.0)).alias(found[i]) for i in range(p)]
    spark = df.sparkSession
    return {
        OUT: spark.createDataFrame(made, "covariate string, coefficient double, hazard_ratio double, standard_error double, z double"),
        "schoenfeld residuals": j.select(F.col("t").alias("Time"), *scaled),
        "converged": done,
        "log likelihood": best,
    }
