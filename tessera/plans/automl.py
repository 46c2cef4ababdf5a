"""Model search: features as one pipeline, algorithms with grids, a split or folds, models ranked by a metric."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.ml import Pipeline
from pyspark.ml import feature as X  # noqa: N812
from pyspark.ml.tuning import CrossValidator, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ml import evaluator


def feature_stages(features: list[dict]) -> tuple[list, list[str]]:
    """Stages and the columns they end in, for {name, type (numerical, categorical, textual, vector), transform, scaler, missing}."""
    stages, ends = [], []
    for f in features:
        a, kind, how = f["name"], f.get("type", "numerical"), f.get("transform")
        if kind == "numerical":
            end = a
            if f.get("missing") in ("mean", "median", "mode"):
                stages.append(X.Imputer(inputCols=[end], outputCols=[f"{a}_imp"], strategy=f["missing"]))
                end = f"{a}_imp"
            if how == "binarize":
                stages.append(X.Binarizer(inputCol=end, outputCol=f"{a}_bin", threshold=float(f.get("threshold", 0))))
                end = f"{a}_bin"
            elif how == "quantis":
                stages.append(X.QuantileDiscretizer(inputCol=end, outputCol=f"{a}_q", numBuckets=int(f.get("buckets", 2)), handleInvalid="keep"))
                end = f"{a}_q"
            elif how == "buckets":
                stages.append(X.Bucketizer(inputCol=end, outputCol=f"{a}_b", splits=[float(x) for x in f["splits"]], handleInvalid="keep"))
                end = f"{a}_b"
            if f.get("scaler"):
                stages.append(X.VectorAssembler(inputCols=[end], outputCol=f"{a}_v", handleInvalid="skip"))
                make = {"standard": X.StandardScaler, "min_max": X.MinMaxScaler, "max_abs": X.MaxAbsScaler}[f["scaler"]]
                stages.append(make(inputCol=f"{a}_v", outputCol=f"{a}_s"))
                end = f"{a}_s"
        elif kind == "categorical":
            stages.append(X.StringIndexer(inputCol=a, outputCol=f"{a}_inx", handleInvalid="keep"))
            end = f"{a}_inx"
            if how == "one_hot_encoder":
                stages.append(X.OneHotEncoder(inputCol=end, outputCol=f"{a}_ohe", handleInvalid="keep"))
                end = f"{a}_ohe"
        elif kind == "textual":
            stages.append(X.RegexTokenizer(inputCol=a, outputCol=f"{a}_tok", pattern=r"\s+"))
            make = X.CountVectorizer(inputCol=f"{a}_tok", outputCol=f"{a}_vec", vocabSize=int(f.get("vocab_size", 1000))) if how == "token_stop_vec" or how == "count" else X.HashingTF(inputCol=f"{a}_tok", outputCol=f"{a}_vec", numFeatures=int(f.get("vocab_size", 1000)))
            stages.append(make)
            end = f"{a}_vec"
        else:
            end = a
        ends.append(end)
    return stages, ends


def drawn(space: dict, number: int, seed: int) -> list[dict]:
    """Parameters drawn at random: from a list, or ("uniform" | "log_uniform" | "int", low, high)."""
    rng = random.Random(seed)

    def one(kind):
        if isinstance(kind, tuple) and len(kind) == 3 and kind[0] in ("uniform", "log_uniform", "int"):
            how, low, high = kind
            if how == "int":
                return rng.randint(int(low), int(high))
            return rng.uniform(low, high) if how == "uniform" else math.exp(rng.uniform(math.log(low), math.log(high)))
        return rng.choice(list(kind))

    return [{p: one(k) for p, k in space.items()} for _ in range(number)]


def search(
    df: DataFrame, features: list[dict], label: dict | None, algorithms: list[tuple[str, object, dict]], metric: str, split: str | int = 0.8, reduce_to: int | None = None, max_models: int | None = None, seed: int = 0,
    parallelism: int = 4, strategy: str = "grid", least_rows: int = 1000, keep: int = 3,
) -> list[dict]:
    """Models by falling quality: name, params, metric, model. algorithms: (name, estimator, {param: values}); split: a share for
    training, or a number of folds. Features are fitted within each training part, so nothing of the rows a model is measured on
    comes into it.

    grid: all combinations, or ``max_models`` of them. random: ``max_models`` (10) draws for each algorithm, whose values may also be
    distributions, as in ``drawn``. halving: those draws (or the grid) meet on a sample of ``least_rows``, the best 1 / ``keep`` go on to
    ``keep`` times as many rows, until all rows are in; what falls out keeps the metric of its last sample."""
    stages, ends = feature_stages(features)
    stages = [*stages, X.VectorAssembler(inputCols=ends, outputCol="features", handleInvalid="skip")]
    column = "features"
    if reduce_to:
        stages.append(X.PCA(k=int(reduce_to), inputCol="features", outputCol="reduced"))
        column = "reduced"
    target, labelled = None, df
    if label:
        target = label["name"]
        if label.get("type") == "categorical":
            # numbers of labels are the same in every part; they say nothing about a row
            labelled = X.StringIndexer(inputCol=target, outputCol="_label", handleInvalid="skip").fit(df).transform(df)
            target = "_label"
    e = evaluator(metric, target or "label")
    better = (lambda m: -m) if e.isLargerBetter() else (lambda m: m)
    candidates = []
    for name, algorithm, space in algorithms:
        a = algorithm.copy()
        a.set(a.featuresCol, column)
        if target:
            a.set(a.labelCol, target)
        if strategy == "grid" or (strategy == "halving" and not max_models):
            found = [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]
            if max_models and len(found) > max_models:
                found = random.Random(seed).sample(found, max_models)
        elif strategy in ("random", "halving"):
            found = drawn(space, max_models or 10, seed)
        else:
            raise ValueError(f"unknown strategy: {strategy}")
        candidates += [(name, a, p) for p in found]

    def measured(some: list[tuple], rows: DataFrame) -> list[tuple[float, object]]:
        out = [None] * len(some)
        for a in {id(c[1]): c[1] for c in some}.values():
            mine = [i for i, c in enumerate(some) if c[1] is a]
            maps = [{a.getParam(p): v for p, v in some[i][2].items()} for i in mine]
            whole = Pipeline(stages=[*stages, a])
            if not target:
                for i, m in zip(mine, maps, strict=True):
                    model = whole.fit(rows, m)
                    out[i] = e.evaluate(model.transform(rows)), model
                continue
            tuner = CrossValidator(numFolds=int(split)) if float(split) > 1 else TrainValidationSplit(trainRatio=float(split))
            tuner = tuner.setEstimator(whole).setEstimatorParamMaps(maps).setEvaluator(e).setSeed(seed).setParallelism(parallelism).setCollectSubModels(False)
            fitted = tuner.fit(rows)
            values = list(fitted.avgMetrics if float(split) > 1 else fitted.validationMetrics)
            best = min(range(len(values)), key=lambda k: better(values[k]))
            for k, i in enumerate(mine):
                out[i] = values[k], fitted.bestModel if k == best else None
        return out

    told: list[dict] = []
    if strategy == "halving":
        total, n = labelled.count(), min(int(least_rows), max(labelled.count(), 1))
        name = F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in labelled.columns)), F.lit(1 << 30))
        while n < total and len(candidates) > 1:
            rows = labelled.filter(name < int(n / total * (1 << 30)))
            ranked = sorted(zip(measured(candidates, rows), candidates, strict=True), key=lambda r: better(r[0][0]))
            stay = max(1, len(ranked) // keep)
            told += [{"name": c[0], "params": c[2], "metric": m, "model": None, "rows": n} for (m, _), c in ranked[stay:]]
            candidates, n = [c for _, c in ranked[:stay]], n * keep
        last = [{"name": c[0], "params": c[2], "metric": m, "model": model, "rows": total} for (m, model), c in zip(measured(candidates, labelled), candidates, strict=True)]
        return sorted(last, key=lambda r: better(r["metric"])) + sorted(told, key=lambda r: (-r["rows"], better(r["metric"])))
    made = [{"name": c[0], "params": c[2], "metric": m, "model": model} for (m, model), c in zip(measured(candidates, labelled), candidates, strict=True)]
    return sorted(made, key=lambda r: better(r["metric"]))
