"""Machine learning: features, algorithms, models, evaluation. Algorithms are Spark's; what Spark lacks is composed here."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C  # noqa: N812
from pyspark.ml import clustering as U  # noqa: N812
from pyspark.ml import evaluation as E  # noqa: N812
from pyspark.ml import feature as X  # noqa: N812
from pyspark.ml import recommendation as R  # noqa: N812
from pyspark.ml import regression as G  # noqa: N812
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from tessera.operators.durable import free_name, numbered, running
from tessera.operators.neighbours import nearest
from tessera.operators.registry import IN, OPERATORS, OUT, ParameterError, flag, names, need, operator


def _aliases(alias, found, end):
    given = [a.strip() for a in (alias.split(",") if isinstance(alias, str) and alias else alias or [])]
    return (given + [f"{a}{end}" for a in found[len(given) :]])[: len(found)]


# --- features


@operator("feature-assembler")
def assemble(inputs, attributes=None, alias="features", handle_invalid="keep", **_):
    return {OUT: X.VectorAssembler(inputCols=names(need(attributes, "attributes")), outputCol=alias, handleInvalid=handle_invalid).transform(inputs[IN])}


@operator("feature-disassembler")
def disassemble(inputs, feature=None, alias="vector_", top_n=0, **_):
    df, a = inputs[IN], names(need(feature, "feature"))[0]
    n = int(top_n) or df.select(F.max(F.size(vector_to_array(F.col(a))))).first()[0] or 0
    return {OUT: df.withColumns({f"{alias}{i + 1}": F.try_element_at(vector_to_array(F.col(a)), F.lit(i + 1)) for i in range(n)})}


def _fitted(inputs, estimator, port="model"):
    model = estimator.fit(inputs[IN])
    return {OUT: model.transform(inputs[IN]), port: model, "model": model, "transformation model": model}


@operator("vector-indexer")
def vector_indexer(inputs, attributes=None, alias=None, max_categories=20, **_):
    found = names(need(attributes, "attributes"))
    return _fitted(inputs, Pipeline(stages=[X.VectorIndexer(inputCol=a, outputCol=b, maxCategories=int(max_categories), handleInvalid="keep") for a, b in zip(found, _aliases(alias, found, "_indexed"), strict=True)]), "indexer models")


@operator("feature-indexer", "string-indexer")
def feature_indexer(inputs, attributes=None, alias=None, **_):
    found = names(need(attributes, "attributes"))
    return _fitted(inputs, X.StringIndexer(inputCols=found, outputCols=_aliases(alias, found, "_inx"), handleInvalid="keep", stringOrderType="frequencyDesc"), "models")


@operator("index-to-string")
def index_to_string(inputs, attributes=None, alias=None, labels=None, **_):
    df, found = inputs[IN], names(need(attributes, "attributes"))
    for a, b in zip(found, _aliases(alias, found, "_str"), strict=True):
        extra = {"labels": labels} if labels else {}
        df = X.IndexToString(inputCol=a, outputCol=b, **extra).transform(df)
    return {OUT: df}


@operator("one-hot-encoder", "one-hot-encoding")
def one_hot(inputs, attributes=None, alias=None, drop_last=True, **_):
    df, found = inputs[IN], names(need(attributes, "attributes"))
    texts = [a for a in found if dict(df.dtypes)[a] == "string"]
    stages = [X.StringIndexer(inputCols=texts, outputCols=[f"_{a}_inx" for a in texts], handleInvalid="keep")] if texts else []
    stages.append(X.OneHotEncoder(inputCols=[f"_{a}_inx" if a in texts else a for a in found], outputCols=_aliases(alias, found, "_ohe"), dropLast=flag(drop_last), handleInvalid="keep"))
    made = _fitted(inputs, Pipeline(stages=stages))
    return made | {OUT: made[OUT].drop(*(f"_{a}_inx" for a in texts))}


def _vector(inputs, attributes, make, alias):
    """An estimator on one vector column, or on number columns put together first."""
    df, found = inputs[IN], names(need(attributes, "attributes"))
    if len(found) == 1 and dict(df.dtypes)[found[0]] == "vector":
        return _fitted(inputs, make(found[0], alias or f"{found[0]}_out"))
    made = _fitted(inputs, Pipeline(stages=[X.VectorAssembler(inputCols=found, outputCol="_features", handleInvalid="skip"), make("_features", alias or "scaled")]))
    return made | {OUT: made[OUT].drop("_features")}


@operator("pca", "features-reduction")
def pca(inputs, attribute=None, attributes=None, k=2, output_attribute="pca", **_):
    return _vector(inputs, attribute or attributes, lambda a, b: X.PCA(k=int(k), inputCol=a, outputCol=b), output_attribute)


@operator("standard-scaler")
def standard_scaler(inputs, attributes=None, attribute=None, alias=None, with_mean=False, with_std=True, **_):
    return _vector(inputs, attributes or attribute, lambda a, b: X.StandardScaler(inputCol=a, outputCol=b, withMean=flag(with_mean), withStd=flag(with_std)), alias)


@operator("max-abs-scaler")
def max_abs_scaler(inputs, attributes=None, attribute=None, alias=None, **_):
    return _vector(inputs, attributes or attribute, lambda a, b: X.MaxAbsScaler(inputCol=a, outputCol=b), alias)


@operator("min-max-scaler")
def min_max_scaler(inputs, attributes=None, attribute=None, alias=None, min=0.0, max=1.0, **_):  # noqa: A002
    return _vector(inputs, attributes or attribute, lambda a, b: X.MinMaxScaler(inputCol=a, outputCol=b, min=float(min), max=float(max)), alias)


@operator("rescale")
def rescale(inputs, type="min_max", attributes=None, min=0.0, max=1.0, with_mean=True, with_std=True, **_):  # noqa: A002
    """Columns rescaled in place; the statistics of all are one aggregated row."""
    df, found = inputs[IN], names(need(attributes, "attributes"))
    s = df.agg(*(g(F.col(a)).alias(f"_{n}{i}") for i, a in enumerate(found) for n, g in (("lo", F.min), ("hi", F.max), ("mu", F.avg), ("sd", F.stddev), ("ab", lambda c: F.max(F.abs(c))))))
    new = {}
    for i, a in enumerate(found):
        c, part = F.col(a), lambda n, i=i: F.col(f"_{n}{i}")
        if type == "min_max":
            span = part("hi") - part("lo")
            new[a] = F.when(span != 0, (c - part("lo")) / span * (float(max) - float(min)) + float(min)).otherwise(F.lit((float(max) + float(min)) / 2))
        elif type == "z_score":
            new[a] = (c - (part("mu") if flag(with_mean) else 0)) / (F.when(part("sd") != 0, part("sd")).otherwise(1.0) if flag(with_std) else 1)
        else:
            new[a] = c / F.when(part("ab") != 0, part("ab")).otherwise(1.0)
    return {OUT: df.crossJoin(F.broadcast(s)).withColumns(new).select(df.columns)}


@operator("bucketizer")
def bucketizer(inputs, attributes=None, splits=None, aliases=None, handle_invalid="keep", **_):
    found = names(need(attributes, "attributes"))
    edges = [float(x) for x in (splits.split(",") if isinstance(splits, str) else splits)]
    model = X.Bucketizer(splitsArray=[edges] * len(found), inputCols=found, outputCols=_aliases(aliases, found, "_bucket"), handleInvalid=handle_invalid)
    return {OUT: model.transform(inputs[IN]), "model": model}


@operator("quantile-discretizer", "kbins-discretizer")
def quantile_discretizer(inputs, attributes=None, attribute=None, buckets=2, n_quantiles=None, aliases=None, alias=None, relative_error=0.001, **_):
    found = names(need(attributes or attribute, "attributes"))
    return _fitted(inputs, X.QuantileDiscretizer(numBuckets=int(n_quantiles or buckets), inputCols=found, outputCols=_aliases(aliases or alias, found, "_bucket"), relativeError=float(relative_error), handleInvalid="keep"))


@operator("chi-sq-selector")
def chi_sq_selector(inputs, attributes=None, label=None, alias="selected", num_top_features=50, **_):
    return _fitted(inputs, X.ChiSqSelector(featuresCol=names(need(attributes, "attributes"))[0], labelCol=label, outputCol=alias, numTopFeatures=int(num_top_features)))


@operator("lsh", "locality-sensitive-hashing")
def lsh(inputs, attribute=None, output_attribute="hashes", type="bucketed-random", num_hash_tables=3, bucket_length=2.0, seed=0, **_):  # noqa: A002
    a = names(need(attribute, "attribute"))[0]
    make = X.MinHashLSH(inputCol=a, outputCol=output_attribute, numHashTables=int(num_hash_tables), seed=int(seed)) if "min" in type else X.BucketedRandomProjectionLSH(inputCol=a, outputCol=output_attribute, numHashTables=int(num_hash_tables), bucketLength=float(bucket_length), seed=int(seed))
    return _fitted(inputs, make)


# --- algorithms: parameters by our names, Spark's names and types


def _estimator(cls, params: dict, fixed: dict | None = None):
    def make(**given):
        out = dict(fixed or {})
        for ours, (theirs, kind) in params.items():
            if given.get(ours) not in (None, ""):
                out[theirs] = kind(given[ours])
        return cls(**out)

    return make


def _ints(x):
    return [int(v) for v in (x.split(",") if isinstance(x, str) else x)]


_TREE = {"max_bins": ("maxBins", int), "max_depth": ("maxDepth", int), "min_info_gain": ("minInfoGain", float), "min_instances_per_node": ("minInstancesPerNode", int), "min_instance": ("minInstancesPerNode", int), "seed": ("seed", int), "impurity": ("impurity", str)}
_FIT = {"max_iter": ("maxIter", int), "reg_param": ("regParam", float), "tol": ("tol", float), "elastic_net_param": ("elasticNetParam", float), "elastic_net": ("elasticNetParam", float), "fit_intercept": ("fitIntercept", flag), "standardization": ("standardization", flag), "aggregation_depth": ("aggregationDepth", int)}
_FOREST = _TREE | {"num_trees": ("numTrees", int), "feature_subset_strategy": ("featureSubsetStrategy", str)}
_K = {"number_of_clusters": ("k", int), "max_iterations": ("maxIter", int), "tolerance": ("tol", float), "seed": ("seed", int)}
_NO_ELASTIC = {k: v for k, v in _FIT.items() if "elastic" not in k}

CLASSIFIERS = {
    "svm-classification": _estimator(C.LinearSVC, _NO_ELASTIC | {"threshold": ("threshold", float)}),
    "logistic-regression": _estimator(C.LogisticRegression, _FIT | {"family": ("family", str), "threshold": ("threshold", float)}),
    "decision-tree-classifier": _estimator(C.DecisionTreeClassifier, _TREE),
    "gbt-classifier": _estimator(C.GBTClassifier, {k: v for k, v in _TREE.items() if k != "impurity"} | {"max_iter": ("maxIter", int), "step_size": ("stepSize", float)}),
    "naive-bayes-classifier": _estimator(C.NaiveBayes, {"smoothing": ("smoothing", float), "model_type": ("modelType", str)}),
    "random-forest-classifier": _estimator(C.RandomForestClassifier, _FOREST),
    "perceptron-classifier": _estimator(C.MultilayerPerceptronClassifier, {"layers": ("layers", _ints), "block_size": ("blockSize", int), "max_iter": ("maxIter", int), "seed": ("seed", int), "solver": ("solver", str)}),
    "fm-classifier": _estimator(C.FMClassifier, {"factor_size": ("factorSize", int), "max_iter": ("maxIter", int), "step_size": ("stepSize", float)}),
    "one-vs-rest-classifier": lambda algorithm=None, **_: C.OneVsRest(classifier=algorithm or C.LogisticRegression()),
}
CLASSIFIERS |= {"naive-bayes": CLASSIFIERS["naive-bayes-classifier"], "perceptron": CLASSIFIERS["perceptron-classifier"], "mlp-classifier": CLASSIFIERS["perceptron-classifier"], "svm": CLASSIFIERS["svm-classification"]}
REGRESSORS = {
    "linear-regression": _estimator(G.LinearRegression, _FIT | {"solver": ("solver", str)}),
    "generalized-linear-regressor": _estimator(G.GeneralizedLinearRegression, {"max_iter": ("maxIter", int), "reg_param": ("regParam", float), "family": ("family", str), "link": ("link", str)}),
    "decision-tree-regressor": _estimator(G.DecisionTreeRegressor, _TREE),
    "gbt-regressor": _estimator(G.GBTRegressor, _TREE | {"max_iter": ("maxIter", int)}),
    "random-forest-regressor": _estimator(G.RandomForestRegressor, _FOREST),
    "aft-survival-regression": _estimator(G.AFTSurvivalRegression, {"max_iter": ("maxIter", int), "censor": ("censorCol", str), "aggregation_depth": ("aggregationDepth", int), "quantiles_col": ("quantilesCol", str)}),
    "isotonic-regression": _estimator(G.IsotonicRegression, {"isotonic": ("isotonic", flag)}),
    "huber-regressor": _estimator(G.LinearRegression, {"max_iter": ("maxIter", int), "epsilon": ("epsilon", float), "tol": ("tol", float)}, {"loss": "huber"}),
    "fm-regression": _estimator(G.FMRegressor, {"factor_size": ("factorSize", int), "max_iter": ("maxIter", int), "step_size": ("stepSize", float)}),
}
CLUSTERERS = {
    "k-means-clustering": lambda type="kmeans", **p: (_estimator(U.BisectingKMeans, {k: v for k, v in _K.items() if k != "tolerance"} | {"distance": ("distanceMeasure", str)}) if "bis" in type else _estimator(U.KMeans, _K | {"distance": ("distanceMeasure", str), "init_mode": ("initMode", str)}))(**p),
    "gaussian-mixture-clustering": _estimator(U.GaussianMixture, _K),
    "lda-clustering": _estimator(U.LDA, {"number_of_topics": ("k", int), "max_iterations": ("maxIter", int), "optimizer": ("optimizer", str), "seed": ("seed", int)}),
    "bkm_clustering": _estimator(U.BisectingKMeans, {k: v for k, v in _K.items() if k != "tolerance"}),
}
CLUSTERERS |= {"k-means": CLUSTERERS["k-means-clustering"], "gaussian-mix": CLUSTERERS["gaussian-mixture-clustering"], "lda_clustering": CLUSTERERS["lda-clustering"]}


def _algorithm_operator(slug, make):
    @operator(slug)
    def algorithm(inputs, **params):
        p = dict(params)
        if inputs.get("algorithm") is not None:
            p["algorithm"] = inputs["algorithm"]
        return {"algorithm": make(**p)}


for _slug, _make in {**CLASSIFIERS, **REGRESSORS, **CLUSTERERS}.items():
    _algorithm_operator(_slug, _make)
_algorithm_operator("als-recommender", _estimator(R.ALS, {"rank": ("rank", int), "max_iter": ("maxIter", int), "reg_param": ("regParam", float), "implicitPrefs": ("implicitPrefs", flag), "user_col": ("userCol", str), "item_col": ("itemCol", str), "rating_col": ("ratingCol", str), "alpha": ("alpha", float), "seed": ("seed", int)}, {"coldStartStrategy": "drop"}))


# --- training


def fit(df, algorithm, features=None, label=None, prediction="prediction"):
    """Fit on one vector column or on number columns; text labels are indexed and predictions named back."""
    if hasattr(algorithm, "fit_rows"):  # not one of Spark's
        return algorithm.fit_rows(df, names(need(features, "features")), need(label, "label"), prediction)
    found, stages, back = names(need(features, "features")), [], []
    column = found[0]
    if len(found) > 1 or dict(df.dtypes)[found[0]] != "vector":
        column = "_features"
        stages.append(X.VectorAssembler(inputCols=found, outputCol=column, handleInvalid="skip"))
    a = algorithm.copy()
    inner = a.getClassifier() if isinstance(a, C.OneVsRest) else a
    for x in {id(x): x for x in (a, inner)}.values():
        if x.hasParam("featuresCol"):
            x.set(x.featuresCol, column)
    if label:
        y = label
        if dict(df.dtypes)[label] == "string":
            index = X.StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip").fit(df)
            stages.append(index)
            back, y = [X.IndexToString(inputCol="_prediction", outputCol=prediction, labels=index.labels)], "_label"
        for x in {id(x): x for x in (a, inner)}.values():
            if x.hasParam("labelCol"):
                x.set(x.labelCol, y)
    if a.hasParam("predictionCol"):
        a.set(a.predictionCol, "_prediction" if back else prediction)
    elif a.hasParam("topicDistributionCol"):
        a.set(a.topicDistributionCol, prediction)
    model = Pipeline(stages=[*stages, a, *back]).fit(df)
    made = model.transform(df)
    return {OUT: made.drop("_features", "_label", "_prediction"), "model": model}


@operator("classification-model", "regression-model", "clustering-model", "k-modes-clustering-model-unsupported")
def fit_model(inputs, features=None, label=None, prediction="prediction", **_):
    df = inputs.get("train input data", inputs.get(IN))
    made = fit(df, inputs["algorithm"], features, label, prediction)
    last = [s for s in getattr(made["model"], "stages", []) if hasattr(s, "clusterCenters")]
    if last:
        made["cluster centroids"] = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(last[-1].clusterCenters())], "cluster int, centroid array<double>")
    return made


OPERATORS.pop("k-modes-clustering-model-unsupported", None)


def _model_operator(slug, make):
    @operator(slug)
    def model(inputs, features=None, label=None, prediction="prediction", **params):
        return fit_model(inputs | {"algorithm": make(**params)}, features, label, prediction)


for _slug, _make in {
    "decision-tree-classifier-model": CLASSIFIERS["decision-tree-classifier"], "logistic-regression-classifier-model": CLASSIFIERS["logistic-regression"], "logistic-regression-model": CLASSIFIERS["logistic-regression"],
    "gbt-classifier-model": CLASSIFIERS["gbt-classifier"], "naive-bayes-classifier-model": CLASSIFIERS["naive-bayes-classifier"], "random-forest-classifier-model": CLASSIFIERS["random-forest-classifier"],
    "perceptron-classifier-model": CLASSIFIERS["perceptron-classifier"], "mlp-classifier-model": CLASSIFIERS["perceptron-classifier"], "one-vs-rest-classifier-model": CLASSIFIERS["one-vs-rest-classifier"], "one-vs-rest-classifier-model-": CLASSIFIERS["one-vs-rest-classifier"],
    "svm-classification-model": CLASSIFIERS["svm-classification"], "k-means-clustering-model": CLUSTERERS["k-means-clustering"], "gaussian-mixture-clustering-model": CLUSTERERS["gaussian-mixture-clustering"], "gaussian-mixture": CLUSTERERS["gaussian-mixture-clustering"],
    "lda-clustering-model": CLUSTERERS["lda-clustering"], "decision-tree-regression-model": REGRESSORS["decision-tree-regressor"], "isotonic-regression-model": REGRESSORS["isotonic-regression"], "isotonic-regressor-model": REGRESSORS["isotonic-regression"],
    "aft-survival-regression-model": REGRESSORS["aft-survival-regression"], "gbt-regressor-model": REGRESSORS["gbt-regressor"], "random-forest-regressor-model": REGRESSORS["random-forest-regressor"],
    "generalized-linear-regressor-model": REGRESSORS["generalized-linear-regressor"], "generalized-linear-regression": REGRESSORS["generalized-linear-regressor"], "linear-regression-model": REGRESSORS["linear-regression"],
    "huber-regressor-model": REGRESSORS["huber-regressor"],
}.items():
    _model_operator(_slug, _make)


@operator("recommendation-model")
def recommend(inputs, **_):
    model = inputs["algorithm"].fit(inputs[IN])
    return {OUT: model.transform(inputs[IN]), "model": model}


@operator("pic_clustering")
def power_iteration(inputs, k=2, src="src", dst="dst", weight=None, max_iter=20, **_):
    return {OUT: U.PowerIterationClustering(k=int(k), maxIter=int(max_iter), srcCol=src, dstCol=dst, weightCol=weight).assignClusters(inputs[IN])}


class NearestRows:
    """Training rows as a model: ``transform`` gives each row the most frequent label of its nearest training rows."""

    def __init__(self, df, features, label, k, metric="euclidean", prediction="prediction"):
        rows = df.select(*features, F.col(label).alias("_l")).filter(F.col("_l").isNotNull())
        self.rows, self.features, self.k, self.metric, self.prediction = numbered(rows, "_id"), features, k, metric, prediction

    def transform(self, df):
        (row,) = free_name(df, "_row")
        asked = numbered(df, row)
        points = self.rows.select(F.col("_id").alias(row), *self.features)
        near = nearest(points, self.features, self.k, row, queries=asked, metric=self.metric)
        return _voted(asked, row, near, self.rows.select(F.col("_id").alias("other"), "_l"), self.prediction, df.columns)


def _voted(rows, row, near, labels, prediction, columns):
    """The most frequent label of each row's neighbours, ties to the smaller one."""
    votes = near.join(labels, "other").groupBy("k", "_l").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("k").agg(F.min_by("_l", F.struct(-F.col("n"), "_l")).alias("_best")).withColumnRenamed("k", "_k")
    return rows.join(best, rows[row] == best["_k"], "left").select(*(rows[c] for c in columns if c != prediction), F.col("_best").alias(prediction))


@operator("knn-classifier-model", "knn-classifier")
def knn(inputs, features=None, label=None, n_neighbors=5, prediction="prediction", key=None, metric="euclidean", **_):
    """The most frequent label among the exact nearest training rows, ties to the smaller label. Rows of ``test input data`` are
    labelled if there are any, else each training row by the other ones. ``model`` labels further rows."""
    df, found, k = inputs.get(IN, inputs.get("train input data")), names(need(features, "features")), int(n_neighbors)
    model = NearestRows(df, found, need(label, "label"), k, metric, prediction)
    if inputs.get("test input data") is not None:
        return {OUT: model.transform(inputs["test input data"]), "model": model}
    (row,) = free_name(df, "_row")
    rows = df.withColumn(row, F.col(key).cast("long")) if key else numbered(df, row)
    near = nearest(rows.filter(F.col(label).isNotNull()), found, k, row, metric=metric)
    labels = rows.select(F.col(row).alias("other"), F.col(label).alias("_l"))
    return {OUT: _voted(rows, row, near, labels, prediction, df.columns), "model": model}


@operator("voting-classifier")
def voting(inputs, models=None, weights=None, prediction_attribute="prediction", key=None, **_):
    """A weighted vote of models on the same rows; ties go to the smaller prediction."""
    df, found = inputs[IN], inputs.get("models") or models
    w = [float(x) for x in weights] if weights else [1.0] * len(found)
    own = df.columns
    for i, m in enumerate(found):
        made = m.transform(df)
        df = made.select(*df.columns, F.col("prediction").cast("double").alias(f"_p{i}"))
    pairs = F.array(*(F.struct(F.col(f"_p{i}").alias("p"), F.lit(x).alias("w")) for i, x in enumerate(w)))
    score = lambda p: F.aggregate(F.filter(pairs, lambda x: x["p"] == p), F.lit(0.0), lambda a, x: a + x["w"])
    options = F.array_distinct(F.transform(pairs, lambda x: x["p"]))
    best = F.array_max(F.transform(options, lambda p: F.struct(score(p).alias("s"), (-p).alias("n"))))
    return {OUT: df.select(*own, (-best["n"]).alias(prediction_attribute))}


@operator("apply-model")
def apply_model(inputs, prediction=None, **_):
    made = inputs["model"].transform(inputs[IN])
    if prediction and prediction not in made.columns and "prediction" in made.columns:
        made = made.withColumnRenamed("prediction", prediction)
    return {OUT: made}


_METRICS = {
    "areaUnderROC": "b", "areaUnderPR": "b", "f1": "m", "accuracy": "m", "weightedPrecision": "m", "weightedRecall": "m", "logLoss": "m",
    "rmse": "r", "mse": "r", "mae": "r", "r2": "r", "mape": "mape", "silhouette": "c",
}


def evaluator(metric: str, label: str = "label", prediction: str = "prediction", raw: str = "rawPrediction"):
    kind = _METRICS.get(metric)
    if kind == "b":
        return E.BinaryClassificationEvaluator(metricName=metric, labelCol=label, rawPredictionCol=raw)
    if kind == "m":
        return E.MulticlassClassificationEvaluator(metricName=metric, labelCol=label, predictionCol=prediction)
    if kind == "r":
        return E.RegressionEvaluator(metricName=metric, labelCol=label, predictionCol=prediction)
    if kind == "c":
        return E.ClusteringEvaluator(predictionCol=prediction)
    raise ParameterError(f"unknown metric: {metric}")


def confusion_matrix(made, label: str, prediction: str):
    """How often each label got each prediction: label, prediction, n."""
    return made.groupBy(F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")).agg(F.count("*").alias("n"))


def curves(made, label: str, score: str):
    """Points of the ROC and the precision-recall curve, one a distinct score: rows of at least that score count as positive."""
    by = made.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(label).cast("double") > 0).alias("p"), F.count_if(F.col(label).cast("double") <= 0).alias("n"))
    rows = running(by, {"tp": F.col("p"), "fp": F.col("n")}, [F.desc("threshold")])
    every = F.broadcast(made.agg(F.count_if(F.col(label).cast("double") > 0).alias("_p"), F.count_if(F.col(label).cast("double") <= 0).alias("_n")))  # one row
    share = lambda a, b: F.when(b != 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    return rows.crossJoin(every).select("threshold", share(c("fp"), c("_n")).alias("fpr"), share(c("tp"), c("_p")).alias("tpr"), share(c("tp"), c("tp") + c("fp")).alias("precision"), share(c("tp"), c("_p")).alias("recall"))


def importances(model, features) -> list[tuple[str, float]]:
    """What a fitted model says of its features, strongest first: importances or coefficients."""
    for stage in reversed(getattr(model, "stages", [model])):
        for name in ("featureImportances", "coefficients"):
            if not hasattr(type(stage), name) or getattr(stage, "numClasses", 2) > 2 and name == "coefficients":
                continue  # a linear model of several classes has no single list
            found = getattr(stage, name)
            return sorted(zip(features, map(float, found.toArray()), strict=False), key=lambda x: -abs(x[1]))
    return []


@operator("evaluate-model", "evaluator")
def evaluate(inputs, metric="f1", label_attribute="label", prediction_attribute="prediction", features=None, **_):
    """The metric's value; of classes also the confusion matrix and a report by class; with metric ``curves`` the ROC and
    precision-recall points of a score; with a model and its feature names what it makes of them."""
    df, more = inputs.get(IN), {}
    if metric == "curves":
        found = curves(df, label_attribute, prediction_attribute)
        return {OUT: found, "curves": found}
    if metric == "mape":
        y, p = F.col(label_attribute), F.col(prediction_attribute)
        value = df.filter(y != 0).agg(F.avg(F.abs((y - p) / y))).first()[0]
        return {OUT: df.sparkSession.createDataFrame([(metric, value)], "metric string, value double"), "evaluator": None}
    e = evaluator(metric, label_attribute, prediction_attribute)
    if df is None:
        return {"evaluator": e}
    made = df if prediction_attribute in df.columns else inputs["model"].transform(df)
    if _METRICS[metric] in "bm":
        more = {"confusion matrix": confusion_matrix(made, label_attribute, prediction_attribute), "report": classification_report({IN: made}, label_attribute, prediction_attribute)[OUT]}
    if inputs.get("model") is not None and features:
        more["importances"] = made.sparkSession.createDataFrame(importances(inputs["model"], names(features)), "feature string, weight double")
    return {OUT: made.sparkSession.createDataFrame([(metric, float(e.evaluate(made)))], "metric string, value double"), "evaluator": e, "evaluated model": inputs.get("model"), **more}


@operator("classification-report")
def classification_report(inputs, label_attribute="label", prediction_attribute="prediction", **_):
    """Support, precision, recall and F1 by class, from the counts of (label, prediction)."""
    c = inputs[IN].groupBy(F.col(label_attribute).cast("string").alias("l"), F.col(prediction_attribute).cast("string").alias("p")).count()
    by = lambda k: c.groupBy(F.col(k).alias("class")).agg(F.sum("count").alias(f"n_{k}"))
    hit = c.filter("l = p").select(F.col("l").alias("class"), F.col("count").alias("tp"))
    j = by("l").join(by("p"), "class", "full").join(hit, "class", "left").na.fill(0)
    precision, recall = F.when(F.col("n_p") > 0, F.col("tp") / F.col("n_p")).otherwise(0.0), F.when(F.col("n_l") > 0, F.col("tp") / F.col("n_l")).otherwise(0.0)
    return {OUT: j.select("class", F.col("n_l").alias("support"), precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))}


@operator("cross-validation")
def cross_validation(inputs, features=None, label_attribute="label", folds=3, seed=0, metric="f1", param_grid=None, **_):
    df, a = inputs[IN], inputs["algorithm"].copy()
    found, stages = names(need(features, "features")), []
    if len(found) > 1 or dict(df.dtypes)[found[0]] != "vector":
        stages.append(X.VectorAssembler(inputCols=found, outputCol="_features", handleInvalid="skip"))
        found = ["_features"]
    a.set(a.featuresCol, found[0]).set(a.labelCol, label_attribute)
    grid = ParamGridBuilder()
    for p, values in (param_grid or {}).items():
        grid = grid.addGrid(a.getParam(p), values)
    e = inputs.get("evaluator") or evaluator(metric, label_attribute)
    model = CrossValidator(estimator=Pipeline(stages=[*stages, a]), estimatorParamMaps=grid.build(), evaluator=e, numFolds=int(folds), seed=int(seed)).fit(df)
    return {"score": model.avgMetrics, "best model": model.bestModel, "model": model, OUT: model.bestModel.transform(df).drop("_features"), "evaluated data": None}


@operator("save-model")
def save_model(inputs, path=None, write_mode="ERROR", **_):
    writer = inputs["models"].write()
    (writer.overwrite() if write_mode.upper() == "OVERWRITE" else writer).save(need(path, "path"))
    return {}


@operator("load-model")
def load_model(inputs, path=None, model=None, **_):
    return {"model": PipelineModel.load(need(path or model, "path"))}


@operator("topic-report")
def topic_report(inputs, terms_per_topic=10, **_):
    """The strongest terms of each topic, by name."""
    vocabulary, model = inputs["vocabulary"], inputs["model"]
    lda = model.stages[-1] if hasattr(model, "stages") else model
    found = lda.describeTopics(int(terms_per_topic))
    words = F.array(*map(F.lit, vocabulary))
    return {"topics": found.withColumn("terms", F.transform("termIndices", lambda i: words[i])), OUT: found.withColumn("terms", F.transform("termIndices", lambda i: words[i]))}
