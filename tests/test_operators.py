"""Operators on small tables with known results."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions.expressions import Compiler, ExpressionError, binary, call, ident, valid_cnpj, valid_cpf
from tessera.operators.registry import OPERATORS, ParameterError, run
from tessera.plans.workflow import Workflow, WorkflowError, run_workflow


def one(spark, tree, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(Compiler().column(tree).alias("v")).first().v


@pytest.mark.parametrize(
    ("tree", "row", "want"),
    [
        (call("when", binary(">", ident("x"), 1), "big", "small"), {"x": 2}, "big"),
        (call("strip_accents", ident("x")), {"x": "Éàñü ça"}, "Eanu ca"),
        (call("set_of_strings", call("split", ident("x"), ",")), {"x": "b,a,,b"}, ["b", "a"]),
        (call("center", ident("x"), 5, "*"), {"x": "a"}, "**a**"),
        (call("swapcase", ident("x")), {"x": "aBc"}, "AbC"),
        (call("logaddexp", ident("x"), ident("x")), {"x": 1.0}, 1 + math.log(2)),
        (call("between", ident("x"), 1, 3), {"x": 2}, True),
        (call("to_date", ident("x"), "dd/MM/yyyy"), {"x": "nonsense"}, None),
        (call("cast", ident("x"), "integer"), {"x": "12a"}, None),
        (call("count", ident("x"), "a.b"), {"x": "a.b aXb a.b"}, 2),
        ({"type": "ConditionalExpression", "test": binary("==", ident("x"), 1), "consequent": {"type": "Literal", "value": 5}, "alternate": {"type": "Literal", "value": 6}}, {"x": 1}, 5),
    ],
)
def test_expressions(spark, tree, row, want):
    got = one(spark, tree, **row)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_unknown_function_is_an_error(spark):
    with pytest.raises(ExpressionError):
        Compiler().column(call("no_such_function"))


def test_public_check_digits(spark):
    df = spark.createDataFrame([("529.982.247-25", "11.222.333/0001-81"), ("529.982.247-24", "11.222.333/0001-80"), ("11111111111", None)], "a string, b string")
    rows = df.select(valid_cpf(F.col("a")).alias("a"), valid_cnpj(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, False), (False, False)]


def test_cast_modes(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    moved = run("cast", {"input data": df}, cast_attributes=[{"attribute": "v", "type": "Integer"}], errors="move")["output data"].collect()
    assert [tuple(r) for r in moved] == [(1, None), (None, "x"), (None, None)]


def test_required_parameters(spark):
    with pytest.raises(ParameterError):
        run("projection", {"input data": spark.range(1)})
    with pytest.raises(ParameterError):
        run("no-such-operator")
    with pytest.raises(ParameterError):
        run("user-filter", {"input data": spark.range(1)}, filters=[{"name": "id", "op": "eq", "multiplicity": "ONE"}])


def test_stop_words_and_stems(spark):
    df = spark.createDataFrame([(["the", "running", "dogs"],)], "w array<string>")
    kept = run("remove-stop-words", {"input data": df}, attributes="w", alias="k")["output data"]
    assert run("stemming", {"input data": kept}, attributes="k", alias="s")["output data"].first().s == ["run", "dog"]


def test_porter_examples():
    from tessera.operators.text import stem

    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "goodness": "good", "revival": "reviv", "adoption": "adopt", "probate": "probat", "controll": "control"}
    assert {w: stem(w) for w in known} == known


def test_point_in_polygon(spark):
    shapes = spark.createDataFrame([("square", [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]), ("far", [[5.0, 5.0], [6.0, 5.0], [6.0, 6.0]])], "name string, points array<array<double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, 5.2, 5.9)], "id long, latitude double, longitude double")
    got = run("within", {"input data": points, "geo data": shapes}, polygon_attributes=["name"])["output data"].orderBy("id").collect()
    assert [r.name for r in got] == ["square", None, "far"]


def test_utm_of_a_known_place(spark):
    df = spark.createDataFrame([(48.8582, 2.2945)], "lat double, lon double")
    r = run("cartographic-projection", {"input data": df}, dst_projection=32631)["output data"].first()
    assert r.x == pytest.approx(448251.8, abs=1) and r.y == pytest.approx(5411932.7, abs=2)


def test_dbscan_and_lof(spark):
    rows = [(i, float(i % 4), float(i // 4)) for i in range(16)] + [(100, 50.0, 50.0)] + [(200 + i, 100.0 + i % 3, float(i // 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: r.prediction for r in run("dbscan-clustering", {"input data": df}, features=["x", "y"], eps=1.1, min_samples=3, key="id")["output data"].collect()}
    assert got[100] == -1 and {got[i] for i in range(16)} == {0} and {got[200 + i] for i in range(9)} == {1}
    lof = {r.id: r.lof for r in run("outlier-detection", {"input data": df}, features=["x", "y"], min_points=3, key="id")["output data"].collect()}
    assert max(lof, key=lof.get) == 100


def test_cox_matches_a_known_model(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    t = rng.exponential(1 / np.exp(0.8 * x))
    df = spark.createDataFrame([(float(a), float(b), 1) for a, b in zip(x, t, strict=True)], "x double, t double, e int")
    r = run("cox-proportional-hazards", {"input data": df}, attributes=["x"], time_attribute="t", y_attribute="e")["output data"].first()
    assert r.coefficient == pytest.approx(0.8, abs=0.15)


def test_fairness(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("a", 0, 0), ("b", 1, 0), ("b", 0, 0), ("b", 1, 1)], "g string, y int, s int")
    got = {r.group: r for r in run("fairness-evaluator", {"input data": df}, attributes="g", label="y", score="s", baseline="a")["output data"].collect()}
    assert (got["a"].tp, got["a"].fp, got["b"].fn) == (1, 1, 1) and got["a"].fpr_disparity == 1 and got["b"].fpr_disparity == 0


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "a.shp").write_bytes(bytes(100) + struct.pack(">2i", 1, len(body) // 2) + body)
    head = struct.pack("<4BIHH20x", 3, 0, 0, 0, 1, 32 + 32 + 1, 1 + 5) + b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5]) + bytes(15) + b"\r"
    (tmp_path / "a.dbf").write_bytes(head + b" " + b"park ")
    r = run("read-shapefile", {}, spark=spark, shapefile=str(tmp_path / "a.shp"))["output data"].first()
    assert r.attributes == {"NAME": "park"} and [tuple(p) for p in r.points] == ring


def test_read_and_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2])], "i int, s string, l array<int>")
    run("save", {"input data": df}, path=str(tmp_path / "c"), format="CSV")
    source = {"url": str(tmp_path / "c"), "format": "CSV", "is_first_line_header": True, "attributes": [{"name": "i", "type": "INTEGER"}, {"name": "s", "type": "CHARACTER"}, {"name": "l", "type": "CHARACTER"}]}
    assert tuple(run("data-reader", {}, spark=spark, data_source=source)["output data"].first()) == (1, "a", "1, 2")


def test_workflow_graph(spark):
    spec = {"tasks": [{"id": 1, "operation": {"slug": "external-input"}}, {"id": 2, "operation": {"slug": "sort"}, "forms": {"attributes": {"value": [{"attribute": "id", "f": "desc"}]}}}], "flows": [{"source_id": 1, "target_id": 2}]}
    out = run_workflow(spark, spec, sources={"1": spark.range(3)})
    assert [r.id for r in out["2"]["output data"].collect()] == [2, 1, 0]
    spec["flows"].append({"source_id": 2, "target_id": 1})
    with pytest.raises(WorkflowError):
        Workflow.parse(spec).order()


def test_models(spark, tmp_path):
    rows = [(float(i), float(i % 7), "yes" if i > 50 else "no") for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    made = run("decision-tree-classifier-model", {"input data": df}, features=["a", "b"], label="y")
    assert made["output data"].filter("y = prediction").count() == 100
    run("save-model", {"models": made["model"]}, path=str(tmp_path / "m"))
    again = run("load-model", {}, path=str(tmp_path / "m"))["model"]
    assert again.transform(df).filter("y = prediction").count() == 100
    knn = run("knn-classifier-model", {"input data": df.withColumn("k", F.col("a").cast("long"))}, features=["a"], label="y", key="k", n_neighbors=3)["output data"]
    assert knn.filter("y = prediction").count() >= 98
    modes = run("k-modes", {"input data": spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "z"), ("b", "z")], "p string, q string")}, features=["p", "q"], number_of_clusters=2)["output data"].collect()
    assert modes[0].prediction == modes[1].prediction != modes[2].prediction == modes[3].prediction


def test_model_search(spark):
    from pyspark.ml.classification import LogisticRegression

    from tessera.plans.automl import search

    df = spark.createDataFrame([(float(i), "u" if i % 2 else "v", "yes" if i > 50 else "no") for i in range(100)], "a double, c string, y string")
    found = search(df, [{"name": "a", "scaler": "standard", "missing": "mean"}, {"name": "c", "type": "categorical", "transform": "one_hot_encoder"}], {"name": "y", "type": "categorical"}, [("lr", LogisticRegression(maxIter=5), {"regParam": [0.0, 10.0]})], "accuracy")
    assert len(found) == 2 and found[0]["metric"] >= found[1]["metric"]


def test_stream_of_files(spark, tmp_path):
    from tessera.streaming.streams import drain, read_stream, word_counts

    spark.createDataFrame([("a b a",), ("b",)], "value string").write.text(str(tmp_path / "in"))
    seen = []
    stream = read_stream(spark, "text", str(tmp_path / "in"), "value string")
    drain(stream, lambda rows, n: seen.extend(r.asDict() for r in word_counts(rows).collect()), str(tmp_path / "cp"))
    assert sorted((r["word"], r["count"]) for r in seen) == [("a", 2), ("b", 2)]


def test_the_catalogue_is_large():
    from tessera.operators import registry

    registry._load()
    assert len(OPERATORS) > 240


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_positions_hold_for_tables_of_unlike_width(spark, adaptive):
    """Every row finds its partner, with and without adaptive execution."""
    from pyspark.sql import functions as F

    n = 200_000
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("filler")).repartition(13)
        narrow = spark.range(n).select(((F.col("id") * 104729) % n).alias("k")).repartition(3)
        made = run("add-columns", {"input data 1": wide, "input data 2": narrow}, order_by=[["k"], ["k"]])["output data"]
        assert made.agg(F.count("*"), F.count_if(F.col("ds0_k") != F.col("ds1_k")), F.count_distinct("ds0_k")).first()[:] == (n, 0, n)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_histogram_and_range_with_nan(spark):
    df = spark.createDataFrame([(float(x),) for x in range(10)] + [(float("nan"),), (float("inf"),), (None,)], "x double")
    got = run("histogram", {"input data": df}, attributes=["x"], bins=3)["output data"].orderBy("bin").collect()
    assert [r["count"] for r in got] == [3, 3, 4] and [r.start for r in got] == [0.0, 3.0, 6.0]
    clipped = [r.x for r in run("force-range", {"input data": df}, attributes=["x"], start=2, end=5)["output data"].collect()]
    assert clipped[:3] == [2.0, 2.0, 2.0] and clipped[9] == 5.0 and clipped[10] != clipped[10] and clipped[11] == 5.0 and clipped[12] is None


def test_sample_shares(spark):
    df = spark.range(1000)
    assert run("sample", {"input data": df}, type="percent", fraction=1)["output data"].count() == 1000
    assert 300 < run("sample", {"input data": df}, type="percent", fraction=50, scale=100)["output data"].count() < 700
    with pytest.raises(ParameterError):
        run("sample", {"input data": df}, type="percent", fraction=1.5)
    assert run("sample", {"input data": df}, type="value", value=40)["output data"].count() == 40
    assert run("sample", {"input data": df}, type="value", value=5000)["output data"].count() == 1000


def test_running_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    from tessera.operators.durable import numbered, running

    df = spark.range(5000).select(((F.col("id") * 37) % 5000).alias("_v0"), F.lit(1).alias("_part")).repartition(9)
    got = running(df, {"s": F.col("_v0")}, [F.asc("_v0")]).orderBy("_v0").collect()
    total = 0
    for r in got:
        total += r["_v0"]
        assert r.s == total
    assert [r["_v0"] for r in numbered(df, "at", [F.desc("_v0")]).orderBy("at").collect()] == list(range(4999, -1, -1))
    assert numbered(df.filter("false"), "at", [F.col("_v0")]).count() == 0


def test_perceptron_regression(spark):
    import numpy as np

    from tessera.operators.neural import Perceptron

    rng = np.random.default_rng(0)
    net = Perceptron([(rng.normal(size=(2, 3)), rng.normal(size=3)), (rng.normal(size=(3, 1)), rng.normal(size=1))], "tanh", np.zeros(2), np.ones(2), 0.0, 1.0)
    x, y = rng.normal(size=(5, 2)), rng.normal(size=5)
    g = net.gradient(x, y)
    flat = np.concatenate([np.concatenate((b, w.ravel())) for w, b in net.layers])
    for i in range(len(flat)):  # slopes by differences
        sides = []
        for h in (1e-6, -1e-6):
            v, at, layers = flat.copy(), 0, []
            v[i] += h
            for w, b in net.layers:
                layers.append((v[at + len(b) : at + len(b) + w.size].reshape(w.shape), v[at : at + len(b)]))
                at += len(b) + w.size
            sides.append(Perceptron(layers, "tanh", net.centre, net.spread, 0.0, 1.0).gradient(x, y)[-2])
        assert math.isclose(g[i], (sides[0] - sides[1]) / 2e-6, rel_tol=1e-4, abs_tol=1e-6)
    rows = [(float(a), float(b), float(abs(a) + 2 * b)) for a, b in rng.uniform(-2, 2, (300, 2))] + [(None, 1.0, 1.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    made = run("mlp-regressor-model", {"input data": df}, features=["a", "b"], label="y", layer_sizes="8", max_iter=80, learning_rate_init=0.05)["output data"].collect()
    assert len(made) == 302 and all((r.prediction is None) == (r.a is None) for r in made)
    known = [r for r in made if r.a is not None and r.y is not None]
    mean = sum(r.y for r in known) / len(known)
    assert sum((r.prediction - r.y) ** 2 for r in known) < 0.05 * sum((r.y - mean) ** 2 for r in known)
