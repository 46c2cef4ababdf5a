"""k-modes against plain rounds."""

import random

import numpy as np
import pytest

from tessera.operators import modes as M
from tessera.operators.registry import ParameterError, run

IN, OUT = "input data", "output data"


def rows(seed, n=900, columns=8):
    rng = random.Random(seed)
    centres = [[rng.choice("pqrstuv") for _ in range(columns)] for _ in range(5)]
    out = []
    for _ in range(n):
        c = rng.choice(centres)
        out.append(tuple(rng.choice(["p", "q", None]) if rng.random() < 0.12 else v for v in c))
    return out


def cost_of(data, modes):
    return sum(min(sum(x != y for x, y in zip(r, m, strict=True)) for m in modes) for r in data)


def plain(data, modes):
    """Rounds from these modes until they stay."""
    while True:
        near = [min(range(len(modes)), key=lambda k: (sum(x != y for x, y in zip(r, modes[k], strict=True)), k)) for r in data]
        new = []
        for k in range(len(modes)):
            mine = [r for r, n in zip(data, near, strict=True) if n == k]
            new.append(tuple(min(sorted({r[j] for r in mine}, key=str), key=lambda v: -sum(r[j] == v for r in mine)) for j in range(len(data[0]))) if mine else modes[k])
        if cost_of(data, new) >= cost_of(data, modes):
            return modes
        modes = new


def frame(spark, data, parts=4):
    return spark.createDataFrame(data, ", ".join(f"c{j} string" for j in range(len(data[0])))).repartition(parts)


@pytest.mark.parametrize("chunk", [8192, 60])
def test_no_worse_than_plain_rounds_and_a_fixed_point(spark, monkeypatch, chunk):
    monkeypatch.setattr(M, "CHUNK", chunk)
    data = rows(1)
    made = run("k-modes", {IN: frame(spark, data)}, features=[f"c{j}" for j in range(8)], number_of_clusters=5)
    model, centres = made["model"], [tuple(r)[1:] for r in made["cluster centroids"].orderBy("cluster").collect()]
    assert model.costs == sorted(model.costs, reverse=True) and model.costs[-1] == cost_of(data, centres)
    assert cost_of(data, plain(data, centres)) == cost_of(data, centres)
    starts = [plain(data, random.Random(s).sample(sorted(set(data), key=str), 5)) for s in range(5)]
    assert cost_of(data, centres) <= np.median([cost_of(data, m) for m in starts])
    for r in made[OUT].collect():
        d = [sum(x != y for x, y in zip(tuple(r)[:8], m, strict=True)) for m in centres]
        assert r.prediction == d.index(min(d))


def test_layouts_agree_and_frequencies(spark):
    data = rows(2, 400)
    for how in ("hamming", "frequency"):
        found = [run("k-modes", {IN: frame(spark, data, n)}, features=["c0", "c1", "c2", "c3"], number_of_clusters=4, similarity=how, metamodessimilarity=how) for n in (1, 6)]
        assert found[0]["model"].modes == found[1]["model"].modes and found[0]["model"].costs == pytest.approx(found[1]["model"].costs)
        assert found[0][OUT].filter("prediction IS NULL").isEmpty()


def test_few_rows_and_wrong_parameters(spark):
    df = frame(spark, [("a", "x"), ("a", "x"), ("b", "z"), (None, "z")], 1)
    made = run("k-modes", {IN: df}, features=["c0", "c1"], number_of_clusters=9)
    assert len(made["model"].modes) == 3 and made["model"].costs[-1] == 0
    assert run("k-modes", {IN: df.limit(0)}, features=["c0"], number_of_clusters=2)[OUT].collect() == []
    with pytest.raises(ParameterError):
        run("k-modes", {IN: df}, features=["c0"], similarity="cosine")
