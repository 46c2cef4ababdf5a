"""k-modes: modes of chunks of rows, then modes of those modes, then rounds over all rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.durable import stored
from tessera.operators.registry import IN, OUT, ParameterError, names, need, operator

#: Distinct rows, or modes, of a chunk.
CHUNK = 8192
SIMILARITIES = ("hamming", "frequency")


def dissimilarity(codes: np.ndarray, modes: np.ndarray, share: np.ndarray | None) -> np.ndarray:
    """(rows, modes): columns that differ; with ``share`` a column that agrees still counts 1 - the mode's share in its cluster."""
    out = np.zeros((len(codes), len(modes)))
    for k, mode in enumerate(modes):
        agree = codes == mode
        out[:, k] = codes.shape[1] - (agree.sum(axis=1) if share is None else agree @ share[k])
    return out


def modes_of(codes: np.ndarray, weight: np.ndarray, cluster: np.ndarray, k: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent value (ties: the smallest) of each column in each cluster, and its share; an empty cluster keeps its mode."""
    modes, share = before.copy(), np.ones(before.shape)
    for c in range(k):
        mine = cluster == c
        if not mine.any():
            continue
        for j in range(codes.shape[1]):
            n = np.bincount(codes[mine, j], weight[mine])
            modes[c, j] = n.argmax()
            share[c, j] = n.max() / n.sum()
    return modes, share


def local(rows: list[tuple], weight: np.ndarray, k: int, rounds: int, frequency: bool) -> tuple[list[tuple], np.ndarray]:
    """k-modes of weighted rows; each start is the row farthest from those before it (ties: the heaviest, then the first)."""
    tables = [sorted({r[j] for r in rows}) for j in range(len(rows[0]))]
    at = [{v: i for i, v in enumerate(t)} for t in tables]
    codes = np.array([[a[x] for a, x in zip(at, r, strict=True)] for r in rows])
    first = int(np.argmax(weight))
    chosen, near = [first], dissimilarity(codes, codes[[first]], None)[:, 0]
    while len(chosen) < min(k, len(rows)) and near.max() > 0:
        chosen.append(int(np.lexsort((-weight, -near))[0]))
        near = np.minimum(near, dissimilarity(codes, codes[[chosen[-1]]], None)[:, 0])
    modes, share, last = codes[chosen], None, None
    for _ in range(rounds):
        cluster = dissimilarity(codes, modes, share if frequency else None).argmin(axis=1)
        if last is not None and (cluster == last).all():
            break
        last = cluster
        modes, share = modes_of(codes, weight, cluster, len(chosen), modes)
    sizes = np.bincount(last, weight, len(chosen)) if last is not None else np.ones(len(chosen))
    return [tuple(tables[j][v] for j, v in enumerate(m)) for m in modes], sizes


@dataclass
class ModesModel:
    features: list[str]
    modes: list[tuple]
    share: list[list[float]] | None  # for the frequency similarity
    prediction: str
    costs: list[float] = field(default_factory=list)

    def distances(self) -> Column:
        def one(k: int) -> Column:
            parts = (F.when(_text(c).eqNullSafe(F.lit(v)), F.lit(1 - self.share[k][j] if self.share else 0.0)).otherwise(1.0) for j, (c, v) in enumerate(zip(self.features, self.modes[k], strict=True)))
            return sum(parts, F.lit(0.0))

        return F.array(*(one(k) for k in range(len(self.modes))))

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with the number of the mode they differ least from, ties to the first."""
        d = self.distances()
        return df.withColumn(self.prediction, (F.array_position(d, F.array_min(d)) - 1).cast("int"))


_NULL = "\x00null"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(_NULL))


def _reduced(k: int, rounds: int, frequency: bool):
    """A chunk of weighted rows (v, w) as its modes."""

    def run(table: pa.Table) -> pa.Table:
        pairs = sorted(zip(map(tuple, table["v"].to_pylist()), table["w"].to_pylist(), strict=True))
        made, sizes = local([p[0] for p in pairs], np.array([p[1] for p in pairs]), k, rounds, frequency)
        return pa.table({"v": pa.array([list(m) for m in made], pa.list_(pa.string())), "w": pa.array(sizes, pa.float64())})

    return run


def fit(df: DataFrame, found: list[str], k: int, rounds: int, local_rounds: int, similarity: str, meta: str, seed: int, prediction: str) -> ModesModel:
    rows = df.select(F.array(*(_text(c) for c in found)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("w"))
    rows = stored(rows, "distinct")
    level, frequency = rows, similarity == "frequency"
    while (n := level.count()) > CHUNK:
        parts = -(-n // CHUNK)
        chunk = F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(parts)).cast("int")
        level = level.withColumn("chunk", chunk).groupBy("chunk").applyInArrow(_reduced(k, local_rounds, frequency), "v array<string>, w double")
        level = stored(level.groupBy("v").agg(F.sum("w").alias("w")), "modes")
        frequency = meta == "frequency"
    pairs = sorted((tuple(r.v), r.w) for r in level.collect())  # at most CHUNK rows
    model = ModesModel(found, [], None, prediction)
    if not pairs:
        return model
    modes, _ = local([p[0] for p in pairs], np.array([p[1] for p in pairs]), k, local_rounds, frequency)
    model.modes = modes
    at = [F.element_at("v", j + 1) for j in range(len(found))]
    best = None
    for _ in range(rounds):
        # one pass: values by cluster and column with their weights, and what the clusters cost
        d = F.array(*(sum((F.when(a == F.lit(v), F.lit(1 - model.share[i][j] if model.share else 0.0)).otherwise(1.0) for j, (a, v) in enumerate(zip(at, m, strict=True))), F.lit(0.0)) for i, m in enumerate(model.modes)))
        near = rows.select("v", "w", d.alias("d")).select("v", "w", (F.array_position("d", F.array_min("d")) - 1).cast("int").alias("k"), F.array_min("d").alias("c"))
        counts = near.select("k", "w", "c", F.posexplode("v").alias("j", "value")).groupBy("k", "j", "value").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("c")).alias("cost"))
        best_value = F.min_by("value", F.struct(-F.col("n"), "value")).alias("value")
        told = counts.groupBy("k", "j").agg(best_value, F.max("n").alias("most"), F.sum("n").alias("all"), F.sum("cost").alias("cost")).collect()  # clusters times columns
        cost = sum(r.cost for r in told if r.j == 0)
        if best is not None and cost >= best[0]:
            break
        model.costs.append(cost)
        best = (cost, model.modes, model.share)
        modes, share = [list(m) for m in model.modes], [[1.0] * len(found) for _ in model.modes]
        for r in told:
            modes[r.k][r.j], share[r.k][r.j] = r.value, r.most / r.all
        model.modes, model.share = [tuple(m) for m in modes], share if similarity == "frequency" else None
    if best is not None:
        _, model.modes, model.share = best
    return model


@operator("k-modes-clustering-model", "k-modes")
def k_modes(inputs, features=None, attributes=None, number_of_clusters=2, max_iterations=20, max_local_iterations=10, similarity="hamming", metamodessimilarity="hamming", prediction="prediction", seed=0, fragmentation=False, **_):
    """Clusters of categorical rows: each row goes to the mode it differs least from (ties: the first).

    Distinct rows with their weights are dealt by a hash into chunks of about ``CHUNK``; each chunk's modes, weighted by their rows,
    are rows of the next level, until the modes of one level fit the driver. From its modes on, rounds over all rows assign and take
    the most frequent values again as long as the cost falls, so it never rises. With the frequency similarity a column that agrees with
    a mode still counts one minus the share that value has in the cluster. A null is a value of its own. The result depends on the rows and the
    seed, not on how they are laid out; ``fragmentation`` is taken for compatibility and changes nothing."""
    for name, value in (("similarity", similarity), ("metamodessimilarity", metamodessimilarity)):
        if value not in SIMILARITIES:
            raise ParameterError(f"{name} must be one of {SIMILARITIES}")
    df, found, k = inputs[IN], names(need(features or attributes, "features")), int(number_of_clusters)
    if k <= 0:
        raise ParameterError("number_of_clusters must be greater than 0")
    model = fit(df, found, k, int(max_iterations), int(max_local_iterations), similarity, metamodessimilarity, int(seed or 0), prediction)
    made = [(i, *(None if v == _NULL else v for v in m)) for i, m in enumerate(model.modes)]
    centres = df.sparkSession.createDataFrame(made, "cluster int, " + ", ".join(f"`{c}` string" for c in found))
    out = model.transform(df) if model.modes else df.withColumn(prediction, F.lit(None).cast("int"))
    return {OUT: out, "cluster centroids": centres, "model": model}
