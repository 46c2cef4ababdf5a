"""Tables written to the folder that all executors share, and positions and running sums over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``; a local session without that setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own.setdefault("root", tempfile.mkdtemp(prefix="tessera-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table of their own: each value, and which row is in which partition, is settled once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that the table does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def _with_bases(rows: DataFrame, part: str, sums: dict[str, Column]) -> DataFrame:
    """What all partitions before a row's own add up to, one column a sum; the driver holds one row a partition."""
    names, sizes = list(sums), rows.groupBy(part).agg(*(c.alias(n) for n, c in sums.items()))
    kinds = dict(sizes.dtypes)
    table, at = [], [0.0 if kinds[n] in ("double", "float") else 0 for n in names]
    for p, *values in sorted((tuple(r) for r in sizes.collect()), key=lambda r: r[0]):
        table.append((p, *at))
        at = [a + (v or 0) for a, v in zip(at, values, strict=True)]
    bases = rows.sparkSession.createDataFrame(table, ", ".join(f"`{n}` {kinds[n]}" for n in (part, *names)))
    return rows.join(F.broadcast(bases), part)


def numbered(df: DataFrame, name: str, order: list[Column] | None = None) -> DataFrame:
    """Rows with their position from 0 on, in this order or as Spark reads them, without one task for all rows.

    The ordered rows are written once with their place in their partition; partitions follow one another by their sizes.
    """
    part, place, base = free_name(df, "_part", "_place", "_base")
    rows = df.orderBy(*order) if order else df
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(rows.withColumns({part: F.spark_partition_id(), place: inside}), "numbered")
    made = _with_bases(rows, part, {base: F.count(F.lit(1))})
    return made.withColumn(name, F.col(base) + F.col(place)).drop(part, place, base)


def running(df: DataFrame, values: dict[str, Column], order: list[Column]) -> DataFrame:
    """Running sums (name to value) in an order, without one task for all rows: range partitions are written, their sums added
    up on the driver, and each partition then runs on its own."""
    part, *taken = free_name(df, "_part", *(f"_v{i}" for i in range(len(values))), *(f"_b{i}" for i in range(len(values))))
    of, bases = taken[: len(values)], taken[len(values) :]
    rows = df.withColumns(dict(zip(of, values.values(), strict=True))).repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    rows = _with_bases(stored(rows, "ranges"), part, {b: F.sum(v) for b, v in zip(bases, of, strict=True)})
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({n: F.col(b) + F.sum(v).over(w) for n, b, v in zip(values, bases, of, strict=True)}).drop(part, *of, *bases)
