"""Sinks: files, tables and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.registry import IN, OUT, ParameterError, flag, need, operator

_MODES = {"error": "errorifexists", "append": "append", "overwrite": "overwrite", "ignore": "ignore"}


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, for formats without them."""
    return df.select(*(F.array_join(F.transform(n, lambda x: x.cast("string")), ", ").alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes))


@operator("save", "data-writer")
def save(inputs, path=None, name=None, format="PARQUET", mode="error", header=True, single_file=False, options=None, **_):  # noqa: A002
    """PARQUET, CSV, JSON, ORC, TABLE or KAFKA. Files are written in parallel; ``single_file`` gathers them in one task and is
    for small results only."""
    df, kind = inputs[IN], format.upper()
    if kind == "CSV":
        df = flat(df)
    if flag(single_file):
        df = df.coalesce(1)
    if kind == "KAFKA":
        df.select(F.to_json(F.struct("*")).alias("value")).write.format("kafka").options(**(options or {})).option("topic", need(name, "name")).save()
        return {OUT: df}
    writer = df.write.mode(_MODES[mode]).options(**(options or {}))
    if kind in ("TABLE", "HIVE", "HIVE_WAREHOUSE"):
        writer.saveAsTable(need(name, "name"))
    elif kind == "CSV":
        # as the reader takes it: quotes are doubled, and blanks around a text are part of it
        given = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"} | (options or {})
        writer.options(**given).option("header", flag(header)).csv(need(path, "path"))
    elif kind in ("PARQUET", "JSON", "ORC"):
        writer.format(kind.lower()).save(need(path, "path"))
    else:
        raise ParameterError(f"unknown format: {kind}")
    return {OUT: df}


@operator("convert-data-source")
def convert(inputs, path=None, target_format="PARQUET", **params):
    """Write a source's rows in another format."""
    return save(inputs, path=path, format=target_format, mode="overwrite", **params)
