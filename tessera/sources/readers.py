"""Readers by catalogue record or by URL."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.expressions import spark_type
from tessera.operators.registry import OUT, ParameterError, flag, need, operator


def schema_of(attributes: list[dict]) -> str:
    """A catalogue's attributes as a schema."""
    kind = lambda a: f"decimal({a.get('precision') or 38},{a.get('scale') or 0})" if a["type"] == "DECIMAL" and a.get("precision") else spark_type({"DOUBLE": "double", "FLOAT": "float", "LONG": "bigint"}.get(a["type"], a["type"]))
    return ", ".join(f"`{a['name']}` {kind(a)}" for a in attributes)


@operator("data-reader", "data-source", "read-data")
def data_reader(inputs, spark: SparkSession | None = None, data_source: dict | None = None, infer_schema="FROM_CATALOG", mode="PERMISSIVE", header=None, separator=None, quote=None, null_values=None, **_):
    """Read what a catalogue record {url, format, attributes, ...} describes: CSV, TEXT, PARQUET, JSON, ORC, LIB_SVM, JDBC, HIVE,
    ICEBERG. Parquet and ORC bring their own schema; text formats take the catalogue's, or infer it with FROM_VALUES."""
    spark = spark or SparkSession.getActiveSession()
    d = need(data_source, "data_source")
    kind, url = d.get("format", "PARQUET").upper(), d.get("url") or d.get("path")
    reader = spark.read
    listed = schema_of(d["attributes"]) if d.get("attributes") and infer_schema not in ("FROM_VALUES", "NO") else None
    nulls = null_values or d.get("treat_as_missing")
    if kind == "CSV":
        reader = reader.options(header=flag(d.get("is_first_line_header") if header is None else header), sep=separator or d.get("attribute_delimiter") or ",", quote=quote or d.get("text_delimiter") or '"', escape='"', mode=mode, encoding=d.get("encoding") or "UTF-8", multiLine=flag(d.get("is_multiline")))
        if nulls:
            reader = reader.option("nullValue", nulls.split(",")[0])
        df = (reader.schema(listed) if listed else reader.option("inferSchema", infer_schema == "FROM_VALUES")).csv(url)
        for extra in (nulls or "").split(",")[1:]:
            df = df.replace(extra, None)
    elif kind == "TEXT":
        df = reader.text(url)
    elif kind == "JSON":
        reader = reader.options(mode=mode, multiLine=flag(d.get("is_multiline")))
        df = (reader.schema(listed) if listed else reader).json(url)
    elif kind == "PARQUET":
        df = reader.parquet(url)
    elif kind == "ORC":
        df = reader.orc(url)
    elif kind == "LIB_SVM":
        df = reader.format("libsvm").load(url)
    elif kind in ("HIVE", "HIVE_WAREHOUSE"):
        df = spark.sql(d["command"]) if d.get("command") else spark.table(url)
    elif kind == "JDBC":
        df = reader.format("jdbc").options(url=url, **({"query": d["command"]} if d.get("command") else {"dbtable": d["table"]}), **d.get("options", {})).load()
    elif kind == "ICEBERG":
        df = reader.format("iceberg").load(url)
    else:
        raise ParameterError(f"unknown format: {kind}")
    return {OUT: df}


@operator("read-csv")
def read_csv(inputs, spark: SparkSession | None = None, url=None, header=True, separator=";", **_):
    spark = spark or SparkSession.getActiveSession()
    return {OUT: spark.read.csv(need(url, "url"), header=flag(header), sep=separator, inferSchema=True)}


@operator("external-input")
def external_input(inputs, **_):
    return {OUT: next(iter(inputs.values()), None)}


@operator("read-files", "image-reader", "video-reader", "sequence-reader", "file-reader")
def read_files(inputs, spark: SparkSession | None = None, file_or_folder=None, **_):
    """Path, time, length and content of files."""
    spark = spark or SparkSession.getActiveSession()
    return {OUT: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(need(file_or_folder, "file_or_folder"))}


# --- shapefiles


def shapes(data: bytes) -> list[list[list[float]] | None]:
    """Points of each record of a .shp file: the main file's fixed layout, big-endian record headers, little-endian shapes."""
    at, out = 100, []
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == 1:
            out.append([list(struct.unpack("<2d", body[4:20]))])
        elif kind in (3, 5):
            parts, n = struct.unpack("<2i", body[36:44])
            flat = struct.unpack(f"<{2 * n}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n])
            out.append([list(p) for p in zip(flat[::2], flat[1::2], strict=True)])
        elif kind == 8:
            n = struct.unpack("<i", body[36:40])[0]
            flat = struct.unpack(f"<{2 * n}d", body[40 : 40 + 16 * n])
            out.append([list(p) for p in zip(flat[::2], flat[1::2], strict=True)])
        else:
            out.append(None)
    return out


def records(data: bytes, encoding: str = "latin-1") -> list[dict[str, str]]:
    """Rows of a .dbf file as text."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    out = []
    for i in range(n):
        row, at = {}, head + i * size + 1
        for name, width in fields:
            row[name] = data[at : at + width].decode(encoding).strip()
            at += width
        out.append(row)
    return out


@operator("read-shapefile")
def read_shapefile(inputs, spark: SparkSession | None = None, shapefile=None, **_):
    """Each record's attributes (text) and points (array of [x, y]). Files are paired by name (.shp with .dbf) and each pair
    is parsed by the task that has it."""
    spark = spark or SparkSession.getActiveSession()
    base = need(shapefile, "shapefile").removesuffix(".shp")
    files = spark.read.format("binaryFile").load([f"{base}.shp", f"{base}.dbf"])

    def parse(table: pa.Table) -> pa.Table:
        by = {p[-4:].lower(): c for p, c in zip(table["path"].to_pylist(), table["content"].to_pylist(), strict=True)}
        points, rows = shapes(by[".shp"]), records(by[".dbf"])
        return pa.table({"attributes": pa.array([list(r.items()) for r in rows], pa.map_(pa.string(), pa.string())), "points": pa.array(points, pa.list_(pa.list_(pa.float64())))})

    from pyspark.sql import functions as F

    paired = files.withColumn("base", F.regexp_replace("path", r"\.[A-Za-z]+$", ""))
    return {OUT: paired.groupBy("base").applyInArrow(parse, "attributes map<string,string>, points array<array<double>>"), "geodata": None}


def union_of(spark: SparkSession, paths: list[str], kind: str = "parquet") -> DataFrame:
    return spark.read.format(kind).load(paths)
