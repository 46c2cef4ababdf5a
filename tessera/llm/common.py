"""Helpers shared by the operators of this subpackage: durable intermediate tables and Arrow batch plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of word splitting everywhere in this subpackage: blank, tab, LF, VT, FF, CR.
SPACES = b" \t\n\x0b\x0c\r"
#: The same set as a regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch.
BATCH_ROWS = 2048
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_root: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``).

    Only where that setting is absent in a local session a temporary folder of the driver is used; elsewhere it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_root.setdefault("root", tempfile.mkdtemp(prefix="tessera-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def released_shuffles(spark: SparkSession):
    """Within, a finished query's shuffle files are deleted at once: its result has been written, nothing rereads them."""
    before = spark.conf.get(_CLEANUP, "false")
    with contextlib.suppress(Exception):  # a Spark without this setting keeps the files until its garbage collection
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with contextlib.suppress(Exception):
            spark.conf.set(_CLEANUP, before)


def materialize(spark: SparkSession, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut lineage with a table written to the shared folder; lost executors then cost a reread, not a recomputation."""
    path = scratch(spark, name)
    with released_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same rows; Arrow batches of this session hold ``BATCH_ROWS`` rows at most from now on, as texts are long and each
    task holds a batch in the JVM and in Python."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH, "0")) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def text_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string); a null text counts as empty."""
    return bounded_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def _give_back() -> None:
    """What an earlier task of this Python worker has freed goes back to the system: workers are reused, and the C library and
    Arrow keep freed memory for themselves."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what is unpacked into Python objects stays small."""
    _give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8_bytes(column: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes without decoding."""
    return pc.cast(column, pa.binary()).to_pylist()


def record(schema: dict[str, pa.DataType], *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, schema.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(schema))


def count_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
