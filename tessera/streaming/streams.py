"""Sources, windows and sinks for Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window


def read_stream(spark: SparkSession, source: str, path_or_topic: str | None = None, schema=None, **options) -> DataFrame:
    """files (parquet, json, csv), rate or kafka as an unbounded table."""
    reader = spark.readStream.options(**options)
    if source == "kafka":
        return reader.format("kafka").option("subscribe", path_or_topic).load()
    if source == "rate":
        return reader.format("rate").load()
    return reader.format(source).schema(schema).load(path_or_topic)


def windowed_counts(stream: DataFrame, time: str, seconds: int, keys: list[str] | None = None, slide: int | None = None, late: str | None = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums) by tumbling or sliding window; windows close when the watermark passes them; ``late``
    is None where the stream has its watermark already. Works on bounded tables too."""
    w = F.window(time, f"{seconds} seconds", *([f"{slide} seconds"] if slide else []))
    rows = stream.withWatermark(time, late) if stream.isStreaming and late else stream
    sums = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return rows.groupBy(w.alias("w"), *(keys or [])).agg(*sums).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(keys or []), "n", *(["total"] if value else []))


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], late: str | None = "10 minutes") -> DataFrame:
    """Counts by session: a session ends after a gap without events. ``late`` as for windows."""
    rows = stream.withWatermark(time, late) if stream.isStreaming and late else stream
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def distinct_events(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """One row for each key: repeats that come while the watermark allows for them are dropped, and state for older keys is given up.
    On a bounded table the earliest row of each key stays."""
    if stream.isStreaming:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    w = Window.partitionBy(*keys).orderBy(time)
    return stream.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def paths(stream: DataFrame, key: str, time: str, step: str, steps: list[str], late: str = "10 minutes") -> DataFrame:
    """How far each key came along ``steps`` in order of time: (key, reached long, since timestamp of the last step reached).

    Events of a key wait in state until the watermark has passed them, so late ones take their place in time; then they are
    walked in order, and what is left in state is two numbers a key. A row comes whenever a key got further; the last one of a key
    is its answer. On a bounded table there is one row for each key that reached a step."""
    kind = dict(stream.dtypes)[key]
    rows = stream.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(step).cast("string").alias("step"))
    if not rows.isStreaming:
        rows = rows.filter(F.col("step").isin(steps) & F.col("key").isNotNull())
        places = F.array_position(F.array(*map(F.lit, steps)), F.col("step")) - 1
        told = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("time", places.alias("at")))).alias("e"))
        start = F.struct(F.lit(0).cast("long").alias("reached"), F.lit(None).cast("timestamp").alias("since"))
        walk = F.aggregate("e", start, lambda a, x: F.when(x["at"] == a["reached"], F.struct((a["reached"] + 1).alias("reached"), x["time"].alias("since"))).otherwise(a))
        return told.select(F.col("key").alias(key), walk.alias("w")).filter("w.reached > 0").select(key, "w.reached", "w.since")
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    made = rows.withWatermark("time", late).groupBy("key").transformWithStateInPandas(statefulProcessor=_Walk(steps), outputStructType=f"key {kind}, reached long, since timestamp", outputMode="Update", timeMode="EventTime")
    return made.withColumnRenamed("key", key)


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Walk(StatefulProcessor):
    """Events that wait for the watermark, as (milliseconds, place), and how far the key has come."""

    def __init__(self, steps: list[str]):
        self.at = {s: i for i, s in enumerate(steps)}

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, place int")
        self.reached = handle.getValueState("reached", "place long, us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # other steps are left out here, not before: they too move the watermark
        new = [(t.value // 1000, self.at[s]) for df in rows for t, s in zip(df["time"], df["step"], strict=True) if s in self.at and key[0] is not None]
        for us, place in new:
            self.waiting.appendValue((us, place))
        if new:
            self.handle.registerTimer(max(us for us, _ in new) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        place, since = self.reached.get() if self.reached.exists() else (0, 0)
        before, events = place, sorted((int(e[0]), int(e[1])) for e in self.waiting.get())
        for us, at in events:
            if us <= limit and at == place:
                place, since = place + 1, us
        later = [e for e in events if e[0] > limit]
        self.waiting.clear()
        for e in later:
            self.waiting.appendValue(e)
        if place > before:
            self.reached.update((place, since))
            yield pd.DataFrame({"key": [key[0]], "reached": [place], "since": [pd.Timestamp(since, unit="us")]})

    def close(self) -> None:
        pass


def word_counts(stream: DataFrame, column: str = "value") -> DataFrame:
    """Counts of words of a stream of text."""
    return stream.select(F.explode(F.split(F.col(column).cast("string"), r"\s+")).alias("word")).filter("word <> ''").groupBy("word").count()


def to_table(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream to its end and read its whole result back from a table in a folder that all executors share: each batch of a
    complete result takes the place of the one before."""

    def put(rows: DataFrame, _number: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    df.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_stream(df: DataFrame, sink: str, path: str, checkpoint: str, mode: str = "append", trigger: str | None = None):
    """Start a query to files, kafka or memory; without a trigger interval it reads what there is and ends."""
    writer = df.writeStream.format(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.queryName(path) if sink == "memory" else writer.option("topic", path) if sink == "kafka" else writer.option("path", path)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def drain(df: DataFrame, into, checkpoint: str) -> None:
    """Run a stream to its end, giving each batch to a function of (rows, number) exactly once."""
    df.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
