"""Structured Streaming over event logs: windowed counts with a watermark, de-duplication, watch updates by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.storage import shared_dir


def event_stream(table: DataFrame, time: str) -> DataFrame:
    """A stream of a Parquet table's files; time as a timestamp, which watermarks need."""
    folder, _, name = table.inputFiles()[0].rpartition("/")
    glob = "*.parquet" if folder.endswith(".parquet") else name
    rows = table.sparkSession.readStream.schema(table.schema).option("pathGlobFilter", glob).parquet(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def table_stream(table: DataFrame) -> DataFrame:
    """A stream of all files of a table's folder, those that are written later included."""
    return table.sparkSession.readStream.schema(table.schema).parquet(table.inputFiles()[0].rpartition("/")[0])


def daily_counts(events: DataFrame, time: str, kind: str, late: str = "1 day") -> DataFrame:
    """Events a day and kind; a day closes once the watermark has passed it."""
    windows = events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), kind)
    return windows.agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), kind, "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """One event for each key within the watermark: late repeats of an observation are no-ops."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a key: runs of events no further apart than gap."""
    w = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return w.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is available now and returns its result as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/chronolex/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    each_batch(stream, keep, f"{base}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def each_batch(stream: DataFrame, use: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """Hands every micro-batch to use; replays after a failure hand over the same batch and number again."""
    stream.writeStream.foreachBatch(use).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
