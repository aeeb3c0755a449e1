"""Watched keys: what a watch does when a new run has been observed, idempotent events, observations since a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Action of each watch from two resolutions (key, status, selected).

    Anything but a resolved state blocks and writes nothing; a first resolution initialises; the same revision
    only advances the run; another one is an effective change.
    """
    b = baseline.select(key, F.col("status").alias("b_status"), F.col("selected").alias("b_selected"))
    joined = current.select(key, "status", "selected").join(b, key, "left")
    action = (
        F.when(F.col("status") != "resolved", F.concat(F.lit("blocked-"), "status"))
        .when(F.col("b_selected").isNull(), "initialized")
        .when(F.col("b_selected") == F.col("selected"), "no-change")
        .otherwise("effective-change")
    )
    return joined.select(key, action.alias("action"), F.when(action == "effective-change", F.col("b_selected")).alias("from_revision"), F.when(action.isin("effective-change", "initialized"), F.col("selected")).alias("to_revision"))


def observed_since(rows: DataFrame, time: str, run: str, after: tuple, through: tuple) -> DataFrame:
    """Rows whose (time, run) lies in (after, through], compared as a pair; the time range is also a plain filter."""
    here = F.struct(F.col(time).alias("t"), F.col(run).alias("r"))
    pair = lambda p: F.struct(F.lit(p[0]).cast(rows.schema[time].dataType).alias("t"), F.lit(p[1]).cast(rows.schema[run].dataType).alias("r"))
    within = (F.col(time) >= F.lit(after[0]).cast(rows.schema[time].dataType)) & (F.col(time) <= F.lit(through[0]).cast(rows.schema[time].dataType))
    return rows.where(within & (here > pair(after)) & (here <= pair(through)))


def new_events(existing: DataFrame, incoming: DataFrame, identity: list[str]) -> DataFrame:
    """Incoming events that aren't there yet, one for each identity; nulls in it count as empty."""
    keyed = lambda d: d.withColumn("event_key", F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]))
    return keyed(incoming).dropDuplicates(["event_key"]).join(keyed(existing).select("event_key"), "event_key", "left_anti").drop("event_key")


def acknowledge(events: DataFrame, ids: DataFrame, key: str, now: str) -> DataFrame:
    """Events with acknowledged_at set where named, keeping the first time."""
    marked = events.join(ids.select(key).distinct().withColumn("named", F.lit(True)), key, "left")
    return marked.withColumn("acknowledged_at", F.when(F.col("named"), F.coalesce("acknowledged_at", F.lit(now).cast("timestamp"))).otherwise(F.col("acknowledged_at"))).drop("named")
