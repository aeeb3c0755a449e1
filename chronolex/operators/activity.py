"""Application state as aggregates over an activity log: recent items, favourites, histories, materials by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.storage import materialise


def recent(log: DataFrame, keys: list[str], time: str, row_id: str) -> DataFrame:
    """Count, first and last time and the last row's id of each key."""
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.max_by(row_id, F.struct(time, row_id)).alias("last_id"))


def favourites(log: DataFrame, owner: str, item: str, action: str, order: list[str]) -> DataFrame:
    """Items whose last action of the owner is add: replaying the log makes adding and removing idempotent."""
    last = log.groupBy(owner, item).agg(F.max_by(action, F.struct(*order)).alias("last"))
    return last.where("last = 'add'").select(owner, item)


def related_materials(rows: DataFrame, group: str, state: str) -> DataFrame:
    """Number of materials by state in each group, and whether any is ready to cite."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(F.col(state) == s).alias(s) for s in ("confirmed", "rejected", "conflicted", "candidate")], F.bool_or(F.col(state) == "confirmed").alias("citation_ready"))


def places(rows: DataFrame, group: str, order: list[Column | str], name: str = "place") -> DataFrame:
    """rows with each one's place in its group, from 1: what row_number gives, without a group in one task.

    Ranges of (group, order) are numbered by themselves, after the sizes of the group's ranges before them.
    """
    dealt = rows.repartitionByRange(F.asc_nulls_first(group), *order).withColumn("range_", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    sizes = dealt.groupBy(F.col(group).alias("group_"), F.col("range_").alias("at_")).agg(F.count("*").alias("size_"))
    before = Window.partitionBy("group_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before_", F.coalesce(F.sum("size_").over(before), F.lit(0))).drop("size_")
    inside = dealt.withColumn("rank_", F.row_number().over(Window.partitionBy(group, "range_").orderBy(*order)))
    placed = inside.join(sizes, (F.col("range_") == F.col("at_")) & F.col(group).eqNullSafe(F.col("group_")))
    return placed.withColumn(name, F.col("before_") + F.col("rank_")).drop("range_", "rank_", "group_", "at_", "before_")


def latency_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """min, median, nearest-rank p95 (half to even), max, mean and number of values of each group.

    Equal values are counted first; ranges of (group, value) are ranked by themselves after the totals of the
    ranges before them, so no task holds a group.
    """
    stats = rows.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.round(F.avg(value), 6).alias("mean"), F.count(value).alias("n"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    counts = materialise(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "counts")
    # one row for each group and range
    parts = counts.groupBy("g", "part").agg(F.sum("c").alias("size"))
    ends = parts.withColumn("end", F.sum("size").over(Window.partitionBy("g").orderBy("part")))
    n = F.col("n")
    places = F.array(*[F.struct(F.lit(k).alias("what"), p.cast("long").alias("place")) for k, p in (("low", F.floor((n + 1) / 2)), ("high", F.floor(n / 2) + 1), ("p95", F.bround((n - 1) * 0.95, 0) + 1))])
    wanted = stats.select(F.col(group).alias("of"), F.explode(places).alias("w")).select("of", "w.what", "w.place")
    holds = ends.join(wanted, F.col("g").eqNullSafe(F.col("of"))).where("place > end - size and place <= end").select("of", "what", F.col("part").alias("at"), (F.col("place") - F.col("end") + F.col("size")).alias("place"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "part").orderBy("v")))
    inside = upto.join(holds, F.col("g").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))).where("upto >= place")
    found = inside.groupBy("of").agg(*[F.min(F.when(F.col("what") == k, F.col("v"))).alias(k) for k in ("low", "high", "p95")])
    return stats.join(found, F.col(group).eqNullSafe(F.col("of")), "left").select(group, "lo", ((F.col("low") + F.col("high")) / 2).alias("median"), "hi", "mean", "p95", "n")
