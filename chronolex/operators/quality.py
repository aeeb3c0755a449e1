"""Data-quality checks: each yields one row (check_name, violations), so that a clean table shows zeros."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def violates(name: str, rows: DataFrame, bad: Column) -> DataFrame:
    """Rows for which the condition holds."""
    return _row(name, rows.where(bad))


def unique(name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return _row(name, rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))


def resolves(name: str, rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in the other table."""
    return _row(name, rows.join(other.select(*keys).distinct(), keys, "left_anti"))


def contiguous(name: str, rows: DataFrame, group: list[str], order: str, first: int = 1) -> DataFrame:
    """Groups whose order numbers don't run from first without a gap."""
    g = rows.groupBy(*group).agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count("*").alias("n"), F.count_distinct(order).alias("d"))
    return _row(name, g.where((F.col("lo") != first) | (F.col("hi") - F.col("lo") + 1 != F.col("n")) | (F.col("n") != F.col("d"))))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
