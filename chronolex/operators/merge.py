"""Keyed merges over immutable tables: upsert, insert-if-absent, issue merge, latest row, long-form assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], run: str) -> DataFrame:
    """Rows of old updated or extended by new; first_run is kept, last_run is that of the latest sight."""
    values = [c for c in old.columns if c not in keys and c != run]
    o = old.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.lit(True).alias("o"), *[F.col(c).alias(f"o_{c}") for c in [*values, run]])
    n = new.select(*keys, F.lit(True).alias("n"), *values, run)
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"o_{k}"))
        same = one if same is None else same & one
    joined = n.join(o, same, "full_outer")
    pick = lambda c: F.when(F.col("n"), F.col(c)).otherwise(F.col(f"o_{c}")).alias(c)
    return joined.select(*[pick(k) for k in keys], *[pick(c) for c in values], F.coalesce(f"o_{run}", run).alias("first_run"), F.coalesce(run, f"o_{run}").alias("last_run"))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key isn't there yet, one for each key."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def drift(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that were seen with different values."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.count("*").alias("n_rows")).where("n_values > 1")


def open_issue_merge(issues: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Open issues by null-safe key: those seen again are counted up, new ones are opened, resolved ones untouched."""
    counts = seen.groupBy(*keys).agg(F.count("*").alias("n_seen"))
    still = issues.where("resolved_at is null").select(*[F.col(k).alias(f"i_{k}") for k in keys], "issue_id")
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"i_{k}"))
        same = one if same is None else same & one
    return counts.join(still, same, "left").select(*keys, "n_seen", F.when(F.col("issue_id").isNull(), "opened").otherwise("seen-again").alias("action"), "issue_id")


def latest_per_key(rows: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The last row of each key by the order's struct, in one aggregate without a sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last")).select(key, *[F.col(f"last.{c}").alias(c) for c in columns])


def field_assertions(rows: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """One row for each entity and field: (entity_id, field, value)."""
    wide = rows.select(F.col(entity).cast("string").alias("entity_id"), *[F.col(f).cast("string").alias(f) for f in fields])
    return wide.unpivot("entity_id", fields, "field", "value")
