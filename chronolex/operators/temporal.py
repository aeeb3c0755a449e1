"""Validity intervals of revisions, and strict resolution of the revision valid on a date.

Input columns: key, revision_id, valid_from (date), quality. Ambiguity is reported, never collapsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIRMED = ("confirmed-api", "confirmed-revision-id")


def derive_temporal(suffix: Column, id_date: Column, api_date: Column) -> Column:
    """Struct of kind, valid_from, quality and issue of one revision, from the dates in its id and its record."""
    baseline = suffix.rlike("^0+$")
    conflict = api_date.isNotNull() & (api_date != id_date)
    return F.struct(
        F.when(baseline, "unknown").otherwise("amendment").alias("kind"),
        F.when(baseline | ~conflict, id_date).alias("valid_from"),
        F.when(baseline | conflict, "ambiguous").when(api_date.isNull(), "confirmed-revision-id").otherwise("confirmed-api").alias("quality"),
        F.when(~baseline & conflict, "EFFECTIVE_DATE_CONFLICT").alias("issue"),
    )


def derive_intervals(revisions: DataFrame, key: str, revision: str, valid_from: str, quality: str) -> DataFrame:
    """Adds sequence, valid_to_exclusive and interval_quality.

    The end is the next strictly later date of the key, shared by revisions of one day, which are ambiguous. One
    shuffle by key serves all windows.
    """
    w = Window.partitionBy(key)
    ordered = w.orderBy(F.asc_nulls_last(valid_from), revision)
    # days after the epoch as order, so that the frame can start strictly later
    later = w.orderBy(F.unix_date(valid_from)).rangeBetween(1, Window.unboundedFollowing)
    same = F.count("*").over(Window.partitionBy(key, valid_from))
    return (
        revisions.withColumn("sequence", F.row_number().over(ordered).cast("long"))
        .withColumn("valid_to_exclusive", F.when(F.col(valid_from).isNotNull(), F.min(valid_from).over(later)))
        .withColumn("interval_quality", F.when(F.col(valid_from).isNotNull() & (same > 1), "ambiguous").otherwise(F.col(quality)))
    )


def same_day_groups(revisions: DataFrame, key: str, revision: str, valid_from: str) -> DataFrame:
    """Keys and dates with several revisions, their ids in order."""
    grouped = revisions.where(F.col(valid_from).isNotNull()).groupBy(key, valid_from).agg(F.sort_array(F.collect_list(F.col(revision).cast("string"))).alias("ids"))
    return grouped.where(F.size("ids") > 1).select(key, valid_from, F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))


def as_of_candidates(intervals: DataFrame, probes: DataFrame, key: str, valid_from: str, date: str) -> DataFrame:
    """Every revision whose half-open interval holds the probe's date: an equi-join with a range filter."""
    holds = (F.col(valid_from) <= F.col(date)) & (F.col("valid_to_exclusive").isNull() | (F.col(date) < F.col("valid_to_exclusive")))
    return probes.join(intervals, key).where(holds)


def resolve_as_of(intervals: DataFrame, contents: DataFrame, probes: DataFrame, key: str, revision: str, valid_from: str, date: str) -> DataFrame:
    """One row for each probe: status not-found, ambiguous, unresolved or resolved, and the content's state.

    contents: (revision, n_contents). A revision is selected only if it is the single candidate and its quality is
    confirmed; missing content never falls back to another revision.
    """
    found = as_of_candidates(intervals, probes, key, valid_from, date).join(contents, revision, "left")
    n = F.count(revision)
    single = F.max_by(F.struct(F.col(revision).alias("id"), F.col("interval_quality").alias("quality"), F.coalesce("n_contents", F.lit(0)).alias("n")), revision)
    grouped = found.groupBy(key, date).agg(n.alias("n_candidates"), single.alias("one"))
    all_probes = probes.select(key, date).distinct().join(grouped, [key, date], "left")
    count = F.coalesce("n_candidates", F.lit(0))
    status = F.when(count == 0, "not-found").when(count > 1, "ambiguous").when(~F.col("one.quality").isin(*CONFIRMED), "unresolved").otherwise("resolved")
    state = F.when(count == 0, "none").when(status != "resolved", "candidate-dependent").when(F.col("one.n") == 0, "missing").when(F.col("one.n") == 1, "available").otherwise("multiple")
    return all_probes.select(key, date, count.cast("long").alias("n_candidates"), status.alias("status"), F.when(status == "resolved", F.col("one.id")).alias("selected"), state.alias("content_status"))


def history(intervals: DataFrame, resolution: DataFrame, key: str, revision: str, valid_from: str, date: str) -> DataFrame:
    """Every revision of the probed keys with flags: selected, or candidate, on the probe's date."""
    joined = intervals.join(resolution.select(key, date, "status", "selected"), key)
    candidate = F.coalesce((F.col(valid_from) <= F.col(date)) & (F.col("valid_to_exclusive").isNull() | (F.col(date) < F.col("valid_to_exclusive"))), F.lit(False))
    return joined.select(key, date, revision, valid_from, "sequence", candidate.alias("candidate_for_as_of"), F.coalesce(F.col("selected") == F.col(revision), F.lit(False)).alias("selected_for_as_of"))
