"""Registered queries that run as streams, each with SQL over the whole log."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolex.plans.queries import query
from chronolex.storage import load, materialise
from chronolex.streaming import events, watches


def watch_log(spark, sf_dir):
    """(runs, resolutions, observed): every day of the events is a run, a user's last event is what the user resolves to.

    A run of every fifth day is partial, of every seventh failed; a last event of a low value is ambiguous.
    """
    e = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.date_trunc("day", "ts").cast("timestamp").alias("run_time"), "event_type", "value", "event_id")
    run = F.concat(F.lit("run-"), F.date_format("run_time", "yyyy-MM-dd")).alias("run")
    day = F.dayofmonth("run_time")
    runs = e.select("run_time").distinct().select(run, "run_time", F.when(day % 7 == 0, "failed").when(day % 5 == 0, "partial").otherwise("succeeded").alias("status"))
    first = e.groupBy("key", F.col("event_type").alias("revision")).agg(F.min("run_time").alias("run_time"))
    last = e.groupBy("key", "run_time").agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("x"))
    source = first.select("key", F.col("revision").alias("selected"), F.concat(F.lit("run-"), F.date_format("run_time", "yyyy-MM-dd")).alias("source_run"))
    told = last.select("key", run, "run_time", F.when(F.col("x.value") < 20, "ambiguous").otherwise("resolved").alias("status"), F.col("x.event_type").alias("selected")).join(source, ["key", "selected"])
    return runs, told.select("key", "run", "run_time", "status", "selected", "source_run"), first.select("key", run, "run_time", "revision")


def closed(rows, spark, kind: str):
    """rows and one of a far later run, which lets the watermark pass all others."""
    end = F.to_timestamp(F.lit("2999-01-01"))
    last = {"key": F.lit(""), "run": F.lit("end"), "run_time": end, "status": F.lit("succeeded" if kind == "runs" else "resolved"), "selected": F.lit("-"), "source_run": F.lit("-"), "revision": F.lit("-")}
    return materialise(rows.unionByName(spark.range(1).select(*[last[c].alias(c) for c in rows.columns])), kind)


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, date_trunc('day', ts) AS d, event_type, value, event_id FROM events),
     f AS (SELECT key, event_type AS revision, min(d) AS d FROM e GROUP BY 1, 2),
     l AS (SELECT key, d, arg_max(event_type, event_id) AS selected, arg_max(value, event_id) AS value FROM e GROUP BY 1, 2),
     r AS (SELECT *, lag(selected) OVER w AS before, lag(d) OVER w AS since FROM l WHERE value >= 20 AND day(d) % 7 <> 0 AND day(d) % 5 <> 0 WINDOW w AS (PARTITION BY key ORDER BY d)),
     x AS (SELECT r.key, 'observed-change' AS event_type, CAST(NULL AS VARCHAR) AS from_revision, f.revision AS to_revision, f.d AS source, r.d FROM r JOIN f ON f.key = r.key AND f.d > r.since AND f.d <= r.d
       UNION ALL SELECT r.key, 'effective-change', before, selected, f.d, r.d FROM r JOIN f ON f.key = r.key AND f.revision = r.selected WHERE before IS NOT NULL AND before <> selected)
SELECT key, event_type, from_revision, to_revision, 'run-' || strftime(source, '%Y-%m-%d') AS source_run, 'run-' || strftime(d, '%Y-%m-%d') AS run FROM x""")
def watch_stream(spark, sf_dir):
    """The watches' state machine over the log as a stream: timers in the order of runs, runs that failed held back."""
    log = [closed(rows, spark, kind) for rows, kind in zip(watch_log(spark, sf_dir), ("runs", "resolutions", "observed"), strict=True)]
    with watches.state_store(spark):
        made = events.drain(watches.watch_events(*[events.table_stream(t) for t in log]))
    return made.drop("run_time")
