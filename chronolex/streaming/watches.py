"""Watches as a stream: each watched key's state machine over the log of runs, exactly once and in the order of runs.

The log has three kinds of rows, all with the run's id and start time:

- runs: (run, run_time, status), when a run is over;
- resolutions: (key, run, run_time, status, selected, source_run), what a key resolves to after a run;
- observed: (key, run, run_time, revision), a revision that the run saw first.

A resolution counts only if its run fully succeeded: a stream-stream join by run and time holds it back until the
run's end is known, and lets it go with the watermark if that never comes or wasn't a success. What a key has been
told waits in its state, and a timer at the earliest run's time evaluates it once the watermark has passed: all runs
up to the watermark, in their order, so rows that come in another order than the runs give the same events. A key is
read and written once for all runs that are due, not once for each.

A state that isn't resolved writes nothing and moves nothing. The first resolved one sets the baseline without an
event. Later ones give an observed-change for each revision seen after the baseline's run and up to this one (in
failed runs too), an effective-change if another revision is selected, and move the baseline. Rows that come after
their run has been evaluated, and repeated rows, give nothing. A restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Times within the state are microseconds; evaluated is the last millisecond up to which runs were evaluated.
EVENTS = "key string, event_type string, from_revision string, to_revision string, source_run string, run string, at long"
HELD = "at long, run string, kind string, status string, revision string, source_run string"
BASELINE = "revision string, at long, run string, evaluated long"


def step(baseline: tuple | None, run: tuple, resolution: tuple | None, observed: list[tuple]) -> tuple[tuple | None, list[tuple], list[tuple]]:
    """(baseline, events, observed rows that still wait) after one run (time, id).

    baseline: (revision, (time, id)) or None; resolution: (status, selected, source run) or None if the run wasn't a
    success; observed: ((time, id), revision) of runs up to this one.
    """
    if resolution is None or resolution[0] != "resolved" or resolution[1] is None:
        return baseline, [], observed
    selected = resolution[1]
    if baseline is None:
        return (selected, run), [], [o for o in observed if o[0] > run]
    due = sorted({o for o in observed if baseline[1] < o[0] <= run})
    events = [("observed-change", None, revision, at[1]) for at, revision in due]
    if selected != baseline[0]:
        events.append(("effective-change", baseline[0], selected, resolution[2]))
    return (selected, run), events, [o for o in observed if o[0] > run]


class WatchProcessor(StatefulProcessor):
    """Holds what a key has been told until its run's timer fires, then takes one step for each run, in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.baseline = handle.getValueState("baseline", BASELINE)
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        evaluated = self.baseline.get()[3] if self.baseline.exists() else None
        new = {(r.at, r.run, r.kind, r.status, r.revision, r.source_run) for r in rows if evaluated is None or r.at // 1000 > evaluated}
        if new:
            self.held.appendList(sorted(new, key=repr))
            self.handle.registerTimer(min(r[0] for r in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        expired = expiredTimerInfo.getExpiryTimeInMs()
        kept = self.baseline.get() if self.baseline.exists() else None
        if kept is not None and kept[3] is not None and expired <= kept[3]:  # an earlier timer has evaluated this run too
            return
        until = max(expired, timerValues.getCurrentWatermarkInMs())
        held = sorted({tuple(h) for h in self.held.get()}, key=repr)
        due = [h for h in held if h[0] // 1000 <= until]
        if not due:
            return
        baseline = (kept[0], (kept[1], kept[2])) if kept is not None and kept[0] is not None else None
        observed = [((h[0], h[1]), h[4]) for h in due if h[2] == "observed"]
        resolved = {(h[0], h[1]): (h[3], h[4], h[5]) for h in due if h[2] == "resolution"}
        for run in sorted(resolved):
            waiting = [o for o in observed if o[0] > run]
            baseline, events, left = step(baseline, run, resolved[run], [o for o in observed if o[0] <= run])
            observed = left + waiting
            for kind, before, after, source in events:
                yield Row(key=key[0], event_type=kind, from_revision=before, to_revision=after, source_run=source, run=run[1], at=run[0])
        revision, at = baseline or (None, (None, None))
        self.baseline.update((revision, at[0], at[1], until))
        later = [h for h in held if h[0] // 1000 > until]
        if later:
            self.handle.registerTimer(min(h[0] for h in later) // 1000)
        left = later + [h for h in due if h[2] == "observed" and ((h[0], h[1]), h[4]) in observed]
        if left:
            self.held.put(left)
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def watch_events(runs: DataFrame, resolutions: DataFrame, observed: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(key, event_type, from_revision, to_revision, source_run, run, run_time) of all watches, as a stream, from three streams.

    late is how far runs' rows may be out of order. The session's state store must be RocksDB's (state_store sets it).
    """
    done = runs.withWatermark("run_time", late).where("status = 'succeeded'").select(F.col("run").alias("done_run"), F.col("run_time").alias("done_time"))
    told = resolutions.withWatermark("run_time", late)
    sound = told.join(done, (F.col("run") == F.col("done_run")) & (F.col("run_time") == F.col("done_time")))
    null = F.lit(None).cast("string")
    columns = ["key", "run_time", F.unix_micros("run_time").alias("at"), "run"]
    sound = sound.select(*columns, F.lit("resolution").alias("kind"), "status", F.col("selected").alias("revision"), "source_run")
    seen = observed.withWatermark("run_time", late).select(*columns, F.lit("observed").alias("kind"), null.alias("status"), "revision", null.alias("source_run"))
    events = sound.unionByName(seen).groupBy("key").transformWithState(WatchProcessor(), EVENTS, "append", "EventTime")
    return events.withColumn("run_time", F.timestamp_micros("at")).drop("at")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session's state store is RocksDB's inside, and what it was again afterwards."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(setting, before)
