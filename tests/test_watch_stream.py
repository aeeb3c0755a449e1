"""The watches' state machine: the step by brute force, the stream against it with restarts, repeats and disorder."""

import datetime as dt
import random
from types import SimpleNamespace

from pyspark.sql import Row

from chronolex.streaming import watches

RUNS = "run string, run_time timestamp, status string"
TOLD = "key string, run string, run_time timestamp, status string, selected string, source_run string"
SEEN = "key string, run string, run_time timestamp, revision string"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def log(seed):
    rng = random.Random(seed)
    runs = [(f"r{i}", day(i), rng.choice(["succeeded", "succeeded", "partial", "failed"])) for i in range(24)]
    told, seen = [], []
    for k in "abcdef":
        known = {}
        for run, at, _ in runs:
            if rng.random() < 0.8:
                revision = rng.choice("ABCD")
                if revision not in known:
                    known[revision] = run
                    seen.append((k, run, at, revision))
                told.append((k, run, at, rng.choice(["resolved", "resolved", "ambiguous", "unresolved", "not-found"]), revision, known[revision]))
    return runs, told, seen


def brute(runs, told, seen):
    """Events by key, from the log in the order of runs."""
    ok = {r[0] for r in runs if r[2] == "succeeded"}
    out = []
    for k in {t[0] for t in told}:
        base = None
        for _, run, at, status, selected, source in sorted((t for t in told if t[0] == k), key=lambda t: t[2]):
            if run not in ok or status != "resolved":
                continue
            if base is not None:
                out += [(k, "observed-change", None, rev, r, run) for kk, r, t, rev in seen if kk == k and base[1] < t <= at]
                if base[0] != selected:
                    out.append((k, "effective-change", base[0], selected, source, run))
            base = (selected, at)
    return sorted(out, key=repr)


def test_blocked_states_and_failed_runs_write_nothing():
    base = ("A", (1, "r1"))
    waiting = [((2, "r2"), "B")]
    for resolution in (None, ("ambiguous", "B", "r2"), ("not-found", None, None), ("resolved", None, None)):
        assert watches.step(base, (2, "r2"), resolution, waiting) == (base, [], waiting)
        assert watches.step(None, (2, "r2"), resolution, waiting) == (None, [], waiting)


def test_initial_change_and_no_change():
    assert watches.step(None, (2, "r2"), ("resolved", "A", "r1"), [((1, "r1"), "A"), ((2, "r2"), "B")]) == (("A", (2, "r2")), [], [])
    base = ("A", (2, "r2"))
    assert watches.step(base, (3, "r3"), ("resolved", "A", "r1"), []) == (("A", (3, "r3")), [], [])
    seen = [((2, "r2"), "X"), ((3, "r3"), "B"), ((3, "r3"), "B")]
    assert watches.step(base, (3, "r3"), ("resolved", "B", "r3"), seen) == (("B", (3, "r3")), [("observed-change", None, "B", "r3"), ("effective-change", "A", "B", "r3")], [])


def test_stream_with_restarts_repeats_and_disorder(spark, tmp_path):
    """Batches of a log whose rows come in any order, some twice; every batch is a new start from the checkpoint."""
    runs, told, seen = log(7)
    far = day(9000)
    rng = random.Random(1)
    rows = [("runs", r) for r in runs] + [("told", t) for t in told] + [("seen", s) for s in seen]
    rng.shuffle(rows)
    rows += rng.sample(rows, 40)
    cut = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    batches = [rows[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    # the end of all lets the watermark pass; after it, everything comes once more and is late
    batches += [[("runs", ("end", far, "succeeded")), ("told", ("-", "end", far, "resolved", "-", "-")), ("seen", ("-", "end", far, "-"))], rows]
    kinds = {"runs": RUNS, "told": TOLD, "seen": SEEN}
    stream = lambda name: spark.readStream.schema(kinds[name]).parquet(f"file://{tmp_path}/{name}")
    sizes = []
    with watches.state_store(spark):
        for batch in batches:
            for name, schema in kinds.items():
                spark.createDataFrame([r for n, r in batch if n == name], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}")
            events = watches.watch_events(*map(stream, kinds), late="60 days")
            events.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
            sizes.append(spark.read.schema(events.schema).parquet(f"file://{tmp_path}/out").count())
    got = spark.read.schema(events.schema).parquet(f"file://{tmp_path}/out").drop("run_time")
    want = brute(runs, told, seen)
    assert len(want) > 20 and sorted(map(tuple, got.collect()), key=repr) == want
    assert sizes[-1] == sizes[-2] == len(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


class Counted:
    """A state of one key in memory, with the number of calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("update", "put"):
                self.value = args[0]
            elif name == "appendList":
                self.value = (self.value or []) + list(args[0])
            elif name == "appendValue":
                self.value = [*(self.value or []), args[0]]
            elif name == "clear":
                self.value = None
            elif name == "exists":
                return self.value is not None
            elif name == "get":
                return iter(self.value or []) if self.value is None or isinstance(self.value, list) else self.value
            return None

        return call


def test_state_calls_do_not_grow_with_runs():
    """All runs that are due are evaluated at once, rows of later ones and unresolved observations wait; the same events as by brute force."""
    ms = 86_400_000
    runs, told, seen = log(11)
    ok = {r[0] for r in runs if r[2] == "succeeded"}
    number = {r[0]: i for i, r in enumerate(runs)}
    kinds = [(k, run, "resolution", status, selected, source) for k, run, _, status, selected, source in told if run in ok]
    kinds += [(k, run, "observed", None, revision, None) for k, run, _, revision in seen]
    got, calls = [], {}
    for days in (24, 12, 1):  # days for which the watermark stands still
        made = []
        for k in "abcdef":
            p, timers = watches.WatchProcessor(), set()
            p.baseline, p.held = Counted(), Counted()
            p.handle = SimpleNamespace(registerTimer=timers.add)
            rows = [Row(at=number[run] * ms * 1000, run=run, kind=kind, status=s, revision=v, source_run=src) for kk, run, kind, s, v, src in kinds if kk == k]
            list(p.handleInputRows((k,), iter(rows), None))
            for mark in range(days - 1, 24, days):
                while due := sorted(t for t in timers if t <= mark * ms):
                    timers.remove(due[0])
                    made += p.handleExpiredTimer((k,), SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m * ms), SimpleNamespace(getExpiryTimeInMs=lambda t=due[0]: t))
            calls[days] = calls.get(days, 0) + p.baseline.calls + p.held.calls
        got.append(sorted([(r.key, r.event_type, r.from_revision, r.to_revision, r.source_run, r.run) for r in made], key=repr))
    assert got == [brute(runs, told, seen)] * 3 and len(got[0]) > 20
    assert calls[24] <= 6 * 8
