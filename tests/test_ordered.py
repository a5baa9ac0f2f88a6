"""Keyed machines over events in time order: files in any order, restarts, late events, state that goes."""

import datetime
import random

import pandas as pd
import pytest

from quillstone.streaming import ordered, streams

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
BEGIN = datetime.datetime(2024, 1, 1)


def given(seed, n=600):
    rng = random.Random(seed)
    times = sorted(rng.uniform(0, 6 * 3600) for _ in range(n))
    return [(i, BEGIN + datetime.timedelta(seconds=t, microseconds=0), rng.choice([1, 1, 1, 2, 3]), rng.choice(["error", "view", "rate_error", "error"]), 1.0, None) for i, t in enumerate(times)]


def replay(rows, machine):
    state, out = {}, {}
    for event_id, ts, user, kind, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        now = round(ts.replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6) / 1e6
        state[user], out[event_id] = machine.step(state.get(user, machine.start), now, kind)
    return out


def put(spark, rows, folder, number):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{number:03d}")


def run(spark, folder, out, state, machine, late, files=1):
    source = spark.readStream.format("parquet").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(folder)
    from pyspark.sql import functions as F

    stream = ordered.in_order(source.withColumn("ts", F.col("ts").cast("timestamp")), machine, late)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("machine", [ordered.RATE_CAP, ordered.KEY_HEALTH])
def test_shuffled_files_and_a_restart_give_the_sorted_answer(spark, tmp_path, machine):
    """Within the lateness files come in any order; the stream is stopped after half of them and goes on from its checkpoint."""
    rows = given(3)
    rng = random.Random(1)
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    mixed = [r for i in range(0, len(parts), 2) for r in [*parts[i + 1], *parts[i]]]  # neighbours swapped: about an hour late
    files = [mixed[i : i + 60] for i in range(0, len(mixed), 60)]
    for f in files:
        rng.shuffle(f)
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for i, f in enumerate(files[:5]):
        put(spark, f, folder, i)
    run(spark, folder, out, state, machine, "2 hours")
    for i, f in enumerate(files[5:], 5):
        put(spark, f, folder, i)
    put(spark, [(9999, BEGIN + datetime.timedelta(hours=20), 9, "view", 1.0, None)], folder, 99)
    run(spark, folder, out, state, machine, "2 hours")
    got = [tuple(r) for r in spark.read.parquet(out).select("event_id", "answer").collect()]
    assert len(got) == len(dict(got)) and dict(got) == replay(rows, machine)


def test_events_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = given(5, 100)
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    put(spark, rows[20:60], folder, 0)
    put(spark, rows[60:], folder, 1)
    put(spark, rows[:20], folder, 2)  # hours before what the first file closed: the watermark of one batch holds for the rows of the next but one
    put(spark, [(9999, BEGIN + datetime.timedelta(hours=20), 9, "view", 1.0, None)], folder, 3)
    run(spark, folder, out, state, ordered.KEY_HEALTH, "1 minute")
    got = {r["event_id"]: r["answer"] for r in spark.read.parquet(out).collect()}
    assert got == replay(rows[20:], ordered.KEY_HEALTH)


def test_machines():
    step = ordered.RATE_CAP.step
    state, out = ordered.RATE_CAP.start, []
    for i in range(70):
        state, ok = step(state, 1000 + i * 0.5, "view")
        out.append(ok)
    assert out == [True] * 60 + [False] * 10 and step(state, 1060.0, "view")[1] and ordered.RATE_CAP.idle(state) == 1060
    state = ordered.KEY_HEALTH.start
    answers = []
    for now, kind in [(0, "error"), (60, "view"), (121, "view"), (200, "rate_error"), (499, "view"), (500, "view")]:
        state, ok = ordered.KEY_HEALTH.step(state, now, kind)
        answers.append(ok)
    assert answers == [True, False, True, True, False, True]
    assert ordered.KEY_HEALTH.idle((2, 5.0)) is None and ordered.KEY_HEALTH.idle((0, 5.0)) == 5.0


def test_events_wait_in_packs():
    """A bucket's events of a batch are few values of the state, whatever their keys, and come out in order, those that the watermark has not passed later."""

    class State:
        def __init__(self):
            self.values = []

        def appendList(self, values):  # noqa: N802
            self.values += values

        def put(self, values):
            self.values = list(values)

        update = put

        def exists(self):
            return bool(self.values)

        def get(self):
            return iter(self.values) if self is waiting else self.values or None

        def clear(self):
            self.values = []

    class Handle:
        timers = []

        def getListState(self, name, schema):  # noqa: N802
            return waiting

        def getValueState(self, name, schema):  # noqa: N802
            return State()

        def registerTimer(self, ms):  # noqa: N802
            self.timers.append(ms)

    class Times:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    waiting, rows = State(), given(9, 25_000)
    machine = ordered.InOrder(ordered.RATE_CAP)
    machine.init(Handle())
    us = {r[0]: (r[1] - BEGIN) // datetime.timedelta(microseconds=1) for r in rows}
    shuffled = random.Random(2).sample(rows, len(rows))
    machine.handleInputRows((1,), iter([pd.DataFrame({"us": [us[r[0]] for r in shuffled], "event_id": [str(r[0]) for r in shuffled], "user_id": [str(r[2]) for r in shuffled], "event_type": [r[3] for r in shuffled]})]), None)
    assert len(waiting.values) == 3
    first = [r for f in machine.handleExpiredTimer((1,), Times(3 * 3600 * 1000), None) for r in f.to_dict("records")]
    assert all(us[r["event_id"]] <= 3 * 3600 * 10**6 for r in first) and 0 < len(waiting.values) < 3
    last = [r for f in machine.handleExpiredTimer((1,), Times(7 * 3600 * 1000), None) for r in f.to_dict("records")]
    assert waiting.values == [] and [r["event_id"] for r in first + last] == [r[0] for r in rows]
    assert {r["event_id"]: r["answer"] for r in first + last} == replay(rows, ordered.RATE_CAP)
    assert [r["user_id"] for r in first + last] == [r[2] for r in rows]
