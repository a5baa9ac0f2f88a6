"""State machines over keyed events in the order of their times, whatever order they arrive in.

Events wait in the state of their key's bucket until the watermark has passed them; a timer at the earliest one's time
then hands them on in the order of time and id. So a stream gives the answer that a batch over sorted events gives, also
when files come in any order within the lateness that the watermark allows, and after a restart from its checkpoint.
Later ones are dropped by the watermark. A key holds the events of at most that lateness, and no state once its machine is back
where it started. Keys are kept in buckets by hash, each with one timer for its earliest event.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstone.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Each value of the state is a message to the state store, and back. So keys share a state by hash, in ``BUCKETS``, and events wait in packs of up to ``PACK``.
EVENTS, PACK, BUCKETS = "us array<long>, event_id array<long>, user_id array<long>, event_type array<string>", 10_000, 4096


@dataclass(frozen=True)
class Machine:
    """``step(state, seconds, event_type)`` gives (next state, answer); ``idle(state)`` is the second from which on the state counts as the start again, None for never."""

    state: str
    start: tuple
    step: Callable[[tuple, float, str], tuple[tuple, bool]]
    idle: Callable[[tuple], float | None] = lambda state: None


def _capped(state: tuple, now: float, kind: str) -> tuple[tuple, bool]:
    begun, used = state
    if used == 0 or now - begun >= 60:
        begun, used = now, 0
    return (begun, used + 1), used < 60


def _health(state: tuple, now: float, kind: str) -> tuple[tuple, bool]:
    streak, until = state
    healthy = streak < 3 and now >= until
    if kind in ("error", "rate_error"):
        streak += 1
        return (streak, now + 60 * (5 if kind == "rate_error" else min(2 * streak, 30))), healthy
    return (0, until), healthy


#: At most 60 events in a minute that starts with the first one after the last minute ended.
RATE_CAP = Machine("begun double, used long", (0.0, 0), _capped, lambda state: state[0] + 60)
#: Three failures in a row or a cooldown make a key unhealthy: 5 minutes after a rate error, else 2 minutes a failure, at most 30.
KEY_HEALTH = Machine("streak long, until double", (0, 0.0), _health, lambda state: None if state[0] else state[1])


class InOrder(StatefulProcessor):
    """Runs a machine over the events of each key of a bucket as the watermark passes them."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("packs", EVENTS)
        self.now = handle.getValueState("now", f"users array<long>, states array<struct<{self.machine.state}>>")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def _packs(self, events: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*events[i : i + PACK], strict=True))) for i in range(0, len(events), PACK)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  the interface's names
        number = lambda column: [None if x is None else int(x) for x in column]
        fresh = [r for f in rows for r in zip(f["us"].tolist(), number(f["event_id"]), number(f["user_id"]), f["event_type"].tolist(), strict=True)]
        self.waiting.appendList(self._packs(fresh))
        self._wake(min(us for us, *_ in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [event for pack in self.waiting.get() for event in zip(*pack, strict=True)] if self.waiting.exists() else []
        held.sort(key=lambda r: (r[0], r[1], r[3] or ""))
        first_later = bisect_right(held, passed, key=lambda r: r[0])
        due, later = held[:first_later], held[first_later:]
        kept = self.now.get()
        states = {} if kept is None else {user: tuple(state) for user, state in zip(*kept, strict=True)}
        out = []
        for us, event_id, user, kind in due:
            states[user], answer = self.machine.step(states.get(user, self.machine.start), us / 1e6, kind)
            out.append((user, event_id, answer))
        ends = {user: None if (idle := self.machine.idle(state)) is None else math.ceil(idle * 1e6) for user, state in states.items()}
        states = {user: state for user, state in states.items() if ends[user] is None or ends[user] > passed}
        if later:
            self.waiting.put(self._packs(later))
        elif held:
            self.waiting.clear()
        if states:
            self.now.update((list(states), list(states.values())))
        elif kept is not None:
            self.now.clear()
        wake = [later[0][0]] if later else []
        wake += [ends[user] for user in states if ends[user] is not None]
        if wake:
            self._wake(min(wake))
        if not out:
            return iter(())
        users, ids, answers = zip(*out, strict=True)
        return iter([pd.DataFrame({"user_id": pd.array(users, "Int64"), "event_id": pd.array(ids, "Int64"), "answer": answers})])

    def close(self) -> None:
        pass


def in_order(events: DataFrame, machine: Machine, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, answer) of a stream of events (ts, user_id, event_id, event_type), once the watermark has passed each."""
    spark: SparkSession = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # ids go as strings, as a frame has numbers with nulls as floats
    keyed = events.withWatermark("ts", late).selectExpr("ts", "cast(user_id as string) as user_id", "unix_micros(ts) as us", "cast(event_id as string) as event_id", "event_type", f"pmod(xxhash64(user_id), {BUCKETS}) as bucket").groupBy("bucket")
    return keyed.transformWithStateInPandas(InOrder(machine), "user_id long, event_id long, answer boolean", "Append", "EventTime")
