"""Replies to jobs as a stream of keyed state with timers.

Every key has one job at a time. A reply moves it on: done; one repair after an
answer that can't be read; failed; pending at once, when the model or its JSON
mode is to blame; waiting until a moment, after a limit or a fault of the server,
or when the key's budget of requests for the quota day is spent. A timer ends the
wait. Replies while a job waits are early and change nothing; a reply after done
or failed belongs to a new job.

Replies are held until the watermark has passed them and taken in the order of
time and number, so the path does not hang on batches or on the order of arrival;
state, buffer and timers are in the checkpoint, and a stopped stream goes on where
it was.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY, HOUR = 86_400_000_000, 3_600_000_000  # microseconds
STATE = "job int, status string, why string, attempts int, model int, repaired boolean, until long, day long, used int"
REPLY = "at long, number long, outcome string, wait double"
PATH = "key long, job int, at long, status string, why string, attempts int, model int, until long, used int"
ENDED = ("done", "failed")


@dataclass(frozen=True)
class Limits:
    attempts: int = 3
    models: int = 2
    budget: int = 2  # requests of a key a quota day
    reset_hour: int = 0
    base: float = 4.0  # seconds of the first wait, doubled each time
    cap: float = 120.0


@dataclass
class Job:
    job: int = 1
    status: str = "pending"
    why: str = ""
    attempts: int = 0
    model: int = 0
    repaired: bool = False
    until: int = -1
    day: int = -1
    used: int = 0


def quota_day(at: int, limits: Limits) -> int:
    return (at - limits.reset_hour * HOUR) // DAY


def _wait(s: Job, until: float, why: str) -> None:
    s.status, s.until, s.why = "waiting", int(until), why


def _next_model(s: Job, limits: Limits) -> bool:
    more = s.model + 1 < limits.models
    s.model += more
    return more


def woken(s: Job, at: int) -> bool:
    """Whether a wait is over at a moment; the job is pending then."""
    if s.until < 0 or s.until > at:
        return False
    s.status, s.why, s.until = "pending", "timer", -1
    return True


def moved(s: Job, at: int, outcome: str, wait: float | None, limits: Limits) -> None:
    """A job that does not wait takes a reply."""
    day = quota_day(at, limits)
    s.used = s.used if s.day == day else 0
    s.day = day
    reset = (day + 1) * DAY + limits.reset_hour * HOUR
    if s.used >= limits.budget:
        return _wait(s, reset, "budget")
    s.used += 1
    if s.status in ENDED:
        s.job, s.attempts, s.model, s.repaired = s.job + 1, 0, 0, False
    s.attempts, s.why, s.until = s.attempts + 1, outcome, -1
    last = s.attempts >= limits.attempts
    pause = at + 1e6 * (wait if wait is not None else min(limits.cap, limits.base * 2.0 ** (s.attempts - 1)))
    if outcome == "ok":
        s.status = "done"
    elif outcome == "invalid":
        s.status = "failed" if s.repaired or last else "repair"
        s.repaired = True
    elif outcome == "json_mode_unsupported":
        s.status, s.attempts = "pending", s.attempts - 1
    elif outcome == "model_gone":
        s.attempts -= 1
        s.status = "pending" if _next_model(s, limits) else "failed"
    elif outcome == "daily_quota":
        s.attempts -= 1
        _wait(s, reset, outcome)
    elif outcome == "rate_limit" and not last:
        _wait(s, pause, outcome)
    elif outcome in ("server", "network") and not last:
        _wait(s, pause, outcome)
    elif outcome in ("server", "network") and _next_model(s, limits):
        s.status, s.attempts = "pending", 0
    else:
        s.status = "failed"


class Replies(StatefulProcessor):
    """The path of each key: a row for every reply and every timer."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)
        self.held = handle.getListState("held", REPLY)

    def handleInputRows(self, key, rows, timerValues):
        new = [tuple(r) for pdf in rows for r in pdf[["at", "number", "outcome", "wait"]].itertuples(index=False, name=None)]
        self.held.appendList([(int(a), int(n), o, None if pd.isna(w) else float(w)) for a, n, o, w in new])
        for ms in {-(-int(a) // 1000) for a, *_ in new}:
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.held.get()) if self.held.exists() else []
        s = Job(*self.job.get()) if self.job.exists() else Job()
        path: list = []

        def told(at: int, why: str | None = None) -> None:
            path.append((key[0], s.job, at, s.status, why or s.why, s.attempts, s.model, s.until if s.until >= 0 else None, s.used))

        for at, _, outcome, wait in [r for r in held if r[0] <= now]:
            until = s.until
            if woken(s, at):
                told(until)
            if s.until >= 0:
                told(at, "early")
                continue
            moved(s, at, outcome, wait, self.limits)
            told(at)
        until = s.until
        if woken(s, now):
            told(until)
        rest = [r for r in held if r[0] > now]
        self.held.put(rest) if rest else self.held.clear()
        self.job.update((s.job, s.status, s.why, s.attempts, s.model, s.repaired, s.until, s.day, s.used))
        if s.until >= 0:
            self.handle.registerTimer(-(-s.until // 1000))
        if path:
            out = pd.DataFrame(path, columns=[c.split()[0] for c in PATH.split(", ")])
            yield out.astype({"until": "Int64"})

    def close(self) -> None:
        pass


def reply_paths(replies: DataFrame, key: str, ts: str, number: str, limits: Limits = Limits(), late: str = "1 hour") -> DataFrame:
    """The paths of a stream of replies (key, ts, number, outcome, wait in
    seconds or null). Needs a state store that holds several states a key
    (``keyed_state``)."""
    rows = replies.select(F.col(key).cast("long").alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("at"), F.col(number).cast("long").alias("number"), "outcome", F.col("wait").cast("double").alias("wait"))
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Replies(limits), PATH, "Append", "EventTime")


def keyed_state(spark) -> None:
    """The session's state store for streams with states and timers of a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
