"""The keyed stream of replies against a plain loop, whole and in two runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.streaming.jobs import appended
from quillon.streaming.retries import Limits, keyed_state, reply_paths

LIMITS = Limits(attempts=3, models=2, budget=3, reset_hour=5, base=600.0, cap=1500.0)
START = dt.datetime(2024, 3, 1, 1, tzinfo=dt.UTC)
OUTCOMES = ["ok", "invalid", "server", "network", "rate_limit", "daily_quota", "json_mode_unsupported", "model_gone", "bad_request"]


def replies(n=400):
    out = []
    for i in range(n):
        minute = (i * 37) % 5000
        out.append((i % 7 + 1, START + dt.timedelta(minutes=minute, seconds=i % 3), i, OUTCOMES[(i * i + i // 7) % 9], 7200.0 if i % 11 == 0 else None))
    return out


def plain(rows, last):
    """Every reply up to ``last``, key by key, by the words of the contract."""
    seconds = lambda t: (t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds()
    out = []
    for key in sorted({r[0] for r in rows}):
        job, status, attempts, model, repaired, until, used = 1, "pending", 0, 0, False, None, {}
        day = None
        for _, t, number, outcome, wait in sorted((r for r in rows if r[0] == key and r[1] <= last), key=lambda r: (r[1], r[2])):
            if until is not None and until <= seconds(t):
                out.append((key, job, until, "pending", "timer", attempts, model, used.get(day, 0)))
                status, until = "pending", None
            if until is not None:
                out.append((key, job, seconds(t), "waiting", "early", attempts, model, used.get(day, 0)))
                continue
            day = (t - dt.timedelta(hours=LIMITS.reset_hour)).date()
            reset = seconds(dt.datetime.combine(day + dt.timedelta(days=1), dt.time(LIMITS.reset_hour), dt.UTC))
            if used.get(day, 0) == LIMITS.budget:
                status, until, why = "waiting", reset, "budget"
            else:
                used[day] = used.get(day, 0) + 1
                if status in ("done", "failed"):
                    job, attempts, model, repaired = job + 1, 0, 0, False
                why, status, free = outcome, "failed", outcome in ("json_mode_unsupported", "model_gone", "daily_quota")
                attempts += not free
                again = attempts < LIMITS.attempts
                if outcome == "ok":
                    status = "done"
                elif outcome == "invalid" and not repaired:
                    status, repaired = "repair" if again else "failed", True
                elif outcome == "json_mode_unsupported":
                    status = "pending"
                elif outcome == "daily_quota":
                    status, until = "waiting", reset
                elif outcome in ("server", "network", "rate_limit") and again:
                    status, until = "waiting", seconds(t) + (wait or min(LIMITS.cap, LIMITS.base * 2 ** (attempts - 1)))
                elif outcome in ("server", "network", "model_gone") and model + 1 < LIMITS.models:
                    status, model, attempts = "pending", model + 1, attempts if outcome == "model_gone" else 0
            out.append((key, job, seconds(t), status, why, attempts, model, used.get(day, 0)))
        if until is not None and until <= seconds(last):
            out.append((key, job, until, "pending", "timer", attempts, model, used.get(day, 0)))
    return sorted(out)


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def path(spark, folder, at):
    schema = "user long, ts timestamp, number long, outcome string, wait double"
    stream = spark.readStream.schema(schema).parquet(folder)
    got = appended(reply_paths(stream, "user", "ts", "number", LIMITS, late="10 minutes"), at)
    return sorted((r["key"], r["job"], r["at"] / 1e6, r["status"], r["why"], r["attempts"], r["model"], r["used"]) for r in got.collect())


def test_paths_whole_and_in_two_runs(spark, store, tmp_path):
    rows = replies()
    schema = "user long, ts timestamp, number long, outcome string, wait double"
    df = spark.createDataFrame(rows, schema).repartition(3)
    last = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    want = plain(rows, last)
    df.write.parquet(str(tmp_path / "all"))
    assert path(spark, str(tmp_path / "all"), str(tmp_path / "one")) == want
    assert {w[4] for w in want} >= {"timer", "early", "budget", "ok", "invalid"} and {w[3] for w in want} == {"pending", "repair", "waiting", "failed", "done"}
    # Stopped after the first half of the time, and started again.
    mid = START + dt.timedelta(minutes=2500)
    df.where(F.col("ts") < F.lit(mid)).write.parquet(str(tmp_path / "half"))
    first = path(spark, str(tmp_path / "half"), str(tmp_path / "two"))
    assert first == plain([r for r in rows if r[1] < mid], max(r[1] for r in rows if r[1] < mid) - dt.timedelta(minutes=10))
    df.where(F.col("ts") >= F.lit(mid)).write.mode("append").parquet(str(tmp_path / "half"))
    assert path(spark, str(tmp_path / "half"), str(tmp_path / "two")) == want
