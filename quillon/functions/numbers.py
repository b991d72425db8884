"""Numeric and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def long_date(c: Column) -> Column:
    """``7 March 2024`` as a date; anything else is null."""
    return F.to_date(F.try_to_timestamp(c, F.lit("d MMMM yyyy")))


def quarter_of(c: Column) -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def months_since(c: Column, day: str) -> Column:
    return F.datediff(c, F.lit(day).cast("date")) / 30.4375


def quota_day(ts: Column, reset_hour: int) -> Column:
    """The day a moment counts to where days begin at ``reset_hour``."""
    return F.to_date(ts - F.expr(f"make_dt_interval(0, {reset_hour})"))


def backoff(attempt: Column, base: float = 2.0, cap: float = 60.0) -> Column:
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt - 1))


def next_reset(ts: Column, reset_hour: int) -> Column:
    """The next moment at which the quota begins anew, strictly after ``ts``."""
    today = F.date_trunc("day", ts) + F.expr(f"make_dt_interval(0, {reset_hour % 24})")
    return F.when(today > ts, today).otherwise(today + F.expr("make_dt_interval(1)"))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or the time until an HTTP date; never negative."""
    date = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.lit(0.0), F.coalesce(header.try_cast("double"), F.unix_seconds(date).cast("double") - F.unix_seconds(now)))


def jittered(seconds: Column, key: Column, share: float = 0.25) -> Column:
    """A wait made longer by up to ``share`` of it, by a hash of ``key``: the same on every rerun."""
    return seconds * (1 + share * (F.pmod(F.xxhash64(key), F.lit(1000)) / 1000))


def epoch_seconds(c: Column) -> Column:
    """Epochs beyond 1e11 are milliseconds."""
    return F.when(c > 1e11, c / 1000).otherwise(c)


# What an exhausted daily quota says, how long a wait means one, and
# what a provider says that does not know the JSON mode.
DAILY = ("per day", "per-day", "daily limit", "free-models-per-day", "daily quota", "add 10 credits", "requests per day")
DAILY_SECONDS = 600
NO_JSON_MODE = r"(?i)structured[-_ ]?outputs?|response_format|json[-_ ]?object|json[-_ ]?schema|json[-_ ]?mode"


def http_outcome(status: Column, body: Column, retry_after: Column | None = None, reset_in: Column | None = None) -> Column:
    """What to do with a reply, one of nine: ok, rate_limit, daily_quota, server,
    model_gone, auth, bad_request, json_mode_unsupported, network. A 200 is ok
    only with a message that was not cut off; its error envelope counts."""
    at = lambda path: F.get_json_object(body, path)
    message = F.coalesce(at("$.error.message"), at("$.error"), body, F.lit(""))
    waits = [w > DAILY_SECONDS for w in (retry_after, reset_in) if w is not None]
    daily = F.coalesce(F.lower(message).rlike("|".join(DAILY)), F.lit(False))
    for w in waits:
        daily = daily | F.coalesce(w, F.lit(False))
    limited = F.when(daily, "daily_quota").otherwise("rate_limit")
    code = F.coalesce(at("$.error.code"), F.lit(""))
    whole = (F.try_parse_json(body).isNotNull()) & at("$.choices[0].message").isNotNull() & (F.lower(F.coalesce(at("$.choices[0].finish_reason"), F.lit(""))) != "length")
    return (
        F.when(status.isNull(), "network")
        .when((status == 200) & at("$.error").isNotNull(), F.when(daily | (code == "429"), limited).otherwise("server"))
        .when(status == 200, F.when(F.coalesce(whole, F.lit(False)), "ok").otherwise("server"))
        .when(status == 429, limited)
        .when(status.isin(401, 403), "auth")
        .when(status == 404, "model_gone")
        .when(status == 402, "daily_quota")
        .when(status.isin(400, 422), F.when(message.rlike(NO_JSON_MODE), "json_mode_unsupported").otherwise("bad_request"))
        .otherwise("server")
    )


def verdict(ari: Column) -> Column:
    return F.when(ari >= 0.8, "robust").when(ari >= 0.6, "mostly robust").otherwise("sensitive")


def phase_of(day: Column, phases: dict[str, tuple[str, str]], default: str = "outside") -> Column:
    """The phase whose closed interval holds the day, the last one listed first;
    a CASE, so no join is needed."""
    out = F.lit(default)
    for name, (start, end) in phases.items():
        out = F.when(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), name).otherwise(out)
    return out


def bucket_of(c: Column, edges: tuple[int, ...]) -> Column:
    """``a-b`` for edges a <= c < b, the last bucket open."""
    out = F.lit(f"{edges[-1]}+")
    for a, b in list(zip(edges, edges[1:]))[::-1]:
        out = F.when(c < b, f"{a}-{b - 1}").otherwise(out)
    return F.when(c < edges[0], f"<{edges[0]}").otherwise(out)


def prevalence_flag(p: Column) -> Column:
    return F.when(p > 0.5, "over half").when((p > 0) & (p < 0.01), "very rare").otherwise("")
