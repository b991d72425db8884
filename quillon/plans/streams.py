"""Streaming queries run to the end of the tables they read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.streaming.jobs import appended, drained, prevalence_windows, quota_windows
from quillon.streaming.retries import Limits, keyed_state, reply_paths

from .base import query, table


def _source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    reader = spark.readStream.schema(schema)
    folder = _is_folder(spark, f"{sf}/{name}.parquet")
    rows = reader.parquet(f"{sf}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # event time has a zone


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _folder(spark: SparkSession) -> str:
    """A folder of its own where all executors can write: under the checkpoint
    folder the session names; a local one in local mode only."""
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = f"{shared or '/tmp/checkpoints/quillon'}/stream-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def _drained(df: DataFrame, keys: list[str]) -> DataFrame:
    return drained(df, keys, _folder(df.sparkSession))


@query("SELECT CAST(ts - INTERVAL 7 HOUR AS DATE) AS day, count(*) AS requests_used FROM events GROUP BY 1")
def stream_quota(spark, sf):
    out = _drained(quota_windows(_source(spark, sf, "events"), reset_hour=7), ["start"])
    return out.select(F.to_date(F.col("start") - F.expr("INTERVAL 7 HOURS")).alias("day"), "requests_used")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_prevalence(spark, sf):
    out = _drained(prevalence_windows(_source(spark, sf, "events"), "event_type"), ["start", "event_type"])
    return out.select(F.to_date("start").alias("day"), "event_type", "n")


#: Users are keys, their events replies: what came back, and how long the provider asks to wait.
LIMITS = Limits(attempts=3, models=2, budget=2, reset_hour=7, base=14_400.0, cap=43_200.0)
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
_OUTCOME = f"""CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'invalid' WHEN 'error' THEN CASE WHEN {_K} < 50 THEN 'server' ELSE 'rate_limit' END
  WHEN 'click' THEN CASE WHEN {_K} < 85 THEN 'network' ELSE 'daily_quota' END
  ELSE CASE WHEN {_K} < 40 THEN 'json_mode_unsupported' WHEN {_K} < 70 THEN 'model_gone' WHEN {_K} < 85 THEN 'bad_request' ELSE 'ok' END END"""
_WAIT = f"CASE WHEN event_type = 'error' AND {_K} % 2 = 0 THEN {_K} * 600.0 END"
_DAY, _HOURS = 86_400_000_000, 7 * 3_600_000_000

#: One reply of every key a round; a row says what the key was before it (b...) and after.
_PATHS = f"""WITH RECURSIVE c AS (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 AS last FROM events),
e AS (SELECT user_id AS key, epoch_us(ts) AS "at", {_OUTCOME} AS outcome, {_WAIT} AS wait,
  (epoch_us(ts) - {_HOURS}) // {_DAY} AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE epoch_us(ts) <= (SELECT last FROM c)),
s AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS "at", 1 AS job, 'pending' AS status, '' AS why, 0 AS attempts, 0 AS model, false AS repaired, CAST(-1 AS BIGINT) AS until, CAST(-1 AS BIGINT) AS day, 0 AS used, CAST(-1 AS BIGINT) AS woke, 0 AS b_attempts, 0 AS b_model, 1 AS b_job, 0 AS b_used, 'pending' AS b_status FROM e
  UNION ALL
  SELECT key, n, "at", job, CASE kind WHEN 'early' THEN 'waiting' WHEN 'budget' THEN 'waiting' ELSE CASE
      WHEN outcome = 'ok' THEN 'done' WHEN outcome = 'invalid' THEN CASE WHEN repaired OR tries >= 3 THEN 'failed' ELSE 'repair' END WHEN outcome = 'json_mode_unsupported' THEN 'pending'
      WHEN outcome = 'model_gone' THEN CASE WHEN model = 0 THEN 'pending' ELSE 'failed' END WHEN outcome = 'daily_quota' THEN 'waiting'
      WHEN outcome IN ('rate_limit', 'server', 'network') AND tries < 3 THEN 'waiting' WHEN outcome IN ('server', 'network') AND model = 0 THEN 'pending' ELSE 'failed' END END,
    CASE kind WHEN 'early' THEN 'early' WHEN 'budget' THEN 'budget' ELSE outcome END,
    CASE WHEN kind <> 'go' THEN attempts WHEN outcome IN ('json_mode_unsupported', 'model_gone', 'daily_quota') THEN tries - 1 WHEN outcome IN ('server', 'network') AND tries >= 3 AND model = 0 THEN 0 ELSE tries END,
    CASE WHEN kind = 'go' AND model = 0 AND (outcome = 'model_gone' OR outcome IN ('server', 'network') AND tries >= 3) THEN 1 ELSE model END,
    CASE WHEN kind = 'go' AND outcome = 'invalid' THEN true ELSE repaired END,
    CASE WHEN kind = 'early' THEN until WHEN kind = 'budget' OR outcome = 'daily_quota' THEN (day + 1) * {_DAY} + {_HOURS}
      WHEN outcome IN ('rate_limit', 'server', 'network') AND tries < 3 THEN CAST("at" + 1000000 * coalesce(wait, least(43200.0, 14400.0 * power(2, tries - 1))) AS BIGINT) ELSE -1 END,
    CASE WHEN kind = 'early' THEN b_day ELSE day END, used, woke, b_attempts, b_model, b_job, b_used, b_status
  FROM (
    SELECT key, n, "at", outcome, wait, day, until, woke, kind, b_day, b_attempts, b_model, b_job, b_used, b_status,
      CASE WHEN fresh THEN b_job + 1 ELSE b_job END AS job, CASE WHEN fresh THEN 0 ELSE b_attempts END AS attempts, CASE WHEN fresh THEN 0 ELSE b_attempts END + 1 AS tries,
      CASE WHEN fresh THEN 0 ELSE b_model END AS model, CASE WHEN fresh THEN false ELSE b_repaired END AS repaired, CASE kind WHEN 'early' THEN b_used WHEN 'budget' THEN today ELSE today + 1 END AS used
    FROM (
      SELECT *, kind = 'go' AND b_status IN ('done', 'failed') AS fresh FROM (
        SELECT e.key, e.n, e."at", e.outcome, e.wait, e.day, s.until, CASE WHEN s.until >= 0 AND s.until <= e."at" THEN s.until ELSE -1 END AS woke, s.day AS b_day, s.attempts AS b_attempts, s.model AS b_model, s.job AS b_job, s.used AS b_used, s.status AS b_status, s.repaired AS b_repaired,
          CASE WHEN s.day = e.day THEN s.used ELSE 0 END AS today, CASE WHEN s.until > e."at" THEN 'early' WHEN s.day = e.day AND s.used >= 2 THEN 'budget' ELSE 'go' END AS kind
        FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)))),
t AS (SELECT key, b_job AS job, woke AS "at", 'pending' AS status, 'timer' AS why, b_attempts AS attempts, b_model AS model, NULL AS until, b_used AS used FROM s WHERE woke >= 0),
z AS (SELECT key, job, until AS "at", 'pending' AS status, 'timer' AS why, attempts, model, NULL AS until, used FROM s, c WHERE until >= 0 AND until <= last AND n = (SELECT max(n) FROM e WHERE e.key = s.key))
SELECT key, job, "at", status, why, attempts, model, CASE WHEN until >= 0 THEN until END AS until, used FROM s WHERE n > 0 UNION ALL SELECT * FROM t UNION ALL SELECT * FROM z"""


@query(_PATHS)
def stream_reply_paths(spark, sf):
    """The path of every key's jobs through replies, waits, repairs and budgets."""
    replies = _source(spark, sf, "events").select("user_id", "ts", "event_id", F.expr(_OUTCOME).alias("outcome"), F.expr(_WAIT).alias("wait"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed_state(spark)
    try:
        return appended(reply_paths(replies, "user_id", "ts", "event_id", LIMITS), _folder(spark))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
