"""Streaming forms: quotas, prevalence alerts, and a resumable annotation worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.store import last_of


def quota_windows(attempts: DataFrame, ts: str = "ts", reset_hour: int = 0, late: str = "1 hour") -> DataFrame:
    """Requests per quota day: a tumbling day that begins at the reset hour."""
    day = F.window(ts, "1 day", "1 day", f"{reset_hour} hours")
    return attempts.withWatermark(ts, late).groupBy(day).agg(F.count(F.lit(1)).alias("requests_used")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests_used")


def prevalence_windows(rows: DataFrame, value: str, ts: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of a code and its window, for alerts on shares and drift."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width), value).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), value, "n")


def start_worker(units: DataFrame, annotate: Callable[[DataFrame], DataFrame], log: str, checkpoint: str):
    """Annotates units as they arrive; every batch appends its attempts under
    its own number, so a batch that is run again after a failure replaces
    itself and a stopped worker goes on where it was."""

    def batch(df: DataFrame, number: int) -> None:
        annotate(df).withColumn("attempt_id", F.lit(number)).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return units.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs an aggregating stream over all that is there now and returns its last
    state. Every batch writes the groups it changed as a table of its own under
    ``at``, so nothing passes through the driver, and a batch that is run again
    replaces itself; of each group the last batch's row counts."""

    def put(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{at}/rows/part={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields), "batch long", "part long"])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{at}/rows").drop("part")
    return last_of(rows, keys, "batch", keys[0]).drop("batch").select(*stream.columns)


def appended(stream: DataFrame, at: str) -> DataFrame:
    """Runs a stream of rows over all that is there now and returns them; run
    again with the same ``at``, it goes on from its checkpoint. Every batch writes
    a table of its own, so a batch that is run again replaces itself."""

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/rows/part={number}")

    q = stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields), "part long"])
    return stream.sparkSession.read.schema(schema).parquet(f"{at}/rows").drop("part")
