"""Expected against observed counts, and alerts on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sanity(checks: list[tuple[str, int, DataFrame]], tolerance: float = 0.01) -> DataFrame:
    """One row per (metric, expected, one-row count): delta, percent, ok."""
    rows = [d.toDF("observed").select(F.lit(m).alias("metric"), F.lit(e).cast("long").alias("expected"), F.col("observed").cast("long")) for m, e, d in checks]
    out = reduce(DataFrame.unionByName, rows)
    delta = F.col("observed") - F.col("expected")
    return out.select("*", delta.alias("delta"), F.round(100.0 * delta / F.col("expected"), 4).alias("pct"), (F.abs(delta) <= tolerance * F.col("expected")).alias("ok"))


def require(report: DataFrame) -> None:
    """Stops where a check failed."""
    bad = [r["metric"] for r in report.where("not ok").select("metric").collect()]  # one row a metric
    if bad:
        raise ValueError(f"sanity checks failed: {', '.join(bad)}")


def mixed_models(ok_jobs: DataFrame, group: list[str], model: str = "model", at: str = "updated_at") -> DataFrame:
    """Groups whose ok jobs name more than one model: each model's jobs and span."""
    per = ok_jobs.where(F.col(model).isNotNull()).groupBy(*group, model).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    several = per.groupBy(*group).agg(F.count(F.lit(1)).alias("n_models")).where("n_models > 1")
    return per.join(several, group)


def few_empty(ok_units: DataFrame, annotated: DataFrame, key: str, group: str, least: float = 0.2) -> DataFrame:
    """Per group: ok units without any annotation, and whether they are too few."""
    marked = ok_units.join(annotated.select(key).distinct().withColumn("_has", F.lit(1)), key, "left")
    out = marked.groupBy(group).agg(F.count(F.lit(1)).alias("ok"), F.sum(F.when(F.col("_has").isNull(), 1).otherwise(0)).alias("empty"))
    return out.withColumn("share", F.col("empty") / F.col("ok")).withColumn("alert", F.col("share") < least)


def stale_versions(stored: DataFrame, declared: DataFrame, key: str = "codebook", version: str = "version") -> DataFrame:
    """Stored job sets whose version is not the declared one."""
    now = declared.select(key, F.col(version).alias("declared"))
    return stored.select(key, version).distinct().join(now, key).where(F.col(version) != F.col("declared"))
