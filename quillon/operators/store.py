"""The job store as an append-only log of attempts with views over it: what other
stores do by upserts is read from the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOB = ["unit_id", "codebook_id", "codebook_version", "run_id"]


def latest_jobs(attempts: DataFrame, key: list[str] = JOB, at: str = "updated_at", tie: str = "attempt_id") -> DataFrame:
    """One row per job: the state of its last attempt, attempts added up, the
    first attempt's time as created_at."""
    state = [c for c in attempts.columns if c not in key and c not in ("attempts", at)]
    last = F.max(F.struct(F.col(at), F.col(tie), *[F.col(c).alias(f"_{c}") for c in state])).alias("_last")
    out = attempts.groupBy(*key).agg(last, F.sum("attempts").alias("attempts"), F.min(at).alias("created_at"))
    return out.select(*key, *[F.col(f"_last._{c}").alias(c) for c in state], "attempts", "created_at", F.col(f"_last.{at}").alias(at))


def live_annotations(annotations: DataFrame, attempts: DataFrame, key: list[str] = JOB, at: str = "updated_at", tie: str = "attempt_id") -> DataFrame:
    """Annotations of each job's last attempt only: an error erases labels."""
    last = latest_jobs(attempts, key, at, tie).select(*key, tie)
    return annotations.join(last, [*key, tie], "left_semi")


def pending(units: DataFrame, jobs: DataFrame, key: str = "unit_id", group: str = "speech_id") -> DataFrame:
    """Groups that have a unit without an ok job, with how many."""
    missing = units.join(jobs.where("status = 'ok'").select(key), key, "left_anti")
    return missing.groupBy(group).agg(F.count(F.lit(1)).alias("n_missing"))


def latest_version(rows: DataFrame, group: list[str], version: str) -> DataFrame:
    """Rows of the highest version of each group. The maxima are few rows, so
    the large side meets them in one join instead of a window's sort."""
    top = rows.groupBy(*group).agg(F.max(version).alias(version))
    return rows.join(top, [*group, version], "left_semi")


def vanished(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Ids on one side only: lost (stored before, not now) or gained."""
    old, new = stored.select(key).distinct(), fresh.select(key).distinct()
    return old.join(new, key, "left_anti").withColumn("kind", F.lit("lost")).unionByName(new.join(old, key, "left_anti").withColumn("kind", F.lit("gained")))


def guard_stable_ids(stored: DataFrame, fresh: DataFrame, key: str) -> None:
    """Refuses a replacement in which annotated ids vanish."""
    lost = stored.select(key).join(fresh.select(key), key, "left_anti")
    if n := lost.count():
        raise ValueError(f"{n} annotated ids would vanish")


def guard_pilot(pilots: DataFrame, codebook: str, version: int, least: int = 20) -> None:
    """Refuses a full run without a pilot of ``least`` speeches at this version."""
    if not pilots.where((F.col("codebook_id") == codebook) & (F.col("codebook_version") == version) & (F.col("n_speeches") >= least)).limit(1).count():
        raise ValueError(f"no pilot of {least} speeches for {codebook} v{version}")


def quota_used(attempts: DataFrame, day: str = "day") -> DataFrame:
    return attempts.groupBy(day).agg(F.count(F.lit(1)).alias("requests_used"))


def cleared(rows: DataFrame, deletions: DataFrame, key: list[str], at: str = "updated_at") -> DataFrame:
    """Rows of a log without those that a later deletion of their key covers;
    ``deletions`` has the key and ``at``. Rows written after it count again."""
    last = deletions.groupBy(*key).agg(F.max(at).alias("_cleared"))
    return rows.join(last, key, "left").where(F.col("_cleared").isNull() | (F.col(at) > F.col("_cleared"))).drop("_cleared")


def last_of(log: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key: what an upsert would have left."""
    rest = [c for c in log.columns if c not in key]
    held = list(dict.fromkeys([at, *([] if tie in key else [tie]), *rest]))
    last = log.groupBy(*key).agg(F.max(F.struct(*held)).alias("_last"))
    return last.select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def capability(models: DataFrame, known: DataFrame, flag: str = "supports_json_mode", key: str = "model") -> DataFrame:
    """``models`` with what is known of each; unknown ones are taken to be able."""
    return models.join(known.select(key, flag), key, "left").withColumn(flag, F.coalesce(flag, F.lit(True)))


def put_by_run(matrix: DataFrame, values: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Adds the column ``name`` where ``values`` has a row for the key, which
    holds the run: a run fills its own rows only, what others wrote stays."""
    new = values.select(*key, F.col(name).alias("_new"), F.lit(True).alias("_put"))
    before = F.col(name) if name in matrix.columns else F.lit(None)
    out = matrix.join(new, key, "left").withColumn(name, F.when(F.col("_put"), F.col("_new")).otherwise(before))
    return out.drop("_new", "_put")


def attempt_state(ok: Column, attempts: Column, most: int = 3) -> Column:
    """What becomes of a unit after an attempt: done, to be tried again, or failed."""
    return F.when(ok, "ok").when(attempts < most, "pending").otherwise("failed")
