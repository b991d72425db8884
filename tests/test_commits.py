"""One commit for several tables."""

import pytest
from pyspark.sql import functions as F

from quillon.sources.commits import AuditError, CommitError, Tables, commit_batches, same_keys


def split(df):
    return {"jobs": df.select("id", F.lit("ok").alias("status")), "annotations": df.select("id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("value"))}


def counts(t, version=None):
    return {n: t.read(n, version).count() for n in t.manifest(version)["tables"]}


def test_both_or_neither(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/store")
    with pytest.raises(CommitError):
        t.read("jobs")
    assert t.commit(split(spark.range(5)), same_keys("id")) == 1 and counts(t) == {"jobs": 5, "annotations": 10}
    # The second table's job fails when the first one is already written.
    broken = split(spark.range(5, 9))
    broken["annotations"] = broken["annotations"].withColumn("value", F.when(F.col("id") == 7, F.raise_error(F.lit("crash")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="crash"):
        t.commit(broken)
    assert counts(t) == {"jobs": 5, "annotations": 10} and t.version() == 1
    # Two tables that disagree are refused by the audit.
    with pytest.raises(AuditError, match="2 keys"):
        t.commit({"jobs": spark.range(5, 9), "annotations": spark.range(5, 7)}, same_keys("id"))
    assert counts(t) == {"jobs": 5, "annotations": 10}
    assert t.clean() == 4 and t.commit(split(spark.range(5, 9)), same_keys("id")) == 2
    assert counts(t) == {"jobs": 9, "annotations": 18} and counts(t, 1) == {"jobs": 5, "annotations": 10} and t.clean() == 0
    t.commit({"jobs": split(spark.range(2))["jobs"]}, replace=True)
    assert counts(t) == {"jobs": 2, "annotations": 18}


def test_a_number_is_taken_once(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    a, b = Tables(spark, root), Tables(spark, root)

    def meanwhile(_):
        b.commit(split(spark.range(3)))

    with pytest.raises(CommitError, match="taken"):
        a.commit(split(spark.range(7)), meanwhile)
    assert counts(a) == {"jobs": 3, "annotations": 6}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    src, t = str(tmp_path / "in"), Tables(spark, f"file://{tmp_path}/store")
    put = commit_batches(t, split, same_keys("id"))
    for k in range(2):
        spark.range(10 * k, 10 * k + 4).write.mode("append").parquet(src)
        spark.readStream.schema("id long").parquet(src).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    put(spark.range(10, 14), 1)
    assert counts(t) == {"jobs": 8, "annotations": 16} and t.version() == 2
