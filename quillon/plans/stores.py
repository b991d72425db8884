"""Queries through a store: tables are written as one and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.sources import commits as co
from quillon.sources import store as so

from .base import UNITS, query, table, units
from .streams import _folder


@query(f"WITH {UNITS} SELECT unit_id, status, price, segment FROM units WHERE status = 'F' AND price > 100000 AND segment IN ('BUILDING', 'MACHINERY') AND unit_id >= 100")
def store_units(spark, sf):
    """Units of a store that the store itself selects, its columns alone."""
    at = _folder(spark)
    u = units(spark, sf)
    so.write_table(u.select("unit_id", "speech_id", "country", "status", "price", "segment", F.col("date").cast("string").alias("date")), at, "units")
    got = so.read_table(spark, at, "units", ["unit_id", "status", "price", "segment"])
    return got.where((F.col("status") == "F") & (F.col("price") > 100000) & F.col("segment").isin("BUILDING", "MACHINERY") & (F.col("unit_id") >= 100))


@query("SELECT count(*) AS paragraphs, count(DISTINCT o_custkey) AS speeches, count(DISTINCT o_custkey % 50) AS meetings FROM orders WHERE o_orderstatus <> 'P'")
def store_selected(spark, sf):
    """Of two stores the one with the expected counts, and its counts."""
    root = _folder(spark)
    o = table(spark, sf, "orders")
    u = o.select(F.concat(F.col("o_custkey") % 50, F.lit("#"), "o_custkey").alias("speech_id"), (F.col("o_orderstatus") == "P").cast("int").alias("para_is_procedural"))
    notes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_returnflag").alias("value"))
    for name, rows in (("whole", u), ("half", u.where("pmod(hash(speech_id), 2) = 0"))):
        so.write_table(rows, f"{root}/{name}", "units")
        so.write_table(notes, f"{root}/{name}", "annotations")
    want = o.where("o_orderstatus <> 'P'").agg(F.count(F.lit(1)).alias("paragraphs"), F.count_distinct("o_custkey").alias("speeches"), F.count_distinct(F.col("o_custkey") % 50).alias("meetings")).first().asDict()
    best = so.select_store(spark, root, want)
    kept = so.read_table(spark, best, "units").where("para_is_procedural = 0")
    return kept.agg(F.count(F.lit(1)).alias("paragraphs"), F.count_distinct("speech_id").alias("speeches"), F.count_distinct(F.substring_index("speech_id", "#", 1)).alias("meetings"))


@query("SELECT o_orderkey AS unit_id, count(l_orderkey) AS n_annotations, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1")
def published_units(spark, sf):
    """Jobs and their annotations, published by batches of one commit each, read together."""
    t = co.Tables(spark, _folder(spark))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderstatus").alias("status"))
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_returnflag").alias("value"))
    for status in ("F", "O", "F"):  # the last is a batch that runs again
        jobs = o.where(F.col("status") == status)
        notes = a.join(jobs.select("unit_id"), "unit_id")
        stray = lambda own: "annotations without a job" if own["annotations"].join(own["jobs"], "unit_id", "left_anti").limit(1).count() else None
        t.commit({"jobs": jobs, "annotations": notes}, stray, key=status)
    notes = t.read("annotations").groupBy(F.col("unit_id").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.max((F.col("value") == "R").cast("int")).alias("r"))
    out = t.read("jobs").join(notes, F.col("unit_id") == F.col("of"), "left")
    return out.select("unit_id", F.coalesce("n", F.lit(0)).alias("n_annotations"), F.coalesce("r", F.lit(0)).alias("returned"))
