"""How the driver's tables play the roles of a coded corpus: orders are units,
customers speeches, nations countries, regions blocs, lineitems annotations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

REGISTRY: dict[str, tuple[Callable, str | None]] = {}

CODES = {"returnflag": ("A", "N", "R"), "linestatus": ("F", "O")}
PHASES = {"P1": ("1995-01-01", "1996-12-31"), "P2": ("1997-01-01", "1998-12-31"), "P3": ("1999-01-01", "2000-12-31")}
EVENT, EVENT_END = "1998-03-01", "1998-08-28"
EVENT_START = "1997-09-02"


def query(sql: str | None = None):
    """Registers a query, with the SQL that must agree with it."""

    def put(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def units(spark: SparkSession, sf: str) -> DataFrame:
    """nation and region are dimensions of fixed size; customers are left to the planner."""
    t = lambda n: table(spark, sf, n)
    place = F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")))
    speech = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = t("orders").join(speech, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("speech_id"), F.col("n_name").alias("country"), F.col("r_name").alias("bloc"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("c_mktsegment").alias("segment"))


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.row_number().over(order).alias("annotation_index"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), (1 - F.col("l_discount")).alias("confidence"), (F.col("l_tax") <= 0.06).cast("int").alias("verified"), F.col("l_quantity").alias("quantity"), F.to_date("l_shipdate").alias("shipped"))


def codes_of(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations without their index: no sort, for aggregates that don't need it."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))


UNITS = """units AS (SELECT o_orderkey AS unit_id, o_custkey AS speech_id, n_name AS country, r_name AS bloc,
 CAST(o_orderdate AS DATE) AS date, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price, c_mktsegment AS segment
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
ANN = """ann AS (SELECT l_orderkey AS unit_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS annotation_index,
 l_returnflag AS returnflag, l_linestatus AS linestatus, 1 - l_discount AS confidence, CASE WHEN l_tax <= 0.06 THEN 1 ELSE 0 END AS verified, l_quantity AS quantity, CAST(l_shipdate AS DATE) AS shipped FROM lineitem)"""
_HAS = ", ".join(f"coalesce(max(CASE WHEN {d} = '{x}' THEN 1 ELSE 0 END), 0) AS {d}__{x}" for d, own in CODES.items() for x in own)
_ABSENT = ", ".join(f"1 - greatest({', '.join(f'{d}__{x}' for x in own)}) AS {d}__NONE_ABSENT" for d, own in CODES.items())
#: One row per unit with the indicator columns.
MATRIX = f"{UNITS}, marked AS (SELECT u.unit_id, {_HAS} FROM units u LEFT JOIN lineitem ON l_orderkey = unit_id GROUP BY u.unit_id), matrix AS (SELECT u.*, m.* EXCLUDE (unit_id), {_ABSENT} FROM units u JOIN marked m ON u.unit_id = m.unit_id)".replace("WHEN returnflag", "WHEN l_returnflag").replace("WHEN linestatus", "WHEN l_linestatus")
COLUMNS = [c for d, own in CODES.items() for c in [*(f"{d}__{x}" for x in own), f"{d}__NONE_ABSENT"]]


def rounded(*columns: str, digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]
