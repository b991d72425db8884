"""The store as a source and a sink."""

import contextlib
import io
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillon.sources import store as so

ROWS = [(i, f"s{i % 7}", None if i % 5 == 0 else i / 4, bytes([i % 256])) for i in range(1, 401)]


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, name string, price double, raw binary").repartition(5)
    so.write_table(df, f"file://{tmp_path}/s", "t")
    return str(tmp_path / "s")


def test_round_trip(spark, table):
    got = so.read_table(spark, table, "t", partitions=20)
    assert got.rdd.getNumPartitions() > 10
    assert sorted((r["id"], r["name"], r["price"], bytes(r["raw"])) for r in got.collect()) == ROWS
    assert so.read_table(spark, table, "t", ["name"]).distinct().count() == 7


@pytest.mark.parametrize("where,pushed", [
    ("id > 10 and id <= 20", True), ("name = 's3'", True), ("name in ('s1', 's2') and price is null", True), ("price is not null and price < 3", True), ("name <=> 's1'", True),
    ("name like 's3%'", True), ("name like '%3'", False), ("id % 2 = 0", False), ("price >= 50 or id < 3", False), ("contains(name, '4')", True),
])
def test_filters_reach_the_store(spark, table, where, pushed):
    want = spark.createDataFrame(ROWS, "id long, name string, price double, raw binary").where(where).select("id")
    got = so.read_table(spark, table, "t").where(where).select("id")
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())
    with contextlib.redirect_stdout(io.StringIO()) as out:
        got.explain("formatted")
    filters = [x for x in out.getvalue().splitlines() if "Condition" in x]
    assert bool(filters) != pushed


def test_only_given_ranges_columns_and_conditions_are_asked_for(table):
    r = so.StoreReader(so.table_schema(table, "t"), {"path": table, "table": "t", "partitions": "7"})
    ranges = [(p.file, p.low, p.high) for p in r.partitions()]
    assert len(ranges) == len(set(ranges)) >= 5 and all(a < z for _, a, z in ranges)
    seen = [row for p in r.partitions() for b in r.read(p) for row in b.column(0).to_pylist()]
    assert sorted(seen) == [i for i, *_ in ROWS]


def test_a_failed_write_leaves_nothing_to_read(spark, table):
    bad = spark.range(10).select(F.col("id"), F.lit("x").alias("name"), F.lit(1.0).alias("price"), F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).cast("binary").alias("raw"))
    with pytest.raises(Exception, match="no"):
        so.write_table(bad, table, "t")
    assert so.read_table(spark, table, "t").count() == len(ROWS)
    so.write_table(spark.range(3).select("id"), table, "t", "overwrite")
    assert so.read_table(spark, table, "t").count() == 3


def test_candidates_are_found_and_scored(spark, tmp_path):
    for name, n in (("a.db", 3), ("b.sqlite", 5), ("no.db", 0)):
        con = sqlite3.connect(tmp_path / name)
        if n:
            con.execute("CREATE TABLE units (speech_id TEXT, para_is_procedural INTEGER)")
            con.execute("CREATE TABLE annotations (unit_id INTEGER)")
            con.executemany("INSERT INTO units VALUES (?, ?)", [(f"m{i % 2}#{i}", 0) for i in range(n)] + [("m9#9", 1)])
        else:
            con.execute("CREATE TABLE other (x INTEGER)")
        con.commit()
        con.close()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.db").write_bytes(b"")
    assert [c.rsplit("/", 1)[1] for c in so.candidates(str(tmp_path))] == ["a.db", "b.sqlite", "no.db"]
    assert so.select_store(spark, str(tmp_path), {"paragraphs": 5, "speeches": 5, "meetings": 2}).endswith("b.sqlite")
    with pytest.raises(ValueError, match="no source"):
        so.select_store(spark, str(tmp_path), {"paragraphs": 50, "speeches": 5, "meetings": 2})
    assert so.read_table(spark, str(tmp_path / "a.db"), "units").count() == 4
    with pytest.raises(ValueError, match="mounted"):
        so.files("hdfs://x/y")
