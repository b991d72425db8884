"""A SQL store as a source and a sink: SQLite files, read in ranges of row ids.

A store is one file, or a folder of files that each hold a part of every table.
``read_table`` splits every file by ranges of its row ids into partitions, asks
for the columns of the schema it is given only, and hands comparisons, null tests
and IN lists to the store. Writing gives every task a file of its own, under a
name that readers pass over until the job commits, so nothing goes through one
process. All executors must see the path.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

NAME, SUFFIXES = "quillon_store", (".db", ".sqlite")
KINDS = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType()}
COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
BATCH = 10_000


def local(path: str) -> str:
    """The path as files see it; other schemes are refused."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    elif "://" in path:
        raise ValueError(f"a store needs a path that every executor has mounted, not {path}")
    return path


def files(path: str) -> list[str]:
    path = local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(SUFFIXES) and not f.startswith(("_", ".")))
    return [path]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _has(con: sqlite3.Connection, table: str) -> bool:
    return con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", [table]).fetchone() is not None


def table_schema(path: str, table: str) -> T.StructType:
    for f in files(path):
        con = _open(f)
        try:
            if _has(con, table):
                return T.StructType([T.StructField(name, KINDS.get((kind or "").upper(), T.StringType())) for _, name, kind, *_ in con.execute(f"PRAGMA table_info({quoted(table)})")])
        finally:
            con.close()
    raise ValueError(f"{path} has no table {table}")


def condition(f) -> tuple[str, list] | None:
    """A filter as SQL with its parameters; null if the store can't say it."""
    column = quoted(".".join(f.attribute)) if hasattr(f, "attribute") else None
    value = getattr(f, "value", None)
    plain = isinstance(value, (int, float, str)) and not isinstance(value, bool)
    if type(f) in COMPARE and plain:
        return f"{column} {COMPARE[type(f)]} ?", [value]
    if isinstance(f, EqualNullSafe) and (plain or value is None):
        return f"{column} IS ?", [value]
    if isinstance(f, IsNull):
        return f"{column} IS NULL", []
    if isinstance(f, IsNotNull):
        return f"{column} IS NOT NULL", []
    if isinstance(f, In) and all(isinstance(v, (int, float, str)) and not isinstance(v, bool) for v in value):
        return f"{column} IN ({', '.join('?' * len(value))})", list(value)
    if isinstance(f, StringStartsWith):
        return f"substr({column}, 1, ?) = ?", [len(value), value]
    if isinstance(f, StringContains):
        return f"instr({column}, ?) > 0", [value]
    return None


@dataclass
class Rows(InputPartition):
    file: str
    low: int
    high: int


class StoreReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.parts = int(options.get("partitions", 8))
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        for f in filters:
            told = condition(f)
            if told is None:
                yield f  # left to the engine
            else:
                self.conditions.append(told)

    def partitions(self):
        out, paths = [], files(self.path)
        each = max(1, self.parts // max(1, len(paths)))
        for f in paths:
            con = _open(f)
            try:
                if not _has(con, self.table):
                    continue
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            finally:
                con.close()
            if low is None:
                continue
            step = -(-(high - low + 1) // each)
            out += [Rows(f, a, min(a + step, high + 1)) for a in range(low, high + 1, step)]
        return out or [Rows("", 0, 0)]

    def read(self, partition):
        if not partition.file:
            return
        columns = ", ".join(quoted(f.name) for f in self.schema) or "1"
        where = " AND ".join(["rowid >= ? AND rowid < ?", *(c for c, _ in self.conditions)])
        con = _open(partition.file)
        try:
            got = con.execute(f"SELECT {columns} FROM {quoted(self.table)} WHERE {where}", [partition.low, partition.high, *(v for _, own in self.conditions for v in own)])
            schema = to_arrow_schema(self.schema)
            while rows := got.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        finally:
            con.close()


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class StoreWriter(DataSourceArrowWriter):
    """Every task's rows in a file of its own; the commit gives the files their names."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.table, self.overwrite = schema, local(options["path"]), options["table"], overwrite

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        file = os.path.join(self.path, f"_{uuid.uuid4().hex}{SUFFIXES[0]}")
        kinds = {type(k): n for n, k in KINDS.items()} | {T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.BooleanType: "INTEGER", T.FloatType: "REAL"}
        columns = ", ".join(f"{quoted(f.name)} {kinds.get(type(f.dataType), 'TEXT')}" for f in self.schema)
        con, n = sqlite3.connect(file, isolation_level=None), 0
        try:
            con.execute(f"CREATE TABLE {quoted(self.table)} ({columns})")
            con.execute("BEGIN")
            for b in iterator:
                con.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.schema))})", zip(*(c.to_pylist() for c in b.columns)))
                n += b.num_rows
            con.execute("COMMIT")
        finally:
            con.close()
        return Written(file, n)

    def commit(self, messages):
        old = files(self.path) if self.overwrite and os.path.isdir(self.path) else []
        for m in messages:
            if m is not None:
                os.replace(m.file, os.path.join(self.path, "part-" + os.path.basename(m.file)[1:]))
        for f in old:
            os.remove(f)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.file):
                os.remove(m.file)


class StoreSource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return table_schema(self.options["path"], self.options["table"])

    def reader(self, schema):
        return StoreReader(schema, self.options)

    def writer(self, schema, overwrite):
        return StoreWriter(schema, self.options, overwrite)


def _known(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)


def read_table(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, partitions: int = 8) -> DataFrame:
    """A table of the store. Only ``columns`` are asked for, if they are given."""
    _known(spark)
    r = spark.read.format(NAME).option("path", path).option("table", table).option("partitions", partitions)
    if columns:
        known = {f.name: f for f in table_schema(path, table)}
        r = r.schema(T.StructType([known[c] for c in columns]))
    return r.load()


def write_table(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Appends, or with ``overwrite`` replaces the store's files."""
    _known(df.sparkSession)
    df.write.format(NAME).option("path", path).option("table", table).mode(mode).save()


def candidates(root: str) -> list[str]:
    """Stores below a folder: files, and folders that hold parts."""
    out = set()
    for d, folders, names in os.walk(local(root)):
        folders[:] = sorted(f for f in folders if f not in (".venv", "node_modules"))
        own = [n for n in names if n.endswith(SUFFIXES) and not n.startswith(("_", "."))]
        out |= {d} if any(n.startswith("part-") for n in own) else {os.path.join(d, n) for n in own}
    return sorted(out)


def headline(spark: SparkSession, path: str) -> dict[str, int]:
    """Paragraphs, speeches and meetings of a store's units that say something;
    zeros if it has no units or annotations."""
    try:
        for t in ("units", "annotations"):
            table_schema(path, t)
    except (ValueError, sqlite3.DatabaseError):
        return {"paragraphs": 0, "speeches": 0, "meetings": 0}
    u = read_table(spark, path, "units", ["speech_id", "para_is_procedural"]).where("para_is_procedural = 0")
    meeting = F.substring_index("speech_id", "#", 1)
    return u.agg(F.count(F.lit(1)).alias("paragraphs"), F.count_distinct("speech_id").alias("speeches"), F.count_distinct(meeting).alias("meetings")).first().asDict()


def select_store(spark: SparkSession, root: str, expected: dict[str, int], tolerance: float = 0.01) -> str:
    """The store below ``root`` whose counts are all as expected; an error if none is."""
    from .tables import best_source

    return best_source({c: headline(spark, c) for c in candidates(root)}, expected, tolerance)
