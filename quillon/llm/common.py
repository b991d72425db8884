"""What the operators share: the shared folder, guarded broadcasts, components."""

from __future__ import annotations

import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word contracts of this subpackage define it.
WORD = r"[^\x20\x09-\x0D]+"
#: A broadcast is hinted only for tables counted to have at most this many rows.
BROADCAST_ROWS = 50_000
#: Between two collections of the driver's garbage: so many seconds, and so many times what the last one took. A heap
#: that is collected for more of its time is enlarged by the JVM, up to its limit.
COLLECT_SECONDS, COLLECT_SHARE = 3, 20
_collect_after = 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, in local mode
    (tests), a folder of our own. A cluster without one is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or "/tmp/checkpoints/quillon")
        _gone_at_exit(spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def _gone_at_exit(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    global _collect_after
    out = df.checkpoint(eager=True)
    # Shuffle files go when the driver collects its garbage; a long job must not wait until its heap is full.
    began = time.monotonic()
    if began >= _collect_after:
        df.sparkSession.sparkContext._jvm.System.gc()
        now = time.monotonic()
        _collect_after = now + max(COLLECT_SECONDS, COLLECT_SHARE * (now - began))
    return out


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hints a broadcast only if ``df`` (already materialised) has few rows;
    otherwise the planner is left to shuffle."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(name: str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def unnamed(df: DataFrame):
    """``df`` with columns c0, c1, ... that clash with nothing, and the new name of a column."""
    own = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*own.values()), own.__getitem__


def fingerprint(df: DataFrame) -> tuple:
    """Count and order-free digest of all rows, for convergence tests."""
    h = F.xxhash64(*df.columns)
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0))).first())


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of ``edges(src, dst)``: rows (id, component), the
    component named by its smallest id. Only ids that occur in an edge appear.

    Alternating large-star and small-star steps on DataFrames; each round is
    checkpointed in the shared folder. Minima use partial aggregation, so a hub
    with very many edges is not gathered in one task, and no link or component
    reaches the driver. Self-loops and repeated links are harmless; an empty
    input gives an empty result.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = cut(e.where("u <> v").distinct())
    before = fingerprint(e)
    for _ in range(limit):
        if before[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(star.select("x.*").where("u <> v").distinct())
        after = fingerprint(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


#: A bit sieve has 2**SIEVE_BITS bits in words of 32: 131,072 rows at most, a bound that no input changes.
SIEVE_BITS = 22


def _at(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << SIEVE_BITS))


def sieve(groups: DataFrame, *keys: str) -> DataFrame:
    """(_word, _bits): the bit of every row of ``groups`` is set."""
    at = groups.select(_at(*keys).alias("_at"))
    bit = F.expr("shiftleft(1L, cast(_at % 32 as int))")
    return at.groupBy(F.shiftright("_at", 5).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def sifted(rows: DataFrame, bits: DataFrame, *keys: str) -> DataFrame:
    """rows with a boolean _goes_on: true for all keys in the sieve, and for
    others by chance only. The sieve's size is fixed, so it is broadcast."""
    rows = rows.withColumn("_at", _at(*keys)).withColumn("_word", F.shiftright("_at", 5))
    rows = rows.join(F.broadcast(bits), "_word", "left")
    hit = F.expr("getbit(coalesce(_bits, 0L), cast(_at % 32 as int)) = 1")
    return rows.withColumn("_goes_on", hit).drop("_at", "_word", "_bits")


class Bits:
    """A broadcast set of bits for the 64-bit hashes in a column: every hash of
    it is held, others by chance only. It has 16 bits for each hash, from 2**16
    to 2**MOST in all, so it weighs 32 MB at most; beyond 2**(MOST - 4) hashes
    more of the others pass, which the exact joins behind it drop."""

    MOST, PAGE = 28, 4096

    def __init__(self, hashes: DataFrame):
        self.size = size = 1 << min(self.MOST, max(16, (16 * hashes.count()).bit_length()))
        page = self.PAGE

        def run(batches):
            own = np.zeros(size >> 3, np.uint8)
            for b in batches:
                at = b.column(0).to_numpy() & (size - 1)
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
            pages = own.reshape(-1, page)
            some = np.flatnonzero(pages.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([p.tobytes() for p in pages[some]], pa.binary())], names=["page", "bits"])

        bits = np.zeros((size >> 3) // page * page, np.uint8).reshape(-1, page)
        for r in hashes.mapInArrow(run, "page long, bits binary").toLocalIterator():
            bits[r["page"]] |= np.frombuffer(r["bits"], np.uint8)
        self.bits = hashes.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & (self.size - 1)
        return (self.bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: for rows too
    wide for a checkpoint. The table goes when the driver ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    _gone_at_exit(spark, at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, once no later step reads it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
