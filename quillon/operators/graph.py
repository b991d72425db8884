"""Similarity graphs over a bounded set of groups, and comparison of partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "v", block: int = 4096) -> DataFrame:
    """The k rows most similar to each query, not itself: (src, dst, weight,
    rank); only similarities above 0 count. Both sides are dealt into blocks by
    their keys, a task multiplies a block of queries with one of rows and keeps
    the k best of each query, and these are merged; nothing is broadcast. Vectors
    that are null, zero or of another length than the query's are not near."""
    nq, nr = (max(1, -(-df.count() // block)) for df in (queries, rows))
    deal = lambda df, own, n, other, m, side: df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(side).alias("side"), F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    both = deal(queries, "qb", nq, "rb", nr, 0).unionByName(deal(rows, "rb", nr, "qb", nq, 1)).where(F.col("v").isNotNull())
    both = both.repartition("qb", "rb").sortWithinPartitions("qb", "rb", "side")
    id_type = rows.schema[key].dataType.simpleString()

    def run(batches):
        held, at = [], None
        for b in batches:
            table = b.to_pandas()
            for own, part in table.groupby(["qb", "rb"], sort=False):
                if own != at:
                    yield from _best(held, k)
                    held, at = [], own
                held.append(part)
        yield from _best(held, k)

    best = both.mapInArrow(run, f"src {id_type}, dst {id_type}, weight double")
    order = W.partitionBy("src").orderBy(F.round("weight", 9).desc(), "dst")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(parts: list[pd.DataFrame], k: int):
    """The k nearest rows (and those equal to the k-th) of each query of a block."""
    if not parts:
        return
    t = pd.concat(parts)
    for _, own in t.groupby(t["v"].map(len)):
        q, r = own[own["side"] == 0], own[own["side"] == 1]
        if not len(q) or not len(r):
            continue
        a, b = (np.stack(x["v"].to_list()).astype(float) for x in (q, r))
        with np.errstate(all="ignore"):
            w = (a @ b.T) / np.sqrt((a * a).sum(1))[:, None] / np.sqrt((b * b).sum(1))[None]
        near = np.round(np.where(np.isfinite(w) & (q["id"].to_numpy()[:, None] != r["id"].to_numpy()[None]), w, -np.inf), 9)
        floor = np.partition(near, max(0, near.shape[1] - k), axis=1)[:, max(0, near.shape[1] - k)]
        i, j = np.nonzero((near >= floor[:, None]) & (near > 0))
        yield pa.RecordBatch.from_arrays([pa.array(q["id"].to_numpy()[i]), pa.array(r["id"].to_numpy()[j]), pa.array(w[i, j])], names=["src", "dst", "weight"])


def undirected(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and the adjusted Rand index of two labellings, from one
    contingency table."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("nij"))
    rows, cols = cells.groupBy(a).agg(F.sum("nij").alias("ni")), cells.groupBy(b).agg(F.sum("nij").alias("nj"))
    one = cells.agg(two("nij").alias("ij"), F.sum("nij").alias("n")).crossJoin(rows.agg(two("ni").alias("i"))).crossJoin(cols.agg(two("nj").alias("j")))  # one row each
    expected = F.try_divide(F.col("i") * F.col("j"), F.col("n") * (F.col("n") - 1) / 2)
    middle = (F.col("i") + F.col("j")) / 2
    return one.select("n", F.when(middle == expected, 1.0).otherwise((F.col("ij") - expected) / (middle - expected)).alias("ari"))


def nesting(df: DataFrame, inner: str, outer: str) -> DataFrame:
    """For each inner group, how many outer ones it touches; nested if one."""
    return df.groupBy(inner).agg(F.count_distinct(outer).alias("n_outer"), F.count(F.lit(1)).alias("n_members")).withColumn("nested", F.col("n_outer") == 1)
