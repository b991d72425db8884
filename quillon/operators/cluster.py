"""Clustering of group profiles: choice of k, bootstrap stability, alignment.

Profiles have one row per group (countries); replicates are independent tasks:
each draws its own counts from the same bounded design with its own seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import stats


def clr_matrix(counts: np.ndarray, blocks: list[slice], pseudocount: float = 0.5) -> np.ndarray:
    logs = np.log(counts + pseudocount)
    return np.hstack([logs[:, b] - logs[:, b].mean(1, keepdims=True) for b in blocks])


def design(matrix: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Units by (group, pattern of codes): all a bootstrap needs, of a size that
    patterns bound, not units."""
    return matrix.groupBy(group, *columns).agg(F.count(F.lit(1)).alias("n"))


def resampled(patterns: pd.DataFrame, group: str, columns: list[str], seed: int) -> tuple[list, np.ndarray]:
    """Counts after drawing each group's units with replacement: multinomial
    over its patterns."""
    g = np.random.default_rng(seed)
    names, rows = [], []
    for name, own in patterns.sort_values([group, *columns]).groupby(group):
        n = own["n"].to_numpy()
        rows.append(g.multinomial(n.sum(), n / n.sum()) @ own[columns].to_numpy())
        names.append(name)
    return names, np.array(rows, float)


def replicates(spark: SparkSession, patterns: pd.DataFrame, group: str, columns: list[str], blocks: list[slice], ks: list[int], times: int, seed: int = 42) -> DataFrame:
    """(k, replicate, group, label): Ward labels of every resample."""
    shared = spark.sparkContext.broadcast(patterns)

    def run(batches):
        for pdf in batches:
            for k, r in zip(pdf["k"], pdf["replicate"]):
                names, counts = resampled(shared.value, group, columns, seed * 100_003 + int(r))
                labels = stats.cut_tree(stats.ward(clr_matrix(counts, blocks)), int(k))
                yield pd.DataFrame({"k": k, "replicate": r, group: names, "label": labels})

    tasks = spark.createDataFrame([(k, r) for k in ks for r in range(times)], "k int, replicate int")
    return tasks.repartition(min(200, len(ks) * times)).mapInPandas(run, f"k int, replicate int, {group} string, label int")


def stability(labels: DataFrame, base: DataFrame, group: str) -> DataFrame:
    """Per base cluster: mean and population sd of the best Jaccard over
    replicates, and the share of replicates at 0.75 or more."""
    both = labels.join(base.withColumnRenamed("label", "cluster"), group)
    cell = both.groupBy("replicate", "cluster", "label").agg(F.count(F.lit(1)).alias("both"))
    own = base.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("own"))
    other = labels.groupBy("replicate", "label").agg(F.count(F.lit(1)).alias("other"))
    j = cell.join(own, "cluster").join(other, ["replicate", "label"]).withColumn("j", F.col("both") / (F.col("own") + F.col("other") - F.col("both")))
    best = j.groupBy("replicate", "cluster").agg(F.max("j").alias("j"))
    return best.groupBy("cluster").agg(F.avg("j").alias("mean_jaccard"), F.stddev_pop("j").alias("sd_jaccard"), F.avg((F.col("j") >= 0.75).cast("double")).alias("share_075"))


def co_clustering(labels: DataFrame, group: str) -> DataFrame:
    """How often two groups share a label, as a share of replicates."""
    times = labels.select("replicate").distinct().count()
    a, b = labels.withColumnRenamed(group, "a"), labels.withColumnRenamed(group, "b")
    return a.join(b, ["replicate", "label"]).groupBy("a", "b").agg((F.count(F.lit(1)) / F.lit(times)).alias("share"))


def choose_k(x: np.ndarray, ks: range, unstable: dict[int, int]) -> int:
    """Largest silhouette among ks without unstable clusters or singletons, else
    among all; ties to the smallest."""
    tree = stats.ward(x)
    score, single = {}, {}
    for k in ks:
        labels = stats.cut_tree(tree, k)
        score[k] = float(stats.silhouette(x, labels).mean())
        single[k] = int((np.bincount(labels)[1:] == 1).sum())
    good = [k for k in ks if not unstable.get(k, 0) and not single[k]] or list(ks)
    return max(good, key=lambda k: (score[k], -k))


def align(phase: np.ndarray, phase_labels: np.ndarray, pooled: np.ndarray, pooled_labels: np.ndarray) -> dict[int, int]:
    """Phase cluster -> pooled cluster by least total centroid distance; those
    left over go to the nearest."""
    own, all_ = np.unique(phase_labels), np.unique(pooled_labels)
    a = np.array([phase[phase_labels == c].mean(0) for c in own])
    b = np.array([pooled[pooled_labels == c].mean(0) for c in all_])
    to = stats.assignment(np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)))
    return {int(c): int(all_[t]) for c, t in zip(own, to)}
