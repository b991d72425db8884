"""Probability samples that do not depend on partitioning: rows are drawn in the
order of a seeded hash of their key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def draw_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def stratum(*columns: str, by: str = " | ") -> Column:
    return F.concat_ws(by, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]) if columns else F.lit("ALL")


def oversample(name: Column, factors: dict[str, float], by: str = " | ") -> Column:
    """The largest factor of a code that is a whole component of the stratum, else 1."""
    parts = F.split(name, rf"\Q{by}\E")
    found = [F.when(F.array_contains(parts, c), F.lit(float(f))) for c, f in factors.items()]
    return F.coalesce(F.greatest(F.lit(None).cast("double"), F.lit(None).cast("double"), *found), F.lit(1.0))


def largest_remainder(sizes: DataFrame, n: int, weight: str = "size") -> DataFrame:
    """Adds n_h: shares of ``n`` in proportion to ``weight``, rounded down, what
    is left going to the largest remainders (ties by stratum name)."""
    all_ = W.partitionBy(F.lit(0))
    exact = F.lit(n) * F.col(weight) / F.sum(weight).over(all_)
    s = sizes.withColumn("_e", exact).withColumn("_f", F.floor("_e"))
    s = s.withColumn("_left", F.lit(n) - F.sum("_f").over(all_))
    s = s.withColumn("_r", F.row_number().over(W.orderBy((F.round(F.col("_e") - F.col("_f"), 9)).desc(), F.col("stratum"))))
    return s.withColumn("n_h", (F.col("_f") + (F.col("_r") <= F.col("_left")).cast("int")).cast("long")).drop("_e", "_f", "_left", "_r")


def allocate(sizes: dict[str, int], n: int, factors: dict[str, float] | None = None, scheme: str = "proportional") -> dict[str, int]:
    """Sample sizes of strata. The ideal shares go by size x factor (also under
    ``neyman``, for want of variances) or are ``equal``; each is rounded down and
    held to its stratum. What is left is dealt in whole rounds to all strata with
    room, found as one level, and a last part round by remainder, then name."""
    names, factors = sorted(sizes), factors or {}
    room = np.array([sizes[s] for s in names], float)
    pull = np.ones(len(names)) if scheme == "equal" else room * [factors.get(s, 1.0) for s in names]
    ideal = n * pull / (pull.sum() or 1.0)
    got = np.minimum(room, np.floor(ideal))
    left, spare = min(n, room.sum()) - got.sum(), room - got
    low, high = 0, int(spare.max(initial=0))
    while low < high:  # the highest level that what is left can fill
        middle = (low + high + 1) // 2
        low, high = (middle, high) if np.minimum(spare, middle).sum() <= left else (low, middle - 1)
    level = np.minimum(spare, low)
    last = [i for i in np.lexsort((names, np.floor(ideal) - ideal)) if spare[i] > low][: int(left - level.sum())]
    got = got + level
    got[last] += 1
    return dict(zip(names, got.astype(int).tolist()))


def draw(frame: DataFrame, key: str, allocation: DataFrame, seed: int) -> DataFrame:
    """Without replacement: the first n_h rows of each stratum in hash order,
    with inclusion probability and weight. ``allocation``: stratum, size, n_h."""
    # Rows that a hash bound with slack shuts out never reach the sort; a stratum
    # that the bound leaves short (which the slack makes next to impossible) is sorted whole.
    share = (F.col("n_h") + 8 * F.sqrt(F.col("n_h")) + 16) / F.col("size")
    held = frame.join(allocation, "stratum").withColumn("_u", F.conv(F.substring(draw_order(key, seed), 1, 12), 16, 10).cast("double") / 16.0**12)
    held = held.withColumn("_in", F.col("_u") < share)
    short = held.groupBy("stratum").agg(F.sum(F.col("_in").cast("int")).alias("_n"), F.first("n_h").alias("_need")).where("_n < _need").select("stratum", F.lit(True).alias("_whole"))
    held = held.join(short, "stratum", "left").where(F.col("_in") | F.coalesce("_whole", F.lit(False))).drop("_u", "_in", "_whole")
    at = W.partitionBy("stratum").orderBy(draw_order(key, seed), key)
    rows = held.withColumn("_r", F.row_number().over(at)).where("_r <= n_h")
    return rows.withColumn("pi", F.col("n_h") / F.col("size")).withColumn("weight", F.col("size") / F.col("n_h")).drop("_r")


def quantile_of(rows: DataFrame, value: str, parts: int) -> Column:
    """Which of ``parts`` quantiles a whole number lies in, as text: cut after the
    (m i / parts)-th smallest of m. The cuts come from counts by value, which are
    few for lengths in units; ``rows`` is read once for them."""
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")).orderBy("v").collect()  # a row for each length
    total, seen, cuts = sum(r["c"] for r in counts), 0, []
    for r in counts:
        seen += r["c"]
        while len(cuts) < parts and seen >= max(1, total * (len(cuts) + 1) // parts):
            cuts.append(r["v"])
    out = F.lit(str(parts - 1))
    for i in range(len(cuts) - 1, -1, -1):
        out = F.when(F.col(value) <= cuts[i], str(i)).otherwise(out)
    return out


def reading_sample(units: DataFrame, signatures: DataFrame, codes: list[str], seed: int, cell: int = 20, top_codes: int = 6, absent: str = "_ABSENT") -> DataFrame:
    """At most ``cell`` units of each cluster and phase, in the order of a seeded
    hash, of those that carry one of their cluster's ``top_codes`` most
    over-represented codes; with the codes they carry (matched, joined by ``|``).
    A cluster whose top codes are all of absence gives any units.

    ``units`` has unit_id, cluster, phase and an indicator for each of ``codes``;
    ``signatures`` (cluster, code, v_test) has a row a cluster and code, so its top
    codes are a small table. Ranks beyond ``cell`` are dropped before the shuffle."""
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.col("v_test").desc_nulls_last(), "code"))
    top = signatures.withColumn("_r", rank).where((F.col("_r") <= top_codes) & F.col("v_test").isNotNull() & ~F.col("code").endswith(absent))
    top = top.groupBy(F.col("cluster").alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_r", "code"))).getField("code").alias("_codes"))
    carried = F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in codes]), lambda c: c.isNotNull())
    u = units.join(F.broadcast(top), F.col("cluster").eqNullSafe(F.col("_g")), "left")
    u = u.withColumn("matched", F.filter("_codes", lambda c: F.array_contains(carried, c)))
    u = u.where(F.col("_codes").isNull() | (F.size("matched") > 0))
    at = W.partitionBy("cluster", "phase").orderBy(draw_order("unit_id", seed), "unit_id")
    u = u.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= cell)
    return u.withColumn("matched", F.coalesce(F.array_join("matched", "|"), F.lit(""))).drop("_g", "_codes", "_n")
