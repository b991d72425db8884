"""Event panels and regressions with group effects and clustered errors.

Everything that grows with the data is a sum: the within transformation and the
moments are aggregations, and only matrices of 3 x 3 and one score row per group
come to the driver."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.functions.numbers import months_since

REGRESSORS = ["post", "m", "post_m"]


def event_window(event: str, bounds: list[str], days: int = 180) -> tuple[str, str]:
    """From ``days`` before the event to ``days`` after it, or to the next phase
    bound if that comes sooner."""
    e = date.fromisoformat(event)
    after = [date.fromisoformat(b) for b in bounds if date.fromisoformat(b) > e]
    return str(e - timedelta(days)), str(min([e + timedelta(days), *after]))


def build_panel(units: DataFrame, event: str, window: tuple[str, str], group: str = "country", day: str = "date") -> DataFrame:
    """Rows of the window with post, m (months since) and post_m, for groups
    seen on both sides."""
    p = units.where(F.col(day).between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")))
    p = p.withColumn("post", (F.col(day) >= F.lit(event).cast("date")).cast("int")).withColumn("m", months_since(F.col(day), event))
    p = p.withColumn("post_m", F.col("post") * F.col("m"))
    both = p.groupBy(group).agg(F.count_distinct("post").alias("_s")).where("_s = 2").select(group)
    return p.join(both, group, "left_semi")


def gated_panel(units: DataFrame, event: str, window: tuple[str, str], in_denominator: Column, span: tuple[str, str] | None = None, group: str = "country", day: str = "date") -> tuple[DataFrame, Callable[[], dict]]:
    """The panel of rows in the denominator, and what the gates dropped. The counts
    are observed in the pass that makes the panel: call the second result after
    the panel has been run or written. With ``span`` (of one model), a window that
    leaves it, clipped to the days there are, is skipped: no rows, and why."""
    lo, hi = (F.lit(x).cast("date") for x in window)
    seen, sides = Observation(), Observation()
    if span is not None:
        days = units.agg(F.min(day).alias("a"), F.max(day).alias("z")).first()
        a, z = (str(x) for x in (max(days["a"], date.fromisoformat(window[0])), min(days["z"], date.fromisoformat(window[1]))))
        if not (span[0] <= a and z <= span[1]):
            why = f"window {a}..{z} leaves the span {span[0]}..{span[1]}"
            return build_panel(units.where(F.lit(False)), event, window, group, day), lambda: {"skipped": why}
        units = units.where(F.col(day).between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")))
    inside = units.where(F.col(day).between(lo, hi)).withColumn("_denom", F.coalesce(in_denominator, F.lit(False)))
    kept = inside.where("_denom").drop("_denom").withColumn("post", (F.col(day) >= F.lit(event).cast("date")).cast("int"))
    # The rows are counted on the way to the groups alone: the panel reads them a second time.
    counted = inside.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_denom").alias("in_denominator")).where("_denom").withColumn("post", (F.col(day) >= F.lit(event).cast("date")).cast("int"))
    groups = counted.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min("post").alias("_low"), F.max("post").alias("_high"))
    both = F.col("_low") < F.col("_high")
    groups = groups.observe(sides, F.count(F.lit(1)).alias("groups"), F.count_if(both).alias("groups_kept"), F.coalesce(F.sum(F.when(both, F.col("_n"))), F.lit(0)).alias("rows_kept"))
    panel = kept.withColumn("m", months_since(F.col(day), event)).withColumn("post_m", F.col("post") * F.col("m"))
    panel = panel.join(groups.where(both).select(group), group, "left_semi")

    def dropped() -> dict:
        a, b = seen.get, sides.get
        return {"skipped": None, "rows": a["rows"], "dropped_denominator": a["rows"] - a["in_denominator"], "groups": b["groups"], "groups_dropped": b["groups"] - b["groups_kept"], "rows_dropped": a["in_denominator"] - b["rows_kept"], "rows_kept": b["rows_kept"]}

    return panel, dropped


def cells(panel: DataFrame, group: str = "country", day: str = "date", y: str = "y") -> DataFrame:
    """Group-meeting cells: mean y, rows as weight, post and mean months."""
    out = panel.groupBy(group, day).agg(F.avg(y).alias(y), F.count(F.lit(1)).alias("w"), F.max("post").alias("post"), F.avg("m").alias("m"))
    return out.withColumn("post_m", F.col("post") * F.col("m"))


def linear(panel: DataFrame, group: str = "country", y: str = "y", weight: str | None = None) -> dict:
    """y on post, m and post_m with group effects; errors clustered by group
    with the small-sample factor, the effects counted as parameters."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    p = panel.select(group, w.alias("_w"), *[F.col(c).cast("double").alias(c) for c in (y, *REGRESSORS)])
    # One aggregate of moments; the within transformation is S_ab - S_a S_b / S_w in each group.
    pairs = [(a, b) for i, a in enumerate(REGRESSORS) for b in (*REGRESSORS[i:], y)]
    single = [F.sum(F.col("_w") * F.col(c)).alias(c) for c in (y, *REGRESSORS)]
    double = [F.sum(F.col("_w") * F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs]
    own = p.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), *single, *double).collect()  # one row for each group
    if len(own) < 2:
        raise ValueError("a clustered regression needs two groups")
    within = lambda r, a, b: r[f"{a}*{b}"] - r[a] * r[b] / r["w"]
    k = len(REGRESSORS)
    each = np.array([[[within(r, *sorted((a, b), key=REGRESSORS.index)) for b in REGRESSORS] for a in REGRESSORS] for r in own])
    xy = np.array([[within(r, a, y) for a in REGRESSORS] for r in own])
    xtx, xty = each.sum(0), xy.sum(0)
    beta = np.linalg.solve(xtx, xty)
    n = sum(r["n"] for r in own)
    beta, se = stats.clustered(xtx, xty, xy - each @ beta, n, k + len(own))
    return {"n": n, "groups": len(own), "coef": dict(zip(REGRESSORS, beta.tolist())), "interval": {c: (b - 1.96 * s, b + 1.96 * s) for c, b, s in zip(REGRESSORS, beta.tolist(), se.tolist())}, "se": dict(zip(REGRESSORS, se.tolist())), "p": {c: stats.normal_p(b, s) for c, b, s in zip(REGRESSORS, beta, se)}}


def logistic(panel: DataFrame, group: str = "country", day: str = "date", y: str = "y") -> dict | None:
    """The same right side in a logit with group dummies, on (group, day, y)
    cells, which carry all of the likelihood."""
    c = panel.groupBy(group, day, "post", "m", y).agg(F.count(F.lit(1)).alias("w")).toPandas()
    c = c.sort_values([group, day, y])
    varied = c.groupby(group)[y].transform("nunique") > 1  # the others have no finite effect
    c = c[varied]
    if not len(c):
        return None
    names = sorted(c[group].unique())
    x = np.column_stack([c["post"], c["m"], c["post"] * c["m"], *[(c[group] == g).astype(float) for g in names]]).astype(float)
    beta = stats.logit(x, c[y].to_numpy(float), c["w"].to_numpy(float))
    return None if beta is None else {"n": int(c["w"].sum()), "groups": len(names), "coef": dict(zip(REGRESSORS, beta[:3].tolist()))}
