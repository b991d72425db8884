"""Operators over an order within groups: inheritance, runs, first and top rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def inherit(df: DataFrame, group: list[str], order: list, hit: Column, carries: Column, to: str) -> DataFrame:
    """A fold: a row's verdict is ``hit``, or the previous row's verdict where
    the row ``carries`` it on; the first row inherits false."""
    told = F.when(hit, True).when(~carries, False)
    at = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(to, F.coalesce(F.last(told, ignorenulls=True).over(at), F.lit(False)))


def runs(df: DataFrame, group: list[str], order: list, value: str, to: str = "run", slice_by: Column | None = None) -> DataFrame:
    """Numbers the stretches of equal neighbouring values (gaps and islands).
    ``slice_by`` never falls along the order: then each slice of a group is
    numbered on its own, and the slices, as few as they are, are stitched, so that
    a group with very many rows is many tasks."""
    df = df.withColumn("_slice", F.lit(0) if slice_by is None else slice_by)
    at = W.partitionBy(*group, "_slice").orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(at)) & F.lag(F.lit(1)).over(at).isNotNull()).cast("int")
    df = df.withColumn("_new", new).withColumn("_local", F.sum("_new").over(at.rowsBetween(W.unboundedPreceding, 0)))
    place = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    ends = df.groupBy(*group, "_slice").agg(F.min_by(F.struct(value), place).alias("_first"), F.max_by(F.struct(value), place).alias("_last"), F.max("_local").alias("_k"))
    over = W.partitionBy(*group).orderBy("_slice")
    begins = (~F.col("_first").eqNullSafe(F.lag("_last").over(over)) | F.lag(F.lit(1)).over(over).isNull()).cast("int")
    ends = ends.withColumn("_begins", begins + F.coalesce(F.lag("_k").over(over), F.lit(0)))
    keys = [*group, "_slice"]
    ends = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.sum("_begins").over(over.rowsBetween(W.unboundedPreceding, 0)).alias("_base"))
    out = df.join(ends, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]))
    return out.withColumn(to, F.col("_base") + F.col("_local")).drop("_slice", "_new", "_local", "_base", *[f"_k{i}" for i in range(len(keys))])


def islands(df: DataFrame, group: list[str], order: list, starts: Column, to: str = "island") -> DataFrame:
    """Numbers groups of rows that begin where ``starts`` holds."""
    at = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(to, F.sum(starts.cast("int")).over(at))


def turns(df: DataFrame, group: list[str], order: list, header: Column, ends: Column, label: Column, to: str = "turn_no") -> DataFrame:
    """Paragraphs with the number of the turn they belong to: a header opens a
    turn, a paragraph that ends one closes it (itself left out), and what follows
    a label is skipped unless it is a header. Paragraphs of no turn are dropped."""
    at = W.partitionBy(*group).orderBy(*order)
    so_far = at.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({"_h": header.cast("int"), "_e": (ends & ~header).cast("int"), "_l": (label & ~header).cast("int")})
    df = df.withColumn(to, F.sum("_h").over(so_far)).withColumn("_skip", F.lag("_l", 1, 0).over(at))
    over = F.max("_e").over(W.partitionBy(*group, to).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_over", over)
    return df.where((F.col(to) > 0) & (F.col("_over") == 0) & ((F.col("_h") == 1) | (F.col("_skip") == 0))).drop("_h", "_e", "_l", "_skip", "_over")


def top(df: DataFrame, group: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; the order must be total."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def joined_in_order(value: str, order: list[str], by: str, most: int | None = None) -> Column:
    """Aggregate: texts of a group joined by ``by`` in order, at most ``most``."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    texts = F.transform(rows, lambda x: x["_v"])
    return F.array_join(F.slice(texts, 1, most) if most else texts, by)


def sorted_set(value: str, by: str = "+") -> Column:
    return F.array_join(F.array_sort(F.collect_set(value)), by)


def mode_of(df: DataFrame, group: list[str], value: str, to: str = "mode") -> DataFrame:
    """The most frequent value of each group; of ties the smallest."""
    n = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(*group, F.col("b.v").alias(to), (-F.col("b.m")).alias("n"))


def cut_points(df: DataFrame, value: str, parts: int) -> list:
    """Order statistics that cut sorted values in ``parts``: the value at
    position floor(n i / parts) for i = 1 .. parts - 1 (1-based)."""
    known = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    n = known.count()
    return kth_values(known, [max(1, n * i // parts) for i in range(1, parts)]) if n else []


def kth_values(values: DataFrame, ranks: list[int], few: int = 10_000, bins: int = 512) -> list:
    """The values (column v, numbers) at 1-based ranks: rounds of counts in
    ``bins`` equal ranges narrow each rank to one range, and once a range holds
    few different values these are counted. Only counts reach the driver."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    spans = {k: (float(low), float(high), k) for k in ranks}  # the range a rank lies in, and its rank there
    found: dict[int, object] = {}
    while len(found) < len(set(ranks)):
        for k, (a, z, rank) in [x for x in spans.items() if x[0] not in found]:
            inside = values.where(F.col("v").between(a, z))
            counts = inside.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
            if a == z or counts.limit(few + 1).count() <= few:
                for r in counts.orderBy("v").collect():  # few rows
                    rank -= r["c"]
                    if rank <= 0:
                        found[k] = r["v"]
                        break
                continue
            step = (z - a) / bins
            part = F.least(F.floor((F.col("v") - a) / step), F.lit(bins - 1))
            held = inside.groupBy(part.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()  # a row for each range
            for r in held:
                if rank <= r["c"]:
                    spans[k] = (float(r["low"]), float(r["high"]), rank)
                    break
                rank -= r["c"]
    return [found[k] for k in ranks]


def tercile(df: DataFrame, value: str, to: str, names: tuple[str, ...] = ("short", "medium", "long")) -> DataFrame:
    """Named parts by cut points; equal values stay together."""
    out = F.lit(names[-1])
    for name, c in list(zip(names, cut_points(df, value, len(names))))[::-1]:
        out = F.when(F.col(value) <= c, name).otherwise(out)
    return df.withColumn(to, out)
