"""Sharding by histogram sort (native DataFrame operations).

Rows are ordered by a 62-bit hash of the text, so equal texts lie together.
Groups of equal texts that weigh more than HEAVY of a shard are placed first, the
heaviest to the emptiest shard; there are at most shards / HEAVY of them. Only a
group that outweighs a whole shard is cut, into the fewest near equal pieces, by
a hash of the id. All other rows fill what room is left: the splitters between
shards are found by rounds, each of which counts the exact bytes between evenly
spaced candidate keys inside every interval that still holds an unsettled
splitter and narrows the interval to one candidate gap, until every splitter is
within the tolerance or beside a single group. Only the counts between candidates
reach the driver, at most (shards - 1) x PROBES numbers a round. The rows are
exchanged once.

Defined cases: null text weighs the overhead alone and has the crc32 of no
bytes; empty tables give no rows; repeated rows are rows like any other; equal
texts share a shard unless they outweigh one together, then they fill the fewest
shards that hold them.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, text_of

BITS = 62
PROBES = 1024
HEAVY = 0.02


def _key(*cols) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - BITS)


def _splitters(rows: DataFrame, wanted: dict[int | None, list[float]], allowed: float) -> dict[int | None, list[int]]:
    """For each text hash (None: all rows without ``heavy``) the keys below which
    the ``wanted`` bytes lie: hashes of ids inside a group, of texts otherwise."""
    # An interval: group, low end, width; its targets: number of the splitter -> bytes still to find in it.
    active = {(g, 0, 1 << BITS): dict(enumerate(want)) for g, want in wanted.items() if want}
    found: dict[int | None, dict[int, int]] = {g: {} for g in wanted}
    while active:
        cells = list(active)
        cell, gap = F.lit(None).cast("int"), F.lit(None).cast("long")
        for n, (group, lo, width) in enumerate(cells):
            k = F.col("k1") if group is None else F.col("k2")
            inside = (k >= lo) & (k < lo + width) & (F.col("heavy").isNull() if group is None else F.col("k1") == group)
            cell = F.when(inside, F.lit(n)).otherwise(cell)
            gap = F.when(inside, F.expr(f"({'k1' if group is None else 'k2'} - {lo}) div {max(1, width // PROBES)}")).otherwise(gap)
        counted = rows.select(cell.alias("cell"), gap.alias("gap"), F.when(F.col("heavy").isNull(), F.col("k1")).otherwise(F.col("k2")).alias("k"), "size").where("cell is not null")
        counted = counted.groupBy("cell", "gap").agg(F.sum("size").alias("bytes"), F.min("k").alias("low"), F.max("k").alias("high"))
        bins: dict[int, list] = {}
        for r in counted.collect():
            bins.setdefault(r["cell"], []).append(r)
        following: dict[tuple, dict[int, float]] = {}
        for n, (group, lo, width) in enumerate(cells):
            step, below = max(1, width // PROBES), 0
            todo = sorted(active[cells[n]].items(), key=lambda x: x[1])
            for r in sorted(bins.get(n, []), key=lambda r: r["gap"]):
                above, start = below + r["bytes"], lo + r["gap"] * step
                while todo and todo[0][1] <= above:
                    i, want = todo.pop(0)
                    if min(want - below, above - want) <= allowed or r["low"] == r["high"]:
                        found[group][i] = start if want - below <= above - want else start + step
                    else:
                        following.setdefault((group, start, step), {})[i] = want - below
                below = above
            for i, _ in todo:
                found[group][i] = lo + width
        active = following
    return {g: [own[i] for i in sorted(own)] for g, own in found.items()}


def _placed(heavy: list, shards: int, room: float) -> tuple[dict[int, list[int]], list[float]]:
    """The shards of each heavy group's pieces, and the bytes each shard holds then."""
    pieces = [(bytes_ / n, k, i) for k, bytes_, rows in heavy for n in [min(rows, -int(-bytes_ // room))] for i in range(n)]
    held, where = [(0.0, s) for s in range(shards)], {}
    for size, k, _ in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        load, s = heapq.heappop(held)
        where.setdefault(k, []).append(s)
        heapq.heappush(held, (load + size, s))
    return where, [load for load, _ in sorted(held, key=lambda x: x[1])]


def _filled(loads: list[float], rest: float) -> list[float]:
    """What each shard takes of ``rest`` bytes so that the loads come out equal."""
    level = 0.0
    order = sorted(loads)
    for n in range(1, len(order) + 1):  # the level at which the n emptiest shards hold all of it
        level = (sum(order[:n]) + rest) / n
        if n == len(order) or level <= order[n]:
            break
    return [max(0.0, level - x) for x in loads]


def histogram_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, tolerance: float = 0.002, heavy: float = HEAVY) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot. Shards
    hold near equal bytes; slots count from 0 without gaps in each shard."""
    raw = text_of(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), _key(raw).alias("k1"), _key(F.col(id_col), F.lit("row")).alias("k2"))
    rows = cut(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    room = total / shards
    groups = rows.groupBy("k1").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where(F.col("bytes") > heavy * room)
    big = [(r["k1"], r["bytes"], r["n"]) for r in groups.collect()]  # at most shards / heavy groups are so heavy
    where, loads = _placed(big, shards, room)
    parts = _filled(loads, total - sum(b for _, b, _ in big))
    wanted = {None: [sum(parts[: i + 1]) for i in range(shards - 1)]}
    wanted |= {k: [b * i / len(where[k]) for i in range(1, len(where[k]))] for k, b, _ in big}
    told = rows.sparkSession.createDataFrame([(k, True) for k in where], "k1 long, heavy boolean")
    splitters = _splitters(rows.join(F.broadcast(told), "k1", "left"), wanted, tolerance * room) if total else {None: []}
    told = rows.sparkSession.createDataFrame([(k, where[k], splitters[k]) for k in where], "k1 long, homes array<int>, cuts array<long>")
    own = rows.join(F.broadcast(told), "k1", "left")
    shard = F.lit(0)
    for a in splitters[None]:
        shard = shard + (F.col("k1") >= a).cast("int")
    shard = F.when(F.col("homes").isNull(), shard).otherwise(F.expr("homes[size(filter(cuts, c -> k2 >= c))]"))
    # Slots: a running count over fixed slices of each shard, then a row number in each slice.
    sliced = own.withColumn("shard", shard).drop("homes", "cuts").withColumn("slice", F.shiftright("k1", BITS - 12) * 64 + F.shiftright("k2", BITS - 6))
    sliced = sliced.repartition("shard", "slice")
    starts = sliced.groupBy("shard", "slice").count()
    starts = starts.select("shard", "slice", (F.sum("count").over(W.partitionBy("shard").orderBy("slice")) - F.col("count")).alias("start"))
    number = F.row_number().over(W.partitionBy("shard", "slice").orderBy("k1", "k2", "id")) - 1
    out = sliced.withColumn("number", number).join(starts, ["shard", "slice"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int"), (F.col("start") + F.col("number")).cast("long").alias("slot"))
