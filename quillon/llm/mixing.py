"""Mixing sources to target weights by a low-discrepancy schedule (native).

1. Sizes: words per row; each source's rows are laid end to end in a hashed
   order, so a row has an offset in its source's stream. Offsets are running
   sums over (source, hash slice) totals plus a running sum inside the slice,
   so a source that holds a third of all rows is still spread over many tasks.
2. Targets: sources in code point order (null last) get the weights in turn;
   shares of all words, none above ``most`` times its source's words, what is
   over going to the others by weight.
3. Schedule: slot i maps frac(i x golden ratio) through the cumulative shares
   to a source; slots are ranked per source; a source's rank r is the block
   r mod n_blocks of pass r div n_blocks over its stream. A source stops at its
   target; ranks a short schedule misses come after the last slot, and the last
   block is cut at the target.
4. Blocks join the rows that lie in them, which gives the words taken and the
   slots in which a row's turn comes. ``mixed_documents`` returns whole rows in
   the order of these slots, so any stretch of its output is mixed by the weights.

Defined cases: null text has no words and is never taken (first_slot is null); a null source is a
source; a source without words has target 0; repeated rows count on their own;
an empty table gives no rows. Reruns agree: nothing is random but hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, cut, small, text_of, unnamed

GOLDEN = 0.6180339887498949
#: A source's rows, and the slots of the schedule, are numbered in slices of about SLICE_ROWS at most.
SLICES, SLICE_ROWS = 1024, 200_000
BLOCK_WORDS = 2048


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """From (source, source_size): weight and target (double), by filling up.

    With sources in order of cap / weight, those whose cap is below their share
    of what is left are capped; the common level of the others is the largest
    level met on the way."""
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * most).cast("double"))
    by = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everyone = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    left = F.sum(F.col("source_size").cast("double")).over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / weight_left)
    s = s.withColumn("target", F.least("cap", F.max("level").over(everyone) * F.col("weight")))
    return s.select("source", "source_size", "weight", "target")


def schedule(sources: DataFrame, slots: int, step: float = GOLDEN) -> DataFrame:
    """(key, rank, slot): slot i goes to the source whose stretch low to high of
    the cumulative shares holds frac((i + 1/2) x step)."""
    spark = sources.sparkSession
    n = sources.count()
    grid = 1 << max(8, (4 * n).bit_length())
    first, last = F.floor(F.col("low") * grid), F.floor(F.col("high") * grid)
    spans = sources.where("high > low").select("key", "low", "high", F.explode(F.sequence(first, last)).alias("cell"))
    u = (F.col("id") + 0.5) * step
    tasks = max(4, min(2000, slots // 50_000))
    points = spark.range(0, slots, 1, tasks).select("id", (u - F.floor(u)).alias("u")).withColumn("cell", F.floor(F.col("u") * grid))
    spans = cut(spans)
    points = points.join(small(spans), "cell").where("u >= low and u < high").select("id", "key")
    points = points.withColumn("part", F.expr(f"id div {max(1, min(SLICE_ROWS, -(-slots // 512)))}"))
    counts = points.groupBy("key", "part").count()
    counts = counts.select("key", "part", (F.sum("count").over(W.partitionBy("key").orderBy("part")) - F.col("count")).alias("start"))
    number = F.row_number().over(W.partitionBy("key", "part").orderBy("id")) - 1
    return points.withColumn("number", number).join(counts, ["key", "part"]).select("key", (F.col("start") + F.col("number")).alias("rank"), F.col("id").alias("slot"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = (), step: float = GOLDEN) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken,
    first_slot (of the schedule, null if nothing is taken), and the columns
    named in ``carry``. ``step`` is the sequence's rotation."""
    out, _ = _mixed(docs, weights, most, id_col, text_col, source_col, block_words, carry, step)
    return out.withColumn("_slots", F.get("_slots", F.lit(0))).withColumnRenamed("_slots", "first_slot").select(id_col, "size", "source_size", "target", "taken", "first_slot", *carry)


def _mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = (), step: float = GOLDEN) -> tuple[DataFrame, int]:
    """The rows of ``mix`` with _slots, the slots of the block in which a row's
    turn begins, one for each pass, and the number of slots."""
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    held = [f"x{i}" for i in range(len(carry))]  # whatever the columns are called, they clash with nothing here
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(x) for c, x in zip(carry, held)], F.col(source_col).alias("_source"), key.alias("_key"), size.alias("_size"), F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("mix")), 2).alias("_h"))
    rows = cut(rows)
    n_rows = rows.count()
    slices = max(SLICES, n_rows // SLICE_ROWS)
    rows = rows.withColumn("_slice", F.shiftright("_h", 62 - (slices - 1).bit_length()))
    sizes = rows.groupBy("_key", F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = cut(source_targets(sizes, weights, most).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))))
    facts = sources.agg(F.sum("source_size").alias("t"), F.min(F.when(F.col("target") >= 1, F.col("target"))).alias("low"), F.sum("target").alias("all")).first()
    total = facts["t"] or 0
    block = max(1, -(-total // max(1 << 19, n_rows)), min(block_words, int((facts["low"] or 0) // 256)))

    # Where each row lies in its source's stream.
    parts = rows.groupBy("_key", "_slice").agg(F.sum("_size").alias("_sum"))
    parts = parts.select("_key", "_slice", (F.sum("_sum").over(W.partitionBy("_key").orderBy("_slice")) - F.col("_sum")).alias("_start"))
    inside = W.partitionBy("_key", "_slice").orderBy("_h", "_id", "_size")
    laid = rows.withColumn("_n", F.row_number().over(inside)).withColumn("_in", F.sum("_size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size"))
    laid = laid.join(parts, ["_key", "_slice"]).withColumn("_off", F.col("_start") + F.col("_in"))

    # The blocks that the schedule takes.
    share = F.sum("target").over(W.orderBy("key").rowsBetween(W.unboundedPreceding, 0))
    everything = float(facts["all"] or 0.0) or 1.0
    plan = sources.withColumn("high", share / everything).withColumn("low", F.col("high") - F.col("target") / everything)
    plan = plan.withColumn("blocks", F.expr(f"cast(ceil(source_size / {block}) as long)")).withColumn("goal", F.round("target").cast("long"))
    plan = plan.withColumn("passes", F.expr("if(source_size > 0, goal div source_size, 0L)"))
    plan = cut(plan.withColumn("needed", F.expr(f"cast(passes * blocks + ceil((goal - passes * source_size) / {block}) as long)")))
    slots = -(-total // block) + 16 if total else 0
    ranks = cut(schedule(plan.select("key", "low", "high"), slots, step))
    made = ranks.groupBy("key").agg(F.count(F.lit(1)).alias("made"))
    short = plan.join(made, "key", "left").withColumn("made", F.coalesce("made", F.lit(0))).where("needed > made")
    ranks = ranks.unionByName(short.select("key", F.explode(F.sequence(F.col("made"), F.col("needed") - 1)).alias("rank"), F.lit(slots).cast("long").alias("slot")))
    few = small(plan.select("key", "source_size", "blocks", "goal", "needed"))
    taken = ranks.join(few, "key").where("rank < needed")
    taken = taken.withColumn("block", F.expr("rank % blocks")).withColumn("whole", F.expr(f"least({block}L, source_size - block * {block}L)"))
    taken = taken.withColumn("words", F.expr(f"least(whole, goal - ((rank div blocks) * source_size + block * {block}L))"))
    blocks = cut(taken.groupBy("key", "block").agg(F.sum((F.col("words") == F.col("whole")).cast("long")).alias("times"), F.max(F.when(F.col("words") < F.col("whole"), F.col("words"))).alias("part"), F.array_sort(F.collect_list(F.when(F.col("words") > 0, F.col("slot")))).alias("slots")))

    # Rows in those blocks.
    empty = laid.where("_size = 0")  # kept out of the join, where they would all be one key
    pieces = laid.where("_size > 0").withColumn("block", F.explode(F.expr(f"sequence(_off div {block}, (_off + _size - 1) div {block})")))
    pieces = pieces.withColumn("_a", F.expr(f"greatest(_off, block * {block}L) - block * {block}L")).withColumn("_z", F.expr(f"least(_off + _size, (block + 1L) * {block}L) - block * {block}L"))
    pieces = pieces.join(blocks.withColumnRenamed("key", "_key"), ["_key", "block"], "left")
    words = F.expr("coalesce(times, 0L) * (_z - _a) + greatest(0L, least(coalesce(part, 0L), _z) - _a)")
    row = ["_key", "_slice", "_n"]
    kept = [F.first(c).alias(c) for c in ("_id", "_size", *held)]
    turn = F.min(F.when(F.size("slots") > 0, F.struct("block", "slots")))["slots"]
    out = pieces.groupBy(*row).agg(*kept, F.coalesce(F.sum(words), F.lit(0)).alias("taken"), turn.alias("_slots"))
    none = empty.select(*row, "_id", "_size", *held, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("array<bigint>").alias("_slots"))
    out = out.unionByName(none).join(small(sources.select(F.col("key").alias("_key"), "source_size", "target")), "_key")
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "taken", "_slots", *[F.col(x).alias(c) for c, x in zip(carry, held)]), slots


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: whole rows, each repeated as many times
    as the rounded ratio of its words taken to its words, in the order of the
    schedule (a row's k-th copy at its k-th slot); columns as they were.
    Partitions are stretches of slots."""
    plain, name = unnamed(docs)
    columns = {c: name(how.pop(c, default)) for c, default in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    marked = plain.withColumn("tag", F.xxhash64(F.col(columns["id_col"]), text_of(columns["text_col"])))
    taken, slots = _mixed(marked, **columns, **how, carry=("tag",))
    times = taken.where("size > 0").groupBy("tag").agg(F.sum("taken").alias("t"), F.max("size").alias("s"), F.count(F.lit(1)).alias("n"), F.min("_slots").alias("slots"))
    times = times.select("tag", "slots", F.expr("cast(round(t / s / n) as int)").alias("times")).where("times > 0")
    out = marked.join(times, "tag").withColumn("copy", F.explode(F.expr("sequence(1, times)")))
    out = out.withColumn("slot", F.expr("element_at(slots, least(copy, size(slots)))"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.least(F.lit(parts - 1), F.floor(F.col("slot") * parts / max(slots, 1))).cast("int")
    out = out.repartitionById(parts, stretch).sortWithinPartitions("slot", "tag", "copy")
    return out.select(*plain.columns).toDF(*docs.columns)
