"""Exact deduplication by progressive refinement (native DataFrame operations).

Rows are grouped by byte length, then by a hash of a short prefix, then by a
full hash. A row goes on only while its group has more than one member. Which
groups go on is held in a bit sieve of fixed size, so no text is ever shuffled
and no hot group is gathered: each level costs one partially aggregated count.
A bit that two groups share only lets a row through to the next, exact level.

Defined cases: null text counts as empty, and empty texts form a group like any
other; a null id never wins against another; rows that repeat id and text share
one verdict (``drop_exact_copies`` keeps one of them); an empty table gives no
rows; other columns are left alone whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sieve, sifted, small, text_of, unnamed

PREFIX_CHARS = 256


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id (the largest id of its group),
    group_size, kept, and the columns named in ``carry``."""
    text = text_of(text_col)
    shape = [F.octet_length(text).alias("_n"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_p")]
    heads = cut(docs.select(*shape))
    lengths = heads.groupBy("_n").count().where("count > 1")
    heads = sifted(heads, sieve(lengths, "_n"), "_n").where("_goes_on")
    prefixes = heads.groupBy("_n", "_p").count().where("count > 1")
    bits = sieve(prefixes, "_n", "_p")

    held = [f"x{i}" for i in range(len(carry))]  # whatever the columns are called, they clash with nothing here
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(x) for c, x in zip(carry, held)], text.alias("_text"), *shape)
    rows = sifted(rows, bits, "_n", "_p")
    # The full content is hashed for survivors alone; the others get a key that nothing shares.
    full = F.when(F.col("_goes_on"), F.unhex(F.sha2("_text", 256)))
    rows = cut(rows.withColumn("_full", full).withColumn("_spread", F.when(~F.col("_goes_on"), F.xxhash64("_id", "_n", "_p")).otherwise(F.lit(0))).drop("_text", "_goes_on"))
    groups = rows.where("_full is not null").groupBy("_n", "_p", "_full").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    groups = small(cut(groups.withColumn("_spread", F.lit(0).cast("long"))))
    keys = ["_n", "_p", "_full"]
    out = rows.join(groups, [*keys, "_spread"], "left")
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), *[F.col(x).alias(c) for c, x in zip(carry, held)])


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    plain, name = unnamed(docs)
    marked = plain.withColumn("tag", F.xxhash64(F.col(name(id_col)), text_of(name(text_col))))
    told = cut(exact_groups(marked, name(id_col), name(text_col), carry=("tag",)))
    losers = told.where("not kept").select("tag").distinct()
    twice = cut(told.where("kept and group_size > 1").groupBy("tag").count().where("count > 1").select("tag"))
    rest = marked.join(losers, "tag", "left_anti")
    if not twice.isEmpty():
        lone = rest.join(twice, "tag", "left_anti")
        rest = lone.unionByName(rest.join(twice, "tag", "left_semi").dropDuplicates(["tag"]))
    return rest.select(*plain.columns).toDF(*docs.columns)
