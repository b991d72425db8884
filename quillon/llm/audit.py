"""What five filters remove together, in every order: first-failure lookup.

A document fails some of the filters, which makes a number of five bits. In an
order of the filters it is removed at the first step whose filter it fails: a
table of 32 by 120, computed once, tells that step for every number and order.
Nothing is filtered 120 times.

1. ``failures`` reads every whole text once and gives the bits of A to D and the
   SHA-256 of the text; equal rows are counted and go on as one. E asks whether an
   equal text has a smaller id: least ids by digest, partially aggregated, joined
   back by digest and id, so that a group of copies is no key of the join.
2. ``audit`` joins the labels by id, to at most 32 rows an id and part. Each task
   counts documents by part, number and labels, the table turns the counts into
   removals by part, order and step (np.bincount), an array a part.
3. Arrays are summed place by place, and the 600 places of a part are its rows.

Defined cases: a null text is empty; a null part is the empty string; a row
without an id, or whose id is the least of its text's, does not fail E, and of
rows that share text and least id none does; a document with several labels has
the largest of each; documents without labels, and labels of no document, count
towards no loss; repeated rows count on their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, text_of

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MOST_CAPITALS = 200, 50, 3  # words, per cent of them, per cent of code points
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
NUMBERS = 1 << STEPS
PLACES = len(ORDERS) * STEPS
#: The filter of each order and step, as the place of its letter.
FILTER_AT = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
#: What a task's arrays of a part hold, one value a place.
SUMS = ("removed", "good_lost", "toxic_lost", "fails", "alone", "total")
#: Parts a task counts at a time.
PARTS = 256


def first_failures() -> np.ndarray:
    """(32, 120): the step, from 0, at which a document that fails the filters of
    a number's bits is removed in an order; STEPS if never."""
    fails = np.arange(NUMBERS)[:, None, None] >> FILTER_AT[None] & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


def text_failures(raw: bytes, code_points: int) -> int:
    """Bits of the filters A to D."""
    words = raw.split()  # of bytes: at ASCII white space
    short = len(words) < MIN_WORDS
    dull = 100 * len(set(words)) < MIN_DISTINCT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS * code_points
    signs = len(raw.translate(None, SIGNS)) < len(raw)
    return short | dull << 1 | loud << 2 | signs << 3


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, fails (the five bits) and n, the rows of ``docs`` that agree in these."""
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches):
        for b in batches:
            bits, digests = [], []
            for t, n in zip(b.column(2).cast(pa.binary()), b.column(3).to_pylist()):
                raw = t.as_py()
                bits.append(text_failures(raw, n))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "bits", "digest"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"), F.char_length(text).alias("points"))
    rows = rows.mapInArrow(read, f"id {kind}, part string, bits int, digest binary")
    rows = cut(rows.groupBy("id", "part", "bits", "digest").agg(F.count(F.lit(1)).alias("n")))
    least = rows.groupBy(F.col("digest").alias("of")).agg(F.min("id").alias("least")).where("least is not null")
    rows = rows.join(least, (F.col("digest") == F.col("of")) & (F.col("id") == F.col("least")), "left")
    fails = F.when(F.col("id").isNotNull() & F.col("of").isNull(), F.col("bits") + (1 << 4)).otherwise(F.col("bits"))
    return rows.groupBy("id", "part", fails.alias("fails")).agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """600 rows a part: part, filter_order, step, filter, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley."""
    table = first_failures()

    def arrays(counts):
        """Of counts (parts, 32, good, toxic): removals by place, all, good and
        toxic; failures of a place's filter, and of it alone; documents."""
        parts = len(counts)
        at = np.arange(parts)[:, None, None] * PLACES + np.arange(len(ORDERS)) * STEPS + table[None]
        met = np.broadcast_to(table < STEPS, at.shape)
        for kind in (counts.sum((2, 3)), counts[:, :, 1].sum(2), counts[:, :, :, 1].sum(2)):
            weights = np.broadcast_to(kind[:, :, None], at.shape)[met]
            yield np.bincount(at[met], weights, parts * PLACES).reshape(parts, PLACES)
        numbers = counts.sum((2, 3))
        fails = np.stack([numbers[:, (np.arange(NUMBERS) >> f & 1).astype(bool)].sum(1) for f in range(STEPS)], axis=1)
        alone = numbers[:, 1 << np.arange(STEPS)]
        yield from (x[:, FILTER_AT.ravel()] for x in (fails, alone))
        yield np.broadcast_to(numbers.sum(1)[:, None], (parts, PLACES))

    def told(names, counts):
        columns = [pa.array(list(x.astype(np.int64)), pa.list_(pa.int64())) for x in arrays(counts)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], names=["part", *SUMS])

    def count(batches):
        held: dict[str, int] = {}
        counts = np.zeros((PARTS, NUMBERS, 2, 2), np.int64)
        for b in batches:
            names = b.column(0).dictionary_encode()
            numbers, good, toxic, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            own = np.asarray(names.indices)
            for k, name in enumerate(names.dictionary.to_pylist()):
                if name not in held and len(held) == PARTS:
                    yield told(list(held), counts)
                    held.clear()
                    counts[:] = 0
                some = own == k
                code = (numbers[some] * 2 + good[some]) * 2 + toxic[some]
                counts[held.setdefault(name, len(held))] += np.bincount(code, n[some], NUMBERS * 4).astype(np.int64).reshape(NUMBERS, 2, 2)
        if held:
            yield told(list(held), counts[: len(held)])

    told_good, told_toxic = (F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic"))
    known = labels.select(F.col(id_col).alias("of"), "quality", "toxic").where("of is not null").groupBy("of").agg(told_good, told_toxic)
    rows = failures(docs, id_col, text_col, part_col)
    rows = rows.join(known, F.col("id") == F.col("of"), "left")
    rows = rows.select("part", "fails", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")], "n")
    sums = rows.mapInArrow(count, ", ".join(["part string", *(f"{c} array<long>" for c in SUMS)]))
    places = sums.select("part", F.posexplode(F.arrays_zip(*SUMS)).alias("place", "x")).groupBy("part", "place").agg(*[F.sum(f"x.{c}").alias(c) for c in SUMS])
    orders = F.array(*map(F.lit, ORDERS))
    out = places.withColumn("filter_order", F.get(orders, F.expr(f"place div {STEPS}").cast("int"))).withColumn("step", (F.col("place") % STEPS + 1).cast("int"))
    out = out.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    kept = F.col("total") - F.sum("removed").over(W.partitionBy("part", "filter_order").orderBy("step"))
    shapley = F.sum("removed").over(W.partitionBy("part", "filter"))
    return out.select("part", "filter_order", "step", "filter", kept.alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), F.col("alone").alias("unique_fails"), "good_lost", "toxic_lost", shapley.alias("shapley"))
