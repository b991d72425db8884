"""Passages found in documents that are not their source.

``find_passages`` tells which documents hold which passages, by the same check as
evidence of a paragraph (whole, or its fragments in order). A passage that a
document holds gives the document all word runs inside it, so of every passage the
run that fewest documents hold is enough to find candidates: runs of RUN words,
without the first and last word of a fragment, which a document may continue. Runs
of documents meet only those that passages have; what passes is compared in full.
No document meets a passage with which it shares no rare run, and no link is lost.

Defined cases: passages without a fragment of RUN + 2 words are left out (and are
what ``unindexed`` returns); null texts hold nothing; repeated rows count on their
own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx

RUN = 3


def _runs(words: Column, width: int) -> Column:
    """Hashes of all runs of so many words."""
    n = F.size(words) - width
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.slice(words, i + 1, width)))).otherwise(F.array().cast("array<bigint>"))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _inner(passage: Column, width: int) -> Column:
    """The runs of a passage's fragments, their outer words left out."""
    parts = F.transform(F.split(passage, r"\.\.\.|…"), lambda p: _words(p))
    inner = lambda w: F.when(F.size(w) > 2, F.slice(w, F.lit(2), F.size(w) - 2)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(parts, lambda w: _runs(inner(w), width))))


def rare_runs(passages: DataFrame, runs: DataFrame) -> DataFrame:
    """Of each passage (item, runs) the run that fewest documents hold (of rows
    doc, run); passages with a run that no document holds are in none."""
    each = passages.select("item", F.explode("runs").alias("run"))
    held = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    each = each.join(held, "run", "left")
    return each.groupBy("item").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0").drop("n")


def find_passages(passages: DataFrame, documents: DataFrame, item: str, passage: str, doc: str, text: str, width: int = RUN) -> DataFrame:
    """(item, doc): the documents that hold a passage."""
    p = passages.select(F.col(item).alias("item"), F.col(passage).alias("passage"), _inner(tx.normalise_evidence(F.col(passage)), width).alias("runs")).where(F.size("runs") > 0)
    d = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    known = p.select(F.explode("runs").alias("run")).distinct()
    # Of all runs of all documents only those of some passage are kept, before anything is counted.
    # The words are a column of their own: inside the expression of the runs they would be split anew for each.
    words = d.select("doc", _words(tx.normalise_evidence(F.col("text"))).alias("words"))
    runs = words.select("doc", F.explode(F.array_distinct(_runs(F.col("words"), width))).alias("run")).join(known, "run", "left_semi")
    near = rare_runs(p.select("item", "runs"), runs).join(runs, "run").select("item", F.col("doc").alias("near")).distinct()
    found = near.join(p.select("item", "passage"), "item").join(d, F.col("near") == F.col("doc"))
    return found.where(tx.evidence_found(F.col("passage"), F.col("text"))).select(F.col("item").alias(item), F.col("doc").alias(doc))


def unindexed(passages: DataFrame, passage: str, width: int = RUN) -> DataFrame:
    """The passages too short for the index."""
    return passages.where(F.size(_inner(tx.normalise_evidence(F.coalesce(passage, F.lit(""))), width)) == 0)
