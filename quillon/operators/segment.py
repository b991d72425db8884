"""Texts to paragraphs, and units with stable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx

from .rules import Rule, bloc_of, judged


def pieces(df: DataFrame, keys: list[str], text: str = "text", separator: str = r"\n\s*\n") -> DataFrame:
    """One row per paragraph, numbered over the ones that are not blank."""
    return df.select(*keys, F.posexplode(tx.paragraphs(F.col(text), separator)).alias("para_index", text))


def units_of(turns: DataFrame, rules: list[Rule], min_words: int = 15, separator: str = r"\n\s*\n", blocs: dict[str, str] | None = None) -> DataFrame:
    """Turns (doc_symbol, turn_index, speech, …) to units: paragraphs with the
    rule that makes them procedural, if one does, and with ``blocs`` their
    country's bloc; the word floor comes after the verdict, so dropped rows leave
    gaps in para_index."""
    t = turns.withColumn("speech_id", F.concat_ws("#", "doc_symbol", F.col("turn_index").cast("string"))).withColumn("text", F.col("speech"))
    rest = [c for c in ("country", "ambassador_name", "role", "language", "meeting_date") if c in turns.columns]
    p = pieces(t, ["speech_id", *rest], "text", separator).withColumn("n_words", tx.word_count(F.col("text")))
    p = judged(p, ["speech_id"], ["para_index"], rules).withColumn("para_is_procedural", F.col("rule").isNotNull().cast("int")).where(F.col("n_words") >= min_words)
    if blocs is not None:
        p = p.withColumn("bloc", bloc_of(F.col("country"), blocs))
    return p.withColumn("unit_id", tx.hash_id(F.col("speech_id"), F.col("para_index"), tx.normalise_for_hash(F.col("text"))))
