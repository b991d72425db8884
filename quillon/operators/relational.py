"""Filters driven by configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order, by a partial aggregate."""
    rest = [c for c in df.columns if c not in (*key, *order)]
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*key, *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)])


def include_when(df: DataFrame, rules: dict[str, object]) -> DataFrame:
    """Rows for which every rule's column has its value; a missing column is an
    error, not an empty result."""
    if missing := set(rules) - set(df.columns):
        raise ValueError(f"no such columns: {', '.join(sorted(missing))}")
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in rules.items()], F.lit(True)))


def corpus_rule(rule: str, least_mentions: int = 1):
    """``agenda``: on the agenda; ``agenda-or-council-terms``: or a council
    record that mentions the terms often enough."""
    on = F.col("on_agenda")
    if rule == "agenda":
        return on
    if rule == "agenda-or-council-terms":
        return on | ((F.col("series") == "S/PV") & (F.col("n_terms") >= least_mentions))
    raise ValueError(f"unknown rule {rule}")
