"""Unit by code matrices, fingerprints, profiles, log-ratios and signatures.

Column lists come from the codebook, never from the data, so every matrix is one
conditional aggregation without a pivot's extra job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

Codes = dict[str, tuple[str, ...]]


def column_of(dimension: str, code: str) -> str:
    return f"{dimension}__{code}"


def absent_of(dimension: str) -> str:
    return f"{dimension}__NONE_ABSENT"


def columns_of(codes: Codes) -> list[str]:
    return [c for d, own in codes.items() for c in [*(column_of(d, x) for x in own), absent_of(d)]]


def code_matrix(units: DataFrame, annotations: DataFrame, codes: Codes, key: str = "unit_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per unit: 1 where it carries a code, and an absence column for
    each dimension. ``annotations`` has a column per dimension. They are brought
    to one row per unit before the join, so the join carries no fan-out."""
    has = [F.max(F.when(F.col(d) == x, 1).otherwise(0)).alias(column_of(d, x)) for d, own in codes.items() for x in own]
    marked = annotations.groupBy(key).agg(*has)
    out = units.select(key, *keep).join(marked, key, "left")
    filled = {column_of(d, x): F.coalesce(column_of(d, x), F.lit(0)) for d, own in codes.items() for x in own}
    out = out.withColumns(filled)
    return out.withColumns({absent_of(d): 1 - F.greatest(*[F.col(column_of(d, x)) for x in own], F.lit(0)) for d, own in codes.items()})


def masked(matrix: DataFrame, annotated: Column, columns: list[str]) -> DataFrame:
    """Three values: null where the unit was never annotated."""
    return matrix.withColumns({c: F.when(annotated, F.col(c)).cast("byte") for c in columns})


def counts_by(matrix: DataFrame, group: str, columns: list[str], floor: int = 1) -> DataFrame:
    """Sums of indicators and n rows per group; groups under the floor go."""
    out = matrix.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(c) for c in columns])
    return out.where(F.col("n") >= floor)


def shares(counts: DataFrame, columns: list[str], digits: int | None = None) -> DataFrame:
    at = lambda c: F.col(c) / F.col("n") if digits is None else F.round(F.col(c) / F.col("n"), digits)
    return counts.withColumns({c: at(c) for c in columns})


def na_shares(matrix: DataFrame, group: str, columns: list[str]) -> list[Column]:
    """Share and number of rows over annotated rows only."""
    return [x for c in columns for x in (F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double")).alias(c), F.count(c).alias(f"n_annotated__{c}"))]


def clr(counts: DataFrame, codes: Codes, pseudocount: float = 0.5) -> DataFrame:
    """Centred log-ratio within each dimension's block."""
    out = {}
    for d, own in codes.items():
        cols = [*(column_of(d, x) for x in own), absent_of(d)]
        logs = {c: F.ln(F.col(c) + F.lit(pseudocount)) for c in cols}
        mean = reduce(lambda a, b: a + b, logs.values()) / len(cols)
        out |= {c: x - mean for c, x in logs.items()}
    return counts.withColumns(out)


def unpivoted(df: DataFrame, keys: list[str], columns: list[str], name: str = "code", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def v_tests(long: DataFrame, cluster: str = "cluster", code: str = "code", value: str = "value") -> DataFrame:
    """Over long (cluster, code, value) rows: cluster and corpus means, their
    ratio and the v-test under sampling without replacement; null where the
    code does not vary. The corpus moments come from (cluster, code) sums, so
    the rows are shuffled once."""
    x = F.col(value)
    g = long.groupBy(cluster, code).agg(F.count(F.lit(1)).alias("ng"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    w = W.partitionBy(code)
    n, s, q = F.sum("ng").over(w), F.sum("s").over(w), F.sum("q").over(w)
    g = g.withColumns({"n_all": n, "corpus_share": s / n, "cluster_share": F.col("s") / F.col("ng"), "var": q / n - (s / n) * (s / n)})
    spread = F.sqrt((F.col("n_all") - F.col("ng")) / (F.col("n_all") - 1) * F.col("var") / F.col("ng"))
    v = F.when((F.col("var") > 1e-15) & (F.col("n_all") > F.col("ng")), (F.col("cluster_share") - F.col("corpus_share")) / spread)
    ratio = F.when(F.col("corpus_share") != 0, F.col("cluster_share") / F.col("corpus_share"))
    return g.select(cluster, code, "cluster_share", "corpus_share", ratio.alias("ratio"), v.alias("v_test"), F.col("ng").alias("n_members"))


def ordinal(annotations: DataFrame, key: str, score: Column, how: str, index: str) -> DataFrame:
    """One score per unit: max, min, mean, or the first by annotation index."""
    agg = {"max": F.max, "min": F.min, "mean": F.avg}.get(how)
    value = agg(score) if agg else F.min_by(score, F.col(index))
    return annotations.where(score.isNotNull()).groupBy(key).agg(value.alias("score"))


def drop_equal(df: DataFrame, columns: list[str]) -> list[str]:
    """``columns`` without those that equal an earlier one in every row; one
    aggregate over all pairs of the columns, which a codebook bounds."""
    pairs = [(a, b) for i, b in enumerate(columns) for a in columns[:i]]
    if not pairs:
        return columns
    same = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    gone = {b for i, (_, b) in enumerate(pairs) if same[f"p{i}"]}
    return [c for c in columns if c not in gone]


def records(units: DataFrame, long: DataFrame, dimensions: list[str], key: str = "unit_id") -> DataFrame:
    """One row per annotation of ``long(unit_id, annotation_index, dimension,
    value, verified)`` with the dimensions, which a codebook lists, as columns;
    missing ones and units without annotations say NONE."""
    wide = long.groupBy(key, "annotation_index").agg(*[F.max(F.when(F.col("dimension") == d, F.col("value"))).alias(d) for d in dimensions], F.max("verified").alias("verified"))
    out = units.join(wide, key, "left")
    said = F.when(F.col("verified") == 1, "yes").when(F.col("verified") == 0, "NO").otherwise("")
    number = F.coalesce(F.col("annotation_index").cast("string"), F.lit(""))
    return out.select(*units.columns, number.alias("annotation_index"), *[F.coalesce(d, F.lit("NONE")).alias(d) for d in dimensions], said.alias("evidence_verified"))
