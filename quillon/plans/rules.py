"""Rule sets over the paragraphs of documents. Every third paragraph is put in
quotation marks, so that verdicts can be inherited."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import rules as ru
from quillon.operators.segment import pieces

from .base import UNITS, query, table, units

#: All kinds of rules: anchored and verbose, anywhere, a ceiling of words, a second pattern, inherited, and one behind that.
RAW = [
    {"name": "opening", "flags": ["IGNORECASE", "VERBOSE"], "max_words": 40, "pattern": r"""
        (?: the | and | les | is | una? )   # words that open
        [ ,.]
        """},
    {"name": "license", "mode": "search", "pattern": r"licen[sc]e|copyright"},
    {"name": "figures", "mode": "search", "flags": [], "pattern": r"[0-9]{2,}", "require": r"[A-Z]", "max_words": 80},
    {"name": "quote", "kind": ru.INHERIT},
    {"name": "question", "mode": "search", "pattern": r"[?!|]$"},
]
RULES = ru.parse(RAW)
BLOC_MAPS = {"by_region": {"NATION_0": "west", "NATION_3": "west", "NATION_7": "east", "NATION_19": "east"}, "none": {}}

_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
_JUDGED = rf"""p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS raw FROM documents),
q AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS para_index, trim(raw) AS text FROM p WHERE trim(raw) <> ''),
t AS (SELECT doc_id, para_index, CASE WHEN para_index % 3 = 1 THEN '“' || text || '”' ELSE text END AS text FROM q),
h AS (SELECT *, {_WORDS} AS n, substr(text, 1, 1) IN ('“', '"', '‘', '''') AS quote FROM t),
m AS (SELECT *, CASE WHEN n <= 40 AND regexp_matches(text, '(?i)\A(?:the|and|les|is|una?)[ ,.]') THEN 'opening' WHEN regexp_matches(text, '(?i)licen[sc]e|copyright') THEN 'license'
  WHEN n <= 80 AND regexp_matches(text, '[0-9]{{2,}}') AND regexp_matches(text, '[A-Z]') THEN 'figures' END AS own, CASE WHEN regexp_matches(text, '[?!|]$') THEN 'question' END AS behind FROM h),
v AS (SELECT *, last_value(CASE WHEN own IS NOT NULL OR behind IS NOT NULL THEN 1 WHEN NOT quote THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS told FROM m),
j AS (SELECT doc_id, para_index, n, coalesce(own, CASE WHEN quote AND told = 1 THEN 'quote' END, behind) AS rule FROM v)"""


def _judged(spark, sf):
    p = pieces(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text", "\n")
    quoted = F.when(F.col("para_index") % 3 == 1, F.concat(F.lit("“"), "text", F.lit("”"))).otherwise(F.col("text"))
    return ru.judged(p.withColumn("text", quoted), ["doc_id"], ["para_index"], RULES)


@query(f"WITH {_JUDGED} SELECT doc_id, para_index, rule FROM j")
def paragraph_rules(spark, sf):
    """The rule that names each paragraph, null for substance."""
    return _judged(spark, sf).select("doc_id", "para_index", "rule")


@query(f"WITH {_JUDGED} SELECT doc_id, para_index, n AS n_words FROM j WHERE rule IS NULL AND n >= 15")
def substantive_paragraphs(spark, sf):
    """Paragraphs without a verdict, over the floor of words that comes after it."""
    n = tx.word_count(F.col("text")).cast("long")
    return _judged(spark, sf).where("rule is null").withColumn("n_words", n).where("n_words >= 15").select("doc_id", "para_index", "n_words")


@query(f"WITH {UNITS} SELECT CASE country WHEN 'NATION_0' THEN 'west' WHEN 'NATION_3' THEN 'west' WHEN 'NATION_7' THEN 'east' WHEN 'NATION_19' THEN 'east' END AS bloc, count(*) AS n, count(DISTINCT speech_id) AS speeches FROM units GROUP BY 1")
def bloc_counts(spark, sf):
    """Units and speeches by the blocs of a named map."""
    bloc = ru.bloc_of(F.col("country"), ru.blocs(BLOC_MAPS, "by_region"))
    return units(spark, sf).groupBy(bloc.alias("bloc")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("speech_id").alias("speeches"))
