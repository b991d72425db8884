"""Samples to read, panels with what their gates drop, codes of names, and passages in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import numbers as num
from quillon.functions import speech as sp
from quillon.operators import evidence as ev
from quillon.operators import matrix as mx
from quillon.operators import sampling as sm
from quillon.operators.panel import gated_panel

from .base import COLUMNS, EVENT, EVENT_END, EVENT_START, MATRIX, PHASES, REGISTRY, query, table, units
from .corpus import _matrix, vtest_signature  # noqa: F401  registered before its SQL is used here

_PHASE = "CASE " + " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{z}' THEN '{p}'" for p, (a, z) in list(PHASES.items())[::-1]) + " ELSE 'outside' END"
_CARRIED = "list_filter([" + ", ".join(f"CASE WHEN {c} = 1 THEN '{c}' END" for c in COLUMNS) + "], lambda c: c IS NOT NULL)"


@query(f"""WITH {MATRIX}, v AS ({REGISTRY['vtest_signature'][1]}),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY v_test DESC NULLS LAST, code) AS i FROM v),
t AS (SELECT cluster, list(code ORDER BY i) AS codes FROM r WHERE i <= 2 AND v_test IS NOT NULL AND code NOT LIKE '%\\_ABSENT' ESCAPE '\\' GROUP BY cluster),
u AS (SELECT unit_id, bloc AS cluster, {_PHASE} AS phase, {_CARRIED} AS carried FROM matrix),
m AS (SELECT unit_id, u.cluster, phase, codes, list_filter(codes, lambda c: list_contains(carried, c)) AS matched FROM u LEFT JOIN t ON u.cluster = t.cluster),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster, phase ORDER BY md5(unit_id || '|42'), unit_id) AS i FROM m WHERE codes IS NULL OR len(matched) > 0)
SELECT cluster, phase, unit_id, coalesce(array_to_string(matched, '|'), '') AS matched FROM k WHERE i <= 20""")
def reading_sample(spark, sf):
    """Units to read of every cluster and phase, each with a signature code of its cluster."""
    m = _matrix(spark, sf, "country", "bloc", "date")
    phase = num.phase_of(F.col("date"), PHASES)
    u = m.select("unit_id", F.col("bloc").alias("cluster"), phase.alias("phase"), *COLUMNS)
    s = m.groupBy("country").agg(F.min("bloc").alias("cluster"), *[F.avg(c).alias(c) for c in COLUMNS])
    v = mx.v_tests(mx.unpivoted(s, ["cluster"], COLUMNS)).withColumn("v_test", F.round("v_test", 4))
    return sm.reading_sample(u, v, COLUMNS, seed=42, top_codes=2).select("cluster", "phase", "unit_id", "matched")


@query(f"""WITH {MATRIX}, w AS (SELECT country, segment, CASE WHEN date >= DATE '{EVENT}' THEN 1 ELSE 0 END AS post, returnflag__NONE_ABSENT = 0 AND speech_id % 3 <> 0 AS denom FROM matrix WHERE date BETWEEN DATE '{EVENT_START}' AND DATE '{EVENT_END}'),
g AS (SELECT country || '/' || segment AS g, count(*) AS n, count(DISTINCT post) AS sides FROM w WHERE denom GROUP BY 1)
SELECT (SELECT count(*) FROM w) AS rows, (SELECT count(*) FROM w WHERE NOT denom) AS dropped_denominator, count(*) AS groups, count(*) FILTER (WHERE sides < 2) AS groups_dropped,
  CAST(coalesce(sum(n) FILTER (WHERE sides < 2), 0) AS BIGINT) AS rows_dropped, CAST(coalesce(sum(n) FILTER (WHERE sides = 2), 0) AS BIGINT) AS rows_kept, (SELECT count(*) FROM w WHERE denom AND country || '/' || segment IN (SELECT g FROM g WHERE sides = 2)) AS panel_rows FROM g""")
def panel_gates(spark, sf):
    """What the gates of an event's panel dropped, observed while it was written."""
    m = _matrix(spark, sf, "country", "date", "segment", "speech_id").withColumn("place", F.concat_ws("/", "country", "segment"))
    panel, dropped = gated_panel(m, EVENT, (EVENT_START, EVENT_END), (F.col("returnflag__NONE_ABSENT") == 0) & (F.col("speech_id") % 3 != 0), group="place")
    n = panel.count()
    told = dropped()
    told.pop("skipped")
    return spark.createDataFrame([(*told.values(), n)], ", ".join(f"{k} long" for k in (*told, "panel_rows")))


_NAMES = list(sp.ISO3)
_QUOTED = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in _NAMES) + "]"
_WRITTEN = "CASE c_custkey % 6 WHEN 0 THEN n WHEN 1 THEN replace(replace(n, 'a', 'ā'), 'o', 'ő') WHEN 2 THEN concat(' ', replace(replace(n, 'e', 'é'), '''', '’'), ' ') WHEN 3 THEN replace(replace(n, 'l', 'ł'), 'u', 'ü') WHEN 4 THEN replace(lower(n), 'i', 'î') ELSE concat('Ñew ', replace(n, 'S', 'Š')) END"


@query(f"""WITH d AS (SELECT unnest({_QUOTED}) AS state, unnest({list(sp.ISO3.values())!r}) AS code),
n AS (SELECT c_custkey, {_QUOTED}[c_custkey % {len(_NAMES)} + 1] AS n FROM customer),
k AS (SELECT c_custkey, replace(strip_accents(trim({_WRITTEN})), '’', '''') AS key FROM n),
s AS (SELECT *, upper(substr(regexp_replace(key, '[^A-Za-z]', '', 'g'), 1, 3)) AS stub FROM k)
SELECT c_custkey, coalesce(code, CASE WHEN stub = '' THEN 'UNK' ELSE stub END) AS iso3 FROM s LEFT JOIN d ON state = key""")
def iso3_names(spark, sf):
    """Codes of names as they are written, with accents or none."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    c = table(spark, sf, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % len(_NAMES)).cast("int")).alias("n"))
    return sp.with_iso3(c.select("c_custkey", F.expr(_WRITTEN).alias("name")), "name").select("c_custkey", "iso3")


_NORM = lambda c: f"lower(trim(regexp_replace(translate(translate({c}, '“”„«»‘’‚', '\"\"\"\"\"''''''' ), '–—‐‑', '----'), '\\s+', ' ', 'g')))"


@query(f"""WITH p AS (SELECT item_id, {_NORM("text")} AS p FROM benchmark), d AS (SELECT doc_id, {_NORM("text")} AS t FROM documents)
SELECT item_id, doc_id FROM p, d WHERE len(string_split(p, ' ')) >= 5 AND contains(t, p)""")
def passages_found(spark, sf):
    """Benchmark passages that documents hold, whole."""
    return ev.find_passages(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "text", "doc_id", "text")


@query("SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS version, count(*) AS speeches, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS errored, CAST(ceil(count(*) FILTER (WHERE o_orderstatus <> 'F') / 950.0) AS BIGINT) AS days_left FROM orders GROUP BY 1")
def progress(spark, sf):
    """Done, pending and errored speeches of every version, and the days left at the daily budget."""
    s = F.col("o_orderstatus")
    g = table(spark, sf, "orders").groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("version")).agg(F.count(F.lit(1)).alias("speeches"), *[F.count_if(s == v).alias(n) for v, n in (("F", "done"), ("O", "pending"), ("P", "errored"))], F.count_if(s != "F").alias("left"))
    return g.select("version", "speeches", "done", "pending", "errored", F.ceil(F.col("left") / 950).cast("long").alias("days_left"))
