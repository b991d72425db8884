"""Queries over speakers, phases, model spans, the job store's verbs and alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillon.functions import numbers as num
from quillon.functions import speech as sp
from quillon.operators import monitor as mon
from quillon.operators import ordered as od
from quillon.operators import phases as ph
from quillon.operators import relational as rel
from quillon.operators import sampling as sm
from quillon.operators import store as st

from .base import MATRIX, PHASES, UNITS, annotations, query, table, units
from .corpus import _PHASE, _TRAJ, _labels, _matrix

# Orders as paragraphs of speeches (one a customer), with sentences that need the detector.
_SAYS = (
    "Thank you. I have the honour to deliver this statement on behalf of the Arab Group.",
    "We align ourselves with the statement to be delivered on behalf of the European Union.",
    "I have the pleasure to speak. We thank those who spoke on behalf of the Non-Aligned Movement.",
    "I shall now resume my functions as President of the Council.",
    "We associate ourselves with remarks on behalf of the African Union! I am speaking on behalf of the Nordic countries and, on behalf of the OIC, too.",
)
_SAID = "CASE " + " ".join(f"WHEN o_orderkey % 97 = {n} THEN '{s}'" for n, s in enumerate(_SAYS)) + " ELSE 'Paragraph of ' || o_orderpriority || '.' END"
_ROLE = "CASE WHEN o_custkey % 11 = 0 THEN 'official/briefer' WHEN o_custkey % 5 = 0 THEN 'president' WHEN o_custkey % 7 = 0 THEN 'guest' ELSE 'representative' END"
_PARAGRAPHS = f"""paras AS (
  SELECT o_orderkey AS unit_id, o_custkey AS speech_id, o_orderkey % 8 AS para_index, {_ROLE} AS role, {_SAID} AS text FROM orders)"""
_BEHALF = r"on behalf of (?:the\s+)?(" + sp.GROUPS + ")"
_GROUP_SQL = f"""{_PARAGRAPHS},
opening AS (SELECT speech_id, string_agg(text, ' ' ORDER BY para_index, unit_id) AS text FROM paras WHERE para_index <= 2 GROUP BY speech_id),
sentence AS (
  SELECT speech_id, unnest(string_split_regex(text, '[.!?]')) AS s, generate_subscripts(string_split_regex(text, '[.!?]'), 1) AS i FROM opening),
hit AS (
  SELECT speech_id, i, unnest(range(1, 1 + len(regexp_extract_all(s, '(?i){_BEHALF}', 0)))) AS k, s,
    regexp_extract_all(s, '(?i){_BEHALF}', 0) AS told, regexp_extract_all(s, '(?i){_BEHALF}', 1) AS names,
    string_split_regex(s, '(?i){_BEHALF.replace('(' + sp.GROUPS, '(?:' + sp.GROUPS)}') AS around FROM sentence),
head AS (
  SELECT speech_id, i, k, names[k] AS grp,
    array_to_string(list_transform(range(1, k + 1), lambda j: CASE WHEN j > 1 THEN told[j - 1] ELSE '' END || around[j]), '') AS before FROM hit),
grp AS (
  SELECT speech_id, arg_min(grp, i * 1000 + k) AS grp FROM head
  WHERE regexp_matches(before, '(?i){sp.DELIVERS}') AND NOT regexp_matches(before, '(?i){sp.ALIGNS}') GROUP BY speech_id)"""


def _paragraphs(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("speech_id"), (F.col("o_orderkey") % 8).alias("para_index"), F.expr(_ROLE).alias("role"), F.expr(_SAID).alias("text"))


def _groups(spark, sf):
    opening = _paragraphs(spark, sf).where("para_index <= 2").groupBy("speech_id").agg(od.joined_in_order("text", ["para_index", "unit_id"], " ").alias("text"))
    return opening.select("speech_id", sp.group_of(F.col("text")).alias("grp")).where("grp is not null")


@query(f"WITH {_GROUP_SQL} SELECT * FROM grp")
def group_delivery(spark, sf):
    """Speeches delivered for a group, from the sentences of their openings."""
    return _groups(spark, sf)


_NATIONAL = f"""national AS (
  SELECT speech_id, min(role) AS role, count(*) >= 4 OR bool_or(regexp_matches(text, '(?i){sp.NATIONAL}')) AS national FROM paras GROUP BY speech_id)"""


@query(f"""WITH {_GROUP_SQL}, {_NATIONAL}
SELECT speaker_class, bloc, count(*) AS n FROM (
  SELECT CASE WHEN role = 'official/briefer' THEN 'briefer' WHEN n_nationkey IN (3, 8) THEN 'party' WHEN grp IS NOT NULL THEN 'group_rep'
    WHEN r_name = 'AFRICA' THEN 'other_invitee' WHEN role = 'president' AND national THEN 'member_state' WHEN role = 'president' THEN 'presiding'
    WHEN role = 'representative' AND n_nationkey <> 5 THEN 'member_state' ELSE 'other_invitee' END AS speaker_class, r_name AS bloc
  FROM national s JOIN customer ON s.speech_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN grp ON grp.speech_id = s.speech_id) GROUP BY ALL""")
def speaker_classes(spark, sf):
    """All seven branches: roles, parties, groups, observers, presidents, blank countries."""
    p = _paragraphs(spark, sf)
    speech = p.groupBy("speech_id").agg(F.min("role").alias("role"), ((F.count(F.lit(1)) >= sp.NATIONAL_PARAGRAPHS) | F.bool_or(sp.in_national_capacity(F.col("text")))).alias("national"))
    place = F.broadcast(table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")))
    where = table(spark, sf, "customer").select(F.col("c_custkey").alias("speech_id"), "c_nationkey").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    s = speech.join(where, "speech_id").join(_groups(spark, sf), "speech_id", "left")
    bloc, country = F.when(F.col("r_name") == "AFRICA", "OBSERVER").otherwise(F.col("r_name")), F.when(F.col("n_nationkey") == 5, " ").otherwise(F.col("n_name"))
    c = sp.speaker_class(F.col("role"), F.col("n_nationkey").isin(3, 8).cast("int"), F.col("grp").isNotNull(), bloc, F.col("national"), country)
    return s.groupBy(c.alias("speaker_class"), F.col("r_name").alias("bloc")).agg(F.count(F.lit(1)).alias("n"))


_NAMED = ("first", "second", "third")


@query(f"""WITH {UNITS}, p AS (
  SELECT CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' THEN 'P1_first'
    WHEN date BETWEEN DATE '1997-01-01' AND DATE '1999-01-05' THEN 'P2-P3_second_to_third' ELSE 'outside' END AS phase, date FROM units)
SELECT phase, count(*) AS paragraphs, count(DISTINCT date) AS meetings FROM p GROUP BY phase""")
def phase_merge(spark, sf):
    """The last phase has five days, under the floor of eight meetings, so it is joined to its neighbour."""
    u = units(spark, sf).withColumn("meeting_id", F.col("date"))
    spans = {**PHASES, "P3": ("1999-01-01", "1999-01-05")}
    given = [ph.Phase(f"{p}_{n}", dt.date.fromisoformat(a), dt.date.fromisoformat(z)) for n, (p, (a, z)) in zip(_NAMED, spans.items())]
    days = [tuple(r) for r in ph.by_day(u).collect()]  # one row a day of the calendar
    now = {p.name: (p.start.isoformat(), p.end.isoformat()) for p in ph.merged_phases(days, given, meetings=8, paragraphs=20)}
    return u.groupBy(num.phase_of(F.col("date"), now).alias("phase")).agg(F.count(F.lit(1)).alias("paragraphs"), F.count_distinct("meeting_id").alias("meetings"))


_MODEL = "CASE WHEN o_orderdate < TIMESTAMP '1994-06-01' OR o_orderkey % 10 = 0 THEN 'm1' WHEN o_orderdate < TIMESTAMP '1997-09-01' THEN 'm2' ELSE 'm1' END"
_RUNS = f"""mm AS (SELECT o_orderkey AS unit_id, CAST(o_orderdate AS DATE) AS date, {_MODEL} AS model FROM orders),
modal AS (SELECT date, model FROM (SELECT date, model, count(*) AS n FROM mm GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY date ORDER BY n DESC, model) = 1),
numbered AS (SELECT *, CASE WHEN model IS DISTINCT FROM lag(model) OVER (ORDER BY date) THEN 1 ELSE 0 END AS new FROM modal),
runs AS (SELECT run, model, min(date) AS a, max(date) AS z, count(*) AS meetings FROM (SELECT *, sum(new) OVER (ORDER BY date) AS run FROM numbered) GROUP BY run, model),
told AS (
  SELECT run, runs.model AS model, a, z, meetings, count(*) AS total, count(CASE WHEN mm.model = runs.model THEN 1 END) AS own
  FROM runs JOIN mm ON mm.date BETWEEN a AND z GROUP BY ALL)"""


def _unit_models(spark, sf):
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    return o.select(F.col("o_orderkey").alias("unit_id"), F.expr(_MODEL).alias("model"), day.alias("meeting_id"), day.alias("date"))


@query(f"WITH {_RUNS} SELECT CAST(run AS BIGINT) AS run, model, a AS start, z AS \"end\", meetings, total, own, round(own / total, 6) AS purity FROM told")
def model_run_table(spark, sf):
    return ph.model_runs(_unit_models(spark, sf)).withColumn("purity", F.round("purity", 6))


@query(f"WITH {_RUNS} SELECT model, a AS start, z AS \"end\", meetings, own, round(own / total, 6) AS purity FROM told ORDER BY own DESC, a LIMIT 1")
def model_span(spark, sf):
    """The span that one model annotated nearly alone (one row: the best run)."""
    return ph.model_span(_unit_models(spark, sf)).select("model", "start", "end", "meetings", "own", F.round("purity", 6).alias("purity"))


@query(f"""WITH {_RUNS}, best AS (SELECT * FROM told ORDER BY own DESC, a LIMIT 1)
SELECT count(*) AS n, count(CASE WHEN mm.date >= DATE '1996-03-01' THEN 1 END) AS n_post, min(mm.date) AS first_day, max(mm.date) AS last_day
FROM mm, best WHERE mm.date BETWEEN greatest(DATE '1995-09-03', a) AND least(DATE '1996-08-28', z)""")
def span_clipped_window(spark, sf):
    """An event's window, clipped to the model's span; nothing if the event is outside."""
    best = ph.model_span(_unit_models(spark, sf)).collect()[0]  # one row
    window = ph.clipped(best["start"], best["end"], dt.date(1996, 3, 1), dt.date(1995, 9, 3), dt.date(1996, 8, 28))
    u = _unit_models(spark, sf)
    u = u.where(F.col("date").between(*[F.lit(x) for x in window])) if window else u.limit(0)
    return u.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("date") >= F.lit(dt.date(1996, 3, 1)), 1)).alias("n_post"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query(f"""{_TRAJ}, pairs AS (
  SELECT a.phase || '-' || b.phase AS step, a.label AS x, b.label AS y FROM top a JOIN top b ON a.country = b.country AND (a.phase, b.phase) IN (('P1', 'P2'), ('P2', 'P3'))),
cells AS (SELECT step, x, y, count(*) AS n FROM pairs GROUP BY ALL),
t AS (SELECT step, sum(n) AS n, sum(n * (n - 1) / 2) AS same, sum(CASE WHEN x = y THEN n ELSE 0 END) AS equal FROM cells GROUP BY step),
l AS (SELECT step, sum(n * (n - 1) / 2) AS v FROM (SELECT step, x, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY step),
r AS (SELECT step, sum(n * (n - 1) / 2) AS v FROM (SELECT step, y, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY step)
SELECT t.step, CAST(n AS BIGINT) AS shared, round(CASE WHEN (l.v + r.v) / 2 = l.v * r.v / (n * (n - 1) / 2) THEN 1.0
  ELSE (same - l.v * r.v / (n * (n - 1) / 2)) / ((l.v + r.v) / 2 - l.v * r.v / (n * (n - 1) / 2)) END, 6) AS ari, round(equal / n, 6) AS same_label
FROM t JOIN l ON t.step = l.step JOIN r ON t.step = r.step WHERE n >= 3""")
def consecutive_ari(spark, sf):
    """Agreement of the labels of neighbouring phases over the countries in both."""
    labels, out = _labels(spark, sf), []
    for a, b in zip(list(PHASES), list(PHASES)[1:]):
        side = lambda p, to: labels.where(F.col("phase") == p).select("country", F.col("label").alias(to))
        out.append(ph.agreement_index(side(a, "x").join(side(b, "y"), "country"), "x", "y").withColumn("step", F.lit(f"{a}-{b}")))
    both = out[0].unionByName(out[1]).where("n >= 3")
    return both.select("step", F.col("n").alias("shared"), F.round("ari", 6).alias("ari"), F.round("same_label", 6).alias("same_label"))


@query(f"""WITH {UNITS}, x AS (SELECT country, CASE WHEN avg(price) > 140000 THEN 1 ELSE 2 END AS a, CASE WHEN count(*) % 2 = 0 THEN 1 ELSE 2 END AS b FROM units GROUP BY country)
SELECT round(greatest(avg(CAST(a = b AS INTEGER)), 1 - avg(CAST(a = b AS INTEGER))), 6) AS agreement FROM x""")
def best_matching_agreement(spark, sf):
    x = units(spark, sf).groupBy("country").agg(F.when(F.avg("price") > 140000, 1).otherwise(2).alias("a"), F.when(F.count(F.lit(1)) % 2 == 0, 1).otherwise(2).alias("b"))
    return x.agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("s")).select(F.round(ph.best_agreement(F.col("s"), 2), 6).alias("agreement"))


@query(f"WITH {UNITS}, c AS (SELECT {_PHASE} AS phase, count(DISTINCT country) AS n FROM units GROUP BY 1) SELECT phase, n AS countries, n >= 9 AS clustered FROM c")
def phase_size_gate(spark, sf):
    """Phases with too few countries for the largest number of clusters are left out."""
    c = units(spark, sf).groupBy(num.phase_of(F.col("date"), PHASES).alias("phase")).agg(F.count_distinct("country").alias("countries"))
    return c.withColumn("clustered", F.col("countries") >= 9)


def _outcome(any_code: bool) -> str:
    return "WHERE returnflag__NONE_ABSENT = 0" if any_code else ""


@query(f"""WITH {MATRIX}
SELECT country, 'all paragraphs' AS denominator, count(*) AS n, CAST(sum(returnflag__R) AS BIGINT) AS hits FROM matrix GROUP BY country
UNION ALL SELECT country, 'with any', count(*), CAST(sum(returnflag__R) AS BIGINT) FROM matrix {_outcome(True)} GROUP BY country""")
def outcome_denominators(spark, sf):
    """Outcome flags over all units, and over units with any code of the dimension."""
    m = _matrix(spark, sf, "country").withColumn("denominator", F.explode(F.when(F.col("returnflag__NONE_ABSENT") == 0, F.array(F.lit("all paragraphs"), F.lit("with any"))).otherwise(F.array(F.lit("all paragraphs")))))
    return m.groupBy("country", "denominator").agg(F.count(F.lit(1)).alias("n"), F.sum("returnflag__R").alias("hits"))


@query(f"""WITH {UNITS}, s AS (SELECT country, count(*) AS n, CASE WHEN avg(price) > 140000 THEN 'high' ELSE 'low' END AS cluster FROM units GROUP BY country)
SELECT cluster, count(*) AS size, CAST(sum(n) AS BIGINT) AS paragraphs, string_agg(country, ', ' ORDER BY country) AS members FROM s GROUP BY cluster""")
def cluster_members(spark, sf):
    s = units(spark, sf).groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.when(F.avg("price") > 140000, "high").otherwise("low").alias("cluster"))
    return s.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("paragraphs"), F.array_join(F.array_sort(F.collect_list("country")), ", ").alias("members"))  # one row a country


@query("SELECT l_linestatus AS codebook, count(DISTINCT l_orderkey) AS n_units, count(DISTINCT (l_orderkey, l_linenumber)) AS n_annotations FROM lineitem GROUP BY 1")
def distinct_compound_key(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("codebook")).agg(F.count_distinct("l_orderkey").alias("n_units"), F.count_distinct("l_orderkey", "l_linenumber").alias("n_annotations"))


@query(f"WITH {UNITS} SELECT country, CAST(max(CASE WHEN status = 'P' THEN 1 ELSE 0 END) AS INTEGER) AS is_party FROM units GROUP BY country")
def group_max_flag(spark, sf):
    return units(spark, sf).groupBy("country").agg(F.max((F.col("status") == "P").cast("int")).alias("is_party"))


@query("""WITH a AS (
  SELECT o_custkey AS id, o_orderpriority AS name, 1 AS page, o_orderkey AS k FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_custkey, o_orderpriority, 2, o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT id, name, page FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY page, k) = 1""")
def union_keep_first(spark, sf):
    """Pages of a listing in one, the first row of each key kept."""
    page = lambda status, n: table(spark, sf, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), F.lit(n).alias("page"), F.col("o_orderkey").alias("k"))
    return rel.first_of(page("P", 1).unionByName(page("F", 2)), ["id"], ["page", "k"]).select("id", "name", "page")


@query("SELECT o_orderkey AS unit_id, substr(sha256('prefix of ' || o_orderpriority || chr(0) || o_orderpriority), 1, 16) AS request_hash FROM orders")
def request_hash(spark, sf):
    """16 digits of the hash of a prompt's static part, a zero byte and the rest."""
    from quillon.functions.text import joined_hash

    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), joined_hash(F.concat(F.lit("prefix of "), "o_orderpriority"), F.col("o_orderpriority")).alias("request_hash"))


@query("""WITH d AS (SELECT c_custkey AS speech_id, max(DATE '1996-01-01') AS cleared FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
SELECT o_custkey AS speech_id, count(*) AS n FROM orders LEFT JOIN d ON o_custkey = speech_id WHERE cleared IS NULL OR CAST(o_orderdate AS DATE) > cleared GROUP BY 1""")
def keyed_delete(spark, sf):
    """What a deletion by key leaves of a log; later rows count again."""
    gone = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("speech_id"), F.lit("1996-01-01").cast("date").alias("updated_at"))
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("speech_id"), F.to_date("o_orderdate").alias("updated_at"))
    return st.cleared(log, gone, ["speech_id"]).groupBy("speech_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS codebook, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS n_units, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS model FROM orders GROUP BY 1")
def pilot_upsert(spark, sf):
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("codebook"), F.col("o_totalprice").alias("n_units"), F.col("o_orderpriority").alias("model"), F.col("o_orderdate").alias("completed_at"), F.col("o_orderkey").alias("attempt_id"))
    return st.last_of(log, ["codebook"], "completed_at", "attempt_id").select("codebook", "n_units", "model")


@query("""SELECT n_name AS model, coalesce(b, TRUE) AS supports_json_mode
FROM nation LEFT JOIN (SELECT r_regionkey AS k, r_regionkey <> 2 AS b FROM region WHERE r_regionkey <= 2) ON k = n_nationkey""")
def capability_default(spark, sf):
    known = table(spark, sf, "region").where("r_regionkey <= 2").select(F.col("r_regionkey").alias("n_nationkey"), (F.col("r_regionkey") != 2).alias("supports_json_mode"))
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("model"))
    return st.capability(n, known, key="n_nationkey").select("model", "supports_json_mode")


@query("""SELECT o_orderkey AS unit_id, o_orderstatus AS run_id, CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN -1 END AS score
FROM orders""")
def multi_run_write(spark, sf):
    """Each run fills its own rows of a shared column and leaves the others'."""
    m = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderstatus").alias("run_id"), "o_totalprice")
    main = m.where("run_id = 'F'").withColumn("score", F.col("o_totalprice"))
    pilot = m.where("run_id = 'P' and unit_id % 2 = 0").withColumn("score", F.lit(-1.0))
    out = st.put_by_run(m.select("unit_id", "run_id"), main, "score", ["unit_id", "run_id"])
    return st.put_by_run(out, pilot, "score", ["unit_id", "run_id"])


@query("""WITH n AS (SELECT n_nationkey AS k, n_name || '/Ms. ' || r_name AS field, n_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT trim(unnest(string_split(field, '/'))) AS person, country FROM n""")
def name_alternates(spark, sf):
    from quillon.functions.text import alternates

    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.explode(alternates(F.concat("n_name", F.lit("/Ms. "), "r_name"))).alias("person"), F.col("n_name").alias("country"))


@query(r"""WITH e AS (SELECT n_nationkey AS id, '1. ' || n_name || chr(10) || ' 2.  second of ' || n_name || chr(10) || 'goes on 3.5 here' AS cell FROM nation),
s AS (SELECT id, unnest(string_split_regex(cell, '\n\s*2\.\s')) AS part, generate_subscripts(string_split_regex(cell, '\n\s*2\.\s'), 1) AS i FROM e)
SELECT id, i AS position, trim(regexp_replace(regexp_replace(part, '^\s*1\.\s*', ''), '\s+', ' ', 'g')) AS example FROM s""")
def numbered_examples(spark, sf):
    """A cell with numbered examples, one row each, in one line."""
    from quillon.functions.text import numbered

    cell = F.concat(F.lit("1. "), "n_name", F.lit("\n 2.  second of "), "n_name", F.lit("\ngoes on 3.5 here"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.posexplode(numbered(cell)).alias("position", "example")).withColumn("position", (F.col("position") + 1).cast("long"))


@query(f"""WITH {UNITS}, s AS (SELECT bloc || ' | ' || status AS stratum, count(*) AS size FROM units GROUP BY 1)
SELECT stratum, size, CASE WHEN stratum LIKE '% | P' THEN 3.0 WHEN stratum LIKE 'ASIA | %' THEN 2.0 ELSE 1.0 END AS weight FROM s""")
def oversample_weight(spark, sf):
    """The largest factor of a code that is a whole component of the stratum."""
    s = units(spark, sf).groupBy(sm.stratum("bloc", "status").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    return s.withColumn("weight", sm.oversample(F.col("stratum"), {"P": 3.0, "ASIA": 2.0, "SIA": 9.0}))


@query(f"""WITH {UNITS}, m AS (SELECT segment AS codebook, status AS model, count(*) AS n, min(date) AS first, max(date) AS last FROM units WHERE segment <> 'BUILDING' OR status = 'F' GROUP BY ALL)
SELECT codebook, model, n, first, last, count(*) OVER (PARTITION BY codebook) AS n_models FROM m QUALIFY count(*) OVER (PARTITION BY codebook) > 1""")
def mixed_models(spark, sf):
    jobs = units(spark, sf).where("segment <> 'BUILDING' or status = 'F'").select(F.col("segment").alias("codebook"), F.col("status").alias("model"), F.col("date").alias("updated_at"))
    return mon.mixed_models(jobs, ["codebook"])


@query(f"""WITH {UNITS}, a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT segment AS codebook, count(*) AS ok, count(*) - count(k) AS empty, round((count(*) - count(k)) / count(*), 6) AS share, (count(*) - count(k)) / count(*) < 0.2 AS alert
FROM units LEFT JOIN a ON unit_id = k GROUP BY segment""")
def few_empty_units(spark, sf):
    has = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("unit_id"))
    return mon.few_empty(units(spark, sf).select("unit_id", F.col("segment").alias("codebook")), has, "unit_id", "codebook").withColumn("share", F.round("share", 6))


@query(f"WITH {UNITS} SELECT DISTINCT segment AS codebook, CAST(substr(priority, 1, 1) AS INTEGER) AS version, length(segment) % 5 + 1 AS declared FROM units WHERE CAST(substr(priority, 1, 1) AS INTEGER) <> length(segment) % 5 + 1")
def stale_versions(spark, sf):
    u = units(spark, sf).select(F.col("segment").alias("codebook"), F.substring("priority", 1, 1).cast("int").alias("version"))
    declared = u.select("codebook", (F.length("codebook") % 5 + 1).alias("version")).distinct()
    return mon.stale_versions(u, declared).withColumn("declared", F.col("declared").cast("long"))


@query("""WITH t AS (SELECT conv_id, turn, text, role, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS starts, length(text) % 13 = 0 AS ends FROM conversations),
n AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS own FROM t),
s AS (SELECT *, max(CASE WHEN ends AND starts = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, own ORDER BY turn) AS over,
  lag(CASE WHEN starts = 0 AND length(text) % 7 = 0 THEN 1 ELSE 0 END, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS skip FROM n)
SELECT conv_id, CAST(own AS BIGINT) AS turn_no, count(*) AS parts, CAST(sum(length(text)) AS BIGINT) AS chars
FROM s WHERE own > 0 AND over = 0 AND (starts = 1 OR skip = 0) GROUP BY conv_id, own""")
def turn_assembly(spark, sf):
    """Paragraphs carried to the speaker of the last header, up to a terminator;
    a paragraph after a vote label is skipped unless it is a header."""
    n = F.length("text")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", (F.col("role") == "user").alias("header"), (n % 13 == 0).alias("ends"), (n % 7 == 0).alias("label"))
    return od.turns(c, ["conv_id"], ["turn"], F.col("header"), F.col("ends"), F.col("label")).groupBy("conv_id", "turn_no").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.length("text")).alias("chars"))


_BYTES = "CASE WHEN n_nationkey % 4 = 0 THEN 'Türkiye' WHEN n_nationkey % 4 = 1 THEN 'Côte d’Ivoire' WHEN n_nationkey % 4 = 2 THEN 'Egypt ' ELSE '--' END"


@query(f"""WITH n AS (SELECT n_nationkey AS id, {_BYTES} AS name FROM nation),
k AS (SELECT id, name, replace(strip_accents(trim(name)), '’', '''') AS key FROM n),
d AS (SELECT * FROM (VALUES ('Turkiye', 'TUR'), ('Egypt', 'EGY')) t(c, iso3))
SELECT id, coalesce(iso3, CASE WHEN upper(substr(regexp_replace(key, '[^A-Za-z]', '', 'g'), 1, 3)) = '' THEN 'UNK' ELSE upper(substr(regexp_replace(key, '[^A-Za-z]', '', 'g'), 1, 3)) END) AS iso3
FROM k LEFT JOIN d ON c = key""")
def iso3_lookup(spark, sf):
    """Codes of a stated table by names without accents; a stub of three letters else."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.expr(_BYTES).alias("name"))
    known = F.create_map(*[F.lit(x) for pair in {"Turkiye": "TUR", "Egypt": "EGY"}.items() for x in pair])
    return n.select("id", F.coalesce(F.try_element_at(known, sp.country_key(F.col("name"))), sp.stub(F.col("name"))).alias("iso3"))


@query(f"""WITH {UNITS} SELECT speech_id, min(price) AS least, median(price) AS middle, round(avg(price), 6) AS mean, max(price) AS most FROM units GROUP BY speech_id""")
def order_statistics(spark, sf):
    return units(spark, sf).groupBy("speech_id").agg(F.min("price").alias("least"), F.median("price").alias("middle"), F.round(F.avg("price"), 6).alias("mean"), F.max("price").alias("most"))


@query(f"""WITH {UNITS}, m AS (SELECT country, status AS model, count(*) AS n FROM units GROUP BY ALL)
SELECT country, string_agg(model || ' (' || n || ')', ', ' ORDER BY n DESC, model) AS models FROM m GROUP BY country""")
def models_with_counts(spark, sf):
    m = units(spark, sf).groupBy("country", F.col("status").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "model", "n")))  # one a model
    return m.groupBy("country").agg(F.array_join(F.transform(rows, lambda x: F.concat(x["model"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("models"))


@query(f"""WITH {UNITS} SELECT unit_id, country FROM units u WHERE NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = u.unit_id AND l_linestatus = 'O' AND CAST(l_shipdate AS DATE) BETWEEN DATE '1995-07-01' AND DATE '1998-01-01')""")
def outside_span_units(spark, sf):
    """Units without an annotation of one kind inside a span (an anti-join)."""
    bad = annotations(spark, sf).where("linestatus = 'O' and shipped between date'1995-07-01' and date'1998-01-01'").select("unit_id")
    return units(spark, sf).join(bad, "unit_id", "left_anti").select("unit_id", "country")


@query(f"""WITH {MATRIX} SELECT country, round(avg(returnflag__A), 6) AS a, round(avg(linestatus__F), 6) AS f FROM matrix GROUP BY country""")
def without_duplicate_column(spark, sf):
    """A feature that equals another in every unit is dropped before shares are taken."""
    from quillon.operators.matrix import drop_equal

    m = _matrix(spark, sf, "country")
    m = m.withColumn("again", F.col("returnflag__A"))
    kept = drop_equal(m, ["returnflag__A", "linestatus__F", "again"])
    return m.groupBy("country").agg(*[F.round(F.avg(c), 6).alias({"returnflag__A": "a", "linestatus__F": "f"}.get(c, c)) for c in kept])

