"""Queries over units and annotations: matrices, profiles, joins, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import numbers as num
from quillon.functions import text as tx
from quillon.operators import matrix as mx
from quillon.operators import ordered as od
from quillon.operators import store as st
from quillon.operators.panel import build_panel, cells

from .base import ANN, CODES, COLUMNS, EVENT, EVENT_END, EVENT_START, MATRIX, PHASES, UNITS, annotations, codes_of, query, rounded, table, units

_SUM = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COLUMNS)
_SHARE = ", ".join(f"round(sum({c}) / count(*), 6) AS {c}" for c in COLUMNS)


def _matrix(spark, sf, *keep):
    return mx.code_matrix(units(spark, sf), codes_of(spark, sf), CODES, keep=keep)


@query(f"WITH {MATRIX} SELECT country, count(*) AS n, {_SHARE} FROM matrix GROUP BY country HAVING count(*) >= 30")
def country_fingerprint(spark, sf):
    counts = mx.counts_by(_matrix(spark, sf, "country"), "country", COLUMNS, floor=30)
    return mx.shares(counts, COLUMNS, digits=6)


@query(f"WITH {MATRIX} SELECT unit_id, {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in COLUMNS)} FROM matrix")
def unit_code_matrix(spark, sf):
    return _matrix(spark, sf)


@query(f"WITH {MATRIX} SELECT bloc, count(*) AS n, round(avg(returnflag__NONE_ABSENT), 6) AS absent FROM matrix GROUP BY bloc")
def absence_share(spark, sf):
    return _matrix(spark, sf, "bloc").groupBy("bloc").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("returnflag__NONE_ABSENT"), 6).alias("absent"))


_NA = ", ".join(f"round(avg(CASE WHEN status <> 'P' THEN {c} END), 6) AS {c}, count(CASE WHEN status <> 'P' THEN {c} END) AS n_annotated__{c}" for c in COLUMNS[:4])


@query(f"WITH {MATRIX} SELECT country, min(bloc) AS bloc, count(*) AS n_paragraphs, count(DISTINCT speech_id) AS n_speeches, {_NA}, round(avg(CASE WHEN status = 'F' THEN price END), 4) AS mean_score, count(CASE WHEN status = 'F' THEN price END) AS n_scored, count(*) < 600 AS is_sparse FROM matrix GROUP BY country")
def country_profiles(spark, sf):
    m = mx.masked(_matrix(spark, sf, "country", "bloc", "speech_id", "status", "price"), F.col("status") != "P", COLUMNS[:4])
    scored = F.when(F.col("status") == "F", F.col("price"))
    out = m.groupBy("country").agg(F.min("bloc").alias("bloc"), F.count(F.lit(1)).alias("n_paragraphs"), F.count_distinct("speech_id").alias("n_speeches"), *mx.na_shares(m, "country", COLUMNS[:4]), F.round(F.avg(scored), 4).alias("mean_score"), F.count(scored).alias("n_scored"))
    return out.withColumns({c: F.round(c, 6) for c in COLUMNS[:4]}).withColumn("is_sparse", F.col("n_paragraphs") < 600)


@query("SELECT source, count(*) AS n, count(toxic) AS n_annotated, round(avg(toxic), 6) AS share FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def na_aware_share(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("toxic").alias("n_annotated"), F.round(F.avg("toxic"), 6).alias("share"))


_SCORE = "CASE returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END"


def _score():
    return F.when(F.col("returnflag") == "A", 0).when(F.col("returnflag") == "N", 1).when(F.col("returnflag") == "R", 2)


@query(f"WITH {ANN}, s AS (SELECT unit_id, max({_SCORE}) AS score FROM ann GROUP BY unit_id) SELECT score, count(*) AS n FROM s GROUP BY score")
def ordinal_score_max(spark, sf):
    return mx.ordinal(codes_of(spark, sf), "unit_id", _score(), "max", "unit_id").groupBy("score").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ANN}, s AS (SELECT unit_id, arg_min({_SCORE}, annotation_index) AS score FROM ann GROUP BY unit_id) SELECT score, count(*) AS n FROM s GROUP BY score")
def ordinal_score_first(spark, sf):
    return mx.ordinal(annotations(spark, sf), "unit_id", _score(), "first", "annotation_index").groupBy("score").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ANN}, {UNITS}, long AS (SELECT unit_id, annotation_index, 'returnflag' AS dimension, returnflag AS value, confidence, verified FROM ann UNION ALL SELECT unit_id, annotation_index, 'linestatus', linestatus, confidence, verified FROM ann) SELECT l.unit_id, CAST(annotation_index AS INTEGER) AS annotation_index, dimension, value, round(confidence, 4) AS confidence, verified = 1 AS evidence_verified, country, bloc FROM long l LEFT JOIN units u ON l.unit_id = u.unit_id")
def annotations_long(spark, sf):
    ann = annotations(spark, sf).unpivot(["unit_id", "annotation_index", "confidence", "verified"], ["returnflag", "linestatus"], "dimension", "value")
    own = units(spark, sf).select("unit_id", "country", "bloc")
    return ann.join(own, "unit_id", "left").select("unit_id", "annotation_index", "dimension", "value", F.round("confidence", 4).alias("confidence"), (F.col("verified") == 1).alias("evidence_verified"), "country", "bloc")


@query(f"WITH {UNITS}, v AS (SELECT segment AS codebook, bloc AS run, CAST(substr(priority, 1, 1) AS INTEGER) AS version FROM units WHERE unit_id % 7 <> 0 OR priority NOT LIKE '5%') SELECT v.codebook, v.run, v.version, count(*) AS n FROM v JOIN (SELECT codebook, run, max(version) AS version FROM v GROUP BY codebook, run) t ON v.codebook = t.codebook AND v.run = t.run AND v.version = t.version GROUP BY ALL")
def latest_version(spark, sf):
    v = units(spark, sf).where("unit_id % 7 <> 0 or priority not like '5%'").select(F.col("segment").alias("codebook"), F.col("bloc").alias("run"), F.substring("priority", 1, 1).cast("int").alias("version"))
    return st.latest_version(v, ["codebook", "run"], "version").groupBy("codebook", "run", "version").agg(F.count(F.lit(1)).alias("n"))


def _jobs(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "api_error").otherwise("pending").alias("status"))


@query("SELECT o_custkey AS speech_id, count(*) AS n_missing FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def pending_units(spark, sf):
    u = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("speech_id"))
    return st.pending(u, _jobs(spark, sf))


@query("SELECT o_custkey AS speech_id, count(*) AS n_missing FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY o_custkey")
def errored_excluded(spark, sf):
    u = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_custkey").alias("speech_id"))
    errored = u.join(_jobs(spark, sf).where("status = 'api_error'"), "unit_id", "left_semi").select("speech_id").distinct()
    return st.pending(u, _jobs(spark, sf)).join(errored, "speech_id", "left_anti")


@query("SELECT o_orderkey AS unit_id, 'lost' AS kind FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'gained' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def orphaned_ids(spark, sf):
    return st.vanished(table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id")), "unit_id")


@query(f"WITH {ANN} SELECT unit_id, arg_max(returnflag, annotation_index) AS status, CAST(sum(verified) AS BIGINT) AS attempts, CAST(min(annotation_index) AS INTEGER) AS created_at, CAST(max(annotation_index) AS INTEGER) AS updated_at FROM ann GROUP BY unit_id")
def job_latest_state(spark, sf):
    log = annotations(spark, sf).select("unit_id", F.col("returnflag").alias("status"), F.col("verified").alias("attempts"), F.col("annotation_index").alias("updated_at"), F.col("annotation_index").alias("attempt_id"))
    return st.latest_jobs(log, ["unit_id"]).select("unit_id", "status", "attempts", "created_at", "updated_at")


@query(f"WITH {ANN}, last AS (SELECT unit_id, max(annotation_index) AS i FROM ann GROUP BY unit_id) SELECT returnflag AS value, count(*) AS n FROM ann JOIN last ON ann.unit_id = last.unit_id AND annotation_index = i GROUP BY returnflag")
def live_annotations(spark, sf):
    ann = annotations(spark, sf).withColumn("attempt_id", F.col("annotation_index"))
    log = ann.select("unit_id", "attempt_id", F.col("attempt_id").alias("updated_at"), F.lit(1).alias("attempts"))
    return st.live_annotations(ann, log, ["unit_id"]).groupBy(F.col("returnflag").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {UNITS}, c AS (SELECT country, priority, count(*) AS n FROM units GROUP BY ALL) SELECT country, priority AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY country ORDER BY n DESC, priority) = 1")
def model_mode(spark, sf):
    return od.mode_of(units(spark, sf), ["country"], "priority")


_ISLANDS = f"WITH {UNITS}, a AS (SELECT country, unit_id, date, status, CASE WHEN status = lag(status) OVER w THEN 0 ELSE 1 END AS new FROM units WINDOW w AS (PARTITION BY country ORDER BY date, unit_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY country ORDER BY date, unit_id) AS run FROM a) SELECT country, CAST(run AS BIGINT) AS run, min(status) AS model, min(date) AS first_day, max(date) AS last_day, count(*) AS n FROM b GROUP BY country, run"


@query(_ISLANDS)
def model_runs_islands(spark, sf):
    r = od.runs(units(spark, sf), ["country"], ["date", "unit_id"], "status", slice_by=F.trunc("date", "month"))
    return r.groupBy("country", "run").agg(F.min("status").alias("model"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("n"))


_PHASE = "CASE " + " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{p}'" for p, (a, b) in reversed(PHASES.items())) + " ELSE 'outside' END"


@query(f"WITH {UNITS} SELECT {_PHASE} AS phase, bloc, count(*) AS n FROM units GROUP BY ALL")
def phase_assign_range_join(spark, sf):
    return units(spark, sf).groupBy(num.phase_of(F.col("date"), PHASES).alias("phase"), "bloc").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {UNITS}, p AS (SELECT *, {_PHASE} AS phase FROM units) SELECT coalesce(phase, 'All') AS phase, count(*) AS n, count(DISTINCT speech_id) AS n_speeches, count(DISTINCT country) AS n_countries, min(date) AS first_day FROM p GROUP BY GROUPING SETS ((phase), ())")
def corpus_overview_grouping_sets(spark, sf):
    p = units(spark, sf).withColumn("phase", num.phase_of(F.col("date"), PHASES))
    out = p.groupingSets([[F.col("phase")], []], F.col("phase")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("speech_id").alias("n_speeches"), F.count_distinct("country").alias("n_countries"), F.min("date").alias("first_day"))
    return out.withColumn("phase", F.coalesce("phase", F.lit("All")))


@query("WITH n AS (SELECT count(*) AS ok FROM orders), c AS (SELECT l_returnflag AS value, l_linestatus AS dimension, count(DISTINCT l_orderkey) AS n_units, count(*) AS n_annotations FROM lineitem GROUP BY ALL) SELECT dimension, value, n_units, n_annotations, round(n_units / ok, 6) AS prevalence, CASE WHEN n_units / ok > 0.5 THEN 'over half' WHEN n_units / ok < 0.01 THEN 'very rare' ELSE '' END AS flag FROM c, n")
def prevalence(spark, sf):
    ok = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("ok"))
    c = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("dimension"), F.col("l_returnflag").alias("value")).agg(F.count_distinct("l_orderkey").alias("n_units"), F.count(F.lit(1)).alias("n_annotations"))
    p = F.col("n_units") / F.col("ok")
    return c.join(F.broadcast(ok)).select("dimension", "value", "n_units", "n_annotations", F.round(p, 6).alias("prevalence"), num.prevalence_flag(p).alias("flag"))  # ok is one row


@query(f"WITH {UNITS} SELECT segment, priority AS prompt_hash, count(*) AS n, min(date) AS first_day, max(date) AS last_day, count(*) = max(count(*)) OVER (PARTITION BY segment) AS dominant FROM units GROUP BY segment, priority")
def drift_report(spark, sf):
    g = units(spark, sf).groupBy("segment", F.col("priority").alias("prompt_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    return g.withColumn("dominant", F.col("n") == F.max("n").over(W.partitionBy("segment")))


@query("WITH o AS (SELECT 'regions' AS metric, 5 AS expected, count(*) AS observed FROM region UNION ALL SELECT 'nations', 25, count(*) FROM nation UNION ALL SELECT 'statuses', 3, count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'flag cells', 7, count(DISTINCT l_returnflag || l_linestatus) FROM lineitem) SELECT metric, CAST(expected AS BIGINT) AS expected, observed, observed - expected AS delta, round(100.0 * (observed - expected) / expected, 4) AS pct, abs(observed - expected) <= 0.01 * expected AS ok FROM o")
def sanity_check(spark, sf):
    from quillon.operators.monitor import sanity

    seen = [("regions", 5, table(spark, sf, "region").agg(F.count(F.lit(1)))), ("nations", 25, table(spark, sf, "nation").agg(F.count(F.lit(1)))), ("statuses", 3, table(spark, sf, "orders").agg(F.count_distinct("o_orderstatus"))), ("flag cells", 7, table(spark, sf, "lineitem").agg(F.count_distinct(F.concat("l_returnflag", "l_linestatus"))))]
    return sanity(seen)


@query(f"WITH {ANN} SELECT unit_id, array_to_string(list_sort(list(DISTINCT returnflag)), '+') AS labels FROM ann GROUP BY unit_id")
def sorted_set_agg(spark, sf):
    return codes_of(spark, sf).groupBy("unit_id").agg(od.sorted_set("returnflag").alias("labels"))


@query(f"WITH {ANN} SELECT unit_id, string_agg(returnflag || linestatus, ' || ' ORDER BY annotation_index) AS evidence FROM ann WHERE annotation_index <= 3 GROUP BY unit_id")
def ordered_top3_evidence(spark, sf):
    ann = annotations(spark, sf).where("annotation_index <= 3").withColumn("e", F.concat("returnflag", "linestatus"))
    return ann.groupBy("unit_id").agg(od.joined_in_order("e", ["annotation_index"], " || ", 3).alias("evidence"))


@query(f"WITH {UNITS} SELECT country, unit_id, round(price, 2) AS price, CAST(row_number() OVER (PARTITION BY country ORDER BY price DESC, unit_id) AS INTEGER) AS rank FROM units QUALIFY row_number() OVER (PARTITION BY country ORDER BY price DESC, unit_id) <= 6")
def topn_per_group(spark, sf):
    return od.top(units(spark, sf), ["country"], [F.col("price").desc(), "unit_id"], 6).select("country", "unit_id", F.round("price", 2).alias("price"), "rank")


@query(f"WITH {MATRIX} SELECT country, {', '.join(f'round(ln(sum({c}) + 0.5) - ({chr(43).join(f'ln(sum({k}) + 0.5)' for k in COLUMNS[:4])}) / 4, 6) AS {c}' for c in COLUMNS[:4])}, {', '.join(f'round(ln(sum({c}) + 0.5) - ({chr(43).join(f'ln(sum({k}) + 0.5)' for k in COLUMNS[4:])}) / 3, 6) AS {c}' for c in COLUMNS[4:])} FROM matrix GROUP BY country")
def clr_blocks(spark, sf):
    counts = mx.counts_by(_matrix(spark, sf, "country"), "country", COLUMNS)
    return mx.clr(counts, CODES).select("country", *rounded(*COLUMNS))


_LONG = f"WITH {MATRIX}, s AS (SELECT country, min(bloc) AS cluster, {', '.join(f'sum({c}) / count(*) AS {c}' for c in COLUMNS)} FROM matrix GROUP BY country), long AS (UNPIVOT s ON {', '.join(COLUMNS)} INTO NAME code VALUE value)"


@query(f"{_LONG}, a AS (SELECT code, count(*) AS n, avg(value) AS m, avg(value * value) - avg(value) * avg(value) AS v FROM long GROUP BY code), g AS (SELECT cluster, code, count(*) AS ng, avg(value) AS mg FROM long GROUP BY ALL) SELECT cluster, g.code, round(mg, 6) AS cluster_share, round(m, 6) AS corpus_share, round(mg / nullif(m, 0), 6) AS ratio, CASE WHEN v > 1e-15 AND n > ng THEN round((mg - m) / sqrt((n - ng) / (n - 1) * v / ng), 4) END AS v_test, ng AS n_members FROM g JOIN a ON g.code = a.code")
def vtest_signature(spark, sf):
    m = _matrix(spark, sf, "country", "bloc")
    s = m.groupBy("country").agg(F.min("bloc").alias("cluster"), *[F.avg(c).alias(c) for c in COLUMNS])
    v = mx.v_tests(mx.unpivoted(s, ["cluster"], COLUMNS))
    return v.withColumns({**{c: F.round(c, 6) for c in ("cluster_share", "corpus_share", "ratio")}, "v_test": F.round("v_test", 4)})


@query(f"WITH {MATRIX}, t AS (SELECT country, {', '.join(f'sum({c}) AS {c}' for c in COLUMNS)} FROM matrix GROUP BY country), long AS (UNPIVOT t ON {', '.join(COLUMNS)} INTO NAME code VALUE x), g AS (SELECT sum(x) AS n FROM long), r AS (SELECT country, sum(x) AS r FROM long GROUP BY country), c AS (SELECT code, sum(x) AS c FROM long GROUP BY code) SELECT long.country, long.code, round((x / n - r * c / n / n) / sqrt(r * c / n / n), 8) AS residual FROM long JOIN r ON long.country = r.country JOIN c ON long.code = c.code, g")
def ca_residuals(spark, sf):
    t = mx.counts_by(_matrix(spark, sf, "country"), "country", COLUMNS)
    long = mx.unpivoted(t, ["country"], COLUMNS, value="x")
    x = F.col("x").cast("double")
    n = F.sum(x).over(W.partitionBy(F.lit(0)))
    r, c = F.sum(x).over(W.partitionBy("country")), F.sum(x).over(W.partitionBy("code"))
    e = r * c / n / n
    return long.select("country", "code", F.round((x / n - e) / F.sqrt(e), 8).alias("residual"))


_PANEL = f"WITH {MATRIX}, w AS (SELECT country, unit_id, date, returnflag__R AS y, CASE WHEN date >= DATE '{EVENT}' THEN 1 ELSE 0 END AS post, date_diff('day', DATE '{EVENT}', date) / 30.4375 AS m FROM matrix WHERE date BETWEEN DATE '{EVENT_START}' AND DATE '{EVENT_END}'), panel AS (SELECT * FROM w WHERE country IN (SELECT country FROM w GROUP BY country HAVING count(DISTINCT post) = 2))"


def _panel(spark, sf):
    m = _matrix(spark, sf, "country", "bloc", "date").withColumn("y", F.col("returnflag__R"))
    return build_panel(m, EVENT, (EVENT_START, EVENT_END))


@query(f"{_PANEL} SELECT unit_id, country, CAST(y AS INTEGER) AS y, post, round(m, 6) AS m, round(post * m, 6) AS post_m FROM panel")
def event_panel(spark, sf):
    return _panel(spark, sf).select("unit_id", "country", "y", "post", *rounded("m", "post_m"))


@query(f"{_PANEL} SELECT country AS cluster, round(avg(CASE WHEN post = 0 THEN y END), 6) AS pre, round(avg(CASE WHEN post = 1 THEN y END), 6) AS post, round(avg(CASE WHEN post = 1 THEN y END) - avg(CASE WHEN post = 0 THEN y END), 6) AS change, count(CASE WHEN post = 0 THEN 1 END) AS n_pre, count(CASE WHEN post = 1 THEN 1 END) AS n_post FROM panel GROUP BY country")
def pre_post_shift(spark, sf):
    pre, post = F.when(F.col("post") == 0, F.col("y")), F.when(F.col("post") == 1, F.col("y"))
    out = _panel(spark, sf).groupBy(F.col("country").alias("cluster")).agg(F.avg(pre).alias("pre"), F.avg(post).alias("post"), F.count(pre).alias("n_pre"), F.count(post).alias("n_post"))
    return out.withColumn("change", F.col("post") - F.col("pre")).withColumns({c: F.round(c, 6) for c in ("pre", "post", "change")})


@query(f"{_PANEL} SELECT country, date, round(avg(y), 6) AS y, count(*) AS w, max(post) AS post, round(avg(m), 6) AS m FROM panel GROUP BY country, date")
def country_meeting_cells(spark, sf):
    return cells(_panel(spark, sf)).select("country", "date", F.round("y", 6).alias("y"), "w", "post", F.round("m", 6).alias("m"))


@query(f"WITH {MATRIX}, g AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n, avg(returnflag__R) AS p FROM matrix GROUP BY 1 HAVING count(*) >= 15) SELECT month, n, round(p, 6) AS share, round(sqrt(p * (1 - p) / n), 6) AS se, round(p - 1.96 * sqrt(p * (1 - p) / n), 6) AS low, round(p + 1.96 * sqrt(p * (1 - p) / n), 6) AS high FROM g")
def monthly_share_ci(spark, sf):
    g = _matrix(spark, sf, "date").groupBy(F.to_date(F.date_trunc("month", "date")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg("returnflag__R").alias("p")).where("n >= 15")
    se = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return g.select("month", "n", F.round("p", 6).alias("share"), F.round(se, 6).alias("se"), F.round(F.col("p") - 1.96 * se, 6).alias("low"), F.round(F.col("p") + 1.96 * se, 6).alias("high"))


_TRAJ = f"WITH {UNITS}, p AS (SELECT country, {_PHASE} AS phase, status, count(*) AS n FROM units GROUP BY ALL), top AS (SELECT country, phase, status AS label, sum(n) OVER (PARTITION BY country, phase) AS n FROM p WHERE phase <> 'outside' QUALIFY row_number() OVER (PARTITION BY country, phase ORDER BY p.n DESC, status) = 1)"


def _labels(spark, sf):
    u = units(spark, sf).withColumn("phase", num.phase_of(F.col("date"), PHASES)).where("phase <> 'outside'")
    c = u.groupBy("country", "phase", "status").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("country", "phase").agg(F.min(F.struct((-F.col("c")).alias("k"), "status"))["status"].alias("label"), F.sum("c").alias("n"))


@query(f"{_TRAJ} SELECT country, {', '.join(f'max(CASE WHEN phase = {chr(39)}{p}{chr(39)} THEN label END) AS {p}, CAST(coalesce(max(CASE WHEN phase = {chr(39)}{p}{chr(39)} THEN n END), 0) AS BIGINT) AS {p}__n' for p in PHASES)}, count(*) AS n_phases_present, count(DISTINCT label) > 1 AS is_mover FROM top GROUP BY country")
def trajectories(spark, sf):
    by = _labels(spark, sf).groupBy("country")
    wide = [x for p in PHASES for x in (F.max(F.when(F.col("phase") == p, F.col("label"))).alias(p), F.coalesce(F.max(F.when(F.col("phase") == p, F.col("n"))), F.lit(0)).alias(f"{p}__n"))]
    return by.agg(*wide, F.count(F.lit(1)).alias("n_phases_present"), (F.count_distinct("label") > 1).alias("is_mover"))


@query(f"{_TRAJ} SELECT a.phase AS phase, a.label AS label, b.label AS next_label, count(*) AS n FROM top a JOIN top b ON a.country = b.country AND (a.phase, b.phase) IN (('P1', 'P2'), ('P2', 'P3')) GROUP BY ALL")
def transition_flows(spark, sf):
    t = _labels(spark, sf)
    follows = dict(zip(PHASES, list(PHASES)[1:]))
    nxt = F.create_map(*[F.lit(x) for p in follows.items() for x in p])
    a = t.withColumn("next_phase", F.try_element_at(nxt, F.col("phase")))
    b = t.select("country", F.col("phase").alias("next_phase"), F.col("label").alias("next_label"))
    return a.join(b, ["country", "next_phase"]).groupBy("phase", "label", "next_label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ANN}, {UNITS} SELECT country, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, min(verified) AS all_verified FROM ann JOIN units ON ann.unit_id = units.unit_id WHERE confidence >= 0.95 AND NOT (linestatus = 'O' AND shipped > DATE '1998-12-31') GROUP BY country")
def quality_filters(spark, sf):
    ann = annotations(spark, sf).where("confidence is not null and confidence >= 0.95 and not (linestatus = 'O' and shipped > date'1998-12-31')")
    return ann.join(units(spark, sf).select("unit_id", "country"), "unit_id").groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("verified").alias("all_verified"))


@query(f"WITH {UNITS} SELECT unit_id, country, price FROM units WHERE status = 'F' AND segment = 'BUILDING' AND country NOT IN ('NATION_1', 'NATION_2') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def include_exclude_filters(spark, sf):
    from quillon.operators.relational import include_when

    u = include_when(units(spark, sf), {"status": "F", "segment": "BUILDING"})
    return u.where(~F.col("country").isin("NATION_1", "NATION_2") & F.col("date").between(F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date"))).select("unit_id", "country", "price")


@query("SELECT r_name AS bloc, k.run_id, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT unnest(['main', 'pilot', 'rerun']) AS run_id) k GROUP BY ALL")
def cross_join_runs(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    runs = n.withColumn("run_id", F.explode(F.array(F.lit("main"), F.lit("pilot"), F.lit("rerun"))))  # a stated list, no join
    return runs.groupBy(F.col("r_name").alias("bloc"), "run_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {UNITS} SELECT year(date) || 'Q' || quarter(date) AS quarter, bloc, count(*) AS n FROM units GROUP BY ALL")
def quarter_counts(spark, sf):
    return units(spark, sf).groupBy(num.quarter_of(F.col("date")).alias("quarter"), "bloc").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus AS status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 4))


@query(f"WITH {ANN} SELECT linestatus AS codebook, CAST(sum(1 - verified) AS BIGINT) AS unverified, count(*) AS total, round(sum(1 - verified) / count(*), 6) AS ratio, sum(1 - verified) / count(*) > 0.15 AS alert FROM ann GROUP BY linestatus")
def unverified_evidence(spark, sf):
    g = annotations(spark, sf).groupBy(F.col("linestatus").alias("codebook")).agg(F.sum(1 - F.col("verified")).alias("unverified"), F.count(F.lit(1)).alias("total"))
    r = num.ratio(F.col("unverified"), F.col("total"))
    return g.withColumn("ratio", F.round(r, 6)).withColumn("alert", r > 0.15)


@query(f"WITH {UNITS} SELECT segment AS codebook, round(100 * avg(CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END), 4) AS coverage_pct, CAST(ceil(count(DISTINCT CASE WHEN status <> 'F' THEN speech_id END) / 950.0) AS BIGINT) AS days_left FROM units GROUP BY segment")
def coverage_progress(spark, sf):
    g = units(spark, sf).groupBy(F.col("segment").alias("codebook")).agg(F.round(100 * F.avg((F.col("status") == "F").cast("double")), 4).alias("coverage_pct"), F.count_distinct(F.when(F.col("status") != "F", F.col("speech_id"))).alias("left"))
    return g.select("codebook", "coverage_pct", F.ceil(F.col("left") / 950.0).cast("long").alias("days_left"))


@query(f"WITH {UNITS}, l AS (SELECT speech_id, sum(price) AS v FROM units GROUP BY speech_id), n AS (SELECT *, row_number() OVER (ORDER BY v, speech_id) AS r, count(*) OVER () AS n FROM l), c AS (SELECT min(CASE WHEN r >= n // 3 THEN v END) AS c1, min(CASE WHEN r >= 2 * n // 3 THEN v END) AS c2 FROM n) SELECT CASE WHEN v <= c1 THEN 'short' WHEN v <= c2 THEN 'medium' ELSE 'long' END AS tercile, count(*) AS n FROM l, c GROUP BY 1")
def length_tercile(spark, sf):
    s = units(spark, sf).groupBy("speech_id").agg(F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("v"))
    return od.tercile(s, "v", "tercile").groupBy("tercile").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS country, CASE WHEN n_name LIKE 'NATION_1%' THEN 'party' WHEN r_name = 'ASIA' THEN 'group' WHEN n_nationkey % 5 = 0 THEN 'invited' ELSE 'member state' END AS speaker_class FROM nation JOIN region ON n_regionkey = r_regionkey")
def speaker_class(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = F.when(F.col("n_name").like("NATION_1%"), "party").when(F.col("r_name") == "ASIA", "group").when(F.col("n_nationkey") % 5 == 0, "invited").otherwise("member state")
    return n.select(F.col("n_name").alias("country"), c.alias("speaker_class"))


@query("SELECT DISTINCT c_mktsegment AS codebook, n_regionkey AS run FROM customer JOIN nation ON c_nationkey = n_nationkey")
def codebook_runs(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_mktsegment").alias("codebook"), F.col("n_regionkey").alias("run")).distinct()


@query("WITH a AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P') SELECT 'union' AS op, count(*) AS n FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT 'symmetric', count(*) FROM ((SELECT id FROM a EXCEPT SELECT id FROM b) UNION (SELECT id FROM b EXCEPT SELECT id FROM a))")
def key_set_operations(spark, sf):
    """All four from one aggregate of presence flags instead of four joins."""
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("a"), F.max((F.col("o_orderstatus") == "P").cast("int")).alias("b"))
    n = g.agg(F.sum(F.greatest("a", "b")).alias("union"), F.sum(F.col("a") * F.col("b")).alias("intersect"), F.sum(F.col("a") * (1 - F.col("b"))).alias("except"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("symmetric"))
    return n.unpivot([], ["union", "intersect", "except", "symmetric"], "op", "n")


@query(f"WITH {UNITS} SELECT country, coalesce(count(CASE WHEN status = 'F' THEN 1 END), 0) AS n_ok, round(sum(CASE WHEN status = 'F' THEN price END), 2) AS price_ok FROM units GROUP BY country")
def reindexed_counts(spark, sf):
    """Counts over every key of the dimension: absent ones are 0."""
    ok = units(spark, sf).where("status = 'F'").groupBy("country").agg(F.count(F.lit(1)).alias("n_ok"), F.round(F.sum("price"), 2).alias("price_ok"))
    return table(spark, sf, "nation").select(F.col("n_name").alias("country")).join(ok, "country", "left").fillna({"n_ok": 0})


@query(f"WITH {UNITS}, c AS (SELECT segment, count(*) AS n, sum(price) AS s FROM units GROUP BY segment), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, segment) AS k FROM c) SELECT CASE WHEN k <= 3 THEN segment ELSE 'other' END AS label, CAST(sum(n) AS BIGINT) AS n, round(sum(s), 2) AS total FROM r GROUP BY 1")
def bar_histogram(spark, sf):
    c = units(spark, sf).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("s"))
    r = c.withColumn("k", F.row_number().over(W.orderBy(F.col("n").desc(), "segment")))
    return r.groupBy(F.when(F.col("k") <= 3, F.col("segment")).otherwise("other").alias("label")).agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query("SELECT c_custkey AS speech_id, regexp_replace(c_name, '#.*', '') AS symbol, length(regexp_replace(c_name, '[\\s()]', '', 'g')) AS key_length FROM customer")
def symbol_normalise(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("speech_id"), tx.before(F.col("c_name")).alias("symbol"), F.length(tx.symbol_key(F.col("c_name"))).cast("long").alias("key_length"))
