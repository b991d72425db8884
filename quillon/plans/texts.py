"""Queries over documents, conversations, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import numbers as num
from quillon.functions import text as tx
from quillon.operators import graph as gr
from quillon.operators import ordered as od
from quillon.operators import replies as rp
from quillon.operators import sampling as sm
from quillon.operators.segment import pieces

from .base import UNITS, query, table, units

#: DuckDB's reading of the same steps.
_PIECES = r"""p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS raw FROM documents),
 para AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS para_index, trim(raw) AS text FROM p WHERE trim(raw) <> '')"""
_N_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"


def _para(spark, sf):
    return pieces(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text", "\n")


@query(f"WITH {_PIECES} SELECT doc_id, para_index, {_N_WORDS} AS n_words, md5(text) AS digest FROM para WHERE {_N_WORDS} >= 15")
def segment_paragraphs(spark, sf):
    p = _para(spark, sf).withColumn("n_words", tx.word_count(F.col("text")).cast("long"))
    return p.where("n_words >= 15").select("doc_id", "para_index", "n_words", F.md5("text").alias("digest"))


@query(f"WITH {_PIECES} SELECT doc_id, para_index, substr(sha256(CAST(doc_id AS VARCHAR) || chr(0) || CAST(para_index AS VARCHAR) || chr(0) || trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) AS unit_id FROM para")
def stable_unit_ids(spark, sf):
    return _para(spark, sf).select("doc_id", "para_index", tx.hash_id(F.col("doc_id"), F.col("para_index"), tx.normalise_for_hash(F.col("text"))).alias("unit_id"))


@query(rf"WITH {_PIECES}, h AS (SELECT *, {_N_WORDS} AS n, regexp_matches(text, '^(The|And|Les|Is)[ ,.]') AS hit, {_N_WORDS} < 10 AS quote FROM para), v AS (SELECT *, coalesce(last_value(CASE WHEN hit THEN true WHEN NOT quote THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_index ROWS UNBOUNDED PRECEDING), false) AS verdict FROM h) SELECT doc_id, count(*) AS n, CAST(sum(CAST(verdict AS INTEGER)) AS BIGINT) AS n_procedural, CAST(sum(CASE WHEN verdict THEN 0 ELSE n END) AS BIGINT) AS substantive_words, sum(CASE WHEN verdict THEN 0 ELSE n END) = 0 AS is_procedural FROM v GROUP BY doc_id")
def procedural_inherit(spark, sf):
    p = _para(spark, sf).withColumn("n", tx.word_count(F.col("text")))
    v = od.inherit(p, ["doc_id"], ["para_index"], F.col("text").rlike(r"^(The|And|Les|Is)[ ,.]"), F.col("n") < 10, "verdict")
    own = F.sum(F.when(F.col("verdict"), 0).otherwise(F.col("n")))
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("verdict").cast("int")).alias("n_procedural"), own.alias("substantive_words"), (own == 0).alias("is_procedural"))


_EDGES = (0, 5, 10, 20, 50, 100, 200)
_BUCKET = "CASE " + " ".join(f"WHEN n < {b} THEN '{a}-{b - 1}'" for a, b in zip(_EDGES, _EDGES[1:])) + f" ELSE '{_EDGES[-1]}+' END"


@query(f"WITH {_PIECES}, c AS (SELECT {_N_WORDS} AS n FROM para) SELECT {_BUCKET} AS bucket, count(*) AS paragraphs, CAST(sum(n) AS BIGINT) AS words FROM c GROUP BY 1")
def word_histogram(spark, sf):
    p = _para(spark, sf).withColumn("n", tx.word_count(F.col("text")))
    return p.groupBy(num.bucket_of(F.col("n"), _EDGES).alias("bucket")).agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("n").alias("words"))


@query("SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean, min(n_chars) AS low, max(n_chars) AS high, " + ", ".join(f"round(quantile_cont(n_chars, {q}), 4) AS p{int(q * 100)}" for q in (0.1, 0.5, 0.9, 0.99)) + " FROM documents GROUP BY source")
def quantile_describe(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), *[F.round(F.percentile("n_chars", q), 4).alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9, 0.99)])


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS n_records, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS record_ids FROM documents GROUP BY md5(text)")
def dedupe_content_hash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_records"), ids.alias("record_ids"))


_STOP = ("the", "and", "for", "with", "that", "this", "from")


@query("WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: len(x) >= 3 AND x NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from'))) AS w FROM conversations) SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS overlap FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def token_jaccard(spark, sf):
    """The next turn by a window, not by a self-join."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", tx.tokens(F.col("text"), _STOP).alias("w"))
    at = W.partitionBy("conv_id").orderBy("turn")
    t = t.withColumn("next", F.lead("w").over(at)).withColumn("next_turn", F.lead("turn").over(at)).where("next_turn = turn + 1")
    return t.select("conv_id", "turn", F.round(tx.jaccard(F.col("w"), F.col("next")), 6).alias("overlap"))


_EV = "substr(text, 5, 20) || '...' || substr(text, 40, 20)"


@query("WITH e AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS para, lower(trim(regexp_replace(substr(text, 5, 20), '\\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN 'not in any text' ELSE substr(text, 40, 20) END, '\\s+', ' ', 'g'))) AS b FROM documents), f AS (SELECT *, instr(para, a) AS ia FROM e) SELECT doc_id, (length(a) < 8 OR ia > 0) AND (length(b) < 8 OR instr(substr(para, CASE WHEN length(a) < 8 THEN 1 ELSE ia + length(a) END), b) > 0) AND (length(a) >= 8 OR length(b) >= 8) AS verified FROM f")
def evidence_verify(spark, sf):
    """Evidence elided in the middle, checked against its own document."""
    d = table(spark, sf, "documents")
    tail = F.when(F.col("doc_id") % 3 == 0, "not in any text").otherwise(F.substring("text", 40, 20))
    ev = F.concat(F.trim(F.substring("text", 5, 20)), F.lit("…"), tail)
    return d.select("doc_id", tx.evidence_found(ev, F.col("text")).alias("verified"))


@query("WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events) SELECT event_type, count(*) AS n, CAST(sum(CAST(k AS INTEGER)) AS BIGINT) AS total, count(CASE WHEN CAST(k AS INTEGER) >= 50 THEN 1 END) AS high FROM e GROUP BY event_type")
def json_reply_explode(spark, sf):
    """props as a map, exploded to one row per key."""
    e = table(spark, sf, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")).where("key = 'k'")
    v = F.col("value").cast("int")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.count(F.when(v >= 50, 1)).alias("high"))


@query("WITH r AS (SELECT d.doc_id, d.lang AS stratum FROM documents d JOIN labels l ON d.doc_id = l.doc_id), s AS (SELECT stratum, count(*) AS size, least(count(*), 12) AS n_h FROM r GROUP BY stratum), k AS (SELECT r.*, row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id || '|42'), doc_id) AS i FROM r) SELECT doc_id, k.stratum, round(n_h / size, 6) AS pi, round(size / n_h, 6) AS weight FROM k JOIN s ON k.stratum = s.stratum WHERE i <= n_h")
def gold_sample_hash(spark, sf):
    frame = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("stratum")).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    sizes = frame.groupBy("stratum").agg(F.count(F.lit(1)).alias("size")).withColumn("n_h", F.least("size", F.lit(12)))
    out = sm.draw(frame, "doc_id", sizes, 42)
    return out.select("doc_id", "stratum", F.round("pi", 6).alias("pi"), F.round("weight", 6).alias("weight"))


@query("WITH s AS (SELECT lang AS stratum, count(*) AS size FROM documents GROUP BY lang), e AS (SELECT *, 100 * size / sum(size) OVER () AS x FROM s), r AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) AS k, 100 - sum(floor(x)) OVER () AS spare FROM e) SELECT stratum, size, CAST(floor(x) + CASE WHEN k <= spare THEN 1 ELSE 0 END AS BIGINT) AS n_h FROM r")
def largest_remainder_alloc(spark, sf):
    s = table(spark, sf, "documents").groupBy(F.col("lang").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    return sm.largest_remainder(s, 100)


@query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM c), a AS (SELECT sum(x * (x - 1) / 2) AS a FROM (SELECT sum(n) AS x FROM c GROUP BY lang)), b AS (SELECT sum(x * (x - 1) / 2) AS b FROM (SELECT sum(n) AS x FROM c GROUP BY source)) SELECT CAST(n AS BIGINT) AS n, round((ij - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 9) AS ari FROM i, a, b")
def ari(spark, sf):
    return gr.adjusted_rand(table(spark, sf, "documents"), "lang", "source").select("n", F.round("ari", 9).alias("ari"))


@query("SELECT n_name AS inner_group, count(DISTINCT c_mktsegment) AS n_outer, count(*) AS n_members, count(DISTINCT c_mktsegment) = 1 AS nested FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def nesting_test(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return gr.nesting(c.withColumnRenamed("n_name", "inner_group"), "inner_group", "c_mktsegment")


@query("WITH q AS (SELECT vec_id AS src, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT src, vec_id AS dst, list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS w FROM embeddings JOIN q ON src <> vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS rank FROM p WHERE w > 0) SELECT src, dst, round(w, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def cosine_knn(spark, sf):
    """The five nearest of every twentieth vector among all vectors."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return gr.nearest(e, e.where("id % 20 = 0"), 5).withColumn("weight", F.round("weight", 6))


@query("WITH s AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS opening, bool_or(role = 'system') AS has_system FROM conversations WHERE turn <= 2 GROUP BY conv_id) SELECT conv_id, md5(opening) AS digest, has_system FROM s")
def opening_text(spark, sf):
    c = table(spark, sf, "conversations").where("turn <= 2")
    return c.groupBy("conv_id").agg(F.md5(od.joined_in_order("text", ["turn"], " ")).alias("digest"), F.bool_or(F.col("role") == "system").alias("has_system"))


@query(rf"WITH {_PIECES}, s AS (SELECT *, CASE WHEN regexp_matches(text, '^[a-z]') AND NOT regexp_matches(coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY para_index), '.'), '[.!?:]$') THEN 0 ELSE 1 END AS new FROM para), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY para_index) AS island FROM s) SELECT doc_id, CAST(island AS BIGINT) AS para, count(*) AS n_pieces, md5(string_agg(text, ' ' ORDER BY para_index)) AS digest FROM i GROUP BY doc_id, island")
def continuation_merge(spark, sf):
    p = _para(spark, sf)
    last = F.coalesce(F.lag("text").over(W.partitionBy("doc_id").orderBy("para_index")), F.lit("."))
    p = p.withColumn("_new", ~(F.col("text").rlike("^[a-z]") & ~last.rlike("[.!?:]$")))
    i = od.islands(p, ["doc_id"], ["para_index"], F.col("_new"))
    return i.groupBy("doc_id", F.col("island").alias("para")).agg(F.count(F.lit(1)).alias("n_pieces"), F.md5(od.joined_in_order("text", ["para_index"], " ")).alias("digest"))


@query(rf"WITH {_PIECES} SELECT regexp_replace(text, '\d+', '#', 'g') AS signature, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM para WHERE length(text) <= 60 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def running_heads(spark, sf):
    p = _para(spark, sf).where(F.length("text") <= 60)
    return p.groupBy(F.regexp_replace("text", r"\d+", "#").alias("signature")).agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n")).where("n_docs >= 2")


@query("SELECT doc_id, len(regexp_extract_all(lower(text), 'the')) AS n_the, len(regexp_extract_all(lower(text), 'tion')) AS n_tion FROM documents")
def term_counts(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").select("doc_id", F.regexp_count(low, F.lit("the")).cast("long").alias("n_the"), F.regexp_count(low, F.lit("tion")).cast("long").alias("n_tion"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages) SELECT page_id, count(*) AS n_links, count(DISTINCT link) AS n_distinct FROM l GROUP BY page_id""")
def page_links(spark, sf):
    l = table(spark, sf, "pages").select("page_id", F.explode(tx.links(F.col("html"))).alias("link"))
    return l.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("link").alias("n_distinct"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS n, min(string_split(url, '/')[-1]) AS first_tag FROM pages GROUP BY 1")
def url_tags(spark, sf):
    p = table(spark, sf, "pages")
    return p.groupBy(tx.symbol_of_url(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.min(tx.model_tag(F.col("url"))).alias("first_tag"))


@query("SELECT CAST(ts - INTERVAL 7 HOUR AS DATE) AS day, count(*) AS requests_used, 950 - count(*) AS remaining FROM events GROUP BY 1")
def quota_by_day(spark, sf):
    e = table(spark, sf, "events").groupBy(num.quota_day(F.col("ts"), 7).alias("day")).agg(F.count(F.lit(1)).alias("requests_used"))
    return e.withColumn("remaining", 950 - F.col("requests_used"))


@query("WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' OR value < 20 THEN 1 ELSE 0 END AS miss FROM events), g AS (SELECT *, sum(1 - miss) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e), r AS (SELECT user_id, island, sum(miss) AS run FROM g GROUP BY ALL) SELECT user_id, CAST(max(run) AS BIGINT) AS longest_miss FROM r GROUP BY user_id")
def consecutive_misses(spark, sf):
    e = table(spark, sf, "events").withColumn("miss", ((F.col("event_type") == "error") | (F.col("value") < 20)).cast("int"))
    g = od.islands(e, ["user_id"], ["ts", "event_id"], F.col("miss") == 0)
    return g.groupBy("user_id", "island").agg(F.sum("miss").alias("run")).groupBy("user_id").agg(F.max("run").alias("longest_miss"))


# A reply of each kind: status, body, seconds to wait, what the reply means.
_REPLIES = (
    (200, '{"choices": [{"message": {"content": "x"}, "finish_reason": "stop"}]}', 0, "ok"),
    (200, '{"choices": [{"message": {"content": "x"}, "finish_reason": "length"}]}', 0, "server"),
    (200, '{"error": {"code": 429, "message": "slow down"}}', 0, "rate_limit"),
    (200, '{"error": {"message": "Daily limit reached"}}', 0, "daily_quota"),
    (200, '{"error": "upstream failed"}', 0, "server"),
    (200, "no json", 0, "server"),
    (429, "slow down", 5, "rate_limit"),
    (429, "slow down", 3600, "daily_quota"),
    (429, "Rate limit: free-models-per-day", 0, "daily_quota"),
    (401, "", 0, "auth"),
    (402, "no credit", 0, "daily_quota"),
    (404, "gone", 0, "model_gone"),
    (400, "response_format is not supported", 0, "json_mode_unsupported"),
    (422, "bad input", 0, "bad_request"),
    (408, "", 0, "server"),
    (503, "", 0, "server"),
    (None, None, 0, "network"),
)
_KINDS = " ".join(f"WHEN {i} THEN '{r[3]}'" for i, r in enumerate(_REPLIES))


@query(f"""SELECT CASE event_id % {len(_REPLIES)} {_KINDS} END AS outcome, count(*) AS n,
  round(avg(least(60.0, 2.0 * power(2, event_id % 7))), 6) AS mean_wait FROM events GROUP BY 1""")
def reply_outcomes(spark, sf):
    """Replies of every kind, classified; the SQL states the outcome meant for each."""
    pick = lambda i, kind: F.element_at(F.array(*[F.lit(r[i]).cast(kind) for r in _REPLIES]), (F.col("event_id") % len(_REPLIES) + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", pick(0, "int").alias("status"), pick(1, "string").alias("body"), pick(2, "int").alias("wait"))
    return e.groupBy(num.http_outcome(F.col("status"), F.col("body"), F.col("wait")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(num.backoff(F.col("event_id") % 7 + 1)), 6).alias("mean_wait"))


@query("SELECT event_id, CASE WHEN value > 1 THEN 1.0 WHEN value < 0 THEN 0.0 ELSE round(value, 6) END AS confidence, '{\"k\": ' || json_extract_string(props, '$.k') || '}' AS reply FROM events")
def reply_cleaning(spark, sf):
    """Fenced replies back to their object; confidences held to 0..1."""
    fenced = F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return table(spark, sf, "events").select("event_id", F.round(rp.confidence_of(F.try_parse_json(F.col("value").cast("string"))), 6).alias("confidence"), tx.strip_fences(fenced).alias("reply"))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY CAST(date_trunc('day', ts) AS DATE)), 6) AS share FROM events GROUP BY 1, 2")
def daily_prevalence(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("day")), 6))


@query(r"WITH " + _PIECES + r" SELECT CASE WHEN regexp_matches(text, '^The[ ,.]') THEN 'opens' WHEN regexp_matches(text, '[Ll]icense') THEN 'license' WHEN " + _N_WORDS + r" <= 3 THEN 'short' ELSE 'none' END AS rule, count(*) AS n FROM para GROUP BY 1")
def rule_hits(spark, sf):
    c = F.when(F.col("text").rlike(r"^The[ ,.]"), "opens").when(F.col("text").rlike("[Ll]icense"), "license").when(tx.word_count(F.col("text")) <= 3, "short").otherwise("none")
    return _para(spark, sf).groupBy(c.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, b.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, sha1(text) AS k FROM documents WHERE doc_id % 3 = 0) b ON d.doc_id = b.doc_id AND sha1(d.text) = b.k")
def provenance_flag(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("k"))
    old = d.where("doc_id % 3 = 0").distinct().withColumn("known", F.lit(True))
    return d.join(old, ["doc_id", "k"], "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"WITH {UNITS}, r AS (SELECT bloc, country, status, count(*) AS n FROM units GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY bloc, status ORDER BY md5(country || '|7'), country) AS i FROM r) SELECT bloc, status, country, n FROM k WHERE i <= 2")
def country_sample(spark, sf):
    r = units(spark, sf).groupBy("bloc", "country", "status").agg(F.count(F.lit(1)).alias("n"))
    return od.top(r, ["bloc", "status"], [sm.draw_order("country", 7), "country"], 2, "i").select("bloc", "status", "country", "n")
