"""Replies about orders: an order is a speech, its lines are the paragraphs sent.
A reply is written from the lines, and every tenth kind of order spoils it in
another way; reading it knows nothing of that."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import codebook as cbk
from quillon.operators import replies as rp

from .base import query, table

CODEBOOK = cbk.parse({"id": "lines", "version": 1, "title": "lines", "dimensions": [
    {"name": "flag", "categories": [{"code": c, "definition": f"returned as {c}"} for c in "ANR"]},
    {"name": "status", "required": False, "conditional_on": {"dimension": "flag", "in": ["A", "N"]}, "categories": [{"code": c, "definition": f"left as {c}"} for c in "FO"]},
    {"name": "grade", "scale": "ordinal", "required": False, "allow_multiple_values": True, "categories": [{"code": str(i), "value": i, "definition": f"grade {i} of discount"} for i in range(10)]},
]})

#: What stands for the first paragraph's value, by order modulo KINDS; the others are as they should be.
KINDS = 24
SPOILED = {
    3: None,  # no key at all
    4: '[], "99": []',
    5: '{"flag": "A"}',
    6: "null",
    7: '[{"flag": "A", "evidence": "e"}, {"flag": "A", "evidence": "e"}, {"flag": "A", "evidence": "e"}, {"flag": "A", "evidence": "e"}, {"flag": "A", "evidence": "e"}]',
    8: '["flag"]',
    9: '[{"colour": "red", "evidence": "e"}]',
    10: '[{"flag": ["A"], "evidence": "e"}]',
    11: '[{"flag": "Z", "evidence": "e"}]',
    12: '[{"flag": "none", "status": null, "grade": []}]',
    13: '[{"flag": "R", "status": "F", "evidence": "e"}]',
    14: '[{"flag": "", "grade": "1", "evidence": "e"}]',
    15: '[{"flag": "A"}]',
    16: '[{"flag": "A", "evidence": 5}]',
    17: '[{"flag": "A", "evidence": "e", "confidence": "0.7"}]',
    18: '[{"flag": "A", "evidence": "e", "confidence": 1.5}]',
    19: '[{"flag": "A", "evidence": "e", "confidence": true}]',
    21: '[{"flag": "A", "grade": ["1", "0"], "evidence": "e"}, {"flag": "N", "grade": 2, "evidence": "e", "confidence": -1}]',
}
_PARAGRAPH = "concat('Part ', l_partkey, ' of supplier ', l_suppkey, ', returned as ', l_returnflag, ' and left as ', l_linestatus)"
#: Whole, elided, or nowhere.
_EVIDENCE = "CASE l_partkey % 3 WHEN 0 THEN concat('Part ', l_partkey, ' of ... returned AS ', l_returnflag) WHEN 1 THEN concat('of  supplier ', l_suppkey) ELSE 'no such words' END"
_ANSWER = f"""concat('[{{"flag": "', l_returnflag, CASE WHEN l_returnflag = 'R' THEN '' ELSE concat('", "status": "', l_linestatus) END, '", "grade": "', CAST(floor(l_discount * 100) AS INT) % 10, '", "evidence": "', {_EVIDENCE}, '", "confidence": ', l_tax, '}}]')"""
_FIRST = f"CASE unit_id % {KINDS} " + " ".join(f"WHEN {k} THEN '\"1\": {v}'" for k, v in SPOILED.items() if v) + " WHEN 3 THEN NULL ELSE concat('\"1\": ', answer) END"
_PART = f"CASE WHEN no = 1 THEN {_FIRST} ELSE concat('\"', no, '\": ', answer) END"
_REPLY = f"CASE unit_id % {KINDS} WHEN 1 THEN concat('{{', parts) WHEN 2 THEN concat('[', n_units, ']') WHEN 20 THEN concat('So: ```json', chr(10), '{{', parts, '}}', chr(10), '```') ELSE concat('{{', parts, '}}') END"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag, l_linestatus, l_discount, l_tax"


def _replies(spark, sf):
    """unit_id, n_units, texts, reply: one row an order."""
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey AS unit_id", f"{_PARAGRAPH} AS text", f"{_ANSWER} AS answer", f"struct({_ORDER}) AS place")
    got = lines.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("place", "text", "answer"))).alias("lines"), F.count(F.lit(1)).cast("int").alias("n_units"))
    parts = F.expr(f"array_join(transform(lines, (x, i) -> {_PART.replace('no =', 'i + 1 =').replace('no,', 'i + 1,').replace('answer', 'x.answer')}), ', ')")
    return got.withColumn("parts", parts).select("unit_id", "n_units", F.col("lines.text").alias("texts"), F.expr(_REPLY).alias("reply"))


#: The same replies, and each annotation with the JSON type of what it says.
_SQL = rf"""WITH l AS (SELECT l_orderkey AS unit_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS no, {_PARAGRAPH} AS text, {_ANSWER.replace('CAST(floor(l_discount * 100) AS INT)', 'CAST(floor(l_discount * 100) AS INTEGER)')} AS answer FROM lineitem),
r AS (SELECT unit_id, count(*) AS n_units, string_agg({_PART}, ', ' ORDER BY no) AS parts, list(text ORDER BY no) AS texts FROM l GROUP BY unit_id),
b AS (SELECT *, {_REPLY} AS reply FROM r),
s AS (SELECT unit_id, n_units, texts, CASE WHEN regexp_matches(reply, '(?s)\{{.*\}}') THEN regexp_extract(reply, '(?s)\{{.*\}}') ELSE reply END AS body FROM b),
j AS (SELECT unit_id, n_units, texts, CASE WHEN json_valid(body) THEN body END AS body FROM s),
o AS (SELECT *, CASE WHEN body IS NULL THEN 'no JSON' WHEN json_type(body) <> 'OBJECT' THEN 'no object' END AS top,
  CASE WHEN json_type(body) = 'OBJECT' THEN json_keys(body) END AS keys FROM j),
k AS (SELECT *, list_filter(list_transform(range(1, n_units + 1), lambda i: CAST(i AS VARCHAR)), lambda i: NOT list_contains(keys, i)) AS missing,
  list_sort(list_filter(keys, lambda x: NOT list_contains(list_transform(range(1, n_units + 1), lambda i: CAST(i AS VARCHAR)), x))) AS extra FROM o),
u AS (SELECT unit_id, texts, unnest(range(1, n_units + 1)) AS no, body, json_extract(body, '$."' || CAST(unnest(range(1, n_units + 1)) AS VARCHAR) || '"') AS given FROM k WHERE top IS NULL),
f1 AS (SELECT unit_id, no, -1 AS pos, 0 AS rank, 'key ' || no || CASE WHEN json_type(given) NOT IN ('ARRAY', 'NULL') THEN ': no list' ELSE ': too many annotations' END AS said
  FROM u WHERE json_type(given) NOT IN ('ARRAY', 'NULL') OR json_type(given) = 'ARRAY' AND json_array_length(given) > 4),
a AS (SELECT unit_id, texts, no, unnest(range(CAST(json_array_length(given) AS BIGINT))) AS pos, json_extract(given, '$[' || CAST(unnest(range(CAST(json_array_length(given) AS BIGINT))) AS VARCHAR) || ']') AS x FROM u WHERE json_type(given) = 'ARRAY'),
d AS (SELECT unit_id, texts, no, pos, x, unnest(['flag', 'status', 'grade']) AS dim, unnest([1, 2, 3]) AS rank FROM a),
v AS (SELECT *, json_type(x, '$.' || dim) AS kind, trim(coalesce(CASE WHEN json_type(x, '$.' || dim) = 'ARRAY' THEN json_extract_string(x, '$.' || dim || '[0]') ELSE json_extract_string(x, '$.' || dim) END, '')) AS raw FROM d),
w AS (SELECT *, CASE WHEN raw = '' OR upper(raw) = 'NONE' THEN 'NONE' ELSE raw END AS value FROM v),
g AS (SELECT unit_id, no, pos, any_value(x) AS x, any_value(texts) AS texts, max(CASE WHEN dim = 'flag' THEN value END) AS flag, max(CASE WHEN dim = 'status' THEN value END) AS status, max(CASE WHEN dim = 'grade' THEN value END) AS grade,
  count(kind) > 0 AS known, bool_or(coalesce(kind, '') = 'ARRAY' AND dim <> 'grade') AS listed FROM w GROUP BY ALL),
h AS (SELECT *, trim(CASE WHEN json_type(x, '$.evidence') = 'VARCHAR' THEN json_extract_string(x, '$.evidence') ELSE '' END) AS evidence,
  CASE WHEN json_type(x, '$.confidence') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN least(1.0, greatest(0.0, CAST(json_extract(x, '$.confidence') AS DOUBLE))) END AS confidence FROM g),
f2 AS (SELECT unit_id, no, pos, 0 AS rank, CASE WHEN json_type(x) <> 'OBJECT' THEN 'no object' WHEN NOT known THEN 'no known dimension' WHEN listed THEN 'flag: a list'
   WHEN flag NOT IN ('NONE', 'A', 'N', 'R') THEN 'flag: no code ' || flag WHEN status NOT IN ('NONE', 'F', 'O') THEN 'status: no code ' || status WHEN grade NOT IN ('NONE', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9') THEN 'grade: no code ' || grade
   WHEN flag = 'NONE' AND status = 'NONE' AND grade = 'NONE' THEN NULL WHEN flag = 'NONE' THEN 'flag: required' WHEN status <> 'NONE' AND flag = 'R' THEN 'status: needs flag' WHEN evidence = '' THEN 'no evidence' END AS said FROM h),
f AS (SELECT unit_id, no, pos, said FROM f1 UNION ALL SELECT unit_id, no, pos, 'key ' || no || ', annotation ' || pos || ': ' || said FROM f2 WHERE said IS NOT NULL),
first AS (SELECT unit_id, arg_min(said, (no, pos)) AS said FROM f GROUP BY unit_id),
e AS (SELECT k.unit_id, coalesce(top, CASE WHEN len(missing) > 0 THEN 'missing keys ' || array_to_string(missing, ', ') WHEN len(extra) > 0 THEN 'unexpected keys ' || array_to_string(extra, ', ') END, said) AS error FROM k LEFT JOIN first ON k.unit_id = first.unit_id)
"""
_FOUND = r"CASE WHEN contains(p, ev) THEN true ELSE len(fr) > 0 AND list_reduce(list_prepend(1, list_transform(fr, lambda z: 0)), lambda acc, z: acc) = 1 AND strpos(p, fr[1]) > 0 AND (len(fr) = 1 OR strpos(substr(p, strpos(p, fr[1]) + length(fr[1])), fr[2]) > 0) END"


@query(_SQL + "SELECT unit_id, error FROM e")
def reply_faults(spark, sf):
    """The first fault of every order's reply; null for those accepted."""
    return rp.checked(CODEBOOK, _replies(spark, sf)).select("unit_id", "error")


@query(_SQL + rf""", t AS (SELECT h.*, lower(trim(regexp_replace(evidence, '\s+', ' ', 'g'))) AS ev, lower(trim(regexp_replace(texts[no], '\s+', ' ', 'g'))) AS p FROM h JOIN e ON h.unit_id = e.unit_id WHERE error IS NULL),
t2 AS (SELECT *, list_filter(list_transform(string_split(ev, '...'), lambda z: trim(z)), lambda z: length(z) >= 8) AS fr FROM t),
t3 AS (SELECT *, {_FOUND} AS verified FROM t2)
SELECT unit_id, CAST(no AS INTEGER) AS unit_no, CAST(pos AS INTEGER) AS annotation_index, dimension, value, evidence, confidence, verified FROM (
  SELECT t3.*, unnest(['flag', 'status', 'grade']) AS dimension, unnest([flag, status, grade]) AS value FROM t3) WHERE value <> 'NONE'""")
def reply_rows(spark, sf):
    """One row a dimension of every accepted reply, its evidence checked."""
    return rp.reply_rows(CODEBOOK, rp.checked(CODEBOOK, _replies(spark, sf)), ["unit_id"], "texts")
