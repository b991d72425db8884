"""Queries over meeting records: speakers' headers, rosters, pilot records and
draws, citations, waiting times."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import numbers as num
from quillon.functions import speech as sp
from quillon.functions.text import citation
from quillon.operators import matrix as mx
from quillon.operators import sampling as sm

from .base import ANN, UNITS, annotations, query, table, units

# Opening paragraphs of turns, with what they say of the speaker: name, country, language, role.
_TURNS = (
    ("Mr. Nebenzia (Russian Federation) (spoke in Russian): We thank you.", "Mr. Nebenzia", "Russian Federation", "Russian", "representative"),
    ("The President: I give the floor.", "The President", "NATION_C", "English", "president"),
    ("Mrs. Shino (United States of America): It is late.", "Mrs. Shino", "United States", "English", "representative"),
    ("Ms. DiCarlo (Department of Political Affairs): I brief.", "Ms. DiCarlo", "", "", "official/briefer"),
    ("Dr.  Lund  (Jordan. Deputy Prime Minister): Yes.", "Dr. Lund", "Jordan", "English", "representative"),
    ("Mr. Roster: I am on the list.", "Mr. Roster", "Listland", "English", "representative"),
    ("Agenda item 3: The question", None, None, None, None),
    ("No header here", None, None, None, None),
    ("Sir Ash (continued) (Malta): So,", "Sir Ash", "Malta", "English", "representative"),
)


def _case(i: int, key: str = "o_orderkey") -> str:
    told = " ".join(f"WHEN {n} THEN '{t[i]}'" for n, t in enumerate(_TURNS) if t[i] is not None)
    return f"CASE {key} % {len(_TURNS)} {told} END"


@query(f"""SELECT o_orderkey AS turn_id, {_case(1)} AS name, {_case(2)} AS country, {_case(3)} AS language, {_case(4)} AS role
FROM orders WHERE {_case(1)} IS NOT NULL""")
def speaker_headers(spark, sf):
    """Headers split from their paragraphs and parsed; the SQL states what is meant by each."""
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("turn_id"), F.expr(_case(0)).alias("text"))
    t = t.withColumn("header", sp.header_of(F.col("text"))).where("header is not null")
    roster = F.when(sp.surname(F.regexp_replace("header", r"\([^()]*\)", "")) == "Roster", "Listland")
    return t.select("turn_id", sp.speaker_of(F.col("header"), F.lit("NATION_C"), roster).alias("s")).select("turn_id", "s.name", "s.country", "s.language", "s.role")


@query("""WITH p AS (
  SELECT n_nationkey AS line, trim(regexp_replace(unnest(string_split('Mr. ' || r_name || '/Ms. ' || n_name, '/')), '^(Mr|Ms)\\. ', '')) AS surname, n_name AS country
  FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT surname, arg_min(country, line) AS country FROM p GROUP BY surname""")
def roster(spark, sf):
    """Surnames of a cover's roster, alternates split; of a name twice the first line counts."""
    from quillon.functions.text import alternates
    from quillon.operators.relational import first_of

    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    p = n.select(F.col("n_nationkey").alias("line"), F.explode(alternates(F.concat(F.lit("Mr. "), "r_name", F.lit("/Ms. "), "n_name"))).alias("person"), F.col("n_name").alias("country"))
    p = p.select("line", sp.surname(F.col("person")).alias("surname"), "country")
    return first_of(p, ["surname"], ["line"]).select("surname", "country")


@query(f"""WITH {UNITS}, {ANN}, a AS (SELECT unit_id, annotation_index, returnflag, CASE WHEN linestatus = 'F' THEN linestatus END AS linestatus, verified FROM ann WHERE returnflag <> 'N')
SELECT u.unit_id, u.speech_id, coalesce(CAST(annotation_index AS VARCHAR), '') AS annotation_index, coalesce(returnflag, 'NONE') AS returnflag, coalesce(linestatus, 'NONE') AS linestatus,
  CASE verified WHEN 1 THEN 'yes' WHEN 0 THEN 'NO' ELSE '' END AS evidence_verified
FROM units u LEFT JOIN a ON u.unit_id = a.unit_id WHERE u.status <> 'P'""")
def pilot_records(spark, sf):
    """One row per annotation with its dimensions as columns, NONE where one is
    missing; a unit without annotations has one row."""
    long = annotations(spark, sf).where("returnflag <> 'N'").unpivot(["unit_id", "annotation_index", "verified"], ["returnflag", "linestatus"], "dimension", "value").where("not (dimension = 'linestatus' and value = 'O')")
    return mx.records(units(spark, sf).where("status <> 'P'").select("unit_id", "speech_id"), long, ["returnflag", "linestatus"])


@query(f"""WITH {UNITS}, s AS (SELECT speech_id, max(bloc) AS bloc, count(*) AS n FROM units GROUP BY speech_id),
r AS (SELECT *, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS m FROM s),
c AS (SELECT max(CASE WHEN i = m // 3 THEN n END) AS c1, max(CASE WHEN i = 2 * m // 3 THEN n END) AS c2 FROM r),
t AS (SELECT speech_id, bloc || ' | ' || CASE WHEN n <= c1 THEN 0 WHEN n <= c2 THEN 1 ELSE 2 END AS stratum FROM s, c),
z AS (SELECT stratum, count(*) AS size, 40 * count(*) / sum(count(*)) OVER () AS e FROM t GROUP BY stratum),
q AS (SELECT *, floor(e) + CASE WHEN row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, stratum) <= 40 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS n_h FROM z)
SELECT t.speech_id, t.stratum FROM t JOIN q ON t.stratum = q.stratum
QUALIFY row_number() OVER (PARTITION BY t.stratum ORDER BY md5(t.speech_id || '|42'), t.speech_id) <= n_h""")
def pilot_draw(spark, sf):
    """Forty speeches, stratified by bloc and tercile of length, drawn in hash order."""
    s = units(spark, sf).groupBy("speech_id").agg(F.max("bloc").alias("bloc"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("stratum", F.concat_ws(" | ", F.coalesce("bloc", F.lit("NO_BLOC")), sm.quantile_of(s, "n", 3)))
    sizes = s.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    return sm.draw(s.select("speech_id", "stratum"), "speech_id", sm.largest_remainder(sizes, 40), 42).select("speech_id", "stratum")


_CITED = "CASE n_nationkey % 4 WHEN 0 THEN 'S/PV.9442,  Nebenzia (rusia),' WHEN 1 THEN 'S/PV.9841, Joyini, Afrika Selatan' WHEN 2 THEN 'Lund, Nowhere;' ELSE 'Plain' END"


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'S/PV.9442, Nebenzia (Russia)' WHEN 1 THEN 'S/PV.9841, Joyini (South Africa)' WHEN 2 THEN 'Lund, Nowhere' ELSE 'Plain' END AS source FROM nation""")
def citations(spark, sf):
    """Attributions with the country by its stated name, in brackets; the SQL states what is meant by each."""
    names = {"rusia": "Russia", "afrika selatan": "South Africa"}
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), citation(F.expr(_CITED), names).alias("source"))


@query("""SELECT event_id, CASE WHEN date_trunc('day', ts) + INTERVAL 5 HOUR > ts THEN date_trunc('day', ts) + INTERVAL 5 HOUR ELSE date_trunc('day', ts) + INTERVAL 29 HOUR END AS next_reset,
  CASE event_id % 3 WHEN 0 THEN CAST(event_id % 50 AS DOUBLE) WHEN 1 THEN 0.0 END AS wait FROM events""")
def waiting_times(spark, sf):
    """When the quota begins anew, and what Retry-After headers ask for: seconds, a past date, nonsense."""
    header = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 50).cast("string")).when(F.col("event_id") % 3 == 1, "Mon, 02 Jan 1995 03:04:05 GMT").otherwise("soon")
    now = F.col("ts").cast("timestamp")
    wait = num.retry_after(header, now)
    return table(spark, sf, "events").select("event_id", num.next_reset(now, 5).alias("next_reset"), F.when(F.col("event_id") % 3 < 2, wait).alias("wait"))


#: An order is a meeting; the nations of its customer's region sit on it, every second one with the name a line below.
_DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _cores(spark) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _covers(spark, sf):
    names = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"
    t = lambda n: table(spark, sf, n)
    line = "concat(n_name, ' . . . . . . ', if(n_nationkey % 2 = 0, '\n', ''), if(n_nationkey % 3 = 0, concat('Mr. First', n_nationkey, '/Ms. Other', n_nationkey), concat('Mrs. Name', n_nationkey % 7)), if(n_nationkey % 5 = 0, '\n\nObservers and guests', ''))"
    seats = t("nation").selectExpr("n_regionkey", "n_nationkey", f"{line} AS line").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))).getField("line"), "\n").alias("lines"))
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation").join(F.broadcast(seats), "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    # An order is few bytes, its cover much work: the rows are dealt to all cores while they are thin.
    o = o.select("o_orderkey", "o_orderdate", "c_custkey", "n_name", "lines").repartition(_cores(spark), "o_orderkey")
    day = f"concat({names(_DAYS)}[dayofweek(o_orderdate) - 1], ', ', day(o_orderdate), ' ', {names(_MONTHS)}[month(o_orderdate) - 1], ' ', year(o_orderdate))"
    head = f"concat('United Nations\nS/PV.', if(o_orderkey % 2 = 0, ' ', ''), o_orderkey, if(o_orderkey % 7 = 0, ' (Resumption 1)', ''), '\nSecurity Council\n', o_orderkey % 90, if(o_orderkey % 4 = 0, 'TH plenary', 'th'), ' meeting\n', if(o_orderkey % 5 = 0, '', {day}), ', 10 a.m.\nNew York\n')"
    chair = "concat('President: Mr.  Chair', c_custkey, ' . . . . . . \n(', n_name, ')\n')"
    return o.selectExpr("o_orderkey AS meeting", f"concat({head}, if(o_orderkey % 11 = 0, '', {chair}), 'Members:\n', lines, '\nAgenda\nNobody . . . . . Mr. Late') AS text")


@query("""WITH m AS (SELECT o_orderkey AS k, o_orderdate AS d, c_custkey, nation.* FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT n_regionkey AS r, n_nationkey AS pos, unnest(CASE WHEN n_nationkey % 3 = 0 THEN ['First' || n_nationkey, 'Other' || n_nationkey] ELSE ['Name' || n_nationkey % 7] END) AS surname, n_name AS country FROM nation),
s AS (SELECT k, surname, country, pos FROM m JOIN p ON n_regionkey = r UNION ALL SELECT k, 'Chair' || c_custkey, n_name, 99 FROM m WHERE k % 11 <> 0)
SELECT k AS meeting, 'S/PV.' || CASE WHEN k % 2 = 0 THEN ' ' ELSE '' END || k || CASE WHEN k % 7 = 0 THEN ' (Resumption 1)' ELSE '' END AS doc_symbol,
  CASE WHEN k % 5 = 0 THEN '' ELSE day(d) || ' ' || monthname(d) || ' ' || year(d) END AS meeting_date, CAST(k % 90 AS VARCHAR) AS meeting_number,
  CASE WHEN k % 11 = 0 THEN '' ELSE 'Mr. Chair' || c_custkey END AS president_name, surname, arg_min(s.country, s.pos) AS country
FROM s JOIN m USING (k) GROUP BY ALL""")
def cover_rosters(spark, sf):
    """Covers read from their texts, a row a name of the roster."""
    from quillon.operators import cover as cv

    c = cv.read_covers(_covers(spark, sf))
    return c.select("meeting", "doc_symbol", "meeting_date", "meeting_number", "president_name", F.explode_outer("roster").alias("surname", "country")).where("surname is not null")
