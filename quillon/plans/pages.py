"""Documents set as pages: every line is a block of two lines of spans, odd
documents in one column and even ones in two, with heads, feet and bar codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import layout as ly

from .base import query, table

_HALF = "CAST(ceil(len(w) / 2.0) AS INT)"


def _spans(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    d = d.withColumn("w", F.expr("filter(split(t, ' '), x -> x <> '')")).where("size(w) > 0")
    d = d.withColumns({"page": F.expr("i div 6"), "slot": F.expr("i % 6"), "half": F.expr("cast(ceil(size(w) / 2.0) as int)")})
    d = d.withColumns({"two": F.col("doc_id") % 2 == 0, "cut": F.when(F.col("doc_id") % 3 == 0, "-").otherwise("")})
    box = "struct(if(two and slot >= 3, 320D, 50D) AS x0, if(two, 120D + (slot % 3) * 200, 120D + slot * 110) AS y0, if(two and slot < 3, 280D, 545D) AS x1)"
    lines = "array(struct(0 AS line, 0 AS span, true AS bold, concat(w[0], ' ') AS text), struct(0 AS line, 1 AS span, false AS bold, concat(array_join(slice(w, 2, half - 1), ' '), cut) AS text), struct(1 AS line, 0 AS span, false AS bold, array_join(slice(w, half + 1, size(w)), ' ') AS text))"
    text = d.selectExpr("doc_id", "page", "slot + 10 AS block", f"{box} AS b", "10D AS size", f"explode({lines}) AS s")
    pages = d.select("doc_id", "page").distinct()
    extra = "array(struct(1 AS block, 20D AS y0, 10D AS size, concat('Record ', doc_id, ' page ', page + 1) AS text), struct(2 AS block, 800D AS y0, 10D AS size, concat('24-', 10000 + page, ' (E)') AS text), struct(3 AS block, 400D AS y0, 30D AS size, 'BAR CODE' AS text))"
    extra = pages.selectExpr("doc_id", "page", f"explode({extra}) AS e").selectExpr("doc_id", "page", "e.block", "struct(50D AS x0, e.y0 AS y0, 545D AS x1) AS b", "e.size", "struct(0 AS line, 0 AS span, false AS bold, e.text AS text) AS s")
    return text.unionByName(extra).selectExpr("doc_id AS doc", "page", "block", "b.x0", "b.y0", "b.x1", "b.y0 + 60 AS y1", "595D AS width", "842D AS height", "size", "s.line", "s.span", "s.bold", "false AS italic", "s.text")


@query(rf"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS t FROM documents),
w AS (SELECT doc_id, i, i // 6 AS page, i % 6 AS slot, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM l),
b AS (SELECT *, {_HALF} AS half, doc_id % 2 = 0 AS two, w[1] || ' ' || array_to_string(w[2:{_HALF}], ' ') || CASE WHEN doc_id % 3 = 0 THEN '-' ELSE '' END AS a, array_to_string(w[{_HALF} + 1:], ' ') AS z FROM w WHERE len(w) > 0),
k AS (SELECT *, CASE WHEN two THEN 120 + slot % 3 * 200 ELSE 120 + slot * 110 END AS y, two AND slot >= 3 AS on_right FROM b),
f AS (SELECT doc_id, page, slot, y, on_right AND max(CASE WHEN two AND slot < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page) = 1 AS second, w[1] AS bold,
  trim(regexp_replace(CASE WHEN z = '' THEN a WHEN a LIKE '%-' THEN CASE WHEN regexp_matches(z, '^\p{{Ll}}') THEN substr(a, 1, length(a) - 1) ELSE a END || z WHEN a LIKE '% ' THEN a || z ELSE a || ' ' || z END, '\s+', ' ', 'g')) AS text
  FROM k WHERE NOT (page = 0 AND y < 200) AND w[1] IS NOT NULL)
SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, second, y, slot) - 1 AS INTEGER) AS para_index, bold AS bold_prefix, md5(text) AS digest FROM f""")
def page_paragraphs(spark, sf):
    """Paragraphs in reading order, from spans alone."""
    out = ly.page_paragraphs(_spans(spark, sf))
    return out.select(F.col("doc").alias("doc_id"), F.col("page").cast("int").alias("page"), "para_index", "bold_prefix", F.md5("text").alias("digest"))
