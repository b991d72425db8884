"""Spans of pages to paragraphs in reading order.

Input is a table of spans: the document, page and block they belong to, line and
span numbers in the block, the block's box (x0, y0, x1, y1), the page's width and
height, font size, bold, italic, text. Nothing hangs on the order of its rows.

1. Spans make blocks, one row each.
2. Blocks go that no body text has: other font sizes, the cover's masthead, junk,
   and running heads: a block in a margin band whose text, digits masked, recurs in
   the document. Heads are counted by document and text and joined back.
3. A page whose blocks keep to both sides of its middle has two columns; blocks
   are read by page, column, height and block number.
4. Lines of a block are joined, words cut at line ends made whole.
5. Paragraphs that a column or page cut in two are joined again.

Windows run over a page or a document. Defined cases: blocks of blank spans are
none; null text is blank; a document without body text has no rows; rows of a null
document are one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# What is neither text nor heading.
JUNK = r"(?i)^(?:\d{2}-\d{5}\s*(?:\(E\))?\s*(?:\*\d+\*)?|\*\d+\*|Accessible ?document|Please ?recycle|Official Records|Provisional|Agenda)\s*$"
STOPS = r"[.!?:;”\"’\)]\s*$"


@dataclass(frozen=True)
class Page:
    """What tells body text from the rest; sizes and heights in points."""

    least_size: float = 9.5
    most_size: float = 12.1
    masthead: float = 200
    band: float = 0.12  # of the height, at the top and at the bottom
    repeats: int = 2  # a head recurs at least so often
    head_chars: int = 120


def _blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def masked(text: Column, most: int = 120) -> Column:
    """Digits as one sign, so that page numbers make no difference."""
    return F.substring(F.regexp_replace(text, r"\d+", "#"), 1, most)


def in_margin(y0: Column, y1: Column, height: Column, band: float) -> Column:
    middle = (y0 + y1) / 2 / height
    return ~((middle > band) & (middle < 1 - band))


def blocks(spans: DataFrame) -> DataFrame:
    """One row a block: its box, its spans in order, its largest font size."""
    s = F.struct("line", "span", "size", "bold", "italic", F.coalesce("text", F.lit("")).alias("text"))
    one = [F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1", "width", "height")]
    b = spans.groupBy("doc", "page", "block").agg(F.array_sort(F.collect_list(s)).alias("spans"), *one)
    written = F.filter("spans", lambda x: ~_blank(x["text"]))
    b = b.withColumns({"all": F.trim(F.array_join("spans.text", "")), "written": written}).where(F.size("written") > 0)
    return b.withColumns({"raw": F.trim(F.array_join("written.text", "")), "largest": F.array_max("written.size")})


def body(b: DataFrame, p: Page = Page()) -> DataFrame:
    """The blocks of body text."""
    margin = in_margin(F.col("y0"), F.col("y1"), F.col("height"), p.band)
    heads = b.where(margin).groupBy(F.col("doc").alias("of"), masked(F.col("all"), p.head_chars).alias("head")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.repeats)
    cover = (F.col("page") == 0) & (F.col("y0") < p.masthead)
    kept = b.where(F.col("largest").between(p.least_size, p.most_size) & ~cover & ~F.col("raw").rlike(JUNK))
    return kept.join(heads, margin & F.col("doc").eqNullSafe(F.col("of")) & (masked(F.col("raw"), p.head_chars) == F.col("head")), "left_anti")


def in_reading_order(b: DataFrame, to: str = "place") -> DataFrame:
    """Blocks numbered through their document from 0."""
    page, middle = W.partitionBy("doc", "page"), F.col("width") / 2
    left, right = (F.max(c.cast("int")).over(page) for c in (F.col("x1") < middle, F.col("x0") > middle))
    column = F.when((left == 1) & (right == 1), (F.col("x0") >= middle).cast("int")).otherwise(0)
    b = b.withColumn("column", column)
    return b.withColumn(to, F.row_number().over(W.partitionBy("doc").orderBy("page", "column", F.round("y0", 1), "block")) - 1)


def _joined(whole: Column, line: Column) -> Column:
    """A line behind what stands already."""
    lower = F.substring(line, 1, 1).rlike(r"^\p{Ll}")
    cut = F.concat(F.when(lower, F.regexp_replace(whole, "-$", "")).otherwise(whole), F.ltrim(line))
    spaced = (whole != "") & ~whole.endswith(" ") & ~line.startswith(" ")
    return F.when(whole.endswith("-"), cut).when(spaced, F.concat(whole, F.lit(" "), line)).otherwise(F.concat(whole, line))


def tidy(c: Column) -> Column:
    """Soft hyphens go with the space they bring, white space is collapsed, none stands inside brackets."""
    c = F.replace(F.regexp_replace(c, "(?U)­\\s*", ""), F.lit("​"), F.lit(""))
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\( ", "("), r" \)", ")"))


def built(b: DataFrame) -> DataFrame:
    """doc, page, place, text, bold_prefix, all_bold, all_italic of blocks."""
    lines = F.transform(F.array_distinct("spans.line"), lambda n: F.array_join(F.transform(F.filter("spans", lambda s: s["line"] == n), lambda s: s["text"]), ""))
    text = F.aggregate(F.filter(lines, lambda x: x != ""), F.lit(""), _joined)
    # The bold spans before the first that says something and is not bold.
    plain = F.array_position(F.transform("spans", lambda s: ~s["bold"] & ~_blank(s["text"])), True)
    head = F.when(plain > 0, F.slice("spans", F.lit(1), (plain - 1).cast("int"))).otherwise(F.col("spans"))
    prefix = F.trim(F.array_join(F.transform(F.filter(head, lambda s: s["bold"]), lambda s: s["text"]), ""))
    all_of = lambda name: F.forall("written", lambda s: s[name]).alias(f"all_{name}")
    out = b.select("doc", "page", "place", tidy(text).alias("text"), prefix.alias("bold_prefix"), all_of("bold"), all_of("italic"))
    return out.where("text <> ''")


def continued(p: DataFrame) -> DataFrame:
    """Paragraphs that go on in the next place as one: doc, page (of the first
    part), para_index, text, bold_prefix."""
    at = W.partitionBy("doc").orderBy("place")
    before = F.lag("text").over(at)
    goes_on = (F.col("bold_prefix") == "") & before.isNotNull() & ~before.rlike(STOPS) & F.substring("text", 1, 1).rlike(r"^\p{Ll}")
    p = p.withColumn("_new", (~goes_on).cast("int"))
    p = p.withColumn("para_index", F.sum("_new").over(at.rowsBetween(W.unboundedPreceding, 0)) - 1)
    parts = p.groupBy("doc", "para_index").agg(F.array_sort(F.collect_list(F.struct("place", "page", "text", "bold_prefix"))).alias("parts"))
    text = F.aggregate(F.transform("parts", lambda x: x["text"]), F.lit(""), lambda a, x: F.when(a == "", x).when(a.endswith("-"), F.concat(F.regexp_replace(a, "-$", ""), x)).otherwise(F.concat(a, F.lit(" "), x)))
    first = F.get("parts", F.lit(0))
    return parts.select("doc", first["page"].alias("page"), F.col("para_index").cast("int"), text.alias("text"), first["bold_prefix"].alias("bold_prefix"))


def page_paragraphs(spans: DataFrame, p: Page = Page()) -> DataFrame:
    """Spans to paragraphs: doc, page, para_index, text, bold_prefix."""
    return continued(built(in_reading_order(body(blocks(spans), p))))
