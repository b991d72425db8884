"""Text expressions, all on the JVM side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quotation marks and dashes, and the plain characters they are read as.
CURLY, STRAIGHT = "“”„«»‘’‚", "\"\"\"\"\"'''"
DASHES, HYPHEN = "–—‐‑", "----"
SPACE = r"(?U)\s+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it: a
    column that is named twice is an expression that is computed twice, inside a
    lambda once more for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalise_for_hash(c: Column) -> Column:
    return collapse(F.translate(c, CURLY, STRAIGHT))


def normalise_evidence(c: Column) -> Column:
    return F.lower(collapse(F.translate(F.translate(c, CURLY, STRAIGHT), DASHES, HYPHEN)))


def hash_id(*parts: Column, length: int = 16) -> Column:
    """Hex digest of the parts joined by NUL, cut to ``length``."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, length)


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def paragraphs(c: Column, separator: str = r"\n\s*\n") -> Column:
    """Pieces between separators, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(c, separator), lambda p: F.trim(p)), lambda p: p != "")


def before(c: Column, mark: str = "#") -> Column:
    return F.substring_index(c, mark, 1)


def symbol_key(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s()]", "")


def model_tag(c: Column, suffixes: tuple[str, ...] = (":free", ":beta", "-instruct", "-preview")) -> Column:
    """Last path segment, each of the suffixes taken off once; null: unknown."""
    out = F.element_at(F.split(c, "/"), -1)
    for s in suffixes:
        out = F.when(out.endswith(s), out.substr(F.lit(1), F.length(out) - len(s))).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def strip_fences(c: Column) -> Column:
    """The outermost braces of a reply, code fences gone."""
    braces = lambda plain: F.coalesce(F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit("")), F.trim(plain))
    return let(F.regexp_replace(c, r"```[A-Za-z]*", ""), braces)


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def tokens(c: Column, stop: tuple[str, ...] = (), least: int = 3) -> Column:
    """Distinct lower-case a-z tokens of at least ``least`` letters, without stop words."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)")), lambda t: F.length(t) >= least))
    return F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def evidence_found(evidence: Column, paragraph: Column, least: int = 8) -> Column:
    """Contained whole, or, where it is elided, its fragments of at least
    ``least`` characters in order."""

    def found(ev: Column, para: Column) -> Column:
        parts = F.filter(F.transform(F.split(ev, r"\.\.\.|…"), lambda p: F.trim(p)), lambda p: F.length(p) >= least)
        return F.contains(para, ev) | let(parts, lambda parts: (F.size(parts) > 0) & (ordered_fragments(parts, para) > 0))

    return let(normalise_evidence(evidence), lambda ev: let(normalise_evidence(paragraph), lambda para: found(ev, para)))


def ordered_fragments(parts: Column, text: Column) -> Column:
    """Position after the last fragment if all stand in ``text`` in order, else 0."""

    def step(at: Column, p: Column) -> Column:
        found = F.call_function("locate", p, text, at)
        return F.when((at == 0) | (found == 0), F.lit(0)).otherwise(found + F.length(p))

    return F.aggregate(parts, F.lit(1), step)


def symbol_of_url(c: Column) -> Column:
    return F.regexp_extract(c, r"^[a-z]+://([^/]+)", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))


def signature(c: Column) -> Column:
    """Digits masked, for running heads that differ by page number."""
    return F.regexp_replace(collapse(c), r"\d+", "#")


def dehyphenate(c: Column) -> Column:
    """Soft hyphens go; words cut at a line end are joined."""
    return F.regexp_replace(F.regexp_replace(c, "­", ""), r"([a-z])-\n([a-z])", "$1$2")


def joined_hash(static: Column, rest: Column) -> Column:
    """16 digits of the SHA-256 of two texts with a zero byte between them."""
    zero = F.unhex(F.lit("00"))
    return F.substring(F.sha2(F.concat(static.cast("binary"), zero, rest.cast("binary")), 256), 1, 16)


def alternates(names: Column) -> Column:
    """``A/B`` as an array of names."""
    return F.transform(F.split(names, "/"), lambda p: F.trim(p))


def numbered(cell: Column) -> Column:
    """The examples of a cell, each begun by a number and a point at the start of
    a line; without the number, white space collapsed, blank ones left out."""
    parts = F.split(cell, r"(?m)^\s*(?=\d+\.\s)")
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^\s*\d+\.\s*", ""), r"\s+", " ")))
    return F.filter(clean, lambda p: p != "")


def citation(source: Column, names: dict[str, str]) -> Column:
    """An attribution in one line, its country, in brackets at the end or after
    the last comma, by its stated name in brackets; ``names`` are lower-case."""
    plain = F.regexp_replace(collapse(source), "[,;]+$", "")
    stated = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    known = lambda c: F.try_element_at(stated, F.lower(F.trim(c)))
    bracket = F.regexp_extract(plain, r"\(([^)]+)\)$", 1)
    head = F.regexp_replace(plain, r"\s*\([^)]+\)$", "")
    last = F.regexp_extract(plain, r"^(.*),\s*([^,]+)$", 2)
    rest = F.regexp_extract(plain, r"^(.*),\s*([^,]+)$", 1)
    inside = F.concat(head, F.lit(" ("), F.coalesce(known(bracket), F.trim(bracket)), F.lit(")"))
    return F.when(bracket != "", inside).when(known(last).isNotNull(), F.concat(rest, F.lit(" ("), known(last), F.lit(")"))).otherwise(plain)
