"""Nested JSON replies against a codebook, as VARIANT values.

A reply is an object keyed "1".."n", one key a paragraph, of lists of annotation
objects. JSON types survive (a number in quotes is no confidence), and a reply is
taken or refused as a whole: ``checked`` adds the first fault in reading order
(keys, then list by list, annotation by annotation), ``reply_rows`` explodes the
accepted ones to one row a dimension. Everything is an expression over one row, so
there is no shuffle, and what a row costs hangs on its own reply alone.

Defined cases: a null reply is no JSON; an object that repeats a key is no JSON;
null for a list is an empty list; values that are null, blank or NONE in any case
say nothing, and so does an annotation of such values, whatever else it lacks; a
confidence that is no JSON number is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx

from .codebook import Codebook, Dimension

BLANKS = " \t\r\n"
OBJECT, LIST = "map<string,variant>", "array<variant>"


def _is(v: Column, *kinds: str) -> Column:
    """Whether the JSON value is of one of the kinds, by the name of its type. The
    name spells out all that the value holds, so it is asked of single values only;
    lists and objects are told by reading them as such."""
    return F.coalesce(tx.let(F.schema_of_variant(v), lambda name: reduce(lambda a, b: a | b, [name.startswith(k) for k in kinds])), F.lit(False))


def _text(v: Column) -> Column:
    return F.btrim(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")), F.lit(BLANKS))


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", LIST)


def value_of(d: Dimension, given: Column) -> Column:
    """The code that an annotation gives a dimension: NONE for nothing; of a list
    its first element."""
    return tx.let(given, lambda given: _value(given, _list(given)))


def _value(given: Column, listed: Column) -> Column:
    picked = tx.let(listed, lambda listed: F.when(listed.isNotNull(), F.get(listed, F.lit(0))).otherwise(given))
    return tx.let(_text(picked), lambda v: F.when((v == "") | (F.upper(v) == "NONE"), "NONE").otherwise(v))


def confidence_of(given: Column) -> Column:
    """A JSON number, held to 0..1; anything else is null."""
    held = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_variant_get(v, "$", "double")))
    return tx.let(given, lambda v: F.when(_is(v, "DECIMAL", "BIGINT", "DOUBLE", "FLOAT"), held(v)))


def _annotation(cb: Codebook, x: Column) -> Column:
    """What is read of one element of a list."""

    def read(fields: Column) -> Column:
        at = lambda name: F.try_element_at(fields, F.lit(name))
        known = reduce(lambda a, b: a | b, [F.map_contains_key(fields, d.name) for d in cb.dimensions])
        given = F.array(*[tx.let(at(d.name), lambda v: F.struct(_list(v).isNotNull().alias("listed"), _value(v, _list(v)).alias("value"))) for d in cb.dimensions])
        return tx.let(given, lambda given: F.struct(
            fields.isNotNull().alias("object"),
            F.coalesce(known, F.lit(False)).alias("known"),
            F.transform(given, lambda g: g["listed"]).alias("listed"),
            F.transform(given, lambda g: g["value"]).alias("given"),
            tx.let(at("evidence"), lambda v: F.when(_is(v, "STRING"), _text(v)).otherwise("")).alias("evidence"),
            confidence_of(at("confidence")).alias("confidence"),
        ))

    return tx.let(F.try_variant_get(x, "$", OBJECT), read)


def read(cb: Codebook, reply: Column, n_units: Column) -> Column:
    """struct(json, object, keys, units): ``units`` holds of every paragraph
    whether its value is a list, and its annotations."""

    def unit(given: Column) -> Column:
        anns = lambda xs: F.transform(xs, lambda x: _annotation(cb, x))
        return tx.let(_list(given), lambda xs: F.struct((xs.isNotNull() | F.coalesce(F.is_variant_null(given), F.lit(False))).alias("list"), anns(xs).alias("anns")))

    numbers = F.when(n_units > 0, F.sequence(F.lit(1), n_units)).otherwise(F.array().cast("array<int>"))

    def whole(parsed: Column, top: Column) -> Column:
        units = F.transform(numbers, lambda i: tx.let(F.try_element_at(top, i.cast("string")), unit))
        return F.struct(parsed.isNotNull().alias("json"), top.isNotNull().alias("object"), F.map_keys(top).alias("keys"), units.alias("units"))

    return tx.let(F.try_parse_json(tx.strip_fences(reply)), lambda parsed: tx.let(F.try_variant_get(parsed, "$", OBJECT), lambda top: whole(parsed, top)))


def annotation_fault(cb: Codebook, a: Column) -> Column:
    """The first fault of one annotation, or null."""
    value = {d.name: F.get(a["given"], F.lit(i)) for i, d in enumerate(cb.dimensions)}
    silent = reduce(lambda x, y: x & y, [v == "NONE" for v in value.values()])
    tests = [(~a["object"], F.lit("no object")), (~a["known"], F.lit("no known dimension"))]
    for i, d in enumerate(cb.dimensions):
        v = value[d.name]
        if not d.multiple:
            tests.append((F.get(a["listed"], F.lit(i)), F.lit(f"{d.name}: a list")))
        tests.append(((v != "NONE") & ~v.isin(*d.codes), F.concat(F.lit(f"{d.name}: no code "), v)))
    tests.append((silent, F.lit(None).cast("string")))
    for d in cb.dimensions:
        v = value[d.name]
        if d.conditional_on:
            parent = value[d.conditional_on]
            met = parent.isin(*d.conditional_in) if d.conditional_in else parent != "NONE"
            tests.append(((v != "NONE") & ~met, F.lit(f"{d.name}: needs {d.conditional_on}")))
        if not d.allows_none:
            tests.append((v == "NONE", F.lit(f"{d.name}: required")))
    if cb.evidence_required:
        tests.append((a["evidence"] == "", F.lit("no evidence")))
    out = F.lit(None).cast("string")
    for test, say in tests[::-1]:
        out = F.when(test, say).otherwise(out)
    return out


def fault(cb: Codebook, r: Column) -> Column:
    """The first fault of a reply that was ``read``, or null."""
    named = lambda what, keys: tx.let(keys, lambda keys: F.when(F.size(keys) > 0, F.concat(F.lit(f"{what} keys "), F.array_join(keys, ", "))))
    want = F.transform(r["units"], lambda u, i: (i + 1).cast("string"))
    keys = tx.let(want, lambda want: F.coalesce(named("missing", F.array_except(want, r["keys"])), named("unexpected", F.array_sort(F.array_except(r["keys"], want)))))

    def unit(u: Column, i: Column) -> Column:
        each = F.transform(u["anns"], lambda a, j: F.concat(F.lit("key "), (i + 1).cast("string"), F.lit(", annotation "), j.cast("string"), F.lit(": "), annotation_fault(cb, a)))
        first = F.get(F.filter(each, lambda e: e.isNotNull()), F.lit(0))
        at = F.concat(F.lit("key "), (i + 1).cast("string"))
        return F.when(~u["list"], F.concat(at, F.lit(": no list"))).when(F.size(u["anns"]) > cb.max_annotations, F.concat(at, F.lit(": too many annotations"))).otherwise(first)

    first = F.get(F.filter(F.transform(r["units"], unit), lambda e: e.isNotNull()), F.lit(0))
    return F.when(~r["json"], "no JSON").when(~r["object"], "no object").otherwise(F.coalesce(keys, first))


def checked(cb: Codebook, replies: DataFrame, reply: str = "reply", n_units: str = "n_units") -> DataFrame:
    """``replies`` with ``parsed`` (see ``read``) and ``error``, null where the
    reply is accepted."""
    both = tx.let(read(cb, F.col(reply), F.col(n_units)), lambda r: F.struct(r.alias("parsed"), fault(cb, r).alias("error")))
    return replies.withColumn("_r", both).select(*replies.columns, "_r.parsed", "_r.error")


def reply_rows(cb: Codebook, replies: DataFrame, keys: list[str], paragraphs: str | None = None) -> DataFrame:
    """(keys, unit_no, annotation_index, dimension, value, evidence, confidence)
    of the accepted of ``checked`` replies, NONE left out; with ``paragraphs`` (an
    array of the texts sent) also verified: whether the evidence stands there."""
    texts = [paragraphs] if paragraphs else []
    # No filter before the reply is read, nor a plain explode, which brings one: a filter would read each reply once more.
    accepted = F.when(F.col("error").isNull(), F.col("parsed.units"))
    u = replies.select(*keys, *texts, F.posexplode_outer(accepted).alias("unit_no", "u")).where("unit_no is not null")
    a = u.select(*keys, *texts, (F.col("unit_no") + 1).alias("unit_no"), F.posexplode("u.anns").alias("annotation_index", "a"))
    names = F.array(*[F.lit(d.name) for d in cb.dimensions])
    v = F.filter(F.arrays_zip(names.alias("dimension"), F.col("a.given").alias("value")), lambda x: x["value"] != "NONE")
    told = [tx.evidence_found(F.col("a.evidence"), F.get(paragraphs, F.col("unit_no") - 1)).alias("verified")] if paragraphs else []
    a = a.select(*keys, "unit_no", "annotation_index", "a", *told)  # once an annotation, not once a dimension
    told = ["verified"] if paragraphs else []
    out = a.select(*keys, "unit_no", "annotation_index", "a.evidence", "a.confidence", *told, F.explode(v).alias("v"))
    return out.select(*keys, "unit_no", "annotation_index", "v.dimension", "v.value", "evidence", "confidence", *told)
