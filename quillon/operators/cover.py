"""Cover pages: symbol, date, number, president and the roster of a meeting, from
a text of many lines.

The roster is read by a machine over the lines: a line with dot leaders names a
country, with a person behind the dots or on a later line; a person's line closes
what is pending. The machine is an aggregate over the array of lines with a struct
as its state, so a cover is one row from first to last and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import speech as sp
from quillon.functions import text as tx

# How covers write symbol, date, number and president.
SYMBOL = r"\b((?:A|S|E)/[A-Za-z0-9./\-]*PV\.\s?\d+(?:\s*\(Resumption\s*\d+\))?)"
DATE = r"(?U)(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),\s*(\d{1,2}\s+\w+\s+\d{4})"
NUMBER = r"(?i)(\d+)(?:st|nd|rd|th)\s+(?:plenary\s+)?meeting"
PRESIDENT = r"(?s)President:\s*(.+?)\((.+?)\)"
LEADERS = r"(?:\s*[.…]){3,}"
PERSON = rf"^(?:{sp.TITLES})\b\.?\s+\S"
ENTRIES = "array<struct<person:string,country:string>>"


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" .,"))


def entries(lines: Column) -> Column:
    """(person, country) of the lines of a roster, in order."""
    start = F.struct(F.lit("").alias("pending"), F.array().cast(ENTRIES).alias("found"))

    def read(line: Column) -> Column:
        """What the machine asks of a line: no pattern is tried twice, and that of the leaders on lines with a dot alone."""
        parts = F.when(F.contains(line, F.lit(".")) | F.contains(line, F.lit("…")), F.split(line, LEADERS, 2)).otherwise(F.array(line))

        def told(parts: Column) -> Column:
            leaders = F.size(parts) == 2
            return tx.let(F.when(leaders, _trimmed(parts[1])).otherwise(line), lambda rest: F.struct(leaders.alias("leaders"), F.when(leaders, _trimmed(parts[0])).alias("head"), rest.alias("rest"), rest.rlike(PERSON).alias("person")))

        return tx.let(parts, told)

    def step(s: Column, x: Column) -> Column:
        add = lambda country: F.array_append(s["found"], F.struct(x["rest"].alias("person"), country.alias("country")))
        whole = x["leaders"] & x["person"]
        late = ~x["leaders"] & (s["pending"] != "") & x["person"]
        pending = F.when(whole | late, "").when(x["leaders"], x["head"]).otherwise(s["pending"])
        found = F.when(whole, add(x["head"])).when(late, add(s["pending"])).otherwise(s["found"])
        return F.struct(pending.alias("pending"), found.alias("found"))

    return F.aggregate(F.transform(lines, read), start, step, lambda s: s["found"])


def roster(found: Column) -> Column:
    """Surname to country, alternates split; of a name twice the first entry counts."""
    people = F.flatten(F.transform(F.filter(found, lambda e: e["country"] != ""), lambda e: F.transform(tx.alternates(e["person"]), lambda p: F.struct(sp.surname(p).alias("surname"), e["country"].alias("country")))))
    people = F.filter(people, lambda p: p["surname"] != "")

    def firsts(people: Column) -> Column:
        names = F.transform(people, lambda p: p["surname"])
        return tx.let(names, lambda names: F.map_from_entries(F.filter(people, lambda p, i: F.array_position(names, p["surname"]) == i + 1)))

    return tx.let(people, firsts)


def cover(text: Column) -> Column:
    """struct(doc_symbol, meeting_date, meeting_number, president_name,
    president_country, entries): empty strings where the text does not say."""

    def read(text: Column, flat: Column) -> Column:
        president = lambda i: F.regexp_replace(F.regexp_extract(flat, PRESIDENT, i), r"(?U)\s+", " ")
        after = F.substring_index(F.regexp_replace(text, r"(?s)^.*?Members:", "\u0000"), "Agenda", 1)
        lines = F.filter(F.transform(F.split(F.replace(after, F.lit("\u0000"), F.lit("")), "\n"), lambda x: tx.collapse(x)), lambda x: x != "")
        lines = F.when(F.contains(text, F.lit("Members:")), lines).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.trim(F.regexp_replace(F.regexp_extract(text, SYMBOL, 1), r"\s+", " ")).alias("doc_symbol"),
            F.regexp_extract(text, DATE, 2).alias("meeting_date"),
            F.regexp_extract(text, NUMBER, 1).alias("meeting_number"),
            _trimmed(president(1)).alias("president_name"),
            F.trim(president(2)).alias("president_country"),
            entries(lines).alias("entries"),
        )

    return tx.let(F.coalesce(text, F.lit("")), lambda text: tx.let(F.regexp_replace(text, "[.…]{2,}", " "), lambda flat: read(text, flat)))


def read_covers(covers: DataFrame, text: str = "text") -> DataFrame:
    """``covers`` with the fields of their covers, the president at the roster's end.
    Take names from the roster by ``explode_outer``: before a plain ``explode`` Spark
    sets a filter on the roster's size, which reads every cover once more."""

    def whole(c: Column) -> Column:
        chair = F.struct(c["president_name"].alias("person"), c["president_country"].alias("country"))
        return F.struct(c.alias("c"), roster(F.concat(c["entries"], F.array(chair))).alias("roster"))

    c = covers.withColumn("_c", tx.let(cover(F.col(text)), whole))
    return c.select(*covers.columns, *[f"_c.c.{n}" for n in ("doc_symbol", "meeting_date", "meeting_number", "president_name", "president_country")], "_c.roster")
