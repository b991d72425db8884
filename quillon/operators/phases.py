"""Phases of a corpus: merging those under a floor, spans of one model, labels."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .graph import adjusted_rand


@dataclass(frozen=True)
class Phase:
    name: str
    start: dt.date
    end: dt.date

    def joined(self, other: "Phase") -> "Phase":
        """Both as one; named by the numbers and the outer suffixes of the two."""
        first, last = sorted((self, other), key=lambda p: p.start)
        numbers = sorted(int(n) for p in (first, last) for n in re.findall(r"P(\d+)", p.name))
        bare = [re.sub(r"^P\d+(?:-P\d+)?_", "", p.name) for p in (first, last)]
        head, tail = bare[0].split("_to_")[0], bare[1].split("_to_")[-1]
        return Phase(f"P{numbers[0]}-P{numbers[-1]}_{head}" + (f"_to_{tail}" if tail != head else ""), min(self.start, other.start), max(self.end, other.end))


def by_day(units: DataFrame, meeting: str = "meeting_id", day: str = "date") -> DataFrame:
    """(day, meetings, paragraphs): as many rows as days, whatever the corpus.
    A meeting has one day, so its counts add up over days."""
    return units.groupBy(F.col(day).alias("day")).agg(F.count_distinct(meeting).alias("meetings"), F.count(F.lit(1)).alias("paragraphs"))


def merged_phases(days: list[tuple[dt.date, int, int]], phases: list[Phase], meetings: int = 8, paragraphs: int = 1500) -> list[Phase]:
    """Phases in order, the smallest one under a floor joined to its smaller
    neighbour (the earlier of equals) until none is under a floor."""
    def size(p: Phase) -> tuple[int, int]:
        inside = [(n, m) for day, m, n in days if p.start <= day <= p.end]
        return sum(n for n, _ in inside), sum(m for _, m in inside)

    now = sorted(phases, key=lambda p: p.start)
    while len(now) > 1:
        sizes = [size(p) for p in now]
        low = [i for i, (n, m) in enumerate(sizes) if n < paragraphs or m < meetings]
        if not low:
            break
        i = min(low, key=lambda i: (*sizes[i], i))
        j = min((k for k in (i - 1, i + 1) if 0 <= k < len(now)), key=lambda k: (sizes[k][0], k))
        now = sorted([p for k, p in enumerate(now) if k not in (i, j)] + [now[i].joined(now[j])], key=lambda p: p.start)
    return now


def large_enough(countries: int, most_clusters: int = 8) -> bool:
    """Whether a phase has the countries that clustering it takes."""
    return countries >= most_clusters + 1


def model_runs(unit_models: DataFrame) -> DataFrame:
    """From (unit_id, model, meeting_id, date): one row for each run of meetings
    in date order that one model dominates: model, start, end, meetings, and the
    units of any model (total) and of that model (own) between its days."""
    daily = unit_models.groupBy("date", "meeting_id", "model").agg(F.count(F.lit(1)).alias("n"))
    modal = daily.groupBy("date", "meeting_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "model"))["model"].alias("model"))
    order = W.orderBy("date", "meeting_id")  # as many rows as meetings
    changed = (~F.col("model").eqNullSafe(F.lag("model").over(order))).cast("int")
    runs = modal.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order))
    runs = runs.groupBy("run", "model").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count_distinct("meeting_id").alias("meetings"))
    per_day = daily.groupBy(F.col("date").alias("day"), F.col("model").alias("by")).agg(F.sum("n").alias("n"))
    # Runs and days are few, so this range join is small whatever the corpus.
    inside = runs.join(per_day, F.col("day").between(F.col("start"), F.col("end")))
    counted = inside.groupBy("run", "model", "start", "end", "meetings").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("by") == F.col("model"), F.col("n")).otherwise(0)).alias("own"))
    return counted.select("run", "model", "start", "end", "meetings", "total", "own", (F.col("own") / F.col("total")).alias("purity"))


def model_span(unit_models: DataFrame) -> DataFrame:
    """The run with most units of its own model (the earliest of equals)."""
    return model_runs(unit_models).orderBy(F.col("own").desc(), "start").limit(1)


def clipped(start: dt.date, end: dt.date, event: dt.date, low: dt.date, high: dt.date) -> tuple[dt.date, dt.date] | None:
    """An event's window inside a model's span; None if the event is not inside
    or the window is empty on one side."""
    a, z = max(start, low), min(end, high)
    return (a, z) if a < event <= z else None


def agreement_index(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, adjusted Rand index and share of equal labels of two labellings."""
    same = pairs.agg(F.avg((F.col(a) == F.col(b)).cast("int")).alias("same_label"))
    return adjusted_rand(pairs, a, b).crossJoin(same)  # one row each


def best_agreement(share, clusters: int):
    """Two clusters can be named either way."""
    return F.greatest(share, 1 - share) if clusters == 2 else share
