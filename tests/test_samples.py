"""Reading samples, panel gates, names to codes, passages: against plain loops."""

import contextlib
import hashlib
import io
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillon.functions import speech as sp
from quillon.functions import text as tx
from quillon.operators import evidence as ev
from quillon.operators import sampling as sm
from quillon.operators.panel import build_panel, gated_panel


def test_names_are_folded_as_plain_text_is(spark):
    def plain(name):
        key = "".join(c for c in unicodedata.normalize("NFKD", name.replace("’", "'").strip()) if not unicodedata.combining(c))
        letters = "".join(c for c in key if c.isascii() and c.isalpha()).upper()[:3]
        return sp.ISO3.get(key) or letters or "UNK"

    r, names = random.Random(12), []
    accents = "áàâäãåāăąçćčďèéêëēęěģíîïīñńňòóôöõōőŕřśšşţťúûüūůűýÿžźżłđøħŧ"
    for n in sp.ISO3:
        names += [n, f" {n} ", n.upper(), n.replace("'", "’"), "".join(unicodedata.normalize("NFC", c + r.choice(["́", "̈", "̄", ""])) if r.random() < 0.3 else c for c in n), n[: r.randrange(1, len(n))]]
    names += ["".join(r.choice(accents + "abcXYZ '-.1") for _ in range(r.randrange(9))) for _ in range(300)] + ["", " ", "--", "Łódź", "Turkiyé", "TÜRKIYE"]
    got = sp.with_iso3(spark.createDataFrame(list(enumerate(names)), "i int, name string"), "name").orderBy("i").collect()
    assert {r["name"]: r["iso3"] for r in got} == {n: plain(n) for n in names} and len(got) == len(names)


def test_reading_sample_against_a_plain_loop(spark):
    r = random.Random(13)
    codes = ["a", "b", "c", "d__NONE_ABSENT"]
    units = [(i, f"C{i % 3}" if i % 17 else None, f"P{i % 4}", *(int(r.random() < 0.3) for _ in codes)) for i in range(1200)]
    signatures = [("C0", "a", 3.0), ("C0", "b", 2.0), ("C0", "c", 1.0), ("C0", "d__NONE_ABSENT", 9.0), ("C1", "d__NONE_ABSENT", 5.0), ("C1", "a", None), ("C2", "c", 0.5), ("C2", "b", 0.5), ("C2", "a", -1.0)]
    u = spark.createDataFrame(units, "unit_id int, cluster string, phase string, a int, b int, c int, d__NONE_ABSENT int").repartition(4)
    s = spark.createDataFrame(signatures, "cluster string, code string, v_test double")
    got = sm.reading_sample(u, s, codes, seed=7, cell=20, top_codes=2)
    want = set()
    top = {"C0": ["a"], "C2": ["b", "c"]}  # the two best, those of absence left out
    for cell in {(x[1], x[2]) for x in units}:
        rows = []
        for x in units:
            if (x[1], x[2]) == cell:
                own = top.get(cell[0])
                matched = [c for c in own or [] if x[3 + codes.index(c)] == 1]
                if own is None or matched:
                    rows.append((hashlib.md5(f"{x[0]}|7".encode()).hexdigest(), x[0], "|".join(matched)))
        want |= {(*cell, i, m) for _, i, m in sorted(rows)[:20]}
    assert {(r["cluster"], r["phase"], r["unit_id"], r["matched"]) for r in got.collect()} == want
    with contextlib.redirect_stdout(io.StringIO()) as out:
        got.explain()
    assert "WindowGroupLimit" in out.getvalue()  # ranks beyond the cell don't reach the shuffle


def test_gates_are_counted_in_the_panel_s_own_pass(spark):
    r = random.Random(14)
    days = [f"2024-0{1 + k // 28}-{1 + k % 28:02d}" for k in range(140)]
    rows = [(i, f"g{min(i % 9, r.randrange(9))}", r.choice(days if i % 9 else days[:60]), r.random() < 0.7) for i in range(900)] + [(1000, "late", "2024-04-20", True), (1001, "g1", "2024-04-20", None)]
    units = spark.createDataFrame(rows, "unit_id int, country string, day string, denom boolean").withColumn("date", F.to_date("day"))
    event, window = "2024-03-01", ("2024-02-01", "2024-04-28")
    inside = [x for x in rows if window[0] <= x[2] <= window[1]]
    denom = [x for x in inside if x[3]]
    sides = {}
    for x in denom:
        sides.setdefault(x[1], set()).add(x[2] >= event)
    kept = [x for x in denom if len(sides[x[1]]) == 2]
    panel, dropped = gated_panel(units, event, window, F.col("denom"))
    jobs = spark.sparkContext.statusTracker()
    assert sorted(r["unit_id"] for r in panel.collect()) == sorted(x[0] for x in kept)
    before = len(jobs.getJobIdsForGroup())
    assert dropped() == {"skipped": None, "rows": len(inside), "dropped_denominator": len(inside) - len(denom), "groups": len(sides), "groups_dropped": sum(len(s) < 2 for s in sides.values()), "rows_dropped": len(denom) - len(kept), "rows_kept": len(kept)}
    assert len(jobs.getJobIdsForGroup()) == before  # no job of its own
    same = build_panel(units.where("denom"), event, window)
    assert sorted(map(tuple, panel.select("unit_id", "post", "m").collect())) == sorted(map(tuple, same.select("unit_id", "post", "m").collect()))
    none, why = gated_panel(units, event, window, F.col("denom"), span=("2024-02-10", "2024-12-31"))
    assert none.count() == 0 and "leaves the span" in why()["skipped"]
    some, told = gated_panel(units, event, window, F.col("denom"), span=("2024-01-15", "2024-12-31"))
    assert some.count() == len(kept) and told()["skipped"] is None


def test_passages_against_all_pairs(spark):
    r = random.Random(15)
    words = [f"w{i}" for i in range(40)] + ["The", "“said”", "–", "é"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 120)))) for i in range(150)] + [(900, None), (901, "")]
    passages = []
    for k in range(80):
        t = r.choice(docs[:150])[1].split()
        a = r.randrange(max(1, len(t)))
        own = " ".join(t[a : a + r.randrange(1, 14)])
        if k % 4 == 0 and len(t) > 30:
            own = " ".join(t[3:10]) + " ... " + " ".join(t[15:22])
        passages.append((k, (own[2:-1] if k % 3 == 0 else own.upper()) if k % 5 else own + " nowhere at all"))
    d, p = spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(passages, "item int, passage string")
    got = ev.find_passages(p, d, "item", "passage", "doc", "text")
    short = {x["item"] for x in ev.unindexed(p, "passage").collect()}
    want = p.crossJoin(d).where(tx.evidence_found(F.col("passage"), F.col("text"))).select("item", "doc")
    assert sorted(map(tuple, got.collect())) == sorted(tuple(x) for x in want.collect() if x["item"] not in short)
    assert got.count() > 20 and 0 < len(short) < 50
    with contextlib.redirect_stdout(io.StringIO()) as out:
        got.explain()
    assert not any(x in out.getvalue() for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c d e f")]), ([(1, "a b c d e f")], []), ([(1, None)], [(1, None)])])
def test_no_passages(spark, docs, items):
    d, p = spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(items, "item int, passage string")
    assert ev.find_passages(p, d, "item", "passage", "doc", "text").count() == 0
