"""The filter audit against plain loops over documents and orders."""

import random
import re
from itertools import permutations

import duckdb
import pytest

from quillon.llm import queries as q
from quillon.llm.audit import audit, first_failures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """{(part, order, step): counts}, document by document."""
    fails = []
    for i, (n, text, part) in enumerate(docs):
        t = text or ""
        w = WORD.findall(t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        own["E"] = any((u or "") == t and m is not None and n is not None and m < n for m, u, _ in docs)
        fails.append((part or "", own, any(d == n and n is not None and y == 1 for d, y, _ in labels), any(d == n and n is not None and x == 1 for d, _, x in labels)))
    out = {}
    for part in {p for p, *_ in fails}:
        mine, removed = [f for f in fails if f[0] == part], {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                gone, left = [f for f in left if f[1][c]], [f for f in left if not f[1][c]]
                removed[c] = removed.get(c, 0) + len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f[1][c] for f in mine) - len(gone), sum(f[1][c] and sum(f[1].values()) == 1 for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return out


def told(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def rows():
    r = random.Random(4)
    kinds = ["word", "Word", "WORD", "a#b", "é", "x|y", "", "W"]
    texts = [" ".join(r.choice(kinds) + (str(r.randrange(900)) if r.random() < 0.7 else "") for _ in range(r.choice((3, 150, 199, 200, 260)))) for _ in range(70)]
    docs = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(150)]
    same = " ".join(f"w{i}" for i in range(220))
    docs += [(500, same, "en"), (500, same, "en"), (500, same, "fr"), (501, same, "fr"), (None, same, "fr"), (None, None, None), (502, None, "en"), (503, "", "en"), (500, "other", "fr")]
    docs += [(600, " \t\n ", "en"), (601, "w\x0bv\xa0u " * 100, "en"), (602, "Z " * 40_000, "de")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 0), (500, 1, 1), (501, 0, 1), (9999, 1, 1), (None, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_plain_loops(spark):
    docs, labels = rows()
    got = told(audit(*frames(spark, docs, labels)))
    assert got == plain(docs, labels) and len(got) == 600 * 4


def test_the_table_names_the_first_failure():
    table, orders = first_failures(), list(map("".join, permutations("ABCDE")))
    assert table.shape == (32, 120) and (table[0] == 5).all()
    for n in range(32):
        for k, order in enumerate(orders):
            assert table[n, k] == next((s for s, c in enumerate(order) if n >> "ABCDE".index(c) & 1), 5)


def test_many_parts_and_extra_columns(spark):
    docs = [(i, "word " * (i % 300), f"p{i % 700}") for i in range(1400)]
    table, labels = frames(spark, docs, [(3, 1, 1)])
    out = audit(table.selectExpr("*", "1 as part", "2 as fails", "3 as n", "'x' as digest", "4 as id"), labels.selectExpr("*", "5 as of", "6 as part"))
    assert out.groupBy("part").count().where("count = 600").count() == 700
    own = [d for d in docs if d[2] == 'p3']
    assert all(v[0] <= len(own) and v[1] + v[2] <= len(own) for v in told(out.where("part = 'p3'")).values())


@pytest.mark.parametrize("which", ["documents", "labels"])
def test_empty(spark, which):
    docs, labels = frames(spark, [(1, "a", "en")] * (which == "labels"), [(1, 1, 1)] * (which == "documents"))
    assert audit(docs, labels).count() == (600 if which == "labels" else 0)


def test_query_agrees_with_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = q.op13_filter_audit(spark, sf).toPandas(), con.execute(q.OP13_SQL).df()
    order = ["part", "filter_order", "step"]
    assert got.sort_values(order)[sorted(got)].astype(str).values.tolist() == want.sort_values(order)[sorted(want)].astype(str).values.tolist()
