"""Operators against plain Python on small tables."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import numbers as num
from quillon.functions import stats
from quillon.functions import text as tx
from quillon.operators import replies as rp
from quillon.operators import rules as ru
from quillon.operators import cluster as cl
from quillon.operators import matrix as mx
from quillon.operators import ordered as od
from quillon.operators import panel as pn
from quillon.operators import sampling as sm
from quillon.operators import segment as sg
from quillon.operators import store as st
from quillon.operators.monitor import require, sanity
from quillon.operators.relational import corpus_rule, include_when


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_inherit_is_the_fold(spark):
    r = random.Random(0)
    rows = [(g, i, r.random() < 0.3, r.random() < 0.4) for g in range(40) for i in range(12)]
    got = {(x["g"], x["i"]): x["v"] for x in od.inherit(spark.createDataFrame(rows, "g int, i int, hit boolean, q boolean"), ["g"], ["i"], F.col("hit"), F.col("q"), "v").collect()}
    for g in range(40):
        last = False
        for _, i, hit, q in (x for x in rows if x[0] == g):
            last = hit or (q and last)
            assert got[g, i] == last


def test_runs_modes_and_cut_points(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate("xxyyyxz")] + [("b", 0, None), ("b", 1, None), ("b", 2, "x")], "g string, i int, v string")
    got = [r["run"] for r in od.runs(df, ["g"], ["i"], "v").where("g = 'a'").orderBy("i").collect()]
    assert got == [1, 1, 2, 2, 2, 3, 4]
    assert [r["run"] for r in od.runs(df, ["g"], ["i"], "v").where("g = 'b'").orderBy("i").collect()] == [1, 1, 2]
    assert [r["mode"] for r in od.mode_of(df.where("g = 'a'"), ["g"], "v").collect()] == ["x"]
    assert od.cut_points(spark.createDataFrame([(x,) for x in [1, 1, 1, 2, 5, 9]], "v int"), "v", 3) == [1, 2]


def test_hash_ids_are_those_of_hashlib(spark):
    import hashlib

    want = hashlib.sha256("s#1\x003\x00it's “plain” \"x\"".replace("“", '"').replace("”", '"').encode()).hexdigest()[:16]
    got = one(spark, tx.hash_id(F.col("s"), F.col("i"), tx.normalise_for_hash(F.col("t"))), s="s#1", i=3, t="  it’s\xa0 “plain”\n\"x\" ")
    assert got == want


@pytest.mark.parametrize("evidence,found", [("quick brown", True), ("THE  “quick”", False), ("the quick…lazy dog over", False), ("the quick brown ... the lazy dog", True), ("the lazy dog ... quick brown", False), ("fox", True), ("", True)])
def test_evidence(spark, evidence, found):
    assert one(spark, tx.evidence_found(F.col("e"), F.col("p")), e=evidence, p="The quick brown fox jumps over the lazy dog.") is found


def test_scalars(spark):
    assert one(spark, tx.model_tag(F.col("m")), m="org/some-model-instruct:free") == "some-model"
    assert one(spark, tx.strip_fences(F.col("m")), m='x\n```json\n{"a": 1}\n``` y') == '{"a": 1}'
    conf = rp.confidence_of(F.try_parse_json("m"))
    assert [one(spark, conf, m=x) for x in ("1.7", "-2", "0.25", "1", '"0.7"', "true", "null", "high")] == [1.0, 0.0, 0.25, 1.0, None, None, None, None]
    assert one(spark, num.long_date(F.col("m")), m="7 March 2024") == date(2024, 3, 7) and one(spark, num.long_date(F.col("m")), m="soon") is None
    assert one(spark, tx.dehyphenate(F.col("m")), m="inter-\nnational") == "international"
    assert one(spark, num.bucket_of(F.col("m"), (0, 5, 10)), m=7) == "5-9" and one(spark, num.bucket_of(F.col("m"), (0, 5, 10)), m=70) == "10+"


def test_segments(spark):
    words = " ".join(["word"] * 16)
    turns = spark.createDataFrame([("S", 1, f"I thank all. {words}\n\n“{words}\n \n{words}\n\nshort\n\n“{words}", "X")], "doc_symbol string, turn_index int, speech string, country string")
    got = [(r["para_index"], r["para_is_procedural"]) for r in sg.units_of(turns, ru.parse([{"pattern": "^I thank"}, {"name": "quote", "kind": ru.INHERIT}])).orderBy("para_index").collect()]
    assert got == [(0, 1), (1, 1), (2, 0), (4, 0)]


def test_matrix_keeps_absence_apart(spark):
    u = spark.createDataFrame([(1,), (2,), (3,)], "unit_id int")
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "NONE"), (2, "other")], "unit_id int, d string")
    got = {r["unit_id"]: r.asDict() for r in mx.code_matrix(u, a, {"d": ("x", "NONE")}).collect()}
    assert got[1] == {"unit_id": 1, "d__x": 1, "d__NONE": 1, "d__NONE_ABSENT": 0}
    assert got[2]["d__NONE_ABSENT"] == 1 and got[3]["d__NONE_ABSENT"] == 1 and got[3]["d__x"] == 0
    c = mx.counts_by(mx.code_matrix(u, a, {"d": ("x", "NONE")}).withColumn("g", F.lit("g")), "g", ["d__x", "d__NONE", "d__NONE_ABSENT"])
    assert abs(sum(mx.clr(c, {"d": ("x", "NONE")}).select("d__x", "d__NONE", "d__NONE_ABSENT").first())) < 1e-12


def test_store_views(spark):
    log = spark.createDataFrame([(1, "ok", 1, 10, 1), (1, "error", 2, 20, 2), (2, "error", 1, 5, 1), (2, "ok", 1, 9, 2)], "unit_id int, status string, attempts int, updated_at int, attempt_id int")
    got = {r["unit_id"]: (r["status"], r["attempts"], r["created_at"]) for r in st.latest_jobs(log, ["unit_id"]).collect()}
    assert got == {1: ("error", 3, 10), 2: ("ok", 2, 5)}
    ann = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (2, 1, "old")], "unit_id int, attempt_id int, value string")
    assert [r["value"] for r in st.live_annotations(ann, log, ["unit_id"]).collect()] == ["b"]
    with pytest.raises(ValueError):
        st.guard_stable_ids(log.select("unit_id"), log.where("unit_id = 1").select("unit_id"), "unit_id")


def test_sampling(spark):
    frame = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(90)], "id long, stratum string")
    sizes = frame.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    alloc = sm.largest_remainder(sizes, 10)
    out = sm.draw(frame, "id", alloc, 3)
    assert out.count() == 10 and abs(out.agg(F.sum("weight")).first()[0] - 90) < 1e-9
    assert {r["id"] for r in out.collect()} == {r["id"] for r in sm.draw(frame.repartition(7), "id", alloc, 3).collect()}
    assert sm.allocate({"a": 3, "b": 50, "c": 50}, 40, scheme="equal") == {"a": 3, "b": 19, "c": 18}
    assert sum(sm.allocate({"a": 7, "b": 11}, 100).values()) == 18


def test_filters(spark):
    df = spark.createDataFrame([("S/PV", False, 5), ("A/PV", False, 5), ("A/PV", True, 0)], "series string, on_agenda boolean, n_terms int")
    assert df.where(corpus_rule("agenda")).count() == 1 and df.where(corpus_rule("agenda-or-council-terms", 3)).count() == 2
    with pytest.raises(ValueError):
        include_when(df, {"nope": 1})
    with pytest.raises(ValueError):
        require(sanity([("rows", 5, df.agg(F.count(F.lit(1))))]))


def test_ward_against_brute_force():
    g = np.random.default_rng(0)
    for _ in range(10):
        x = g.standard_normal((9, 3))
        groups, cost = [[i] for i in range(9)], []
        within = lambda own: ((x[own] - x[own].mean(0)) ** 2).sum()
        while len(groups) > 1:
            best = min(((within(a + b) - within(a) - within(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
            cost.append(np.sqrt(2 * best[0]))
            groups = [q for k, q in enumerate(groups) if k not in best[1:]] + [groups[best[1]] + groups[best[2]]]
        assert np.allclose(stats.ward(x)[:, 2], cost)


def test_statistics():
    g = np.random.default_rng(1)
    counts = g.integers(1, 50, (8, 5)).astype(float)
    ca = stats.correspondence(counts, 4)
    e = np.outer(counts.sum(1), counts.sum(0)) / counts.sum()
    assert np.isclose(ca["eigenvalues"].sum(), ((counts - e) ** 2 / e).sum() / counts.sum())
    assert np.allclose(ca["row_mass"] @ ca["rows"], 0) and np.allclose(stats.project_rows(counts, ca), ca["rows"])
    assert np.allclose(ca["contributions"].sum(0), 1)
    a, b = [0, 0, 1, 1, 2], [5, 5, 6, 6, 7]
    assert stats.adjusted_rand(a, b) == 1 and abs(stats.adjusted_rand([0, 0, 1, 1], [0, 1, 0, 1]) + 0.5) < 1e-12
    label, q = stats.louvain(8, [(i, j, 1.0) for c in (range(4), range(4, 8)) for i in c for j in c if i < j] + [(0, 4, 0.1)])
    assert len(set(label[:4])) == 1 and len(set(label)) == 2 and q > 0.4
    from itertools import permutations

    for n, m in ((4, 4), (3, 6)):
        cost = g.random((n, m))
        got = stats.assignment(cost)
        assert np.isclose(sum(cost[i, j] for i, j in enumerate(got)), min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n)))
    assert len(set(stats.assignment(g.random((5, 3))))) == 3
    s = stats.silhouette(np.array([[0.0], [1.0], [10.0]]), np.array([1, 1, 2]))
    assert np.allclose(s, [0.9, 8 / 9, 0])
    assert abs(stats.normal_p(-0.1044, 0.0346) - 0.00256) < 2e-4


def test_within_estimator_is_dummies(spark):
    g = np.random.default_rng(2)
    rows = [(f"c{i % 6}", int(d), float(g.random() < 0.5)) for i in range(400) for d in [g.integers(-90, 90)]]
    df = spark.createDataFrame([(c, d, y, int(d >= 0), d / 30.4375, max(d, 0) / 30.4375) for c, d, y in rows], "country string, date int, y double, post int, m double, post_m double")
    fit = pn.linear(df)
    x = np.array([[d >= 0, d / 30.4375, max(d, 0) / 30.4375, *[c == f"c{k}" for k in range(6)]] for c, d, _ in rows], float)
    y = np.array([r[2] for r in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose([fit["coef"][c] for c in pn.REGRESSORS], beta[:3])
    inv, res = np.linalg.inv(x.T @ x), y - x @ beta
    score = np.array([(x * res[:, None])[[r[0] == f"c{k}" for r in rows]].sum(0) for k in range(6)])
    cov = inv @ (score.T @ score) @ inv * (6 / 5) * (399 / (400 - 9))
    assert np.allclose([fit["se"][c] for c in pn.REGRESSORS], np.sqrt(np.diag(cov))[:3])
    wls = pn.linear(pn.cells(df), weight="w")
    assert np.allclose(list(wls["coef"].values()), list(fit["coef"].values()))
    logit = pn.logistic(df)
    b = np.array([logit["coef"][c] for c in pn.REGRESSORS])
    assert np.isfinite(b).all() and np.sign(b[0]) == np.sign(beta[0])


def test_event_window_and_alignment():
    assert pn.event_window("2024-01-01", ["2024-03-17", "2023-10-07"]) == ("2023-07-05", "2024-03-17")
    x = np.array([[0.0], [0.1], [5.0], [5.1]])
    assert cl.align(x, np.array([2, 2, 1, 1]), x, np.array([1, 1, 2, 2])) == {1: 2, 2: 1}


def test_bootstrap(spark):
    import pandas as pd

    p = pd.DataFrame([("a", 1, 0, 50), ("a", 0, 1, 2), ("b", 1, 0, 45), ("b", 0, 1, 3), ("c", 1, 0, 3), ("c", 0, 1, 60), ("d", 0, 1, 40)], columns=["g", "x", "y", "n"])
    reps = cl.replicates(spark, p, "g", ["x", "y"], [slice(0, 2)], [2], 12).drop("k").cache()
    base = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "g string, label int")
    got = cl.stability(reps, base, "g").collect()
    assert all(r["mean_jaccard"] > 0.8 for r in got)
    co = {(r["a"], r["b"]): r["share"] for r in cl.co_clustering(reps, "g").collect()}
    assert all(co[x, x] == 1 for x in "abcd") and co["a", "b"] > 0.8 and all(co[a, b] == co[b, a] for a, b in co)
    names, counts = cl.resampled(p, "g", ["x", "y"], 1)
    assert names == list("abcd") and counts.sum(1).tolist() == [52, 48, 63, 40]
