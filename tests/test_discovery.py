"""Phases, groups and regressions against plain versions of themselves."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import speech as sp
from quillon.operators import ordered as od
from quillon.operators import panel as pn
from quillon.operators import phases as ph
from quillon.operators import sampling as sm
from quillon.operators import store as st
from quillon.operators.graph import nearest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_groups_are_told_from_those_that_join_them(spark):
    said = {
        "I have the pleasure to deliver this statement on behalf of the Arab Group.": "Arab Group",
        "We align ourselves with the statement delivered on behalf of the European Union.": None,
        "We are delivering this statement. Others spoke on behalf of the OIC.": None,
        "Some spoke on behalf of the OIC! I am speaking on behalf of Nordic countries, too.": "Nordic countries",
        "I speak, and on behalf of the African Union": "African Union",
        "": None,
    }
    for text, group in said.items():
        assert one(spark, sp.group_of(F.col("t")), t=text) == group, text
    assert one(spark, sp.in_national_capacity(F.col("t")), t="I shall now Resume my functions as President.")


def test_speaker_classes_in_order(spark):
    rows = [("official/briefer", 1, True, "X", True, "A", "briefer"), ("president", 1, True, "X", True, "A", "party"), ("president", 0, True, "OBSERVER", True, "A", "group_rep"), ("representative", 0, False, "OBSERVER", False, "A", "other_invitee"), ("president", 0, False, "X", True, "", "member_state"), ("president", 0, False, "X", False, "A", "presiding"), ("representative", 0, False, "X", False, None, "member_state"), ("representative", 0, False, "X", False, " ", "other_invitee"), ("guest", 0, False, None, False, "A", "other_invitee")]
    df = spark.createDataFrame(rows, "role string, party int, grp boolean, bloc string, nat boolean, country string, want string")
    got = df.select("want", sp.speaker_class(*[F.col(c) for c in ("role", "party", "grp", "bloc", "nat", "country")]).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_phases_merge_into_the_smaller_neighbour():
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    phases = [ph.Phase("P1_a", d(0), d(9)), ph.Phase("P2_b", d(10), d(19)), ph.Phase("P3_c", d(20), d(29)), ph.Phase("P4_d", d(30), d(39))]
    days = [(d(n), 1, {0: 100, 1: 10, 2: 50, 3: 40}[n // 10]) for n in range(40)]
    got = ph.merged_phases(days, phases, meetings=8, paragraphs=450)
    assert [p.name for p in got] == ["P1_a", "P2-P3_b_to_c", "P4_d"] or [p.name for p in got] == ["P1_a", "P2-P4_b_to_d"]
    assert got[0] == phases[0] and got[-1].end == d(39) and ph.merged_phases(days, phases, 1, 1) == phases
    assert [p.name for p in ph.merged_phases(days, phases, 99, 10**6)] == ["P1-P4_a_to_d"]
    assert ph.clipped(d(0), d(20), d(10), d(5), d(30)) == (d(5), d(20)) and ph.clipped(d(0), d(20), d(25), d(5), d(30)) is None
    assert ph.large_enough(9) and not ph.large_enough(8)


def panel_rows():
    r = random.Random(4)
    return [(g, dt.date(2024, 1, 1) + dt.timedelta(k), r.random() < 0.3 + 0.05 * (ord(g) % 3) + (0.2 if k > 30 else 0)) for g in "abcdefg" for k in range(60) for _ in range(r.randrange(1, 4))]


def dummies(frame, weight=None):
    """Coefficients and clustered errors of the regression with a dummy for each group."""
    names = sorted(frame["country"].unique())
    x = np.column_stack([frame[c].astype(float) for c in pn.REGRESSORS] + [(frame["country"] == n).astype(float) for n in names])
    y, w = frame["y"].to_numpy(float), np.ones(len(frame)) if weight is None else frame[weight].to_numpy(float)
    bread = np.linalg.inv((x * w[:, None]).T @ x)
    beta = bread @ ((x * w[:, None]).T @ y)
    score = np.array([(x * (w * (y - x @ beta))[:, None])[(frame["country"] == n).to_numpy()].sum(0) for n in names])
    g, n, k = len(names), len(y), x.shape[1]
    cov = bread @ (score.T @ score) @ bread * g / (g - 1) * (n - 1) / (n - k)
    return beta[:3], np.sqrt(np.diag(cov))[:3]


def test_regressions_match_dummies(spark):
    units = spark.createDataFrame([(g, d, int(y)) for g, d, y in panel_rows()], "country string, date date, y int")
    p = pn.build_panel(units, "2024-02-01", ("2024-01-01", "2024-03-30"))
    for frame, weight in ((p, None), (pn.cells(p), "w")):
        got = pn.linear(frame, weight=weight)
        beta, se = dummies(frame.toPandas(), weight)
        assert np.allclose([got["coef"][c] for c in pn.REGRESSORS], beta, atol=1e-9)
        assert np.allclose([got["se"][c] for c in pn.REGRESSORS], se, rtol=1e-6)
        low, high = got["interval"]["post"]
        assert low < got["coef"]["post"] < high


def test_allocation_deals_in_rounds():
    r = random.Random(8)
    for _ in range(300):
        sizes = {f"s{i}": r.randrange(1, 30) for i in range(r.randrange(1, 8))}
        n, scheme = r.randrange(0, 120), r.choice(["proportional", "neyman", "equal"])
        got = sm.allocate(sizes, n, {"s0": 2.0}, scheme)
        assert sum(got.values()) == min(n, sum(sizes.values())) and all(0 <= got[s] <= sizes[s] for s in sizes)
        pull = {s: 1.0 if scheme == "equal" else k * (2.0 if s == "s0" else 1.0) for s, k in sizes.items()}
        ideal = {s: n * x / sum(pull.values()) for s, x in pull.items()}
        want = {s: min(sizes[s], int(ideal[s])) for s in sizes}  # then one after the other, over and over
        order = sorted(sizes, key=lambda s: (int(ideal[s]) - ideal[s], s))
        while sum(want.values()) < min(n, sum(sizes.values())):
            for s in order:
                if sum(want.values()) < n and want[s] < sizes[s]:
                    want[s] += 1
        assert got == want


def test_nearest_in_blocks(spark):
    g = np.random.default_rng(0)
    v = g.standard_normal((90, 5))
    rows = [(i, [float(x) for x in v[i]]) for i in range(90)] + [(100, None), (101, [0.0] * 5), (102, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["src"], r["dst"]): r["weight"] for r in nearest(df, df.where("id % 20 = 0"), 4, block=16).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for s in (0, 20, 40, 60, 80):
        w = unit[s] @ unit.T
        w[s] = -1
        want = [int(j) for j in np.argsort(-w)[:4] if w[j] > 0]
        assert {d for a, d in got if a == s} == set(want)
        assert all(abs(got[s, d] - w[d]) < 1e-9 for d in want)


def test_store_verbs(spark):
    log = spark.createDataFrame([("a", 1), ("a", 5), ("b", 1)], "k string, updated_at int")
    gone = spark.createDataFrame([("a", 3)], "k string, updated_at int")
    assert sorted(map(tuple, st.cleared(log, gone, ["k"]).collect())) == [("a", 5), ("b", 1)]
    models = spark.createDataFrame([("m",), ("n",)], "model string")
    known = spark.createDataFrame([("m", False)], "model string, supports_json_mode boolean")
    assert {tuple(r) for r in st.capability(models, known).collect()} == {("m", False), ("n", True)}
    matrix = spark.createDataFrame([(1, "r1"), (1, "r2")], "unit_id int, run_id string")
    one_run = st.put_by_run(matrix, spark.createDataFrame([(1, "r1", 7)], "unit_id int, run_id string, score int"), "score", ["unit_id", "run_id"])
    two = st.put_by_run(one_run, spark.createDataFrame([(1, "r2", 8)], "unit_id int, run_id string, score int"), "score", ["unit_id", "run_id"])
    assert {tuple(r) for r in two.select("run_id", "score").collect()} == {("r1", 7), ("r2", 8)}
    state = spark.range(5).select(st.attempt_state(F.col("id") == 4, F.col("id")).alias("s"))
    assert [r["s"] for r in state.collect()] == ["pending", "pending", "pending", "failed", "ok"]


def test_runs_in_slices_and_ranks_by_rounds(spark):
    r = random.Random(6)
    rows = [(g, i, r.choice(["x", "y", None])) for g in ("a", "b", None) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, i int, v string")
    whole = sorted((r["g"] or "", r["i"], r["run"]) for r in od.runs(df, ["g"], ["i"], "v").collect())
    cut = sorted((r["g"] or "", r["i"], r["run"]) for r in od.runs(df, ["g"], ["i"], "v", slice_by=F.floor(F.col("i") / 7)).collect())
    last, want = {}, []
    for g, i, v in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        n, before = last.get(g, (0, object()))
        last[g] = (n + (v != before), v)
        want.append((g or "", i, last[g][0]))
    assert whole == cut == want
    numbers = [r.choice([r.random(), 0.5, r.randrange(9)]) for _ in range(500)]
    values = spark.createDataFrame([(float(x),) for x in numbers], "v double")
    assert od.kth_values(values, [1, 100, 250, 500], few=5, bins=4) == [sorted(numbers)[k - 1] for k in (1, 100, 250, 500)]
