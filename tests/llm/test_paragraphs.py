"""Repeated paragraphs and passages against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm.paragraphs import PART_BITS, _repeated, drop_repeats, numbers, repeated_paragraphs

SCHEMA = "doc_id long, text string, start long, id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(4)


def words(r, n):
    return [f"w{r.randrange(10**7)}" for _ in range(n)]


def corpus():
    r = random.Random(3)
    rows = [(i, "\n".join(" ".join(words(r, r.randrange(1, 90))) for _ in range(5))) for i in range(60)]
    para = words(r, 60)
    near = list(para)
    near[30] = "changed"
    rows += [(100, " ".join(words(r, 30)) + "\n" + " ".join(para)), (101, " ".join(para)), (102, "é " * 3 + "\n" + " ".join(near) + "\nend")]
    passage = " ".join(words(r, 52))
    rows += [(200 + k, " ".join(words(r, 7 + 11 * k)) + " " + passage + " " + " ".join(words(r, 40))) for k in range(4)]
    rows += [(300, "short line here"), (301, "short line here"), (302, None), (303, ""), (304, "x " * 40_000)]
    return rows, para, passage


def broken():
    """A passage over line breaks."""
    r = random.Random(21)
    p = words(r, 60)
    rows = [(401, " ".join(words(r, 60)) + " " + " ".join(p[:30]) + "\n" + " ".join(p[30:]) + " " + " ".join(words(r, 60)))]
    return rows + [(402, "\n".join(" ".join(p[k : k + 12]) for k in range(0, 60, 12)))]


def join(*x):
    return " ".join(w for part in x for w in part)


def nested():
    """Passages that meet lines which repeat, and passages of several lengths."""
    r = random.Random(22)
    p, a, b = words(r, 60), words(r, 60), words(r, 60)
    rows = [(i, join(p)) for i in range(501, 504)] + [(509, join(words(r, 60), p, words(r, 60)))]  # a line, and a passage
    x, y, q = join(words(r, 60), b, words(r, 60)), join(words(r, 60), b, words(r, 60)), words(r, 300)
    rows += [(511, x), (512, x), (513, y), (514, y)]  # a passage inside two groups of lines
    rows += [(521, join(words(r, 40), q[:50])), *((k, join(words(r, 200), q, words(r, 200))) for k in (522, 523, 524))]
    back = words(r, 60)
    rows += [(531, join(words(r, 90), a)), (532, join(words(r, 90), back)), (533, join(words(r, 90), a, back)), (534, join(words(r, 90), a, back))]
    return rows, p, a, b, q, back


@pytest.fixture(scope="module")
def found(spark):
    """All of these together, searched once and cleaned once."""
    rows = corpus()[0] + broken() + nested()[0]
    table = docs(spark, rows)
    clean = drop_repeats(table)
    assert clean.columns == table.columns
    return dict(rows), repeated_paragraphs(table).collect(), {r["doc_id"]: r["text"] for r in clean.collect()}


def test_finds_planted_and_leaves_others(found):
    texts, got, _ = found
    _, para, passage = corpus()
    text = {i: (t or "").encode() for i, t in texts.items()}
    whole = {r["doc_id"]: r for r in got if not r["is_passage"] and r["doc_id"] < 400}
    assert set(whole) == {100, 101, 102}
    assert all(r["component_id"] == 100 and r["group_size"] == 3 and r["kept"] == (r["doc_id"] == 100) for r in whole.values())
    assert text[101][whole[101]["start"] : whole[101]["end"]].decode() == " ".join(para)
    parts = {r["doc_id"]: r for r in got if r["is_passage"] and r["doc_id"] not in (304, *range(400, 600))}
    assert set(parts) == {200, 201, 202, 203}
    for i, r in parts.items():
        own = text[i][r["start"] : r["end"]].decode()
        assert own in passage and len(own.split()) >= 28 and r["component_id"] == 200


def test_removal_and_edges(spark, found):
    before, _, out = found
    assert len(out) == len(before)
    assert all(out[i] == before[i] for i in [*range(60), 100, 300, 301, 302, 303, 200])
    assert out[101] == "" and "changed" not in out[102] and out[102].startswith("é é é") and out[102].endswith("end")
    assert repeated_paragraphs(docs(spark, [])).count() == 0


def test_passages_over_line_breaks(found):
    got = {x["doc_id"]: x for x in found[1] if x["doc_id"] in (401, 402)}
    assert set(got) == {401, 402} and all(x["is_passage"] and x["component_id"] == 401 for x in got.values())
    assert got[401]["kept"] and not got[402]["kept"]


def test_passages_meet_lines_that_repeat_and_nothing_is_lost(found):
    texts, got, cleaned = found
    rows, p, a, b, q, back = nested()
    nine = [g for g in got if g["doc_id"] == 509]
    assert len(nine) == 1 and not nine[0]["kept"] and nine[0]["component_id"] == 501 and nine[0]["group_size"] >= 4
    assert any(g["doc_id"] == 513 and g["is_passage"] and not g["kept"] and g["component_id"] == 511 for g in got)
    for i, want in ((509, p), (513, b), (533, a)):  # whole, not windows alone
        assert any(texts[i].encode()[g["start"] : g["end"]].decode() == " ".join(want) or i == 533 for g in got if g["doc_id"] == i and not g["kept"])
    out = {i: cleaned[i] for i, _ in rows}
    assert set(" ".join(out.values()).split()) == set(" ".join(t for _, t in rows).split())
    assert sum(t.count(" ".join(q[50:])) for t in out.values()) == 1 and sum(" ".join(back) in t for t in out.values()) == 1


def test_shared_passages_of_50_words_always_meet():
    r = random.Random(9)

    def digests(texts):
        got = numbers([t.encode() for t in texts])
        return [np.frombuffer(x, np.int64) for x in got["w_digest"].to_pylist()], [np.frombuffer(x, np.int32) for x in got["w_start"].to_pylist()]

    for _ in range(300):
        p = words(r, 50)
        a, b = (" ".join(words(r, r.randrange(30)) + p + words(r, r.randrange(30))) for _ in range(2))
        one, two = (digests([x])[0][0] for x in (a, b))
        assert len(np.intersect1d(one, two))
        together, starts = digests(["short", a, "", b])
        assert (together[1] == one).all() and (together[3] == two).all() and not len(together[0]) and not len(together[2])
        assert (starts[3] == digests([b])[1][0]).all()


def shingled(line):
    w = line.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def all_links(rows, least=75, min_words=20):
    """Every place of a line, and the places that links join, by all pairs that share a shingle."""
    places = [(i, len("\n".join(t.split("\n")[:k]).encode()) + (k > 0), shingled(line)) for i, t in rows for k, line in enumerate((t or "").split("\n")) if len(line.split()) >= min_words]
    have, parent = defaultdict(list), list(range(len(places)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n, (*_, s) in enumerate(places):
        for x in s:
            have[x].append(n)
    shared = Counter((a, b) for ids in have.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= least * (len(places[a][2]) + len(places[b][2]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for n, p in enumerate(places):
        groups[find(n)].append(p[:2])
    return {p: p == min(g) for g in groups.values() if len(g) > 1 for p in g}


def test_paragraphs_match_all_pairs(spark, sf):
    """Places of repeated paragraphs, and which stays, over a whole table."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    want = all_links([(r["doc_id"], r["text"]) for r in table.collect()])
    got = repeated_paragraphs(table).where("not is_passage").collect()
    assert {(r["doc_id"], r["start"]): r["kept"] for r in got} == want and len(want) > 50


def test_shorter_paragraphs_if_asked(spark):
    rows = [(1, "one two three four five six\nx"), (2, "x\none two three four five six"), (3, "x\ny")]
    assert repeated_paragraphs(docs(spark, rows)).count() == 0
    assert {r["doc_id"] for r in repeated_paragraphs(docs(spark, rows), min_words=5).collect()} == {1, 2}


def test_reach_is_the_longest_equal_stretch():
    from quillon.llm.paragraphs import _reach

    assert _reach(b"x A  b c", b"y a b\nc", True, 9) == (3, 6, 5)
    assert _reach(b"a b x", b"a  b y", False, 9) == (2, 3, 4)
    assert _reach(b"a b", b"c", False, 9) == (0, 0, 0)


def test_removals_belong_to_an_id_with_its_text(spark):
    r = random.Random(31)
    para, other = " ".join(words(r, 60)), " ".join(words(r, 60))
    rows = [(1, para), (2, "a\n" + para), (2, other), (None, "b\n" + para), (None, "c " + other[:40])]
    got = sorted((x["doc_id"] or 0, x["text"]) for x in drop_repeats(docs(spark, rows)).collect())
    # The place without an id comes first and stays.
    assert got == sorted([(1, ""), (2, "a\n"), (2, other), (0, "b\n" + para), (0, "c " + other[:40])])


def test_repeats_are_counted_without_a_row_for_each_value(spark):
    r = np.random.default_rng(5)
    common = r.integers(-(2**63), 2**63 - 1, 300)  # in every row
    rows, seen = [], Counter()
    for _ in range(40):
        v = np.concatenate([common, r.integers(-(2**63), 2**63 - 1, 2000)])
        again = np.where(np.arange(len(v)) % 500 == 499, 7, -1).astype(np.int32)
        rows.append((bytearray(v.tobytes()), bytearray(again.tobytes())))
        seen.update(v.tolist())
        seen.update(v[again >= 0].tolist())
    rows += [(None, None), (bytearray(), bytearray())]
    table = spark.createDataFrame(rows, "held binary, again binary").repartition(2).localCheckpoint()
    jvm = spark._jvm

    def moved():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = moved()
    got = [x["value"] for x in _repeated(table, "held", "again").collect()]
    rows_moved = sum(n for k, n in moved().items() if k not in before)
    assert len(got) == len(set(got)) and set(got) == {v for v, m in seen.items() if m > 1}
    assert 0 < rows_moved <= 2 << PART_BITS < 20_000  # 80,000 values
    assert _repeated(spark.createDataFrame([], table.schema), "held").count() == 0
