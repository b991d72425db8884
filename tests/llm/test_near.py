"""Near-duplicates of documents against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from quillon.llm import minhash as mh
from quillon.llm.common import components

SCHEMA = "doc_id long, text string, n long, component string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c") for i, t in rows], SCHEMA).repartition(4)


def shingles(text, width=5):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in raw.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows):
    """{id: (size, component)}"""
    sets, first = {}, {}
    for i, t in rows:
        sets[i] = shingles(t)
        first.setdefault(sets[i], i) if sets[i] else None
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    have = defaultdict(list)
    for s, i in first.items():
        for x in s:
            have[x].append(i)
    shared = Counter()
    for ids in have.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            join(a, b)
    for i, s in sets.items():
        if s:
            join(i, first[s])
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(df):
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in df.collect()[:50])
    return out


def varied(r, words, edits):
    w = list(words)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_near_groups_match_brute_force(spark):
    r = random.Random(5)
    rows = []
    for g in range(60):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(6, 200))]
        rows += [(len(rows) + k, varied(r, base, r.randrange(0, 6) * len(base) // 100)) for k in range(r.randrange(1, 7))]
    hot = [f"h{i}" for i in range(120)]
    rows += [(10_000 + k, varied(r, hot, r.randrange(0, 5))) for k in range(300)]
    rows += [(20_000 + k, " ".join(hot)) for k in range(200)]
    rows += [(30_000 + k, t) for k, t in enumerate([None, "", " \n\t", "One two", "one TWO", "one two three", "x", "X", "É a b c d", "é a b c d", "a\xa0b c d e f"])]
    rows += [(31_000, "long " * 30_000), (31_001, "long " * 30_001), (31_002, " ".join(f"v{i}" for i in range(30_000)))]
    assert found(mh.near_groups(docs(spark, rows))) == brute(rows)


def test_near_groups_on_documents(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(mh.near_groups(table)) == brute([(r["doc_id"], r["text"]) for r in table.collect()])


def test_edges(spark):
    assert mh.near_groups(docs(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q w e r t y")]
    out = [tuple(r) for r in mh.near_groups(docs(spark, rows)).orderBy("doc_id").collect()]
    assert [(o[0], o[2]) for o in out] == [(None, None), (1, 1), (1, 1), (2, 2)]
    left = mh.drop_near_copies(docs(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "")]))
    assert left.columns == ["doc_id", "text", "n", "component"] and sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]


def test_sketch_fills_and_estimates():
    g = np.random.default_rng(0)
    a = g.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:771], g.integers(0, 2**63, 129).astype(np.uint64)])
    s = mh.sketches([a, b, a[:1], a[:0]])
    assert (s[:3] != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.15
    assert (mh.band_keys(s)[0] == mh.band_keys(mh.sketches([a[::-1]]))[0]).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(500)] + [(5, 5)] + [(2000 + r.randrange(100), 2000 + r.randrange(100)) for _ in range(60)]
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(500))
    assert all(got[a] == got[b] for a, b in edges if a != b)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_without_broadcasts(spark, monkeypatch):
    """Above the bound on broadcasts the same rows come out."""
    from quillon.llm import common
    from quillon.llm.exact_dedup import exact_groups

    r = random.Random(7)
    base = [f"w{r.randrange(900)}" for _ in range(60)]
    rows = [(k, varied(r, base, k % 9)) for k in range(60)] + [(100 + k, " ".join(base)) for k in range(20)] + [(200, None), (201, "x y")]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert found(mh.near_groups(docs(spark, rows))) == brute(rows)
    text = {i: t or "" for i, t in rows}
    for x in exact_groups(docs(spark, rows)).collect():
        assert x["keep_id"] == max(i for i, t in text.items() if t == text[x["doc_id"]])


def test_ids_of_any_type_and_repeated_ids(spark):
    texts = ["a b c d e f g", "a b c d e f g", "q w e r t y u i", "q w e r t y u i o p a s d f g h j k l", None]
    table = spark.createDataFrame([("k2", texts[0]), ("k1", texts[1]), ("k3", texts[2]), ("k3", texts[3]), ("k4", texts[4])], "doc_id string, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in mh.near_groups(table).collect())
    assert got == [("k1", 3, "k1", True), ("k2", 3, "k1", False), ("k3", 4, "k3", True), ("k3", 15, "k3", True), ("k4", 0, "k4", True)]
    assert sorted(r["doc_id"] for r in mh.drop_near_copies(table).collect()) == ["k1", "k3", "k3", "k4"]


def test_block_pairs_compared_together_equal_each_alone():
    r = np.random.default_rng(8)
    rows, want, at = [], set(), 0
    base = r.integers(0, 2**63, 40).astype(np.uint64)
    for group in range(120):
        size, two = int(r.integers(1, 9)), group % 3 == 0  # a block with itself, or two blocks
        band = int(r.integers(4))
        own = []
        for i in range(size):
            s = np.unique(np.where(r.random(40) < 0.12, r.integers(0, 2**63, 40).astype(np.uint64), base))
            keys = r.integers(0, 3, 4)
            keys[band] = 9
            own.append({"group": group, "id": at + i, "c": int(r.integers(6)), "side": int(r.integers(2)) if two else -1, "band": band, "bands": keys, "s": s})
        at += size
        for i, p in enumerate(own):
            for j, q in enumerate(own):
                meet = i < j if not two else p["side"] < q["side"]
                both, first = len(np.intersect1d(p["s"], q["s"])), (p["bands"] == q["bands"]).argmax() == band
                if meet and p["c"] != q["c"] and first and 100 * both >= 75 * (len(p["s"]) + len(q["s"]) - both):
                    want.add(tuple(sorted((p["id"], q["id"]))))
        rows += own
    n, _, _, _, _, masks = mh.sketch_columns([x["s"] for x in rows], 32, 2, 2, 256)
    sig = mh.sketches([x["s"] for x in rows], 256).astype(np.uint8)
    held = {c: np.array([x[c] for x in rows]) for c in ("group", "id", "c", "side", "band", "bands")}
    held |= {"n": n.to_numpy(), "sig": sig, "mask": np.frombuffer(b"".join(masks.to_pylist()), np.uint8).reshape(len(rows), -1)}
    for most in (1 << 16, 10):
        found = [(int(i), int(j)) for a, b in mh._likely(held, 75, 0.6, most) for i, j in zip(a, b)]
        pairs = {tuple(sorted((rows[i]["id"], rows[j]["id"]))) for i, j in found if held["group"][i] == held["group"][j]}
        assert len(found) == len(pairs) and want <= pairs and len(want) > 20
        sets = pa.array([x["s"].tobytes() for x in rows], pa.binary())
        links = list(mh._enough(mh._likely(held, 75, 0.6, most), held["c"], sets, 75))
        assert all(tuple(sorted((rows[i]["id"], rows[j]["id"]))) in want for i, j in links) and len(links) == 5
