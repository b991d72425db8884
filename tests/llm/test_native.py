"""Exact dedup, sharding and mixing against brute force on small tables."""

import hashlib
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quillon.llm.exact_dedup import drop_exact_copies, exact_groups
from quillon.llm.mixing import GOLDEN, mix, mixed_documents, schedule
from quillon.llm.minhash import drop_near_copies
from quillon.llm.paragraphs import drop_repeats
from quillon.llm.pii import sanitised
from quillon.llm.quality import Network, keep_good
from quillon.llm.sharding import histogram_shards

SCHEMA = "doc_id long, text string, source string, count long, size long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], SCHEMA)


ROWS = [(1, "a b c", "x"), (2, "a b c", "y"), (3, None, "x"), (4, "", None), (5, "a b d", "x"), (6, "zz", "x"), (6, "zz", "x"), (None, "a b c", "y"), (8, "w " * 5000, "y"), (9, "w " * 5000 + "v", "y"), (10, "éè x", "z")]


def test_exact_groups(spark):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(docs(spark, ROWS)).collect()}
    by = defaultdict(list)
    for i, t, _ in ROWS:
        by[t or ""].append(i)
    want = set()
    for i, t, _ in ROWS:
        keep = max((x for x in by[t or ""] if x is not None), default=None)
        want.add((i, keep, len(by[t or ""]), i == keep))
    assert got == want


def test_exact_drop_keeps_one_and_columns(spark):
    out = drop_exact_copies(docs(spark, ROWS))
    assert out.columns == ["doc_id", "text", "source", "count", "size"]
    texts = [r["text"] or "" for r in out.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, _ in ROWS})


@pytest.mark.parametrize("f", [exact_groups, drop_exact_copies, histogram_shards, mix, mixed_documents])
def test_empty(spark, f):
    assert f(docs(spark, [])).count() == 0


def test_shards(spark):
    rows = [(i, f"text {i % 700} " + "x" * (i % 97), "s") for i in range(3000)] + [(5000 + i, "hot copy", "s") for i in range(1500)] + [(9999, None, None)]
    got = histogram_shards(docs(spark, rows), shards=8).toPandas()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == crc32(text[r.doc_id].encode()) for r in got.itertuples())
    by = got.groupby("shard")
    assert list(by.size().index) == list(range(8))
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in by)
    sums = by["size"].sum()
    assert sums.max() - sums.min() < 0.02 * sums.mean() + 800
    again = histogram_shards(docs(spark, rows[::-1]), shards=8).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_groups_of_equal_texts_stay_whole(spark):
    """Groups up to a shard's size lie in one shard; a larger one fills the fewest."""
    rows = [(i, f"group {i % 40} " + "y" * (i % 40) * 9, "s") for i in range(1200)] + [(5000 + i, "hot copy", "s") for i in range(900)]
    got = histogram_shards(docs(spark, rows), shards=8).toPandas()
    got["text"] = got["doc_id"].map({i: t for i, t, _ in rows})
    room = got["size"].sum() / 8
    for _, g in got.groupby("text"):
        assert g["shard"].nunique() == max(1, -(-g["size"].sum() // room))
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() < 0.1 * room


CLASHING = ["doc_id", "text", "source", "_n", "_p", "_keep", "_size", "_key", "_row_of_text", "tag", "times", "c0", "x0", "score", "_gone", "kept", "id"]


@pytest.mark.parametrize("f", [drop_exact_copies, drop_near_copies, mixed_documents, lambda d: keep_good(d, Network.fresh(1, 0.9)), sanitised, drop_repeats])
def test_other_columns_stay_whatever_their_names(spark, f):
    base = docs(spark, [(1, "a b c d e f", "x"), (2, "q w e r t y", "x"), (3, None, "x"), (4, "u i o p a s d f", "x")]).select("doc_id", "text", "source")
    table = base.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING[3:]])
    out = f(table)
    assert out.columns == CLASHING
    for r in out.collect():
        assert all(r[c] == f"{c}{r['doc_id']}" for c in CLASHING[3:])


def level(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: most * sizes[s] for s in capped} | {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        capped |= set(over)


def test_mix(spark):
    rows = [(i, "w " * (i % 13), "abcdefgh"[i % 3 if i % 2 else i % 8]) for i in range(2000)] + [(3000, "only five words are here", "tiny"), (3001, None, "none"), (3002, "n u l l", None), (3002, "n u l l", None)]
    got = mix(docs(spark, rows)).toPandas()
    assert len(got) == len(rows)
    sizes, source = defaultdict(int), {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = level(sizes), defaultdict(int)
    for r in got.itertuples():
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mix(docs(spark, rows[::-1])).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))


def test_mixed_documents(spark):
    rows = [(i, f"{i} " + "w " * 9, "ab"[i % 2]) for i in range(400)]
    out = mixed_documents(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "count", "size"]
    n = out.groupBy("source").count().toPandas().set_index("source")["count"].to_dict()
    assert abs(n["a"] - 400 * 5 / 7) < 4 and abs(n["b"] - 400 * 2 / 7) < 4


def test_sha_of_text_follows(spark):
    from quillon.llm.queries import op9_exact_dedup

    got = op9_exact_dedup(spark, "/root/testdata/sf0.001").toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(hashlib.sha256(texts[r.doc_id].encode()).hexdigest() == r.text_sha256 for r in got.itertuples())


def test_every_prefix_of_the_schedule_is_near_the_weights(spark):
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    sources = spark.createDataFrame([("a", 0.0, 0.5), ("b", 0.5, 0.8), ("c", 0.8, 1.0)], "key string, low double, high double")
    got = schedule(sources, 3000).toPandas().sort_values("slot")
    assert list(got["slot"]) == list(range(3000))
    for k, share in shares.items():
        met = (got["key"] == k).cumsum().to_numpy()
        assert max(abs(met[m - 1] - share * m) for m in range(1, 3001)) < 4
        assert list(got[got["key"] == k]["rank"]) == list(range(met[-1]))


def test_the_sequence_decides_the_slots(spark):
    rows = [(i, "w " * (3 + i % 7), "abc"[i % 3]) for i in range(900)] + [(2000, None, "a"), (2001, "", "b")]
    a, b = (mix(docs(spark, rows), step=s).toPandas().set_index("doc_id").sort_index() for s in (GOLDEN, 2**0.5 - 1))
    assert (a["taken"] == b["taken"]).mean() > 0.9  # targets don't hang on the order, turns do
    both = a["first_slot"].notna()
    assert both.sum() > 500 and (a["first_slot"] != b["first_slot"])[both].mean() > 0.9
    assert ((a["taken"] > 0) == both).all() and a.loc[2000, "taken"] == a.loc[2001, "taken"] == 0
    # The first tenth of the slots holds the sources in the proportion of their targets.
    of = {i: s for i, _, s in rows}
    a["source"] = [of[i] for i in a.index]
    early = a[a["first_slot"] < a["first_slot"].max() / 10].groupby("source")["size"].sum()
    want = a.groupby("source")["target"].first()
    assert (abs(early / early.sum() - want / want.sum()) < 0.08).all()


def test_mixed_documents_come_in_the_order_of_slots(spark):
    rows = [(i, f"{i} " + "w " * 9, "ab"[i % 2]) for i in range(400)]
    slot = {r["doc_id"]: r["first_slot"] for r in mix(docs(spark, rows)).collect()}
    first, seen = [], set()
    for r in mixed_documents(docs(spark, rows)).collect():
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            first.append(slot[r["doc_id"]])
    assert first == sorted(first)
