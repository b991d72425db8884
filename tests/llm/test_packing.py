"""Packing: an exact round trip, and neighbours against plain BM25."""

from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
from tokenizers import Tokenizer

from quillon.llm import packing as pk
from quillon.llm.bpe import vocabulary

SCHEMA = "doc_id long, text string, ids string, shard long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(4)


def check(rows, texts):
    lib = Tokenizer.from_file(vocabulary())
    want = {i: np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], np.uint32) for i, t in texts}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(want)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want[i]) and r["ids_crc32"] == crc32(want[i][at : at + r["length"]].astype("<u4").tobytes())
            at += r["length"]
        assert at == len(want[i])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
    return len(by_seq), sum(map(len, want.values()))


def test_round_trip(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in table.collect()]
    n, total = check(pk.packed(table).collect(), texts)
    assert n == -(-total // 2048)
    n, total = check(pk.packed(table, shard_docs=50).collect(), texts)
    assert n <= -(-total // 2048) + 4


def test_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "a<|endoftext|>B é"), (4, "日本語 x"), (5, "word " * 9000), (6, "İ ŉ \x85 z"), (7, "x" * 500)]
    check(pk.packed(docs(spark, texts)).collect(), texts)
    assert pk.packed(docs(spark, [])).count() == 0


def test_neighbours_are_bm25():
    g = np.random.default_rng(0)
    texts = [g.integers(0, 60, g.integers(20, 90)).astype("<u2") for _ in range(80)]
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=60)
    idf = np.log1p((80 - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = np.mean([len(t) for t in texts])
    index = pk.Index(texts, idf, mean)
    unused = np.ones(80, bool)
    unused[::7] = False

    def weight(t, d):
        f = Counter(d.tolist())[t]
        return float(idf[t]) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean))

    for i in (3, 11):
        terms = set(texts[i].tolist())
        score = {j: sum(weight(t, texts[j]) for t in terms) for j in range(80) if unused[j]}
        got = list(index.neighbours(i, unused))
        assert set(got) == {j for j, s in score.items() if s > 0}
        assert all(score[a] >= score[b] - 1e-3 for a, b in zip(got, got[1:]))


def test_documents_are_dealt_by_content(spark):
    topics = ["zebra", "quartz", "violin", "harbor", "cactus", "glacier", "pepper", "lantern"]
    texts = [(i, " ".join(["the", "and", "of"] * 20 + [topics[i % 8]] * 30)) for i in range(160)]
    rows = pk.packed(docs(spark, texts), shard_docs=20).collect()
    check(rows, texts)
    shards = defaultdict(set)
    for r in rows:
        shards[r["doc_id"] % 8].add(r["sequence_id"] >> 32)
    assert all(len(s) <= 3 for s in shards.values())  # dealt at random, 20 documents stand in nearly all of the 8


def test_queries_have_all_terms():
    texts = [np.arange(40, dtype="<u2"), np.array([39, 50, 51], "<u2")] + [np.array([k], "<u2") for k in range(60, 80)]
    idf = np.ones(80, np.float32)
    idf[39] = 0.1  # the weakest of the seed's 40 terms
    unused = np.ones(len(texts), bool)
    unused[0] = False
    assert list(pk.Index(texts, idf, 10.0).neighbours(0, unused)) == [1]
