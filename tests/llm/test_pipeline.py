"""The pipeline against what its stages' decisions must be."""

from collections import Counter

import corpus_pipeline as cp
from test_near import brute

SF = "/root/testdata/sf0.01"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, source = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        docs.write.mode("overwrite").parquet(at := f"/tmp/checkpoints/test-pipeline/{name.replace(' ', '-')}")
        docs = spark.read.parquet(at)
        after = docs.collect()
        kept[name] = {r["doc_id"] for r in after}
        assert kept[name] <= {r["doc_id"] for r in before}
        if name != "packing":
            assert docs.columns == columns and all(r == source[r["doc_id"]] for r in after)
        if name == "quality classifier":
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept[name] for i in good) >= 0.98 * len(good)
            assert sum(i not in kept[name] for i, q in labels.items() if q == 0) >= 0.9 * (len(labels) - len(good))
        if name == "exact dedup":
            want = {}
            for r in before:
                want[r["text"]] = max(want.get(r["text"], -1), r["doc_id"])
            assert sorted(r["doc_id"] for r in after) == sorted(want.values())
        if name == "MinHash near-dedup":
            groups = brute([(r["doc_id"], r["text"]) for r in before])
            assert kept[name] == {c for _, c in groups.values()} and len(after) == len(kept[name])
        if name == "source mixing":
            n = Counter(r["doc_id"] for r in after)
            assert max(n.values()) <= 3
    pieces = Counter()
    for r in after:
        pieces[r["doc_id"]] += r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in after}
    assert all(pieces[i] == n[i] * tokens[i] for i in n)


def test_stages_cope_with_nulls_and_none(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b", None, "s", None), (3, "a b", None, "s", None)], docs.schema)
    for table in (empty, odd):
        for _, stage in cp.STAGES:
            out = stage(spark, table, SF)
            assert out.count() >= 0
