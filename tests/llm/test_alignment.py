"""Cross-tokenizer alignment against plain loops over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import alignment, queries as q
from quillon.llm.alignment import Aligner, Bitset, aligned_tokens, grouped, vocabularies
from quillon.llm.bpe import byte_symbols

SCHEMA = "doc_id long, text string, row long, id string, key long"
BITS = ["the ", "The", " of", "ing", "\n", "\n\n", "  ", "   ", "\t", "\xa0", " ", " ", "　", "é", "ß", "日本語", "😀", "1234567", "3.14", "#$%", "====", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "\x00", "\x1c", "Zanzibarov", "don't", "'ll", "é", "​", "x" * 30]
PATH_A, PATH_B = vocabularies()
LIB_A, LIB_B = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
LIB_A.encode_special_tokens = True
BYTE = {c: b for b, c in enumerate(byte_symbols())}


def piece(i):
    p = LIB_B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if LIB_B.is_byte(i) else p.replace("▁", " ").encode()


def plain(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, digest of every text."""
    docs, held = [], Counter()
    for t in texts:
        want = (" " + (t or "")).encode()
        a, b = LIB_A.encode(" " + (t or ""), add_special_tokens=False).ids, LIB_B.encode(t or "")
        pa_, pb = [bytes(BYTE[c] for c in LIB_A.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not t or b"".join(pa_) != want or b"".join(pb) != want:
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in (pa_, pb)]
        cuts = sorted({*ends[0]} & {*ends[1]})
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append([[i for i, e in zip(ids, own) if lo < e <= hi] for ids, own in zip((a, b), ends)])
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        docs.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        told = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in d[2])
        out.append((d[0], d[1], len(d[2]), len(d[3]), sum(held[x] == best[x[0]] for x in d[3]), sum(held[x] for x in d[3]), hashlib.sha256(told.encode()).hexdigest()))
    return out


def texts(sf=None):
    r = random.Random(8)
    out = ["".join(r.choice(BITS) for _ in range(r.randrange(1, 40))) for _ in range(300)]
    return out + [None, "", " ", "  lead and trail  ", "a▁b", "▁", "a" * 5000, " " * 400, "\n" * 700 + "x", "same words here"] + ["same words here"] * 3 + ["word " * 3000 + "日本" * 300]


def rows(df):
    return {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()}


def frame(spark, own):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(own)], SCHEMA).repartition(5)


@pytest.mark.parametrize("heavy", [1 << 22, 50, 3])
def test_against_plain_loops(spark, heavy):
    own = texts()
    want = plain(own)
    got = rows(aligned_tokens(frame(spark, own), heavy=heavy))
    assert [got[i] for i in range(len(own))] == want


def test_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id")
    want = plain([r["text"] for r in docs.collect()])
    got = rows(q.op12_token_alignment(spark, sf))
    assert [got[i] for i in sorted(got)] == want


def test_bits_rank_and_cut():
    g = np.random.default_rng(9)
    for n in (1, 63, 64, 65, 1000):
        a, b = (np.unique(np.append(g.integers(0, n, n // 2 + 1), n - 1)) for _ in range(2))
        cuts, ra, rb = grouped(a, b, n)
        assert cuts.tolist() == sorted({*a.tolist()} & {*b.tolist()})
        assert ra.tolist() == [(a <= c).sum() for c in cuts] and rb.tolist() == [(b <= c).sum() for c in cuts]
        assert Bitset(a, n).rank(np.arange(n)).tolist() == [(a <= c).sum() for c in range(n)]


def test_wide_groups_are_products_of_their_ids(monkeypatch):
    own = [b" " + t.encode() for t in texts() if t]
    want = Aligner(PATH_A, PATH_B).aligned(own)
    monkeypatch.setattr(alignment, "WIDE", 3)
    got = Aligner(PATH_A, PATH_B).aligned(own)
    assert all(np.array_equal(x, y) for x, y in zip(got, want))


def test_a_full_store_begins_anew(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_SEGMENTS", 5)
    own, one = Aligner(PATH_A, PATH_B), [b" " + t.encode() for t in texts() if t]
    first = own.aligned(one)
    assert own.full and all(np.array_equal(x, y) for x, y in zip(first, own.aligned(one)))


def test_empty(spark):
    assert aligned_tokens(frame(spark, [])).count() == 0
    assert rows(aligned_tokens(frame(spark, [None, ""]))) == {0: (0, 0, 0, 0, 0, 0, ""), 1: (0, 0, 0, 0, 0, 0, "")}
