"""Chat formatting: round trips, masks and control strings."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from quillon.llm import queries as q
from quillon.llm.chat import CONTROLS, KNOWN, encoder, escaped, formatted, read_back, unescaped, vocabulary
from quillon.llm.tokens import segments

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = [*CONTROLS, "\\", "### ", "#", "</", "turn>", "Assistant:", "</turn", " ", "\n", "\n\n", "  ", "\xa0", "  ", "é", "日本", "x" * 20, "word", "<|endoftext|>", "\x1c", "\t", "'s", "1234"]


def text(r, n=12):
    return "".join(r.choice(BITS) for _ in range(r.randrange(n)))


def test_escapes_are_reversible_and_hide_every_control_string():
    r = random.Random(5)
    for _ in range(4000):
        t = text(r)
        assert unescaped(escaped(t)) == t
        assert not any(c in escaped(t) for c in CONTROLS)
        # Between two control strings too, none but theirs can be found.
        assert sum((CONTROLS[1] + escaped(t) + CONTROLS[-1]).count(c) for c in CONTROLS) == 2


def test_segments_give_the_ids_of_whole_texts(spark, sf):
    own, r = encoder(vocabulary()), random.Random(6)
    texts = [text(r, 40) for _ in range(600)] + ["", " ", "a" * 20_000, " " * 3000 + "x", "\xa0" * 700 + " y", "a\n\n\n  b \n c  "]
    texts += [d["text"] for d in spark.read.parquet(f"{sf}/documents.parquet").limit(200).collect()] + [r_["text"] for r_ in spark.read.parquet(f"{sf}/pages.parquet").select("html").withColumnRenamed("html", "text").limit(20).collect()]
    for _ in range(2):
        ids, sizes = own.encode([t.encode() for t in texts])
        at = 0
        for t, n in zip(texts, sizes.tolist()):
            assert ids[at : at + n].tolist() == own.lib.alone(t), t[:80]
            at += n
    raw, starts, ends, bounds = segments([b"", b" a b", b"x\xc2\xa0 y z"])
    assert [raw[a:z] for a, z in zip(starts, ends)] == [b" a", b" b", b"x\xc2\xa0 y", b" z"] and bounds.tolist() == [0, 0, 2, 4]


def conversations():
    r = random.Random(7)
    roles = ["user", "assistant", "system", "tool", "### Role:", "", None, "Assistant", "a</turn>"]
    rows = [(c, t, r.choice(roles[:3] if c % 2 else roles), r.choice([None, "", text(r), text(r, 60)])) for c in range(60) for t in range(r.randrange(9))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t} " + text(r)) for t in range(700)]
    rows += [(200, 0, "assistant", "w " * 90_000), (201, 0, "user", "same"), (201, 0, "user", "same"), (201, None, "assistant", "first"), (None, 1, "assistant", "no id")]
    return rows


def want(rows):
    out = {}
    for c in {c for c, *_ in rows}:
        own = sorted([(t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c])
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        chars = sum(len(escaped(x)) + 7 + (len(KNOWN[r]) if r in KNOWN else 9 + len(escaped(r)) + 9) for _, _, r, x in own)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(own), sha("".join(f"{r}\n{x}\n" for _, _, r, x in own)), len(loss), sha(loss), chars)
    return out


@pytest.mark.parametrize("piece", [1 << 16, 97])
def test_round_trip(spark, piece):
    rows = conversations()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as ids", "2 as conv", "'x' as mask")
    pieces = formatted(table, piece=piece)
    for got in (read_back(pieces, in_order=True), read_back(pieces.repartition(7))):
        assert {r["conv"]: tuple(r)[1:] for r in got.collect()} == want(rows)


def test_the_mask_holds_the_texts_of_learned_roles_alone(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hello there"), (1, 2, "assistant", "good day"), (1, 3, "tool", "42"), (1, 4, "assistant", "bye")]
    lib = encoder(vocabulary()).lib
    for learned, told in ((("assistant",), ["good day", "bye"]), (("assistant", "user"), ["hello there", "good day", "bye"]), ((), [])):
        (r,) = formatted(spark.createDataFrame(rows, SCHEMA), learned=learned).collect()
        ids, mask = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["mask"], np.int8)
        assert (mask[ids >= lib.size] == 0).all() and (ids >= lib.size).sum() == 11
        edges = np.flatnonzero(np.diff(mask, prepend=0, append=0))
        assert [b"".join(lib.bytes[t] for t in ids[a:z]).decode() for a, z in zip(edges[::2], edges[1::2])] == told
        written = "".join(CONTROLS[t - lib.size] if t >= lib.size else lib.bytes[t].decode() for t in ids.tolist())
        assert written == "### System:be kind</turn>### User:hello there</turn>### Assistant:good day</turn>### Role:tool### Text:42</turn>### Assistant:bye</turn>"


def test_empty(spark):
    assert read_back(formatted(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_agrees_with_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    got, sql = q.op11_chat_formatting(spark, sf).toPandas(), con.execute(q.OP11_SQL).df()
    assert got.sort_values("conv_id")[sorted(got)].astype(str).values.tolist() == sql.sort_values("conv_id")[sorted(sql)].astype(str).values.tolist()
    assert -7 in set(got["conv_id"])
