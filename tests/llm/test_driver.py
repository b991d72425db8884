"""What the driver itself holds, and how often its garbage is collected."""

from types import SimpleNamespace

import numpy as np
from quillon.llm import common, mixing, packing, quality


def test_the_driver_loads_no_vocabulary(spark, monkeypatch):
    def refused(path):
        raise AssertionError("loaded on the driver")

    monkeypatch.setattr(packing, "Ids", refused)
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    rows = packing.packed(docs).collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in rows if r["doc_id"] == 2) == [(2, 0, 1)]


def test_training_blocks_weigh_three_bytes_a_byte():
    rows, echo = quality._blocks(b"abcdabcd" * 100)
    assert rows.nbytes + echo.nbytes == 3 * 800
    assert not echo.ravel()[:7].any() and echo.ravel()[7:].all()
    net = quality.Network.fresh(7, 0.5)
    assert quality._input(net, rows, echo).dtype == np.float32
    assert quality._input(net.rounded(), rows, echo).dtype == np.float64


def test_collections_take_a_bounded_share_of_the_time(spark, monkeypatch):
    now = [1000.0]

    def tick():  # the clock goes on by two seconds each time it is read
        now[0] += 2
        return now[0]

    monkeypatch.setattr(common, "time", SimpleNamespace(monotonic=tick))
    monkeypatch.setattr(common, "_collect_after", 0.0)
    common.cut(spark.range(3))
    after = common._collect_after
    assert after == 1004 + 2 * common.COLLECT_SHARE
    common.cut(spark.range(3))
    assert common._collect_after == after  # none was due
    now[0] = after
    common.cut(spark.range(3))
    assert common._collect_after > after


def test_the_mix_makes_its_schedule_once(spark, monkeypatch):
    ranks = []
    real = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: ranks.append(real(*a)) or ranks[-1])
    docs = spark.createDataFrame([(i, "a b c " * (i % 5 + 1), "xyz"[i % 3]) for i in range(60)], "doc_id long, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert len(ranks) == 1 and "Range (" not in plan
