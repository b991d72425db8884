"""Codebook parsing, reply checks, sources and sinks, streams."""

import json
import sqlite3  # noqa: F401

import pytest
from pyspark.sql import functions as F

from quillon.operators import codebook as cbk
from quillon.operators import replies as rp
from quillon.sources import tables as src
from quillon.streaming.jobs import start_worker

RAW = {"id": "v", "version": 2, "title": "t", "dimensions": [
    {"name": "kind", "categories": [{"code": "A", "definition": "first thing entirely"}, {"code": "B", "definition": "another matter altogether"}]},
    {"name": "who", "required": False, "conditional_on": "kind", "categories": [{"code": "X", "definition": "x"}, {"code": "Y", "definition": "y"}]},
]}


def changed(**what):
    return {**RAW, **what}


def test_parse_and_faults():
    cb = cbk.parse(RAW)
    assert cb.codes() == {"kind": ("A", "B"), "who": ("X", "Y")} and not cb.warnings and cb.dimensions[1].allows_none
    ordinal = {"name": "o", "scale": "ordinal", "categories": [{"code": "0", "value": 0, "definition": "a"}, {"code": "2", "value": 2, "definition": "b"}]}
    assert any("gaps" in w for w in cbk.parse(changed(dimensions=[ordinal], oops=1)).warnings)
    for bad in ({"version": "2"}, {"dimensions": []}, {"dimensions": [RAW["dimensions"][0]] * 2}, {"dimensions": [{**RAW["dimensions"][0], "conditional_on": "nope"}]}, {"dimensions": [{**RAW["dimensions"][0], "conditional_on": "who"}, RAW["dimensions"][1]]}, {"dimensions": [{"name": "k", "categories": [{"code": "NONE"}]}]}, {"dimensions": [{**ordinal, "categories": [{"code": "1"}]}]}, {"dimensions": [{"name": "k", "scale": "odd", "categories": [{"code": "a"}]}]}):
        with pytest.raises(cbk.CodebookError):
            cbk.parse(changed(**bad))


def reply(**units):
    return json.dumps({k[1:]: v for k, v in units.items()})


GOOD = [{"kind": "A", "who": "X", "evidence": "words", "confidence": 1.4}, {"kind": "none", "who": None}, {"kind": "B", "evidence": "more", "confidence": "0.9"}]
SCALED = {**RAW, "allow_multiple_annotations": False, "dimensions": [
    {"name": "level", "scale": "ordinal", "allow_multiple_values": True, "categories": [{"code": str(i), "value": i, "definition": "x"} for i in range(3)]},
    {"name": "why", "required": False, "conditional_on": {"dimension": "level", "in": ["1", "2"]}, "categories": [{"code": "P", "definition": "y"}]},
]}


@pytest.mark.parametrize("raw,text,n,error", [
    (RAW, reply(_1=GOOD, _2=[]), 2, None),
    (RAW, "Sure:\n```json\n" + reply(_1=GOOD) + "\n```", 1, None),
    (RAW, reply(_1=None, _2=GOOD[:1]), 2, None),
    (RAW, "{}", 0, None),
    (RAW, None, 1, "no JSON"),
    (RAW, "no json", 1, "no JSON"),
    (RAW, '{"1": [], "1": []}', 1, "no JSON"),
    (RAW, "[1, 2]", 1, "no object"),
    (RAW, reply(_1=GOOD), 2, "missing keys 2"),
    (RAW, reply(_1=[], _2=[], _10=[]), 1, "unexpected keys 10, 2"),
    (RAW, reply(_1=[], _2={"kind": "A"}), 2, "key 2: no list"),
    (RAW, reply(_1=["x"]), 1, "key 1, annotation 0: no object"),
    (RAW, reply(_1=[{"kind": "NONE"}, {"evidence": "e"}]), 1, "key 1, annotation 1: no known dimension"),
    (RAW, reply(_1=[{"kind": ["A"], "evidence": "e"}]), 1, "key 1, annotation 0: kind: a list"),
    (RAW, reply(_1=[{"kind": "C", "evidence": "e"}]), 1, "key 1, annotation 0: kind: no code C"),
    (RAW, reply(_1=[{"kind": {"a": 1}, "evidence": "e"}]), 1, 'key 1, annotation 0: kind: no code {"a":1}'),
    (RAW, reply(_1=[{"kind": " ", "who": "X", "evidence": "e"}]), 1, "key 1, annotation 0: kind: required"),
    (RAW, reply(_1=[{"kind": "A"}]), 1, "key 1, annotation 0: no evidence"),
    (RAW, reply(_1=[{"kind": "A", "evidence": 7}]), 1, "key 1, annotation 0: no evidence"),
    (RAW, reply(_1=[{"kind": "A", "evidence": " \n"}]), 1, "key 1, annotation 0: no evidence"),
    (RAW, reply(_1=[{"kind": "A", "evidence": "e"}] * 5), 1, "key 1: too many annotations"),
    (SCALED, reply(_1=[{"level": 1, "why": "P", "evidence": "e"}]), 1, None),
    (SCALED, reply(_1=[{"level": ["2", "0"], "evidence": "e"}]), 1, None),
    (SCALED, reply(_1=[{"level": [], "why": "NONE"}]), 1, None),
    (SCALED, reply(_1=[{"level": "0", "why": "P", "evidence": "e"}]), 1, "key 1, annotation 0: why: needs level"),
    (SCALED, reply(_1=[{"level": "3", "evidence": "e"}]), 1, "key 1, annotation 0: level: no code 3"),
    (SCALED, reply(_1=[{"level": "1", "evidence": "e"}] * 2), 1, "key 1: too many annotations"),
])
def test_replies(spark, raw, text, n, error):
    cb = cbk.parse(raw)
    got = rp.checked(cb, spark.createDataFrame([("s", text, n)], "speech_id string, reply string, n_units int"))
    rows = rp.reply_rows(cb, got, ["speech_id"]).orderBy("unit_no", "annotation_index", "dimension").collect()
    assert got.first()["error"] == error
    if error:
        assert not rows  # refused as a whole
    elif raw is RAW and text and "more" in text:
        assert [(r["annotation_index"], r["dimension"], r["value"], r["confidence"]) for r in rows] == [(0, "kind", "A", 1.0), (0, "who", "X", 1.0), (2, "kind", "B", None)]
    elif raw is SCALED:
        assert [r["value"] for r in rows] == {"P": ["1", "P"], "2": ["2"], "E": []}["P" if "P" in text else "2" if "2" in text else "E"]


def test_evidence_of_replies(spark):
    cb = cbk.parse(RAW)
    text = reply(_1=[{"kind": "A", "evidence": "The “second”  words"}], _2=[{"kind": "B", "evidence": "first words ... follow here"}, {"kind": "B", "evidence": "nowhere"}])
    df = spark.createDataFrame([("s", text, 2, ['so the "second" words', "the first words that follow here"])], "speech_id string, reply string, n_units int, texts array<string>")
    got = rp.reply_rows(cb, rp.checked(cb, df), ["speech_id"], "texts").orderBy("unit_no", "annotation_index")
    assert [(r["unit_no"], r["verified"]) for r in got.collect()] == [(1, True), (2, True), (2, False)]


def test_a_reply_is_parsed_once(spark, sf):
    """However often its parts are asked for, and no filter before the explode repeats it."""
    import __spark_entry__ as entry

    for name in ("reply_faults", "reply_rows"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("```[A-Za-z]*") == 1 and plan.lower().count("parsejson") == 1, name


def test_conditions_name_codes():
    with pytest.raises(cbk.CodebookError, match="names no codes"):
        cbk.parse({**SCALED, "dimensions": [SCALED["dimensions"][0], {**SCALED["dimensions"][1], "conditional_on": {"dimension": "level", "in": ["9"]}}]})


def test_blocks_and_rows(spark):
    u = spark.createDataFrame([("s", 3, "b"), ("s", 0, "a")], "speech_id string, para_index int, text string")
    assert cbk.speech_blocks(u).first()["block"] == "[1] a\n[2] b"
    assert cbk.parse(RAW).rows(spark).count() == 4 and cbk.prompt(cbk.parse(RAW)) == cbk.prompt(cbk.parse(RAW))


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'line\n"quoted", and\n\nmore'), (2, None), (3, "é")]
    df = spark.createDataFrame(rows, "id int, text string")
    src.write_csv(df, str(tmp_path / "c"), one_file=True)
    assert sorted(map(tuple, src.read_csv(spark, str(tmp_path / "c"), "id int, text string").collect())) == rows
    src.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    (tmp_path / "x.pdf").write_bytes(b"abc")
    assert src.read_binary(spark, str(tmp_path)).first()["sha256"].startswith("ba7816bf")


def test_sinks(spark):
    df = spark.createDataFrame([("a_b", 0.51234, "p"), ("50%", None, "q")], "name string, share double, panel string")
    t = src.latex_table(df, "A $k$ & b", "tab:x", panel="panel")
    assert r"a\_b & 0.512" in t and r"50\% & " in t and r"\textit{q}" in t and r"\$k\$" in t
    with pytest.raises(ValueError):
        src.latex_table(df, "c", "l", most=1)
    long = spark.createDataFrame([("x" * 40_000,)], "t string")
    assert len(src.for_sheet(long).first()["t"]) == src.CELL_CHARS and src.sheet_name("a/b" * 20)[:3] == "a_b"
    assert json.loads(src.manifest(df, run="r"))["rows"] == 2
    assert src.dump(spark.createDataFrame([(1, "x")], "a int, error string")).columns == ["a"]
    assert src.best_source({"a": {"n": 1}, "b": {"n": 100}}, {"n": 100}) == "b"
    with pytest.raises(ValueError):
        src.best_source({"a": {"n": 1}}, {"n": 100})


def test_worker_resumes(spark, tmp_path):
    units, log, at = str(tmp_path / "u"), str(tmp_path / "log"), str(tmp_path / "ck")
    spark.range(3).write.parquet(units)
    annotate = lambda df: df.withColumn("status", F.lit("ok"))
    for extra in (0, 2):
        if extra:
            spark.range(3, 3 + extra).write.mode("append").parquet(units)
        start_worker(spark.readStream.schema("id long").parquet(units), annotate, log, at).awaitTermination()
    got = spark.read.parquet(log)
    assert got.count() == 5 and got.select("id").distinct().count() == 5
