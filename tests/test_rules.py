"""Rule sets against a plain loop over paragraphs."""

import random
import re

import pytest

from quillon.operators import rules as ru

FLAGS = {"IGNORECASE": re.I, "VERBOSE": re.X, "DOTALL": re.S, "MULTILINE": re.M}


def plain(raw, paragraphs):
    """The name of the first rule that fires on each paragraph, in order."""
    out, before = [], False
    for text in paragraphs:
        name = None
        for r in raw:
            if r.get("kind"):
                hit = before and text.lstrip().startswith(("“", '"', "‘", "'"))
            else:
                flags = sum(FLAGS[f] for f in r.get("flags", ["IGNORECASE"]))
                find = re.match if r.get("mode", "match") == "match" else re.search
                hit = find(r["pattern"], text, flags) and (r.get("max_words") is None or len(text.split()) <= r["max_words"]) and (not r.get("require") or re.search(r["require"], text, flags))
            if hit:
                name = r["name"]
                break
        out.append(name)
        before = name is not None
    return out


CHAIR_SAYS = [
    "I now give the floor to the representative of Norway.", "I shall now  give the floor", "I once again warmly welcome the Minister.", "I am grateful to all, and to the interpreters above all.",
    "I am grateful. The interpreters stay.", "The Security Council will now\nbegin its consideration", "Rule 37 of the Council", "under rule 12 of the Assembly it is so", "There are 14 more speakers on the list", "There are many speakers",
    "The Council is ready to proceed", "The draft resolution has been adopted", "The resolution was not adopted", "The provisional agenda was adopted today", "May I take it that", "Maybe not", "On behalf of the Council, I thank him",
    "The representative of Chad asked for the floor", "The meeting stands adjourned", "I NOW INVITE them", "I thank Mr. Lund for his briefing.", "I thank you", "I also wish to thank her for the statement " + "and more " * 40, "I express my sincere thanks for their remarks",
    "“Rule 37 says this.”", '"and that"', " ‘and this’", "'and more'", "We speak of substance here.", "“A quotation of substance”", "", "  ", "I would like to inform the Council", "Did you finish your statement",
    "It is my understanding that the Council is ready", "I intend, with the concurrence of all", "In view of the request made by some, I shall put it", "Ｉ now invite", "I\xa0now invite you",
]


def judged(spark, raw, groups):
    rows = [(g, i, t) for g, own in enumerate(groups) for i, t in enumerate(own)]
    df = spark.createDataFrame(rows, "g int, i int, text string").repartition(4)
    got = {(r["g"], r["i"]): r["rule"] for r in ru.judged(df, ["g"], ["i"], ru.parse(raw)).collect()}
    return [[got[g, i] for i in range(len(own))] for g, own in enumerate(groups)]


def test_chair_rules_against_a_plain_loop(spark):
    r = random.Random(10)
    groups = [CHAIR_SAYS] + [[r.choice(CHAIR_SAYS) for _ in range(r.randrange(1, 12))] for _ in range(200)]
    want = [plain(ru.CHAIR, own) for own in groups]
    assert judged(spark, ru.CHAIR, groups) == want
    assert {n for own in want for n in own} == {None, "chair_housekeeping", "courtesy_thanks", "quote_after_procedural"}


@pytest.mark.parametrize("seed", range(4))
def test_any_set_of_rules(spark, seed):
    r = random.Random(seed)
    pool = [
        {"name": "a", "pattern": "the", "mode": "search"}, {"name": "b", "pattern": r"(?P<x>\w)(?P=x)", "mode": "search", "require": r"\d"}, {"name": "c", "pattern": "I", "flags": [], "max_words": 6},
        {"name": "d", "pattern": r" [#\ ] | x  # or x", "flags": ["VERBOSE"], "mode": "search"}, {"name": "e", "pattern": r"^b", "flags": ["MULTILINE"], "mode": "search"}, {"name": "f", "pattern": "a.b", "flags": ["DOTALL", "IGNORECASE"]},
        {"name": "q", "kind": ru.INHERIT}, {"name": "q2", "kind": ru.INHERIT}, {"name": "g", "pattern": "é\\b", "mode": "search", "max_words": 0 if seed == 3 else 9}, {"name": "z", "pattern": r"\s*\Z"},
    ]
    raw = r.sample(pool, r.randrange(2, len(pool)))
    bits = ["the", "I", "“", "'", " ", "b", "\n", "aa 1", "É", "café", "x", "#", "A\nb", "word word"]
    groups = [["".join(r.choice(bits) for _ in range(r.randrange(6))) for _ in range(r.randrange(1, 9))] for _ in range(150)]
    assert judged(spark, raw, groups) == [plain(raw, own) for own in groups]


def test_faults_of_rules():
    for bad, said in (({"name": "x"}, "neither"), ({"name": "x", "kind": "odd"}, "unknown kind"), ({"pattern": "(", "name": "x"}, "bad pattern"), ({"pattern": "a", "require": "["}, "bad require"), ({"pattern": "a", "flags": ["LOUD"]}, "unknown flag"), ({"pattern": "a", "mode": "near"}, "unknown mode"), ({"pattern": "a", "max_words": "9"}, "whole number"), ("text", "not a mapping"), ({"pattern": "a", "patern": "b"}, "unknown key")):
        with pytest.raises(ru.RuleError, match=said):
            ru.parse([bad])
    with pytest.raises(ru.RuleError, match="x: bad pattern.*y: neither.*repeats"):
        ru.parse([{"name": "x", "pattern": "("}, {"name": "y"}, {"name": "x", "pattern": "a"}])
    with pytest.raises(ru.RuleError, match="no map"):
        ru.blocs({"a": {}}, "b")


def test_blocs(spark):
    df = spark.createDataFrame([(" Chad ",), ("Peru",), (None,)], "c string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(ru.bloc_of(F.col("c"), ru.blocs({"m": {"Chad": "x"}}, "m"))).collect()] == ["x", None, None]
    assert [r[0] for r in df.select(ru.bloc_of(F.col("c"), {})).collect()] == [None] * 3
