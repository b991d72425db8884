"""Rule sets as data: ordered rules over paragraphs, compiled to expressions.

A rule is a mapping: name; pattern with mode (match: from the start; search:
anywhere) and flags; max_words, above which it does not fire; require, a pattern
that must be found too; or kind inherit_previous_quote, which fires on a paragraph
that opens with a quotation mark behind one for which any rule fired. The first
rule of the list that fires names the paragraph. Own patterns are one expression
a paragraph; what inherits is one fold over the paragraphs of a group, however
many rules there are.

Patterns are written for a regex dialect with verbose layout and Unicode classes;
``java`` brings them to the engine's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions import text as tx

INHERIT = "inherit_previous_quote"
MODES, FLAGS = ("match", "search"), {"IGNORECASE": "iu", "DOTALL": "s", "MULTILINE": "m", "VERBOSE": ""}
KEYS = {"name", "kind", "pattern", "mode", "flags", "max_words", "require"}
QUOTES = ("“", '"', "‘", "'")


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str | None = None
    pattern: str | None = None  # in the engine's dialect, anchored if it must match
    require: str | None = None
    max_words: int | None = None


def unlaid(pattern: str) -> str:
    """A verbose pattern without its layout: white space and comments go, but
    where they are escaped or in a class."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "#" and not in_class:
            i = (pattern + "\n").index("\n", i)
            continue
        in_class = c == "[" or in_class and c != "]"
        if in_class or not c.isspace():
            out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str, flags: tuple[str, ...] = ("IGNORECASE",), whole: bool = False) -> str:
    """``pattern`` in the engine's dialect; ``whole`` anchors it at the start."""
    if "VERBOSE" in flags:
        pattern = unlaid(pattern)
    pattern = pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    return f"(?U{''.join(FLAGS[f] for f in flags)})" + (rf"\A(?:{pattern})" if whole else pattern)


def parse(raw: list[dict]) -> list[Rule]:
    """Raises RuleError with every fault found, each with its place."""
    out, errors, names = [], [], set()
    for i, r in enumerate(raw if isinstance(raw, list) else [raw]):
        if not isinstance(r, dict):
            errors.append(f"rules[{i}]: not a mapping")
            continue
        name, kind, flags = str(r.get("name", f"rule_{i}")), r.get("kind"), tuple(r.get("flags", ["IGNORECASE"]))
        say = lambda what: errors.append(f"{name}: {what}")  # noqa: B023, E731
        for k in sorted(set(r) - KEYS):
            say(f"unknown key {k!r}")
        if name in names:
            say("name repeats")
        names.add(name)
        if kind not in (None, INHERIT):
            say(f"unknown kind {kind!r}")
        if kind is None and "pattern" not in r:
            say("neither pattern nor kind")
        if r.get("mode", "match") not in MODES:
            say(f"unknown mode {r['mode']!r}")
        unknown = [f for f in flags if f not in FLAGS]
        for f in unknown:
            say(f"unknown flag {f!r}")
        for k in ("pattern", "require"):
            try:
                re.compile(str(r.get(k) or ""), re.VERBOSE if "VERBOSE" in flags else 0)
            except re.error as e:
                say(f"bad {k}: {e}")
        most = r.get("max_words")
        if most is not None and (not isinstance(most, int) or isinstance(most, bool) or most < 0):
            say("max_words is no whole number")
        if not unknown and kind is None and "pattern" in r:
            own = [java(str(r[k]), flags, k == "pattern" and r.get("mode", "match") == "match") if r.get(k) else None for k in ("pattern", "require")]
            out.append(Rule(name, None, *own, most))
        elif kind == INHERIT:
            out.append(Rule(name, INHERIT))
    if errors:
        raise RuleError("; ".join(errors))
    return out


def fires(rule: Rule, text: Column, n_words: Column) -> Column:
    """Whether a rule with a pattern fires; the cheap tests come first."""
    hit = F.lit(True) if rule.max_words is None else n_words <= rule.max_words
    for p in (rule.pattern, rule.require):
        if p is not None:
            hit = hit & text.rlike(p)
    return F.coalesce(hit, F.lit(False))


def judged(df: DataFrame, group: list[str], order: list, rules: list[Rule], text: str = "text", to: str = "rule") -> DataFrame:
    """``df`` with the name of the first rule that fires on each paragraph, null
    where none does. ``order`` is the order of a group's paragraphs."""
    n_words = tx.word_count(F.col(text))
    before, after = F.lit(None).cast("string"), F.lit(None).cast("string")  # hits before and behind the first that inherits
    inherits = [i for i, r in enumerate(rules) if r.kind == INHERIT]
    for i, r in list(enumerate(rules))[::-1]:
        if r.kind is not None:
            continue
        hit = fires(r, F.col(text), n_words)
        if not inherits or i < inherits[0]:
            before = F.when(hit, r.name).otherwise(before)
        else:
            after = F.when(hit, r.name).otherwise(after)
    if not inherits:
        return df.withColumn(to, before)
    df = df.withColumns({"_before": before, "_after": after, "_quote": F.coalesce(F.regexp_replace(text, r"(?U)^\s+", "").rlike(f"^[{''.join(QUOTES)}]"), F.lit(False))})
    own = F.coalesce("_before", "_after")
    # A quotation without a hit of its own says nothing: what was told before it still holds.
    told = F.when(own.isNotNull(), True).when(~F.col("_quote"), False)
    so_far = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    carried = F.col("_quote") & F.coalesce(F.last(told, ignorenulls=True).over(so_far), F.lit(False))
    name = F.coalesce("_before", F.when(carried, rules[inherits[0]].name), "_after")
    return df.withColumn(to, name).drop("_before", "_after", "_quote")


def blocs(maps: dict[str, dict[str, str]], name: str) -> dict[str, str]:
    """The named map of countries to blocs."""
    if name not in maps:
        raise RuleError(f"no map {name!r}; there are {', '.join(sorted(maps))}")
    return {str(k): str(v) for k, v in maps[name].items()}


def bloc_of(country: Column, chosen: dict[str, str]) -> Column:
    """The bloc of a country, null for none; names are compared trimmed."""
    if not chosen:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair]), F.trim(country))


# The formulas of a chair, in their order; courtesies; quotations behind either.
CHAIR = [
    {"name": "chair_housekeeping", "mode": "match", "flags": ["IGNORECASE", "VERBOSE"], "pattern": r"""
        ^(?:
          I\s(?:now\s|shall\snow\s|shall\sfirst\s|will\snow\s|should\snow\s|then\s|once\sagain\s|
              again\s|warmly\s)*(?:give|call\son|invite|welcome)\b
        | I\s(?:now\s)?(?:give|call)\sthe\sfloor\b
        | I\sshall\s(?:now|first)\s(?:give|call)\b
        | I\stake\snote\sof\sthe\sstatement\b
        | I\sam\sgrateful\b[^.]{0,80}\binterpreters\b
        | The\s(?:presidency|President)\sof\sthe\sSecurity\sCouncil\b[^.]{0,80}\bfloor\b
        | We\sare\spresiding\sover\sthe\sCouncil\b
        | The\s(?:Security\sCouncil|General\sAssembly)\swill\snow\s
              (?:begin|proceed|take|resume|consider|hear|vote)\b
        | The\sGeneral\sAssembly\shas\sthus\sconcluded\b
        | In\saccordance\swith\s(?:rule|the\sunderstanding|Article)\b
        | (?:Under\s)?Rule\s\d+\sof\sthe\s(?:Council|Assembly)
        | (?:There\sbeing|In\sthe\sabsence\sof)\sno\sobjection\b
        | If\sI\shear\sno\sobjection\b
        | It\sis\sso\sdecided\b
        | I\spropose\sthat\s(?:the\s(?:Council|Assembly)\sinvite|we\smove\son)\b
        | I\s(?:now\s)?resume\smy\sfunctions\sas\s(?:the\s)?President\b
        | The\s(?:representative|Permanent\s(?:Observer|Representative)|Minister|Observer)\b
              [^.]{0,140}?\b(?:asked\sfor\sthe\sfloor|has\ssubmitted)\b
        | There\s(?:are|is|appear\sto\sbe)\s(?:no\smore|still|\d+)\b
              [^.]{0,60}\b(?:names\sinscribed|speakers)\b
        | The\snext\sspeaker\b
        | Members\sof\sthe\s(?:Council|Assembly)\shave\sbefore\sthem\b
        | (?:It\sis\smy\sunderstanding\sthat\s)?The?\s?(?:Council|Assembly)\sis\sready\sto\sproceed\b
        | It\sis\smy\sunderstanding\sthat\sthe\s(?:Council|Assembly)\sis\sready\b
        | I\sshall\s(?:now\s|first\s)?put\b
        | Accordingly,\sI\sintend\sto\sput\b
        | I\sintend,\swith\sthe\sconcurrence\b
        | In\sview\sof\sthe\srequest\smade\b[^.]{0,120}\bput\b
        | (?:The\sprovisional\sagenda|The\s(?:draft\s)?resolution|The\s(?:proposed\s)?
              (?:oral\s)?amendment)\s(?:received|was\s(?:adopted|not\sadopted)|
              has\s(?:been\s)?(?:adopted|not\sbeen\sadopted))\b
        | I\s(?:would\slike\sto|wish\sto|should\slike\sto)\s
              (?:remind|inform|request|encourage|draw\sthe\sattention|take\sthis\sopportunity)\b
        | (?:May\sI|Before\s(?:giving\sthe\sfloor|continuing|we\s(?:begin|proceed)|I\sadjourn))\b
        | May\sI\stake\sit\sthat\b
        | On\sbehalf\sof\sthe\s(?:Council|Assembly),\sI\s
              (?:wish|should\slike|thank|congratulate|welcome)\b
        | We\shave\sheard\sthe\s(?:last|final)\sspeaker\b
        | We\sshall\s(?:hear|now\sproceed|now\sturn|now\sconsider)\b
        | I\s(?:shall|will)\snow\smake\sa\sstatement\sin\smy\scapacity\b
        | The\smeeting\s(?:is|stands)\s(?:adjourned|suspended)\b
        | I\snow\sinvite\b
        | The\sPermanent\sObserver\sof\sthe\sObserver\sState\b
        | I\sreiterate\sto\sall\sparticipating\sdelegations\b
        | In\sorder\sto\sensure\sthat\sall\sspeakers\b
        | Allow\sme\sto\sexpress\smy\ssincere\sthanks\sto\sthe\sinterpreters\b
        | Did\syou\sfinish\syour\sstatement\b
        )"""},
    {"name": "courtesy_thanks", "mode": "match", "max_words": 60,
     "pattern": r"^I\s(?:also\s|now\s|again\s)?(?:thank|wish\sto\sthank|should\slike\sto\sthank|express\smy\s\w+\s(?:appreciation|thanks))\b",
     "require": r"\b(briefing|statement|presentation|remarks|clarification|participation|being\shere|Secretary-General|his|her|their)\b"},
    {"name": "quote_after_procedural", "kind": INHERIT},
]
