"""Personal data: base patterns, and information-theoretic sanitisation.

Base kinds (email, ip, card, phone) are found in every whole text, leftmost and
non-overlapping per kind, then checked; a match that fails its check is dropped
and not retried.

Sanitisation: protected entities are every distinct base value, each kind, and
personal data of any kind; every term of a document that holds an entity is a
candidate, wherever it stands. Terms are words, and runs of letters and digits
mixed, which count by their shape (hexadecimal or not, and length rounded down to
a power of two): as a rule each of them stands once, its shape often. With
document counts over the whole corpus, a term t tells an entity e by
PMI(e, t) = log2(p(e | t) / p(e)), and all of it would be IC(e) = -log2 p(e). The
threshold is put on the estimate itself: p(e | t) = n(e, t) / n(t) is taken at
its lower Wilson bound, so a term needs no fixed number of documents but enough
for its estimate to be safe, and t exceeds the disclosure threshold if
PMI >= alpha x IC. A value's own words are few and chosen after the fact, so
values have the stricter alpha and bound. Every occurrence of a term over the
threshold becomes a span: ``remove`` if the entity stands in all documents with
the term, else ``generalise``.

Which words the workers look for is told by a bit sieve that grows with their
number, up to 2**MOST_BITS bits; what passes it by chance is dropped by an exact
join. Only FEW words at most are sent to the workers themselves, so no vocabulary
is broadcast or collected. No text is shuffled.

Defined cases: null text counts as empty; empty texts and tables have no spans;
repeated rows have the same spans; other columns are not touched, whatever they
are called.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, text_of, unnamed

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information that a term may tell, and standard errors of
#: its estimate's bound: for kinds of data, and for single values.
KIND_ALPHA, KIND_Z = 0.6, 3.0
VALUE_ALPHA, VALUE_Z = 0.9, 3.0
LEAST_BITS, MOST_BITS = 16, 27
KEPT_COUNTS = 100_000
KEPT_WORDS = 300_000
FEW = 10_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile(r"[0-9]")
# A match that starts inside a run of digits would start at the run's first digit too, so only those are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_RUN = re.compile(r"[^\W_]{8,}")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[^\W\d_])")
_HEX = re.compile(r"[0-9a-f]+")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOCAL_CHARS = frozenset(_LETTERS + "0123456789._%+-")
# Of UTF-8: all but letters and bytes beyond ASCII as spaces; and letters and those bytes as a, digits as 0.
_WORD_BYTES = bytes(c if c >= 128 or chr(c) in _LETTERS else 32 for c in range(256))
_RUN_BYTES = bytes(97 if c >= 128 or chr(c) in _LETTERS else 48 if 48 <= c < 58 else 32 for c in range(256))


def emails(text: str) -> list[tuple[int, int]]:
    """One @ after the other: the local part runs back from it, not beyond the
    previous match, and the domain must follow it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d if d < 10 else d - 9 for d in (2 * int(c) for c in even))) % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = [(a, z, "email") for a, z in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _only_digits(m.group())) <= 19 and _luhn(d):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_only_digits(m.group())) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def covered(spans: list[tuple[int, int, str]]):
    """A test whether a stretch overlaps any of the spans."""
    starts, ends = [], []
    for a, z, _ in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], z)
        else:
            starts.append(a)
            ends.append(z)
    return lambda a, z: (i := bisect_left(starts, z)) > 0 and ends[i - 1] > a


def entity(text: str, span: tuple[int, int, str]) -> str:
    """The protected value of a base span, however it is written."""
    a, z, kind = span
    return f"{kind}:{text[a:z].lower() if kind == 'email' else _only_digits(text[a:z])}"


def terms(text: str) -> list[tuple[int, int, str]]:
    """(start, end, term): the words and the mixed runs of a lower-cased text."""
    out = [(*m.span(), m.group()) for m in _TERM.finditer(text)]
    return out + [(*m.span(), shape(m.group())) for m in _RUN.finditer(text) if _MIXED.match(m.group())]


def shape(run: str) -> str:
    return f"#{'x' if _HEX.fullmatch(run) else 'a'}{1 << (len(run).bit_length() - 1)}"


def terms_of(text: str) -> set[str]:
    """The different terms of a lower-cased text. Its bytes are split where ASCII
    has no letter; the patterns read only what other characters may cut, and texts
    with a digit beside a letter."""
    raw = text.encode("utf-8", "surrogatepass")
    found = set(raw.translate(_WORD_BYTES).decode("utf-8", "surrogatepass").split())
    if len(raw) > len(text) and (odd := [w for w in found if not w.isalpha()]):
        found.difference_update(odd)
        found.update(_TERM.findall(" ".join(odd)))
    found = {w for w in found if len(w) > 2}
    runs = raw.translate(_RUN_BYTES)
    if b"a0" in runs or b"0a" in runs:
        found.update(shape(r) for r in _RUN.findall(text) if _MIXED.match(r))
    return found


def folded(text: str) -> str:
    """Lower-cased, code point for code point."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def words_of(text: str, spans: list[tuple[int, int, str]]) -> set[str]:
    """The terms of a text that are not part of a span."""
    taken = covered(spans)
    return {t for a, z, t in terms(folded(text)) if not taken(a, z)}


class Sieve:
    """Bits for the words looked for, 16 for each on average and more: a word sets
    four of one block of 64, so that few others (under 1 %) pass by chance. Up to
    FEW words are held themselves, and nothing else passes."""

    def __init__(self, words: DataFrame):
        n = words.count()
        if n <= FEW:
            self.bits_of, self.empty = 0, n == 0
            self.shared = words.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in words.select("word").collect()))
            return
        self.bits_of = bits_of = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
        hashed = F.md5(F.col("word").cast("binary"))
        digits = lambda start, n: F.conv(F.substring(hashed, start, n), 16, 10).cast("long")
        rows = words.select(digits(1, 8).bitwiseAND(F.lit((1 << bits_of - 6) - 1)).alias("at"), digits(9, 6).alias("m"))
        mask = F.expr(" | ".join(f"shiftleft(1L, cast(shiftright(m, {6 * i}) & 63 as int))" for i in range(4)))
        bits, self.empty = bytearray(1 << (bits_of - 3)), True
        for r in rows.groupBy("at").agg(F.bit_or(mask).alias("bits")).toLocalIterator():  # at most 2**(MOST_BITS - 6) rows
            bits[8 * r["at"] : 8 * r["at"] + 8] = r["bits"].to_bytes(8, "little", signed=True)
            self.empty = False
        self.shared = words.sparkSession.sparkContext.broadcast(bytes(bits))

    def picker(self):
        """A test of words that remembers its answers, for one task."""
        if not self.bits_of:
            return self.shared.value.__contains__
        bits, last, known = self.shared.value, (1 << self.bits_of - 6) - 1, {}

        def holds(word: str) -> bool:
            got = known.get(word)
            if got is None:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                h = md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                at, m = 8 * (int.from_bytes(h[:4], "big") & last), int.from_bytes(h[4:7], "big")
                block = int.from_bytes(bits[at : at + 8], "little")
                got = known[word] = bool(block >> (m & 63) & block >> (m >> 6 & 63) & block >> (m >> 12 & 63) & block >> (m >> 18) & 1)
            return got

        return holds

    def passing(self, words: list[str]) -> list[str]:
        """Those of many words that pass, tested together."""
        if not self.bits_of:
            return list(filter(self.shared.value.__contains__, words))
        hashed = b"".join([md5(w.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for w in words])
        h = np.frombuffer(hashed, ">u4").reshape(-1, 4).astype(np.uint64)
        block, m = np.frombuffer(self.shared.value, "<u8")[h[:, 0] & np.uint64((1 << self.bits_of - 6) - 1)], h[:, 1] >> np.uint64(8)
        got = np.ones(len(words), np.uint64)
        for i in range(4):
            got &= block >> (m >> np.uint64(6 * i) & np.uint64(63))
        return [words[i] for i in np.flatnonzero(got)]


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(text_of(text_col).alias("text"))


def co_occurrence(docs: DataFrame, text_col: str = "text", keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(entity, n_e), and (entity, word, n_et), in documents; of the latter only
    those for which ``keep``, of entity and n, holds."""

    def find(batches):
        seen: dict[tuple[str, str], int] = {}

        def out():
            cols = list(zip(*seen)) or [[], []]
            batch = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["entity", "word", "n"])
            seen.clear()
            return batch

        for b in batches:
            for t in b.column(0).to_pylist():
                if spans := base_spans(t):
                    words = ["", *words_of(t, spans)]
                    for e in {entity(t, s) for s in spans} | {f"{s[2]}:" for s in spans} | {"any:"}:
                        for w in words:
                            seen[e, w] = seen.get((e, w), 0) + 1
                        if len(seen) >= KEPT_COUNTS:
                            yield out()
        yield out()

    met = _texts(docs, text_col).mapInArrow(find, "entity string, word string, n long")
    met = met.groupBy("entity", "word").agg(F.sum("n").alias("n"))
    met = cut(met if keep is None else met.where((F.col("word") == "") | keep))
    return met.where("word = ''").select("entity", F.col("n").alias("n_e")), met.where("word <> ''").select("entity", "word", F.col("n").alias("n_et"))


def document_counts(docs: DataFrame, words: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n_t): in how many documents each of ``words`` stands."""
    sieve = Sieve(words)
    if sieve.empty:
        return words.select("word", F.lit(0).cast("long").alias("n_t"))

    def count(batches):
        fresh, seen = Counter(), Counter()  # of all words, and of those that have passed

        def sift():
            for w in sieve.passing(list(fresh)):
                seen[w] += fresh[w]
            fresh.clear()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for b in batches:
            for t in b.column(0).to_pylist():
                fresh.update(terms_of(folded(t)))
                if len(fresh) >= KEPT_WORDS:
                    sift()
                if len(seen) >= KEPT_WORDS:  # each time they are given out costs a row a word
                    yield out()
        sift()
        yield out()

    got = _texts(docs, text_col).mapInArrow(count, "word string, n long")
    return words.join(got.groupBy("word").agg(F.sum("n").alias("n_t")), "word")


def wilson(hits: Column, of: Column, z: Column) -> Column:
    """The lower bound of the share hits / of, at z standard errors."""
    p, zz = hits / of, z * z
    return (p + zz / (2 * of) - z * F.sqrt(p * (1 - p) / of + zz / (4 * of * of))) / (1 + zz / of)


def revealing_words(docs: DataFrame, text_col: str = "text", kind: tuple[float, float] = (KIND_ALPHA, KIND_Z), value: tuple[float, float] = (VALUE_ALPHA, VALUE_Z)) -> DataFrame:
    """(word, action): the terms over the disclosure threshold; ``kind`` and
    ``value`` are (alpha, z)."""
    n = float(max(docs.count(), 1))
    broad = F.col("entity").endswith(":")
    alpha, z = (F.when(broad, k).otherwise(v) for k, v in zip(kind, value))
    # As n_e is n_et at least, a pair that fails with n_et in its place fails: most rare ones are not written at all.
    n_e, pairs = co_occurrence(docs, text_col, (1 + 1e-9) * wilson(F.col("n"), F.col("n"), z) >= F.pow(F.col("n") / n, 1 - alpha))
    pairs = pairs.join(n_e, "entity").where(F.col("n_e") < n)
    pairs = pairs.withColumns({"alpha": alpha, "z": z})
    # p(e | t) must reach p(e) ** (1 - alpha). No term can that stands in more documents than with the entity alone.
    pairs = pairs.withColumn("least", F.pow(F.col("n_e") / n, 1 - F.col("alpha")))
    pairs = cut(pairs.where(wilson(F.col("n_et"), F.col("n_et"), F.col("z")) >= F.col("least")))
    told = pairs.join(document_counts(docs, cut(pairs.select("word").distinct()), text_col), "word")
    of = F.greatest("n_t", "n_et")
    told = told.where(wilson(F.col("n_et"), of, F.col("z")) >= F.col("least"))
    return told.groupBy("word").agg(F.when(F.max((F.col("n_et") >= of).cast("int")) == 1, "remove").otherwise("generalise").alias("action"))


SPANS = "array<struct<start:int,end:int,kind:string>>"


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """One row per row of ``docs``: id, text_key, base (array of spans by start
    and kind), added (array of spans, with the action), each span a struct
    start, end, kind in code points, end exclusive."""
    words = cut(revealing_words(docs, text_col, **thresholds))
    sieve = Sieve(words)
    plain = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def find(batches):
        holds = sieve.picker()
        for b in batches:
            base, near = [], []
            for t in b.column(2).to_pylist():
                own = base_spans(t)
                base.append([{"start": a, "end": z, "kind": k} for a, z, k in own])
                found = []
                if not sieve.empty:
                    low = folded(t)
                    if any(map(holds, terms_of(low))):
                        taken = covered(own)
                        found = [{"start": a, "end": z, "kind": w} for a, z, w in terms(low) if holds(w) and not taken(a, z)]
                near.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, plain), pa.array(near, plain)], names=["id", "text_key", "base", "near"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = rows.mapInArrow(find, f"id {docs.schema[id_col].dataType.simpleString()}, text_key long, base {SPANS}, near {SPANS}")
    none = F.expr(f"cast(array() as {SPANS})")
    if sieve.empty:
        return rows.select(F.col("id").alias(id_col), "text_key", "base", none.alias("added"))
    rows = cut(rows)
    hits = rows.where("size(near) > 0").select("id", "text_key", F.explode("near").alias("s"))
    hits = hits.join(small(words), hits["s.kind"] == words["word"]).select("id", "text_key", F.struct(F.col("s.start"), F.col("s.end"), F.col("action").alias("kind")).alias("s"))
    # By id and text: copies of one text are as many keys, and rows that repeat both have one set of spans.
    hits = hits.groupBy(F.col("id").alias("id2"), F.col("text_key").alias("key2")).agg(F.array_sort(F.collect_set("s")).alias("added"))
    out = rows.drop("near").join(hits, (F.col("text_key") == F.col("key2")) & F.col("id").eqNullSafe(F.col("id2")), "left")
    return out.select(F.col("id").alias(id_col), "text_key", "base", F.coalesce("added", none).alias("added"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """``docs`` with the spans replaced in the text: base values by their kind,
    terms that reveal an entity removed or generalised to a placeholder. Spans that
    overlap are replaced together, the first one's placeholder standing for all."""
    plain, name = unnamed(docs)
    own, text = name(id_col), name(text_col)
    found = pii_spans(plain.select(F.col(own).alias("doc_id"), F.col(text).alias("text")), **thresholds).where("size(base) + size(added) > 0")
    found = found.select("doc_id", "text_key", F.array_sort(F.concat("base", "added")).alias("spans")).dropDuplicates(["doc_id", "text_key"])
    rows = plain.withColumn("key", F.xxhash64(text_of(text))).withColumn("t", text_of(text))
    rows = rows.join(found, (F.col("key") == F.col("text_key")) & F.col(own).eqNullSafe(F.col("doc_id")), "left")
    word = "case s.kind when 'remove' then '' when 'generalise' then '[TERM]' else concat('[', upper(s.kind), ']') end"
    step = f"(a, s) -> if(s.start < a.at, struct(a.done as done, greatest(a.at, s.end) as at), struct(concat(a.done, substring(t, a.at + 1, s.start - a.at), {word}) as done, s.end as at))"
    new = F.expr(f"aggregate(spans, struct('' as done, 0 as at), {step}, a -> concat(a.done, substring(t, a.at + 1)))")
    rows = rows.withColumn("cleaned", F.when(F.col("spans").isNull(), F.col(text)).otherwise(new))
    return rows.select(*["cleaned" if c == text else c for c in plain.columns]).toDF(*docs.columns)


def digest(spans: str) -> str:
    """SQL of the joined form kind:start:end of an array of spans."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
