"""Repeated paragraphs by MinHash banding, exact Jaccard and components.

One pass over the texts makes a table of numbers: of every paragraph (a line of
at least MIN_WORDS words) its place, a digest of its words and its band keys; of
every document the windows described below. All later steps read that table;
texts are read again only where words are compared.

Paragraphs are sketched and banded (12 bands of 2 coordinates: a pair at
similarity 0.75 is missed with probability 5e-5), colliding ones are verified by
the exact Jaccard similarity of their 5-word shingles, and the links make
components. Equal paragraphs are one item, and buckets are settled with
leaders, as for documents.

A passage can also stand inside longer, otherwise different paragraphs. For
these, the words of every whole document, whatever its lines, give windows of
WINDOW words from their anchors; an anchor is the smallest word-triple hash
among SPAN neighbouring ones, so documents that share WINDOW + SPAN + 1 (50)
words in a row share an anchor and its window wherever these words stand.
Windows that lie inside a removed paragraph are left out. Of each window digest
the first place that no removed paragraph touches stays and every other place is
removed, so no words go of which no equal ones stay. Removed windows that
overlap make one passage. Both its ends are extended to the longest stretch
equal to the place that stays, word by word; the windows at the ends are
compared word by word too. Equal paragraphs and the windows between are told by
64-bit digests.

Of each group of paragraphs the first place by (doc_id, start) stays, the others
are removals. A component is what hangs together by shared windows: paragraphs
and passages, where several places can stay, each for other words. Only what lies
inside a removed paragraph is not told again. Only text that repeats is
returned: documents that repeat nothing do not appear.

Defined cases: null and empty texts have no paragraphs; text that repeats inside
its own document counts; lines of fewer words than MIN_WORDS are headings or
markers, not paragraphs, though windows run over them; rows without an id, or
that repeat an id with another text, are places like any other; rows equal in id
and text are one; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import minhash as mh
from . import scan
from .common import Bits, components, cut, discard, sieve, sifted, small, text_of, unnamed, written

MIN_WORDS = 20
WINDOW, SPAN = 28, 21
BINS, BANDS, ROWS, MASK, FINER = 32, 12, 2, 1024, 256
#: Parts that hashes are dealt into, as leading bits.
PART_BITS = 12
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: The columns of the table of numbers, each a blob of one kind, and its part.
NUMBERS = {"l_start": "<i4", "l_end": "<i4", "l_node": "<i8", "l_keys": "<i8", "w_start": "<i4", "w_stop": "<i4", "w_rest": "<i4", "w_end": "<i4", "w_digest": "<i8"}


def _smallest(x: np.ndarray, span: int, most: bool = False) -> np.ndarray:
    """The smallest (or largest) of every ``span`` neighbours."""
    pick, size = np.maximum if most else np.minimum, 1
    while 2 * size <= span:
        x, size = pick(x[:-size], x[size:]), 2 * size
    return pick(x[: len(x) - (span - size)], x[span - size :]) if size < span else x


def anchored(h: np.ndarray, bounds: np.ndarray, window: int = WINDOW, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """First word and digest of the windows of texts that lie end to end; text i
    has the words from bounds[i] to bounds[i + 1]."""
    if len(h) < span + 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    end = np.repeat(bounds[1:], np.diff(bounds))
    x = scan.rolled(h, 3) | scan.U(1)
    low = _smallest(x, span)
    j = np.arange(len(low))
    low[j + span + 1 >= end[: len(low)]] = 0  # the stretch runs into the next text
    edge = np.zeros(span - 1, scan.U)
    at = np.flatnonzero(_smallest(np.concatenate([edge, low, edge]), span, most=True) == x)
    at = at[at + window <= end[at]]
    digest = np.full(len(at), scan.U(window))
    for i in range(window):
        digest *= scan.STEP
        digest += h[at + i]
    return at, scan.mix(digest).view(np.int64)


def numbers(texts: list[bytes], least: int = MIN_WORDS, window: int = WINDOW, span: int = SPAN) -> dict[str, pa.Array]:
    """The table's columns for some texts."""
    raw, at = scan.joined(texts)
    h, starts, ends = scan.words(raw)
    bounds = np.searchsorted(starts, at)
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    first = np.concatenate([[0], np.searchsorted(starts, breaks)])
    held = np.flatnonzero(np.diff(first) >= least)
    sizes, first = np.diff(first)[held], first[:-1][held]
    start, end = np.concatenate([[0], breaks + 1])[held], breaks[held]
    doc = np.searchsorted(at, start, side="right") - 1
    of_word = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # its place in the line
    own = scan.mix(h[np.repeat(first, sizes) + of_word] + (of_word + 1).astype(scan.U) * scan.STEP)
    node = np.add.reduceat(own, np.cumsum(sizes) - sizes) if len(own) else np.empty(0, scan.U)
    node = scan.mix(node + sizes.astype(scan.U)).view(np.int64)
    runs = sizes - mh.WIDTH + 1
    of_run = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    items = scan.rolled(h, mh.WIDTH)[np.repeat(first, runs) + of_run]
    keys = mh.band_keys(mh.flat_sketches(items, runs, BINS), BANDS, ROWS)
    anchors, digest = anchored(h, bounds, window, span)
    first, last, rest = _runs(anchors, digest, np.searchsorted(bounds, anchors, side="right"), window)
    own, anchors = anchors[last], anchors[first]
    w_doc = np.searchsorted(bounds, anchors, side="right") - 1
    per_line, per_window = np.bincount(doc, minlength=len(texts)), np.bincount(w_doc, minlength=len(texts))
    off = at[w_doc]
    values = {"l_start": start - at[doc], "l_end": end - at[doc], "l_node": node, "l_keys": keys.reshape(-1)}
    values |= {"w_start": starts[anchors] - off, "w_stop": ends[anchors + window - 1] - off, "w_rest": np.where(rest < 0, -1, starts[rest] - off), "w_end": ends[own + window - 1] - off, "w_digest": digest[first]}
    counts = {"l_keys": per_line * BANDS}
    return {c: scan.blobs(v.astype(NUMBERS[c]), counts.get(c, per_line if c[0] == "l" else per_window)) for c, v in values.items()}


def _runs(at: np.ndarray, digest: np.ndarray, doc: np.ndarray, window: int):
    """Of windows in order: first and last of each run of equal overlapping ones
    (text with a short period), and the first word of the first window of a run
    that begins where its first window has ended, or -1."""
    if not len(at):
        return at, at, at
    new = np.flatnonzero(np.concatenate([[True], (digest[1:] != digest[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + window)]))
    begin = np.repeat(at[new], np.diff(np.append(new, len(at))))
    none = np.int64(1) << 60
    rest = np.minimum.reduceat(np.where(at >= begin + window, at, none), new)
    return new, np.append(new[1:], len(at)) - 1, np.where(rest == none, -1, rest)


def _table(docs: DataFrame, least: int, window: int, span: int) -> DataFrame:
    """docs(id, text, doc) -> doc, id and NUMBERS."""
    if least < mh.WIDTH:
        raise ValueError(f"a paragraph has at least {mh.WIDTH} words, one shingle")

    def run(batches):
        for b in batches:
            for part, texts in scan.parts(b, 1, mh.BATCH_BYTES):
                got = numbers(texts, least, window, span)
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), *(got[c] for c in NUMBERS)], names=["doc", "id", *NUMBERS])

    kinds = ", ".join(f"{c} binary" for c in NUMBERS)
    return docs.mapInArrow(run, f"doc long, id {docs.schema['id'].dataType.simpleString()}, {kinds}")


def _repeated(table: DataFrame, column: str, again: str | None = None) -> DataFrame:
    """(value): the values of a column that stand more than once; a value whose
    number in the column ``again`` is not negative stands twice.

    The values are hashes: their leading bits deal them into parts of like size.
    A batch sends a part's values as one blob, each of them twice at most."""

    def deal(batches):
        for b in batches:
            v = scan.unblobbed(b.column(0), np.int64)[0]
            if again:
                v = np.concatenate([v, v[scan.unblobbed(b.column(1), np.int32)[0] >= 0]])
            v = np.sort(v)
            v = v[np.concatenate([np.ones(min(2, len(v)), bool), v[2:] != v[:-2]])]
            part, counts = np.unique(v >> (64 - PART_BITS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(part), scan.blobs(v, counts)], names=["part", "held"])

    def count(batches):
        rest, at = [], None
        for b in itertools.chain(batches, [None]):
            done = rest
            if b is not None:
                if not b.num_rows:
                    continue
                part, held = b.column(0).to_numpy(), b.column(1).to_pylist()
                last = int(np.searchsorted(part, part[-1]))  # the next batch may go on with this part
                if last == 0 and part[-1] == at:
                    rest += held
                    continue
                done, rest, at = rest + held[:last], held[last:], part[-1]
            v = np.sort(np.frombuffer(b"".join(done), np.int64))
            v = v[1:][v[1:] == v[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(v[np.concatenate([np.ones(min(1, len(v)), bool), v[1:] != v[:-1]])])], names=["value"])

    dealt = table.select(column, *([again] if again else [])).mapInArrow(deal, "part long, held binary")
    return cut(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(count, "value long"))


def _members(table: DataFrame, keys: Bits) -> DataFrame:
    """(key, id) of the paragraphs' band keys that a bit lets through."""

    def run(batches):
        for b in batches:
            node, at = np.unique(scan.unblobbed(b.column(0), np.int64)[0], return_index=True)
            own = scan.unblobbed(b.column(1), np.int64)[0].reshape(-1, BANDS)[at]
            hit = keys.hold(own)
            yield pa.RecordBatch.from_arrays([pa.array(own[hit]), pa.array(np.repeat(node, hit.sum(1)))], names=["key", "id"])

    return table.select("l_node", "l_keys").mapInArrow(run, "key long, id long")


def _line_places(table: DataFrame, nodes: Bits) -> DataFrame:
    """doc, id, start, end, node of the paragraphs that a bit lets through."""

    def run(batches):
        for b in batches:
            node, counts = scan.unblobbed(b.column(4), np.int64)
            hit = np.flatnonzero(nodes.hold(node))
            row = np.repeat(np.arange(b.num_rows), counts)[hit]
            start, end = (scan.unblobbed(b.column(i), np.int32)[0][hit] for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(start), pa.array(end), pa.array(node[hit])], names=["doc", "id", "start", "end", "node"])

    got = table.select("doc", "id", "l_start", "l_end", "l_node").mapInArrow(run, f"doc long, id {table.schema['id'].dataType.simpleString()}, start int, end int, node long")
    return got


def _repeated_lines(docs: DataFrame, table: DataFrame, least: int) -> DataFrame:
    """doc, id, start, end, node: the paragraphs that repeat and their component."""
    members = cut(_members(table, Bits(_repeated(table, "l_keys"))).distinct())
    led = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("lead")).where("m > 1")
    members = cut(members.join(small(cut(led)), "key"))
    asked = cut(members.select("id").distinct())
    places = _line_places(table, Bits(asked)).join(small(asked.withColumnRenamed("id", "node")), "node")
    places = cut(places.groupBy("node").agg(F.min(F.struct("doc", "start", "end")).alias("at")).select("node", F.col("at.doc").alias("doc"), F.col("at.start").alias("a"), F.col("at.end").alias("z")))
    some = sifted(docs, sieve(places, "doc"), "doc").where("_goes_on").drop("_goes_on")
    line = F.expr("substring(cast(text as binary), a + 1, z - a)").cast("string")
    own = some.join(small(places), "doc").select(F.col("node").alias("id"), line.alias("text"))
    sets = cut(mh.full_sets(own, "id", "text").dropDuplicates(["id"]))
    # Each paragraph is compared with the leader that it meets most often; the next step takes up whatever is still open in a bucket.
    met = members.where("id <> lead").groupBy("id", "lead").count()
    pairs = met.groupBy(F.col("id").alias("b")).agg(F.min(F.struct((-F.col("count")).alias("k"), "lead"))["lead"].alias("a")).select("a", "b")
    items_of = lambda ids: mh.sketched_sets(sets.join(ids, "id", "left_semi"), BINS, BANDS, ROWS, MASK, FINER)
    comps = mh.settled(members, pairs, sets, items_of, least, FINER)
    equal = _repeated(table, "l_node").withColumnRenamed("value", "id")
    named = cut(equal.join(comps, "id", "full").select("id", F.coalesce("component", "id").alias("component")))
    named = named.withColumnRenamed("id", "node")
    found = _line_places(table, Bits(named.select("node"))).join(small(named), "node").dropDuplicates(["doc", "start"])
    return cut(found.select("doc", "id", "start", "end", F.col("component").alias("node")))


def _around(doc: np.ndarray, start: np.ndarray, end: np.ndarray, s_doc: np.ndarray, s_start: np.ndarray, s_end: np.ndarray):
    """inside, free, low, high of places against spans (disjoint, in order):
    whether a place lies inside a span, whether it overlaps none, and the ends of
    the text around it that is not in a span."""
    top = np.int64(2**31 - 1)
    base = doc.astype(np.int64) << 32
    own, to = base + start, base + end
    begins, stops = (np.concatenate([[-1], (s_doc.astype(np.int64) << 32) + x, [np.int64(2**62)]]) for x in (s_start, s_end))
    at = np.searchsorted(begins, own, side="right") - 1  # the last span that begins before or where the place does
    inside = (begins[at] >= base) & (stops[at] >= to)
    free = ~((begins[at] >= base) & (stops[at] > own)) & ~(begins[at + 1] < to)
    before = np.where(stops[at] <= own, stops[at], stops[np.maximum(at - 1, 0)])
    after = begins[np.searchsorted(begins, to, side="left")]
    return inside, free, np.maximum(before - base, 0), np.minimum(after - base, top)


_WINDOW = ("w_start", "w_stop", "w_rest", "w_end")


def _outside(table: DataFrame, removed: DataFrame) -> DataFrame:
    """doc, id, the windows that don't lie inside a removed paragraph, and these
    paragraphs (s_start, s_end), document by document."""
    spans = removed.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))  # the lines of one text
    spans = cut(spans.select("doc", F.col("spans.start").alias("s_start"), F.col("spans.end").alias("s_end")))
    held = table.select("doc", "id", "w_digest", *_WINDOW).join(small(spans), "doc", "left")
    names = ["doc", "id", "w_digest", *_WINDOW, "s_start", "s_end"]

    def run(batches):
        for b in batches:
            digest, counts = scan.unblobbed(b.column(2), np.int64)
            places = [scan.unblobbed(b.column(i), np.int32)[0] for i in range(3, 7)]
            s_counts = pc.fill_null(pc.list_value_length(b.column(7)), 0).to_numpy(zero_copy_only=False)
            s_start, s_end = (pc.list_flatten(b.column(i)).to_numpy(zero_copy_only=False).astype(np.int32) for i in (7, 8))
            rows = np.arange(b.num_rows)
            doc = np.repeat(rows, counts)
            out = ~_around(doc, places[0], places[3], np.repeat(rows, s_counts), s_start, s_end)[0]
            kept = np.bincount(doc[out], minlength=b.num_rows)
            blobs = [scan.blobs(x[out], kept) for x in (digest, *places)] + [scan.blobs(x, s_counts) for x in (s_start, s_end)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *blobs], names=names)

    kinds = ", ".join(f"{c} binary" for c in names[2:])
    return held.mapInArrow(run, f"doc long, id {table.schema['id'].dataType.simpleString()}, {kinds}")


def _window_places(held: DataFrame, digests: Bits) -> DataFrame:
    """doc, id, start, stop, rest, end, digest, free, low, high of the windows
    that a bit lets through: start and end of a run, where its first window stops
    and where the first one after that begins (or -1)."""
    names = ["doc", "id", "start", "stop", "rest", "end", "digest", "free", "low", "high"]

    def run(batches):
        for b in batches:
            digest, counts = scan.unblobbed(b.column(2), np.int64)
            hit = np.flatnonzero(digests.hold(digest))
            places = [scan.unblobbed(b.column(i), np.int32)[0][hit] for i in range(3, 7)]
            s_start, s_counts = scan.unblobbed(b.column(7), np.int32)
            rows = np.arange(b.num_rows)
            doc = np.repeat(rows, counts)[hit]
            _, free, low, high = _around(doc, places[0], places[3], np.repeat(rows, s_counts), s_start, scan.unblobbed(b.column(8), np.int32)[0])
            at = pa.array(doc)
            columns = [b.column(0).take(at), b.column(1).take(at), *map(pa.array, places), pa.array(digest[hit]), pa.array(free), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = held.schema["id"].dataType.simpleString()
    return held.mapInArrow(run, f"doc long, id {id_type}, start int, stop int, rest int, end int, digest long, free boolean, low int, high int")


def _islands(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans (doc, start, end) with island, the number of their run of overlapping ones."""
    order = W.partitionBy("doc", *keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    return marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def _merged(spans: DataFrame) -> DataFrame:
    """doc, id, start, end, digest, stays: overlapping spans of one kind as one."""
    held = _islands(spans, "stays").groupBy("doc", "stays", "island")
    return held.agg(F.min("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("digest").alias("digest")).drop("island")


def _contexts(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """asked(doc, left, at, bound) -> doc, left, at, bound, around: up to ``words``
    words of the text before (left) or after ``at``, not beyond ``bound``."""
    asked = cut(asked.distinct().groupBy("doc").agg(F.collect_list(F.struct("left", "at", "bound")).alias("asks")))
    some = sifted(docs.select("doc", "text"), sieve(asked, "doc"), "doc").where("_goes_on").select("doc", "text").dropDuplicates(["doc"])
    out = pa.schema([("doc", pa.int64()), ("left", pa.bool_()), ("at", pa.int32()), ("bound", pa.int32()), ("around", pa.binary())])

    def slice_of(raw: bytes, left: bool, at: int, bound: int) -> bytes:
        size = 1024
        while True:
            a, z = (max(bound, at - size), at) if left else (at, min(bound, at + size, len(raw)))
            got = raw[a:z]
            if (a == bound if left else z == min(bound, len(raw))) or len(got.split(None, words)) > words:
                return got
            size *= 2

    def run(batches):
        for b in batches:
            for part, texts in scan.parts(b, 1, mh.BATCH_BYTES):
                rows = [(d, q["left"], q["at"], q["bound"], slice_of(t, q["left"], q["at"], q["bound"])) for d, t, asks in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist()) for q in asks]
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, r)) for r in rows], schema=out)

    return some.join(asked, "doc").mapInArrow(run, "doc long, left boolean, at int, bound int, around binary")


_PREFIX = [re.compile(rb"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]+" % max(0, n - 1)) for n in range(256)]


def _reach(own: bytes, other: bytes, left: bool, words: int) -> tuple[int, int, int]:
    """How many words, at most ``words`` (under 256), two texts share from the
    end (left) or the beginning on, and their bytes in both."""
    if left:
        own, other = own[::-1], other[::-1]
    a, b = (x.translate(scan.LOWER).split(None, words)[:words] for x in (own, other))
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return (n, _PREFIX[n].match(own).end(), _PREFIX[n].match(other).end()) if n else (0, 0, 0)


def _extended(docs: DataFrame, removed: DataFrame, window: int, span: int) -> DataFrame:
    """doc, id, start, end, digest, stays: for both ends of every removed island
    the longest stretch equal to the place that stays, and that place's own.
    The words are compared themselves, those of the window included."""
    words = window + span + 3
    held = _islands(removed).groupBy("doc", "island")
    rest = ("low", "high", "digest", "rep")
    first, last = F.min(F.struct("start", "id", "stop", *rest)), F.max(F.struct("end", "id", "start", *rest))
    ends = held.agg(first.alias("f"), last.alias("l"))
    side = lambda e, left, at, bound: F.struct(
        F.lit(left).alias("left"), F.col(f"{e}.id").alias("id"), F.col(f"{e}.digest").alias("digest"), F.col(f"{e}.{at}").alias("at"), F.col(f"{e}.rep.{at}").alias("rat"),
        # Within one document neither stretch runs into the other's window.
        (F.greatest(f"{e}.low", F.when(F.col(f"{e}.rep.doc") == F.col("doc"), F.col(f"{e}.rep.stop")).otherwise(0)) if left else F.col(f"{e}.high")).alias("bound"),
        (F.col(f"{e}.rep.low") if left else F.least(f"{e}.rep.high", F.when(F.col(f"{e}.rep.doc") == F.col("doc"), F.col(f"{e}.start")).otherwise(2**31 - 1))).alias("rbound"),
        F.col(f"{e}.rep.doc").alias("rdoc"), F.col(f"{e}.rep.id").alias("rid"))
    asks = cut(ends.select("doc", F.explode(F.array(side("f", True, "stop", "low"), side("l", False, "start", "high"))).alias("s")).select("doc", "s.*"))
    got = written(_contexts(docs, asks.select("doc", "left", "at", "bound").unionByName(asks.select(F.col("rdoc").alias("doc"), "left", F.col("rat").alias("at"), F.col("rbound").alias("bound"))), words), "contexts")
    rgot = got.select(F.col("doc").alias("rdoc"), "left", F.col("at").alias("rat"), F.col("bound").alias("rbound"), F.col("around").alias("raround"))
    both = asks.join(got, ["doc", "left", "at", "bound"]).join(rgot, ["rdoc", "left", "rat", "rbound"])
    columns = ["doc", "id", "at", "rdoc", "rid", "rat", "left", "digest", "around", "raround"]
    names = ["doc", "id", "start", "end", "digest", "stays"]

    def run(batches):
        for b in batches:
            rows = []
            for doc, i, at, rdoc, ri, rat, left, digest, own, other in zip(*(c.to_pylist() for c in b.columns)):
                n, k, rk = _reach(own, other, left, words)
                if n >= window:
                    rows += [(doc, i, at - k, at, digest, False), (rdoc, ri, rat - rk, rat, digest, True)] if left else [(doc, i, at, at + k, digest, False), (rdoc, ri, rat, rat + rk, digest, True)]
            kinds = [pa.int64(), b.schema.field("id").type, pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=names)

    id_type = removed.schema["id"].dataType.simpleString()
    out = cut(both.select(columns).mapInArrow(run, f"doc long, id {id_type}, start int, end int, digest long, stays boolean"))
    discard(got)
    return out


def _passages(docs: DataFrame, table: DataFrame, whole: DataFrame, removed_lines: DataFrame, window: int, span: int) -> tuple[DataFrame, DataFrame]:
    """doc, id, start, end, node, kept of passages; and (id, component) of the
    window digests and lines that belong together."""
    held = written(_outside(table, removed_lines), "windows")
    discard(table)
    repeated = _repeated(held, "w_digest", "w_rest").withColumnRenamed("value", "digest")
    places = _window_places(held, Bits(repeated)).join(small(repeated), "digest")
    places = cut(places.dropDuplicates(["doc", "start"]))
    discard(held)
    # Of each digest the first place that no removed line touches stays.
    stay = F.min(F.when(F.col("free"), F.struct("id", "start", "doc", "stop", "low", "high")))
    several = F.count(F.lit(1)) + F.count(F.when(F.col("rest") >= 0, 1))
    reps = cut(places.groupBy("digest").agg(stay.alias("rep"), several.alias("m")).where("m > 1 and rep is not null").drop("m"))
    # Of the run that begins with the place that stays, what follows that place goes.
    own = (F.col("doc") == F.col("rep.doc")) & (F.col("start") == F.col("rep.start"))
    away = F.when(own, F.col("rest") >= 0).otherwise((F.col("doc") != F.col("rep.doc")) | (F.col("start") >= F.col("rep.stop")))
    removed = places.join(small(reps), "digest").where(away).drop("free")
    removed = cut(removed.withColumns({"start": F.when(own, F.col("rest")).otherwise(F.col("start")), "stop": F.when(own, F.col("end")).otherwise(F.col("stop"))}).drop("rest"))
    stays = removed.select(F.col("rep.doc").alias("doc"), F.col("rep.id").alias("id"), F.col("rep.start").alias("start"), F.col("rep.stop").alias("end"), "digest").distinct()
    spans = removed.select("doc", "id", "start", "end", "digest", F.lit(False).alias("stays")).unionByName(stays.withColumn("stays", F.lit(True)))
    spans = cut(spans)
    marked = _islands(spans.select("doc", "start", "end", "digest"))
    near = marked.select(F.min("digest").over(W.partitionBy("doc", "island")).alias("src"), F.col("digest").alias("dst"))
    kept = whole.join(removed_lines.select("doc", "start"), ["doc", "start"], "left_anti").select("doc", F.col("start").alias("a"), F.col("end").alias("z"), "node")
    lines_of = spans.join(kept, "doc").where("start >= a and end <= z").select(F.col("node").alias("src"), F.col("digest").alias("dst"))
    comps = cut(components(near.where("src <> dst").unionByName(lines_of).distinct()))
    found = _merged(spans.unionByName(_extended(docs, removed, window, span)))
    found = found.join(small(comps), found["digest"] == comps["id"], "left").select(found["doc"], found["id"], "start", "end", F.coalesce("component", "digest").alias("node"), F.col("stays").alias("kept"))
    return found, comps


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, window: int = WINDOW, span: int = SPAN, least: int = 75) -> DataFrame:
    """One row per repeated paragraph or passage: id, start, end (bytes of the
    UTF-8 text, end exclusive), is_passage, component_id and component_start
    (the component's first place), group_size (places), kept."""
    return _repeats(docs, id_col, text_col, min_words, window, span, least).drop("doc")


def _repeats(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, window: int = WINDOW, span: int = SPAN, least: int = 75) -> DataFrame:
    """The rows of ``repeated_paragraphs`` with doc, the hash that tells rows of
    one id and different texts apart."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("doc", F.xxhash64("id", "text"))
    table = written(_table(rows, min_words, window, span), "numbers")
    whole = _repeated_lines(rows, table, least)
    ahead = small(cut(whole.groupBy("node").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("start") == F.col("first.start"))
    whole = cut(whole.join(ahead, "node").withColumn("kept", stays).drop("first"))
    parts, comps = _passages(rows, table, whole.drop("kept"), whole.where("not kept").select("doc", "start", "end"), window, span)
    named = whole.join(small(comps), whole["node"] == comps["id"], "left").select("doc", whole["id"], "start", "end", F.coalesce("component", "node").alias("node"), "kept")
    found = cut(named.withColumn("passage", F.lit(False)).unionByName(parts.withColumn("passage", F.lit(True))))
    groups = found.groupBy("node").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    out = found.join(small(cut(groups)), "node")
    return out.select("doc", F.col("id").alias(id_col), "start", "end", F.col("passage").alias("is_passage"), F.col("first.id").alias("component_id"), F.col("first.start").alias("component_start"), "group_size", "kept")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the removals cut out of the text; other columns as they
    were, whatever their names. Removals belong to an id together with its text:
    rows of one id, or without an id, lose their own repeats only."""
    plain, name = unnamed(docs)
    told = _repeats(plain, name(id_col), name(text_col), **how)
    spans = told.where("not kept").groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    held = plain.withColumn("own", F.xxhash64(F.col(name(id_col)), text_of(name(text_col))))
    held = held.join(spans, held["own"] == spans["doc"], "left")
    raw = held.withColumn("raw", F.col(name(text_col)).cast("binary"))
    cut_out = "aggregate(spans, struct(cast('' as binary) as done, 0 as at), (a, s) -> struct(if(s.start > a.at, concat(a.done, substring(raw, a.at + 1, s.start - a.at)), a.done) as done, greatest(a.at, s.end) as at), a -> concat(a.done, substring(raw, a.at + 1)))"
    text = F.when(F.col("spans").isNull(), F.col(name(text_col))).otherwise(F.expr(cut_out).cast("string"))
    return raw.withColumn("cleaned", text).select(*["cleaned" if c == name(text_col) else c for c in plain.columns]).toDF(*docs.columns)
