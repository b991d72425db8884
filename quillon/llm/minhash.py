"""Near-duplicates by fast similarity sketches, banding and exact verification.

Sketch: bins are filled in rounds. In round i < BINS every shingle is hashed to
a random bin with the value i plus a fraction; in round BINS + j every shingle
goes to bin j. A bin keeps its smallest value, and rounds stop once all bins of
a set are filled, so every coordinate is filled whatever the set's size, in one
or two rounds for large sets.

Banding: ROWS coordinates make a band; 32 bands of 4 miss a pair at similarity
0.75 with probability 6e-6. Equal sets are collapsed before banding, so copies
are never expanded. Buckets are then settled in two steps. Each member is
compared with the leader of its bucket, and components are formed. Members of
one bucket that are still in different components are dealt into blocks, pairs
of blocks go to tasks, and a task compares the members' sketches; only pairs
whose estimate is within 4.5 standard errors of the threshold, and whose bit
maps allow a large enough intersection, leave it, once, in the first band they
share. Every link is confirmed on the full shingle sets, so no pairs of copies
are formed and no bucket is gathered in one task.

Defined cases: null text counts as empty; a set without words is empty and
links with nothing; fewer words than the width make one shingle; rows that
repeat an id with another text have sets of their own, and ``drop_near_copies``
drops them together; ids are of any type that can be compared; rows without an
id are never linked.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, sieve, sifted, small, text_of, unnamed
from .scan import STEP, mix, parts, shingle_sets, slices

BINS, BANDS, ROWS, WIDTH = 256, 32, 4, 5
#: Bits of the map of a set that bounds intersections from above.
MASK = 2048
BLOCK = 512
BATCH_BYTES = 4 << 20
U = np.uint64
_FULL = U(0xFFFFFFFFFFFFFFFF)
_SEEDS = np.array([xxhash.xxh3_64_intdigest(b"round %d" % i) | 1 for i in range(1024)], np.uint64)


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """(sets, bins) of 64-bit coordinates, all filled; ``bins`` a power of two.
    Empty sets get rows that mean nothing."""
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return flat_sketches(flat, np.array([len(s) for s in sets], np.int64), bins)


def flat_sketches(items: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """Sketches of sets that lie end to end; elements may repeat in a set."""
    shift, low = U(64 - bins.bit_length() + 1), U((1 << 52) - 1)
    got = np.full((len(sizes), bins), _FULL)
    flat = got.reshape(-1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(2 * bins):
        if not len(items):
            break
        x = mix(items * _SEEDS[i] + _SEEDS[-1 - i])
        bin_ = (x >> shift).astype(np.int64) if i < bins else np.full(len(x), i - bins)
        np.minimum.at(flat, owner * bins + bin_, x & low | U(i << 52))
        todo = (got == _FULL).any(axis=1)[owner]
        items, owner = items[todo], owner[todo]
    return got


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) of 64-bit keys of the first coordinates; a key tells its band too."""
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    key = np.broadcast_to(_SEEDS[None, :bands], parts.shape[:2]).copy()
    for r in range(rows):
        key *= STEP
        key += parts[:, :, r]
        mix(key)
    return key.view(np.int64)


SKETCHED = "n long, d1 long, d2 long, bands array<long>, sig binary, mask binary"


def sketch_columns(sets: list[np.ndarray], bins: int, bands: int, rows: int, mask: int = MASK) -> list[pa.Array]:
    """n (shingles), d1 and d2 (digest of the set), bands (keys), sig (the low
    byte of every coordinate), mask (the bit of each element is set)."""
    got = sketches(sets, bins)
    keys = band_keys(got, bands, rows)
    sizes = np.array([len(s) for s in sets])
    # Sums of two mixes of the elements, as differences of running sums; both wrap around.
    flat, ends = np.concatenate(sets) if sets else np.empty(0, np.uint64), np.cumsum(sizes)
    d1, d2 = (np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[np.concatenate([[0], ends])]).view(np.int64) for x in (mix(flat * _SEEDS[0]), mix(flat ^ _SEEDS[1])))
    lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.reshape(-1))
    masks = np.zeros((len(sets), mask), bool)
    masks[np.repeat(np.arange(len(sets)), sizes), (flat & U(mask - 1)).astype(np.int64)] = True
    masks = np.packbits(masks, axis=1)
    return [pa.array(sizes, pa.int64()), pa.array(d1), pa.array(d2), lists, pa.array([x.tobytes() for x in got.astype(np.uint8)], pa.binary()), pa.array([x.tobytes() for x in masks], pa.binary())]


def sketched(items: DataFrame, text_col: str, bins: int = BINS, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """items without the text, with the columns of their sketches."""
    keep = [c for c in items.columns if c != text_col]

    def run(batches):
        for b in batches:
            for part, texts in parts(b, b.num_columns - 1, BATCH_BYTES):
                columns = sketch_columns(shingle_sets(texts, width), bins, bands, rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*keep, "n", "d1", "d2", "bands", "sig", "mask"])

    fields = [f"{c} {items.schema[c].dataType.simpleString()}" for c in keep]
    return items.select(*keep, text_of(text_col).alias(text_col)).mapInArrow(run, ", ".join([*fields, SKETCHED]))


def full_sets(items: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, s): the sorted shingle hashes of each item, as bytes."""

    def run(batches):
        for b in batches:
            for part, texts in parts(b, 1, BATCH_BYTES):
                s = pa.array([x.tobytes() for x in shingle_sets(texts, width)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), s], names=["id", "s"])

    return items.select(id_col, text_of(text_col).alias("t")).mapInArrow(run, "id long, s binary")


def sketched_sets(sets: DataFrame, bins: int, bands: int, rows: int, mask: int, finer: int) -> DataFrame:
    """(id, n, bands, sig, mask, s) of sets(id, s); sig has ``finer`` coordinates."""

    def run(batches):
        for b in batches:
            for a, z in slices(pc.binary_length(b.column(1)).to_pylist(), BATCH_BYTES):
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(1).slice(a, z - a)]
                n, _, _, keys, _, masks = sketch_columns(own, bins, bands, rows, mask)
                sig = pa.array([x.tobytes() for x in sketches(own, finer).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), n, keys, sig, masks, b.column(1).slice(a, z - a)], names=["id", "n", "bands", "sig", "mask", "s"])

    return sets.select("id", "s").mapInArrow(run, "id long, n long, bands array<long>, sig binary, mask binary, s binary")


def confirmed(pairs: DataFrame, sets: DataFrame, least: int = 75) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets meet 100 |A and B| >= least |A or B|."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                keep.append(_meets(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    held = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("t")), "b")
    held = held.join(sets.select(F.col("id").alias("a"), "s"), "a").select("a", "b", "s", "t")
    return held.mapInArrow(run, "a long, b long")


def _likely(rows: dict[str, np.ndarray], least: int, floor: float, most_pairs: int = 1 << 16):
    """Pairs of rows of one block pair (``group``; the rows of one lie together)
    that may be links: of different components, sizes and estimate near enough,
    this block pair's band the first they share. Many small block pairs are
    compared at once."""
    group, sig, c, n, bands, ids = rows["group"], rows["sig"], rows["c"], rows["n"], rows["bands"], rows["id"]
    order = np.lexsort((rows["side"], group))
    group, side = group[order], rows["side"][order]
    # The rows that a row meets: those behind it in its own block, or all of the other block.
    end = np.searchsorted(group, group, side="right")
    other = np.searchsorted(group * 3 + side, group * 3 + 1)
    start = np.where(side < 0, np.arange(len(order)) + 1, np.where(side == 0, other, end))
    ends = np.cumsum(end - start)
    s = 0
    while s < len(order):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most_pairs, side="right")))
        sizes = (end - start)[s:e]
        a = order[np.repeat(np.arange(s, e), sizes)]
        b = order[np.repeat(start[s:e] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        s = e
        ok = (c[a] != c[b]) & (ids[a] != ids[b]) & (100 * np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]))
        a, b = a[ok], b[ok]
        near = [np.count_nonzero(sig[a[i : i + 4096]] == sig[b[i : i + 4096]], axis=1) / sig.shape[1] >= floor for i in range(0, len(a), 4096)]
        near = np.concatenate([np.empty(0, bool), *near])
        a, b = a[near], b[near]
        if not len(a):
            continue
        first = (bands[a] == bands[b]).argmax(1) == rows["band"][a]
        a, b = a[first], b[first]
        # A bit of one set that the other lacks is an element at least that it lacks: no link is lost by this bound.
        p, q = rows["mask"][a], rows["mask"][b]
        most = np.minimum(n[a] - np.bitwise_count(p & ~q).sum(1, dtype=np.int64), n[b] - np.bitwise_count(q & ~p).sum(1, dtype=np.int64))
        may = 100 * most >= least * (n[a] + n[b] - most)
        yield a[may], b[may]


def _enough(pairs, c: np.ndarray, sets: pa.BinaryArray, least: int):
    """Of pairs of rows those that join components ``c`` not joined before, each
    confirmed on the full sets: as many links as it takes, and no more."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for a, b in pairs:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(int(c[i])), find(int(c[j]))
            if x != y and _meets(*(np.frombuffer(sets[k].as_buffer(), np.uint64) for k in (i, j)), least):
                parent[max(x, y)] = min(x, y)
                yield i, j


def _meets(p: np.ndarray, q: np.ndarray, least: int) -> bool:
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= least * (len(p) + len(q) - shared)


def likely_pairs(open_: DataFrame, items: DataFrame, least: int, bins: int, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs worth confirming among ``open_(key, id, c, m)``, the members
    of buckets that hold several components. If ``items`` has the full sets (s),
    they are confirmed on the spot, and of a block pair only those leave that join
    components."""
    whole = "s" in items.columns
    held = ["n", "bands", "sig", "mask", *(["s"] if whole else [])]
    floor = least / 100 - 4.5 * (least / 100 * (1 - least / 100) / bins) ** 0.5
    blocks = F.ceil(F.col("m") / block)
    dealt = open_.withColumn("own", F.pmod(F.xxhash64("id", "key"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "c", side.alias("side"))
    dealt = dealt.join(items.select("id", *held), "id").select("key", "x", "y", "id", "c", "side", *held)
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(t: pa.Table, new: np.ndarray):
        t = t.combine_chunks()
        rows = {c: t[c].to_numpy() for c in ("id", "c", "side", "n")}
        rows["bands"] = t["bands"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        for c in ("sig", "mask"):
            rows[c] = np.frombuffer(b"".join(t[c].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        rows["group"] = np.repeat(np.arange(len(new)), np.diff(np.append(new, t.num_rows)))
        rows["band"] = (rows["bands"] == t["key"].to_numpy()[:, None]).argmax(1)
        found = _likely(rows, least, floor)
        if whole:
            links = list(_enough(found, rows["c"], t["s"].combine_chunks(), least))
            found = [tuple(np.array(links, np.int64).reshape(-1, 2).T)]
        for a, b in found:
            a, b = rows["id"][a], rows["id"][b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=out)

    def run(batches):
        rest = None
        for b in itertools.chain(batches, [None]):
            t = rest if b is None else pa.Table.from_batches([*(rest.to_batches() if rest else []), b])
            if not t:
                continue
            ks = np.stack([t[c].to_numpy() for c in ("key", "x", "y")])
            new = np.concatenate([[0], np.flatnonzero((ks[:, 1:] != ks[:, :-1]).any(0)) + 1])
            last = t.num_rows if b is None else int(new[-1])  # the next batch may go on with its last block pair
            rest = t.slice(last)
            new = new[new < last]
            weights = 1024 + (pc.binary_length(t["s"]).to_numpy() if whole else np.zeros(t.num_rows, np.int64))
            for p, q in slices(np.add.reduceat(weights[:last], new).tolist() if len(new) else [], BATCH_BYTES):
                a, z = int(new[p]), int(new[q]) if q < len(new) else last
                yield from settle(t.slice(a, z - a), new[p:q] - a)

    return dealt.mapInArrow(run, "a long, b long")


def buckets(items: DataFrame) -> DataFrame:
    """(key, id, n, m, lead): the members of buckets that hold several of
    ``items(id, n, bands)``, with the bucket's size and its leader (id, n)."""
    keys = items.select("id", "n", F.explode("bands").alias("key"))
    # Only keys are shuffled to count them; rows of keys that stand once are left out by a sieve before they move.
    twice = cut(keys.groupBy("key").count().where("count > 1").select("key"))
    members = sifted(keys, sieve(twice, "key"), "key").where("_goes_on").select("key", "id", "n")
    members = cut(members.join(small(twice), "key"))
    led = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "n")).alias("lead"))
    return cut(members.join(small(cut(led)), "key"))


def settled(members: DataFrame, pairs: DataFrame, sets: DataFrame, items_of, least: int, bins: int) -> DataFrame:
    """(id, component) of the linked ids. ``members(key, id, m)`` are the
    buckets, ``pairs(a, b)`` their leaders with members, ``sets(id, s)`` the
    full sets; ``items_of(ids)`` gives (id, n, bands, sig, mask), and s where sets
    are small enough to travel."""
    links = cut(confirmed(pairs, sets, least))
    comps = cut(components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    open_ = members.select("key", "id", "m").join(small(comps), "id", "left").withColumn("c", F.coalesce("component", "id"))
    mixed = open_.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    open_ = cut(open_.select("key", "id", "m", "c").join(small(cut(mixed)), "key"))
    items = items_of(open_.select("id").distinct())
    more = cut(likely_pairs(open_, items, least, bins))
    more = more if "s" in items.columns else confirmed(more, sets, least)
    links = cut(links.unionByName(more))
    return cut(components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 75, bins: int = BINS, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest
    id that links lead to), kept (whether that is the row's own)."""
    items = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = items.withColumn("row", F.xxhash64("id", text_of("text")))
    told = sketched(items, "text", bins, bands, rows, width)
    linkable = (F.col("n") > 0) & F.col("id").isNotNull()
    told = cut(told.withColumn("node", F.when(linkable, F.xxhash64("d1", "d2"))).drop("d1", "d2"))
    one = [F.first(c).alias(c) for c in ("n", "bands", "sig", "mask")]
    classes = told.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "row")).alias("rep"), F.count(F.lit(1)).alias("c"), *one)
    classes = cut(classes.withColumnRenamed("node", "id"))

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = cut(classes.join(ids, "id").select(F.col("id").alias("node"), F.col("rep.row").alias("row")))
        some = sifted(items, sieve(asked, "row"), "row").where("_goes_on").drop("_goes_on").join(asked, "row")
        return full_sets(some, "node", "text", width).dropDuplicates(["id"])

    members = buckets(classes.select("id", "n", "bands"))
    sets = cut(sets_of(members.select("id").distinct()))
    near = F.expr(f"100 * least(n, lead.n) >= {least} * greatest(n, lead.n)")
    pairs = members.where("id <> lead.id").where(near).select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()
    items_of = lambda ids: classes.select("id", "n", "bands", "sig", "mask").join(ids, "id", "left_semi")
    comps = settled(members, pairs, sets, items_of, least, bins)
    named = classes.select("id", "c", "rep").join(comps, "id", "left").where("c > 1 or component is not null")
    named = cut(named.select("id", F.coalesce("component", "id").alias("component"), F.col("rep.id").alias("own")))
    least_id = named.groupBy("component").agg(F.min("own").alias("component_id"))
    named = small(cut(named.join(least_id, "component").select(F.col("id").alias("node"), "component_id")))
    # Rows that link with nothing get a key of their own, so that no task gathers them.
    out = told.select("id", "n", F.coalesce("node", F.xxhash64("id", "row")).alias("node"), F.col("node").isNotNull().alias("sound")).join(named, "node", "left")
    out = out.withColumn("component_id", F.coalesce(F.when(F.col("sound"), F.col("component_id")), "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group, columns as they were, whatever
    their names; rows without an id stay."""
    plain, name = unnamed(docs)
    told = near_groups(plain.select(F.col(name(id_col)).alias("doc_id"), F.col(name(text_col)).alias("text")), **how)
    gone = small(cut(told.where("not kept and doc_id is not null").select("doc_id").distinct()))
    return plain.join(gone, plain[name(id_col)] == gone["doc_id"], "left_anti").toDF(*docs.columns)
