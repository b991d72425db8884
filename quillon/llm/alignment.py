"""Tokens of two vocabularies aligned through bitsets of their ends.

Texts, with a space in front, are encoded by a byte-level BPE (A) and by a piece
model (B). Bytes where a token of each ends are shared cuts; between neighbouring
cuts lies a group, whose tokens of A and B are linked, each with each.

1. Each different segment of a text (``tokens.py``) is aligned once. The ends of
   the tokens are bits over the bytes of many segments; AND yields the shared
   cuts, and popcounts over words of 64 bits rank every cut among the tokens of
   either side, which tells the range of tokens of each group. Groups are expanded
   to links, wide ones as products of their different ids.
2. A document adds up its segments. Its different pairs of ids, with how often each
   is linked, are written beside it as sorted differences.
3. Documents are counted by pair: unions within a task first, then sums by pair;
   the highest count of each A id is found by sums of the same table.
4. Documents meet the counts again. Pairs that more than one row in HEAVY of all
   (document, pair) rows names are at most HEAVY whatever the corpus; these are
   broadcast. Rows of the other pairs, none of which is hot, are joined by pair.

Defined cases: texts that are null or empty, and texts whose tokens of A or B,
joined as bytes, differ from the space and the text, have no tokens (zeros, and
the empty string for groups_sha256); repeated rows count as documents of their own;
ids of any type, null too; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, written
from .scan import blobs, parts, unblobbed
from .tokens import ByteLevel, Lists, PieceModel, Store, segments

#: Pairs that are broadcast at most, and the numerator of the share of rows that makes a pair one of them.
HEAVY = 1 << 22
SLICE_BYTES = 1 << 20
KEPT_SEGMENTS, KEPT_PAIRS = 150_000, 2_000_000
#: Links expanded at once; a group of more is a product of its different ids.
WIDE = 1 << 20


def vocabularies() -> tuple[str, str]:
    """Where the public vocabularies lie; a default, the operators take any paths."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Bitset:
    """Bits over bytes 0 to n in words of 64, with ranks by popcount."""

    def __init__(self, places: np.ndarray, n: int):
        marks = np.zeros((n // 64 + 1) * 64, np.uint8)
        marks[places] = 1
        self.words = np.packbits(marks, bitorder="little").view("<u8")

    def __and__(self, other: "Bitset") -> np.ndarray:
        """The places set in both."""
        both = self.words & other.words
        return np.flatnonzero(np.unpackbits(both.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set up to and at each place."""
        before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=before[1:])
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return before[word] + np.bitwise_count(self.words[word] & upto)


def grouped(ends_a: np.ndarray, ends_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shared cuts of two tokenisations of n bytes, and how many tokens of A
    and of B end up to each."""
    a, b = Bitset(ends_a, n), Bitset(ends_b, n)
    cuts = a & b
    return cuts, a.rank(cuts), b.rank(cuts)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _reduced(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(times, first)


class Aligner:
    """What each different segment gives: numbers of tokens, groups and links,
    its groups written out, and its pairs with how often each is linked."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), PieceModel(path_b)
        if self.a.size * self.b.size >= 1 << 32:
            raise ValueError("a pair of ids must fit 32 bits")
        self.size_a, self.size_b = (np.array([len(x) for x in v.bytes], np.int64) for v in (self.a, self.b))
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(v.bytes), np.uint8) for v in (self.a, self.b))
        self.at_a, self.at_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        self.names = [np.array([b"%d%s" % (i, end) for i in range(max(self.a.size, self.b.size))], object) for end in (b",", b"|", b";")]
        self.clear()

    def clear(self) -> None:
        self.store = Store(self._learn)
        self.numbers = np.empty((0, 5), np.int64)  # tokens of A, of B, groups, links, whether bytes come back
        self.keys, self.times, self.groups = Lists(np.uint32), Lists(np.int64), []

    @property
    def full(self) -> bool:
        return len(self.groups) > KEPT_SEGMENTS or len(self.keys.values) > KEPT_PAIRS

    def _learn(self, found: list[bytes]) -> None:
        (a, na), (b, nb) = self.a.encoded(found), self.b.encoded(found)
        raw, bounds = np.frombuffer(b"".join(found), np.uint8), np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(x) for x in found], out=bounds[1:])
        good = self._come_back(raw, bounds, a, na, self.flat_a, self.at_a, self.size_a) & self._come_back(raw, bounds, b, nb, self.flat_b, self.at_b, self.size_b)
        if not good.all():  # segments whose bytes don't come back take part in nothing
            keep = np.flatnonzero(good)
            a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
            raw = raw[_ranges(bounds[keep], np.diff(bounds)[keep])]
            na, nb = np.where(good, na, 0), np.where(good, nb, 0)
            bounds = np.concatenate([[0], np.cumsum(np.where(good, np.diff(bounds), 0))])
        cuts, ra, rb = grouped(np.cumsum(self.size_a[a]) - 1, np.cumsum(self.size_b[b]) - 1, len(raw))
        of_seg = np.searchsorted(cuts, bounds)  # groups up to each segment's start
        ga, gb = np.diff(ra, prepend=0), np.diff(rb, prepend=0)
        links = np.concatenate([[0], np.cumsum(ga * gb)])
        n_groups = np.diff(of_seg)
        self.numbers = np.concatenate([self.numbers, np.stack([na, nb, n_groups, np.diff(links[of_seg]), good], axis=1)])
        self._write(a, b, ra, rb, ga, gb, of_seg)
        self._pair(a, b, ra, rb, ga, gb, np.repeat(np.arange(len(found)), n_groups), len(found))

    def _come_back(self, raw, bounds, ids, sizes, flat, at, width) -> np.ndarray:
        """Of which segments the tokens' bytes are the segment's."""
        ends = np.concatenate([[0], np.cumsum(width[ids])])
        token = np.concatenate([[0], np.cumsum(sizes)])
        good = np.diff(ends[token]) == np.diff(bounds)
        if good.all():
            same = flat[_ranges(at[ids], width[ids])] == raw
            wrong = np.concatenate([[0], np.cumsum(~same)])
            return np.diff(wrong[bounds]) == 0
        for i in np.flatnonzero(good).tolist():
            own = ids[token[i] : token[i + 1]]
            good[i] = np.array_equal(flat[_ranges(at[own], width[own])], raw[bounds[i] : bounds[i + 1]])
        return good

    def _write(self, a, b, ra, rb, ga, gb, of_seg) -> None:
        """Each segment's groups, ``a1,a2|b1;`` with a semicolon behind every group."""
        group_a, group_b = np.repeat(np.arange(len(ga)), ga), np.repeat(np.arange(len(gb)), gb)
        place_a, place_b = np.arange(len(a)) + (rb - gb)[group_a], np.arange(len(b)) + ra[group_b]
        out = np.empty(len(a) + len(b), object)
        comma, bar, semicolon = self.names
        out[place_a], out[place_b] = comma[a], comma[b]
        out[place_a[ra - 1]], out[place_b[rb - 1]] = bar[a[ra - 1]], semicolon[b[rb - 1]]
        upto = np.concatenate([[0], ra + rb])[of_seg].tolist()
        out = out.tolist()
        self.groups += [b"".join(out[p:q]) for p, q in zip(upto, upto[1:])]

    def _pair(self, a, b, ra, rb, ga, gb, seg, n: int) -> None:
        """Pairs of each segment and how often each is linked."""
        a, b, wide = a.astype(np.int64), b.astype(np.int64), ga * gb > WIDE
        keys, times = [], []
        narrow = np.flatnonzero(~wide)
        work = np.concatenate([[0], np.cumsum((ga * gb)[narrow])])
        for lo, hi in self._stretches(work):
            g = narrow[lo:hi]
            m = ga[g] * gb[g]
            within = _ranges(np.zeros(len(g), np.int64), m)
            per = np.repeat(gb[g], m)
            left, right = np.repeat((ra - ga)[g], m) + within // per, np.repeat((rb - gb)[g], m) + within % per
            keys.append(np.repeat(seg[g], m) << 32 | a[left] * self.b.size + b[right])
            times.append(np.ones(len(keys[-1]), np.int64))
        for g in np.flatnonzero(wide).tolist():
            (x, k), (y, m) = (np.unique(v[r[g] - c[g] : r[g]], return_counts=True) for v, r, c in ((a, ra, ga), (b, rb, gb)))
            keys.append(int(seg[g]) << 32 | (x[:, None] * self.b.size + y).ravel())
            times.append((k[:, None] * m).ravel())
        if not keys:
            keys, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        key, time = _reduced(np.concatenate(keys), np.concatenate(times))
        sizes = np.bincount(key >> 32, minlength=n)
        self.keys.add((key & 0xFFFFFFFF).astype(np.uint32), sizes)
        self.times.add(time, sizes)

    @staticmethod
    def _stretches(work: np.ndarray):
        """Stretches of items of about WIDE in work."""
        at = 0
        while at < len(work) - 1:
            end = max(at + 1, int(np.searchsorted(work, work[at] + 4 * WIDE, "right")) - 1)
            yield at, end
            at = end

    def aligned(self, texts: list[bytes]):
        """Of texts with their space in front: numbers (texts, 4), digests, and
        the pairs of all texts end to end with their times and numbers."""
        if self.full:
            self.clear()
        raw, starts, ends, bounds = segments(texts, whole=not self.b.cuts)
        codes = self.store.codes(raw, starts, ends)
        total = np.zeros((len(codes) + 1, 5), np.int64)
        np.cumsum(self.numbers[codes], axis=0, out=total[1:])
        numbers = np.diff(total[bounds], axis=0)
        good = numbers[:, 4] == np.diff(bounds)
        digests, groups, own = [], self.groups, codes.tolist()
        for a, z, ok in zip(bounds.tolist(), bounds[1:].tolist(), good.tolist()):
            told = b"".join([groups[c] for c in own[a:z]]) if ok else b""
            digests.append(hashlib.sha256(told[:-1]).hexdigest() if told else "")
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))[np.repeat(good, np.diff(bounds))]
        met, often = _reduced(doc << 32 | codes[np.repeat(good, np.diff(bounds))], np.ones(len(doc), np.int64))
        code = met & 0xFFFFFFFF
        sizes = self.keys.sizes[code]
        keys = np.repeat(met >> 32, sizes) << 32 | self.keys.of(code).astype(np.int64)
        keys, times = _reduced(keys, np.repeat(often, sizes) * self.times.of(code))
        return numbers[:, :4] * good[:, None], digests, (keys & 0xFFFFFFFF).astype(np.uint32), times, np.bincount(keys >> 32, minlength=len(texts))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(*paths: str) -> Aligner:
    """One a worker process; later tasks find its segments."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def _differences(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sorted keys of each row as first key and steps, which compress well."""
    out = np.diff(keys, prepend=np.uint32(0))
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[first] = keys[first]
    return out


def _restored(column) -> tuple[np.ndarray, np.ndarray]:
    steps, sizes = unblobbed(column, "<u4")
    total = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
    before = total[np.cumsum(sizes) - sizes]
    return total[1:] - np.repeat(before, sizes), sizes


def _read(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str]) -> DataFrame:
    """row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def read(batches):
        own = aligner(*paths)
        for batch in batches:
            for b, texts in parts(batch, 2, SLICE_BYTES):
                numbers, digests, keys, times, sizes = own.aligned([b" " + t if t else b"" for t in texts])
                steps = _differences(keys, sizes).astype("<u4")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(numbers[:, i]) for i in range(4)), pa.array(digests, pa.string()), blobs(steps, sizes), blobs(times.astype("<i8"), sizes)], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(read, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def pair_counts(read: DataFrame, size_b: int, held: int = 1 << 21) -> DataFrame:
    """key (A id x size of B + B id), n (documents), best (whether no pair of the
    A id has more)."""

    def count(batches):
        keys, n, waiting, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def told():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

        for b in batches:
            waiting.append(_restored(b.column(0))[0])
            size += len(waiting[-1])
            if size > held:
                keys, n = _reduced(np.concatenate([keys, *waiting]), np.concatenate([n, np.ones(size, np.int64)]))
                waiting, size = [], 0
                if len(keys) > held:
                    yield told()
                    keys, n = keys[:0], n[:0]
        keys, n = _reduced(np.concatenate([keys, *waiting]), np.concatenate([n, np.ones(size, np.int64)]))
        yield told()

    counts = cut(read.select("pairs").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    most = counts.groupBy(F.expr(f"key div {size_b}").alias("a")).agg(F.max("n").alias("most"))  # one row an A id
    counts = counts.join(F.broadcast(most), F.expr(f"key div {size_b}") == F.col("a"))
    return cut(counts.select("key", "n", (F.col("n") == F.col("most")).alias("best")))


def aligned_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256."""
    paths = paths or vocabularies()
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    read = written(_read(docs, id_col, text_col, paths), "aligned")
    counts = pair_counts(read, size_b)
    facts = counts.agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("rows")).first()
    # At most ``heavy`` pairs can have more than one in ``heavy`` of all rows.
    few = facts["pairs"] <= heavy
    bar = 0 if few else facts["rows"] // heavy
    top = counts.where(F.col("n") > bar).toArrow()
    order = np.argsort(top["key"].to_numpy())
    known = spark.sparkContext.broadcast(tuple(top[c].to_numpy()[order] for c in ("key", "n", "best")))
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def score(batches):
        keys, n, best = known.value
        for b in batches:
            (own, sizes), (times, _) = _restored(b.column(7)), unblobbed(b.column(8), "<i8")
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            row = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.zeros((2, len(sizes)), np.int64)
            np.add.at(sums[0], row[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], row[hit], times[hit] * n[at[hit]])
            rest = np.bincount(row[~hit], minlength=len(sizes))
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest)]), pa.int32()), pa.array(x[~hit])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(sums[0]), pa.array(sums[1]), *lists], names=["row", "id", *numbers, "groups_sha256", "n_best", "count_sum", "keys", "often"])

    out = read.mapInArrow(score, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, keys array<long>, often array<long>")
    if not few:
        out = written(out, "scored")
        rest = out.select("row", F.explode(F.arrays_zip("keys", "often")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.often").alias("often"))
        rest = rest.join(counts.where(F.col("n") <= bar), "key").groupBy(F.col("row").alias("of")).agg(F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("b"), F.sum(F.col("often") * F.col("n")).alias("s"))
        out = out.join(rest, F.col("row") == F.col("of"), "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))})
    return out.select(F.col("id").alias(id_col), *numbers, "n_best", "count_sum", "groups_sha256")
