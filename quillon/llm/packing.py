"""Lexical retrieval packing with a sharded BM25 index.

Documents are tokenised once and dealt by content into shards of about
SHARD_DOCS: in the order of their two weightiest terms that other documents hold
too, so documents that share rare terms lie side by side. A seed asks its own
shard alone, on all its terms; neighbours whose weightiest terms differ can lie
in other shards and are not found. Stretches of ``window`` ids fill sequences of their own; what is
left of each document waits in its shard. There the next waiting document seeds
a sequence, and the shard's inverted index returns its unused neighbours by
BM25, best first; they fill the window, whole while they fit, the last one cut
where the window ends (its rest seeds the next sequence). When no neighbour is
left, the next waiting document is taken. So only the last sequence of a shard
is not full.

BM25's terms are token ids, so document frequencies, taken over all documents,
are bounded by the vocabulary; these alone are sent to every task.

Defined cases: null text counts as empty and has the end id alone; repeated rows
are packed on their own; long documents are cut; an empty table gives no rows.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Pieces, byte_symbols, vocabulary
from .common import text_of, written
from .scan import Vocabulary, blobs, gathered, parts, slices, unblobbed

WINDOW, END = 2048, 1
SHARD_DOCS, SHARD_IDS = 2048, 1 << 22
K1, B = 1.2, 0.75
#: Pieces and words that a worker remembers; they stay with it from task to task.
KEPT_PIECES, KEPT_WORDS = 200_000, 1_000_000
BATCH_BYTES = 4 << 20
#: Terms that more than one in DENSE documents of a shard hold are scored as one matrix product, MOST_DENSE at most.
DENSE, MOST_DENSE = 16, 1024


class Ids:
    """The ids of texts. Different words are tokenised once each, from the ids of
    their pieces, which the library's own model gives; texts that hold special
    strings go through the library whole."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.kind = np.dtype("<u2" if self.pieces.lib.get_vocab_size() < 1 << 16 else "<u4")
        self.symbols = str.maketrans({chr(b): s for b, s in enumerate(byte_symbols())})
        self.words, self.known = Vocabulary(self._learn, self.kind, KEPT_WORDS), {}

    def _encode(self, text: str) -> list[int]:
        return self.pieces.lib.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> bytes:
        symbols = piece.encode("utf-8").decode("latin-1").translate(self.symbols)
        return np.array([t.id for t in self.pieces.lib.model.tokenize(symbols)], self.kind).tobytes()

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) >= KEPT_PIECES:
            self.known.clear()
        known, values, sizes = self.known, [], []
        texts = [w.decode("utf-8").lower() for w in words]
        for w, own in zip(words, self.pieces.split_plain(texts)):
            if own is None:
                got = np.array(self._encode(w.decode("utf-8")), self.kind).tobytes()
            else:
                for p in own:
                    if p not in known:
                        known[p] = self._piece(p)
                got = b"".join([known[p] for p in own])
            values.append(got)
            sizes.append(len(got) // self.kind.itemsize)
        return np.frombuffer(b"".join(values), self.kind), np.array(sizes, np.int64)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each with the end id, and their numbers."""
        special = [i for i, t in enumerate(texts) if self.pieces.has_special(t)]
        plain = texts if not special else [b"" if i in set(special) else t for i, t in enumerate(texts)]
        starts, sizes, bounds = self.words.of(plain)
        values = np.append(self.words.values, np.array(END, self.kind))
        starts, sizes = (np.insert(x, bounds[1:], v) for x, v in ((starts, len(values) - 1), (sizes, 1)))
        bounds = bounds + np.arange(len(bounds))
        ids, counts = gathered(values, starts, sizes), np.diff(np.concatenate([[0], np.cumsum(sizes)])[bounds])
        if special:
            each = np.split(ids, np.cumsum(counts)[:-1])
            for i in special:
                each[i] = np.array([*self._encode(texts[i].decode("utf-8")), END], self.kind)
            ids, counts = np.concatenate(each), np.array([len(x) for x in each])
        return ids, counts


_IDS: dict[str, Ids] = {}


def ids(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def id_kind(spark: SparkSession, path: str) -> np.dtype:
    """What holds an id, as a task says: the vocabulary is loaded by the workers alone, which keep it."""

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([ids(path).kind.str])], names=["kind"])

    return np.dtype(spark.range(0, 1, 1, 1).mapInArrow(run, "kind string").first()["kind"])


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """(id, ids): the ids of each document and the end id, as bytes."""

    def run(batches):
        t = ids(path)
        for b in batches:
            for part, texts in parts(b, 1, BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), blobs(*t.of(texts))], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids binary")


def term_counts(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of documents end to end, in this order."""
    key = np.repeat(np.arange(len(sizes), dtype=np.int64) << 24, sizes)
    key |= flat
    key.sort()
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at] >> 24, key[at] & 0xFFFFFF, np.diff(np.append(at, len(key)))


def weights(doc: np.ndarray, term: np.ndarray, times: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    return (idf[term] * (times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[doc] / max(mean, 1.0))))).astype(np.float32)


def _stretches(batch, at: int, kind: np.dtype):
    """A batch in slices with their ids end to end and numbers of ids."""
    for a, z in slices(pc.binary_length(batch.column(at)).to_pylist(), BATCH_BYTES):
        part = batch.slice(a, z - a)
        yield part, *unblobbed(part.column(at), kind)


def document_frequencies(tokens: DataFrame, kind: np.dtype) -> tuple[np.ndarray, int, int]:
    """How many documents hold each id, how many there are, the number of ids in all."""
    size = 1 << (16 if kind.itemsize == 2 else 20)

    def run(batches):
        df, n, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            for _, flat, sizes in _stretches(b, 0, kind):
                df += np.bincount(term_counts(flat, sizes)[1], minlength=size)
                n, total = n + len(sizes), total + len(flat)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([df[at], [n, total]]))], names=["term", "n"])

    got = tokens.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df, n, total = np.zeros(size, np.int64), 0, 0
    for r in got.collect():  # at most one row for each id of the vocabulary
        if r["term"] >= 0:
            df[r["term"]] = r["n"]
        else:
            n, total = (r["n"], total) if r["term"] == -1 else (n, r["n"])
    return df, n, total


def dealt(tokens: DataFrame, kind: np.dtype, df: np.ndarray, idf: np.ndarray, mean: float, shards: int) -> DataFrame:
    """(shard, id, ids): documents side by side in the order of their two
    weightiest terms among those that at least two documents hold; documents
    equal in these are told apart by a hash."""
    shared = tokens.sparkSession.sparkContext.broadcast((np.where(df > 1, idf, 0).astype(np.float32), mean))

    def run(batches):
        idf, mean = shared.value
        for b in batches:
            for part, flat, sizes in _stretches(b, 1, kind):
                doc, term, times = term_counts(flat, sizes)
                w = weights(doc, term, times, sizes, idf, mean)
                order = np.lexsort((term, -w, doc))
                first = np.searchsorted(doc, np.arange(len(sizes)))  # every document has the end id at least
                top = []
                for k in (0, 1):
                    at = order[np.minimum(first + k, len(order) - 1)]
                    top.append(np.where((doc[at] == np.arange(len(sizes))) & (w[at] > 0), term[at], -1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(top[0]), pa.array(top[1]), part.column(0), part.column(1)], names=["t1", "t2", "id", "ids"])

    id_type = tokens.schema["id"].dataType.simpleString()
    keyed = tokens.select("id", "ids").mapInArrow(run, f"t1 int, t2 int, id {id_type}, ids binary").withColumn("h", F.xxhash64("id", "ids"))
    side = keyed.repartitionByRange(shards, "t1", "t2", "h").sortWithinPartitions("t1", "t2", "h", "id", "ids")
    return side.select(F.spark_partition_id().alias("shard"), "id", "ids")


class Index:
    """BM25 over the documents of one shard; a query has all terms of its document.

    Terms that many documents hold are scored for all pairs by one matrix
    product, the others by their posting lists."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n = self.n = len(docs)
        sizes = np.array([len(d) for d in docs])
        doc, term, times = term_counts(np.concatenate(docs), sizes)
        w = weights(doc, term, times, sizes, idf, mean)
        _, term = np.unique(term, return_inverse=True)
        held = np.bincount(term)
        often = np.argsort(-held, kind="stable")[:MOST_DENSE]
        often = often[held[often] * DENSE > n]
        column = np.full(len(held), -1)
        column[often] = np.arange(len(often))
        dense = column[term] >= 0
        matrix = np.zeros((n, len(often)), np.float32)
        matrix[doc[dense], column[term[dense]]] = w[dense]
        self.base = (matrix > 0).astype(np.float32) @ matrix.T
        doc, term, w = doc[~dense], term[~dense], w[~dense]
        self.terms, self.bounds = term, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = doc[order], w[order]
        self.sizes = np.bincount(term, minlength=len(held))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def scores(self, i: int) -> np.ndarray:
        """Of all documents, for the terms of document i."""
        terms = self.terms[self.bounds[i] : self.bounds[i + 1]]
        at = gathered(np.arange(len(self.owner)), self.starts[terms], self.sizes[terms])
        return self.base[i] + np.bincount(self.owner[at], self.weight[at], self.n)

    def neighbours(self, i: int, unused: np.ndarray):
        """Unused documents that share a term with i, best first."""
        score = self.scores(i)
        score[~unused] = 0
        few = min(64, self.n)
        some = np.argpartition(-score, few - 1)[:few]
        best = some[np.lexsort((some, -score[some]))]
        yield from best[score[best] > 0].tolist()
        rest = np.flatnonzero(score > 0)  # beyond the first, only if the window still has room
        rest = rest[np.lexsort((rest, -score[rest]))]
        yield from rest[~np.isin(rest, best)].tolist()


def pack(docs: list[np.ndarray], index: Index, window: int = WINDOW):
    """(doc, start, length, sequence, offset) of every piece."""
    sequence, left = 0, []
    for i, d in enumerate(docs):
        for a in range(0, len(d) - window + 1, window):
            yield i, a, window, sequence, 0
            sequence += 1
        left.append(len(d) // window * window)
    done = np.array(left)  # ids of each document that are packed
    size = np.array([len(d) for d in docs])
    unused = done < size
    order = np.argsort(-(size - done), kind="stable").tolist()
    at, seed = 0, None
    while True:
        if seed is None or not unused[seed]:
            while at < len(order) and not unused[order[at]]:
                at += 1
            if at == len(order):
                return
            seed = order[at]
        offset, now, cut_one = 0, seed, None
        found = None
        while offset < window:
            take = min(int(size[now] - done[now]), window - offset)
            yield now, int(done[now]), take, sequence, offset
            done[now] += take
            offset += take
            if done[now] < size[now]:
                cut_one = now
                break
            unused[now] = False
            if offset == window:
                break
            if found is None:
                found = index.neighbours(seed, unused)
            now = next((x for x in found if unused[x]), None)
            if now is None:
                while at < len(order) and not unused[order[at]]:
                    at += 1
                if at == len(order):
                    return
                now = order[at]
        sequence += 1
        seed = cut_one


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or vocabulary()
    kind = id_kind(docs.sparkSession, path)
    tokens = written(tokenised(docs, path, id_col, text_col), "tokens")
    df, n, total = document_frequencies(tokens, kind)
    mean = total / max(n, 1)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((idf, mean))
    id_type = docs.schema[id_col].dataType.simpleString()
    shards = max(1, -(-n // shard_docs), -(-total // shard_ids))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        idf, mean = shared.value
        held, size, own, before, kind_of_id = [], 0, None, 0, None

        def settle():
            nonlocal before
            if not held:
                return
            docs = [np.frombuffer(x, kind) for _, x in held]
            rows = [(held[i][0], a, k, crc32(docs[i][a : a + k].astype("<u4").tobytes()), len(docs[i]), (own << 32) + before + s, o) for i, a, k, s, o in pack(docs, Index(docs, idf, mean), window)]
            before += rows[-1][5] - (own << 32) - before + 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind_of_id), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

        for b in batches:
            kind_of_id = b.schema.field(1).type
            for s, i, x in zip(*(b.column(k).to_pylist() for k in range(3))):
                # A range that came out too large makes several shards.
                if s != own or len(held) >= 2 * shard_docs or size > 2 * shard_ids * kind.itemsize:
                    yield from settle()
                    before = before if s == own else 0
                    held, size, own = [], 0, s
                held.append((i, x))
                size += len(x)
        yield from settle()

    out = dealt(tokens, kind, df, idf, mean, shards).mapInArrow(run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
