"""Quality classifier: a convolutional network over bytes, in numpy.

Each byte has a learned vector and an echo: whether the four bytes that end in
it stood up to ECHO bytes earlier too. Learned filters slide over chunks of 16 bytes
that overlap by half and together cover the whole document; every filter keeps
its largest response (max pooling), and a logistic layer over the pooled
responses gives one probability. The network sees bytes of the text alone.

Scores use the parameters rounded to a binary grid, in double precision: every
product and sum is then exact, so a score depends on the text alone, whatever the
kernel, the batch or the text's place in it.

It is fitted on the driver on a bounded sample: at most TRAIN_ROWS labelled
rows, those with the lowest hash of their id; of a text longer than TRAIN_BYTES
a whole segment of so many bytes, at a place drawn by the hash. Scoring covers
every byte of every text, SEGMENT bytes at a time, so memory is bounded whatever
the length.

Defined cases: null and empty texts are scored as one chunk of padding; rows
without a label are never learned from; with no usable label, or one class
only, every score is that class's rate (0.5 with none); empty tables give no
rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, unnamed

TRAIN_ROWS = 3072
TRAIN_BYTES = 16_384
WIDTH, STEP = 16, 8
DIM, FILTERS = 8, 32  # DIM without the echo
INPUT = DIM + 1
ECHO = 24
SEGMENT = 1 << 19
TILE = 4096
PAD = 256
#: Bits after the point of embeddings, filters, shifts and responses, and output weights. With parameters
#: under BOUND a response needs 43 bits and a logit 51, less than the 53 of a double.
EMBED_BITS, FILTER_BITS, SHIFT_BITS, OUT_BITS = 12, 16, 16, 12
BOUND = 8


@dataclass
class Network:
    embed: np.ndarray  # (257, DIM)
    filters: np.ndarray  # (WIDTH * INPUT, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (FILTERS,)
    bias: float

    @staticmethod
    def fresh(seed: int, rate: float) -> "Network":
        g = np.random.default_rng(seed)
        f32 = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
        return Network(f32(PAD + 1, DIM, scale=0.5), f32(WIDTH * INPUT, FILTERS, scale=(WIDTH * INPUT) ** -0.5), np.zeros(FILTERS, np.float32), f32(FILTERS, scale=FILTERS**-0.5), float(np.log(rate / (1 - rate))))

    def rounded(self) -> "Network":
        """The network on its grid, where the order of sums makes no difference."""
        grid = lambda x, bits: np.clip(np.rint(np.asarray(x, np.float64) * 2.0**bits) / 2.0**bits, -BOUND, BOUND)
        return Network(grid(self.embed, EMBED_BITS), grid(self.filters, FILTER_BITS), grid(self.shift, SHIFT_BITS), grid(self.out, OUT_BITS), float(grid(self.bias, OUT_BITS)))


def _echo(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw), bool)
    if len(raw) > 4:
        w = raw.astype(np.uint32)
        four = w[3:] | w[2:-1] << 8 | w[1:-2] << 16 | w[:-3] << 24
        for lag in range(1, min(ECHO, len(four) - 1) + 1):
            out[3 + lag :] |= four[lag:] == four[:-lag]
    return out


def _blocks(raw: bytes, a: int = 0, z: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes a to z in rows of STEP, at least two rows so that one chunk
    exists, and their echoes."""
    z = len(raw) if z is None else min(z, len(raw))
    n = max(2, -(-(z - a) // STEP))
    out, echo = np.full(n * STEP, PAD, np.int16), np.zeros(n * STEP, bool)
    back = max(0, a - ECHO - 4)
    own = np.frombuffer(raw, np.uint8)[back:z]
    out[: z - a], echo[: z - a] = own[a - back :], _echo(own)[a - back :]
    return out.reshape(n, STEP), echo.reshape(n, STEP)


def _input(net: Network, rows: np.ndarray, echo: np.ndarray) -> np.ndarray:
    return np.concatenate([net.embed[rows], echo[..., None]], axis=-1)


def _pooled(net: Network, blocks: list[tuple[np.ndarray, np.ndarray]], where: bool = False):
    """Largest response of each filter in each item; with where, also its chunk."""
    sizes = np.array([len(b) for b, _ in blocks])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    rows, echo = np.concatenate([b for b, _ in blocks]), np.concatenate([e for _, e in blocks])
    half = STEP * INPUT
    kind = net.filters.dtype
    filters, both = np.hstack([net.filters[:half], net.filters[half:]]), np.empty((len(rows), 2 * FILTERS), kind)
    for a in range(0, len(rows), TILE):
        np.matmul(_input(net, rows[a : a + TILE], echo[a : a + TILE]).reshape(-1, half), filters, out=both[a : a + TILE])
    got = np.full((len(rows), FILTERS), -np.inf, kind)
    np.add(both[:-1, :FILTERS], both[1:, FILTERS:], out=got[:-1])
    got[ends - 1] = -np.inf  # a chunk does not run from one item into the next
    top = np.maximum.reduceat(got, starts, axis=0)
    if not where:
        return top
    return top, np.stack([starts[i] + got[starts[i] : ends[i]].argmax(0) for i in range(len(sizes))]), rows, echo


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """One probability for each text; long texts go through in segments that
    overlap by a step, so that no chunk is missed. The same text gets the same
    score, to the last bit, in any batch."""
    net = net.rounded()
    top = np.full((len(texts), FILTERS), -np.inf)
    held, owner, size = [], [], 0

    def flush():
        nonlocal held, owner, size
        if held:
            np.maximum.at(top, np.array(owner), _pooled(net, held))
            held, owner, size = [], [], 0

    for i, raw in enumerate(texts):
        for a in range(0, max(1, len(raw) - STEP), SEGMENT):
            held.append(_blocks(raw, a, a + SEGMENT + STEP))
            owner.append(i)
            size += held[-1][0].size
            if size >= SEGMENT:
                flush()
    flush()
    act = np.rint(np.clip(top + net.shift, 0, 1 << 14) * 2.0**SHIFT_BITS) / 2.0**SHIFT_BITS
    z = np.clip((act * net.out).sum(axis=1) + net.bias, -60, 60)
    return np.array([1 / (1 + math.exp(-x)) for x in z.tolist()])


def train(texts: list[bytes], labels: list[int], epochs: int = 12, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
    """Fits the network with Adam; the gradient of max pooling goes to the
    winning chunk of each filter only."""
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        net = Network.fresh(seed, min(max(share, 0.01), 0.99))
        net.out[:] = 0
        return net
    net = Network.fresh(seed, share)
    order = np.random.default_rng(seed)
    blocks = [_blocks(t) for t in texts]
    names = ("embed", "filters", "shift", "out", "bias")
    m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    steps = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        turn = order.permutation(len(y))
        for a in range(0, len(y), batch):
            some = turn[a : a + batch]
            top, at, rows, echo = _pooled(net, [blocks[i] for i in some], where=True)
            pre = top + net.shift
            act = np.maximum(pre, 0)
            z = act @ net.out + net.bias
            dz = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[some]) / len(some)
            dpre = (dz[:, None] * net.out[None, :]) * (pre > 0)  # (items, FILTERS)
            chunk, heard = (np.concatenate([x[at], x[at + 1]], axis=2) for x in (rows, echo))  # (items, FILTERS, WIDTH)
            seen = _input(net, chunk, heard).reshape(*at.shape, WIDTH * INPUT)
            back = (dpre[:, :, None] * net.filters.T[None]).reshape(-1, INPUT)[:, :DIM]
            d_embed = np.stack([np.bincount(chunk.ravel(), back[:, d], PAD + 1) for d in range(DIM)], axis=1).astype(np.float32)
            grads = {"embed": d_embed, "filters": np.einsum("if,ifd->df", dpre, seen), "shift": dpre.sum(0), "out": act.T @ dz, "bias": float(dz.sum())}
            t += 1
            now = rate * (1 - 0.9 * t / steps)
            for k in names:
                p, g = getattr(net, k), grads[k]
                g = g + decay * p if k != "bias" else g
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                setattr(net, k, p - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", usable: Column | None = None, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Network:
    """Fits on the bounded sample of labelled rows; ``usable`` (a condition on
    the id) leaves rows out, as a held-out share."""
    raw = text_of(text_col)
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    given = given.groupBy("id").agg(F.max("y").alias("y"))
    if usable is not None:
        given = given.where(usable)
    # The ids with the lowest hashes are settled before any text is read.
    given = given.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    given = given.withColumn("h", F.xxhash64("id", F.lit("train"))).orderBy("h", "id").limit(rows)
    room = F.greatest(F.octet_length("t") - most_bytes + 1, F.lit(1))
    segment = F.col("t").substr(F.pmod(F.xxhash64("id", F.lit("segment")), room).cast("int") + 1, F.lit(most_bytes))
    texts = docs.select(F.col(id_col).alias("id"), raw.cast("binary").alias("t")).withColumn("t", segment)
    sample = texts.join(F.broadcast(given), "id").orderBy("h", "id", "t").limit(rows).select("t", "y").collect()
    texts, y = [r["t"] for r in sample], [r["y"] for r in sample]
    del sample  # its rows are not held twice
    return train(texts, y)


def score_quality(docs: DataFrame, net: Network, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with one more column, the probability of label 1; the other
    columns are left alone whatever they are called."""

    def score(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
            s = pa.array(scores(net, texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], s], names=[*b.schema.names[:-1], "_score"])

    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    rows = renamed.withColumn("_text", text_of(f"c{docs.columns.index(text_col)}"))
    fields = [*renamed.schema.fields]
    out = rows.mapInArrow(score, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "_score double"]))
    return out.toDF(*docs.columns, to)


def keep_good(docs: DataFrame, net: Network, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    plain, name = unnamed(docs)
    scored = score_quality(plain, net, name(text_col), "score")
    return scored.where(F.col("score") >= at_least).drop("score").toDF(*docs.columns)
