"""Words of many texts at once: places and hashes by array operations.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z lower-cased. A
word's hash is a polynomial in random byte values modulo 2**64, read off one
running sum over the bytes, then mixed; so no word is touched on its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Running sums start anew every SPAN bytes; words longer than LONG are hashed on their own.
SPAN, LONG = 1 << 19, 1 << 14
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
STEP = U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = np.array([xxhash.xxh3_64_intdigest(b"byte %d" % LOWER[b]) for b in range(256)], U)


def _powers(base: int) -> np.ndarray:
    out = np.full(SPAN + LONG + 1, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


_POWER, _INVERSE = _powers(0xD1342543DE82EF95), _powers(pow(0xD1342543DE82EF95, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finisher; x is changed."""
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of ``raw``."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.diff(_SPACE[b], prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    h = np.empty(len(starts), U)
    bounds = np.searchsorted(starts, np.arange(0, len(b) + SPAN, SPAN)).tolist()
    for p, q in zip(bounds, bounds[1:]):
        if p == q:
            continue
        a = int(starts[p])
        z = min(int(ends[q - 1]), a + SPAN + LONG)
        total = np.zeros(z - a + 1, U)
        np.cumsum(_VALUE[b[a:z]] * _POWER[: z - a], dtype=U, out=total[1:])
        s = starts[p:q] - a
        h[p:q] = (total[np.minimum(ends[p:q], z) - a] - total[s]) * _INVERSE[s]
    mix(h)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].translate(LOWER))
    return h, starts, ends


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    out = np.zeros(max(len(h) - width + 1, 0), U)
    for i in range(width):
        out *= STEP
        out += h[i : i + len(out)]
    return mix(out)


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts with a line break after each, and where each begins (and the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return b"\n".join([*texts, b""]), at


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``width`` words; a text
    of fewer words gives one, of its whole sequence."""
    raw, at = joined(texts)
    h, starts, _ = words(raw)
    bounds = np.searchsorted(starts, at).tolist()
    runs, out = rolled(h, width), []
    for a, z in zip(bounds, bounds[1:]):
        if z - a >= width:
            own = np.sort(runs[a : z - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif z > a:
            short = np.array([z - a], U)
            for x in h[a:z]:
                short = short * STEP + x
            out.append(mix(short))
        else:
            out.append(np.empty(0, U))
    return out


class Vocabulary:
    """What a tokenizer gives for the words of texts, each different word asked
    for once: ``learn`` maps a list of words to values end to end and their
    numbers. Fit for tokenizers that see no further than a word, split at ASCII
    white space, and lower-case it. Words are told apart by their 64-bit hashes.
    Emptied when full."""

    def __init__(self, learn, kind: np.dtype, kept: int = 1_500_000):
        self.learn, self.kind, self.kept = learn, np.dtype(kind), kept
        self.clear()

    def clear(self):
        self.hashes, self.places = np.empty(0, U), np.empty(0, np.int64)  # sorted; where each word's values are
        self.values, self.starts, self.sizes = np.empty(0, self.kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def _add(self, hashes: np.ndarray, found: list[bytes]) -> None:
        values, sizes = self.learn(found)
        places = len(self.starts) + np.arange(len(sizes))
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.values = np.concatenate([self.values, np.asarray(values, self.kind)])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.places = np.insert(self.hashes, at, hashes), np.insert(self.places, at, places)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words of some texts: first value and number of values of each
        word in ``values``, and the bounds of the texts' words."""
        raw, at = joined(texts)
        h, starts, ends = words(raw)
        code, different = pd.factorize(h)
        order = np.argsort(different)
        ranked = different[order]
        if max(len(self.hashes), len(self.values) // 8) >= self.kept:
            self.clear()
        near = np.searchsorted(self.hashes, ranked)
        new = np.ones(len(ranked), bool)
        new[near < len(self.hashes)] = self.hashes[near[near < len(self.hashes)]] != ranked[near < len(self.hashes)]
        if new.any():
            first = np.empty(len(different), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            own = first[order[new]]
            self._add(ranked[new], [raw[a:z] for a, z in zip(starts[own].tolist(), ends[own].tolist())])
        place = np.empty(len(different), np.int64)
        place[order] = self.places[np.searchsorted(self.hashes, ranked)]
        place = place[code]
        return self.starts[place], self.sizes[place], np.searchsorted(starts, at)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``values`` end to end."""
    return values[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def slices(sizes, most: int):
    """Stretches of a batch of at most about ``most`` bytes."""
    a, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield a, i
            a, total = i, 0
        total += s
    if a < len(sizes):
        yield a, len(sizes)


def parts(batch, at: int, most: int):
    """A batch in slices with the bytes of the texts of column ``at``."""
    for a, z in slices(pc.binary_length(batch.column(at)).to_pylist(), most):
        part = batch.slice(a, z - a)
        yield part, part.column(at).cast(pa.binary()).to_pylist()


def blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary column: row i holds the next counts[i] of ``values``."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(np.asarray(counts) * values.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def unblobbed(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """What blobs() was given; a null row holds none."""
    kind = np.dtype(kind)
    counts = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) // kind.itemsize
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind), counts
