"""Tokens of many texts through segments, each different segment encoded once.

A text is cut before every ASCII white-space run that follows a character which
is no white space at all. Byte-level BPE never merges over such a place, and a
piece vocabulary does so only if it has a piece with white space inside, which is
looked up when it is loaded; so the tokens of a text are those of its segments,
and every such place is a token's end. Segments are hashed by array operations
(64 bits) and kept in a bounded store in each worker.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd

from .bpe import byte_symbols
from .scan import _INVERSE, _POWER, LONG, SPAN, U, _SPACE, _VALUE, mix

#: White space beyond ASCII, and what some libraries take for it, in UTF-8.
_ODD = rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf"
ODD_BEFORE_SPACE = re.compile(rb"(?:" + _ODD + rb")(?=[ \t-\r])")
#: Segments that end in odd white space, or hold a long run of any, are encoded alone.
ODD_AT_END = re.compile(rb"(?:" + _ODD + rb")\Z")
LONG_SPACE = re.compile(rb"(?:[ \t-\r]|" + _ODD + rb"){256}")
_VALUE_OF_CASE = _VALUE.copy()
_VALUE_OF_CASE[65:91] = mix(np.arange(65, 91, dtype=U) * U(0x9E3779B97F4A7C15))


def segments(texts: list[bytes], whole: bool = False) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts end to end, the starts and ends of their segments, and the
    bounds of each text's segments; with ``whole`` each text is one."""
    raw = b"".join(texts)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    inner = np.zeros(len(raw) + 1, bool)
    if len(raw) and not whole:
        inner[1:-1] = space[1:] & ~space[:-1]
        for m in ODD_BEFORE_SPACE.finditer(raw):
            inner[m.end()] = False
    inner[at] = True
    cuts = np.flatnonzero(inner)
    starts, ends = cuts[:-1], cuts[1:]
    return raw, starts, ends, np.searchsorted(starts, at)


def segment_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    import xxhash

    b = np.frombuffer(raw, np.uint8)
    h = np.empty(len(starts), U)
    bounds = np.searchsorted(starts, np.arange(0, len(b) + SPAN, SPAN)).tolist()
    for p, q in zip(bounds, bounds[1:]):
        if p == q:
            continue
        a = int(starts[p])
        z = min(int(ends[q - 1]), a + SPAN + LONG)
        total = np.zeros(z - a + 1, U)
        np.cumsum(_VALUE_OF_CASE[b[a:z]] * _POWER[: z - a], dtype=U, out=total[1:])
        s = starts[p:q] - a
        h[p:q] = (total[np.minimum(ends[p:q], z) - a] - total[s]) * _INVERSE[s]
    mix(h)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return h


class Store:
    """Numbers segments: ``codes`` gives each segment's number, ``learn(list of
    bytes)`` is called once with those not met before, in order of their numbers."""

    def __init__(self, learn):
        self.learn = learn
        self.clear()

    def clear(self):
        self.hashes, self.numbers = np.empty(0, U), np.empty(0, np.int64)

    def codes(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        code, different = pd.factorize(segment_hashes(raw, starts, ends))
        order = np.argsort(different)
        ranked = different[order]
        near = np.searchsorted(self.hashes, ranked)
        new = np.ones(len(ranked), bool)
        held = near < len(self.hashes)
        new[held] = self.hashes[near[held]] != ranked[held]
        if new.any():
            first = np.empty(len(different), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            own = first[order[new]]
            self.learn([raw[a:z] for a, z in zip(starts[own].tolist(), ends[own].tolist())])
            at = near[new]
            self.numbers = np.insert(self.numbers, at, len(self.hashes) + np.arange(len(own)))
            self.hashes = np.insert(self.hashes, at, ranked[new])
        number = np.empty(len(different), np.int64)
        number[order] = self.numbers[np.searchsorted(self.hashes, ranked)]
        return number[code]


class Lists:
    """A growing list of number lists, end to end."""

    def __init__(self, kind):
        self.values, self.starts, self.sizes = np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        sizes = np.asarray(sizes, np.int64)
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.values = np.concatenate([self.values, np.asarray(values, self.values.dtype)])

    def of(self, codes: np.ndarray) -> np.ndarray:
        s, n = self.starts[codes], self.sizes[codes]
        return self.values[np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _end_to_end(found: list[list[int]], kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in found], np.int64)
    return np.array([i for x in found for i in x], kind), sizes


class ByteLevel:
    """A byte-level BPE vocabulary of the tokenizers library; special strings in
    texts are plain text. Where its ranks allow it, segments are encoded by
    tiktoken, which gives the same ids several times as fast."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        self.bytes = [b""] * self.size
        for t, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in t)
        self.fast = self._ranks(spec, vocab)

    def _ranks(self, spec: dict, vocab: dict):
        import tiktoken

        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        pre, usual = spec["pre_tokenizer"], spec["normalizer"] is None and not spec["model"].get("end_of_word_suffix")
        if not usual or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or made != sorted(made) or len(set(made)) != len(made):
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={self.bytes[i]: i for i in vocab.values()}, special_tokens={})

    def alone(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def encoded(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments end to end, and their numbers. Segments between a
        white-space run and a last character are encoded in one go and cut at
        their ends, which are ends of tokens."""
        if self.fast is None:
            return _end_to_end([self.alone(x.decode("utf-8")) for x in found])
        joint = [bool(x) and _SPACE[x[0]] and not _SPACE[x[-1]] and not ODD_AT_END.search(x[-3:]) and not (len(x) >= 256 and LONG_SPACE.search(x)) for x in found]
        some, out = [i for i, j in enumerate(joint) if j], [None] * len(found)
        try:
            ids = self.fast.encode_ordinary(b"".join([found[i] for i in some]).decode("utf-8"))
            for i, own in zip(some, cut_at([self.bytes[t] for t in ids], ids, [found[i] for i in some])):
                out[i] = own
        except ValueError:
            pass
        return _end_to_end([self.alone(x.decode("utf-8")) if own is None else own for x, own in zip(found, out)])


def cut_at(pieces: list[bytes], ids: list[int], texts: list[bytes]) -> list[list[int]]:
    """Ids of joined texts, one list a text; each text must end with a token, and
    the tokens' bytes must be those of the texts."""
    if b"".join(pieces) != b"".join(texts):
        raise ValueError("the bytes of the tokens are others")
    sizes = [len(t) for t in texts]
    ends = np.cumsum([len(p) for p in pieces])
    bounds = np.searchsorted(ends, np.cumsum(sizes))
    if not len(sizes):
        return []
    if not len(ends) or (ends[np.minimum(bounds, len(ends) - 1)] != np.cumsum(sizes)).any():
        raise ValueError("a token runs over the end of a segment")
    bounds = (bounds + 1).tolist()
    return [ids[a:z] for a, z in zip([0, *bounds], bounds)]


#: What a piece model writes for a space.
SPACE_MARK = "▁".encode("utf-8")


class PieceModel:
    """A sentencepiece model with byte fallback that adds a space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.lib.get_piece_size()
        names = [self.lib.id_to_piece(i) for i in range(self.size)]
        of_byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := of_byte.fullmatch(n)) and self.lib.is_byte(i) else n.replace("▁", " ").encode("utf-8") for i, n in enumerate(names)]
        #: Whether no token can run over a cut: no piece has white space behind another character.
        self.cuts = not any(re.search("[^ ][ \t-\r]", p.decode("utf-8", "replace")) or re.search("[\t-\r]", p.decode("utf-8", "replace")) for i, p in enumerate(self.bytes) if not self.lib.is_byte(i) and not self.lib.is_control(i) and not self.lib.is_unknown(i))

    def encoded(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments end to end, and their numbers; a segment begins with
        white space."""
        try:
            if not self.cuts:
                raise ValueError("tokens can run over cuts")
            some = [x for x in found if SPACE_MARK not in x]  # which never comes back
            ids = self.lib.encode("x" + b"".join(some).decode("utf-8"), num_threads=1)
            joint = iter(cut_at([self.bytes[t] for t in ids], ids, [b" x", *some])[1:])
            own = [self.alone(x) if SPACE_MARK in x else next(joint) for x in found]
        except ValueError:  # or bytes that don't come back: find out whose
            own = [self.alone(x) for x in found]
        return _end_to_end(own)

    def alone(self, segment: bytes) -> list[int]:
        """The space in front is the one that the model adds, or goes."""
        text = segment.decode("utf-8")
        return self.lib.encode(text[1:], num_threads=1) if text[:1] == " " else self.lib.encode(text, num_threads=1)[1:]
