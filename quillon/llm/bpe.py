"""Byte-pair token counts by heap and linked list; pieces and ids of texts.

``Counter`` counts the tokens of a text without making any identifier: each
piece of the pre-tokenizer starts as its byte symbols in a linked list, the
lowest-rank adjacent pair is popped from a heap until none is left, and the
count is the symbols at the start less the merges made. Pieces are independent,
so their counts are kept in a bounded table in each worker.

Defined cases: null text counts as empty (0 tokens); special strings inside a
text are one token each, as the library's default has them; empty tables give
no rows; pieces of any length take O(n log n).
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

KEPT_PIECES = 400_000
KEPT_CHARS = 64
#: Texts of these characters alone need no normalizer but lower-casing: none composes, none is odd white space.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ſ]*")
_LETTERS, _DIGITS = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
PLAIN_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
PLAIN_PARTS = re.compile(f"{PLAIN_PIECES.pattern}|\\s")


def vocabulary() -> str:
    """Where the public vocabulary lies; a default, the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes
    that print stand for themselves, the others follow from code point 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Pieces:
    """Splits texts as the vocabulary's normalizer and pre-tokenizer do."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.spec = json.load(open(path, encoding="utf-8"))
        special = [t["content"] for t in self.spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.ends = special
        self.special_bytes = [t.encode("utf-8") for t in special]
        self.bytes_of = {c: b for b, c in enumerate(byte_symbols())}

    def plain(self, text: str) -> list[str] | None:
        """Pieces of a text without special strings or unusual characters."""
        if PLAIN.fullmatch(text) is None or any(t in text for t in self.ends):
            return None
        return PLAIN_PIECES.findall(text.lower())

    def split_plain(self, words: list[str]) -> list[list[str] | None]:
        """The pieces of each of many lower-cased words without special strings;
        None for words of unusual characters."""
        usual = [PLAIN.fullmatch(w) is not None for w in words]
        found = PLAIN_PARTS.findall(" ".join(w for w, u in zip(words, usual) if u))
        found.append(" ")
        out, at = [], 0
        for u in usual:
            if not u:
                out.append(None)
                continue
            end = found.index(" ", at)
            out.append(found[at:end])
            at = end + 1
        return out

    def has_special(self, text: bytes) -> bool:
        return any(x in text for x in self.special_bytes)

    def split(self, text: str) -> tuple[list[str], int]:
        """Pieces, and how many special strings stood between them."""
        found = self.plain(text)
        if found is not None:
            return found, 0
        parts = self.special.split(text) if self.special else [text]
        out = []
        for p in parts:
            for piece, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(p)):
                out.append(bytes(self.bytes_of[c] for c in piece).decode("utf-8", "surrogateescape"))
        return out, len(parts) - 1


class Counter(dict):
    """piece -> tokens, filled as pieces are met and emptied when full."""

    def __init__(self, path: str):
        super().__init__()
        self.pieces = Pieces(path)
        model = self.pieces.spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + suffix] for s in symbols]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]

    def __missing__(self, piece: str) -> int:
        n = self.tokens_of(piece.encode("utf-8", "surrogateescape"))
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = n
        return n

    def tokens_of(self, word: bytes) -> int:
        n, rank = len(word), self.rank
        sym = [self.inner[b] for b in word]
        sym[-1] = self.final[word[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapify(heap)
        left = n
        while heap:
            x = heappop(heap)
            r, i = x >> 32, x & 0xFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j >= n or rank.get(sym[i] << 32 | sym[j]) != r:
                continue  # an earlier merge took one of the two
            sym[i], sym[j], k = self.made[r], -1, after[j]
            after[i] = k
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank.get(sym[i] << 32 | sym[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank.get(sym[h] << 32 | sym[i])) is not None:
                heappush(heap, r << 32 | h)
        return left

    def count(self, text: str) -> int:
        pieces, special = self.pieces.split(text)
        return sum(map(self.__getitem__, pieces)) + special


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One a worker process; later tasks find its pieces."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens."""
    path = path or vocabulary()

    def count(batches):
        c = counter(path)
        for b in batches:
            n = pa.array([c.count(t) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["id", "n_bytes", "n_tokens"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(count, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
