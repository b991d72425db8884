"""Chat formatting at the level of tokens.

A turn is a header, its text and an end mark. Headers and marks are control
strings, each with a reserved id beyond the vocabulary; texts are encoded apart
from them, so no text, whatever it says, gives a reserved id, and no token runs
over a border. In the written form too a text can't pass for a control string: a
backslash before every backslash, and one behind the first character of every
control string that a text contains; ``unescaped`` takes them out again.

    ### User:TEXT</turn>          known roles: system, user, assistant
    ### Role:ROLE### Text:TEXT</turn>   any other

1. Turns are encoded where they lie: work is dealt by rows, so a long conversation
   is no task of its own. Each different segment of a text is encoded once.
2. Sorted by conversation and turn, the segments of a batch are laid end to end
   and the reserved ids spliced between. The loss mask is a prefix sum: +1 where a
   text of a role that is learned begins, -1 where it ends. Pieces of at most
   PIECE ids leave the task, so a conversation of any length streams through; its
   digests, a running hash by their nature, keep a few bytes of state.

Defined cases: null text and null role count as empty; turns are ordered by turn
(null first), then role, then ids; repeated rows are turns of their own; a null
conversation id is a conversation; extra columns are left out; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scan import blobs, parts, slices, unblobbed
from .tokens import ByteLevel, Lists, Store, segments

#: The template's control strings, in the order of their reserved ids.
KNOWN = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:"}
CONTROLS = [*KNOWN.values(), "### Role:", "### Text:", "</turn>"]
ROLE, TEXT, END = len(KNOWN), len(KNOWN) + 1, len(KNOWN) + 2
LEARNED = ("assistant",)
PIECE = 1 << 16
SLICE_BYTES = 4 << 20
KEPT_SEGMENTS = 1_000_000
_ESCAPE = re.compile("|".join(map(re.escape, ["\\", *CONTROLS])))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def vocabulary() -> str:
    """Where the public vocabulary lies; a default, the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def escaped(text: str) -> str:
    """``text`` without control strings, reversibly."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Encoder:
    """Ids of texts, each different segment encoded once."""

    def __init__(self, path: str):
        self.lib = ByteLevel(path)
        self.clear()

    def clear(self):
        self.store, self.ids = Store(self._learn), Lists(np.int32)

    def _learn(self, found: list[bytes]) -> None:
        self.ids.add(*self.lib.encoded(found))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and each text's number of them."""
        if len(self.ids.sizes) > KEPT_SEGMENTS or len(self.ids.values) > 8 * KEPT_SEGMENTS:
            self.clear()
        raw, starts, ends, bounds = segments(texts)
        codes = self.store.codes(raw, starts, ends)
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(self.ids.sizes[codes], out=total[1:])
        return self.ids.of(codes), np.diff(total[bounds])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process; later tasks find its segments."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _turns(rows: DataFrame, path: str, kind: str) -> DataFrame:
    """conv, turn, role (place in KNOWN, or ROLE), role_ids, ids: encoded turns."""
    known = {r: i for i, r in enumerate(KNOWN)}

    def encode(batches):
        own = encoder(path)
        for batch in batches:
            for b, texts in parts(batch, 3, SLICE_BYTES):
                roles = b.column(2).to_pylist()
                texts = [escaped(t.decode("utf-8")).encode("utf-8") for t in texts]
                others = [b"" if r in known else escaped(r).encode("utf-8") for r in roles]
                (a, n), (c, m) = own.encode(texts), own.encode(others)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([known.get(r, ROLE) for r in roles], pa.int32()), blobs(c.astype("<i4"), m), blobs(a.astype("<i4"), n)], names=["conv", "turn", "role", "role_ids", "ids"])

    return rows.mapInArrow(encode, f"conv {kind}, turn long, role int, role_ids binary, ids binary")


def spliced(base: int, roles: np.ndarray, role_ids: np.ndarray, role_sizes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, learned: tuple[str, ...] = LEARNED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turns end to end with the reserved ids between, their loss mask, and the
    bounds of the turns. ``base`` is the first reserved id."""
    other = roles == ROLE
    head = 1 + np.where(other, role_sizes + 1, 0)  # a header, or role mark, role and text mark
    bounds = np.zeros(len(roles) + 1, np.int64)
    np.cumsum(head + sizes + 1, out=bounds[1:])
    starts, body = bounds[:-1], bounds[:-1] + head
    out = np.full(bounds[-1], base + END, np.int32)
    out[starts] = base + roles
    out[body[other] - 1] = base + TEXT
    place = lambda at, n: np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    out[place(starts + 1, np.where(other, role_sizes, 0))] = role_ids
    out[place(body, sizes)] = ids
    change = np.zeros(len(out) + 1, np.int32)
    told = np.isin(roles, [i for i, r in enumerate(KNOWN) if r in learned])
    np.add.at(change, body[told], 1)
    np.add.at(change, (body + sizes)[told], -1)
    return out, np.cumsum(change[:-1]).astype(np.int8), bounds


def formatted(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", path: str | None = None, learned: tuple[str, ...] = LEARNED, piece: int = PIECE) -> DataFrame:
    """conv, piece (from 0), ids (32-bit), mask (bytes 0 or 1): conversations in
    pieces of at most ``piece`` ids, a conversation's pieces in order in one
    partition. Ids from the vocabulary's size on are CONTROLS."""
    path = path or vocabulary()
    kind = rows.schema[conv_col].dataType.simpleString()
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    turns = _turns(plain, path, kind).repartition("conv").sortWithinPartitions("conv", "turn", "role", "role_ids", "ids")

    def assemble(batches):
        base, last, number = encoder(path).lib.size, [], 0
        for batch in batches:
            weights = (pc.binary_length(batch.column(3)).to_numpy() + pc.binary_length(batch.column(4)).to_numpy()) // 4 + 3
            for a, z in slices(weights.tolist(), 16 * piece):
                b = batch.slice(a, z - a)
                convs, roles = b.column(0).to_pylist(), b.column(2).to_numpy()
                ids, mask, bounds = spliced(base, roles, *unblobbed(b.column(3), "<i4"), *unblobbed(b.column(4), "<i4"), learned)
                out = [], [], [], []
                new = [k for k in range(len(convs)) if k == 0 or convs[k] != convs[k - 1]]
                for k, end in zip(new, [*new[1:], len(convs)]):
                    if last != [convs[k]]:
                        last, number = [convs[k]], 0
                    for at in range(int(bounds[k]), int(bounds[end]), piece):
                        stop = min(at + piece, int(bounds[end]))
                        for x, y in zip(out, (convs[k], number, ids[at:stop].tobytes(), mask[at:stop].tobytes())):
                            x.append(y)
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["conv", "piece", "ids", "mask"])

    return turns.mapInArrow(assemble, f"conv {kind}, piece long, ids binary, mask binary")


def turns_of(base: int, table: list[bytes], pieces):
    """(conversation, role, text, text under the mask, characters written) of
    every turn of pieces (conversation, number, ids, mask) in their order."""
    conv, fields, kind, chars = None, [], -1, 0
    held: list = []  # ids and mask since the last control string

    def text_of_held(masked: bool) -> str:
        own = [i[m == 1] if masked else i for i, m in held]
        return b"".join(table[t] for i in own for t in i.tolist()).decode("utf-8")

    for conv, _, ids, mask in pieces:
        ids, mask = np.frombuffer(ids, "<i4"), np.frombuffer(mask, np.int8)
        at = 0
        for stop in [*np.flatnonzero(ids >= base).tolist(), len(ids)]:
            if stop > at:
                held.append((ids[at:stop], mask[at:stop]))
            if stop == len(ids):
                break
            control = int(ids[stop]) - base
            written = text_of_held(False)
            chars += len(written) + len(CONTROLS[control])
            if control == END:
                role = fields[0] if kind == ROLE else list(KNOWN)[kind]
                yield conv, role, unescaped(written), unescaped(text_of_held(True)), chars
                chars = 0
            elif control == TEXT:
                fields = [unescaped(written)]
            else:
                kind = control
            held, at = [], stop + 1


def read_back(pieces: DataFrame, path: str | None = None, in_order: bool = False) -> DataFrame:
    """One row a conversation of ``formatted``: conv, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, all from ids and mask. With
    ``in_order`` the partitions are as ``formatted`` left them."""
    path = path or vocabulary()
    kind = pieces.schema["conv"].dataType.simpleString()
    if not in_order:
        pieces = pieces.repartition("conv").sortWithinPartitions("conv", "piece")

    def read(batches):
        lib = encoder(path).lib
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
        out: list = []
        for conv, turns in groupby(turns_of(lib.size, lib.bytes, rows), key=lambda t: t[0]):
            n, all_turns, loss, loss_chars, chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            for _, role, text, learned, written in turns:
                n, chars, loss_chars = n + 1, chars + written, loss_chars + len(learned)
                all_turns.update(f"{role}\n{text}\n".encode("utf-8"))
                loss.update(learned.encode("utf-8"))
            out.append((conv, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) == 4096:
                yield told(out)
                out = []
        if out:
            yield told(out)

    def told(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    conv_type = to_arrow_type(pieces.schema["conv"].dataType)
    return pieces.mapInArrow(read, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
