"""Embedding near-duplicates by E8 lattice hashing.

Each table projects the unit vectors on eight random directions and decodes
them to the nearest point of the E8 lattice; a vector lives in that cell and
probes the PROBES neighbouring cells it leans to most. Two vectors meet in a
table if they share a cell or one probes the other's. With six tables a pair at
cosine 0.98 in 64 dimensions is missed with probability about 2e-6 (measured:
0.89 found in one table). Every meeting is verified by the cosine in double
precision.

Vectors are only hashed with their label, so other labels never meet. Equal
vectors are collapsed first. Each cell's vectors are dealt into blocks, pairs of
blocks go to tasks. There a first pass compares 64 signs of random projections
and lets only rows with a likely partner go on; these alone are sent their
vectors, and a task multiplies blocks and returns one row for each vector that
has links: how many, and the smallest id it is connected to there. No pair leaves a task, and no cell, however full, is gathered in one. A pair
that meets more than once is counted only at its first meeting in a fixed order.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of different lengths never link; rows that repeat id, label
and vector count as one; an id that names several vectors is compared by one; rows without an id
are returned unlinked; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

TABLES, PROBES, SCALE = 6, 2, 1.5
BLOCK = 512


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [[s * (k == i) + t * (k == j) for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + [list(v) for v in half], float)


_NEAR = minimal_vectors()


def _checkerboard(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return r


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: integer ones with an even sum, or those plus a half."""
    a, b = _checkerboard(x), _checkerboard(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, label: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the homes (n, tables) and of the probed cells (n, tables, probes)."""
    n, dim = unit.shape
    homes, probed = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        ways = np.random.default_rng([seed, t, dim]).standard_normal((dim, 8))
        weights = np.random.default_rng([seed, t]).integers(1, 2**63, 9, np.int64).astype(np.uint64) | np.uint64(1)
        x = unit @ ways / scale
        home = nearest_point(x)
        lean = np.argsort(-((x - home) @ _NEAR.T), axis=1, kind="stable")[:, :probes]

        def key(points, label=label, weights=weights):
            twice = np.rint(points * 2).astype(np.int64).astype(np.uint64)
            h = (twice * weights[:8]).sum(axis=-1, dtype=np.uint64)
            h += label.astype(np.uint64).reshape(-1, *[1] * (h.ndim - 1)) * weights[8]
            h ^= h >> np.uint64(29)
            return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)

        homes[:, t], probed[:, t] = key(home), key(home[:, None, :] + _NEAR[lean])
    return homes, probed


def _labelled(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    given = table.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if given == "array<float>" else F.col(vector_col).cast("array<double>")
    sound = vector.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return table.select(F.col(id_col).alias("id"), F.xxhash64(F.col(label_col), F.size(vector)).alias("label"), vector.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))


def _meet(rows: pa.Table, least: float):
    """Links of one block pair: rows id, copies, v, homes, probed, home (whether
    the row lives in the cell). -> ids, links counted here, smallest id reached."""
    ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
    home = rows["home"].to_numpy(zero_copy_only=False)
    v, homes, probed = (rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) for c in ("v", "homes", "probed"))
    key = rows["key"][0].as_py()
    side = rows["side"].to_numpy()
    h, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(h) or not len(q):
        return None
    v = v.astype(np.float64)
    norm = np.sqrt((v * v).sum(1))
    near = v[h] @ v[q].T / norm[h][:, None] / norm[q][None, :] >= least
    a, b = np.nonzero(near)
    a, b = h[a], q[b]
    fresh = (ids[a] < ids[b]) | (~home[b] & (ids[a] != ids[b]))  # of two that live here, one order only
    a, b = a[fresh], b[fresh]
    if not len(a):
        return None
    n_probes = probed.shape[1] // homes.shape[1]
    counted = np.zeros(len(ids), np.int64)
    for s in range(0, len(a), 50_000):
        x, y = a[s : s + 50_000], b[s : s + 50_000]
        low, high = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
        first = np.zeros(len(x), bool)
        met = np.zeros(len(x), bool)
        for t in range(homes.shape[1]):
            own = slice(t * n_probes, (t + 1) * n_probes)
            homes_low, homes_high = homes[low, t], homes[high, t]
            for one, cell in ((homes_low == homes_high, homes_low), ((probed[low, own] == homes_high[:, None]).any(1), homes_high), ((probed[high, own] == homes_low[:, None]).any(1), homes_low)):
                first |= one & ~met & (cell == key)  # the first meeting of the two, and it is in this cell
                met |= one
        np.add.at(counted, x[first], copies[y[first]])
        np.add.at(counted, y[first], copies[x[first]])
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            break
    some = np.unique(np.concatenate([a, b]))
    return ids[some], counted[some], root[some]


def signs(unit: np.ndarray, seed: int = 12) -> np.ndarray:
    """64 signs of random projections, as a number."""
    ways = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], 64))
    return np.packbits(unit @ ways > 0, axis=1).view(np.int64).reshape(-1)


def groups_of(batches, keys: int, settle):
    """Calls settle(key, rows) for each run of rows that agree in their first ``keys`` columns."""
    rest, at = [], None
    for b in batches:
        ks = np.stack([b.column(i).to_numpy() for i in range(keys)])
        ends = [*(np.flatnonzero((ks[:, 1:] != ks[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        start = 0
        for end in ends:
            if end > start:
                own = tuple(ks[:, start])
                if own != at and rest:
                    yield from settle(pa.Table.from_batches(rest).combine_chunks())
                    rest = []
                at = own
                rest.append(b.slice(start, end - start))
            start = end
    if rest:
        yield from settle(pa.Table.from_batches(rest).combine_chunks())


def screened(dealt: DataFrame, least: float) -> DataFrame:
    """The rows of ``dealt(key, hb, qb, id, home, side, bits)`` that may have a
    link in their block pair, by their signs: two vectors at the threshold differ
    in more signs than the bound with probability 1e-6 at most."""
    p = np.arccos(least) / np.pi
    bound = int(np.ceil(64 * p + 6 * np.sqrt(64 * p * (1 - p))))

    def settle(t: pa.Table):
        side, ids, bits = t["side"].to_numpy(), t["id"].to_numpy(), t["bits"].to_numpy().view(np.uint64)
        h, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        keep = np.zeros(len(side), bool)
        for a in range(0, len(h), 64):
            x = h[a : a + 64]
            near = (np.bitwise_count(bits[x][:, None] ^ bits[q][None]) <= bound) & (ids[x][:, None] != ids[q][None])
            keep[x] = near.any(1)
            keep[q] |= near.any(0)
        yield from t.drop_columns(["bits"]).filter(pa.array(keep)).to_batches()

    def run(batches):
        return groups_of(batches, 3, settle)

    return dealt.mapInArrow(run, "key long, hb long, qb long, id long, home boolean, side int")


def linked(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """(id, n, root) rows from ``vectors(id, copies, label, v)``, ids unique:
    parts of each id's number of links, and an id it is connected to."""
    held = pa.schema([("id", pa.int64()), ("homes", pa.list_(pa.int64())), ("probed", pa.list_(pa.int64())), ("bits", pa.int64())])

    def hashed(batches):
        for b in batches:
            v = b.column(2)
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for size in np.unique(sizes):
                some = np.flatnonzero(sizes == size)
                x = flat[starts[some][:, None] + np.arange(size)].astype(np.float64)
                x = x / np.abs(x).max(1)[:, None]
                x = x / np.sqrt((x * x).sum(1))[:, None]
                homes, probed = cells(x, b.column(1).to_numpy()[some], tables, probes, scale)
                put = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.size // len(a), dtype=np.int32), a.reshape(-1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), put(homes), put(probed), pa.array(signs(x))], schema=held)

    keys = cut(vectors.select("id", "label", "v").mapInArrow(hashed, "id long, homes array<long>, probed array<long>, bits long"))
    places = keys.select("id", F.explode("homes").alias("key"), F.lit(True).alias("home")).unionByName(keys.select("id", F.explode("probed").alias("key"), F.lit(False).alias("home")))
    sizes = places.groupBy("key").agg(F.sum(F.col("home").cast("long")).alias("h"), F.count(F.lit(1)).alias("q")).where("h > 0 and q > 1")
    met = places.join(sizes, "key")
    cut_to = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.ceil(F.col(n) / block))
    # A row that lives in the cell is on both sides: once against each block of the other side.
    as_home = met.where("home").select("id", "key", "home", F.lit(0).alias("side"), cut_to("h", 0).alias("hb"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("q") / block) - 1)).alias("qb"))
    as_query = met.select("id", "key", "home", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("h") / block) - 1)).alias("hb"), cut_to("q", 1).alias("qb"))
    # Vectors are not shipped until their signs say that a cell holds a likely partner.
    narrow = as_home.unionByName(as_query).join(keys.select("id", "bits"), "id").select("key", "hb", "qb", "id", "home", "side", "bits")
    dealt = cut(screened(narrow.repartition("key", "hb", "qb").sortWithinPartitions("key", "hb", "qb"), least))
    full = vectors.select("id", "copies", "v").join(keys.drop("bits"), "id")
    dealt = dealt.join(full, "id").select("key", "hb", "qb", "id", "copies", "home", "side", "v", "homes", "probed")
    dealt = dealt.repartition("key", "hb", "qb").sortWithinPartitions("key", "hb", "qb")
    out = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def settle(t: pa.Table):
        if got := _meet(t, least):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], schema=out)

    return dealt.mapInArrow(lambda batches: groups_of(batches, 3, settle), "id long, n long, root long")


def embedding_groups(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, **how) -> DataFrame:
    """One row per row of ``table``: id, n_links (other ids linked directly),
    component_id (smallest id reachable), kept."""
    rows = cut(_labelled(table, id_col, vector_col, label_col))
    once = rows.where("sound").select("id", "label", "v").distinct()
    classes = cut(once.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    vectors = classes.groupBy("rep").agg(F.min(F.struct("label", "v", "copies")).alias("x")).select(F.col("rep").alias("id"), "x.copies", "x.label", "x.v")
    got = cut(linked(vectors, least, **how))
    links = got.groupBy("id").agg(F.sum("n").alias("n"))
    comps = components(got.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst")).distinct())
    told = classes.join(links, classes["rep"] == links["id"], "left").drop("id").join(comps, F.col("rep") == comps["id"], "left")
    told = told.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")).where("n_links > 0 or component_id is not null")
    key = F.when(F.col("sound"), F.struct("label", "v"))
    out = rows.join(told.select(F.struct("label", "v").alias("k"), "n_links", "component_id"), key == F.col("k"), "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
