"""E8 lattice hashing against brute force."""

import numpy as np

from quillon.llm.lattice import embedding_groups, minimal_vectors, nearest_point

SCHEMA = "vec_id long, embedding array<float>, label int, n long, id string"


def brute(rows, least=0.98):
    """{id: (links, component)}"""
    ids = [r[0] for r in rows]
    links, comp = {i: set() for i in ids}, {}
    ok = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    v = np.array([r[1] for r in ok], np.float32).astype(float)
    c = v @ v.T / np.sqrt((v * v).sum(1))[:, None] / np.sqrt((v * v).sum(1))[None]
    lab = np.array([r[2] for r in ok])
    for a, b in zip(*np.nonzero((c >= least) & (lab[:, None] == lab[None]))):
        if ok[a][0] != ok[b][0]:
            links[ok[a][0]].add(ok[b][0])
    for i in sorted(ids):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += links[x]
    return {i: (len(links[i]), comp[i]) for i in ids}


def found(df):
    rows = df.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}


def test_decoder():
    g = np.random.default_rng(0)
    x = g.standard_normal((500, 8)) * 2
    near = nearest_point(x)
    d = ((x - near) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all()  # the covering radius
    assert all((d <= ((x - near - m) ** 2).sum(1) + 1e-9).all() for m in minimal_vectors())


def test_against_brute_force(spark):
    g = np.random.default_rng(1)
    rows = []
    for i in range(600):
        rows.append([i, g.standard_normal(64), i % 4])
    for i in range(300):  # near copies around and over the threshold
        base = rows[i % 40][1]
        rows.append([1000 + i, base + g.standard_normal(64) * g.uniform(0.02, 0.25), rows[i % 40][2]])
    for i in range(700):  # one hot group, several blocks
        rows.append([5000 + i, rows[3][1] + g.standard_normal(64) * 0.06, 3])
    rows += [[9000 + i, rows[0][1], 0] for i in range(30)] + [[9100, rows[0][1], 1], [9101, rows[0][1], None]]
    rows = [[i, [float(np.float32(x)) for x in v], lab] for i, v, lab in rows]
    rows += [[9200, None, 1], [9201, [0.0] * 64, 1], [9202, [float("nan")] * 64, 1], [9203, [None] + [1.0] * 63, 1], [9204, [float("inf")] + [1.0] * 63, 1], [9205, [1.0, 2.0], 1], [9206, [1.0, 2.0], 1], [9207, [], 1]]
    table = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], SCHEMA).repartition(4)
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 64])
    want |= {9205: (1, 9205), 9206: (1, 9205), 9207: (0, 9207)}
    assert found(embedding_groups(table, block=128)) == want


def test_edges(spark):
    assert embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    v = [1.0] * 8
    rows = [(1, v, 1, 1, "x"), (1, v, 1, 1, "x"), (2, v, 1, 1, "x"), (None, v, 1, 1, "x")]
    got = sorted(tuple(r) for r in embedding_groups(spark.createDataFrame(rows, SCHEMA)).where("vec_id is not null").collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
