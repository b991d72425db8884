"""Statistics of small dense matrices, on numpy. Inputs are tables already
aggregated to a bounded number of rows (groups, codes, clusters)."""

from __future__ import annotations

import math

import numpy as np


def ward(x: np.ndarray) -> np.ndarray:
    """Ward linkage by Lance-Williams updates: rows (left, right, distance, size)."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    size, name, out = np.ones(n), list(range(n)), []
    for step in range(n - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        out.append((min(name[i], name[j]), max(name[i], name[j]), math.sqrt(d[i, j]), size[i] + size[j]))
        a, b = size[i], size[j]
        live = np.isfinite(d[i]) & np.isfinite(d[j])
        new = np.full(n, np.inf)
        new[live] = ((a + size[live]) * d[i, live] + (b + size[live]) * d[j, live] - size[live] * d[i, j]) / (a + b + size[live])
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        d[i, i] = np.inf
        size[i], name[i] = a + b, n + step
    return np.array(out).reshape(-1, 4)


def cut_tree(linkage: np.ndarray, k: int) -> np.ndarray:
    """Labels 1..k after the merges that leave k clusters, numbered by their
    first member."""
    n = len(linkage) + 1
    members = {i: [i] for i in range(n)}
    for s in range(n - k):
        a, b = int(linkage[s, 0]), int(linkage[s, 1])
        members[n + s] = members.pop(a) + members.pop(b)
    labels = np.zeros(n, int)
    for c, own in enumerate(sorted(members.values(), key=min), 1):
        labels[own] = c
    return labels


def silhouette(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """One value per row; 0 for the only member of a cluster."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    names = np.unique(labels)
    means = np.stack([d[:, labels == c].sum(1) for c in names], 1)
    sizes = np.array([(labels == c).sum() for c in names])
    out = np.zeros(len(x))
    for i in range(len(x)):
        c = np.flatnonzero(names == labels[i])[0]
        if sizes[c] < 2 or len(names) < 2:
            continue
        a = means[i, c] / (sizes[c] - 1)
        b = min(means[i, o] / sizes[o] for o in range(len(names)) if o != c)
        out[i] = (b - a) / max(a, b) if max(a, b) else 0.0
    return out


def adjusted_rand(a, b) -> float:
    a, b = np.asarray(a), np.asarray(b)
    table = np.array([[((a == x) & (b == y)).sum() for y in np.unique(b)] for x in np.unique(a)])
    two = lambda v: (v * (v - 1) / 2).sum()
    ij, i, j, n = two(table), two(table.sum(1)), two(table.sum(0)), len(a) * (len(a) - 1) / 2
    expected = i * j / n if n else 0.0
    return 1.0 if (i + j) / 2 == expected else float((ij - expected) / ((i + j) / 2 - expected))


def correspondence(counts: np.ndarray, components: int = 4) -> dict[str, np.ndarray]:
    """Principal coordinates of rows and columns, eigenvalues, inertia shares.
    Axis signs make each axis's largest column coordinate positive."""
    p = counts / counts.sum()
    r, c = p.sum(1), p.sum(0)
    s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    u, d, vt = np.linalg.svd(s, full_matrices=False)
    sign = np.sign(vt[np.arange(len(d)), np.abs(vt).argmax(1)])
    u, vt = u * sign, vt * sign[:, None]
    k = min(components, len(d))
    rows, cols = u[:, :k] * d[:k] / np.sqrt(r)[:, None], vt[:k].T * d[:k] / np.sqrt(c)[:, None]
    return {"rows": rows, "columns": cols, "eigenvalues": d[:k] ** 2, "inertia": d[:k] ** 2 / (d**2).sum(), "row_mass": r, "column_mass": c, "contributions": cols**2 * c[:, None] / np.where(d[:k] > 1e-12, d[:k] ** 2, np.inf)}


def project_rows(counts: np.ndarray, ca: dict[str, np.ndarray]) -> np.ndarray:
    """Supplementary rows on axes they took no part in."""
    profile = counts / counts.sum(1, keepdims=True)
    root = np.sqrt(ca["eigenvalues"])
    return profile @ (ca["columns"] / np.where(root > 1e-12, root, np.inf))


def louvain(n: int, edges: list[tuple[int, int, float]], rounds: int = 50) -> tuple[np.ndarray, float]:
    """Communities by greedy modularity moves and aggregation, nodes in order;
    labels numbered by first member, and the modularity."""
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] += x
        if a != b:
            w[b, a] += x
    total = w.sum()
    label, group, g = np.arange(n), np.arange(n), w
    if total:
        while True:
            own, k = np.arange(len(g)), g.sum(1)
            for _ in range(rounds):
                moved = False
                for i in range(len(g)):
                    links = np.bincount(own, np.where(np.arange(len(g)) == i, 0, g[i]), len(g))
                    weight = np.bincount(own, k, len(g))
                    weight[own[i]] -= k[i]
                    gain = links - k[i] * weight / total
                    best = int(np.argmax(gain))
                    if gain[best] > gain[own[i]] + 1e-12:
                        own[i], moved = best, True
                if not moved:
                    break
            names, own = np.unique(own, return_inverse=True)
            if len(names) == len(g):
                break
            group = own[group]
            fold = np.eye(len(names))[own]
            g = fold.T @ g @ fold
        label = group
    order = {c: i for i, c in enumerate(dict.fromkeys(label.tolist()))}
    label = np.array([order[c] for c in label.tolist()])
    k = w.sum(1)
    same = label[:, None] == label[None]
    return label, float(((w - np.outer(k, k) / total) * same).sum() / total) if total else 0.0


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row at least total cost (Hungarian method with
    potentials); rows beyond the columns get their nearest column."""
    n, m = cost.shape
    if n > m:
        back = assignment(cost.T)
        out = [int(cost[i].argmin()) for i in range(n)]
        for col, row in enumerate(back):
            out[row] = col
        return out
    u, v, way, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], np.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if now < low[j]:
                        low[j], way[j] = now, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def best_jaccard(base: np.ndarray, other: np.ndarray) -> dict[int, float]:
    """For each base cluster the best overlap with a cluster of the other."""
    return {int(c): max(float(((base == c) & (other == o)).sum() / ((base == c) | (other == o)).sum()) for o in np.unique(other)) for c in np.unique(base)}


def normal_p(b: float, se: float) -> float:
    return math.erfc(abs(b / se) / math.sqrt(2)) if se else float("nan")


def clustered(xtx: np.ndarray, xty: np.ndarray, scores: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and cluster-robust standard errors from moments: scores is
    a function's result per cluster (G, columns) at the coefficients."""
    beta = np.linalg.solve(xtx, xty)
    g = len(scores)
    inv = np.linalg.inv(xtx)
    cov = inv @ (scores.T @ scores) @ inv * (g / (g - 1) * (n - 1) / (n - k))
    return beta, np.sqrt(np.diag(cov))


def logit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray | None:
    """Maximum likelihood by reweighted least squares; None if it diverges."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weight * p * (1 - p)
        try:
            step = np.linalg.solve(x.T @ (x * w[:, None]) + 1e-9 * np.eye(len(beta)), x.T @ (weight * (y - p)))
        except np.linalg.LinAlgError:
            return None
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            return beta
    return beta if np.abs(beta).max() < 25 else None


