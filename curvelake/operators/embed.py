"""Neighbours, clusters and low-dimensional maps of vectors.

Nearest neighbours and k-means run distributed. Methods whose result needs a whole distance matrix (diffusion map,
PHATE-like map, classical scaling, Isomap, UMAP-like map, linkage, DBSCAN) are fitted on a bounded sample of real rows (FIT of
them, of smallest seeded hash) and every row of the table is then placed beside the fitted rows it is nearest to, in one
distributed pass: a table of up to FIT rows is fitted whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 4000
FIT, PLACED_BY = 800, 5  # rows a map is fitted on; fitted rows that place another
QUERY_BLOCK = 4096


def matrix(df: DataFrame, key: str, vector: str) -> tuple[list, np.ndarray]:
    """(keys, rows) of a bounded table, ordered by key."""
    rows = df.select(key, vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull()).orderBy(key).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rows; draw a sample first")
    return [r[0] for r in rows], np.array([r[1] for r in rows], float).reshape(len(rows), -1)


def fitted_rows(df: DataFrame, key: str, vector: str, most: int = FIT, seed: int = 0) -> tuple[list, np.ndarray]:
    """(keys, rows) of up to `most` rows of smallest seeded hash of their key, ordered by key."""
    some = df.select(key, vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull()).orderBy(F.xxhash64(F.lit(seed), key), key).limit(most).collect()
    some.sort(key=lambda r: r[0])
    return [r[0] for r in some], np.array([r[1] for r in some], float).reshape(len(some), -1)


def place_all(df: DataFrame, key: str, vector: str, keys: list, rows: np.ndarray, values: np.ndarray, names: Sequence[str], how: str = "euclidean") -> DataFrame:
    """key and names: for every row of df the values of its fitted row, or what the PLACED_BY nearest fitted rows have, each
    weighed by the inverse of its distance. Rows with a null key or vector are left out; no fitted rows, no rows."""
    sent = df.sparkSession.sparkContext.broadcast(({k: i for i, k in enumerate(keys)}, rows, np.asarray(values, float).reshape(len(keys), len(names))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, x, y = sent.value
        for batch in batches:
            batch = batch.dropna()
            if not len(batch) or not len(x):
                continue
            d = distances(np.stack(batch[vector].to_numpy()).astype(float), x, how)
            near = np.argsort(d, 1, kind="stable")[:, :PLACED_BY]
            w = 1 / np.maximum(np.take_along_axis(d, near, 1), 1e-9)
            out = (y[near] * (w / w.sum(1, keepdims=True))[:, :, None]).sum(1)
            own = np.array([of.get(k, -1) for k in batch[key]])
            out[own >= 0] = y[own[own >= 0]]
            yield pd.DataFrame({key: batch[key]} | {n: out[:, i] for i, n in enumerate(names)})

    return df.select(key, vector).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, " + ", ".join(f"{n} double" for n in names))


def label_all(df: DataFrame, key: str, vector: str, rows: np.ndarray, labels: np.ndarray, reach: float = np.inf, how: str = "euclidean") -> DataFrame:
    """key, cluster: for every row of df the label of the nearest fitted row that has one (not -1) within reach, else -1."""
    kept = np.flatnonzero(np.asarray(labels) >= 0)
    sent = df.sparkSession.sparkContext.broadcast((rows[kept], np.asarray(labels)[kept]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = sent.value
        for batch in batches:
            batch = batch.dropna()
            if len(batch):
                d = distances(np.stack(batch[vector].to_numpy()).astype(float), x, how) if len(x) else np.full((len(batch), 1), np.inf)
                near = d.argmin(1)
                yield pd.DataFrame({key: batch[key], "cluster": np.where(d[np.arange(len(d)), near] <= reach, y[near] if len(y) else -1, -1).astype(np.int32)})

    return df.select(key, vector).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, cluster int")


def distances(a: np.ndarray, b: np.ndarray, how: str = "euclidean") -> np.ndarray:
    """All distances of rows of a and b: euclidean, manhattan, cosine, correlation, or hellinger of non-negative rows."""
    if how == "manhattan":
        return np.stack([np.abs(b - row).sum(1) for row in a]) if len(a) else np.zeros((0, len(b)))
    if how == "hellinger":
        return distances(np.sqrt(a), np.sqrt(b)) / np.sqrt(2)
    if how in ("cosine", "correlation"):
        if how == "correlation":
            a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        return 1 - a @ b.T
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))


def nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, how: str = "euclidean") -> DataFrame:
    """query, neighbour, distance, place: the exact k nearest rows of each query, itself left out, ties by key.

    Queries travel in blocks of QUERY_BLOCK to wherever the rows are; every batch of rows keeps its own k best per query,
    so what is shuffled is k rows per query and task, and no pair leaves a task that can't be among the k.
    """
    asked = queries.select(key, vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    spark, found = df.sparkSession, None
    n = asked.count()
    for block in range(max(1, -(-n // QUERY_BLOCK))):
        part = asked if n <= QUERY_BLOCK else asked.where(F.pmod(F.xxhash64(key), F.lit(-(-n // QUERY_BLOCK))) == block)
        rows = part.orderBy(key).collect()
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float).reshape(len(rows), -1)))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            for batch in batches:
                batch = batch.dropna()
                if not len(batch) or not len(ids):
                    continue
                own = batch[key].to_numpy()
                dist = distances(q, np.stack(batch[vector].to_numpy()).astype(float), how)
                dist[ids[:, None] == own[None, :]] = np.inf
                order = np.lexsort((np.broadcast_to(own, dist.shape), dist), axis=1)[:, :k]
                keep = np.take_along_axis(dist, order, 1)
                out = pd.DataFrame({"query": np.repeat(ids, order.shape[1]), "neighbour": own[order].ravel(), "distance": keep.ravel()})
                yield out[np.isfinite(out["distance"])]

        got = df.select(key, vector).mapInPandas(search, f"query {dict(df.dtypes)[key]}, neighbour {dict(df.dtypes)[key]}, distance double")
        found = got if found is None else found.unionByName(got)
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def k_means(df: DataFrame, key: str, vector: str, k: int, seed: int = 0, rounds: int = 20) -> DataFrame:
    """key, cluster: Lloyd's algorithm from k rows of smallest seeded hash; clusters numbered by size, then by centre.

    Each round is one distributed pass that sends k centres out and k sums back.
    """
    rows = df.select(key, vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    first = rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(k).collect()
    centres = np.array([r[1] for r in first], float)
    if not len(centres):
        return rows.select(key, F.lit(0).alias("cluster"))

    def label(c: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({key: batch[key], "cluster": distances(np.stack(batch[vector].to_numpy()).astype(float), c).argmin(1)})

        return run

    def sums(c: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros_like(c), np.zeros(len(c))
            for batch in batches:
                if len(batch):
                    m = np.stack(batch[vector].to_numpy()).astype(float)
                    near = distances(m, c).argmin(1)
                    np.add.at(total, near, m)
                    n += np.bincount(near, minlength=len(c))
            yield pd.DataFrame({"cluster": np.arange(len(c)), "n": n, "total": list(total)})

        return run

    n = np.zeros(len(centres))
    for _ in range(rounds):
        got = rows.mapInPandas(sums(centres), "cluster int, n double, total array<double>").toPandas()  # k rows a task
        total, n = np.zeros_like(centres), np.zeros(len(centres))
        for c, m, t in zip(got["cluster"], got["n"], got["total"]):
            total[c] += t
            n[c] += m
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        moved, centres = np.abs(new - centres).max(), new
        if moved < 1e-9:
            break
    rank = sorted(range(len(centres)), key=lambda i: (-n[i], tuple(centres[i])))
    return rows.mapInPandas(label(centres[rank]), f"{key} {dict(df.dtypes)[key]}, cluster int")


def components(n: int, a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Smallest index of each node's connected component."""
    label = np.arange(n)
    a, b = np.asarray(a, int), np.asarray(b, int)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def dbscan(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Cluster of each row, -1 for noise: core rows have `least` rows within eps, themselves among them; clusters are
    numbered by size, then by their first row; a border row joins its nearest core."""
    d = distances(x, x)
    core = (d <= eps).sum(1) >= least
    i, j = np.nonzero(np.triu(d <= eps, 1) & core[:, None] & core[None, :])
    label = np.where(core, components(len(x), i, j), -1)
    for r in np.flatnonzero(~core):
        near = np.flatnonzero(core & (d[r] <= eps))
        if len(near):
            label[r] = label[near[d[r, near].argmin()]]
    order = sorted({c for c in label if c >= 0}, key=lambda c: (-(label == c).sum(), c))
    return np.array([order.index(c) if c >= 0 else -1 for c in label], int)


def silhouette(d: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette from a distance matrix; single members count 0; under two clusters 0."""
    names = np.unique(label)
    if len(names) < 2:
        return 0.0
    to = np.stack([d[:, label == c].sum(1) for c in names], 1)
    size = np.array([(label == c).sum() for c in names])
    own = np.searchsorted(names, label)
    rows = np.arange(len(label))
    inner = to[rows, own] / np.maximum(size[own] - 1, 1)
    mean = to / size
    mean[rows, own] = np.inf
    outer = mean.min(1)
    return float(np.where(size[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0).mean())


def linkage(d: np.ndarray, how: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of a distance matrix by single, complete, average or Ward linkage; new clusters are n, n + 1, ..."""
    n = len(d)
    work = d.astype(float).copy() ** (2 if how == "ward" else 1)
    np.fill_diagonal(work, np.inf)
    name, size, alive, out = list(range(n)), np.ones(n), np.ones(n, bool), []
    for step in range(n - 1):
        live = np.flatnonzero(alive)
        sub = work[np.ix_(live, live)]
        i, j = divmod(int(sub.argmin()), len(live))
        a, b = live[min(i, j)], live[max(i, j)]
        height, na, nb = work[a, b], size[a], size[b]
        rest = live[(live != a) & (live != b)]
        da, db, nr = work[a, rest], work[b, rest], size[rest]
        if how == "single":
            new = np.minimum(da, db)
        elif how == "complete":
            new = np.maximum(da, db)
        elif how == "average":
            new = (na * da + nb * db) / (na + nb)
        else:
            new = ((na + nr) * da + (nb + nr) * db - nr * height) / (na + nb + nr)
        work[a, rest] = work[rest, a] = new
        out.append((min(name[a], name[b]), max(name[a], name[b]), float(np.sqrt(height) if how == "ward" else height), int(na + nb)))
        name[a], size[a], alive[b] = n + step, na + nb, False
    return out


def cut_tree(merges: Sequence[tuple[int, int, float, int]], n: int, height: float) -> np.ndarray:
    """Cluster of each leaf when all merges up to height are made; numbered by size, then by first leaf."""
    of = {i: [i] for i in range(n)}
    label = np.arange(n)
    for step, (a, b, h, _) in enumerate(merges):
        of[n + step] = of.pop(a) + of.pop(b)
        if h <= height:
            label[of[n + step]] = min(of[n + step])
    order = sorted(set(label.tolist()), key=lambda c: (-(label == c).sum(), c))
    return np.array([order.index(c) for c in label])


def adaptive_kernel(d: np.ndarray, k: int = 15, alpha: float = 1.0) -> np.ndarray:
    """Row-stochastic diffusion kernel of a distance matrix, sparse over each row's k nearest rows and itself.

    A pair's weight is exp(-d^2 / (w_i w_j)) with the distances to either row's k-th neighbour as widths (the median
    positive distance where that is 0), kept where j is among i's neighbours, averaged over both directions, and
    corrected by the density to the power alpha on either side.
    """
    n = len(d)
    if not n:
        return np.zeros((0, 0))
    k = max(2, min(k, n - 1))
    near = np.argsort(d, 1, kind="stable")[:, : k + 1]
    width = d[np.arange(n), near[:, -1]]
    positive = d[np.triu_indices(n, 1)]
    positive = positive[np.isfinite(positive) & (positive > 0)]
    width = np.maximum(np.where(np.isfinite(width) & (width > 0), width, np.median(positive) if len(positive) else 1.0), 1e-12)
    rows = np.repeat(np.arange(n), near.shape[1])
    w = np.zeros((n, n))
    w[rows, near.ravel()] = np.exp(-np.minimum(d[rows, near.ravel()] ** 2 / (width[rows] * width[near.ravel()]), 700.0))
    w = (w + w.T) / 2
    density = np.maximum(w.sum(1), 1e-12) ** alpha
    w = w / np.outer(density, density)
    return w / np.maximum(w.sum(1, keepdims=True), 1e-12)


def diffusion_map(p: np.ndarray, dims: int = 2, t: int = 1, normalised: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, eigenvalues) of a row-stochastic kernel, the constant one left out.

    Plain: eigenvectors of its symmetric part, scaled by the eigenvalue (0 where negative) to the power t. Normalised: those of
    the symmetric-normalised operator over the root of the degree. The largest entry of each is positive.
    """
    s = (p + p.T) / 2
    degree = s.sum(1)
    op = s / np.sqrt(np.outer(degree, degree)) if normalised else s
    values, vectors = np.linalg.eigh(op)
    order = np.argsort(-values)[1 : dims + 1]
    v = vectors[:, order] / (np.sqrt(degree)[:, None] if normalised else 1.0)
    v *= np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return v * np.maximum(values[order], 0.0) ** t, values[order]


def classical_scaling(d: np.ndarray, dims: int = 2) -> np.ndarray:
    """Coordinates whose distances come nearest to d by double centring."""
    n = len(d)
    j = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ d**2 @ j)
    order = np.argsort(-values)[:dims]
    v = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    return v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


def potential_map(p: np.ndarray, dims: int = 2, t: int = 3) -> np.ndarray:
    """PHATE-like: distances of the centred potentials -log p^t, scaled classically."""
    u = -np.log(np.maximum(np.linalg.matrix_power(p, t), 1e-12))
    return classical_scaling(distances(u - u.mean(1, keepdims=True), u - u.mean(1, keepdims=True)), dims)


def entropy_curve(p: np.ndarray, most: int = 20) -> np.ndarray:
    """Von Neumann entropy of the kernel's powers 1 to most."""
    values = np.abs(np.linalg.eigvalsh((p + p.T) / 2))
    out = []
    for t in range(1, most + 1):
        w = values**t / max((values**t).sum(), 1e-300)
        out.append(float(-(w[w > 0] * np.log(w[w > 0])).sum()))
    return np.array(out)


def isomap(d: np.ndarray, k: int = 12, dims: int = 2) -> np.ndarray:
    """Classical scaling of shortest paths over the symmetric graph of k neighbours; parts without a path lie twice the largest apart."""
    g = shortest_paths(neighbour_graph(d, k))
    top = g[np.isfinite(g)].max() if len(g) else 0.0
    return classical_scaling(np.where(np.isfinite(g), g, 2 * top), dims)


def fuzzy_graph(d: np.ndarray, k: int = 15) -> np.ndarray:
    """Symmetric membership strengths of k neighbours: 1 at the nearest, summing to log2 k by each row's own width."""
    n = len(d)
    k = min(k, n - 1)
    near = np.argsort(d + np.diag(np.full(n, -1.0)), 1, kind="stable")[:, 1 : k + 1]
    dist = np.take_along_axis(d, near, 1)
    rho = dist[:, :1]
    lo, hi = np.zeros((n, 1)), np.full((n, 1), max(dist.max(), 1e-12) * 8)
    for _ in range(50):
        mid = (lo + hi) / 2
        high = np.exp(-(dist - rho) / np.maximum(mid, 1e-12)).sum(1, keepdims=True) > np.log2(k + 1e-9)
        hi, lo = np.where(high, mid, hi), np.where(high, lo, mid)
    w = np.zeros((n, n))
    w[np.arange(n)[:, None], near] = np.exp(-(dist - rho) / np.maximum((lo + hi) / 2, 1e-12))
    return w + w.T - w * w.T


def neighbour_map(d: np.ndarray, k: int = 15, dims: int = 2, min_dist: float = 0.1, rounds: int = 200, dens: float = 0.0, dens_share: float = 0.3) -> np.ndarray:
    """UMAP-like: a layout whose membership strengths 1 / (1 + a r^2b) come near those of the fuzzy graph.

    Start from the diffusion map, then full gradient steps of the cross entropy, so there is no random draw. dens: weight
    of the density term in the last dens_share of the rounds, the correlation of the rows' log local radii (mean squared
    distance, weighed by the memberships) in the table and in the layout.
    """
    n = len(d)
    w = fuzzy_graph(d, k)
    # a and b fit the curve that is 1 up to min_dist and falls off exponentially behind it.
    r = np.linspace(0.01, 3, 300)
    want = np.where(r < min_dist, 1.0, np.exp(-(r - min_dist)))
    a, b = min(((a, b) for a in np.linspace(0.2, 3, 57) for b in np.linspace(0.4, 2, 33)), key=lambda ab: ((1 / (1 + ab[0] * r ** (2 * ab[1])) - want) ** 2).sum())
    y = diffusion_map((w + np.eye(n)) / (w + np.eye(n)).sum(1, keepdims=True), dims)[0]
    flat = classical_scaling(d, dims)  # a little of it, as rows of a part of its own share one place in the diffusion map
    y = 10 * (y - y.mean(0)) / max(np.abs(y).max(), 1e-12) + flat / max(np.abs(flat).max(), 1e-12)
    for step in range(rounds):
        diff = y[:, None, :] - y[None, :, :]
        r2 = np.maximum((diff**2).sum(2), 1e-6)
        pull = w * a * b * r2 ** (b - 1) / (1 + a * r2**b)
        push = (1 - w) * b / ((0.001 + r2) * (1 + a * r2**b)) * min(1.0, 5.0 * k / n)
        np.fill_diagonal(push, 0)
        move = ((push - pull)[:, :, None] * diff).sum(1)
        if dens and step >= (1 - dens_share) * rounds:
            mass = np.maximum(w.sum(1), 1e-12)
            spread = np.maximum((w * r2).sum(1), 1e-12)
            standard = lambda x: (x - x.mean()) / max(x.std(), 1e-12)
            wide, here = standard(np.log(np.maximum((w * d**2).sum(1) / mass, 1e-12))), np.log(spread / mass)
            z = standard(here)
            slope = (wide - (wide * z).mean() * z) / (max(here.std(), 1e-12) * spread)
            move = move + dens * 2 * (w[:, :, None] * diff * (slope[:, None] + slope[None, :])[:, :, None]).sum(1)
        y = y + (1 - step / rounds) * np.clip(move, -4, 4) * 0.1
    return y


def neighbour_graph(d: np.ndarray, k: int = 12) -> np.ndarray:
    """Distances of the symmetric graph of k neighbours, infinite without an edge."""
    n = len(d)
    near = np.argsort(d, 1, kind="stable")[:, : min(k + 1, n)]
    g = np.full((n, n), np.inf)
    rows = np.arange(n)[:, None]
    g[rows, near] = d[rows, near]
    g = np.minimum(g, g.T)
    np.fill_diagonal(g, 0)
    return g


def shortest_paths(g: np.ndarray) -> np.ndarray:
    """All shortest path lengths by repeated relaxing through each node."""
    out = g.copy()
    for k in range(len(out)):
        np.minimum(out, out[:, k, None] + out[None, k, :], out=out)
    return out


def auto_clusters(d: np.ndarray, most: int = 12) -> tuple[np.ndarray, int]:
    """(labels, k): average linkage cut at the k of 2..most with the best silhouette less 0.04 per single member."""
    merges, n = linkage(d), len(d)
    best: tuple[float, int, np.ndarray] = (-np.inf, 1, np.zeros(n, int))
    for k in range(2, min(most, n - 1) + 1):
        label = cut_tree(merges, n, merges[n - k - 1][2])
        score = silhouette(d, label) - 0.04 * (np.bincount(label) == 1).sum()
        if score > best[0] + 1e-12:
            best = (score, k, label)
    return best[2], best[1]


def leaf_order(merges: Sequence[tuple[int, int, float, int]], n: int) -> list[int]:
    """The leaves from left to right, the first child of every merge before the second."""
    below = {n + step: (a, b) for step, (a, b, _, _) in enumerate(merges)}
    out: list[int] = []
    stack = [n + len(merges) - 1] if merges else list(range(n))[::-1]
    while stack:
        node = stack.pop()
        if node in below:
            stack += below[node][::-1]
        else:
            out.append(node)
    return out


def neighbour_overlap(a: np.ndarray, b: np.ndarray, k: int = 10) -> float:
    """Mean share of common k nearest neighbours in two embeddings of the same rows."""
    near = lambda x: np.argsort(distances(x, x) + np.diag(np.full(len(x), np.inf)), 1, kind="stable")[:, :k]
    return float(np.mean([len(set(p) & set(q)) / k for p, q in zip(near(a), near(b))]))


def gradient_field(x: np.ndarray, y: np.ndarray, f: np.ndarray, cells: int = 20, width: float = 0.1, ridge: float = 1e-12) -> np.ndarray:
    """cells x cells x 2 gradients of f by Gaussian-weighted local lines at cell centres; 0 where fewer than three rows weigh."""
    out = np.zeros((cells, cells, 2))
    sx, sy = np.ptp(x) or 1.0, np.ptp(y) or 1.0
    for i in range(cells):
        for j in range(cells):
            dx, dy = (x - x.min()) / sx - (i + 0.5) / cells, (y - y.min()) / sy - (j + 0.5) / cells
            w = np.exp(-(dx**2 + dy**2) / (2 * width**2))
            if (w > 1e-3).sum() >= 3:
                a = np.stack([np.ones_like(dx), dx * sx, dy * sy], 1)
                out[i, j] = np.linalg.solve(a.T @ (a * w[:, None]) + ridge * np.eye(3), a.T @ (w * f))[1:]
    return out


def gradient_map(df: DataFrame, x: str, y: str, f: str, cells: int = 20, width: float = 0.1, ridge: float = 1e-12) -> np.ndarray:
    """gradient_field over all rows of a table in which x, y and f are finite numbers, by sums of each cell's normal equations.

    Each task adds up its rows; cells * cells * 10 numbers a task are moved.
    """
    rows = df.select(*[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (f, "f"))])
    for c in ("x", "y", "f"):
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    r = rows.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if r["x0"] is None:
        return np.zeros((cells, cells, 2))
    x0, y0, sx, sy = r["x0"], r["y0"], (r["x1"] - r["x0"]) or 1.0, (r["y1"] - r["y0"]) or 1.0

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((cells, cells, 10))
        mid = (np.arange(cells) + 0.5) / cells
        for b in batches:
            u, v, value = (b["x"].to_numpy() - x0) / sx, (b["y"].to_numpy() - y0) / sy, b["f"].to_numpy()
            for i in range(cells):
                dx = u - mid[i]
                for j in range(cells):
                    dy = v - mid[j]
                    w = np.exp(-(dx**2 + dy**2) / (2 * width**2))
                    a, c = dx * sx, dy * sy
                    total[i, j] += [w.sum(), w @ a, w @ c, w @ (a * a), w @ (a * c), w @ (c * c), w @ value, w @ (a * value), w @ (c * value), (w > 1e-3).sum()]
        flat = total.reshape(-1, 10)
        yield pd.DataFrame({"cell": np.arange(len(flat), dtype=np.int32)} | {f"s{k}": flat[:, k] for k in range(10)})

    sums = rows.mapInPandas(part, "cell int, " + ", ".join(f"s{k} double" for k in range(10))).groupBy("cell").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(10)])
    out = np.zeros((cells, cells, 2))
    for cell, *s in sums.collect():  # cells * cells rows
        if s[9] >= 3:
            m = np.array([[s[0], s[1], s[2]], [s[1], s[3], s[4]], [s[2], s[4], s[5]]]) + ridge * np.eye(3)
            out[cell // cells, cell % cells] = np.linalg.solve(m, s[6:9])[1:]
    return out


def regrid(z: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Bilinear values of a grid on another number of even rows and columns."""
    r, c = np.linspace(0, z.shape[0] - 1, rows), np.linspace(0, z.shape[1] - 1, cols)
    across = np.stack([np.interp(c, np.arange(z.shape[1]), row) for row in z])
    return np.stack([np.interp(r, np.arange(z.shape[0]), col) for col in across.T], 1)


def smooth_periodic(z: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing of a grid that wraps at both sides, sigma in cells; the sum stays."""
    if sigma <= 0:
        return z.copy()
    out = z
    for axis in (0, 1):
        n = z.shape[axis]
        at = np.minimum(np.arange(n), n - np.arange(n))
        kernel = np.exp(-(at**2) / (2 * sigma**2))
        circ = np.stack([np.roll(kernel / kernel.sum(), i) for i in range(n)])
        out = circ @ out if axis == 0 else out @ circ.T
    return out


def polyline_position(df: DataFrame, x: str, y: str, path: Sequence[tuple[float, float]]) -> DataFrame:
    """df with s, the arc length of the nearest point of the path, and off, the distance to it; the first segment on ties. Rows
    that lack x or y have nulls."""
    near, start = [], 0.0
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(path, path[1:])):
        long2 = (x1 - x0) ** 2 + (y1 - y0) ** 2
        t = F.least(F.greatest(((F.col(x) - x0) * (x1 - x0) + (F.col(y) - y0) * (y1 - y0)) / (long2 or 1.0), F.lit(0.0)), F.lit(1.0))
        off = F.sqrt((F.col(x) - (x0 + t * (x1 - x0))) ** 2 + (F.col(y) - (y0 + t * (y1 - y0))) ** 2)
        near.append(F.struct(off.alias("off"), F.lit(i).alias("i"), (start + t * long2**0.5).alias("s")))
        start += long2**0.5
    best = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.array_min(F.array(*near)))
    return df.withColumn("_b", best).withColumn("s", F.col("_b.s")).withColumn("off", F.col("_b.off")).drop("_b")


def in_box(df: DataFrame, x: str, y: str, a: tuple[float, float], b: tuple[float, float]) -> DataFrame:
    """Rows inside the rectangle of two corners, in any order."""
    return df.where(F.col(x).between(min(a[0], b[0]), max(a[0], b[0])) & F.col(y).between(min(a[1], b[1]), max(a[1], b[1])))


def composite(df: DataFrame, axes: Sequence[str], name: str = "s") -> DataFrame:
    """df with name: the first principal component of the standardised axes, its sign that of the first axis; a row that lacks an
    axis has null. One aggregate for means and products, the rest a projection."""
    value = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double")) for c in axes]
    whole = df.select(*[v.alias(f"_{i}") for i, v in enumerate(value)]).dropna()
    p = range(len(axes))
    r = whole.agg(*[f(f"_{i}").alias(f"{n}{i}") for i in p for n, f in (("m", F.avg), ("d", F.stddev_samp))], *[F.corr(f"_{i}", f"_{j}").alias(f"r{i}_{j}") for i in p for j in p if i < j]).first()
    if r["m0"] is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    c = np.array([[1.0 if i == j else r[f"r{min(i, j)}_{max(i, j)}"] or 0.0 for j in p] for i in p])
    lead = np.linalg.eigh(np.nan_to_num(c))[1][:, -1]
    lead = lead * (-1 if lead[0] < 0 else 1)
    z = [(v - float(r[f"m{i}"])) / (float(r[f"d{i}"] or 0.0) or 1.0) for i, v in enumerate(value)]
    return df.withColumn(name, sum((zi * float(w) for zi, w in zip(z, lead)), F.lit(0.0)))


def path_coordinate(df: DataFrame, key: str, axes: Sequence[str], mode: str = "axis1", anchors: Sequence[Sequence[float]] = (), feature: str | None = None, most: int = FIT) -> DataFrame:
    """df with s, the place of each row along a path: axis1, axis2, axis3, the composite of xy, xz, yz or xyz, a feature, the
    straight line between two anchors, a polyline through several, or a geodesic, the shortest way over neighbouring rows
    from the first to the last anchor (over up to `most` rows of smallest hash). Anything that can't be told falls back to axis1.

    line, polyline and geodesic run in the plane of the first two axes.
    """
    letters = {"x": 0, "y": 1, "z": 2}
    if mode in ("xy", "xz", "yz", "xyz") and all(letters[c] < len(axes) for c in mode):
        return composite(df, [axes[letters[c]] for c in mode])
    if mode in ("axis1", "axis2", "axis3") and int(mode[-1]) <= len(axes):
        return df.withColumn("s", F.col(axes[int(mode[-1]) - 1]).cast("double"))
    if mode == "feature" and feature in df.columns:
        return df.withColumn("s", F.col(f"`{feature}`").cast("double"))
    if mode in ("line", "polyline", "geodesic") and len(anchors) >= 2 and len(axes) >= 2:
        path = [tuple(map(float, a[:2])) for a in anchors]
        if mode == "line":
            path = [path[0], path[-1]]
        if mode == "geodesic":
            _, x = fitted_rows(df.withColumn("_v", F.array(*[F.col(c).cast("double") for c in axes[:2]])).where(F.expr(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in axes[:2]))), key, "_v", most)
            path = geodesic(x, path[0], path[-1]) if len(x) else path
        if len(set(path)) > 1:
            return polyline_position(df, axes[0], axes[1], path).drop("off")
    return df.withColumn("s", F.col(axes[0]).cast("double"))


def geodesic(x: np.ndarray, start: tuple[float, float], end: tuple[float, float], k: int = 12) -> list[tuple[float, float]]:
    """The rows on the shortest way from the row nearest to start to that nearest to end, over the symmetric graph of k neighbours;
    both ends alone where there is none."""
    g = neighbour_graph(distances(x, x), k)
    a, b = (int(np.abs(x - np.array(p)).sum(1).argmin()) for p in (start, end))
    far, last, left = np.full(len(x), np.inf), np.full(len(x), -1), set(range(len(x)))
    far[a] = 0.0
    while left:
        i = min(left, key=lambda i: (far[i], i))
        if i == b or not np.isfinite(far[i]):
            break
        left.discard(i)
        closer = far[i] + g[i] < far
        far[closer], last[closer] = far[i] + g[i][closer], i
    way = [b]
    while way[-1] != a and last[way[-1]] >= 0:
        way.append(int(last[way[-1]]))
    return [tuple(map(float, x[i])) for i in way[::-1]] if way[-1] == a else [start, end]
