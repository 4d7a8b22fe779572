import math

import numpy as np
import pytest

from curvelake.operators import curves as C
from curvelake.operators import embed as E
from curvelake.operators import features as X
from curvelake.operators import tables as T


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(c, 0.2, (20, 3)) for c in (0, 4, 9)])


def test_distances(blobs):
    a, b = blobs[:7], blobs[30:34]
    assert np.allclose(E.distances(a, b), np.linalg.norm(a[:, None] - b[None], axis=2))
    assert np.allclose(E.distances(a, b, "manhattan"), np.abs(a[:, None] - b[None]).sum(2))
    assert np.allclose(E.distances(a, b, "correlation")[0, 0], 1 - np.corrcoef(a[0], b[0])[0, 1])
    p = np.abs(a)
    assert np.allclose(E.distances(p, p, "hellinger"), np.linalg.norm(np.sqrt(p)[:, None] - np.sqrt(p)[None], axis=2) / np.sqrt(2), atol=1e-7)


def test_clusters(blobs):
    d = E.distances(blobs, blobs)
    label = E.dbscan(blobs, 1.0, 4)
    assert [len(set(label[i : i + 20])) for i in (0, 20, 40)] == [1, 1, 1] and len(set(label)) == 3
    assert E.dbscan(np.concatenate([blobs, [[99.0, 0, 0]]]), 1.0, 4)[-1] == -1
    for how in ("single", "complete", "average", "ward"):
        assert len(set(E.cut_tree(E.linkage(d, how), 60, 3.0))) == 3, how
    best, k = E.auto_clusters(d)
    assert k == 3 and E.silhouette(d, best) > 0.8 and E.silhouette(d, np.zeros(60, int)) == 0.0
    heights = [m[2] for m in E.linkage(d)]
    assert all(a <= b + 1e-9 for a, b in zip(heights, heights[1:]))


def test_maps(blobs):
    d = E.distances(blobs, blobs)
    flat = E.classical_scaling(d, 3)
    assert np.allclose(E.distances(flat, flat), d, atol=1e-5)
    p = E.adaptive_kernel(d)
    assert np.allclose(p.sum(1), 1) and len(E.entropy_curve(p)) == 20
    for c in (E.diffusion_map(p)[0], E.diffusion_map(p, normalised=True)[0], E.potential_map(p), E.isomap(d)):
        assert c.shape == (60, 2) and np.isfinite(c).all()
    g = E.shortest_paths(E.neighbour_graph(d, 59))
    assert np.allclose(g, d, atol=1e-6)
    assert E.neighbour_overlap(blobs, blobs * 2 + 1, 5) == 1.0


def test_diffusion_kernel_by_its_formula(blobs):
    d = E.distances(blobs, blobs)
    n, k, alpha = len(d), 7, 0.5
    near = [sorted(range(n), key=lambda j: (d[i, j], j))[: k + 1] for i in range(n)]
    width = [d[i, near[i][-1]] for i in range(n)]
    w = [[math.exp(-d[i, j] ** 2 / (width[i] * width[j])) if j in near[i] else 0.0 for j in range(n)] for i in range(n)]
    w = [[(w[i][j] + w[j][i]) / 2 for j in range(n)] for i in range(n)]
    q = [sum(row) ** alpha for row in w]
    w = np.array([[w[i][j] / (q[i] * q[j]) for j in range(n)] for i in range(n)])
    assert np.allclose(E.adaptive_kernel(d, k, alpha), w / w.sum(1, keepdims=True), atol=1e-9)
    assert (E.adaptive_kernel(d, k) == 0).sum() > n * n / 2  # sparse
    # Copies without any distance take the median positive distance as width.
    p = E.adaptive_kernel(E.distances(np.repeat(blobs[:3], 6, 0), np.repeat(blobs[:3], 6, 0)), 3)
    assert np.isfinite(p).all() and np.allclose(p.sum(1), 1)
    assert E.adaptive_kernel(np.zeros((0, 0))).shape == (0, 0)


def test_density_term_keeps_local_radii():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, s, (40, 3)) + c for s, c in ((0.1, 0), (2.0, 12))])
    d = E.distances(x, x)
    radius = lambda y: np.log(np.sort(E.distances(y, y), 1)[:, 1:8].mean(1) + 1e-9)
    plain, dense = (np.corrcoef(radius(x), radius(E.neighbour_map(d, 10, dens=w)))[0, 1] for w in (0.0, 2.0))
    assert dense > plain and dense > 0.5


def test_every_row_is_placed_beside_the_fitted_ones(spark, blobs):
    df = spark.createDataFrame([(i, [float(v) for v in r], "clash") for i, r in enumerate(blobs)] + [(99, None, "clash"), (None, [0.0, 0.0, 0.0], "clash")], "id int, vec array<double>, c1 string")
    keys, x = E.fitted_rows(df, "id", "vec", 30)
    assert len(keys) == 30 and keys == sorted(keys) and np.allclose(x, blobs[keys])
    made = E.place_all(df, "id", "vec", keys, x, x, ["c1", "c2", "c3"]).toPandas().sort_values("id")
    assert made["id"].tolist() == list(range(60))
    got = made[["c1", "c2", "c3"]].to_numpy()
    assert np.allclose(got[keys], blobs[keys]) and np.abs(got - blobs).max() < 1.5
    label = E.label_all(df, "id", "vec", x, np.array(keys) // 20).toPandas().set_index("id").cluster
    assert all(label[i] == i // 20 for i in range(60))
    assert set(E.label_all(df, "id", "vec", x, np.full(30, -1)).toPandas().cluster) == {-1}
    assert E.place_all(df.limit(0), "id", "vec", [], x[:0], x[:0], ["a"]).count() == 0


def curves(rng, n, sizes):
    rows = []
    for i in range(n):
        for metric, size in sizes.items():
            if rng.random() < 0.8:
                for cell in range(size):
                    if rng.random() < 0.9:
                        rows.append((f"v{i:02d}", metric, cell, float(rng.random() ** 3), "clash"))
    return rows


def test_nearest_curves_against_brute_force(spark):
    rng, sizes = np.random.default_rng(3), {"rg": 12, "phi": 9, "e2e": 5}
    rows = curves(rng, 24, sizes) + [("v00", "none", 0, 1.0, "x"), ("zero", "rg", 1, 0.0, "x"), ("neg", "rg", 1, -2.0, "x"), ("neg", "rg", 2, None, "x"), (None, "rg", 0, 1.0, "x")]
    df = spark.createDataFrame(rows, "variant string, metric string, cell int, p double, item string")
    sets = C.curve_sets(df, "variant", "metric", "cell", "p")
    asked = sets.where("variant IN ('v00', 'v07', 'zero')")
    mass = {}
    for v, metric, cell, p, _ in rows:
        if v and metric in sizes:
            mass.setdefault((v, metric), np.zeros(sizes[metric]))[cell] = max(p or 0.0, 0.0)
    mass = {k: np.maximum(m / m.sum(), 1e-15) for k, m in mass.items() if m.sum() > 0}
    mass = {k: m / m.sum() for k, m in mass.items()}

    def one(kind, p, q):
        m = (p + q) / 2
        if kind == "js":
            return math.sqrt(max(((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()) / 2, 0.0))
        if kind == "hellinger":
            return np.linalg.norm(np.sqrt(p) - np.sqrt(q)) / math.sqrt(2)
        if kind == "w1":
            return np.abs(np.cumsum(p) - np.cumsum(q)).sum() / len(p)
        u, at = np.linspace(0, 1, 256), np.arange(len(p)) + 0.5
        return math.sqrt(((np.interp(u, np.cumsum(p), at) - np.interp(u, np.cumsum(q), at)) ** 2).mean()) / len(p)

    names = sorted({v for v, _ in mass})
    got = {(r["kind"], r["query"], r["place"]): (r["item"], r["distance"]) for r in C.nearest_curves(sets, asked, "variant", sizes, 4).collect()}
    for kind in C.KINDS:
        pairs = {(a, b, m): one(kind, mass[a, m], mass[b, m]) for a in ("v00", "v07") for b in names for m in sizes if a != b and (a, m) in mass and (b, m) in mass}
        scale = {}
        for m in sizes:
            told = sorted(max(math.floor(x * 10_000 + 0.5), 1) for (_, _, k), x in pairs.items() if k == m and x > 1e-9)
            scale[m] = told[(len(told) + 1) // 2 - 1] / 10_000 if told else 1.0
        for a in ("v00", "v07"):
            mean = sorted((np.mean([pairs[a, b, m] / scale[m] for m in sizes if (a, b, m) in pairs]), b) for b in names if any((a, b, m) in pairs for m in sizes))
            assert [got[kind, a, i + 1][0] for i in range(4)] == [b for _, b in mean[:4]]
            assert np.allclose([got[kind, a, i + 1][1] for i in range(4)], [x for x, _ in mean[:4]], atol=1e-7)
    assert not any(k[1] == "zero" for k in got)
    small = C.nearest_curves(sets, asked, "variant", sizes, 4, block=1)
    assert {(r["kind"], r["query"], r["place"]): r["item"] for r in small.collect()} == {k: v[0] for k, v in got.items()}
    assert C.nearest_curves(sets.limit(0), asked, "variant", sizes).count() == 0 and C.nearest_curves(sets, asked.limit(0), "variant", sizes).count() == 0
    d = C.curve_matrix([r["curves"] for r in sets.where("variant < 'v09'").orderBy("variant").collect()], sizes)
    assert np.allclose(d, d.T) and (np.diag(d) == 0).all()


def test_medoids_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    m = rng.dirichlet(np.full(8, 0.5), 15)
    rows = [("rg", f"v{i:02d}", c, float(m[i, c])) for i in range(15) for c in range(8)] + [("one", "a", 0, 1.0)]
    got = C.medoids(spark.createDataFrame(rows, "metric string, variant string, cell int, mass double"), ["metric"], "variant", "cell", "mass").collect()
    d2 = 1 - np.sqrt(m) @ np.sqrt(m).T
    want = (d2.sum(1) - np.diag(d2)) / 14
    for r in got:
        if r["metric"] == "rg":
            assert abs(r["cohesion"] - want[int(r["variant"][1:])]) < 1e-8 and r["is_medoid"] == (int(r["variant"][1:]) == want.argmin())
        else:
            assert r["cohesion"] is None and r["is_medoid"]


def test_resamples_against_copies_of_the_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    rows = [(f"v{i}", float(a), float(b)) for i, (a, b) in enumerate(x)] + [("n", None, 1.0), ("i", float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "key string, a double, b double")
    ids = {r["key"]: r["h"] for r in df.selectExpr("key", "xxhash64(key) AS h").collect()}
    w = X.draws(np.array([ids[f"v{i}"] for i in range(300)]), 40)
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1
    one = np.column_stack([np.ones(300), x])
    got = X.resampled_grams(df, "key", ["a", "b"], 40)
    assert got.shape == (40, 1, 3, 3) and np.allclose(got[:, 0], np.einsum("ir,ij,ik->rjk", w, one, one))
    halves = X.resampled_grams(df, "key", ["a", "b"], 7, "split_half")
    assert np.allclose(halves.sum(1), one.T @ one) and (np.abs(halves[:, 0, 0, 0] - 150) < 50).all()
    assert (X.resampled_grams(df.limit(0), "key", ["a", "b"], 3) == 0).all()


def test_pca_stability_against_the_scores(spark, blobs):
    x = np.column_stack([blobs, blobs @ [1.0, 2.0, -1.0] + np.random.default_rng(1).normal(0, 0.5, 60)])
    df = spark.createDataFrame([(i, *[float(v) for v in r]) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    runs = X.pca_stability(df, "id", names, 2, 8, "bootstrap", 0.8)
    grams = X.resampled_grams(df, "id", names, 8, "bootstrap", 0.8)
    base = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :2]
    for r, g in zip(runs, grams[:, 0]):
        m = g[0, 1:] / g[0, 0]
        c = (g[1:, 1:] / g[0, 0] - np.outer(m, m)) / np.outer(x.std(0, ddof=1), x.std(0, ddof=1))
        load = np.linalg.eigh(c)[1][:, ::-1][:, :2]
        assert abs(r["disparity"] - X.procrustes(z @ base, z @ load)[0]) < 1e-6 and np.allclose(r["cosines"], X.aligned(base, load))
    assert len(X.pca_stability(df, "id", names, 2, 1)) == 5 and all(r["disparity"] >= 0 for r in X.pca_stability(df, "id", names, 2, 6))


def test_nearest_information_of_known_laws():
    rng = np.random.default_rng(0)
    for rho in (0.0, 0.6, 0.9):
        x, y = rng.multivariate_normal([0, 0], [[1, rho], [rho, 1]], 1500).T
        assert abs(X.nearest_information(x, y * 40 + 3) - -0.5 * np.log(1 - rho**2)) < 0.08
    m = X.information_matrix(np.column_stack([x, y, x**3, rng.normal(size=1500)]))
    assert np.allclose(m, m.T) and m[0, 2] > 0.5 and m[0, 3] < 0.05 and (np.diag(m) == 1).all()
    assert (X.information_matrix(np.full((9, 2), np.nan)) == np.eye(2)).all() and X.nearest_information(x[:3], y[:3]) == 0.0


def test_paths(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3)) @ np.array([[1.0, 0.8, 0.1], [0, 0.6, 0.2], [0, 0, 1.0]])
    df = spark.createDataFrame([(i, *[float(v) for v in r], float(i)) for i, r in enumerate(x)] + [(99, None, 1.0, 1.0, 7.0)], "id int, x double, y double, z double, f double")
    at = lambda mode, **k: {r["id"]: r["s"] for r in E.path_coordinate(df, "id", ["x", "y", "z"], mode, **k).collect()}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    lead = np.linalg.svd(z)[2][0]
    lead *= np.sign(lead[0])
    got = at("xyz")
    assert np.allclose([got[i] for i in range(80)], z @ lead, atol=1e-9) and got[99] is None
    assert at("axis3")[5] == x[5, 2] and at("feature", feature="f")[99] == 7.0 and at("nonsense")[3] == x[3, 0] and at("line")[3] == x[3, 0]
    line = at("line", anchors=[(0, 0), (9, 9), (3, 4)])
    assert np.allclose([line[i] for i in range(80)], np.clip(x[:, :2] @ [0.6, 0.8], 0, 5))
    ring = np.array([[np.cos(a), np.sin(a)] for a in np.linspace(0, np.pi, 40)])
    way = E.geodesic(ring, (1, 0), (-1, 0), 2)
    assert way[0] == (1.0, 0.0) and len(way) >= 20 and abs(sum(math.dist(p, q) for p, q in zip(way, way[1:])) - np.pi) < 0.01
    assert E.geodesic(np.array([[0.0, 0], [0, 1], [50, 0], [50, 1]]), (0, 0), (50, 0), 1) == [(0, 0), (50, 0)]
    assert set(at("geodesic", anchors=[(-1, -1), (1, 1)])) == set(range(80)) | {99}


def test_leaf_order(blobs):
    merges = E.linkage(E.distances(blobs, blobs))
    order = E.leaf_order(merges, 60)
    assert sorted(order) == list(range(60)) and [len({i // 20 for i in order[k : k + 20]}) for k in (0, 20, 40)] == [1, 1, 1]
    assert E.leaf_order([], 1) == [0] and E.leaf_order([(0, 1, 1.0, 2), (2, 3, 2.0, 3)], 3) == [2, 0, 1]


def test_neighbour_map_keeps_groups(blobs):
    d = E.distances(blobs, blobs)
    w = E.fuzzy_graph(d, 8)
    assert np.allclose(w, w.T) and w.max() <= 1 + 1e-12
    y = E.neighbour_map(d, 8)
    assert E.silhouette(E.distances(y, y), np.repeat([0, 1, 2], 20)) > 0.6


def test_grids():
    z = np.zeros((8, 8))
    z[0, 0] = 1
    s = E.smooth_periodic(z, 1.0)
    assert abs(s.sum() - 1) < 1e-9 and abs(s[7, 0] - s[1, 0]) < 1e-12 and s[0, 0] == s.max()
    assert np.allclose(E.regrid(np.add.outer(np.arange(3.0), np.arange(5.0)), 5, 9)[1, 1], 1.0)
    rng = np.random.default_rng(1)
    x, y = rng.random(300), rng.random(300)
    g = E.gradient_field(x, y, 2 * x - 3 * y, 5)
    assert np.allclose(g, [2, -3], atol=1e-6)


def test_gradients_of_a_table_are_those_of_all_its_rows(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=3000), rng.normal(size=3000) * 40
    f = np.sin(x) + 0.1 * y + rng.normal(size=3000)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, y, f)] + [(None, 1.0, 1.0), (float("inf"), 1.0, 1.0), (1.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, f double")
    assert np.allclose(E.gradient_map(df, "x", "y", "f", 6), E.gradient_field(x, y, f, 6), atol=1e-6)
    assert (E.gradient_map(df.limit(0), "x", "y", "f", 6) == 0).all()


def test_gradient_query_uses_all_rows(spark, sf):
    from curvelake.plans.common import feature_rows
    from curvelake.plans.reports import q_gradient

    names = ["kd_mean", "rg__mean", "e2e__mean"]
    rows = feature_rows(spark, sf).toPandas()[names]
    x, y, f = (rows[np.isfinite(rows.astype(float)).all(axis=1)][c].to_numpy(float) for c in names)
    got = q_gradient(spark, sf).toPandas().sort_values(["i", "j"])
    assert np.allclose(got[["gx", "gy"]].to_numpy().reshape(12, 12, 2), E.gradient_field(x, y, f, 12), atol=1e-5)


def test_neighbours_and_k_means(spark, blobs):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(blobs)] + [(99, None)], "id int, vec array<double>")
    got = E.nearest(df, df.where("id % 20 = 0"), "id", "vec", 3).toPandas()
    d = E.distances(blobs, blobs) + np.diag(np.full(60, np.inf))
    for q, part in got.groupby("query"):
        assert part.sort_values("place").neighbour.tolist() == np.argsort(d[q])[:3].tolist()
    label = E.k_means(df, "id", "vec", 3, seed=3).toPandas().sort_values("id").cluster.to_numpy()
    assert len(label) == 60 and E.silhouette(E.distances(blobs, blobs), label) > 0.3
    assert E.k_means(df.limit(0), "id", "vec", 3).count() == 0
    with pytest.raises(ValueError):
        E.matrix(spark.range(5000).selectExpr("id", "array(1.0d) AS vec"), "id", "vec")


def test_pca(spark, blobs):
    x = np.column_stack([blobs, blobs @ [1.0, 2.0, -1.0]])
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in x], "a double, b double, c double, d double")
    p = X.Pca(df, ["a", "b", "c", "d"])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(p.values, s**2 / 59, atol=1e-8) and p.reach(0.9999) <= 3 and 1 <= p.participation <= 4
    scores = np.array([tuple(r) for r in p.scores(df, 2, []).collect()])
    assert np.allclose(np.abs(scores), np.abs((z @ vt[:2].T)), atol=1e-6)
    assert np.allclose(X.aligned(p.vectors[:, :2], -p.vectors[:, [1, 0]]), 1)
    r = np.array([[np.cos(1), -np.sin(1)], [np.sin(1), np.cos(1)]])
    assert X.procrustes(blobs[:, :2], 3 * blobs[:, :2] @ r + 5)[0] < 1e-12


def test_choices_and_sets():
    r = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    assert X.uncorrelated(["a", "b", "c"], r, 0.5) == ["a", "c"] and X.chained_order(["a", "b", "c"], r) == ["a", "b", "c"]
    assert T.cover({"x": {1, 2}, "y": {2, 3, 4}, "z": {1}}, 5) == ["y", "x"] and T.cover({}, 2) == []
    assert T.select_tokens("b, z;a b", ["a", "b"]) == ["b", "a"]
    u = ["a", "b", "c"]
    assert [T.change_selection(["a"], ["b"], h, u) for h in ("set", "add", "remove", "toggle", "invert", "clear")] == [["b"], ["a", "b"], ["a"], ["a", "b"], ["b", "c"], []]
    assert [T.condensed_index(i, j, 4) for i in range(4) for j in range(i + 1, 4)] == list(range(6))


def test_transforms_and_designs(spark):
    rows = [("a", "g", v) for v in (1.0, 3.0, -2.0, None, float("nan"))] + [("b", None, 5.0), ("c", "g", 7.0)]
    df = spark.createDataFrame(rows, "column string, grp string, value double")
    z = {(r["column"], r["value"] if r["value"] == r["value"] else "nan"): r["z"] for r in X.transform(df, {"a": "log1p_zscore", "c": "zscore", "b": "none"}, scope="grp").collect()}
    p = np.log1p([1.0, 3.0, 0.0])
    assert np.allclose([z["a", 1.0], z["a", 3.0], z["a", -2.0]], (p - p.mean()) / p.std(ddof=1)) and z["a", None] is None and z["a", "nan"] is None and z["b", 5.0] == 5.0 and z["c", 7.0] == 0.0
    wide = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, None, 5.0, None), (4.0, 6.0, 5.0, 1.0), (None, None, 5.0, None)], "phi_res1 double, b double, flat double, few double")
    ready, kept = X.design(wide, ["phi_res1", "b", "flat", "few"])
    assert kept == ["phi_res1"] and ready.count() == 3
    assert X.viable(wide, ["b"], 2) == ["b"] and X.viable(wide, ["b"], 2, 0.1) == [] and X.viable(wide, []) == []
    scaled, names = X.balance_torsions(wide, ["phi_res1", "b", "flat"])
    assert abs(scaled.first()["phi_res1"] - 2**0.5) < 1e-12 and X.balance_torsions(wide, ["phi_res1", "b"], "exclude")[1] == ["b"]


def test_tab_input(spark):
    df = spark.createDataFrame([("rg", "nm", 0.1, 1.0, True), ("rg", "nm", 0.3, None, None), ("rg", "nm", 0.4, 3.0, True)], "metric string, coordinate_units string, effective_support_frac double, x_eqpop double, pmf_has_valid_probability boolean")
    made = X.tab_input(df, "pmf_intrinsic", {"effective_support_frac": "zscore"}, flags=["pmf_has_valid_probability", "none"])
    assert made["features"] == ["effective_support_frac"] and made["rows"].count() == 2 and "flag none is not in the table" in made["warnings"] and "local_ruggedness_kT" in made["missing"]
    assert X.tab_input(df, "pmf_annotations")["features"] == ["x_eqpop"]
