import numpy as np
import pandas as pd

from curvelake.llm import neighbours as N


def frame(spark, v, metric="m"):
    return spark.createDataFrame(pd.DataFrame({"metric": metric, "curve_id": np.arange(len(v)), "vec": [r.tobytes() for r in v.astype(np.float32)], "cell": 1, "rb": 2}))


def brute(v, k, least):
    s = v.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T
    np.fill_diagonal(s, -1)
    return {i: [j for j in sorted(range(len(v)), key=lambda j: (-round(s[i, j], 6), j))[:k] if j != i and (least is None or s[i, j] >= least)] for i in range(len(v))}


def unit(rng, n, dims=40):
    x = rng.dirichlet(np.full(dims, 0.3), n)
    return x


def recall(got, want):
    g = {k: set(q["neighbour_id"]) for k, q in got.groupby("curve_id")}
    return np.mean([len(set(w) & g.get(i, set())) / len(w) for i, w in want.items() if w])


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = unit(rng, 300)
    x = np.concatenate([x, x[:80] * np.exp(rng.normal(0, 0.05, (80, 40)))])
    v = np.sqrt(x / x.sum(1, keepdims=True))
    got = N.most_similar(frame(spark, v), 5, 0.98).toPandas()
    want = brute(v, 5, 0.98)
    assert recall(got, want) >= 0.98
    assert len(got) == sum(map(len, want.values()))


def test_any_similarity_against_brute_force(spark):
    v = np.sqrt(unit(np.random.default_rng(1), 400))
    assert recall(N.most_similar(frame(spark, v), 5, None, "curve_id % 20 = 0").toPandas(), {i: w for i, w in brute(v, 5, None).items() if i % 20 == 0}) >= 0.9


def test_cells_and_blocks_keep_recall(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 60)
    monkeypatch.setattr(N, "BLOCK", 50)
    rng = np.random.default_rng(2)
    x = unit(rng, 500)
    x = np.concatenate([x, x[:200] * np.exp(rng.normal(0, 0.04, (200, 40)))])
    v = np.sqrt(x / x.sum(1, keepdims=True))
    assert recall(N.most_similar(frame(spark, v), 5, 0.98).toPandas(), brute(v, 5, 0.98)) >= 0.9


def test_a_third_of_all_vectors_are_copies(spark):
    rng = np.random.default_rng(3)
    x = unit(rng, 200)
    v = np.sqrt(np.concatenate([x, np.repeat(x[:1], 100, 0), x[5:10]]))
    for least in (0.98, None):
        got = N.most_similar(frame(spark, v), 5, least).toPandas()
        assert recall(got, brute(v, 5, least)) == 1.0
        assert got.groupby("curve_id").size().max() <= 5


def test_a_hundred_ties_go_to_the_smaller_ids():
    """All rows are equally similar to the query, their ids fall along the block; windows are wide enough for all to collide."""
    rng = np.random.default_rng(8)
    away = rng.standard_normal((100, 40))
    query = np.abs(rng.standard_normal(40))
    query /= np.linalg.norm(query)
    away -= np.outer(away @ query, query)
    away /= np.linalg.norm(away, axis=1)[:, None]
    rows = np.round(0.995 * query + np.sqrt(1 - 0.995**2) * away, 3).astype(np.float32)
    rows = np.repeat(rows[:1], 100, 0)
    for threshold in (N.THRESHOLD, 0):
        _, found, sim = N.search(np.arange(100, 0, -1), rows, np.array([0]), query[None].astype(np.float32), 5, 0.2, 0.2, threshold=threshold)
        assert found.tolist() == [1, 2, 3, 4, 5] and np.ptp(sim) == 0


def test_exact_search_misses_nothing_across_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 60)
    v = np.sqrt(unit(np.random.default_rng(9), 400))
    got = N.most_similar(frame(spark, v), 5, None, "curve_id % 20 = 0", exact=True).toPandas()
    assert recall(got, {i: w for i, w in brute(v, 5, None).items() if i % 20 == 0}) == 1.0


def test_recall_in_whole_blocks():
    rng = np.random.default_rng(10)
    x = unit(rng, 2000)
    x = np.concatenate([x, x * np.exp(rng.normal(0, 0.05, x.shape))])
    v = np.sqrt(x / x.sum(1, keepdims=True)).astype(np.float32)
    asked = np.arange(0, 4000, 20)
    q, c, _ = N.search(np.arange(4000), v, asked, v[asked], 5, 0.2, 0.1)
    s = v[asked].astype(float) @ v.T.astype(float)
    s[np.arange(len(asked)), asked] = -1
    want = {(a, b) for i, a in enumerate(asked) for b in np.argsort(-s[i], kind="stable")[:5] if s[i, b] >= 0.98}
    assert len(want) > 100 and len(want & set(zip(q.tolist(), c.tolist()))) / len(want) >= 0.99


def test_dirty_readings_and_pairs(spark):
    nan, inf = float("nan"), float("inf")
    grid = spark.createDataFrame([("rg", 0.0, 0.1, 10, False)], "metric string, x_start double, x_step double, n_cells int, is_periodic boolean")
    shape = [0.1, 0.4, 0.3, 0.1, 0.05, 0.05]
    rows = [(c, "rg", 0.05 + 0.1 * k, p * c) for c in (1, 2) for k, p in enumerate(shape)]
    rows += [(1, "rg", 0.05, None), (1, "rg", 0.05, nan), (1, "rg", 0.95, inf), (2, "rg", 9.0, 5.0), (2, "rg", None, 5.0), (2, "rg", 0.85, -3.0), (None, "rg", 0.15, 7.0), (3, "rg", 0.5, 0.0), (4, None, 0.5, 1.0), (5, "rg", 0.95, 1.0)]
    curves = spark.createDataFrame([(*r, 1, 1.0) for r in rows], "curve_id bigint, metric string, x double, P double, cell int, v double")
    vectors = N.unit_vectors(curves, grid)
    assert sorted(r["curve_id"] for r in vectors.collect()) == [1, 2, 5]
    assert [tuple(r) for r in N.similar_pairs(vectors).collect()] == [(1, 2)]


def test_empty(spark):
    assert N.most_similar(frame(spark, np.zeros((1, 4))).limit(0)).count() == 0
