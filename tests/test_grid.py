import math

import numpy as np

from curvelake.operators import grid

PMF = "curve_id bigint, metric string, x double, P double, F_kJ_mol double, cell int, n_cells int"


def metrics(spark):
    return spark.createDataFrame([("rg", 0.0, 0.1, 20, False), ("phi", -180.0, 30.0, 12, True)], "metric string, x_start double, x_step double, n_cells int, is_periodic boolean")


def curves(spark, rows):
    return spark.createDataFrame([(*r, 99, 99) for r in rows], PMF)


def test_cells_bounds_and_turns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "rg", x, 1.0, 1.0) for x in (0.0, 0.1, 0.30000000000000004, 1.9999, 2.0, -0.1, None, nan, inf)] + [(2, "phi", x, 1.0, 1.0) for x in (-180.0, 180.0, 540.0, 179.9, -190.0)] + [(None, "rg", 0.5, 1.0, 1.0), (3, None, 0.5, 1.0, 1.0), (4, "zz", 0.5, 1.0, 1.0)]
    got = sorted((r["curve_id"], r["cell"]) for r in grid.in_cells(curves(spark, rows), metrics(spark), []).collect())
    assert got == [(1, 0), (1, 1), (1, 3), (1, 19), (2, 0), (2, 0), (2, 0), (2, 11), (2, 11)]


def test_every_cell_once_filled_and_marked(spark):
    rows = [(1, "rg", 0.05 + 0.1 * k, 0.5, math.sin(k / 3)) for k in range(20) if k not in (4, 5, 13)]
    rows += [(1, "rg", 0.45, 0.5, float("nan")), (1, "rg", 1.35, 0.5, None), (1, "rg", 0.05, 0.5, 0.0), (2, "rg", None, 1.0, 1.0), (3, "phi", 5.0, None, float("inf"))]
    got = grid.regular_grid(curves(spark, rows), metrics(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r["curve_id"], {})[r["cell"]] = r
    assert {c: len(v) for c, v in by.items()} == {1: 20, 2: 20, 3: 12}
    assert sorted(k for k, r in by[1].items() if r["F_kJ_mol_filled"]) == [4, 5, 13]
    assert all(abs(by[1][k]["F_kJ_mol"] - math.sin(k / 3)) < 0.1 for k in (4, 5, 13))
    assert all(r["F_kJ_mol"] is None and r["F_kJ_mol_filled"] for r in by[2].values())
    assert not by[1][4]["P_filled"]


def test_empty(spark):
    assert grid.regular_grid(curves(spark, []), metrics(spark)).count() == 0
    assert grid.regular_grid(curves(spark, [(1, "rg", 0.5, 1.0, 1.0)]), metrics(spark).limit(0)).count() == 0


def test_imputation_beats_straight_lines_on_waves():
    t = np.arange(80)
    whole = np.stack([np.sin(t / 4 + p) + 0.3 * np.cos(t / 2) for p in range(5)])
    rng = np.random.default_rng(1)
    gap = rng.random(whole.shape) < 0.25
    gap[:, :1] = gap[:, -1:] = False
    holes = np.where(gap, np.nan, whole)
    line = np.stack([np.interp(t, t[~g], w[~g]) for g, w in zip(gap, whole)])
    filled = grid.ssa_fill(holes, rounds=100)
    assert np.array_equal(filled[~gap], whole[~gap])
    assert np.abs(filled - whole)[gap].mean() < 0.6 * np.abs(line - whole)[gap].mean()


def test_few_values():
    nan = np.nan
    got = grid.ssa_fill(np.array([[nan] * 6, [nan, 2.0, nan, nan, nan, nan], [1.0, nan, 3.0, nan, nan, nan]]))
    assert np.isnan(got[0]).all() and (got[1] == 2).all() and got[2].tolist() == [1, 2, 3, 3, 3, 3]
    assert grid.ssa_fill(np.zeros((0, 5))).shape == (0, 5)


def test_filling_goes_on_until_it_settles():
    t = np.arange(60)
    rng = np.random.default_rng(3)
    whole = np.stack([np.sin(t / 5 + p) + 0.2 * rng.normal(size=60) for p in range(40)])
    whole[:, 20:32] = np.nan
    filled, settled = grid.ssa_settle(whole)
    assert settled.all() and not grid.ssa_settle(whole, rounds=30)[1].all()
    assert np.abs(filled - grid.ssa_settle(whole, rounds=30)[0]).max() > 0.05


def test_default_settles_more_than_thirty_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(c, "rg", 0.05 + 0.1 * k, 0.5, float(math.sin(k / 2 + c) + 0.3 * rng.normal())) for c in range(20) for k in range(20) if not 7 <= k < 12]
    got = grid.regular_grid(curves(spark, rows), metrics(spark)).toPandas().sort_values(["curve_id", "cell"])
    tall = got.F_kJ_mol.where(~got.F_kJ_mol_filled).to_numpy().reshape(20, 20)
    want, settled = grid.ssa_settle(tall)
    assert np.allclose(got.F_kJ_mol.to_numpy().reshape(20, 20), want) and (got.F_kJ_mol_settled.to_numpy().reshape(20, 20) == settled[:, None]).all()
    assert not np.allclose(want, grid.ssa_fill(tall, rounds=30), atol=1e-2) and got.P_settled.all()


def test_a_trend_at_the_end_settles_within_reach_of_the_readings():
    rng = np.random.default_rng(0)
    at = np.arange(60)
    series = np.stack([np.exp(at / 12.0) + rng.normal(0, 0.3, 60), 40 - 0.6 * at + rng.normal(0, 0.2, 60), np.sin(at / 5.0) * 3])
    holes = series.copy()
    holes[:, 50:] = np.nan
    holes[:, 20:24] = np.nan
    filled, settled = grid.ssa_settle(holes)
    low, high = np.nanmin(holes, 1, keepdims=True), np.nanmax(holes, 1, keepdims=True)
    reach = grid.REACH * (high - low)
    assert settled.all() and (filled >= low - reach - 1e-9).all() and (filled <= high + reach + 1e-9).all()
    assert np.abs(filled[:, 20:24] - series[:, 20:24]).max() < 0.15 * (high - low).max()
    assert np.array_equal(filled[:, 24:50], series[:, 24:50])
