"""Every query runs on the smallest tables, and those with SQL give the rows of the SQL."""

import pathlib

import duckdb
import numpy as np
import pytest

from compare import cell
from curvelake import plans


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in pathlib.Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.all_queries()))
def test_query(spark, sf, con, name):
    rows = plans.all_queries()[name](spark, sf).toArrow()
    sql = plans.all_sql().get(name)
    if sql is None:
        # Kernels without SQL: no row lacks all its values and no number is infinite; their values have tests of their own.
        assert rows.num_rows > 0 or name == "p7_found"
        for c in rows.column_names:
            if str(rows[c].type) == "double":
                assert not any(v is not None and np.isinf(v) for v in rows[c].to_pylist()), c
        return
    want = con.sql(sql).to_arrow_table()
    names = sorted(rows.column_names)
    assert names == sorted(want.column_names)
    table = lambda t: sorted((tuple(cell(v) for v in r) for r in zip(*[t[c].to_pylist() for c in names])), key=repr)
    assert table(rows) == table(want)


def test_interpolation_asks_for_every_cell_and_wraps_angles(spark, sf, con):
    got = plans.all_queries()["q_grid_interp"](spark, sf).toPandas()
    rows = con.sql("SELECT p.curve_id, p.metric, p.x, p.F_kJ_mol AS y, g.x_start, g.x_step, g.n_cells, g.is_periodic FROM pmf p JOIN metric_grid g ON p.metric = g.metric WHERE curve_id IS NOT NULL AND variant IS NOT NULL AND isfinite(x) AND isfinite(F_kJ_mol)").df()
    assert set(got.metric) == set(rows.metric) and rows.metric.nunique() == 8
    found = {k: part.sort_values("cell") for k, part in got.groupby(["curve_id", "metric"])}
    assert set(found) == set(rows.groupby(["curve_id", "metric"]).groups)
    for key, part in rows.groupby(["curve_id", "metric"]):
        start, step, n, turns = part[["x_start", "x_step", "n_cells", "is_periodic"]].iloc[0]
        at = start + step * (np.arange(int(n)) + 0.5)
        x = start + (part.x - start) % 360.0 if turns else part.x
        y = part.y.groupby(x.to_numpy()).mean()
        want = np.interp(at, y.index, y.to_numpy(), period=360.0) if turns else np.interp(at, y.index, y.to_numpy(), left=np.nan, right=np.nan)
        assert found[key].cell.tolist() == list(range(int(n)))
        assert np.allclose(found[key].F_kJ_mol.to_numpy(float), want, atol=6e-5, equal_nan=True)


def test_the_matrix_has_all_variants_and_metrics(spark, sf, con):
    got = plans.all_queries()["q_pmf_matrix"](spark, sf).toPandas()
    rows = con.sql("SELECT p.metric, variant, CASE WHEN is_periodic THEN x_start + (x - x_start) - 360 * floor((x - x_start) / 360) ELSE x END AS x, greatest(P, 0) AS P FROM pmf p JOIN metric_grid g ON p.metric = g.metric WHERE curve_id IS NOT NULL AND variant IS NOT NULL AND isfinite(x) AND isfinite(F_kJ_mol) AND isfinite(P)").df()
    rows["x"] = np.floor(rows.x * 10000 + 0.5) / 10000
    assert got.variant.nunique() > 1 and set(got.metric) == set(rows.metric) and rows.metric.nunique() == 8
    want = 0
    found = {k: part.sort_values("x") for k, part in got.groupby(["metric", "variant"])}
    for metric, part in rows.groupby("metric"):
        grid = np.unique(part.x)
        grid = np.linspace(grid[0], grid[-1], 256) if len(grid) > 256 else grid
        for variant, own in part.groupby("variant"):
            y = own.groupby("x").P.mean()
            if len(y) < 2:
                continue
            want += 1
            v = np.interp(grid, y.index, y.to_numpy(), left=0, right=0)
            area = np.trapezoid(v, grid)
            assert np.allclose(found[metric, variant].density, v / area if area > 0 else v, atol=1e-5)
    assert want == len(found)
