"""python baseline.py [DIR]: headline queries restated in pandas and NumPy in one process, timed with their reading; beside bench.py's figures."""

from __future__ import annotations

import collections
import json
import re
import sys
import time

import numpy as np
import pandas as pd

FEATURES = ["seq_len", "kd_mean", "rg__mean", "rg__std", "e2e__mean", "sasa__mean", "rmsd__mean", "rg__effective_support_frac", "rg__global_basin_escape_barrier_kt", "rg__local_ruggedness_kt"]


def _finite(s: pd.Series) -> pd.Series:
    return s.where(np.isfinite(s.astype(float)))


def _pmf(d: str) -> pd.DataFrame:
    p = pd.read_parquet(f"{d}/pmf.parquet", columns=["curve_id", "variant", "metric", "replica", "x", "P", "F_kJ_mol"])
    p = p[p.curve_id.notna() & p.variant.notna() & p.metric.notna() & np.isfinite(p.x) & np.isfinite(p.F_kJ_mol)]
    return p.assign(P=_finite(p.P))


def _cells(d: str) -> pd.DataFrame:
    p = _pmf(d).merge(pd.read_parquet(f"{d}/metric_grid.parquet"), on="metric")
    w = np.where(p.is_periodic, p.x_start + (p.x - p.x_start) % 360.0, p.x)
    p["cell"] = np.floor((w - p.x_start) / p.x_step).astype(int)
    return p[(p.cell >= 0) & (p.cell < p.n_cells)]


def _rows(d: str) -> pd.DataFrame:
    f = pd.read_parquet(f"{d}/features.parquet")
    return f[f.variant.notna()].sort_values(["exported_at", *FEATURES]).drop_duplicates("variant", keep="last")


def q_describe(d):
    return pd.read_parquet(f"{d}/features.parquet", columns=FEATURES).astype(float).replace([np.inf, -np.inf], np.nan).describe(percentiles=[0.25, 0.5, 0.75])


def q_metric_coverage(d):
    p = pd.read_parquet(f"{d}/pmf.parquet", columns=["variant", "metric", "replica"])
    return p.groupby(["variant", "metric"]).replica.agg(["size", "nunique"])


def q_replica_mean_std(d):
    m = _cells(d).groupby(["variant", "metric", "cell", "replica"]).F_kJ_mol.mean()
    return m.groupby(level=[0, 1, 2]).agg(["mean", "std", "count"])


def q_design_matrix(d):
    c = _cells(d)
    p = c[c.P.notna()].assign(P=lambda t: t.P.clip(lower=0)).groupby(["variant", "metric", "cell"]).P.mean().unstack(fill_value=0.0)
    p = p[p.sum(axis=1) > 0]
    return np.sqrt(p.div(p.sum(axis=1), axis=0))


def q_grid_interp(d):
    out = []
    for (curve, metric), part in _cells(d).groupby(["curve_id", "metric"]):
        x0, dx, n, turns = part[["x_start", "x_step", "n_cells", "is_periodic"]].iloc[0]
        y = part.groupby("x").F_kJ_mol.mean()
        at = x0 + dx * (np.arange(int(n)) + 0.5)
        out.append(np.interp(at, y.index, y.to_numpy(), period=360.0) if turns else np.interp(at, y.index, y.to_numpy(), left=np.nan, right=np.nan))
    return out


def q_pearson_pairs(d):
    return _rows(d)[FEATURES].astype(float).replace([np.inf, -np.inf], np.nan).corr()


def q_avg_rank_spearman(d):
    return _rows(d)[["kd_mean", "rg__mean", "e2e__mean", "sasa__mean"]].replace([np.inf, -np.inf], np.nan).rank().corr()


def q_pca_scores(d):
    x = _rows(d)[FEATURES].astype(float).replace([np.inf, -np.inf], np.nan)
    z = x.fillna(x.median())
    z = ((z - z.mean()) / z.std()).to_numpy()
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    return u[:, :4] * s[:4]


def q_kmer_top(d):
    out = {}
    seqs = [re.sub("[^ACDEFGHIKLMNPQRSTVWY]", "", s.upper()) for s in _rows(d).sequence.dropna()]
    for k in (2, 3, 4):
        out[k] = collections.Counter(s[i : i + k] for s in seqs for i in range(len(s) - k + 1)).most_common(64)
    return out


def q_knn(d):
    e = pd.read_parquet(f"{d}/embeddings.parquet", columns=["vec_id", "embedding"])
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    q = x[ids % 20 == 0]
    far = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q @ x.T, 0))
    return np.argsort(far, 1)[:, 1:6]


def q_acf(d):
    e = pd.read_parquet(f"{d}/events.parquet", columns=["user_id", "event_type", "ts", "event_id", "value"]).sort_values(["ts", "event_id"])
    out = {}
    for key, part in e.groupby(["event_type", "user_id"]):
        v = part.value.to_numpy() - part.value.mean()
        if len(v) >= 3 and (z := v @ v) > 1e-12:
            out[key] = np.correlate(v, v, "full")[len(v) - 1 :][:301] / z
    return out


def p6_mask(d):
    c = _cells(d)
    return {k: np.setdiff1d(np.arange(n.iloc[0]), cell) for k, cell, n in ((k, g.cell.unique(), g.n_cells) for k, g in c.groupby(["curve_id", "metric"]))}


def main() -> None:
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    took = {}
    for f in (q_describe, q_metric_coverage, q_replica_mean_std, q_design_matrix, q_grid_interp, q_pearson_pairs, q_avg_rank_spearman, q_pca_scores, q_kmer_top, q_knn, q_acf, p6_mask):
        best = []
        for _ in range(2):
            began = time.time()
            f(d)
            best.append(time.time() - began)
        took[f.__name__] = round(min(best), 3)
    print(json.dumps(took))


if __name__ == "__main__":
    main()
