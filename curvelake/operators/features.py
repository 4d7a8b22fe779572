"""Transforms of feature tables and linear algebra on their columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.operators.grid import finite


def standardise(tall: DataFrame, by: Sequence[str], value: str = "value", ddof: int = 1) -> DataFrame:
    """tall with z: (value - mean) / std over the finite values of each group; a finite value in a group without spread
    gives 0, a missing one stays null."""
    v = finite(F.col(value))
    spread = F.stddev_samp(v) if ddof == 1 else F.stddev_pop(v)
    w = Window.partitionBy(*by)
    m, s = F.avg(v).over(w), spread.over(w)
    return tall.withColumn("z", F.when(v.isNotNull(), F.when(F.coalesce(s, F.lit(0.0)) > 0, (v - m) / s).otherwise(0.0)))


# Negative values count as 0 before a logarithm or root, as noise around 0 mustn't turn into gaps.
RULES = {
    "zscore": lambda v: v,
    "log1p_zscore": lambda v: F.log1p(F.greatest(v, F.lit(0.0))),
    "sqrt_zscore": lambda v: F.sqrt(F.greatest(v, F.lit(0.0))),
}


def transform(tall: DataFrame, rules: dict[str, str], column: str = "column", scope: str | None = None) -> DataFrame:
    """tall (column, value) with z by each column's rule; columns without a known rule keep their value.

    scope: a further column inside whose groups is scaled; rows without a group keep their value. A column the table
    lacks counts as none.
    """
    if scope is not None and scope not in tall.columns:
        scope = None
    v = finite(F.col("value"))
    known = {n: r for n, r in rules.items() if r in RULES}
    prepared = v
    for name, rule in known.items():
        prepared = F.when(F.col(column) == name, RULES[rule](F.when(v.isNotNull(), v))).otherwise(prepared)
    prepared = F.when(v.isNotNull(), prepared)  # greatest() would make a missing value 0
    made = standardise(tall.withColumn("_p", prepared), [column, *([scope] if scope else [])], "_p")
    out = F.when(F.col(column).isin(*known), F.col("z")).otherwise(v) if known else v
    if scope:
        out = F.when(F.col(scope).isNull(), v).otherwise(out)
    return made.withColumn("z", out).drop("_p")


def viable(df: DataFrame, columns: Sequence[str], least: int = 3, most_missing: float = 1.0) -> list[str]:
    """Columns with at least `least` finite values (2 where the table has fewer rows), variance, and at most this share missing."""
    if not columns:
        return []
    c = {x: finite(F.col(f"`{x}`").cast("double")) for x in columns}
    row = df.agg(F.count("*").alias("rows"), *[f(v).alias(f"{n}{i}") for i, v in enumerate(c.values()) for n, f in (("n", F.count), ("v", F.var_samp))]).first()
    need = least if row["rows"] >= least else 2
    return [x for i, x in enumerate(columns) if row[f"n{i}"] >= need and (row[f"v{i}"] or 0) > 0 and row[f"n{i}"] >= (1 - most_missing) * row["rows"]]


def design(df: DataFrame, columns: Sequence[str], least: int = 3) -> tuple[DataFrame, list[str]]:
    """(df with its viable columns median-imputed, those columns); rows with fewer than two values (one for one column) are left out."""
    kept = viable(df, columns, least)
    if not kept:
        return df.limit(0), []
    filled = sum((finite(F.col(f"`{c}`").cast("double")).isNotNull().cast("int") for c in kept), F.lit(0))
    return impute(df.where(filled >= min(2, len(kept))), kept), kept


def balance_torsions(df: DataFrame, columns: Sequence[str], how: str = "balance") -> tuple[DataFrame, list[str]]:
    """Torsion columns left out, or scaled so that all torsions together weigh as the other columns do."""
    import re

    concept = lambda c: m[0].lower() if (m := re.match(r"(?i)(phi|psi)[_-]?(?:res)?[a-z]{0,6}\d+", c)) else None
    torsions = [c for c in columns if concept(c)]
    rest = [c for c in columns if not concept(c)]
    if how == "exclude" or not torsions:
        return df, rest if how == "exclude" else list(columns)
    factor = (max(len(rest), 1) / len({concept(c) for c in torsions})) ** 0.5
    return df.withColumns({c: F.col(f"`{c}`") * factor for c in torsions}), list(columns)


def tab_input(df: DataFrame, preset: str, rules: dict[str, str] | None = None, observable: str = "metric", unit: str = "coordinate_units", flags: Sequence[str] = ()) -> dict:
    """The input of an embedding from long rows: the preset's present features, rows whose flags hold, features that may be
    mixed, transformed. Returns features, missing, excluded, warnings, rows (with row_id, the untouched columns and one
    z_<feature> each)."""
    from curvelake.functions import names as N

    present, missing = N.preset(preset, df.columns)
    kept = flags_hold(df, flags)
    one = kept.agg(*[F.countDistinct(c).alias(c) for c in (observable, unit) if c in df.columns]).first().asDict() if {observable, unit} & set(df.columns) else {}
    allowed = present if preset == "pmf_annotations" else N.for_embedding(present, one.get(observable, 2), ["u"] * min(one.get(unit, 0), 1) + ["v"] * (one.get(unit, 0) > 1))
    row_id = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    rows = kept.withColumn("row_id", row_id)
    rate = rows.agg(F.count("*").alias("n"), *[F.count(finite(F.col(f"`{c}`").cast("double"))).alias(c) for c in allowed]).first().asDict() if allowed else {"n": 0}
    warnings = [f"{c}: more than half missing" for c in allowed if rate["n"] and rate[c] < 0.5 * rate["n"]] + [f"flag {f} is not in the table" for f in flags if f not in df.columns]
    for c in allowed:
        v = finite(F.col(f"`{c}`").cast("double"))
        rule = (rules or {}).get(c)
        if rule in RULES:
            p = F.when(v.isNotNull(), RULES[rule](v))
            stats = rows.agg(F.avg(p).alias("m"), F.stddev_samp(p).alias("s")).first()
            v = F.when(p.isNotNull(), (p - (stats["m"] or 0.0)) / stats["s"] if stats["s"] else F.lit(0.0))
        rows = rows.withColumn(f"z_{c}", v)
    return {"features": allowed, "missing": missing, "excluded": [c for c in present if c not in allowed], "warnings": warnings, "rows": rows}


def flags_hold(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows whose flags are all true; null is false; flags the table lacks are passed over."""
    return df.where(F.forall(F.array(F.lit(True), *[F.coalesce(F.col(f), F.lit(False)) for f in flags if f in df.columns]), lambda f: f))


def encode_angles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each angle column in degrees replaced, in place, by its sine and cosine."""
    out: list[Column] = []
    for c in df.columns:
        a = F.radians(F.col(f"`{c}`"))
        out += [F.sin(a).alias(f"{c}_sin"), F.cos(a).alias(f"{c}_cos")] if c in columns else [F.col(f"`{c}`")]
    return df.select(*out)


def impute(df: DataFrame, columns: Sequence[str], how: str = "median") -> DataFrame:
    """Not finite values of columns replaced by the column's median or mean, 0 for columns without a value."""
    f = F.median if how == "median" else F.avg
    clean = df.withColumns({c: finite(F.col(f"`{c}`").cast("double")) for c in columns})
    fill = clean.agg(*[F.coalesce(f(F.col(f"`{c}`")), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(columns)])
    joined = clean.join(F.broadcast(fill))  # one row
    return joined.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.col(f"_f{i}")) for i, c in enumerate(columns)}).select(*df.columns)


def gram(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, covariance with n - 1) of complete columns, in one distributed aggregate of size columns squared."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    c = [F.col(f"`{x}`") for x in columns]
    row = df.agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(c)], *[F.covar_samp(c[i], c[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))]), cov


class Pca:
    """Principal components by the covariance of the columns; the sign of each makes its largest loading positive."""

    def __init__(self, df: DataFrame, columns: Sequence[str], scale: bool = True) -> None:
        self.columns = list(columns)
        self.rows, self.mean, cov = gram(df, columns)
        self.std = np.sqrt(np.diag(cov)) if scale else np.ones(len(columns))
        self.std[self.std == 0] = 1.0
        values, vectors = np.linalg.eigh(cov / np.outer(self.std, self.std))
        self.values = np.maximum(values[::-1], 0.0)
        self.vectors = vectors[:, ::-1]
        self.vectors *= np.sign(self.vectors[np.abs(self.vectors).argmax(0), np.arange(len(columns))] + 1e-300)

    @property
    def shares(self) -> np.ndarray:
        """Explained share of the variance of each component."""
        return self.values / max(self.values.sum(), 1e-300)

    @property
    def participation(self) -> float:
        """Effective number of dimensions: the squared sum of the eigenvalues over the sum of their squares."""
        return float(self.values.sum() ** 2 / max((self.values**2).sum(), 1e-300))

    def reach(self, share: float, most: int = 64) -> int:
        """Fewest components that explain a share, at most `most`."""
        return int(min(np.searchsorted(np.cumsum(self.shares), share - 1e-12) + 1, most, len(self.columns)))

    def scores(self, df: DataFrame, k: int, keep: Sequence[str]) -> DataFrame:
        """keep, pc1..pck: the rows projected, as plain sums of columns."""
        z = [(F.col(f"`{c}`") - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.std)]
        return df.select(*keep, *[sum((z[i] * float(self.vectors[i, j]) for i in range(len(z))), F.lit(0.0)).alias(f"pc{j + 1}") for j in range(k)])

    def loadings(self, k: int) -> list[tuple[str, int, float]]:
        return [(c, j + 1, float(self.vectors[i, j])) for i, c in enumerate(self.columns) for j in range(k)]


def aligned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Absolute cosines of the columns of b matched one to one with those of a, best matches first (k x k loadings)."""
    from itertools import permutations

    c = np.abs(a.T @ b) / np.outer(np.linalg.norm(a, axis=0), np.linalg.norm(b, axis=0))
    if c.shape[0] <= 6:
        best = max(permutations(range(c.shape[1])), key=lambda p: sum(c[i, p[i]] for i in range(c.shape[0])))
        return np.array([c[i, best[i]] for i in range(c.shape[0])])
    out, left = [], set(range(c.shape[1]))
    for i in range(c.shape[0]):
        j = max(left, key=lambda j: c[i, j])
        left.discard(j)
        out.append(c[i, j])
    return np.array(out)


def procrustes(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(squared residual, root mean square) of b fitted on a by shift, scale and rotation."""
    x, y = a - a.mean(0), b - b.mean(0)
    x, y = x / max(np.linalg.norm(x), 1e-300), y / max(np.linalg.norm(y), 1e-300)
    u, s, v = np.linalg.svd(y.T @ x)
    residual = x - y @ (u @ v) * s.sum()
    return float((residual**2).sum()), float(np.sqrt((residual**2).sum(1).mean()))


def uncorrelated(columns: Sequence[str], r: np.ndarray, most: float) -> list[str]:
    """Walks the columns in order and keeps each whose absolute correlation with all kept is at most `most`."""
    kept: list[int] = []
    for i in range(len(columns)):
        if all(not abs(r[i, j]) > most for j in kept):
            kept.append(i)
    return [columns[i] for i in kept]


def chained_order(columns: Sequence[str], r: np.ndarray) -> list[str]:
    """Starts at the first column and again and again appends the one with the highest mean absolute correlation to those chosen."""
    a, chosen = np.abs(np.nan_to_num(r)), [0] if len(columns) else []
    while len(chosen) < len(columns):
        rest = [i for i in range(len(columns)) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (a[i, chosen].mean(), -i)))
    return [columns[i] for i in chosen]


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 16) -> DataFrame:
    """mi, h_a, h_b, normalised: mutual information of two columns on equal-width bins, over the root of the entropies, within 0 and 1."""
    from curvelake.operators.stats import histogram2d

    n = histogram2d(df, a, b, [], bins)
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    p = n.withColumn("p", F.col("n") / total)
    p = p.withColumn("px", F.sum("p").over(Window.partitionBy("xbin"))).withColumn("py", F.sum("p").over(Window.partitionBy("ybin")))
    # A cell's share of a marginal's entropy is -p ln(px): summed over the marginal it gives -px ln(px).
    made = p.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"), F.sum(-F.col("p") * F.ln("px")).alias("h_a"), F.sum(-F.col("p") * F.ln("py")).alias("h_b"))
    return made.withColumn("normalised", F.least(F.greatest(F.coalesce(F.try_divide("mi", F.sqrt(F.col("h_a") * F.col("h_b"))), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(ids: np.ndarray, runs: int, share: float = 1.0, seed: int = 0) -> np.ndarray:
    """rows x runs: how often each row is drawn in each run, Poisson with mean share, told by the row's own 64-bit id alone, so
    that any task draws the same."""
    with np.errstate(over="ignore"):
        bits = _mixed(ids.view(np.uint64)[:, None] + np.arange(seed, seed + runs, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    u = (bits >> np.uint64(11)).astype(float) / float(1 << 53)
    term, total, k = np.exp(-share), np.exp(-share), 0
    out = np.zeros(u.shape)
    while (beyond := u >= total).any() and k < 60:
        k += 1
        term *= share / k
        total += term
        out += beyond
    return out


def resampled_grams(df: DataFrame, key: str, columns: Sequence[str], runs: int, how: str = "bootstrap", share: float = 1.0, seed: int = 0) -> np.ndarray:
    """runs x parts x (p + 1) x (p + 1): sums of the products of the columns, with a leading 1, of each run's resample.

    bootstrap: one part, every row drawn Poisson(share) times. split_half: two parts, every row in one of them. One pass over
    the rows; a task moves its sums, runs times (p + 1) squared numbers, and no row is copied. Rows with a null or a number that
    isn't finite don't count.
    """
    if how not in ("bootstrap", "split_half"):
        raise ValueError(how)
    p, parts = len(columns) + 1, 1 + (how == "split_half")
    rows = df.select(F.xxhash64(key).alias("_id"), *[F.col(f"`{c}`").cast("double").alias(f"_c{i}") for i, c in enumerate(columns)]).dropna()

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((runs * parts, p * p))
        for b in batches:
            x = np.column_stack([np.ones(len(b)), b[[f"_c{i}" for i in range(p - 1)]].to_numpy()])
            ok = np.isfinite(x).all(1)
            x, ids = x[ok], b["_id"].to_numpy()[ok]
            for at in range(0, len(x), 4096):
                xs = x[at : at + 4096]
                w = draws(ids[at : at + 4096], runs, share, seed)
                if how == "split_half":
                    half = w > 0.5  # Poisson(ln 2) is 0 for half of all rows
                    w = np.concatenate([half[:, :, None], ~half[:, :, None]], 2).reshape(len(xs), -1).astype(float)
                total += w.T @ np.einsum("ij,ik->ijk", xs, xs).reshape(len(xs), -1)
        yield pd.DataFrame({"run": np.arange(len(total), dtype=np.int32), "g": list(total)})

    if how == "split_half":
        share = float(np.log(2))
    made = rows.mapInPandas(part, "run int, g array<double>").select("run", F.posexplode("g").alias("i", "v")).groupBy("run", "i").agg(F.sum("v").alias("v")).toPandas()  # runs x (p + 1)^2 rows
    out = np.zeros((runs * parts, p * p))
    out[made["run"], made["i"]] = made["v"]
    return out.reshape(runs, parts, p, p)


def pca_stability(df: DataFrame, key: str, columns: Sequence[str], k: int = 4, runs: int = 60, how: str = "split_half", share: float = 0.8, scale: bool = True) -> list[dict]:
    """Per run: cosines of the k loadings and the Procrustes disparity of the scores of all rows, of two halves, or of a
    resample and all rows.

    Columns are standardised over all rows. Disparity: the squared residual of the two score sets, each centred and of norm 1,
    after the best rotation (and scale); told by the loadings and the rows' products alone. runs is held within 5 and 500.
    """
    runs = min(max(runs, 5), 500)
    n, mean, cov = gram(df, columns)
    std = np.sqrt(np.diag(cov))
    std[~(std > 0)] = 1.0
    whole = cov / np.outer(std, std)
    k = max(1, min(k, 6, len(columns)))

    def loadings(g: np.ndarray) -> np.ndarray:
        m = g[0, 1:] / max(g[0, 0], 1.0)
        c = g[1:, 1:] / max(g[0, 0], 1.0) - np.outer(m, m)
        return np.linalg.eigh(c / np.outer(std, std))[1][:, ::-1][:, :k]

    grams = resampled_grams(df, key, columns, runs, how, share)
    base = np.linalg.eigh(whole)[1][:, ::-1][:, :k]
    out = []
    for r in range(runs):
        a, b = (loadings(grams[r, 0]), loadings(grams[r, 1])) if how == "split_half" else (base, loadings(grams[r, 0]))
        na, nb = np.sqrt(np.trace(a.T @ whole @ a)), np.sqrt(np.trace(b.T @ whole @ b))
        fit = np.linalg.svd(a.T @ whole @ b / max(na * nb, 1e-300))[1].sum()
        out.append({"run": r, "cosines": aligned(a, b), "disparity": float(max(1 - fit**2 if scale else 2 - 2 * fit, 0.0))})
    return out


def _digamma(n: np.ndarray) -> np.ndarray:
    """Of whole numbers from 1 on."""
    sums = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, int(n.max(initial=1)) + 1))])
    return sums[n.astype(int) - 1] - 0.5772156649015329


def nearest_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information of two columns by the distances to the k-th nearest rows (Kraskov, Stoegbauer and Grassberger's first
    estimator), at least 0. Columns are scaled to a deviation of 1; rows are compared in blocks."""
    n = len(x)
    if n <= k + 1:
        return 0.0
    x, y = ((c - c.mean()) / max(c.std(), 1e-300) for c in (x, y))
    sx, sy = np.sort(x), np.sort(y)
    total = 0.0
    for at in range(0, n, 512):
        d = np.maximum(np.abs(x[at : at + 512, None] - x[None, :]), np.abs(y[at : at + 512, None] - y[None, :]))
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        radius = np.nextafter(np.partition(d, k - 1, 1)[:, k - 1], 0)
        within = lambda s, v: np.searchsorted(s, v + radius, "right") - np.searchsorted(s, v - radius)  # noqa: B023, E731
        total += (_digamma(np.maximum(within(sx, x[at : at + 512]), 1)) + _digamma(np.maximum(within(sy, y[at : at + 512]), 1))).sum()
    return float(max(_digamma(np.array([k]))[0] + _digamma(np.array([n]))[0] - total / n, 0.0))


def information_matrix(rows: np.ndarray, k: int = 3) -> np.ndarray:
    """Mutual information of all pairs of columns over the root of both columns' own, within 0 and 1; rows with a number that isn't finite don't count."""
    rows = rows[np.isfinite(rows).all(1)]
    p = rows.shape[1]
    if len(rows) < 3 or p < 2:
        return np.eye(p)
    m = np.array([[nearest_information(rows[:, i], rows[:, j], k) if j >= i else 0.0 for j in range(p)] for i in range(p)])
    m = np.triu(m) + np.triu(m, 1).T
    own = np.maximum(np.diag(m), 1e-10)
    out = np.clip(m / np.sqrt(np.outer(own, own)), 0.0, 1.0)
    np.fill_diagonal(out, 1.0)
    return out
