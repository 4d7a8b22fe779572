"""Composite reports: what a view of the data shows, as one table each; and the streaming extension."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from curvelake.functions import names as N
from curvelake.functions import physics as P
from curvelake.operators import curves as C
from curvelake.operators import embed as E
from curvelake.operators import features as X
from curvelake.operators import stats as A
from curvelake.operators import tables as T
from curvelake.operators.grid import finite
from curvelake.plans.common import CELLS, FEATURE_ROWS, FEATURES, FIN, MEANS, PMF, cell_means, feature_rows, features, in_cells, pmf, rounded
from curvelake.session import shared_dir, table
from curvelake.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT metric, min(x) AS low, max(x) AS high, metric LIKE 'phi%' OR metric LIKE 'psi%' AS is_torsion FROM {PMF} GROUP BY metric")
def q_x_ranges(spark, d):
    """K02."""
    return pmf(spark, d).groupBy("metric").agg(F.min("x").alias("low"), F.max("x").alias("high")).withColumn("is_torsion", N.torsion(F.col("metric")).isNotNull())


@query(f"""WITH r AS (SELECT variant, metric, replica, cell, avg(F_kJ_mol) AS y FROM {CELLS} GROUP BY 1, 2, 3, 4), s AS (SELECT variant, metric, cell, avg(y) AS f, stddev_samp(y) AS std, count(y) AS n FROM r GROUP BY 1, 2, 3)
SELECT variant, metric, cell, round(f - min(f) OVER w, 8) AS f, round(f - min(f) OVER w - coalesce(std, 0), 8) AS low, round(f - min(f) OVER w + coalesce(std, 0), 8) AS high, n FROM s WINDOW w AS (PARTITION BY variant, metric)""")
def q_curve_report(spark, d):
    """Each variant's mean curve from its minimum, with a band of one standard deviation over replicas."""
    s = C.replica_stats(in_cells(spark, d), ["variant", "metric"], "replica", "cell", "F_kJ_mol")
    f = F.col("mean") - F.min("mean").over(Window.partitionBy("variant", "metric"))
    band = F.coalesce("std", F.lit(0.0))
    return rounded(s.select("variant", "metric", "cell", f.alias("f"), (f - band).alias("low"), (f + band).alias("high"), "n"), "f", "low", "high", places=8)


@query("""WITH m AS (SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS y, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS n_days, round(arg_max(y, day), 9) AS final, round(arg_max(y, day) - arg_min(y, day), 9) AS delta, round(max(y) - min(y), 9) AS spread FROM m GROUP BY 1""")
def q_conv_dashboard(spark, d):
    """Series of daily means summed up per metric."""
    m = table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("y"))
    made = m.groupBy("event_type").agg(F.count("*").alias("n_days"), F.max_by("y", "day").alias("final"), (F.max_by("y", "day") - F.min_by("y", "day")).alias("delta"), (F.max("y") - F.min("y")).alias("spread"))
    return rounded(made, "final", "delta", "spread", places=9)


# Some canonical convergence metrics and other names of theirs.
CONVERGENCE_NAMES = {
    "RMSE_F": ("RMSE_F", "RMSEF", "rmse_f", "pmf_rmse", "rmse_pmf", "tail_median_RMSE_F"),
    "MAE_F": ("MAE_F", "MAEF", "mae_f", "pmf_mae", "mae_pmf"),
    "JS": ("JS", "JSD", "js", "jsd", "jensen_shannon", "jensen_shannon_divergence", "tail_median_JS"),
    "barrier_error": ("barrier_error", "barrier_err", "delta_barrier", "barrier_delta", "barrier_rmse"),
}


@query("""SELECT p_partkey, name, CASE n WHEN 'rmsef' THEN 'RMSE_F' WHEN 'jsd' THEN 'JS' WHEN 'barriererr' THEN 'barrier_error' WHEN 'pmfmae' THEN 'MAE_F' ELSE CASE WHEN contains(n, 'rmsef') THEN 'RMSE_F' WHEN contains(n, 'barriererror') THEN 'barrier_error' END END AS canonical
FROM (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS n FROM (SELECT p_partkey, (['RMSE-F', 'jsd', 'Barrier err', 'pmf_mae', 'my_RMSE_F_tail', 'the barrier error', 'other'])[p_partkey % 7 + 1] AS name FROM part))""")
def q_canonical_metric(spark, d):
    """F05."""
    names = F.array(*[F.lit(x) for x in ("RMSE-F", "jsd", "Barrier err", "pmf_mae", "my_RMSE_F_tail", "the barrier error", "other")])
    rows = table(spark, d, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int")).alias("name"))
    return rows.withColumn("canonical", N.canonical(F.col("name"), CONVERGENCE_NAMES))


@query(f"""WITH f AS (SELECT variant, {FIN('kd_mean')} AS ax FROM {FEATURE_ROWS}), m AS {MEANS}, j AS (SELECT m.metric, m.cell, f.ax, m.F_kJ_mol AS v FROM m JOIN f ON m.variant = f.variant WHERE ax IS NOT NULL),
k AS (SELECT metric, cell, count(*) AS n, corr(ax, v) AS r FROM j GROUP BY 1, 2 HAVING count(*) >= 3), o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(abs(r), 9) DESC, cell) AS place FROM k WHERE r IS NOT NULL AND NOT isnan(r))
SELECT metric, cell, n, round(r, 6) AS r, place::INT AS place FROM o WHERE place <= 5""")
def q_family_top_bins(spark, d):
    """Cells that go most with an axis, five per family."""
    f = feature_rows(spark, d).select("variant", finite(F.col("kd_mean")).alias("ax")).where("ax IS NOT NULL")
    k = cell_means(spark, d).join(f, "variant").groupBy("metric", "cell").agg(F.count("*").alias("n"), F.corr("ax", "F_kJ_mol").alias("r")).where("n >= 3 AND r IS NOT NULL AND NOT isnan(r)")
    w = Window.partitionBy("metric").orderBy(F.round(F.abs("r"), 9).desc(), "cell")
    return rounded(k.withColumn("place", F.row_number().over(w)).where("place <= 5"), "r")


@query(f"""WITH f AS (SELECT variant, {FIN('kd_mean')} AS ax FROM {FEATURE_ROWS}), m AS {MEANS}, j AS (SELECT m.metric, m.cell, f.ax, m.F_kJ_mol AS v FROM m JOIN f ON m.variant = f.variant WHERE ax IS NOT NULL),
k AS (SELECT metric, cell, count(*) AS n, corr(ax, v) AS r FROM j GROUP BY 1, 2 HAVING count(*) >= 3), o AS (SELECT *, row_number() OVER (ORDER BY round(abs(r), 9) DESC, metric, cell) AS place FROM k WHERE r IS NOT NULL AND NOT isnan(r))
SELECT metric, cell, n, round(r, 6) AS r, place::INT AS place FROM o WHERE place <= 20""")
def q_global_top_bins(spark, d):
    """The cells of all families that go most with an axis."""
    f = feature_rows(spark, d).select("variant", finite(F.col("kd_mean")).alias("ax")).where("ax IS NOT NULL")
    k = cell_means(spark, d).join(f, "variant").groupBy("metric", "cell").agg(F.count("*").alias("n"), F.corr("ax", "F_kJ_mol").alias("r")).where("n >= 3 AND r IS NOT NULL AND NOT isnan(r)")
    top = k.orderBy(F.round(F.abs("r"), 9).desc(), "metric", "cell").limit(20)  # a bounded report, ranked after the limit
    return rounded(top.withColumn("place", F.row_number().over(Window.orderBy(F.round(F.abs("r"), 9).desc(), "metric", "cell"))), "r")


@query(f"""WITH r AS (SELECT kd_mean AS u, rg__mean AS v, e2e__mean AS a, sasa__mean AS b, rmsd__mean AS c FROM {FEATURE_ROWS}),
t AS ({' UNION ALL '.join(f"SELECT '{n}' AS \"column\", corr({FIN('u')}, {FIN(x)}) AS ru, corr({FIN('v')}, {FIN(x)}) AS rv FROM r" for n, x in (('e2e__mean', 'a'), ('sasa__mean', 'b'), ('rmsd__mean', 'c')))})
SELECT "column", round(ru, 6) AS ru, round(rv, 6) AS rv, round(sqrt(ru * ru + rv * rv), 6) AS "length" FROM t""")
def q_biplot(spark, d):
    """T11."""
    rest = ["e2e__mean", "sasa__mean", "rmsd__mean"]
    r = A.correlations(feature_rows(spark, d), ["kd_mean", "rg__mean", *rest]).where(F.col("b").isin(*rest))
    pick = lambda a: F.max(F.when(F.col("a") == a, F.col("r")))
    made = r.where(F.col("a").isin("kd_mean", "rg__mean")).groupBy(F.col("b").alias("column")).agg(pick("kd_mean").alias("ru"), pick("rg__mean").alias("rv"))
    return rounded(made.withColumn("length", F.sqrt(F.col("ru") ** 2 + F.col("rv") ** 2)), "ru", "rv", "length")


_TORSIONS = ["phi_res4__circular_mean_deg", "psi_res4__circular_mean_deg"]


@query(f"""WITH r AS (SELECT phi_res4__circular_mean_deg AS a, psi_res4__circular_mean_deg AS b FROM features) SELECT 'phi_res4__circular_mean_deg' AS a, 'psi_res4__circular_mean_deg' AS b, 4 AS res_a, 4 AS res_b, count(*) FILTER (isfinite(a) AND isfinite(b)) AS n, round(abs(corr({FIN('a')}, {FIN('b')})), 6) AS coupling FROM r""")
def q_coupling(spark, d):
    """Absolute correlation of torsion features by residue."""
    r = A.correlations(features(spark, d), _TORSIONS)
    res = lambda c: F.regexp_extract(c, r"res(\d+)", 1).cast("int")
    return rounded(r.select("a", "b", res("a").alias("res_a"), res("b").alias("res_b"), "n", F.abs("r").alias("coupling")), "coupling")


@query()
def q_pca_stability(spark, d):
    """Means and deviations over 60 split halves and 60 resamples of the cosines of loadings and the Procrustes disparity."""
    ready = X.impute(feature_rows(spark, d), FEATURES)
    rows = []
    for how in ("split_half", "bootstrap"):
        runs = X.pca_stability(ready, "variant", FEATURES, 4, 60, how)
        rows += [(how, r["run"], j + 1, float(c), r["disparity"]) for r in runs for j, c in enumerate(r["cosines"])]
    every = spark.createDataFrame(rows, "method string, run int, component int, cosine double, disparity double")
    made = every.groupBy("method", "component").agg(F.count("*").alias("runs"), F.avg("cosine").alias("cosine_mean"), F.stddev_samp("cosine").alias("cosine_std"), F.avg("disparity").alias("disparity_mean"), F.stddev_samp("disparity").alias("disparity_std"))
    return rounded(made, "cosine_mean", "cosine_std", "disparity_mean", "disparity_std")


@query()
def q_embedding_stability(spark, d):
    """Overlap of neighbours and Procrustes residual of the map of all vectors, fitted on other samples in every run, against the first."""
    e = table(spark, d, "embeddings")
    asked, _ = E.fitted_rows(e, "vec_id", "embedding", 300)
    some = e.where(F.col("vec_id").isin(asked))

    def run(seed):
        keys, x = E.fitted_rows(e, "vec_id", "embedding", 400, seed)
        made = E.place_all(some, "vec_id", "embedding", keys, x, E.potential_map(E.adaptive_kernel(E.distances(x, x))), ["a", "b"])
        return np.array([[r["a"], r["b"]] for r in made.orderBy("vec_id").collect()])  # 300 rows

    base, rows = run(0), []
    for seed in range(1, 6):
        other = run(seed)
        residual, rms = X.procrustes(base, other)
        rows.append((seed, E.neighbour_overlap(base, other, 10), residual, rms))
    runs = spark.createDataFrame(rows, "run int, overlap double, residual double, rms double")
    return rounded(runs.agg(F.count("*").alias("runs"), *[f(c).alias(f"{c}_{n}") for c in ("overlap", "residual", "rms") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]), *[f"{c}_{n}" for c in ("overlap", "residual", "rms") for n in ("mean", "std")])


@query()
def q_rama_smooth(spark, d):
    """A torsion map of all readings, smoothed periodically and laid on a 45 x 45 grid, as energies."""
    rows = in_cells(spark, d)
    side = lambda m, c: rows.where(F.col("metric") == m).groupBy("variant", "replica", F.floor(F.col("cell") / 3).cast("int").alias(c)).agg(F.count("*").alias(c + "_n"))
    both = side("phi_res4", "x").join(side("psi_res4", "y"), ["variant", "replica"]).groupBy("x", "y").agg(F.sum(F.col("x_n") * F.col("y_n")).cast("double").alias("n")).collect()  # 30 x 30 cells at most
    z = np.zeros((30, 30))
    for r in both:
        z[r["y"], r["x"]] = r["n"]
    s = E.regrid(E.smooth_periodic(z, 1.0), 45, 45)
    f = -P.R * 300 * np.log(np.maximum(s / max(s.sum(), 1e-300), 1e-300))
    f = np.minimum(f - f.min(), np.quantile(f - f.min(), 0.95))
    return spark.createDataFrame([(i, j, round(float(f[i, j]), 6)) for i in range(45) for j in range(45)], "y int, x int, f double")


@query()
def q_gradient(spark, d):
    """Gradients of a feature over the plane of two others, from all rows."""
    g = E.gradient_map(feature_rows(spark, d), "kd_mean", "rg__mean", "e2e__mean", 12)
    return spark.createDataFrame([(i, j, round(float(g[i, j, 0]), 6), round(float(g[i, j, 1]), 6)) for i in range(12) for j in range(12)], "i int, j int, gx double, gy double")


def _tree(spark, d, most=400):
    """(all curve sets, variants of the tree, merges, distances, cells per metric): average linkage of up to `most` variants of
    smallest hash, by their mean JS distance over common metrics."""
    from curvelake.plans.profiles import _sets

    sets, _, sizes = _sets(spark, d)
    some = sorted(sets.orderBy(F.xxhash64("variant"), "variant").limit(most).collect(), key=lambda r: r["variant"])
    m = C.curve_matrix([r["curves"] for r in some], sizes)
    return sets, [r["variant"] for r in some], E.linkage(m), m, sizes


@query()
def q_dendrogram(spark, d):
    """The merges of the tree and, of the leaves, their place from left to right."""
    _, names, merges, _, _ = _tree(spark, d)
    at = {leaf: i for i, leaf in enumerate(E.leaf_order(merges, len(names)))}
    rows = [(i, names[i], at[i], None, None, 0.0, 1) for i in range(len(names))]
    rows += [(len(names) + i, None, None, a, b, round(h, 6), n) for i, (a, b, h, n) in enumerate(merges)]
    return spark.createDataFrame(rows, "node int, variant string, place int, a int, b int, height double, size int")


@query()
def q_dendrogram_clusters(spark, d):
    """Every variant in the cluster of the tree's variant nearest to it, the tree cut at 0.7 of its height."""
    sets, names, merges, m, sizes = _tree(spark, d)
    label = E.cut_tree(merges, len(names), 0.7 * merges[-1][2]) if merges else np.zeros(len(names), int)
    of = spark.createDataFrame([(n, int(c)) for n, c in zip(names, label)], "leaf string, cluster int")
    rest = sets.join(of, sets["variant"] == of["leaf"], "left_anti")
    near = C.nearest_curves(sets.join(of, sets["variant"] == of["leaf"], "left_semi"), rest, "variant", sizes, 1, ("js",))
    placed = near.join(of, near["item"] == of["leaf"]).select(F.col("query").alias("variant"), "cluster", "distance")
    return rounded(of.select(F.col("leaf").alias("variant"), "cluster", F.lit(0.0).alias("distance")).unionByName(placed), "distance")


@query(f"""WITH f AS (SELECT variant, ntile(8) OVER (ORDER BY rg__mean, variant) - 1 AS bin FROM {FEATURE_ROWS} WHERE isfinite(rg__mean)), m AS {MEANS},
s AS (SELECT bin, cell, avg(F_kJ_mol) AS f FROM m JOIN f ON m.variant = f.variant WHERE metric = 'rg' GROUP BY 1, 2), q AS (SELECT bin, cell, f - min(f) OVER (PARTITION BY bin) AS f FROM s)
SELECT bin, cell, round(f, 8) AS f, round(f - lag(f) OVER (PARTITION BY cell ORDER BY bin), 8) AS delta FROM q""")
def q_trajectory(spark, d):
    """Mean curves of equal-count bins along a coordinate and their change from bin to bin."""
    from curvelake.operators import series as S

    rows = feature_rows(spark, d).where(finite(F.col("rg__mean")).isNotNull())
    bins = S.equal_count_bins(rows, [], ["rg__mean", "variant"], 8).select("variant", F.col("bin").cast("bigint").alias("bin"))
    s = cell_means(spark, d).where("metric = 'rg'").join(bins, "variant").groupBy("bin", "cell").agg(F.avg("F_kJ_mol").alias("f"))
    q = s.withColumn("f", F.col("f") - F.min("f").over(Window.partitionBy("bin")))
    return rounded(q.withColumn("delta", F.col("f") - F.lag("f").over(Window.partitionBy("cell").orderBy("bin"))), "f", "delta", places=8)


@query(f"""WITH c AS (SELECT variant, metric, temperature_k, x, F_kJ_mol FROM {PMF} WHERE metric = 'rg'), t AS (SELECT variant, coalesce(median(CASE WHEN temperature_k > 0 THEN temperature_k END), 300) AS t FROM c GROUP BY 1)
SELECT c.variant, round(min(F_kJ_mol) / 4.184, 9) AS kcal, round(min(F_kJ_mol) / (0.008314462618 * greatest(any_value(t), 1)), 9) AS kt, arg_min(x, (F_kJ_mol, x)) AS at_x FROM c JOIN t ON c.variant = t.variant GROUP BY c.variant""")
def q_overlay_minima(spark, d):
    """Each variant's minimum in kcal/mol and kT, and where it lies."""
    c = pmf(spark, d).where("metric = 'rg'")
    t = C.curve_temperature(c, ["variant"])
    low = C.lowest_point(c, ["variant"], "x", "F_kJ_mol").join(t, "variant")
    return rounded(low.select("variant", (F.col("F_kJ_mol") * P.unit_factor("kcal/mol")).alias("kcal"), (F.col("F_kJ_mol") / P.kt(F.col("temperature"))).alias("kt"), F.col("x").alias("at_x")), "kcal", "kt", places=9)


@query("""WITH p AS (SELECT count(*) AS n, count(DISTINCT variant) AS v FROM pmf), f AS (SELECT count(*) AS n, count(DISTINCT variant) AS v FROM features), s AS (SELECT count(*) AS n, count(DISTINCT variant) AS v FROM summary)
SELECT 'pmf' AS "table", n, v AS n_variants FROM p UNION ALL SELECT 'features', n, v FROM f UNION ALL SELECT 'summary', n, v FROM s""")
def q_table_status(spark, d):
    """S17, S23, A34."""
    parts = [table(spark, d, t).agg(F.lit(t).alias("table"), F.count("*").alias("n"), F.countDistinct("variant").alias("n_variants")) for t in ("pmf", "features", "summary")]
    return T.union_by_name(parts)


@query("""WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM (SELECT date_trunc('hour', ts) AS start, * FROM events), m WHERE start + INTERVAL 1 HOUR <= date_trunc('millisecond', mark) GROUP BY start, event_type""")
def q_stream_windows(spark, d):
    """Extension: hourly windows of a file stream, run to its end; windows the watermark has closed."""
    base = os.path.join(shared_dir(spark), f"curvelake-stream-{uuid.uuid4().hex}")
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    made = windows.tumbling(events, "ts", "1 hour", "1 hour", ["event_type"], "value")
    run = made.writeStream.format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.parquet(base + "/out")
    return rounded(out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean", "low", "high"), "mean")


@query(f"""WITH c AS (SELECT p.metric, variant, CASE WHEN g.is_periodic THEN g.x_start + (p.x - g.x_start) - 360 * floor((p.x - g.x_start) / 360) ELSE p.x END AS x, P FROM {PMF} p JOIN metric_grid g ON p.metric = g.metric WHERE P IS NOT NULL),
p AS MATERIALIZED (SELECT metric, variant, floor(x * 10000 + 0.5) / 10000 AS x, avg(greatest(P, 0)) AS v FROM c GROUP BY 1, 2, 3), k AS (SELECT metric, variant FROM p GROUP BY 1, 2 HAVING count(*) >= 2),
n AS (SELECT metric, count(DISTINCT x) AS n, min(x) AS lo, max(x) AS hi FROM p GROUP BY 1), g AS (SELECT DISTINCT p.metric, x FROM p JOIN n ON p.metric = n.metric WHERE n <= 256
  UNION ALL SELECT metric, CASE WHEN i = 255 THEN hi ELSE lo + i * ((hi - lo) / 255) END FROM n, LATERAL (SELECT unnest(range(256)) AS i) WHERE n > 256), a AS (SELECT k.metric, k.variant, g.x FROM k JOIN g ON k.metric = g.metric),
l AS (SELECT a.*, p.x AS lx, p.v AS lv FROM a ASOF LEFT JOIN p ON a.metric = p.metric AND a.variant = p.variant AND a.x >= p.x), r AS (SELECT l.*, p.x AS rx, p.v AS rv FROM l ASOF LEFT JOIN p ON l.metric = p.metric AND l.variant = p.variant AND l.x <= p.x),
i AS (SELECT metric, variant, x, CASE WHEN lx = rx THEN lv WHEN lx IS NULL OR rx IS NULL THEN 0 ELSE lv + (x - lx) / (rx - lx) * (rv - lv) END AS y FROM r),
t AS (SELECT *, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS part FROM i WINDOW w AS (PARTITION BY metric, variant ORDER BY x)), s AS (SELECT *, sum(part) OVER (PARTITION BY metric, variant) AS area FROM t)
SELECT metric, variant, round(x, 6) AS x, round(CASE WHEN area > 0 THEN y / area ELSE y END, 6) AS density FROM s""")
def q_pmf_matrix(spark, d):
    """Densities of all variants and metrics on each metric's shared grid of at most 256 x, angles brought into one turn.

    Variants that lack a metric stay, without rows for it.
    """
    g = table(spark, d, "metric_grid").select("metric", "x_start", "is_periodic")
    turned = F.when(F.col("is_periodic"), F.col("x_start") + F.pmod(F.col("x") - F.col("x_start"), F.lit(360.0))).otherwise(F.col("x"))
    rows = pmf(spark, d).where("P IS NOT NULL").join(F.broadcast(g), "metric").select("metric", "variant", turned.alias("x"), "P")
    return rounded(C.density_matrix(rows, "metric", "variant", "x", "P"), "x", "density")


@query(f"""WITH e AS (SELECT variant, metric, replica FROM {CELLS} WHERE P IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT cell) >= 3),
r AS (SELECT c.variant, c.metric, c.replica, c.cell, avg(greatest(P, 0)) AS y FROM {CELLS} c JOIN e ON c.variant = e.variant AND c.metric = e.metric AND c.replica = e.replica WHERE P IS NOT NULL GROUP BY 1, 2, 3, 4),
m AS (SELECT r.variant, r.metric, r.cell, avg(y) * any_value(g.x_step) + 1e-12 AS m FROM r JOIN metric_grid g ON r.metric = g.metric GROUP BY 1, 2, 3)
SELECT variant, metric, cell, round(m / sum(m) OVER (PARTITION BY variant, metric), 7) AS mass FROM m""")
def q_mass_blocks(spark, d):
    """Masses averaged over replicas, each block with a sum of 1."""
    rows = in_cells(spark, d).where("P IS NOT NULL").join(table(spark, d, "metric_grid").select("metric", "x_step"), "metric")
    return rounded(C.replica_mass(rows, ["variant", "metric"], "replica", "cell", "P", "x_step"), "mass", places=7)


@query()
def q_correlation_report(spark, d):
    """Correlations with p and q values, redundant pairs marked, and their places in the chained order."""
    from curvelake.plans.statistics import _p_values

    made = A.benjamini_hochberg(_p_values(spark, d), "p", ["a", "b"]).withColumn("redundant", F.abs("r") >= 0.8)
    rows = made.select("a", "b", "r").collect()  # a row per pair of columns
    m = np.eye(len(FEATURES))
    for x in rows:
        i, j = FEATURES.index(x["a"]), FEATURES.index(x["b"])
        m[i, j] = m[j, i] = x["r"]
    order = {c: i for i, c in enumerate(X.chained_order(FEATURES, m))}
    place = F.create_map(*[F.lit(v) for kv in order.items() for v in kv])
    return rounded(made.select("a", "b", "n", "r", "p", "q", "redundant", F.element_at(place, F.col("a")).alias("place_a"), F.element_at(place, F.col("b")).alias("place_b")), "r", "p", "q")


@query()
def q_series_report(spark, d):
    """Per series its length, mean, correlation time, effective size and stride."""
    from curvelake.operators import series as S

    keys = ["event_type", "user_id"]
    events = table(spark, d, "events")
    tau = S.correlation_time(S.autocorrelation(events, keys, ["ts", "event_id"], "value", 50), keys)
    mean = events.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return rounded(mean.join(tau, keys, "left").select(*keys, "n", "mean", "std", "tau", "ess", "stride"), "mean", "std", "tau", "ess")


@query(f"""WITH s AS (SELECT variant FROM {FEATURE_ROWS} WHERE kd_mean BETWEEN -0.5 AND 0.5 AND rg__mean BETWEEN 0.8 AND 1.4), m AS {MEANS}, j AS (SELECT m.* FROM m JOIN s ON m.variant = s.variant),
b AS (SELECT *, exp(-least(greatest((F_kJ_mol - min(F_kJ_mol) OVER (PARTITION BY variant, metric)) / {0.008314462618 * 300}, 0), 700)) AS b FROM j), p AS (SELECT variant, metric, cell, b / sum(b) OVER (PARTITION BY variant, metric) AS mass FROM b),
x AS (SELECT metric, cell, sum(mass) AS p FROM p GROUP BY 1, 2) SELECT metric, cell, round(p / sum(p) OVER (PARTITION BY metric), 6) AS p FROM x""")
def q_region_pmf(spark, d):
    """The mixture curve of the variants inside a region of a map."""
    inside = E.in_box(feature_rows(spark, d), "kd_mean", "rg__mean", (-0.5, 0.8), (0.5, 1.4)).select("variant")
    masses = C.density(cell_means(spark, d).join(inside, "variant", "left_semi"), ["variant", "metric"], temperature=None)
    return rounded(C.mixture(masses, ["metric"], "cell", "mass", F.lit(1.0)), "p")


@query()
def q_embedding_report(spark, d):
    """Viable features, torsions balanced, imputed and projected, with the outlier score of each row."""
    ready, columns = X.design(feature_rows(spark, d), FEATURES)
    balanced, columns = X.balance_torsions(ready, columns)
    p = X.Pca(balanced, columns)
    return rounded(p.scores(balanced, 3, ["variant"]), "pc1", "pc2", "pc3")


@query()
def q_sequence_clusters(spark, d):
    """Sequence features clustered by k-means, with each cluster's size and class shift."""
    from curvelake.operators import sequence as Q
    from curvelake.plans.shapes import _sequences

    s = Q.sequence_features(_sequences(spark, d).where("length(s) > 0"), ["variant", "s"], "s")
    vec = s.select("variant", "s", F.array(*[F.col(f"frac_{k}") for k in N.CLASSES], "net_charge").alias("vec"))
    label = E.k_means(vec, "variant", "vec", 4)
    joined = vec.join(label, "variant")
    size = joined.groupBy("cluster").agg(F.count("*").alias("size"))
    return rounded(Q.class_shift(joined, "cluster", "s").join(size, "cluster"), "delta_pp")


@query(f"""WITH r AS (SELECT variant, {', '.join(f'{FIN(c)} AS v{i}' for i, c in enumerate(('rg__effective_support_frac', 'rg__global_basin_escape_barrier_kt', 'rg__local_ruggedness_kt')))} FROM features)
SELECT count(*) AS n, round(max((v0 - (SELECT avg(v0) FROM r)) / (SELECT stddev_samp(v0) FROM r)), 6) AS top FROM r""")
def q_tab_input(spark, d):
    """The input of an embedding from a preset, transformed."""
    f = features(spark, d)
    long = f.select("variant", F.col("rg__effective_support_frac").alias("effective_support_frac"), F.col("rg__global_basin_escape_barrier_kt").alias("global_basin_escape_barrier_kT"), F.col("rg__local_ruggedness_kt").alias("local_ruggedness_kT"))
    made = X.tab_input(long, "pmf_intrinsic", {"effective_support_frac": "zscore", "global_basin_escape_barrier_kT": "log1p_zscore"})
    return rounded(made["rows"].agg(F.count("*").alias("n"), F.max("z_effective_support_frac").alias("top")), "top")
