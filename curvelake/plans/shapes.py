"""Queries over series, table shapes, feature transforms, sequences and vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from curvelake.functions import names as N
from curvelake.operators import embed as E
from curvelake.operators import features as X
from curvelake.operators import sequence as Q
from curvelake.operators import series as S
from curvelake.operators import stats as A
from curvelake.operators import tables as T
from curvelake.plans.common import FEATURE_ROWS, FEATURES, FEATURES_TALL, FIN, PMF, feature_rows, features, pmf, rounded
from curvelake.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SERIES = ["user_id", "event_type"]
_ORDER = ["ts", "event_id"]


@query("""SELECT event_id, round(CASE WHEN count(*) OVER g <= 5 THEN avg(value) OVER g ELSE sum(value) OVER (g ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 END, 6) AS smooth FROM events WINDOW g AS (PARTITION BY user_id, event_type)""")
def q_moving_average(spark, d):
    """W01."""
    return rounded(S.moving_average(table(spark, d, "events"), _SERIES, _ORDER, "value", 5).select("event_id", "smooth"), "smooth")


_ACF = """c AS (SELECT event_type, user_id, row_number() OVER (g ORDER BY ts, event_id) AS i, count(*) OVER g AS n, value - avg(value) OVER g AS dv FROM events WINDOW g AS (PARTITION BY event_type, user_id)),
p AS (SELECT a.event_type, a.user_id, a.i - b.i AS lag, sum(a.dv * b.dv) AS s, any_value(a.n) AS n FROM c a JOIN c b ON a.event_type = b.event_type AND a.user_id = b.user_id AND a.i - b.i BETWEEN 0 AND 300 WHERE a.n >= 3 GROUP BY 1, 2, 3),
z AS (SELECT *, max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY event_type, user_id) AS z FROM p), r AS (SELECT event_type, user_id, lag, s / z AS rho, n FROM z WHERE z > 1e-12)"""


@query(f"WITH {_ACF} SELECT event_type, user_id, CAST(lag AS INTEGER) AS lag, round(rho, 6) AS rho, n FROM r")
def q_acf(spark, d):
    """W09."""
    return rounded(S.autocorrelation(table(spark, d, "events"), ["event_type", "user_id"], _ORDER, "value", 300), "rho")


@query(f"""WITH {_ACF}, m AS (SELECT *, max(CASE WHEN lag > 0 AND rho <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id ORDER BY lag) AS stopped FROM r),
t AS (SELECT event_type, user_id, any_value(n) AS n, greatest(0.5, 0.5 + sum(CASE WHEN lag > 0 AND stopped = 0 THEN rho ELSE 0 END)) AS tau FROM m GROUP BY 1, 2)
SELECT event_type, user_id, n, round(tau, 6) AS tau, round(n / (2 * tau), 6) AS ess, greatest(1, floor(2 * tau + 0.5))::INTEGER AS stride FROM t""")
def q_tau_ess(spark, d):
    """W10, W11."""
    keys = ["event_type", "user_id"]
    return rounded(S.correlation_time(S.autocorrelation(table(spark, d, "events"), keys, _ORDER, "value", 300), keys), "tau", "ess")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events) WHERE (i - 1) % 3 = 0")
def q_stride(spark, d):
    """Every third row of each series."""
    return S.strided(table(spark, d, "events"), _SERIES, _ORDER, 3).select("event_id", "user_id")


@query(f"SELECT variant, ntile(12) OVER (ORDER BY {FIN('rg__mean')}, variant) - 1 AS bin FROM {FEATURE_ROWS} WHERE isfinite(rg__mean)")
def q_ntile_bins(spark, d):
    """Nearly equal counts along one feature."""
    rows = feature_rows(spark, d).where("rg__mean IS NOT NULL AND NOT isnan(rg__mean) AND abs(rg__mean) < double('inf')")
    return S.equal_count_bins(rows, [], ["rg__mean", "variant"], 12).select("variant", F.col("bin").cast("bigint").alias("bin"))


@query(f"""WITH b AS (SELECT ntile(12) OVER (ORDER BY rg__mean, variant) - 1 AS bin, kd_mean FROM {FEATURE_ROWS} WHERE isfinite(rg__mean)), m AS (SELECT bin, avg({FIN('kd_mean')}) AS m FROM b GROUP BY 1)
SELECT bin, round(m, 6) AS mean, round(coalesce(m - lag(m) OVER (ORDER BY bin), 0), 6) AS delta FROM m""")
def q_bin_delta(spark, d):
    """Change from bin to bin along a path."""
    rows = feature_rows(spark, d).where("rg__mean IS NOT NULL AND NOT isnan(rg__mean) AND abs(rg__mean) < double('inf')")
    binned = S.equal_count_bins(rows, [], ["rg__mean", "variant"], 12)
    m = binned.groupBy(F.col("bin").cast("bigint").alias("bin")).agg(F.avg(F.when(~F.isnan("kd_mean") & (F.abs("kd_mean") < float("inf")), F.col("kd_mean"))).alias("mean"))
    return rounded(m.withColumn("delta", F.coalesce(F.col("mean") - F.lag("mean").over(Window.orderBy("bin")), F.lit(0.0))), "mean", "delta")


@query("""WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('click', 'view')),
p AS (SELECT a.user_id, a.i, a.value AS a, b.value AS b, count(*) OVER (PARTITION BY a.user_id) AS n FROM r a JOIN r b ON a.user_id = b.user_id AND a.i = b.i AND a.event_type = 'click' AND b.event_type = 'view')
SELECT user_id, i, a, b FROM p WHERE n >= 8""")
def q_paired_series(spark, d):
    """J08."""
    return S.paired(table(spark, d, "events"), ["user_id"], _ORDER, "event_type", "click", "view", "value").withColumn("i", F.col("i").cast("bigint"))


# Joins and sets


@query(f"SELECT p.variant, p.metric, count(*) AS n, any_value(f.kd_mean) AS kd_mean FROM {PMF} p LEFT JOIN (SELECT variant, min(CASE WHEN isfinite(kd_mean) THEN kd_mean END) AS kd_mean FROM features GROUP BY 1) f ON p.variant = f.variant GROUP BY 1, 2")
def q_annotation_join(spark, d):
    """Columns the left table lacks, one row per key."""
    f = features(spark, d).where("kd_mean IS NOT NULL AND NOT isnan(kd_mean) AND abs(kd_mean) < double('inf')").select("variant", "kd_mean")
    counts = pmf(spark, d).groupBy("variant", "metric").agg(F.count("*").alias("n"))
    return T.annotate(counts, f, "variant")[0].select("variant", "metric", "n", "kd_mean")


@query("WITH c AS (SELECT variant, seq_len, 'new' AS kind FROM (SELECT variant, max(seq_len) AS seq_len FROM features GROUP BY 1)) SELECT s.variant, c.seq_len, c.kind, count(*) AS n FROM summary s JOIN c ON s.variant = c.variant GROUP BY 1, 2, 3")
def q_overlay_join(spark, d):
    """Stale overlay columns are replaced."""
    new = features(spark, d).groupBy("variant").agg(F.max("seq_len").alias("seq_len")).withColumn("kind", F.lit("new"))
    old = table(spark, d, "summary").select("variant").withColumn("kind", F.lit("stale"))
    return T.overlay(old, new, "variant").groupBy("variant", "seq_len", "kind").agg(F.count("*").alias("n"))


@query("SELECT variant FROM pmf WHERE metric IN ('rg', 'e2e') AND variant IS NOT NULL GROUP BY variant HAVING count(DISTINCT metric) = 2")
def q_variant_policies(spark, d):
    """J09, U02."""
    return T.in_all(table(spark, d, "pmf"), "variant", "metric", ["rg", "e2e"])


@query("SELECT DISTINCT variant FROM pmf WHERE variant IS NOT NULL AND variant NOT IN (SELECT variant FROM features WHERE variant IS NOT NULL)")
def q_variant_except(spark, d):
    """J12, U07."""
    return T.without(table(spark, d, "pmf"), features(spark, d), "variant")


@query("SELECT variant, 'replica' AS kind, count(*) AS n FROM pmf WHERE replica > 1 GROUP BY variant UNION ALL SELECT variant, 'pooled', count(*) FROM pmf WHERE replica = 1 AND variant NOT IN (SELECT variant FROM pmf WHERE replica > 1 AND variant IS NOT NULL) GROUP BY variant")
def q_replica_fallback(spark, d):
    """Replicas where there are any, else the pooled rows."""
    p = table(spark, d, "pmf")
    count = lambda rows, kind: rows.where("variant IS NOT NULL" if kind == "pooled" else "true").groupBy("variant").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return T.replicas_or_pooled(count(p.where("replica > 1"), "replica"), count(p.where("replica = 1"), "pooled"), "variant")


@query("SELECT variant, kd_mean, NULL::VARCHAR AS metric, 'f' AS src FROM features UNION ALL SELECT variant, NULL, metric, 's' FROM summary")
def q_union_by_name(spark, d):
    """U01, S10, S11, S19."""
    f = features(spark, d).select("variant", "kd_mean").withColumn("src", F.lit("f"))
    s = table(spark, d, "summary").select("variant", "metric").withColumn("src", F.lit("s"))
    return T.union_by_name([f, s])


@query("SELECT variant, metric, val FROM (SELECT *, row_number() OVER (PARTITION BY variant, metric ORDER BY row_id) AS n FROM summary) WHERE n = 1")
def q_ordered_dedupe(spark, d):
    """U03."""
    return T.first_of(table(spark, d, "summary"), ["variant", "metric"], ["row_id"]).select("variant", "metric", "val")


@query("SELECT variant, count(DISTINCT metric) AS n_metrics, count(DISTINCT curve_id) AS n_curves FROM pmf GROUP BY variant")
def q_distinct_curves(spark, d):
    """U06."""
    return table(spark, d, "pmf").groupBy("variant").agg(F.countDistinct("metric").alias("n_metrics"), F.countDistinct("curve_id").alias("n_curves"))


@query(f"SELECT variant, metric, count(*) AS n FROM {PMF} WHERE metric = 'rg' AND contains(lower(variant), 'pep') GROUP BY 1, 2")
def q_variant_filter(spark, d):
    """Pushed-down equality and a case-insensitive search."""
    return pmf(spark, d).where("metric = 'rg'").where(F.contains(F.lower("variant"), F.lit("pep"))).groupBy("variant", "metric").agg(F.count("*").alias("n"))


@query(f"SELECT curve_id, x, P, F_kJ_mol FROM {PMF}")
def q_validity_filter(spark, d):
    """Rows with finite x and F."""
    return pmf(spark, d).select("curve_id", "x", "P", "F_kJ_mol")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 10")
def q_quality_flags(spark, d):
    """Rows whose flags all hold; null is false; a flag the table lacks is passed over."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("ok_flag"), (F.col("l_quantity") > 10).alias("ok_size"))
    return X.flags_hold(rows, ["ok_flag", "ok_size", "no_such_flag"]).select("l_orderkey", "l_linenumber")


@query(f"SELECT variant FROM (SELECT variant, kd_mean, rg__mean FROM {FEATURE_ROWS}) WHERE kd_mean BETWEEN -0.5 AND 0.5 AND rg__mean BETWEEN 1.0 AND 1.5 AND variant IN (SELECT variant FROM pmf)")
def q_box_select(spark, d):
    """P18, P22."""
    inside = E.in_box(feature_rows(spark, d), "kd_mean", "rg__mean", (0.5, 1.5), (-0.5, 1.0))
    return inside.join(table(spark, d, "pmf").select("variant").distinct(), "variant", "left_semi").select("variant")


@query(f"""WITH c AS (SELECT variant, metric, CAST(round(x, 0) AS BIGINT) AS cell, avg(greatest(P, 0)) AS p FROM {PMF} WHERE P IS NOT NULL GROUP BY 1, 2, 3), n AS (SELECT metric, count(DISTINCT variant) AS n FROM c GROUP BY 1)
SELECT c.metric, c.cell, count(DISTINCT CASE WHEN sqrt(p) > 1e-6 THEN variant END) AS support FROM c JOIN n ON c.metric = n.metric GROUP BY c.metric, c.cell, n.n HAVING count(DISTINCT CASE WHEN sqrt(p) > 1e-6 THEN variant END) >= greatest(3, floor(0.1 * n.n))""")
def q_support_filter(spark, d):
    """Cells enough variants have."""
    c = pmf(spark, d).where("P IS NOT NULL").groupBy("variant", "metric", F.round("x", 0).cast("bigint").alias("cell")).agg(F.avg(F.greatest("P", F.lit(0.0))).alias("p"))
    n = c.groupBy("metric").agg(F.countDistinct("variant").alias("_n"))
    s = c.groupBy("metric", "cell").agg(F.countDistinct(F.when(F.sqrt("p") > 1e-6, F.col("variant"))).alias("support"))
    return s.join(n, "metric").where(F.col("support") >= F.greatest(F.lit(3), F.floor(0.1 * F.col("_n")))).drop("_n")


@query(f"SELECT DISTINCT variant FROM {PMF} ORDER BY variant LIMIT 25")
def q_first_variants(spark, d):
    """T16."""
    return pmf(spark, d).select("variant").distinct().orderBy("variant").limit(25)


@query()
def q_variant_sample(spark, d):
    """A seeded tenth of the variants."""
    return T.sample_keys(table(spark, d, "pmf"), "variant", 0.1, 7)


@query("SELECT metric, variant, starts_with(variant, 'ref_') AS is_ref, n, row_number() OVER (ORDER BY metric, starts_with(variant, 'ref_') DESC, variant) AS place FROM (SELECT metric, variant, count(*) AS n FROM pmf WHERE metric IS NOT NULL AND variant IS NOT NULL GROUP BY 1, 2)")
def q_reference_first(spark, d):
    """T13, T14."""
    g = table(spark, d, "pmf").where("metric IS NOT NULL AND variant IS NOT NULL").groupBy("metric", "variant").agg(F.count("*").alias("n")).withColumn("is_ref", F.startswith("variant", F.lit("ref_")))
    # Places per metric and the metrics' offsets, so that no window holds the whole table.
    inner = g.withColumn("_p", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("is_ref"), "variant")))
    offset = g.groupBy("metric").agg(F.count("*").alias("_n")).withColumn("_o", F.sum("_n").over(Window.orderBy("metric")) - F.col("_n")).drop("_n")
    return inner.join(offset, "metric").select("metric", "variant", "is_ref", "n", (F.col("_p") + F.col("_o")).cast("bigint").alias("place"))


# Shapes


@query("""SELECT variant, min(CASE WHEN metric = 'rg' THEN mean END) AS rg__mean, min(CASE WHEN metric = 'rg' THEN n END) AS rg__n, min(CASE WHEN metric = 'e2e' THEN mean END) AS e2e__mean, min(CASE WHEN metric = 'e2e' THEN n END) AS e2e__n
FROM (SELECT variant, metric, round(avg(CASE WHEN isfinite(F_kJ_mol) THEN F_kJ_mol END), 8) AS mean, count(*) AS n FROM pmf GROUP BY 1, 2) GROUP BY variant""")
def q_summary_pivot(spark, d):
    """R01, S16."""
    finite = F.when(~F.isnan("F_kJ_mol") & (F.abs("F_kJ_mol") < float("inf")), F.col("F_kJ_mol"))
    long = rounded(table(spark, d, "pmf").groupBy("variant", "metric").agg(F.avg(finite).alias("mean"), F.count("*").alias("n")), "mean", places=8)
    return T.pivot_stats(long, "variant", "metric", ["mean", "n"], ["rg", "e2e"])


@query("SELECT variant, feature, round(value, 6) AS value, regexp_extract(feature, 'res([0-9]+)', 1)::INT AS residue FROM (SELECT variant, phi_res4__circular_mean_deg, psi_res4__circular_mean_deg FROM features) UNPIVOT INCLUDE NULLS (value FOR feature IN (phi_res4__circular_mean_deg, psi_res4__circular_mean_deg))")
def q_melt(spark, d):
    """R02, R03."""
    m = T.melt(features(spark, d), ["variant"], ["phi_res4__circular_mean_deg", "psi_res4__circular_mean_deg"])
    return rounded(m.withColumn("residue", F.regexp_extract("feature", r"res(\d+)", 1).cast("int")), "value")


@query("SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def q_category_codes(spark, d):
    """R13."""
    return T.codes(table(spark, d, "documents"), "lang").withColumn("code", F.col("code").cast("bigint"))


@query(f"""WITH v AS (SELECT variant, "column", value FROM {FEATURES_TALL} WHERE "column" IN ('rg__mean', 'e2e__mean', 'sasa__mean', 'rmsd__mean')), m AS (SELECT split_part("column", '__', 1) AS family, variant, avg(value) AS v FROM v WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT family, variant, round(v, 8) AS value, round(coalesce((v - avg(v) OVER (PARTITION BY family)) / stddev_samp(v) OVER (PARTITION BY family), 0), 6) AS z FROM m""")
def q_heatmap(spark, d):
    """One statistic across metrics, z-scored per column."""
    v = A.tall(features(spark, d), ["rg__mean", "e2e__mean", "sasa__mean", "rmsd__mean"], ["variant"]).where("value IS NOT NULL")
    m = v.groupBy(F.split_part("column", F.lit("__"), F.lit(1)).alias("family"), "variant").agg(F.avg("value").alias("value"))
    return rounded(rounded(X.standardise(m, ["family"]), "z"), "value", places=8)


# Transforms and linear algebra


@query(f"""SELECT variant, "column", value, round(CASE WHEN value IS NOT NULL THEN coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 0) END, 6) AS z FROM {FEATURES_TALL} WINDOW w AS (PARTITION BY "column")""")
def q_zscore(spark, d):
    """L01, L07."""
    return rounded(X.standardise(A.tall(features(spark, d), FEATURES, ["variant"]), ["column"]), "z")


@query(f"""WITH t AS (SELECT metric, variant, F_kJ_mol AS value, ln(1 + greatest(F_kJ_mol, 0)) AS p FROM {PMF})
SELECT metric, count(*) AS n, count(z) AS n_z, round(max(z), 6) AS top FROM (SELECT metric, CASE WHEN p IS NOT NULL THEN (p - avg(p) OVER (PARTITION BY metric)) / stddev_samp(p) OVER (PARTITION BY metric) END AS z FROM t) GROUP BY metric""")
def q_zscore_rules(spark, d):
    """log1p z-score inside each metric."""
    t = pmf(spark, d).select("metric", F.lit("f").alias("column"), F.col("F_kJ_mol").alias("value"))
    made = X.transform(t, {"f": "log1p_zscore"}, scope="metric")
    return rounded(made.groupBy("metric").agg(F.count("*").alias("n"), F.count("z").alias("n_z"), F.max("z").alias("top")), "top")


@query("SELECT variant, kd_mean, round(sin(radians(phi_res4__circular_mean_deg)), 9) AS phi_res4__circular_mean_deg_sin, round(cos(radians(phi_res4__circular_mean_deg)), 9) AS phi_res4__circular_mean_deg_cos FROM features")
def q_angle_encoding(spark, d):
    """L08."""
    rows = features(spark, d).select("variant", "kd_mean", "phi_res4__circular_mean_deg")
    return rounded(X.encode_angles(rows, ["phi_res4__circular_mean_deg"]), "phi_res4__circular_mean_deg_sin", "phi_res4__circular_mean_deg_cos", places=9)


_FOUR = ["kd_mean", "rg__mean", "e2e__mean", "sasa__mean"]


@query(f"WITH f AS (SELECT {', '.join(f'median({FIN(c)}) AS {c}' for c in _FOUR)} FROM {FEATURE_ROWS}) SELECT r.variant, {', '.join(f'round(CASE WHEN isfinite(r.{c}) THEN r.{c} ELSE f.{c} END, 9) AS {c}' for c in _FOUR)} FROM {FEATURE_ROWS} r CROSS JOIN f")
def q_impute_median(spark, d):
    """L04, L05, L06."""
    return rounded(X.impute(feature_rows(spark, d), _FOUR).select("variant", *_FOUR), *_FOUR, places=9)


def _pca(spark, d):
    ready = X.impute(feature_rows(spark, d), FEATURES)
    return X.Pca(ready, FEATURES), ready


@query()
def q_pca_scores(spark, d):
    """Scores on four components."""
    p, ready = _pca(spark, d)
    return rounded(p.scores(ready, 4, ["variant"]), "pc1", "pc2", "pc3", "pc4")


@query()
def q_pca_loadings(spark, d):
    """Loadings, shares, effective dimensions and the cut at 99 %."""
    p, _ = _pca(spark, d)
    rows = [(c, j, round(v, 6), round(float(p.shares[j - 1]), 6), round(p.participation, 6), p.reach(0.99)) for c, j, v in p.loadings(4)]
    return spark.createDataFrame(rows, "column string, component int, loading double, share double, participation double, reach_99 int")


@query(f"""WITH m AS (SELECT {', '.join(f'median({FIN(c)}) AS m_{c}' for c in _FOUR)} FROM {FEATURE_ROWS}), i AS (SELECT {', '.join(f'CASE WHEN isfinite(r.{c}) THEN r.{c} ELSE m.m_{c} END AS {c}' for c in _FOUR)} FROM {FEATURE_ROWS} r CROSS JOIN m)
{' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM i" for i, a in enumerate(_FOUR) for b in _FOUR[i:])}""")
def q_covariance(spark, d):
    """L10's matrix: correlations of imputed columns by one aggregate."""
    _, _, cov = X.gram(X.impute(feature_rows(spark, d), _FOUR), _FOUR)
    s = np.sqrt(np.diag(cov))
    r = cov / np.outer(s, s)
    return spark.createDataFrame([(a, b, round(float(r[i, j]), 6)) for i, a in enumerate(_FOUR) for j, b in enumerate(_FOUR) if j >= i], "a string, b string, r double")


@query()
def q_feature_choice(spark, d):
    """Features kept below a correlation of 0.5, and the chained order."""
    rows = A.correlations(feature_rows(spark, d), FEATURES).collect()
    r = np.eye(len(FEATURES))
    for x in rows:
        i, j = FEATURES.index(x["a"]), FEATURES.index(x["b"])
        r[i, j] = r[j, i] = x["r"] if x["r"] is not None else 0.0
    kept, order = X.uncorrelated(FEATURES, r, 0.5), X.chained_order(FEATURES, r)
    return spark.createDataFrame([(c, c in kept, order.index(c)) for c in FEATURES], "column string, kept boolean, place int")


@query(f"""WITH v AS (SELECT rg__mean AS a, e2e__mean AS b FROM {FEATURE_ROWS} WHERE isfinite(rg__mean) AND isfinite(e2e__mean)), e AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM v),
n AS (SELECT least(floor((a - a0) / (a1 - a0) * 16), 15) AS x, least(floor((b - b0) / (b1 - b0) * 16), 15) AS y, count(*)::DOUBLE AS n FROM v CROSS JOIN e GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER () AS p FROM n), q AS (SELECT *, sum(p) OVER (PARTITION BY x) AS px, sum(p) OVER (PARTITION BY y) AS py FROM p),
s AS (SELECT sum(p * ln(p / (px * py))) AS mi, sum(-p * ln(px)) AS h_a, sum(-p * ln(py)) AS h_b FROM q)
SELECT round(mi, 6) AS mi, round(h_a, 6) AS h_a, round(h_b, 6) AS h_b, round(least(greatest(mi / sqrt(h_a * h_b), 0), 1), 6) AS normalised FROM s""")
def q_mutual_information(spark, d):
    """L16."""
    return rounded(X.mutual_information(feature_rows(spark, d), "rg__mean", "e2e__mean"), "mi", "h_a", "h_b", "normalised")


@query()
def q_mutual_information_knn(spark, d):
    """L16 by the distances to the third nearest rows, of up to 2,000 variants of smallest hash; q_mutual_information takes all rows, on bins."""
    rows = feature_rows(spark, d).select("variant", F.array(*[F.col(c).cast("double") for c in _FOUR]).alias("v")).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    m = X.information_matrix(E.fitted_rows(rows, "variant", "v", 2000)[1])
    return spark.createDataFrame([(a, b, round(float(m[i, j]), 6)) for i, a in enumerate(_FOUR) for j, b in enumerate(_FOUR)], "a string, b string, normalised double")


@query()
def q_bootstrap_correlation(spark, d):
    """500 Poisson resamples of a correlation, summed up where the rows are, with the 2.5 and 97.5 percentile."""
    g = X.resampled_grams(feature_rows(spark, d), "variant", ["rg__mean", "e2e__mean"], 500)[:, 0]
    n, sx, sy, sxx, syy, sxy = g[:, 0, 0], g[:, 0, 1], g[:, 0, 2], g[:, 1, 1], g[:, 2, 2], g[:, 1, 2]
    with np.errstate(all="ignore"):
        r = (n * sxy - sx * sy) / np.sqrt((n * sxx - sx**2) * (n * syy - sy**2))
    r = r[np.isfinite(r)]
    low, high = (round(float(np.quantile(r, q)), 6) if len(r) else None for q in (0.025, 0.975))
    return spark.createDataFrame([(len(r), low, high)], "n_boot bigint, low double, high double")


# Sequences


@query(r"""WITH t AS (SELECT variant, list_transform(regexp_extract_all(upper(variant), '[ACDEFGHIKLMNPQRSTVWY]{2,}'), lambda s: s) AS runs FROM (SELECT DISTINCT variant FROM features))
SELECT variant, coalesce(list_filter(runs, lambda r: length(r) = list_max(list_transform(runs, lambda s: length(s))))[1], '') AS sequence FROM t""")
def q_sequence_names(spark, d):
    """F08."""
    return features(spark, d).select("variant").distinct().select("variant", N.residues_in(F.col("variant")).alias("sequence"))


_SEQ = "(SELECT variant, regexp_replace(upper(sequence), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s, CASE WHEN rg__mean > 1.2 THEN 'wide' ELSE 'tight' END AS grp FROM " + FEATURE_ROWS + " WHERE sequence IS NOT NULL AND isfinite(rg__mean))"
_AA = "(SELECT unnest(string_split('A C D E F G H I K L M N P Q R S T V W Y', ' ')) AS aa)"


def _sequences(spark, d):
    rows = feature_rows(spark, d).where("sequence IS NOT NULL AND rg__mean IS NOT NULL AND NOT isnan(rg__mean) AND abs(rg__mean) < double('inf')")
    return rows.select("variant", F.regexp_replace(F.upper("sequence"), f"[^{N.RESIDUES}]", "").alias("s"), F.when(F.col("rg__mean") > 1.2, "wide").otherwise("tight").alias("grp"))


@query(f"WITH c AS (SELECT grp, aa, sum(length(s) - length(replace(s, aa, '')))::BIGINT AS n FROM {_SEQ}, {_AA} GROUP BY 1, 2) SELECT grp, aa, n, round(100.0 * n / sum(n) OVER (PARTITION BY grp), 6)::DOUBLE AS pct FROM c")
def q_composition(spark, d):
    """A23."""
    return rounded(Q.composition(_sequences(spark, d), ["grp"], "s"), "pct")


@query(f"""WITH c AS (SELECT grp, aa, sum(length(s) - length(replace(s, aa, '')))::DOUBLE AS n FROM {_SEQ}, {_AA} GROUP BY 1, 2), p AS (SELECT grp, aa, 100.0 * n / sum(n) OVER (PARTITION BY grp) AS pct FROM c)
SELECT a.aa, round(a.pct - b.pct, 6) AS delta_pp, round((a.pct + 0.05) / (b.pct + 0.05), 6) AS fold, round(log2((a.pct + 0.05) / (b.pct + 0.05)), 6) AS "log2" FROM p a JOIN p b ON a.aa = b.aa AND a.grp = 'wide' AND b.grp = 'tight'""")
def q_enrichment(spark, d):
    """J06, Q01."""
    c = Q.composition(_sequences(spark, d), ["grp"], "s")
    return rounded(Q.enrichment(c.where("grp = 'wide'"), c.where("grp = 'tight'")), "delta_pp", "fold", "log2")


_POS = f"p AS (SELECT grp, i AS pos, substr(s, i::INT, 1) AS aa, count(*) AS n FROM {_SEQ}, LATERAL (SELECT unnest(range(1, length(s) + 1)) AS i) GROUP BY 1, 2, 3), q AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY grp, pos) AS share FROM p)"


@query(f"WITH {_POS} SELECT pos::INT AS pos, aa, n, round(share, 9) AS share FROM q WHERE grp = 'wide'")
def q_position_freq(spark, d):
    """Q02, Q06."""
    return rounded(Q.position_frequencies(_sequences(spark, d).where("grp = 'wide'"), "s"), "share", places=9)


@query(f"""WITH {_POS}, j AS (SELECT coalesce(a.pos, b.pos) AS pos, coalesce(a.aa, b.aa) AS aa, coalesce(a.share, 0) - coalesce(b.share, 0) AS d FROM (SELECT * FROM q WHERE grp = 'wide') a FULL JOIN (SELECT * FROM q WHERE grp = 'tight') b ON a.pos = b.pos AND a.aa = b.aa)
SELECT pos::INT AS pos, arg_max(aa, (round(abs(d), 9), aa)) AS aa, round(arg_max(d, (round(abs(d), 9), aa)), 9) AS delta, round(sum(abs(d)) / 2, 9) AS variation FROM j GROUP BY pos""")
def q_grammar(spark, d):
    """Q03, Q04."""
    rows = _sequences(spark, d)
    return rounded(Q.grammar(Q.position_frequencies(rows.where("grp = 'wide'"), "s"), Q.position_frequencies(rows.where("grp = 'tight'"), "s")), "delta", "variation", places=9)


_KMERS = lambda k: f"SELECT {k} AS k, substr(s, i::INT, {k}) AS kmer, count(*) AS n FROM {_SEQ}, LATERAL (SELECT unnest(range(1, length(s) - {k} + 2)) AS i) GROUP BY 2"


@query(" UNION ALL ".join(f"(SELECT * FROM ({_KMERS(k)}) ORDER BY n DESC, kmer LIMIT 64)" for k in (2, 3, 4)))
def q_kmer_top(spark, d):
    """Q07."""
    return Q.top_kmers(_sequences(spark, d), "s", (2, 3, 4), 64)


@query(f"""WITH o AS (SELECT grp, substr(s, i::INT, 3) AS kmer, count(*) AS n FROM {_SEQ}, LATERAL (SELECT unnest(range(1, length(s) - 1)) AS i) GROUP BY 1, 2),
a AS (SELECT *, sum(n) OVER (PARTITION BY kmer) AS al, sum(n) OVER (PARTITION BY grp) AS sz, sum(n) OVER () AS tot FROM o), f AS (SELECT grp, kmer, n, ((n + 0.5::DOUBLE) / (sz + 0.5::DOUBLE)) / ((al - n + 0.5::DOUBLE) / (tot - sz + 0.5::DOUBLE)) AS fold FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(fold, 9) DESC, n DESC, kmer) AS place FROM f) SELECT grp, kmer, n, round(fold, 6) AS fold, place::INT AS place FROM r WHERE place <= 5""")
def q_motif_enrich(spark, d):
    """A30, Q08."""
    return rounded(Q.enriched_motifs(_sequences(spark, d), "grp", "s", 3), "fold")


_CLASS = "CASE " + " ".join(f"WHEN aa IN ({', '.join(repr(a) for a in c)}) THEN '{k}'" for k, c in N.CLASSES.items()) + " END"


@query(f"""WITH p AS (SELECT grp, {_CLASS} AS residue_class, sum(length(s) - length(replace(s, aa, '')))::DOUBLE AS n FROM {_SEQ}, {_AA} GROUP BY 1, 2),
dl AS (SELECT grp, residue_class, 100.0 * (n / sum(n) OVER (PARTITION BY grp) - sum(n) OVER (PARTITION BY residue_class) / sum(n) OVER ()) AS delta_pp FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(abs(delta_pp), 9) DESC, residue_class) AS place FROM dl) SELECT grp, residue_class, round(delta_pp, 6) AS delta_pp, place::INT AS place FROM r WHERE place <= 4""")
def q_class_shift(spark, d):
    """Q09."""
    return rounded(Q.class_shift(_sequences(spark, d), "grp", "s"), "delta_pp")


_RUN = lambda chars: f"coalesce(list_max(list_transform(regexp_extract_all(s, '[{chars}]+'), lambda r: length(r))), 0)"
_SHARE = lambda chars: f"(length(s) - length(regexp_replace(s, '[{chars}]', '', 'g')))"
_GREASY = N.CLASSES["hydrophobic"] + N.CLASSES["aromatic"]


@query(f"""SELECT variant, length(s)::INT AS length, {', '.join(f"round({_SHARE(c)}::DOUBLE / length(s), 9) AS {name}" for name, c in [*((f'aa_{a}', a) for a in N.RESIDUES), *((f'frac_{k}', c) for k, c in N.CLASSES.items()), ('charge_density', 'KRDE'), ('hydrophobic_frac', _GREASY)])},
{', '.join(f"(strpos('{c}', {at}) > 0)::INT AS {end}_{k}" for end, at in (('n_term', 'left(s, 1)'), ('c_term', 'right(s, 1)')) for k, c in N.CLASSES.items())},
round(({_SHARE('KR')} - {_SHARE('DE')})::DOUBLE / length(s), 9) AS net_charge, round({_RUN(_GREASY)}::DOUBLE / length(s), 9) AS hydrophobic_run_frac, round({_RUN('GP')}::DOUBLE / length(s), 9) AS gp_run_frac FROM {_SEQ} WHERE length(s) > 0""")
def q_sequence_features(spark, d):
    """F09, F11, Q05, Q10."""
    made = Q.sequence_features(_sequences(spark, d).where("length(s) > 0"), ["variant"], "s")
    return rounded(made, *[c for c, t in made.dtypes if t == "double"], places=9)


@query(f"""WITH p AS (SELECT variant, i, substr(s, i::INT, 1) AS aa FROM {_SEQ}, LATERAL (SELECT unnest(range(1, length(s) + 1)) AS i))
SELECT variant, 'pos' || i || '_' || aa AS "column", 1 AS value FROM p UNION ALL SELECT variant, 'pos' || i || '_class_' || {_CLASS}, 1 FROM p""")
def q_one_hot(spark, d):
    """Q06, all positions."""
    return Q.one_hot(_sequences(spark, d), ["variant"], "s", None)


# Vectors


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), neighbour) AS place FROM p) SELECT query, neighbour, round(distance, 6) AS distance, place::INT AS place FROM r WHERE place <= 5""")
def q_knn(spark, d):
    """Five nearest of every vector whose id is divisible by 20, among all."""
    e = table(spark, d, "embeddings")
    return rounded(E.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5), "distance")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query, e.vec_id AS neighbour, 1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), neighbour) AS place FROM p) SELECT query, neighbour, round(distance, 6) AS distance, place::INT AS place FROM r WHERE place <= 3""")
def q_cosine_knn(spark, d):
    """E03."""
    e = table(spark, d, "embeddings")
    return rounded(E.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 3, "cosine"), "distance")


@query()
def q_kmeans(spark, d):
    """E16."""
    return E.k_means(table(spark, d, "embeddings"), "vec_id", "embedding", 10)


def _map(spark, d, name, dims, make, most=E.FIT):
    """Every vector's coordinates: make(distances) of up to `most` fitted vectors, the others placed beside them."""
    e = table(spark, d, "embeddings")
    keys, x = E.fitted_rows(e, "vec_id", "embedding", most)
    names = [f"{name}{i + 1}" for i in range(dims)]
    return rounded(E.place_all(e, "vec_id", "embedding", keys, x, make(E.distances(x, x)), names), *names)


@query()
def q_diffusion_map(spark, d):
    """E05, E06."""
    return _map(spark, d, "dc", 2, lambda m: E.diffusion_map(E.adaptive_kernel(m), 2)[0])


@query()
def q_diffusion_replica(spark, d):
    """The other operator."""
    return _map(spark, d, "dc", 6, lambda m: E.diffusion_map(E.adaptive_kernel(m), 6, normalised=True)[0])


@query()
def q_scaling(spark, d):
    """E08."""
    return _map(spark, d, "mds", 2, E.classical_scaling)


@query()
def q_potential_map(spark, d):
    """E09."""
    return _map(spark, d, "ph", 2, lambda m: E.potential_map(E.adaptive_kernel(m)))


@query()
def q_isomap(spark, d):
    """E10, E21."""
    return _map(spark, d, "iso", 2, E.isomap, 400)


@query()
def q_neighbour_map(spark, d):
    """A UMAP-like layout."""
    return _map(spark, d, "u", 2, lambda m: E.neighbour_map(m, 15), 400)


@query()
def q_density_map(spark, d):
    """The same with DensMAP's density term."""
    return _map(spark, d, "u", 2, lambda m: E.neighbour_map(m, 15, dens=2.0), 400)


@query()
def q_linkage(spark, d):
    """Average linkage of the fitted vectors, cut where the silhouette is best; every vector in its nearest one's cluster."""
    e = table(spark, d, "embeddings")
    _, x = E.fitted_rows(e, "vec_id", "embedding", 400)
    label, k = E.auto_clusters(E.distances(x, x))
    return E.label_all(e, "vec_id", "embedding", x, label).withColumn("k", F.lit(k))


@query()
def q_dbscan(spark, d):
    """Cluster sizes over all vectors; DBSCAN on the fitted ones, every other one joins a core within eps or is noise."""
    e = table(spark, d, "embeddings")
    _, x = E.fitted_rows(e, "vec_id", "embedding")
    near = E.distances(x, x)
    eps = float(np.quantile(np.sort(near, 1)[:, min(4, len(x) - 1)], 0.6))
    label = E.label_all(e, "vec_id", "embedding", x, E.dbscan(x, eps, 4), eps)
    sizes = label.groupBy(F.when(F.col("cluster") < 0, F.lit("noise")).otherwise(F.concat(F.lit("C"), "cluster")).alias("cluster")).agg(F.count("*").alias("n"))
    return rounded(sizes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))), "share")


@query(f"""WITH p AS (SELECT variant, kd_mean AS x, rg__mean AS y FROM {FEATURE_ROWS} WHERE isfinite(kd_mean) AND isfinite(rg__mean)), t AS (SELECT *, greatest(0, least(1, (x + 1) / 1 * 1.0 + 0 * y)) AS t1, greatest(0, least(1, (y - 1.2) / 1.0)) AS t2 FROM p),
o AS (SELECT variant, sqrt((x - (-1 + t1)) ** 2 + (y - 1.2) ** 2) AS o1, t1 AS s1, sqrt((x - 0) ** 2 + (y - (1.2 + t2)) ** 2) AS o2, 1 + t2 AS s2 FROM t)
SELECT variant, round(CASE WHEN o2 < o1 THEN s2 ELSE s1 END, 6) AS s, round(least(o1, o2), 6) AS off FROM o""")
def q_polyline(spark, d):
    """Place along a path of two segments."""
    rows = feature_rows(spark, d).where("kd_mean IS NOT NULL AND rg__mean IS NOT NULL AND NOT isnan(kd_mean) AND NOT isnan(rg__mean) AND abs(kd_mean) < double('inf') AND abs(rg__mean) < double('inf')")
    return rounded(E.polyline_position(rows, "kd_mean", "rg__mean", [(-1.0, 1.2), (0.0, 1.2), (0.0, 2.2)]).select("variant", "s", "off"), "s", "off")


_Z = "SELECT variant, kd_mean AS x, rg__mean AS y FROM " + FEATURE_ROWS


@query(f"""WITH p AS ({_Z}), w AS (SELECT * FROM p WHERE isfinite(x) AND isfinite(y)), m AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_samp(x) AS dx, stddev_samp(y) AS dy, corr(x, y) AS r FROM w),
c AS (SELECT variant, CASE WHEN isfinite(x) AND isfinite(y) THEN ((x - mx) / dx + CASE WHEN r < 0 THEN -1 ELSE 1 END * (y - my) / dy) / sqrt(2) END AS s FROM p CROSS JOIN m),
l AS (SELECT variant, CASE WHEN isfinite(x) AND isfinite(y) THEN greatest(0, least(1, ((x + 1) * 2 + (y - 1) * 1) / 5.0)) * sqrt(5) END AS s FROM p)
SELECT variant, 'xy' AS mode, round(s, 6) AS s FROM c UNION ALL SELECT variant, 'line', round(s, 6) FROM l UNION ALL SELECT variant, 'axis2', round(CASE WHEN isfinite(y) THEN y END, 6) FROM p""")
def q_path_coordinate(spark, d):
    """Places along the composite of two axes, along a line between two anchors, and along one axis."""
    from curvelake.operators.grid import finite

    rows = feature_rows(spark, d).select("variant", finite(F.col("kd_mean")).alias("x"), finite(F.col("rg__mean")).alias("y"))
    made = [E.path_coordinate(rows, "variant", ["x", "y"], m, [(-1.0, 1.0), (1.0, 2.0)]).select("variant", F.lit(m).alias("mode"), "s") for m in ("xy", "line", "axis2")]
    return rounded(made[0].unionByName(made[1]).unionByName(made[2]), "s")


@query()
def q_geodesic(spark, d):
    """Places along the shortest way over neighbouring variants between two anchors."""
    from curvelake.operators.grid import finite

    rows = feature_rows(spark, d).select("variant", finite(F.col("kd_mean")).alias("x"), finite(F.col("rg__mean")).alias("y")).dropna()
    return rounded(E.path_coordinate(rows, "variant", ["x", "y"], "geodesic", [(-1.0, 1.0), (1.0, 2.0)], most=400).select("variant", "s"), "s")
