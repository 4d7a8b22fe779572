"""Queries over descriptive statistics, coverage, histograms and correlations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curvelake.functions import names as N
from curvelake.functions.physics import p_of_r
from curvelake.operators import stats as S
from curvelake.plans.common import CELLS, FEATURE_ROWS, FEATURES, FEATURES_TALL, FIN, PMF, feature_rows, features, in_cells, pmf, rounded
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


@query(f"""
SELECT "column", count(value) AS "count", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
  round(quantile_cont(value, 0.25), 8) AS p25, round(quantile_cont(value, 0.5), 8) AS p50, round(quantile_cont(value, 0.75), 8) AS p75, max(value) AS max
FROM {FEATURES_TALL} GROUP BY "column" """)
def q_describe(spark, d):
    return rounded(rounded(S.describe(features(spark, d), FEATURES), "mean", "std"), "p25", "p50", "p75", places=8)


@query("""
SELECT count(*) AS rows, 9::BIGINT AS cols, count(DISTINCT variant) AS n_variant, count(DISTINCT metric) AS n_metric, count(DISTINCT replica) AS n_replica,
  sum((curve_id IS NULL)::BIGINT + (variant IS NULL)::BIGINT + (metric IS NULL)::BIGINT + (replica IS NULL)::BIGINT + (written_at IS NULL)::BIGINT
    + (x IS NULL OR isnan(x))::BIGINT + (P IS NULL OR isnan(P))::BIGINT + (F_kJ_mol IS NULL OR isnan(F_kJ_mol))::BIGINT + (temperature_k IS NULL OR isnan(temperature_k))::BIGINT)::BIGINT AS missing,
  round(100.0 * missing::DOUBLE / (count(*) * 9), 6) AS missing_pct FROM pmf""")
def q_overview(spark, d):
    made = S.overview(table(spark, d, "pmf"), ["variant", "metric", "replica"])
    return rounded(made.withColumn("missing", F.col("missing").cast("bigint")), "missing_pct")


_COLS = ["variant", "sequence", "seq_len", "kd_mean", "rg__mean", "rg__std", "e2e__mean", "sasa__mean", "rmsd__mean", "phi_res4__circular_mean_deg", "psi_res4__circular_mean_deg", "rg__effective_support_frac", "rg__global_basin_escape_barrier_kt", "rg__local_ruggedness_kt", "exported_at"]
_DOUBLES = [c for c in _COLS if c not in ("variant", "sequence", "seq_len", "exported_at")]
_GONE = lambda c: f"({c} IS NULL OR isnan({c}))" if c in _DOUBLES else f"({c} IS NULL)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({_GONE(c)}) AS missing, round(100.0 * count(*) FILTER ({_GONE(c)})::DOUBLE / count(*), 6) AS pct FROM features" for c in _COLS))
def q_missing_columns(spark, d):
    return rounded(S.missing_by_column(features(spark, d)), "pct")


@query(f"""
SELECT variant, round(avg(({' + '.join(f'{_GONE(c)}::INT' for c in FEATURES)})::DOUBLE / {len(FEATURES)}), 6) AS missing_share FROM features GROUP BY variant
ORDER BY avg(({' + '.join(f'{_GONE(c)}::INT' for c in FEATURES)})::DOUBLE / {len(FEATURES)}) DESC, variant LIMIT 200""")
def q_missing_variants(spark, d):
    return rounded(S.missing_by_row(features(spark, d), "variant", FEATURES), "missing_share")


@query("""
WITH p AS (SELECT DISTINCT variant, metric FROM pmf WHERE variant IS NOT NULL AND metric IS NOT NULL),
m AS (SELECT DISTINCT metric FROM p), v AS (SELECT DISTINCT variant FROM p),
c AS (SELECT v.variant, m.metric, p.metric AS have FROM v CROSS JOIN m LEFT JOIN p ON p.variant = v.variant AND p.metric = m.metric)
SELECT variant, count(have) AS present, count(*) - count(have) AS missing, count(*) AS total,
  coalesce(array_to_string((list(metric ORDER BY metric) FILTER (have IS NULL))[1:25], ','), '') AS missing_items
FROM c GROUP BY variant ORDER BY missing DESC, variant LIMIT 200""")
def q_metric_coverage(spark, d):
    return S.coverage(table(spark, d, "pmf"), "variant", "metric")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(DISTINCT variant) AS n_keys, count(DISTINCT variant) FILTER (variant IN (SELECT variant FROM features)) AS in_base FROM {t}" for t in ("features", "pmf", "summary", "chunk_rows", "documents")))
def q_table_coverage(spark, d):
    return S.shared_keys({t: table(spark, d, t) for t in ("features", "pmf", "summary", "chunk_rows", "documents")}, "variant", "features")


@query(f"SELECT metric, count(*) AS n_rows, count(DISTINCT variant) AS n_variants, count(DISTINCT replica) AS n_replicas, count(DISTINCT curve_id) AS n_curves FROM {PMF} GROUP BY metric")
def q_status_counts(spark, d):
    return pmf(spark, d).groupBy("metric").agg(F.count("*").alias("n_rows"), F.countDistinct("variant").alias("n_variants"), F.countDistinct("replica").alias("n_replicas"), F.countDistinct("curve_id").alias("n_curves"))


@query(f"""SELECT variant, mode, n FROM (SELECT variant, metric AS mode, count(*) AS n, row_number() OVER (PARTITION BY variant ORDER BY count(*) DESC, metric) AS r FROM {PMF} GROUP BY variant, metric) WHERE r = 1""")
def q_variant_mode(spark, d):
    return S.typical_value(pmf(spark, d), ["variant"], "metric")


@query("SELECT label, count(*) AS n, list(vec_id ORDER BY vec_id)[1:5] AS members FROM embeddings GROUP BY label")
def q_cluster_members(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    ranked = table(spark, d, "embeddings").withColumn("_r", F.row_number().over(w))
    return ranked.groupBy("label").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= 5, F.col("vec_id")))).alias("members"))


@query("SELECT metric, CASE WHEN count(P) > 0 THEN true ELSE false END AS has_p, CASE WHEN count(F_kJ_mol) > 0 THEN true ELSE false END AS has_f, CASE WHEN count(temperature_k) > 0 THEN true ELSE false END AS has_t FROM pmf GROUP BY metric")
def q_nonempty_columns(spark, d):
    has = lambda c, n: (F.count(c) > 0).alias(n)
    return table(spark, d, "pmf").groupBy("metric").agg(has("P", "has_p"), has("F_kJ_mol", "has_f"), has("temperature_k", "has_t"))


@query(f"""
WITH v AS (SELECT metric, F_kJ_mol AS v FROM {PMF}), e AS (SELECT metric, min(v) AS lo, max(v) AS hi FROM v GROUP BY metric)
SELECT v.metric, CAST(least(floor((v - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin, round(lo + (hi - lo) / 40 * CAST(least(floor((v - lo) / (hi - lo) * 40), 39) AS INTEGER), 6) AS "left", count(*) AS n
FROM v JOIN e ON v.metric = e.metric WHERE hi > lo GROUP BY v.metric, 2, lo, hi""")
def q_hist1d(spark, d):
    return rounded(S.histogram(pmf(spark, d), "F_kJ_mol", ["metric"], 40), "left")


@query(f"""
WITH v AS (SELECT metric, F_kJ_mol AS a, P AS b FROM {PMF} WHERE P IS NOT NULL), e AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM v)
SELECT metric, CAST(least(floor((a - a0) / (a1 - a0) * 30), 29) AS INTEGER) AS xbin, CAST(least(floor((b - b0) / (b1 - b0) * 30), 29) AS INTEGER) AS ybin, count(*) AS n FROM v CROSS JOIN e GROUP BY 1, 2, 3""")
def q_hist2d(spark, d):
    return S.histogram2d(pmf(spark, d), "F_kJ_mol", "P", ["metric"], 30)


@query(f"""
WITH c AS (SELECT metric, cell, CAST(count(*) AS DOUBLE) AS w FROM {CELLS} GROUP BY metric, cell), m AS (SELECT metric, sum(w * cell) / sum(w) AS mean FROM c GROUP BY metric),
s AS (SELECT c.metric, mean, sum(w * (cell - mean) ** 2) / sum(w) AS m2, sum(w * (cell - mean) ** 3) / sum(w) AS m3, sum(w * (cell - mean) ** 4) / sum(w) AS m4 FROM c JOIN m ON c.metric = m.metric GROUP BY c.metric, mean)
SELECT metric, round(mean, 6) AS mean, round(m2, 6) AS variance, round(m3 / m2 ** 1.5, 6) AS skew, round(m4 / m2 ** 2 - 3, 6) AS kurtosis FROM s""")
def q_hist_moments(spark, d):
    counts = in_cells(spark, d).groupBy("metric", "cell").agg(F.count("*").cast("double").alias("w"))
    return rounded(S.moments(counts, ["metric"], "cell", "w"), "mean", "variance", "skew", "kurtosis")


@query(f"""
WITH a AS (SELECT metric, variant, avg(cos(radians(x))) AS c, avg(sin(radians(x))) AS s FROM {PMF} WHERE metric LIKE 'phi%' OR metric LIKE 'psi%' GROUP BY metric, variant)
SELECT metric, variant, round(CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END, 5) AS mean_deg, round(sqrt(c * c + s * s), 6) AS r, round(1 - sqrt(c * c + s * s), 6) AS variance FROM a""")
def q_circular_stats(spark, d):
    angles = pmf(spark, d).where(N.torsion(F.col("metric")).isNotNull())
    return rounded(rounded(S.circular(angles, ["metric", "variant"], "x"), "mean_deg", places=5), "r", "variance")


@query(f"""
WITH a AS (SELECT variant, replica, cell, avg(x) AS phi FROM {CELLS} WHERE metric = 'phi_res4' GROUP BY variant, replica, cell), b AS (SELECT variant, replica, cell, avg(x) AS psi, avg(coalesce(P, 0)) AS p FROM {CELLS} WHERE metric = 'psi_res4' GROUP BY variant, replica, cell),
j AS (SELECT a.variant, phi - 360 * floor((phi + 180) / 360) AS phi, psi - 360 * floor((psi + 180) / 360) AS psi, p FROM a JOIN b ON a.variant = b.variant AND a.replica = b.replica AND a.cell = b.cell),
s AS (SELECT variant, sum(p) AS t, sum(CASE WHEN phi >= -100 AND phi < -30 AND psi >= -80 AND psi < -5 THEN p ELSE 0 END) AS a, sum(CASE WHEN phi >= -180 AND phi < -40 AND psi >= 90 AND psi < 180 THEN p ELSE 0 END) AS b, sum(CASE WHEN phi >= 30 AND phi < 100 AND psi >= 0 AND psi < 90 THEN p ELSE 0 END) AS l FROM j GROUP BY variant)
SELECT variant, round(a / t, 6) AS alpha, round(b / t, 6) AS beta, round(l / t, 6) AS left_alpha, round(greatest(0, 1 - (a + b + l) / t), 6) AS other FROM s WHERE t > 0""")
def q_rama_regions(spark, d):
    from curvelake.functions.physics import wrap180

    rows = in_cells(spark, d)
    keys = ["variant", "replica", "cell"]
    phi = rows.where("metric = 'phi_res4'").groupBy(*keys).agg(wrap180(F.avg("x")).alias("phi"))
    psi = rows.where("metric = 'psi_res4'").groupBy(*keys).agg(wrap180(F.avg("x")).alias("psi"), F.avg(F.coalesce("P", F.lit(0.0))).alias("p"))
    made = S.rama_populations(phi.join(psi, keys), ["variant"], "phi", "psi", F.col("p"))
    return rounded(made.where("alpha IS NOT NULL"), "alpha", "beta", "left_alpha", "other")


_PAIRS = S.pair_list(FEATURES)


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (isfinite({a}::DOUBLE) AND isfinite({b}::DOUBLE)) AS n, round(corr({FIN(f'{a}::DOUBLE')}, {FIN(f'{b}::DOUBLE')}), 6) AS r FROM {FEATURE_ROWS}" for a, b in _PAIRS))
def q_pearson_pairs(spark, d):
    return rounded(S.correlations(feature_rows(spark, d), FEATURES), "r")


@query(f"""
SELECT a, b, n, r FROM ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (isfinite({a}::DOUBLE) AND isfinite({b}::DOUBLE)) AS n, round(corr({FIN(f'{a}::DOUBLE')}, {FIN(f'{b}::DOUBLE')}), 6) AS r FROM {FEATURE_ROWS}" for a, b in _PAIRS)}) ORDER BY abs(r) DESC NULLS LAST, a, b LIMIT 100""")
def q_top_correlations(spark, d):
    """Pairs by absolute correlation."""
    return rounded(S.correlations(feature_rows(spark, d), FEATURES), "r").orderBy(F.abs("r").desc_nulls_last(), "a", "b").limit(100)


_SIX = ["kd_mean", "rg__mean", "e2e__mean", "sasa__mean"]
_RANK = lambda c: f"CASE WHEN isfinite({c}) THEN rank() OVER (PARTITION BY isfinite({c}) ORDER BY {c}) + (count(*) OVER (PARTITION BY isfinite({c}), {c}) - 1) / 2.0 END"


@query(f"""WITH r AS (SELECT {', '.join(f'({_RANK(c)})::DOUBLE AS rank_{c}' for c in _SIX)} FROM {FEATURE_ROWS})
{' UNION ALL '.join(f"SELECT 'rank_{a}' AS a, 'rank_{b}' AS b, count(*) FILTER (rank_{a} IS NOT NULL AND rank_{b} IS NOT NULL) AS n, round(corr(rank_{a}, rank_{b}), 6) AS r FROM r" for a, b in S.pair_list(_SIX))}""")
def q_avg_rank_spearman(spark, d):
    """Average ranks of each column, then their correlation."""
    ranks = S.average_ranks(feature_rows(spark, d), _SIX)
    return rounded(S.correlations(ranks, [f"rank_{c}" for c in _SIX]), "r")


@query(f"""WITH c AS ({' UNION ALL '.join(f"SELECT '{c}' AS \"column\", count(*) FILTER (isfinite({c}::DOUBLE) AND isfinite(rg__mean)) AS n, corr({FIN(f'{c}::DOUBLE')}, {FIN('rg__mean')}) AS r FROM {FEATURE_ROWS}" for c in FEATURES if c != 'rg__mean')})
SELECT "column", n, round(r, 6) AS r FROM c WHERE n >= 4 ORDER BY abs(r) DESC NULLS LAST, "column" LIMIT 60""")
def q_target_correlation(spark, d):
    """Every feature against one target, over pairs of at least four."""
    other = [c for c in FEATURES if c != "rg__mean"]
    made = S.correlations(feature_rows(spark, d), ["rg__mean", *other]).where("a = 'rg__mean' AND n >= 4")
    return rounded(made.select(F.col("b").alias("column"), "n", "r").orderBy(F.abs("r").desc_nulls_last(), "column").limit(60), "r")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1, 2")
def q_regression(spark, d):
    made = S.regression(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return rounded(rounded(made, "slope", "r2"), "intercept", places=4)


def _p_values(spark, d):
    """The correlations of all pairs of features, a row each, with their p values."""
    rows = S.correlations(feature_rows(spark, d), FEATURES).where("r IS NOT NULL AND NOT isnan(r)")
    found = [(r["a"], r["b"], r["n"], r["r"], p_of_r(r["r"], r["n"])) for r in rows.collect()]  # a row per pair of columns
    return spark.createDataFrame(found, "a string, b string, n bigint, r double, p double")


@query()
def q_bh_fdr(spark, d):
    """Two-sided p values of the correlations, Benjamini-Hochberg q values and stars."""
    made = S.benjamini_hochberg(_p_values(spark, d), "p", ["a", "b"])
    return rounded(made.withColumn("stars", N.stars(F.col("q"))), "r", "p", "q")


@query("""WITH p AS (SELECT o_orderkey, (o_orderkey % 1000 + 0.5) / 1000.0 AS p FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY p, o_orderkey) AS k, count(*) OVER () AS n FROM p)
SELECT o_orderkey, round(p::DOUBLE, 9) AS p, round(least(min(p::DOUBLE * n / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0), 9) AS q FROM r""")
def q_bh_adjust(spark, d):
    """W16 on plain numbers, against SQL."""
    tests = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 1000 + 0.5) / 1000.0).alias("p"))
    return rounded(S.benjamini_hochberg(tests, "p", ["o_orderkey"]), "p", "q", places=9)


@query(f"""
WITH v AS (SELECT "column", value, avg(value) OVER (PARTITION BY "column") AS m, median(value) OVER (PARTITION BY "column") AS md FROM {FEATURES_TALL} WHERE value IS NOT NULL)
SELECT "column", round(var_samp(value), 6) AS variance, round(var_samp(value) / (median(abs(value - md)) + 1e-12), 4) AS snr FROM v GROUP BY "column" ORDER BY variance DESC, "column" LIMIT 5""")
def q_top_variance(spark, d):
    """Features by variance, with variance over the median absolute deviation."""
    v = S.tall(features(spark, d), FEATURES).where("value IS NOT NULL")
    mid = v.groupBy("column").agg(F.median("value").alias("md"))
    made = v.join(F.broadcast(mid), "column").groupBy("column").agg(F.var_samp("value").alias("variance"), (F.var_samp("value") / (F.median(F.abs(F.col("value") - F.col("md"))) + 1e-12)).alias("snr"))
    return rounded(rounded(made, "variance"), "snr", places=4).orderBy(F.desc("variance"), "column").limit(5)


@query(f"""
WITH z AS (SELECT variant, {' + '.join(f"coalesce((({c}::DOUBLE - (SELECT avg({FIN(f'{c}::DOUBLE')}) FROM {FEATURE_ROWS})) / (SELECT stddev_samp({FIN(f'{c}::DOUBLE')}) FROM {FEATURE_ROWS})) ** 2 * (CASE WHEN isfinite({c}::DOUBLE) THEN 1 END), 0)" for c in _SIX)} AS score FROM {FEATURE_ROWS})
SELECT variant, round(score, 6) AS score, score > (SELECT quantile_cont(score, 0.95) FROM z) AS over_95, score > (SELECT quantile_cont(score, 0.99) FROM z) AS over_99 FROM z""")
def q_outlier_score(spark, d):
    """Sum of squared z values, flagged above the 95th and 99th percentile."""
    from curvelake.operators.grid import finite

    rows = feature_rows(spark, d).select("variant", *[finite(F.col(c)).alias(c) for c in _SIX])
    ref = rows.agg(*[f(c).alias(f"{n}_{c}") for c in _SIX for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    score = sum((F.coalesce(((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")) ** 2, F.lit(0.0)) for c in _SIX), F.lit(0.0))
    scored = rows.join(F.broadcast(ref)).select("variant", score.alias("score"))
    cut = scored.agg(F.percentile("score", F.lit(0.95)).alias("a"), F.percentile("score", F.lit(0.99)).alias("b"))
    return rounded(scored.join(F.broadcast(cut)).select("variant", "score", (F.col("score") > F.col("a")).alias("over_95"), (F.col("score") > F.col("b")).alias("over_99")), "score")


@query(f"""SELECT "column", round(quantile_cont(value, 0.02), 8) AS low, round(quantile_cont(value, 0.98), 8) AS high FROM {FEATURES_TALL} GROUP BY "column" """)
def q_percentile_pair(spark, d):
    q = F.percentile("value", F.array(F.lit(0.02), F.lit(0.98)))
    return rounded(S.tall(features(spark, d), FEATURES).groupBy("column").agg(q.alias("q")).select("column", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")), "low", "high", places=8)


@query(f"""SELECT variant, round(avg({FIN('rmsd__mean')}), 8) AS mean, round(stddev_samp({FIN('rmsd__mean')}), 8) AS std, count({FIN('rmsd__mean')}) AS n FROM features GROUP BY variant""")
def q_rmsf_stats(spark, d):
    """A09."""
    from curvelake.operators.grid import finite

    v = finite(F.col("rmsd__mean"))
    return rounded(features(spark, d).groupBy("variant").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n")), "mean", "std", places=8)


@query(f"""SELECT a, b, n, r FROM ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (isfinite({a}::DOUBLE) AND isfinite({b}::DOUBLE)) AS n, round(corr({FIN(f'{a}::DOUBLE')}, {FIN(f'{b}::DOUBLE')}), 6) AS r FROM {FEATURE_ROWS}" for a, b in _PAIRS)}) WHERE abs(r) >= 0.3 ORDER BY abs(r) DESC, a, b LIMIT 200""")
def q_redundant_pairs(spark, d):
    """Pairs whose absolute correlation is at least 0.3, up to 200."""
    return rounded(S.correlations(feature_rows(spark, d), FEATURES), "r").where(F.abs("r") >= 0.3).orderBy(F.abs("r").desc(), "a", "b").limit(200)
