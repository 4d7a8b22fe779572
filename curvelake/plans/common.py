"""What the queries share: the tables in clean form, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.operators import curves as C
from curvelake.operators import grid as G
from curvelake.session import table

FEATURES = ["seq_len", "kd_mean", "rg__mean", "rg__std", "e2e__mean", "sasa__mean", "rmsd__mean", "rg__effective_support_frac", "rg__global_basin_escape_barrier_kt", "rg__local_ruggedness_kt"]


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Columns rounded, so that the order of a sum can't show; -0.0 as 0.0."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def exact_mean(column: str, scale: float = 1e6):
    """The mean of a column summed in whole 1 / scale, so that it is the same double in any order; nulls don't count."""
    return F.sum(F.round(F.col(column) * scale).cast("bigint")).cast("double") / (F.count(column) * scale)


def sql_mean(column: str, scale: str = "1e6") -> str:
    return f"sum(CAST(round({column} * {scale}) AS BIGINT))::DOUBLE / (count({column}) * {scale})"


def pmf(spark: SparkSession, d: str) -> DataFrame:
    return C.clean(table(spark, d, "pmf"))


def in_cells(spark: SparkSession, d: str) -> DataFrame:
    """curve_id, variant, metric, replica, cell, x, F_kJ_mol, P, temperature_k of the clean rows inside the grid."""
    rows = pmf(spark, d).withColumn("x_raw", F.col("x"))
    return G.in_cells(rows, table(spark, d, "metric_grid"), ["variant", "replica", "x_raw", "F_kJ_mol", "P", "temperature_k"]).withColumnRenamed("x_raw", "x")


def cell_means(spark: SparkSession, d: str) -> DataFrame:
    """variant, metric, cell, F_kJ_mol: the mean over all replicas' readings, summed in whole 1e-6, so that it is the same in any order."""
    return in_cells(spark, d).groupBy("variant", "metric", "cell").agg(exact_mean("F_kJ_mol").alias("F_kJ_mol"))


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "features")


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per variant: the latest export, and of its rows the largest."""
    best = F.max_by(F.struct(*FEATURES, "sequence"), F.struct("exported_at", *FEATURES, "sequence"))
    return features(spark, d).where("variant IS NOT NULL").groupBy("variant").agg(best.alias("b")).select("variant", "b.*")


PMF = "(SELECT curve_id, variant, metric, replica, x, CASE WHEN isfinite(P) THEN P END AS P, F_kJ_mol, temperature_k, written_at FROM pmf WHERE curve_id IS NOT NULL AND variant IS NOT NULL AND metric IS NOT NULL AND isfinite(x) AND isfinite(F_kJ_mol))"
CELLS = f"""(SELECT curve_id, variant, metric, replica, cell, x, F_kJ_mol, P, temperature_k FROM (
  SELECT *, CAST(floor((w - x_start) / x_step) AS INTEGER) AS cell FROM (
    SELECT p.*, g.x_start, g.x_step, g.n_cells, CASE WHEN g.is_periodic THEN g.x_start + (p.x - g.x_start) - 360 * floor((p.x - g.x_start) / 360) ELSE p.x END AS w
    FROM {PMF} p JOIN metric_grid g ON p.metric = g.metric)) WHERE cell >= 0 AND cell < n_cells)"""
MEANS = f"(SELECT variant, metric, cell, {sql_mean('F_kJ_mol')} AS F_kJ_mol FROM {CELLS} GROUP BY variant, metric, cell)"
FIN = lambda c: f"CASE WHEN isfinite({c}) THEN {c} END"
FEATURE_ROWS = f"""(SELECT variant, {', '.join(FEATURES)}, sequence FROM (
  SELECT *, row_number() OVER (PARTITION BY variant ORDER BY exported_at DESC NULLS LAST, {', '.join(f'{c} DESC NULLS LAST' for c in FEATURES)}, sequence DESC NULLS LAST) AS n FROM features WHERE variant IS NOT NULL) WHERE n = 1)"""
FEATURES_TALL = "(" + " UNION ALL ".join(f"SELECT variant, '{c}' AS \"column\", {FIN(f'CAST({c} AS DOUBLE)')} AS value FROM features" for c in FEATURES) + ")"
