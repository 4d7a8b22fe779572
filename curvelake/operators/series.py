"""Ordered series: smoothing, autocorrelation, effective sample size, strides, equal-count bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], y: str, width: int) -> DataFrame:
    """df with smooth: the sum over a frame of width rows (left-heavy for even widths) over width, zeros beyond the ends;
    series of at most width rows get their mean."""
    w = Window.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(-(width // 2), width - 1 - width // 2)
    whole = Window.partitionBy(*keys)
    return df.withColumn("smooth", F.when(F.count("*").over(whole) <= width, F.avg(y).over(whole)).otherwise(F.sum(y).over(frame) / width))


def autocorrelation(df: DataFrame, keys: Sequence[str], order: Sequence[str], y: str, lags: int = 50) -> DataFrame:
    """keys, lag, rho, n: biased autocorrelation over lag 0. Series under three rows or without variance have no row.

    Lags are taken by a window, so a series is read in one sorted stream and never held whole; all lags of a row are
    folded into sums before anything is shuffled again.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    centred = df.withColumn("_n", F.count("*").over(whole)).withColumn("_d", F.col(y) - F.avg(y).over(whole)).where("_n >= 3")
    # The last `lags` values up to each row, newest first: one array, from which every lag's product is taken.
    recent = F.collect_list("_d").over(w.rowsBetween(-lags, 0))
    products = centred.withColumn("_r", F.reverse(recent)).select(*keys, "_n", F.posexplode(F.transform("_r", lambda v: v * F.col("_d"))).alias("lag", "_p"))
    sums = products.groupBy(*keys, "lag").agg(F.sum("_p").alias("_c"), F.first("_n").alias("n"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("_c"))).over(whole)
    return sums.withColumn("_z", zero).where("_z > 1e-12").select(*keys, "lag", (F.col("_c") / F.col("_z")).alias("rho"), "n")


def correlation_time(acf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, tau, ess, stride: 0.5 plus the sum of rho until the first that isn't positive, at least 0.5; n / (2 tau);
    and round(2 tau), at least 1."""
    w = Window.partitionBy(*keys).orderBy("lag")
    stopped = F.max(F.when((F.col("rho") <= 0) & (F.col("lag") > 0), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    made = acf.withColumn("_s", stopped).groupBy(*keys).agg(F.first("n").alias("n"), (0.5 + F.sum(F.when((F.col("lag") > 0) & (F.col("_s") == 0), F.col("rho")).otherwise(0.0))).alias("tau"))
    tau = F.greatest("tau", F.lit(0.5))
    return made.select(*keys, "n", tau.alias("tau"), F.when(F.col("n") <= 1, F.col("n").cast("double")).otherwise(F.col("n") / (2 * tau)).alias("ess"), F.greatest(F.lit(1), F.floor(2 * tau + 0.5)).cast("int").alias("stride"))


def strided(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: int) -> DataFrame:
    """Every step-th row of each series from its first on."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where((F.col("_i") - 1) % step == 0).drop("_i")


def equal_count_bins(df: DataFrame, keys: Sequence[str], order: Sequence[str], bins: int, most: int = 80) -> DataFrame:
    """df with bin from 0: nearly equal counts in order; max(2, min(bins, most, rows)) bins."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    counted = df.withColumn("_n", n).withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1)
    k = F.greatest(F.lit(2), F.least(F.lit(bins), F.lit(most), F.col("_n")))
    # The first n mod k bins hold one more than the others.
    base, extra = F.floor(F.col("_n") / F.col("_k")), F.col("_n") % F.col("_k")
    cut = extra * (base + 1)
    at = F.when(F.col("_i") < cut, F.floor(F.col("_i") / (base + 1))).otherwise(extra + F.floor((F.col("_i") - cut) / base))
    return counted.withColumn("_k", k).withColumn("bin", at.cast("int")).drop("_n", "_i", "_k")


def paired(df: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str, a: str, b: str, y: str, least: int = 8) -> DataFrame:
    """keys, i, a, b: the i-th values of two kinds side by side, cut to the shorter; keys under least pairs are left out."""
    ranked = df.where(F.col(kind).isin(a, b)).withColumn("i", F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order)))
    pick = lambda k: F.max(F.when(F.col(kind) == k, F.col(y)))
    both = ranked.groupBy(*keys, "i").agg(pick(a).alias("a"), pick(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n")


def stride_of(tau: Column) -> Column:
    """round(2 tau), at least 1; null and NaN give 1."""
    return F.when(tau.isNull() | F.isnan(tau), 1).otherwise(F.greatest(F.lit(1), F.floor(2 * tau + 0.5))).cast("int")
