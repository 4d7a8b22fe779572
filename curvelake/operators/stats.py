"""Descriptive statistics of tables: column profiles, coverage, histograms, circular statistics, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.operators.grid import finite


def tall(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, column, value: one row per key row and column, values as double, not finite ones null."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), finite(F.col(f"`{c}`").cast("double")).alias("value")) for c in columns])
    return df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.column", "_e.value")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column of the finite values: count, mean, std (n - 1), min, quartiles (interpolated), max. One pass, one shuffle."""
    v = F.col("value")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    made = tall(df, columns).groupBy("column").agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"))
    return made.select("column", "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def is_missing(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()


def overview(df: DataFrame, distinct: Sequence[str]) -> DataFrame:
    """rows, cols, n_<column> distinct values, missing cells and their percentage."""
    cells = sum((F.when(is_missing(c, t), 1).otherwise(0) for c, t in df.dtypes), F.lit(0))
    counts = [F.countDistinct(c).alias(f"n_{c}") for c in distinct]
    made = df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("cols"), *counts, F.coalesce(F.sum(cells), F.lit(0)).alias("missing"))
    return made.withColumn("missing_pct", F.when(F.col("rows") > 0, 100.0 * F.col("missing") / (F.col("rows") * F.col("cols"))))


def missing_by_column(df: DataFrame) -> DataFrame:
    """column, missing, pct of every column."""
    kinds = dict(df.dtypes)
    counted = df.agg(F.count("*").alias("_rows"), *[F.count(F.when(is_missing(c, t), 1)).alias(c) for c, t in kinds.items()])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in kinds])
    return counted.select("_rows", F.inline(entries)).select("column", "missing", F.when(F.col("_rows") > 0, 100.0 * F.col("missing") / F.col("_rows")).alias("pct"))


def missing_by_row(df: DataFrame, key: str, columns: Sequence[str], top: int = 200) -> DataFrame:
    """key, missing_share: the mean share of missing values among columns, per key; the top by share, then key."""
    kinds = dict(df.dtypes)
    share = sum((F.when(is_missing(c, kinds[c]), 1.0).otherwise(0.0) for c in columns), F.lit(0.0)) / max(len(columns), 1)
    return df.groupBy(key).agg(F.avg(share).alias("missing_share")).orderBy(F.desc("missing_share"), key).limit(top)


def coverage(df: DataFrame, key: str, item: str, top: int = 200, listed: int = 25) -> DataFrame:
    """key, present, missing, total, missing_items (sorted, the first listed): which items each key lacks."""
    pairs = df.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(key, item).distinct()
    # The items are the columns of a catalogue (metrics): few by nature, gathered into one array on the executors.
    every = pairs.select(item).distinct().agg(F.array_sort(F.collect_set(item)).alias("_all"))
    have = pairs.groupBy(key).agg(F.collect_set(item).alias("_have"))
    lack = F.array_sort(F.array_except("_all", "_have"))
    made = have.join(every).select(key, F.size("_have").cast("bigint").alias("present"), F.size(lack).cast("bigint").alias("missing"), F.size("_all").cast("bigint").alias("total"), F.array_join(F.slice(lack, 1, listed), ",").alias("missing_items"))
    return made.orderBy(F.desc("missing"), key).limit(top)


def shared_keys(tables: dict[str, DataFrame], key: str, base: str) -> DataFrame:
    """table, n_keys, in_base: distinct keys of each table and how many of them the base table has."""
    tagged = None
    for name, df in tables.items():
        part = df.where(F.col(key).isNotNull()).select(key).distinct().withColumn("table", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    marked = tagged.groupBy(key).agg(F.collect_set("table").alias("t"))
    return marked.select(F.explode("t").alias("table"), F.array_contains("t", base).alias("b")).groupBy("table").agg(F.count("*").alias("n_keys"), F.count(F.when(F.col("b"), 1)).alias("in_base"))


def typical_value(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """keys, mode, n: the most frequent value, the smallest on ties; nulls don't count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("mode")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "mode")
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin from 0, the right edge in the last; null outside."""
    at = F.floor((value - low) / (high - low) * bins)
    return F.when((value >= low) & (value <= high), F.least(at, F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, value: str, keys: Sequence[str], bins: int) -> DataFrame:
    """keys, bin, left, n: equal-width bins between each key's smallest and largest finite value; empty bins are left out."""
    v = df.select(*keys, finite(F.col(value)).alias("_v")).where(F.col("_v").isNotNull())
    edge = v.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")) if keys else v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = (v.join(edge, list(keys)) if keys else v.join(F.broadcast(edge))).where("_hi > _lo").withColumn("bin", bin_index(F.col("_v"), F.col("_lo"), F.col("_hi"), bins))
    return at.groupBy(*keys, "bin", "_lo", "_hi").agg(F.count("*").alias("n")).select(*keys, "bin", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) / bins * F.col("bin")).alias("left"), "n")


def histogram2d(df: DataFrame, x: str, y: str, keys: Sequence[str], bins: int) -> DataFrame:
    """keys, xbin, ybin, n on edges shared by all rows."""
    v = df.select(*keys, finite(F.col(x)).alias("_x"), finite(F.col(y)).alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    edge = v.agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"))
    at = v.join(F.broadcast(edge)).withColumn("xbin", bin_index(F.col("_x"), F.col("_x0"), F.col("_x1"), bins)).withColumn("ybin", bin_index(F.col("_y"), F.col("_y0"), F.col("_y1"), bins))
    return at.groupBy(*keys, "xbin", "ybin").agg(F.count("*").alias("n"))


def moments(df: DataFrame, keys: Sequence[str], x: str, weight: str) -> DataFrame:
    """keys, mean, variance, skew, kurtosis: weighted population moments, the last as excess; null for zero variance.

    Centred in a second pass over the folded weights, as raw third and fourth powers would cancel.
    """
    w, v = F.col(weight), F.col(x)
    mean = df.groupBy(*keys).agg((F.sum(w * v) / F.sum(w)).alias("mean"))
    d = v - F.col("mean")
    made = df.join(mean, list(keys)).groupBy(*keys, "mean").agg(*[(F.sum(w * d**k) / F.sum(w)).alias(f"m{k}") for k in (2, 3, 4)])
    real = F.col("m2") > 1e-12
    return made.select(*keys, "mean", F.col("m2").alias("variance"), F.when(real, F.col("m3") / F.col("m2") ** 1.5).alias("skew"), F.when(real, F.col("m4") / F.col("m2") ** 2 - 3).alias("kurtosis"))


def circular(df: DataFrame, keys: Sequence[str], angle: str, weight: Column | None = None) -> DataFrame:
    """keys, mean_deg in [0, 360), r (length of the mean vector), variance 1 - r of angles in degrees."""
    w = weight if weight is not None else F.lit(1.0)
    a = F.radians(angle)
    made = df.groupBy(*keys).agg((F.sum(w * F.cos(a)) / F.sum(w)).alias("c"), (F.sum(w * F.sin(a)) / F.sum(w)).alias("s"))
    r = F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)
    return made.select(*keys, F.pmod(F.degrees(F.atan2("s", "c")) + 360.0, F.lit(360.0)).alias("mean_deg"), r.alias("r"), (1 - r).alias("variance"))


# Boxes of backbone angles, lower bounds inside, upper bounds outside.
RAMA = {"alpha": (-100, -30, -80, -5), "beta": (-180, -40, 90, 180), "left_alpha": (30, 100, 0, 90)}


def rama_populations(df: DataFrame, keys: Sequence[str], phi: str, psi: str, weight: Column) -> DataFrame:
    """keys, alpha, beta, left_alpha, other: shares of the weight in each box; null where the weight is 0."""
    box = lambda b: (F.col(phi) >= b[0]) & (F.col(phi) < b[1]) & (F.col(psi) >= b[2]) & (F.col(psi) < b[3])
    total = F.sum(weight)
    made = df.groupBy(*keys).agg(*[F.when(total > 0, F.sum(F.when(box(b), weight).otherwise(0.0)) / total).alias(n) for n, b in RAMA.items()])
    return made.withColumn("other", F.greatest(F.lit(0.0), 1 - sum((F.col(n) for n in RAMA), F.lit(0.0))))


def pair_list(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def correlations(df: DataFrame, columns: Sequence[str], least: int = 2) -> DataFrame:
    """a, b, n, r of all pairs of columns over the rows where both are finite; r is null under least pairs or without
    variance. One aggregate over the table for any number of rows; the pairs are of columns, so they don't grow with it."""
    clean = df.select(*[finite(F.col(f"`{c}`").cast("double")).alias(c) for c in columns])
    both = lambda a, b: F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
    pairs = pair_list(columns)
    aggs = [x for i, (a, b) in enumerate(pairs) for x in (F.count(F.when(both(a, b), 1)).alias(f"n{i}"), F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"r{i}"))]
    row = clean.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.when((F.col(f"n{i}") >= least) & ~F.isnan(f"r{i}"), F.col(f"r{i}")).alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(entries))


def average_ranks(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """keep and, per column, the rank of its finite values with ties at their mean, null for others.

    Ranks come from value counts and their running sums, so a heavy tie is one row, and no window holds the table: the
    running sum is taken over 1,024 ranges of values first and inside each range next.
    """
    out = df
    for c in columns:
        v = finite(F.col(f"`{c}`").cast("double")) + F.lit(0.0)
        counts = df.select(v.alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").agg(F.count("*").alias("_n"))
        edge = counts.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        ranged = counts.join(F.broadcast(edge)).withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 1023)).otherwise(0))
        sums = ranged.groupBy("_b").agg(F.sum("_n").alias("_t"))
        before = sums.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_before"))
        inside = ranged.join(before, "_b").withColumn("_end", F.col("_before") + F.sum("_n").over(Window.partitionBy("_b").orderBy("_v")))
        rank = inside.select("_v", (F.col("_end") - (F.col("_n") - 1) / 2.0).alias(f"rank_{c}"))
        out = out.withColumn("_v", v).join(rank, "_v", "left").drop("_v")
    return out.select(*keep, *[f"rank_{c}" for c in columns])


def benjamini_hochberg(df: DataFrame, p: str, keys: Sequence[str]) -> DataFrame:
    """df with q: p * n / rank, made monotone from the largest rank down, at most 1. Ties in p rank by keys."""
    ranked = df.where(F.col(p).isNotNull())
    w = Window.orderBy(F.col(p), *keys)  # over tests of column pairs: a small table by nature
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    raw = ranked.withColumn("_rank", F.row_number().over(w)).withColumn("_raw", F.col(p) * n / F.col("_rank"))
    down = Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.least(F.min("_raw").over(down), F.lit(1.0))).drop("_rank", "_raw")


def regression(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, slope, intercept, r2 of the least squares line over rows where both are finite."""
    clean = df.select(*keys, finite(F.col(x).cast("double")).alias("x"), finite(F.col(y).cast("double")).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return clean.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
