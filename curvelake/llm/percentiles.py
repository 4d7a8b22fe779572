"""Exact percentiles per group over any number of values, from partial results that combine.

Method: a full distributed sort with per-partition counts. Partial results are value counts per group and day; adding
them up loses nothing, so the error is bounded by zero. The combined counts are range-partitioned and sorted; the counts
of each partition give each group's offsets, the wanted positions are located in them, and only the partitions that hold
one are read again to interpolate between neighbouring order statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelake.session import cut


def day_partials(df: DataFrame, groups: list[str], values: list[str], when: str) -> DataFrame:
    """groups, day, column, value, n: how often each finite value stands per group and day.

    Null, NaN and infinite values are left out; rows with a null group or time keep null as their group or day. Counts
    fold map-side, so a hot group or value is split over all tasks.
    """
    unpivot = F.explode(F.array(*[F.struct(F.lit(v).alias("column"), (F.col(v).cast("double") + F.lit(0.0)).alias("value")) for v in values])).alias("_u")
    tall = df.select(*groups, F.to_date(when).alias("day"), unpivot).select(*groups, "day", "_u.column", "_u.value")
    kept = tall.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return kept.groupBy(*groups, "day", "column", "value").agg(F.count("*").alias("n"))


def percentiles(partials: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """groups, column, share, value, n: the exact, linearly interpolated percentiles of the combined partial results.

    The value at share q of n values is that at position q*(n-1) of their order, counted from 0. Groups without a finite
    value have no row. Partials of one day, of several or of the same value in several parts all combine.
    """
    key = [*groups, "column"]
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]
    sorted_runs = partials.repartitionByRange(*key, "value").groupBy(*key, "value").agg(F.sum("n").alias("n")).sortWithinPartitions(*key, "value")
    runs = cut(sorted_runs.withColumn("part", F.spark_partition_id()), "runs")
    counts = runs.groupBy(*key, "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*key).orderBy("part")
    offsets = counts.withColumn("first", F.sum("n").over(before) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy(*key)))
    position = F.col("share") * (F.col("total") - 1)
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    asked = offsets.withColumn("share", F.explode(wanted)).withColumn("_p", position).withColumn("low", F.floor("_p")).withColumn("part_of", F.col("_p") - F.col("low"))
    ranks = asked.withColumn("rank", F.explode(F.array_distinct(F.array(F.col("low"), F.ceil("_p")))))
    located = ranks.where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))).select(*key, "part", "first", "total", "share", "low", "part_of", "rank")
    touched = located.groupBy(*key, "part").agg(F.max("first").alias("first"))
    near = runs.alias("r").join(touched.alias("t"), [*same("r", "t"), F.col("r.part") == F.col("t.part")]).select("r.*", "t.first")
    summed = near.withColumn("_end", F.col("first") + F.sum("n").over(Window.partitionBy(*key, "part").orderBy("value")))
    hit = summed.alias("s").join(located.alias("l"), [*same("s", "l"), F.col("s.part") == F.col("l.part"), F.col("l.rank") < F.col("s._end"), F.col("l.rank") >= F.col("s._end") - F.col("s.n")])
    at = hit.select("l.*", "s.value")
    low, high = F.max(F.when(F.col("rank") == F.col("low"), F.col("value"))), F.max(F.when(F.col("rank") > F.col("low"), F.col("value")))
    return (
        at.groupBy(*key, "share", "total", "part_of")
        .agg(low.alias("_lo"), high.alias("_hi"))
        .select(*key, "share", F.when(F.col("_hi").isNull(), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("part_of")).alias("value"), F.col("total").alias("n"))
    )
