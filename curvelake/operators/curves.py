"""Curves over x: replica averages, areas, derivatives, regions, convergence, interpolation, mixtures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.functions.physics import ROOM, boltzmann, kt
from curvelake.operators.grid import finite


def clean(curves: DataFrame) -> DataFrame:
    """Rows with curve, variant and metric, finite x and finite F; P null where it isn't finite."""
    named = F.col("curve_id").isNotNull() & F.col("variant").isNotNull() & F.col("metric").isNotNull()
    return curves.where(named & finite(F.col("x")).isNotNull() & finite(F.col("F_kJ_mol")).isNotNull()).withColumn("P", finite(F.col("P")))


def replica_stats(df: DataFrame, keys: Sequence[str], replica: str, x: str, y: str) -> DataFrame:
    """keys, x, mean, std, n: mean of y inside each (replica, x), then mean, std (n - 1) and count over the replicas."""
    inner = df.groupBy(*keys, replica, x).agg(F.avg(y).alias("_y"))
    return inner.groupBy(*keys, x).agg(F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("std"), F.count("_y").alias("n"))


def trapezoid(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, area: the integral of y over x by trapezoids; rows of equal x are averaged first; one point gives 0."""
    points = df.groupBy(*keys, x).agg(F.avg(y).alias("_y"))
    w = Window.partitionBy(*keys).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col("_y") + F.lag("_y").over(w)) / 2
    return points.withColumn("_a", part).groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def area_normalised(df: DataFrame, keys: Sequence[str], replica: str, x: str, y: str) -> DataFrame:
    """keys, x, mean, std, n, mean_area: each replica's clipped y over its area (left as it is for area 0), then over replicas."""
    points = df.groupBy(*keys, replica, x).agg(F.avg(F.greatest(F.col(y), F.lit(0.0))).alias("_y"))
    w = Window.partitionBy(*keys, replica).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col("_y") + F.lag("_y").over(w)) / 2
    total = F.coalesce(F.sum("_part").over(Window.partitionBy(*keys, replica)), F.lit(0.0))
    scaled = points.withColumn("_part", part).withColumn("_area", total).withColumn("_n", F.when(F.col("_area") > 0, F.col("_y") / F.col("_area")).otherwise(F.col("_y")))
    return scaled.groupBy(*keys, x).agg(F.avg("_n").alias("mean"), F.stddev_samp("_n").alias("std"), F.count("_n").alias("n"), F.avg("_area").alias("mean_area"))


def cumulative(df: DataFrame, keys: Sequence[str], x: str, mass: str) -> DataFrame:
    """df with cumulative: the running sum of mass along x."""
    return df.withColumn("cumulative", F.sum(mass).over(Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)))


def bin_width(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """keys, width: the median positive difference of neighbouring distinct x; null under two."""
    points = df.select(*keys, x).distinct()
    gap = F.col(x) - F.lag(x).over(Window.partitionBy(*keys).orderBy(x))
    return points.withColumn("_g", gap).groupBy(*keys).agg(F.percentile("_g", F.lit(0.5)).alias("width"))


def derivative(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, x, y, slope: second-order differences for uneven x inside, one-sided at the ends; equal x averaged first."""
    points = df.groupBy(*keys, x).agg(F.avg(y).alias("_y"))
    w = Window.partitionBy(*keys).orderBy(x)
    x0, x2, y0, y2 = F.lag(x).over(w), F.lead(x).over(w), F.lag("_y").over(w), F.lead("_y").over(w)
    p = points.withColumn("_h1", F.col(x) - x0).withColumn("_h2", x2 - F.col(x)).withColumn("_y0", y0).withColumn("_y2", y2)
    h1, h2, y1 = F.col("_h1"), F.col("_h2"), F.col("_y")
    inside = (h1 * h1 * F.col("_y2") - h2 * h2 * F.col("_y0") + (h2 * h2 - h1 * h1) * y1) / (h1 * h2 * (h1 + h2))
    slope = F.when(h1.isNotNull() & h2.isNotNull(), inside).when(h2.isNotNull(), (F.col("_y2") - y1) / h2).otherwise((y1 - F.col("_y0")) / h1)
    return p.withColumn("slope", slope).select(*keys, x, y1.alias(y), "slope")


def region_minima(df: DataFrame, keys: Sequence[str], x: str, y: str, first: tuple[float, float], second: tuple[float, float]) -> DataFrame:
    """keys, f1, f2, delta: the smallest y inside each closed interval of x and their difference, null where one is empty."""
    low = lambda i: F.min(F.when(F.col(x).between(float(i[0]), float(i[1])), F.col(y)))
    return df.groupBy(*keys).agg(low(first).alias("f1"), low(second).alias("f2")).withColumn("delta", F.col("f2") - F.col("f1"))


def region_integral(df: DataFrame, keys: Sequence[str], x: str, y: str, interval: tuple[float, float]) -> DataFrame:
    """keys, integral: trapezoids over the points inside the interval; 0 under two points."""
    inside = trapezoid(df.where(F.col(x).between(float(interval[0]), float(interval[1]))), keys, x, y)
    return df.select(*keys).distinct().join(inside, list(keys), "left").select(*keys, F.coalesce("area", F.lit(0.0)).alias("integral"))


def density(df: DataFrame, keys: Sequence[str], f: str = "F_kJ_mol", temperature: str | None = "temperature_k") -> DataFrame:
    """df with mass: Boltzmann weights of f over their sum in each curve, at the median positive temperature of the curve."""
    w = Window.partitionBy(*keys)
    t = F.coalesce(F.median(F.when(F.col(temperature) > 0, F.col(temperature))).over(w), F.lit(ROOM)) if temperature else F.lit(ROOM)
    weighed = df.withColumn("_b", boltzmann(F.col(f), F.min(f).over(w), kt(t)))
    return weighed.withColumn("mass", F.col("_b") / F.sum("_b").over(w)).drop("_b")


def curve_temperature(df: DataFrame, keys: Sequence[str], column: str = "temperature_k") -> DataFrame:
    """keys, temperature: the median positive finite temperature, else ROOM."""
    t = finite(F.col(column))
    return df.groupBy(*keys).agg(F.coalesce(F.median(F.when(t > 0, t)), F.lit(ROOM)).alias("temperature"))


def lowest_point(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, x, y of the lowest point, the smallest x on ties."""
    return df.groupBy(*keys).agg(F.min(F.struct(F.col(y).alias("y"), F.col(x).alias("x"))).alias("m")).select(*keys, F.col("m.x").alias(x), F.col("m.y").alias(y))


def downsample(df: DataFrame, keys: Sequence[str], x: str, y: str, most: int) -> DataFrame:
    """At most `most` points a curve: evenly spaced places along x with the first, last and lowest among them."""
    w = Window.partitionBy(*keys).orderBy(x, y)
    whole = Window.partitionBy(*keys)
    ranked = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole))
    low = ranked.withColumn("_m", F.min(F.struct(F.col(y), F.col("_i"))).over(whole))
    step = (F.col("_n") - 1) / F.lit(most - 1)
    # Place i is kept where some k has round(k * step) = i.
    k = F.floor((F.col("_i") + 0.5) / step)
    even = F.array_contains(F.transform(F.sequence(F.greatest(k - 1, F.lit(0)), k + 1), lambda j: F.floor(j * step + 0.5)), F.col("_i").cast("bigint"))
    keep = (F.col("_n") <= most) | (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | (F.col("_i") == F.col("_m._i")) | even
    kept = low.where(keep).withColumn("_r", F.row_number().over(w))
    return kept.where((F.col("_r") <= most) | (F.col("_n") <= most)).drop("_i", "_n", "_m", "_r")


def interpolate(curves: DataFrame, points: DataFrame, keys: Sequence[str], x: str, y: str, outside: str = "null") -> DataFrame:
    """points with y at their x by straight lines between the curve's neighbours (both tables hold keys and x).

    outside: 'null', 'zero' or 'edge' for x beyond the curve. Equal x of a curve are averaged first. Curve and points are
    sorted together once; no point meets any other curve's rows.
    """
    known = curves.groupBy(*keys, x).agg(F.avg(y).alias("_y")).withColumn("_ask", F.lit(False))
    asked = points.select(*keys, x).distinct().withColumn("_y", F.lit(None).cast("double")).withColumn("_ask", F.lit(True))
    at = F.when(F.col("_y").isNotNull(), F.struct(F.col(x).alias("x"), F.col("_y").alias("y")))
    w = Window.partitionBy(*keys).orderBy(x)
    both = known.unionByName(asked)
    left = F.last(at, True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    right = F.first(at, True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumn("_l", left).withColumn("_r", right).where("_ask")
    lx, ly, rx, ry = F.col("_l.x"), F.col("_l.y"), F.col("_r.x"), F.col("_r.y")
    value = F.when(lx == rx, ly).otherwise(ly + (F.col(x) - lx) / (rx - lx) * (ry - ly))
    beyond = {"null": F.lit(None).cast("double"), "zero": F.when(F.coalesce(lx, rx).isNotNull(), F.lit(0.0)), "edge": F.coalesce(ly, ry)}[outside]
    return near.select(*keys, x, F.coalesce(value, beyond).alias(y))


def convergence_time(df: DataFrame, keys: Sequence[str], x: str, y: str, eps: float, eps_rel: float, window: float) -> DataFrame:
    """keys, n, final, epsilon, t_conv: the first x from which a window of values stays within epsilon of the final one.

    epsilon = max(eps, eps_rel * max(range, |final|, 1e-12)); the window holds max(3, round(window * n)) rows; null where
    no whole window stays inside. window is held within 0.01 and 0.95.
    """
    share = min(max(window, 0.01), 0.95)
    whole = Window.partitionBy(*keys)
    order = Window.partitionBy(*keys).orderBy(x)
    told = df.withColumn("_n", F.count("*").over(whole)).withColumn("_f", F.last(y).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    spread = F.max(y).over(whole) - F.min(y).over(whole)
    told = told.withColumn("_e", F.greatest(F.lit(eps), eps_rel * F.greatest(spread, F.abs("_f"), F.lit(1e-12)))).withColumn("_w", F.greatest(F.lit(3), F.round(share * F.col("_n")).cast("int")))
    told = told.withColumn("_i", F.row_number().over(order)).withColumn("_out", F.when(F.abs(F.col(y) - F.col("_f")) > F.col("_e"), F.col("_i")))
    # A window from row i stays inside if the next row outside lies w rows on or never comes.
    next_out = F.first("_out", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    good = (F.coalesce(next_out, F.col("_n") + 1) >= F.col("_i") + F.col("_w")) & (F.col("_i") + F.col("_w") - 1 <= F.col("_n"))
    return told.withColumn("_g", F.when(good, F.col(x))).groupBy(*keys).agg(F.first("_n").alias("n"), F.first("_f").alias("final"), F.first("_e").alias("epsilon"), F.min("_g").alias("t_conv"))


def mixture(members: DataFrame, group: Sequence[str], x: str, mass: str, weight: Column) -> DataFrame:
    """group, x, p: the weighted mean of the members' masses, normalised over x."""
    summed = members.groupBy(*group, x).agg(F.sum(F.col(mass) * weight).alias("_p"))
    total = F.sum("_p").over(Window.partitionBy(*group))
    return summed.select(*group, x, F.when(total > 0, F.col("_p") / total).alias("p"))


def interpolated_density(df: DataFrame, keys: Sequence[str], item: str, x: str, y: str, places: int = 4) -> DataFrame:
    """keys, item, x, density: each item's curve on the union of its key's rounded x, 0 outside it, with an integral of 1.

    Items with fewer than two points are left out. x is rounded half up; equal x are averaged first.
    """
    points = df.withColumn(x, F.floor(F.col(x) * 10**places + 0.5) / 10**places).groupBy(*keys, item, x).agg(F.avg(F.greatest(F.col(y), F.lit(0.0))).alias("_v"))
    several = points.groupBy(*keys, item).agg(F.count("*").alias("_n")).where("_n >= 2").select(*keys, item)
    asked = several.join(points.select(*keys, x).distinct(), list(keys))
    made = interpolate(points.withColumnRenamed("_v", y), asked, [*keys, item], x, y, "zero")
    w = Window.partitionBy(*keys, item)
    part = (F.col(x) - F.lag(x).over(w.orderBy(x))) * (F.col(y) + F.lag(y).over(w.orderBy(x))) / 2
    area = made.withColumn("_a", part).withColumn("_t", F.sum("_a").over(w))
    return area.select(*keys, item, x, F.when(F.col("_t") > 0, F.col(y) / F.col("_t")).otherwise(F.col(y)).alias("density"))


def density_matrix(df: DataFrame, key: str, item: str, x: str, y: str, places: int = 4, most: int = 256) -> DataFrame:
    """key, item, x, density: as interpolated_density for few keys and any number of items, on at most `most` x a key.

    A key with more rounded x gets as many even ones from its least to its greatest. A curve is gathered as one list of
    its rounded x, so its length is bounded by their number.
    """
    points = df.withColumn(x, F.floor(F.col(x) * 10**places + 0.5) / 10**places).groupBy(key, item, x).agg(F.avg(F.greatest(F.col(y), F.lit(0.0))).alias("_v"))
    known = points.select(key, x).distinct()
    spans = known.groupBy(key).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()
    few = [r[key] for r in spans if r["n"] <= most]
    grids = {r[key]: np.linspace(r["lo"], r["hi"], most) for r in spans if r["n"] > most}
    for r in known.where(F.col(key).isin(few)).groupBy(key).agg(F.array_sort(F.collect_list(x)).alias("x")).collect() if few else []:
        grids[r[key]] = np.array(r["x"])

    def part(batches):
        for batch in batches:
            for k, i, px, py in zip(*(batch.column(c) for c in range(4))):
                name, at = k.as_py(), np.array(px.values)
                order, grid = np.argsort(at), grids[name]
                v = np.interp(grid, at[order], np.array(py.values)[order], left=0.0, right=0.0)
                area = np.trapezoid(v, grid)
                yield pa.RecordBatch.from_pydict({key: pa.array([name] * len(grid), pa.string()), item: pa.array([i.as_py()] * len(grid), pa.string()), x: grid, "density": v / area if area > 0 else v})

    lists = points.groupBy(key, item).agg(F.collect_list(F.struct(x, "_v")).alias("_p")).where(F.size("_p") >= 2).select(key, item, F.col(f"_p.{x}").alias("_x"), F.col("_p._v").alias("_y"))
    return lists.mapInArrow(part, f"{key} string, {item} string, {x} double, density double")


def replica_mass(df: DataFrame, keys: Sequence[str], replica: str, x: str, y: str, step: str) -> DataFrame:
    """keys, x, mass: the mean over replicas with at least three points of y at x, times step, plus 1e-12, over the sum."""
    enough = df.groupBy(*keys, replica).agg(F.countDistinct(x).alias("_n")).where("_n >= 3").select(*keys, replica)
    kept = df.join(enough, [*keys, replica], "left_semi")
    inner = kept.groupBy(*keys, replica, x).agg(F.avg(F.greatest(F.col(y), F.lit(0.0))).alias("_y"), F.first(step).alias("_s"))
    mean = inner.groupBy(*keys, x).agg((F.avg("_y") * F.first("_s") + 1e-12).alias("_m"))
    return mean.select(*keys, x, (F.col("_m") / F.sum("_m").over(Window.partitionBy(*keys))).alias("mass"))


KINDS = ("js", "hellinger", "w1", "w2")
BINS, POINTS, FLOOR = 10_000, 256, 1e-15  # steps of a distance's range in which its median is told; quantiles of w2; least mass


def curve_sets(cells: DataFrame, item: str, metric: str, x: str, y: str) -> DataFrame:
    """item, curves: of each item its curves, an array of (metric, cells: (x, y)); a curve has one row per cell, so is bounded by its grid."""
    one = cells.where(F.col(item).isNotNull()).groupBy(item, metric).agg(F.collect_list(F.struct(F.col(x).cast("int").alias("cell"), F.col(y).alias("v"))).alias("cells"))
    return one.groupBy(item).agg(F.collect_list(F.struct(F.col(metric).alias("metric"), "cells")).alias("curves"))


def _masses(curves: list, sizes: dict[str, int]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """metric -> (rows, masses) of a batch of curve sets; negative or missing readings as 0, each curve with a sum of 1, floored.
    A curve without a positive reading is none."""
    out: dict[str, tuple[list, list]] = {}
    for row, of in enumerate(curves):
        for c in of or ():
            if c["metric"] in sizes:
                m = np.zeros(sizes[c["metric"]])
                for p in c["cells"]:
                    m[p["cell"]] = max(p["v"] or 0.0, 0.0)
                if m.sum() > 0:
                    m = np.maximum(m / m.sum(), FLOOR)
                    out.setdefault(c["metric"], ([], []))
                    out[c["metric"]][0].append(row)
                    out[c["metric"]][1].append(m / m.sum())
    return {k: (np.array(r), np.array(m)) for k, (r, m) in out.items()}


def _curve_distances(q: np.ndarray, m: np.ndarray, kind: str) -> np.ndarray:
    """Distances of all rows of q and m as shares of what the grid allows: js and hellinger as they are, w1 and w2 over the grid's span."""
    n = q.shape[1]
    if kind == "hellinger":
        return np.sqrt(np.maximum(1 - np.sqrt(q) @ np.sqrt(m).T, 0.0))
    if kind == "js":
        lm = (m * np.log(m)).sum(1)
        out = np.empty((len(q), len(m)))
        for i, row in enumerate(q):
            mid = (row + m) / 2
            out[i] = ((row * np.log(row)).sum() + lm) / 2 - (mid * np.log(mid)).sum(1)
        return np.sqrt(np.maximum(out, 0.0))
    if kind == "w1":
        cq, cm = np.cumsum(q, 1), np.cumsum(m, 1)
        return np.stack([np.abs(row - cm).sum(1) for row in cq]) / n
    at, u = np.arange(n) + 0.5, np.linspace(0, 1, POINTS)
    xq, xm = (np.stack([np.interp(u, row, at) for row in np.cumsum(x, 1)]) for x in (q, m))
    return np.stack([np.sqrt(((row - xm) ** 2).mean(1)) for row in xq]) / n


def nearest_curves(sets: DataFrame, asked: DataFrame, item: str, sizes: dict[str, int], k: int = 5, kinds: Sequence[str] = KINDS, block: int = 2048) -> DataFrame:
    """kind, query, item, distance, n_metrics, place: the k items of `sets` nearest to each item of `asked`, itself left out.

    Both as of curve_sets. The distance of two items is the mean, over the metrics both have, of their distance in that
    metric over its median: js (root of the Jensen-Shannon divergence), hellinger, w1 (sum of the differences of the
    running sums, times the step) and w2 (of the quantile functions). The medians are of all positive distances between
    `asked` and `sets`, to a 10,000th of the metric's range. Items without a common metric aren't near. Ties go to the
    smaller name. Asked items travel in blocks; the rows of `sets` are read twice a block, for the medians and for the
    neighbours, and never shuffled: a task hands on counts, and then its k best of each asked item.
    """
    spark = sets.sparkSession
    n = asked.count()
    blocks = max(1, -(-n // block))
    sent = []
    for i in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == i)
        rows = part.orderBy(item).collect()
        sent.append(spark.sparkContext.broadcast(([r[0] for r in rows], _masses([r["curves"] for r in rows], sizes))))

    def count(queries):
        def run(batches):
            names, mine = queries.value
            for batch in batches:
                own = batch.column(0).to_pylist()
                theirs = _masses(batch.column(1).to_pylist(), sizes)
                for metric, (qi, q) in mine.items():
                    if metric in theirs:
                        mi, m = theirs[metric]
                        other = np.array([[names[a] != own[b] for b in mi] for a in qi], bool)
                        for kind in kinds:
                            d = _curve_distances(q, m, kind)
                            bins, c = np.unique(np.maximum(np.floor(d[other & (d > 1e-9)] * BINS + 0.5), 1), return_counts=True)
                            yield pa.RecordBatch.from_pydict({"metric": pa.array([metric] * len(bins)), "kind": pa.array([kind] * len(bins)), "bin": bins.astype(np.int64), "n": c.astype(np.int64)})

        return run

    total = None
    for queries in sent:
        got = sets.select(item, "curves").mapInArrow(count(queries), "metric string, kind string, bin bigint, n bigint")
        total = got if total is None else total.unionByName(got)
    told = total.groupBy("metric", "kind", "bin").agg(F.sum("n").alias("n")).collect()  # at most BINS rows a metric and kind
    scale = {}
    for key in {(r["metric"], r["kind"]) for r in told}:
        bins = sorted((r["bin"], r["n"]) for r in told if (r["metric"], r["kind"]) == key)
        run_ = np.cumsum([c for _, c in bins])
        scale[key] = bins[int(np.searchsorted(run_, (run_[-1] + 1) // 2))][0] / BINS

    def best(queries):
        def run(batches):
            names, mine = queries.value
            for batch in batches:
                own = batch.column(0).to_pylist()
                theirs = _masses(batch.column(1).to_pylist(), sizes)
                common = np.zeros((len(names), len(own)), int)
                for metric, (qi, _) in mine.items():
                    if metric in theirs:
                        common[np.ix_(qi, theirs[metric][0])] += 1
                same = np.array([[a == b for b in own] for a in names], bool).reshape(len(names), len(own))
                for kind in kinds:
                    d = np.zeros((len(names), len(own)))
                    for metric, (qi, q) in mine.items():
                        if metric in theirs:
                            d[np.ix_(qi, theirs[metric][0])] += _curve_distances(q, theirs[metric][1], kind) / scale.get((metric, kind), 1.0)
                    d = np.where((common > 0) & ~same, np.round(d / np.maximum(common, 1), 9), np.inf)
                    order = np.lexsort((np.broadcast_to(np.array(own, dtype=object).astype(str), d.shape), d), axis=1)[:, :k] if len(own) else np.zeros((len(names), 0), int)
                    a, b = np.repeat(np.arange(len(names)), order.shape[1]), order.ravel()
                    keep = np.isfinite(d[a, b])
                    a, b = a[keep], b[keep]
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(a), pa.string()), "query": pa.array([names[i] for i in a], pa.string()), "item": pa.array([own[i] for i in b], pa.string()), "distance": pa.array(d[a, b], pa.float64()), "n_metrics": pa.array(common[a, b], pa.int32())})

        return run

    found = None
    for queries in sent:
        got = sets.select(item, "curves").mapInArrow(best(queries), "kind string, query string, item string, distance double, n_metrics int")
        found = got if found is None else found.unionByName(got)
    w = Window.partitionBy("kind", "query").orderBy("distance", "item")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def curve_matrix(sets: list, sizes: dict[str, int], kind: str = "js") -> np.ndarray:
    """The matrix of mean distances over common metrics of a bounded list of curve sets; the largest one where two have none in common."""
    d, n = np.zeros((len(sets), len(sets))), np.zeros((len(sets), len(sets)), int)
    for rows, m in _masses(sets, sizes).values():
        at = np.ix_(rows, rows)
        d[at] += _curve_distances(m, m, kind)
        n[at] += 1
    mean = np.where(n > 0, d / np.maximum(n, 1), 0.0)
    mean = np.where(n > 0, mean, mean.max(initial=0.0))
    mean = (mean + mean.T) / 2
    np.fill_diagonal(mean, 0.0)
    return mean


def medoids(masses: DataFrame, keys: Sequence[str], item: str, x: str, mass: str) -> DataFrame:
    """keys, item, cohesion, is_medoid: each item's mean squared Hellinger distance to the other items of its key, and whether
    it is the least (ties: the smaller name).

    The squared distance is 1 less the product of the roots of both masses, so the mean over all others is told by the sum
    of all roots per cell: linear in the items, however many. Items alone have a null cohesion and are the medoid.
    """
    root = masses.withColumn("_r", F.sqrt(mass))
    total = root.groupBy(*keys, x).agg(F.sum("_r").alias("_s"))
    n = root.groupBy(*keys).agg(F.countDistinct(item).alias("_n"))
    near = root.join(total, [*keys, x]).groupBy(*keys, item).agg(F.sum(F.col("_r") * (F.col("_s") - F.col("_r"))).alias("_p")).join(n, list(keys))
    made = near.withColumn("cohesion", F.when(F.col("_n") > 1, F.round(F.greatest(1 - F.col("_p") / (F.col("_n") - 1), F.lit(0.0)), 9)))
    best = made.groupBy(*keys).agg(F.min_by(item, F.struct("cohesion", item)).alias("_m"))
    return made.join(best, list(keys)).select(*keys, item, "cohesion", (F.col(item) == F.col("_m")).alias("is_medoid"))
