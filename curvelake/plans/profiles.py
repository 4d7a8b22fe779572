"""Queries over free-energy curves: replicas, areas, derivatives, regions, grids, convergence, mixtures, distances."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curvelake.functions import names as N
from curvelake.functions import physics as P
from curvelake.operators import curves as C
from curvelake.plans.common import CELLS, MEANS, PMF, cell_means, exact_mean, in_cells, pmf, rounded, sql_mean
from curvelake.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KT = 0.008314462618 * 300


@query(f"""
WITH r AS (SELECT variant, metric, replica, cell, avg(F_kJ_mol) AS y FROM {CELLS} GROUP BY 1, 2, 3, 4)
SELECT variant, metric, cell, round(avg(y), 8) AS mean, round(stddev_samp(y), 8) AS std, count(y) AS n FROM r GROUP BY 1, 2, 3""")
def q_replica_mean_std(spark, d):
    """A06."""
    return rounded(C.replica_stats(in_cells(spark, d), ["variant", "metric"], "replica", "cell", "F_kJ_mol"), "mean", "std", places=8)


@query(f"""
WITH r AS (SELECT variant, metric, replica, x, avg(greatest(P, 0)) AS y FROM {PMF} WHERE P IS NOT NULL GROUP BY 1, 2, 3, 4),
a AS (SELECT *, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS part FROM r WINDOW w AS (PARTITION BY variant, metric, replica ORDER BY x)),
t AS (SELECT *, coalesce(sum(part) OVER (PARTITION BY variant, metric, replica), 0) AS area FROM a)
SELECT variant, metric, x, round(avg(CASE WHEN area > 0 THEN y / area ELSE y END), 6) AS mean, round(stddev_samp(CASE WHEN area > 0 THEN y / area ELSE y END), 6) AS std, count(y) AS n, round(avg(area), 6) AS mean_area FROM t GROUP BY 1, 2, 3""")
def q_replica_normed(spark, d):
    """A07, J07, M07."""
    made = C.area_normalised(pmf(spark, d).where("P IS NOT NULL"), ["variant", "metric"], "replica", "x", "P")
    return rounded(made, "mean", "std", "mean_area")


@query(f"SELECT metric, cell, {sql_mean('x')} AS x, {sql_mean('F_kJ_mol')} AS F_kJ_mol, {sql_mean('P', '1e9')} AS P, count(*) AS n FROM {CELLS} GROUP BY 1, 2")
def q_x_bin_mean(spark, d):
    """Rows of one cell collapsed to means."""
    return in_cells(spark, d).groupBy("metric", "cell").agg(exact_mean("x").alias("x"), exact_mean("F_kJ_mol").alias("F_kJ_mol"), exact_mean("P", 1e9).alias("P"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_type, user_id, date_trunc('hour', ts) AS hour, avg(value) AS y FROM events GROUP BY 1, 2, 3)
SELECT event_type, hour, round(avg(y), 6) AS mean, round(coalesce(stddev_samp(y), 0), 6) AS std, count(*) AS n FROM r GROUP BY 1, 2""")
def q_conv_checkpoints(spark, d):
    """A10: per checkpoint the mean over sources, missing spread as 0."""
    inner = table(spark, d, "events").groupBy("event_type", "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.avg("value").alias("y"))
    return rounded(inner.groupBy("event_type", "hour").agg(F.avg("y").alias("mean"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("std"), F.count("*").alias("n")), "mean", "std")


@query("""SELECT user_id, event_type, count(*) AS n, arg_max(value, (ts, event_id)) AS final, round(CASE WHEN count(*) > 1 THEN arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) END, 6) AS delta FROM events GROUP BY 1, 2""")
def q_conv_first_last(spark, d):
    """A12."""
    at = F.struct("ts", "event_id")
    made = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max_by("value", at).alias("final"), F.min_by("value", at).alias("_first"))
    return rounded(made.select("user_id", "event_type", "n", "final", F.when(F.col("n") > 1, F.col("final") - F.col("_first")).alias("delta")), "delta")


@query(f"""SELECT variant, metric, round(coalesce(median(CASE WHEN temperature_k > 0 AND isfinite(temperature_k) THEN temperature_k END), 300), 6) AS temperature FROM {PMF} GROUP BY 1, 2""")
def q_temperature(spark, d):
    """A31."""
    return rounded(C.curve_temperature(pmf(spark, d), ["variant", "metric"]), "temperature")


@query(f"WITH m AS (SELECT metric, curve_id, min(F_kJ_mol) AS f FROM {PMF} GROUP BY 1, 2) SELECT metric, min(f) AS lowest, max(f) AS highest, count(*) AS n_curves FROM m GROUP BY 1")
def q_min_range(spark, d):
    """A32."""
    low = pmf(spark, d).groupBy("metric", "curve_id").agg(F.min("F_kJ_mol").alias("f"))
    return low.groupBy("metric").agg(F.min("f").alias("lowest"), F.max("f").alias("highest"), F.count("*").alias("n_curves"))


@query(f"""WITH r AS (SELECT curve_id, min(CASE WHEN cell BETWEEN 0 AND 44 THEN F_kJ_mol END) AS f1, min(CASE WHEN cell BETWEEN 45 AND 120 THEN F_kJ_mol END) AS f2 FROM {CELLS} GROUP BY 1)
SELECT curve_id, f1, f2, round(f2 - f1, 6) AS delta FROM r""")
def q_region_min(spark, d):
    """A33."""
    return rounded(C.region_minima(in_cells(spark, d), ["curve_id"], "cell", "F_kJ_mol", (0, 44), (45, 120)), "delta")


@query(f"""
WITH p AS (SELECT curve_id, x, avg(greatest(P, 0)) AS y FROM {PMF} WHERE P IS NOT NULL GROUP BY 1, 2), i AS (SELECT curve_id, x, y FROM p WHERE x BETWEEN -60 AND 60),
a AS (SELECT curve_id, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS part FROM i WINDOW w AS (PARTITION BY curve_id ORDER BY x)), s AS (SELECT curve_id, coalesce(sum(part), 0) AS s FROM a GROUP BY 1)
SELECT c.curve_id, round(coalesce(s.s, 0), 6) AS integral FROM (SELECT DISTINCT curve_id FROM p) c LEFT JOIN s ON c.curve_id = s.curve_id""")
def q_region_pop(spark, d):
    """W06, W07."""
    rows = pmf(spark, d).where("P IS NOT NULL").withColumn("P", F.greatest(F.col("P"), F.lit(0.0)))
    return rounded(C.region_integral(rows, ["curve_id"], "x", "P", (-60, 60)), "integral")


@query(f"""
WITH m AS {MEANS}, b AS (SELECT *, exp(-least(greatest((F_kJ_mol - min(F_kJ_mol) OVER (PARTITION BY variant, metric)) / {_KT}, 0), 700)) AS b FROM m),
p AS (SELECT variant, metric, cell, b / sum(b) OVER (PARTITION BY variant, metric) AS mass FROM b)
SELECT variant, metric, cell, round(mass, 6) AS mass, round(sum(mass) OVER (PARTITION BY variant, metric ORDER BY cell), 6) AS cumulative FROM p""")
def q_boltzmann(spark, d):
    """Mass from free energies and its running sum."""
    made = C.density(cell_means(spark, d), ["variant", "metric"], temperature=None).select("variant", "metric", "cell", "mass")
    return rounded(C.cumulative(made, ["variant", "metric"], "cell", "mass"), "mass", "cumulative", places=6)


@query(f"""
WITH p AS (SELECT metric, variant, cell, avg(greatest(P, 0)) AS p FROM {CELLS} WHERE P IS NOT NULL GROUP BY 1, 2, 3), f AS (SELECT *, -{_KT} * ln(greatest(p, 1e-300)) AS f FROM p)
SELECT metric, variant, cell, round(f - min(f) OVER (PARTITION BY metric, variant), 6) AS F_kJ_mol FROM f""")
def q_free_energy(spark, d):
    """Free energies from probabilities, lowest at 0."""
    p = in_cells(spark, d).where("P IS NOT NULL").groupBy("metric", "variant", "cell").agg(F.avg(F.greatest("P", F.lit(0.0))).alias("p"))
    f = p.withColumn("f", P.free_energy(F.col("p"), P.kt(F.lit(300.0))))
    return rounded(f.select("metric", "variant", "cell", (F.col("f") - F.min("f").over(Window.partitionBy("metric", "variant"))).alias("F_kJ_mol")), "F_kJ_mol")


@query("SELECT p_partkey, round(0.008314462618 / 4.184 * (250 + p_size), 9) AS kt_kcal, round(p_size - 360.0 * 7 + 180 - 360 * floor((p_size - 360.0 * 7 + 180) / 360) - 180, 6)::DOUBLE AS wrapped FROM part")
def q_units(spark, d):
    """M01, F16, M17."""
    angle = F.col("p_size") - 360.0 * 7
    return rounded(rounded(table(spark, d, "part").select("p_partkey", P.kt(250.0 + F.col("p_size"), "kcal/mol").alias("kt_kcal"), P.wrap180(angle).alias("wrapped")), "kt_kcal", places=9), "wrapped")


@query(f"WITH x AS (SELECT DISTINCT curve_id, x FROM {PMF}), g AS (SELECT curve_id, x - lag(x) OVER (PARTITION BY curve_id ORDER BY x) AS g FROM x) SELECT curve_id, round(median(g), 9) AS width FROM g GROUP BY 1")
def q_bin_width(spark, d):
    """W04."""
    return rounded(C.bin_width(pmf(spark, d), ["curve_id"], "x"), "width", places=9)


@query(f"""
WITH p AS {MEANS}, w AS (SELECT *, cell - lag(cell) OVER o AS h1, lead(cell) OVER o - cell AS h2, lag(F_kJ_mol) OVER o AS y0, lead(F_kJ_mol) OVER o AS y2 FROM p WINDOW o AS (PARTITION BY variant, metric ORDER BY cell))
SELECT variant, metric, cell, F_kJ_mol, CASE WHEN h1 IS NOT NULL AND h2 IS NOT NULL THEN (h1::DOUBLE * h1 * y2 - h2 * h2 * y0 + (h2 * h2 - h1 * h1) * F_kJ_mol) / (h1 * h2 * (h1 + h2)) WHEN h2 IS NOT NULL THEN (y2 - F_kJ_mol) / h2 ELSE (F_kJ_mol - y0) / h1 END AS slope FROM w""")
def q_derivative(spark, d):
    """W05."""
    return C.derivative(cell_means(spark, d), ["variant", "metric"], "cell", "F_kJ_mol")


@query(f"SELECT curve_id, arg_min(x, (F_kJ_mol, x)) AS x, min(F_kJ_mol) AS F_kJ_mol FROM {PMF} GROUP BY 1")
def q_curve_minimum(spark, d):
    """W15."""
    return C.lowest_point(pmf(spark, d), ["curve_id"], "x", "F_kJ_mol")


@query(f"""
WITH r AS (SELECT curve_id, x, F_kJ_mol, row_number() OVER (PARTITION BY curve_id ORDER BY x, F_kJ_mol) - 1 AS i, count(*) OVER (PARTITION BY curve_id) AS n FROM (SELECT curve_id, x, min(F_kJ_mol) AS F_kJ_mol FROM {PMF} GROUP BY 1, 2)),
m AS (SELECT *, first_value(i) OVER (PARTITION BY curve_id ORDER BY F_kJ_mol, i) AS lo FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY i) AS k FROM m WHERE n <= 20 OR i = 0 OR i = n - 1 OR i = lo OR list_contains(list_transform(range(20), lambda j: floor(j * (n - 1) / 19 + 0.5)::BIGINT), i))
SELECT curve_id, x, F_kJ_mol FROM k WHERE n <= 20 OR k <= 20""")
def q_downsample(spark, d):
    """At most 20 points a curve."""
    points = pmf(spark, d).groupBy("curve_id", "x").agg(F.min("F_kJ_mol").alias("F_kJ_mol"))
    return C.downsample(points, ["curve_id"], "x", "F_kJ_mol", 20)


_TURNED = "CASE WHEN g.is_periodic THEN g.x_start + (p.x - g.x_start) - 360 * floor((p.x - g.x_start) / 360) ELSE p.x END"


@query(f"""
WITH c AS MATERIALIZED (SELECT curve_id, metric, is_periodic, x, avg(F_kJ_mol) AS y FROM (SELECT p.curve_id, p.metric, g.is_periodic, {_TURNED} AS x, F_kJ_mol FROM {PMF} p JOIN metric_grid g ON p.metric = g.metric) GROUP BY 1, 2, 3, 4),
n AS MATERIALIZED (SELECT curve_id, metric, x, y FROM c UNION ALL SELECT curve_id, metric, min(x) + 360, arg_min(y, x) FROM c WHERE is_periodic GROUP BY 1, 2 UNION ALL SELECT curve_id, metric, max(x) - 360, arg_max(y, x) FROM c WHERE is_periodic GROUP BY 1, 2),
a AS (SELECT k.curve_id, k.metric, i::INT AS cell, g.x_start + g.x_step * (i + 0.5) AS x FROM (SELECT DISTINCT curve_id, metric FROM c) k JOIN metric_grid g ON k.metric = g.metric, LATERAL (SELECT unnest(range(g.n_cells)) AS i)),
l AS (SELECT a.*, n.x AS lx, n.y AS ly FROM a ASOF LEFT JOIN n ON a.curve_id = n.curve_id AND a.metric = n.metric AND a.x >= n.x),
r AS (SELECT l.*, n.x AS rx, n.y AS ry FROM l ASOF LEFT JOIN n ON l.curve_id = n.curve_id AND l.metric = n.metric AND l.x <= n.x)
SELECT curve_id, metric, cell, round(x, 6) AS x, round(CASE WHEN lx = rx THEN ly ELSE ly + (x - lx) / (rx - lx) * (ry - ly) END, 9) AS F_kJ_mol FROM r""")
def q_grid_interp(spark, d):
    """Every cell centre of every metric's grid by straight lines between readings, angles across their turn; null outside the readings."""
    g = table(spark, d, "metric_grid")
    centres = g.select("metric", F.explode(F.sequence(F.lit(0), F.col("n_cells") - 1)).alias("cell"), "x_start", "x_step").select("metric", "cell", (F.col("x_start") + F.col("x_step") * (F.col("cell") + 0.5)).alias("x"))
    turned = F.when(F.col("is_periodic"), F.col("x_start") + F.pmod(F.col("x") - F.col("x_start"), F.lit(360.0))).otherwise(F.col("x"))
    keys = ["curve_id", "metric"]
    rows = pmf(spark, d).join(g, "metric").select(*keys, "is_periodic", turned.alias("x"), "F_kJ_mol").groupBy(*keys, "is_periodic", "x").agg(F.avg("F_kJ_mol").alias("F_kJ_mol"))
    ends = rows.where("is_periodic").groupBy(*keys).agg(F.min(F.struct("x", "F_kJ_mol")).alias("low"), F.max(F.struct("x", "F_kJ_mol")).alias("high"))
    side = lambda end, turn: ends.select(*keys, (F.col(f"{end}.x") + turn).alias("x"), F.col(f"{end}.F_kJ_mol").alias("F_kJ_mol"))
    known = rows.select(*keys, "x", "F_kJ_mol").unionByName(side("low", 360.0)).unionByName(side("high", -360.0))
    asked = rows.select(*keys).distinct().join(centres, "metric")
    made = C.interpolate(known, asked, keys, "x", "F_kJ_mol").join(F.broadcast(centres), ["metric", "x"])
    return rounded(rounded(made.select(*keys, "cell", "x", "F_kJ_mol"), "x"), "F_kJ_mol", places=9)


@query("""
WITH o AS (SELECT user_id, event_type, event_id, row_number() OVER w AS i, avg(value) OVER (w ROWS UNBOUNDED PRECEDING) AS y FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
t AS (SELECT *, count(*) OVER g AS n, last_value(y) OVER (g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, max(y) OVER g - min(y) OVER g AS r FROM o WINDOW g AS (PARTITION BY user_id, event_type)),
e AS (SELECT *, greatest(0.5, 0.05 * greatest(r, abs(f), 1e-12)) AS e, greatest(3, round(0.2 * n)::INT) AS w FROM t),
x AS (SELECT *, first_value(CASE WHEN abs(y - f) > e THEN i END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM e)
SELECT user_id, event_type, first(n) AS n, round(first(f), 6) AS final, round(first(e), 6) AS epsilon, min(CASE WHEN coalesce(nx, n + 1) >= i + w AND i + w - 1 <= n THEN i END) AS t_conv FROM x GROUP BY 1, 2""")
def q_conv_time(spark, d):
    """W08 over the running mean of each series."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    runs = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(order).cast("bigint").alias("i"), F.avg("value").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("y"))
    return rounded(C.convergence_time(runs, ["user_id", "event_type"], "i", "y", 0.5, 0.05, 0.2), "final", "epsilon")


@query(f"""
WITH m AS {MEANS}, b AS (SELECT *, exp(-least(greatest((F_kJ_mol - min(F_kJ_mol) OVER (PARTITION BY variant, metric)) / {_KT}, 0), 700)) AS b FROM m),
p AS (SELECT variant, metric, cell, b / sum(b) OVER (PARTITION BY variant, metric) AS mass FROM b), s AS (SELECT metric, cell, sum(mass) AS p FROM p GROUP BY 1, 2),
n AS (SELECT metric, cell, p / sum(p) OVER (PARTITION BY metric) AS p FROM s)
SELECT metric, cell, round(p, 6) AS p, round(-{_KT} * ln(p) - min(-{_KT} * ln(p)) OVER (PARTITION BY metric), 6) AS F_kJ_mol FROM n""")
def q_mixture_pmf(spark, d):
    """The curve of a mixture of all variants, equally weighted."""
    masses = C.density(cell_means(spark, d), ["variant", "metric"], temperature=None)
    mixed = C.mixture(masses, ["metric"], "cell", "mass", F.lit(1.0)).withColumn("f", P.free_energy(F.col("p"), P.kt(F.lit(300.0))))
    return rounded(rounded(mixed.select("metric", "cell", "p", (F.col("f") - F.min("f").over(Window.partitionBy("metric"))).alias("F_kJ_mol")), "p"), "F_kJ_mol")


@query(f"""
WITH m AS {MEANS} SELECT metric, cell, count(*) AS n, {sql_mean('F_kJ_mol')} AS mean, round(quantile_cont(F_kJ_mol, 0.25), 8) AS q25, round(quantile_cont(F_kJ_mol, 0.75), 8) AS q75 FROM m GROUP BY 1, 2""")
def q_representative_pmf(spark, d):
    """Mean and quartiles of a set of curves on their grid."""
    q = F.percentile("F_kJ_mol", F.array(F.lit(0.25), F.lit(0.75)))
    made = cell_means(spark, d).groupBy("metric", "cell").agg(F.count("*").alias("n"), exact_mean("F_kJ_mol").alias("mean"), q.alias("q"))
    return rounded(made.select("metric", "cell", "n", "mean", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75")), "q25", "q75", places=8)


# Masses of P on every cell of the grid, per variant and metric; variants have no id, so "divisible by 20" goes by a hash of the name.
_MASS = f"""
p AS (SELECT variant, metric, cell, avg(greatest(P, 0)) AS p FROM {CELLS} WHERE P IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT variant, metric FROM p GROUP BY 1, 2 HAVING sum(p) > 0),
g AS (SELECT metric, i AS cell FROM metric_grid, LATERAL (SELECT unnest(range(n_cells))::INT AS i)),
f AS (SELECT k.variant, k.metric, g.cell, coalesce(p.p, 0) AS p FROM k JOIN g ON k.metric = g.metric LEFT JOIN p ON p.variant = k.variant AND p.metric = k.metric AND p.cell = g.cell),
n AS (SELECT *, p / sum(p) OVER (PARTITION BY variant, metric) AS mass FROM f)"""
_ASKED = "CAST('0x' || substr(md5({}), 1, 4) AS INTEGER) % 20 = 0"


def _readings(spark, d):
    return in_cells(spark, d).where("P IS NOT NULL").groupBy("variant", "metric", "cell").agg(F.avg(F.greatest("P", F.lit(0.0))).alias("p"))


def _sets(spark, d):
    """(all variants' curves, those of the variants that ask, cells per metric); the grid is a fixed table."""
    sets = cut(C.curve_sets(_readings(spark, d), "variant", "metric", "cell", "p"), "sets")
    sizes = {r["metric"]: r["n_cells"] for r in table(spark, d, "metric_grid").select("metric", "n_cells").collect()}
    return sets, sets.where(F.conv(F.substring(F.md5("variant"), 1, 4), 16, 10).cast("int") % 20 == 0), sizes


@query(f"""WITH {_MASS}, h AS (SELECT variant, metric, cell, greatest(mass, 1e-15) AS m FROM n), l AS (SELECT variant, metric, cell, m / sum(m) OVER (PARTITION BY variant, metric) AS m FROM h),
c AS MATERIALIZED (SELECT *, sum(m) OVER (PARTITION BY variant, metric ORDER BY cell) AS cm FROM l), q AS MATERIALIZED (SELECT * FROM c WHERE {_ASKED.format('variant')}),
d AS (SELECT a.metric, a.variant AS query, b.variant AS item, sqrt(greatest(sum((a.m * ln(a.m / ((a.m + b.m) / 2)) + b.m * ln(b.m / ((a.m + b.m) / 2))) / 2), 0)) AS js, sqrt(greatest(1 - sum(sqrt(a.m) * sqrt(b.m)), 0)) AS hellinger, sum(abs(a.cm - b.cm)) / count(*) AS w1
  FROM q a JOIN c b ON a.metric = b.metric AND a.cell = b.cell AND a.variant <> b.variant GROUP BY 1, 2, 3),
t AS (SELECT metric, query, item, 'js' AS kind, js AS v FROM d UNION ALL SELECT metric, query, item, 'hellinger', hellinger FROM d UNION ALL SELECT metric, query, item, 'w1', w1 FROM d),
s AS (SELECT metric, kind, bin / 10000 AS scale FROM (SELECT metric, kind, greatest(floor(v * 10000 + 0.5), 1) AS bin, row_number() OVER (PARTITION BY metric, kind ORDER BY greatest(floor(v * 10000 + 0.5), 1)) AS r, count(*) OVER (PARTITION BY metric, kind) AS n FROM t WHERE v > 1e-9) WHERE r = (n + 1) // 2),
m AS (SELECT t.kind, query, item, avg(v / coalesce(scale, 1)) AS distance, count(*)::INT AS n_metrics FROM t LEFT JOIN s ON t.metric = s.metric AND t.kind = s.kind GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, query ORDER BY round(distance, 9), item)::INT AS place FROM m)
SELECT kind, query, item, round(distance, 6) AS distance, n_metrics, place FROM r WHERE place <= 5""")
def q_curve_distances(spark, d):
    """The five variants whose curves are nearest to each asked variant's, over all metrics both have, each over its median."""
    sets, asked, sizes = _sets(spark, d)
    return rounded(C.nearest_curves(sets, asked, "variant", sizes, 5, ("js", "hellinger", "w1")), "distance")


@query(f"""WITH {_MASS}, s AS (SELECT metric, cell, sum(sqrt(mass)) AS s FROM n GROUP BY 1, 2), i AS (SELECT metric, count(DISTINCT variant) AS c FROM n GROUP BY 1),
o AS (SELECT n.metric, n.variant AS item, CASE WHEN any_value(i.c) > 1 THEN round(greatest(1 - sum(sqrt(mass) * (s.s - sqrt(mass))) / (any_value(i.c) - 1), 0), 9) END AS cohesion FROM n JOIN s ON n.metric = s.metric AND n.cell = s.cell JOIN i ON n.metric = i.metric GROUP BY 1, 2)
SELECT metric, item, round(cohesion, 6) AS cohesion, item = first_value(item) OVER (PARTITION BY metric ORDER BY cohesion NULLS FIRST, item) AS is_medoid FROM o""")
def q_medoid(spark, d):
    """Each variant's mean squared Hellinger distance to all others of its metric; the least is the medoid in the space of the roots of P."""
    p = _readings(spark, d)
    masses = p.withColumn("_t", F.sum("p").over(Window.partitionBy("variant", "metric"))).where("_t > 0").select("variant", "metric", "cell", (F.col("p") / F.col("_t")).alias("mass"))
    return rounded(C.medoids(masses, ["metric"], "variant", "cell", "mass").withColumnRenamed("variant", "item"), "cohesion")


@query(f"""WITH c AS (SELECT metric, cell, count(*)::DOUBLE AS n FROM {CELLS} GROUP BY 1, 2), t AS (SELECT c.*, sum(n) OVER (PARTITION BY metric) AS t, count(*) OVER (PARTITION BY metric) AS k FROM c), p AS (SELECT *, (n + 0.5) / (t + 0.5 * k) AS p FROM t)
SELECT metric, cell, round(p, 9) AS p, round(greatest(p - 1.959964 * sqrt(p * (1 - p) / greatest(t, 1)), 0), 9) AS lo, round(least(p + 1.959964 * sqrt(p * (1 - p) / greatest(t, 1)), 1), 9) AS hi,
  round(-ln(least(p + 1.959964 * sqrt(p * (1 - p) / greatest(t, 1)), 1)) - min(-ln(p)) OVER (PARTITION BY metric), 6) AS f_lo, round(-ln(p) - min(-ln(p)) OVER (PARTITION BY metric), 6) AS f FROM p""")
def q_pmf_1d_ci(spark, d):
    """A smoothed histogram as probabilities and energies with a band; high P is low F."""
    w = Window.partitionBy("metric")
    c = in_cells(spark, d).groupBy("metric", "cell").agg(F.count("*").cast("double").alias("n"))
    p = c.withColumn("t", F.sum("n").over(w)).withColumn("k", F.count("*").over(w)).withColumn("p", (F.col("n") + 0.5) / (F.col("t") + 0.5 * F.col("k")))
    half = 1.959964 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.greatest(F.col("t"), F.lit(1.0)))
    p = p.withColumn("lo", F.greatest(F.col("p") - half, F.lit(0.0))).withColumn("hi", F.least(F.col("p") + half, F.lit(1.0)))
    zero = F.min(-F.ln("p")).over(w)
    made = p.select("metric", "cell", "p", "lo", "hi", (-F.ln("hi") - zero).alias("f_lo"), (-F.ln("p") - zero).alias("f"))
    return rounded(rounded(made, "p", "lo", "hi", places=9), "f_lo", "f")


@query(f"""WITH a AS (SELECT variant, replica, cell // 6 AS bx, count(*) AS n FROM {CELLS} WHERE metric = 'phi_res4' GROUP BY 1, 2, 3), b AS (SELECT variant, replica, cell // 6 AS by_, count(*) AS n FROM {CELLS} WHERE metric = 'psi_res4' GROUP BY 1, 2, 3),
j AS (SELECT bx, by_, sum(a.n * b.n)::DOUBLE AS n FROM a JOIN b ON a.variant = b.variant AND a.replica = b.replica GROUP BY 1, 2), p AS (SELECT *, (n + 1) / (sum(n + 1) OVER ()) AS p FROM j)
SELECT bx AS xbin, by_ AS ybin, round(p, 9) AS p, round(least(-{_KT} * ln(p) - min(-{_KT} * ln(p)) OVER (), 25), 6) AS F_kJ_mol FROM p""")
def q_pmf_2d(spark, d):
    """A 2-D map from two torsions of the same variant and replica, smoothed, capped."""
    rows = in_cells(spark, d)
    side = lambda m, c: rows.where(F.col("metric") == m).groupBy("variant", "replica", F.floor(F.col("cell") / 6).alias(c)).agg(F.count("*").alias(c + "_n"))
    both = side("phi_res4", "xbin").join(side("psi_res4", "ybin"), ["variant", "replica"]).groupBy("xbin", "ybin").agg(F.sum(F.col("xbin_n") * F.col("ybin_n")).cast("double").alias("n"))
    total = both.agg(F.sum(F.col("n") + 1).alias("t"), F.max("n").alias("m"))
    p = both.join(F.broadcast(total)).withColumn("p", (F.col("n") + 1) / F.col("t"))
    f = -_KT * F.ln("p") + _KT * F.ln((F.col("m") + 1) / F.col("t"))
    return rounded(rounded(p.select(F.col("xbin").cast("int").alias("xbin"), F.col("ybin").cast("int").alias("ybin"), "p", F.least(f, F.lit(25.0)).alias("F_kJ_mol")), "p", places=9), "F_kJ_mol")


@query(f"""WITH x AS (SELECT DISTINCT metric, CASE WHEN x_step >= 1 THEN floor(x + 0.5) ELSE floor(x * 1000 + 0.5) / 1000 END AS x FROM (SELECT p.metric, p.x, g.x_step FROM {PMF} p JOIN metric_grid g ON p.metric = g.metric)),
n AS (SELECT metric, count(*) AS n, min(x) AS x0, max(x) AS x1 FROM x GROUP BY 1)
SELECT metric, n, x0, x1, least(n, 64) AS kept, round((x1 - x0) / 63, 6) AS step FROM n""")
def q_grid(spark, d):
    """Rounded distinct x per metric and the even grid that replaces more than 64 of them."""
    g = table(spark, d, "metric_grid").select("metric", F.when(F.col("x_step") >= 1, 0).otherwise(3).alias("k"))
    x = pmf(spark, d).join(g, "metric").select("metric", F.when(F.col("k") == 0, F.floor(F.col("x") + 0.5)).otherwise(F.floor(F.col("x") * 1000 + 0.5) / 1000).cast("double").alias("x")).distinct()
    made = x.groupBy("metric").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    return rounded(made.select("metric", "n", "x0", "x1", F.least("n", F.lit(64)).cast("bigint").alias("kept"), ((F.col("x1") - F.col("x0")) / 63).alias("step")), "step")


@query(f"""WITH p AS (SELECT variant, metric, cell, avg(greatest(P, 0)) AS p FROM {CELLS} WHERE P IS NOT NULL GROUP BY 1, 2, 3), g AS (SELECT metric, i AS cell FROM metric_grid, LATERAL (SELECT unnest(range(n_cells))::INT AS i)),
k AS (SELECT variant, metric FROM p GROUP BY 1, 2 HAVING sum(p) > 0), f AS (SELECT k.variant, k.metric, g.cell, coalesce(p.p, 0) AS p FROM k JOIN g ON k.metric = g.metric LEFT JOIN p ON p.variant = k.variant AND p.metric = k.metric AND p.cell = g.cell),
m AS (SELECT *, p / sum(p) OVER (PARTITION BY variant, metric) AS mass, count(*) OVER (PARTITION BY variant, metric) AS n FROM f)
SELECT variant, metric || '|x=' || cell AS "column", round(mass, 7) AS mass, round(sqrt(mass) / sqrt(n), 7) AS shape FROM m""")
def q_design_matrix(spark, d):
    """Blocks of mass per metric that sum to 1, zero where missing, and their balanced square roots."""
    p = in_cells(spark, d).where("P IS NOT NULL").groupBy("variant", "metric", "cell").agg(F.avg(F.greatest("P", F.lit(0.0))).alias("p"))
    keys = p.groupBy("variant", "metric").agg(F.sum("p").alias("_t")).where("_t > 0").drop("_t")
    cells = table(spark, d, "metric_grid").select("metric", F.explode(F.sequence(F.lit(0), F.col("n_cells") - 1)).alias("cell"))
    w = Window.partitionBy("variant", "metric")
    full = keys.join(cells, "metric").join(p, ["variant", "metric", "cell"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    mass = full.withColumn("mass", F.col("p") / F.sum("p").over(w)).withColumn("n", F.count("*").over(w))
    return rounded(mass.select("variant", F.concat("metric", F.lit("|x="), F.col("cell").cast("string")).alias("column"), "mass", (F.sqrt("mass") / F.sqrt("n")).alias("shape")), "mass", "shape", places=7)


@query("""SELECT metric, regexp_extract(metric, '^(phi|psi)_res([0-9]+)$', 1) <> '' AS is_torsion, CASE WHEN regexp_extract(metric, '^(phi|psi)_res([0-9]+)$', 1) <> '' THEN CASE WHEN metric LIKE 'phi%' THEN 'φ ' ELSE 'ψ ' END || regexp_extract(metric, '[0-9]+') ELSE metric END AS label,
row_number() OVER (ORDER BY regexp_extract(metric, '^(phi|psi)_res([0-9]+)$', 1) = '', left(metric, 3) || CASE WHEN metric LIKE 'p%' THEN '' ELSE '~' END, CAST('0' || regexp_extract(metric, '[0-9]+') AS INT), lower(metric)) AS place FROM metric_grid WHERE metric LIKE 'p%'""")
def q_torsion_names(spark, d):
    """F01, F02, F04, T12."""
    g = table(spark, d, "metric_grid").where("metric LIKE 'p%'")
    m = F.col("metric")
    return g.select(m, N.torsion(m).isNotNull().alias("is_torsion"), N.label(m, F.lit(None).cast("string")).alias("label"), F.row_number().over(Window.orderBy(*N.torsion_order(m))).cast("bigint").alias("place"))


@query()
def q_quantile_distance(spark, d):
    """As q_curve_distances, by W2 of the quantile functions at 256 points."""
    sets, asked, sizes = _sets(spark, d)
    return rounded(C.nearest_curves(sets, asked, "variant", sizes, 5, ("w2",)), "distance")
