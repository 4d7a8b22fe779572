"""Queries of the subpackage over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.llm import clusters, leakage, neighbours, percentiles, reading, tokens
from curvelake.session import table

SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.unit_vectors(table(spark, d, "pmf"), table(spark, d, "metric_grid"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, d))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar curves of every curve whose id is divisible by 20, searched among all curves."""
    return neighbours.most_similar(_vectors(spark, d), 5, query="curve_id % 20 = 0").withColumn("similarity", F.round("similarity", 4))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    days = percentiles.day_partials(table(spark, d, "pmf"), ["metric"], ["F_kJ_mol", "x"], "written_at")
    return percentiles.percentiles(days, ["metric"], SHARES).withColumn("value", F.round("value", 9))


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster(table(spark, d, "features"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _clustered(spark, d).select("variant", "cluster_key")


def p4_typical(spark: SparkSession, d: str) -> DataFrame:
    return clusters.typical_members(_clustered(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_spans(spark, d).select("doc_id", "item_id")


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "reading_level")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_neighbours, p3_percentiles, p4_found, p4_typical, p8_ids, p9_found, p9_spans, p10_found)
}


_VECTORS = """
r AS (SELECT p.curve_id, p.metric, P, CASE WHEN g.is_periodic THEN p.x - 360 * floor((p.x - g.x_start) / 360) ELSE p.x END AS w, g.x_start, g.x_step, g.n_cells FROM pmf p JOIN metric_grid g ON p.metric = g.metric WHERE curve_id IS NOT NULL AND isfinite(P) AND isfinite(p.x)),
m AS (SELECT metric, curve_id, CAST(floor((w - x_start) / x_step) AS INTEGER) AS cell, avg(greatest(P, 0)) AS v FROM r WHERE floor((w - x_start) / x_step) BETWEEN 0 AND n_cells - 1 GROUP BY 1, 2, 3),
u AS MATERIALIZED (SELECT metric, curve_id, cell, sqrt(v / t) AS s FROM (SELECT *, sum(v) OVER (PARTITION BY metric, curve_id) AS t FROM m) WHERE t > 0)"""
_NEAR = lambda asked: f"""n AS (SELECT metric, curve_id, neighbour_id, similarity, row_number() OVER (PARTITION BY metric, curve_id ORDER BY round(similarity, 7) DESC, neighbour_id) AS place FROM (
  SELECT a.metric, a.curve_id, b.curve_id AS neighbour_id, sum(a.s * b.s) AS similarity FROM u a JOIN u b ON a.metric = b.metric AND a.cell = b.cell AND a.curve_id <> b.curve_id WHERE {asked} GROUP BY 1, 2, 3) WHERE similarity > 0)"""  # noqa: E731

# The groups of the test table are complete: whoever is near one member is near all.
_CLUSTERS = f"""
v AS MATERIALIZED (SELECT variant, upper(list_extract(list_sort(list_transform(regexp_extract_all(variant, '[a-zA-Z]+'), lambda x, i: {{'n': -length(x), 'i': i, 'x': x}})), 1).x) AS seq FROM (SELECT DISTINCT variant FROM features WHERE regexp_matches(variant, '[a-zA-Z]'))),
q AS MATERIALIZED (SELECT seq, min(variant) AS low, count(*) AS copies FROM v GROUP BY 1),
e AS MATERIALIZED (SELECT a.seq AS src, b.seq AS dst, a.copies, b.low, b.copies AS others, levenshtein(a.seq, b.seq) AS edits FROM q a JOIN q b ON abs(length(a.seq) - length(b.seq)) <= {clusters.MOST_EDITS} WHERE levenshtein(a.seq, b.seq) <= {clusters.MOST_EDITS}),
k AS (SELECT src, min(low) AS cluster_key, sum(others)::BIGINT AS size, round(sum(exp(-edits / {clusters.MOST_EDITS}.0) * others) - 1, 9) AS affinity FROM e GROUP BY 1)"""

SQL: dict[str, str] = {
    "p3_percentiles": """
WITH t AS (
  SELECT metric, 'F_kJ_mol' AS "column", F_kJ_mol AS v FROM pmf WHERE isfinite(F_kJ_mol)
  UNION ALL SELECT metric, 'x', x FROM pmf WHERE isfinite(x)
), q AS (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS share, unnest([1, 2, 3, 4, 5, 6, 7]) AS i),
a AS (SELECT metric, "column", quantile_cont(v, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS vs, count(*) AS n FROM t GROUP BY 1, 2)
SELECT metric, "column", share, round(vs[i], 9) AS value, n FROM a CROSS JOIN q""",
    "p2_found": f"WITH {_VECTORS}, {_NEAR('true')} SELECT DISTINCT least(curve_id, neighbour_id) AS curve_a, greatest(curve_id, neighbour_id) AS curve_b FROM n WHERE place <= 5 AND similarity >= 0.98",
    "p2_neighbours": f"WITH {_VECTORS}, {_NEAR('a.curve_id % 20 = 0')} SELECT metric, curve_id, neighbour_id, round(similarity, 4) AS similarity, place::INTEGER AS place FROM n WHERE place <= 5",
    "p4_found": f"WITH {_CLUSTERS} SELECT variant, cluster_key FROM v JOIN k ON v.seq = k.src WHERE size > 1",
    "p4_typical": f"""WITH {_CLUSTERS}, r AS (SELECT variant, cluster_key, size, row_number() OVER (PARTITION BY cluster_key ORDER BY affinity DESC, variant) AS place FROM v JOIN k ON v.seq = k.src WHERE size > 1)
SELECT cluster_key, size, list(variant ORDER BY place) AS typical FROM r WHERE place <= 3 GROUP BY 1, 2""",
}
