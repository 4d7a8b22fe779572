"""The most similar vectors of every vector.

Method: collision-counting hashing. Every vector is projected on single random Gaussian directions, each a sorted array
of its own; windows centred on the query widen by virtual rehashing (the half width grows with the search radius, no
table is built again), and the vectors that fall into the windows of enough projections are verified exactly.

To spread this over a cluster, the vectors of a metric are parted into Voronoi cells of centres that are fitted on a
bounded sample (SAMPLE_PER_CELL rows a cell). Every vector is indexed in its own cell; a query also looks into each
cell whose border runs within MARGIN times the search radius. Cells are cut into blocks of BLOCK rows and BLOCK queries,
so neither a hot metric nor a hot cell is ever gathered into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelake.operators.grid import dense, finite, in_cells
from curvelake.session import cut

PROJECTIONS, THRESHOLD, HALF_WIDTH = 24, 16, 1.5
CELL, SAMPLE_PER_CELL, MOST_CELLS, MARGIN, BLOCK = 2000, 12, 4096, 0.35, 4096


def curve_vectors(curves: DataFrame, grid: DataFrame) -> DataFrame:
    """metric, curve_id, n_cells, cells: for each curve the mean P of the cells that have one, negative P as 0.

    P that is null, NaN or infinite is no reading. Repeated rows count as often as they stand. Rows without curve_id, or
    outside the grid, belong to no cell. Folds map-side to at most n_cells rows a curve.
    """
    p = finite(F.col("P"))
    means = in_cells(curves, grid, ["P"]).where(p.isNotNull()).groupBy("metric", "curve_id", "cell").agg(F.avg(F.greatest(p, F.lit(0.0))).alias("v"))
    return means.groupBy("metric", "curve_id").agg(F.collect_list(F.struct("cell", "v")).alias("cells")).join(grid.select("metric", "n_cells"), "metric")


def unit_vectors(curves: DataFrame, grid: DataFrame) -> DataFrame:
    """metric, curve_id, vec: the square roots of each curve's vector over its sum, as float32 bytes.

    Their dot product is the similarity (sum of the square roots of the products), their squared distance 2 - 2 times
    that. A curve whose vector sums to 0 is like no other and is left out.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_of = batch.column("n_cells").to_numpy()
            for n in np.unique(n_of):
                part = batch.filter(pa.array(n_of == n))
                m = np.nan_to_num(dense(part.column("cells"), "v", int(n)))
                total = m.sum(1)
                keep = np.flatnonzero(total > 0)
                m = np.sqrt(m[keep] / total[keep, None]).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"metric": part.column("metric").take(keep), "curve_id": part.column("curve_id").take(keep), "vec": pa.array([r.tobytes() for r in m], pa.binary())})

    return curve_vectors(curves, grid).mapInArrow(pack, "metric string, curve_id bigint, vec binary")


def _matrix(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), -1)


def _nearest(m: np.ndarray, centres: np.ndarray, step: int = 2000) -> np.ndarray:
    """Index of the nearest centre of each row, in steps, so that no large distance matrix stands in memory."""
    squares = np.einsum("ij,ij->i", centres, centres)
    return np.concatenate([(squares[None, :] - 2 * m[i : i + step] @ centres.T).argmin(1) for i in range(0, len(m), step)] or [np.zeros(0, int)])


def fit_cells(vectors: DataFrame) -> dict[str, np.ndarray]:
    """metric -> centres. Metrics of up to two cells' rows get one. The sample is chosen by hash and bounded."""
    counts = {r["metric"]: r["n"] for r in vectors.groupBy("metric").agg(F.count("*").alias("n")).collect()}  # a metric each: the fixed grid's
    share = {m: min(1.0, SAMPLE_PER_CELL * min(-(-n // CELL), MOST_CELLS) / n) for m, n in counts.items() if n > 2 * CELL}
    out: dict[str, np.ndarray] = {}
    if share:
        limit = F.create_map(*[F.lit(x) for m, s in share.items() for x in (m, int(s * (1 << 30)))])
        drawn = vectors.where(F.pmod(F.xxhash64("curve_id", F.lit("cells")), F.lit(1 << 30)) < F.try_element_at(limit, F.col("metric"))).toPandas()
        for metric, part in drawn.sort_values("curve_id").groupby("metric"):
            rows = _matrix(part["vec"])
            rng = np.random.default_rng(7)
            centres = rows[rng.permutation(len(rows))[: max(1, min(MOST_CELLS, -(-counts[metric] // CELL)))]].copy()
            for _ in range(6):
                near = _nearest(rows, centres)
                for c in np.unique(near):
                    centres[c] = rows[near == c].mean(0)
            out[metric] = centres
    return out


def _placed(vectors: DataFrame, centres: dict[str, np.ndarray], radius: float, query: str, margin: float = MARGIN) -> DataFrame:
    """vectors with home, their own cell, and probes, the cells a query looks into (empty for vectors that don't ask)."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS rows a metric

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for metric, part in batch.groupby("metric"):
                c = sent.value.get(metric)
                m = _matrix(part["vec"])
                if c is None or len(c) == 1:
                    home, probes = np.zeros(len(part), np.int32), [np.zeros(1, np.int32)] * len(part)
                else:
                    home, probes = _nearest(m, c).astype(np.int32), []
                    squares, between = np.einsum("ij,ij->i", c, c), c @ c.T if len(c) <= 1024 else None
                    for i in range(0, len(m), 1000):
                        at, own = np.arange(len(m[i : i + 1000])), home[i : i + 1000]
                        dist = squares[None, :] - 2 * m[i : i + 1000] @ c.T
                        cross = between[own] if between is not None else c[own] @ c.T
                        apart = np.sqrt(np.maximum(squares[own][:, None] + squares[None, :] - 2 * cross, 1e-12))
                        border = (dist - dist[at, own][:, None]) / (2 * apart)
                        border[at, own] = 0
                        probes += [np.flatnonzero(b <= margin * radius).astype(np.int32) for b in border]
                none = np.zeros(0, np.int32)
                yield pd.DataFrame({"metric": metric, "curve_id": part["curve_id"], "vec": part["vec"], "home": home, "probes": [p if a else none for p, a in zip(probes, part["asks"])]})

    return vectors.withColumn("asks", F.expr(query)).mapInPandas(place, "metric string, curve_id bigint, vec binary, home int, probes array<int>")


def search(row_ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, radius: float, first_radius: float, seed: int = 11, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, similarity) of the up to k nearest rows of each query within radius, by collision counting.

    Every row that collides often enough is verified, however many do; of equally similar ones the smaller ids come first.
    """
    directions = np.random.default_rng(seed).standard_normal((PROJECTIONS, rows.shape[1])).astype(np.float32)
    p_rows, p_queries = rows @ directions.T, queries @ directions.T
    order = p_rows.argsort(0, kind="stable")
    arrays = np.take_along_axis(p_rows, order, 0)
    rank = np.empty_like(order, dtype=np.uint16)
    np.put_along_axis(rank, order, np.arange(len(rows), dtype=np.uint16)[:, None], 0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live, r = np.arange(len(queries)), first_radius
    while len(live):
        r = min(r, radius)
        still = []
        for at in range(0, len(live), 256):
            some = live[at : at + 256]
            hits = np.zeros((len(some), len(rows)), np.uint8)
            for j in range(PROJECTIONS):
                lo = np.searchsorted(arrays[:, j], p_queries[some, j] - HALF_WIDTH * r).astype(np.uint16)
                hi = np.searchsorted(arrays[:, j], p_queries[some, j] + HALF_WIDTH * r, "right").astype(np.uint16)
                hits += (rank[:, j][None, :] - lo[:, None]) < (hi - lo)[:, None]
            met = hits >= threshold
            near_q, near_c = [], []
            for i, one in enumerate(some):
                c = np.flatnonzero(met[i])
                c = c[row_ids[c] != query_ids[one]]
                if len(c) > k:  # float32 is off by far less than 1e-5: whatever may be among the k goes on, ties included
                    rough = rows[c] @ queries[one]
                    c = c[rough >= np.partition(rough, len(c) - k)[len(c) - k] - 1e-5]
                near_q.append(np.full(len(c), one))
                near_c.append(c)
            q, c = np.concatenate(near_q), np.concatenate(near_c)
            sim = np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + 100_000]], rows[c[i : i + 100_000]], dtype=np.float64) for i in range(0, len(q), 100_000)] or [np.zeros(0)])
            inside = 2 - 2 * sim <= radius * radius + 1e-9
            q, c, sim = q[inside], c[inside], sim[inside]
            by = np.lexsort((row_ids[c], -sim, q))
            q, c, sim = q[by], c[by], sim[by]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            top = place < k
            q, c, sim = q[top], c[top], sim[top]
            near = np.bincount(q[2 - 2 * sim <= r * r], minlength=len(queries))
            done = (near[some] >= k) | (r >= radius)
            still.append(some[~done])
            ended = np.isin(q, some[done])
            found.append((query_ids[q[ended]], row_ids[c[ended]], sim[ended]))
        live, r = np.concatenate(still), r * 2
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _copies(stored: DataFrame, k: int, spread: int = 64) -> tuple[DataFrame, DataFrame] | None:
    """(members: metric, curve_id, rep; groups: metric, rep, ids, the k + 1 smallest members) of vectors that occur more than
    once, or None where all differ. Two rounds, so that copies of one vector never meet in one task."""
    key = ["metric", "_h1", "_h2"]
    hashed = stored.select("metric", "curve_id", F.xxhash64("vec").alias("_h1"), F.xxhash64(F.lit(1), F.col("vec")).alias("_h2"))
    several = hashed.groupBy(*key).agg(F.count("*").alias("_n"), F.min("curve_id").alias("rep")).where("_n > 1")
    several = cut(several, "copies")
    if several.isEmpty():
        return None
    members = cut(hashed.join(several, key).select("metric", "curve_id", "rep"), "members")
    sliced = members.withColumn("_s", F.pmod(F.xxhash64("curve_id", F.lit("slice")), F.lit(spread)))
    first = sliced.withColumn("_r", F.row_number().over(Window.partitionBy("metric", "rep", "_s").orderBy("curve_id"))).where(F.col("_r") <= k + 1)
    smallest = first.withColumn("_r", F.row_number().over(Window.partitionBy("metric", "rep").orderBy("curve_id"))).where(F.col("_r") <= k + 1)
    return members, smallest.groupBy("metric", "rep").agg(F.array_sort(F.collect_list("curve_id")).alias("ids"))


def most_similar(vectors: DataFrame, k: int = 5, least: float | None = None, query: str = "true", exact: bool = False) -> DataFrame:
    """metric, curve_id, neighbour_id, similarity, place: the k most similar vectors of the same metric.

    vectors: metric, curve_id, vec as of unit_vectors; one row per curve and metric. query: which vectors ask, by a
    condition on curve_id (all are searched). least: neighbours below this similarity are of no interest, which bounds the
    radius; without it windows widen until k are found in the cells looked into. Ties go to the smaller id; a vector is
    never its own neighbour. A vector without a neighbour has no row. Empty input: no rows. exact: every cell is looked
    into and every vector counts as colliding, so nothing is missed, at the price of comparing all with all.

    Copies of one vector are searched once, by their smallest id, and take part in every result as the vectors they are;
    the work for a group of copies grows with its size, not with its square.
    """
    stored = cut(vectors.select("metric", "curve_id", "vec"), "vectors")
    copies = _copies(stored, k)
    order = Window.partitionBy("metric", "curve_id").orderBy(F.desc("similarity"), "neighbour_id")
    if copies is None:
        found = _search_all(stored, k, least, query, exact)
    else:
        members, groups = copies
        spare = members.where("curve_id <> rep").select("metric", "curve_id")
        near = _search_all(stored.join(spare, ["metric", "curve_id"], "left_anti"), k, least, "true", exact)
        asked = groups.select("metric", F.col("rep").alias("neighbour_id"), "ids")
        wide = near.join(asked, ["metric", "neighbour_id"], "left").select("metric", F.col("curve_id").alias("rep"), F.explode(F.coalesce("ids", F.array("neighbour_id"))).alias("neighbour_id"), "similarity")
        own = groups.select("metric", "rep", F.explode("ids").alias("neighbour_id"), F.lit(1.0).alias("similarity"))
        top = Window.partitionBy("metric", "rep").orderBy(F.desc("similarity"), "neighbour_id")
        lists = cut(wide.unionByName(own).withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1).drop("_r"), "lists")
        of = members.select(F.col("metric").alias("_m"), F.col("rep").alias("_rep"), "curve_id")
        met = lists.join(of, (F.col("metric") == F.col("_m")) & (F.col("rep") == F.col("_rep")), "left").select("metric", F.coalesce("curve_id", "rep").alias("curve_id"), "neighbour_id", "similarity")
        found = met.where("curve_id <> neighbour_id").where(query)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _search_all(stored: DataFrame, k: int, least: float | None, query: str, exact: bool = False) -> DataFrame:
    """metric, curve_id, neighbour_id, similarity: up to k of each block looked into."""
    radius = float(np.sqrt(2 - 2 * least)) if least is not None else float(np.sqrt(2.0))
    reach = radius if least is not None else 0.4  # without a bound, cells whose border is nearer than MARGIN times this
    placed = cut(_placed(stored, fit_cells(stored), reach, query, np.inf if exact else MARGIN), "placed")
    asked = placed.select(*[F.col(c).alias(c) for c in ("metric", "curve_id", "vec", "probes")]).withColumn("cell", F.explode("probes")).drop("probes")
    sizes = (
        placed.groupBy("metric", F.col("home").alias("cell")).agg(F.count("*").alias("n"))
        .join(asked.groupBy("metric", "cell").agg(F.count("*").alias("q")), ["metric", "cell"])
        .select("metric", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("row_blocks"), F.ceil(F.col("q") / BLOCK).cast("int").alias("query_blocks"))
    )
    part = lambda n: F.pmod(F.xxhash64("curve_id", F.lit("block")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = placed.withColumnRenamed("home", "cell").join(sizes, ["metric", "cell"]).select("metric", "cell", part("row_blocks").alias("rb"), every("query_blocks").alias("qb"), "curve_id", "vec")
    queries = asked.join(sizes, ["metric", "cell"]).select("metric", "cell", every("row_blocks").alias("rb"), part("query_blocks").alias("qb"), "curve_id", "vec")
    keys = ["metric", "cell", "rb", "qb"]
    first = radius if exact else radius / 2 if least is not None else 0.1
    threshold = 0 if exact else THRESHOLD

    def both(key: tuple, r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(q):
            return pd.DataFrame({"metric": [], "curve_id": [], "neighbour_id": [], "similarity": []})
        a, b, s = search(r["curve_id"].to_numpy(), _matrix(r["vec"]), q["q_curve_id"].to_numpy(), _matrix(q["q_vec"]), k, radius, first, threshold=threshold)
        return pd.DataFrame({"metric": key[0], "curve_id": a, "neighbour_id": b, "similarity": s})

    queries = queries.select(*[F.col(c).alias("q_" + c) for c in queries.columns])  # cogroup wants columns of its own on either side
    found = rows.groupBy(*keys).cogroup(queries.groupBy(*["q_" + c for c in keys])).applyInPandas(both, "metric string, curve_id bigint, neighbour_id bigint, similarity double")
    return found.where(F.col("similarity") >= least) if least is not None else found


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.98) -> DataFrame:
    """curve_a < curve_b: pairs of which one is among the k most similar of the other, of similarity least or more."""
    near = most_similar(vectors, k, least)
    return near.select(F.least("curve_id", "neighbour_id").alias("curve_a"), F.greatest("curve_id", "neighbour_id").alias("curve_b")).distinct()
