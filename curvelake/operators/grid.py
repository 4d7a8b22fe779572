"""Irregular readings onto a regular grid.

Method: the readings of a curve are averaged per cell of its metric's grid; cells without a reading are filled by
iterative singular-spectrum imputation (the Hankel matrix of the series is cut to its leading singular vectors, the
missing entries take the values of the cut matrix, and so on until they settle) and are marked. The series of a task are
bucketed by length and rank, and the decompositions of a bucket run as one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 3000  # a safety bound; series that stand unsettled at it are marked
STRETCH = 1.2
REACH = 0.25  # ranges of a series' readings by which a filled value may lie outside them


def in_cells(curves: DataFrame, grid: DataFrame, keep: list[str], outside: bool = False) -> DataFrame:
    """Rows with curve_id and x inside their metric's grid: curve_id, metric, cell and the columns of keep.

    outside: also the rows whose x is null, NaN or outside the grid, with null as their cell.

    Periodic x is brought into [x_start, x_start + 360) first. The quotient only proposes a cell; the comparison with
    the cell's own bounds decides, so rounding can't move a reading.
    """
    g = grid.select("metric", F.col("x_start").alias("_x0"), F.col("x_step").alias("_dx"), F.col("n_cells").alias("_n"), F.col("is_periodic").alias("_turns"))
    rows = curves.where(F.col("curve_id").isNotNull()).select("curve_id", "metric", F.col("x").alias("_x"), *[k for k in keep if k not in ("curve_id", "metric")])
    x = F.when(F.col("_turns"), F.col("_x0") + F.pmod(F.col("_x") - F.col("_x0"), F.lit(360.0))).otherwise(F.col("_x"))
    bound = lambda k: F.col("_x0") + k * F.col("_dx")
    guess = F.floor((F.col("_w") - F.col("_x0")) / F.col("_dx"))
    cell = F.when(F.col("_w") < bound(F.col("_k")), F.col("_k") - 1).when(F.col("_w") >= bound(F.col("_k") + 1), F.col("_k") + 1).otherwise(F.col("_k"))
    known = F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < float("inf"))
    # The filter looks at _w alone: one on the cell would be pushed down with the cell's whole expression in it, again and again.
    inside = (F.col("_w") >= F.col("_x0")) & (F.col("_w") < bound(F.col("_n")))
    placed = rows.join(g, "metric").withColumn("_w", F.when(known, x))
    if not outside:
        placed = placed.where(inside)
    placed = placed.withColumn("_k", guess).withColumn("cell", F.when(inside, cell).cast("int"))
    return placed.select("curve_id", "metric", "cell", *[k for k in keep if k not in ("curve_id", "metric")])


def finite(value: Column) -> Column:
    """value where it is a finite number, else null."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def dense(cells: pa.ListArray, field: str, n_cells: int) -> np.ndarray:
    """Lists of (cell, field) as one matrix, a row per list, NaN where a list lacks a cell or holds null."""
    out = np.full((len(cells), n_cells), np.nan)
    flat = cells.flatten()
    row = np.repeat(np.arange(len(cells)), np.nan_to_num(cells.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
    out[row, flat.field("cell").to_numpy(zero_copy_only=False)] = flat.field(field).to_numpy(zero_copy_only=False)
    return out


def ssa_fill(values: np.ndarray, rank: int = 4, window: int | None = None, rounds: int = ROUNDS, tol: float = 1e-4, fold: int = 256) -> np.ndarray:
    """values (series x cells, NaN where missing) with every missing entry filled by iterative singular-spectrum cuts."""
    return ssa_settle(values, rank, window, rounds, tol, fold)[0]


def ssa_settle(values: np.ndarray, rank: int = 4, window: int | None = None, rounds: int = ROUNDS, tol: float = 1e-4, fold: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """As ssa_fill, and whether each series settled within rounds.

    Start: linear between neighbours, the nearest value at the ends. A series without any value stays NaN; one with
    fewer than three is filled by the start alone. A series stops when its largest change falls under tol of its spread.
    The step over a change grows by STRETCH a round as long as what the cut leaves out doesn't grow, else the round is
    taken back to the plain step. A filled value stays within REACH ranges of the readings around them, as a trend at an end
    would else run away round by round and never settle.
    """
    out = np.array(values, dtype=float)
    n, length = out.shape
    settled = np.ones(n, bool)
    if n == 0 or length == 0:
        return out, settled
    gap = np.isnan(out)
    have = (~gap).sum(1)
    at = np.arange(length)
    left = np.maximum.accumulate(np.where(gap, -1, at), axis=1)
    right = np.minimum.accumulate(np.where(gap, length, at)[:, ::-1], axis=1)[:, ::-1]
    lo, hi = np.where(left < 0, np.minimum(right, length - 1), left), np.where(right >= length, np.maximum(left, 0), right)
    row = np.arange(n)[:, None]
    share = np.where(hi > lo, (at - lo) / np.maximum(hi - lo, 1), 0.0)
    start = out[row, lo] * (1 - share) + out[row, hi] * share
    out = np.where(gap, start, out)
    todo = np.flatnonzero((have >= 3) & gap.any(1))
    if window is None:
        window = max(2, min(12, length // 3))
    if length < 4 or not len(todo):
        return out, settled
    k = length - window + 1
    count = np.convolve(np.ones(window), np.ones(k))
    for first in range(0, len(todo), fold):
        live = todo[first : first + fold]
        spread = np.nanstd(values[live], axis=1) + 1e-12
        low, high = np.nanmin(values[live], axis=1, keepdims=True), np.nanmax(values[live], axis=1, keepdims=True)
        low, high = low - REACH * (high - low), high + REACH * (high - low)
        step, least, plain = np.ones(len(live)), np.full(len(live), np.inf), out[live]
        for _ in range(rounds):
            series = out[live]
            mean = series.mean(1, keepdims=True)
            hankel = np.lib.stride_tricks.sliding_window_view(series - mean, k, axis=1)  # series x window x k
            energy, vectors = np.linalg.eigh(hankel @ hankel.transpose(0, 2, 1))
            lead = vectors[:, :, -min(rank, window) :]
            cutm = lead @ (lead.transpose(0, 2, 1) @ hankel)
            back = np.zeros_like(series)
            for i in range(window):  # means of the anti-diagonals
                back[:, i : i + k] += cutm[:, i, :]
            new = np.where(gap[live], np.clip(back / count + mean, low, high), series)
            rest = energy[:, : -min(rank, window)].sum(1)
            worse = (step > 1) & (rest > least * (1 + 1e-9))
            done = ~worse & (np.abs(new - series).max(1) <= tol * spread)
            step = np.where(worse, 1.0, step * STRETCH)
            far = np.where(done[:, None], new, np.clip(series + step[:, None] * (new - series), low, high))
            out[live] = np.where(worse[:, None], plain, far)
            plain, least = np.where(worse[:, None], plain, new), np.where(worse, least, rest)
            go = ~done
            live, spread, step, least, plain, low, high = live[go], spread[go], step[go], least[go], plain[go], low[go], high[go]
            if not len(live):
                break
        out[live], settled[live] = plain, False
    return out, settled


def regular_grid(curves: DataFrame, grid: DataFrame, values: tuple[str, ...] = ("F_kJ_mol", "P"), rank: int = 4) -> DataFrame:
    """One row per curve and cell of its metric's grid: curve_id, metric, cell, and per value v its v, v_filled and v_settled.

    A cell's value is the mean of its finite readings; other cells are filled and marked true in v_filled. A curve
    without a finite reading keeps nulls, marked true as well. v_settled is false in all rows of a curve whose filled
    values still moved after ROUNDS rounds. Rows without curve_id, or whose x is null, NaN or outside
    the grid, belong to no cell, but their curve and metric still get a grid. Repeated rows count as often as they
    stand. A curve that stands under several metrics gets a grid for each. Empty input: no rows. Groups fold map-side to
    at most n_cells rows, so no curve, however large, is gathered raw.
    """
    here = in_cells(curves, grid, list(values), outside=True).groupBy("metric", "curve_id", "cell").agg(*[F.avg(finite(F.col(v))).alias(v) for v in values])
    every = here.groupBy("metric", "curve_id").agg(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", *values))).alias("cells"))
    sized = every.join(grid.select("metric", "n_cells"), "metric")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_of = batch.column("n_cells").to_numpy()
            for n_cells in np.unique(n_of):
                part = batch.filter(pa.array(n_of == n_cells))
                out = {
                    "metric": part.column("metric").take(np.repeat(np.arange(len(part)), n_cells)),
                    "curve_id": np.repeat(part.column("curve_id").to_numpy(), n_cells),
                    "cell": np.tile(np.arange(n_cells, dtype=np.int32), len(part)),
                }
                for v in values:
                    tall = dense(part.column("cells"), v, int(n_cells))
                    done, settled = ssa_settle(tall, rank)
                    done = done.ravel()
                    out[v] = pa.array(done, mask=np.isnan(done))
                    out[v + "_filled"] = np.isnan(tall).ravel()
                    out[v + "_settled"] = np.repeat(settled, n_cells)
                yield pa.RecordBatch.from_pydict(out)

    schema = "metric string, curve_id bigint, cell int, " + ", ".join(f"{v} double, {v}_filled boolean, {v}_settled boolean" for v in values)
    return sized.mapInArrow(fill, schema).select("curve_id", "metric", "cell", *[c for v in values for c in (v, f"{v}_filled", f"{v}_settled")])
