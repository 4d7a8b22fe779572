"""XVG series: indexes of files, and readers of time series and of multi-column histograms."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.functions.names import parse_series_name, parse_series_tokens


def is_multi(path: str | Path) -> bool:
    """Whether a line of the first 200 starts with &."""
    try:
        with open(path, "rb") as lines:
            return any(line.startswith(b"&") for line, _ in zip(lines, range(200)))
    except OSError:
        return False


def index(spark: SparkSession, folder: str, by_tokens: bool = True) -> DataFrame:
    """variant, metric, replica, path, kind of every .xvg file below a folder; the file's own folder is the variant's."""
    parse = parse_series_tokens if by_tokens else parse_series_name
    rows = []
    for p in sorted(Path(folder).rglob("*.xvg")):
        variant, metric, replica = parse(p.stem, p.parent.name if p.parent != Path(folder) else None)
        rows.append((variant, metric, replica, str(p), "multi" if by_tokens and is_multi(p) else "single"))
    return spark.createDataFrame(rows, "variant string, metric string, replica int, path string, kind string")


def _lines(path: str) -> Iterator[bytes]:
    with open(path, "rb") as lines:
        yield from lines


def parse_series(lines: Iterator[bytes], stride: int = 1) -> Iterator[tuple[int, float, float]]:
    """(block, time, value): every stride-th data line of each block, whether it can be read or not, if it can."""
    block = seen = 0
    for raw in lines:
        if raw[:1] in b"@#" and raw[:1]:
            continue
        if raw[:1] == b"&":
            block, seen = block + 1, 0
            continue
        parts = raw.split()
        if not parts:
            continue
        due, seen = seen % max(stride, 1) == 0, seen + 1
        if due and len(parts) > 1:
            try:
                yield block, float(parts[0]), float(parts[1])
            except ValueError:
                continue


def read_series(files: DataFrame, stride: int = 1, first_block: bool = True) -> DataFrame:
    """variant, metric, replica, path, block, i, time, value of an index's files, read where the tasks run, line by line.

    Unreadable files have no rows.
    """
    keys = ["variant", "metric", "replica", "path"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    found = list(parse_series(_lines(row.path), stride))
                except OSError:
                    continue
                out = pd.DataFrame(found, columns=["block", "time", "value"])
                if first_block:
                    out = out[out["block"] == 0]
                out["i"] = out.groupby("block").cumcount()
                yield out.assign(variant=row.variant, metric=row.metric, replica=row.replica, path=row.path)

    schema = "block int, time double, value double, i int, variant string, metric string, replica int, path string"
    return files.select(*keys).repartition("path").mapInPandas(run, schema)


def read_histograms(files: DataFrame) -> DataFrame:
    """variant, replica, residue (from 1), i, angle, h of files with rows 'angle h1 .. hN'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows = []
                try:
                    for raw in _lines(row.path):
                        if raw[:1] in (b"@", b"#", b"&"):
                            continue
                        try:
                            rows.append([float(x) for x in raw.split()])
                        except ValueError:
                            continue
                except OSError:
                    continue
                out = [(row.variant, row.replica, k, i, r[0], r[k]) for i, r in enumerate(x for x in rows if len(x) > 1) for k in range(1, len(r))]
                yield pd.DataFrame(out, columns=["variant", "replica", "residue", "i", "angle", "h"])

    return files.select("variant", "replica", "path").repartition("path").mapInPandas(run, "variant string, replica int, residue int, i int, angle double, h double")


def pool_histograms(rows: DataFrame) -> DataFrame:
    """variant, residue, i, angle, h: sums over replicas; replicas with another number of bins than the first are left out."""
    size = rows.groupBy("variant", "replica").agg(F.countDistinct("i").alias("_n"))
    first = size.groupBy("variant").agg(F.min_by("_n", "replica").alias("_first"))
    fit = size.join(first, "variant").where("_n = _first").select("variant", "replica")
    return rows.join(fit, ["variant", "replica"]).groupBy("variant", "residue", "i").agg(F.min("angle").alias("angle"), F.sum("h").alias("h"))
