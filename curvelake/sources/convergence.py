"""Convergence tables: discovery by file name, selective scans and options."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelake.functions.names import error_columns
from curvelake.sources import files


def discover(folder: str, source: str = "pooled") -> list[tuple[str, Path]]:
    """(variant, file) by name: top level first, subfolders where it has none; pooled leaves the replica files out."""
    found = files.curve_files(folder, "convergence", deep=True)
    replica = [f for f in found if "replica" in f.name]
    chosen = replica if source == "replica" else [f for f in found if f not in replica]
    return sorted((re.sub(r"_(?:replica_)?convergence.*$", "", f.name), f) for f in chosen)


def scan(spark: SparkSession, folder: str, variants: Sequence[str] | None = None, columns: Sequence[str] | None = None, source: str = "pooled") -> DataFrame | None:
    """Rows of the variants' files with the columns asked for, variant and source; only the files named after them are read."""
    named = [(v, f) for v, f in discover(folder, source) if variants is None or v in variants]
    df = files.read_all(spark, [f for _, f in named], None, "_file")
    if df is None:
        return None
    if "variant" not in df.columns:
        df = df.withColumn("variant", F.regexp_replace("_file", r"_(?:replica_)?convergence.*$", ""))
    if variants is not None:
        df = df.where(F.col("variant").isin(*variants))
    keep = [c for c in df.columns if c != "_file" and (columns is None or c in (*columns, "variant", "metric"))]
    return df.select(*keep, F.lit(source).alias("source"))


def options(df: DataFrame, first: int = 6) -> dict[str, list[str]]:
    """Names to choose from: metrics and variants (sorted), the first variants, and the y columns, error-like ones first."""
    names = lambda c: [r[c] for r in df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).limit(10_000).collect()] if c in df.columns else []
    variants = names("variant")
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in ("replica", "x")]
    return {"metrics": names("metric"), "variants": variants, "default_variants": variants[:first], "y": error_columns(numeric)}
