"""Discovery and reading of parquet and CSV tables, and their writing."""

from __future__ import annotations

import hashlib
import json
import logging
import os
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelake.session import room, spread

# Names of feature files in order of preference, and of the tables of curves.
FEATURE_FILES = (
    "*_features.parquet", "*_features.csv.gz", "features_per_peptide_all.parquet", "features_per_peptide_all.csv.gz", "features_per_peptide_all.csv",
    "features_per_peptide.parquet", "features_per_peptide.csv.gz", "features_per_peptide.csv",
)
CURVE_FILES = {
    "pmf": ("*_pmf.parquet", "*_pmf.csv*"), "cumulative": ("*_cumulative.parquet", "*_cumulative.csv*"), "rmsf": ("*_rmsf.parquet", "*_replica.parquet", "*_rmsf.csv*"),
    "convergence": ("*_convergence.parquet", "*_convergence.csv*"), "rama2d": ("*_rama2d.parquet", "*_rama2d.csv*"), "summary": ("*_summary.parquet", "*_summary.csv*"),
}

# Up to so many tables Spark looks at each itself; the footers of more are read in one job.
FEW = 32


def resolve_layout(path: str | os.PathLike) -> tuple[Path, Path]:
    """(data folder, project folder): the path may be the data folder itself, its parent, or any folder."""
    p = Path(path).resolve()
    if p.name == "GLOBAL_DATA":
        return p, p.parent
    inner = p / "GLOBAL_DATA"
    return (inner, p) if inner.is_dir() else (p, p)


def find_files(folder: str | os.PathLike, patterns: Iterable[str]) -> list[Path]:
    """Files by pattern, in the patterns' order and then by name, each once."""
    return list(dict.fromkeys(f.resolve() for p in patterns for f in sorted(Path(folder).glob(p))))


def feature_files(folder: str | os.PathLike, most: int | None = None) -> list[Path]:
    """Feature files; where there is a file with all tables in one, the core file would repeat its rows and is left out."""
    found = find_files(folder, FEATURE_FILES)
    if any("_all." in f.name for f in found):
        found = [f for f in found if not f.name.startswith("features_per_peptide.")]
    return found[:most]


def curve_files(folder: str | os.PathLike, key: str, deep: bool = False) -> list[Path]:
    """Files of a curve table; rmsf leaves out the replica files of the others. deep: in subfolders, where the folder has none."""
    found = find_files(folder, CURVE_FILES[key])
    if not found and deep:
        found = find_files(folder, [f"**/{p}" for p in CURVE_FILES[key]])
    if key == "rmsf":
        found = [f for f in found if not any(w in f.name for w in ("pmf", "cumulative", "convergence"))]
    return found


def read(spark: SparkSession, path: str | os.PathLike, columns: Sequence[str] | None = None, skipped: list | None = None) -> DataFrame | None:
    """A table by its suffix, with the given columns it has; None where it can't be read or is empty. A file that can't be
    read is logged, and appended to skipped.

    CSV types are taken from a bounded sample of lines and kept as text where the sample disagrees.
    """
    text = str(path)
    try:
        if text.endswith(".parquet"):
            df = spark.read.parquet(text)
        elif ".csv" in text:
            df = spark.read.csv(text, header=True, inferSchema=True, samplingRatio=0.1 if os.path.getsize(text) > 64 << 20 else 1.0)
        else:
            return None
        if columns is not None:
            df = df.select(*[f"`{c}`" for c in df.columns if c in set(columns)])
        return df if df.columns and not df.isEmpty() else None
    except Exception as x:  # unreadable files are passed over, as one bad file must not stop a scan of thousands
        _skip(text, x, skipped)
        return None


def _skip(path: str, why: Exception, skipped: list | None) -> None:
    logging.getLogger(__name__).warning("%s can't be read and is left out: %s", path, str(why).split("\n")[0][:200])
    if skipped is not None:
        skipped.append(path)


def read_all(spark: SparkSession, paths: Sequence[str | os.PathLike], columns: Sequence[str] | None = None, tag: str | None = None, skipped: list | None = None) -> DataFrame | None:
    """All readable files by column name; parquet files of one schema are one scan. tag: a column with the file's name. Files
    that can't be read are logged, and appended to skipped."""
    groups: dict[str, list[str]] = {}
    found = [p for p in map(str, paths) if p.endswith(".parquet")]
    footers, known = footer_keys(spark, found) if len(found) > FEW else {}, {}
    for p in map(str, paths):
        if p.endswith(".parquet"):
            key = footers.get(p)
            try:
                schema = known.get(key) or schema_of(spark, p).json()
            except Exception as x:
                _skip(p, x, skipped)
                continue
            if key is not None:
                known[key] = schema
            groups.setdefault(schema, []).append(p)
        else:
            groups.setdefault(p, []).append(p)
    frames = []
    for files in groups.values():
        df = _scan(spark, files) if files[0].endswith(".parquet") else read(spark, files[0], None, skipped)
        if df is None:
            continue
        keep = [c for c in df.columns if columns is None or c in set(columns)]
        extra = [_file_name().alias(tag)] if tag else []
        frames.append(df.select(*[f"`{c}`" for c in keep], *extra))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def _footer_key(path: str) -> str | None:
    """What Spark's schema of a parquet table hangs on, hashed: the footer's schema and Spark's own note of it. None where Spark
    has to look itself: at what can't be read, and at folders with folders or summary files in them."""
    try:
        if os.path.isdir(path):
            inner = sorted((f for f in os.scandir(path) if not f.name.startswith(".")), key=lambda f: f.name)
            if any(f.is_dir() or f.name in ("_metadata", "_common_metadata") for f in inner):
                return None
            path = next(f.path for f in inner if not f.name.startswith("_"))
        footer = pq.read_metadata(path)
        schema = str(footer.schema).split("\n", 1)[1]  # the first line is the object's address
        return hashlib.sha256(f"{schema}{(footer.metadata or {}).get(b'org.apache.spark.sql.parquet.row.metadata')}".encode()).hexdigest()[:32]
    except Exception:  # whatever is wrong with it, Spark names it
        return None


def footer_keys(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """path: key; parquet tables of one key have one schema. All footers are read in one job, where the tasks run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"i": batch.column("i"), "key": pa.array([_footer_key(p) for p in batch.column("path").to_pylist()], pa.string())})

    asked = spread(spark.createDataFrame(pa.table({"i": pa.array(range(len(paths)), pa.int32()), "path": pa.array(paths, pa.string())})))
    found = asked.mapInArrow(run, "i int, key string").where("key IS NOT NULL").toArrow()  # a short row per file
    return {paths[i]: key for i, key in zip(found["i"].to_pylist(), found["key"].to_pylist())}


def _file_name() -> Column:
    """The name of the table a row is from, which may be a folder of parts; without patterns, which cost more than the reading."""
    path = F.input_file_name()
    last, above = F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    parts = last.startswith("part-") & (above.endswith(".parquet") | above.endswith(".csv") | above.endswith(".csv.gz"))
    name = F.when(parts, above).otherwise(last)
    return F.when(F.contains(name, F.lit("%")), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)


def _scan(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet tables of one schema as one scan; they are listed by as many tasks as there is room for, not by one task each."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), room(spark))))
    try:
        return spark.read.parquet(*paths)
    finally:
        spark.conf.set(name, before)


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    """The schema of a parquet file, from its footer."""
    return spark.read.parquet(path).schema


def numeric_columns(spark: SparkSession, path: str, most: int = 512) -> list[str]:
    """variant first, then the numeric columns, at most `most`."""
    fields = [f.name for f in schema_of(spark, path).fields if isinstance(f.dataType, T.NumericType)]
    return ["variant", *[f for f in fields if f != "variant"]][:most]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without columns that hold no value at all."""
    if not df.columns:
        return df
    full = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[f"`{c}`" for c in df.columns if full[c]])


def variant_store(spark: SparkSession, folder: str, variants: Sequence[str] | None = None, metric: str | None = None, columns: Sequence[str] | None = None) -> DataFrame | None:
    """Curves of files <variant>_pmf.parquet: only the files of the variants, only the columns, the metric pushed down."""
    names = [f"{v}_pmf.parquet" for v in variants] if variants is not None else ["*_pmf.parquet"]
    files = [f for n in names for f in (find_files(folder, [n]) if "*" in n else [Path(folder, n)] if Path(folder, n).is_file() else [])]
    df = read_all(spark, files, None, "_file")
    if df is None:
        return None
    if "variant" not in df.columns:
        df = df.withColumn("variant", F.expr("left(_file, length(_file) - length('_pmf.parquet'))"))
    if metric is not None and "metric" in df.columns:
        df = df.where(F.col("metric") == metric)
    return df.select(*[c for c in df.columns if c != "_file" and (columns is None or c in (*columns, "variant"))])


def metrics_in(df: DataFrame) -> DataFrame:
    """metric: distinct, not blank, sorted by lower case."""
    return df.select(F.trim("metric").alias("metric")).where("metric <> ''").distinct().orderBy(F.lower("metric"), "metric")


def normalise_curves(df: DataFrame) -> DataFrame:
    """df with F_kJ_mol and P taken from the first of their other names, as double; unreadable values null."""
    from curvelake.functions.names import F_NAMES, P_NAMES, first_name

    for target, names in (("F_kJ_mol", F_NAMES), ("P", P_NAMES)):
        found = first_name(df.columns, names)
        if found:
            df = df.withColumn(target, F.col(f"`{found}`").cast("string").try_cast("double"))
            if found != target and found.lower() != target.lower():
                df = df.drop(found)
    return df


def normalise_rama(pooled: DataFrame, residues: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Pooled rows without a residue, and per-residue rows with dataset_index renamed and as number."""
    if "residue" in pooled.columns:
        pooled = pooled.where("residue IS NULL")
    if residues is not None and "dataset_index" in residues.columns and "residue" not in residues.columns:
        residues = residues.withColumnRenamed("dataset_index", "residue")
    if residues is not None and "residue" in residues.columns:
        residues = residues.withColumn("residue", F.col("residue").cast("string").try_cast("double").cast("int"))
    return pooled, residues


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers."""
    df.write.mode("overwrite").option("header", True).csv(path)


class Cache:
    """Tables kept by the exact parameters that made them: parquet beside a JSON of the parameters."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    @staticmethod
    def key(parameters: dict) -> str:
        return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=sorted).encode()).hexdigest()[:16]

    @staticmethod
    def fingerprint(df: DataFrame) -> str:
        """Of columns, rows and contents, whatever their order: a sum of row hashes, one pass."""
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("h")).first() if df.columns else {"n": 0, "h": 0}
        return hashlib.sha256(f"{df.dtypes}{row['n']}{row['h']}".encode()).hexdigest()[:16]

    def get(self, spark: SparkSession, parameters: dict) -> DataFrame | None:
        path = os.path.join(self.folder, self.key(parameters))
        try:
            return spark.read.parquet(path)
        except Exception:
            return None

    def put(self, df: DataFrame, parameters: dict) -> DataFrame:
        path = os.path.join(self.folder, self.key(parameters))
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return df.sparkSession.read.parquet(path)
