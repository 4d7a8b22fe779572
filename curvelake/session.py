"""Sessions and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", name: str = "curvelake") -> SparkSession:
    """A session on one machine, for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(os.cpu_count() if cores == "*" else cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where that is unset, a session on one machine
    gets a local one; any other is refused, as its executors wouldn't see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext.getCheckpointDir()
        if not got:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="curvelake-"))
            got = spark.sparkContext.getCheckpointDir()
        found = got
    return found


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except (AttributeError, OSError, Py4JError):  # the session has ended; the folder's owner clears it
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's name inside the shared folder; drop_cuts removes it, at the latest at the end of the process."""
    path = os.path.join(shared_dir(spark), f"curvelake-{name}-{uuid.uuid4().hex}")
    if not _made:
        atexit.register(drop_cuts, spark)
    _made.append(path)
    return path


def drop_cuts(spark: SparkSession) -> None:
    """Removes all that cut wrote so far; call it when the results that stand on it are written."""
    while _made:
        _drop(spark, _made.pop())


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, written as a table into the shared folder and read again: its lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def room(spark: SparkSession) -> int:
    """As many tasks as there is room for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many tasks as there is room for, by keys if there are any: for small rows that cost much work each, which
    the adaptive planner would gather into one task for their few bytes."""
    return df.repartition(room(df.sparkSession), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables that lie side by side in a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
