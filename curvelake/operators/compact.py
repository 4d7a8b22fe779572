"""Far too many small files into a few well-sized ones.

Method: cumulative-size grouping. The manifest is frozen and ordered, a window sums its bytes, and every stretch of
target_bytes becomes one group. The planning is SQL only. The running sum is taken in three levels (inside a block of
files, over the blocks of a bucket, over 4,096 buckets), so that no task ever holds the whole manifest, whatever a
single folder's share of it. The groups are then written, read back and reconciled with the manifest file by file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelake.session import shared_path

PLAN = """
WITH files AS (
  SELECT file_id, path, coalesce(n_rows, 0) AS n_rows, coalesce(n_bytes, 0) AS n_bytes,
         coalesce(regexp_replace(path, '/[^/]*$', ''), '') AS folder,
         CAST(conv(substring(md5(coalesce(regexp_replace(path, '/[^/]*$', ''), '')), 1, 3), 16, 10) AS INT) AS bucket, file_id DIV 4096 AS block
  FROM {manifest} WHERE file_id IS NOT NULL
), blocks AS (
  SELECT bucket, folder, block, sum(n_bytes) AS bytes FROM files GROUP BY bucket, folder, block
), buckets AS (
  SELECT bucket, sum(bytes) AS bytes FROM blocks GROUP BY bucket
), starts AS (
  SELECT bucket, coalesce(sum(bytes) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM buckets
), placed AS (
  SELECT b.bucket, b.folder, b.block,
         s.at + coalesce(sum(b.bytes) OVER (PARTITION BY b.bucket ORDER BY b.folder, b.block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at
  FROM blocks b JOIN starts s ON b.bucket = s.bucket
), summed AS (
  SELECT f.*, p.at + coalesce(sum(f.n_bytes) OVER (PARTITION BY f.bucket, f.folder, f.block ORDER BY f.file_id, f.path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_bytes
  FROM files f JOIN placed p ON f.bucket = p.bucket AND f.folder = p.folder AND f.block = p.block
)
SELECT file_id, path, n_rows, n_bytes, offset_bytes, offset_bytes DIV {target} AS group_no FROM summed
"""


def plan_groups(manifest: DataFrame, target_bytes: int = 128 << 20) -> DataFrame:
    """file_id, path, n_rows, n_bytes, offset_bytes, group_no: the group each file of the manifest goes into.

    Files of one folder stay together; the order is (hash of the folder, folder, file_id). A group holds target_bytes and
    at most one file more. Empty files ride along; a null size counts as 0. Rows without file_id are left out.
    """
    return manifest.sparkSession.sql(PLAN.format(manifest="{m}", target=int(target_bytes)), m=manifest)


def record_key() -> list:
    """What makes two records the same: names without outer blanks and letter case, replica, numbers to 6 decimals."""
    number = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.col(c)).otherwise(F.round(F.col(c), 6) + F.lit(0.0)).alias("_" + c)
    name = lambda c: F.lower(F.regexp_replace(F.col(c), r"^[\s ]+|[\s ]+$", "")).alias("_" + c)
    return [name("variant"), name("metric"), F.col("replica").alias("_replica"), number("x"), number("P"), number("F_kJ_mol")]


def mark_repeats(rows: DataFrame, keep: list[str], spread: int = 64) -> DataFrame:
    """file_id, row_no, _kept (a struct of keep) and repeats: whether a row before it (by file_id, then row_no) holds the same record.

    Two rounds, so that a record that is a third of all rows isn't one task: the first row of every (record, slice of
    files), then the first among those. Nulls equal nulls, NaN equals NaN, -0.0 equals 0.0. Records travel as two 64-bit
    hashes of their whole key (128 bits), not as texts. Of two rows with the same file_id and row_no one is kept.
    """
    key = F.struct(*record_key())
    text = F.to_json(key, {"ignoreNullFields": "false"})
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(True).alias("_"))  # packed, so that no name can clash
    hashed = rows.select("file_id", "row_no", kept.alias("_kept"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(7919), F.reverse(text)).alias("_h2"))
    sliced = hashed.withColumn("_slice", F.pmod(F.xxhash64("file_id"), F.lit(spread)).cast("int"))
    order = [F.col("file_id").asc_nulls_first(), F.col("row_no").asc_nulls_first()]
    # A running count, not row_number: a rank limit would go into one of the branches below and both would scan and shuffle the rows.
    running = Window.partitionBy("_h1", "_h2", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumn("_n", F.count(F.lit(1)).over(running))
    across = F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy(*order))
    firsts = local.where("_n = 1").withColumn("repeats", across > 1)
    later = local.where("_n > 1").withColumn("repeats", F.lit(True))
    columns = ["file_id", "row_no", "_kept", "repeats"]
    return firsts.select(*columns).unionByName(later.select(*columns))


def rewrite(manifest: DataFrame, rows: DataFrame, target_bytes: int = 128 << 20) -> DataFrame:
    """Every row of the chunks with group_no, the file it goes to, and repeats, whether it is left out as held before.

    Rows of a file the manifest doesn't list go to group -1, so none is lost. Columns of rows called group_no, repeats or
    part are replaced.
    """
    plan = plan_groups(manifest, target_bytes).groupBy(F.col("file_id").alias("_f")).agg(F.min("group_no").alias("group_no"))
    value = [c for c in rows.columns if c.lower() not in ("file_id", "row_no", "group_no", "repeats", "part")]
    marked = mark_repeats(rows, value)
    joined = marked.join(plan, F.col("file_id") == F.col("_f"), "left")
    return joined.select("file_id", "row_no", *[F.col(f"_kept.`{c}`").alias(c) for c in value], F.coalesce("group_no", F.lit(-1)).alias("group_no"), "repeats")


def write_groups(rewritten: DataFrame, path: str) -> None:
    """The rows as files: repeats=false/part=<group_no> holds one file per group of kept rows, sorted by what they have of
    variant, metric, replica and x; repeats=true/part=0 holds file_id, row_no and group_no of the rows left out.

    A group is written by one task, which its size allows; rows of unlisted files (group -1), of which there is no bound,
    by all tasks, a file each.
    """
    own = ("file_id", "row_no", "group_no", "repeats")
    blank = [F.when(~F.col("repeats"), F.col(f"`{c}`")).alias(c) if c not in own else F.col(c) for c in rewritten.columns]
    salt = F.when(F.col("group_no") < 0, F.xxhash64("file_id", "row_no")).otherwise(F.lit(0))
    order = [c for c in ("variant", "metric", "replica", "x") if c in rewritten.columns]
    parted = rewritten.select(*blank, F.when(F.col("repeats"), F.lit(0)).otherwise(F.col("group_no")).alias("part")).repartition("group_no", salt)
    parted.sortWithinPartitions("repeats", "part", *order).write.partitionBy("repeats", "part").parquet(path)


def read_groups(spark, path: str, like: DataFrame) -> DataFrame:
    """What write_groups wrote of like: its columns, values of repeats null."""
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields]
    return spark.read.schema(", ".join([*columns, "part bigint"])).parquet(path).select(*[f"`{c}`" for c in like.columns])


def consolidate(manifest: DataFrame, rows: DataFrame, target_bytes: int = 128 << 20, path: str | None = None) -> DataFrame:
    """The rewritten rows, read back from the files they were written to: path, or one in the shared folder."""
    spark = rows.sparkSession
    path = path or shared_path(spark, "groups")
    made = rewrite(manifest, rows, target_bytes)
    write_groups(made, path)
    return read_groups(spark, path, made)


def reconcile(manifest: DataFrame, written: DataFrame, target_bytes: int = 128 << 20) -> DataFrame:
    """Per file: file_id, group_no, listed_rows (by the manifest, null where it doesn't list the file), kept_rows, repeated_rows
    (of those read back) and whole, whether both make up what is listed."""
    listed = plan_groups(manifest, target_bytes).groupBy("file_id").agg(F.min("group_no").alias("_g"), F.sum("n_rows").cast("bigint").alias("listed_rows"))
    got = written.groupBy("file_id").agg(F.min("group_no").alias("_w"), F.count(F.when(~F.col("repeats"), 1)).alias("kept_rows"), F.count(F.when(F.col("repeats"), 1)).alias("repeated_rows"))
    both = listed.join(got, "file_id", "full").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("kept_rows", "repeated_rows")})
    whole = F.coalesce(F.col("listed_rows") == F.col("kept_rows") + F.col("repeated_rows"), F.lit(False))
    return both.select("file_id", F.coalesce("_g", "_w").alias("group_no"), "listed_rows", "kept_rows", "repeated_rows", whole.alias("whole"))
