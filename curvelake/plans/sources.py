"""Sources and names through the tables of a folder: files are written into the shared folder in each format, read back by the
library's readers, and must give what SQL reads from the tables themselves."""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.functions import names as N
from curvelake.operators import tables as T
from curvelake.plans.common import rounded
from curvelake.session import cut, shared_path, spread, table
from curvelake.sources import convergence, files, sqlite, xvg

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark, name: str, *inner: str) -> str:
    """A new local path inside the shared folder, made."""
    root = urlparse(shared_path(spark, name)).path
    path = os.path.join(root, *inner)
    os.makedirs(path)
    return path


def _small(df: DataFrame):
    """Rows for SQLite's own writer, a file only one process can write."""
    return df.toPandas()


_CORE = ["kd_mean", "rg__mean", "seq_len"]
_FEATURES = "SELECT variant, kd_mean, rg__mean, seq_len, NULL::DOUBLE AS extra FROM features WHERE variant IS NOT NULL"


def _feature_folder(spark, d) -> str:
    """A data folder with the features as parquet, CSV and zipped CSV by their first letter, a broken file and one of another table."""
    data = _folder(spark, "layout", "GLOBAL_DATA")
    rows = table(spark, d, "features").select("variant", *_CORE, F.lower(F.substring("variant", 1, 1)).alias("_l")).where("variant IS NOT NULL")
    parts = (("x_features.parquet", "_l < 'f'"), ("features_per_peptide_all.csv", "_l >= 'f' AND _l < 'p'"), ("rest_features.csv.gz", "NOT (_l < 'p')"))
    for name, where in parts:
        part = rows.where(where).drop("_l")
        writer = part.withColumn("extra", F.lit(None).cast("double")) if name.endswith("parquet") else part
        if name.endswith("parquet"):
            writer.write.parquet(os.path.join(data, name))
        else:
            writer.write.option("header", True).option("compression", "gzip" if name.endswith("gz") else "none").csv(os.path.join(data, name))
    with open(os.path.join(data, "broken_features.parquet"), "wb") as out:
        out.write(b"not a table")
    with open(os.path.join(data, "A_pmf.csv"), "w") as out:
        out.write("variant,x\nA,1\n")
    return data


@query(f"""SELECT count(*) AS n, count(DISTINCT variant) AS variants, count(*) FILTER (isfinite(kd_mean)) AS with_kd, round(sum(CASE WHEN isfinite(kd_mean) THEN TRY_CAST(round(kd_mean * 1e6) AS BIGINT) END)::DOUBLE / 1e6, 4) AS kd,
round(sum(CASE WHEN isfinite(rg__mean) THEN TRY_CAST(round(rg__mean * 1e6) AS BIGINT) END)::DOUBLE / 1e6, 4) AS rg, sum(seq_len)::BIGINT AS letters FROM features WHERE variant IS NOT NULL""")
def q_source_features(spark, d):
    """A feature folder of three formats and a broken file, read as one table."""
    data, _ = files.resolve_layout(os.path.dirname(_feature_folder(spark, d)))
    skipped: list = []
    df = files.read_all(spark, files.feature_files(data), skipped=skipped)
    assert [os.path.basename(p) for p in skipped] == ["broken_features.parquet"]
    num = lambda c: F.round(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) * 1e6).cast("bigint")
    df = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in ("kd_mean", "rg__mean")})
    made = df.agg(F.count("*").alias("n"), F.countDistinct("variant").alias("variants"), F.count(num("kd_mean")).alias("with_kd"), (F.sum(num("kd_mean")) / 1e6).alias("kd"), (F.sum(num("rg__mean")) / 1e6).alias("rg"), F.sum(F.col("seq_len").cast("bigint")).alias("letters"))
    return rounded(made, "kd", "rg", places=4)


@query("SELECT variant, count(*) AS n FROM features WHERE variant IS NOT NULL AND seq_len > 20 GROUP BY 1")
def q_source_projection(spark, d):
    """Two columns of the same folder, filtered."""
    df = files.read_all(spark, files.feature_files(_feature_folder(spark, d)), ["variant", "seq_len"])
    return df.where(F.col("seq_len").cast("int") > 20).groupBy("variant").agg(F.count("*").alias("n"))


def _per_variant(df: DataFrame, folder: str, suffix: str) -> None:
    """A table per variant, <variant><suffix>: a folder of one part, as a file whose name begins with _ or . would be hidden.
    A variant's rows meet in one task, which writes them as they come; a task that runs again puts the same part in place."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = out = None

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.where, os.path.join(os.path.dirname(out.where), "part-0.parquet"))

        for batch in batches:
            runs = pc.run_end_encode(batch.column("variant"))
            rows, start = batch.drop_columns(["variant"]), 0
            for end, variant in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if variant != at:
                    close()
                    path = os.path.join(folder, variant + suffix)
                    os.makedirs(path, exist_ok=True)
                    at, out = variant, pq.ParquetWriter(os.path.join(path, f".{uuid.uuid4().hex}"), rows.schema)
                out.write_batch(rows.slice(start, end - start))
                start = end
        close()
        yield from ()

    spread(df, "variant").sortWithinPartitions("variant").mapInArrow(write, "n int").write.format("noop").mode("overwrite").save()


def _curve_folder(spark, d) -> str:
    """The curves of all variants in a store of a table per variant; energies under another name."""
    data = _folder(spark, "curves", "GLOBAL_DATA")
    rows = table(spark, d, "pmf").where("variant IS NOT NULL").select("variant", "metric", "replica", "x", F.col("F_kJ_mol").alias("free_energy"), "P")
    _per_variant(rows, data, "_pmf.parquet")
    return data


@query("SELECT variant, replica, count(*) AS n, count(*) FILTER (isfinite(F_kJ_mol)) AS with_f FROM pmf WHERE variant IS NOT NULL AND metric = 'rg' GROUP BY 1, 2")
def q_source_curves(spark, d):
    """Curves of one metric from a store of a table per variant, columns normalised."""
    df = files.normalise_curves(files.variant_store(spark, _curve_folder(spark, d), metric="rg"))
    return df.groupBy("variant", "replica").agg(F.count("*").alias("n"), F.count(F.when(~F.isnan("F_kJ_mol") & (F.abs("F_kJ_mol") < float("inf")), 1)).alias("with_f"))


@query("SELECT DISTINCT trim(metric) AS metric FROM pmf WHERE variant IS NOT NULL AND trim(metric) <> ''")
def q_source_metrics(spark, d):
    """The metrics of the same files."""
    return files.metrics_in(files.variant_store(spark, _curve_folder(spark, d)))


@query("SELECT column_name AS \"column\", i::INT AS place FROM (VALUES ('variant', 0), ('kd_mean', 1), ('rg__mean', 2), ('seq_len', 3), ('extra', 4)) t(column_name, i)")
def q_source_schema(spark, d):
    """The key and the numeric columns of a parquet file, from its footer."""
    columns = files.numeric_columns(spark, os.path.join(_feature_folder(spark, d), "x_features.parquet"))
    return spark.createDataFrame([(c, i) for i, c in enumerate(columns)], "column string, place int")


def _database(spark, d) -> str:
    """An SQLite file with the catalog, the grid, and the mean and deviation of rg and e2e per variant, long; sequences beside them."""
    path = os.path.join(_folder(spark, "sqlite"), "atlas.db")
    f = table(spark, d, "features").where("variant IS NOT NULL")
    best = f.groupBy("variant").agg(*[F.max(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))).alias(c) for c in ("rg__mean", "rg__std", "e2e__mean")], F.max("seq_len").alias("seq_len"))
    rows = _small(best)
    with sqlite3.connect(path) as con:
        _small(table(spark, d, "attribute_catalog")).to_sql("attribute_catalog", con, index=False)
        _small(table(spark, d, "metric_grid")).to_sql("metric_grid", con, index=False)
        long = [(r.variant, m, getattr(r, f"{m}__mean"), r.rg__std if m == "rg" else None) for r in rows.itertuples() for m in ("rg", "e2e")]
        con.execute("CREATE TABLE summary (variant TEXT, metric TEXT, mean REAL, std REAL)")
        con.executemany("INSERT INTO summary VALUES (?, ?, ?, ?)", [tuple(None if x is None or x != x else x for x in r) for r in long])
        con.execute("CREATE TABLE sequence_features (variant TEXT, seq_len INTEGER)")
        con.executemany("INSERT INTO sequence_features VALUES (?, ?)", [(r.variant, None if r.seq_len != r.seq_len else int(r.seq_len)) for r in rows.itertuples()])
    return path


_BEST = "(SELECT variant, " + ", ".join(f"max(CASE WHEN isfinite({c}) THEN {c} END) AS {c}" for c in ("rg__mean", "rg__std", "e2e__mean")) + ", max(seq_len) AS seq_len FROM features WHERE variant IS NOT NULL GROUP BY 1)"


@query(f"SELECT variant, round(rg__mean, 9) AS rg__mean, round(rg__std, 9) AS rg__std, round(e2e__mean, 9) AS e2e__mean, seq_len::BIGINT AS seq_len FROM {_BEST}")
def q_source_sqlite(spark, d):
    """The feature table of a database without one: its long summary pivoted, sequence descriptors joined."""
    made = sqlite.features(spark, _database(spark, d), ("mean", "std"))
    return rounded(made.select("variant", "rg__mean", "rg__std", "e2e__mean", F.col("seq_len").cast("bigint").alias("seq_len")), "rg__mean", "rg__std", "e2e__mean", places=9)


@query("SELECT metric, round(x_start, 9) AS x_start, n_cells::BIGINT AS n_cells FROM metric_grid WHERE metric IN ('rg', 'e2e', 'phi_res4')")
def q_source_sqlite_pushdown(spark, d):
    """A wide table of a database, the condition pushed down to it."""
    path = _database(spark, d)
    assert "metric_grid" in sqlite.tables(path)
    return rounded(sqlite.read(spark, path, "metric_grid").where("metric IN ('rg', 'e2e', 'phi_res4')").select("metric", "x_start", F.col("n_cells").cast("bigint").alias("n_cells")), "x_start", places=9)


def _series_folder(spark, d) -> str:
    """An .xvg file per user of all readings, with comments before them and a second block behind."""
    folder = _folder(spark, "xvg")
    e = table(spark, d, "events").where("user_id IS NOT NULL AND value IS NOT NULL")
    lines = e.select("user_id", F.lit(1).alias("k"), F.col("event_id").alias("i"), F.concat_ws(" ", F.col("event_id").cast("string"), F.col("value").cast("double").cast("string")).alias("value"))
    rest = [(0, 0, "# c"), (0, 1, '@ title "t"'), (2, 0, "&"), (2, 1, "0 99.0")]
    around = e.select("user_id").distinct().select("user_id", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).cast("bigint").alias("i"), F.lit(v).alias("value")) for k, i, v in rest])))
    every = lines.unionByName(around.withColumn("i", F.col("i").cast(lines.schema["i"].dataType)))
    every.repartition("user_id").sortWithinPartitions("user_id", "k", "i").select("user_id", "value").write.partitionBy("user_id").text(os.path.join(folder, "_parts"))
    for name in os.listdir(os.path.join(folder, "_parts")):
        if name.startswith("user_id="):
            (part,) = [f for f in os.listdir(os.path.join(folder, "_parts", name)) if f.startswith("part-")]
            os.makedirs(os.path.join(folder, f"USER{name[8:]}"))
            os.rename(os.path.join(folder, "_parts", name, part), os.path.join(folder, f"USER{name[8:]}", "rg_1.xvg"))
    shutil.rmtree(os.path.join(folder, "_parts"))
    return folder


@query("SELECT 'USER' || user_id AS variant, event_id::DOUBLE AS time, value::DOUBLE AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL) WHERE (i - 1) % 2 = 0")
def q_source_series(spark, d):
    """Every second reading of the first block of each series file."""
    return xvg.read_series(xvg.index(spark, _series_folder(spark, d)), 2).select("variant", "time", "value")


@query("SELECT 'USER' || user_id AS variant, count(*) AS n FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1")
def q_source_series_index(spark, d):
    """The other flavour of the index, counted."""
    return xvg.read_series(xvg.index(spark, _series_folder(spark, d), by_tokens=False)).groupBy("variant").agg(F.count("*").alias("n"))


@query("SELECT r + 1 AS residue, a::DOUBLE AS angle, sum(h)::DOUBLE AS h FROM (SELECT o_orderkey % 2 AS rep, o_orderkey % 3 AS r, o_orderkey % 12 AS a, count(*) AS h FROM orders GROUP BY 1, 2, 3), LATERAL (SELECT 1) GROUP BY 1, 2")
def q_source_histograms(spark, d):
    """Histogram files of two replicas with a column per residue, pooled."""
    folder = _folder(spark, "hist", "VARIANTA")
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").groupBy((k % 2).alias("rep"), (k % 3).alias("r"), (k % 12).alias("a")).count().collect()  # at most 72 rows
    got = {(r["rep"], r["a"], r["r"]): r["count"] for r in rows}
    for rep in (0, 1):
        with open(os.path.join(folder, f"hist_{rep + 1}.xvg"), "w") as out:
            out.writelines(f"{a} " + " ".join(str(got.get((rep, a, r), 0)) for r in range(3)) + "\n" for a in range(12))
    pooled = xvg.pool_histograms(xvg.read_histograms(xvg.index(spark, os.path.dirname(folder))))
    return pooled.where("h > 0").select(F.col("residue").cast("bigint").alias("residue"), "angle", "h")


@query("SELECT variant, metric, x, RMSE_F, 'pooled' AS source FROM (SELECT variant, metric, min(x) AS x, round(avg(CASE WHEN abs(F_kJ_mol) < 1e6 THEN round(F_kJ_mol * 1e6)::BIGINT END) / 1e6, 6) AS RMSE_F FROM pmf WHERE variant IS NOT NULL AND isfinite(x) GROUP BY 1, 2)")
def q_source_convergence(spark, d):
    """Convergence tables of all variants, found by name beside replica tables and read."""
    folder = _folder(spark, "convergence")
    rows = table(spark, d, "pmf").where("variant IS NOT NULL AND x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')")
    f = F.when(F.abs("F_kJ_mol") < 1e6, F.round(F.col("F_kJ_mol") * 1e6).cast("bigint"))
    made = cut(rounded(rows.groupBy("variant", "metric").agg(F.min("x").alias("x"), (F.avg(f) / 1e6).alias("RMSE_F")), "RMSE_F"), "convergence")
    _per_variant(made, folder, "_convergence.parquet")
    _per_variant(made.where("metric = 'rg'"), folder, "_replica_convergence.parquet")
    return convergence.scan(spark, folder, columns=["x", "RMSE_F"]).select("variant", "metric", "x", "RMSE_F", "source")


@query("SELECT unnest(['RMSE_F', 'x_other']) AS name, unnest([0, 1])::INT AS place")
def q_source_convergence_options(spark, d):
    """The y columns to choose from, error-like ones first."""
    df = spark.createDataFrame([("rg", "A", 1.0, 2.0, 0.5)], "metric string, variant string, x double, x_other double, RMSE_F double")
    return spark.createDataFrame([(c, i) for i, c in enumerate(convergence.options(df)["y"])], "name string, place int")


@query("SELECT variant, count(*) AS n FROM features WHERE variant IS NOT NULL GROUP BY 1")
def q_source_cache(spark, d):
    """A table kept by its parameters and taken from there, whatever their order."""
    cache = files.Cache(_folder(spark, "cache"))
    made = table(spark, d, "features").where("variant IS NOT NULL").groupBy("variant").agg(F.count("*").alias("n"))
    cache.put(made, {"table": "features", "by": {"variant", "metric"}})
    return cache.get(spark, {"by": {"metric", "variant"}, "table": "features"})


@query("SELECT count(*) FILTER (dataset_index % 5 <> 0)::BIGINT AS residues, count(*) FILTER (dataset_index % 7 = 0)::BIGINT AS pooled FROM (SELECT o_orderkey AS dataset_index FROM orders)")
def q_source_rama(spark, d):
    """Pooled rows without a residue, per-residue rows with a number."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    pooled, per = files.normalise_rama(o.select(F.when(k % 7 != 0, k).alias("residue")), o.select(F.when(k % 5 != 0, k.cast("string")).otherwise(F.lit("x")).alias("dataset_index")))
    return per.agg(F.count("residue").alias("residues")).crossJoin(pooled.agg(F.count("*").alias("pooled")))  # one row each


# Names: fixed lists of the names that are asked, and of what the rules say of them.
_NAMES = ["variant", "rg__mean", "rg__std", "sasa__iqr", "rg__effective_support_frac", "phi_res4__circular_mean_deg", "seq_len", "kd_mean", "rmsd__skew", "row_id", "metric|x=3", "e2e__mean"]


@query("SELECT name, CASE WHEN strpos(name, '|') > 0 THEN split_part(name, '|', 1) WHEN strpos(name, '__') > 0 THEN split_part(name, '__', 1) ELSE 'misc' END AS family FROM (SELECT unnest(" + repr(_NAMES) + ") AS name)")
def q_name_family(spark, d):
    """The family of a column's name."""
    return spark.createDataFrame([(n, N.family(n)) for n in _NAMES], "name string, family string")


@query("""SELECT names, chosen FROM (VALUES ('Replica,x', 'Replica'), ('x,rep', 'rep'), ('x,replica_no_7', 'replica_no_7'), ('x,y', NULL)) t(names, chosen)""")
def q_name_replica(spark, d):
    """the column that holds the replica."""
    lists = ["Replica,x", "x,rep", "x,replica_no_7", "x,y"]
    return spark.createDataFrame([(n, N.replica_column(n.split(","))) for n in lists], "names string, chosen string")


@query("""WITH v AS (SELECT DISTINCT variant FROM features WHERE variant IS NOT NULL), s AS (SELECT variant, row_number() OVER (ORDER BY variant) AS i FROM v), a AS (SELECT variant FROM s WHERE i <= 6), b AS (SELECT variant FROM s WHERE i BETWEEN 4 AND 9)
SELECT 'set' AS how, variant FROM b UNION ALL SELECT 'add', variant FROM (SELECT variant FROM a UNION SELECT variant FROM b) UNION ALL SELECT 'remove', variant FROM (SELECT variant FROM a EXCEPT SELECT variant FROM b)
UNION ALL SELECT 'toggle', variant FROM ((SELECT variant FROM a EXCEPT SELECT variant FROM b) UNION (SELECT variant FROM b EXCEPT SELECT variant FROM a)) UNION ALL SELECT 'invert', variant FROM (SELECT variant FROM v EXCEPT SELECT variant FROM a)""")
def q_selection(spark, d):
    """The algebra of selections over all variants."""
    every = [r[0] for r in table(spark, d, "features").where("variant IS NOT NULL").select("variant").distinct().orderBy("variant").collect()]  # a view's choices
    a, b = every[:6], every[3:9]
    return spark.createDataFrame([(h, v) for h in ("set", "add", "remove", "toggle", "invert") for v in T.change_selection(a, b, h, every)], "how string, variant string")
