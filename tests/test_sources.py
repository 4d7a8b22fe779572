import os
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvelake.plans.sources import _per_variant
from curvelake.sources import files, sqlite, xvg
from curvelake.streaming import windows


@pytest.fixture
def folder(spark, tmp_path):
    data = tmp_path / "GLOBAL_DATA"
    data.mkdir()
    spark.createDataFrame([("A", 1.0, 2)], "variant string, rg double, n int").toPandas().to_parquet(data / "x_features.parquet")
    spark.createDataFrame([("B", 3.0)], "variant string, e2e double").toPandas().to_parquet(data / "features_per_peptide_all.parquet")
    spark.createDataFrame([("B", 3.0)], "variant string, e2e double").toPandas().to_parquet(data / "features_per_peptide.parquet")
    (data / "extra_features.csv.gz").write_bytes(b"not a gzip")
    for v, alias in (("A", "F"), ("B", "free_energy")):
        spark.createDataFrame([("rg", 0.1, "1.5"), ("e2e", 0.2, "bad")], f"metric string, x double, {alias} string").toPandas().to_parquet(data / f"{v}_pmf.parquet")
    return data


def test_discovery_and_union(spark, folder):
    assert files.resolve_layout(folder.parent) == (folder, folder.parent) and files.resolve_layout(folder) == (folder, folder.parent)
    found = files.feature_files(folder)
    assert [f.name for f in found] == ["x_features.parquet", "extra_features.csv.gz", "features_per_peptide_all.parquet"]
    assert files.feature_files(folder, 1) == found[:1]
    rows = {r["variant"]: r for r in files.read_all(spark, found).collect()}
    assert rows["A"]["rg"] == 1.0 and rows["A"]["e2e"] is None and rows["B"]["e2e"] == 3.0
    assert files.read_all(spark, found, ["variant"]).columns == ["variant"] and files.read_all(spark, []) is None
    assert files.read(spark, folder / "none.parquet") is None and files.read(spark, folder / "extra_features.csv.gz") is None
    assert files.numeric_columns(spark, str(found[0])) == ["variant", "rg", "n"]


def test_variant_store_reads_only_what_is_asked(spark, folder):
    df = files.variant_store(spark, folder, ["A", "Z"], "rg")
    assert [(r["variant"], r["x"]) for r in df.collect()] == [("A", 0.1)]
    assert files.variant_store(spark, folder, ["Z"]) is None
    clean = files.normalise_curves(files.variant_store(spark, folder, ["B"]))
    assert sorted((r["x"], r["F_kJ_mol"]) for r in clean.collect()) == [(0.1, 1.5), (0.2, None)]
    assert [r["metric"] for r in files.metrics_in(df.unionByName(df.withColumn("metric", F.lit(" ")))).collect()] == ["rg"]


def test_a_large_store_is_opened_in_a_few_jobs(spark, tmp_path):
    names = [f"V{i}" for i in range(60)] + ["_under", ".dot", "a b", "a+b", "50%", "é"]
    made = spark.createDataFrame([(v, m, float(i)) for i, v in enumerate(names) for m in ("rg", "e2e")], "variant string, metric string, F double")
    _per_variant(made, str(tmp_path), "_pmf.parquet")
    assert sorted(f.name for f in tmp_path.iterdir()) == sorted(f"{v}_pmf.parquet" for v in names)
    (tmp_path / "wide_pmf.parquet").mkdir()
    pd.DataFrame({"metric": ["rg"], "F": [0.5], "more": [1]}).to_parquet(tmp_path / "wide_pmf.parquet" / "part-0.parquet")
    pd.DataFrame({"metric": ["rg"], "F": [0.7]}).to_parquet(tmp_path / "plain_pmf.parquet")
    (tmp_path / "bad_pmf.parquet").write_bytes(b"not a table")
    skipped, at = [], "open of a large store"
    spark.sparkContext.setJobGroup(at, at)
    try:
        files.read_all(spark, files.find_files(tmp_path, ["*_pmf.parquet"]), skipped=skipped)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(at)) < 20  # it was one a table, or more
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [os.path.basename(p) for p in skipped] == ["bad_pmf.parquet"]
    rows = {r["variant"]: (r["F"], r["more"]) for r in files.variant_store(spark, str(tmp_path), metric="rg").collect()}
    assert rows == {v: (float(i), None) for i, v in enumerate(names)} | {"wide": (0.5, 1), "plain": (0.7, None)}


def test_csv_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    files.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True).count() == 2
    cache = files.Cache(str(tmp_path / "cache"))
    key = {"variants": {"b", "a"}, "n": 1}
    assert cache.get(spark, key) is None and cache.put(df, key).count() == 2 and cache.get(spark, {"n": 1, "variants": {"a", "b"}}).count() == 2
    assert files.Cache.fingerprint(df) == files.Cache.fingerprint(df.orderBy(F.desc("k"))) != files.Cache.fingerprint(df.limit(1))
    assert files.drop_empty_columns(df.withColumn("w", F.lit(None).cast("int"))).columns == ["k", "v"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE summary (variant TEXT, metric TEXT, mean REAL, "odd ""name" INTEGER)')
        con.executemany("INSERT INTO summary VALUES (?, ?, ?, ?)", [(f"v{i % 50}", "rg" if i < 50 else "e2e", i / 2, "x" if i == 3 else i) for i in range(100)])
        con.execute("CREATE TABLE empty (variant TEXT)")
        con.execute("CREATE TABLE sequence_features (variant TEXT, seq_len INTEGER)")
        con.execute("INSERT INTO sequence_features VALUES ('v1', 7)")
    df = sqlite.read(spark, path, "summary", 4)
    assert df.count() == 100 and df.rdd.getNumPartitions() == 4
    assert df.where("metric = 'rg' AND variant IN ('v1', 'v2')").agg(F.sum("mean")).first()[0] == 1.5
    assert df.where("`odd \"name` IS NULL").count() == 1
    assert sqlite.read(spark, path, "none") is None and sqlite.first_table(spark, path, ("empty", "summary")).count() == 100
    wide = {r["variant"]: r for r in sqlite.features(spark, path).collect()}
    assert wide["v1"]["rg__mean"] == 0.5 and wide["v1"]["e2e__mean"] == 25.5 and wide["v1"]["seq_len"] == 7 and wide["v2"]["seq_len"] is None


def test_xvg(spark, tmp_path):
    folder = tmp_path / "VARIANTA"
    folder.mkdir()
    (folder / "rg_1.xvg").write_text('@ title "t"\n# c\n0 1.0\n1 x\n\n2 3.0\n3 4.0\n&\n0 9.0\n')
    (folder / "rg_2.xvg").write_text("0 2.0\n")
    index = xvg.index(spark, str(tmp_path))
    assert sorted((r["variant"], r["metric"], r["replica"], r["kind"]) for r in index.collect()) == [("VARIANTA", "rg", 1, "multi"), ("VARIANTA", "rg", 2, "single")]
    rows = sorted((r["replica"], r["time"], r["value"]) for r in xvg.read_series(index).collect())
    assert rows == [(1, 0.0, 1.0), (1, 2.0, 3.0), (1, 3.0, 4.0), (2, 0.0, 2.0)]
    assert sorted((r["block"], r["time"]) for r in xvg.read_series(index.where("replica = 1"), 2, False).collect()) == [(0, 0.0), (0, 2.0), (1, 0.0)]
    for rep, n in ((1, 3), (2, 3), (3, 2)):
        (folder / f"hist_{rep}.xvg").write_text("".join(f"{a} {a + rep} 1\n" for a in range(n)))
    pooled = xvg.pool_histograms(xvg.read_histograms(xvg.index(spark, str(tmp_path)).where("metric = 'hist'")))
    assert sorted((r["residue"], r["angle"], r["h"]) for r in pooled.collect()) == [(1, 0.0, 3.0), (1, 1.0, 5.0), (1, 2.0, 7.0), (2, 0.0, 2.0), (2, 1.0, 2.0), (2, 2.0, 2.0)]


def test_rama_tables(spark):
    pooled = spark.createDataFrame([(None, 1.0), (3, 2.0)], "residue int, z double")
    per = spark.createDataFrame([("3", 1.0), ("x", 2.0)], "dataset_index string, z double")
    a, b = files.normalise_rama(pooled, per)
    assert a.count() == 1 and sorted(r["residue"] or 0 for r in b.collect()) == [0, 3]


def test_streaming_windows(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    rows = [(i, f"2025-01-01 00:{i:02d}:00", "a", float(i)) for i in range(0, 50, 5)] + [(0, "2025-01-01 00:00:00", "a", 0.0)]
    df = spark.createDataFrame(rows, "id int, at string, kind string, value double").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    once = windows.once(stream, "at", "1 minute", ["id"])
    made = once.groupBy(F.window("at", "10 minutes"), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
    q = made.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["n"] for r in spark.read.parquet(str(out)).collect()} == {2}
    for made in (windows.tumbling(stream, "at", "1 minute", "10 minutes", ["kind"], "value"), windows.sessions(stream, "at", "1 minute", "3 minutes", ["kind"]), windows.cell_counts(stream.withColumn("x", F.col("value")).withColumn("metric", F.col("kind")), "at", "1 minute", "10 minutes", 0.0, 1.0)):
        assert made.isStreaming


def test_convergence_tables(spark, tmp_path):
    from curvelake.sources import convergence

    for name in ("A_convergence", "B_convergence", "A_replica_convergence"):
        spark.createDataFrame([("JS", 1.0, 0.5)], "metric string, x double, RMSE_F double").toPandas().to_parquet(tmp_path / f"{name}.parquet")
    assert [v for v, _ in convergence.discover(str(tmp_path))] == ["A", "B"] and [v for v, _ in convergence.discover(str(tmp_path), "replica")] == ["A"]
    df = convergence.scan(spark, str(tmp_path), ["B"], ["x", "RMSE_F"])
    assert [tuple(r) for r in df.select("variant", "metric", "x", "RMSE_F", "source").collect()] == [("B", "JS", 1.0, 0.5, "pooled")]
    assert convergence.scan(spark, str(tmp_path), ["Z"]) is None
    assert convergence.options(df)["y"] == ["RMSE_F"] and convergence.options(df)["variants"] == ["B"]


def test_engine_and_cli(spark, sf, tmp_path, capsys):
    from curvelake import cli
    from curvelake.engine import Engine

    engine = Engine(spark, sf)
    assert "pmf" in engine.names and engine.sql("SELECT count(*) AS n FROM pmf JOIN metric_grid USING (metric)").first()["n"] > 0
    assert engine.run("q_table_status").count() == 3
    part = Engine(spark, sf, share=0.2, seed=1)
    assert 0 < part.table("features").select("variant").distinct().count() < engine.table("features").select("variant").distinct().count()
    assert cli.main([sf, "--list"]) == 0 and "q_describe" in capsys.readouterr().out
    assert cli.main([sf, "--query", "q_table_status", "--out", str(tmp_path / "o"), "--format", "csv"]) == 0
    assert spark.read.csv(str(tmp_path / "o"), header=True).count() == 3
