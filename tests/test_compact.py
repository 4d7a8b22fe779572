from curvelake.operators import compact

FILES = "file_id bigint, path string, n_rows int, n_bytes bigint, bucket string"
ROWS = "file_id bigint, row_no int, variant string, metric string, replica int, x double, P double, F_kJ_mol double, _h1 string, _n int, group_no int"


def manifest(spark, n=500):
    return spark.createDataFrame([(i, f"D/v{i % 7}/m{i % 3}.{i}.parquet", 2, 0 if i % 50 == 0 else 100 + i % 9, "clash") for i in range(1, n + 1)], FILES)


def test_groups_are_intervals_of_the_running_sum(spark):
    plan = compact.plan_groups(manifest(spark), 1000).orderBy("offset_bytes", "file_id").collect()
    assert len(plan) == 500 and len({r["file_id"] for r in plan}) == 500
    total, size = 0, {}
    for r in sorted(plan, key=lambda r: (r["offset_bytes"], r["n_bytes"])):
        assert r["offset_bytes"] == total and r["group_no"] == total // 1000
        total += r["n_bytes"]
        size[r["group_no"]] = size.get(r["group_no"], 0) + r["n_bytes"]
    assert total == sum(100 + i % 9 for i in range(1, 501) if i % 50)
    assert max(size.values()) < 1000 + 109


def rows(spark, data):
    return spark.createDataFrame([(*r, "clash", 5, 77) for r in data], ROWS)


def test_repeats(spark):
    nan = float("nan")
    data = [
        (1, 1, " Pep ", "RG", 1, 0.1, 0.2, 0.3), (2, 1, "pep", "rg ", 1, 0.1000000001, 0.2, 0.3), (1, 2, "pep", "rg", 2, 0.1, 0.2, 0.3),
        (3, 1, None, "rg", 1, nan, None, 0.0), (3, 2, None, "rg", 1, nan, None, -0.0), (3, 3, None, "rg", 1, None, None, 0.0), (9, 1, "pep", "rg", 1, 0.1, 0.2, 0.3), (9, 2, "pep", "rg", 1, 0.100002, 0.2, 0.3),
    ]
    made = compact.rewrite(manifest(spark, 3), rows(spark, data), 1000)
    got = {(r["file_id"], r["row_no"]) for r in made.where("repeats").collect()}
    assert got == {(2, 1), (3, 2), (9, 1)}
    assert made.count() == len(data) and made.where("_h1 = 'clash' AND _n = 5").count() == len(data)
    assert {r["group_no"] for r in made.where("file_id = 9").collect()} == {-1}
    got = {r["file_id"]: (r["group_no"], r["listed_rows"], r["kept_rows"], r["repeated_rows"], r["whole"]) for r in compact.reconcile(manifest(spark, 3), made, 1000).collect()}
    assert got == {1: (0, 2, 2, 0, True), 2: (0, 2, 0, 1, False), 3: (0, 2, 2, 1, False), 9: (-1, None, 1, 1, False)}


def test_one_record_in_a_third_of_all_rows(spark):
    data = [(i, 1, "p", "rg", 1, 0.5, 0.5, 0.5) if i % 3 == 0 else (i, 1, "p", "rg", i + 1000, 0.5, 0.5, 0.5) for i in range(1, 601)]
    assert compact.rewrite(manifest(spark), rows(spark, data)).where("repeats").count() == 199


def test_written_groups_hold_each_record_once(spark, tmp_path):
    data = [(i % 20 + 1, i, "p", "rg", i % 37, 0.1, 0.2, 0.3) for i in range(200)] + [(99, i, "p", "rg", i, 0.7, 0.2, 0.3) for i in range(50)]
    path = str(tmp_path / "out")
    back = compact.consolidate(manifest(spark, 20), rows(spark, data), 500, path).cache()
    assert back.count() == 250 and back.where("NOT repeats").count() == 37 + 50 and back.where("repeats").count() == 163
    assert back.where("repeats AND variant IS NOT NULL").count() == 0 and back.where("NOT repeats AND (_h1 <> 'clash' OR _n <> 5)").count() == 0
    keys = {(r["replica"], r["x"]) for r in back.where("NOT repeats").collect()}
    assert keys == {(i, 0.1) for i in range(37)} | {(i, 0.7) for i in range(50)}
    # One file per planned group; the rows of unlisted files lie in group -1.
    groups = {r["group_no"] for r in back.where("NOT repeats").collect()}
    folders = {p.name: list(p.glob("*.parquet")) for p in (tmp_path / "out" / "repeats=false").iterdir()}
    assert set(folders) == {f"part={g}" for g in groups} and all(len(f) == 1 for n, f in folders.items() if n != "part=-1")
    every = compact.reconcile(manifest(spark, 20), back, 500).collect()
    assert len(every) == 21 and sum(r["kept_rows"] + r["repeated_rows"] for r in every) == 250


def test_rows_are_scanned_and_shuffled_once(spark, tmp_path):
    rows(spark, [(1, 1, "p", "rg", 1, 0.1, 0.2, 0.3)]).write.parquet(str(tmp_path / "in"))
    marked = compact.mark_repeats(spark.read.parquet(str(tmp_path / "in")), ["variant"])
    marked.collect()
    plan = marked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


def test_empty(spark):
    assert compact.plan_groups(manifest(spark).limit(0)).count() == 0
    made = compact.rewrite(manifest(spark).limit(0), rows(spark, []))
    assert made.count() == 0 and compact.reconcile(manifest(spark).limit(0), made).count() == 0
