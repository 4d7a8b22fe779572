import datetime as dt

from curvelake.operators import wide

ROWS = "row_id bigint, variant string, metric string, val string, recorded_at timestamp, value string, unit string"
T = dt.datetime(2025, 1, 1)


def catalog(spark):
    return spark.createDataFrame([("rg__mean", "double", "nm"), ("rg__n", "bigint", None), ("is_ok", "boolean", None), ("kind", "string", None)], "metric string, value_type string, unit string")


def rows(spark, data):
    return spark.createDataFrame([(i, v, m, x, t, "clash", "clash") for i, v, m, x, t in data], ROWS)


def cells(spark, data):
    return {(r["variant"], r["metric"]): r["row_id"] for r in wide.filled(wide.widen(rows(spark, data), catalog(spark))).collect()}


def test_values_that_read_and_that_do_not(spark):
    good = {"rg__mean": ["1.5", " 1,5 ", "1e-3", "2.0 nm", "2.0nm", "-.5", "+3"], "rg__n": ["12", "12.0", "12,000", " -3 "], "is_ok": ["TRUE", "no", "0", "Yes"], "kind": ["x", " a b "]}
    bad = {"rg__mean": ["nan", "inf", "", None, "1.5 kT", "1.5.2", "1e999", "many"], "rg__n": ["1.5", "nan", "1e3", ""], "is_ok": ["2", "maybe", ""], "kind": ["", "   ", None]}
    data, want, n = [], set(), 0
    for table, fits in ((good, True), (bad, False)):
        for metric, values in table.items():
            for value in values:
                n += 1
                data.append((n, f"v{n}", metric, value, T))
                if fits:
                    want.add(n)
    assert set(cells(spark, data).values()) == want


def test_latest_wins_then_smaller_row(spark):
    later = T + dt.timedelta(days=1)
    data = [(5, "a", "RG/mean", "1", later), (3, "a", "rg__mean", "2", later), (1, "a", "rg.mean", "3", T), (9, "a", "rg__mean", "x", later + dt.timedelta(1)), (2, "b", "rg mean", "4", None), (2, "b", "rg mean", "4", None)]
    assert cells(spark, data) == {("a", "rg__mean"): 3, ("b", "rg__mean"): 2}


def test_types_nulls_and_unknown_attributes(spark):
    data = [(1, "a", "rg__n", "7.0", T), (2, None, "rg__n", "7", T), (3, "a", None, "7", T), (4, "a", "unknown", "7", T), (5, "c", "kind", "x" * 100_000, T)]
    made = wide.widen(rows(spark, data), catalog(spark))
    assert dict(made.dtypes)["rg__n"] == "bigint" and dict(made.dtypes)["is_ok"] == "boolean"
    got = {r["variant"]: r for r in made.collect()}
    assert set(got) == {"a", "c"} and got["a"]["rg__n"] == 7 and got["a"]["rg__mean"] is None and len(got["c"]["kind"]) == 100_000


def test_empty(spark):
    made = wide.widen(rows(spark, []), catalog(spark))
    assert made.count() == 0 and "rg__mean" in made.columns
    assert wide.widen(rows(spark, []), catalog(spark).limit(0)).columns == ["variant"]
