import datetime as dt

import numpy as np
import pandas as pd

from curvelake.llm import percentiles as P

SHARES = [0.0, 0.1, 0.5, 0.9, 1.0]


def frame(spark, data):
    t = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(g, v, w, t + dt.timedelta(days=i % 4) if i % 7 else None, "x", 1) for i, (g, v, w) in enumerate(data)], "g string, v double, w double, at timestamp, part string, first int")


def check(spark, data):
    got = {(r["g"], r["column"], r["share"]): (r["value"], r["n"]) for r in P.percentiles(P.day_partials(frame(spark, data), ["g"], ["v", "w"], "at"), ["g"], SHARES).collect()}
    table = pd.DataFrame(data, columns=["g", "v", "w"])
    want = {}
    for g, part in table.groupby("g", dropna=False):
        for c in ("v", "w"):
            x = part[c].astype(float).to_numpy()
            x = x[np.isfinite(x)]
            for s in SHARES:
                if len(x):
                    want[g if isinstance(g, str) else None, c, s] = (np.quantile(x, s), len(x))
    assert got.keys() == want.keys()
    for k, (value, n) in want.items():
        assert abs(got[k][0] - value) < 1e-9 and got[k][1] == n, k


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    data = [(str(rng.choice(["a", "b", "c"], p=[0.8, 0.15, 0.05])), float(np.round(rng.normal(), 2)), float(rng.exponential())) for _ in range(3000)]
    check(spark, data)


def test_dirt_ties_and_null_groups(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [("a", 1.0, None), ("a", nan, inf), ("a", -inf, -0.0), ("a", 1.0, 0.0), (None, 3.0, 1.0), (None, None, 2.0), ("b", None, nan), ("c", 5.0, 5.0)] + [("hot", 7.0, 7.0)] * 500)


def test_days_combine_in_any_parts(spark):
    data = [("a", float(i * 37 % 101), 0.0) for i in range(200)]
    df = frame(spark, data)
    whole = P.day_partials(df, ["g"], ["v"], "at")
    parts = P.day_partials(df.where("v < 40"), ["g"], ["v"], "at").unionByName(P.day_partials(df.where("v >= 40"), ["g"], ["v"], "at"))
    key = lambda p: sorted((r["share"], r["value"], r["n"]) for r in P.percentiles(p, ["g"], SHARES).collect())
    assert key(whole) == key(parts)


def test_empty(spark):
    assert P.percentiles(P.day_partials(frame(spark, []), ["g"], ["v"], "at"), ["g"], SHARES).count() == 0
