from datetime import date, timedelta

import duckdb
import numpy as np
import pandas as pd

from larder.operators import features
from larder.plans.catalog import neat


def made(spark, demand):
    rows = [(s, date(2024, 1, 1) + timedelta(i), float(x)) for s, values in demand.items() for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "sku_id string, date date, demand double")


def test_second_implementation_agrees(spark):
    demand = {f"S{m}": [(i * m) % 23 for i in range(125)] for m in (1, 3)}
    got = features.create_features(made(spark, demand)).toPandas().sort_values(["sku_id", "date"])
    for sku, values in demand.items():
        own, s = got[got.sku_id == sku], pd.Series(values, dtype=float)
        for k in (1, 7, 14, 30, 60, 90):
            np.testing.assert_allclose(own[f"lag_{k}"].astype(float), s.shift(k))
        for n in (30, 60, 90):
            np.testing.assert_allclose(own[f"roll_mean_{n}"].astype(float), s.shift(1).rolling(n).mean(), atol=1e-9)
            np.testing.assert_allclose(own[f"roll_std_{n}"].astype(float), s.shift(1).rolling(n).std(), atol=1e-9)
        for a in (0.3, 0.5, 0.7):
            np.testing.assert_allclose(own[f"ewm_{int(a * 10)}"].astype(float), s.shift(1).ewm(alpha=a, adjust=False).mean(), rtol=1e-12)
    assert len(got) == 250


def test_exponential_means_of_long_and_broken_series(spark):
    """Chunks that begin and end anywhere, large and tiny values, missing days and missing demand."""
    g = np.random.default_rng(4)
    series = {"long": g.uniform(0, 1e6, 1100).tolist(), "zeros": [1e9] + [0.0] * 400, "one": [5.0], "none": [None] * 70 + [3.0] * 3, "holes": [None if i % 7 == 3 else float(i) for i in range(300)]}
    rows = [(s, date(2023, 3, 9) + timedelta(i + 200 * (s == "holes" and i > 150)), x, 0.5) for s, v in series.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "sku_id string, date date, demand double, _sum double").repartition(3)
    got = features.ewm_features(df).toPandas().sort_values(["sku_id", "date"])
    for sku, values in series.items():
        for a in (0.3, 0.5, 0.7):
            y, want = None, []
            for x in values:
                want.append(np.nan if y is None else y)
                y = y if x is None else x if y is None else (1 - a) * y + a * x
            np.testing.assert_allclose(got[got.sku_id == sku][f"ewm_{int(a * 10)}"].astype(float), want, rtol=1e-10, atol=1e-280)


def test_exponential_means_are_those_of_a_fold_bit_by_bit(spark):
    """A scan that sums powers is off by the last bit, and a mean half way between two printed numbers then differs."""
    series = {"half": [0.0, 5.0, 0.0, 35.0, 13.0, 31.0, 2.0], "long": [float(i * i % 47) for i in range(200)]}
    got = features.ewm_features(made(spark, series)).toPandas().sort_values(["sku_id", "date"])
    for sku, values in series.items():
        for a, rest in ((0.3, 0.7), (0.5, 0.5), (0.7, 0.3)):
            y, want = None, []
            for x in values:
                want.append(y)
                y = x if y is None else y * rest + x * a
            assert [None if np.isnan(v) else v for v in got[got.sku_id == sku][f"ewm_{int(a * 10)}"]] == want


def test_numbers_are_rounded_as_sql_rounds_them(spark):
    con = duckdb.connect()
    values = [26.663349999999998, -26.663349999999998, 0.03125, 1.00005, 2.5, 1e12 + 0.00005, 0.0, None]
    got = [r.v for r in neat(spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)).collect()]
    assert got == [con.execute("SELECT round(CAST(? AS DOUBLE), 4)", [v]).fetchall()[0][0] for v in values]


def test_the_future_does_not_leak(spark):
    values = [i % 17 for i in range(120)]
    changed = [x + 10_000 if i > 91 else x for i, x in enumerate(values)]
    a, b = (features.create_features(made(spark, {"S": v})).filter("date <= '2024-04-01'").drop("demand").orderBy("date").collect() for v in (values, changed))
    assert a == b
