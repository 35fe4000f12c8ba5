import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions.ordered import grouped_quantiles, numbered, quantiles, running_total


@pytest.fixture(scope="module")
def rows(spark):
    """Many ties: a third of all values is the same."""
    g = np.random.default_rng(5)
    values = [1.0 if i % 3 == 0 else float(g.integers(0, 50)) / 4 for i in range(400)]
    return values, spark.createDataFrame([(f"k{i:04d}", v) for i, v in enumerate(values)], "key string, v double")


def test_running_total_and_numbers_follow_the_order(rows):
    values, df = rows
    got = running_total(df, F.col("v"), [F.desc("v"), F.col("key")], "run", "total").orderBy("run", F.desc("v"), "key").collect()
    order = sorted(range(len(values)), key=lambda i: (-values[i], i))
    want = np.cumsum([values[i] for i in order])
    assert {r.key: r.run for r in got} == pytest.approx({f"k{i:04d}": w for i, w in zip(order, want.tolist(), strict=True)})
    assert all(r.total == pytest.approx(sum(values)) for r in got)
    ranks = {r.key: r.n for r in numbered(df, [F.desc("v"), F.col("key")], "n").collect()}
    assert ranks == {f"k{i:04d}": at + 1 for at, i in enumerate(order)}


def test_quantiles_are_exact(rows):
    values, df = rows
    wanted = {"low": 0.25, "mid": 0.5, "high": 0.97, "end": 1.0}
    got = quantiles(df, "v", "key", wanted).first()
    for name, q in wanted.items():
        assert got[name] == pytest.approx(float(np.quantile(values, q)))


def test_no_rows(spark):
    none = spark.createDataFrame([], "key string, v double")
    assert numbered(none, [F.col("key")], "n").count() == 0
    assert quantiles(none, "v", "key", {"q": 0.5}).first().q is None


def test_missing_values_count_as_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("c", None)], "key string, v double")
    assert [r.run for r in running_total(df, F.col("v"), [F.col("key")], "run").orderBy("key").collect()] == [0.0, 2.0, 2.0]
    assert quantiles(df, "v", "key", {"q": 0.5}).first().q == 2.0


def test_quantiles_of_groups_of_any_size(spark):
    """One group with most rows, one with most of its values equal, small ones, a null key and missing values."""
    g, rows = np.random.default_rng(9), []
    for key, n in (("hot", 3000), ("same", 900), ("two", 2), ("one", 1), (None, 50), ("none", 5)):
        for i in range(n):
            value = None if key == "none" or i % 11 == 7 else 1.5 if key == "same" and i % 9 else float(g.normal())
            rows.append((key, "x", value))
    df = spark.createDataFrame(rows, "k string, other string, v double").repartition(6)
    wanted = {"least": 0.0, "low": 0.1, "mid": 0.5, "high": 0.97, "most": 1.0}
    got = {r.k: r for r in grouped_quantiles(df, ["k", "other"], "v", wanted).collect()}
    assert set(got) == {"hot", "same", "two", "one", None}
    for key, r in got.items():
        own = [v for k, _, v in rows if k == key and v is not None]
        assert [r[name] for name in wanted] == pytest.approx([float(np.quantile(own, q)) for q in wanted.values()])


def test_a_large_group_lies_in_several_ranges(spark):
    df = spark.range(10_000).selectExpr("'one' AS k", "CAST(id AS double) AS v")
    plan = grouped_quantiles(df, ["k"], "v", {"mid": 0.5})
    assert plan.first().mid == 4999.5
    rows = spark.range(10_000).selectExpr("'one' AS k", "id AS v").repartitionByRange(4, "k", "v").selectExpr("spark_partition_id() AS p").distinct()
    assert rows.count() == 4


def test_no_groups(spark):
    assert grouped_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"q": 0.5}).collect() == []
