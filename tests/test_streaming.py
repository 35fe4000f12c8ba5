"""The stream, batch by batch and after a restart, against the batch simulation."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import simulate
from larder.streaming.replenish import replenish

FIRST, N = date(2025, 10, 1), 24
DAYS = "sku_id string, date date, demand double, target double"


@pytest.fixture(scope="module")
def made(spark):
    g = np.random.default_rng(3)
    rows = [(s, FIRST + timedelta(i), float(g.integers(0, 9)), float(g.integers(1, 8)) if i + 1 < N else None) for s in ("A", "B", "C") for i in range(N)]
    policy = spark.createDataFrame([("A", 1, 20.0, 8.0, 3.0), ("B", 4, 15.0, 30.0, 0.0), ("C", 2, 5.0, 40.0, 1.0)], "sku_id string, lead_time long, order_quantity double, rop double, safety_stock double")
    return rows, policy, spark.createDataFrame([("A", 10), ("B", 0), ("C", 25)], "sku_id string, initial_inventory long")


def written(spark, rows, path, first, last):
    spark.createDataFrame([r for r in rows if first <= (r[1] - FIRST).days < last], DAYS).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("dynamic", [False, True])
def test_batches_give_the_rows_of_the_batch_simulation(spark, made, tmp_path, dynamic):
    rows, policy, initial = made
    source, sink, state = (f"{tmp_path}/{k}" for k in ("days", "trace", "state"))
    cuts = [0, 1, 6, 7, 15, N]
    for a, b in zip(cuts, cuts[1:], strict=False):  # each batch goes on from the checkpoint of the one before
        written(spark, rows, source, a, b)
        stream = spark.readStream.schema(DAYS).parquet(source)
        out = replenish(stream, policy, initial, FIRST + timedelta(N - 1), dynamic)
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    daily = spark.createDataFrame(rows, DAYS)
    schedule = daily.select("sku_id", F.date_add("date", 1), "target").toDF("sku_id", "date", "forecast").filter("forecast is not null")
    want = simulate.simulate(simulate.daily_paths(daily, ["sku_id"], schedule if dynamic else None), policy, initial, ["sku_id"], dynamic=dynamic)
    got = spark.read.parquet(sink)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() == 3 * N
    assert got.filter("order_placed = 1").count() > 3


def test_a_gap_is_refused(spark, made, tmp_path):
    rows, policy, initial = made
    written(spark, rows, f"{tmp_path}/days", 0, 2)
    written(spark, rows, f"{tmp_path}/days", 3, 4)
    out = replenish(spark.readStream.schema(DAYS).parquet(f"{tmp_path}/days"), policy, initial, FIRST + timedelta(N - 1))
    query = out.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="must come next for SKU"):
        query.awaitTermination()
