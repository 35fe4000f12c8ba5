from datetime import date, timedelta

import numpy as np
import pytest

from larder.operators import simulate
from larder.operators.contract import ContractError, require_output

DAY = date(2025, 10, 1)


def run(spark, demand, rop, quantity, lead, initial, forecast=None, safety=0.0):
    days = [DAY + timedelta(i) for i in range(len(demand))]
    daily = spark.createDataFrame([("S", d, float(x)) for d, x in zip(days, demand)], "sku_id string, date date, demand double")
    schedule = None if forecast is None else spark.createDataFrame([("S", d, float(x)) for d, x in zip(days, forecast)], "sku_id string, date date, forecast double")
    policy = spark.createDataFrame([("S", lead, float(quantity), float(rop), float(safety), 5.0, 10.0)], "sku_id string, lead_time int, order_quantity double, rop double, safety_stock double, unit_cost double, unit_price double")
    start = spark.createDataFrame([("S", float(initial))], "sku_id string, initial_inventory double")
    trace = simulate.simulate(simulate.daily_paths(daily, ["sku_id"], schedule), policy, start, ["sku_id"], dynamic=forecast is not None)
    return trace, policy


def test_inventory_is_conserved_and_never_negative(spark):
    trace, policy = run(spark, [5, 7, 3, 4], rop=8, quantity=10, lead=1, initial=20)
    rows = trace.orderBy("date").collect()
    before = 20.0
    for r in rows:
        assert r.inventory == before + r.received - r.sales_quantity and r.inventory >= 0 and r.lost == r.demand - r.sales_quantity
        before = r.inventory
    metric = simulate.policy_metric(trace, policy, ["sku_id"], 50.0, 0.25).first()
    assert metric.total_demand == 19 and metric.total_sales == sum(r.sales_quantity for r in rows)
    assert metric.total_cost == pytest.approx(metric.stockout_cost + metric.holding_cost + metric.ordering_cost)


@pytest.mark.parametrize("lead", [1, 3, 5])
def test_an_order_arrives_after_its_lead_time(spark, lead):
    rows = run(spark, [0] * (lead + 2), rop=0, quantity=10, lead=lead, initial=0)[0].orderBy("date").collect()
    assert [i for i, r in enumerate(rows) if r.received > 0][0] == lead


def test_dynamic_reorder_point_uses_the_next_day(spark):
    rows = run(spark, [0, 0, 0], rop=0, quantity=5, lead=2, initial=0, forecast=[100, 4, 7], safety=3)[0].orderBy("date").collect()
    assert [r.rop_used for r in rows] == [11.0, 17.0, None] and [r.order_placed for r in rows] == [1, 1, 0]


def test_linear_quantile(spark):
    from pyspark.sql import functions as F

    values = [3.0, 5.0, 7.0]
    got = spark.range(1).select(simulate.quantile_of(F.array(*map(F.lit, values)), F.lit(0.97)).alias("q")).first().q
    assert got == pytest.approx(float(np.quantile(values, 0.97)))


def test_a_forecast_to_be_written_is_unique_and_nonnegative(spark):
    with pytest.raises(ContractError, match="nonnegative"):
        require_output(spark.createDataFrame([("S", DAY, -0.1)], "sku_id string, date date, forecast double"))
    with pytest.raises(ContractError, match="duplicate SKU-date"):
        require_output(spark.createDataFrame([("S", DAY, 0.1)] * 2, "sku_id string, date date, forecast double"))


def refuses(match, make):
    with pytest.raises(Exception, match=match):
        make().collect()


@pytest.mark.parametrize("lead", [0.0, -1.0, 3.5, float("nan"), float("inf"), None])
def test_lead_times_must_be_positive_whole_days(spark, lead):
    daily = spark.createDataFrame([("S", DAY + timedelta(i), 1.0) for i in range(5)], "sku_id string, date date, demand double")
    policy = spark.createDataFrame([("S", lead, 10.0, 1.0, 0.0, 5.0, 10.0)], "sku_id string, lead_time double, order_quantity double, rop double, safety_stock double, unit_cost double, unit_price double")
    start = spark.createDataFrame([("S", 1.0)], "sku_id string, initial_inventory double")
    refuses("lead_time must be a positive integer; affected: S", lambda: simulate.simulate(simulate.daily_paths(daily, ["sku_id"]), policy, start, ["sku_id"]))


@pytest.mark.parametrize("days", [[0, 2], [0, 1, 1], [0, 1, 1, 3], [0, None]])
def test_days_must_follow_one_another(spark, days):
    daily = spark.createDataFrame([("S", None if i is None else DAY + timedelta(i), 1.0) for i in days], "sku_id string, date date, demand double")
    refuses("one consecutive row per calendar day; affected: S", lambda: simulate.daily_paths(daily, ["sku_id"]))


def test_a_policy_needs_its_days_and_inventory(spark):
    daily = spark.createDataFrame([("S", DAY, 1.0), ("T", DAY, 1.0)], "sku_id string, date date, demand double")
    policy = lambda sku: spark.createDataFrame([(sku, 1, 10.0, 1.0, 0.0)], "sku_id string, lead_time int, order_quantity double, rop double, safety_stock double")
    start = spark.createDataFrame([("S", 1.0)], "sku_id string, initial_inventory double")
    paths = simulate.daily_paths(daily, ["sku_id"])
    assert [r.sku_id for r in simulate.run_totals(paths, policy("S"), start, ["sku_id"]).collect()] == ["S"]
    for sku in ("U", "T"):
        refuses(f"no daily demand or no inventory before it for target SKU {sku}", lambda sku=sku: simulate.run_totals(paths, policy(sku), start, ["sku_id"]))


def test_totals_are_those_of_the_trace(spark):
    g = np.random.default_rng(5)
    rows = [(s, DAY + timedelta(i), float(g.integers(0, 9))) for s, n in (("A", 40), ("B", 1), ("C", 25)) for i in range(n)]
    daily = spark.createDataFrame(rows, "sku_id string, date date, demand double")
    policy = spark.createDataFrame([(s, lead, 30.0, 12.0, 0.0, "AX", 5.0, 10.0) for s, lead in (("A", 3), ("B", 1), ("C", 30))], "sku_id string, lead_time int, order_quantity double, rop double, safety_stock double, class string, unit_cost double, unit_price double")
    start = spark.createDataFrame([("A", 20.0), ("B", 0.0), ("C", 50.0)], "sku_id string, initial_inventory double")
    paths = simulate.daily_paths(daily, ["sku_id"])
    trace, totals = simulate.simulate(paths, policy, start, ["sku_id"]), simulate.run_totals(paths, policy, start, ["sku_id"])
    one = simulate.policy_metric(trace, policy, ["sku_id"], 50.0, 0.25).orderBy("sku_id").collect()
    two = simulate.priced(totals, policy, ["sku_id"], 50.0, 0.25).orderBy("sku_id").collect()
    assert len(one) == 3 and [r.asDict() for r in one] == [r.asDict() for r in two]
    assert one[0].num_cycles > 2 and one[0].total_lost > 0


@pytest.mark.parametrize("rate", [-0.1, float("inf"), float("nan")])
def test_costs_must_be_finite_and_nonnegative(spark, rate):
    trace, policy = run(spark, [1], rop=1, quantity=1, lead=1, initial=1)
    for rates in ((rate, 0.25, 1.0), (50.0, rate, 1.0), (50.0, 0.25, rate)):
        with pytest.raises(ValueError, match="finite and nonnegative"):
            simulate.policy_metric(trace, policy, ["sku_id"], *rates)
