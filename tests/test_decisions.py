"""Worked examples of policies, costs, windows and uncertainty."""

from datetime import date, timedelta

import numpy as np
import pytest

from larder.config import Settings, Windows
from larder.operators import contract, forecast, policy, report, simulate, uncertainty
from larder.sources.panel import PANEL

S = Settings(windows=Windows(date(2025, 1, 1), date(2025, 5, 30), date(2025, 5, 31), date(2025, 9, 30), date(2025, 10, 1)))


def panel(spark, rows):
    """Rows of (sku, date, demand, inventory, received, lead, rop, quantity)."""
    full = [(s, d, demand, demand, inventory, received, "c", lead, 1, rop, q, 5.0, 10.0) for s, d, demand, inventory, received, lead, rop, q in rows]
    return spark.createDataFrame(full, PANEL)


def test_each_broken_promise_is_counted(spark):
    d = date(2025, 1, 1)
    good = [("A", d, 1, 1, 10, 0, "c", 2, 1, 1, 1, 1.0, 2.0), ("A", d + timedelta(1), 2, 2, 8, 0, "c", 2, 1, 1, 1, 1.0, 2.0)]
    bad = [("B", d, 1, 2, 10, 0, "c", 0, 1, 1, 1, 1.0, 2.0), ("B", d + timedelta(2), -1, -1, 3, 0, None, 2, 1, 1, 1, 1.0, 2.0)]
    counts = lambda rows: {r.check_name: r.violations for r in contract.contract_violations(spark.createDataFrame(rows, PANEL)).collect()}
    assert not any(counts(good).values())
    found = counts(good + bad)
    assert {k for k, v in found.items() if v} == {"no_missing_value", "lead_time_whole_days", "continuous_calendar", "not_negative", "sales_within_demand", "inventory_balance"}
    assert counts([*good, good[0]])["key_unique"] == 2
    assert not any(counts([]).values())


def test_recorded_and_inferred_policies(spark):
    days = [date(2025, 9, 27) + timedelta(i) for i in range(4)]
    p = panel(spark, [("A", d, 3, inv, rec, 1, 40, 20) for d, inv, rec in zip(days, (15, 12, 7, 18), (0, 0, 0, 12))])
    old, seen = policy.historical_policy(p, S).first(), policy.inferred_policy(p, S).first()
    assert (old.rop, old.order_quantity) == (40, 20) and (seen.rop, seen.order_quantity) == (7, 12)


def test_safety_stock_is_a_quantile_of_summed_residuals(spark):
    days = [date(2025, 9, 27) + timedelta(i) for i in range(4)]
    p = panel(spark, [("A", d, 10, 10, 0, 2, 1, 1) for d in days] + [("A", date(2025, 10, 1), 500, 10, 0, 2, 1, 1)])
    fc = spark.createDataFrame([("A", d, float(x), 10.0) for d, x in zip(days, (11, 12, 13, 14))], "sku_id string, date date, demand double, forecast double")
    for class_, intervention, target in (("AY", None, 97), ("DX", "protect_strategic_value", 97)):
        scope = spark.createDataFrame([("A", class_, intervention)], "sku_id string, class string, intervention string")
        row = policy.policy_params(fc, p, scope, S).first()
        assert list(row.sums) == [3, 5, 7] and row.target == target and row.safety_stock == pytest.approx(float(np.quantile([3, 5, 7], 0.97)))


@pytest.mark.parametrize("by_sku", [False, True])
def test_orders_keep_to_least_quantity_and_multiple(spark, by_sku):
    days = [date(2025, 6, 1) + timedelta(i) for i in range(5)]
    p = panel(spark, [("A", d, 5, 10, 0, 1, 5, 5) for d in (date(2025, 5, 30), *days)])
    if by_sku:
        from pyspark.sql import functions as F

        p = p.withColumns({"moq": F.lit(7), "order_multiple": F.lit(4)})
    fc = spark.createDataFrame([("A", d, 5.0, 5.0) for d in days], "sku_id string, date date, demand double, forecast double")
    scope = spark.createDataFrame([("A", "CX", "correct_understock")], "sku_id string, class string, intervention string")
    own = Settings(windows=S.windows, quantity_multipliers=(0.5, 2.0), reorder_quantiles=(0.5,))
    audit = policy.policy_grid(fc, p, scope, own, *(() if by_sku else (7, 4)))
    rows = audit.collect()
    assert len(rows) == 4 and {r.order_quantity for r in rows} == {8, 12}
    best, able = policy.selected_policy(audit).first(), [r for r in rows if r.service_floor_met]
    assert best.total_cost == pytest.approx(min((r.total_cost for r in able), default=best.total_cost))


def test_a_constraint_must_be_positive(spark):
    from pyspark.sql import functions as F

    p = panel(spark, [("A", date(2025, 6, 1), 5, 10, 0, 1, 5, 5)]).withColumn("moq", F.lit(0))
    with pytest.raises(Exception, match="moq must be positive"):
        policy.with_constraint(p.select("sku_id").distinct(), p, "moq", 1.0, S).collect()


def metric(spark, rows):
    cols = "sku_id string, total_sales double, total_demand double, avg_inventory double, stockout_unit double, holding_unit double, orders double, total_cost double"
    return spark.createDataFrame(rows, cols)


def test_costs_scale_with_their_rates(spark):
    own = Settings(windows=S.windows, ordering_costs=(10.0, 20.0), holding_rates=(0.1, 0.2), shortage_multipliers=(0.5, 1.5))
    old = metric(spark, [("A", 80.0, 100.0, 10.0, 100.0, 100.0, 1.0, 175.0)])
    new = metric(spark, [("A", 100.0, 100.0, 8.0, 0.0, 100.0, 1.0, 75.0)])
    rows = uncertainty.cost_sensitivity(old, new, own).orderBy("scenario_id").collect()
    assert len(rows) == 8 and rows[0].scenario_id == "cost_sensitivity_001" and all(r.fill_rate_delta_pp == pytest.approx(20) for r in rows)
    first = rows[0]
    assert rows[1].old_stockout_cost == pytest.approx(3 * first.old_stockout_cost) and rows[2].old_holding_cost == pytest.approx(2 * first.old_holding_cost) and rows[4].old_ordering_cost == pytest.approx(2 * first.old_ordering_cost)
    assert all(r.old_total_cost == pytest.approx(r.old_stockout_cost + r.old_holding_cost + r.old_ordering_cost) for r in rows)


@pytest.mark.parametrize("kind", ["hash", "pcg64"])
def test_bootstrap_is_the_same_again(spark, kind):
    old = metric(spark, [("A", 60.0, 60.0, 50.0, 0.0, 0.0, 0.0, 100.0), ("B", 40.0, 50.0, 50.0, 0.0, 0.0, 0.0, 100.0)])
    new = metric(spark, [("A", 60.0, 60.0, 45.0, 0.0, 0.0, 0.0, 80.0), ("B", 45.0, 50.0, 45.0, 0.0, 0.0, 0.0, 80.0)])
    one, two = ({r.metric: r for r in uncertainty.policy_bootstrap(old, new, 100, 7, kind).collect()} for _ in range(2))
    assert one == two
    assert one["fill_rate_delta_pp"].estimate == pytest.approx(100 * (105 / 110 - 100 / 110))
    assert one["inventory_change_pct"].estimate == pytest.approx(-10) and one["cost_change_pct"].estimate == pytest.approx(-20)
    known = uncertainty.policy_bootstrap(old, new, 10, 7, kind)
    assert report.uncertainty_estimate(known, "cost_change_pct", 1.0).first()[0] == pytest.approx(-20) and report.uncertainty_estimate(known, "other", 1.0).first()[0] == 1.0


def test_folds_and_windows(spark):
    days = spark.createDataFrame([(date(2024, 1, 1) + timedelta(i),) for i in range(640)], "date date")
    rows = forecast.date_folds(days, S).collect()
    assert len(rows) == 150 and min(r.date for r in rows) >= date(2025, 1, 1) and max(r.date for r in rows) == date(2025, 5, 30)
    with pytest.raises(ValueError, match="follow one another"):
        Windows(calibration_start=date(2025, 5, 1))


def test_forecasts_outside_their_window_are_refused(spark):
    row = spark.createDataFrame([("A", date(2025, 10, 1), 1.0, 1.0)], "sku_id string, date date, demand double, forecast double")
    with pytest.raises(contract.ContractError, match="configured"):
        contract.require_forecast(row, S.windows.calibration_start, S.windows.calibration_end, S.windows.final_start)


def test_negative_margin_is_refused(spark):
    trace = spark.createDataFrame([("A", date(2025, 10, 1), 1.0, 1.0, 0.0, 5.0, 0.0, 0)], "sku_id string, date date, demand double, sales_quantity double, lost double, inventory double, received double, order_placed int")
    runs = spark.createDataFrame([("A", 10.0, 5.0)], "sku_id string, unit_cost double, unit_price double")
    with pytest.raises(Exception, match="negative unit margin"):
        simulate.policy_metric(trace, runs, ["sku_id"], 50.0, 0.25).collect()


def test_scenarios_weighed_by_probability(spark):
    df = spark.createDataFrame([(1.0, 0.7), (-1.0, 0.2), (None, 0.1)], "cost_saving double, p double")
    assert report.favourable_share(df).first()[0] == 0.5 and report.favourable_share(df, "p").first()[0] == pytest.approx(0.7 / 0.9)


def stress_policy(spark, rows):
    return spark.createDataFrame([(s, lead, 20.0, 15.0, 4.0, 5.0, 10.0) for s, lead in rows], "sku_id string, lead_time double, order_quantity double, rop double, safety_stock double, unit_cost double, unit_price double")


@pytest.mark.parametrize(("new", "says"), [([("A", 2.0)], "same SKU set"), ([("A", 2.0), ("B", 2.0), ("B", 2.0)], "one row per SKU"), ([("A", 2.0), ("B", 3.0)], "same base lead time for B"), ([("A", 2.0), ("B", 2.5)], "positive integer; affected: B")])
def test_stress_needs_paired_policies(spark, new, says):
    old = stress_policy(spark, [("A", 2.0), ("B", 2.0)])
    assert sorted(r.sku_id for r in uncertainty.paired_policies(old, old).collect()) == ["A", "B"]
    with pytest.raises(Exception, match=says):
        uncertainty.paired_policies(old, stress_policy(spark, new)).collect()


def test_rates_of_zero_can_be_repriced(spark):
    own = Settings(windows=S.windows, ordering_cost=0.0, holding_rate=0.0, shortage_multiplier=0.0, ordering_costs=(0.0, 20.0), holding_rates=(0.2,), shortage_multipliers=(1.0,))
    old = metric(spark, [("A", 80.0, 100.0, 10.0, 100.0, 100.0, 2.0, 0.0)])
    rows = uncertainty.cost_sensitivity(old, old, own).orderBy("ordering_cost_rate").collect()
    assert [r.old_total_cost for r in rows] == pytest.approx([120.0, 160.0]) and all(r.cost_saving == 0 for r in rows)
    with pytest.raises(ValueError, match="finite and nonnegative"):
        uncertainty.cost_sensitivity(old, old, Settings(windows=S.windows, holding_rates=(-1.0,)))


def test_bootstrap_needs_the_same_skus(spark):
    old = metric(spark, [("A", 60.0, 60.0, 50.0, 0.0, 0.0, 0.0, 100.0), ("B", 40.0, 50.0, 50.0, 0.0, 0.0, 0.0, 100.0)])
    with pytest.raises(Exception, match="metrics of the same SKUs; affected: B"):
        uncertainty.policy_bootstrap(old, old.filter("sku_id = 'A'"), 10, 7).collect()


def test_action_words(spark):
    current = spark.createDataFrame([("A", 100.0, 50.0, 5.0), ("B", 100.0, 50.0, 5.0), ("C", 100.0, 50.0, 5.0), ("D", 100.0, 50.0, 5.0)], "sku_id string, order_quantity double, rop double, safety_stock double")
    rows = [("A", 90.0, 60.0, "minimum_cost_feasible"), ("B", 120.0, 40.0, "minimum_cost_feasible"), ("C", 105.0, 52.5, "minimum_cost_feasible"), ("D", 1.0, 1.0, "no_feasible_candidate_best_service")]
    chosen = spark.createDataFrame([(s, "AX", "x", 2.0, q, rop, 1.0, 0.9, status) for s, q, rop, status in rows], "sku_id string, class string, intervention string, lead_time double, order_quantity double, rop double, safety_stock double, service_floor double, selection_status string")
    metrics = spark.createDataFrame([(s, 0.9, 10.0, 100.0, 1.0) for s in "ABCD"], "sku_id string, fill_rate double, avg_inventory double, total_cost double, total_lost double")
    got = {r.sku_id: r.action for r in report.policy_action(chosen, current, metrics, metrics).collect()}
    assert got == {"A": "raise ROP + lower Q", "B": "lower ROP + raise Q", "C": "Keep parameters / monitor", "D": "Review SLA/grid feasibility"}
    medians = spark.createDataFrame([("A", 50.0), ("B", 50.0), ("C", 50.0)], "sku_id string, reorder_point double")
    assert {r.sku_id: r.action for r in report.fallback_action(chosen.filter("sku_id < 'D'"), medians).collect()} == {"A": "Increase ROP", "B": "Reduce ROP", "C": "Hold / monitor"}
