"""Stress and bootstrap by numpy's sequence, against a loop that draws and simulates in order."""

import math
import os
from datetime import date, timedelta

import numpy as np
import pytest

from larder.config import Settings, Windows
from larder.operators import uncertainty
from larder.sources.panel import PANEL

W = Windows(date(2025, 1, 1), date(2025, 5, 30), date(2025, 5, 31), date(2025, 9, 30), date(2025, 10, 1))
DAYS, FINAL = 11, [date(2025, 10, 1) + timedelta(i) for i in range(11)]
SKUS = ["b10", "a7", "c", "Z"]


def run(demand, lead, quantity, point, start):
    """(demand, sales, inventory sum, orders): receive, sell, then order for a later day, but on the last."""
    due, inventory, waiting, sold, held, orders = {}, start, 0.0, 0.0, 0.0, 0
    for t, wanted in enumerate(demand):
        arrived = due.pop(t, 0.0)
        inventory, waiting = inventory + arrived, waiting - arrived
        sales = min(wanted, inventory)
        inventory, sold = inventory - sales, sold + sales
        held += inventory
        if t + 1 < len(demand) and inventory + waiting <= point(t):
            due[t + lead] = due.get(t + lead, 0.0) + quantity
            waiting, orders = waiting + quantity, orders + 1
    return sum(demand), sold, held / len(demand), orders


def brute(residuals, forecast, policies, settings, scenarios):
    rng, out = np.random.default_rng(settings.seed), []
    for _ in range(scenarios):
        factor = float(rng.choice(np.array(settings.lead_multipliers), p=np.array(settings.lead_probabilities)))
        sums, clipped = {"old": np.zeros(4), "new": np.zeros(4)}, 0
        for sku in sorted(SKUS):
            noise = []
            while len(noise) < DAYS:
                at = int(rng.integers(0, len(residuals[sku]) - settings.block_days + 1))
                noise += residuals[sku][at : at + settings.block_days]
            raw = [f + e for f, e in zip(forecast[sku], noise, strict=False)]
            clipped += sum(x < 0 for x in raw)
            demand = [max(x, 0.0) for x in raw]
            for side, (lead, quantity, rop, safety, cost, price, start) in ((k, v[sku]) for k, v in policies.items()):
                own = max(1, math.ceil(lead * factor))
                point = (lambda t, r=rop: r) if side == "old" else (lambda t, s=sku, n=own, ss=safety: forecast[s][t + 1] * n + ss)
                wanted, sold, held, orders = run(demand, own, quantity, point, start)
                sums[side] += [wanted, sold, held, (wanted - sold) * (price - cost) + held * cost * settings.holding_rate * DAYS / 365 + orders * settings.ordering_cost]
        out.append((factor, clipped, *sums["old"], *sums["new"]))
    return out


@pytest.mark.parametrize("seed", [42, 7])
def test_stress_draws_as_one_program_would(spark, seed):
    settings, g = Settings(windows=W, seed=seed, scenarios=9), np.random.default_rng(1)
    residuals = {s: [float(x) for x in g.integers(-9, 10, n)] for s, n in zip(SKUS, (40, 7, 25, 123), strict=True)}  # one block alone draws nothing
    forecast = {s: [float(x) for x in g.integers(2, 12, DAYS)] for s in SKUS}
    policies = {side: {s: (2.0 + k, q + k, 15.0, 4.0, 5.0, 9.0, 20.0) for k, s in enumerate(SKUS)} for side, q in (("old", 20.0), ("new", 12.0))}
    rows = [(s, date(2025, 6, 1) + timedelta(i), 50.0 + x, 50.0) for s in SKUS for i, x in enumerate(residuals[s])]
    calibration = spark.createDataFrame(rows, "sku_id string, date date, demand double, forecast double").repartition(5)
    schedule = spark.createDataFrame([(s, d, f) for s in SKUS for d, f in zip(FINAL, forecast[s], strict=True)], "sku_id string, date date, forecast double")
    old, new = (spark.createDataFrame([(s, *v[:-1]) for s, v in policies[side].items()], "sku_id string, lead_time double, order_quantity double, rop double, safety_stock double, unit_cost double, unit_price double") for side in ("old", "new"))
    panel = spark.createDataFrame([(s, date(2025, 9, 30), 1, 1, 20, 0, "c", 2, 1, 1, 1, 5.0, 9.0) for s in SKUS], PANEL)
    got = uncertainty.stress_test(old, new, calibration, schedule, panel, settings).orderBy("scenario_id").collect()
    want = brute(residuals, forecast, policies, settings, 9)
    assert len({w[0] for w in want}) > 1 and any(w[1] for w in want)
    for r, w in zip(got, want, strict=True):
        assert (r.lead_multiplier, r.clipped_cells) == w[:2]
        assert [r[f"{p}_{c}"] for p in ("old", "new") for c in ("total_demand", "total_sales", "avg_inventory", "total_cost")] == pytest.approx(list(w[2:]))


def test_bootstrap_draws_as_one_program_would(spark):
    g = np.random.default_rng(3)
    values = {p: g.uniform(1, 9, (23, 4)) for p in ("old", "new")}
    sides = {p: spark.createDataFrame([(f"k{i:02d}", *map(float, row)) for i, row in enumerate(v)], "sku_id string, total_sales double, total_demand double, avg_inventory double, total_cost double").repartition(3) for p, v in values.items()}
    rng, found = np.random.default_rng(42), []
    for _ in range(200):
        at = rng.integers(0, 23, size=23)
        o, n = values["old"][at].sum(axis=0), values["new"][at].sum(axis=0)
        found.append(((n[0] / n[1] - o[0] / o[1]) * 100, (n[2] / o[2] - 1) * 100, (n[3] / o[3] - 1) * 100))
    got = {r.metric: r for r in uncertainty.policy_bootstrap(sides["old"], sides["new"], 200, 42, "pcg64").collect()}
    for k, name in enumerate(("fill_rate_delta_pp", "inventory_change_pct", "cost_change_pct")):
        assert [got[name].ci_2_5, got[name].ci_97_5] == pytest.approx(list(np.quantile([x[k] for x in found], [0.025, 0.975])))


@pytest.mark.skipif(not {"GOLDEN_OLD", "GOLDEN_NEW"} <= set(os.environ), reason="names two CSV tables of published policy metrics")
def test_published_intervals(spark):
    """Published estimates and intervals of 2,000 draws with seed 42."""
    old, new = (spark.read.option("header", True).option("inferSchema", True).csv(os.environ[k]) for k in ("GOLDEN_OLD", "GOLDEN_NEW"))
    got = {r.metric: (r.estimate, r.ci_2_5, r.ci_97_5) for r in uncertainty.policy_bootstrap(old, new, 2000, 42, "pcg64").collect()}
    want = {"fill_rate_delta_pp": (1.628754, 0.708154, 2.676177), "inventory_change_pct": (-40.929941, -44.263649, -37.296546), "cost_change_pct": (-52.935888, -63.185778, -41.160943)}
    assert {k: [round(x, 6) for x in v] for k, v in got.items()} == {k: list(v) for k, v in want.items()}


def test_unknown_draws_are_refused():
    with pytest.raises(ValueError, match="unknown kind"):
        Settings(draws="dice")
