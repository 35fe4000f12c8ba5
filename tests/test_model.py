"""Tuning, missing values and the choice between trees and baselines."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from larder.config import Settings, Windows
from larder.operators import model, tuning

W = Windows(date(2024, 3, 1), date(2024, 3, 20), date(2024, 3, 21), date(2024, 4, 19), date(2024, 4, 20), folds=2, fold_days=10, season=28)
S = Settings(windows=W)


def far(params):
    """A valley in two of eight settings."""
    return (math.log(params["stepSize"] / 0.1) ** 2) + 0.05 * (params["minInstancesPerNode"] - 20) ** 2 / 100


def test_sampler_repeats_and_keeps_to_its_ranges():
    def trials(seed, score, n=40):
        sampler, out = tuning.Sampler(model.SPACE, seed), []
        for _ in range(n // 4):
            batch = [sampler.ask() for _ in range(4)]
            for i, params in batch:
                sampler.tell(i, score(params))
                out.append(params)
        return out

    one = trials(42, far)
    assert one == trials(42, far) != trials(43, far)
    for params in one:
        for k, r in model.SPACE.items():
            assert r.low * (1 - 1e-9) <= params[k] <= r.high * (1 + 1e-9) and isinstance(params[k], int) == r.whole
    assert {p["maxDepth"] for p in trials(1, lambda p: 0.0, 80)} == {2, 3, 4, 5, 6}


def test_sampler_beats_even_draws():
    """By far over eight trials and more, on average over seeds."""
    for n, share in ((8, 1.0), (40, 0.5)):
        led, even = [], []
        for seed in range(30):
            sampler, scores = tuning.Sampler(model.SPACE, seed), []
            while len(scores) < n:
                batch = [sampler.ask() for _ in range(4)]
                for i, params in batch:
                    scores.append(far(params))
                    sampler.tell(i, scores[-1])
            led.append(min(scores))
            even.append(min(far(p) for p in model.parameter_plan(n, seed)))
        assert np.mean(led) <= share * np.mean(even)


def test_pending_trials_and_missing_scores_are_bad():
    sampler = tuning.Sampler({"x": tuning.Range(0.0, 1.0)}, 5)
    for _ in range(8):
        i, p = sampler.ask()
        sampler.tell(i, math.nan if p["x"] > 0.5 else p["x"])
    batch = [sampler.ask()[1]["x"] for _ in range(12)]
    assert np.median(batch) < 0.5 and len({round(x, 2) for x in batch}) > 6


@pytest.mark.parametrize("high_with", ["large", "small"])
def test_missing_values_go_where_they_belong(spark, high_with):
    """One split must send missing values to the side of large or of small ones, whatever the sign."""
    g, rows = np.random.default_rng(2), []
    for i in range(600):
        x = None if i % 3 == 0 else float(g.uniform(-1, 1))
        high = x is None or (x > 0.1 if high_with == "large" else x < -0.1)
        rows.append((f"s{i % 2}", date(2024, 1, 1) + timedelta(i // 2), 100.0 if high else 10.0, x, 1.0))
    table = model.prepared(spark.createDataFrame(rows, "sku_id string, date date, demand double, x double, same double"))
    fitted = model.train(table, {"maxDepth": 1, "maxIter": 1, "stepSize": 1.0}, date(2025, 1, 1))
    got = model.predict(fitted, table, date(2024, 1, 1), date(2025, 1, 1)).collect()
    assert np.mean([abs(r.forecast - r.demand) > 5 for r in got]) < 0.03
    assert [name for name, w in model.importance(fitted, table) if w > 0] == ["x"] and {n for n, _ in model.importance(fitted, table)} == {"x", "same", "sku_index"}


@pytest.fixture(scope="module")
def panel(spark):
    g = np.random.default_rng(6)
    rows = [(f"S{k}", date(2023, 10, 1) + timedelta(i), int(20 + 8 * k + 10 * (i % 7 == 2) + g.integers(0, 3))) for k in range(3) for i in range(220)]
    return pd.DataFrame(rows, columns=["sku_id", "date", "demand"]), spark.createDataFrame(rows, "sku_id string, date date, demand long")


def test_trials_and_comparison(spark, panel, monkeypatch):
    """Baselines and counts against a plain loop; trials are those of the sampler, scored on the folds."""
    monkeypatch.setattr(model, "MOST_TREES", 6)  # a small test
    monkeypatch.setattr(model, "BATCH", 2)
    frame, df = panel
    rows = model.prepared(model.create_features(df))
    found = model.trial_table(rows, S, 3).orderBy("trial").collect()
    assert [r.trial for r in found] == [1, 2, 3] and all(0 < r.wape < 1 and 1 <= r.trees <= 6 for r in found)
    assert len({r.params for r in found}) == 3
    params, score = model.tune(rows, S, 3)
    assert score == pytest.approx(min(r.wape for r in found)) and params["maxIter"] in {r.trees for r in found}
    got = {r.model: r for r in model.compare_candidates(rows, df, params, S).collect()}
    days = [date(2024, 3, 1) + timedelta(i) for i in range(20)]
    for name, ahead in (("Naive", lambda s, i: s[i - 1]), ("SeasonalNaive", lambda s, i: s[i - 28]), ("HistoricMean", lambda s, i: np.mean(s[:i]))):
        error, total, n = 0.0, 0.0, 0
        for _, own in frame.groupby("sku_id"):
            s, at = own.demand.to_numpy(float), {d: i for i, d in enumerate(own.date)}
            for d in days:
                error, total, n = error + abs(s[at[d]] - ahead(s, at[d])), total + s[at[d]], n + 1
        assert (got[name].wape, got[name].mae, got[name].n_obs) == (pytest.approx(error / total), pytest.approx(error / n), n)
    out = model.selection_forecast(rows, params, S)
    assert got["GBT"].n_obs == out.count() == 60 and {r.date for r in out.select("date").distinct().collect()} == set(days)
    first = model.predict(model.train(rows, params, days[0], S.seed), rows, days[0], days[9]).collect()
    assert {(r.sku_id, r.date): r.forecast for r in out.filter("date < '2024-03-11'").collect()} == pytest.approx({(r.sku_id, r.date): r.forecast for r in first})
