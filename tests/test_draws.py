"""Stretches drawn by many tasks against one generator that draws in order."""

import numpy as np
import pytest

from larder.functions import draws


@pytest.mark.parametrize("n", [1, 2, 7, 109, 128, 3_000_000_000])
def test_stretches_of_bounded_integers(n):
    want = np.random.default_rng(5).integers(0, n, size=400)
    got, refused = draws.stretch(5, 0, np.full(400, n), 0)
    assert (got == want).all() and (refused > 50) == (n > 2**31)
    first, skipped = draws.stretch(5, 0, np.full(150, n), 0)
    assert (draws.stretch(5, 150 + skipped, np.full(250, n), 0)[0] == want[150:]).all() and (first == want[:150]).all()


@pytest.mark.parametrize(("n", "times"), [(1, 3), (4, 20), (109, 30), (700, 3), (5, 0)])
def test_resampled_places(spark, n, times):
    g = np.random.default_rng(42)
    want = sorted((d, int(x)) for d in range(times) for x in g.integers(0, n, size=n))
    assert sorted(tuple(r) for r in draws.resampled(spark, n, times, 42, size=128).collect()) == want


@pytest.mark.parametrize("rows", [4096, 3])
@pytest.mark.parametrize("bounds", [[117] * 8, [117, 1, 3, 1, 60, 2, 117, 5], [1] * 8, [3_000_000_000, 117, 2_500_000_000, 1, 4_000_000_000, 7, 3_000_000_000, 9]])
def test_a_loop_over_scenarios(spark, rows, bounds):
    """Odd numbers of draws leave half a word to the next scenario; refused halves shift all later draws."""
    counts, scenarios = [3, 1, 2, 4, 1, 2, 3, 1], 7
    g, want, numbers = np.random.default_rng(11), {f"k{i}": [] for i in range(8)}, []
    for _ in range(scenarios):
        numbers.append(g.random())
        for i, (bound, n) in enumerate(zip(bounds, counts, strict=True)):
            want[f"k{i}"].append([int(g.integers(0, bound)) for _ in range(n)])
    items = spark.createDataFrame([(f"k{i}", b, n) for i, (b, n) in enumerate(zip(bounds, counts, strict=True))], "sku string, bound long, n int").repartition(5)
    got, units = draws.scenario_draws(items, "sku", scenarios, 11, rows)
    assert {r.sku: [list(x) for x in r.drawn] for r in got.collect()} == want and units.tolist() == numbers


def test_nothing_to_draw_and_too_much(spark):
    got, units = draws.scenario_draws(spark.createDataFrame([], "sku string, bound long, n int"), "sku", 2, 3)
    assert got.collect() == [] and units.tolist() == np.random.default_rng(3).random(2).tolist()
    with pytest.raises(ValueError, match="places"):
        draws.resampled(spark, 2**32, 1, 1)
