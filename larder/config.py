"""Settings of a run: time windows, service targets, costs and grids."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from datetime import date


@dataclass(frozen=True)
class Windows:
    """Inclusive day windows.  Models are chosen in the first, policies tuned in the
    second, and both judged in the last, which no choice may see."""

    # fixed values: the days unless others are given
    selection_start: date = date(2025, 1, 1)
    selection_end: date = date(2025, 5, 30)
    calibration_start: date = date(2025, 5, 31)
    calibration_end: date = date(2025, 9, 30)
    final_start: date = date(2025, 10, 1)
    folds: int = 5
    fold_days: int = 30
    season: int = 365

    def __post_init__(self):
        order = [self.selection_start, self.selection_end, self.calibration_start, self.calibration_end, self.final_start]
        if not (order[0] <= order[1] < order[2] <= order[3] < order[4]):
            raise ValueError("windows must follow one another: selection, calibration, final")

    @property
    def selection_days(self) -> int:
        return self.folds * self.fold_days


@dataclass(frozen=True)
class Settings:
    windows: Windows = field(default_factory=Windows)
    # fixed values from here on: service targets in percent, by class and by intervention, and fill floors
    service_by_class: dict[str, float] = field(default_factory=lambda: {"AX": 99, "AY": 97, "AZ": 90, "CX": 90, "BZ": 85, "CZ": 80})
    service_by_intervention: dict[str, float] = field(default_factory=lambda: {"protect_strategic_value": 97, "correct_understock": 90, "reduce_overstock": 85})
    floor_by_intervention: dict[str, float] = field(default_factory=lambda: {"protect_strategic_value": 0.97, "correct_understock": 0.95, "reduce_overstock": 0.98})
    # costs, and the grids of policies, prices and stress
    ordering_cost: float = 50.0
    holding_rate: float = 0.25
    shortage_multiplier: float = 1.0
    quantity_multipliers: tuple[float, ...] = (0.5, 0.75, 1.0, 1.25, 1.5)
    reorder_quantiles: tuple[float, ...] = (0.75, 0.8, 0.85, 0.9, 0.95, 0.97, 0.99)
    holding_rates: tuple[float, ...] = (0.15, 0.25, 0.35)
    ordering_costs: tuple[float, ...] = (25.0, 50.0, 100.0)
    shortage_multipliers: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0)
    scenarios: int = 100
    seed: int = 42
    #: ``pcg64``: numpy's sequence, as a program would draw it in order; ``hash``: draws that SQL can make too
    draws: str = "pcg64"
    block_days: int = 7
    lead_multipliers: tuple[float, ...] = (0.8, 1.0, 1.2, 1.5)
    lead_probabilities: tuple[float, ...] = (0.1, 0.5, 0.3, 0.1)
    # thresholds of classes and scope
    value_basis: str = "gross_margin"
    a_share: float = 0.80
    b_share: float = 0.95
    x_quantile: float = 0.25
    z_quantile: float = 0.75
    strategic_share: float = 0.25
    understock_fill: float = 0.95
    overstock_fill: float = 0.99
    overstock_quantile: float = 0.75

    def __post_init__(self):
        if self.draws not in ("pcg64", "hash"):
            raise ValueError(f"unknown kind of draws: {self.draws!r}")


#: The windows of the panel that the standard tables give.
STANDARD = Settings(
    windows=Windows(date(2000, 1, 1), date(2000, 5, 29), date(2000, 5, 30), date(2000, 9, 30), date(2000, 10, 1)),
    draws="hash",
)


def from_json(path: str) -> Settings:
    """Settings from a JSON object whose keys are those of ``Settings``; ``windows`` is an object of dates."""
    with open(path) as file:
        found = json.load(file)
    windows = {k: date.fromisoformat(v) if isinstance(v, str) else v for k, v in found.pop("windows", {}).items()}
    known = {f.name for f in fields(Settings)}
    if strange := set(found) - known:
        raise ValueError(f"unknown settings: {sorted(strange)}")
    return Settings(windows=Windows(**windows), **{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})
