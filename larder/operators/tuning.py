"""A tree-structured Parzen sampler: settings are drawn where good trials lie dense and bad ones don't."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Trials that are drawn evenly before any score counts.
STARTUP = 4
#: Share of the finished trials that are good, and candidates drawn for each setting.
GOOD_SHARE, CANDIDATES = 0.25, 24


@dataclass(frozen=True)
class Range:
    """Values of one setting, both ends included; ``log`` spreads them by their logarithm."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def value(self, u: float) -> float:
        """The value at a place from 0 to 1."""
        if self.whole:
            return int(min(math.floor(self.low + u * (self.high - self.low + 1)), self.high))
        return self.low * (self.high / self.low) ** u if self.log else self.low + u * (self.high - self.low)


@dataclass
class Density:
    """Normal kernels on [0, 1] about the places of trials, and a wide one in the middle for all others."""

    centres: np.ndarray
    widths: np.ndarray

    @classmethod
    def of(cls, places: list[float]) -> Density:
        centres = np.sort(np.r_[places, 0.5])
        edges = np.r_[0.0, centres, 1.0]
        widths = np.clip(np.maximum(np.diff(edges)[:-1], np.diff(edges)[1:]), 1 / min(100, len(centres) + 1), 1.0)
        widths[np.searchsorted(centres, 0.5)] = 1.0
        return cls(centres, widths)

    def draw(self, g: np.random.Generator, n: int) -> np.ndarray:
        """Places by a kernel each; those outside are drawn again."""
        out = np.full(n, -1.0)
        while (wrong := (out < 0) | (out > 1)).any():
            k = g.integers(0, len(self.centres), wrong.sum())
            out[wrong] = g.normal(self.centres[k], self.widths[k])
        return out

    def log(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.centres) / self.widths
        inside = np.array([0.5 * (math.erf((1 - c) / w / math.sqrt(2)) - math.erf(-c / w / math.sqrt(2))) for c, w in zip(self.centres, self.widths, strict=True)])
        return np.log((np.exp(-0.5 * z * z) / (self.widths * inside)).mean(axis=1))


class Sampler:
    """Asked for settings and told their scores, the least of which is best; a seed gives the same trials again.

    Settings that were asked for and have no score yet count as bad, so those of one
    batch don't gather in one place.
    """

    def __init__(self, space: dict[str, Range], seed: int):
        self.space, self.rng = space, np.random.default_rng(seed)
        self.places: list[dict[str, float]] = []
        self.scores: list[float | None] = []

    def ask(self) -> tuple[int, dict]:
        """(number of the trial, its settings)."""
        done = [i for i, s in enumerate(self.scores) if s is not None]
        if len(done) < STARTUP:
            place = {k: float(self.rng.uniform()) for k in self.space}
        else:
            best = sorted(done, key=lambda i: (self.scores[i], i))
            good = best[: max(1, math.ceil(GOOD_SHARE * len(best)))]
            place = {}
            for k in self.space:
                near = Density.of([self.places[i][k] for i in good])
                far = Density.of([p[k] for i, p in enumerate(self.places) if i not in good])
                x = near.draw(self.rng, CANDIDATES)
                place[k] = float(x[np.argmax(near.log(x) - far.log(x))])
        self.places.append(place)
        self.scores.append(None)
        return len(self.places) - 1, {k: r.value(place[k]) for k, r in self.space.items()}

    def tell(self, trial: int, score: float) -> None:
        self.scores[trial] = float(score) if score == score else math.inf
