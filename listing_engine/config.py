"""Tunable parameters of matching and scoring."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# Scoring weights, softness, caps and tolerances of the matching model.
WEIGHTS = {"price": 0.35, "area": 0.30, "rooms": 0.20, "baths": 0.10, "operation": 0.05}
SOFTNESS = {"price": 0.15, "area": 0.15, "rooms": 0.35, "baths": 0.35}
CAPS = {"price": 0.975, "area": 0.975, "rooms": 0.975, "baths": 0.975, "operation": 0.985}

#: component -> (listing value, client lower bound, client upper bound)
RANGES = {
    "price": ("precio", "price_min_eur", "price_max_eur"),
    "area": ("m2", "area_min_m2", "area_max_m2"),
    "rooms": ("habitaciones", "rooms_min", "rooms_max"),
    "baths": ("banos", "bath_min", "bath_max"),
}

EPS = 1e-6


@dataclass(frozen=True)
class MatchConfig:
    top_n: int | None = 50
    min_score: float = 0.55
    neutral_score: float = 0.7
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    softness: dict = field(default_factory=lambda: dict(SOFTNESS))
    caps: dict = field(default_factory=lambda: dict(CAPS))
    hard_cap: float = 0.982
    coverage_min: float = 0.6
    coverage_gamma: float = 0.7
    score_gamma: float = 1.25
    jitter: float = 0.001
    jitter_hash: str = "xxhash64"  # or "md5" where another engine must agree
    # "decimal": round half up on the decimal value; "scaled": scale, add one
    # half and cut, for engines that round that way.
    rounding: str = "decimal"
    price_max_factor: float = 1.25
    price_min_factor: float = 0.25
    rooms_tolerance: int = 1
    baths_tolerance: int = 1
    # "observed": a missing bound or value still takes part unless its whole
    # column is empty; "declared": it is left out of the mean.
    null_policy: str = "observed"
    # A join group with more pairs than this, or more rows of a side, is cut into
    # rectangles for several tasks.
    group_pairs: int = 500_000
    group_rows: int = 200_000
    # The same for pairs of classes in the search for the first top_n, which are not passed on.
    class_pairs: int = 20_000_000
    # Ratio between neighbouring price bands of the range join.
    band_ratio: float = 1.5

    def zero_component_ceiling(self, name: str) -> float:
        """Highest score a pair can reach when the bounded component `name` is 0.

        A bounded component weighs at least half its nominal weight while every
        other one weighs at most its nominal weight and scores at most 1.
        """
        own = 0.5 * self.weights[name]
        rest = sum(w for k, w in self.weights.items() if k != name)
        if own <= 0:
            return 1.0
        base = math.exp(own / (own + rest) * math.log(EPS))
        return min(base**self.score_gamma, self.hard_cap) + self.jitter + 1e-6

    def prunable(self, name: str) -> bool:
        """True when a pair with a zero `name` component can never be a match."""
        return self.zero_component_ceiling(name) < self.min_score
