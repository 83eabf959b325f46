"""Column roles and operator settings.

Every operator takes a ``Roles`` value, so a table whose columns are named otherwise needs no renaming step. ``by`` holds
the columns that separate independent markets; all totals, ranks and limits are computed inside them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Roles:
    id: str = "id"
    name: str = "name"
    year: str = "year"
    value: str = "value"
    type: str = "type"
    by: tuple[str, ...] = ("market",)

    def with_(self, **changes) -> "Roles":
        return replace(self, **changes)

    @property
    def entity(self) -> list[str]:
        """Key of one entity: bounded history, so windows over it hold one row per period."""
        return [*self.by, self.id]

    @property
    def period(self) -> list[str]:
        """Key of one market-year: unbounded in entities, so it is aggregated, never windowed."""
        return [*self.by, self.year]


DEFAULT = Roles()


def setting(config: dict, path: str, default=None):
    """The value at a dotted path of a nested configuration, or ``default`` where a part of the path is missing."""
    value = config
    for part in path.split("."):
        if not isinstance(value, dict) or part not in value:
            return default
        value = value[part]
    return value


def with_setting(config: dict, path: str, value) -> dict:
    """A copy of the configuration with the value set at a dotted path; levels that are missing, or are no level, are made."""
    first, _, rest = path.partition(".")
    inner = config.get(first)
    return {**config, first: with_setting(inner if isinstance(inner, dict) else {}, rest, value) if rest else value}


def roles_from(config: dict, source: str) -> Roles:
    """Roles of a table whose columns are named by ``column_mapping.<source>`` (role to column); ``by`` may be one name or a list."""
    named = setting(config, f"column_mapping.{source}", {})
    known = {r: named[r] for r in ("id", "name", "year", "value", "type") if r in named}
    by = named.get("by")
    return DEFAULT.with_(**known, **({} if by is None else {"by": (by,) if isinstance(by, str) else tuple(by)}))


# Growth multiplier bounds by phase, and their adjustment by tier.
PHASE_BOUNDS = {
    "emerging": (0.01, 50.0),
    "growth": (0.05, 20.0),
    "mature": (0.5, 5.0),
    "declining": (0.1, 2.0),
}
DEFAULT_BOUNDS = (0.1, 10.0)
TIER_BOUND_FACTORS = {1: (1.5, 0.7), 2: (1.2, 0.9), 3: (1.0, 1.0), 4: (0.8, 1.2)}

# Smoothing by tier as (window, highest growth %, lowest growth %, long-run growth %).
SMOOTHING_BY_TIER = {1: (3, 35.0, -15.0, 15.0), 2: (3, 40.0, -20.0, 20.0), 3: (5, 45.0, -25.0, 25.0)}
SMOOTHING_OTHER = (4, 40.0, -20.0, 25.0)


@dataclass(frozen=True)
class DistributionSettings:
    tier_thresholds: tuple[float, ...] = (5.0, 1.0, 0.1)
    tier_change_caps: tuple[float, ...] = (0.2, 0.3, 0.5)
    damping_floor: float | None = 0.0
    zero_policy: str = "skip"
    max_growth_rate: float | None = None
    min_growth_rate: float | None = None
    scale_limits_by_size: bool = True
    min_market_share: float = 0.001
    start_year: int | None = None
    smooth: bool = True
    tolerance: float = 0.001


@dataclass(frozen=True)
class HarmonizeSettings:
    method: str = "adaptive"
    boundary: str = "strict"
    strength: float = 0.5
    transition_zone: int = 2
    sensitivity: float = 0.6
    min_prominence: float = 0.2
    target_growth: dict = field(default_factory=lambda: {0: 15.0, 1: 12.0, 2: 18.0, 3: 25.0})
    tier_strength: dict = field(default_factory=lambda: {1: 0.4, 2: 0.5, 3: 0.6})


@dataclass(frozen=True)
class CalibrationSettings:
    periods: tuple[int, ...] = (1, 3, 5)
    bias_gate: float = 10.0
    bias_share: float = 0.5
    mape_gate: float = 30.0
    top_entities: int = 10
    keep_runs: int = 5
