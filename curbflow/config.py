"""Tunable parameters of the engine. The defaults are fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass

#: Feet in a degree, for tolerances that are given in feet and applied to degrees.
FEET_PER_DEGREE = 364_320.0
#: Degrees by which route boxes are widened.
ROUTE_EDGE_DEGREES = 100.0 / 335_000.0
#: Time zone of local wall clocks.
LOCAL_ZONE = "US/Pacific"


@dataclass(frozen=True)
class EngineConfig:
    """Enrichment and timeline. landfill_buffer_ft, batch_size and output_crs are accepted but have no effect here."""

    parcel_edge_ft: float = 25.0
    slow_mph_max: float = 12.0
    depot_radius_ft: float = 250.0
    landfill_buffer_ft: float = 50.0
    mileage_inflation_pct: float = 0.0
    batch_size: int = 200_000
    output_crs: str = "EPSG:4326"


@dataclass(frozen=True)
class PatternConfig:
    """Service-pattern detection."""

    stop_bin_minutes: int = 15
    weekly_min_regularity: float = 0.25
    weekly_min_weeks: int = 6
    weekly_min_weeks_ratio: float = 0.25
    biweekly_gap_days: int = 14
    biweekly_gap_tolerance: int = 4
    biweekly_min_visits: int = 6
    biweekly_min_weeks: int = 6
    biweekly_min_weeks_ratio: float = 0.25
    biweekly_min_phase_share: float = 0.72
    biweekly_min_score: float = 0.58
    biweekly_max_regularity: float = 0.80
    weight_phase: float = 0.45
    weight_gap: float = 0.35
    weight_centre: float = 0.20

    def weeks(self, total_weeks: int) -> tuple[int, int]:
        """Weeks that weekly and biweekly candidates need in a window of so many: a floor or a share, rounded half to even."""
        weekly = max(self.weekly_min_weeks, round(self.weekly_min_weeks_ratio * total_weeks))
        return weekly, max(self.biweekly_min_weeks, round(self.biweekly_min_weeks_ratio * total_weeks))


@dataclass(frozen=True)
class FacilitiesConfig:
    """Names and buffers of facility and route layers."""

    name_col: str = "Name"
    depot_name: str = "Central Yard"
    landfill_buffer_ft: float = 50.0
    manual_buffer_ft: float = 150.0
    crs: str | None = None
