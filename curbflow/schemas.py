"""Canonical columns of every stage."""

from __future__ import annotations

PINGS = "vehicle_id string, dt_utc timestamp, dt_local timestamp_ntz, lat double, lon double, speed_mph double"
ENRICHED = PINGS + ", route_id string, apn string, in_landfill boolean, at_depot boolean"
TIMELINE = (
    "vehicle_id string, segment_id int, segment_type string, load_number int, route_id string, start_dt_local timestamp_ntz, "
    "end_dt_local timestamp_ntz, duration_seconds double, miles double, n_pings bigint"
)
VIOLATIONS = "vehicle_id string, segment_id int, violation_type string, severity string, description string"
PARCELS = "APN string, UNITQTY double, route_ref string, route_org string, route_rec string, min_lon double, min_lat double, max_lon double, max_lat double, geom_wkb binary"
VEHICLE_DAYS = "day string, vehicle_id string, rows bigint, min_local timestamp_ntz, max_local timestamp_ntz, lat_min double, lat_max double, lon_min double, lon_max double, file_path string"
ROUTE_BOXES = "route_id string, rte_min_lon double, rte_min_lat double, rte_max_lon double, rte_max_lat double"
WEEKLY = ("vehicle", "dow", "hour", "regularity", "visits", "weeks_present")
PATTERNS = (
    ["APN", "route_ref", "route_org", "route_rec"]
    + [f"weekly{n}_{c}" for n in (1, 2) for c in WEEKLY]
    + [f"biweekly_{c}" for c in ("vehicle", "dow", "hour", "weeks_present", "regularity", "visit_days", "med_gap", "pct14", "phase_share", "score", "even_hits", "odd_hits")]
    + ["analysis_min_day", "analysis_max_day", "analysis_total_weeks"]
)


def names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]
