"""Rule values and parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values ---------------------------------------------------------
# Name prefix of the default zone (case-sensitive).
ZONE_PREFIX = "Zürich"

# Columns a table must have, and which must not hold nulls.
REQUIRED_COLUMNS = {
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon"),
    "routes": ("route_id",),
    "trips": ("trip_id", "route_id"),
    "stop_times": ("trip_id", "stop_id", "stop_sequence"),
}

# Inclusive row-count bounds of one nationwide snapshot.
ROW_BOUNDS = {
    "stops": (10_000, 1_000_000),
    "routes": (500, 50_000),
    "trips": (100_000, 10_000_000),
    "stop_times": (1_000_000, 100_000_000),
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = (
    ("trips", "route_id", "routes", "route_id"),
    ("stop_times", "trip_id", "trips", "trip_id"),
    ("stop_times", "stop_id", "stops", "stop_id"),
)

# Archive members that must exist and hold bytes, in the order they are reported.
REQUIRED_MEMBERS = ("stops.txt", "trips.txt", "routes.txt", "stop_times.txt", "calendar_dates.txt")
# Members that may be missing but must not be empty.
OPTIONAL_MEMBERS = ("agency.txt", "calendar.txt")

# Versions older than this are not processed unless the caller says otherwise.
DEFAULT_CUTOFF = "20260101"

# Zone centre and earth radius of the distance exploration.
ZONE_CENTRE = (47.378177, 8.540192)
EARTH_RADIUS_KM = 6371.0
RADII_KM = (5, 10, 15, 20, 25)

# Ledger tables and how many days each is kept.
RETENTION_DAYS = {
    "transit.snapshots.raw": 7,
    "transit.snapshots.normalized": 7,
    "transit.state.deltas": 7,
    "transit.metrics.operational": 30,
}
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class QualityRules:
    """What `operators.rules` checks; override the parts that do not fit your feed."""

    required: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(REQUIRED_COLUMNS))
    bounds: dict[str, tuple[int, int]] = field(default_factory=lambda: dict(ROW_BOUNDS))
    foreign_keys: tuple[tuple[str, str, str, str], ...] = FOREIGN_KEYS


class MissingInput(ValueError):
    """A table or column an operator cannot do without is absent."""


def need(tables: dict, name: str, *columns: str):
    """The table `name` (a DataFrame or its columns), or a `MissingInput` that says what is absent."""
    if name not in tables:
        raise MissingInput(f"table {name!r} is missing; present: {sorted(tables)}")
    have = getattr(tables[name], "columns", tables[name])
    absent = [c for c in columns if c not in have]
    if absent:
        raise MissingInput(f"table {name!r} lacks column(s) {absent}")
    return tables[name]
