"""Expressions over decoded realtime entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: code -> name of the realtime enums ---------------------
INCREMENTALITY = {0: "FULL_DATASET", 1: "DIFFERENTIAL"}
STOP_STATUS = {0: "INCOMING_AT", 1: "STOPPED_AT", 2: "IN_TRANSIT_TO"}
CONGESTION = {
    0: "UNKNOWN_CONGESTION_LEVEL",
    1: "RUNNING_SMOOTHLY",
    2: "STOP_AND_GO",
    3: "CONGESTION",
    4: "SEVERE_CONGESTION",
}
OCCUPANCY = {
    0: "EMPTY",
    1: "MANY_SEATS_AVAILABLE",
    2: "FEW_SEATS_AVAILABLE",
    3: "STANDING_ROOM_ONLY",
    4: "CRUSHED_STANDING_ROOM_ONLY",
    5: "FULL",
    6: "NOT_ACCEPTING_PASSENGERS",
}
TRIP_SCHEDULE = {0: "SCHEDULED", 1: "ADDED", 2: "UNSCHEDULED", 3: "CANCELED", 5: "REPLACEMENT"}
STOP_SCHEDULE = {0: "SCHEDULED", 1: "SKIPPED", 2: "NO_DATA"}
CAUSE = {
    1: "UNKNOWN_CAUSE",
    2: "OTHER_CAUSE",
    3: "TECHNICAL_PROBLEM",
    4: "STRIKE",
    5: "DEMONSTRATION",
    6: "ACCIDENT",
    7: "HOLIDAY",
    8: "WEATHER",
    9: "MAINTENANCE",
    10: "CONSTRUCTION",
    11: "POLICE_ACTIVITY",
    12: "MEDICAL_EMERGENCY",
}
EFFECT = {
    1: "NO_SERVICE",
    2: "REDUCED_SERVICE",
    3: "SIGNIFICANT_DELAYS",
    4: "DETOUR",
    5: "ADDITIONAL_SERVICE",
    6: "MODIFIED_SERVICE",
    7: "OTHER_EFFECT",
    8: "UNKNOWN_EFFECT",
    9: "STOP_MOVED",
}
# --------------------------------------------------------------------------


def enum_sql(code: str, names: dict[int, str]) -> str:
    """Name of a code as SQL; unset and unknown codes are absent, no default is filled in."""
    pairs = ", ".join(f"{number}, '{name}'" for number, name in names.items())
    return f"try_element_at(map({pairs}), {code})"


def entity_type(vehicle: Column, trip_update: Column, alert: Column) -> Column:
    return (
        F.when(vehicle.isNotNull(), F.lit("VEHICLE_POSITION"))
        .when(trip_update.isNotNull(), F.lit("TRIP_UPDATE"))
        .when(alert.isNotNull(), F.lit("ALERT"))
        .otherwise(F.lit("UNKNOWN"))
    )


def entity_key(entity_id: Column, vehicle: Column, trip_update: Column, alert: Column) -> Column:
    """Partition key: the natural id where there is one, a hash prefix for alerts."""
    vehicle_id = F.coalesce(vehicle["vehicle"]["id"], entity_id)
    trip_id = F.coalesce(trip_update["trip"]["trip_id"], entity_id)
    alert_id = F.substring(F.sha2(entity_id, 256), 1, 12)
    return (
        F.when(vehicle.isNotNull(), F.concat(F.lit("vehicle."), vehicle_id))
        .when(trip_update.isNotNull(), F.concat(F.lit("trip."), trip_id))
        .when(alert.isNotNull(), F.concat(F.lit("alert."), alert_id))
        .otherwise(F.concat(F.lit("unknown."), entity_id))
    )


def kept(is_deleted: Column) -> Column:
    return ~F.coalesce(is_deleted, F.lit(False))


def preferred_text(translations: Column, language: str = "en") -> Column:
    """The text in one language, else the first text there is."""
    wanted = F.filter(translations, lambda t: t["language"] == language)
    return F.coalesce(F.get(wanted, F.lit(0))["text"], F.get(translations, F.lit(0))["text"])


def alert_active(periods: Column, at: Column) -> Column:
    """Active at POSIX second `at`: start included, end excluded, a missing bound is open.

    An alert without any period is active as long as it is in the feed.
    """
    inside = F.exists(
        periods,
        lambda p: F.coalesce(p["start"] <= at, F.lit(True))
        & F.coalesce(at < p["end"], F.lit(True)),
    )
    return F.coalesce(F.size(periods) <= 0, F.lit(True)) | F.coalesce(inside, F.lit(True))
