"""Record types of decoded realtime entities: with enum codes as read, with names as published."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, F32, F64, B = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.FloatType(),
    T.DoubleType(),
    T.BooleanType(),
)


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def entity_schema(enum: T.DataType = I) -> T.StructType:
    """One entity; `enum` is the type of enum fields (codes as integers, names as strings)."""
    trip = _record(
        trip_id=S, route_id=S, direction_id=I, start_time=S, start_date=S,
        schedule_relationship=enum,
    )
    vehicle = _record(id=S, label=S, license_plate=S)
    position = _record(latitude=F32, longitude=F32, bearing=F32, odometer=F64, speed=F32)
    event = _record(delay=I, time=L, uncertainty=I)
    update = _record(
        stop_sequence=I, stop_id=S, arrival=event, departure=event, schedule_relationship=enum
    )
    texts = _record(translation=T.ArrayType(_record(text=S, language=S)))
    return _record(
        id=S,
        is_deleted=B,
        trip_update=_record(
            trip=trip, vehicle=vehicle, stop_time_update=T.ArrayType(update), timestamp=L, delay=I
        ),
        vehicle=_record(
            trip=trip, vehicle=vehicle, position=position, current_stop_sequence=I, stop_id=S,
            current_status=enum, timestamp=L, congestion_level=enum, occupancy_status=enum,
        ),
        alert=_record(
            active_period=T.ArrayType(_record(start=L, end=L)),
            informed_entity=T.ArrayType(
                _record(agency_id=S, route_id=S, route_type=I, trip=trip, stop_id=S)
            ),
            cause=enum,
            effect=enum,
            url=texts,
            header_text=texts,
            description_text=texts,
        ),
    )


def header_schema(enum: T.DataType = I) -> T.StructType:
    return _record(gtfs_realtime_version=S, incrementality=enum, timestamp=L)


# one entity per row with the header of its snapshot repeated
FEED_SCHEMA = T.StructType(
    [T.StructField("header", header_schema()), *entity_schema().fields]
)
