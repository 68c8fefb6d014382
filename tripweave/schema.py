"""Table schemas and column checks."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, D, L, I, TS = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])


LATLON = _struct(("latitude", D), ("longitude", D))

# Columns of the trips table, in order.
TRIP_COLUMNS = (
    "VIN",
    "trip_id",
    "StartTrip",
    "EndTrip",
    "Trajectory",
    "AltitudeTrajectory",
    "start_latitude",
    "start_longitude",
    "start_altitude_m",
    "end_latitude",
    "end_longitude",
    "end_altitude_m",
    "duration_seconds",
    "duration_minutes",
    "distance_m",
    "distance_km",
    "straight_line_distance_m",
    "average_speed_kmh",
    "max_segment_speed_kmh",
    "point_count",
    "quality_status",
    "quality_flags",
    "trajectory_timestamp_method",
)

TRIPS = _struct(
    ("VIN", S),
    ("trip_id", S),
    ("StartTrip", TS),
    ("EndTrip", TS),
    ("Trajectory", T.ArrayType(LATLON)),
    ("AltitudeTrajectory", T.ArrayType(D)),
    *[(c, D) for c in TRIP_COLUMNS[6:19]],
    ("point_count", I),
    ("quality_status", S),
    ("quality_flags", T.ArrayType(S)),
    ("trajectory_timestamp_method", S),
    ("fuel", S),
    ("hyb", S),
    ("model", S),
)

# What the sample and scenario steps need from a trips table.
TRIPS_NEEDED = (
    "VIN",
    "trip_id",
    "StartTrip",
    "EndTrip",
    "Trajectory",
    "end_latitude",
    "end_longitude",
)

# Fields of a scenario request.
REQUESTS = _struct(
    ("vin", S),
    ("reference_trip_id", S),
    ("departure_time", S),
    ("origin_latitude", D),
    ("origin_longitude", D),
    ("prefix_fraction", D),
    ("prefix_points", T.ArrayType(T.ArrayType(D))),
    ("history_trip_ids", T.ArrayType(S)),
    ("history_limit", I),
    ("top_k", I),
)

# The model's input columns, in model order, each with the input of a request
# that it is made from.
FEATURE_INPUTS = {
    "origin_latitude": "origin",
    "origin_longitude": "origin",
    "hour_sin": "departure_time",
    "hour_cos": "departure_time",
    "weekday_sin": "departure_time",
    "weekday_cos": "departure_time",
    "month_sin": "departure_time",
    "month_cos": "departure_time",
    "weekend": "departure_time",
    "prefix_fraction": "trajectory_prefix",
    "prefix_last_latitude": "trajectory_prefix",
    "prefix_last_longitude": "trajectory_prefix",
    "prefix_displacement_km": "trajectory_prefix",
    "prefix_path_km": "trajectory_prefix",
    "prefix_bearing_sin": "trajectory_prefix",
    "prefix_bearing_cos": "trajectory_prefix",
    "history_count": "history",
    "last_destination_latitude": "history",
    "last_destination_longitude": "history",
    "mean_destination_latitude": "history",
    "mean_destination_longitude": "history",
}
FEATURES = tuple(FEATURE_INPUTS)


def require_columns(df: DataFrame, needed: Iterable[str], what: str) -> None:
    """Fail while planning, before any job runs, when columns are absent."""
    absent = sorted(set(needed) - set(df.columns))
    if absent:
        raise ValueError(f"{what} lacks required columns: {absent}")
