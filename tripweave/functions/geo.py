"""Geographic Column expressions. They also work inside array lambdas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius.
EARTH_RADIUS_M = 6371008.8
EARTH_RADIUS_KM = 6371.0088


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = F.radians(lon2) - F.radians(lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), F.lit(2.0)
    )
    # Rounding can lift h above 1 at antipodes; asin then gives NaN. (least() would
    # clip too, but it skips nulls and turns an unknown point into a distance.)
    return F.nanvl(F.asin(F.sqrt(h)), F.lit(math.pi / 2))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.lit(2.0 * EARTH_RADIUS_M) * _half_chord(lat1, lon1, lat2, lon2)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.lit(2.0 * EARTH_RADIUS_KM) * _half_chord(lat1, lon1, lat2, lon2)


def metres_between(a: Column, b: Column) -> Column:
    """Distance between two structs with ``latitude`` and ``longitude``."""
    return haversine_m(a["latitude"], a["longitude"], b["latitude"], b["longitude"])


def km_between(a: Column, b: Column) -> Column:
    return haversine_km(a["latitude"], a["longitude"], b["latitude"], b["longitude"])


def bearing_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 <= b < 360."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dl = F.radians(lon2) - F.radians(lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def bearing_between(a: Column, b: Column) -> Column:
    return bearing_degrees(a["latitude"], a["longitude"], b["latitude"], b["longitude"])


def in_bounds(lat: Column, lon: Column) -> Column:
    """True only for a finite coordinate on the globe; never null."""
    # NaN sorts above every number in Spark, so the upper bounds reject it.
    ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.coalesce(ok, F.lit(False))


def grid_row(lat: Column, size: float) -> Column:
    return F.floor((lat + 90.0) / F.lit(size))


def grid_column(lon: Column, size: float) -> Column:
    return F.floor((lon + 180.0) / F.lit(size))


def grid_cell(lat: Column, lon: Column, size: float) -> Column:
    """Cell id ``g{row}:{column}``."""
    return F.concat(
        F.lit("g"),
        grid_row(lat, size).cast("string"),
        F.lit(":"),
        grid_column(lon, size).cast("string"),
    )


def grid_centre(cell: Column, size: float) -> Column:
    """Struct (latitude, longitude) of a cell's centre."""
    parts = F.split(F.substring(cell, 2, 64), ":")
    return F.struct(
        (parts[0].cast("bigint") * F.lit(size) - 90.0 + F.lit(size / 2)).alias("latitude"),
        (parts[1].cast("bigint") * F.lit(size) - 180.0 + F.lit(size / 2)).alias("longitude"),
    )


def grid_polygon(cell: Column, size: float) -> Column:
    """Closed ring of five [lon, lat] corners, counter-clockwise from south-west."""
    c = grid_centre(cell, size)
    west, east = c["longitude"] - size / 2, c["longitude"] + size / 2
    south, north = c["latitude"] - size / 2, c["latitude"] + size / 2
    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    return F.array(*[F.array(x, y) for x, y in corners])


def with_error_km(df):
    """Append ``error_km``: predicted against actual destination."""
    return df.withColumn(
        "error_km",
        haversine_km(
            F.col("actual_latitude"),
            F.col("actual_longitude"),
            F.col("predicted_latitude"),
            F.col("predicted_longitude"),
        ),
    )
