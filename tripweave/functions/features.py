"""The model's input columns, shared by training samples and scenarios."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import bearing_between, km_between
from .paths import first_of, last_of, path_km


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi / period) * value
    return F.sin(angle), F.cos(angle)


def calendar_features(at: Column) -> dict[str, Column]:
    """Sine and cosine of hour, weekday (Monday 0) and month, and the weekend flag."""
    hour = F.hour(at) + F.minute(at) / 60.0
    day = F.weekday(at)
    out: dict[str, Column] = {}
    for name, value, period in (("hour", hour, 24.0), ("weekday", day, 7.0), ("month", F.month(at) - 1, 12.0)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(value, period)
    out["weekend"] = (day >= 5).cast("double")
    return out


def prefix_features(prefix: Column, fraction: Column) -> dict[str, Column]:
    origin, last = first_of(prefix), last_of(prefix)
    bearing = F.radians(F.when(F.size(prefix) > 1, bearing_between(origin, last)).otherwise(F.lit(0.0)))
    return {
        "origin_latitude": origin["latitude"],
        "origin_longitude": origin["longitude"],
        "prefix_fraction": fraction.cast("double"),
        "prefix_last_latitude": last["latitude"],
        "prefix_last_longitude": last["longitude"],
        "prefix_displacement_km": km_between(origin, last),
        "prefix_path_km": path_km(prefix),
        "prefix_bearing_sin": F.sin(bearing),
        "prefix_bearing_cos": F.cos(bearing),
    }


def history_features(history: Column, origin: Column) -> dict[str, Column]:
    """Count, last and mean earlier destination; the origin stands in for none."""
    n = F.size(history)
    last = last_of(history)

    def mean(part: str) -> Column:
        summed = F.aggregate(history, F.lit(0.0), lambda a, h: a + h[part])
        return F.when(n > 0, summed / n).otherwise(origin[part])

    return {
        "history_count": n.cast("double"),
        "last_destination_latitude": F.coalesce(last["latitude"], origin["latitude"]),
        "last_destination_longitude": F.coalesce(last["longitude"], origin["longitude"]),
        "mean_destination_latitude": mean("latitude"),
        "mean_destination_longitude": mean("longitude"),
    }


def feature_columns(at: Column, prefix: Column, fraction: Column, history: Column) -> dict[str, Column]:
    """All features from what is known at prediction time."""
    return {
        **calendar_features(at),
        **prefix_features(prefix, fraction),
        **history_features(history, first_of(prefix)),
    }
