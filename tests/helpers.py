"""Small telemetry tables and plain-Python counterparts of the core rules."""

import json
import math
from datetime import datetime, timedelta, timezone

from tripweave.config import BuildSettings

B = BuildSettings()
T0 = datetime(2026, 2, 13, 7, 0, 0, tzinfo=timezone.utc)
RAW_SCHEMA = (
    "vin string, triggerOrContext string, name string, scalarValue string, timeSeriesValue string, "
    "vehicleCollectionTime string, fuel string, model string"
)
SIGNALS = (B.latitude_signal, B.longitude_signal, B.altitude_signal)
DEGREE_M = math.pi * 6371008.8 / 180


def at(seconds):
    return (T0 + timedelta(seconds=seconds)).isoformat()


def trigger(vin, name, t, lat, lon, alt=70.0, fuel="electric", model="m"):
    values = (lat, lon, alt)
    return [
        (vin, name, s, str(v), None, at(t), fuel, model) for s, v in zip(SIGNALS, values) if v is not None
    ]


def start(vin, t, lat=48.8, lon=2.2, **kw):
    return trigger(vin, B.start_trigger, t, lat, lon, **kw)


def end(vin, t, lat=48.81, lon=2.208, **kw):
    return trigger(vin, B.end_trigger, t, lat, lon, **kw)


def batch(vin, t, lats, lons, alts=None):
    arrays = (lats, lons, alts)
    return [
        (vin, B.periodic_trigger, s, None, a if isinstance(a, str) else json.dumps(a), at(t), "electric", "m")
        for s, a in zip(SIGNALS, arrays)
        if a is not None
    ]


def haversine(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    dl = math.radians(b[1]) - math.radians(a[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))


def kept_points(points):
    """The repeat rule, one point after the other."""
    out = []
    for p in points:
        if not out or haversine(out[-1], p) >= 0.01:
            out.append(p)
    return out
