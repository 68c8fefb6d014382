"""Cleaned rows to one row per (vin, timestamp, trigger)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BuildSettings
from .clean import ROW_ID

# Order of kinds at one instant: a start opens, a batch belongs to what is open,
# an end closes. Makes start <= batch <= end inclusive on both sides.
START, BATCH, END = 0, 1, 2

SHORT = ("lat", "lon", "alt")

# Error texts that appear in rejection details.
LACKS_ARRAY = "trajectory batch lacks latitude or longitude array"
UNALIGNED = "unaligned trajectory array lengths: ["


def position(ts_us: Column, kind: Column) -> Column:
    """One long that orders a vehicle's timeline by (time, kind)."""
    return ts_us * 4 + kind


def mark_time(mark: Column) -> Column:
    return F.shiftright(mark, 2)


def mark_kind(mark: Column) -> Column:
    return mark.bitwiseAND(F.lit(3))


def _present_metadata(data: DataFrame, cfg: BuildSettings) -> list[str]:
    return [c for c in cfg.metadata_columns if c in data.columns]


def extract_events(data: DataFrame, cfg: BuildSettings) -> DataFrame:
    """Start events, end events and trajectory batches in one aggregation.

    Columns: vin, ts_us, kind, pos; lat/lon/alt (last number by row id) and
    duplicate_signals for triggers; points, error, truncated for batches;
    source_row_ids for both; source_rows (rows aggregated); one ``meta_<c>`` struct per
    metadata column: the first value in canonical order and whether several exist.
    """
    signals = dict(zip(SHORT, (cfg.latitude_signal, cfg.longitude_signal, cfg.altitude_signal)))
    kind = (
        F.when(F.col("trigger") == cfg.start_trigger, START)
        .when(F.col("trigger") == cfg.periodic_trigger, BATCH)
        .otherwise(END)
    )
    base = data.withColumn("kind", kind).withColumn("ts_us", F.unix_micros("timestamp"))
    aggs: list[Column] = [F.count(F.lit(1)).alias("source_rows")]
    for short, name in signals.items():
        here = F.col("signal") == name
        numbered = here & F.col("scalar").isNotNull() & (F.col("kind") != BATCH)
        listed = here & F.col("series_values").isNotNull() & (F.col("kind") == BATCH)
        latest = F.when(numbered | listed, F.col(ROW_ID))
        aggs += [
            F.max_by(F.when(numbered, F.col("scalar")), F.when(numbered, F.col(ROW_ID))).alias(short),
            F.max_by(F.when(listed, F.col("series_values")), F.when(listed, F.col(ROW_ID))).alias(f"{short}_values"),
            F.max(latest).alias(f"{short}_row"),
            F.count_if(here).alias(f"{short}_count"),
        ]
    for c in _present_metadata(data, cfg):
        value = F.col(c).cast("string")
        at = F.struct(F.col("trigger"), F.col("signal"), F.col(ROW_ID))
        aggs += [
            F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), at)).alias(f"first_{c}"),
            F.min(F.when(value.isNotNull(), at)).alias(f"at_{c}"),
            F.min(value).alias(f"low_{c}"),
            F.max(value).alias(f"high_{c}"),
        ]
    grouped = base.groupBy("vin", "ts_us", "kind").agg(*aggs)

    lat, lon, alt = (F.col(f"{s}_values") for s in SHORT)
    is_batch = F.col("kind") == BATCH
    lengths = F.array_compact(
        F.array(F.size(lat), F.size(lon), F.when(alt.isNotNull(), F.size(alt)))
    )
    aligned = F.array_min(lengths) == F.array_max(lengths)
    lacking = lat.isNull() | lon.isNull()
    reject = F.lit(cfg.length_policy == "reject")
    error = F.when(
        is_batch,
        F.when(lacking, LACKS_ARRAY).when(
            reject & ~aligned,
            F.concat(F.lit(UNALIGNED), F.array_join(lengths.cast("array<string>"), ", "), F.lit("]")),
        ),
    )
    zipped = F.transform(
        F.slice(lat, F.lit(1), F.array_min(lengths)),
        lambda v, i: F.struct(
            v.alias("latitude"), F.get(lon, i).alias("longitude"), F.get(alt, i).alias("altitude")
        ),
    )
    duplicates = F.array_sort(
        F.array_compact(
            F.array(*[F.when(F.col(f"{s}_count") > 1, F.lit(n)) for s, n in signals.items()])
        )
    )
    ids = F.array_compact(F.array(*[F.col(f"{s}_row") for s in SHORT]))
    meta = [
        F.struct(
            F.col(f"first_{c}").alias("value"),
            F.col(f"at_{c}").alias("at"),
            F.col(f"low_{c}").alias("low"),
            F.col(f"high_{c}").alias("high"),
        ).alias(f"meta_{c}")
        for c in _present_metadata(data, cfg)
    ]
    return (
        grouped.withColumn("error", error)
        .select(
            "vin",
            "ts_us",
            "kind",
            position(F.col("ts_us"), F.col("kind")).alias("pos"),
            *SHORT,
            F.when(~is_batch, duplicates).alias("duplicate_signals"),
            F.when(is_batch & F.col("error").isNull(), zipped).alias("points"),
            "error",
            (is_batch & F.col("error").isNull() & ~aligned).alias("truncated"),
            ids.alias("source_row_ids"),
            "source_rows",
            *meta,
        )
    )


def vehicle_metadata(events: DataFrame, cfg: BuildSettings) -> DataFrame:
    """vin, each metadata column, and ``metadata_flags`` for inconsistent ones.

    The value is the vehicle's first non-null one in canonical order over all its
    cleaned rows, computed as an aggregate of the per-event firsts.
    """
    present = [c for c in cfg.metadata_columns if f"meta_{c}" in events.columns]
    aggs: list[Column] = [F.count(F.lit(1)).alias("_n")]
    for c in present:
        m = F.col(f"meta_{c}")
        has = m["value"].isNotNull()
        key = F.when(has, F.struct(F.col("ts_us"), m["at"]))
        aggs += [
            F.min_by(F.when(has, m["value"]), key).alias(c),
            (F.min(m["low"]) != F.max(m["high"])).alias(f"_mixed_{c}"),
        ]
    flags = [F.when(F.col(f"_mixed_{c}"), F.lit(f"inconsistent_metadata:{c}")) for c in present]
    flag_array = (
        F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    )
    per_vin = events.groupBy("vin").agg(*aggs)
    columns = [
        F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in cfg.metadata_columns
    ]
    return per_vin.select("vin", *columns, flag_array.alias("metadata_flags"))


def start_events(events: DataFrame) -> DataFrame:
    return _trigger_events(events, START)


def end_events(events: DataFrame) -> DataFrame:
    return _trigger_events(events, END)


def _trigger_events(events: DataFrame, kind: int) -> DataFrame:
    return events.filter(F.col("kind") == kind).select(
        "vin",
        F.timestamp_micros("ts_us").alias("timestamp"),
        F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"),
        F.col("alt").alias("altitude"),
        "source_row_ids",
        "duplicate_signals",
    )


def trajectory_batches(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind") == BATCH).select(
        "vin",
        F.timestamp_micros("ts_us").alias("timestamp"),
        F.col("points").alias("coordinates"),
        "error",
        "truncated",
        "source_row_ids",
    )

