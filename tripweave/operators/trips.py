"""Accepted outcomes to the trip, point and lineage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BuildSettings
from ..functions.geo import metres_between
from ..functions.rounding import round_exact
from .clean import ROW_ID
from .spread import with_ordinal

# Fixed value: how point times are made.
TIME_METHOD = "interpolated_between_trip_triggers"


def accepted_trips(result: DataFrame, metadata: DataFrame) -> DataFrame:
    """Accepted outcomes with trip_id, ordinal, metadata and final flags."""
    accepted = result.filter("accepted")
    numbered = with_ordinal(
        accepted,
        ["vin"],
        "bucket",
        ["start_us"],
        "ordinal",
        counted=accepted.select("vin", "bucket"),
        carry=metadata,
    )
    stamp = F.date_format(F.timestamp_micros("start_us"), "yyyyMMdd'T'HHmmss'Z'")
    # Four digits at least; lpad alone would cut longer numbers.
    number = F.col("ordinal").cast("string")
    number = F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))
    return numbered.withColumn("trip_id", F.concat_ws("_", "vin", stamp, number)).withColumn(
        "flags",
        F.array_sort(
            F.array_distinct(
                F.concat("flags", F.coalesce("metadata_flags", F.array().cast("array<string>")))
            )
        ),
    )


def trip_table(accepted: DataFrame, cfg: BuildSettings) -> DataFrame:
    """One row per accepted trip."""
    dp = cfg.coordinate_decimals

    r = round_exact
    meters, seconds = F.col("distance"), F.col("duration_s")
    return accepted.select(
        F.col("vin").alias("VIN"),
        "trip_id",
        F.timestamp_micros("start_us").alias("StartTrip"),
        F.timestamp_micros("end_us").alias("EndTrip"),
        F.transform(
            "points",
            lambda p: F.struct(r(p["latitude"], dp).alias("latitude"), r(p["longitude"], dp).alias("longitude")),
        ).alias("Trajectory"),
        F.transform("points", lambda p: r(p["altitude"], 3)).alias("AltitudeTrajectory"),
        r(F.col("start.latitude"), dp).alias("start_latitude"),
        r(F.col("start.longitude"), dp).alias("start_longitude"),
        F.col("start.altitude").alias("start_altitude_m"),
        r(F.col("end.latitude"), dp).alias("end_latitude"),
        r(F.col("end.longitude"), dp).alias("end_longitude"),
        F.col("end.altitude").alias("end_altitude_m"),
        r(seconds, 3).alias("duration_seconds"),
        r(seconds / 60.0, 3).alias("duration_minutes"),
        r(meters, 3).alias("distance_m"),
        r(meters / 1000.0, 6).alias("distance_km"),
        r(F.col("straight_m"), 3).alias("straight_line_distance_m"),
        r(meters / seconds * 3.6, 3).alias("average_speed_kmh"),
        r(F.col("max_speed"), 3).alias("max_segment_speed_kmh"),
        F.col("n").cast("int").alias("point_count"),
        F.when(F.size("flags") > 0, "accepted_with_flags").otherwise("accepted").alias("quality_status"),
        F.col("flags").alias("quality_flags"),
        F.lit(TIME_METHOD).alias("trajectory_timestamp_method"),
        *cfg.metadata_columns,
    )


def point_table(accepted: DataFrame, cfg: BuildSettings) -> DataFrame:
    """One row per ordered point.

    The windows are partitioned on (vin, bucket, trip): the rows already lie hashed
    on (vin, bucket) from the numbering of trips, so exploding them moves nothing.
    """
    dp = cfg.coordinate_decimals
    rows = accepted.select(
        "vin", "bucket", "start_us", "end_us", "trip_id", "duration_s", "n", F.posexplode("points").alias("i", "p")
    )
    w = Window.partitionBy("vin", "bucket", "start_us").orderBy("i")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    n, i = F.col("n"), F.col("i")
    # A whole number of microseconds, rounded down.
    offset_us = F.expr("((end_us - start_us) * CAST(i AS BIGINT)) div (n - 1)")
    step = F.coalesce(metres_between(F.lag("p").over(w), F.col("p")), F.lit(0.0))
    return (
        rows.withColumn("step", step)
        .withColumn("walked", F.sum("step").over(so_far))
        .withColumn("offset_us", offset_us)
        .select(
            "trip_id",
            F.col("vin").alias("VIN"),
            i.alias("point_index"),
            F.when(i == 0, "start").when(i == n - 1, "destination").otherwise("trajectory").alias("point_role"),
            F.timestamp_micros(F.col("start_us") + F.col("offset_us")).alias("timestamp"),
            round_exact(F.col("offset_us") / 1e6, 3).alias("elapsed_seconds"),
            round_exact(F.col("p.latitude"), dp).alias("latitude"),
            round_exact(F.col("p.longitude"), dp).alias("longitude"),
            round_exact(F.col("p.altitude"), 3).alias("altitude_m"),
            round_exact(F.col("step"), 3).alias("segment_distance_m"),
            round_exact(F.col("walked"), 3).alias("cumulative_distance_m"),
            round_exact(F.col("step") / (F.col("duration_s") / (n - 1)) * 3.6, 3).alias("segment_speed_kmh"),
            F.lit(TIME_METHOD).alias("timestamp_method"),
        )
    )


def lineage(accepted: DataFrame) -> DataFrame:
    """source_row_id to the trips it fed and in which roles."""

    def used(rows: Column, role: str) -> Column:
        return F.transform(
            F.coalesce(rows, F.array().cast("array<bigint>")),
            lambda x: F.struct(x.alias("row"), F.lit(role).alias("role")),
        )

    return (
        accepted.select(
            "trip_id",
            F.inline(
                F.concat(
                    used(F.col("start.rows"), "start_trigger"),
                    used(F.col("end.rows"), "end_trigger"),
                    used(F.col("batch_rows"), "trajectory_batch"),
                )
            ),
        )
        .groupBy(F.col("row").alias(ROW_ID))
        .agg(
            F.array_sort(F.collect_set("trip_id")).alias("trip_ids"),
            F.array_sort(F.collect_set("role")).alias("source_roles"),
        )
    )


def cleaned_source(data: DataFrame, usage: DataFrame, cfg: BuildSettings) -> DataFrame:
    """Cleaned rows that fed an accepted trip, with their lineage."""
    optional = [
        c for c in ("ingestion_timestamp", *cfg.metadata_columns) if c in data.columns
    ]
    return data.join(usage, ROW_ID, "inner").select(
        ROW_ID,
        "trip_ids",
        "source_roles",
        F.col("vin").alias("VIN"),
        F.col("timestamp").alias("source_timestamp"),
        F.col("trigger").alias("source_trigger"),
        F.col("signal").alias("source_signal"),
        F.col("scalar").alias("scalar_value"),
        F.col("series").alias("series_value"),
        *optional,
    )
