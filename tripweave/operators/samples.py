"""Trips to prediction samples that only see the past."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SampleSettings, SpreadSettings
from ..functions.features import feature_columns
from ..functions.geo import grid_cell, in_bounds
from ..functions.paths import latlon_from_pairs, observed_prefix, usable_trajectory
from ..schema import FEATURES, TRIPS_NEEDED, require_columns
from .split import attach_split, distinct_vins, split_by_cutoffs, split_cutoffs
from .spread import with_ordinal, with_time_bucket

# Fixed value: longest history a sample carries.
MOST_HISTORY = 20


def pseudonym(vin: Column) -> Column:
    return F.concat(F.lit("vehicle-"), F.left(F.sha2(vin, 256), F.lit(10)))


def trajectory_points(df: DataFrame, name: str = "Trajectory") -> Column:
    """Trajectory column as ARRAY<STRUCT<latitude,longitude>>, from JSON text if need be."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        pairs = F.from_json(F.col(name), "array<array<double>>")
        return latlon_from_pairs(pairs)
    if isinstance(kind.elementType, T.ArrayType):
        return latlon_from_pairs(F.col(name))
    return F.col(name)


def _utc(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("timestamp")


def normalised_trips(trips: DataFrame) -> DataFrame:
    """The columns samples and scenarios need, typed; bad trajectories fail the job."""
    require_columns(trips, TRIPS_NEEDED, "Trips table")
    points = trajectory_points(trips)
    bad = F.concat(F.lit("Unusable trajectory in trip "), F.col("trip_id"))
    return trips.select(
        F.col("VIN").cast("string").alias("VIN"),
        F.col("trip_id").cast("string").alias("trip_id"),
        _utc(trips, "StartTrip").alias("StartTrip"),
        _utc(trips, "EndTrip").alias("EndTrip"),
        points.alias("trajectory"),
        F.col("end_latitude").cast("double").alias("end_latitude"),
        F.col("end_longitude").cast("double").alias("end_longitude"),
    ).withColumn(
        "trajectory",
        F.when(usable_trajectory(F.col("trajectory")), F.col("trajectory")).otherwise(
            F.raise_error(bad).cast("array<struct<latitude:double,longitude:double>>")
        ),
    )


def numbered_trips(trips: DataFrame, spread: SpreadSettings) -> DataFrame:
    """Append ``ordinal``: 1, 2, ... per vehicle by (StartTrip, trip_id)."""
    timed = trips.withColumn("_us", F.unix_micros("StartTrip"))
    bucketed = with_time_bucket(timed, "VIN", "_us", spread, "_bucket").drop("_us")
    return with_ordinal(
        bucketed,
        ["VIN"],
        "_bucket",
        ["StartTrip", "trip_id"],
        "ordinal",
        counted=bucketed.select("VIN", "_bucket"),
    ).drop("_bucket")


def completed_destination() -> Column:
    """A trip as later trips see it: where and when it ended."""
    return F.struct(
        F.col("end_latitude").alias("latitude"),
        F.col("end_longitude").alias("longitude"),
        (F.unix_micros("EndTrip") / 1e6).alias("completed_at"),
    )


def with_history(
    trips: DataFrame, limit: int, spread: SpreadSettings, item: Column | None = None
) -> DataFrame:
    """Append ``history``: ``item`` of the last ``limit`` earlier trips, oldest first.

    Needs ``ordinal``. A vehicle is cut into runs of ``history_chunk`` trips; the
    last trips of a run are sent along to the next one, so each window sees the
    past it needs and holds at most chunk + limit rows. Overlapping trips fail.
    """
    reach = max(1, limit)
    size = max(spread.history_chunk, reach)
    place = F.col("ordinal") - 1
    own = F.expr(f"(ordinal - 1) div {size}")
    spills = place % size >= size - reach
    sent = trips.withColumn(
        "_run", F.explode(F.when(spills, F.array(own, own + 1)).otherwise(F.array(own)))
    ).withColumn("_home", F.col("_run") == own)
    w = Window.partitionBy("VIN", "_run").orderBy("ordinal")
    item = item if item is not None else completed_destination()
    history = F.collect_list(item).over(w.rowsBetween(-reach, -1))
    if limit == 0:
        history = F.slice(history, F.lit(1), F.lit(0))
    clash = F.concat(F.lit("Overlapping trips detected for VIN "), F.col("VIN"))
    return (
        sent.withColumn("_earlier_end", F.lag("EndTrip").over(w))
        .withColumn("history", history)
        .filter("_home")
        .withColumn(
            "history",
            F.when(
                F.col("_earlier_end") >= F.col("StartTrip"),
                F.raise_error(clash),
            ).otherwise(F.col("history")),
        )
        .drop("_run", "_home", "_earlier_end")
    )


def overlap_count(trips: DataFrame, spread: SpreadSettings | None = None) -> DataFrame:
    """One row: trips that start before the previous trip of the vehicle has ended."""
    spread = spread or SpreadSettings()
    slim = numbered_trips(trips.select("VIN", "trip_id", "StartTrip", "EndTrip"), spread)
    nxt = slim.select("VIN", (F.col("ordinal") + 1).alias("ordinal"), F.col("EndTrip").alias("earlier_end"))
    return slim.join(nxt, ["VIN", "ordinal"]).agg(
        F.count_if(F.col("earlier_end") >= F.col("StartTrip")).alias("overlaps")
    )


def prepare_samples(
    trips: DataFrame,
    cfg: SampleSettings | None = None,
    manifest: DataFrame | None = None,
    fractions: Sequence[float] | None = None,
    spread: SpreadSettings | None = None,
) -> DataFrame:
    """One row per trip and prefix fraction: ids, split, actuals, arrays, features.

    Without a manifest the split is drawn from the vehicles at hand. ``trips`` is
    read more than once (vehicles, counts, rows): pass a written table.
    """
    cfg, spread = cfg or SampleSettings(), spread or SpreadSettings()
    frame = normalised_trips(trips)
    limit = min(MOST_HISTORY, cfg.max_history_trips)
    seen = with_history(numbered_trips(frame, spread), limit, spread)
    if manifest is None:
        cut = split_cutoffs(distinct_vins(trips), cfg)
        seen = split_by_cutoffs(seen, "VIN", cut, cfg)
    else:
        seen = attach_split(seen, "VIN", manifest)
    wanted = [float(f) for f in (fractions or cfg.prefix_fractions)]
    if any(not 0 <= f < 1 for f in wanted):
        raise ValueError("prefix fractions must be in [0, 1)")
    rows = seen.withColumn("_f", F.explode(F.array(*[F.lit(f) for f in wanted])))
    rows = rows.withColumn("trajectory_prefix", observed_prefix(F.col("trajectory"), F.col("_f")))
    features = feature_columns(
        F.col("StartTrip"), F.col("trajectory_prefix"), F.col("_f"), F.col("history")
    )
    return rows.select(
        F.format_string("%s@%.3f", F.col("trip_id"), F.col("_f")).alias("sample_id"),
        "VIN",
        pseudonym(F.col("VIN")).alias("vehicle_id"),
        "trip_id",
        "StartTrip",
        "EndTrip",
        "split",
        F.col("end_latitude").alias("actual_latitude"),
        F.col("end_longitude").alias("actual_longitude"),
        grid_cell(F.col("end_latitude"), F.col("end_longitude"), cfg.grid_cell_degrees).alias("actual_cell"),
        "trajectory",
        "trajectory_prefix",
        F.col("history").alias("history_sequence"),
        *[features[name].alias(name) for name in FEATURES],
    )


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def checked_features(samples: DataFrame) -> DataFrame:
    """Samples with ``features_array`` (FLOAT); a missing or non-finite feature fails."""
    ok = F.lit(True)
    for name in FEATURES:
        ok = ok & F.coalesce(_finite(F.col(name)), F.lit(False))
    values = F.array(*[F.col(name).cast("float") for name in FEATURES])
    fail = F.raise_error(F.lit("Model features contain missing or non-finite values")).cast("array<float>")
    return samples.withColumn("features_array", F.when(ok, values).otherwise(fail))


def checked_targets(samples: DataFrame) -> DataFrame:
    """Samples with ``target`` [lat, lon]; a missing or non-finite value fails."""
    lat, lon = F.col("actual_latitude"), F.col("actual_longitude")
    ok = F.coalesce(_finite(lat) & _finite(lon), F.lit(False))
    fail = F.raise_error(F.lit("Destination targets contain missing or non-finite values")).cast("array<double>")
    return samples.withColumn("target", F.when(ok, F.array(lat, lon)).otherwise(fail))
