"""Every start and every stray end to an outcome: an accepted trip or its rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BuildSettings
from ..functions.geo import in_bounds, metres_between
from ..functions.paths import (
    SURELY_KEPT_M,
    all_in_bounds,
    drop_equal_neighbours,
    drop_repeats,
    first_of,
    last_of,
    shortened,
    steps_m,
    total,
)
from ..functions.rounding import round_exact
from .events import BATCH, END, START
from .pairing import ALONE, LONG, SHORT

# Rejection reasons with their constant detail texts.
DETAILS = {
    "missing_end_trigger": "No end trigger before the next journey start",
    "missing_start_coordinate": "Start trigger lacks latitude or longitude",
    "missing_end_coordinate": "End trigger lacks latitude or longitude",
    "invalid_trigger_coordinate": "Start or end coordinate is outside geographic bounds",
    "missing_trajectory": "No usable periodic trajectory array",
    "invalid_trajectory_coordinate": "Trajectory contains latitude/longitude outside geographic bounds",
    "unmatched_end_trigger": "End trigger has no preceding unmatched start trigger",
}

TRIP = ["vin", "start_us", "end_us"]
STATS = ["n", "distance", "longest_step", "first_point", "last_point", "in_bounds"]


def _trigger_struct() -> Column:
    return F.struct(
        F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"),
        F.col("alt").alias("altitude"),
        F.col("duplicate_signals").alias("duplicates"),
        F.col("source_row_ids").alias("rows"),
    )


def _ends_of_trip() -> list[Column]:
    return [
        F.first(F.when(F.col("kind") == START, _trigger_struct()), ignorenulls=True).alias("start"),
        F.first(F.when(F.col("kind") == END, _trigger_struct()), ignorenulls=True).alias("end"),
        F.first(F.when(F.col("kind") == START, F.col("bucket")), ignorenulls=True).alias("bucket"),
    ]


def _settle_points(df: DataFrame) -> DataFrame:
    """Drop repeats from ``points`` and append their figures (STATS).

    Each intermediate array gets a column of its own: an array expression used
    inside a lambda would be evaluated again for every element.
    """
    points, steps = F.col("points"), F.col("_steps")
    settled = (
        df.withColumn("points", drop_equal_neighbours(points))
        .withColumn("_steps", steps_m(points))
        .withColumn("points", drop_repeats(points, steps))
        .withColumn("_steps", F.when(shortened(points, steps), steps_m(points)).otherwise(steps))
    )
    figures = {
        "n": F.size(points).cast("bigint"),
        "distance": total(steps),
        "longest_step": F.coalesce(F.array_max(steps), F.lit(0.0)),
        "first_point": first_of(points),
        "last_point": last_of(points),
        "in_bounds": all_in_bounds(points),
    }
    return settled.withColumns(figures).drop("_steps")


def _short_trips(rows: DataFrame) -> DataFrame:
    """Trips no longer than the duration limit: their span bounds what is gathered."""
    batch = F.when(
        F.col("kind") == BATCH,
        F.struct("ts_us", "error", "truncated", "points", "source_row_ids"),
    )
    gathered = rows.groupBy(*TRIP).agg(
        *_ends_of_trip(), F.array_sort(F.collect_list(batch)).alias("batches")
    )
    batches = F.col("batches")
    raw_points = F.flatten(F.filter(F.transform(batches, lambda b: b["points"]), lambda p: p.isNotNull()))
    return _settle_points(gathered.withColumn("points", raw_points)).select(
            *TRIP,
            "bucket",
            "start",
            "end",
            F.array_join(
                F.filter(F.transform(batches, lambda b: b["error"]), lambda e: e.isNotNull()), "; "
            ).alias("errors"),
            F.exists(batches, lambda b: b["truncated"]).alias("truncated"),
            F.flatten(F.transform(batches, lambda b: b["source_row_ids"])).alias("batch_rows"),
            "points",
            *STATS,
        )


def _long_trips(rows: DataFrame) -> DataFrame:
    """Trips over the duration limit. They are rejected, but with exact figures, and
    one may span any number of batches: work per time bucket, combine the figures.
    """
    heads = rows.filter(F.col("kind") != BATCH).groupBy(*TRIP).agg(*_ends_of_trip())
    batches = rows.filter(F.col("kind") == BATCH)
    # All branches below start from this one aggregation, with the same columns, so
    # that the plan computes its exchange once.
    gathered = batches.groupBy(*TRIP, "bucket").agg(
        F.array_sort(F.collect_list(F.struct("ts_us", "error", "points", "truncated"))).alias("b")
    )
    errors = F.array_join(F.filter(F.transform("b", lambda x: x["error"]), lambda e: e.isNotNull()), "; ")
    notes = (
        gathered.withColumn("errors", errors)
        .groupBy(*TRIP)
        .agg(
            F.array_sort(
                F.collect_list(F.when(F.col("errors") != "", F.struct("bucket", "errors")))
            ).alias("found"),
            F.max(F.exists("b", lambda x: x["truncated"])).alias("truncated"),
        )
        .select(
            *TRIP, F.array_join(F.transform("found", lambda x: x["errors"]), "; ").alias("errors"), "truncated"
        )
    )
    raw_points = F.flatten(F.filter(F.transform("b", lambda x: x["points"]), lambda p: p.isNotNull()))
    per_bucket = gathered.select(*TRIP, "bucket", raw_points.alias("points")).withColumn(
        "points", drop_equal_neighbours(F.col("points"))
    )
    # A bucket whose first point is surely kept starts a chunk the repeat filter can
    # treat on its own; other buckets (a parked vehicle) join the chunk before.
    filled = per_bucket.filter(F.size("points") > 0)
    edges = filled.select(
        *TRIP, "bucket", first_of(F.col("points")).alias("a"), last_of(F.col("points")).alias("z")
    )
    in_trip = Window.partitionBy(*TRIP).orderBy("bucket")
    jump = metres_between(F.lag("z").over(in_trip), F.col("a"))
    chunks = (
        edges.withColumn("opens", F.when(jump < SURELY_KEPT_M, 0).otherwise(1))
        .withColumn("chunk", F.sum("opens").over(in_trip))
        .select(*TRIP, "bucket", "chunk")
    )
    chunked = (
        filled.join(chunks, [*TRIP, "bucket"])
        .groupBy(*TRIP, "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("bucket", "points"))).alias("parts"))
        .withColumn("points", F.flatten(F.transform("parts", lambda p: p["points"])))
    )
    chunked = _settle_points(chunked).select(*TRIP, "chunk", *STATS)
    by_chunk = Window.partitionBy(*TRIP).orderBy("chunk")
    bridged = chunked.withColumn(
        "bridge",
        F.coalesce(metres_between(F.lag("last_point").over(by_chunk), F.col("first_point")), F.lit(0.0)),
    )
    stats = bridged.groupBy(*TRIP).agg(
        F.sum("n").alias("n"),
        (F.sum("distance") + F.sum("bridge")).alias("distance"),
        F.greatest(F.max("longest_step"), F.max("bridge")).alias("longest_step"),
        F.min_by("first_point", "chunk").alias("first_point"),
        F.max_by("last_point", "chunk").alias("last_point"),
        F.min("in_bounds").alias("in_bounds"),
    )
    return (
        heads.join(notes, TRIP, "left")
        .join(stats, TRIP, "left")
        .select(
            *TRIP,
            "bucket",
            "start",
            "end",
            F.coalesce("errors", F.lit("")).alias("errors"),
            F.coalesce("truncated", F.lit(False)).alias("truncated"),
            F.lit(None).cast("array<bigint>").alias("batch_rows"),
            F.lit(None)
            .cast("array<struct<latitude:double,longitude:double,altitude:double>>")
            .alias("points"),
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce("distance", F.lit(0.0)).alias("distance"),
            F.coalesce("longest_step", F.lit(0.0)).alias("longest_step"),
            "first_point",
            "last_point",
            F.coalesce("in_bounds", F.lit(True)).alias("in_bounds"),
        )
    )


def _plain_point(c: Column) -> Column:
    return F.struct(c["latitude"], c["longitude"], c["altitude"])


def _flag(when: Column, text: str) -> Column:
    return F.when(when, F.lit(text))


def candidates(paired: DataFrame, cfg: BuildSettings) -> DataFrame:
    """Paired trips with their final geometry figures and quality flags.

    Fallback to the trigger points and endpoint repair are applied to the figures
    and to the points alike.
    """
    built = _short_trips(paired.filter(F.col("route") == SHORT)).unionByName(
        _long_trips(paired.filter(F.col("route") == LONG))
    )

    start, end = _plain_point(F.col("start")), _plain_point(F.col("end"))
    no_path = F.col("n") == 0
    built = built.withColumns(
        {
            "straight_m": metres_between(F.col("start"), F.col("end")),
            "no_path": no_path,
            "fell_back": no_path & F.lit(cfg.fallback_to_triggers),
        }
    )
    instead = {
        "points": F.array(start, end),
        "first_point": start,
        "last_point": end,
        "n": F.lit(2),
        "distance": F.col("straight_m"),
        "longest_step": F.col("straight_m"),
    }
    fell = F.col("fell_back")
    built = built.withColumns({c: F.when(fell, e).otherwise(F.col(c)) for c, e in instead.items()})
    # Both gaps come from the path before anything is inserted.
    built = built.withColumns(
        {
            "start_gap": metres_between(F.col("start"), F.col("first_point")),
            "end_gap": metres_between(F.col("last_point"), F.col("end")),
        }
    )
    far_start = F.coalesce(F.col("start_gap") > cfg.endpoint_tolerance_m, F.lit(False))
    far_end = F.coalesce(F.col("end_gap") > cfg.endpoint_tolerance_m, F.lit(False))
    flags: list[Column] = [
        _flag(F.col("truncated"), "trajectory_arrays_truncated"),
        _flag(F.col("fell_back"), "trajectory_fallback_to_trigger_endpoints"),
    ]
    if cfg.add_trigger_endpoints:
        nothing = F.slice(F.col("points"), F.lit(1), F.lit(0))
        gaps = [F.when(far, F.col(gap)).otherwise(0.0) for far, gap in ((far_start, "start_gap"), (far_end, "end_gap"))]
        built = built.withColumns(
            {
                "points": F.concat(
                    F.when(far_start, F.array(start)).otherwise(nothing),
                    F.col("points"),
                    F.when(far_end, F.array(end)).otherwise(nothing),
                ),
                "n": F.col("n") + far_start.cast("int") + far_end.cast("int"),
                "distance": F.col("distance") + gaps[0] + gaps[1],
                "longest_step": F.greatest(F.col("longest_step"), *gaps),
            }
        )
        flags += [_flag(far_start, "start_trigger_point_added"), _flag(far_end, "end_trigger_point_added")]
    else:
        flags += [_flag(far_start, "start_endpoint_mismatch"), _flag(far_end, "end_endpoint_mismatch")]

    def prefixed(prefix: str, side: str) -> Column:
        return F.transform(F.col(side)["duplicates"], lambda d: F.concat(F.lit(prefix), d))

    seconds = (F.col("end_us") - F.col("start_us")) / 1e6
    # Points are spread evenly in time, so the longest step is also the fastest.
    interval = seconds / (F.col("n") - 1)
    moving = (F.col("n") > 1) & (seconds > 0)
    return built.withColumns(
        {
            "duration_s": seconds,
            "max_speed": F.when(moving, F.col("longest_step") / interval * 3.6).otherwise(0.0),
            "flags": F.concat(
                prefixed("duplicate_start_signal:", "start"),
                prefixed("duplicate_end_signal:", "end"),
                F.array_compact(F.array(*flags)),
            ),
        }
    )


def first_failure(cfg: BuildSettings) -> Column:
    """The one reason that stops a paired trip before eligibility is looked at."""
    start, end = F.col("start"), F.col("end")

    def lacks(p: Column) -> Column:
        return p["latitude"].isNull() | p["longitude"].isNull()

    bad = ~in_bounds(start["latitude"], start["longitude"]) | ~in_bounds(end["latitude"], end["longitude"])
    return (
        F.when(lacks(start), "missing_start_coordinate")
        .when(lacks(end), "missing_end_coordinate")
        .when(bad, "invalid_trigger_coordinate")
        .when(F.col("errors") != "", "invalid_trajectory_array")
        .when(F.col("no_path") & ~F.col("fell_back"), "missing_trajectory")
        .when(~F.col("in_bounds"), "invalid_trajectory_coordinate")
        .when(F.col("duration_s") <= 0, "non_positive_duration")
    )


def _reason(when: Column, reason: str, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(reason).alias("reason"), detail.alias("detail")))


def eligibility_failures(cfg: BuildSettings) -> Column:
    """All limits a trip breaks, as an array of (reason, detail)."""
    d, n, m, v = (F.col(c) for c in ("duration_s", "n", "distance", "max_speed"))
    seconds = F.format_string("duration_s=%.3f", round_exact(d, 3))
    metres = F.format_string("distance_m=%.3f", round_exact(m, 3))
    return F.array_compact(
        F.array(
            _reason(d < cfg.min_duration_seconds, "duration_too_short", seconds),
            _reason(d > cfg.max_duration_seconds, "duration_too_long", seconds),
            _reason(n < cfg.min_points, "too_few_points", F.format_string("point_count=%d", n)),
            _reason(m < cfg.min_distance_m, "distance_too_short", metres),
            _reason(m > cfg.max_distance_m, "distance_too_long", metres),
            _reason(
                v > cfg.max_segment_speed_kmh,
                "implausible_segment_speed",
                F.format_string("max_segment_speed_kmh=%.3f", round_exact(v, 3)),
            ),
        )
    )


def outcomes(paired: DataFrame, cfg: BuildSettings) -> DataFrame:
    """One row per start event and per unmatched end, from ``routed_events``.

    ``accepted`` rows have no ``reasons``; only they keep their points.
    ``bucket`` is that of the start event. Reads ``paired`` once per route: pass it staged by route.
    """
    judged = candidates(paired, cfg).withColumn("failure", first_failure(cfg))
    fixed = F.create_map(*[F.lit(x) for kv in DETAILS.items() for x in kv])
    detail = (
        F.when(F.col("failure") == "invalid_trajectory_array", F.col("errors"))
        .when(
            F.col("failure") == "non_positive_duration",
            F.concat(F.lit("duration_s="), F.col("duration_s").cast("string")),
        )
        .otherwise(F.try_element_at(fixed, F.col("failure")))
    )
    judged = judged.withColumn(
        "reasons",
        F.when(
            F.col("failure").isNotNull(),
            F.array(F.struct(F.col("failure").alias("reason"), detail.alias("detail"))),
        ).otherwise(eligibility_failures(cfg)),
    )
    ok = F.size("reasons") == 0
    judged = judged.select(
        *TRIP,
        "reasons",
        "start",
        "end",
        *[F.when(ok, F.col(c)).alias(c) for c in ("points", "batch_rows", "flags")],
        "n",
        "distance",
        "straight_m",
        "duration_s",
        "max_speed",
        "bucket",
    )

    def lone(reason: str) -> Column:
        return F.array(
            F.struct(F.lit(reason).alias("reason"), F.lit(DETAILS[reason]).alias("detail"))
        )

    widowed = F.col("kind") == START
    unpaired = paired.filter(F.col("route") == ALONE).select(
        *TRIP,
        F.when(widowed, lone("missing_end_trigger")).otherwise(lone("unmatched_end_trigger")).alias("reasons"),
        "bucket",
    )
    everything = judged.unionByName(unpaired, allowMissingColumns=True)
    return everything.withColumn("accepted", F.size("reasons") == 0)


def rejections(result: DataFrame) -> DataFrame:
    """(VIN, StartTrip, EndTrip, reason, detail), one row per reason."""
    return result.filter(~F.col("accepted")).select(
        F.col("vin").alias("VIN"),
        F.timestamp_micros("start_us").alias("StartTrip"),
        F.timestamp_micros("end_us").alias("EndTrip"),
        F.inline("reasons"),
    )
