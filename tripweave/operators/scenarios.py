"""A batch of what-if requests to model-ready samples with recorded provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SampleSettings, SpreadSettings
from ..functions.features import feature_columns
from ..functions.geo import grid_cell, in_bounds, km_between
from ..functions.paths import all_in_bounds, first_of, latlon_from_pairs, observed_prefix
from ..functions.text import iso_utc
from ..schema import FEATURES, REQUESTS
from ..session import stage
from .clean import strip
from .samples import completed_destination, normalised_trips, numbered_trips, pseudonym
from .spread import with_neighbour_marks, with_ordinal, with_time_bucket

# Request defaults and how near a custom prefix must start.
DEFAULT_TOP_K = 5
DEFAULT_FRACTION = 0.0
ORIGIN_TOLERANCE_KM = 0.03


@dataclass(frozen=True)
class Scenarios:
    """``samples``: model-ready rows; ``errors``: (scenario_id, vin, trip, error)."""

    samples: DataFrame
    errors: DataFrame


def complete_requests(requests: DataFrame) -> DataFrame:
    """Known columns only, defaults filled, texts trimmed, repeated history ids dropped."""
    known = {f.name: f.dataType for f in REQUESTS.fields}
    unknown = sorted(set(requests.columns) - set(known) - {"parse_error", "line"})
    if unknown:
        raise ValueError(f"Unknown request columns: {unknown}")
    filled = requests.select(
        *[
            (F.col(n) if n in requests.columns else F.lit(None)).cast(t).alias(n)
            for n, t in (known | {"parse_error": "string", "line": "bigint"}).items()
        ]
    )
    return (
        filled.withColumn("vin", strip(F.coalesce("vin", F.lit(""))))
        .withColumn("reference_trip_id", strip(F.coalesce("reference_trip_id", F.lit(""))))
        .withColumn("departure_time", F.nullif("departure_time", F.lit("")))
        .withColumn("prefix_fraction", F.coalesce("prefix_fraction", F.lit(DEFAULT_FRACTION)))
        .withColumn("top_k", F.coalesce("top_k", F.lit(DEFAULT_TOP_K)))
        .withColumn(
            "history_trip_ids", F.array_distinct(F.transform("history_trip_ids", lambda x: strip(x)))
        )
    )


def request_error() -> Column:
    """First rule a request breaks; null for a sound one."""
    pairs = F.col("prefix_points")
    short = F.exists(pairs, lambda p: F.size(p) < 2)
    bad = F.exists(pairs, lambda p: ~in_bounds(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    lat, lon, fraction = F.col("origin_latitude"), F.col("origin_longitude"), F.col("prefix_fraction")
    return (
        F.when(short, "Every custom prefix point needs latitude and longitude")
        .when(bad, "Custom prefix contains an invalid coordinate")
        .when(F.size(pairs) == 0, "Custom prefix must contain at least one point")
        .when(F.col("vin") == "", "VIN cannot be empty")
        .when(F.col("reference_trip_id") == "", "reference_trip_id cannot be empty")
        .when(~((fraction >= 0) & (fraction < 1)), "prefix_fraction must be in [0, 1)")
        .when(F.col("top_k") < 1, "top_k must be positive")
        .when(F.col("history_limit") < 0, "history_limit must be non-negative")
        .when(lat.isNull() != lon.isNull(), "Origin latitude and longitude must be supplied together")
        .when(~lat.between(-90.0, 90.0), "origin_latitude must be in [-90, 90]")
        .when(~lon.between(-180.0, 180.0), "origin_longitude must be in [-180, 180]")
    )


def scenario_hash() -> Column:
    """SHA-256 of the request as compact JSON with sorted keys."""
    ordered = F.struct(*sorted(f.name for f in REQUESTS.fields))
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def validated(requests: DataFrame) -> DataFrame:
    """Completed requests with ``scenario_id`` and ``error``; equal requests are one scenario,
    lines that could not be read are one each."""
    done = complete_requests(requests)
    unread = F.concat(scenario_hash(), F.lit(":"), F.col("line").cast("string"))
    return (
        done.withColumn("scenario_id", F.when(F.col("line").isNotNull(), unread).otherwise(scenario_hash()))
        .withColumn("error", F.coalesce("parse_error", request_error()))
        .drop("parse_error", "line")
        .dropDuplicates(["scenario_id"])
    )


def _blame(error: Column, when: Column, message: Column | str) -> Column:
    """Keep an earlier error; else set this one when it applies."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.coalesce(error, F.when(when, text))


def _last_before(moments: DataFrame, marked: DataFrame, name: str, spread: SpreadSettings) -> DataFrame:
    """Append ``name``: the mark of the last row of ``marked`` (vin, _at, _mark) before each
    moment (vin, departure), 0 if there is none. Both share one bucketed timeline."""
    asked = moments.withColumn("_at", F.unix_micros("departure")).withColumn("_order", F.col("_at") * 2)
    # At one instant the moment sorts first: only what is earlier counts.
    line = asked.unionByName(marked.withColumn("_order", F.col("_at") * 2 + 1), allowMissingColumns=True)
    line = with_time_bucket(line, "vin", "_at", spread, "_bucket")
    return (
        with_neighbour_marks(line, ["vin"], "_bucket", "_order", "_mark")
        .filter(F.col("departure").isNotNull())
        .withColumn(name, F.coalesce("prev_mark", F.lit(0)))
        .select(*moments.columns, name)
    )


def with_trip_counts(rows: DataFrame, trips: DataFrame, spread: SpreadSettings) -> DataFrame:
    """Append ``completed`` and ``started``: how many trips of ``vin`` had ended, and how
    many had begun, before ``departure``.

    ``trips``: output of ``ordered_trips``. Only distinct (vin, departure) stand on the
    timelines, whatever the rows carry; the counts come back by equality. Trips may
    overlap: ends are numbered for themselves.
    """
    starts = trips.select(F.col("VIN").alias("vin"), F.unix_micros("StartTrip").alias("_at"), F.col("ordinal").alias("_mark"))
    ends = trips.select(F.col("VIN").alias("vin"), F.unix_micros("EndTrip").alias("_at"), "trip_id")
    ends = with_time_bucket(ends, "vin", "_at", spread, "_bucket")
    ends = stage(with_ordinal(ends, ["vin"], "_bucket", ["_at", "trip_id"], "_mark").select("vin", "_at", "_mark"), "ends")
    moments = stage(rows.filter("departure IS NOT NULL").select("vin", "departure").distinct(), "moments")
    counted = _last_before(_last_before(moments, ends, "completed", spread), starts, "started", spread)
    return rows.join(counted, ["vin", "departure"], "left").withColumns(
        {n: F.coalesce(n, F.lit(0)) for n in ("completed", "started")}
    )


def ended_before(end: Column, departure: Column) -> Column:
    return F.coalesce(end < departure, F.lit(False))


def located_requests(requests: DataFrame, trips: DataFrame, spread: SpreadSettings) -> DataFrame:
    """Requests with their reference trip, departure and the counts of trips before it.

    ``trips``: output of ``ordered_trips``. Errors: earlier ones, unknown trip, bad time.
    """
    reference = trips.select(
        F.col("VIN").alias("vin"),
        F.col("trip_id").alias("reference_trip_id"),
        F.struct("StartTrip", "EndTrip", "end_latitude", "end_longitude", "ordinal").alias("ref"),
    )
    found = requests.join(reference, ["vin", "reference_trip_id"], "left")
    override = F.try_to_timestamp(strip(F.col("departure_time")))
    unknown = F.concat(
        F.lit("Trip "), F.col("reference_trip_id"), F.lit(" does not belong to VIN "), F.col("vin")
    )
    error = _blame(F.col("error"), F.col("ref").isNull(), unknown)
    error = _blame(
        error, F.col("departure_time").isNotNull() & override.isNull(), "departure_time is not a timestamp"
    )
    found = found.withColumn("error", error).withColumn("departure", F.coalesce(override, F.col("ref.StartTrip")))
    counted = with_trip_counts(found, trips, spread)
    # Points are moved once: they join when all else about a request is known.
    points = trips.select(F.col("VIN").alias("vin"), F.col("trip_id").alias("reference_trip_id"), "trajectory")
    ref = F.when(F.col("ref").isNotNull(), F.col("ref").withField("trajectory", F.col("trajectory")))
    return counted.join(points, ["vin", "reference_trip_id"], "left").withColumn("ref", ref).drop("trajectory")


def eligible_history(located: DataFrame) -> DataFrame:
    """How much history each request may use: a trip counts when it ended before
    departure and is not the reference trip."""
    own = ended_before(F.col("ref.EndTrip"), F.col("departure")).cast("int")
    return located.withColumn("eligible_count", F.col("completed") - own)


def eligible_history_rows(located: DataFrame, trips: DataFrame) -> DataFrame:
    """The eligible trips as rows (scenario_id, ordinal, trip_id). As large as its answer.

    Ordinals are written out in blocks, so no array grows with a vehicle's trips.
    """
    block = 65536
    blocks = located.filter("error IS NULL AND started > 0").select(
        "scenario_id",
        F.col("vin").alias("VIN"),
        "reference_trip_id",
        "departure",
        "started",
        F.explode(F.expr(f"sequence(0L, (started - 1) div {block})")).alias("_block"),
    )
    low = F.col("_block") * block + 1
    high = F.least(F.col("started"), F.col("_block") * block + block)
    numbers = blocks.select(
        "scenario_id", "VIN", "reference_trip_id", "departure", F.explode(F.sequence(low, high)).alias("ordinal")
    )
    return (
        numbers.join(trips.select("VIN", "ordinal", "trip_id", "EndTrip"), ["VIN", "ordinal"])
        .filter((F.col("EndTrip") < F.col("departure")) & (F.col("trip_id") != F.col("reference_trip_id")))
        .select("scenario_id", "ordinal", "trip_id")
    )


#: Children of a block of ordinals; trips of a finest block.
FAN = 64


def last_ended(rows: DataFrame, key: str, trips: DataFrame, item: Column, fan: int = FAN) -> DataFrame:
    """(key, item) of the last ``_limit`` eligible trips by start, for rows with VIN,
    reference_trip_id, departure, started and _limit.

    Trips may overlap, so any number of those that had begun may still be under way. A
    vehicle's ordinals are cut into blocks, those into blocks again, each with its least
    EndTrip. A block whose least end lies before the departure holds an eligible trip (or
    the reference trip), so of the blocks of one size no request looks into more than the
    last ``_limit + 1`` of such: whatever is under way, it reads ``fan`` times as many rows.
    """
    ends = trips.select("VIN", "ordinal", "EndTrip")
    most = ends.agg(F.max("ordinal")).first()[0] or 0
    sizes, index = [], {}
    while (sizes[-1] if sizes else 1) * fan < most:
        size = (sizes[-1] if sizes else 1) * fan
        below = index[sizes[-1]] if sizes else ends.select("VIN", (F.col("ordinal") - 1).alias("_block"), F.col("EndTrip").alias("_least"))
        made = below.groupBy("VIN", F.expr(f"_block div {fan}").alias("_block")).agg(F.min("_least").alias("_least"))
        index[size] = stage(made, "blocks")
        sizes.append(size)
    asked = rows.filter("started > 0 AND _limit > 0").select(
        key, "VIN", "reference_trip_id", "departure", "_limit", "started"
    )
    last = Window.partitionBy(key).orderBy(F.col("_block").desc())
    widest = sizes[-1] if sizes else 1
    open_blocks = asked.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(started - 1) div {widest}"))))
    for size in reversed(sizes):
        kept = (
            open_blocks.join(index[size], ["VIN", "_block"])
            .filter(F.col("_least") < F.col("departure"))
            .withColumn("_place", F.row_number().over(last))
            .filter(F.col("_place") <= F.col("_limit") + 1)
        )
        smaller = size // fan
        low, high = F.col("_block") * fan, F.least(F.col("_block") * fan + fan - 1, F.expr(f"(started - 1) div {smaller}"))
        open_blocks = kept.select(*asked.columns, F.explode(F.sequence(low, high)).alias("_block"))
    return (
        open_blocks.withColumn("ordinal", F.col("_block") + 1)
        .join(trips, ["VIN", "ordinal"])
        .filter((F.col("EndTrip") < F.col("departure")) & (F.col("trip_id") != F.col("reference_trip_id")))
        .withColumn("_place", F.row_number().over(last))
        .filter(F.col("_place") <= F.col("_limit"))
        .select(key, item.alias("item"))
    )


def chosen_history(located: DataFrame, trips: DataFrame, cfg: SampleSettings) -> DataFrame:
    """(scenario_id, history, history_ids, rejected_ids) per request.

    Automatic: the last min(limit, maximum) eligible trips by start. Selected: the given
    ids, eligible or rejected. Both look trips up by an equality on a unique key and
    compare each trip's own end with the departure.
    """
    sound = located.filter(F.col("error").isNull()).withColumn("VIN", F.col("vin"))
    limit = F.least(F.coalesce("history_limit", F.lit(cfg.max_history_trips)), F.lit(cfg.max_history_trips))
    item = F.struct(
        F.col("ordinal"),
        F.col("trip_id"),
        completed_destination().alias("h"),
    )
    slim = trips.select("VIN", "ordinal", "trip_id", "EndTrip", "end_latitude", "end_longitude")
    automatic = sound.filter(F.col("history_trip_ids").isNull()).withColumn("_limit", limit)
    by_number = last_ended(automatic, "scenario_id", slim, item).select(
        "scenario_id", "item", F.lit(None).cast("string").alias("rejected")
    )
    by_id = (
        sound.filter(F.col("history_trip_ids").isNotNull())
        .select("scenario_id", "VIN", "departure", "reference_trip_id", F.explode("history_trip_ids").alias("trip_id"))
        .join(slim, ["VIN", "trip_id"], "left")
    )
    fits = ended_before(F.col("EndTrip"), F.col("departure")) & (F.col("trip_id") != F.col("reference_trip_id"))
    by_id = by_id.select(
        "scenario_id", F.when(fits, item).alias("item"), F.when(~fits, F.col("trip_id")).alias("rejected")
    )
    # As many rows per scenario as its own request lists, or the maximum.
    return (
        by_number.unionByName(by_id)
        .groupBy("scenario_id")
        .agg(
            F.array_sort(F.collect_list("item")).alias("items"),
            F.array_sort(F.collect_list("rejected")).alias("rejected_ids"),
        )
        .select(
            "scenario_id",
            F.transform("items", lambda x: x["h"]).alias("history"),
            F.transform("items", lambda x: x["trip_id"]).alias("history_ids"),
            "rejected_ids",
        )
    )


def ordered_trips(trips: DataFrame, spread: SpreadSettings | None = None) -> DataFrame:
    """Typed trips with their ordinal per vehicle."""
    return numbered_trips(normalised_trips(trips), spread or SpreadSettings())


def _paths(df: DataFrame) -> DataFrame:
    """Append origin, prefix, its source, and the errors they raise."""
    seen = observed_prefix(F.col("ref.trajectory"), F.col("prefix_fraction"))
    df = df.withColumn("_seen", seen).withColumn("_from", first_of(F.col("_seen")))
    df = df.withColumn(
        "origin",
        F.struct(
            F.coalesce("origin_latitude", F.col("_from.latitude")).alias("latitude"),
            F.coalesce("origin_longitude", F.col("_from.longitude")).alias("longitude"),
        ),
    )
    origin, start = F.col("origin"), F.col("_from")
    moved = F.transform(
        "_seen",
        lambda p: F.struct(
            (p["latitude"] + (origin["latitude"] - start["latitude"])).alias("latitude"),
            (p["longitude"] + (origin["longitude"] - start["longitude"])).alias("longitude"),
        ),
    )
    custom = F.col("prefix_points").isNotNull()
    given = latlon_from_pairs(F.col("prefix_points"))
    kept = (origin["latitude"] == start["latitude"]) & (origin["longitude"] == start["longitude"])
    df = df.withColumn("_path", F.when(custom, given).otherwise(moved)).withColumn(
        "prefix_source",
        F.when(custom, "custom_points").when(kept, "reference_trip").otherwise("translated_reference_trip"),
    )
    away = km_between(origin, first_of(F.col("_path"))) > ORIGIN_TOLERANCE_KM
    error = _blame(
        F.col("error"), ~custom & ~all_in_bounds(F.col("_path")), "Translated prefix leaves the valid coordinate range"
    )
    error = _blame(error, custom & away, "Custom prefix must start at the configured origin (within 30 m)")
    # Nothing has been observed at fraction 0 but the origin.
    prefix = F.when(F.col("prefix_fraction") == 0, F.array(origin)).otherwise(F.col("_path"))
    return df.withColumn("error", error).withColumn("trajectory_prefix", prefix).drop("_seen", "_from", "_path")


def provenance() -> Column:
    """Where each input of a scenario came from."""
    return F.struct(
        F.col("scenario_id").alias("request_hash"),
        F.col("vin"),
        F.col("reference_trip_id"),
        iso_utc(F.col("departure")).alias("departure_time"),
        F.struct(
            F.when(F.col("departure_time").isNotNull(), "user_override").otherwise("reference_trip").alias("departure_time"),
            F.when(F.col("origin_latitude").isNotNull(), "user_override").otherwise("reference_trip").alias("origin"),
            F.col("prefix_source").alias("trajectory_prefix"),
            F.when(F.col("history_trip_ids").isNull(), "automatic_previous_trips")
            .otherwise("user_selected_previous_trips")
            .alias("history"),
            F.lit("reference_trip_comparison_only").alias("actual_destination"),
        ).alias("input_sources"),
        F.col("history_ids").alias("history_trip_ids"),
        F.col("eligible_count").alias("eligible_history_trips"),
        F.size("trajectory_prefix").alias("observed_prefix_points"),
        F.lit(len(FEATURES)).alias("model_feature_count"),
        F.struct(
            *[
                F.lit(False).alias(n)
                for n in (
                    "vin_is_model_feature",
                    "actual_destination_is_model_feature",
                    "future_history_used",
                    "final_reference_point_in_prefix",
                )
            ]
        ).alias("scientific_contract"),
    )


def prepare_scenarios(
    requests: DataFrame,
    trips: DataFrame,
    manifest: DataFrame,
    cfg: SampleSettings | None = None,
    spread: SpreadSettings | None = None,
) -> Scenarios:
    """One model-ready sample per sound request; every other request gets its error.

    Features come from the same expressions as training samples. The numbered trips
    and the located requests are staged, as four and three steps read them.
    """
    cfg, spread = cfg or SampleSettings(), spread or SpreadSettings()
    ordered = stage(ordered_trips(trips, spread), "ordered")
    located = stage(
        eligible_history(_paths(located_requests(validated(requests), ordered, spread))), "located"
    )
    history = chosen_history(located, ordered, cfg)
    known = manifest.select("vin", "split")
    frame = located.join(history, "scenario_id", "left").join(known, "vin", "left")
    nothing = F.array().cast("array<struct<latitude:double,longitude:double,completed_at:double>>")
    no_ids = F.array().cast("array<string>")
    frame = (
        frame.withColumn("history", F.coalesce("history", nothing))
        .withColumn("history_ids", F.coalesce("history_ids", no_ids))
        .withColumn("rejected_ids", F.coalesce("rejected_ids", no_ids))
    )
    invalid = F.concat(
        F.lit("History trips must belong to the VIN and end before departure: "), F.array_join("rejected_ids", ", ")
    )
    error = _blame(F.col("error"), F.size("rejected_ids") > 0, invalid)
    error = _blame(
        error,
        F.size("history_trip_ids") > cfg.max_history_trips,
        f"At most {cfg.max_history_trips} history trips are supported",
    )
    error = _blame(error, F.col("split").isNull(), "VIN absent from the split manifest")
    frame = frame.withColumn("error", error)
    features = feature_columns(
        F.col("departure"), F.col("trajectory_prefix"), F.col("prefix_fraction"), F.col("history")
    )
    lat, lon = F.col("ref.end_latitude"), F.col("ref.end_longitude")
    # prefix_fraction is a request column already; the features bring their own.
    samples = frame.filter(F.col("error").isNull()).select(
        F.concat(F.lit("scenario:"), F.left("scenario_id", F.lit(16))).alias("sample_id"),
        "scenario_id",
        F.col("vin").alias("VIN"),
        pseudonym(F.col("vin")).alias("vehicle_id"),
        F.col("reference_trip_id").alias("trip_id"),
        "reference_trip_id",
        F.col("departure").alias("StartTrip"),
        F.col("ref.EndTrip").alias("EndTrip"),
        "split",
        lat.alias("actual_latitude"),
        lon.alias("actual_longitude"),
        grid_cell(lat, lon, cfg.grid_cell_degrees).alias("actual_cell"),
        F.col("ref.trajectory").alias("trajectory"),
        "trajectory_prefix",
        F.col("history").alias("history_sequence"),
        *[features[name].alias(name) for name in FEATURES],
        "top_k",
        provenance().alias("provenance"),
    )
    errors = frame.filter(F.col("error").isNotNull()).select("scenario_id", "vin", "reference_trip_id", "error")
    return Scenarios(samples, errors)


def reference_defaults(
    trips: DataFrame, fraction: float, history_limit: int, spread: SpreadSettings | None = None
) -> DataFrame:
    """What a request form starts from, for every (vin, trip); trips may overlap.

    ``eligible_history_trips`` counts what :func:`eligible_history_rows` lists.
    """
    spread = spread or SpreadSettings()
    ordered = stage(ordered_trips(trips, spread), "ordered")
    asked = ordered.select(
        F.col("VIN").alias("vin"), F.col("trip_id").alias("reference_trip_id"), F.col("StartTrip").alias("departure")
    )
    counted = stage(with_trip_counts(asked, ordered, spread), "defaults")
    keyed = counted.select(
        F.struct("vin", "reference_trip_id").alias("_asked"), F.col("vin").alias("VIN"), "reference_trip_id",
        "departure", "completed", "started", F.lit(int(history_limit)).cast("bigint").alias("_limit"),
    )
    slim = ordered.select("VIN", "ordinal", "trip_id", "EndTrip")
    chosen = last_ended(keyed, "_asked", slim, F.struct("ordinal", "trip_id")).groupBy("_asked").agg(
        F.transform(F.array_sort(F.collect_list("item")), lambda x: x["trip_id"]).alias("history")
    )
    chosen = chosen.select("_asked.vin", "_asked.reference_trip_id", "history")
    # Points are moved once, to what was found for their trip.
    points = ordered.select(
        F.col("VIN").alias("vin"), F.col("trip_id").alias("reference_trip_id"), "trajectory", "end_latitude", "end_longitude"
    )
    key = ["vin", "reference_trip_id"]
    seen = points.join(counted.join(chosen, key, "left"), key)
    prefix = observed_prefix(F.col("trajectory"), F.lit(float(fraction)))
    origin = first_of(F.col("trajectory"))
    return seen.select(
        "vin",
        "reference_trip_id",
        F.col("departure").alias("departure_time"),
        origin["latitude"].alias("origin_latitude"),
        origin["longitude"].alias("origin_longitude"),
        F.lit(float(fraction)).alias("prefix_fraction"),
        prefix.alias("prefix_points"),
        F.col("completed").alias("eligible_history_trips"),
        F.coalesce("history", F.array().cast("array<string>")).alias("history_trip_ids"),
        "end_latitude",
        "end_longitude",
    ).withColumnsRenamed({"end_latitude": "actual_latitude", "end_longitude": "actual_longitude"})
