"""Map-ready tables: trip coverage and prediction layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import grid_polygon, in_bounds, km_between
from ..functions.paths import latlon_from_pairs, lonlat
from .samples import pseudonym
from .split import SPLITS

# Labels and colours of the splits and of the map's points.
SPLIT_LABELS = {"train": "Training", "validation": "Validation", "test": "Final test"}
SPLIT_COLOURS = {"train": "#0B63CE", "validation": "#D97706", "test": "#C0264A"}
ORIGIN_RGBA = (31, 41, 55, 230)
ACTUAL_RGBA = (16, 185, 129, 240)
REFINED_RGBA = (239, 68, 68, 240)
ACTUAL_LINE_RGBA = (16, 185, 129, 150)
REFINED_LINE_RGBA = (239, 68, 68, 150)


def _by_split(values: dict[str, str]) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.element_at(mapping, F.col("split"))


def trip_routes(trips: DataFrame) -> DataFrame:
    """One route per trip. ``trips`` carries ``split`` and point-struct trajectories."""
    return trips.select(
        "trip_id",
        pseudonym(F.col("VIN")).alias("vehicle_id"),
        "split",
        _by_split(SPLIT_LABELS).alias("split_label"),
        _by_split(SPLIT_COLOURS).alias("color"),
        F.col("StartTrip").alias("start_time"),
        "distance_km",
        "duration_minutes",
        F.size("Trajectory").alias("point_count"),
        lonlat(F.col("Trajectory")).alias("path"),
    )


def coverage_counts(trips: DataFrame) -> DataFrame:
    """(split, label, trip_count, vehicle_count) for all three splits and in total.

    One aggregation: each trip counts for its split and for the total.
    """
    counted = (
        trips.select("VIN", F.explode(F.array("split", F.lit("total"))).alias("split"))
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("t"), F.count_distinct("VIN").alias("v"))
    )
    names = trips.sparkSession.createDataFrame(
        [(s, SPLIT_LABELS[s]) for s in SPLITS] + [("total", "Total")], "split string, label string"
    )
    return names.join(counted, "split", "left").select(
        "split",
        "label",
        F.coalesce("t", F.lit(0)).alias("trip_count"),
        F.coalesce("v", F.lit(0)).alias("vehicle_count"),
    )


def map_bounds(trips: DataFrame) -> DataFrame:
    """Corner coordinates of all trajectories, without exploding them."""

    def edge(reduce, over, part: str) -> Column:
        return over(reduce(F.transform("Trajectory", lambda p: p[part])))

    return trips.agg(
        edge(F.array_min, F.min, "latitude").alias("south"),
        edge(F.array_min, F.min, "longitude").alias("west"),
        edge(F.array_max, F.max, "latitude").alias("north"),
        edge(F.array_max, F.max, "longitude").alias("east"),
    )


def enriched_candidates(candidates: Column, actual: Column, grid_size: float) -> Column:
    """Candidates with their distance to the actual destination and cell polygon."""
    return F.transform(
        candidates,
        lambda c: c.withField("error_to_actual_km", km_between(c, actual)).withField(
            "polygon", grid_polygon(c["cell"], grid_size)
        ),
    )


def _rgba(values: tuple[int, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def prediction_layers(predictions: DataFrame, grid_size: float) -> DataFrame:
    """Everything a map of one prediction needs, nested, one row per prediction.

    ``predictions`` also carries ``trajectory`` and ``trajectory_prefix``.
    """

    def place(kind: str) -> Column:
        return F.struct(
            F.col(f"{kind}_latitude").alias("latitude"), F.col(f"{kind}_longitude").alias("longitude")
        )

    def marker(kind: str, label: Column, at: Column, colour: tuple[int, ...]) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            label.alias("label"),
            at["latitude"].alias("latitude"),
            at["longitude"].alias("longitude"),
            _rgba(colour).alias("color"),
        )

    def line(to: Column, colour: tuple[int, ...]) -> Column:
        ends = [F.array(p["longitude"], p["latitude"]) for p in (place("origin"), to)]
        return F.struct(F.array(*ends).alias("path"), _rgba(colour).alias("color"))

    origin, actual, refined = place("origin"), place("actual"), place("predicted")

    def middle(part: str) -> Column:
        return (origin[part] + actual[part] + refined[part]) / 3

    refined_label = F.format_string("Refined prediction (%.2f km error)", F.col("error_km"))
    return predictions.select(
        "sample_id",
        lonlat(F.col("trajectory")).alias("trajectory"),
        lonlat(F.col("trajectory_prefix")).alias("prefix"),
        F.array(
            marker("origin", F.lit("Prediction origin"), origin, ORIGIN_RGBA),
            marker("actual", F.lit("Actual destination"), actual, ACTUAL_RGBA),
            marker("refined", refined_label, refined, REFINED_RGBA),
        ).alias("points"),
        enriched_candidates(F.col("top_k_candidates"), actual, grid_size).alias("candidates"),
        F.array(line(actual, ACTUAL_LINE_RGBA), line(refined, REFINED_LINE_RGBA)).alias("lines"),
        F.struct(middle("latitude").alias("latitude"), middle("longitude").alias("longitude")).alias("center"),
    )


def parse_prefix_text(text: Column) -> Column:
    """Editable prefix JSON to struct (points, error).

    Accepts [[lat, lon], ...] or {"points": [[lat, lon], ...]}; names the first bad point.
    """
    bare = F.from_json(text, "array<array<double>>")
    keyed = F.from_json(text, "points array<array<double>>")["points"]
    pairs = F.when(F.left(F.ltrim(text), F.lit(1)) == "{", keyed).otherwise(bare)
    points = latlon_from_pairs(pairs)

    def wrong(p: Column) -> Column:
        return p["latitude"].isNull() | p["longitude"].isNull()

    def off(p: Column) -> Column:
        return ~in_bounds(p["latitude"], p["longitude"])

    verdicts = F.transform(
        points,
        lambda p, i: F.when(
            wrong(p), F.format_string("Prefix point %d must be [latitude, longitude]", i + 1)
        ).when(off(p), F.format_string("Prefix point %d is outside valid coordinate bounds", i + 1)),
    )
    readable = F.try_parse_json(text).isNotNull()
    error = (
        F.when(~readable | text.isNull(), "Custom prefix is not valid JSON")
        .when(
            F.coalesce(F.size(pairs), F.lit(0)) <= 0,
            "Custom prefix must be a non-empty JSON array of [lat, lon]",
        )
        .otherwise(F.get(F.array_compact(verdicts), F.lit(0)))
    )
    return F.struct(F.when(error.isNull(), points).alias("points"), error.alias("error"))


def prefix_text(points: Column) -> Column:
    """Points as JSON text [[lat, lon], ...] at seven decimals."""
    return F.to_json(
        F.transform(points, lambda p: F.array(F.round(p["latitude"], 7), F.round(p["longitude"], 7)))
    )
