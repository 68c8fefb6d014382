"""Report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BuildSettings
from ..functions.geo import km_between
from ..schema import FEATURE_INPUTS
from .spread import exact_quantiles


def vehicle_list(trips: DataFrame) -> DataFrame:
    return trips.groupBy("VIN").agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.min("StartTrip").alias("first_trip"),
        F.max("StartTrip").alias("last_trip"),
    )


def raw_profile(raw: DataFrame, cfg: BuildSettings, approximate: bool = False) -> DataFrame:
    """Rows and distinct vehicles, triggers and signals of a raw table."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return raw.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        distinct(F.col(cfg.vin_column)).alias("vins"),
        distinct(F.col(cfg.trigger_column)).alias("triggers"),
        distinct(F.col(cfg.signal_column)).alias("signals"),
    )


def split_summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_distinct("VIN").alias("vins"),
        F.count_distinct("trip_id").alias("trips"),
    )


def overview(trips: DataFrame) -> DataFrame:
    return trips.agg(
        F.count(F.lit(1)).alias("trips"),
        F.count_distinct("VIN").alias("vehicles"),
        F.coalesce(F.sum("point_count"), F.lit(0)).alias("points"),
    )


def median_error_by_prefix(predictions: DataFrame) -> DataFrame:
    return exact_quantiles(predictions, ["prefix_fraction"], "error_km", {"median_error_km": 0.5})


def split_kpis(predictions: DataFrame) -> DataFrame:
    """Median, P90, top-3 share and vehicles per split."""
    ranks = F.col("actual_rank")
    plain = predictions.groupBy("split").agg(
        F.avg(F.when(ranks.isNotNull(), (ranks <= 3).cast("double"))).alias("top_3"),
        F.count_distinct("VIN").alias("vehicles"),
    )
    q = exact_quantiles(predictions, ["split"], "error_km", {"median_km": 0.5, "p90_km": 0.9})
    return plain.join(q, "split")


def error_histogram(predictions: DataFrame, value: str = "error_km") -> DataFrame:
    """Equal-width right-closed bins, empty ones kept: (bin, low, high, predictions).

    4 to 12 bins by the root of the row count. Two passes over the rows, both plain
    aggregations; the bin table has 12 rows at most.
    """
    span = predictions.agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    bins = F.least(F.lit(12), F.greatest(F.lit(4), F.floor(F.sqrt("n")).cast("int")))
    flat = F.col("lo") == F.col("hi")
    pad = F.when(F.col("lo") == 0, 0.001).otherwise(F.abs("lo") * 0.001)
    span = span.select(
        bins.alias("b"),
        flat.alias("flat"),
        F.when(flat, F.col("lo") - pad).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + pad).otherwise(F.col("hi")).alias("hi"),
    ).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("b"))
    whole = span.select(F.struct("*")).scalar()

    def edge(i: Column) -> Column:
        return i * F.col("s.w") + F.col("s.lo")

    x = F.col(value)
    guess = F.greatest(F.lit(1), F.ceil((x - F.col("s.lo")) / F.col("s.w"))).cast("int")
    # The edges decide, not the quotient's rounding.
    low, high = edge(F.col("g") - 1), edge(F.col("g"))
    settled = (
        F.when((F.col("g") > 1) & (x <= low), F.col("g") - 1)
        .when((F.col("g") < F.col("s.b")) & (x > high), F.col("g") + 1)
        .otherwise(F.least(F.col("g"), F.col("s.b")))
    )
    counted = (
        predictions.select(value)
        .withColumn("s", whole)
        .withColumn("g", guess)
        .groupBy(settled.alias("bin"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(1), F.col("b"))))
    at = (F.col("bin") - 1) * F.col("w") + F.col("lo")
    first = F.col("bin") == 1
    widened = F.when(first & ~F.col("flat"), at - (F.col("hi") - F.col("lo")) * 0.001).otherwise(at)
    return grid.join(counted, "bin", "left").select(
        "bin",
        widened.alias("low"),
        F.when(F.col("bin") == F.col("b"), F.col("hi")).otherwise(F.col("bin") * F.col("w") + F.col("lo")).alias("high"),
        F.coalesce("c", F.lit(0)).alias("predictions"),
    )


def worst_errors(predictions: DataFrame, n: int) -> DataFrame:
    """The n predictions with the largest error; ties by sample id."""
    return (
        predictions.select(
            "sample_id", "vehicle_id", "trip_id", "prefix_fraction", "error_km", "actual_rank", "predicted_cell_probability"
        )
        .orderBy(F.col("error_km").desc(), "sample_id")
        .limit(n)
    )


def candidate_table(predictions: DataFrame) -> DataFrame:
    """One row per candidate: rank, probability in percent, distance to actual, cell."""
    actual = F.struct(
        F.col("actual_latitude").alias("latitude"), F.col("actual_longitude").alias("longitude")
    )
    rows = predictions.withColumn("actual", actual).select(
        "sample_id", "actual", F.explode("top_k_candidates").alias("c")
    )
    return rows.select(
        "sample_id",
        F.col("c.rank").alias("rank"),
        F.format_string("%.1f%%", F.col("c.probability") * 100.0).alias("probability"),
        F.format_string("%.2f", km_between(F.col("c"), F.col("actual"))).alias("distance_km"),
        F.col("c.cell").alias("cell"),
    )


def feature_audit(samples: DataFrame, sources: Column | None = None) -> DataFrame:
    """Unpivot the features to (sample_id, feature, value, source).

    ``sources``: struct or map column with departure_time, origin, trajectory_prefix
    and history; without it every feature counts as derived.
    """

    def source(of: str) -> Column:
        return F.lit("derived") if sources is None else F.coalesce(sources[of], F.lit("derived"))

    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.col(name).cast("double").alias("value"),
                source(read).alias("source"),
            )
            for name, read in FEATURE_INPUTS.items()
        ]
    )
    return samples.select("sample_id", F.inline(rows))
