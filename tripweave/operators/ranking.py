"""Scores to ranked candidates and prediction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import grid_centre, with_error_km

# Columns of the predictions table, in order.
PREDICTION_COLUMNS = (
    "sample_id",
    "VIN",
    "vehicle_id",
    "trip_id",
    "split",
    "prefix_fraction",
    "origin_latitude",
    "origin_longitude",
    "actual_latitude",
    "actual_longitude",
    "actual_cell",
    "predicted_latitude",
    "predicted_longitude",
    "predicted_cell",
    "predicted_cell_probability",
    "actual_rank",
    "top_k_candidates",
)


def top_candidates(cells: Column, probabilities: Column, k: Column | int, grid_size: float) -> Column:
    """The k most probable cells as (rank, cell, probability, latitude, longitude).

    k is held between 1 and the number of cells; equal probabilities go by cell.
    """
    k = F.lit(k) if isinstance(k, int) else k
    most = F.greatest(F.lit(1), F.least(k, F.size(cells)))
    scored = F.zip_with(
        cells, probabilities, lambda c, p: F.struct((-p).alias("sort"), c.alias("cell"), p.alias("probability"))
    )

    def candidate(s: Column, i: Column) -> Column:
        centre = grid_centre(s["cell"], grid_size)
        return F.struct(
            (i + 1).alias("rank"),
            s["cell"].alias("cell"),
            s["probability"].alias("probability"),
            centre["latitude"].alias("latitude"),
            centre["longitude"].alias("longitude"),
        )

    return F.transform(F.slice(F.array_sort(scored), F.lit(1), most), candidate)


def rank_of(candidates: Column, cell: Column) -> Column:
    """Rank of ``cell`` among the candidates; null when it is not there."""
    found = F.array_position(F.transform(candidates, lambda c: c["cell"]), cell)
    return F.nullif(found, F.lit(0)).cast("int")


def prediction_rows(scored: DataFrame, top_k: Column | int, grid_size: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """Samples with ``cells``, ``probabilities`` and predicted coordinates to predictions."""
    ranked = scored.withColumn(
        "top_k_candidates", top_candidates(F.col("cells"), F.col("probabilities"), top_k, grid_size)
    )
    best = F.get("top_k_candidates", F.lit(0))
    rows = (
        ranked.withColumn("predicted_cell", best["cell"])
        .withColumn("predicted_cell_probability", best["probability"])
        .withColumn("actual_rank", rank_of(F.col("top_k_candidates"), F.col("actual_cell")))
        .select(*PREDICTION_COLUMNS, *extra)
    )
    return with_error_km(rows)


def coordinates_from_residuals(df: DataFrame) -> DataFrame:
    """Predicted coordinates from (residual_latitude, residual_longitude) in 1/100 degree."""
    return df.withColumn(
        "predicted_latitude", F.col("origin_latitude") + F.col("residual_latitude") / 100.0
    ).withColumn("predicted_longitude", F.col("origin_longitude") + F.col("residual_longitude") / 100.0)


def class_weights(samples: DataFrame) -> DataFrame:
    """(actual_cell, class_weight) over the training split: n / (classes * members)."""
    per_cell = samples.filter("split = 'train'").groupBy("actual_cell").agg(F.count(F.lit(1)).alias("members"))
    size = per_cell.agg(F.struct(F.sum("members").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return per_cell.withColumn("_size", size).select(
        "actual_cell",
        (F.col("_size.n") / (F.col("_size.k") * F.col("members"))).alias("class_weight"),
    )
