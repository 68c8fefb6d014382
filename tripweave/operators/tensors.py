"""Model-ready arrays: scaled context, label vocabulary, padded sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SampleSettings
from ..functions.geo import bearing_between, km_between
from ..functions.paths import first_of
from ..schema import FEATURES
from .spread import with_ordinal, with_prefix


def _of_train(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("split") == "train")


def context_statistics(samples: DataFrame) -> DataFrame:
    """(feature, mean, scale) over the training split; population deviation, 1 if ~0."""
    stats = _of_train(samples).agg(
        *[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"m_{c}").alias("mean"),
                F.when(F.col(f"s_{c}") < 1e-8, 1.0).otherwise(F.col(f"s_{c}")).alias("scale"),
            )
            for c in FEATURES
        ]
    )
    return stats.select(F.inline(rows))


def scaled_context(samples: DataFrame, statistics: DataFrame) -> DataFrame:
    """Append ``context``: the features as (value - mean) / scale, in model order."""
    table = statistics.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale"))))
    ).scalar()
    s = samples.withColumn("_stats", table)

    def scaled(c: str) -> Column:
        entry = F.element_at("_stats", F.lit(c))
        return (F.col(c) - entry["mean"]) / entry["scale"]

    return s.withColumn("context", F.array(*[scaled(c) for c in FEATURES])).drop("_stats")


def vocabulary(samples: DataFrame) -> DataFrame:
    """(cell, label): training cells in text order, labels from 0.

    Labels come from counts per text prefix, so ranking needs no single sort. A prefix grows
    until few cells share it.
    """
    cells = _of_train(samples).select(F.col("actual_cell").alias("cell")).distinct()
    ranked = with_ordinal(with_prefix(cells, "cell", "_p", 5), [], "_p", ["cell"], "_r")
    return ranked.select("cell", (F.col("_r") - 1).cast("int").alias("label"))


def require_vocabulary(words: DataFrame) -> DataFrame:
    """Pass the vocabulary through; fewer than two cells fail at once."""
    if words.limit(2).count() < 2:
        raise ValueError("At least two training cells are required")
    return words


def labelled(samples: DataFrame, words: DataFrame) -> DataFrame:
    """Append ``label`` and ``label_weight``; unknown cells get label 0, weight 0."""
    w = words.select(F.col("cell").alias("_cell"), F.col("label").alias("_label"))
    return (
        samples.join(w, F.col("actual_cell") == F.col("_cell"), "left")
        .withColumn("label", F.coalesce("_label", F.lit(0)))
        .withColumn("label_weight", F.when(F.col("_label").isNotNull(), 1.0).otherwise(0.0))
        .drop("_cell", "_label")
    )


def _last(items: Column, most: int) -> Column:
    n = F.least(F.size(items), F.lit(most))
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def _zeros(width: int, times: Column) -> Column:
    return F.array_repeat(F.array(*[F.lit(0.0)] * width), times)


def trajectory_tensor(prefix: Column, most: int) -> Column:
    """most x 6 array, zero padded at the end: offsets * 100, step km, bearing, position."""
    points = _last(prefix, most)
    origin = first_of(points)

    def row(p: Column, i: Column) -> Column:
        before = F.get(points, F.greatest(i - 1, F.lit(0)))
        step = F.when(i > 0, km_between(before, p)).otherwise(F.lit(0.0))
        turn = F.radians(F.when(i > 0, bearing_between(before, p)).otherwise(F.lit(0.0)))
        return F.array(
            (p["latitude"] - origin["latitude"]) * 100.0,
            (p["longitude"] - origin["longitude"]) * 100.0,
            step,
            F.sin(turn),
            F.cos(turn),
            (i + 1) / F.size(points),
        )

    return F.concat(F.transform(points, row), _zeros(6, F.lit(most) - F.size(points)))


def history_tensor(history: Column, origin_lat: Column, origin_lon: Column, start: Column, most: int) -> Column:
    """most x 4 array, zero padded in front: offsets * 100, log1p(age in days), position."""
    if most == 0:
        return F.array().cast("array<array<double>>")
    items = _last(history, most)
    now = F.unix_micros(start) / 1e6

    def row(h: Column, i: Column) -> Column:
        age = F.greatest(F.lit(0.0), (now - h["completed_at"]) / 86400.0)
        return F.array(
            (h["latitude"] - origin_lat) * 100.0,
            (h["longitude"] - origin_lon) * 100.0,
            F.log1p(age),
            (i + 1) / F.size(items),
        )

    return F.concat(_zeros(4, F.lit(most) - F.size(items)), F.transform(items, row))


def model_arrays(
    samples: DataFrame, cfg: SampleSettings, statistics: DataFrame | None = None, words: DataFrame | None = None
) -> DataFrame:
    """Inputs, targets and weights of a sequence model, one row per sample."""
    statistics = statistics if statistics is not None else context_statistics(samples)
    words = require_vocabulary(words if words is not None else vocabulary(samples))
    ready = labelled(scaled_context(samples, statistics), words)
    return ready.select(
        "sample_id",
        "split",
        trajectory_tensor(F.col("trajectory_prefix"), cfg.max_trajectory_points).alias("trajectory"),
        "context",
        history_tensor(
            F.col("history_sequence"),
            F.col("origin_latitude"),
            F.col("origin_longitude"),
            F.col("StartTrip"),
            cfg.max_history_trips,
        ).alias("history"),
        "label",
        "label_weight",
        F.array(
            (F.col("actual_latitude") - F.col("origin_latitude")) * 100.0,
            (F.col("actual_longitude") - F.col("origin_longitude")) * 100.0,
        ).alias("coordinate"),
        F.lit(1.0).alias("coordinate_weight"),
    )
