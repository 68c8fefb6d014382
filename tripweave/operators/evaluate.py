"""Geographic and ranking metrics; an undefined metric is null."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EvaluationSettings
from .spread import exact_quantiles

GROUPS = ("split", "prefix_fraction")


def _require_rows(predictions: DataFrame, message: str) -> None:
    if predictions.isEmpty():
        raise ValueError(message)


def prediction_metrics(
    predictions: DataFrame, cfg: EvaluationSettings | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """One metric row, or one per value of ``keys``.

    ``predictions`` is read several times: pass a written table.
    """
    cfg = cfg or EvaluationSettings()
    keys = list(keys)
    _require_rows(predictions, "Cannot evaluate an empty prediction table")
    error, rank = F.col("error_km"), F.col("actual_rank")
    aggs = [
        F.count(F.lit(1)).alias("sample_count"),
        F.count_distinct("trip_id").alias("trip_count"),
        F.count_distinct("VIN").alias("vin_count"),
        F.avg(error).alias("mean_haversine_km"),
        *[
            F.avg(F.when(error <= d, 1.0).otherwise(0.0)).alias(f"recall_within_{d:g}km")
            for d in cfg.recall_distances_km
        ],
        F.count(rank).alias("cell_metrics_defined_samples"),
        F.count_if(rank.isNull()).alias("cell_metrics_undefined_samples"),
        *[
            F.avg(F.when(rank.isNotNull(), (rank <= k).cast("double"))).alias(f"top_{k}_cell_accuracy")
            for k in cfg.top_k
        ],
        F.avg(F.lit(1.0) / rank).alias("mean_reciprocal_rank"),
    ]
    plain = predictions.groupBy(*keys).agg(*aggs)
    marks = {"median_haversine_km": 0.5, "p90_haversine_km": 0.9}
    quantiles = exact_quantiles(predictions, keys, "error_km", marks)
    if not keys:
        one = quantiles.select(F.struct(*marks)).scalar()
        merged = plain.withColumn("_q", one)
        return merged.select(
            *plain.columns[:4], *[F.col(f"_q.{m}").alias(m) for m in marks], *plain.columns[4:]
        )
    renamed = quantiles.withColumnsRenamed({k: f"_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    head = len(keys) + 4
    return plain.join(renamed, match).select(*plain.columns[:head], *marks, *plain.columns[head:])


def metrics_by_group(
    predictions: DataFrame, columns: Sequence[str] = GROUPS, cfg: EvaluationSettings | None = None
) -> DataFrame:
    """Metrics per value of each column, stacked as (group, value, ...); nulls are a group.

    Absent columns are skipped. Metrics use default limits unless ``cfg`` is given.
    """
    present = [c for c in columns if c in predictions.columns]
    if not present:
        raise ValueError(f"None of the group columns exist: {list(columns)}")
    pairs = F.array(
        *[F.struct(F.lit(c).alias("group"), F.col(c).cast("string").alias("value")) for c in present]
    )
    stacked = predictions.select("trip_id", "VIN", "error_km", "actual_rank", F.inline(pairs))
    return prediction_metrics(stacked, cfg, ["group", "value"])


def evaluate_split(predictions: DataFrame, split: str = "test", cfg: EvaluationSettings | None = None) -> DataFrame:
    """Metrics of one split of a saved predictions table."""
    chosen = predictions.filter(F.col("split") == split)
    _require_rows(chosen, f"No predictions exist for split {split!r}")
    return prediction_metrics(chosen, cfg)
