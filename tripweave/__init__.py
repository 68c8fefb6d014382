"""Vehicle-telemetry analytics on Spark: cleaning, trips, samples, models, metrics."""

from .config import (
    BuildSettings,
    EvaluationSettings,
    ForestSettings,
    ProjectSettings,
    SampleSettings,
    SpreadSettings,
)

__all__ = [
    "BuildSettings",
    "EvaluationSettings",
    "ForestSettings",
    "ProjectSettings",
    "SampleSettings",
    "SpreadSettings",
]
