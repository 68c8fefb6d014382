"""Registered queries: one per operator or natural group of operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.config import SampleSettings
from tripweave.functions.geo import grid_cell
from tripweave.operators.ranking import prediction_rows
from tripweave.operators.samples import prepare_samples
from tripweave.operators.split import make_split
from tripweave.plans.build import TripBuild, build_trips
from tripweave.session import prepare, stage

from .oracle import sql
from .telemetry import SETTINGS, telemetry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

class Run:
    """Stage outputs of one data folder, written once and read by the queries.

    The same hand-off as in a production run, where later stages read the written
    trips, samples and predictions.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        return stage(telemetry(self.spark, self.sf_dir), "raw")

    @cached_property
    def build(self) -> TripBuild:
        return build_trips(self.raw, SETTINGS)

    @cached_property
    def trips(self) -> DataFrame:
        return stage(self.build.trips, "trips")

    @cached_property
    def manifest(self) -> DataFrame:
        return stage(make_split(self.trips, SAMPLES), "manifest")

    @cached_property
    def samples(self) -> DataFrame:
        return stage(prepare_samples(self.trips, SAMPLES), "samples")

    @cached_property
    def predictions(self) -> DataFrame:
        return stage(prediction_rows(stand_in_scores(self.samples), 5, SAMPLES.grid_cell_degrees), "predictions")


SAMPLES = SampleSettings()
_runs: dict[tuple[str, str], Run] = {}


def run(spark: SparkSession, sf_dir: str) -> Run:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        _runs[key] = Run(spark, sf_dir)
    return _runs[key]


def build(spark: SparkSession, sf_dir: str) -> TripBuild:
    return run(spark, sf_dir).build


def stand_in_scores(samples: DataFrame) -> DataFrame:
    """Model output by plain arithmetic on the start time, so SQL can say the same.

    Seven candidate cells around the actual one with probabilities in fiftieths
    (ties occur), and predicted coordinates up to 0.05 degrees off.
    """
    lat, lon, f = F.col("actual_latitude"), F.col("actual_longitude"), F.col("prefix_fraction")

    def off(divisor: int) -> Column:
        digits = F.expr(f"(unix_micros(StartTrip) div {divisor}) % 1000")
        return (digits / 1000.0 - 0.5) * 0.1 * (1.0 - f)

    cells = [grid_cell(lat + (i - 3) * 0.01, lon, SAMPLES.grid_cell_degrees) for i in range(7)]
    chances = [F.expr(f"(unix_micros(StartTrip) div {i + 3}) % 50") / 50.0 for i in range(7)]
    return (
        samples.withColumn("predicted_latitude", lat + off(7))
        .withColumn("predicted_longitude", lon + off(11))
        .withColumn("cells", F.array(*cells))
        .withColumn("probabilities", F.array(*chances))
    )


def register(name: str, steps: str | None = None, final: str | None = None):
    def wrap(fn: Query) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = query
        if final is not None:
            ORACLES[name] = sql(steps, final)
        return fn

    return wrap


def us(c: str) -> Column:
    return F.unix_micros(c)


def joined(c: str | Column) -> Column:
    return F.array_join(c, ";")
