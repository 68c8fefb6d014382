"""Which start, end and batch belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BuildSettings, SpreadSettings
from .events import BATCH, END, START, mark_kind, mark_time
from .spread import with_neighbour_marks, with_time_bucket


def pair_events(events: DataFrame) -> DataFrame:
    """Events with ``start_us`` and ``end_us`` of the trip they belong to.

    ``events`` carries ``bucket``; see ``with_time_bucket``.

    On a vehicle's timeline of starts and ends, a start pairs with the mark right
    after it when that is an end; this is the first end in [start, next start). So
    the nearest mark on each side decides everything, for batches too, and neither
    an as-of nor a range join is needed.

    start: end_us is null when the trip has no end. end: start_us is null when
    unmatched. batch: both null when it lies in no trip.
    """
    is_mark = F.col("kind") != BATCH
    marked = events.withColumn("mark", F.when(is_mark, F.col("pos")))
    linked = with_neighbour_marks(marked, ["vin"], "bucket", "pos", "mark")
    after_start = mark_kind(F.col("prev_mark")) == START
    before_end = mark_kind(F.col("next_mark")) == END
    prev_us, next_us = mark_time(F.col("prev_mark")), mark_time(F.col("next_mark"))
    kind = F.col("kind")
    start_us = (
        F.when(kind == START, F.col("ts_us"))
        .when((kind == END) & after_start, prev_us)
        .when((kind == BATCH) & after_start & before_end, prev_us)
    )
    end_us = (
        F.when(kind == END, F.col("ts_us"))
        .when((kind == START) & before_end, next_us)
        .when((kind == BATCH) & after_start & before_end, next_us)
    )
    return linked.withColumn("start_us", start_us).withColumn("end_us", end_us).drop(
        "mark", "prev_mark", "next_mark"
    )


# How a timeline row goes on: a trip within the duration limit, one beyond it, or
# no trip at all.
SHORT, LONG, ALONE = "short", "long", "alone"


def bucketed(events: DataFrame, spread: SpreadSettings) -> DataFrame:
    return with_time_bucket(events, "vin", "ts_us", spread)


def routed_events(events: DataFrame, cfg: BuildSettings, spread: SpreadSettings | None = None) -> DataFrame:
    """Paired events with ``route``; batches outside every trip are dropped."""
    events = bucketed(events, spread or SpreadSettings())
    limit_us = F.lit(int(round(cfg.max_duration_seconds * 1000000)))
    span = F.col("end_us") - F.col("start_us")
    route = F.when(span.isNull(), ALONE).when(span <= limit_us, SHORT).otherwise(LONG)
    meta = [c for c in events.columns if c.startswith("meta_")]
    paired = pair_events(events.drop("source_rows", *meta)).withColumn("route", route)
    return paired.filter((F.col("kind") != BATCH) | (F.col("route") != ALONE))


def _marks(events: DataFrame, spread: SpreadSettings | None) -> DataFrame:
    slim = events.filter(F.col("kind") != BATCH).select("vin", "ts_us", "kind", "pos")
    return pair_events(bucketed(slim, spread or SpreadSettings()))


def pairs(events: DataFrame, spread: SpreadSettings | None = None) -> DataFrame:
    """(vin, start_us, end_us) of every start; null end_us when it has none."""
    return _marks(events, spread).filter(F.col("kind") == START).select("vin", "start_us", "end_us")


def unmatched_ends(events: DataFrame, spread: SpreadSettings | None = None) -> DataFrame:
    stray = (F.col("kind") == END) & F.col("start_us").isNull()
    return _marks(events, spread).filter(stray).select("vin", "end_us")
