"""Whole trip build: raw telemetry to six outputs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BuildSettings, SpreadSettings
from ..operators import clean as C
from ..operators import events as E
from ..operators import outcomes as O
from ..operators import pairing as P
from ..operators import trips as T
from ..session import prepare, stage

# Fixed value: note carried by every build audit.
TIMESTAMP_NOTE = (
    "The raw trajectory arrays have no per-point timestamps; point timestamps "
    "are deterministically interpolated between StartTrip and EndTrip."
)


@dataclass(frozen=True)
class TripBuild:
    """Outputs of one build.

    Four tables are staged because several steps read them: ``judged`` (the only pass over
    the raw table: rules, copies, parsed arrays), ``events`` (end of the work on rows),
    ``paired`` (the timeline, by route) and ``outcomes`` (end of the work per trip).
    Everything else is a lazy view of those.
    """

    raw: DataFrame
    settings: BuildSettings
    spread: SpreadSettings

    @cached_property
    def rows(self) -> DataFrame:
        return C.canonical(self.raw, self.settings)

    @cached_property
    def judged(self) -> C.Judged:
        return C.judge(self.raw, self.settings)

    @cached_property
    def data(self) -> DataFrame:
        return self.judged.retained

    @cached_property
    def discarded(self) -> DataFrame:
        return self.judged.discarded

    @cached_property
    def reason_counts(self) -> DataFrame:
        """Counted once; both audits read it."""
        return stage(self.judged.counts, "reasons")

    @cached_property
    def events(self) -> DataFrame:
        return stage(E.extract_events(self.data, self.settings), "events")

    @cached_property
    def paired(self) -> DataFrame:
        return stage(P.routed_events(self.events, self.settings, self.spread), "paired", ("route",))

    @cached_property
    def outcomes(self) -> DataFrame:
        return stage(O.outcomes(self.paired, self.settings), "outcomes", ("accepted",))

    @cached_property
    def accepted(self) -> DataFrame:
        return T.accepted_trips(self.outcomes, E.vehicle_metadata(self.events, self.settings))

    @cached_property
    def trips(self) -> DataFrame:
        return T.trip_table(self.accepted, self.settings)

    @cached_property
    def points(self) -> DataFrame:
        return T.point_table(self.accepted, self.settings)

    @cached_property
    def rejected(self) -> DataFrame:
        return O.rejections(self.outcomes)

    @cached_property
    def lineage(self) -> DataFrame:
        return T.lineage(self.accepted)

    @cached_property
    def cleaned_source(self) -> DataFrame:
        return T.cleaned_source(self.data, self.lineage, self.settings)

    @cached_property
    def _usage_counts(self) -> DataFrame:
        """One row: retained rows, rows used by accepted trips.

        Events know how many rows they folded, and a row feeds one event; so both
        numbers come from the staged tables without a second pass over raw rows.
        """
        retained = self.events.agg(F.coalesce(F.sum("source_rows"), F.lit(0)).alias("retained"))
        used = self.lineage.agg(F.count(F.lit(1)).alias("used"))
        return retained.withColumn("used", F.lit(0) + used.scalar())

    @cached_property
    def cleaning_audit(self) -> DataFrame:
        """(stage, reason, row_count)."""
        before = self.reason_counts.filter(F.col("reason").isNotNull()).select(
            F.lit("preconstruction").alias("stage"), "reason", "row_count"
        )
        after = self._usage_counts.select(
            F.lit("post_reconstruction").alias("stage"),
            F.lit("not_used_by_accepted_trip").alias("reason"),
            (F.col("retained") - F.col("used")).alias("row_count"),
        ).filter("row_count > 0")
        return before.unionByName(after)

    @cached_property
    def audit(self) -> DataFrame:
        """One row of counts for the whole build."""
        counts = C.cleaning_record(self.reason_counts)
        ev = self.events.agg(
            F.count_distinct("vin").alias("vins_after_filters"),
            F.count_if(F.col("kind") == E.START).alias("start_events"),
            F.count_if(F.col("kind") == E.END).alias("end_events"),
            F.count_if(F.col("kind") == E.BATCH).alias("trajectory_batches"),
        )
        ok = F.col("accepted")
        done = self.outcomes.agg(
            F.count_if(ok).alias("accepted_trips"),
            F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("accepted_points"),
            F.coalesce(F.sum(F.size("reasons")), F.lit(0)).alias("rejection_records"),
        )
        reasons = (
            self.rejected.groupBy("reason")
            .agg(F.count(F.lit(1)).alias("c"))
            .agg(
                F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "c")))).alias(
                    "rejection_counts"
                )
            )
        )

        def one(df: DataFrame) -> Column:
            return df.select(F.struct(*df.columns)).scalar()

        c, e, d, u = F.col("_c"), F.col("_e"), F.col("_d"), F.col("_u")
        spark = self.raw.sparkSession
        return (
            spark.range(1)
            .select(
                one(counts).alias("_c"),
                one(ev).alias("_e"),
                one(done).alias("_d"),
                one(self._usage_counts).alias("_u"),
                reasons.scalar().alias("rejection_counts"),
            )
            .select(
                F.lit(self.settings.fingerprint).alias("config_hash"),
                *[c[x].alias(x) for x in counts.columns],
                u["retained"].alias("raw_rows_after_filters"),
                F.coalesce(
                    F.try_element_at(c["preconstruction_discard_counts"], F.lit("exact_duplicate")), F.lit(0)
                ).alias("exact_duplicates_removed"),
                u["used"].alias("raw_rows_in_cleaned_trip_source"),
                (u["retained"] - u["used"]).alias("raw_rows_unused_after_reconstruction"),
                (c["raw_rows_received"] - u["used"]).alias("raw_rows_removed_from_final_source"),
                *[e[x].alias(x) for x in ev.columns],
                *[d[x].alias(x) for x in done.columns],
                "rejection_counts",
                F.lit(TIMESTAMP_NOTE).alias("timestamp_note"),
            )
        )


def build_trips(
    raw: DataFrame,
    settings: BuildSettings | None = None,
    spread: SpreadSettings | None = None,
) -> TripBuild:
    prepare(raw.sparkSession)
    return TripBuild(raw, settings or BuildSettings(), spread or SpreadSettings())
