"""Queries over cleaning, trip building and audits (S, C, T ids)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tripweave.operators import events as E
from tripweave.operators import pairing
from tripweave.operators.clean import clean, cleaning_record

from .queries import build, joined, register, run, us
from .telemetry import SETTINGS, telemetry


@register("telemetry", "telemetry", """SELECT row_id, vin, trig AS trigger, name, scalar_text AS scalar,
  series_text AS series, time_text AS at, fuel, model FROM telemetry""")
def _(spark, sf):
    t = telemetry(spark, sf)
    return t.select(
        "row_id", "vin", F.col("triggerOrContext").alias("trigger"), "name",
        F.col("scalarValue").alias("scalar"), F.col("timeSeriesValue").alias("series"),
        F.col("vehicleCollectionTime").alias("at"), "fuel", "model",
    )


@register("canonical_rows", "canon", "SELECT row_id, vin, trig AS trigger, signal, scalar, series, ts AS ts_us FROM canon")
def _(spark, sf):
    return build(spark, sf).rows.select(
        F.col("source_row_id").alias("row_id"), "vin", "trigger", "signal", "scalar", "series",
        us("timestamp").alias("ts_us"),
    )


@register("clean_rows", "cleaned", """SELECT row_id, vin, trig AS trigger, signal, scalar, series, ts AS ts_us,
  fuel, model FROM cleaned""")
def _(spark, sf):
    return build(spark, sf).data.select(
        F.col("source_row_id").alias("row_id"), "vin", "trigger", "signal", "scalar", "series",
        us("timestamp").alias("ts_us"), "fuel", "model",
    )


@register("discard_log", "judged", "SELECT row_id, reason FROM judged WHERE reason IS NOT NULL")
def _(spark, sf):
    return build(spark, sf).discarded.select(F.col("source_row_id").alias("row_id"), "reason")


@register("clean_reason_counts", "judged", """SELECT coalesce(reason,'retained') AS reason, count(*) AS row_count
  FROM judged GROUP BY 1""")
def _(spark, sf):
    return build(spark, sf).reason_counts.select(F.coalesce("reason", F.lit("retained")).alias("reason"), "row_count")


@register("cleaning_record", "judged", """SELECT count(*) AS received, count(*) FILTER (reason IS NULL) AS retained,
  count(*) FILTER (reason IS NOT NULL) AS discarded,
  (SELECT string_agg(reason || '=' || c, ';' ORDER BY reason) FROM
    (SELECT reason, count(*) AS c FROM judged WHERE reason IS NOT NULL GROUP BY 1)) AS counts FROM judged""")
def _(spark, sf):
    r = cleaning_record(build(spark, sf).reason_counts)
    counts = F.transform(
        F.array_sort(F.map_entries("preconstruction_discard_counts")),
        lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")),
    )
    return r.select(
        F.col("raw_rows_received").alias("received"),
        F.col("rows_retained_for_reconstruction").alias("retained"),
        F.col("rows_discarded_before_reconstruction").alias("discarded"),
        joined(counts).alias("counts"),
    )


@register("start_end_events", "trigger_events", """SELECT vin, ts AS ts_us, kind, round(lat,6) AS lat, round(lon,6) AS lon,
  round(alt,6) AS alt, concat_ws(';', lat_row, lon_row, alt_row) AS row_ids, coalesce(dup,'') AS duplicates FROM trigger_events""")
def _(spark, sf):
    return build(spark, sf).events.filter("kind <> 1").select(
        "vin", "ts_us", "kind", *[F.round(c, 6).alias(c) for c in ("lat", "lon", "alt")],
        joined(F.col("source_row_ids").cast("array<string>")).alias("row_ids"),
        joined("duplicate_signals").alias("duplicates"),
    )


@register("batches", "batches", """SELECT vin, ts AS ts_us, coalesce(error,'') AS error,
  CASE WHEN error IS NULL THEN len(lats) ELSE 0 END AS n_points,
  CASE WHEN error IS NULL THEN round(lats[1],6) END AS first_lat, CASE WHEN error IS NULL THEN round(lons[-1],6) END AS last_lon,
  CASE WHEN error IS NULL THEN round(alts[1],6) END AS first_alt,
  concat_ws(';', lat_row, lon_row, alt_row) AS row_ids FROM batches""")
def _(spark, sf):
    p = F.col("coordinates")
    b = E.trajectory_batches(build(spark, sf).events)
    return b.select(
        "vin", us("timestamp").alias("ts_us"), F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce(F.size(p), F.lit(0)).alias("n_points"),
        F.round(F.get(p, F.lit(0))["latitude"], 6).alias("first_lat"),
        F.round(F.get(p, F.size(p) - 1)["longitude"], 6).alias("last_lon"),
        F.round(F.get(p, F.lit(0))["altitude"], 6).alias("first_alt"),
        joined(F.col("source_row_ids").cast("array<string>")).alias("row_ids"),
    )


@register("pairs", "paired", "SELECT vin, s_us AS start_us, e_us AS end_us FROM paired")
def _(spark, sf):
    return pairing.pairs(build(spark, sf).events)


@register("unmatched_ends", "stray", "SELECT vin, e_us AS end_us FROM stray")
def _(spark, sf):
    return pairing.unmatched_ends(build(spark, sf).events)


@register("trip_batches", "paired trip_batches", """SELECT vin, s_us AS start_us, e_us AS end_us, ts AS ts_us,
  coalesce(error,'') AS error FROM trip_batches""")
def _(spark, sf):
    b = build(spark, sf)
    slim = b.events.select("vin", "ts_us", "kind", "pos", "error")
    return pairing.pair_events(pairing.bucketed(slim, b.spread)).filter("kind = 1 AND start_us IS NOT NULL").select(
        "vin", "start_us", "end_us", "ts_us", F.coalesce("error", F.lit("")).alias("error")
    )


@register("rejections", "rejected", "SELECT vin, s_us AS start_us, e_us AS end_us, reason, detail FROM rejected")
def _(spark, sf):
    return build(spark, sf).rejected.select(
        F.col("VIN").alias("vin"), us("StartTrip").alias("start_us"), us("EndTrip").alias("end_us"), "reason", "detail"
    )


@register("vehicle_metadata", "metadata", """SELECT vin, fuel, CAST(NULL AS VARCHAR) AS hyb, model,
  concat_ws(';', CASE WHEN mixed_fuel THEN 'inconsistent_metadata:fuel' END,
   CASE WHEN mixed_model THEN 'inconsistent_metadata:model' END) AS flags FROM metadata""")
def _(spark, sf):
    b = build(spark, sf)
    return E.vehicle_metadata(b.events, b.settings).select(
        "vin", "fuel", "hyb", "model", joined("metadata_flags").alias("flags")
    )


@register("trips", "accepted", """SELECT vin, trip_id, s_us AS start_us, e_us AS end_us, CAST(printf('%.7f', slat) AS DOUBLE) AS start_latitude,
  CAST(printf('%.7f', slon) AS DOUBLE) AS start_longitude, salt AS start_altitude_m, CAST(printf('%.7f', elat) AS DOUBLE) AS end_latitude, CAST(printf('%.7f', elon) AS DOUBLE) AS end_longitude,
  ealt AS end_altitude_m, CAST(printf('%.3f', dur) AS DOUBLE) AS duration_seconds, CAST(printf('%.3f', dur/60) AS DOUBLE) AS duration_minutes,
  CAST(printf('%.3f', dist) AS DOUBLE) AS distance_m, CAST(printf('%.6f', dist/1000) AS DOUBLE) AS distance_km, CAST(printf('%.3f', straight) AS DOUBLE) AS straight_line_distance_m,
  CAST(printf('%.3f', dist/dur*3.6) AS DOUBLE) AS average_speed_kmh, CAST(printf('%.3f', vmax) AS DOUBLE) AS max_segment_speed_kmh, CAST(n AS INT) AS point_count,
  CASE WHEN flags='' THEN 'accepted' ELSE 'accepted_with_flags' END AS quality_status, flags AS quality_flags, fuel, model
  FROM accepted""")
def _(spark, sf):
    t = build(spark, sf).trips
    return t.select(
        F.col("VIN").alias("vin"), "trip_id", us("StartTrip").alias("start_us"), us("EndTrip").alias("end_us"),
        *[c for c in t.columns if c.startswith(("start_", "end_"))],
        "duration_seconds", "duration_minutes", "distance_m", "distance_km", "straight_line_distance_m",
        "average_speed_kmh", "max_segment_speed_kmh", "point_count", "quality_status",
        joined("quality_flags").alias("quality_flags"), "fuel", "model",
    )


@register("points", "points", """SELECT trip_id, vin, CAST(idx AS INT) AS point_index,
  CASE WHEN idx=0 THEN 'start' WHEN idx=n-1 THEN 'destination' ELSE 'trajectory' END AS point_role,
  s_us+off_us AS at_us, CAST(printf('%.3f', off_us/1e6) AS DOUBLE) AS elapsed_seconds, CAST(printf('%.7f', lat) AS DOUBLE) AS latitude, CAST(printf('%.7f', lon) AS DOUBLE) AS longitude,
  CAST(printf('%.3f', alt) AS DOUBLE) AS altitude_m, CAST(printf('%.3f', step) AS DOUBLE) AS segment_distance_m, CAST(printf('%.3f', walked) AS DOUBLE) AS cumulative_distance_m,
  CAST(printf('%.3f', step/(dur/(n-1))*3.6) AS DOUBLE) AS segment_speed_kmh FROM points""")
def _(spark, sf):
    p = build(spark, sf).points
    return p.select(
        "trip_id", F.col("VIN").alias("vin"), "point_index", "point_role", us("timestamp").alias("at_us"),
        "elapsed_seconds", "latitude", "longitude", "altitude_m", "segment_distance_m",
        "cumulative_distance_m", "segment_speed_kmh",
    )


@register("lineage", "lineage", "SELECT row_id, trip_ids, roles FROM lineage")
def _(spark, sf):
    return build(spark, sf).lineage.select(
        F.col("source_row_id").alias("row_id"), joined("trip_ids").alias("trip_ids"), joined("source_roles").alias("roles")
    )


@register("cleaned_source", "cleaned lineage", """SELECT l.row_id, l.trip_ids, l.roles, c.vin, c.ts AS ts_us, c.trig AS trigger,
  c.signal, c.scalar, c.series, c.fuel, c.model FROM lineage l JOIN cleaned c USING (row_id)""")
def _(spark, sf):
    s = build(spark, sf).cleaned_source
    return s.select(
        F.col("source_row_id").alias("row_id"), joined("trip_ids").alias("trip_ids"), joined("source_roles").alias("roles"),
        F.col("VIN").alias("vin"), us("source_timestamp").alias("ts_us"), F.col("source_trigger").alias("trigger"),
        F.col("source_signal").alias("signal"), F.col("scalar_value").alias("scalar"),
        F.col("series_value").alias("series"), "fuel", "model",
    )


@register("cleaning_audit", "judged lineage cleaned", """SELECT 'preconstruction' AS stage, reason, count(*) AS row_count
  FROM judged WHERE reason IS NOT NULL GROUP BY reason
  UNION ALL SELECT 'post_reconstruction', 'not_used_by_accepted_trip',
   (SELECT count(*) FROM cleaned) - (SELECT count(*) FROM lineage)""")
def _(spark, sf):
    return build(spark, sf).cleaning_audit


@register("build_audit", "judged cleaned lineage trigger_events batches accepted rejected", """SELECT
  (SELECT count(*) FROM judged) AS raw_rows_received, (SELECT count(*) FROM cleaned) AS rows_retained,
  (SELECT count(*) FROM judged WHERE reason='exact_duplicate') AS exact_duplicates_removed,
  (SELECT count(*) FROM lineage) AS rows_used, (SELECT count(*) FROM cleaned)-(SELECT count(*) FROM lineage) AS rows_unused,
  (SELECT count(*) FROM judged)-(SELECT count(*) FROM lineage) AS rows_removed,
  (SELECT count(DISTINCT vin) FROM cleaned) AS vins,
  (SELECT count(*) FROM trigger_events WHERE kind=0) AS start_events, (SELECT count(*) FROM trigger_events WHERE kind=2) AS end_events,
  (SELECT count(*) FROM batches) AS trajectory_batches, (SELECT count(*) FROM accepted) AS accepted_trips,
  (SELECT CAST(sum(n) AS BIGINT) FROM accepted) AS accepted_points, (SELECT count(*) FROM rejected) AS rejection_records,
  (SELECT string_agg(reason || '=' || c, ';' ORDER BY reason) FROM (SELECT reason, count(*) AS c FROM rejected GROUP BY 1)) AS rejection_counts""")
def _(spark, sf):
    counts = F.transform(
        F.array_sort(F.map_entries("rejection_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return build(spark, sf).audit.select(
        "raw_rows_received", F.col("rows_retained_for_reconstruction").alias("rows_retained"),
        "exact_duplicates_removed", F.col("raw_rows_in_cleaned_trip_source").alias("rows_used"),
        F.col("raw_rows_unused_after_reconstruction").alias("rows_unused"),
        F.col("raw_rows_removed_from_final_source").alias("rows_removed"),
        F.col("vins_after_filters").alias("vins"), "start_events", "end_events", "trajectory_batches",
        "accepted_trips", "accepted_points", "rejection_records", joined(counts).alias("rejection_counts"),
    )


# Vehicles of the list queries, in both dialects.
_LISTED = ("VIN000001", "VIN000003", "VIN000005", "VIN000008")
_IN_LIST = "vin IN (" + ", ".join(f"'{v}'" for v in _LISTED) + ")"


def _listed(spark, sf, **lists):
    made = clean(run(spark, sf).raw, replace(SETTINGS, **lists))
    counts = made.discarded.groupBy("reason").agg(F.count(F.lit(1)).alias("row_count"))
    kept = made.data.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("retained").alias("reason"), "row_count")
    return counts.unionByName(kept)


def _listed_sql(test: str, reason: str) -> str:
    named = f"CASE WHEN r1 IS NOT NULL OR reason = 'exact_duplicate' THEN reason WHEN {test} THEN '{reason}' ELSE coalesce(reason, 'retained') END"
    return f"SELECT {named} AS reason, count(*) AS row_count FROM judged GROUP BY 1"


@register("vehicles_included", "judged", _listed_sql(f"NOT ({_IN_LIST})", "vin_not_included"))
def _(spark, sf):
    return _listed(spark, sf, include_vins=_LISTED)


@register("vehicles_excluded", "judged", _listed_sql(_IN_LIST, "vin_excluded"))
def _(spark, sf):
    return _listed(spark, sf, exclude_vins=_LISTED)
