"""Queries that write and read back (S ids)."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from tripweave.operators.clean import ROW_ID, canonical, clean, with_row_id
from tripweave.operators.scenarios import validated
from tripweave.session import staging_root
from tripweave.sources import tables as IO

from .queries import ORACLES, register, run, us
from .scenario_queries import requests
from .telemetry import SETTINGS


def folder(spark, sf, name: str) -> str:
    return f"{staging_root(spark)}/{name}-sf{sf.rstrip('/').rsplit('sf', 1)[-1]}"


def _contents(spark, outputs):
    """(output, row_count, digest) of written tables: the sum of 32 hash bits of each row's text."""
    parts = []
    for name, path, cells in outputs:
        text = F.concat_ws(":", *[c.cast("string") for c in cells])
        bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
        found = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"), F.sum(bits).alias("digest"))
        parts.append(found.select(F.lit(name).alias("output"), "row_count", "digest"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _contents_sql(name: str, cells: str, table: str) -> str:
    bits = f"('0x' || md5(concat_ws(':', {cells}))[1:8])::BIGINT"
    return f"SELECT '{name}' AS output, count(*) AS row_count, sum({bits})::BIGINT AS digest FROM {table}"


@register("row_ids")
def _(spark, sf):
    numbered = with_row_id(spark.read.parquet(f"{sf}/events.parquet"))
    return numbered.agg(
        F.count(F.lit(1)).alias("row_count"), F.min(ROW_ID).alias("first_id"), F.max(ROW_ID).alias("last_id"),
        F.count_distinct(ROW_ID).alias("ids"),
    )


ORACLES["row_ids"] = "SELECT count(*) AS row_count, 0 AS first_id, count(*)-1 AS last_id, count(*) AS ids FROM events"


@register("trips_from_csv", "accepted points", """SELECT a.trip_id, a.s_us AS start_us, CAST(a.n AS INT) AS point_count, CAST(printf('%.3f', a.dist) AS DOUBLE) AS distance_m,
  CASE WHEN flags='' THEN '[]' ELSE '["' || replace(flags, ';', '","') || '"]' END AS quality_flags, p.path FROM accepted a
  JOIN (SELECT trip_id, string_agg(printf('%.6f %.6f', lat, lon), ';' ORDER BY idx) AS path FROM points GROUP BY trip_id) p ON p.trip_id=a.trip_id""")
def _(spark, sf):
    from tripweave.operators.samples import trajectory_points

    path = IO.write_table(run(spark, sf).trips, folder(spark, sf, "trips") + ".csv")
    t = IO.load_trips(spark, path)
    text = F.transform(trajectory_points(t), lambda p: F.format_string("%.6f %.6f", p["latitude"], p["longitude"]))
    return t.select(
        "trip_id", us("StartTrip").alias("start_us"), "point_count", "distance_m", "quality_flags", F.array_join(text, ";").alias("path")
    )


_AUDIT_ROWS = """(SELECT 'preconstruction' AS stage, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason
  UNION ALL SELECT * FROM (SELECT 'post_reconstruction', 'not_used_by_accepted_trip',
    (SELECT count(*) FROM judged WHERE reason IS NULL) - (SELECT count(*) FROM lineage) AS n) WHERE n > 0)"""


@register("written_build", "accepted points lineage rejected judged", " UNION ALL ".join([
    _contents_sql("trips", "trip_id, s_us, e_us, n", "accepted"),
    _contents_sql("points", "trip_id, printf('%.6f %.6f', lat, lon)", "points"),
    _contents_sql("cleaned_source", "row_id, trip_ids, roles", "lineage"),
    _contents_sql("rejected", "vin, s_us, e_us, reason, detail", "rejected"),
    _contents_sql("cleaning_audit", "stage, reason, n", _AUDIT_ROWS),
]))
def _(spark, sf):
    paths = IO.write_build(run(spark, sf).build, folder(spark, sf, "build"))
    c = F.col
    return _contents(spark, [
        ("trips", paths["trips"], [c("trip_id"), us("StartTrip"), us("EndTrip"), c("point_count")]),
        ("points", paths["points"], [c("trip_id"), F.format_string("%.6f %.6f", "latitude", "longitude")]),
        ("cleaned_source", paths["cleaned_source"], [c(ROW_ID), F.array_join("trip_ids", ";"), F.array_join("source_roles", ";")]),
        ("rejected", paths["rejected"], [c("VIN"), us("StartTrip"), us("EndTrip"), c("reason"), c("detail")]),
        ("cleaning_audit", paths["cleaning_audit"], [c("stage"), c("reason"), c("row_count")]),
    ])


@register("written_cleaning", "judged", " UNION ALL ".join([
    _contents_sql("cleaned_raw", "row_id, vin, trig, signal, series, ts", "(SELECT * FROM judged WHERE reason IS NULL)"),
    _contents_sql("discarded_rows", "row_id, reason", "(SELECT * FROM judged WHERE reason IS NOT NULL)"),
]))
def _(spark, sf):
    paths = IO.write_cleaning(clean(run(spark, sf).raw, SETTINGS), folder(spark, sf, "cleaning"))
    c = F.col
    return _contents(spark, [
        ("cleaned_raw", paths["cleaned_raw"], [c(ROW_ID), c("vin"), c("trigger"), c("signal"), c("series"), us("timestamp")]),
        ("discarded_rows", paths["discarded_rows"], [c(ROW_ID), c("reason")]),
    ])


@register("raw_from_csv", "canon", """SELECT coalesce(vin, '') AS vin, coalesce(trig, '') AS trigger,
  coalesce(signal, '') AS signal, scalar, series, count(*) AS n FROM canon GROUP BY ALL""")
def _(spark, sf):
    """Raw telemetry written as CSV and read by the reader of raw files, then made canonical.
    CSV does not tell empty text from none; both are missing."""
    path = folder(spark, sf, "raw") + ".csv"
    run(spark, sf).raw.drop(SETTINGS.row_id_column).write.mode("overwrite").options(**IO.CSV).csv(path)
    rows = canonical(IO.read_raw(spark, path), replace(SETTINGS, row_id_column=None))
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("vin", "trigger", "signal")]
    return rows.select(*texts, "scalar", "series").groupBy("vin", "trigger", "signal", "scalar", "series").agg(
        F.count(F.lit(1)).alias("n")
    )


@register("request_file", "requests", "SELECT vin, trip_id, flaw AS error FROM requests")
def _(spark, sf):
    path = folder(spark, sf, "requests")
    requests(spark, sf).write.mode("overwrite").json(path)
    v = validated(IO.read_requests(spark, path))
    return v.select("vin", F.col("reference_trip_id").alias("trip_id"), "error")
