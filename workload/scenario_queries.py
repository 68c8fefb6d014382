"""Queries over what-if requests (I ids). One request per trip, varied by its start time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.config import SpreadSettings
from tripweave.functions.text import iso_utc
from tripweave.operators import scenarios as S
from tripweave.schema import FEATURES
from tripweave.session import stage

from .oracle import R_KM, STEPS, bearing, hav, step
from .queries import SAMPLES, joined, register, run, us

SPREAD = SpreadSettings()


def requests(spark, sf) -> DataFrame:
    """Overrides, custom prefixes, chosen histories and broken requests by arithmetic."""
    t = run(spark, sf).trips.withColumn("_u", us("StartTrip"))
    firsts = t.groupBy("VIN").agg(F.min("trip_id").alias("_first"))
    t = t.join(firsts, "VIN")

    def hit(n: int):
        return F.pmod("_u", F.lit(n)) == 0

    lat, lon = F.col("start_latitude"), F.col("start_longitude")
    at_lat = lat + F.when(hit(5), 0.01).otherwise(0.0)
    at_lon = lon - F.when(hit(5), 0.02).otherwise(0.0)
    far = F.when(hit(3), 1.0).otherwise(0.0)
    custom = F.array(F.array(at_lat + far, at_lon), F.array(at_lat + 0.001, at_lon + 0.001))
    moved = F.expr("StartTrip + INTERVAL 30 MINUTES")
    return t.select(
        F.concat(F.lit(" "), F.col("VIN")).alias("vin"),
        F.col("trip_id").alias("reference_trip_id"),
        F.when(hit(2), iso_utc(moved)).alias("departure_time"),
        F.when(hit(5), at_lat).alias("origin_latitude"),
        F.when(hit(5) & ~hit(23), at_lon).alias("origin_longitude"),
        (F.pmod("_u", F.lit(4)) / 4.0).alias("prefix_fraction"),
        F.when(hit(7), custom).alias("prefix_points"),
        F.when(hit(11), F.array("trip_id")).when(hit(3), F.array("_first", "_first")).alias("history_trip_ids"),
        F.when(hit(17), -1).when(hit(6), 2).cast("int").alias("history_limit"),
        F.when(hit(19), 0).otherwise(3).cast("int").alias("top_k"),
    )


step(
    "requests",
    "accepted",
    """SELECT a.vin, a.trip_id, a.s_us, a.e_us, a.ordinal, a.n, a.elat, a.elon,
    CASE WHEN s_us % 2 = 0 THEN s_us + 1800000000 END AS moved, s_us % 5 = 0 AS shifted,
    slat + CASE WHEN s_us % 5 = 0 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS rlat, slon - CASE WHEN s_us % 5 = 0 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END AS rlon,
    (s_us % 4)/4.0::DOUBLE AS f, s_us % 7 = 0 AS custom, s_us % 3 = 0 AS far,
    CASE WHEN s_us % 11 = 0 THEN trip_id WHEN s_us % 3 = 0 THEN min(trip_id) OVER (PARTITION BY vin) END AS wanted,
    CASE WHEN s_us % 17 = 0 THEN -1 WHEN s_us % 6 = 0 THEN 2 END AS lim, CASE WHEN s_us % 19 = 0 THEN 0 ELSE 3 END AS k,
    CASE WHEN s_us % 19 = 0 THEN 'top_k must be positive' WHEN s_us % 17 = 0 THEN 'history_limit must be non-negative'
      WHEN s_us % 115 = 0 THEN 'Origin latitude and longitude must be supplied together' END AS flaw
    FROM accepted a""",
)
step(
    "located",
    "requests points",
    f"""SELECT r.*, coalesce(moved, r.s_us) AS dep, o.lat AS tlat, o.lon AS tlon,
    CASE WHEN shifted THEN rlat ELSE o.lat END AS olat, CASE WHEN shifted THEN rlon ELSE o.lon END AS olon,
    CAST(least(CASE WHEN f=0 THEN 1 ELSE greatest(1, ceil(greatest(1,r.n-1)*f)) END, greatest(1,r.n-1)) AS BIGINT) AS cnt,
    (SELECT count(*) FROM accepted t WHERE t.vin=r.vin AND t.e_us < coalesce(moved, r.s_us) AND t.trip_id <> r.trip_id) AS eligible
    FROM requests r JOIN points o ON o.trip_id=r.trip_id AND o.idx=0""",
)
step(
    "checked",
    "located",
    f"""SELECT *, CASE WHEN flaw IS NOT NULL THEN flaw
      WHEN custom AND {hav('olat', 'olon', 'rlat + CASE WHEN far THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END', 'rlon', R_KM)} > 0.03
        THEN 'Custom prefix must start at the configured origin (within 30 m)'
      WHEN wanted IS NOT NULL AND NOT EXISTS (SELECT 1 FROM accepted t WHERE t.vin=located.vin AND t.trip_id=located.wanted
        AND t.e_us < located.dep AND t.trip_id <> located.trip_id)
        THEN 'History trips must belong to the VIN and end before departure: ' || wanted END AS error FROM located""",
)
step(
    "used",
    "checked",
    """SELECT trip_id, string_agg(hid, ';' ORDER BY o) AS ids, count(*) AS cnt_h, arg_max(hlat, o) AS last_lat, arg_max(hlon, o) AS last_lon,
    avg(hlat) AS mean_lat, avg(hlon) AS mean_lon FROM (
      SELECT c.trip_id, t.trip_id AS hid, t.ordinal AS o, t.elat AS hlat, t.elon AS hlon, c.wanted, least(coalesce(c.lim,20),20) AS lim,
        row_number() OVER (PARTITION BY c.trip_id ORDER BY t.ordinal DESC) AS back
      FROM checked c JOIN accepted t ON t.vin=c.vin AND t.e_us < c.dep AND t.trip_id <> c.trip_id AND (c.wanted IS NULL OR t.trip_id=c.wanted)
      WHERE c.error IS NULL) WHERE wanted IS NOT NULL OR back <= lim GROUP BY trip_id""",
)
step(
    "walk",
    "checked points",
    """SELECT c.trip_id, max(p.lat) FILTER (p.idx=c.cnt-1) + (max(c.olat)-max(c.tlat)) AS plat, max(p.lon) FILTER (p.idx=c.cnt-1) + (max(c.olon)-max(c.tlon)) AS plon
    FROM checked c JOIN points p USING (trip_id) GROUP BY c.trip_id""",
)
step(
    "ready",
    "checked used walk",
    """SELECT c.*, coalesce(u.cnt_h,0) AS cnt_h, coalesce(u.ids,'') AS ids, coalesce(u.last_lat, hlat) AS last_lat, coalesce(u.last_lon, hlon) AS last_lon,
    coalesce(mean_lat, hlat) AS mean_lat, coalesce(mean_lon, hlon) AS mean_lon
    FROM (SELECT c.*, CASE WHEN f > 0 AND custom THEN rlat + CASE WHEN far THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE olat END AS hlat,
       CASE WHEN f > 0 AND custom THEN rlon ELSE olon END AS hlon,
       CASE WHEN f = 0 THEN olat WHEN custom THEN rlat+0.001::DOUBLE ELSE w.plat END AS plat,
       CASE WHEN f = 0 THEN olon WHEN custom THEN rlon+0.001::DOUBLE ELSE w.plon END AS plon,
       CASE WHEN f = 0 THEN 1 WHEN custom THEN 2 ELSE cnt END AS seen FROM checked c JOIN walk w USING (trip_id)) c
    LEFT JOIN used u ON u.trip_id=c.trip_id WHERE c.error IS NULL""",
)
assert "requests" in STEPS


@register("request_validation", "requests", "SELECT vin, trip_id, flaw AS error FROM requests")
def _(spark, sf):
    v = S.validated(requests(spark, sf))
    return v.select("vin", F.col("reference_trip_id").alias("trip_id"), "error")


@register("request_hash", "requests", """SELECT trip_id, sha256('{"departure_time":' ||
  CASE WHEN moved IS NULL THEN 'null' ELSE '"' || strftime(make_timestamp(moved), '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN moved % 1000000 <> 0 THEN strftime(make_timestamp(moved), '.%f') ELSE '' END || '+00:00"' END ||
  ',"history_limit":' || coalesce(CAST(lim AS VARCHAR), 'null') || ',"history_trip_ids":' || CASE WHEN wanted IS NULL THEN 'null' ELSE '["' || wanted || '"]' END ||
  ',"origin_latitude":' || CASE WHEN shifted THEN CAST(rlat AS VARCHAR) ELSE 'null' END ||
  ',"origin_longitude":' || CASE WHEN shifted AND s_us % 23 <> 0 THEN CAST(rlon AS VARCHAR) ELSE 'null' END || ',"prefix_fraction":' || CAST(f AS VARCHAR) ||
  ',"prefix_points":' || CASE WHEN custom THEN '[[' || CAST(rlat + CASE WHEN far THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS VARCHAR) || ',' || CAST(rlon AS VARCHAR) || '],[' ||
    CAST(rlat + 0.001::DOUBLE AS VARCHAR) || ',' || CAST(rlon + 0.001::DOUBLE AS VARCHAR) || ']]' ELSE 'null' END ||
  ',"reference_trip_id":"' || trip_id || '","top_k":' || k || ',"vin":"' || vin || '"}') AS scenario_id FROM requests""")
def _(spark, sf):
    return S.validated(requests(spark, sf)).select(F.col("reference_trip_id").alias("trip_id"), "scenario_id")


def _located(spark, sf):
    ordered = stage(S.ordered_trips(run(spark, sf).trips, SPREAD), "ordered")
    return S.located_requests(S.validated(requests(spark, sf)), ordered, SPREAD), ordered


@register("reference_lookup", "located", "SELECT trip_id, dep AS departure_us, e_us AS end_us, ordinal FROM located")
def _(spark, sf):
    d, _ = _located(spark, sf)
    return d.select(
        F.col("reference_trip_id").alias("trip_id"), us("departure").alias("departure_us"), us("ref.EndTrip").alias("end_us"), F.col("ref.ordinal").alias("ordinal")
    )


@register("eligible_history", "located", "SELECT trip_id, eligible FROM located")
def _(spark, sf):
    d, _ = _located(spark, sf)
    return S.eligible_history(d).select(F.col("reference_trip_id").alias("trip_id"), F.col("eligible_count").alias("eligible"))


@register("chosen_history", "used", "SELECT trip_id, ids FROM used")
def _(spark, sf):
    d, ordered = _located(spark, sf)
    # Read by three steps, none of which looks at points.
    slim = ("scenario_id", "vin", "reference_trip_id", "departure", "started", "history_limit", "history_trip_ids", "error")
    d = stage(S._paths(d).select(*slim), "located")
    h = S.chosen_history(d, ordered, SAMPLES)
    named = d.select("scenario_id", F.col("reference_trip_id").alias("trip_id"))
    return h.filter("size(rejected_ids) = 0").join(named, "scenario_id").select("trip_id", joined("history_ids").alias("ids"))


def _made(spark, sf):
    r = run(spark, sf)
    return S.prepare_scenarios(requests(spark, sf), r.trips, r.manifest, SAMPLES, SPREAD)


@register("scenario_samples", "ready manifest", f"""SELECT trip_id, dep AS start_us, e_us AS end_us, split, round(elat,6) AS actual_latitude, round(elon,6) AS actual_longitude,
  round(hlat,6) AS origin_latitude, round(hlon,6) AS origin_longitude, f AS prefix_fraction, seen, round(plat,6) AS prefix_last_latitude,
  round(plon,6) AS prefix_last_longitude, round({hav('hlat', 'hlon', 'plat', 'plon', R_KM)},6) AS prefix_displacement_km,
  round(CASE WHEN seen > 1 THEN cos(radians({bearing('hlat', 'hlon', 'plat', 'plon')})) ELSE 1.0::DOUBLE END,6)+0.0::DOUBLE AS prefix_bearing_cos,
  CAST(cnt_h AS DOUBLE) AS history_count, round(last_lat,6) AS last_destination_latitude, round(last_lon,6) AS last_destination_longitude,
  round(mean_lat,9) AS mean_destination_latitude, round(mean_lon,9) AS mean_destination_longitude FROM ready JOIN manifest USING (vin)""")
def _(spark, sf):
    s = _made(spark, sf).samples
    names = [
        "origin_latitude", "origin_longitude", "prefix_last_latitude", "prefix_last_longitude", "prefix_displacement_km",
        "prefix_bearing_cos", "last_destination_latitude", "last_destination_longitude", "mean_destination_latitude",
        "mean_destination_longitude", "actual_latitude", "actual_longitude",
    ]
    assert set(FEATURES) <= set(s.columns)
    return s.select(
        "trip_id", us("StartTrip").alias("start_us"), us("EndTrip").alias("end_us"), "split", "prefix_fraction", "history_count",
        F.size("trajectory_prefix").cast("bigint").alias("seen"), *[F.round(n, 9 if n.startswith("mean_") else 6).alias(n) for n in names],
    )


@register("scenario_errors", "checked", "SELECT trip_id, error FROM checked WHERE error IS NOT NULL")
def _(spark, sf):
    return _made(spark, sf).errors.select(F.col("reference_trip_id").alias("trip_id"), "error")


@register("scenario_provenance", "ready", """SELECT trip_id, CASE WHEN moved IS NULL THEN 'reference_trip' ELSE 'user_override' END AS departure_source,
  CASE WHEN shifted THEN 'user_override' ELSE 'reference_trip' END AS origin_source,
  CASE WHEN custom THEN 'custom_points' WHEN shifted THEN 'translated_reference_trip' ELSE 'reference_trip' END AS prefix_source,
  CASE WHEN wanted IS NULL THEN 'automatic_previous_trips' ELSE 'user_selected_previous_trips' END AS history_source,
  ids AS history_ids, eligible, seen, 21 AS features FROM ready""")
def _(spark, sf):
    p = _made(spark, sf).samples.select("trip_id", "provenance.*")
    return p.select(
        "trip_id", F.col("input_sources.departure_time").alias("departure_source"), F.col("input_sources.origin").alias("origin_source"),
        F.col("input_sources.trajectory_prefix").alias("prefix_source"), F.col("input_sources.history").alias("history_source"),
        joined("history_trip_ids").alias("history_ids"), F.col("eligible_history_trips").alias("eligible"),
        F.col("observed_prefix_points").cast("bigint").alias("seen"), F.col("model_feature_count").alias("features"),
    )


@register("reference_defaults", "accepted points", """SELECT a.trip_id, a.s_us AS departure_us, round(o.lat,6) AS origin_latitude, round(o.lon,6) AS origin_longitude,
  a.ordinal-1 AS eligible, coalesce((SELECT string_agg(b.trip_id, ';' ORDER BY b.ordinal) FROM accepted b WHERE b.vin=a.vin AND b.ordinal BETWEEN a.ordinal-5 AND a.ordinal-1),'') AS ids
  FROM accepted a JOIN points o ON o.trip_id=a.trip_id AND o.idx=0""")
def _(spark, sf):
    d = S.reference_defaults(run(spark, sf).trips, 0.25, 5, SPREAD)
    return d.select(
        F.col("reference_trip_id").alias("trip_id"), us("departure_time").alias("departure_us"), *[F.round(c, 6).alias(c) for c in ("origin_latitude", "origin_longitude")],
        F.col("eligible_history_trips").alias("eligible"), joined("history_trip_ids").alias("ids"),
    )


@register("eligible_history_rows", "located", """SELECT r.trip_id, t.trip_id AS eligible_trip_id FROM located r
  JOIN accepted t ON t.vin=r.vin AND t.e_us < r.dep AND t.trip_id <> r.trip_id WHERE r.flaw IS NULL""")
def _(spark, sf):
    d, ordered = _located(spark, sf)
    named = d.select("scenario_id", F.col("reference_trip_id").alias("asked"))
    rows = S.eligible_history_rows(d, ordered).join(named, "scenario_id")
    return rows.select(F.col("asked").alias("trip_id"), F.col("trip_id").alias("eligible_trip_id"))


def _overlapping(spark, sf) -> DataFrame:
    """Trips of the build whose ends are moved by up to three days, so that many overlap."""
    t = run(spark, sf).trips
    hours = F.pmod(F.floor(us("StartTrip") / 1_000_000), F.lit(73))
    return t.withColumn("EndTrip", F.timestamp_micros(us("EndTrip") + hours * F.lit(3_600_000_000)))


_MOVED = "(SELECT vin, trip_id, ordinal, s_us, e_us + ((s_us // 1000000) % 73) * 3600000000 AS end_us FROM accepted)"


@register("overlapping_history", "accepted", f"""SELECT trip_id, count(earlier) AS eligible, coalesce(string_agg(earlier, ';' ORDER BY o) FILTER (back <= 5), '') AS ids
  FROM (SELECT a.trip_id, b.trip_id AS earlier, b.ordinal AS o, row_number() OVER (PARTITION BY a.trip_id ORDER BY b.ordinal DESC NULLS LAST) AS back
    FROM {_MOVED} a LEFT JOIN {_MOVED} b ON b.vin = a.vin AND b.end_us < a.s_us AND b.trip_id <> a.trip_id) GROUP BY trip_id""")
def _(spark, sf):
    d = S.reference_defaults(_overlapping(spark, sf), 0.0, 5, SPREAD)
    return d.select(F.col("reference_trip_id").alias("trip_id"), F.col("eligible_history_trips").alias("eligible"), joined("history_trip_ids").alias("ids"))
