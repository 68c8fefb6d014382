import math

import pytest
from pyspark.sql import functions as F

from tripweave.config import BuildSettings, SpreadSettings
from tripweave.plans.build import build_trips

from .helpers import B, DEGREE_M, RAW_SCHEMA, batch, end, haversine, kept_points, start

LATS = [48.8, 48.8025, 48.805, 48.8075, 48.81]
LONS = [2.2, 2.202, 2.204, 2.206, 2.208]
M = 1 / DEGREE_M  # degrees of latitude per metre


def tiny(steps, lat=48.8):
    out = [lat]
    for s in steps:
        out.append(out[-1] + s * M)
    return out


CASES = {
    "ok": start("ok", 0) + batch("ok", 240, LATS, LONS, [70.0, 70.5, 71.0, 71.5, 72.0]) + end("ok", 480, alt=72.0),
    "end_at_start": start("end_at_start", 0) + end("end_at_start", 0),
    "two_ends": start("two_ends", 0) + end("two_ends", 60) + end("two_ends", 120),
    "end_first": end("end_first", 0) + start("end_first", 600) + end("end_first", 1200),
    "two_starts": start("two_starts", 0) + start("two_starts", 60) + end("two_starts", 600),
    "batch_edges": start("batch_edges", 0)
    + batch("batch_edges", 0, LATS[:2], LONS[:2])
    + batch("batch_edges", 600, LATS[2:], LONS[2:])
    + end("batch_edges", 600)
    + batch("batch_edges", 601, [48.9], [2.3]),
    "unaligned": start("unaligned", 0) + batch("unaligned", 9, LATS[:3], LONS[:2], [1.0] * 3) + end("unaligned", 600),
    "no_lon": start("no_lon", 0) + batch("no_lon", 9, LATS, None, [1.0] * 5) + end("no_lon", 600),
    "no_alt": start("no_alt", 0) + batch("no_alt", 9, LATS, LONS) + end("no_alt", 600),
    "tiny": start("tiny", 0)
    + batch("tiny", 9, tiny([0, 0.006, 0.006, 0.006, 500]), [2.2] * 6)
    + end("tiny", 600, lat=48.8 + 500.018 * M, lon=2.2),
    "fallback": start("fallback", 0) + end("fallback", 600),
    "near": start("near", 0) + batch("near", 9, [48.8 + 29 * M, 48.81 - 29 * M], [2.2, 2.208]) + end("near", 600),
    "far": start("far", 0) + batch("far", 9, [48.8 + 31 * M, 48.81 - 31 * M], [2.2, 2.208]) + end("far", 600),
    "one_point": start("one_point", 0) + batch("one_point", 9, [48.805], [2.204]) + end("one_point", 600),
    "two_limits": start("two_limits", 0, lat=40.0, lon=2.0) + end("two_limits", 100, lat=60.0, lon=2.0),
    "lat_91": start("lat_91", 0, lat=91.0) + end("lat_91", 600),
    "lon_181": start("lon_181", 0) + end("lon_181", 600, lon=-181.0),
    "infinite": start("infinite", 0, lat="Infinity") + end("infinite", 600),
    "no_start_lat": start("no_start_lat", 0, lat=None) + end("no_start_lat", 600),
    "no_end_lon": start("no_end_lon", 0) + end("no_end_lon", 600, lon=None),
    "path_off": start("path_off", 0) + batch("path_off", 9, [48.8, 95.0], [2.2, 2.3]) + end("path_off", 600),
    "twice": start("twice", 0) + start("twice", 0, lat=48.9, lon=None, alt=None) + end("twice", 600),
    "mixed": start("mixed", 0, model="a") + end("mixed", 600, model="b"),
    "short": start("short", 0) + end("short", 0.5),
    "days": start("days", 0) + batch("days", 90000, LATS, LONS) + end("days", 100000),
    "second": start("second", 0) + end("second", 600) + start("second", 0.5 + 600) + end("second", 1300),
}


@pytest.fixture(scope="module")
def built(spark):
    raw = spark.createDataFrame([r for rows in CASES.values() for r in rows], RAW_SCHEMA)
    result = build_trips(raw.repartition(5))
    trips = {}
    for t in result.trips.collect():
        trips.setdefault(t.VIN, []).append(t)
    reasons = {}
    for r in result.rejected.collect():
        reasons.setdefault(r.VIN, []).append((r.reason, r.detail))
    return result, trips, {k: sorted(v) for k, v in reasons.items()}


def reason_names(built, vin):
    return [r for r, _ in built[2].get(vin, [])]


def test_plain_trip(built):
    (t,) = built[1]["ok"]
    assert t.trip_id == "ok_20260213T070000Z_0001"
    assert [(p.latitude, p.longitude) for p in t.Trajectory] == list(zip(LATS, LONS))
    assert t.AltitudeTrajectory == [70.0, 70.5, 71.0, 71.5, 72.0]
    assert (t.duration_seconds, t.duration_minutes) == (480.0, 8.0)
    assert (t.distance_m, t.distance_km, t.straight_line_distance_m) == (1256.86, 1.25686, 1256.86)
    assert (t.average_speed_kmh, t.max_segment_speed_kmh) == (9.426, 9.427)
    assert (t.point_count, t.quality_status, t.quality_flags) == (5, "accepted", [])
    assert (t.fuel, t.hyb, t.model) == ("electric", None, "m")


def test_points_of_plain_trip(built):
    pts = built[0].points.filter("VIN = 'ok'").orderBy("point_index").collect()
    assert [p.point_role for p in pts] == ["start"] + ["trajectory"] * 3 + ["destination"]
    assert [p.elapsed_seconds for p in pts] == [0.0, 120.0, 240.0, 360.0, 480.0]
    assert pts[0].segment_distance_m == 0.0 and pts[-1].cumulative_distance_m == 1256.86
    steps = [haversine(a, b) for a, b in zip(zip(LATS, LONS), list(zip(LATS, LONS))[1:])]
    assert [p.segment_distance_m for p in pts[1:]] == [round(s, 3) for s in steps]


@pytest.mark.parametrize(
    "vin, reasons, trips",
    [
        ("end_at_start", ["non_positive_duration"], 0),
        ("two_ends", ["unmatched_end_trigger"], 1),
        ("end_first", ["unmatched_end_trigger"], 1),
        ("two_starts", ["missing_end_trigger"], 1),
        ("unaligned", ["invalid_trajectory_array"], 0),
        ("no_lon", ["invalid_trajectory_array"], 0),
        ("two_limits", ["distance_too_long", "implausible_segment_speed"], 0),
        ("lat_91", ["invalid_trigger_coordinate"], 0),
        ("lon_181", ["invalid_trigger_coordinate"], 0),
        ("infinite", ["invalid_trigger_coordinate"], 0),
        ("no_start_lat", ["missing_start_coordinate"], 0),
        ("no_end_lon", ["missing_end_coordinate"], 0),
        ("path_off", ["invalid_trajectory_coordinate"], 0),
        ("short", ["duration_too_short", "implausible_segment_speed"], 0),
        ("days", ["duration_too_long"], 0),
        ("second", [], 2),
    ],
)
def test_outcome(built, vin, reasons, trips):
    assert reason_names(built, vin) == reasons
    assert len(built[1].get(vin, [])) == trips


def test_details(built):
    details = {vin: dict(v) for vin, v in built[2].items()}
    assert details["end_at_start"]["non_positive_duration"] == "duration_s=0.0"
    assert details["unaligned"]["invalid_trajectory_array"] == "unaligned trajectory array lengths: [3, 2, 3]"
    assert details["no_lon"]["invalid_trajectory_array"] == "trajectory batch lacks latitude or longitude array"
    assert details["days"]["duration_too_long"] == "duration_s=100000.000"
    far = haversine((40.0, 2.0), (60.0, 2.0))
    assert details["two_limits"]["distance_too_long"] == f"distance_m={far:.3f}"


def test_batches_at_both_edges_count_and_later_ones_do_not(built):
    (t,) = built[1]["batch_edges"]
    assert t.point_count == 5


def test_missing_altitude_stays_null(built):
    assert built[1]["no_alt"][0].AltitudeTrajectory == [None] * 5


def test_repeats_are_judged_from_the_last_kept_point(built):
    (t,) = built[1]["tiny"]
    expected = kept_points([(x, 2.2) for x in tiny([0, 0.006, 0.006, 0.006, 500])])
    assert len(expected) == 3
    assert t.point_count == 3
    assert [p.latitude for p in t.Trajectory] == [round(p[0], 7) for p in expected]


def test_endpoint_repair(built):
    trips = built[1]
    assert trips["near"][0].point_count == 2 and trips["near"][0].quality_flags == []
    assert trips["far"][0].point_count == 4
    assert trips["far"][0].quality_flags == ["end_trigger_point_added", "start_trigger_point_added"]
    assert trips["one_point"][0].point_count == 3
    fb = trips["fallback"][0]
    assert fb.point_count == 2 and fb.quality_flags == ["trajectory_fallback_to_trigger_endpoints"]
    assert fb.quality_status == "accepted_with_flags"


def test_duplicate_signal_last_row_wins(built):
    (t,) = built[1]["twice"]
    assert f"duplicate_start_signal:{B.latitude_signal}" in t.quality_flags
    assert t.start_latitude in (48.8, 48.9)


def test_inconsistent_metadata(built):
    (t,) = built[1]["mixed"]
    assert t.model == "a" and "inconsistent_metadata:model" in t.quality_flags


def test_ordinals_count_accepted_trips_only(built):
    assert [t.trip_id[-4:] for t in sorted(built[1]["second"], key=lambda t: t.StartTrip)] == ["0001", "0002"]
    assert built[1]["end_first"][0].trip_id.endswith("_0001")


def test_every_start_has_exactly_one_outcome_and_lineage_adds_up(built):
    result = built[0]
    o = result.outcomes
    assert o.filter("start_us IS NOT NULL").count() == result.events.filter("kind = 0").count()
    assert o.select("vin", "start_us", "end_us").distinct().count() == o.count()
    a = result.audit.first()
    used = result.cleaned_source.count()
    assert a.raw_rows_in_cleaned_trip_source == used
    assert a.raw_rows_unused_after_reconstruction == a.rows_retained_for_reconstruction - used
    assert a.accepted_points == result.points.count()
    roles = {r.source_row_id: r.source_roles for r in result.lineage.collect()}
    assert all(len(v) == 1 for v in roles.values())


def test_trips_start_and_end_at_their_points(built):
    for trips in built[1].values():
        for t in trips:
            assert t.point_count == len(t.Trajectory)
            first, last = t.Trajectory[0], t.Trajectory[-1]
            assert haversine((first.latitude, first.longitude), (t.start_latitude, t.start_longitude)) <= 30.01
            assert haversine((last.latitude, last.longitude), (t.end_latitude, t.end_longitude)) <= 30.01


def test_other_policies(spark):
    names = ("unaligned", "far", "fallback", "ok")
    raw = spark.createDataFrame([r for n in names for r in CASES[n]], RAW_SCHEMA)
    cfg = BuildSettings(length_policy="truncate", add_trigger_endpoints=False, fallback_to_triggers=False)
    b = build_trips(raw, cfg)
    trips = {t.VIN: t for t in b.trips.collect()}
    assert set(trips) == {"unaligned", "far", "ok"}
    assert trips["unaligned"].point_count == 2
    assert trips["unaligned"].quality_flags == ["end_endpoint_mismatch", "trajectory_arrays_truncated"]
    assert trips["far"].quality_flags == ["end_endpoint_mismatch", "start_endpoint_mismatch"]
    assert [(r.VIN, r.reason) for r in b.rejected.collect()] == [("fallback", "missing_trajectory")]


def test_no_rows_give_typed_empty_tables(spark):
    b = build_trips(spark.createDataFrame([], RAW_SCHEMA))
    assert b.trips.count() == 0 and b.points.count() == 0 and b.rejected.count() == 0
    assert "Trajectory" in b.trips.columns
    a = b.audit.first()
    assert a.raw_rows_received == 0 and a.rejection_counts == {}


def test_long_path_equals_short_path(spark):
    """The same trips, once gathered whole and once worked through by time bucket."""
    import random

    rnd = random.Random(3)
    rows = []
    for v in range(6):
        vin = f"L{v}"
        rows += start(vin, 0, lat=48.0, lon=2.0)
        lat, t = 48.0, 10
        for _ in range(60):
            lats = []
            for _ in range(rnd.randint(1, 4)):
                lat += rnd.choice([0.0, 0.004, 0.007, 0.012, 0.019, 3.0, 80.0]) * M
                lats.append(lat)
            rows += batch(vin, t, lats, [2.0] * len(lats))
            t += rnd.choice([20, 400, 1800, 5000])
        rows += end(vin, t + 60, lat=lat, lon=2.0)
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    from tripweave.operators.outcomes import candidates
    from tripweave.operators.pairing import routed_events

    figures = []
    for limit in (10_000_000.0, 2.0):
        cfg = BuildSettings(max_duration_seconds=limit)
        b = build_trips(raw, cfg, SpreadSettings(bucket_seconds=900))
        c = candidates(b.paired, cfg)
        assert {r.route for r in b.paired.select("route").distinct().collect()} == {"short" if limit > 2 else "long"}
        figures.append(
            {r.vin: (r.n, r.distance, r.longest_step, r.start_gap, r.end_gap) for r in c.collect()}
        )
    assert routed_events is not None
    whole, cut = figures
    assert set(whole) == set(cut) and len(whole) == 6
    for vin in whole:
        assert whole[vin][0] == cut[vin][0]
        for a, b_ in zip(whole[vin][1:], cut[vin][1:]):
            assert math.isclose(a, b_, rel_tol=1e-9, abs_tol=1e-6)


def test_kept_points_match_plain_fold(spark):
    import random

    from tripweave.functions.paths import drop_equal_neighbours, drop_repeats, steps_m

    rnd = random.Random(5)
    paths = []
    for _ in range(200):
        lat, pts = 48.0, []
        for _ in range(rnd.randint(1, 12)):
            lat += rnd.choice([0.0, 0.003, 0.006, 0.0099, 0.0101, 0.02, 5.0]) * M
            pts.append((lat, 2.0))
        paths.append(pts)
    df = spark.createDataFrame(
        list(enumerate(paths)), "id int, points array<struct<latitude:double,longitude:double>>"
    )
    df = df.withColumn("points", drop_equal_neighbours(F.col("points"))).withColumn("s", steps_m(F.col("points")))
    got = {r.id: [tuple(p) for p in r.k] for r in df.select("id", drop_repeats(F.col("points"), F.col("s")).alias("k")).collect()}
    assert got == {i: kept_points(p) for i, p in enumerate(paths)}
