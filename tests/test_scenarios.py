from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tripweave.config import SampleSettings
from tripweave.operators import scenarios as S
from tripweave.schema import FEATURES, REQUESTS
from tripweave.sources.tables import read_requests

from .test_samples import SCHEMA, T0, trip

ID = "V00_0003"


@pytest.fixture(scope="module")
def trips(spark):
    return spark.createDataFrame([trip("V00", i) for i in range(8)] + [trip("V01", i) for i in range(3)], SCHEMA).cache()


@pytest.fixture(scope="module")
def manifest(spark):
    return spark.createDataFrame([("V00", "test"), ("V01", "train")], "vin string, split string")


def request(spark, **values):
    row = {"vin": "V00", "reference_trip_id": ID, **values}
    return spark.createDataFrame([tuple(row.get(f.name) for f in REQUESTS.fields)], REQUESTS)


def run(spark, trips, manifest, cfg=None, **values):
    made = S.prepare_scenarios(request(spark, **values), trips, manifest, cfg)
    bad = made.errors.collect()
    return (None, bad[0].error) if bad else (made.samples.first(), None)


def test_defaults_take_the_reference_trip(spark, trips, manifest):
    s, _ = run(spark, trips, manifest)
    assert s.split == "test" and s.history_count == 3.0 and s.trip_id == ID
    p = s.provenance
    assert p.history_trip_ids == ["V00_0000", "V00_0001", "V00_0002"]
    assert p.input_sources.trajectory_prefix == "reference_trip"
    assert p.input_sources.history == "automatic_previous_trips"
    assert p.eligible_history_trips == 3 and p.model_feature_count == len(FEATURES)
    assert s.sample_id == "scenario:" + s.scenario_id[:16]


def test_overrides_are_recorded(spark, trips, manifest):
    late = (T0 + timedelta(hours=13)).isoformat()
    s, _ = run(
        spark, trips, manifest, departure_time=late, origin_latitude=48.5, origin_longitude=2.5, prefix_fraction=0.5,
        history_trip_ids=["V00_0004", "V00_0001", "V00_0004"], top_k=3,
    )
    assert s.origin_latitude == 48.5 and len(s.trajectory_prefix) == 2
    assert s.prefix_last_latitude == pytest.approx(48.501)
    p = s.provenance
    assert p.history_trip_ids == ["V00_0001", "V00_0004"]
    # Trips 0..4 have ended; the reference trip itself does not count.
    assert p.eligible_history_trips == 4
    assert p.input_sources.origin == p.input_sources.departure_time == "user_override"
    assert p.input_sources.trajectory_prefix == "translated_reference_trip"
    assert not any(p.scientific_contract)


def test_limits(spark, trips, manifest):
    assert run(spark, trips, manifest, history_limit=0)[0].history_count == 0.0
    s, _ = run(spark, trips, manifest, history_limit=2, departure_time=(T0 + timedelta(hours=16)).isoformat())
    assert s.provenance.history_trip_ids == ["V00_0004", "V00_0005"]
    s, _ = run(spark, trips, manifest, SampleSettings(max_history_trips=1))
    assert s.provenance.history_trip_ids == ["V00_0002"]


def test_naive_time_is_utc_and_a_trip_ending_at_departure_is_not_history(spark, trips, manifest):
    s, _ = run(spark, trips, manifest, departure_time="2026-02-13T10:10:00")
    assert s.provenance.departure_time == "2026-02-13T10:10:00+00:00"
    assert s.provenance.history_trip_ids == ["V00_0000"]


BROKEN = [
    ({"vin": "  "}, "VIN cannot be empty"),
    ({"reference_trip_id": ""}, "reference_trip_id cannot be empty"),
    ({"prefix_fraction": 1.0}, "prefix_fraction must be"),
    ({"top_k": 0}, "top_k must be positive"),
    ({"history_limit": -1}, "history_limit"),
    ({"origin_latitude": 1.0}, "supplied together"),
    ({"origin_latitude": 91.0, "origin_longitude": 1.0}, "origin_latitude must"),
    ({"origin_latitude": 1.0, "origin_longitude": 181.0}, "origin_longitude must"),
    ({"prefix_points": []}, "at least one point"),
    ({"prefix_points": [[1.0]]}, "latitude and longitude"),
    ({"prefix_points": [[91.0, 1.0]]}, "invalid coordinate"),
    ({"reference_trip_id": "V01_0001"}, "does not belong to VIN"),
    ({"departure_time": "soon"}, "not a timestamp"),
    ({"history_trip_ids": ["V00_0004"]}, "end before departure: V00_0004"),
    ({"history_trip_ids": [ID]}, "end before departure"),
    ({"prefix_points": [[49.0, 3.0]], "prefix_fraction": 0.25}, "start at the configured origin"),
    ({"origin_latitude": 89.9999, "origin_longitude": 2.0, "prefix_fraction": 0.9}, "Translated prefix"),
]


def test_every_broken_request_gets_its_error(spark, trips, manifest):
    from functools import reduce

    frames = [request(spark, **values) for values, _ in BROKEN]
    ids = [S.validated(f).first().scenario_id for f in frames]
    made = S.prepare_scenarios(reduce(lambda a, b: a.union(b), [*frames, request(spark)]), trips, manifest)
    assert made.samples.count() == 1
    errors = {r.scenario_id: r.error for r in made.errors.collect()}
    assert len(errors) == len(BROKEN)
    for scenario, (_, message) in zip(ids, BROKEN):
        assert message in errors[scenario]


def test_unknown_vehicle_and_too_much_history(spark, trips, manifest):
    _, error = run(spark, trips, manifest.filter("vin = 'V01'"))
    assert "manifest" in error
    _, error = run(spark, trips, manifest, SampleSettings(max_history_trips=1), history_trip_ids=["V00_0000", "V00_0001"])
    assert error == "At most 1 history trips are supported"


def test_hash_is_the_request_content(spark):
    demo = request(
        spark, vin=" VIN006", reference_trip_id="VIN006_20260213T130000Z_0003", departure_time="2026-02-13T14:00:00+00:00",
        origin_latitude=48.987, origin_longitude=2.329, prefix_fraction=0.25, history_trip_ids=["VIN006_20260213T070000Z_0001"],
    )
    assert S.validated(demo).first().scenario_id == "58bdb1120b4ee7377a1d4119b062ccf965c2378e2d88c63f12ba96ae9e6ca8cb"
    both = S.validated(demo.union(demo).union(demo.withColumn("top_k", F.lit(10))))
    assert both.count() == 2


def test_eligible_rows_and_reference_defaults(spark, trips):
    ordered = S.ordered_trips(trips)
    located = S.located_requests(S.validated(request(spark)), ordered, __import__("tripweave").SpreadSettings())
    rows = S.eligible_history_rows(located, ordered).orderBy("ordinal").collect()
    assert [r.trip_id for r in rows] == ["V00_0000", "V00_0001", "V00_0002"]
    d = {r.reference_trip_id: r for r in S.reference_defaults(trips, 0.25, 2).collect()}
    assert d[ID].history_trip_ids == ["V00_0001", "V00_0002"] and d[ID].eligible_history_trips == 3
    assert d["V01_0000"].history_trip_ids == []


def test_request_file(spark, tmp_path):
    good = tmp_path / "r.json"
    good.write_text('{"vin": "V00", "reference_trip_id": "x", "prefix_points": [[1, 2]]}\n')
    assert read_requests(spark, str(good)).first().prefix_points == [[1.0, 2.0]]


def test_every_bad_line_of_a_request_file_is_its_own_error(spark, tmp_path, trips, manifest):
    sound = '{"vin": "V00", "reference_trip_id": "%s"' % ID
    lines = [
        sound + "}", "", sound + "}", "nonsense", "nonsense", sound + "} more", sound + ', "speed": 3}',
        sound + ', "prefix_fraction": "x"}', sound + ', "top_k": [1]}', sound + ', "prefix_points": 5}', "[1]",
        sound + ', "prefix_fraction": "0.25"}',
    ]
    (tmp_path / "bad.json").write_text("\n".join(lines))
    made = S.prepare_scenarios(read_requests(spark, str(tmp_path / "bad.json")), trips, manifest)
    assert made.samples.count() == 2  # two equal requests are one
    errors = [r.error for r in made.errors.collect()]
    assert sorted(e.split(":")[0] for e in errors) == ["The line is not one JSON object"] * 4 + ["Unknown settings"] + [
        "Values of the wrong type"
    ] * 3


def test_a_trip_under_way_is_no_history(spark, manifest):
    # A 08:00-12:00, B 09:00-10:00, C 13:00-14:00; asked for 11:00.
    def timed(i, start, end):
        vin, name, _, _, *rest = trip("V00", i)
        return (vin, name, T0.replace(hour=start), T0.replace(hour=end), *rest)

    table = spark.createDataFrame([timed(0, 8, 12), timed(1, 9, 10), timed(2, 13, 14)], SCHEMA)
    s, _ = run(spark, table, manifest, reference_trip_id="V00_0002", departure_time=T0.replace(hour=11).isoformat())
    assert s.provenance.history_trip_ids == ["V00_0001"] and s.provenance.eligible_history_trips == 1
    _, error = run(
        spark, table, manifest, reference_trip_id="V00_0002", departure_time=T0.replace(hour=11).isoformat(),
        history_trip_ids=["V00_0000"],
    )
    assert "end before departure: V00_0000" in error
    d = {r.reference_trip_id: r for r in S.reference_defaults(table, 0.0, 5).collect()}
    assert d["V00_0001"].history_trip_ids == [] and d["V00_0002"].history_trip_ids == ["V00_0000", "V00_0001"]


def test_equal_departures_are_one_moment(spark, trips):
    ordered = S.ordered_trips(trips)
    same = spark.range(1000).selectExpr("'V00' AS vin", "timestamp'2026-02-13 12:30:00' AS departure", "id")
    counted = S.with_trip_counts(same, ordered, __import__("tripweave").SpreadSettings())
    assert counted.count() == 1000 and counted.select("completed", "started").distinct().count() == 1


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_last_ended_trips_are_found_by_blocks(spark, fan):
    """Overlapping trips, some open for long; against a look at every trip."""
    import random
    from datetime import datetime, timedelta

    from tripweave.operators.scenarios import last_ended

    rnd, t0 = random.Random(4), datetime(2026, 1, 1)
    trips, asked = [], []
    for vin, n, open_share in (("A", 150, 0.0), ("B", 150, 0.9), ("C", 3, 0.5), ("D", 40, 1.0)):
        for i in range(n):
            start = t0 + timedelta(minutes=10 * i)
            long = rnd.random() < open_share
            end = start + timedelta(minutes=10**5 if long else rnd.randint(1, 200))
            trips.append((vin, i + 1, f"{vin}{i + 1}", start, end))
        for _ in range(15):
            departure = t0 + timedelta(minutes=rnd.randint(-5, 10 * n + 300))
            started = sum(t[0] == vin and t[3] < departure for t in trips)
            asked.append((f"q{len(asked)}", vin, f"{vin}{rnd.randint(1, n)}", departure, started, rnd.choice([0, 1, 3, 20])))
    table = spark.createDataFrame(trips, "VIN string, ordinal long, trip_id string, StartTrip timestamp, EndTrip timestamp")
    rows = spark.createDataFrame(asked, "k string, VIN string, reference_trip_id string, departure timestamp, started long, _limit int")
    found = {}
    for r in last_ended(rows, "k", table, F.col("trip_id"), fan).collect():
        found.setdefault(r.k, set()).add(r.item)
    for k, vin, reference, departure, _, limit in asked:
        fit = [t[2] for t in trips if t[0] == vin and t[3] < departure and t[4] < departure and t[2] != reference]
        assert found.get(k, set()) == set(fit[len(fit) - min(limit, len(fit)) :]), k
