import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tripweave.config import SampleSettings, SpreadSettings
from tripweave.operators import samples as S
from tripweave.operators import tensors as X
from tripweave.operators.split import attach_split, make_split
from tripweave.schema import FEATURES, LATLON

from .helpers import haversine

SCHEMA = (
    "VIN string, trip_id string, StartTrip timestamp, EndTrip timestamp, "
    "Trajectory array<struct<latitude:double,longitude:double>>, end_latitude double, end_longitude double"
)
T0 = datetime(2026, 2, 13, 7, 0, 0, tzinfo=timezone.utc)


def trip(vin, i, n=5, hours=3, minutes=10):
    begin = T0 + timedelta(hours=hours * i)
    path = [(48.0 + 0.01 * i + 0.001 * j, 2.0 + 0.002 * j) for j in range(n)]
    return (vin, f"{vin}_{i:04d}", begin, begin + timedelta(minutes=minutes), path, *path[-1])


@pytest.fixture(scope="module")
def trips(spark):
    rows = [trip("HOT", i, n=2 + i % 6) for i in range(60)]
    rows += [trip(f"V{v:02d}", i) for v in range(9) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    return df.cache()


@pytest.fixture(scope="module")
def made(trips):
    return S.prepare_samples(trips, spread=SpreadSettings(bucket_seconds=7200, history_chunk=25)).cache()


def test_leakage_and_history(trips, made):
    ordered = {}
    for t in trips.orderBy("VIN", "StartTrip").collect():
        ordered.setdefault(t.VIN, []).append(t)
    rows = made.collect()
    assert len(rows) == 3 * trips.count()
    for s in rows:
        mine = ordered[s.VIN]
        k = [t.trip_id for t in mine].index(s.trip_id)
        past = mine[max(0, k - 20) : k]
        assert [(h.latitude, h.longitude) for h in s.history_sequence] == [(t.end_latitude, t.end_longitude) for t in past]
        assert all(h.completed_at < s.StartTrip.replace(tzinfo=timezone.utc).timestamp() for h in s.history_sequence) or past
        n, f = len(s.trajectory), s.prefix_fraction
        most = max(1, n - 1)
        assert len(s.trajectory_prefix) == min(1 if f == 0 else max(1, math.ceil(most * f)), most)
        assert len(s.trajectory_prefix) < n
        assert s.history_count == len(past)
        if past:
            assert s.mean_destination_latitude == pytest.approx(sum(t.end_latitude for t in past) / len(past))
            assert s.last_destination_latitude == past[-1].end_latitude
        else:
            assert s.mean_destination_latitude == s.origin_latitude == s.last_destination_latitude
        pts = [(p.latitude, p.longitude) for p in s.trajectory_prefix]
        assert s.prefix_path_km == pytest.approx(sum(haversine(a, b) for a, b in zip(pts, pts[1:])) / 1000, abs=1e-9)
    assert not {"VIN", "actual_latitude", "actual_longitude"} & set(FEATURES)


def test_calendar(made):
    s = made.filter("trip_id = 'HOT_0000' AND prefix_fraction = 0").first()
    assert s.hour_sin == pytest.approx(math.sin(2 * math.pi * 7 / 24))
    assert s.weekday_cos == pytest.approx(math.cos(2 * math.pi * 4 / 7))  # a Friday
    assert s.month_sin == pytest.approx(math.sin(2 * math.pi / 12))
    assert s.weekend == 0.0
    assert s.sample_id == "HOT_0000@0.000"


def test_prefix_edges(spark):
    from tripweave.functions.paths import observed_count

    rows = [(2, 0.0), (2, 0.5), (2, 0.999), (5, 0.25), (5, 0.26), (5, 0.999), (1, 0.5)]
    df = spark.createDataFrame(rows, "n int, f double").select(observed_count(F.col("n"), F.col("f")).alias("c"))
    assert [r.c for r in df.collect()] == [1, 1, 1, 1, 2, 4, 1]


def test_split_sizes_determinism_and_disjointness(spark):
    for n, sizes in ((3, (1, 1, 1)), (10, (6, 2, 2)), (14, (10, 2, 2)), (100, (70, 15, 15))):
        trips = spark.range(n).select(F.format_string("VIN%03d", "id").alias("VIN"))
        rows = make_split(trips, SampleSettings()).collect()
        got = {}
        for r in rows:
            got.setdefault(r.split, set()).add(r.vin)
        assert tuple(len(got[s]) for s in ("train", "validation", "test")) == sizes
        again = make_split(trips.repartition(5).union(trips), SampleSettings()).collect()
        assert sorted(rows) == sorted(again)
    other = make_split(trips, SampleSettings(split_seed=7)).collect()
    assert sorted(other) != sorted(rows)


def test_split_errors(spark):
    two = spark.range(2).select(F.col("id").cast("string").alias("VIN"))
    with pytest.raises(Exception, match="three VINs"):
        make_split(two, SampleSettings()).collect()
    known = spark.createDataFrame([("0", "train")], "vin string, split string")
    with pytest.raises(Exception, match="absent from the split manifest"):
        attach_split(two, "VIN", known).collect()
    assert attach_split(two.filter("VIN = '0'"), "VIN", known).first().split == "train"


def test_pseudonym_is_a_fixed_hash(spark):
    assert spark.range(1).select(S.pseudonym(F.lit("VIN006")).alias("p")).first().p == "vehicle-3c641937fb"


def test_overlap_and_bad_trajectories_fail(spark, trips):
    clash = trips.union(spark.createDataFrame([trip("HOT", 1, minutes=400)], SCHEMA).withColumn("trip_id", F.lit("x")))
    with pytest.raises(Exception, match="Overlapping"):
        S.prepare_samples(clash).collect()
    assert S.overlap_count(trips).first().overlaps == 0
    assert S.overlap_count(clash).first().overlaps > 0
    single = trips.limit(1).withColumn("Trajectory", F.slice("Trajectory", F.lit(1), F.lit(1)))
    with pytest.raises(Exception, match="Unusable trajectory"):
        S.normalised_trips(single).collect()
    with pytest.raises(ValueError, match="EndTrip"):
        S.prepare_samples(trips.drop("EndTrip"))


def test_zero_history(trips):
    s = S.prepare_samples(trips, SampleSettings(max_history_trips=0, prefix_fractions=(0.0,)))
    assert s.agg(F.max("history_count")).first()[0] == 0.0


def test_finite_checks(made):
    assert made.count() == S.checked_features(made).filter(F.size("features_array") == 21).count()
    with pytest.raises(Exception, match="non-finite"):
        S.checked_features(made.withColumn("hour_sin", F.lit(float("nan")))).collect()
    with pytest.raises(Exception, match="targets"):
        S.checked_targets(made.withColumn("actual_latitude", F.lit(None).cast("double"))).collect()


def test_tensors(made):
    cfg = SampleSettings(max_trajectory_points=3, max_history_trips=2)
    rows = X.model_arrays(made, cfg).join(made.select("sample_id", *FEATURES, "trajectory_prefix", "history_sequence", "actual_cell"), "sample_id").collect()
    train_cells = sorted({r.actual_cell for r in rows if r.split == "train"})
    for r in rows:
        assert len(r.trajectory) == 3 and len(r.history) == 2 and len(r.context) == 21
        seen = r.trajectory_prefix[-3:]
        assert r.trajectory[0][:2] == [0.0, 0.0] and r.trajectory[0][4] == 1.0
        assert all(v == 0.0 for row in r.trajectory[len(seen) :] for v in row)
        assert r.trajectory[len(seen) - 1][5] == 1.0
        past = r.history_sequence[-2:]
        assert all(v == 0.0 for row in r.history[: 2 - len(past)] for v in row)
        known = r.actual_cell in train_cells
        assert (r.label, r.label_weight) == ((train_cells.index(r.actual_cell), 1.0) if known else (0, 0.0))
    stats = {s.feature: s for s in X.context_statistics(made).collect()}
    assert stats["month_sin"].scale == 1.0
    assert list(stats) == list(FEATURES)
    assert LATLON.fieldNames() == ["latitude", "longitude"]
