"""What scenarios move and write: points of trips travel once."""

from tripweave.operators import scenarios as S
from workload import scenario_queries as Q
from workload.queries import QUERIES

from .test_samples import SCHEMA, trip
from .test_scenarios import request


def trips_of(spark):
    return spark.createDataFrame([trip("V00", i) for i in range(5)], SCHEMA)


def test_defaults_are_counted_without_points(spark, monkeypatch):
    written = {}

    def noted(df, label, *more):
        written[label] = df.columns
        return made(df, label, *more)

    made = S.stage
    monkeypatch.setattr(S, "stage", noted)
    rows = S.reference_defaults(trips_of(spark), 0.5, 2).collect()
    assert "trajectory" not in written["defaults"]
    got = {r.reference_trip_id: r for r in rows}
    assert len(got) == 5 and all(len(r.prefix_points) > 0 and r.actual_latitude is not None for r in rows)
    assert got["V00_0004"].history_trip_ids == ["V00_0002", "V00_0003"]


def test_points_join_once_the_trips_before_are_counted(spark, monkeypatch):
    seen = []
    counts = S.with_trip_counts
    monkeypatch.setattr(S, "with_trip_counts", lambda rows, *more: seen.append(rows) or counts(rows, *more))
    ordered = S.ordered_trips(trips_of(spark))
    for trip_id, known in (("V00_0003", True), ("none", False)):
        row = S.located_requests(S.validated(request(spark, reference_trip_id=trip_id)), ordered, Q.SPREAD).first()
        assert (row.error is None) == known
        assert (row.ref is not None) == known and (not known or len(row.ref.trajectory) > 1)
    assert all("trajectory" not in rows.schema["ref"].dataType.names for rows in seen)


def test_chosen_history_reads_written_requests(spark, monkeypatch):
    class Run:
        trips = trips_of(spark)

    written = []
    made = Q.stage
    monkeypatch.setattr(Q, "run", lambda *_: Run)
    monkeypatch.setattr(Q, "stage", lambda df, label: written.append((label, df.columns)) or made(df, label))
    monkeypatch.setattr(Q, "requests", lambda s, _: request(s, reference_trip_id="V00_0003"))
    (row,) = QUERIES["chosen_history"](spark, "").collect()
    assert row.ids == "V00_0000;V00_0001;V00_0002"
    assert [label for label, _ in written] == ["ordered", "located"]
    assert "trajectory_prefix" not in written[1][1] and "ref" not in written[1][1]

