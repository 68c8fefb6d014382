import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
# A spread over all stages; the driver compares every query.
NAMES = [
    "clean_rows", "discard_log", "clean_reason_counts", "start_end_events", "batches", "pairs", "rejections", "trips",
    "points", "lineage", "cleaning_audit", "build_audit", "split", "samples", "history_tensor", "predictions", "metrics",
    "metrics_by_group", "error_histogram", "scenario_samples", "scenario_errors", "map_layers",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


def test_registry():
    queries, oracles = E.queries(), E.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) >= 75


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cur = duck.execute(E.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    mine = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    theirs = [tuple(plain(v) for v in r) for r in cur.fetchall()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)


def test_model_queries_train_the_configured_forest():
    from tripweave.config import ForestSettings
    from workload.model_queries import CFG

    assert CFG.forest == ForestSettings()


def test_a_reloaded_model_predicts_every_split(spark):
    queries = E.queries()
    assert queries["model_reloaded"](spark, SF).count() == queries["samples"](spark, SF).count() > 0


def test_metrics_of_the_test_split_score_no_other(spark, monkeypatch):
    from workload import model_queries as M
    from workload.queries import run, stand_in_scores
    from tripweave.operators.ranking import prediction_rows

    scored = []

    class StandIn:
        def predict(self, samples, top_k):
            scored.append({r["split"] for r in samples.select("split").distinct().collect()})
            return prediction_rows(stand_in_scores(samples), top_k, M.SAMPLES.grid_cell_degrees)

    monkeypatch.setattr(M, "model", lambda spark, sf: StandIn())
    M._predictions.cache_clear()
    try:
        metrics = E.queries()["model_metrics"](spark, SF).first().asDict()
        assert scored == [{"test"}]
        everything = M.predictions(spark, SF)
        assert scored[0].isdisjoint(scored[1]) and len(scored) == 2
        assert everything.count() == run(spark, SF).samples.count()
        assert M.evaluate.evaluate_split(everything, "test", M.CFG.evaluation).first().asDict() == metrics
    finally:
        M._predictions.cache_clear()


def test_flagship(spark):
    assert E.entry(spark).count() > 0
