"""Queries that train and apply the destination model (M-03..M-07, M-10, M-11, F-04, I-16, E-10).

Trees have no SQL counterpart; what must hold of their predictions has. The forest has the
operator's own settings. Predictions are written once and read by the queries over them.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

from tripweave.config import ProjectSettings
from tripweave.functions.geo import km_between
from tripweave.models.bootstrap import PRIME, THRESHOLDS, balanced_weights
from tripweave.models.forest import load_manifest, load_model, save_manifest, train
from tripweave.operators import evaluate
from tripweave.plans.pipeline import run_summary, score_scenarios, score_trips
from tripweave.session import stage, staging_root

from .queries import SAMPLES, register, run
from .scenario_queries import requests
from .telemetry import SETTINGS

CFG = ProjectSettings(build=SETTINGS, samples=SAMPLES)


@lru_cache(maxsize=4)
def _model(app: str, spark, sf):
    r = run(spark, sf)
    return train(r.samples, r.manifest, CFG.forest, SAMPLES.grid_cell_degrees, CFG.fingerprint)


def model(spark, sf):
    return _model(spark.sparkContext.applicationId, spark, sf)


@lru_cache(maxsize=8)
def _predictions(app: str, spark, sf, of_test: bool):
    samples = run(spark, sf).samples
    chosen = samples.filter(F.col("split").eqNullSafe("test") == of_test)
    return stage(model(spark, sf).predict(chosen, 5), "model-predictions")


def test_predictions(spark, sf):
    """Predictions of the test split, all that its metrics read; written once."""
    return _predictions(spark.sparkContext.applicationId, spark, sf, True)


def predictions(spark, sf):
    """Predictions of all samples, written once."""
    others = _predictions(spark.sparkContext.applicationId, spark, sf, False)
    return test_predictions(spark, sf).unionByName(others)


@lru_cache(maxsize=4)
def _reloaded(app: str, spark, sf):
    path = f"{staging_root(spark)}/model-{uuid.uuid4().hex}"
    model(spark, sf).save(path)
    return load_model(spark, path)


def reloaded(spark, sf):
    """The model, written and read back."""
    return _reloaded(spark.sparkContext.applicationId, spark, sf)


@lru_cache(maxsize=4)
def _reloaded_predictions(app: str, spark, sf):
    p = reloaded(spark, sf).predict(run(spark, sf).samples, 3)
    return stage(
        p.select("sample_id", "predicted_latitude", "predicted_longitude", "predicted_cell", "actual_rank", "error_km"),
        "reloaded-predictions",
    )


def reloaded_predictions(spark, sf):
    """What the reloaded model predicts, written once."""
    return _reloaded_predictions(spark.sparkContext.applicationId, spark, sf)


def _mark_sql() -> str:
    steps = [f"(key % {PRIME} + (tree + 1) * 1000003 + {CFG.forest.seed}) % {PRIME} AS x", f"(x * 48271 + 11) % {PRIME} AS x"]
    steps += [f"((x * x) % {PRIME} + x * 16807 % {PRIME}) % {PRIME} AS x", f"(x * 69621 + 7) % {PRIME} AS x"]
    table = "keyed"
    for step in steps:
        table = f"(SELECT actual_cell, key, tree, {step} FROM {table})"
    return table


_DRAWN = " + ".join(f"(x >= {t})::INTEGER" for t in THRESHOLDS)


@register("bootstrap_weights", "samples", f"""
    SELECT actual_cell, tree::INTEGER AS tree, drawn, sum(drawn) OVER (PARTITION BY tree) / (count(*) OVER (PARTITION BY tree) * drawn) AS class_weight
    FROM (
        SELECT actual_cell, tree, sum({_DRAWN})::BIGINT AS drawn
        FROM (SELECT * FROM {_mark_sql().replace("FROM keyed", "FROM (SELECT actual_cell, ('0x' || md5(sample_id)[1:8])::BIGINT AS key, unnest(range(" + str(CFG.forest.trees) + "))::BIGINT AS tree FROM samples WHERE split = 'train')")})
        GROUP BY actual_cell, tree
    ) WHERE drawn > 0
""")
def _(spark, sf):
    return balanced_weights(run(spark, sf).samples.filter("split = 'train'"), CFG.forest.trees, CFG.forest.seed)


@register("model_predictions")
def _(spark, sf):
    return predictions(spark, sf).drop("top_k_candidates")


@register("manifest_round_trip", "manifest", "SELECT vin, split, 42::INTEGER AS seed FROM manifest")
def _(spark, sf):
    """The split manifest, written and read back as a model's save and load do, under their checks.
    The trees have no part in it; ``reload_parity`` covers the whole model."""
    path = f"{staging_root(spark)}/manifest-{uuid.uuid4().hex}"
    save_manifest(run(spark, sf).manifest, path)
    return load_manifest(spark, path).select("vin", "split", "seed")


@register("prediction_checks", "samples", """SELECT sample_id, split, actual_cell, true AS error_holds, true AS rank_holds, true AS order_holds FROM samples""")
def _(spark, sf):
    """What must hold of every prediction, whatever the trees say."""
    p = predictions(spark, sf)
    c, rank = F.col("top_k_candidates"), F.col("actual_rank")
    away = km_between(
        F.struct(F.col("predicted_latitude").alias("latitude"), F.col("predicted_longitude").alias("longitude")),
        F.struct(F.col("actual_latitude").alias("latitude"), F.col("actual_longitude").alias("longitude")),
    )
    among = F.filter(c, lambda x: x["cell"] == F.col("actual_cell"))
    ranked = F.when(F.size(among) > 0, F.get(among, F.lit(0))["rank"] == rank).otherwise(rank.isNull() | (rank > F.size(c)))
    ordered = F.forall(
        F.sequence(F.lit(1), F.size(c)),
        lambda i: (F.get(c, i - 1)["rank"] == i)
        & ((i == 1) | (F.get(c, i - 1)["probability"] <= F.get(c, F.greatest(i - 2, F.lit(0)))["probability"])),
    )
    return p.select(
        "sample_id", "split", "actual_cell", (F.abs(F.col("error_km") - away) < 1e-9).alias("error_holds"),
        F.coalesce(ranked, F.lit(False)).alias("rank_holds"), ordered.alias("order_holds"),
    )


@register("reload_parity", "samples", "SELECT split, count(*) AS predicted, 0::BIGINT AS differing FROM samples GROUP BY split")
def _(spark, sf):
    """A model read back predicts what the saved one does, over all splits."""
    samples = run(spark, sf).samples
    cols = ["predicted_latitude", "predicted_longitude", "predicted_cell", "actual_rank", "error_km"]
    here = model(spark, sf).predict(samples, 3).select("sample_id", "split", F.struct(*cols).alias("here"))
    back = reloaded_predictions(spark, sf).select("sample_id", F.struct(*cols).alias("back"))
    return here.join(back, "sample_id").groupBy("split").agg(
        F.count(F.lit(1)).alias("predicted"), F.count_if(~F.col("here").eqNullSafe(F.col("back"))).alias("differing")
    )


@register("model_metrics")
def _(spark, sf):
    return evaluate.evaluate_split(test_predictions(spark, sf), "test", CFG.evaluation)


@register("model_reloaded")
def _(spark, sf):
    return reloaded_predictions(spark, sf)


@register("scenario_predictions")
def _(spark, sf):
    p, _ = score_scenarios(requests(spark, sf), run(spark, sf).trips, model(spark, sf), CFG)
    return p.drop("top_k_candidates")


@register("trip_predictions")
def _(spark, sf):
    return score_trips(run(spark, sf).trips, 0.5, model(spark, sf), CFG, 3).drop("top_k_candidates")


@register("run_summary")
def _(spark, sf):
    metrics = evaluate.evaluate_split(test_predictions(spark, sf), "test", CFG.evaluation)
    return run_summary(run(spark, sf).build.audit, metrics).select(
        "trip_build.accepted_trips", "trip_build.rejection_records", "model_test.sample_count",
        F.round("model_test.median_haversine_km", 6).alias("median_km"), "scientific_note",
    )
