import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripweave.config import EvaluationSettings
from tripweave.operators import evaluate, maps, report
from tripweave.operators.ranking import rank_of, top_candidates

SCHEMA = "trip_id string, VIN string, split string, prefix_fraction double, error_km double, actual_rank int"


def table(spark, errors, ranks=None, split="test"):
    ranks = ranks or [None] * len(errors)
    rows = [(f"t{i}", f"v{i % 3}", split if i % 4 else None, (i % 2) / 4, float(e), r) for i, (e, r) in enumerate(zip(errors, ranks))]
    return spark.createDataFrame(rows, SCHEMA)


def test_undefined_metrics_are_null(spark):
    m = evaluate.prediction_metrics(table(spark, [1.0, 2.0, 3.0])).first()
    assert m.top_1_cell_accuracy is None and m.mean_reciprocal_rank is None
    assert (m.cell_metrics_defined_samples, m.cell_metrics_undefined_samples) == (0, 3)
    assert m.median_haversine_km == 2.0 and m.p90_haversine_km == pytest.approx(2.8)
    assert m.recall_within_1km == pytest.approx(1 / 3)


def test_defined_ranks_only(spark):
    m = evaluate.prediction_metrics(table(spark, [1, 2, 3, 4], [1, 4, None, 2]), EvaluationSettings(top_k=(1, 3))).first()
    assert m.top_1_cell_accuracy == pytest.approx(1 / 3)
    assert m.top_3_cell_accuracy == pytest.approx(2 / 3)
    assert m.mean_reciprocal_rank == pytest.approx((1 + 0.25 + 0.5) / 3)


def test_one_sample(spark):
    m = evaluate.prediction_metrics(table(spark, [7.5])).first()
    assert m.mean_haversine_km == m.median_haversine_km == m.p90_haversine_km == 7.5


def test_groups_keep_nulls_and_skip_absent_columns(spark):
    g = evaluate.metrics_by_group(table(spark, range(8)), ("split", "prefix_fraction", "nothing")).collect()
    assert {(r.group, r.value): r.sample_count for r in g} == {
        ("split", "test"): 6, ("split", None): 2, ("prefix_fraction", "0.0"): 4, ("prefix_fraction", "0.25"): 4,
    }


def test_empty_input_is_an_error(spark):
    t = table(spark, [1.0])
    with pytest.raises(ValueError, match="empty"):
        evaluate.prediction_metrics(t.filter("false"))
    with pytest.raises(ValueError, match="'train'"):
        evaluate.evaluate_split(t, "train")


@pytest.mark.parametrize("errors", [[3.0, 3.0, 3.0], [0.0], list(np.random.default_rng(4).exponential(2, 400)), list(range(41))])
def test_histogram_equals_equal_width_cut(spark, errors):
    rows = report.error_histogram(table(spark, errors)).orderBy("bin").collect()
    bins = min(12, max(4, int(math.sqrt(len(errors)))))
    expected = pd.cut(pd.Series(errors, dtype=float), bins=bins).value_counts(sort=False)
    assert [r.predictions for r in rows] == expected.tolist()
    edges = np.array([[i.left, i.right] for i in expected.index])
    assert np.allclose([[r.low, r.high] for r in rows], edges, atol=2e-3 * max(1, max(errors)))


def test_worst_errors_have_a_tie_order(spark):
    t = table(spark, [5, 9, 9, 1]).withColumns(
        {"sample_id": F.col("trip_id"), "vehicle_id": F.col("VIN"), "predicted_cell_probability": F.lit(0.5)}
    )
    assert [r.sample_id for r in report.worst_errors(t, 2).collect()] == ["t1", "t2"]


def test_candidates_order_ties_and_clamp(spark):
    df = spark.createDataFrame([(["g2:1", "g1:1", "g3:1"], [0.4, 0.4, 0.2])], "cells array<string>, p array<double>")

    def cells(k):
        c = top_candidates(F.col("cells"), F.col("p"), k, 0.01)
        return df.select(c.alias("c"), rank_of(c, F.lit("g2:1")).alias("r"), rank_of(c, F.lit("g9:9")).alias("none")).first()

    assert [c.cell for c in cells(2).c] == ["g1:1", "g2:1"]
    assert (cells(2).r, cells(1).r, cells(2).none) == (2, None, None)
    assert len(cells(99).c) == 3 and len(cells(0).c) == 1


def test_prefix_text_errors(spark):
    texts = ["[[1,2],[3,4]]", '{"points": [[1,2]]}', "[[1,2]", "[]", "[[1,2],[91,0]]", "[[1]]", "5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(maps.parse_prefix_text(F.col("t")).alias("x"))
    got = [(r.x.error, r.x.points and len(r.x.points)) for r in df.collect()]
    assert got[0] == (None, 2) and got[1] == (None, 1)
    assert "not valid JSON" in got[2][0]
    assert "non-empty" in got[3][0] and "non-empty" in got[6][0]
    assert got[4][0].startswith("Prefix point 2") and got[5][0].startswith("Prefix point 1")


def test_geo_round_trip(spark):
    from tripweave.functions import geo

    df = spark.range(500).select(
        (F.col("id") * 0.713 % 180 - 90).alias("lat"), (F.col("id") * 1.37 % 360 - 180).alias("lon")
    )
    cell = geo.grid_cell(F.col("lat"), F.col("lon"), 0.01)
    centre = geo.grid_centre(cell, 0.01)
    off = df.filter((F.abs(centre["latitude"] - F.col("lat")) > 0.00501) | (F.abs(centre["longitude"] - F.col("lon")) > 0.00501))
    assert off.count() == 0
    half = geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))
    bad = [geo.in_bounds(F.lit(a), F.lit(b)) for a, b in ((91.0, 0.0), (0.0, -181.0), (float("nan"), 0.0), (float("inf"), 0.0))]
    unknown = geo.haversine_m(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    r = spark.range(1).select(half.alias("half"), unknown.alias("unknown"), *[b.alias(f"b{i}") for i, b in enumerate(bad)]).first()
    assert r.half == pytest.approx(math.pi * 6371.0088)
    assert r.unknown is None and not any(r[f"b{i}"] for i in range(4))


def test_rounding_is_by_the_binary_value(spark):
    from tripweave.functions.rounding import round_exact

    values = [2.675, 1.005, 0.125, 0.375, 134490.2265, 48.00000005, -2.675, -0.5, 1e6 + 0.0005, 2.5, 3.5]
    for digits in (0, 2, 3, 7):
        df = spark.createDataFrame([(v,) for v in values], "v double").select(round_exact(F.col("v"), digits).alias("r"))
        assert [r.r for r in df.collect()] == [float(round(v, digits)) for v in values]
