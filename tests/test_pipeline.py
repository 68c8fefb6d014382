import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tripweave.config import ForestSettings, ProjectSettings
from tripweave.models.forest import load_model
from tripweave.plans.pipeline import clean_stage, evaluate_saved, run_all, score_trips
from tripweave.sources import tables as IO

from .helpers import RAW_SCHEMA, batch, end, start


@pytest.fixture(scope="module")
def raw_csv(spark, tmp_path_factory):
    rows = []
    for v in range(12):
        for i in range(4):
            lat, lon = 48.0 + 0.02 * v, 2.0 + 0.02 * i
            t = i * 7200
            lats, lons = [lat + 0.003 * j for j in range(5)], [lon + 0.002 * j for j in range(5)]
            rows += start(f"VIN{v:03d}", t, lat=lat, lon=lon)
            rows += batch(f"VIN{v:03d}", t + 60, lats, lons, [70.0] * 5)
            rows += end(f"VIN{v:03d}", t + 600, lat=lats[-1], lon=lons[-1])
    path = str(tmp_path_factory.mktemp("raw") / "raw.csv")
    spark.createDataFrame(rows, RAW_SCHEMA).coalesce(1).write.options(**IO.CSV).csv(path)
    return path


@pytest.fixture(scope="module")
def finished(spark, raw_csv, tmp_path_factory):
    cfg = ProjectSettings(forest=ForestSettings(trees=10, max_depth=6))
    out = str(tmp_path_factory.mktemp("run"))
    return cfg, out, run_all(spark, raw_csv, out, cfg)


def test_run_all_writes_everything(spark, finished):
    _, _, paths = finished
    assert spark.read.parquet(paths["trips"]).count() == 48
    assert spark.read.parquet(paths["points"]).count() == 48 * 5
    assert spark.read.parquet(paths["rejected"]).count() == 0
    summary = json.loads(spark.read.text(paths["summary"]).first().value)
    assert summary["trip_build"]["accepted_trips"] == 48
    assert summary["model_test"]["sample_count"] == 2 * 4 * 3
    assert summary["model_test"]["mean_haversine_km"] >= 0
    assert len(spark.read.parquet(paths["source"]).first().sha256) == 64


def test_saved_model_predicts_the_same(spark, finished):
    cfg, _, paths = finished
    model = load_model(spark, paths["model"])
    trips = spark.read.parquet(paths["trips"])
    scored = score_trips(trips, 0.25, model, cfg, 3)
    saved = spark.read.parquet(paths["predictions"]).filter("prefix_fraction = 0.25")
    both = scored.select("trip_id", F.col("error_km").alias("a")).join(saved.select("trip_id", F.col("error_km").alias("b")), "trip_id")
    assert both.count() == 48 and both.filter("abs(a - b) > 1e-9").count() == 0
    row = scored.first()
    assert len(row.top_k_candidates) == 3 and json.loads(row.input_provenance)["model_feature_count"] == 21
    assert model.config_hash == cfg.fingerprint


def test_saved_predictions_can_be_evaluated_again(spark, finished, tmp_path):
    cfg, _, paths = finished
    first = json.loads(spark.read.text(paths["metrics"]).first().value)
    again = evaluate_saved(spark, paths["predictions"], cfg).first()
    assert again.median_haversine_km == first["median_haversine_km"]
    text = str(tmp_path / "p.csv")
    IO.write_table(spark.read.parquet(paths["predictions"]), text)
    assert evaluate_saved(spark, text, cfg).first().median_haversine_km == pytest.approx(again.median_haversine_km)


def test_trips_survive_csv(spark, finished, tmp_path):
    from tripweave.operators.samples import prepare_samples

    _, _, paths = finished
    trips = spark.read.parquet(paths["trips"])
    path = str(tmp_path / "trips.csv")
    IO.write_table(trips, path)
    again = IO.load_trips(spark, path)
    a = prepare_samples(trips).orderBy("sample_id").collect()
    b = prepare_samples(again).orderBy("sample_id").collect()
    assert a == b and len(a) == 48 * 3


def test_foreign_model_is_refused(spark, finished, tmp_path):
    spark.createDataFrame([('{"kind": "other"}',)], "value string").write.text(str(tmp_path / "metadata"))
    with pytest.raises(TypeError):
        load_model(spark, str(tmp_path))


def test_clean_stage(spark, raw_csv, tmp_path):
    paths = clean_stage(spark, raw_csv, str(tmp_path), ProjectSettings())
    assert spark.read.parquet(paths["cleaned_raw"]).count() == 48 * 9
    assert json.loads(spark.read.text(paths["cleaning_audit"]).first().value)["raw_rows_received"] == 48 * 9


def test_formats_and_previews(spark, finished):
    with pytest.raises(ValueError, match="Unsupported"):
        IO.read_raw(spark, "/tmp/raw.xlsx")
    _, _, paths = finished
    p = IO.preview(spark.read.parquet(paths["trips"]), ["trip_id"], 3, "trip_id")
    assert [r.trip_id[:6] for r in p.collect()] == ["VIN000"] * 3
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<trip_id:string>" in plan and "TakeOrdered" in plan


def test_content_fingerprint_ignores_order(spark, raw_csv):
    df = IO.read_raw(spark, raw_csv)
    assert IO.content_fingerprint(df).first() == IO.content_fingerprint(df.repartition(7)).first()
    assert IO.content_fingerprint(df).first() != IO.content_fingerprint(df.limit(10)).first()


def test_files_of_any_size_are_hashed_part_by_part(spark, tmp_path):
    from tripweave.sources.tables import file_fingerprints

    contents = {"small": b"x" * 10, "empty": b"", "two parts": b"y" * 128, "odd %20é": bytes(range(256)) * 5}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in file_fingerprints(spark, str(tmp_path), part_bytes=64).collect()}
    # Spark lists no empty files.
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items() if data}


def test_a_build_records_the_rows_of_every_source_file(spark, raw_csv, tmp_path):
    from tripweave.plans.pipeline import build_stage

    paths = build_stage(spark, raw_csv, str(tmp_path), ProjectSettings())
    files = spark.read.parquet(paths["source"]).collect()
    contents = spark.read.parquet(paths["source_contents"]).collect()
    parts = [p.read_bytes() for p in Path(raw_csv).glob("*.csv")]
    assert sorted(f.sha256 for f in files) == sorted(hashlib.sha256(p).hexdigest() for p in parts if p)
    assert len(contents) == 1 and contents[0].content_hash
    assert contents[0].rows == spark.read.text(raw_csv).count()


def test_file_contents_see_a_change_of_the_same_length(spark, tmp_path):
    def hashes(name, *texts):
        (tmp_path / name).mkdir()
        for i, text in enumerate(texts):
            (tmp_path / name / f"{i}.csv").write_text(text)
        return {r.path[-5]: (r.rows, r.content_hash) for r in IO.file_contents(spark, str(tmp_path / name)).collect()}

    one = hashes("one.csv", "a,b\n1,\n3,4\n", "a,b\n5,6\n")
    two = hashes("two.csv", "a,b\n,1\n3,4\n", "a,b\n5,6\n")
    assert one["0"] != two["0"] and one["1"] == two["1"] and [one["0"][0], one["1"][0]] == [3, 2]
    for name, row in (("p.parquet", ("x", None)), ("q.parquet", (None, "x"))):
        spark.createDataFrame([row], "a string, b string").write.parquet(str(tmp_path / name))
    p, q = (IO.file_contents(spark, str(tmp_path / n)).first().content_hash for n in ("p.parquet", "q.parquet"))
    assert p != q


def test_predictions_carry_no_list_of_all_cells(spark, finished):
    from tripweave.models.forest import BEAM
    from tripweave.operators.samples import prepare_samples

    _, _, paths = finished
    model = load_model(spark, paths["model"])
    samples = prepare_samples(spark.read.parquet(paths["trips"]))
    scored = model.score(samples, 3)
    cells = {r[0] for r in samples.filter("split = 'train'").select("actual_cell").distinct().collect()}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert len(cells) > BEAM and not any(c in plan for c in cells)
    sizes = scored.select(F.size("cells").alias("n"), F.size("probabilities").alias("m"))
    assert {(r.n, r.m) for r in sizes.distinct().collect()} == {(BEAM, BEAM)}
    found = {r[0] for r in scored.select(F.explode("cells")).distinct().collect()}
    assert found <= cells


def test_a_tampered_manifest_is_refused(spark, finished, tmp_path):
    import shutil

    _, _, paths = finished
    shutil.copytree(paths["model"], tmp_path / "model")
    manifest = spark.read.parquet(paths["model"] + "/manifest")
    swapped = F.when(F.col("split") == "test", "train").otherwise(F.col("split"))
    manifest.withColumn("split", swapped).write.mode("overwrite").parquet(str(tmp_path / "model" / "manifest"))
    with pytest.raises(ValueError, match="not the one"):
        load_model(spark, str(tmp_path / "model"))


def test_a_manifest_is_saved_and_checked_without_a_model(spark, tmp_path, monkeypatch):
    import __spark_entry__ as E
    from tripweave.models import forest
    from workload import model_queries

    def no_training(*_):
        raise AssertionError("the manifest needs no trees")

    monkeypatch.setattr(model_queries, "model", no_training)
    assert E.queries()["manifest_round_trip"](spark, "/root/testdata/sf0.001").count() > 0
    rows = [("a", "train", 42), ("b", "test", 42), ("c", "validation", 42)]
    manifest = spark.createDataFrame(rows, "vin string, split string, seed int")
    forest.save_manifest(manifest, str(tmp_path))
    assert sorted(map(tuple, forest.load_manifest(spark, str(tmp_path)).collect())) == rows
    other = manifest.replace({"c": "d"}, subset="vin")
    other.write.mode("overwrite").parquet(str(tmp_path / "manifest"))
    with pytest.raises(ValueError, match="not the one"):
        forest.load_manifest(spark, str(tmp_path))
