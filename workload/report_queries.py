"""Queries over ranking, metrics, reports and maps (M, E, R ids) on stand-in scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.operators import evaluate, maps, ranking, report
from tripweave.sources.tables import content_fingerprint, file_fingerprints, preview

from .oracle import R_KM, hav
from .queries import SAMPLES, register, run, stand_in_scores, us
from .telemetry import SETTINGS, telemetry

SIZE = SAMPLES.grid_cell_degrees


@register("top_candidates", "top", """SELECT sample_id, CAST(rk AS INT) AS rank, cell, round(probability,6) AS probability,
  round(clat,6) AS latitude, round(clon,6) AS longitude FROM top""")
def _(spark, sf):
    s = stand_in_scores(run(spark, sf).samples)
    c = ranking.top_candidates(F.col("cells"), F.col("probabilities"), 5, SIZE)
    return s.select("sample_id", F.inline(c)).select(
        "sample_id", "rank", "cell", *[F.round(x, 6).alias(x) for x in ("probability", "latitude", "longitude")]
    )


@register("actual_rank", "predictions", "SELECT sample_id, CAST(actual_rank AS INT) AS actual_rank FROM predictions")
def _(spark, sf):
    r = ranking.rank_of(F.col("top_k_candidates"), F.col("actual_cell"))
    return run(spark, sf).predictions.select("sample_id", r.alias("actual_rank"))


@register("predictions", "predictions", """SELECT sample_id, vin, vehicle_id, trip_id, split, prefix_fraction, actual_cell, predicted_cell,
  round(origin_latitude,6) AS origin_latitude, round(origin_longitude,6) AS origin_longitude,
  round(predicted_latitude,6) AS predicted_latitude, round(predicted_longitude,6) AS predicted_longitude,
  round(predicted_cell_probability,6) AS predicted_cell_probability, CAST(actual_rank AS INT) AS actual_rank, round(error_km,6) AS error_km FROM predictions""")
def _(spark, sf):
    p = ranking.prediction_rows(stand_in_scores(run(spark, sf).samples), 5, SIZE)
    return p.select(
        "sample_id", F.col("VIN").alias("vin"), "vehicle_id", "trip_id", "split", "prefix_fraction", "actual_cell", "predicted_cell",
        *[F.round(c, 6).alias(c) for c in ("origin_latitude", "origin_longitude", "predicted_latitude", "predicted_longitude", "predicted_cell_probability")],
        "actual_rank", F.round("error_km", 6).alias("error_km"),
    )


@register("residual_coordinates", "samples", """SELECT sample_id, round(origin_latitude + ((s_us // 7) % 1000)/100000.0::DOUBLE,6) AS predicted_latitude,
  round(origin_longitude + ((s_us // 11) % 1000)/100000.0::DOUBLE,6) AS predicted_longitude FROM samples""")
def _(spark, sf):
    s = run(spark, sf).samples
    s = s.withColumn("residual_latitude", F.expr("(unix_micros(StartTrip) div 7) % 1000 / 1000.0D")).withColumn(
        "residual_longitude", F.expr("(unix_micros(StartTrip) div 11) % 1000 / 1000.0D")
    )
    return ranking.coordinates_from_residuals(s).select(
        "sample_id", *[F.round(c, 6).alias(c) for c in ("predicted_latitude", "predicted_longitude")]
    )


@register("class_weights", "samples", """SELECT actual_cell, round((SELECT count(*) FROM samples WHERE split='train') /
  ((SELECT count(DISTINCT actual_cell) FROM samples WHERE split='train') * count(*)),6) AS class_weight
  FROM samples WHERE split='train' GROUP BY actual_cell""")
def _(spark, sf):
    return ranking.class_weights(run(spark, sf).samples).select("actual_cell", F.round("class_weight", 6).alias("class_weight"))


@register("train_guard", "samples", """SELECT split, count(*) AS samples, count(DISTINCT actual_cell) AS cells FROM samples GROUP BY split""")
def _(spark, sf):
    return run(spark, sf).samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("actual_cell").alias("cells")
    )


_METRICS = """count(*) AS sample_count, count(DISTINCT trip_id) AS trip_count, count(DISTINCT vin) AS vin_count,
  round(avg(error_km),6) AS mean_haversine_km, round(quantile_cont(error_km,0.5),6) AS median_haversine_km,
  round(quantile_cont(error_km,0.9),6) AS p90_haversine_km,
  round(avg(CASE WHEN error_km<=1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS recall_within_1km,
  round(avg(CASE WHEN error_km<=5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS recall_within_5km,
  round(avg(CASE WHEN error_km<=10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS recall_within_10km,
  round(avg(CASE WHEN error_km<=25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS recall_within_25km,
  count(actual_rank) AS cell_metrics_defined_samples, count(*)-count(actual_rank) AS cell_metrics_undefined_samples,
  round(avg(CASE WHEN actual_rank IS NOT NULL THEN CASE WHEN actual_rank<=1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END),6) AS top_1_cell_accuracy,
  round(avg(CASE WHEN actual_rank IS NOT NULL THEN CASE WHEN actual_rank<=3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END),6) AS top_3_cell_accuracy,
  round(avg(CASE WHEN actual_rank IS NOT NULL THEN CASE WHEN actual_rank<=5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END),6) AS top_5_cell_accuracy,
  round(avg(1.0::DOUBLE/actual_rank),6) AS mean_reciprocal_rank"""


def _six(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("metrics", "predictions", f"SELECT {_METRICS} FROM predictions")
def _(spark, sf):
    return _six(evaluate.prediction_metrics(run(spark, sf).predictions))


@register("metrics_of_split", "predictions", f"SELECT {_METRICS} FROM predictions WHERE split='test'")
def _(spark, sf):
    return _six(evaluate.evaluate_split(run(spark, sf).predictions, "test"))


@register("metrics_by_group", "predictions", f"""SELECT 'split' AS "group", split AS value, {_METRICS} FROM predictions GROUP BY split
  UNION ALL SELECT 'prefix_fraction', CAST(prefix_fraction AS VARCHAR), {_METRICS} FROM predictions GROUP BY prefix_fraction""")
def _(spark, sf):
    return _six(evaluate.metrics_by_group(run(spark, sf).predictions))


@register("vehicle_list", "accepted", "SELECT vin, count(*) AS trip_count, min(s_us) AS first_us, max(s_us) AS last_us FROM accepted GROUP BY vin")
def _(spark, sf):
    v = report.vehicle_list(run(spark, sf).trips)
    return v.select(F.col("VIN").alias("vin"), "trip_count", us("first_trip").alias("first_us"), us("last_trip").alias("last_us"))


@register("vehicle_distance", "accepted", """SELECT vin, count(*) AS trips, round(sum(CAST(printf('%.6f', dist/1000) AS DOUBLE)),3) AS distance_km FROM accepted GROUP BY vin""")
def _(spark, sf):
    return run(spark, sf).trips.groupBy(F.col("VIN").alias("vin")).agg(
        F.count(F.lit(1)).alias("trips"), F.round(F.sum("distance_km"), 3).alias("distance_km")
    )


@register("raw_profile", "telemetry", """SELECT count(*) AS raw_rows, count(DISTINCT vin) AS vins, count(DISTINCT trig) AS triggers,
  count(DISTINCT name) AS signals FROM telemetry""")
def _(spark, sf):
    return report.raw_profile(telemetry(spark, sf), SETTINGS)


@register("split_summary", "samples", "SELECT split, count(*) AS samples, count(DISTINCT vin) AS vins, count(DISTINCT trip_id) AS trips FROM samples GROUP BY split")
def _(spark, sf):
    return report.split_summary(run(spark, sf).samples)


@register("overview", "accepted", "SELECT count(*) AS trips, count(DISTINCT vin) AS vehicles, CAST(sum(n) AS BIGINT) AS points FROM accepted")
def _(spark, sf):
    return report.overview(run(spark, sf).trips)


@register("median_error_by_prefix", "predictions", """SELECT prefix_fraction, round(quantile_cont(error_km,0.5),6) AS median_error_km
  FROM predictions GROUP BY prefix_fraction""")
def _(spark, sf):
    return _six(report.median_error_by_prefix(run(spark, sf).predictions))


@register("split_kpis", "predictions", """SELECT split, round(avg(CASE WHEN actual_rank IS NOT NULL THEN CASE WHEN actual_rank<=3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END),6) AS top_3,
  count(DISTINCT vin) AS vehicles, round(quantile_cont(error_km,0.5),6) AS median_km, round(quantile_cont(error_km,0.9),6) AS p90_km FROM predictions GROUP BY split""")
def _(spark, sf):
    return _six(report.split_kpis(run(spark, sf).predictions))


@register("error_histogram", "predictions", """SELECT CAST(bin AS INT) AS bin, round(CASE WHEN bin=1 THEN lo-(hi-lo)*0.001::DOUBLE ELSE (bin-1)*w+lo END,6) AS low,
  round(CASE WHEN bin=b THEN hi ELSE bin*w+lo END,6) AS high, count(p.error_km) AS predictions
  FROM (SELECT *, unnest(range(1,b+1)) AS bin, (hi-lo)/b AS w FROM (SELECT least(12,greatest(4,CAST(floor(sqrt(count(*))) AS BIGINT))) AS b,
    min(error_km) AS lo, max(error_km) AS hi FROM predictions)) g
  LEFT JOIN predictions p ON (p.error_km > (bin-1)*w+lo OR (bin=1 AND p.error_km >= lo)) AND (p.error_km <= bin*w+lo OR bin=b) GROUP BY bin, lo, hi, w, b""")
def _(spark, sf):
    return _six(report.error_histogram(run(spark, sf).predictions))


@register("worst_errors", "predictions", """SELECT sample_id, vehicle_id, trip_id, prefix_fraction, round(error_km,6) AS error_km,
  CAST(actual_rank AS INT) AS actual_rank, round(predicted_cell_probability,6) AS predicted_cell_probability
  FROM (SELECT * FROM predictions ORDER BY predictions.error_km DESC, sample_id LIMIT 100)""")
def _(spark, sf):
    return _six(report.worst_errors(run(spark, sf).predictions, 100))


@register("candidate_table", "top", f"""SELECT sample_id, CAST(rk AS INT) AS rank, printf('%.1f%%', probability*100) AS probability,
  printf('%.2f', {hav('clat', 'clon', 'actual_latitude', 'actual_longitude', R_KM)}) AS distance_km, cell FROM top""")
def _(spark, sf):
    return report.candidate_table(run(spark, sf).predictions)


# Features that a trip's own departure, origin and prefix give, and those of its history.
_OWN_FEATURES = (
    "origin_latitude",
    "origin_longitude",
    "hour_sin",
    "hour_cos",
    "weekday_sin",
    "weekday_cos",
    "month_sin",
    "month_cos",
    "weekend",
    "prefix_fraction",
    "prefix_last_latitude",
    "prefix_last_longitude",
    "prefix_displacement_km",
    "prefix_path_km",
    "prefix_bearing_sin",
    "prefix_bearing_cos",
)
_HISTORY_FEATURES = (
    "history_count",
    "last_destination_latitude",
    "last_destination_longitude",
    "mean_destination_latitude",
    "mean_destination_longitude",
)


@register("feature_audit", "samples", " UNION ALL ".join(
    f"SELECT sample_id, '{c}' AS feature, round({c},9)+0.0::DOUBLE AS value, '{source}' AS source FROM samples"
    for names, source in ((_OWN_FEATURES, "reference_trip"), (_HISTORY_FEATURES, "automatic_previous_trips")) for c in names))
def _(spark, sf):
    sources = F.struct(
        F.lit("reference_trip").alias("departure_time"), F.lit("reference_trip").alias("origin"),
        F.lit("reference_trip").alias("trajectory_prefix"), F.lit("automatic_previous_trips").alias("history"),
    )
    return report.feature_audit(run(spark, sf).samples, sources).withColumn("value", F.round("value", 9))


def _split_trips(spark, sf):
    from tripweave.operators.split import attach_split

    r = run(spark, sf)
    return attach_split(r.trips, "VIN", r.manifest)


@register("coverage_routes", "accepted manifest points", """SELECT a.trip_id, 'vehicle-' || left(sha256(a.vin),10) AS vehicle_id, split,
  CASE split WHEN 'train' THEN 'Training' WHEN 'validation' THEN 'Validation' ELSE 'Final test' END AS split_label,
  a.s_us AS start_us, CAST(a.n AS INT) AS point_count, p.path FROM accepted a JOIN manifest USING (vin)
  JOIN (SELECT trip_id, string_agg(printf('%.6f %.6f', lon, lat), ';' ORDER BY idx) AS path FROM points GROUP BY trip_id) p ON p.trip_id=a.trip_id""")
def _(spark, sf):
    r = maps.trip_routes(_split_trips(spark, sf))
    path = F.transform("path", lambda p: F.format_string("%.6f %.6f", F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    return r.select(
        "trip_id", "vehicle_id", "split", "split_label", us("start_time").alias("start_us"), "point_count",
        F.array_join(path, ";").alias("path"),
    )


@register("coverage_counts", "accepted manifest", """SELECT s.split, label, count(a.trip_id) AS trip_count, count(DISTINCT a.vin) AS vehicle_count
  FROM (VALUES ('train','Training'),('validation','Validation'),('test','Final test')) s(split,label)
  LEFT JOIN (SELECT trip_id, vin, split FROM accepted JOIN manifest USING (vin)) a ON a.split=s.split GROUP BY 1,2
  UNION ALL SELECT 'total', 'Total', count(*), count(DISTINCT vin) FROM accepted""")
def _(spark, sf):
    return maps.coverage_counts(_split_trips(spark, sf))


@register("map_bounds", "points", """SELECT round(min(lat),6) AS south, round(min(lon),6) AS west, round(max(lat),6) AS north, round(max(lon),6) AS east FROM points""")
def _(spark, sf):
    return _six(maps.map_bounds(run(spark, sf).trips))


def _layers(spark, sf):
    r = run(spark, sf)
    paths = r.samples.select("sample_id", "trajectory", "trajectory_prefix")
    return maps.prediction_layers(r.predictions.join(paths, "sample_id"), SIZE)


@register("map_layers", "predictions", """SELECT sample_id, n AS trajectory_points, cnt AS prefix_points, 'origin;actual;refined' AS kinds,
  printf('Refined prediction (%.2f km error)', error_km) AS refined_label,
  round((origin_latitude+actual_latitude+predicted_latitude)/3,6) AS center_lat, round((origin_longitude+actual_longitude+predicted_longitude)/3,6) AS center_lon,
  round(predicted_longitude,6) AS refined_line_lon FROM predictions""")
def _(spark, sf):
    d = _layers(spark, sf)
    line = F.get(F.get("lines", F.lit(1))["path"], F.lit(1))
    return d.select(
        "sample_id", F.size("trajectory").cast("bigint").alias("trajectory_points"), F.size("prefix").cast("bigint").alias("prefix_points"),
        F.array_join(F.transform("points", lambda p: p["kind"]), ";").alias("kinds"),
        F.get("points", F.lit(2))["label"].alias("refined_label"),
        F.round("center.latitude", 6).alias("center_lat"), F.round("center.longitude", 6).alias("center_lon"),
        F.round(F.get(line, F.lit(0)), 6).alias("refined_line_lon"),
    )


@register("map_candidates", "top", f"""SELECT sample_id, CAST(rk AS INT) AS rank, round({hav('clat', 'clon', 'actual_latitude', 'actual_longitude', R_KM)},6) AS error_km,
  round(clon-0.005::DOUBLE,6) AS west, round(clat+0.005::DOUBLE,6) AS north FROM top""")
def _(spark, sf):
    c = _layers(spark, sf).select("sample_id", F.explode("candidates").alias("c"))
    ring = F.col("c.polygon")
    return c.select(
        "sample_id", F.col("c.rank").alias("rank"), F.round("c.error_to_actual_km", 6).alias("error_km"),
        F.round(F.get(F.get(ring, F.lit(0)), F.lit(0)), 6).alias("west"), F.round(F.get(F.get(ring, F.lit(2)), F.lit(1)), 6).alias("north"),
    )


@register("prefix_text", "accepted", """SELECT trip_id, CASE WHEN s_us % 5 = 1 THEN 'Custom prefix is not valid JSON'
  WHEN s_us % 5 = 2 THEN 'Custom prefix must be a non-empty JSON array of [lat, lon]' WHEN s_us % 5 = 3 THEN 'Prefix point 2 is outside valid coordinate bounds'
  WHEN s_us % 5 = 4 THEN 'Prefix point 1 must be [latitude, longitude]' END AS error, CASE WHEN s_us % 5 = 0 THEN CAST(n AS INT) END AS points FROM accepted""")
def _(spark, sf):
    t = run(spark, sf).trips
    k = F.pmod(us("StartTrip"), F.lit(5))
    whole = maps.prefix_text(F.col("Trajectory"))
    text = (
        F.when(k == 1, "[[1,").when(k == 2, "[]").when(k == 3, "[[1.5,2],[91,2]]").when(k == 4, '{"points":[[48.1]]}').otherwise(whole)
    )
    parsed = maps.parse_prefix_text(text)
    return t.select("trip_id", parsed["error"].alias("error"), F.size(parsed["points"]).alias("points"))


@register("preview", "accepted", """SELECT trip_id, vin, round(dist/1000,3) AS distance_km FROM (SELECT * FROM accepted ORDER BY accepted.trip_id LIMIT 50)""")
def _(spark, sf):
    p = preview(run(spark, sf).trips, ["trip_id", "VIN", "distance_km"], 50, "trip_id")
    return p.select("trip_id", F.col("VIN").alias("vin"), F.round("distance_km", 3).alias("distance_km"))


@register("source_files")
def _(spark, sf):
    return file_fingerprints(spark, f"{sf}/events.parquet")


@register("content_fingerprint")
def _(spark, sf):
    return content_fingerprint(telemetry(spark, sf))
