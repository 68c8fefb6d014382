"""Queries over geography, samples, split and tensors (G, F ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripweave.functions import geo, paths
from tripweave.functions.features import calendar_features
from tripweave.operators import samples as S
from tripweave.operators import tensors as X
from tripweave.schema import FEATURES

from .oracle import R_KM, bearing, cell, hav
from .queries import SAMPLES, joined, register, run, us


def _digits(name: str) -> int:
    # A mean of few values can tie at the sixth decimal.
    return 9 if name.startswith("mean_") else 6


def rounded(*names: str):
    return [F.round(n, _digits(n)).alias(n) for n in names]


def sql_rounded(*names: str) -> str:
    # Adding zero turns a rounded -0.0 into 0.0, which is what Spark's round gives.
    return ", ".join(f"round({n},{_digits(n)})+0.0::DOUBLE AS {n}" for n in names)


def places(spark, sf):
    """Two coordinates per event."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        "event_id",
        (48 + F.col("value") / 1000).alias("a_lat"),
        (2 + k / 1000).alias("a_lon"),
        (F.col("event_id") % 170 - 85).cast("double").alias("b_lat"),
        (F.col("event_id") % 350 - 175).cast("double").alias("b_lon"),
        (F.col("value") - 50).alias("any_lat"),
        (F.col("value") * 2 - 200).alias("any_lon"),
    )


PLACES = """places AS (SELECT event_id, 48 + value/1000 AS a_lat, 2 + CAST(json_extract(props,'$.k') AS INT)/1000 AS a_lon,
  CAST(event_id % 170 - 85 AS DOUBLE) AS b_lat, CAST(event_id % 350 - 175 AS DOUBLE) AS b_lon,
  value - 50 AS any_lat, value*2 - 200 AS any_lon FROM events)"""


def geo_query(name: str, final: str):
    from .queries import ORACLES

    def wrap(fn):
        register(name)(fn)
        ORACLES[name] = f"WITH {PLACES} {final}"
        return fn

    return wrap


def ab():
    return [F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")]


@geo_query("haversine", f"SELECT event_id, round({hav('a_lat', 'a_lon', 'b_lat', 'b_lon')},3) AS metres, "
           f"round({hav('a_lat', 'a_lon', 'b_lat', 'b_lon', R_KM)},6) AS km FROM places")
def _(spark, sf):
    return places(spark, sf).select(
        "event_id", F.round(geo.haversine_m(*ab()), 3).alias("metres"), F.round(geo.haversine_km(*ab()), 6).alias("km")
    )


@geo_query("bearing", f"SELECT event_id, round({bearing('a_lat', 'a_lon', 'b_lat', 'b_lon')},6) AS degrees FROM places")
def _(spark, sf):
    return places(spark, sf).select("event_id", F.round(geo.bearing_degrees(*ab()), 6).alias("degrees"))


@geo_query("grid_encode", f"""SELECT event_id, {cell('a_lat', 'a_lon')} AS cell_a, {cell('b_lat', 'b_lon')} AS cell_b FROM places""")
def _(spark, sf):
    size = SAMPLES.grid_cell_degrees
    return places(spark, sf).select(
        "event_id", geo.grid_cell(*ab()[:2], size).alias("cell_a"), geo.grid_cell(*ab()[2:], size).alias("cell_b")
    )


_ROW = "floor((a_lat+90.0::DOUBLE)/0.01::DOUBLE)"
_COL = "floor((a_lon+180.0::DOUBLE)/0.01::DOUBLE)"


@geo_query("grid_decode", f"""SELECT event_id, round({_ROW}*0.01::DOUBLE-90.0::DOUBLE+0.005::DOUBLE,6) AS lat,
  round({_COL}*0.01::DOUBLE-180.0::DOUBLE+0.005::DOUBLE,6) AS lon FROM places""")
def _(spark, sf):
    size = SAMPLES.grid_cell_degrees
    c = geo.grid_centre(geo.grid_cell(*ab()[:2], size), size)
    return places(spark, sf).select("event_id", F.round(c["latitude"], 6).alias("lat"), F.round(c["longitude"], 6).alias("lon"))


@geo_query("grid_polygon", f"""SELECT event_id, i, round({_COL}*0.01::DOUBLE-180.0::DOUBLE + CASE WHEN i IN (1,2) THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END,6) AS lon,
  round({_ROW}*0.01::DOUBLE-90.0::DOUBLE + CASE WHEN i IN (2,3) THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END,6) AS lat
  FROM places CROSS JOIN (SELECT CAST(range AS INT) AS i FROM range(5))""")
def _(spark, sf):
    size = SAMPLES.grid_cell_degrees
    ring = geo.grid_polygon(geo.grid_cell(*ab()[:2], size), size)
    return places(spark, sf).select("event_id", F.posexplode(ring).alias("i", "p")).select(
        "event_id", "i", F.round(F.get("p", F.lit(0)), 6).alias("lon"), F.round(F.get("p", F.lit(1)), 6).alias("lat")
    )


@geo_query("coordinate_validity", """SELECT event_id, any_lat BETWEEN -90 AND 90 AND any_lon BETWEEN -180 AND 180 AS ok FROM places""")
def _(spark, sf):
    return places(spark, sf).select("event_id", geo.in_bounds(F.col("any_lat"), F.col("any_lon")).alias("ok"))


@register("path_length", "points", "SELECT trip_id, round(sum(step)/1000,6) AS path_km FROM points GROUP BY trip_id")
def _(spark, sf):
    return run(spark, sf).trips.select("trip_id", F.round(paths.path_km(F.col("Trajectory")), 6).alias("path_km"))


@register("geographic_error", "predictions", "SELECT sample_id, round(error_km,6) AS error_km FROM predictions")
def _(spark, sf):
    bare = run(spark, sf).predictions.drop("error_km")
    return geo.with_error_km(bare).select("sample_id", F.round("error_km", 6).alias("error_km"))


@register("trajectory_parse", "points", """SELECT trip_id, count(*) AS points, round(min(lat),6) AS south, round(max(lon),6) AS east
  FROM points GROUP BY trip_id""")
def _(spark, sf):
    t = run(spark, sf).trips
    as_text = t.withColumn(
        "Trajectory", F.to_json(F.transform("Trajectory", lambda p: F.array(p["latitude"], p["longitude"])))
    )
    return S.normalised_trips(as_text).select(
        "trip_id",
        F.size("trajectory").cast("bigint").alias("points"),
        F.round(F.array_min(F.transform("trajectory", lambda p: p["latitude"])), 6).alias("south"),
        F.round(F.array_max(F.transform("trajectory", lambda p: p["longitude"])), 6).alias("east"),
    )


@register("split", "manifest", "SELECT vin, split FROM manifest")
def _(spark, sf):
    return run(spark, sf).manifest.select("vin", "split")


@register("split_lookup", "accepted manifest", "SELECT trip_id, split FROM accepted JOIN manifest USING (vin)")
def _(spark, sf):
    from tripweave.operators.split import attach_split

    r = run(spark, sf)
    return attach_split(r.trips.select("trip_id", "VIN"), "VIN", r.manifest).select("trip_id", "split")


@register("pseudonyms", "accepted", "SELECT DISTINCT vin, 'vehicle-' || left(sha256(vin),10) AS vehicle_id FROM accepted")
def _(spark, sf):
    return run(spark, sf).trips.select(F.col("VIN").alias("vin")).distinct().withColumn("vehicle_id", S.pseudonym(F.col("vin")))


@register("prefix", "expanded seen", """SELECT x.trip_id || printf('@%.3f', x.f) AS sample_id, x.cnt AS seen, x.n AS points,
  round(plat,6) AS last_lat, round(plon,6) AS last_lon FROM expanded x JOIN seen s ON s.trip_id=x.trip_id AND s.f=x.f""")
def _(spark, sf):
    last = paths.last_of(F.col("trajectory_prefix"))
    return run(spark, sf).samples.select(
        "sample_id", F.size("trajectory_prefix").cast("bigint").alias("seen"), F.size("trajectory").cast("bigint").alias("points"),
        F.round(last["latitude"], 6).alias("last_lat"), F.round(last["longitude"], 6).alias("last_lon"),
    )


@register("history", "accepted", """SELECT a.trip_id, coalesce(string_agg(printf('%.6f,%.6f,%.3f', b.elat, b.elon, b.e_us/1e6), ';' ORDER BY b.s_us),'') AS history
  FROM accepted a LEFT JOIN accepted b ON b.vin=a.vin AND b.ordinal BETWEEN a.ordinal-20 AND a.ordinal-1 GROUP BY a.trip_id""")
def _(spark, sf):
    from tripweave.config import SpreadSettings
    from tripweave.functions.rounding import round_exact

    spread = SpreadSettings()
    h = S.with_history(S.numbered_trips(S.normalised_trips(run(spark, sf).trips), spread), 20, spread)
    text = F.transform("history", lambda x: F.format_string("%.6f,%.6f,%.3f", x["latitude"], x["longitude"], round_exact(x["completed_at"], 3)))
    return h.select("trip_id", joined(text).alias("history"))


@register("overlap_guard", "accepted", """SELECT count(*) FILTER (prior >= s_us) AS overlaps FROM
  (SELECT s_us, lag(e_us) OVER (PARTITION BY vin ORDER BY s_us) AS prior FROM accepted)""")
def _(spark, sf):
    return S.overlap_count(run(spark, sf).trips)


_CAL = ("hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "month_sin", "month_cos", "weekend")


@register("calendar", "samples", f"SELECT trip_id, {sql_rounded(*_CAL)} FROM samples WHERE prefix_fraction=0")
def _(spark, sf):
    c = calendar_features(F.col("StartTrip"))
    return run(spark, sf).trips.select("trip_id", *[F.round(c[n], 6).alias(n) for n in _CAL])


@register("samples", "samples", f"""SELECT sample_id, vin, vehicle_id, trip_id, s_us AS start_us, e_us AS end_us, split, round(actual_latitude,6) AS actual_latitude,
  round(actual_longitude,6) AS actual_longitude, actual_cell, {sql_rounded(*FEATURES)} FROM samples""")
def _(spark, sf):
    return run(spark, sf).samples.select(
        "sample_id", F.col("VIN").alias("vin"), "vehicle_id", "trip_id", us("StartTrip").alias("start_us"),
        us("EndTrip").alias("end_us"), "split", *rounded("actual_latitude", "actual_longitude"), "actual_cell", *rounded(*FEATURES),
    )


@register("feature_matrix", "samples", "SELECT sample_id, 21 AS width, round(CAST(CAST(origin_latitude AS FLOAT) AS DOUBLE),6) AS first_value FROM samples")
def _(spark, sf):
    m = S.checked_features(run(spark, sf).samples)
    return m.select(
        "sample_id", F.size("features_array").alias("width"),
        F.round(F.get("features_array", F.lit(0)).cast("double"), 6).alias("first_value"),
    )


@register("targets", "samples", "SELECT sample_id, round(actual_latitude,6) AS lat, round(actual_longitude,6) AS lon FROM samples")
def _(spark, sf):
    t = S.checked_targets(run(spark, sf).samples)
    return t.select("sample_id", F.round(F.get("target", F.lit(0)), 6).alias("lat"), F.round(F.get("target", F.lit(1)), 6).alias("lon"))


_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}),6)+0.0::DOUBLE AS mean, round(CASE WHEN stddev_pop({c}) < 1e-8 THEN 1.0::DOUBLE ELSE stddev_pop({c}) END,6) AS scale FROM samples WHERE split='train'"
    for c in FEATURES
)


@register("standardise", "samples", _STATS)
def _(spark, sf):
    return X.context_statistics(run(spark, sf).samples).select("feature", *rounded("mean", "scale"))


@register("vocabulary", "samples", """SELECT cell, CAST(row_number() OVER (ORDER BY cell)-1 AS INT) AS label FROM
  (SELECT DISTINCT actual_cell AS cell FROM samples WHERE split='train')""")
def _(spark, sf):
    return X.vocabulary(run(spark, sf).samples)


@register("labels", "samples", """SELECT sample_id, CAST(coalesce(label,0) AS INT) AS label, CASE WHEN label IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label_weight
  FROM samples LEFT JOIN (SELECT cell, row_number() OVER (ORDER BY cell)-1 AS label FROM
  (SELECT DISTINCT actual_cell AS cell FROM samples WHERE split='train')) v ON v.cell=actual_cell""")
def _(spark, sf):
    s = run(spark, sf).samples
    return X.labelled(s, X.vocabulary(s)).select("sample_id", "label", "label_weight")


def _cells_of(df, column, most):
    """Tensor column to rows (sample_id, position, part, value)."""
    return df.select("sample_id", F.posexplode(column).alias("position", "row")).select(
        "sample_id", "position", F.posexplode("row").alias("part", "v")
    ).select("sample_id", "position", "part", F.round("v", 6).alias("value"))


_POINTS = SAMPLES.max_trajectory_points


@register("trajectory_tensor", "expanded points", f"""SELECT sample_id, position, part, round(value,6)+0.0::DOUBLE AS value FROM (
  SELECT x.trip_id || printf('@%.3f', x.f) AS sample_id, CAST(g.i AS INT) AS position, part,
   CASE WHEN g.i >= x.kept THEN 0.0::DOUBLE ELSE CASE part WHEN 0 THEN (p.lat-o.lat)*100 WHEN 1 THEN (p.lon-o.lon)*100
    WHEN 2 THEN CASE WHEN g.i=0 THEN 0.0::DOUBLE ELSE p.step/1000 END
    WHEN 3 THEN CASE WHEN g.i=0 THEN 0.0::DOUBLE ELSE sin(radians({bearing('q.lat', 'q.lon', 'p.lat', 'p.lon')})) END
    WHEN 4 THEN CASE WHEN g.i=0 THEN 1.0::DOUBLE ELSE cos(radians({bearing('q.lat', 'q.lon', 'p.lat', 'p.lon')})) END
    ELSE (g.i+1)/x.kept END END AS value
  FROM (SELECT *, least(cnt, {_POINTS}) AS kept, greatest(cnt - {_POINTS}, 0) AS skipped FROM expanded) x
  CROSS JOIN range({_POINTS}) g(i) CROSS JOIN (SELECT CAST(range AS INT) AS part FROM range(6)) d
  LEFT JOIN points p ON p.trip_id=x.trip_id AND p.idx=g.i+x.skipped LEFT JOIN points q ON q.trip_id=x.trip_id AND q.idx=g.i+x.skipped-1
  LEFT JOIN points o ON o.trip_id=x.trip_id AND o.idx=x.skipped)""")
def _(spark, sf):
    s = run(spark, sf).samples
    return _cells_of(s, X.trajectory_tensor(F.col("trajectory_prefix"), _POINTS), _POINTS)


@register("history_tensor", "samples accepted", """SELECT sample_id, position, part, round(coalesce(value, 0.0::DOUBLE),6)+0.0::DOUBLE AS value FROM (
  SELECT s.sample_id, CAST(g.i AS INT) AS position, part, CASE WHEN b.s_us IS NULL THEN 0.0::DOUBLE ELSE CASE part WHEN 0 THEN (b.elat-s.origin_latitude)*100 WHEN 1 THEN (b.elon-s.origin_longitude)*100
   WHEN 2 THEN ln(1+greatest(0.0::DOUBLE, (s.s_us/1e6-b.e_us/1e6)/86400)) ELSE (g.i-20+least(s.ordinal-1,20)+1)/least(s.ordinal-1,20) END END AS value
  FROM samples s CROSS JOIN range(20) g(i) CROSS JOIN (SELECT CAST(range AS INT) AS part FROM range(4)) d
  LEFT JOIN accepted b ON b.vin=s.vin AND b.ordinal=s.ordinal-20+g.i)""")
def _(spark, sf):
    s = run(spark, sf).samples
    t = X.history_tensor(F.col("history_sequence"), F.col("origin_latitude"), F.col("origin_longitude"), F.col("StartTrip"), 20)
    return _cells_of(s, t, 20)


@register("model_arrays", "samples", """SELECT sample_id, split, 100 AS points, 20 AS history, 21 AS context,
  round((actual_latitude-origin_latitude)*100,6)+0.0::DOUBLE AS dlat, round((actual_longitude-origin_longitude)*100,6)+0.0::DOUBLE AS dlon FROM samples""")
def _(spark, sf):
    m = X.model_arrays(run(spark, sf).samples, SAMPLES)
    return m.select(
        "sample_id", "split", F.size("trajectory").alias("points"), F.size("history").alias("history"), F.size("context").alias("context"),
        F.round(F.get("coordinate", F.lit(0)), 6).alias("dlat"), F.round(F.get("coordinate", F.lit(1)), 6).alias("dlon"),
    )
