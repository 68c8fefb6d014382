"""DuckDB SQL for the registered queries, as a chain of named steps.

``sql("trips", "SELECT ...")`` yields the steps ``trips`` needs and the final select.
windows and range joins where the Spark side uses buckets, carries and arrays.
"""

from __future__ import annotations

from .telemetry import SETTINGS as D
from .telemetry import TELEMETRY_SQL

R_M, R_KM = 6371008.8, 6371.0088
# What a rejection says, by reason.
DETAILS = {
    "missing_end_trigger": "No end trigger before the next journey start",
    "missing_start_coordinate": "Start trigger lacks latitude or longitude",
    "missing_end_coordinate": "End trigger lacks latitude or longitude",
    "invalid_trigger_coordinate": "Start or end coordinate is outside geographic bounds",
    "missing_trajectory": "No usable periodic trajectory array",
    "invalid_trajectory_coordinate": "Trajectory contains latitude/longitude outside geographic bounds",
    "unmatched_end_trigger": "End trigger has no preceding unmatched start trigger",
}


def hav(a: str, b: str, c: str, d: str, radius: float = R_M) -> str:
    return (
        f"(CASE WHEN {a} IS NOT NULL AND {c} IS NOT NULL THEN {2 * radius}::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians({c})-radians({a}))/2),2)"
        f" + cos(radians({a}))*cos(radians({c}))*pow(sin((radians({d})-radians({b}))/2),2)))) END)"
    )


def bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d})-radians({b}))*cos(radians({c}))"
    x = (
        f"cos(radians({a}))*sin(radians({c})) - sin(radians({a}))*cos(radians({c}))"
        f"*cos(radians({d})-radians({b}))"
    )
    return f"((degrees(atan2({y}, {x})) + 360.0) % 360.0)"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def cell(lat: str, lon: str) -> str:
    return (
        f"'g' || CAST(CAST(floor(({lat}+90.0::DOUBLE)/0.01::DOUBLE) AS BIGINT) AS VARCHAR) || ':' || "
        f"CAST(CAST(floor(({lon}+180.0::DOUBLE)/0.01::DOUBLE) AS BIGINT) AS VARCHAR)"
    )


_numbers = "TRY(CAST(json_extract_string(series, '$[*]') AS DOUBLE[]))"

STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def step(name: str, needs: str, body: str) -> None:
    STEPS[name] = (tuple(needs.split()), f"{name} AS ({body})")


STEPS["telemetry"] = ((), TELEMETRY_SQL)

step(
    "canon",
    "telemetry",
    f"""SELECT row_id, {strip('vin')} AS vin, {strip('trig')} AS trig, {strip('name')} AS signal,
    TRY_CAST(scalar_text AS DOUBLE) AS scalar, nullif({strip('series_text')}, '') AS series,
    epoch_us(try_strptime(time_text, '%Y-%m-%dT%H:%M:%S.%fZ')) AS ts, fuel, model FROM telemetry""",
)
step(
    "early",
    "canon",
    """SELECT *, CASE WHEN coalesce(vin,'')='' THEN 'missing_vin'
    WHEN coalesce(trig,'')='' THEN 'missing_trigger' WHEN coalesce(signal,'')='' THEN 'missing_signal'
    WHEN ts IS NULL THEN 'invalid_timestamp' END AS r1 FROM canon""",
)
step(
    "ranked",
    "early",
    """SELECT *, CASE WHEN r1 IS NULL THEN row_number() OVER (
      PARTITION BY r1 IS NULL, vin, trig, signal, scalar, series, ts, fuel, model ORDER BY row_id) END AS copy_no,
    CASE WHEN json_valid(series) THEN TRY(CAST(json_extract_string(series, '$[*]') AS DOUBLE[])) END AS nums
    FROM early""",
)
step(
    "judged",
    "ranked",
    f"""SELECT *, CASE WHEN r1 IS NOT NULL THEN r1 WHEN copy_no > 1 THEN 'exact_duplicate'
    WHEN trig NOT IN ('{D.start_trigger}','{D.end_trigger}','{D.periodic_trigger}')
      OR signal NOT IN ('{D.latitude_signal}','{D.longitude_signal}','{D.altitude_signal}')
      THEN 'irrelevant_trigger_or_signal'
    WHEN trig <> '{D.periodic_trigger}' AND scalar IS NULL THEN 'invalid_scalar_value'
    WHEN trig = '{D.periodic_trigger}' AND series IS NULL THEN 'missing_series_value'
    WHEN trig = '{D.periodic_trigger}' AND (nums IS NULL OR len(nums) = 0
      OR len([x FOR x IN nums IF x IS NULL OR NOT isfinite(x)]) > 0) THEN 'invalid_series_value'
    END AS reason FROM ranked""",
)
step("cleaned", "judged", "SELECT * FROM judged WHERE reason IS NULL")
step(
    "trigger_events",
    "cleaned",
    f"""SELECT vin, ts, CASE WHEN trig='{D.start_trigger}' THEN 0 ELSE 2 END AS kind,
    arg_max(scalar, row_id) FILTER (signal='{D.latitude_signal}') AS lat,
    arg_max(scalar, row_id) FILTER (signal='{D.longitude_signal}') AS lon,
    arg_max(scalar, row_id) FILTER (signal='{D.altitude_signal}') AS alt,
    max(row_id) FILTER (signal='{D.latitude_signal}') AS lat_row,
    max(row_id) FILTER (signal='{D.longitude_signal}') AS lon_row,
    max(row_id) FILTER (signal='{D.altitude_signal}') AS alt_row,
    CASE WHEN count(*) FILTER (signal='{D.latitude_signal}') > 1 THEN '{D.latitude_signal}' END AS dup
    FROM cleaned WHERE trig <> '{D.periodic_trigger}' GROUP BY ALL""",
)
step(
    "batches",
    "cleaned",
    f"""SELECT *, CASE WHEN lats IS NULL OR lons IS NULL THEN 'trajectory batch lacks latitude or longitude array'
      WHEN len(lats) <> len(lons) OR len(alts) <> len(lats) THEN 'unaligned trajectory array lengths: [' ||
        concat_ws(', ', len(lats), len(lons), len(alts)) || ']' END AS error
    FROM (SELECT vin, ts, arg_max(nums, row_id) FILTER (signal='{D.latitude_signal}') AS lats,
      arg_max(nums, row_id) FILTER (signal='{D.longitude_signal}') AS lons,
      arg_max(nums, row_id) FILTER (signal='{D.altitude_signal}') AS alts,
      max(row_id) FILTER (signal='{D.latitude_signal}') AS lat_row,
      max(row_id) FILTER (signal='{D.longitude_signal}') AS lon_row,
      max(row_id) FILTER (signal='{D.altitude_signal}') AS alt_row
      FROM cleaned WHERE trig = '{D.periodic_trigger}' GROUP BY vin, ts)""",
)
step(
    "starts",
    "trigger_events",
    "SELECT *, lead(ts) OVER (PARTITION BY vin ORDER BY ts) AS next_start FROM trigger_events WHERE kind=0",
)
step("ends", "trigger_events", "SELECT * FROM trigger_events WHERE kind=2")
step(
    "paired",
    "starts ends",
    """SELECT s.vin, s.ts AS s_us, min(e.ts) AS e_us FROM starts s LEFT JOIN ends e
    ON e.vin=s.vin AND e.ts >= s.ts AND (s.next_start IS NULL OR e.ts < s.next_start) GROUP BY s.vin, s.ts""",
)
step(
    "stray",
    "paired ends",
    """SELECT e.vin, e.ts AS e_us FROM ends e WHERE NOT EXISTS
    (SELECT 1 FROM paired p WHERE p.vin=e.vin AND p.e_us=e.ts)""",
)
step(
    "trip_ends",
    "paired starts ends",
    """SELECT p.vin, p.s_us, p.e_us, s.lat AS slat, s.lon AS slon, s.alt AS salt, e.lat AS elat, e.lon AS elon,
    e.alt AS ealt, s.dup AS sdup, e.dup AS edup, (p.e_us-p.s_us)/1e6 AS dur,
    s.lat_row AS s1, s.lon_row AS s2, s.alt_row AS s3, e.lat_row AS e1, e.lon_row AS e2, e.alt_row AS e3
    FROM paired p JOIN starts s ON s.vin=p.vin AND s.ts=p.s_us JOIN ends e ON e.vin=p.vin AND e.ts=p.e_us""",
)
step(
    "trip_batches",
    "paired batches",
    """SELECT p.s_us, p.e_us, b.* FROM paired p JOIN batches b
    ON b.vin=p.vin AND b.ts >= p.s_us AND b.ts <= p.e_us""",
)
step(
    "trip_errors",
    "trip_batches",
    """SELECT vin, s_us, string_agg(error, '; ' ORDER BY ts) AS errors FROM trip_batches
    WHERE error IS NOT NULL GROUP BY vin, s_us""",
)
step(
    "raw_points",
    "trip_batches",
    """SELECT vin, s_us, ts, i, lats[i] AS lat, lons[i] AS lon, alts[i] AS alt
    FROM (SELECT *, unnest(range(1, len(lats)+1)) AS i FROM trip_batches WHERE error IS NULL)""",
)
step(
    "stepped",
    "raw_points",
    """SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM raw_points
    WINDOW w AS (PARTITION BY vin, s_us ORDER BY ts, i)""",
)
step(
    "kept",
    "stepped",
    f"SELECT * FROM stepped WHERE plat IS NULL OR {hav('plat', 'plon', 'lat', 'lon')} >= 0.01",
)
step(
    "edges",
    "kept",
    """SELECT vin, s_us, arg_min(lat, (ts,i)) AS alat, arg_min(lon, (ts,i)) AS alon,
    arg_max(lat, (ts,i)) AS zlat, arg_max(lon, (ts,i)) AS zlon,
    bool_or(NOT (abs(lat) <= 90 AND abs(lon) <= 180)) AS bad FROM kept GROUP BY vin, s_us""",
)
step(
    "cand",
    "trip_ends trip_errors edges",
    f"""SELECT t.*, r.errors, g.alat, g.bad, g.alat IS NULL AS fell,
    CASE WHEN g.alat IS NOT NULL AND {hav('t.slat', 't.slon', 'g.alat', 'g.alon')} > 30 THEN 1 ELSE 0 END AS add_s,
    CASE WHEN g.alat IS NOT NULL AND {hav('g.zlat', 'g.zlon', 't.elat', 't.elon')} > 30 THEN 1 ELSE 0 END AS add_e
    FROM trip_ends t LEFT JOIN trip_errors r USING (vin, s_us) LEFT JOIN edges g USING (vin, s_us)""",
)
step(
    "all_points",
    "cand kept",
    """SELECT c.vin, c.s_us, 0 AS part, 0 AS ts, 0 AS i, slat AS lat, slon AS lon, salt AS alt FROM cand c WHERE fell OR add_s=1
    UNION ALL SELECT vin, s_us, 1, ts, i, lat, lon, alt FROM kept
    UNION ALL SELECT c.vin, c.s_us, 2, 0, 0, elat, elon, ealt FROM cand c WHERE fell OR add_e=1""",
)
step(
    "seg",
    "all_points",
    f"""SELECT *, coalesce({hav('plat', 'plon', 'lat', 'lon')}, 0.0::DOUBLE) AS step FROM (
      SELECT *, row_number() OVER w - 1 AS idx, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM all_points
      WINDOW w AS (PARTITION BY vin, s_us ORDER BY part, ts, i))""",
)
step(
    "figures",
    "seg cand",
    """SELECT c.*, f.n, f.dist, CASE WHEN c.dur > 0 THEN f.longest / (c.dur/(f.n-1)) * 3.6 ELSE 0.0 END AS vmax FROM cand c JOIN (
      SELECT vin, s_us, count(*) AS n, sum(step) AS dist, max(step) AS longest FROM seg GROUP BY vin, s_us) f USING (vin, s_us)""",
)
step(
    "failed",
    "figures",
    f"""SELECT *, CASE
    WHEN slat IS NULL OR slon IS NULL THEN 'missing_start_coordinate'
    WHEN elat IS NULL OR elon IS NULL THEN 'missing_end_coordinate'
    WHEN NOT (abs(slat)<=90 AND abs(slon)<=180 AND abs(elat)<=90 AND abs(elon)<=180) THEN 'invalid_trigger_coordinate'
    WHEN errors IS NOT NULL THEN 'invalid_trajectory_array'
    WHEN bad THEN 'invalid_trajectory_coordinate' WHEN dur <= 0 THEN 'non_positive_duration' END AS failure
    FROM figures""",
)
step(
    "rejected",
    "failed paired stray",
    f"""SELECT vin, s_us, e_us, failure AS reason, CASE failure
      WHEN 'invalid_trajectory_array' THEN errors
      {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in DETAILS.items())} END AS detail FROM failed WHERE failure IS NOT NULL
    UNION ALL SELECT vin, s_us, NULL, 'missing_end_trigger', '{DETAILS['missing_end_trigger']}' FROM paired WHERE e_us IS NULL
    UNION ALL SELECT vin, NULL, e_us, 'unmatched_end_trigger', '{DETAILS['unmatched_end_trigger']}' FROM stray
    UNION ALL SELECT vin, s_us, e_us, 'duration_too_short', printf('duration_s=%.3f', dur) FROM failed WHERE failure IS NULL AND dur < 1
    UNION ALL SELECT vin, s_us, e_us, 'duration_too_long', printf('duration_s=%.3f', dur) FROM failed WHERE failure IS NULL AND dur > 86400
    UNION ALL SELECT vin, s_us, e_us, 'distance_too_long', printf('distance_m=%.3f', dist) FROM failed WHERE failure IS NULL AND dist > 1000000
    UNION ALL SELECT vin, s_us, e_us, 'implausible_segment_speed', printf('max_segment_speed_kmh=%.3f', vmax) FROM failed WHERE failure IS NULL AND vmax > 250""",
)
step(
    "metadata",
    "cleaned",
    """SELECT vin, arg_min(fuel, (ts, trig, signal, row_id)) AS fuel, arg_min(model, (ts, trig, signal, row_id)) AS model,
    count(DISTINCT fuel) > 1 AS mixed_fuel, count(DISTINCT model) > 1 AS mixed_model FROM cleaned GROUP BY vin""",
)
step(
    "accepted",
    "failed rejected metadata",
    f"""SELECT f.*, m.fuel, m.model, f.vin || '_' || strftime(make_timestamp(f.s_us), '%Y%m%dT%H%M%SZ') || '_' ||
      lpad(CAST(row_number() OVER (PARTITION BY f.vin ORDER BY f.s_us) AS VARCHAR), 4, '0') AS trip_id,
    row_number() OVER (PARTITION BY f.vin ORDER BY f.s_us) AS ordinal,
    {hav('slat', 'slon', 'elat', 'elon')} AS straight,
    concat_ws(';', CASE WHEN edup IS NOT NULL THEN 'duplicate_end_signal:'||edup END,
      CASE WHEN sdup IS NOT NULL THEN 'duplicate_start_signal:'||sdup END,
      CASE WHEN add_e=1 THEN 'end_trigger_point_added' END,
      CASE WHEN mixed_fuel THEN 'inconsistent_metadata:fuel' END,
      CASE WHEN mixed_model THEN 'inconsistent_metadata:model' END,
      CASE WHEN add_s=1 THEN 'start_trigger_point_added' END,
      CASE WHEN fell THEN 'trajectory_fallback_to_trigger_endpoints' END) AS flags
    FROM failed f JOIN metadata m USING (vin)
    WHERE NOT EXISTS (SELECT 1 FROM rejected r WHERE r.vin=f.vin AND r.s_us=f.s_us)""",
)
step(
    "points",
    "accepted seg",
    """SELECT a.trip_id, a.vin, s.idx, a.s_us, a.n, a.dur, ((a.e_us-a.s_us)*s.idx)//(a.n-1) AS off_us, s.lat, s.lon, s.alt,
    s.step, sum(s.step) OVER (PARTITION BY a.trip_id ORDER BY s.idx ROWS UNBOUNDED PRECEDING) AS walked
    FROM accepted a JOIN seg s ON s.vin=a.vin AND s.s_us=a.s_us""",
)
step(
    "usage",
    "accepted trip_batches",
    """SELECT unnest([s1,s2,s3]) AS row_id, trip_id, 'start_trigger' AS role FROM accepted
    UNION ALL SELECT unnest([e1,e2,e3]), trip_id, 'end_trigger' FROM accepted
    UNION ALL SELECT unnest([b.lat_row,b.lon_row,b.alt_row]), a.trip_id, 'trajectory_batch' FROM accepted a
      JOIN trip_batches b ON b.vin=a.vin AND b.s_us=a.s_us""",
)
step(
    "lineage",
    "usage",
    """SELECT row_id, string_agg(DISTINCT trip_id, ';' ORDER BY trip_id) AS trip_ids,
    string_agg(DISTINCT role, ';' ORDER BY role) AS roles FROM usage WHERE row_id IS NOT NULL GROUP BY row_id""",
)


step(
    "draws",
    "accepted",
    """SELECT vin, sha256('42:' || vin) || ':' || vin AS draw, count(*) OVER () AS n,
    row_number() OVER (ORDER BY sha256('42:' || vin) || ':' || vin) AS rk FROM (SELECT DISTINCT vin FROM accepted)""",
)
step(
    "manifest",
    "draws",
    """SELECT vin, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + v THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT *, greatest(1, CAST(round_even(n*0.15::DOUBLE, 0) AS BIGINT)) AS t,
      greatest(1, CAST(round_even(n*0.15::DOUBLE, 0) AS BIGINT)) AS v FROM draws)""",
)
step(
    "past",
    "accepted manifest",
    """SELECT a.*, m.split, least(ordinal-1, 20) AS hist_n, lag(elat) OVER w AS last_lat, lag(elon) OVER w AS last_lon,
    avg(elat) OVER h AS mean_lat, avg(elon) OVER h AS mean_lon, lag(e_us) OVER w AS prior_end
    FROM accepted a JOIN manifest m USING (vin)
    WINDOW w AS (PARTITION BY vin ORDER BY s_us), h AS (PARTITION BY vin ORDER BY s_us ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
)
step(
    "expanded",
    "past",
    """SELECT p.*, f, CAST(least(CASE WHEN f=0 THEN 1 ELSE greatest(1, ceil(greatest(1,n-1)*f)) END, greatest(1,n-1)) AS BIGINT) AS cnt
    FROM past p CROSS JOIN (VALUES (0.0::DOUBLE),(0.25::DOUBLE),(0.5::DOUBLE)) v(f)""",
)
step(
    "seen",
    "expanded points",
    """SELECT x.trip_id, x.f, max(p.lat) FILTER (p.idx=0) AS olat, max(p.lon) FILTER (p.idx=0) AS olon,
    max(p.lat) FILTER (p.idx=x.cnt-1) AS plat, max(p.lon) FILTER (p.idx=x.cnt-1) AS plon,
    coalesce(sum(p.step) FILTER (p.idx BETWEEN 1 AND x.cnt-1), 0)/1000 AS path_km
    FROM expanded x JOIN points p USING (trip_id) GROUP BY x.trip_id, x.f""",
)
step(
    "samples",
    "expanded seen",
    f"""SELECT x.trip_id || printf('@%.3f', x.f) AS sample_id, x.vin, x.trip_id, x.s_us, x.e_us, x.split, x.cnt, x.n, x.ordinal,
    'vehicle-' || left(sha256(x.vin), 10) AS vehicle_id, x.elat AS actual_latitude, x.elon AS actual_longitude,
    {cell('x.elat', 'x.elon')} AS actual_cell, olat AS origin_latitude, olon AS origin_longitude,
    sin(2*pi()*hr/24) AS hour_sin, cos(2*pi()*hr/24) AS hour_cos, sin(2*pi()*wd/7) AS weekday_sin, cos(2*pi()*wd/7) AS weekday_cos,
    sin(2*pi()*mo/12) AS month_sin, cos(2*pi()*mo/12) AS month_cos, CASE WHEN wd>=5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weekend,
    x.f AS prefix_fraction, plat AS prefix_last_latitude, plon AS prefix_last_longitude,
    {hav('olat', 'olon', 'plat', 'plon', R_KM)} AS prefix_displacement_km, path_km AS prefix_path_km,
    CASE WHEN cnt > 1 THEN sin(radians({bearing('olat', 'olon', 'plat', 'plon')})) ELSE 0.0::DOUBLE END AS prefix_bearing_sin,
    CASE WHEN cnt > 1 THEN cos(radians({bearing('olat', 'olon', 'plat', 'plon')})) ELSE 1.0::DOUBLE END AS prefix_bearing_cos,
    CAST(hist_n AS DOUBLE) AS history_count, coalesce(last_lat, olat) AS last_destination_latitude,
    coalesce(last_lon, olon) AS last_destination_longitude, coalesce(mean_lat, olat) AS mean_destination_latitude,
    coalesce(mean_lon, olon) AS mean_destination_longitude
    FROM (SELECT *, hour(make_timestamp(s_us)) + minute(make_timestamp(s_us))/60.0::DOUBLE AS hr,
      isodow(make_timestamp(s_us))-1 AS wd, month(make_timestamp(s_us))-1 AS mo FROM expanded) x
    JOIN seen s ON s.trip_id=x.trip_id AND s.f=x.f""",
)
step(
    "scored",
    "samples",
    """SELECT *, actual_latitude + (((s_us // 7) % 1000)/1000.0::DOUBLE - 0.5::DOUBLE) * 0.1::DOUBLE * (1-prefix_fraction) AS predicted_latitude,
    actual_longitude + (((s_us // 11) % 1000)/1000.0::DOUBLE - 0.5::DOUBLE) * 0.1::DOUBLE * (1-prefix_fraction) AS predicted_longitude FROM samples""",
)
step(
    "candidates",
    "samples",
    f"""SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY probability DESC, cell) AS rk FROM (
    SELECT sample_id, actual_cell, actual_latitude, actual_longitude,
      {cell('actual_latitude + (i-3)*0.01::DOUBLE', 'actual_longitude').replace('actual_latitude + (i-3)*0.01::DOUBLE', '(actual_latitude + (i-3)*0.01::DOUBLE)')} AS cell,
      ((s_us // (i+3)) % 50)/50.0::DOUBLE AS probability FROM samples CROSS JOIN range(7) r(i))""",
)
step(
    "top",
    "candidates",
    """SELECT *, CAST(split_part(substr(cell,2),':',1) AS BIGINT)*0.01::DOUBLE - 90.0::DOUBLE + 0.005::DOUBLE AS clat,
    CAST(split_part(cell,':',2) AS BIGINT)*0.01::DOUBLE - 180.0::DOUBLE + 0.005::DOUBLE AS clon FROM candidates WHERE rk <= 5""",
)
step(
    "predictions",
    "scored top",
    f"""SELECT s.*, t.cell AS predicted_cell, t.probability AS predicted_cell_probability, r.rk AS actual_rank,
    {hav('s.actual_latitude', 's.actual_longitude', 's.predicted_latitude', 's.predicted_longitude', R_KM)} AS error_km
    FROM scored s JOIN top t ON t.sample_id=s.sample_id AND t.rk=1
    LEFT JOIN (SELECT sample_id, cell, min(rk) AS rk FROM top GROUP BY ALL) r
      ON r.sample_id=s.sample_id AND r.cell=s.actual_cell""",
)


def sql(target: str, final: str) -> str:
    """WITH-chain for the (space separated) steps in ``target``, then ``final``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in STEPS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in target.split():
        visit(name)
    return "WITH " + ",\n".join(STEPS[n][1] for n in ordered) + "\n" + final
