"""The driver's ``events`` table read as vehicle telemetry (rules: FIXTURES.md, section 2).

signup starts a trip, purchase ends it, view is a periodic batch, click is an
irrelevant row, error is one of nine kinds of dirty row. Some batches are unaligned
or lack altitude and some triggers carry a signal twice, so those paths run too.
``TELEMETRY_SQL`` says the same in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.config import BuildSettings
from tripweave.session import widen

SETTINGS = BuildSettings(row_id_column="row_id", metadata_columns=("fuel", "hyb", "model"))
D = SETTINGS


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = widen(spark.read.parquet(f"{sf_dir}/events.parquet"))
    k = F.get_json_object("props", "$.k").cast("int")
    e, kind = F.col("event_id"), F.col("event_type")
    dirty = F.when(kind == "error", e % 9)
    base = ev.select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        (48 + F.col("value") / 1000).alias("lat"),
        (2 + k / 1000).alias("lon"),
        (50 + e % 100).cast("double").alias("alt"),
        F.coalesce(dirty, F.lit(-1)).alias("dirty"),
    )
    # Slots 0 to 2: one signal each; 3: latitude again; 10 to 12: copies of 0 to 2.
    wide = base.withColumn("slot", F.explode(F.array(*[F.lit(x) for x in (0, 1, 2, 3, 10, 11, 12)])))
    slot = F.col("slot")
    triggers = kind.isin("signup", "purchase")
    repeated = triggers & (e % 13 == 0)
    wide = wide.filter(
        F.when(slot >= 10, F.col("dirty") == 8).when(slot == 3, repeated).otherwise(F.lit(True))
    )
    signal = F.when(slot >= 10, slot - 10).otherwise(slot % 3)

    def pick(*options: Column) -> Column:
        return F.when(signal == 0, options[0]).when(signal == 1, options[1]).otherwise(options[2])

    def text(c: Column) -> Column:
        return c.cast("decimal(14,6)").cast("string")

    base_value = pick(F.col("lat"), F.col("lon"), F.col("alt"))
    step = pick(F.lit(0.001), F.lit(0.002), F.lit(0.0))
    ticks = [text(base_value), text(base_value + step), text(base_value + step * 2)]
    two, three = (F.concat(F.lit("["), F.concat_ws(",", *ticks[:n]), F.lit("]")) for n in (2, 3))
    series = (
        F.when((kind == "view") & (signal == 1) & (e % 17 == 0), two)
        .when((kind == "view") & ~((signal == 2) & (e % 19 == 0)), three)
        .when(F.col("dirty") == 6, "[1,")
        .when(F.col("dirty") == 7, '[1,"NaN"]')
    )
    extra = F.when(slot == 3, 0.0005).otherwise(0.0)
    scalar = F.when(triggers, text(base_value + extra)).when(F.col("dirty") == 4, "abc")
    row_id = F.when(slot >= 10, -(e * 4 + slot - 10) - 1).otherwise(e * 4 + slot)
    vin = F.concat(F.lit("VIN"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    vin = F.when((kind == "view") & (F.col("event_id") % 4 == 0), F.concat(F.lit(" "), vin, F.lit("\t"))).otherwise(vin)
    trigger = (
        F.when(kind == "signup", D.start_trigger)
        .when(kind == "purchase", D.end_trigger)
        .when(kind == "view", D.periodic_trigger)
        .when(F.col("dirty") == 1, " ")
        .when(F.col("dirty") == 4, D.start_trigger)
        .when(F.col("dirty").isin(5, 6, 7), D.periodic_trigger)
        .otherwise("Vehicle/Context/Unused")
    )
    return wide.select(
        row_id.alias("row_id"),
        F.when(F.col("dirty") == 0, "   ").otherwise(vin).alias("vin"),
        trigger.alias("triggerOrContext"),
        F.when(F.col("dirty") == 2, "")
        .otherwise(pick(F.lit(D.latitude_signal), F.lit(D.longitude_signal), F.lit(D.altitude_signal)))
        .alias("name"),
        scalar.alias("scalarValue"),
        series.alias("timeSeriesValue"),
        F.when(F.col("dirty") == 3, "not-a-time")
        .otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
        .alias("vehicleCollectionTime"),
        F.when(F.col("user_id") % 2 == 0, "electric").otherwise("petrol").alias("fuel"),
        F.concat(
            F.lit("m"),
            F.when(F.col("user_id") % 11 == 0, F.col("event_id") % 2).otherwise(F.col("user_id") % 5).cast("string"),
        ).alias("model"),
    )


TELEMETRY_SQL = f"""
slots AS (
  SELECT * FROM (VALUES (0,false),(1,false),(2,false),(3,false),(0,true),(1,true),(2,true)) v(s, copy)
),
ev AS (
  SELECT event_id, user_id, event_type, ts, 48 + value/1000 AS lat,
         2 + CAST(json_extract(props,'$.k') AS INT)/1000 AS lon,
         CAST(50 + event_id % 100 AS DOUBLE) AS alt,
         CASE WHEN event_type='error' THEN event_id % 9 ELSE -1 END AS dirty
  FROM events
),
wide AS (
  SELECT ev.*, slots.s, slots.copy,
         CASE s % 3 WHEN 0 THEN lat WHEN 1 THEN lon ELSE alt END AS v,
         CASE s % 3 WHEN 0 THEN 0.001::DOUBLE WHEN 1 THEN 0.002::DOUBLE ELSE 0.0::DOUBLE END AS inc
  FROM ev CROSS JOIN slots
  WHERE CASE WHEN copy THEN dirty = 8
             WHEN s = 3 THEN event_type IN ('signup','purchase') AND event_id % 13 = 0
             ELSE true END
),
telemetry AS (
  SELECT CASE WHEN copy THEN -(event_id*4+s)-1 ELSE event_id*4+s END AS row_id,
    CASE WHEN dirty = 0 THEN '   '
         WHEN event_type='view' AND event_id % 4 = 0
           THEN ' VIN' || lpad(CAST(user_id AS VARCHAR),6,'0') || chr(9)
         ELSE 'VIN' || lpad(CAST(user_id AS VARCHAR),6,'0') END AS vin,
    CASE WHEN event_type='signup' THEN '{D.start_trigger}'
         WHEN event_type='purchase' THEN '{D.end_trigger}'
         WHEN event_type='view' THEN '{D.periodic_trigger}'
         WHEN dirty=1 THEN ' '
         WHEN dirty=4 THEN '{D.start_trigger}'
         WHEN dirty IN (5,6,7) THEN '{D.periodic_trigger}'
         ELSE 'Vehicle/Context/Unused' END AS trig,
    CASE WHEN dirty=2 THEN ''
         WHEN s % 3 = 0 THEN '{D.latitude_signal}'
         WHEN s % 3 = 1 THEN '{D.longitude_signal}'
         ELSE '{D.altitude_signal}' END AS name,
    CASE WHEN event_type IN ('signup','purchase')
           THEN printf('%.6f', v + CASE WHEN s=3 THEN 0.0005::DOUBLE ELSE 0.0::DOUBLE END)
         WHEN dirty=4 THEN 'abc' END AS scalar_text,
    CASE WHEN event_type='view' AND s % 3 = 1 AND event_id % 17 = 0
           THEN '[' || printf('%.6f', v) || ',' || printf('%.6f', v+inc) || ']'
         WHEN event_type='view' AND s % 3 = 2 AND event_id % 19 = 0 THEN NULL
         WHEN event_type='view'
           THEN '[' || printf('%.6f', v) || ',' || printf('%.6f', v+inc) || ',' || printf('%.6f', v+2*inc) || ']'
         WHEN dirty=6 THEN '[1,' WHEN dirty=7 THEN '[1,"NaN"]' END AS series_text,
    CASE WHEN dirty=3 THEN 'not-a-time'
         ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END AS time_text,
    CASE WHEN user_id % 2 = 0 THEN 'electric' ELSE 'petrol' END AS fuel,
    'm' || CAST(CASE WHEN user_id % 11 = 0 THEN event_id % 2 ELSE user_id % 5 END AS VARCHAR) AS model
  FROM wide
)"""
