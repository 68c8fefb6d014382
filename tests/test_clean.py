import pytest
from pyspark.sql import functions as F

from tripweave.config import BuildSettings
from tripweave.operators.clean import clean, cleaning_record, judge, repeated_contents, with_series_values
from tripweave.operators.events import extract_events
from tripweave.plans.build import build_trips

from .helpers import B, RAW_SCHEMA, at, batch, end, start

LAT = B.latitude_signal


def row(vin="V", trig=B.start_trigger, name=LAT, scalar="1", series=None, t=None, fuel="f"):
    return (vin, trig, name, scalar, series, t or at(0), fuel, None)


CASES = [
    (row(vin="  "), "missing_vin"),
    (row(vin=None), "missing_vin"),
    (row(vin="", trig=""), "missing_vin"),
    (row(trig="\t"), "missing_trigger"),
    (row(name=None), "missing_signal"),
    (row(t="yesterday"), "invalid_timestamp"),
    (row(trig="Other"), "irrelevant_trigger_or_signal"),
    (row(name="ambientTemperature"), "irrelevant_trigger_or_signal"),
    (row(scalar="abc"), "invalid_scalar_value"),
    (row(scalar="NaN", fuel="g"), "invalid_scalar_value"),
    (row(scalar="1d", fuel="h"), "invalid_scalar_value"),
    (row(scalar="0x1p3", fuel="i"), "invalid_scalar_value"),
    (row(t="12:30"), "invalid_timestamp"),
    (row(trig=B.periodic_trigger, scalar=None), "missing_series_value"),
    (row(trig=B.periodic_trigger, series="  "), "missing_series_value"),
    (row(trig=B.periodic_trigger, series="[1,"), "invalid_series_value"),
    (row(trig=B.periodic_trigger, series="[]"), "invalid_series_value"),
    (row(trig=B.periodic_trigger, series='{"a": 1}'), "invalid_series_value"),
    (row(trig=B.periodic_trigger, series='[1, "NaN"]'), "invalid_series_value"),
    (row(trig=B.periodic_trigger, series="[1] [2]"), "invalid_series_value"),
    (row(trig=B.periodic_trigger, series="[1, null]"), "invalid_series_value"),
    (row(trig=B.periodic_trigger, series='["2.5", 3]'), None),
    (row(vin=" K ", scalar=" 2.5 "), None),
    (row(vin="D", fuel=None), None),
    (row(vin="D ", fuel=None), "exact_duplicate"),
    (row(vin="D", fuel=None), "exact_duplicate"),
    (row(vin="D", fuel="x"), None),
    (row(vin="Z", trig="Other"), "irrelevant_trigger_or_signal"),
    (row(vin="Z", trig="Other"), "exact_duplicate"),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    raw = spark.createDataFrame([c for c, _ in CASES], RAW_SCHEMA).coalesce(1)
    return clean(raw)


def test_each_row_has_its_first_reason(cleaned):
    got = {r.source_row_id: r.reason for r in cleaned.discarded.collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(CASES) if reason}


def test_received_is_retained_plus_discarded(cleaned):
    kept = cleaned.data.collect()
    assert {r.source_row_id for r in kept} == {i for i, (_, reason) in enumerate(CASES) if reason is None}
    rec = cleaning_record(cleaned.counts).first()
    assert rec.raw_rows_received == len(CASES)
    assert rec.rows_retained_for_reconstruction == len(kept)
    assert rec.rows_discarded_before_reconstruction == len(CASES) - len(kept)
    assert rec.preconstruction_discard_counts["exact_duplicate"] == 3


def test_text_is_trimmed_and_numbers_read(cleaned):
    k = cleaned.data.filter("vin = 'K'").first()
    assert k.scalar == 2.5
    quoted = cleaned.data.filter(F.col("series").isNotNull()).first()
    assert quoted.series_values == [2.5, 3.0]


def test_vin_lists_and_kept_duplicates(spark):
    raw = spark.createDataFrame(start("A", 0) + start("B", 0) + start("C", 0) + start("A", 0), RAW_SCHEMA)
    cfg = BuildSettings(include_vins=("A", "B"), drop_exact_duplicates=False)
    c = clean(raw, cfg)
    assert {r.reason: r["count"] for r in c.discarded.groupBy("reason").count().collect()} == {"vin_not_included": 3}
    assert c.data.count() == 9
    c = clean(raw, BuildSettings(exclude_vins=("B",)))
    counts = {r.reason: r.row_count for r in c.counts.collect()}
    assert counts == {None: 6, "vin_excluded": 3, "exact_duplicate": 3}


def test_nan_equals_null_in_extra_columns(spark):
    rows = [(*r, x) for r, x in zip(start("A", 0)[:1] * 3, (float("nan"), None, 1.0))]
    c = clean(spark.createDataFrame(rows, RAW_SCHEMA + ", speed double").coalesce(1))
    assert [r.source_row_id for r in c.discarded.collect()] == [1]


def test_missing_columns_fail_before_any_job(spark):
    raw = spark.createDataFrame(end("A", 0) + batch("A", 1, [1.0], [1.0]), RAW_SCHEMA)
    with pytest.raises(ValueError, match="name"):
        clean(raw.drop("name"))


def test_many_copies_of_one_row_fold_on_the_map_side(spark):
    raw = spark.range(0, 5000, numPartitions=8).select(
        F.col("id").alias("rid"), F.lit("V").alias("vin"), F.lit(B.start_trigger).alias("triggerOrContext"), F.lit(LAT).alias("name"),
        F.lit("1").alias("scalarValue"), F.lit(None).cast("string").alias("timeSeriesValue"),
        F.lit(at(0)).alias("vehicleCollectionTime"),
    )
    c = clean(raw, BuildSettings(row_id_column="rid"))
    assert [r.source_row_id for r in c.data.collect()] == [0]
    assert c.discarded.count() == 4999
    told = judge(raw, BuildSettings(row_id_column="rid"))
    plan = repeated_contents(told.rows)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_content_is_exchanged_once_for_a_whole_build(spark):
    """Reading what stays, what goes and the counts moves no content; events move it once."""
    rows = start("A", 0) + batch("A", 60, [48.8, 48.805], [2.2, 2.204], [70.0, 70.0]) + end("A", 600)
    raw = spark.createDataFrame(rows + rows, RAW_SCHEMA)
    build = build_trips(raw)
    plans = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plans(build.data)
    for lean in (build.discarded, build.judged.counts):
        assert "series" not in plans(lean).split("ReadSchema: ", 1)[1].split("\n", 1)[0]
    events = plans(extract_events(build.data, build.settings))
    assert events.count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning" not in plans(build.data.filter("vin = 'A'"))
    assert sorted((r.reason or "", r.row_count) for r in build.reason_counts.collect()) == [("", 9), ("exact_duplicate", 9)]


def test_absent_values_are_not_confused_with_others(spark):
    # Equal texts in different columns, and nulls in either, are different contents.
    base = ("A", B.start_trigger, B.latitude_signal, "1", None, at(0))
    rows = [(*base, "x", None), (*base, None, "x"), (*base, None, None), (*base, "x", "x"), (*base, None, "x")]
    c = clean(spark.createDataFrame(rows, RAW_SCHEMA))
    assert c.data.count() == 4 and [r.reason for r in c.discarded.collect()] == ["exact_duplicate"]


def test_series_reader(spark):
    texts = ["[1,2]", "[1.5]", '["1"]', "[1e3,-2]", "[Infinity]", "[[1]]", "1", None, "[true]"]
    df = with_series_values(spark.createDataFrame([(t,) for t in texts], "series string"))
    got = [r.series_values for r in df.collect()]
    assert got == [[1.0, 2.0], [1.5], [1.0], [1000.0, -2.0], None, None, None, None, None]


def test_forms_of_time(spark):
    from tripweave.operators.clean import as_utc

    forms = [
        "2026-02-13T07:00:00Z", "2026-02-13 08:00:00+01:00", "2026/02/13 07:00:00", "20260213T070000Z", "2/13/2026 7:00",
        "Feb 13 2026 07:00", "Feb 13, 2026 07:00:00", "13 Feb 2026 07:00", "2026.02.13 07:00:00.000000",
    ]
    rows = [(i, f) for i, f in enumerate(forms)] + [(-1, "07:00"), (-2, "soon"), (-3, ""), (-4, "2026/13/40"), (-5, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r.s for r in df.select("i", F.unix_seconds(as_utc(df, "t")).alias("s")).collect()}
    assert {got[i] for i in range(len(forms))} == {1770966000}
    assert all(got[i] is None for i in range(-5, 0))
    number = spark.createDataFrame([(1770966000_123456789,)], "t bigint")
    assert number.select(F.unix_micros(as_utc(number, "t"))).first()[0] == 1770966000123456
