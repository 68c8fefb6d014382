"""Bucketed helpers against whole-key answers, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tripweave.config import BuildSettings, SpreadSettings
from tripweave.operators.events import BATCH, END, START
from tripweave.operators.pairing import pair_events
from tripweave.operators.spread import exact_quantiles, with_ordinal, with_prefix, with_time_bucket


def timeline(seed, hot=400, cold=40):
    rnd = random.Random(seed)
    rows = set()
    for vin, n in (("HOT", hot), ("A", cold), ("B", cold)):
        for _ in range(n):
            rows.add((vin, rnd.randrange(-50, 3000), rnd.choice([START, BATCH, BATCH, END])))
    return sorted(rows)


def plain_pairs(rows):
    out = {}
    for vin in {r[0] for r in rows}:
        starts = sorted(t for v, t, k in rows if v == vin and k == START)
        ends = sorted(t for v, t, k in rows if v == vin and k == END)
        used = set()
        trips = []
        for i, s in enumerate(starts):
            nxt = starts[i + 1] if i + 1 < len(starts) else None
            e = next((e for e in ends if e not in used and e >= s and (nxt is None or e < nxt)), None)
            out[(vin, s, START)] = (s, e)
            if e is not None:
                used.add(e)
                trips.append((s, e))
        for e in ends:
            out[(vin, e, END)] = next(((s, x) for s, x in trips if x == e), (None, e))
        for v, t, k in rows:
            if v == vin and k == BATCH:
                out[(vin, t, k)] = next(((s, e) for s, e in trips if s <= t <= e), (None, None))
    return out


@pytest.mark.parametrize("bucket", [7, 100, 1000000])
def test_pairing_equals_the_plain_search(spark, bucket):
    rows = timeline(bucket)
    df = spark.createDataFrame(rows, "vin string, ts_us bigint, kind int").select(
        "*", F.floor(F.col("ts_us") / bucket).alias("bucket"), (F.col("ts_us") * 4 + F.col("kind")).alias("pos")
    )
    got = {(r.vin, r.ts_us, r.kind): (r.start_us, r.end_us) for r in pair_events(df.repartition(7)).collect()}
    assert got == plain_pairs(rows)


def test_no_window_over_a_whole_vehicle_holds_its_rows(spark):
    """Windows on vin alone exist only above the per-bucket aggregation."""
    df = spark.createDataFrame(timeline(1), "vin string, ts_us bigint, kind int").select(
        "*", F.floor(F.col("ts_us") / 10).alias("bucket"), (F.col("ts_us") * 4 + F.col("kind")).alias("pos")
    )
    plan = pair_events(df)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "bucket" not in line.split("windowspec")[0]:
            spec = line.split("], [", 1)[1]
            keys = spec.split("], [")[0]
            if "bucket" not in keys:
                assert "_first" in line or "_last" in line


def test_hot_time_spans_are_cut_at_their_own_quantiles(spark):
    # One span holds nearly all rows, most of them within a thousandth of it.
    df = spark.range(0, 40000, numPartitions=8).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("V"), F.col("id") % 7)).otherwise(F.lit("HOT")).alias("vin"),
        F.when(F.col("id") < 39000, F.col("id")).otherwise(F.col("id") * 80000).alias("ts"),
    )
    out = with_time_bucket(df, "vin", "ts", SpreadSettings(), hot_rows=1000).cache()
    assert out.count() == 40000 and out.columns == ["vin", "ts", "bucket"]
    largest = out.filter("vin = 'HOT'").groupBy("vin", "bucket").count().agg(F.max("count")).first()[0]
    assert largest <= 400
    w = Window.partitionBy("vin").orderBy("ts")
    falls = out.withColumn("before", F.lag("bucket").over(w)).filter("bucket < before")
    assert falls.count() == 0
    cold = with_time_bucket(df, "vin", "ts", SpreadSettings())
    assert "_cuts" not in cold._jdf.queryExecution().optimizedPlan().toString()


def test_ordinal(spark):
    rows = [("HOT", i) for i in range(500)] + [("A", i * 3) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t int").withColumn("b", F.floor(F.col("t") / 10)).repartition(6)
    got = {(r.k, r.t): r.n for r in with_ordinal(df, ["k"], "b", ["t"], "n").collect()}
    assert got == {("HOT", i): i + 1 for i in range(500)} | {("A", i * 3): i + 1 for i in range(5)}
    whole = with_ordinal(df.withColumn("t", F.col("t")), [], "b", ["t", "k"], "n").select("n").collect()
    assert sorted(r.n for r in whole) == list(range(1, 506))


@pytest.mark.parametrize("accuracy", [100000, 20])
def test_exact_quantiles(spark, accuracy):
    rnd = random.Random(11)
    values = [(rnd.choice("xxxxy"), rnd.choice([1.0, rnd.random() * 9, rnd.expovariate(1)])) for _ in range(3000)]
    values += [(None, 4.0), (None, 5.0), ("one", 2.0)]
    df = spark.createDataFrame(values, "g string, v double").repartition(5)
    got = exact_quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.9, "c": 0.0, "d": 1.0}, accuracy)
    for r in got.collect():
        mine = [v for g, v in values if g == r.g]
        expect = np.quantile(mine, [0.5, 0.9, 0.0, 1.0])
        assert np.allclose([r.a, r.b, r.c, r.d], expect, rtol=1e-12), r.g
    one = exact_quantiles(df, [], "v", {"m": 0.5}, accuracy).first().m
    assert one == pytest.approx(np.median([v for _, v in values]), rel=1e-12)
    assert got.count() == 4


def test_result_does_not_depend_on_buckets_or_partitions(spark):
    from tripweave.plans.build import build_trips

    from .helpers import RAW_SCHEMA, batch, end, start

    rnd = random.Random(2)
    rows = []
    for i in range(120):
        t = i * 700
        vin = "HOT" if i % 3 else f"V{i % 5}"
        rows += start(vin, t, lat=48 + rnd.random() / 9)
        if i % 2:
            rows += batch(vin, t + 5, [48.05, 48.06], [2.2, 2.21])
        rows += end(vin, t + 400, lat=48 + rnd.random() / 9)
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rid bigint, " + RAW_SCHEMA)
    cfg = BuildSettings(row_id_column="rid")
    seen = []
    for seconds, parts in ((60, 1), (86400 * 30, 9)):
        b = build_trips(raw.repartition(parts), cfg, SpreadSettings(bucket_seconds=seconds))
        seen.append(sorted(b.trips.collect()) + sorted(b.lineage.collect()))
    assert seen[0] == seen[1] and len(seen[0]) > 100


def test_a_bucket_is_cut_by_its_own_rows_not_by_its_share(spark):
    # 400 of 300,000 rows: far below any share of the table, above the target.
    df = spark.range(0, 300000, numPartitions=4).select(
        F.when(F.col("id") < 400, "HOT").otherwise(F.concat(F.lit("V"), F.col("id") % 3000)).alias("vin"),
        F.when(F.col("id") < 400, F.col("id")).otherwise(F.col("id") * 10_000_000).alias("ts"),
    )
    out = with_time_bucket(df, "vin", "ts", SpreadSettings(), hot_rows=100)
    assert out.filter("vin = 'HOT'").select("bucket").distinct().count() >= 4


def test_the_repeat_filter_is_not_quadratic(spark):
    import time

    from tripweave.functions.paths import drop_repeats, steps_m

    def run(near):
        step = F.when(F.col("id") == 7, 1e-9 if near else 1e-4).otherwise(1e-4)
        points = spark.range(60000).select((F.col("id") * 1e-5 + step).alias("latitude"), F.lit(2.0).alias("longitude"), "id")
        one = points.agg(F.sort_array(F.collect_list(F.struct("id", "latitude", "longitude"))).alias("p"))
        one = one.select(F.transform("p", lambda x: F.struct(x["latitude"].alias("latitude"), x["longitude"].alias("longitude"))).alias("p"))
        one = one.withColumn("s", steps_m(F.col("p")))
        at = time.perf_counter()
        n = one.select(F.size(drop_repeats(F.col("p"), F.col("s")))).first()[0]
        return n, time.perf_counter() - at

    run(False)
    assert run(True)[1] < 10


def test_repeat_filter_equals_brute_force(spark):
    from tripweave.functions.paths import REPEAT_M, drop_repeats, steps_m

    from .helpers import haversine

    rnd = random.Random(5)
    lat, path = 48.0, []
    for _ in range(2000):
        lat += rnd.choice([2e-8, 5e-8, 1e-5])
        path.append((lat, 2.0))
    df = spark.createDataFrame([(path,)], "p array<struct<latitude:double,longitude:double>>").withColumn("s", steps_m(F.col("p")))
    got = [tuple(x) for x in df.select(drop_repeats(F.col("p"), F.col("s"))).first()[0]]
    kept = []
    for p in path:
        if not kept or haversine(kept[-1], p) >= REPEAT_M:
            kept.append(p)
    assert got == kept and len(kept) < 1900


@pytest.mark.parametrize("few", [1, 7, 1024])
def test_quantiles_narrow_through_ties_and_scales(spark, few):
    rng = np.random.default_rng(9)
    groups = {
        "ties": np.repeat([1.0, 2.0, 3.0], [500, 500, 1]),
        "scales": 10.0 ** rng.integers(-200, 200, 700),
        "one": np.array([4.0]),
        "two": np.array([-1.0, 5.0]),
        "even": np.sort(rng.normal(size=900)),
        None: np.concatenate([np.zeros(600), rng.random(300)]),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    marks = {"least": 0.0, "low": 0.1, "mid": 0.5, "high": 0.9, "most": 1.0}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", marks, few).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        for name, q in marks.items():
            ordered = np.sort(xs)
            spot = q * (len(xs) - 1)
            a, b = ordered[int(spot)], ordered[min(int(spot) + 1, len(xs) - 1)]
            assert got[g][name] == a + (b - a) * (spot - int(spot)), (g, name)


@pytest.mark.parametrize("most", [1, 5, 10**6])
def test_prefixes_grow_until_few_share_them(spark, most):
    rnd = random.Random(5)
    texts = {f"g1380{rnd.randrange(10)}:{rnd.randrange(10**5)}" for _ in range(300)} | {"g", "g1380", "x", "é", "éa"}
    df = with_prefix(spark.createDataFrame([(t,) for t in texts], "cell string"), "cell", "p", 5, most)
    rows = df.collect()
    assert all(r.cell.startswith(r.p) for r in rows)
    sizes = {}
    for r in rows:
        sizes.setdefault(r.p, []).append(r.cell)
    assert all(len(v) <= most or max(map(len, v)) == len(p) for p, v in sizes.items())
    ranked = with_ordinal(df, [], "p", ["cell"], "n").collect()
    assert [r.cell for r in sorted(ranked, key=lambda r: r.n)] == sorted(texts, key=lambda t: t.encode())
