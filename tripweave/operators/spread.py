"""Ordered per-key work without putting a whole key into one task.

Each helper cuts a key into buckets, works inside (key, bucket), and lets a slim
table with one row per (key, bucket) carry what a bucket needs from the others.
The big table is joined on (key, bucket), so a key that holds a third of all rows
is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SpreadSettings
from ..session import stage


# A bucket of more rows than this is cut, however many rows the table has.
HOT_ROWS = 100000
# Numbers of pieces that a hot bucket may be cut into; it takes the least that brings a
# piece to HOT_ROWS. Quantile marks are constants, so each number is one aggregation.
PIECES = (16, 256, 4096)


def with_time_bucket(
    df: DataFrame,
    key: str,
    ts_us: str,
    spread: SpreadSettings,
    name: str = "bucket",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Append a bucket number that never decreases along a key's time.

    Buckets are fixed spans of time. A span that is still hot (a key that stands for
    many vehicles, a replay stamped within one hour) is cut at quantiles of its own
    times, into as many pieces as its own count asks for. Sizes are counted at once,
    from two columns of ``df``; the cuts stay a table and are joined. Pass a staged
    table.
    """
    span = F.floor(F.col(ts_us) / F.lit(spread.bucket_us))
    slim = df.select(F.col(key).alias("_key"), span.alias("_span"), F.col(ts_us).alias("_ts"))
    sizes = slim.groupBy("_key", "_span").agg(F.count(F.lit(1)).alias("_rows"))
    hot = sizes.filter(F.col("_rows") > hot_rows)
    tagged = df.withColumn("_span", span)
    piece = F.lit(0)
    if not hot.isEmpty():
        cuts = None
        for least, pieces in zip((1, *PIECES), PIECES):
            fits = F.col("_rows") > least * hot_rows
            if pieces != PIECES[-1]:
                fits &= F.col("_rows") <= pieces * hot_rows
            marks = [i / pieces for i in range(1, pieces)]
            found = (
                slim.join(hot.filter(fits).select("_key", "_span"), ["_key", "_span"])
                .groupBy("_key", "_span")
                .agg(F.percentile_approx("_ts", marks, 10 * pieces).alias("_cuts"))
            )
            cuts = found if cuts is None else cuts.unionByName(found)
        cuts = stage(cuts.withColumnsRenamed({"_span": "_hot_span", "_key": "_hot_key"}), "cuts")
        tagged = tagged.join(
            cuts, (F.col(key) == F.col("_hot_key")) & (F.col("_span") == F.col("_hot_span")), "left"
        ).drop("_hot_key", "_hot_span")
        below = F.size(F.filter("_cuts", lambda c: c <= F.col(ts_us)))
        piece = F.when(F.col("_cuts").isNull(), 0).otherwise(below)
    out = tagged.withColumn(name, F.col("_span") * F.lit(2 * PIECES[-1]) + piece)
    return out.drop("_span", "_cuts")


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str | Column],
    name: str,
    counted: DataFrame | None = None,
    carry: DataFrame | None = None,
) -> DataFrame:
    """1-based position of each row within ``keys`` under (bucket, order).

    ``bucket`` must not decrease along ``order``. ``counted`` is a cheaper source of
    the bucket sizes than ``df`` when one exists. ``carry`` (unique on ``keys``) is
    attached on the slim side, which spares the big table a join on ``keys``.
    """
    keys = list(keys)
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = by_key.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        (counted if counted is not None else df)
        .groupBy(*keys, bucket)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    if carry is not None:
        offsets = offsets.join(carry, keys, "left")
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(within))
        .join(offsets, [*keys, bucket], "inner")
        .withColumn(name, F.col("_offset") + F.col("_rank"))
        .drop("_rank", "_offset")
    )


def with_prefix(df: DataFrame, text: str, name: str, length: int, most: int = HOT_ROWS) -> DataFrame:
    """Append ``name``: a prefix of ``text``, as long as it takes for at most ``most`` rows to
    share it (or the whole text). Prefixes sort as the texts do.

    Starts at ``length`` characters; prefixes that too many rows share grow by as many, and
    only their rows change.
    """
    out = df.withColumn(name, F.substring(text, 1, length))
    while True:
        crowded = out.groupBy(name).agg(F.count(F.lit(1)).alias("_rows"), F.max(F.length(text)).alias("_longest"))
        crowded = crowded.filter((F.col("_rows") > most) & (F.col("_longest") > F.length(name)))
        crowded = stage(crowded.select(F.col(name).alias("_crowded")), "prefixes")
        if crowded.isEmpty():
            return out
        longer = F.expr(f"substring({text}, 1, length({name}) + {length})")
        grown = F.when(F.col("_crowded").isNotNull(), longer).otherwise(F.col(name))
        out = out.join(crowded, F.col(name) == F.col("_crowded"), "left").withColumn(name, grown).drop("_crowded")
        out = stage(out, "prefixed")


def with_neighbour_marks(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    position: str,
    mark: str,
) -> DataFrame:
    """Nearest mark strictly before and strictly after each row of a timeline.

    ``position`` orders the rows of a key; ``mark`` equals it on marked rows and is
    null elsewhere. Adds ``prev_mark`` and ``next_mark``. Reads ``df`` twice, the
    second time three columns of it.
    """
    keys = list(keys)
    key_up = Window.partitionBy(*keys).orderBy(F.col(bucket))
    key_down = Window.partitionBy(*keys).orderBy(F.col(bucket).desc())
    in_up = Window.partitionBy(*keys, bucket).orderBy(F.col(position))
    in_down = Window.partitionBy(*keys, bucket).orderBy(F.col(position).desc())

    def before(w):
        return w.rowsBetween(Window.unboundedPreceding, -1)

    # Buckets without marks get a row too: their rows need what is carried past them.
    slim = (
        df.groupBy(*keys, bucket)
        .agg(F.min(mark).alias("_first"), F.max(mark).alias("_last"))
        .withColumn("_carried_prev", F.max("_last").over(before(key_up)))
        .withColumn("_carried_next", F.min("_first").over(before(key_down)))
        .drop("_first", "_last")
    )
    # Marks grow along the order, so max and min find the nearest one. The later
    # side runs on a descending order: frames open to the end cost quadratic time.
    return (
        df.withColumn("_near_prev", F.max(mark).over(before(in_up)))
        .withColumn("_near_next", F.min(mark).over(before(in_down)))
        .join(slim, [*keys, bucket], "left")
        .withColumn("prev_mark", F.coalesce("_near_prev", "_carried_prev"))
        .withColumn("next_mark", F.coalesce("_near_next", "_carried_next"))
        .drop("_near_prev", "_near_next", "_carried_prev", "_carried_next")
    )


#: Values of a bracket that are ordered as they are, and marks that cut a wider one.
FEW, MARKS = 1024, 256


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    few: int = FEW,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per name.

    A quantile lies between two ranks, and each rank is searched by narrowing. A bracket
    (low, high) of values is known to hold the rank; counts of the values up to ``low`` and
    strictly between tell whether ``low`` or ``high`` is the answer. Otherwise the values
    between are cut at ``MARKS`` marks of a mergeable sketch and the four parts around the
    rank are the next bracket. What lies strictly between two marks shrinks by a factor of
    over 50 in each pass, whatever ties there are, until ``few`` values are left. So no task
    ever holds more than that of a group, and passes grow with the logarithm of its rows.

    ``value`` must have no nulls. Runs its passes at once: pass a written table.
    """
    keys = list(keys) or ["_all"]
    keyed = df if keys != ["_all"] else df.withColumn("_all", F.lit(1))
    keyed = keyed.select(*keys, F.col(value).alias("_v"))
    v = F.col("_v")
    names = list(quantiles)
    ranks = [f"{i}_{side}" for i in range(len(names)) for side in ("a", "b")]
    spots = {f"{i}_{side}": q for i, q in enumerate(quantiles.values()) for side in ("a", "b")}

    def rank(r: str) -> Column:
        below = F.floor(F.lit(float(spots[r])) * (F.col("_n") - 1))
        return below if r.endswith("a") else F.least(below + 1, F.col("_n") - 1)

    def with_state(state: DataFrame) -> DataFrame:
        named = state.withColumnsRenamed({k: f"_key_{k}" for k in keys})
        match = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
        return keyed.join(named, match, "inner")

    def between(r: str) -> Column:
        return (v > F.col(f"_low_{r}")) & (v < F.col(f"_high_{r}"))

    def counted(brackets: DataFrame) -> DataFrame:
        """Count what the brackets hold; a rank that falls on an end of its own is found."""
        columns = [c for c in brackets.columns if c not in keys]
        counts = []
        for r in ranks:
            counts += [F.count_if(v <= F.col(f"_low_{r}")).alias(f"_upto_{r}"), F.count_if(between(r)).alias(f"_inside_{r}")]
        found = with_state(brackets).groupBy(*keys, *columns).agg(*counts)
        for r in ranks:
            at_low = rank(r) < F.col(f"_upto_{r}")
            at_high = rank(r) >= F.col(f"_upto_{r}") + F.col(f"_inside_{r}")
            value_at = F.when(at_low, F.col(f"_low_{r}")).when(at_high, F.col(f"_high_{r}"))
            found = found.withColumn(f"_value_{r}", value_at)
        # Written before the join, so that adaptive execution may split the other side.
        return stage(found, "brackets")

    ends = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    edges = [c.alias(n) for r in ranks for c, n in ((F.col("_least"), f"_low_{r}"), (F.col("_most"), f"_high_{r}"))]
    state = counted(stage(ends.select(*keys, "_n", *edges), "ends"))

    def wide(r: str) -> Column:
        return F.col(f"_value_{r}").isNull() & (F.col(f"_inside_{r}") > few)

    any_wide = F.lit(False)
    for r in ranks:
        any_wide = any_wide | wide(r)
    shares = [i / MARKS for i in range(MARKS + 1)]
    while not state.filter(any_wide).isEmpty():
        columns = [c for c in state.columns if c not in keys]
        marks = [
            F.percentile_approx(F.when(wide(r) & between(r), v), shares, 10 * MARKS).alias(f"_marks_{r}") for r in ranks
        ]
        cut = with_state(state).groupBy(*keys, *columns).agg(*marks)
        narrowed = []
        for r in ranks:
            at = F.floor((rank(r) - F.col(f"_upto_{r}")) * MARKS / F.col(f"_inside_{r}")).cast("int")
            low, high = F.get(f"_marks_{r}", at - 1), F.get(f"_marks_{r}", at + 3)
            narrowed += [
                F.when(wide(r), F.coalesce(low, F.col(f"_low_{r}"))).otherwise(F.col(f"_low_{r}")).alias(f"_low_{r}"),
                F.when(wide(r), F.coalesce(high, F.col(f"_high_{r}"))).otherwise(F.col(f"_high_{r}")).alias(f"_high_{r}"),
            ]
        state = counted(stage(cut.select(*keys, "_n", *narrowed), "cuts"))

    columns = [c for c in state.columns if c not in keys]
    rest = [
        F.sort_array(F.collect_list(F.when(F.col(f"_value_{r}").isNull() & between(r), v))).alias(f"_rest_{r}") for r in ranks
    ]
    left = with_state(state).groupBy(*keys, *columns).agg(*rest)
    results = []
    for i, (name, q) in enumerate(quantiles.items()):
        a, b = (
            F.coalesce(F.col(f"_value_{r}"), F.get(f"_rest_{r}", (rank(r) - F.col(f"_upto_{r}")).cast("int")))
            for r in (f"{i}_a", f"{i}_b")
        )
        spot = F.lit(float(q)) * (F.col("_n") - 1)
        results.append((a + (b - a) * (spot - F.floor(spot))).alias(name))
    return left.select(*keys, *results).drop("_all")
