"""Expressions over arrays of points (structs with latitude and longitude)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import in_bounds, km_between, metres_between

# Fixed value: a point nearer than this to the last kept point is a repeat.
REPEAT_M = 0.01
# A point this far from its raw predecessor is kept whatever was kept before it:
# the last kept point lies within REPEAT_M of that predecessor.
SURELY_KEPT_M = 2 * REPEAT_M
# Kept points that the repeat filter gathers before it closes a block.
KEPT_BLOCK = 256


def same_place(a: Column, b: Column) -> Column:
    return (a["latitude"] == b["latitude"]) & (a["longitude"] == b["longitude"])


def pairwise(points: Column, fn) -> Column:
    """fn(previous, current) for each neighbouring pair."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), fn)


def steps_m(points: Column) -> Column:
    return F.when(F.size(points) > 1, pairwise(points, metres_between)).otherwise(
        F.array().cast("array<double>")
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def path_km(points: Column) -> Column:
    return F.when(F.size(points) > 1, total(pairwise(points, km_between))).otherwise(F.lit(0.0))


def drop_equal_neighbours(points: Column) -> Column:
    """Remove points with exactly their predecessor's coordinates."""
    return F.when(F.size(points) < 2, points).otherwise(
        F.filter(
            points,
            lambda p, i: (i == 0) | ~same_place(p, F.get(points, F.greatest(i - 1, F.lit(0)))),
        )
    )


def drop_repeats(points: Column, steps: Column) -> Column:
    """Keep a point only at REPEAT_M or more from the last kept point.

    ``points`` must have no equal neighbours; ``steps`` are the distances between
    them. Almost always every step is at least REPEAT_M and the array is already the
    answer. Others take a fold that gathers kept points in blocks of KEPT_BLOCK, so a
    step copies one block and now and then the list of blocks, never all that was kept.
    """
    none = F.slice(points, F.lit(1), F.lit(0))
    empty = F.struct(F.get(none, F.lit(0)).alias("last"), none.alias("block"), F.array(none).alias("blocks"))

    def step(state: Column, p: Column) -> Column:
        near = F.coalesce(metres_between(state["last"], p) < REPEAT_M, F.lit(False))
        full = F.size(state["block"]) >= KEPT_BLOCK
        taken = F.struct(
            p.alias("last"),
            F.when(full, F.array(p)).otherwise(F.concat(state["block"], F.array(p))).alias("block"),
            F.when(full, F.concat(state["blocks"], F.array(state["block"]))).otherwise(state["blocks"]).alias("blocks"),
        )
        return F.when(near, state).otherwise(taken)

    folded = F.aggregate(
        points, empty, step, lambda state: F.flatten(F.concat(state["blocks"], F.array(state["block"])))
    )
    return F.when(F.array_min(steps) < REPEAT_M, folded).otherwise(points)


def shortened(points: Column, steps: Column) -> Column:
    """drop_repeats() has removed something: ``steps`` no longer belong to ``points``."""
    return F.size(points) <= F.size(steps)


def all_in_bounds(points: Column) -> Column:
    return F.forall(points, lambda p: in_bounds(p["latitude"], p["longitude"]))


def first_of(points: Column) -> Column:
    return F.get(points, F.lit(0))


def last_of(points: Column) -> Column:
    return F.get(points, F.size(points) - 1)


def observed_count(n_points: Column, fraction: Column) -> Column:
    """How many points of a trip are seen at a fraction; never the destination."""
    most = F.greatest(F.lit(1), n_points - 1)
    wanted = F.greatest(F.lit(1), F.ceil(most * fraction).cast("int"))
    return F.least(F.when(fraction == 0, F.lit(1)).otherwise(wanted), most)


def observed_prefix(points: Column, fraction: Column) -> Column:
    return F.slice(points, F.lit(1), observed_count(F.size(points), fraction))


def lonlat(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["longitude"], p["latitude"]))


def latlon_from_pairs(pairs: Column) -> Column:
    """[[lat, lon, ...], ...] to point structs; short members give nulls."""
    return F.transform(
        pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("latitude"), F.get(p, F.lit(1)).alias("longitude"))
    )


def usable_trajectory(points: Column) -> Column:
    """At least two points, all on the globe; never null."""
    return F.coalesce((F.size(points) >= 2) & all_in_bounds(points), F.lit(False))
