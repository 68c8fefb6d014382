"""Vehicle-disjoint train / validation / test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SampleSettings
from .spread import with_ordinal, with_prefix

SPLITS = ("train", "validation", "test")


def split_hash(vin: Column, seed: int) -> Column:
    """Order of vehicles in the draw: a seeded hash, ties broken by the VIN itself."""
    return F.concat(F.sha2(F.concat(F.lit(f"{seed}:"), vin), 256), F.lit(":"), vin)


def split_cutoffs(vins: DataFrame, cfg: SampleSettings) -> DataFrame:
    """One row: vehicle count and the last draw key of test and of validation.

    ``vins`` has a unique ``vin`` column. Ranks come from counts per hash prefix, which
    grows until few vehicles share it, so no task ever sorts all vehicles.
    """
    keyed = vins.select(split_hash(F.col("vin"), cfg.split_seed).alias("draw"))
    keyed = with_prefix(keyed, "draw", "prefix", 4)
    ranked = with_ordinal(keyed, [], "prefix", ["draw"], "rank")
    total = keyed.agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")

    def share(fraction: float) -> Column:
        # Halves go to the even neighbour.
        return F.greatest(F.lit(1), F.bround(n * F.lit(fraction), 0).cast("bigint"))

    sizes = total.select(
        n, share(cfg.test_vin_fraction).alias("test"), share(cfg.validation_vin_fraction).alias("validation")
    )
    crowded = F.col("test") + F.col("validation") >= n
    sizes = sizes.select(
        F.when(n < 3, F.raise_error(F.lit("At least three VINs are required for a split")))
        .otherwise(n)
        .alias("n"),
        F.when(crowded, 1).otherwise(F.col("test")).alias("test"),
        F.when(crowded, 1).otherwise(F.col("validation")).alias("validation"),
    )
    size = sizes.select(F.struct("n", "test", "validation")).scalar()
    flagged = ranked.withColumn("size", size)
    return flagged.agg(
        F.max("size.n").alias("n_vins"),
        F.max(F.when(F.col("rank") <= F.col("size.test"), F.col("draw"))).alias("test_through"),
        F.max(
            F.when(F.col("rank") <= F.col("size.test") + F.col("size.validation"), F.col("draw"))
        ).alias("validation_through"),
    )


def split_by_cutoffs(df: DataFrame, vin: str, cutoffs: DataFrame, cfg: SampleSettings) -> DataFrame:
    """Append ``split``. The two cut-offs decide it per row: no join on the VIN."""
    cut = cutoffs.select(F.struct("test_through", "validation_through")).scalar()
    draw = split_hash(F.col(vin), cfg.split_seed)
    return (
        df.withColumn("_cut", cut)
        .withColumn(
            "split",
            F.when(draw <= F.col("_cut.test_through"), "test")
            .when(draw <= F.col("_cut.validation_through"), "validation")
            .otherwise("train"),
        )
        .drop("_cut")
    )


def distinct_vins(trips: DataFrame) -> DataFrame:
    return trips.select(F.col("VIN").alias("vin")).distinct()


def make_split(trips: DataFrame, cfg: SampleSettings) -> DataFrame:
    """Manifest (vin, split, seed) of the vehicles in a trips table."""
    vins = distinct_vins(trips)
    return split_by_cutoffs(vins, "vin", split_cutoffs(vins, cfg), cfg).withColumn(
        "seed", F.lit(cfg.split_seed)
    )


def attach_split(df: DataFrame, vin: str, manifest: DataFrame) -> DataFrame:
    """Append ``split`` from a saved manifest; an unknown VIN fails the job.

    The manifest has one row per vehicle and is not bounded, so the join is left to
    the optimizer; adaptive execution splits a hot vehicle's side.
    """
    known = manifest.select(F.col("vin").alias("_vin"), F.col("split").alias("_split"))
    message = F.concat(F.lit("VIN absent from the split manifest: "), F.col(vin))
    return (
        df.join(known, F.col(vin) == F.col("_vin"), "left")
        .withColumn("split", F.coalesce("_split", F.raise_error(message).cast("string")))
        .drop("_vin", "_split")
    )
