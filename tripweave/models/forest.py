"""Destination model: cells by a quadtree of forests, coordinates by extra-trees.

Cells. The grid cells of the training trips lie in a square of 2^L x 2^L cells. A cell is a path
of L quarters, and the model has a forest for each level that tells the four quarters of a cell
of the level above apart, from the sample's features and that cell's centre. A level has four
classes however many cells there are. A cell's probability is the product along its path; the
best are found by beam search, so a row carries as many cells as it may return and no more.
Each tree learns from a bootstrap of its own in which its cells weigh alike.

Coordinates. One model of both: trees over all rows that draw one cut for each feature of a
node and take the one that lowers the joint variance most.

Trees grow over the whole table (``trees.grow``). The model that scoring tasks get is bounded by
trees x leaves x levels and sent as a broadcast.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ForestSettings
from ..functions.geo import grid_column, grid_row
from ..operators.ranking import prediction_rows
from ..schema import FEATURES
from ..session import stage
from . import bootstrap
from .trees import OUTPUTS, Ensemble, Problem, grow

KIND = "quadtree-forest"
#: Coordinates are whole numbers of this part of a degree while trees grow.
FINE = 10_000_000
#: Cells of all levels that scoring tasks are told of, 8 bytes each. Cells of finer levels that
#: no training trip ended in may be predicted.
MOST_CELLS = 4_000_000
#: Ranges that make a training file, and rows that are scored at once.
RANGES, SCORED_ROWS = 16, 2_048
#: Cells kept between levels, at least; twice the cells asked for, if that is more.
BEAM = 8


@dataclass(frozen=True)
class Quadtree:
    """A square of 2^depth grid cells a side from (row, column)."""

    row: int
    column: int
    depth: int
    grid_size: float

    def centre(self, row: np.ndarray, column: np.ndarray, level: int) -> np.ndarray:
        """Centre of cells of a level, given within the square and in cells of that level."""
        side = 1 << (self.depth - level)
        lat = (self.row + (row + 0.5) * side) * self.grid_size - 90.0
        lon = (self.column + (column + 0.5) * side) * self.grid_size - 180.0
        return np.stack([lat, lon], axis=1).astype(np.float32)


@dataclass
class LevelProblem(Problem):
    """Which quarter of its cell at ``level - 1`` a trip ends in."""

    tree: Quadtree
    level: int
    trees: int
    max_leaves: int
    seed: int
    features: int = len(FEATURES) + 2
    outputs: int = OUTPUTS

    @property
    def drawn(self) -> int:
        return max(1, int(self.features**0.5))

    def matrix(self, rows: dict) -> np.ndarray:
        shift = self.tree.depth - self.level + 1
        above = self.tree.centre(rows["row"] >> shift, rows["column"] >> shift, self.level - 1)
        return np.concatenate([rows["x"], above], axis=1)

    def targets(self, rows: dict) -> np.ndarray:
        return (self.classes(rows)[:, None] == np.arange(4)[None, :]).astype(np.int64)

    def classes(self, rows: dict) -> np.ndarray:
        shift = self.tree.depth - self.level
        return 2 * (rows["row"] >> shift & 1) + (rows["column"] >> shift & 1)

    def weights(self, rows: dict, tree: int) -> np.ndarray:
        return bootstrap.draws_of(rows["key"], tree, self.seed) * rows["balance"][:, tree]

    def drawn_rows(self, rows: dict, tree: int) -> tuple[np.ndarray, np.ndarray]:
        # The levels share their trees' draws.
        if tree not in rows["drawn"]:
            rows["drawn"][tree] = super().drawn_rows(rows, tree)
        return rows["drawn"][tree]


@dataclass
class PlaceProblem(Problem):
    """Where a trip ends, both coordinates at once. No bootstrap, all features tried."""

    trees: int
    max_leaves: int
    features: int = len(FEATURES)
    drawn: int = len(FEATURES)
    outputs: int = 2

    def matrix(self, rows: dict) -> np.ndarray:
        return rows["x"]

    def targets(self, rows: dict) -> np.ndarray:
        return rows["place"]

    def weights(self, rows: dict, tree: int) -> np.ndarray:
        return np.ones(len(rows["x"]), np.int64)


def rows_of(batch: pa.RecordBatch) -> dict:
    """Arrays of one batch of the training table."""
    n = batch.num_rows

    def wide(name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1))

    numbers = {c: batch.column(c).to_numpy() for c in ("key", "row", "column", "lat", "lon")}
    place = np.stack([numbers.pop("lat"), numbers.pop("lon")], axis=1)
    return {**numbers, "place": place, "x": wide("x"), "balance": np.asfortranarray(wide("balance")), "drawn": {}}


def _features() -> Column:
    return F.array(*[F.col(c).cast("float") for c in FEATURES])


@dataclass(frozen=True)
class Scorer:
    """What a scoring task is sent."""

    tree: Quadtree
    levels: list[Ensemble]
    places: Ensemble
    #: Sorted codes of the training cells, by level; the finest levels may be absent.
    seen: list[np.ndarray]

    def cells(self, x: np.ndarray, width: np.ndarray):
        """Beam search: (row, grid row, grid column, probability) of the best cells."""
        n = len(x)
        owner, code, chance = np.arange(n), np.zeros(n, np.int64), np.ones(n)
        row, column = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for level, forest in enumerate(self.levels, 1):
            above = self.tree.centre(row, column, level - 1)
            share = forest.mean(np.concatenate([x[owner], above], axis=1))
            quarter = np.arange(4)[None, :]
            child = code[:, None] * 4 + quarter
            known = np.ones(child.shape, bool)
            if level <= len(self.seen):
                cells = self.seen[level - 1]
                at = np.minimum(np.searchsorted(cells, child), len(cells) - 1)
                known = cells[at] == child
            share = share * known
            total = share.sum(axis=1, keepdims=True)
            share = np.where(total > 0, share / np.where(total > 0, total, 1), known / known.sum(axis=1, keepdims=True))
            keep = known.ravel()
            owner = np.repeat(owner, 4)[keep]
            chance = (chance[:, None] * share).ravel()[keep]
            code = child.ravel()[keep]
            row = (row[:, None] * 2 + quarter // 2).ravel()[keep]
            column = (column[:, None] * 2 + quarter % 2).ravel()[keep]
            order = np.lexsort((code, -chance, owner))
            owner, code, chance, row, column = (a[order] for a in (owner, code, chance, row, column))
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            kept = place < width[owner]
            owner, code, chance, row, column = (a[kept] for a in (owner, code, chance, row, column))
        return owner, self.tree.row + row, self.tree.column + column, chance

    def score(self, x: np.ndarray, k: np.ndarray) -> pa.StructArray:
        names, chances, ends, places = [], [], [np.zeros(1, np.int64)], []
        width = np.maximum(BEAM, 2 * k)
        for at in range(0, len(x), SCORED_ROWS):
            part = x[at : at + SCORED_ROWS]
            owner, row, column, chance = self.cells(part, width[at : at + SCORED_ROWS])
            names += [f"g{i}:{j}" for i, j in zip(row.tolist(), column.tolist())]
            chances.append(chance)
            ends.append(ends[-1][-1] + np.cumsum(np.bincount(owner, minlength=len(part))))
            places.append(self.places.mean(part))
        offsets = pa.array(np.concatenate(ends), pa.int32())
        place = np.concatenate(places) if places else np.zeros((0, 2))
        chance = np.concatenate(chances) if chances else np.zeros(0)
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(offsets, pa.array(names, pa.string())),
                pa.ListArray.from_arrays(offsets, pa.array(chance, pa.float64())),
                pa.array(place[:, 0]),
                pa.array(place[:, 1]),
            ],
            names=["cells", "probabilities", "predicted_latitude", "predicted_longitude"],
        )


_SCORES = (
    "struct<cells: array<string>, probabilities: array<double>,"
    " predicted_latitude: double, predicted_longitude: double>"
)


@dataclass(frozen=True)
class DestinationModel:
    """``manifest`` is the (vin, split, seed) table the model was trained under."""

    scorer: Scorer
    manifest: DataFrame
    grid_size: float
    config_hash: str
    features: tuple[str, ...] = FEATURES
    extra: dict = field(default_factory=dict)

    @cached_property
    def sent(self):
        return self.manifest.sparkSession.sparkContext.broadcast(self.scorer)

    def score(self, samples: DataFrame, top_k: Column | int = 5) -> DataFrame:
        """Samples with ``cells`` and ``probabilities`` (the beam's, at least ``top_k`` if there
        are so many) and predicted coordinates."""
        sent = self.sent

        @F.arrow_udf(_SCORES)
        def scores(x: pa.Array, k: pa.Array) -> pa.Array:
            wide = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(FEATURES))
            return sent.value.score(wide, k.fill_null(1).to_numpy())

        k = F.lit(top_k) if isinstance(top_k, int) else top_k
        found = samples.withColumn("_scores", scores(_features(), k.cast("int")))
        names = ("cells", "probabilities", "predicted_latitude", "predicted_longitude")
        return found.withColumns({n: F.col(f"_scores.{n}") for n in names}).drop("_scores")

    def predict(self, samples: DataFrame, top_k: Column | int = 5, extra: tuple[str, ...] = ()) -> DataFrame:
        return prediction_rows(self.score(samples, top_k), top_k, self.grid_size, extra)

    def save(self, path: str) -> None:
        spark = self.manifest.sparkSession
        s = self.scorer
        forests = [*s.levels, s.places]
        saved = pa.table(
            {
                "level": pa.array(range(1, len(forests) + 1), pa.int32()),
                **{
                    c: pa.array([getattr(e, c).ravel() for e in forests], pa.list_(t))
                    for c, t in (
                        ("feature", pa.int16()),
                        ("cut", pa.float32()),
                        ("left", pa.int32()),
                        ("value", pa.float64()),
                        ("roots", pa.int32()),
                    )
                },
            }
        )
        spark.createDataFrame(saved).write.mode("overwrite").parquet(f"{path}/forests")
        seen = pa.table({"level": pa.array(range(1, len(s.seen) + 1), pa.int32()), "codes": pa.array(s.seen, pa.list_(pa.int64()))})
        spark.createDataFrame(seen).write.mode("overwrite").parquet(f"{path}/seen")
        save_manifest(self.manifest, path)
        record = {
            "kind": KIND,
            "config_hash": self.config_hash,
            "features": list(self.features),
            "grid_size": self.grid_size,
            "square": [s.tree.row, s.tree.column, s.tree.depth],
            "spark_version": pyspark.__version__,
        }
        _write_json(spark, record, f"{path}/metadata")


def _write_json(spark: SparkSession, record: dict, path: str) -> None:
    row = spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def save_manifest(manifest: DataFrame, path: str) -> None:
    """The split manifest of a model saved at ``path``, with its facts. Needs no trees."""
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    _write_json(manifest.sparkSession, manifest_facts(manifest), f"{path}/manifest_record")


def load_manifest(spark: SparkSession, path: str, recorded: dict | None = None) -> DataFrame:
    """The manifest of a saved model, if it is the recorded one."""
    if recorded is None:
        recorded = json.loads(spark.read.text(f"{path}/manifest_record").first()["value"])
    manifest = spark.read.parquet(f"{path}/manifest")
    check_manifest(manifest_facts(manifest), recorded)
    return manifest


def manifest_facts(manifest: DataFrame) -> dict:
    """Counts of a split manifest and a hash of its rows in any order."""
    per_vin = manifest.groupBy("vin").agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("rows"))
    row = F.xxhash64("vin", "split", F.col("seed").cast("bigint"))
    facts = manifest.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "validation").alias("validation"),
        F.count_if(F.col("split") == "test").alias("test"),
        F.collect_set("seed").alias("seeds"),
        F.sum(row.cast("decimal(38,0)")).cast("string").alias("hash"),
    ).first()
    shared = per_vin.filter("splits > 1 or rows > 1 or vin is null").count()
    return {**facts.asDict(), "seeds": sorted(facts["seeds"])[:2], "shared": shared}


def check_manifest(facts: dict, recorded: dict | None = None) -> None:
    """Refuse a manifest whose splits overlap, that lacks one, or that is not the recorded one."""
    if facts["shared"]:
        raise ValueError(f"{facts['shared']} vehicles are missing a name or stand in the manifest twice")
    known = facts["train"] + facts["validation"] + facts["test"]
    if known != facts["rows"]:
        raise ValueError(f"{facts['rows'] - known} manifest rows have an unknown split")
    if not facts["train"]:
        raise ValueError("The manifest has no training vehicle")
    if len(facts["seeds"]) != 1:
        raise ValueError("The manifest rows do not share one seed")
    if recorded is not None and facts != recorded:
        raise ValueError("The manifest is not the one the model was trained under")


def load_model(spark: SparkSession, path: str) -> DestinationModel:
    record = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    if record.get("kind") != KIND:
        raise TypeError(f"Not a saved destination model: {path}")
    if tuple(record["features"]) != FEATURES:
        raise ValueError("The saved feature list does not match this version")
    # Models saved before had the facts among their own.
    manifest = load_manifest(spark, path, record.get("manifest"))
    forests = spark.read.parquet(f"{path}/forests").orderBy("level").toArrow()
    columns = {c: [v.values.to_numpy() for v in forests.column(c)] for c in forests.column_names if c != "level"}
    made = [
        Ensemble(f, c, l, v.reshape(len(f), -1), r)
        for f, c, l, v, r in zip(*[columns[c] for c in ("feature", "cut", "left", "value", "roots")])
    ]
    seen = spark.read.parquet(f"{path}/seen").orderBy("level").toArrow().column("codes")
    tree = Quadtree(*record["square"], float(record["grid_size"]))
    scorer = Scorer(tree, made[:-1], made[-1], [v.values.to_numpy() for v in seen])
    return DestinationModel(scorer, manifest, float(record["grid_size"]), record["config_hash"])


def _square(training: DataFrame, grid_size: float):
    """The smallest square of a power of two that holds all training cells, and the centre of
    the destinations in fine units."""
    lat, lon = F.col("actual_latitude"), F.col("actual_longitude")
    row, column = grid_row(lat, grid_size), grid_column(lon, grid_size)
    parts = {"row": row, "column": column, "lat": F.round(lat * FINE), "lon": F.round(lon * FINE)}
    edges = [f(c).cast("bigint").alias(f"{n}_{name}") for name, c in parts.items() for n, f in (("min", F.min), ("max", F.max))]
    e = training.agg(*edges).first()
    span = max(e["max_row"] - e["min_row"], e["max_column"] - e["min_column"]) + 1
    square = Quadtree(e["min_row"], e["min_column"], max(1, (span - 1).bit_length()), grid_size)
    return square, ((e["min_lat"] + e["max_lat"]) // 2, (e["min_lon"] + e["max_lon"]) // 2)


def training_table(training: DataFrame, square: Quadtree, centre: tuple[int, int], cfg: ForestSettings) -> DataFrame:
    """What trees read, staged: features, the cell within the square, the destination, the hash
    the bootstrap draws by, and for each tree the weight of the row's cell."""
    trees = F.sequence(F.lit(0), F.lit(cfg.trees - 1))
    fixed = F.round(F.col("class_weight") * bootstrap.UNIT).cast("bigint")
    weights = (
        bootstrap.balanced_weights(training, cfg.trees, cfg.seed)
        .groupBy("actual_cell")
        .agg(F.map_from_entries(F.collect_list(F.struct("tree", F.greatest(fixed, F.lit(1))))).alias("of_tree"))
        .select(
            F.col("actual_cell").alias("cell"),
            F.transform(trees, lambda t: F.coalesce(F.try_element_at("of_tree", t), F.lit(0).cast("bigint"))).alias("balance"),
        )
    )
    lat, lon = F.col("actual_latitude"), F.col("actual_longitude")
    rows = training.join(stage(weights, "balance"), F.col("actual_cell") == F.col("cell")).select(
        bootstrap.row_key("sample_id").alias("key"),
        _features().alias("x"),
        (grid_row(lat, square.grid_size) - square.row).alias("row"),
        (grid_column(lon, square.grid_size) - square.column).alias("column"),
        (F.round(lat * FINE).cast("bigint") - centre[0]).alias("lat"),
        (F.round(lon * FINE).cast("bigint") - centre[1]).alias("lon"),
        "balance",
    )
    # Every pass reads the table, and all rows cost alike: one file a core, of as many rows each,
    # so that no core waits for others. Drawn from many ranges, for a range is only about even.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # Rows of one cell lie together: their weights are equal and take next to no room.
    ranges = rows.repartitionByRange(RANGES * cores, "row", "column", "key").sortWithinPartitions("row", "column")
    return stage(ranges.coalesce(cores), "training")


def _seen(table: DataFrame, square: Quadtree) -> list[np.ndarray]:
    """Codes of the training cells, level by level, while their number stays bounded."""
    code = F.lit(0).cast("bigint")
    codes = []
    for level in range(1, square.depth + 1):
        shift = square.depth - level
        row, column = F.shiftright("row", shift), F.shiftright("column", shift)
        code = code * 4 + row % 2 * 2 + column % 2
        codes.append(F.struct(F.lit(level).alias("level"), code.alias("code")))
    cells = stage(
        table.select("row", "column").distinct().select(F.explode(F.array(*codes)).alias("c")).select("c.*").distinct(), "seen"
    )
    counts = {r["level"]: r["count"] for r in cells.groupBy("level").count().collect()}
    told, room = 0, MOST_CELLS
    while told < square.depth and counts[told + 1] <= room:
        told += 1
        room -= counts[told]
    listed = cells.filter(F.col("level") <= told).toPandas()
    return [np.sort(listed.loc[listed["level"] == k, "code"].to_numpy()) for k in range(1, told + 1)]


def train(
    samples: DataFrame, manifest: DataFrame, cfg: ForestSettings, grid_size: float, config_hash: str = ""
) -> DestinationModel:
    """Fit on the training split. Trees grow level by level over all executors."""
    training = samples.filter("split = 'train'")
    if training.select("actual_cell").distinct().limit(2).count() < 2:
        raise ValueError("Classification requires at least two training cells")
    square, centre = _square(training, grid_size)
    table = training_table(training, square, centre, cfg)
    levels = [
        LevelProblem(square, level, cfg.trees, cfg.level_leaves, cfg.seed) for level in range(1, square.depth + 1)
    ]
    problems = [*levels, PlaceProblem(cfg.trees, cfg.max_leaves)]
    grown = grow(table, rows_of, problems, cfg.seed, cfg.depth, cfg.min_samples_leaf)

    def shares(sums: np.ndarray) -> np.ndarray:
        # A tree that drew no row at all has no opinion.
        weight = sums[:, 1:2]
        return np.where(weight > 0, sums[:, 2 : 2 + OUTPUTS] / np.maximum(weight, 1), 1 / OUTPUTS)

    def places(sums: np.ndarray) -> np.ndarray:
        return (sums[:, 2:4] / sums[:, :1] + np.array(centre)) / FINE

    forests = [Ensemble.of(trees, shares) for trees in grown[:-1]]
    scorer = Scorer(square, forests, Ensemble.of(grown[-1], places), _seen(table, square))
    return DestinationModel(scorer, manifest, grid_size, config_hash)
