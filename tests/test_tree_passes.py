"""The passes over rows that grow trees: their short cuts give what plain sums give."""

import numpy as np
import pytest

from tripweave.models.trees import Tree, _counted, grow, walk
from tests.test_trees import Plain, arrays, rows_of


class ByClass(Plain):
    def classes(self, rows):
        return rows["y"].argmax(axis=1)


def test_targets_of_one_class_add_up_as_numbers_do(spark):
    rows = arrays(300, 11, True)
    made = [(int(k), x.tolist(), y.tolist()) for k, x, y in zip(rows["key"], rows["x"], rows["y"])]
    table = spark.createDataFrame(made, "key long, x array<float>, y array<long>").repartition(3)
    numbers, classes = grow(table, rows_of, [Plain(4, 2, 40, 4), ByClass(4, 2, 40, 4)], 7, 12, 1)
    alone = grow(table, rows_of, [Plain(4, 2, 40, 4), Plain(4, 2, 40, 4)], 7, 12, 1)
    for a, b in zip(numbers + classes, alone[0] + alone[1]):
        assert a.left.tolist() == b.left.tolist() and a.sums.tolist() == b.sums.tolist()
        assert a.feature.tolist() == b.feature.tolist() and np.array_equal(a.cut, b.cut)


@pytest.mark.parametrize("most", [9, 2**51, 2**60])
def test_weights_add_up_exactly_beyond_doubles(most):
    rng = np.random.default_rng(2)
    key, weights = rng.integers(0, 3, 5), rng.integers(most - 8, most, 5)
    assert _counted(key, weights, 3).tolist() == [sum(int(w) for w in weights[key == k]) for k in range(3)]


def test_rows_that_stand_still_leave_the_walk():
    # A chain: the first feature peels off one row in eight at each node.
    n = 40
    tree = Tree(
        np.zeros(2 * n + 1, np.int32),
        np.array([k + 1 if i == 0 else np.inf for k in range(n) for i in (0, 1)] + [np.inf], np.float32),
        np.array([2 * k + 1 if i == 0 else 2 * k + 1 for k in range(n) for i in (0, 1)] + [2 * n], np.int32),
    )
    x = np.random.default_rng(4).integers(0, n + 3, (500, 2)).astype(np.float32)
    slow = np.zeros(len(x), np.int64)
    for _ in range(n):
        slow = tree.left[slow] + (x[np.arange(len(x)), tree.feature[slow]] >= tree.cut[slow])
    assert tree.descend(x).tolist() == slow.tolist()
    some = np.array([3, 5, 499])
    assert walk(tree.feature, tree.cut, tree.left, x.T.copy(), some, 0).tolist() == slow[some].tolist()
    assert len(tree.descend(x[:0])) == 0


def test_every_core_reads_as_many_training_rows(spark):
    from pyspark.sql import functions as F
    from tripweave.config import ForestSettings
    from tripweave.models import forest
    from tripweave.schema import FEATURES

    part = (F.xxhash64("id") % 1000) / 50_000
    training = spark.range(0, 700_000, 1, 8).select(
        F.col("id").cast("string").alias("sample_id"), *[F.lit(1.0).alias(f) for f in FEATURES],
        (48.2 + part).alias("actual_latitude"), (2.1 + part * part).alias("actual_longitude"),
        F.concat(F.lit("g"), F.floor(part * 100).cast("string")).alias("actual_cell"),
    )
    square, centre = forest._square(training, 0.01)
    table = forest.training_table(training, square, centre, ForestSettings(trees=10))
    held = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 700_000
    assert len(held) == spark.sparkContext.defaultParallelism and max(held) * len(held) <= 1.3 * sum(held)


def test_small_batches_are_worked_on_together(monkeypatch):
    import pyarrow as pa
    from tripweave.models import trees

    rows = arrays(300, 11, True)
    table = pa.table({"key": rows["key"].astype(np.int64), "x": rows["x"].tolist(), "y": rows["y"].tolist()})
    table = table.set_column(1, "x", table["x"].cast(pa.list_(pa.float32())))
    nodes, problem = np.zeros(1, np.int64), Plain(4, 2, 40, 4)
    growths = {
        g: trees.Growth(0, Tree(), nodes, nodes, trees.drawn_features(7, g, nodes, nodes, problem.features, problem.drawn))
        for g in range(problem.trees)
    }
    seen = []

    def counted(batch):
        seen.append(batch.num_rows)
        return rows_of(batch)

    run = trees._ranges([(problem, 0)], counted)
    apart = list(run(iter(table.to_batches(max_chunksize=7)), growths))
    assert seen == [300]
    monkeypatch.setattr(trees, "JOINED_ROWS", 100)
    again = list(run(iter(table.to_batches(max_chunksize=7)), growths))
    assert seen[1:] == [105, 105, 90] and again == apart
    assert list(trees._joined(iter([]), 100)) == []


@pytest.mark.parametrize("inner, features", [(1, 3), (14, 3), (15, 3), (16, 3), (300, 4)])
def test_the_top_of_a_tree_sends_rows_where_a_plain_walk_does(inner, features):
    from tripweave.models import trees

    rng = np.random.default_rng(inner)
    tree = Tree(*(np.array([v], t) for v, t in ((0, np.int32), (np.inf, np.float32), (0, np.int32))))
    for _ in range(inner):
        node = rng.choice(np.flatnonzero(tree.left == np.arange(len(tree.left))))
        size = len(tree.left)
        tree.feature[node], tree.cut[node], tree.left[node] = rng.integers(0, features), rng.random(), size
        tree.feature = np.concatenate([tree.feature, np.zeros(2, np.int32)])
        tree.cut = np.concatenate([tree.cut, np.full(2, np.inf, np.float32)])
        tree.left = np.concatenate([tree.left, np.arange(size, size + 2, dtype=np.int32)])
    x = rng.random((2 * trees.TOP_ROWS, features)).astype(np.float32)
    x[::97, 0] = np.nan
    slow = np.zeros(len(x), np.int64)
    for _ in range(inner):
        slow = tree.left[slow] + (x[np.arange(len(x)), tree.feature[slow]] >= tree.cut[slow])
    assert tree.descend(x).tolist() == slow.tolist()
    ends, place = trees._top(tree.feature, tree.cut, tree.left, x.T.copy(), 0)
    assert len(ends) == min(inner, trees.TOP_NODES) + 1 and len(place) == len(x)


def test_a_task_sends_one_row_for_each_tree():
    import pyarrow as pa
    from tripweave.models import trees

    rows = arrays(300, 11, True)
    table = pa.table({"key": rows["key"].astype(np.int64), "x": rows["x"].tolist(), "y": rows["y"].tolist()})
    table = table.set_column(1, "x", table["x"].cast(pa.list_(pa.float32())))
    nodes, problem = np.zeros(1, np.int64), Plain(4, 2, 40, 4)
    growths = {
        g: trees.Growth(0, Tree(), nodes, nodes, trees.drawn_features(7, g, nodes, nodes, problem.features, problem.drawn))
        for g in range(problem.trees)
    }
    found = list(trees._ranges([(problem, 0)], rows_of)(iter(table.to_batches()), growths))
    assert [b.num_rows for b in found] == [problem.trees]
    cuts = {g: f["cuts"] for g, f in trees._arrays(trees._cuts_of(iter(found), growths, 7))}
    for g, growth in growths.items():
        growth.cuts = cuts[g].reshape(growth.feature.shape)
    # Two tasks of the same rows: twice the sums, the same choice.
    parts = list(trees._left_sums([(problem, 0)], rows_of)(iter(table.to_batches()), growths))
    assert [b.num_rows for b in parts] == [problem.trees]
    once, twice = (dict(trees._arrays(trees._best_cuts(iter(parts * n), growths, 1))) for n in (1, 2))
    for g in growths:
        assert (2 * once[g]["total"] == twice[g]["total"]).all() and (2 * once[g]["left"] == twice[g]["left"]).all()
        assert (once[g]["place"] == twice[g]["place"]).all()


def test_a_sent_tree_leaves_its_sums_behind():
    import pickle
    from tripweave.models import trees

    nodes = np.zeros(1, np.int64)
    growth = trees.Growth(0, Tree(), nodes, nodes, np.zeros((1, 2), np.int32))
    sent = pickle.loads(pickle.dumps(growth))
    assert len(sent.tree.sums) == 0 and len(growth.tree.sums) == 1
    assert sent.tree.left.tolist() == [0] and sent.feature.tolist() == growth.feature.tolist()


def test_rows_and_weights_add_up_as_one_sum_where_they_fit():
    from tripweave.models.trees import _fits

    assert _fits(np.array([3, 5])) == 16 and _fits(np.array([2**52, 2**51])) is None
    assert _fits(np.array([2**40] * 9)) == 2**44 and _fits(np.array([2**50, 1, 1])) is None
