"""Trees grown over a table against the same growth on whole arrays; bootstrap; beam search."""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripweave.models import bootstrap
from tripweave.models.forest import Quadtree, Scorer, check_manifest, manifest_facts
from tripweave.models.trees import OUTPUTS, Ensemble, Problem, drawn_cuts, drawn_features, gains, grow


@dataclass
class Plain(Problem):
    trees: int
    drawn: int
    max_leaves: int
    outputs: int
    features: int = 4

    def matrix(self, rows):
        return rows["x"]

    def targets(self, rows):
        return rows["y"][:, : self.outputs]

    def weights(self, rows, tree):
        return (rows["key"] * (2 * tree + 3)) % 4


def rows_of(batch: pa.RecordBatch):
    wide = lambda c: batch.column(c).flatten().to_numpy().reshape(batch.num_rows, 4)
    return {"x": wide("x"), "y": wide("y"), "key": batch.column("key").to_numpy()}


def arrays(n, seed, classes):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).astype(np.float32)
    x[:, 3] = rng.integers(0, 2, n)
    x[: n // 2, 2] = 1.5
    if classes:
        y = np.eye(4, dtype=np.int64)[rng.integers(0, 4, n)]
    else:
        y = np.concatenate([(x[:, :2] * 1000).astype(np.int64), np.zeros((n, 2), np.int64)], axis=1)
        y[:, 0] += rng.integers(-200, 200, n)
    return {"x": x, "y": y, "key": np.arange(n)}


def grown_by_hand(rows, problem, seed, g, max_depth, min_leaf):
    """One tree, node by node; the same draws, whole arrays, no passes."""
    w = problem.weights(rows, g)
    x, y = rows["x"], rows["y"]
    feature, cut, left, members, attempts = [0], [math.inf], [0], [np.flatnonzero(w > 0)], [0]
    open_nodes, leaves, depth = [0], 1, 0

    def sums(at):
        out = np.zeros(2 + OUTPUTS, np.int64)
        out[0], out[1] = len(at), w[at].sum()
        out[2 : 2 + problem.outputs] = (w[at, None] * y[at, : problem.outputs]).sum(axis=0)
        return out

    for _ in range(max_depth * 3):
        found, again = [], []
        for node in open_nodes:
            at, one = members[node], np.array([node])
            f = drawn_features(seed, g, one, np.array([attempts[node]]), 4, problem.drawn)
            if not len(at):
                continue
            low, high = x[at][:, f[0]].min(axis=0)[None, :], x[at][:, f[0]].max(axis=0)[None, :]
            c = drawn_cuts(seed, g, one, np.array([attempts[node]]), f, low, high)
            best = None
            for j in range(f.shape[1]):
                below = at[x[at, f[0, j]] < c[0, j]]
                if len(below):
                    gain = gains(sums(below)[None, :], sums(at)[None, :], min_leaf)[0]
                    if gain >= 0 and (best is None or gain > best[0]):
                        best = (gain, j, below)
            if best:
                found.append((node, best, f[0], c[0]))
            elif np.isnan(c).all() and attempts[node] + 1 < 3:
                attempts[node] += 1
                again.append(node)
        room = problem.max_leaves - leaves
        if len(found) > room:
            kept = sorted(range(len(found)), key=lambda k: (-found[k][1][0], k))[:room]
            found = [found[k] for k in sorted(kept)]
        fresh = []
        for node, (_, j, below), f, c in found:
            feature[node], cut[node], left[node] = f[j], c[j], len(left)
            for part in (below, np.setdiff1d(members[node], below)):
                fresh.append(len(left))
                feature.append(0), cut.append(math.inf), left.append(len(left)), members.append(part), attempts.append(0)
        leaves += len(found)
        depth += bool(found)
        if depth >= max_depth or leaves >= problem.max_leaves:
            break
        pure = lambda s: problem.outputs == OUTPUTS and s[2:].max() == s[1]
        open_nodes = again + [k for k in fresh if len(members[k]) >= 2 * min_leaf and not pure(sums(members[k]))]
        if not open_nodes:
            break
    return feature, cut, left, [sums(m) for m in members]


@pytest.mark.parametrize("outputs,drawn,max_leaves,min_leaf", [(2, 4, 64, 1), (2, 4, 9, 3), (4, 2, 64, 1), (4, 1, 12, 2)])
def test_trees_equal_growth_on_whole_arrays(spark, outputs, drawn, max_leaves, min_leaf):
    rows = arrays(120, 3, outputs == 4)
    problem = Plain(3, drawn, max_leaves, outputs)
    made = [(int(k), x.tolist(), y.tolist()) for k, x, y in zip(rows["key"], rows["x"], rows["y"])]
    table = spark.createDataFrame(made, "key long, x array<float>, y array<long>")
    for parts in (1, 5):
        grown = grow(table.repartition(parts), rows_of, [problem, problem], 7, 12, min_leaf)
        for g, tree in enumerate([*grown[0], *grown[1]]):
            here = Plain(3, drawn, max_leaves, outputs)
            here.weights = lambda r, t, p=problem: p.weights(r, t % 3)
            feature, cut, left, sums = grown_by_hand(rows, here, 7, g, 12, min_leaf)
            assert tree.left.tolist() == left
            assert tree.feature.tolist() == feature and np.array_equal(tree.cut, np.float32(cut))
            assert tree.sums.tolist() == [s.tolist() for s in sums]
            assert tree.leaves <= max_leaves and len(left) == 2 * tree.leaves - 1


def test_a_forest_fits_and_averages(spark):
    rows = arrays(400, 5, False)
    made = [(int(k), x.tolist(), y.tolist()) for k, x, y in zip(rows["key"], rows["x"], rows["y"])]
    table = spark.createDataFrame(made, "key long, x array<float>, y array<long>").repartition(3)
    problem = Plain(20, 4, 64, 2)
    trees = grow(table, rows_of, [problem], 1, 30, 1)[0]
    joined = Ensemble.of(trees, lambda s: s[:, 2:4] / s[:, 1:2])
    guess = joined.mean(rows["x"])
    by_hand = np.mean([(t.sums[:, 2:4] / t.sums[:, 1:2])[t.descend(rows["x"])] for t in trees], axis=0)
    assert np.allclose(guess, by_hand)
    left = ((guess - rows["y"][:, :2]) ** 2).sum()
    assert left < 0.25 * ((rows["y"][:, :2] - rows["y"][:, :2].mean(axis=0)) ** 2).sum()


def test_draws_are_poisson_and_equal_in_both_forms(spark):
    keys = np.arange(20_000, dtype=np.int64) * 214_013 % 2**32
    frame = spark.createDataFrame([(int(k),) for k in keys], "key long")
    here = np.stack([bootstrap.draws_of(keys, t, 42) for t in range(4)])
    there = frame.select(*[bootstrap.draws(F.col("key"), F.lit(t), 42).alias(f"t{t}") for t in range(4)]).toPandas()
    assert (there.to_numpy().T == here).all()
    for row in here:
        shares = np.bincount(row, minlength=4)[:4] / len(row)
        assert np.allclose(shares, [math.exp(-1) / math.factorial(k) for k in range(4)], atol=0.015)
    assert abs(np.corrcoef(here)[np.triu_indices(4, 1)]).max() < 0.03


def test_cells_weigh_alike_within_a_tree(spark):
    made = [(f"s{i}", "a" if i % 10 else "b") for i in range(500)]
    weights = bootstrap.balanced_weights(spark.createDataFrame(made, "sample_id string, actual_cell string"), 5, 1)
    for r in weights.groupBy("tree").agg(F.collect_list(F.col("drawn") * F.col("class_weight")).alias("w")).collect():
        assert len(r.w) == 2 and r.w[0] == pytest.approx(r.w[1])


class Fixed:
    """Stands in for a forest: shares of the quarters by the last two features."""

    def __init__(self, seed):
        self.seed = seed

    def mean(self, x):
        u = np.abs(np.sin((x[:, -2:].sum(axis=1) + self.seed)[:, None] * np.array([1.1, 2.3, 3.7, 5.9])))
        return u / u.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("width", [3, 64])
def test_beam_search_finds_the_most_probable_known_cells(width):
    tree = Quadtree(100, 200, 3, 0.01)
    rng = np.random.default_rng(3)
    known = sorted(rng.choice(64, 20, replace=False))
    seen = [np.unique(np.array(known) >> (2 * (3 - level))) for level in (1, 2, 3)]
    scorer = Scorer(tree, [Fixed(k) for k in range(3)], Fixed(0), seen)
    x = rng.normal(size=(5, 2)).astype(np.float32)
    owner, row, column, chance = scorer.cells(x, np.full(5, width))

    def walk(level, code, r, c, p, out):
        if level == 3:
            out[(100 + r, 200 + c)] = p
            return
        share = scorer.levels[level].mean(tree.centre(np.array([r]), np.array([c]), level))[0]
        share = np.array([s if code * 4 + q in seen[level] else 0 for q, s in enumerate(share)])
        for q in np.flatnonzero(share):
            walk(level + 1, code * 4 + q, 2 * r + q // 2, 2 * c + q % 2, p * share[q] / share.sum(), out)

    exact: dict = {}
    walk(0, 0, 0, 0, 1.0, exact)
    assert len(exact) == 20
    for i in range(5):
        got = {(r, c): p for o, r, c, p in zip(owner, row, column, chance) if o == i}
        assert len(got) == min(width, 20) and set(got) <= set(exact)
        assert all(got[k] == pytest.approx(exact[k]) for k in got)
        if width >= 20:
            assert sum(got.values()) == pytest.approx(1)


def test_manifests_prove_themselves(spark):
    def facts(rows):
        return manifest_facts(spark.createDataFrame(rows, "vin string, split string, seed int"))

    sound = [("a", "train", 1), ("b", "train", 1), ("c", "validation", 1), ("d", "test", 1)]
    recorded = facts(sound)
    check_manifest(facts(sound[::-1]), recorded)
    for rows, what in (
        ([*sound, ("a", "test", 1)], "twice"),
        ([*sound, (None, "test", 1)], "missing a name"),
        ([*sound[:3], ("d", "other", 1)], "unknown split"),
        ([sound[3]], "no training vehicle"),
        ([*sound[:3], ("d", "test", 2)], "one seed"),
        ([*sound[:2], ("c", "test", 1), ("d", "validation", 1)], "not the one"),
        (sound[:3], "not the one"),
    ):
        with pytest.raises(ValueError, match=what):
            check_manifest(facts(rows), recorded)
