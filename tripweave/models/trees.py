"""Trees grown level by level over a distributed table.

A pass over the rows gives, for every tree, partial sums of its open nodes and their features: a
row of arrays from each task, added up by tree. The driver sees the best cut of each node. Two passes make a
level: the range of each drawn feature within each node, then the sums on the left of one cut
drawn in that range. All trees of all problems grow in the same passes.

Everything added up is a whole number, so a model does not depend on partitions or their
order. A cut's gain is the fall of ``sum of squares / weight`` over all outputs: joint variance
where outputs are coordinates, Gini impurity where they are weights of classes.

What is held at once is bounded by settings: trees, leaves of a tree, drawn features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: How often a node whose drawn features were all constant draws again.
ATTEMPTS = 3
#: Outputs of a problem, at most: columns of a pass.
OUTPUTS = 4
#: Rows that a pass works on at once: what it does for each tree and node is paid once for them.
JOINED_ROWS = 40_000
#: Inner nodes at the top of a tree that are asked of all rows at once, and the rows that repay it.
TOP_NODES, TOP_ROWS = 15, 2_048
#: A gain below this share of the node's own sum is rounding.
LEAST_GAIN = 1e-12


class Problem:
    """What a group of trees learns. ``matrix``, ``targets`` and ``weights`` read one batch."""

    features: int
    drawn: int
    outputs: int
    trees: int
    max_leaves: int

    def matrix(self, rows: dict) -> np.ndarray:
        """Rows x features, single precision."""
        raise NotImplementedError

    def targets(self, rows: dict) -> np.ndarray:
        """Rows x outputs, whole numbers."""
        raise NotImplementedError

    def weights(self, rows: dict, tree: int) -> np.ndarray:
        """Whole numbers; rows of weight 0 are not part of the tree."""
        raise NotImplementedError

    def drawn_rows(self, rows: dict, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are part of the tree, and their weights."""
        weights = self.weights(rows, tree)
        drawn = np.flatnonzero(weights > 0)
        return drawn, weights[drawn]

    def classes(self, rows: dict) -> np.ndarray | None:
        """The one output of each row whose target is 1, where all others are 0; else None."""
        return None


def _top(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, columns: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes just below the top of a tree, and by which of them every row passes.

    Each inner node of the top compares its whole column, and the answers are joined by bits,
    which costs less than to look up every row's node as often as the top is deep.
    """
    inner, level = set(), [root]
    while level and len(inner) < TOP_NODES:
        level = [n for n in level if left[n] != n][: TOP_NODES - len(inner)]
        inner.update(level)
        level = [child for n in level for child in (int(left[n]), int(left[n]) + 1)]
    ends = []

    def passed(node: int):
        if node not in inner:
            ends.append(node)
            return np.uint8(len(ends) - 1)
        a, b = passed(int(left[node])), passed(int(left[node]) + 1)
        right = (columns[feature[node]] >= cut[node]).view(np.uint8)
        np.negative(right, out=right)
        # The bits in which the sides differ, where the row goes right.
        right &= a ^ b
        right ^= a
        return right

    place = passed(root)
    return np.array(ends, np.intp), place


def walk(
    feature: np.ndarray, cut: np.ndarray, left: np.ndarray, columns: np.ndarray, rows: np.ndarray, root: int, top: bool = True
) -> np.ndarray:
    """Leaf that each of ``rows`` comes to from ``root``. ``columns``: features x rows; ``top``: whole columns may be
    asked first.

    Rows that stand still (a leaf is its own left child) leave the loop once they are many.
    """
    left = left.astype(np.intp, copy=False)
    if left[root] == root or not len(rows):
        return np.full(len(rows), root, np.intp)
    if top and len(rows) >= TOP_ROWS and 3 * len(rows) >= columns.shape[1]:
        ends, place = _top(feature, cut, left, columns, root)
        here = ends.take(place.take(rows, mode="clip"), mode="clip")
        if (left[ends] == ends).all():
            return here
    else:
        # All rows read one column at the root.
        here = left[root] + (columns[feature[root]].take(rows, mode="clip") >= cut[root])
    flat, start = columns.ravel(), feature.astype(np.intp) * columns.shape[1]
    node, moving = here, None
    while len(here):
        at = start.take(here, mode="clip")
        at += rows
        then = left.take(here, mode="clip")
        then += flat.take(at, mode="clip") >= cut.take(here, mode="clip")
        moves = then != here
        count = np.count_nonzero(moves)
        if moving is None:
            node = then
        if count < 0.75 * len(here):
            if moving is not None:
                node[moving] = then
            kept = np.flatnonzero(moves)
            moving = kept if moving is None else moving[kept]
            then, rows = then[kept], rows[kept]
        here = then
    return node


@dataclass
class Tree:
    """Node arrays. A leaf is its own left child, by a cut that nothing reaches."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.full(1, np.inf, np.float32))
    left: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    #: Rows, weight and outputs of each node.
    sums: np.ndarray = field(default_factory=lambda: np.zeros((1, 2 + OUTPUTS), np.int64))
    depth: int = 0
    leaves: int = 1

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Node that each row has come to."""
        return self.walk(np.ascontiguousarray(x.T), np.arange(len(x)))

    def walk(self, columns: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return walk(self.feature, self.cut, self.left, columns, rows, 0)


def _mixed(*parts) -> np.ndarray:
    """64 well-spread bits for whole numbers (a chain of bijections)."""
    with np.errstate(over="ignore"):
        h = np.uint64(0)
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def drawn_features(seed: int, tree: int, nodes: np.ndarray, attempts: np.ndarray, features: int, drawn: int) -> np.ndarray:
    """Nodes x drawn features of one tree, without repetition."""
    keys = _mixed(seed, tree, nodes[:, None], attempts[:, None], np.arange(features)[None, :])
    return np.sort(np.argsort(keys, axis=1, kind="stable")[:, :drawn], axis=1).astype(np.int32)


def drawn_cuts(
    seed: int, tree: int, nodes: np.ndarray, attempts: np.ndarray, feature: np.ndarray, low: np.ndarray, high: np.ndarray
) -> np.ndarray:
    """One cut within each range; rows below it go left. A range of one value has none."""
    u = _mixed(seed + 1, tree, nodes[:, None], attempts[:, None], feature).astype(np.float64) / 2.0**64
    wide = low.astype(np.float64) + u * (high.astype(np.float64) - low.astype(np.float64))
    cut = np.where(wide.astype(np.float32) > low, wide.astype(np.float32), high)
    return np.where(low < high, cut, np.float32(np.nan)).astype(np.float32)


@dataclass
class Growth:
    """The open nodes of one tree, as a pass needs them."""

    problem: int
    tree: Tree
    nodes: np.ndarray
    attempts: np.ndarray
    feature: np.ndarray
    cuts: np.ndarray | None = None

    def __getstate__(self) -> dict:
        # No task reads the sums of a tree's nodes.
        return {**self.__dict__, "tree": replace(self.tree, sums=self.tree.sums[:0])}

    def places(self) -> np.ndarray:
        at = np.full(len(self.tree.left), -1, np.int64)
        at[self.nodes] = np.arange(len(self.nodes))
        return at


def _open_rows(growth: Growth, columns: np.ndarray, drawn: np.ndarray):
    """Which of the drawn rows are in open nodes, and in which."""
    at = growth.places()[growth.tree.walk(columns, drawn)]
    found = np.flatnonzero(at >= 0)
    return (None, at) if len(found) == len(at) else (found, at[found])


def _by_node(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by node, the nodes in that order, where each starts, and its rows. Few nodes sort by radix."""
    order = np.argsort(at.astype(np.int16) if at.max() < 2**15 else at, kind="stable")
    counts = np.bincount(at)
    nodes = np.flatnonzero(counts)
    counts = counts[nodes]
    return order, nodes, np.cumsum(counts) - counts, counts


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches joined to ones of at least ``rows`` rows, but for the last."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.concat_batches(held)
            held, count = [], 0
    if count:
        yield pa.concat_batches(held)


def _each_tree(problems, growths, batches, rows_of):
    """(problem, rows, features x rows, growth number, growth, rows in open nodes, their nodes, weights)."""
    for batch in _joined(batches, JOINED_ROWS):
        rows = rows_of(batch)
        for p, (problem, first) in enumerate(problems):
            open_trees = [(g, growth) for g, growth in growths.items() if growth.problem == p]
            if not open_trees:
                continue
            columns = np.ascontiguousarray(problem.matrix(rows).T)
            for g, growth in open_trees:
                drawn, weights = problem.drawn_rows(rows, g - first)
                found, at = _open_rows(growth, columns, drawn)
                if found is not None:
                    drawn, weights = drawn[found], weights[found]
                if len(drawn):
                    yield problem, rows, columns, g, growth, drawn, at, weights


def _values(
    growth: Growth, columns: np.ndarray, place: int, drawn: np.ndarray, at: np.ndarray, counts: np.ndarray | None = None
) -> np.ndarray:
    """Each row's value of its node's drawn feature. Of rows that lie by node, ``at`` holds the nodes
    and ``counts`` their rows."""
    feature = growth.feature[:, place]
    if (feature == feature[0]).all():
        return columns[feature[0]].take(drawn, mode="clip")
    where = (feature.astype(np.intp) * columns.shape[1]).take(at, mode="clip")
    if counts is not None:
        where = where.repeat(counts)
    where += drawn
    return columns.ravel().take(where, mode="clip")


def _lists(parts: list, t: pa.DataType) -> pa.ListArray:
    """A list of each part's values."""
    ends = np.cumsum([0, *[p.size for p in parts]])
    values = np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, t))


def _rows_of_trees(numbers: list[int], lists: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    """A row for each tree: its number, and a list in each column."""
    columns = [pa.array(numbers, pa.int32()), *[_lists(parts, t) for parts, t in lists.values()]]
    return pa.RecordBatch.from_arrays(columns, names=["g", *lists])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The rows of ``_rows_of_trees``: number, and an array for each column."""
    for batch in batches:
        lists = {c: batch.column(c) for c in batch.schema.names if c != "g"}
        ends = {c: v.offsets.to_numpy() for c, v in lists.items()}
        values = {c: v.values.to_numpy() for c, v in lists.items()}
        for i, g in enumerate(batch.column("g").to_pylist()):
            yield g, {c: v[ends[c][i] : ends[c][i + 1]] for c, v in values.items()}


def _ranges(problems: list[tuple[Problem, int]], rows_of):
    """Pass one: least and greatest value of each drawn feature in each open node."""

    def run(batches: Iterator[pa.RecordBatch], growths: dict[int, Growth]) -> Iterator[pa.RecordBatch]:
        low = {g: np.full(w.feature.shape, np.inf, np.float32) for g, w in growths.items()}
        high = {g: np.full(w.feature.shape, -np.inf, np.float32) for g, w in growths.items()}
        for _, _, columns, g, growth, drawn, at, _ in _each_tree(problems, growths, batches, rows_of):
            order, nodes, starts, counts = _by_node(at)
            drawn = drawn.take(order)
            # The places below each other, so that what all batches have is looked up once.
            least, most = np.empty((2, growth.feature.shape[1], len(nodes)), np.float32)
            for place in range(growth.feature.shape[1]):
                values = _values(growth, columns, place, drawn, nodes, counts)
                np.minimum.reduceat(values, starts, out=least[place])
                np.maximum.reduceat(values, starts, out=most[place])
            low[g][nodes] = np.minimum(low[g][nodes], least.T)
            high[g][nodes] = np.maximum(high[g][nodes], most.T)
        found = {g: np.isfinite(low[g]) for g in growths}
        seen = {g: np.flatnonzero(f.any(axis=1)) for g, f in found.items()}
        numbers = [g for g in growths if len(seen[g])]
        lows = [np.where(found[g], low[g], np.float32(np.inf))[seen[g]] for g in numbers]
        highs = [np.where(found[g], high[g], np.float32(-np.inf))[seen[g]] for g in numbers]
        nodes = [seen[g] for g in numbers]
        types = (pa.int32(), pa.float32(), pa.float32())
        yield _rows_of_trees(numbers, dict(zip(("node", "low", "high"), zip((nodes, lows, highs), types))))

    return run


_RANGES = "g int, node array<int>, low array<float>, high array<float>"
_CUTS = "g int, cuts array<float>"


def _cuts_of(batches: Iterator[pa.RecordBatch], growths: dict[int, Growth], seed: int) -> Iterator[pa.RecordBatch]:
    """The cuts of each tree, from the ranges that the tasks found."""
    low, high = {}, {}
    for g, found in _arrays(batches):
        shape = growths[g].feature.shape
        if g not in low:
            low[g], high[g] = np.full(shape, np.inf, np.float32), np.full(shape, -np.inf, np.float32)
        at = found["node"]
        low[g][at] = np.minimum(low[g][at], found["low"].reshape(len(at), -1))
        high[g][at] = np.maximum(high[g][at], found["high"].reshape(len(at), -1))
    made = []
    for g, growth in ((g, growths[g]) for g in low):
        none = low[g] == np.inf
        low[g][none] = high[g][none] = 0
        made.append(drawn_cuts(seed, g, growth.nodes, growth.attempts, growth.feature, low[g], high[g]))
    yield _rows_of_trees(list(low), {"cuts": (made, pa.float32())})


def _add_numbers(growth, problem, rows, columns, drawn, at, weights, left, whole) -> None:
    """Add rows with any whole numbers as targets, sorted by node."""
    order, nodes, starts, counts = _by_node(at)
    drawn, weights = drawn.take(order), weights.take(order)
    parts = [np.ones(len(at), np.int64)]
    unit = bool((weights == 1).all())
    targets = problem.targets(rows)
    if not unit:
        parts.append(weights)
    parts += [targets[:, k].take(drawn) * (1 if unit else weights) for k in range(problem.outputs)]
    # Rows of weight 1 have one sum for rows and weight.
    into = [(0, 1) if unit else (0,)] + [(k,) for k in range(2 if unit else 1, 2 + problem.outputs)]
    for part, ks in zip(parts, into):
        sums = np.add.reduceat(part, starts)
        for k in ks:
            whole[nodes, k] += sums
    made = np.empty((len(parts), growth.feature.shape[1], len(nodes)), np.int64)
    cuts = growth.cuts[nodes]
    for place in range(growth.feature.shape[1]):
        below = _values(growth, columns, place, drawn, nodes, counts) < cuts[:, place].repeat(counts)
        below = below.astype(np.int64)  # once, not for each part
        for i, part in enumerate(parts):
            np.add.reduceat(below * part if i else below, starts, out=made[i, place])
    # The places below each other, so that what all batches have is looked up once.
    for sums, ks in zip(made, into):
        for k in ks:
            left[nodes, :, k] += sums.T


def _fits(weights: np.ndarray) -> int | None:
    """A power of two above the sum of the weights, if as many of it as there are rows add up exactly in doubles."""
    total = int(weights.max()) * len(weights)
    if total >= 2**53:
        return None
    unit = 1 << int(weights.sum()).bit_length()
    return unit if unit * (len(weights) + 1) < 2**53 else None


def _counted(key: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole weights by key: in doubles, of halves of the bits where they may not fit."""
    if int(weights.max()) * len(weights) < 2**53:
        return np.bincount(key, weights, size).astype(np.int64)
    high, low = weights >> 26, weights & (2**26 - 1)
    return (np.bincount(key, high, size).astype(np.int64) << 26) + np.bincount(key, low, size).astype(np.int64)


def _add_classes(growth, problem, classes, columns, drawn, at, weights, left, whole) -> None:
    """Add rows whose targets are 1 for one class and 0 for the others, by (node, side, class)."""
    n, outputs = len(growth.nodes), problem.outputs
    cell = at * (2 * outputs)
    cell += classes.take(drawn)
    unit = _fits(weights)
    if unit:
        # A row adds its weight and, above all weights, one unit: both sums are one.
        counting = weights.astype(np.float64)
        counting += unit
    elif int(weights.max()) * len(weights) < 2**53:
        weights = weights.astype(np.float64)  # once, not for each place
    for place in range(growth.feature.shape[1]):
        below = _values(growth, columns, place, drawn, at) < growth.cuts[:, place].take(at, mode="clip")
        key = cell + below.view(np.uint8) * np.uint8(outputs)
        if unit:
            both = np.bincount(key, counting, 2 * outputs * n).astype(np.int64).reshape(n, 2, outputs)
            rows, sums = (both >> (unit.bit_length() - 1)).sum(axis=2), both & (unit - 1)
        else:
            rows = np.bincount(key, minlength=2 * outputs * n).reshape(n, 2, outputs).sum(axis=2)
            sums = _counted(key, weights, 2 * outputs * n).reshape(n, 2, outputs)
        left[:, place, 0] += rows[:, 1]
        left[:, place, 1] += sums[:, 1].sum(axis=1)
        left[:, place, 2 : 2 + outputs] += sums[:, 1]
        if place == 0:
            whole[:, 0] += rows.sum(axis=1)
            whole[:, 1] += sums.sum(axis=(1, 2))
            whole[:, 2 : 2 + outputs] += sums.sum(axis=1)


def _left_sums(problems: list[tuple[Problem, int]], rows_of):
    """Pass two: rows, weight and outputs left of each cut, and of the node."""

    def run(batches: Iterator[pa.RecordBatch], growths: dict[int, Growth]) -> Iterator[pa.RecordBatch]:
        left = {g: np.zeros((*w.feature.shape, 2 + OUTPUTS), np.int64) for g, w in growths.items()}
        whole = {g: np.zeros((len(w.nodes), 2 + OUTPUTS), np.int64) for g, w in growths.items()}
        of = None
        for problem, rows, columns, g, growth, drawn, at, weights in _each_tree(problems, growths, batches, rows_of):
            if of is None or of[0] is not rows or of[1] is not problem:
                of, classes = (rows, problem), problem.classes(rows)
            add = _add_numbers if classes is None else _add_classes
            add(growth, problem, rows if classes is None else classes, columns, drawn, at, weights, left[g], whole[g])
        seen = {g: np.flatnonzero(whole[g][:, 0]) for g in growths}
        numbers = [g for g in growths if len(seen[g])]
        yield _rows_of_trees(
            numbers,
            {
                "node": ([seen[g] for g in numbers], pa.int32()),
                "left": ([left[g][seen[g]] for g in numbers], pa.int64()),
                "total": ([whole[g][seen[g]] for g in numbers], pa.int64()),
            },
        )

    return run


_SUMS = "g int, node array<int>, left array<bigint>, total array<bigint>"
_JUDGED = "g int, node array<int>, place array<int>, gain array<double>, left array<bigint>, total array<bigint>"


def gains(left: np.ndarray, total: np.ndarray, min_leaf: int) -> np.ndarray:
    """Gain of each cut from rows, weight and outputs on its left and in all; -1 for none."""
    right = total - left
    l, r, t = (side.astype(np.float64) for side in (left, right, total))
    with np.errstate(invalid="ignore", divide="ignore"):
        split = (l[:, 2:] ** 2).sum(axis=1) / l[:, 1] + (r[:, 2:] ** 2).sum(axis=1) / r[:, 1]
        gain = split - (t[:, 2:] ** 2).sum(axis=1) / t[:, 1]
    sound = (left[:, 0] >= min_leaf) & (right[:, 0] >= min_leaf) & (gain > split * LEAST_GAIN)
    return np.where(sound, gain, -1.0)


def _best_cuts(batches: Iterator[pa.RecordBatch], growths: dict[int, Growth], min_leaf: int) -> Iterator[pa.RecordBatch]:
    """Totals of each open node, and the cut of the greatest gain (the first of equals; gain -1 for none)."""
    lefts, totals = {}, {}
    for g, found in _arrays(batches):
        shape = growths[g].feature.shape
        if g not in lefts:
            lefts[g] = np.zeros((*shape, 2 + OUTPUTS), np.int64)
            totals[g] = np.zeros((shape[0], 2 + OUTPUTS), np.int64)
        at = found["node"]
        lefts[g][at] += found["left"].reshape(len(at), *lefts[g].shape[1:])
        totals[g][at] += found["total"].reshape(len(at), -1)
    made = {c: [] for c in ("node", "place", "gain", "left", "total")}
    for g, total in totals.items():
        node = np.flatnonzero(total[:, 0])
        left, total = lefts[g][node], total[node]
        places = left.shape[1]
        gain = gains(left.reshape(-1, 2 + OUTPUTS), total.repeat(places, axis=0), min_leaf).reshape(-1, places)
        place = gain.argmax(axis=1)
        best = np.arange(len(node)), place
        for c, part in zip(made, (node, place, gain[best], left[best], total)):
            made[c].append(part)
    types = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
    yield _rows_of_trees(list(totals), {c: (parts, t) for (c, parts), t in zip(made.items(), types)})


def _added(parts: DataFrame, add, schema: str) -> dict[int, dict[str, np.ndarray]]:
    """The tasks' rows of each tree, added up where they meet. A task holds the nodes of its trees:
    at most the leaves and drawn features that the settings allow."""
    table = parts.repartition("g").mapInArrow(add, schema).toArrow()
    return dict(sorted(_arrays(table.to_batches()), key=lambda row: row[0]))


def grow(
    table: DataFrame, rows_of, problems: list[Problem], seed: int, max_depth: int, min_leaf: int
) -> list[list[Tree]]:
    """The trees of each problem. ``rows_of`` turns a batch of ``table`` into arrays."""
    spark = table.sparkSession
    first = np.concatenate([[0], np.cumsum([p.trees for p in problems])]).tolist()
    trees = [Tree() for _ in range(first[-1])]
    owner = np.repeat(np.arange(len(problems)), [p.trees for p in problems])
    open_nodes = {g: (np.zeros(1, np.int64), np.zeros(1, np.int64)) for g in range(len(trees))}
    numbered = list(zip(problems, first))
    one, two = _ranges(numbered, rows_of), _left_sums(numbered, rows_of)
    for _ in range(max_depth * ATTEMPTS):
        growths = {}
        for g, (nodes, attempts) in open_nodes.items():
            p = problems[owner[g]]
            feature = drawn_features(seed, g, nodes, attempts, p.features, p.drawn)
            growths[g] = Growth(int(owner[g]), trees[g], nodes, attempts, feature)
        if not growths:
            break
        sent = spark.sparkContext.broadcast(growths)
        ranges = table.mapInArrow(lambda batches: one(batches, sent.value), _RANGES)
        found = _added(ranges, lambda batches: _cuts_of(batches, sent.value, seed), _CUTS)
        for g, growth in growths.items():
            growth.cuts = np.full(growth.feature.shape, np.nan, np.float32)
            if g in found:
                growth.cuts = found[g]["cuts"].reshape(growth.feature.shape)
        cuts = spark.sparkContext.broadcast({g: growth.cuts for g, growth in growths.items()})

        def cutting(batches):
            # The trees were sent with the ranges' pass.
            return two(batches, {g: replace(sent.value[g], cuts=c) for g, c in cuts.value.items()})

        sums = _added(
            table.mapInArrow(cutting, _SUMS), lambda batches: _best_cuts(batches, sent.value, min_leaf), _JUDGED
        )
        open_nodes = {}
        for g, rows in sums.items():
            more = _split(trees[g], growths[g], rows, problems[owner[g]], max_depth, min_leaf)
            if len(more[0]):
                open_nodes[g] = more
    return [trees[a:b] for a, b in zip(first, first[1:])]


def _split(tree: Tree, growth: Growth, rows, problem: Problem, max_depth: int, min_leaf: int):
    """Apply a tree's best cuts within its leaves; the nodes that are open next."""
    width = 2 + OUTPUTS
    at, gain = rows["node"], rows["gain"]
    left, totals = rows["left"].reshape(-1, width), rows["total"].reshape(-1, width)
    tree.sums[growth.nodes[at]] = totals
    cut = np.flatnonzero(gain >= 0)
    room = problem.max_leaves - tree.leaves
    if len(cut) > room:
        cut = np.sort(cut[np.argsort(-gain[cut], kind="stable")[:room]])
    retry = (gain < 0) & (growth.attempts[at] + 1 < ATTEMPTS) & np.isnan(growth.cuts[at]).all(axis=1)
    nodes, size = growth.nodes[at[cut]], len(tree.left)
    place, left = rows["place"][cut], left[cut]
    children = size + np.arange(2 * len(cut))
    tree.feature[nodes] = growth.feature[at[cut], place]
    tree.cut[nodes] = growth.cuts[at[cut], place]
    tree.left[nodes] = children[::2]
    tree.feature = np.concatenate([tree.feature, np.zeros(len(children), np.int32)])
    tree.cut = np.concatenate([tree.cut, np.full(len(children), np.inf, np.float32)])
    tree.left = np.concatenate([tree.left, children.astype(np.int32)])
    sums = np.stack([left, totals[cut] - left], axis=1).reshape(-1, width)
    tree.sums = np.concatenate([tree.sums, sums])
    tree.leaves += len(cut)
    again = growth.nodes[at[retry]]
    attempts = growth.attempts[at[retry]] + 1
    if len(cut):
        tree.depth += 1
    if tree.depth >= max_depth or tree.leaves >= problem.max_leaves:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pure = sums[:, 2:].max(axis=1) == sums[:, 1] if problem.outputs == OUTPUTS else np.zeros(len(sums), bool)
    fresh = children[(sums[:, 0] >= 2 * min_leaf) & ~pure]
    return np.concatenate([again, fresh]), np.concatenate([attempts, np.zeros(len(fresh), np.int64)])


@dataclass
class Ensemble:
    """The trees of one problem joined into one set of node arrays, for scoring."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    @classmethod
    def of(cls, trees: list[Tree], values) -> "Ensemble":
        """``values``: node sums to what a leaf predicts."""
        starts = np.concatenate([[0], np.cumsum([len(t.left) for t in trees])])
        return cls(
            np.concatenate([t.feature for t in trees]).astype(np.int16),
            np.concatenate([t.cut for t in trees]),
            np.concatenate([t.left + s for t, s in zip(trees, starts)]).astype(np.int32),
            np.concatenate([values(t.sums) for t in trees]),
            starts[:-1].astype(np.int32),
        )

    def mean(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the leaf values, in tree order."""
        out = np.zeros((len(x), self.value.shape[1]))
        columns, everyone = np.ascontiguousarray(x.T), np.arange(len(x))
        ends = [*self.roots[1:].tolist(), len(self.feature)]
        for root, end in zip(self.roots.tolist(), ends):
            # One tree's nodes are few and stay in the processor's cache.
            part = slice(root, end)
            # Whole columns first did not pay here: on all cores at once it was slower, not faster.
            node = walk(self.feature[part], self.cut[part], self.left[part] - root, columns, everyone, 0, False)
            out += self.value[part].take(node, axis=0)
        return out / len(self.roots)
