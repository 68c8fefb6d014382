"""Near duplicates: MinHash bands, sequential Bayesian pruning, exact verification.

Steps, all on Spark tables:

1. Documents with one and the same shingle set are one node, named by its least doc_id,
   so copies are never compared or expanded.
2. Nodes whose signatures agree in a band share a bucket; buckets of one node leave.
3. Candidates inside a bucket are taken against pivots first: the pivot of a bucket is
   its member with the most company over all bands. A node starts with its best pivot
   only. What is linked by then needs no further comparison: a pair whose ends have one
   component cannot change the result.
4. In buckets that still hold several components a node meets one drawn pivot a round,
   and at last every pair across components is compared, large buckets in blocks of about
   ``BLOCK`` nodes a side. The blocks carry signatures and texts, so pruning and exact
   counting happen inside the task and only links become rows.
5. A candidate's signatures are compared batch by batch. With a uniform prior on the
   similarity, a pair is dropped as soon as the posterior chance of reaching the
   threshold is below ``MISS``. Survivors are counted on full shingle sets.

With 30 bands of 5 a pair at similarity 0.8 shares no bucket with probability 7e-6, a
more similar one less.

Defined cases: null text, empty text and white space have no shingles: linked with
nothing, kept. Fewer words than a shingle's make one shingle of the whole. Rows with one
doc_id are one document: the links of all its texts are joined. A null doc_id is linked
with nothing and kept. Texts may have any length. An empty table gives an empty one. Other
columns pass through :func:`deduplicate`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import Scratch, ready
from tripweave.llm.components import components
from tripweave.llm.shingles import Signer, WordHashes, mix, shingle_set, words_of

BANDS, BAND_ROWS = 30, 5
#: Signature values compared at a time.
BATCH = 30
#: Chance of dropping a pair that reaches the threshold, at each look.
MISS = 1e-6
#: Nodes on one side of a block of comparisons.
BLOCK = 512
#: Percent of the union that the intersection must reach.
PERCENT = 80


def required_matches(percent: int, miss: float = MISS, batch: int = BATCH, length: int = BANDS * BAND_ROWS):
    """(values seen, least matches) at each look.

    With a uniform prior and m of n values equal, P(similarity >= t) is the chance of at
    most m successes in n + 1 draws at rate t.
    """
    t = percent / 100
    looks = []
    for n in range(batch, length + 1, batch):
        total, least = 0.0, n + 1
        for m in range(n + 1):
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                least = m
                break
        looks.append((n, least))
    return looks


def describe(size: int):
    """Function for ``mapInArrow`` over (doc_id, text): sets described, not shown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sign = WordHashes(), Signer(BANDS * BAND_ROWS)
        for batch in batches:
            counts, keys, signatures = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(hashes(words_of(text and text.lower())), size)
                counts.append(len(found))
                if len(found):
                    # Two independent sums over a set name it.
                    again = mix(found ^ np.uint64(0x5851F42D4C957F2D))
                    keys.append(found.sum().tobytes() + again.sum().tobytes() + len(found).to_bytes(4, "big"))
                    signatures.append(sign(found).tobytes())
                else:
                    keys.append(None)
                    signatures.append(None)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_shingles": pa.array(counts, pa.int64()),
                    "same": pa.array(keys, pa.binary()),
                    "signature": pa.array(signatures, pa.binary()),
                }
            )

    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32)
        signed = signed.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), signed.shape[:2]).copy()
        for i in range(BAND_ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signed[:, :, i])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key.astype(np.int64).ravel()),
                pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)),
                pa.array(np.repeat(batch.column(1).to_numpy(zero_copy_only=False), BANDS)),
            ],
            names=["bucket", "node", "n"],
        )


def _survivors(left: np.ndarray, right: np.ndarray, looks) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the rows whose signatures pass every look, and how many values agree."""
    alive, matches, seen = np.arange(len(left)), np.zeros(len(left), dtype=int), 0
    for n, least in looks:
        matches = matches + (left[alive, seen:n] == right[alive, seen:n]).sum(axis=1)
        passed = matches >= least
        alive, matches, seen = alive[passed], matches[passed], n
        if not len(alive):
            break
    return alive, matches


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * BAND_ROWS)


def _prune(looks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive, _ = _survivors(_signatures(batch.column(2)), _signatures(batch.column(3)), looks)
            yield batch.select([0, 1]).take(pa.array(alive))

    return run


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether the intersection of two sets reaches ``percent`` of their union."""
    union = len(np.unique(np.concatenate([one, two])))
    return 100 * (len(one) + len(two) - union) >= percent * union


def _similar(size: int, percent: int):
    """Function for ``mapInArrow`` over (a, b, text_a, text_b): the pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last, held = None, None  # rows come in the order of b, whose set serves many
        for batch in batches:
            linked = []
            for text_a, text_b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if text_b != last:
                    last, held = text_b, shingle_set(hashes(words_of(text_b.lower())), size)
                one = shingle_set(hashes(words_of(text_a.lower())), size)
                linked.append(_linked(one, held, percent))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return run


def _block_links(looks, percent: int, size: int):
    """Function for ``applyInArrow``: links that join components within a block pair.

    Pairs that survive pruning are counted here, on the full sets, and never become rows;
    a pair whose ends have been joined on the way is not counted.
    """

    def run(table: pa.Table) -> pa.Table:
        node, label, n, side = (table.column(c).to_numpy() for c in ("node", "label", "n", "side"))
        signed = _signatures(table.column("signature"))
        texts = table.column("text")
        within = bool(table.column("within")[0].as_py())
        hashes, sets, above = WordHashes(), {}, {}

        def full(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(hashes(words_of(texts[i].as_py().lower())), size)
            return sets[i]

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        links = []
        for i in np.flatnonzero(side == 0).tolist():
            other = np.flatnonzero((side == 0) & (node > node[i]) if within else side == 1)
            other = other[label[other] != label[i]]
            other = other[100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i])]
            if not len(other):
                continue
            mine = np.broadcast_to(signed[i], (len(other), signed.shape[1]))
            alive, matches = _survivors(mine, signed[other], looks)
            for j in other[alive[np.argsort(-matches, kind="stable")]].tolist():
                one, two = root(int(label[i])), root(int(label[j]))
                if one != two and _linked(full(i), full(j), percent):
                    above[max(one, two)] = min(one, two)
                    links.append(sorted((int(node[i]), int(node[j]))))
        return pa.table({c: pa.array([x[k] for x in links], pa.int64()) for k, c in enumerate("ab")})

    return run


class NearDuplicates:
    """One search; ``documents`` has a row per input row, ``labels`` a row per linked node."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int):
        self.spark = ready(docs.sparkSession)
        self.scratch = Scratch(self.spark, "near")
        self.shingle, self.percent = shingle, percent
        self.looks = required_matches(percent)
        self.source = docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")
        )
        keep = self.scratch.keep
        described = keep(
            self.source.mapInArrow(
                describe(shingle), "doc_id long, n_shingles long, same binary, signature binary"
            ),
            "described",
        )
        usable = described.filter("same IS NOT NULL AND doc_id IS NOT NULL")
        self.classes = keep(
            usable.groupBy("same").agg(
                F.min("doc_id").alias("node"),
                F.first("n_shingles").alias("n"),
                F.first("signature").alias("signature"),
            ),
            "classes",
        )
        self.described = described.select("doc_id", "n_shingles", "same")
        self.members = self._buckets()
        self.texts = self._texts()
        self.links = self._more_than_one_text()
        self.tested: DataFrame | None = None
        self._search()

    def _buckets(self) -> DataFrame:
        """(bucket, node, n) of buckets with at least two nodes."""
        rows = self.scratch.keep(
            self.classes.select("node", "n", "signature").mapInArrow(
                _band_rows, "bucket long, node long, n long"
            ),
            "bands",
        )
        shared = rows.groupBy("bucket").agg(
            F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")
        )
        # Written before the join, whose tasks Spark can split then.
        shared = self.scratch.keep(shared.filter("low < high").select("bucket", "size"), "shared")
        members = self.scratch.keep(rows.join(shared, "bucket"), "members")
        self.scratch.drop(rows)
        return members

    def _texts(self) -> DataFrame:
        """(node, text) of the nodes that share a bucket, so that the corpus moves once."""
        nodes = self.members.select("node").distinct()
        return self.scratch.keep(
            self.source.withColumnRenamed("doc_id", "node")
            .join(nodes, "node", "left_semi")
            .dropDuplicates(),
            "texts",
        )

    def _more_than_one_text(self) -> DataFrame:
        """Links between classes of one document id."""
        usable = self.described.filter("same IS NOT NULL AND doc_id IS NOT NULL")
        several = (
            usable.groupBy("doc_id")
            .agg(F.min("same").alias("low"), F.max("same").alias("high"))
            .filter("low < high")
            .select("doc_id")
        )
        named = usable.join(several, "doc_id", "left_semi").join(self.classes.select("same", "node"), "same")
        links = named.select(F.least("doc_id", "node").alias("a"), F.greatest("doc_id", "node").alias("b"))
        return self.scratch.keep(links.filter("a < b").distinct(), "links")

    def _verify(self, pairs: DataFrame) -> None:
        """Add the pairs (a, b) that are linked; remember all as tested."""
        pairs = self.scratch.keep(pairs, "pairs")
        signed = self.classes.select("node", "signature")
        of_a = signed.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
        of_b = signed.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
        likely = self.scratch.keep(
            pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "sa", "sb")
            .mapInArrow(_prune(self.looks), "a long, b long"),
            "likely",
        )
        self._count_exactly(likely)
        self.tested = pairs if self.tested is None else self.tested.union(pairs)

    def _count_exactly(self, likely: DataFrame) -> None:
        of_a = self.texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        of_b = self.texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        linked = (
            likely.join(of_a, "a").join(of_b, "b").select("a", "b", "ta", "tb")
            .mapInArrow(_similar(self.shingle, self.percent), "a long, b long")
        )
        self.links = self.links.union(self.scratch.keep(linked, "links"))

    def _comparable(self, pairs: DataFrame) -> DataFrame:
        """Distinct (a, b), a < b, whose sizes allow the similarity, not tested yet."""
        fit = F.least("n", "m") * 100 >= F.greatest("n", "m") * self.percent
        pairs = (
            pairs.filter((F.col("node") != F.col("pivot")) & fit)
            .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
            .distinct()
        )
        return pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti")

    def _search(self) -> None:
        company = self.scratch.keep(
            self.members.groupBy("node").agg(F.sum("size").alias("company")), "company"
        )
        ranked = self.scratch.keep(self.members.join(company, "node"), "ranked")
        # First every node against one pivot, the best it meets in any bucket.
        best = F.max(F.struct("company", (-F.col("node")).alias("minus"), "n"))
        pivots = self.scratch.keep(ranked.groupBy("bucket").agg(best.alias("p")), "pivots")
        met = ranked.join(pivots, "bucket").filter(F.col("p.minus") != -F.col("node"))
        one = met.groupBy("node", "n").agg(F.max("p").alias("p"))
        self._verify(
            self._comparable(one.select("node", "n", (-F.col("p.minus")).alias("pivot"), F.col("p.n").alias("m")))
        )
        self.labels = components(self.links, self.scratch)
        # Then, where components still share a bucket, against a pivot drawn from it.
        for turn in range(2):
            open_rows = self._open(ranked)
            if open_rows.isEmpty():
                return
            drawn = F.struct(
                F.xxhash64("node", F.lit(turn)).alias("draw"), F.col("node").alias("pivot"), F.col("n").alias("m"), "label"
            )
            pivots = self.scratch.keep(open_rows.groupBy("bucket").agg(F.max(drawn).alias("p")), "pivots")
            across = open_rows.join(pivots, "bucket").filter(F.col("p.label") != F.col("label"))
            one = across.groupBy("node", "n").agg(F.max("p").alias("p"))
            self._verify(self._comparable(one.select("node", "n", "p.pivot", "p.m")))
            self.labels = components(self.links, self.scratch)
        # At last all pairs across.
        open_rows = self._open(ranked)
        if not open_rows.isEmpty():
            self._compare_all(open_rows)
            self.labels = components(self.links, self.scratch)

    def _open(self, ranked: DataFrame) -> DataFrame:
        """Members, with their components, of buckets that hold several components."""
        named = self.scratch.keep(
            ranked.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node")),
            "named",
        )
        mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        return self.scratch.keep(
            named.join(mixed.filter("low < high").select("bucket"), "bucket", "left_semi"), "open"
        )

    def _compare_all(self, open_rows: DataFrame) -> None:
        """Every pair across components of an open bucket, in blocks, verified in the task."""
        blocks = F.ceil(F.col("size") / BLOCK)
        mine = F.pmod(F.xxhash64("node"), blocks)
        rows = (
            open_rows.join(self.classes.select("node", "signature"), "node")
            .join(self.texts, "node")
            .withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select(
                "bucket",
                F.least("mine", "other").alias("i"),
                F.greatest("mine", "other").alias("j"),
                (F.col("mine") > F.col("other")).cast("int").alias("side"),
                (F.col("mine") == F.col("other")).alias("within"),
                "node",
                "n",
                "label",
                "signature",
                "text",
            )
        )
        links = (
            rows.groupBy("bucket", "i", "j")
            .applyInArrow(_block_links(self.looks, self.percent, self.shingle), "a long, b long")
            .distinct()
        )
        self.links = self.links.union(self.scratch.keep(links, "links"))

    @property
    def documents(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id, kept."""
        named = self.classes.select("same", "node").join(self.labels, "node", "left")
        named = named.select("same", F.coalesce("label", "node").alias("component_id"))
        # A document id with several texts has the component of all of them.
        return self.described.join(named, "same", "left").select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
        )


def report(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return NearDuplicates(docs, doc_id, text, shingle, percent).documents


def deduplicate(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    percent: int = PERCENT,
) -> DataFrame:
    """The rows of ``docs`` without those linked to a smaller doc_id."""
    found = report(docs, doc_id, text, shingle, percent)
    dropped = found.filter("NOT kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    rows = docs.select(F.struct("*").alias("whole"), F.col(doc_id).alias("row_id"))
    return rows.join(dropped, F.col("row_id") == F.col("dropped_id"), "left_anti").select("whole.*")
