"""Ranked lexical search: every document scored for every item, the best 20 of each kept.

Terms are the runs of letters, digits and non-ASCII characters, A-Z lower-cased. Texts are read
once: a document leaves the first pass as its number of terms and its occurrences of terms that
any item has, under small numbers (the compact vocabulary). The statistics N, L and df are
aggregations of that slim table.

Scores are products of dense blocks, by BLAS in float64. An item tile is a matrix items x terms
of (occurrences in the item) * w over the tile's own terms; a document tile is a matrix
terms x documents of what a term adds for its frequency and the document's length. All entries
are whole numbers, and a tile takes only so many terms that no sum in it can reach 2^53, so the
products are exact in any order of addition; tiles of terms are added as 64-bit integers.

Each task keeps 20 documents an item over its tiles: the candidates of a tile are all scores not
below the twentieth so far, ties included, and ties go by ascending doc_id. The tasks' lists meet
in two rankings, first within slices of each item, so no task reads one item's lists whole.

The item side is sent to the tasks: at most ``ITEM_TERMS`` (item, term) pairs at a time; more
items are dealt into groups by hash, which are scored one after the other on the slim table.
One item with more distinct terms than that is a group by itself.

Cases: null and empty texts have no terms, count in no statistic and never rank; an item is an
item_id, its terms are those of all its distinct texts (a null item_id is an id like any other),
and one without terms or without a matching document has no rows; repeated documents rank each
for itself, equal scores by ascending doc_id, null last, so equal rows share adjacent ranks; a
text may have any length; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm.common import Scratch

TOP = 20
#: (item, term) pairs that are sent to the tasks at once.
ITEM_TERMS = 1_000_000
#: Items and documents of a tile.
ITEM_TILE, DOC_TILE = 64, 512
#: No sum of a tile may reach this.
EXACT = 2**53
#: What one occurrence in an item may add at most, per unit of weight: 10^9 tf / (1000 tf + 12 m).
FULL = 1_000_000
#: Slices in which an item's candidates are ranked first.
SLICES = 64

_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order, as UTF-8."""
    return text.encode().translate(_KEEP).split() if text else []


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n): occurrences over the distinct texts of each item_id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, counts = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term, n in Counter(terms_of(text)).items():
                    ids.append(item)
                    terms.append(term.decode())
                    counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(terms, pa.string()), pa.array(counts, pa.int64())],
                names=["item_id", "term", "n"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    distinct = items.select("item_id", "text").distinct()
    return (
        distinct.mapInArrow(cut, f"item_id {kind}, term string, n bigint")
        .groupBy("item_id", "term")
        .agg(F.sum("n").alias("n"))
    )


def _groups(pairs: DataFrame, limit: int) -> int:
    """Into how many groups items are dealt, so that each has at most ``limit`` pairs."""
    total = pairs.count()
    groups = max(1, -(-total // limit))
    items = None
    while groups > 1:
        sizes = pairs.groupBy(_group_of(groups).alias("g")).agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("items")
        )
        if sizes.filter((F.col("n") > limit) & (F.col("items") > 1)).isEmpty():
            break
        items = items or pairs.select("item_id").distinct().count()
        if groups >= 64 * items:
            break
        groups *= 2
    return groups


def _group_of(groups: int):
    return F.pmod(F.xxhash64("item_id"), F.lit(groups))


def occurrences(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms of each document counted, those of the vocabulary
    listed. Documents without terms are left out."""
    sent = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ids, sizes, terms, tfs, ends = [], [], [], [], [0]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                counts = Counter(known[t] for t in found if t in known)
                ids.append(doc)
                sizes.append(len(found))
                terms.extend(counts.keys())
                tfs.extend(counts.values())
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    slim = docs.select(F.col("doc_id").cast("long"), "text").filter("text <> ''")
    return slim.mapInArrow(cut, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class ItemTiles:
    """Item matrices, cut so that every sum is exact.

    ``tiles``: (rows of the items, [(terms, matrix items x terms)]).
    """

    def __init__(self, owners: np.ndarray, terms: np.ndarray, values: np.ndarray, n_items: int, tile: int = ITEM_TILE):
        self.n_items = n_items
        self.tiles = []
        order = np.argsort(owners, kind="stable")
        owners, terms, values = owners[order], terms[order], values[order]
        for start in range(0, n_items, tile):
            lo, hi = np.searchsorted(owners, [start, start + tile])
            rows, cols, vals = owners[lo:hi] - start, terms[lo:hi], values[lo:hi]
            height = min(tile, n_items - start)
            parts = []
            own, spot = np.unique(cols, return_inverse=True)
            first = 0
            while first < len(own):
                # The longest run of terms whose largest possible row sum stays exact.
                width = len(own) - first
                while True:
                    chosen = (spot >= first) & (spot < first + width)
                    matrix = np.zeros((height, width))
                    matrix[rows[chosen], spot[chosen] - first] = vals[chosen]
                    if matrix.sum(axis=1).max(initial=0) * FULL < EXACT:
                        break
                    if width == 1:
                        raise OverflowError("One term of one item is out of exact range")
                    width = (width + 1) // 2
                parts.append((own[first : first + width], matrix))
                first += width
            self.tiles.append((slice(start, start + height), parts))


class Best:
    """The highest scores of each item so far: ties by ascending doc_id, null ids last."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.scores = np.zeros((n_items, top), dtype=np.int64)
        self.ids = np.zeros((n_items, top), dtype=np.int64)
        self.nulls = np.zeros((n_items, top), dtype=bool)

    def offer(self, at: slice, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """Scores (items x documents) of one tile."""
        least = np.maximum(self.scores[at, -1], 1)
        hits = scores >= least[:, None]
        for i in np.flatnonzero(hits.any(axis=1)):
            mine, row = np.flatnonzero(hits[i]), at.start + i
            s = np.concatenate([self.scores[row], scores[i, mine]])
            d = np.concatenate([self.ids[row], ids[mine]])
            n = np.concatenate([self.nulls[row], nulls[mine]])
            keep = np.lexsort((d, n, -s))[: self.top]
            self.scores[row], self.ids[row], self.nulls[row] = s[keep], d[keep], n[keep]


def _impacts(n: np.ndarray, n_docs: int, n_terms: int, sizes: np.ndarray, tfs: np.ndarray) -> np.ndarray:
    """What each listed term adds per unit of weight, in 64-bit integers."""
    m = 100 - 25 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * tfs) // (1000 * tfs + 12 * np.repeat(m, sizes))


def _scored(slim: DataFrame, tiles: ItemTiles, vocabulary: int, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best of each task."""
    sent = slim.sparkSession.sparkContext.broadcast(tiles)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = sent.value
        best = Best(tiles.n_items, top)
        place = np.full(vocabulary, -1)
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(at, DOC_TILE)
                ids, listed = part.column(0), part.column(2)
                nulls = ids.is_null().to_numpy(zero_copy_only=False)
                numbers = ids.fill_null(0).to_numpy()
                sizes = listed.value_lengths().to_numpy()
                terms = listed.flatten().to_numpy()
                tfs = part.column(3).flatten().to_numpy()
                added = _impacts(part.column(1).to_numpy(), n_docs, n_terms, sizes, tfs)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                for rows, parts in tiles.tiles:
                    scores = np.zeros((rows.stop - rows.start, len(sizes)), dtype=np.int64)
                    for own, matrix in parts:
                        place[own] = np.arange(len(own))
                        spot = place[terms]
                        place[own] = -1
                        here = spot >= 0
                        present, spot = np.unique(spot[here], return_inverse=True)
                        block = np.zeros((len(present), len(sizes)))
                        block[spot, owner[here]] = added[here]
                        scores += (matrix[:, present] @ block).astype(np.int64)
                    best.offer(rows, scores, numbers, nulls)
        items, spots = np.nonzero(best.scores)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(items, pa.int32()),
                pa.array(best.ids[items, spots], pa.int64(), mask=best.nulls[items, spots]),
                pa.array(best.scores[items, spots], pa.int64()),
            ],
            names=["item", "doc_id", "score"],
        )

    return slim.mapInArrow(score, "item int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest documents of each item."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    pairs = scratch.keep(_item_terms(items), "item-terms")
    groups = _groups(pairs, item_terms)
    kind = items.schema["item_id"].dataType.simpleString()
    out = []
    for g in range(groups):
        mine = pairs.filter(_group_of(groups) == g) if groups > 1 else pairs
        listed = mine.toPandas()
        if not len(listed):
            continue
        vocabulary = sorted(set(listed["term"]))
        number = {t: i for i, t in enumerate(vocabulary)}
        slim = scratch.keep(occurrences(docs, vocabulary), f"occurrences-{g}")
        n_docs, n_terms = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        # One row for each term of the group's items.
        weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.count(F.lit(1)) + 1))).cast("long")
        weights = slim.select(F.explode("terms").alias("term")).groupBy("term").agg(weight.alias("w")).toPandas()
        w = np.zeros(len(vocabulary))
        w[weights["term"].to_numpy()] = weights["w"].to_numpy()
        terms = listed["term"].map(number).to_numpy()
        owners, ids = _numbered(listed["item_id"])
        tiles = ItemTiles(owners, terms, listed["n"].to_numpy() * w[terms], len(ids))
        found = _scored(slim, tiles, len(vocabulary), n_docs, n_terms, top)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
        out.append(_ranked(found, top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionAll(more)
    return whole


def _numbered(ids) -> tuple[np.ndarray, list]:
    """A number for each distinct id, null included."""
    seen: dict = {}
    made = [None if i is None or i != i else i for i in ids.astype(object)]
    owners = np.array([seen.setdefault(i, len(seen)) for i in made])
    return owners, [int(i) if isinstance(i, float) else i for i in seen]


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    slice_of = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SLICES))
    within = Window.partitionBy("item", "slice").orderBy(*order)
    whole = Window.partitionBy("item").orderBy(*order)
    sliced = found.withColumn("slice", slice_of).withColumn("rank", F.row_number().over(within))
    return (
        sliced.filter(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= top)
        .select("item", "rank", "doc_id", "score")
    )
