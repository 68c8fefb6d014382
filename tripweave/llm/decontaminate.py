"""Benchmark items inside documents: size-partitioned MinHash containment search.

Only DataFrame functions. Words are runs of letters and digits, lower-cased; shingles
are five words, hashed to 63 bits.

Documents are partitioned by the number of their distinct shingles, by powers of two. A
document of partition c has a one-permutation MinHash signature of ``2^(c + extra)`` bins,
so that a bin holds few shingles however long the document is, and a long document is not
drowned by its own length as it would be with a fixed number of bins. The bin of a
shingle is given by the leading bits of its hash, its least hash is the bin's value; in
sorted order a hash is the least of its bin exactly if it differs from the one before in
those bits. ``extra`` follows the shortest item: an item at containment 0.8 shares at
least s of its q shingles, each of which is a bin's value with probability
``p = (1 - exp(-load)) / load`` at least. None of them is with probability ``(1 - p)^s``:
below 1e-5 for every q. If an item has under nine shingles, all hashes are compared, for
all items: no fewer can find it.

An item and a document are a candidate if at least ``m - sqrt(2 m ln 1e5)`` values agree,
and one at least, where ``m = s p`` are expected: by Chernoff's bound fewer do with
probability 1e-5 at most. Candidates are verified on their exact shingles, as text.

Defined cases: an item or document with fewer than five words is one shingle of its
whole sequence; without words it has none and matches nothing; null text is empty. Items
with one item_id count each for themselves, the best is shown. Rows that repeat give one
row of the result; a null doc_id is a document like others. Texts may have any length; an
empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import Scratch, ready, text_or_empty

SHINGLE = 5
CONTAINED = 0.8
#: Shingles of all items up to which they are broadcast; beyond that the join shuffles.
BROADCAST_SHINGLES = 200_000
#: Least shingles of the shortest item, and bins for it as a power of two over the partition.
RESOLUTION = ((32, -1), (16, 0), (9, 1))
#: Probability of missing an item that a document contains, at most.
MISS = 1e-5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _starts(array: Column) -> Column:
    """Starts of the shingles of a word array: one of 1 for a short one, none for none."""
    last = F.greatest(F.size(array) - (SHINGLE - 1), F.lit(1))
    return F.when(F.size(array) > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def hashed_shingles(array: Column) -> Column:
    """Sorted distinct 63-bit hashes of the shingles."""
    each = F.transform(_starts(array), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(array, i, SHINGLE)), 1))
    return F.sort_array(F.array_distinct(each))


def exact_shingles(array: Column) -> Column:
    return F.array_distinct(F.transform(_starts(array), lambda i: F.array_join(F.slice(array, i, SHINGLE), " ")))


def resolution(shortest: int) -> tuple[int | None, float]:
    """(extra, least probability that a shared shingle is a bin's value) for an item size."""
    for least, extra in RESOLUTION:
        if shortest >= least:
            load = 2.0**-extra
            return extra, (1 - math.exp(-load)) / load
    return None, 1.0


def least_agreeing(q: Column, contained: float, p: float) -> Column:
    """Values of an item of ``q`` shingles that agree but with probability ``MISS``."""
    expected = F.ceil(q * contained) * F.lit(p)
    return F.greatest(expected - F.sqrt(2 * expected * math.log(1 / MISS)), F.lit(1.0))


def signature(hashes: Column, extra: int | None) -> Column:
    """The bins' least hashes; all hashes without ``extra``."""
    if extra is None:
        return hashes
    partition = F.ceil(F.log2(F.greatest(F.size(hashes), F.lit(1)).cast("double")))
    bits = F.greatest(partition + extra, F.lit(0))
    step = F.pow(F.lit(2.0), 63 - bits)
    return F.filter(
        hashes,
        lambda x, i: (i == 0) | (x.bitwiseXOR(F.get(hashes, i - 1)).cast("double") >= step),
    )


def _items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    made = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("words"))
    return made.select("item_id", "words", hashed_shingles(F.col("words")).alias("hashes"))


class Leaks:
    """One search; ``found`` has a row per text and item it contains."""

    def __init__(self, docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, contained: float):
        spark = ready(docs.sparkSession)
        scratch = Scratch(spark, "leaks")
        index = scratch.keep(_items(items, item_id, text), "items").filter("size(hashes) > 0")
        shape = index.agg(F.min(F.size("hashes")).alias("least"), F.sum(F.size("hashes")).alias("all")).first()
        extra, p = resolution(shape["least"] or 1)
        postings = index.select("item_id", F.size("hashes").alias("q"), F.explode("hashes").alias("value"))
        if (shape["all"] or 0) <= BROADCAST_SHINGLES:
            postings = F.broadcast(postings)
        rows = docs.select(
            F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("body"), words(F.col(text)).alias("words")
        )
        # Hashes are read twice below, so each array is a column of its own.
        hashed = rows.select("doc_id", "body", hashed_shingles(F.col("words")).alias("hashes"))
        # The outer form, since explode adds a filter on its array that Spark moves below the
        # projections, where the words would be cut anew for every shingle.
        values = hashed.select("doc_id", "body", F.explode_outer(signature(F.col("hashes"), extra)).alias("value"))
        candidates = (
            values.join(postings, "value")
            .groupBy("doc_id", "body", "item_id", "q")
            .agg(F.count_distinct("value").alias("agree"))
            .filter(F.col("agree") >= least_agreeing(F.col("q"), contained, p))
            .select("doc_id", "body", "item_id")
        )
        candidates = scratch.keep(candidates, "candidates")
        of_items = index.select("item_id", exact_shingles(F.col("words")).alias("wanted"))
        bodies = docs.select(
            F.col(doc_id).alias("id"), F.xxhash64(text_or_empty(text)).alias("hash"), F.col(text).alias("text")
        )
        wanted = candidates.select("doc_id", "body").distinct()
        # Only texts with a candidate are cut into shingles again.
        again = bodies.join(
            wanted, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("body"))
        ).select("doc_id", "body", words(F.col("text")).alias("words"))
        again = again.groupBy("doc_id", "body").agg(F.first("words").alias("words"))
        again = again.select("doc_id", "body", exact_shingles(F.col("words")).alias("shingles"))
        pairs = again.withColumnsRenamed({"doc_id": "id", "body": "hash"}).join(
            candidates, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("body"))
        )
        counted = pairs.join(of_items, "item_id").select(
            "doc_id",
            "body",
            "item_id",
            F.size("wanted").cast("long").alias("n_shingles"),
            F.size(F.array_intersect("wanted", "shingles")).cast("long").alias("n_shared"),
        )
        self.found = scratch.keep(
            counted.filter(F.col("n_shared") >= F.lit(contained) * F.col("n_shingles")), "found"
        )


def report(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    contained: float = CONTAINED,
) -> DataFrame:
    """(doc_id, item_id, n_shingles of the item, n_shared) of each item that a document contains."""
    found = Leaks(docs, items, doc_id, item_id, text, contained).found
    best = F.max(F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shingles", "n_shared"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.n_shingles", "b.n_shared"
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    contained: float = CONTAINED,
) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    found = Leaks(docs, items, doc_id, item_id, text, contained).found
    leaking = found.select(F.col("doc_id").alias("leak_id"), F.col("body").alias("leak_body")).distinct()
    rows = docs.select(
        F.struct("*").alias("whole"), F.col(doc_id).alias("id"), F.xxhash64(text_or_empty(text)).alias("hash")
    )
    return rows.join(
        leaking, F.col("id").eqNullSafe(F.col("leak_id")) & (F.col("hash") == F.col("leak_body")), "left_anti"
    ).select("whole.*")
