"""Exact duplicates, with the frequent texts split off.

A Misra-Gries summary of each partition's text digests, merged by sums, names every
digest that more than ``2 / (counters + 1)`` of the rows share. Their winners are
counted exactly, hold a second hash of the text as a check, and are few (at most
``counters + 1``), so they are broadcast and their copies leave on the map side.
All other digests take the ordinary shuffle, where none is hot any more.

Defined cases: null text counts as empty; the row with the largest doc_id stays; a null
doc_id loses to any other; rows that repeat both doc_id and text are the same document,
so the report says the same of each and :func:`deduplicate` leaves one: of rows with one
doc_id and text that differ in other columns, any. Texts may have any length. An empty table
gives an empty one. Other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import Scratch, ready, text_or_empty

#: Counters of a summary: what more than 2 / (COUNTERS + 1) of all rows share is found.
COUNTERS = 1023


def _fold(keys: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum equal keys, then take the (size + 1)-th largest count off all of them."""
    keys, at = np.unique(keys, return_inverse=True)
    counts = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
    if len(keys) > size:
        counts = counts - np.partition(counts, len(counts) - size - 1)[len(counts) - size - 1]
    return keys[counts > 0], counts[counts > 0]


def misra_gries(column: str, size: int):
    """Function for ``mapInArrow``: the summary of one partition's binary digests."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # As hex, since numpy's byte strings lose zero bytes at their end.
        keys, counts = np.array([], dtype="S64"), np.array([], dtype=np.int64)
        for batch in batches:
            new = np.array([d.hex() for d in batch.column(column).to_pylist()], dtype="S64")
            keys, counts = _fold(
                np.concatenate([keys, new]),
                np.concatenate([counts, np.ones(len(new), dtype=np.int64)]),
                size,
            )
        yield pa.RecordBatch.from_pydict(
            {
                "sha": pa.array([bytes.fromhex(k.decode()) for k in keys], pa.binary()),
                "seen": pa.array(counts, pa.int64()),
            }
        )

    return summarise


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters + 1`` digests, among them all that are frequent.

    A merged count misses at most rows / (counters + 1) of a digest's rows, and all
    merged counts sum to at most the rows: so few can pass the limit below.
    """
    rows = digests.count()
    return (
        digests.select("sha")
        .mapInArrow(misra_gries("sha", counters), "sha binary, seen long")
        .groupBy("sha")
        .agg(F.sum("seen").alias("seen"))
        .filter(F.col("seen") > rows / (counters + 1))
        .select("sha")
    )


def _digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = text_or_empty(F.col(text))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.sha2(body, 256)).alias("sha"),
        F.xxhash64(body).alias("check"),
    )


def _winners(digests: DataFrame) -> DataFrame:
    return digests.groupBy("sha", "check").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def _frequent_winners(digests: DataFrame, scratch: Scratch, counters: int) -> DataFrame:
    """Winner, size and check of every frequent text, exact."""
    named = F.broadcast(frequent(digests, counters))
    return scratch.keep(_winners(digests.join(named, "sha", "left_semi")), "winners")


def report(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = ready(docs.sparkSession)
    scratch = Scratch(spark, "exact")
    digests = scratch.keep(_digests(docs, doc_id, text), "digests")
    hot = _frequent_winners(digests, scratch, counters)
    few = F.broadcast(hot)
    rest = digests.join(few, ["sha", "check"], "left_anti")
    # Written before the join, whose tasks Spark can split then, however many copies are left.
    others = scratch.keep(_winners(rest), "others")
    judged = digests.join(few, ["sha", "check"]).unionByName(rest.join(others, ["sha", "check"]))
    return judged.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One whole row of ``docs`` for each distinct text, that of the largest doc_id."""
    spark = ready(docs.sparkSession)
    scratch = Scratch(spark, "exact")
    digests = scratch.keep(_digests(docs, doc_id, text), "digests")
    hot = _frequent_winners(digests, scratch, counters)
    body = text_or_empty(F.col(text))
    rows = docs.select(
        F.struct("*").alias("whole"),
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.sha2(body, 256)).alias("sha"),
        F.xxhash64(body).alias("check"),
    )
    # Copies of frequent texts leave here, before anything is shuffled.
    left = rows.join(F.broadcast(hot), ["sha", "check"], "left").filter(
        F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    )
    first = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    return left.groupBy("sha", "check").agg(F.max_by("whole", first).alias("whole")).select("whole.*")
