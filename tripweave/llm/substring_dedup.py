"""Passages that repeat, found level by level with doubled lengths.

The windows asked for have ``window`` words. Lengths double up to that: about a quarter,
a half, the whole (9, 18 and 35 words for 35). At each level every full window that is
still a candidate names one of the windows of that length inside it, the one with the
least hash (leftmost of equals); equal full windows name equal ones at the same place.
Named windows are counted, and only full windows whose named window repeats go on to the
next length. At the last length a window names itself, so what survives are the windows
whose own hash repeats.
Neighbours mostly name the same window: the first level moves one row for about fourteen
words of the corpus, later ones move rows for what repeats.

Texts with equal word sequences are one class with a count of its copies; a class with
copies repeats as a whole and is represented once. Hashes have 64 bits and are counted
with partial sums before the shuffle; no window's occurrences are gathered. Two different
windows are taken for equal with a chance of 2^-64 for each pair of surviving candidates.

Defined cases: null, empty and short texts (fewer words than a window) lose nothing.
Rows that repeat are copies of each other. A null doc_id takes part like any other. Texts
may have any length; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import Scratch, ready
from tripweave.llm.shingles import WordHashes, windows, words_of

#: Words of a window.
WINDOW = 35


def named_starts(short: np.ndarray, spread: int) -> np.ndarray:
    """For each full window, the start of the short window it names (leftmost least)."""
    if len(short) < spread:
        return np.array([], dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(short, spread)
    return view.argmin(axis=1) + np.arange(len(view))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _describe(window: int, short: int):
    """(doc_id, text, tag) to word count, digest of the words, named short windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, digests, named, places = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                digests.append(_digest(words))
                if len(words) >= window:
                    made = windows(hashes(words), short)
                    starts = np.unique(named_starts(made, window - short + 1))
                    named.append(made[starts].astype(np.int64))
                    places.append(starts.astype(np.int32))
                else:
                    named.append(None)
                    places.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(named, pa.list_(pa.int64())),
                    pa.array(places, pa.list_(pa.int32())),
                ],
                names=["doc_id", "tag", "n_words", "sha", "named", "places"],
            )

    return run


def _named_rows(window: int, before: int, size: int):
    """(class, sha, text, places) to the windows of ``size`` words that are named by full
    windows whose named window of the level ``before`` starts at one of the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for kind, sha, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if _digest(words) != sha:  # another text under the same id
                    continue
                plain = hashes(words)
                earlier = named_starts(windows(plain, before), window - before + 1)
                made = windows(plain, size)
                named = named_starts(made, window - size + 1)[np.isin(earlier, places)]
                starts = np.unique(named)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(starts), kind, dtype=np.int64)),
                        pa.array(made[starts].astype(np.int64)),
                        pa.array(starts.astype(np.int32)),
                    ],
                    names=["class", "value", "place"],
                )

    return run


def _covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a run of ``size`` words from one of the starts."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + size, n), -1)
    return np.cumsum(edges[:n]) > 0


def _keep_words(window: int):
    """(class, sha, text, places) to what is left of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, removed, digests, left = [], [], [], []
            for _, sha, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if _digest(words) != sha:
                    continue
                gone = _covered(np.array(places), window, len(words))
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                shas.append(sha)
                removed.append(len(words) - len(kept))
                digests.append(_digest(kept))
                left.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shas, pa.binary()),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(left, pa.binary()),
                ],
                names=["sha", "n_removed", "kept_sha", "kept"],
            )

    return run


def _repeated(rows: DataFrame, times: Column, scratch: Scratch) -> DataFrame:
    """(class, places): the places of (class, value, place) whose value repeats.

    Repeated values are written before the join, whose tasks Spark can split then.
    """
    often = rows.groupBy("value").agg(times.alias("times")).filter("times > 1").select("value")
    often = scratch.keep(often, "often")
    return rows.join(often, "value").groupBy("class").agg(F.collect_set("place").alias("places"))


def lengths(window: int) -> list[int]:
    """A quarter, a half and the whole of the window, rounded up."""
    half = -(-window // 2)
    return sorted({-(-half // 2), half, window})


class Repeats:
    """One search. ``described``: doc_id, n_words, sha of each input row. ``copied``: sha
    of word sequences that occur as whole texts more than once. ``partly``: sha,
    n_removed, kept_sha and kept words of other sequences that lose some."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, window: int):
        spark = ready(docs.sparkSession)
        scratch = Scratch(spark, "repeats")
        keep = scratch.keep
        first, *longer = lengths(window)
        # Rows are named by id and text: many texts may stand under one id, or under none.
        source = docs.select(
            F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.xxhash64(text).alias("tag")
        )
        kind = source.schema["doc_id"].dataType.simpleString()
        described = keep(
            source.mapInArrow(
                _describe(window, first),
                f"doc_id {kind}, tag long, n_words long, sha binary, named array<long>, places array<int>",
            ),
            "described",
        )
        merged = keep(
            described.filter(F.col("n_words") >= window)
            .groupBy("sha")
            .agg(
                F.count(F.lit(1)).alias("copies"),
                F.min(F.struct("doc_id", "tag")).alias("row"),
                F.first("named").alias("named"),
                F.first("places").alias("places"),
            )
            # Written with the table, so it is fixed from here on.
            .withColumn("class", F.monotonically_increasing_id()),
            "merged",
        )
        self.described = keep(described.select("doc_id", "n_words", "sha"), "documents")
        scratch.drop(described)
        classes = keep(merged.select("class", "sha", "copies", "row.doc_id", "row.tag"), "classes")
        named = merged.select("class", "copies", F.explode(F.arrays_zip("named", "places")).alias("w"))
        named = named.select("class", "copies", F.col("w.named").alias("value"), F.col("w.places").alias("place"))
        places = keep(_repeated(named, F.sum("copies"), scratch), "places")
        scratch.drop(merged)
        self.copied = classes.filter("copies > 1").select("sha")
        candidates = places.join(classes.withColumnsRenamed({"doc_id": "first_id", "tag": "first_tag"}), "class")
        # The corpus is shuffled here, once; later levels move what still repeats.
        texts = keep(
            source.join(
                candidates,
                source["doc_id"].eqNullSafe(candidates["first_id"]) & (source["tag"] == candidates["first_tag"]),
            ).select("class", "sha", "copies", "text", "places"),
            "texts",
        )
        work = texts.select("class", "sha", "text", "places")
        for before, size in zip([first, *longer], longer):
            rows = keep(
                work.mapInArrow(_named_rows(window, before, size), "class long, value long, place int"), "rows"
            )
            places = keep(_repeated(rows, F.count(F.lit(1)), scratch), "places")
            scratch.drop(rows)
            work = texts.drop("places").join(places, "class").select("class", "sha", "text", "places")
        single = texts.filter("copies = 1").drop("places").join(places, "class")
        self.partly = keep(
            single.select("class", "sha", "text", "places").mapInArrow(
                _keep_words(window), "sha binary, n_removed long, kept_sha binary, kept binary"
            ),
            "partly",
        )
        scratch.drop(texts)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    found = Repeats(docs, doc_id, text, window)
    judged = found.described.join(found.copied.withColumn("whole", F.lit(True)), "sha", "left").join(
        found.partly.select("sha", "n_removed", "kept_sha"), "sha", "left"
    )
    nothing = F.unhex(F.sha2(F.lit(""), 256))
    kept = F.when(F.col("whole"), nothing).otherwise(F.coalesce("kept_sha", "sha"))
    return judged.select(
        "doc_id",
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(kept)).alias("kept_sha256"),
    )


def remaining_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(sha, kept): what is left of each word sequence that loses words, copies as empty."""
    found = Repeats(docs, doc_id, text, window)
    whole = found.copied.select("sha", F.lit("").alias("kept"))
    return found.partly.select("sha", F.col("kept").cast("string").alias("kept")).union(whole)
