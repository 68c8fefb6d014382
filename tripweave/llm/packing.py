"""Best-fit packing of documents into training sequences, under conflicts.

Documents are cut into pieces of at most ``capacity`` words and dealt by a hash into
shards of about ``shard_rows`` pieces, so a task holds one shard and never a whole source
or group of copies. Within a shard, longest first, a piece goes to the bin with the least
room that still fits it and does not conflict: the bins stand in the order of their room,
each with a bitmap of its sources and one of its duplicate clusters, and the search goes
from the tightest bin to its successors until one is compatible; else a bin is opened.
Two pieces of one source or one cluster never share a bin.

Defined cases: a document without words takes no room and gets no bin (null). A null
source or cluster conflicts with nothing; null text has no words. Rows that repeat are
numbered (``copy``) and packed each for itself, in different bins, since they share a
cluster. Pieces of one document share its cluster too. An empty table gives an empty one. A text
longer than a bin is cut into pieces, however many. Other columns are left behind, whatever
their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import WORD, Scratch, ready, text_or_empty

#: Words of one training sequence.
CAPACITY = 2048
#: Pieces that one task packs at a time, on average.
SHARD_ROWS = 2048

PACKED = (
    "doc_id long, copy long, piece long, start_word long, n_words long,"
    " bin_id long, position long, bin_words long"
)


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of each piece, in the given order; bins are numbered as they are opened."""
    room: list[tuple[int, int]] = []  # (words left, bin), always in order
    bins: list[list[int]] = []  # bitmaps of the sources and of the clusters
    bits: tuple[dict, dict] = ({}, {})
    chosen = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        marks = [
            0 if value is None else 1 << seen.setdefault(value, len(seen))
            for value, seen in zip((source, cluster), bits, strict=True)
        ]
        at = bisect_left(room, (length, -1))
        while at < len(room):
            taken = bins[room[at][1]]
            if not (taken[0] & marks[0] or taken[1] & marks[1]):
                break
            at += 1
        if at < len(room):
            left, which = room.pop(at)
        else:
            left, which = capacity, len(bins)
            bins.append([0, 0])
        bins[which][0] |= marks[0]
        bins[which][1] |= marks[1]
        if left > length:
            insort(room, (left - length, which))
        chosen.append(which)
    return chosen


def same_words(text: str = "text") -> Column:
    """Cluster of texts that differ in case and white space only."""
    return F.xxhash64(F.regexp_replace(F.lower(text_or_empty(text)), r"[\x20\x09-\x0D]+", " "))


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str | None = "source",
    cluster: Column | None = None,
) -> DataFrame:
    """(doc_id, copy, source, cluster, piece, start_word, n_words), texts left behind.

    Equal rows are counted, partly before the shuffle, and numbered from the count.
    """
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.col(source) if source else F.lit(None)).cast("string").alias("source"),
        (same_words(text) if cluster is None else cluster).alias("cluster"),
        F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("words"),
    )
    numbered = slim.groupBy("doc_id", "source", "cluster", "words").count()
    cuts = F.greatest(F.ceil(F.col("words") / capacity), F.lit(1))
    return (
        numbered.select("*", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
        .select("*", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("piece"))
        .select(
            "doc_id",
            "copy",
            "source",
            "cluster",
            "piece",
            (F.col("piece") * capacity).alias("start_word"),
            F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).alias("n_words"),
        )
    )


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str | None = "source",
    cluster: Column | None = None,
) -> DataFrame:
    """Where each piece goes: doc_id, copy, piece, start_word, n_words, bin_id, position
    in the bin, bin_words (words in the whole bin)."""
    spark = ready(docs.sparkSession)
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces(docs, capacity, doc_id, text, source, cluster), "pieces")
    shards = max(1, -(-cut.count() // shard_rows))
    dealt = cut.filter("n_words > 0").withColumn(
        "shard",
        F.pmod(F.xxhash64("doc_id", "cluster", "copy", "piece"), F.lit(shards)),
    )

    def shard(table: pa.Table) -> pa.Table:
        rows = sorted(
            table.to_pylist(),
            key=lambda r: (-r["n_words"], r["doc_id"] is None, r["doc_id"], r["cluster"], r["copy"], r["piece"]),
        )
        chosen = best_fit(*([r[c] for r in rows] for c in ("n_words", "source", "cluster")), capacity)
        filled = [0] * len(rows)
        members = [0] * len(rows)
        for row, which in zip(rows, chosen, strict=True):
            row["bin_id"] = (row["shard"] << 31) + which
            row["position"] = members[which]
            members[which] += 1
            filled[which] += row["n_words"]
        for row, which in zip(rows, chosen, strict=True):
            row["bin_words"] = filled[which]
        return pa.table({c: pa.array([r[c] for r in rows], pa.int64()) for c in columns})

    columns = [c.split()[0] for c in PACKED.split(",")]
    packed = dealt.groupBy("shard").applyInArrow(shard, PACKED)
    empty = cut.filter("n_words = 0").select(
        "doc_id",
        "copy",
        "piece",
        "start_word",
        "n_words",
        F.lit(None).cast("long").alias("bin_id"),
        F.lit(None).cast("long").alias("position"),
        F.lit(None).cast("long").alias("bin_words"),
    )
    return packed.unionByName(empty)


def sequences(docs: DataFrame, packed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bin_id, text): the words of each bin, pieces joined by an empty line.

    A bin is bounded by the capacity, and so is what is gathered for it. Rows that
    repeat a doc_id must have equal texts here.
    """
    words = F.regexp_extract_all(text_or_empty(text), F.lit(f"({WORD})"), F.lit(1))
    bodies = docs.groupBy(F.col(doc_id).alias("doc_id")).agg(F.first(text).alias("text"))
    cut = (
        packed.filter("bin_id IS NOT NULL")
        .join(bodies.select("doc_id", words.alias("words")), "doc_id")
        .select(
            "bin_id",
            "position",
            F.array_join(
                F.slice("words", F.col("start_word").cast("int") + 1, F.col("n_words").cast("int")),
                " ",
            ).alias("text"),
        )
    )
    whole = F.sort_array(F.collect_list(F.struct("position", "text")))
    return cut.groupBy("bin_id").agg(F.array_join(whole["text"], "\n\n").alias("text"))
