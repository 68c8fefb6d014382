"""Document fingerprints: SimHash votes, and all pairs within a Hamming radius.

A text's terms are its distinct words (lower case, between ASCII white space). Each term has
a hash of 128 bits and votes on every bit, for where its hash has a one and against where it
has a zero, with its length in characters as weight, so that the short words every text has
count little. A bit of the fingerprint is set where the votes for it outweigh those against.

Two 64-bit sums are one addition: a hash is shifted by 0 to 31 and masked to bits 0 and 32, so
one long carries the votes on two bits. A lane overflows only beyond 2^32 characters, more than
a text can have.

Order of documents (``edited``): doc_id descending, null last; among equal ids by hash of the
text, then text. The order is cut into ranges of doc_id at quantiles, an id that fills more than
a range by hash of the text, and a (doc_id, text) that does by row. Whole texts move once, into
their range; the head of the following range is put at the end of each, so that ``lead`` finds
the next document without a window over all rows.

Pairs within a radius (``near_pairs``): the bits are cut into 8 blocks of 16. Two fingerprints
that differ in at most 6 bits agree in 2 blocks at least, so one table for each of the 28 pairs of
blocks, keyed by their bits, holds them together; the first table in which a pair meets reports
it. Only distinct fingerprints are compared.

DataFrame functions only. Cases: null counts as empty text; empty text and white space have the
fingerprint of zeros; a text may have any length; equal rows and rows with equal ids are rows of
their own; one row alone is its own next document; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm.common import Scratch, text_or_empty

#: Bits of a fingerprint, kept as two longs.
BITS = 128
#: Rows of a range, and the most ranges there are; a range of a larger table has more rows.
RANGE_ROWS, RANGES = 256, 65_536
#: The radius that the tables are built for, and the blocks: any two within it agree in
#: ``BLOCKS - RADIUS`` blocks.
RADIUS, BLOCKS = 6, 8
RANGE = ["range", "piece", "row_piece"]
_PAIR_MASK = (1 << 32) | 1


def terms(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _votes(bits: Column, weight: Column, shift: int) -> Column:
    return F.sum(F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(_PAIR_MASK)) * weight)


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with ``high`` and ``low``, the halves of the fingerprint of ``text``.

    A group of equal keys is one text. Rows already dealt by some of ``keys`` do not move.
    """
    exploded = df.select(*keys, F.explode_outer(terms(F.col(text))).alias("term")).select(
        *keys,
        F.coalesce(F.length("term"), F.lit(0)).cast("long").alias("weight"),
        F.xxhash64("term").alias("a"),
        F.xxhash64(F.lit(1), F.col("term")).alias("b"),
    )
    sums = [_votes(F.col(c), F.col("weight"), s).alias(f"{c}{s}") for c in "ab" for s in range(32)]
    voted = exploded.groupBy(*keys).agg(F.sum("weight").alias("total"), *sums)

    def half(c: str) -> Column:
        out = F.lit(0).cast("long")
        for s in range(32):
            lanes = F.col(f"{c}{s}")
            for lane, at in ((lanes.bitwiseAND(F.lit((1 << 32) - 1)), s), (F.shiftrightunsigned(lanes, 32), s + 32)):
                one = F.shiftleft(F.lit(1).cast("long"), at)
                out = out.bitwiseOR(F.when(2 * lane > F.col("total"), one).otherwise(F.lit(0).cast("long")))
        return out

    return voted.select(*keys, half("a").alias("high"), half("b").alias("low"))


def distance(high: Column, low: Column, other_high: Column, other_low: Column) -> Column:
    """Number of bits in which two fingerprints differ."""
    return F.bit_count(high.bitwiseXOR(other_high)) + F.bit_count(low.bitwiseXOR(other_low))


def written(high: Column, low: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def _longs(values: list[int]) -> Column:
    """A constant array that takes no expression for each of its values."""
    return F.from_json(F.lit(str(values)), "array<bigint>")


def _in_ranges(docs: DataFrame, range_rows: int, scratch: Scratch) -> DataFrame:
    """``docs`` (doc_id, text, tie) with the range each row belongs to: ``range`` by doc_id,
    ``piece`` by hash of the text, ``row_piece`` among equal rows. Along the order, none of
    the three ever decreases before the one to its left has grown."""
    rows = docs.count()
    n = max(1, min(RANGES, -(-rows // range_rows)))
    size = -(-rows // n) if rows else 1
    position = F.lit(0)
    if n > 1:
        marks = [i / n for i in range(1, n)]
        bounds = docs.agg(F.percentile_approx("doc_id", marks, 10 * n)).first()[0] or []
        bounds = sorted(set(bounds), reverse=True)
        steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
        cuts = _longs(bounds)
        # Binary search: how many cuts lie above the id.
        position = F.aggregate(
            _longs(steps).cast("array<int>"),
            F.lit(0),
            lambda at, step: F.when(
                F.coalesce(F.get(cuts, at + step - 1) > F.col("doc_id"), F.lit(False)), at + step
            ).otherwise(at),
        )
        position = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(position)
    ranged = docs.withColumn("range", position)
    crowded = ranged.groupBy("range").count().filter(F.col("count") > 4 * size).select("range")
    # At most ``RANGES`` ids, and as many (id, text), can hold a range's rows.
    counts = (
        ranged.join(F.broadcast(crowded), "range", "left_semi")
        .groupBy("doc_id", "tie")
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("doc_id")
        .agg(
            F.sum("copies").alias("of_id"),
            F.map_from_entries(
                F.collect_list(F.when(F.col("copies") > size, F.struct("tie", F.ceil(F.col("copies") / size))))
            ).alias("hot_ties"),
        )
        .filter(F.col("of_id") > size)
        .select(F.col("doc_id").alias("hot_id"), F.ceil(F.col("of_id") / size).alias("pieces"), "hot_ties")
    )
    counts = scratch.keep(counts, "hot-ids")
    share = F.col("tie").cast("double") / 2.0**64 + 0.5
    piece = F.least(F.floor(share * F.col("pieces")), F.col("pieces") - 1)
    copies = F.try_element_at("hot_ties", F.col("tie"))
    return (
        ranged.join(F.broadcast(counts), F.col("doc_id").eqNullSafe(F.col("hot_id")) & F.col("pieces").isNotNull(), "left")
        .withColumn("piece", F.coalesce(piece, F.lit(0)))
        .withColumn(
            "row_piece",
            F.coalesce(F.pmod(F.monotonically_increasing_id(), copies), F.lit(0)),
        )
        .drop("hot_id", "pieces", "hot_ties")
    )


def with_next(docs: DataFrame, scratch: Scratch, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with ``next_text``, dealt by range. ``n`` numbers a
    range's rows; ``extra`` marks the copy of the following range's head."""
    keyed = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    ranged = _in_ranges(keyed.withColumn("tie", F.xxhash64("text")), range_rows, scratch)
    # Complement reverses the order of ids without overflow.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.bitwise_not("doc_id").alias("id"), "tie"))
    heads = ranged.groupBy(*RANGE).agg(first.alias("first"))
    # One slim row for a range: at most a few times ``RANGES``.
    along = Window.partitionBy(F.lit(0)).orderBy(*RANGE)
    around = Window.partitionBy(F.lit(0)).orderBy(*[F.col(c).desc() for c in RANGE])
    places = heads.select(
        *[F.coalesce(F.lag(c).over(along), F.first(c).over(around)).alias(f"to_{c}") for c in RANGE],
        *[F.col(c).alias(f"at_{c}") for c in RANGE],
        F.when(~F.col("first.no_id"), F.bitwise_not("first.id")).alias("first_id"),
        F.col("first.tie").alias("first_tie"),
    )
    here = F.lit(True)
    for c in RANGE:
        here &= F.col(c) == F.col(f"at_{c}")
    places = scratch.keep(places, "heads")
    copies = (
        ranged.join(
            F.broadcast(places),
            here & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")),
        )
        .groupBy(*[F.col(f"to_{c}").alias(c) for c in RANGE])
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("tie"), *RANGE)
    )
    both = ranged.withColumn("extra", F.lit(False)).unionByName(copies.withColumn("extra", F.lit(True)))
    order = Window.partitionBy(*RANGE).orderBy("extra", F.col("doc_id").desc_nulls_last(), "tie", "text")
    return both.select(
        *RANGE,
        "doc_id",
        "text",
        "extra",
        F.row_number().over(order).alias("n"),
        F.lead("text").over(order).alias("next_text"),
    )


def edited(docs: DataFrame, scratch: Scratch, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: its fingerprint (also as ``high`` and ``low``), that of its
    edited text (the last half of its code points replaced by as many of the next document's
    first), and the likeness of its fingerprint to the edited text's and to the next's."""
    length = F.char_length("text")
    half = F.floor(length / 2).cast("int")
    texts = with_next(docs, scratch, range_rows).select(
        *RANGE,
        "n",
        "doc_id",
        "extra",
        length.cast("long").alias("n_chars"),
        F.col("text").alias("own"),
        F.concat(
            F.substring("text", F.lit(1), length - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)
        ).alias("changed"),
    )
    row = [*RANGE, "n", "doc_id", "extra", "n_chars", "edited_sha256"]
    versions = texts.withColumn("edited_sha256", F.sha2(F.col("changed"), 256)).select(
        *row,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("version"), F.col("own").alias("text")),
                F.struct(F.lit(1).alias("version"), F.col("changed").alias("text")),
            )
        ).alias("v"),
    )
    prints = fingerprints(versions.select(*row, "v.version", "v.text"), [*row, "version"], "text")

    def of(version: int, part: str) -> Column:
        return F.max(F.when(F.col("version") == version, F.col(part)))

    paired = prints.groupBy(*row).agg(
        of(0, "high").alias("high"),
        of(0, "low").alias("low"),
        of(1, "high").alias("edited_high"),
        of(1, "low").alias("edited_low"),
    )
    order = Window.partitionBy(*RANGE).orderBy("n")
    with_following = paired.select(
        "*", F.lead("high").over(order).alias("next_high"), F.lead("low").over(order).alias("next_low")
    )

    def likeness(other: str) -> Column:
        apart = distance(F.col("high"), F.col("low"), F.col(f"{other}_high"), F.col(f"{other}_low"))
        return 1 - apart / F.lit(float(BITS))

    return with_following.filter(~F.col("extra")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("high"), F.col("low")).alias("fingerprint"),
        written(F.col("edited_high"), F.col("edited_low")).alias("edited_fingerprint"),
        likeness("edited").alias("near_edited"),
        likeness("next").alias("near_next"),
        "high",
        "low",
    )


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (left_high, left_low, right_high, right_low, distance) of different fingerprints
    in ``prints`` (high, low) at most ``radius`` bits apart, each pair once."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"The tables find distances up to {RADIUS}")
    kept = BLOCKS - RADIUS
    distinct = prints.select("high", "low").distinct()

    def block(high: Column, low: Column, i: int) -> Column:
        part = high if i < 4 else low
        return F.shiftrightunsigned(part, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF).cast("long"))

    tables = []
    for k, chosen in enumerate(combinations(range(BLOCKS), kept)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, 16).bitwiseOR(block(F.col("high"), F.col("low"), i))
        tables.append(key)
    keyed = distinct.select("high", "low", F.explode(F.array(*tables)).alias("key"))
    left = keyed.select("key", F.col("high").alias("left_high"), F.col("low").alias("left_low"))
    right = keyed.select("key", F.col("high").alias("right_high"), F.col("low").alias("right_low"))
    ends = [F.col(c) for c in ("left_high", "left_low", "right_high", "right_low")]
    ordered = (ends[0] < ends[2]) | ((ends[0] == ends[2]) & (ends[1] < ends[3]))
    # The first table in which two fingerprints meet has their first equal blocks.
    mine = F.lit(-1)
    for k, chosen in reversed(list(enumerate(combinations(range(BLOCKS), kept)))):
        same = F.lit(True)
        for i in chosen:
            same &= block(ends[0], ends[1], i) == block(ends[2], ends[3], i)
        mine = F.when(same, k).otherwise(mine)
    apart = distance(*ends)
    # Never broadcast: an explode is planned as if it made one row of each, so the tables are
    # taken to be 28 times smaller than they are, and the driver would build them whole.
    return (
        left.join(right.hint("merge"), "key")
        .filter(ordered & (apart <= radius) & (F.shiftrightunsigned("key", 16 * kept) == mine))
        .select(*ends, apart.alias("distance"))
    )


def report(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``edited`` with ``n_near``: how many other fingerprints of the table lie within the
    radius of the document's own."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    found = scratch.keep(edited(docs, scratch, range_rows), "prints")
    pairs = near_pairs(found)
    ends = pairs.select(F.col("left_high").alias("at_high"), F.col("left_low").alias("at_low")).unionAll(
        pairs.select("right_high", "right_low")
    )
    # Written, so that adaptive execution may split the prints of a frequent text.
    degrees = scratch.keep(ends.groupBy("at_high", "at_low").agg(F.count(F.lit(1)).alias("n_near")), "degrees")
    same = (F.col("high") == F.col("at_high")) & (F.col("low") == F.col("at_low"))
    return (
        found.join(degrees, same, "left")
        .withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
        .drop("high", "low", "at_high", "at_low")
    )
