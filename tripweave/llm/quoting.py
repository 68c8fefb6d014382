"""Quotation linking: replies find what they quote, and conversations lose the quotes.

Only DataFrame functions. A line's quote level is the number of ``>`` it starts with
(blanks between them do not count). Runs of lines of one level above 0 are quoted
passages; each is normalised (lower case, runs of other than letters and digits as one
blank) and hashed. A message offers its own text as original: the whole of it, its
paragraphs, its lines and every run of its consecutive lines, level 0 only; lines without
letters or digits do not count. Of the runs of lines only those are hashed that begin with
the two first lines of a quoted passage and have as many lines as it. A quote that is cut
within a line is no run of lines and is not linked. A passage belongs to the earliest message of its
conversation that offers it, before the quoting one; if there is none, to the earliest
of all conversations. There is one original for each passage, so frequent passages
multiply nothing.

A message replies to the latest message of its conversation that it quotes at its lowest
linked level. Chains of replies are followed by doubling. Ordered by (conv_id, root_turn,
turn), each thread stands together and every reply after what it answers; rows are not
gathered, since a conversation has no bound. Linked passages leave the text; passages
whose original is nowhere stay, for they would be lost.

Defined cases: null text is empty and stays null; null conv_id or turn: the message
is its own root, quotes nothing in its conversation and is no original. Messages that
repeat (conv_id, turn) are judged each by its own text, and any of them can be quoted.
Passages without letters or digits are not linked. "Earliest" of all conversations is the
least conv_id. Of rows that repeat (conv_id, turn) and text any is the original. Texts may
have any length; an empty table gives an empty one. Other columns pass through, whatever
their names (``message`` holds them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import Scratch, ready, text_or_empty

_QUOTING = r"(?m)^[ \t]*>"
_MARKS = r"^(?:[ \t]*>)+[ \t]?"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def with_passages(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``runs``, array of (level, body, lines): runs of lines of one level, in order."""
    shape = "array<struct<level:int,body:string,line:string>>"
    quoting = F.col(text).rlike(_QUOTING)
    lines = F.transform(
        F.split(text, "\r?\n"),
        lambda line: F.struct(
            _level(line).alias("level"), F.regexp_replace(line, _MARKS, "").alias("body"), line.alias("line")
        ),
    )
    # Each array is a column of its own, so that none is made again for every element.
    cut = rows.withColumn("_lines", F.when(quoting, lines).otherwise(F.array().cast(shape)))
    level = lambda i: F.get("_lines", i - 1)["level"]
    places = F.when(F.size("_lines") > 0, F.sequence(F.lit(1), F.size("_lines"))).otherwise(F.array().cast("array<int>"))
    cut = cut.withColumn("_starts", F.filter(places, lambda i: (i == 1) | (level(i) != level(i - 1))))

    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), F.size("_lines") + 1)
        part = F.slice("_lines", start, end - start)
        return F.struct(
            level(start).alias("level"),
            F.array_join(F.transform(part, lambda x: x["body"]), "\n").alias("body"),
            F.array_join(F.transform(part, lambda x: x["line"]), "\n").alias("lines"),
        )

    # Most messages quote nothing and are one run as they are.
    plain = F.array(F.struct(F.lit(0).alias("level"), F.col(text).alias("body"), F.col(text).alias("lines")))
    runs = F.when(F.size("_starts") > 0, F.transform("_starts", run)).otherwise(plain)
    return cut.withColumn("runs", runs).drop("_lines", "_starts")


def offered(runs: Column) -> Column:
    """Normalised originals of a message: its own text whole, by paragraph and by line."""
    own = F.transform(F.filter(runs, lambda r: r["level"] == 0), lambda r: r["body"])
    parts = F.concat(
        F.array(F.array_join(own, "\n")),
        own,
        F.flatten(F.transform(own, lambda t: F.split(t, r"\n[ \t]*\n"))),
        F.flatten(F.transform(own, lambda t: F.split(t, r"\n"))),
    )
    return F.filter(F.array_distinct(F.transform(parts, normalised)), lambda t: t != "")


def _bare_lines(text: Column) -> Column:
    """Normalised lines of a text, without those that have no letters or digits."""
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda t: t != "")


def _runs_of_lines(own: DataFrame, quotes: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, hash) of the runs of own lines that may be quoted passages of two lines or more."""
    asked = scratch.keep(quotes.filter("n_lines > 1").select("head", "n_lines").distinct(), "asked")
    own = own.withColumn("bare", _bare_lines(F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["body"]), "\n")))
    two = F.transform("bare", lambda t, i: F.sha2(F.concat_ws(" ", t, F.get("bare", i + 1)), 256))
    heads = own.withColumn("two", two).select("conv_id", "turn", "body", F.posexplode_outer("two").alias("i", "head"))
    # Places are gathered for each message, so that its lines are carried once.
    places = heads.join(asked, "head").groupBy("conv_id", "turn", "body").agg(
        F.collect_set(F.struct("i", "n_lines")).alias("places")
    )
    places = scratch.keep(places, "places").withColumnsRenamed({"conv_id": "c", "turn": "t", "body": "b"})
    same = (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("body") == F.col("b"))
    inside = F.filter("places", lambda p: p["i"] + p["n_lines"] <= F.size("bare"))
    run = lambda p: F.sha2(F.array_join(F.slice("bare", p["i"] + 1, p["n_lines"]), " "), 256)
    made = own.join(places, same).withColumn("made", F.transform(inside, run))
    return made.select("conv_id", "turn", F.explode_outer("made").alias("hash")).filter("hash IS NOT NULL")


def _links(cut: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, body, at, level, from_conv, from_turn) of each linked passage."""
    # Outer explodes, since the others add filters that Spark moves below the projections,
    # where the lines would be cut anew for every passage.
    quotes = scratch.keep(
        cut.filter(F.col("content").rlike(_QUOTING))
        .select("conv_id", "turn", "body", F.posexplode_outer("runs").alias("at", "run"))
        .filter("run.level > 0")
        .withColumn("bare", _bare_lines(F.col("run.body")))
        .select(
            "conv_id",
            "turn",
            "body",
            "at",
            "run.level",
            F.array_join("bare", " ").alias("passage"),
            F.size("bare").alias("n_lines"),
            F.sha2(F.array_join(F.slice("bare", 1, 2), " "), 256).alias("head"),
        )
        .filter("passage != ''")
        .withColumn("hash", F.sha2("passage", 256)),
        "quotes",
    )
    own = cut.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    originals = (
        own.select("conv_id", "turn", F.explode_outer(offered(F.col("runs"))).alias("passage"))
        .select("conv_id", "turn", F.sha2("passage", 256).alias("hash"))
        .unionByName(_runs_of_lines(own, quotes, scratch))
        .join(quotes.select("hash").distinct(), "hash", "left_semi")
    )
    originals = scratch.keep(
        originals.groupBy("hash", "conv_id").agg(F.min("turn").alias("from_turn")), "originals"
    )
    here = originals.select("hash", "conv_id", F.col("from_turn").alias("here_turn"))
    # The two least conversations: one of them is another one than the quote's own.
    least = F.min(F.struct("conv_id", "from_turn"))
    first = originals.groupBy("hash").agg(least.alias("first"))
    second = (
        originals.join(first, "hash").filter(F.col("conv_id") != F.col("first.conv_id")).groupBy("hash").agg(least.alias("second"))
    )
    anywhere = scratch.keep(first.join(second, "hash", "left"), "anywhere")
    joined = quotes.drop("n_lines", "head").join(here, ["hash", "conv_id"], "left").join(anywhere, "hash", "left")
    own = F.col("here_turn") < F.col("turn")
    abroad = F.when(F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first"))
    joined = joined.withColumn("abroad", abroad)
    linked = joined.select(
        "conv_id",
        "turn",
        "body",
        "at",
        "level",
        F.when(own, F.col("conv_id")).otherwise(F.col("abroad.conv_id")).alias("from_conv"),
        F.when(own, F.col("here_turn")).otherwise(F.col("abroad.from_turn")).alias("from_turn"),
    )
    return scratch.keep(linked.filter("from_turn IS NOT NULL"), "links")


def _roots(replies: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, root_turn) of (conv_id, turn, parent): chains halve each round."""
    here = scratch.keep(replies.groupBy("conv_id", "turn").agg(F.max("parent").alias("up")), "up")
    while True:
        above = here.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("above"))
        moved = scratch.keep(here.join(above, ["conv_id", "up"], "left"), "above")
        if moved.filter("above IS NOT NULL").isEmpty():
            return here.select("conv_id", "turn", F.col("up").alias("root_turn"))
        here = moved.select("conv_id", "turn", F.coalesce("above", "up").alias("up"))


def link_quotes(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text"
) -> DataFrame:
    """The rows of ``messages`` as struct ``message``, with n_quotes, n_linked, reply_to
    (turn), root_turn, from_conv (of a passage from elsewhere) and the text without quotes."""
    scratch = Scratch(ready(messages.sparkSession), "quotes")
    content = text_or_empty(text)
    rows = messages.select(
        F.struct("*").alias("message"),
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.xxhash64(content).alias("body"),
        content.alias("content"),
    )
    rows = with_passages(rows, "content")
    links = _links(rows.drop("message"), scratch)
    inside = links.filter(F.col("from_conv") == F.col("conv_id"))
    lowest = F.min(F.struct("level", (-F.col("from_turn")).alias("minus"))).alias("m")
    replies = inside.groupBy("conv_id", "turn", "body").agg(lowest).select(
        "conv_id", "turn", "body", (-F.col("m.minus")).alias("reply_to")
    )
    replies = scratch.keep(replies, "replies")
    roots = _roots(replies.select("conv_id", "turn", F.col("reply_to").alias("parent")), scratch)
    gone = links.groupBy("conv_id", "turn", "body").agg(
        F.collect_set("at").alias("gone"), F.min(F.when(F.col("from_conv") != F.col("conv_id"), F.col("from_conv"))).alias("from_conv")
    )
    known = scratch.keep(
        gone.join(replies, ["conv_id", "turn", "body"], "left").join(roots, ["conv_id", "turn"], "left"), "known"
    ).withColumnsRenamed({"conv_id": "c", "turn": "t", "body": "b"})
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("body") == F.col("b"))
    joined = rows.join(known, same, "left")
    kept = F.filter("runs", lambda r, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    quotes = F.size(F.filter("runs", lambda r: r["level"] > 0))
    return joined.select(
        "message",
        quotes.cast("long").alias("n_quotes"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_linked"),
        "reply_to",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        "from_conv",
        F.when(F.col(f"message.{text}").isNotNull(), F.array_join(F.transform(kept, lambda r: r["lines"]), "\n")).alias("text"),
    )
