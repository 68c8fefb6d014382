"""Conversation structure repair: the cheapest edits that make turns alternate.

A conversation is right when the first letters of its roles read ``(s?(ua)+)?``. Keeping a turn
costs 0, giving it the role user or assistant 3, deleting it 4, inserting an empty turn of user
or assistant 3. A turn that is blank or repeats an earlier one (same role and text) must go; one
whose text breaks off (its last character but white space is none of ``.!?``) costs 3 more when
it stays. Of the cheapest edits those with the ASCII-least audit are taken: the letters D, I, K, R
(delete, insert, keep, rerole) in order.

Wagner-Fischer: turns are aligned with the alternating string. All target lengths share one
table, since the target read from its end is the same for all; its first row holds the cost of
each feasible length. Cells that cannot be on a path cheaper than a greedy repair are not
computed (Ukkonen's band). Every length that reaches the least cost is traced from the front,
taking the ASCII-least edit that stays on a cheapest path, and the audits are compared.

A conversation is cut into runs of ``RUN`` turns. A run is aligned for each state that may lie
before and after it (nothing yet, after s, after u, after a), and the states are chained; an
insertion belongs to the turn it stands before, so audits of equal cost compare run by run.
Time is in proportion to the turns, however many one conversation has. What a task holds of a
conversation is what its audit cell holds, a few letters a turn; texts are streamed past the
audit in order and never gathered.

Order of turns: by turn (null first), then by hash of role and text. Cases: null role or text
counts as one space; a null conv_id is a conversation of its own; equal rows repeat each other;
blank turns are no duplicates; texts may have any length; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import Scratch

RUN = 256
REROLE, DELETE, INSERT, BROKEN = 3, 4, 3, 3
_NEVER = 1 << 40
_SPACE = " \t\n\x0b\x0c\r"
_ROLES = {"u": "user", "a": "assistant"}
#: States between two turns: nothing emitted, last emitted s, u or a.
_START, _S, _U, _A = range(4)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that a checksum of conv_id and turn
    chooses: of 20, 0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats the
    row, 4 makes its role user. Nulls are one space."""
    key = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    text = F.coalesce("text", F.lit(" "))
    return (
        conversations.withColumn("kind", F.crc32(key) % 20)
        .filter("kind <> 0")
        .select(
            "conv_id",
            F.col("turn").cast("long").alias("turn"),
            F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
            F.when(F.col("kind") == 1, "")
            .when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", ""))
            .otherwise(text)
            .alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def _prepared(turns: DataFrame) -> DataFrame:
    """Turns without nulls in role and text, with the digest that orders equal turns."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest")
    )


class Run:
    """One run of turns: first letters of the roles, which must go, which are broken off."""

    def __init__(self, letters: list[str], goes: np.ndarray, broken: np.ndarray, last: bool):
        self.letters, self.n, self.last = letters, len(letters), last
        self.stays = np.where(goes, _NEVER, BROKEN * broken)
        rerole = self.stays + REROLE
        is_u = np.array([c == "u" for c in letters], dtype=bool)
        is_a = np.array([c == "a" for c in letters], dtype=bool)
        #: Cost of ending up as user and as assistant.
        self.as_role = {"u": np.where(is_u, self.stays, rerole), "a": np.where(is_a, self.stays, rerole)}
        self.tables: dict[str, np.ndarray] = {}
        self.bound = max(self.greedy("u"), self.greedy("a")) + REROLE + INSERT

    def greedy(self, expected: str) -> int:
        """Cost of one repair of the run; any end is reached for an insertion and a role more."""
        cost = 0
        u, a = self.as_role["u"].tolist(), self.as_role["a"].tolist()
        for i in range(self.n):
            here = u[i] if expected == "u" else a[i]
            if here < DELETE:
                cost += here
                expected = "a" if expected == "u" else "u"
            else:
                cost += DELETE
        return cost

    def table(self, final: str) -> np.ndarray:
        """``[i, k]``: least cost of turns i... against the last k letters of an alternating
        string that ends in ``final``. Only the last run may end in insertions."""
        if final not in self.tables:
            n, wide = self.n, self.n + self.bound // INSERT + 2
            other = "u" if final == "a" else "a"
            k = np.arange(wide)
            cost = np.full((n + 1, wide), _NEVER)
            cost[n] = INSERT * k if self.last else np.where(k == 0, 0, _NEVER)
            odd = k % 2 == 1
            for i in range(n - 1, -1, -1):
                left = n - i
                lo, hi = max(0, left - self.bound // DELETE), min(wide, left + self.bound // INSERT + 1)
                below = cost[i + 1]
                step = below[lo:hi] + DELETE
                matched = np.where(odd[lo:hi], self.as_role[final][i], self.as_role[other][i])
                first = max(lo, 1)
                step[first - lo :] = np.minimum(step[first - lo :], below[first - 1 : hi - 1] + matched[first - lo :])
                slope = INSERT * k[lo:hi]
                cost[i, lo:hi] = np.minimum.accumulate(step - slope) + slope
            self.tables[final] = np.minimum(cost, _NEVER)
        return self.tables[final]

    def trace(self, final: str, i: int, k: int) -> str:
        """ASCII-least audit of a cheapest path from cell (i, k)."""
        cost, out = self.table(final), []
        other = "u" if final == "a" else "a"
        while i < self.n or k:
            here = cost[i, k]
            letter = final if k % 2 else other
            if i < self.n and cost[i + 1, k] + DELETE == here:
                out.append("D")
                i += 1
            elif k and cost[i, k - 1] + INSERT == here:
                out.append("I")
                k -= 1
            else:
                out.append("K" if self.letters[i] == letter else "R")
                i += 1
                k -= 1
        return "".join(out)

    def best(self, before: int, after: int) -> tuple[int, str] | None:
        """Least (cost, audit) of the run between two states."""
        found: list[tuple[int, tuple]] = []
        if before == after or (before == _START and self.last and after == _A):
            # Nothing but deletions. A conversation may end with nothing in it.
            found.append((DELETE * self.n, ("D" * self.n,)))
        final = {_U: "u", _A: "a"}.get(after)
        if final:
            expected = "a" if before == _U else "u"
            cost = self.table(final)
            start = 1 if final == expected else 2
            ways = [(int(cost[0, k]), ("", 0, k)) for k in range(start, cost.shape[1], 2)]
            if before == _START:
                for i, letter in enumerate(self.letters):
                    if letter == "s" and self.stays[i] < _NEVER:
                        paid = DELETE * i + int(self.stays[i])
                        ways += [
                            (paid + int(cost[i + 1, k]), ("D" * i + "K", i + 1, k))
                            for k in range(start, cost.shape[1], 2)
                        ]
            least = min(w[0] for w in ways)
            found += [w for w in ways if w[0] == least]
        elif before == _START and after == _S:
            for i, letter in enumerate(self.letters):
                if letter == "s" and self.stays[i] < _NEVER:
                    paid = DELETE * (self.n - 1) + int(self.stays[i])
                    found.append((paid, ("D" * i + "K" + "D" * (self.n - 1 - i),)))
        found = [f for f in found if f[0] < _NEVER]
        if not found:
            return None
        least = min(f[0] for f in found)
        audits = [p[0] if len(p) == 1 else p[0] + self.trace(final, p[1], p[2]) for c, p in found if c == least]
        return least, min(audits)


def align(letters: list[str], goes: np.ndarray, broken: np.ndarray, run: int = RUN) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of one conversation."""
    n = len(letters)
    if not n:
        return 0, ""
    #: For each state: cost, place of its audit among those of the states, link to the parts.
    states: dict[int, tuple] = {_START: (0, 0, None)}
    for at in range(0, n, run):
        part = Run(letters[at : at + run], goes[at : at + run], broken[at : at + run], at + run >= n)
        reached: dict[int, tuple] = {}
        for after in [_A] if part.last else range(4):
            options = []
            for before, (cost, place, link) in states.items():
                if found := part.best(before, after):
                    options.append((cost + found[0], place, found[1], link))
            if options:
                reached[after] = min(options, key=lambda o: o[:3])
        audits = sorted({o[1:3] for o in reached.values()})
        states = {s: (c, audits.index((p, t)), (link, t)) for s, (c, p, t, link) in reached.items()}
    cost, _, link = states[_A]
    parts = []
    while link:
        link, text = link[0], link[1]
        parts.append(text)
    return cost, "".join(reversed(parts))


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is kept of one conversation while its turns pass: a few letters a turn."""

    def __init__(self, conv):
        self.conv, self.letters = conv, []
        self.goes, self.broken = bytearray(), bytearray()
        self.blank = self.duplicate = self.illegal = self.turns = 0
        self.first = self.final = self.seen = None

    def add(self, turn, digest: str, letter: str, blank: bool, open_end: bool, later: bool, copies: int) -> None:
        repeats = not blank and (later or self.seen == (turn, digest))
        self.seen = (turn, digest)
        for i in range(copies):
            again = not blank and (repeats or i > 0)
            if self.letters and self.letters[-1] + letter not in _LEGAL:
                self.illegal += 1
            self.letters.append(letter)
            self.goes.append(blank or again)
            self.broken.append(open_end and not blank and not again)
            self.blank += blank
            self.duplicate += again
        if turn is not None:
            self.turns += self.final != turn
            self.first = turn if self.first is None else self.first
            self.final = turn

    def result(self) -> tuple:
        goes, broken = np.frombuffer(self.goes, np.uint8) > 0, np.frombuffer(self.broken, np.uint8).astype(np.int64)
        cost, audit = align(self.letters, goes, broken)
        gaps = 0 if self.first is None else self.final - self.first + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, int(broken.sum()), self.illegal, cost, audit)


def audits(turns: DataFrame, ids: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``ids`` (conv_id) names conversations that get a row even without turns.
    """
    scratch = scratch or Scratch(turns.sparkSession, "repair")
    spoken = F.rtrim("text", F.lit(_SPACE))
    slim = (
        _prepared(turns)
        .select(
            "conv_id",
            "turn",
            "digest",
            F.substring("role", 1, 1).alias("letter"),
            (spoken == "").alias("blank"),
            (~F.substring(spoken, -1, 1).isin(".", "!", "?")).alias("open_end"),
        )
        # Copies in one turn are counted, so a row repeated without end is one row.
        .groupBy("conv_id", "turn", "digest", "letter", "blank", "open_end")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    slim = scratch.keep(slim, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    repeated = (
        slim.filter("not blank")
        .groupBy("conv_id", "digest")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("conv_id").alias("in_conv"), F.col("digest").alias("said"), "first")
    )
    # Written, so that adaptive execution may split the turns that say the same.
    repeated = scratch.keep(repeated, "repeated")
    same = F.col("conv_id").eqNullSafe(F.col("in_conv")) & (F.col("digest") == F.col("said"))
    marked = slim.join(repeated, same, "left").select(
        *slim.columns, (F.col("first").isNotNull() & ~F.col("first.at").eqNullSafe(F.col("turn"))).alias("later")
    )
    if ids is not None:
        named = ids.select("conv_id").distinct().withColumn("copies", F.lit(0).cast("long"))
        marked = marked.unionByName(named, allowMissingColumns=True)
    dealt = marked.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kind = None, None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * 8
            types = [kind, *[pa.int64()] * 6, pa.string()]
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"],
            )
            done.clear()
            return made

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in zip(*[batch.column(c).to_pylist() for c in _SLIM]):
                if current is None or current.conv != row[0]:
                    if current:
                        done.append(current.result())
                    current = _Conversation(row[0])
                if row[-1]:
                    current.add(*row[1:])
            if len(done) >= 256:
                yield flush()
        if current:
            done.append(current.result())
            yield flush()

    kind = turns.schema["conv_id"].dataType.simpleString()
    return dealt.select(*_SLIM).mapInArrow(walk, f"conv_id {kind}, {_RESULT}")


_SLIM = ["conv_id", "turn", "digest", "letter", "blank", "open_end", "later", "copies"]
_MARKS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


class _Repairing:
    """Follows one audit along its turns and says what comes out, in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.expected, self.emitted = audit, 0, "u", 0

    def _out(self, letter: str, role: str, text: str, edit: str) -> tuple:
        self.emitted += 1
        if letter in _ROLES:
            self.expected = "a" if letter == "u" else "u"
        return self.emitted, role, text, edit

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._out(self.expected, _ROLES[self.expected], "", "I")

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._out(role[:1], role, text, edit)
        elif edit == "R":
            yield self._out(self.expected, _ROLES[self.expected], text, edit)


def _streamed(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit row, then its turns in order, in one partition."""
    texts = _prepared(turns)
    both = found.withColumn("is_turn", F.lit(False)).unionByName(
        texts.withColumn("is_turn", F.lit(True)), allowMissingColumns=True
    )
    order = ["conv_id", "is_turn", F.col("turn").asc_nulls_first(), "digest"]
    return both.repartition("conv_id").sortWithinPartitions(*order)


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, position from 1, role, text, edit)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, doing, kind = None, None, None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "is_turn", "audit", "role", "text")]
            for c, is_turn, audit, role, text in zip(*columns):
                if not is_turn:
                    if doing:
                        out += [(conv, *made) for made in doing.inserted()]
                    conv, doing = c, _Repairing(audit)
                else:
                    out += [(conv, *made) for made in doing.turn(role, text)]
            yield _turn_rows(out, kind)
        if doing:
            yield _turn_rows([(conv, *made) for made in doing.inserted()], kind)

    kind = turns.schema["conv_id"].dataType.simpleString()
    return _streamed(turns, found.select("conv_id", "audit")).mapInArrow(
        walk, f"conv_id {kind}, position bigint, role string, text string, edit string"
    )


def _turn_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "position", "role", "text", "edit"]
    )


def report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``audits`` with ``repaired_sha256``: the hash of the repaired turns as ``role:text``,
    joined by line ends."""
    scratch = Scratch(turns.sparkSession, "repair")
    found = scratch.keep(audits(turns, ids, scratch), "audits")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, doing, schema = None, None, None
        done: list[tuple] = []

        def hashed(made: Iterator[tuple]) -> None:
            for position, role, text, _ in made:
                doing[1].update(("\n" if position > 1 else "").encode() + f"{role}:{text}".encode())

        def close() -> None:
            hashed(doing[0].inserted())
            done.append((*conv, doing[1].hexdigest()))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * 9
            types = [schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", *_MARKS, "repaired_sha256"]
            )

        for batch in batches:
            schema = batch.schema
            marks = zip(*[batch.column(c).to_pylist() for c in ["conv_id", *_MARKS]])
            columns = zip(*[batch.column(c).to_pylist() for c in ("is_turn", "role", "text")], marks)
            for is_turn, role, text, row in columns:
                if not is_turn:
                    if doing:
                        close()
                    conv, doing = row, (_Repairing(row[-1]), hashlib.sha256())
                else:
                    hashed(doing[0].turn(role, text))
            if len(done) >= 256:
                yield flush()
        if doing:
            close()
            yield flush()

    kind = turns.schema["conv_id"].dataType.simpleString()
    return _streamed(turns, found).mapInArrow(walk, f"conv_id {kind}, {_RESULT}, repaired_sha256 string")
