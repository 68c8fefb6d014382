"""Personal data: fixed patterns, and a semi-Markov conditional random field beside them.

Patterns find emails, IP addresses, card numbers and phone numbers in whole texts; each
is searched in time linear in the text. The field works on islands, runs of neighbouring
chunks that hold a digit or an ``@``. An island is cut into tokens; every run of at most
``LONGEST`` tokens is a candidate segment, scored as a whole (its shape, its digit
groups, length, check sum, the word before it) for each type, and dynamic programming
over the tokens chooses boundaries and types together. Weights maximise the conditional
likelihood, by forward and backward sums, on a bounded sample of islands. These are labelled
by the patterns, by names that announce a secret (``token = "..."``), and by what becomes of
pattern spans that are written otherwise: a phone without its plus stays a phone, the first
digits of a number are plain text. So the field knows forms that no pattern finds: phones
without a plus, and secrets (mixed runs of letters and digits) by their own looks, announced
or not. A segment that the best path takes is added if its log odds against plain text pass a
margin and it meets no pattern's span.

Defined cases: null and empty texts have no spans. Offsets are code points, ends
exclusive. Spans are ordered by kind, then start; of types that score alike the one listed
first is taken. Rows that repeat, and null ids, are judged alike. Texts may have any length;
an empty table gives an empty one; other columns are ignored. Without labelled islands the
patterns alone answer.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import ready

KINDS = ("email", "ip", "card", "phone")
#: What the field tells apart: the kinds of the patterns, and secrets.
TYPES = (*KINDS, "secret")

#: Islands that the field is fitted on, and the longest of them in characters.
SAMPLE_ISLANDS, SAMPLE_CHARS = 600, 200
#: Tokens of a segment, and digits of one without an @.
LONGEST, LEAST_DIGITS = 14, 4
#: Log odds that an added segment needs.
MARGIN = 4.0

# The patterns of the base spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """One look at each @: the local part is the whole run before it, back to the last match."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1, start):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", at + 1 if not found else end)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(_octet(p) for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


_HIT = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
#: Letters and digits of a mixed run, which is one token.
MIXED = 16
_TOKEN = re.compile(
    rf"(?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{{{MIXED},}}|[0-9]+|[A-Za-z]+|\s+|[^\s]", re.ASCII
)
_ANNOUNCED = re.compile(
    rf"(?i)(?:token|secret|password|passwd|pwd|api[ _-]?key|key)[\x20\t]*[=:][\x20\t]*[\"']?([a-z0-9]{{{MIXED},}})(?![a-z0-9])"
)


def _mixed(token: str) -> bool:
    return len(token) >= MIXED and not token.isdigit() and not token.isalpha() and token.isalnum()


def announced(text: str) -> list[tuple[str, int, int]]:
    """Secrets that a name stands before. They teach the field; they are not spans by themselves."""
    return [("secret", *m.span(1)) for m in _ANNOUNCED.finditer(text) if _mixed(m[1])]


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of chunks with a digit or @; chunks are parted by one or two white spaces."""
    hit = _HIT.search(text)
    start = end = None
    while hit:
        at = hit.start()
        left = at
        while left > (end or 0) and not text[left - 1].isspace():
            left -= 1
        stop = _SPACE.search(text, at)
        right = stop.start() if stop else len(text)
        if end is not None and left - end <= 2 and not text[end:left].strip():
            end = right
        else:
            if end is not None:
                yield start, end
            start, end = left, right
        hit = _HIT.search(text, right)
    if end is not None:
        yield start, end


def _bucket(n: int) -> str:
    return str(n) if n < 8 else "8-9" if n < 10 else "10-12" if n < 13 else "13-19" if n < 20 else "20+"


def features(tokens: list[str], first: int, last: int, before: str) -> list[str]:
    """Features of the segment tokens[first:last] as a whole."""
    part = tokens[first:last]
    text = "".join(part)
    digits = _digits(text)
    groups = [len(t) for t in part if t[0].isdigit()]
    marks = "".join(sorted({t[0] for t in part if not t[0].isalnum()}))
    out = [
        f"digits:{_bucket(len(digits))}",
        f"groups:{'-'.join(map(str, groups[:6]))}" if len(groups) < 7 else "groups:many",
        f"marks:{marks[:6]}",
        f"starts:{'d' if part[0][0].isdigit() else 'a' if part[0][0].isalpha() else part[0][0]}",
        f"ends:{'d' if part[-1][0].isdigit() else 'a' if part[-1][0].isalpha() else part[-1][0]}",
        f"letters:{any(t[0].isalpha() for t in part)}",
        f"word:{before}",
    ]
    following = tokens[last] if last < len(tokens) else " "
    preceding = tokens[first - 1] if first else " "
    out.append(f"cut:{preceding[0].isalnum()}{following[0].isalnum()}{following[0] == '.'}")
    if 13 <= len(digits) <= 19:
        out.append(f"luhn:{luhn(digits)}")
    if len(groups) == 4 and marks == ".":
        out.append(f"octets:{all(_octet(t) for t in part if "0" <= t[0] <= "9")}")
    mixed = [t for t in part if _mixed(t)]
    if mixed:
        out.append(f"mixed:{len(part)}:{min(len(mixed[0]) // 8, 8)}:{set(mixed[0].lower()) <= set('0123456789abcdef')}")
    if "@" in text:
        out.append(f"at:{text.count('@')}:{'.' in text.split('@')[-1].strip('.')}")
    return out


def candidates(tokens: list[str]) -> Iterator[tuple[int, int]]:
    """Segments that can be data at all: with an @, or without letters and with
    ``LEAST_DIGITS`` digits; on one line, from a letter, digit, + or ( to a letter or digit.
    A mixed run is a segment by itself."""
    n = len(tokens)
    next_at = [n + LONGEST] * (n + 1)  # none ahead: out of reach
    for i in range(n - 1, -1, -1):
        next_at[i] = i if tokens[i] == "@" else next_at[i + 1]
    for i, token in enumerate(tokens):
        if not (token[0].isalnum() or token[0] in "+("):
            continue
        at, digits = next_at[i], 0
        if _mixed(token):
            yield i, i + 1
        for j in range(i, min(n, i + LONGEST)):
            c = tokens[j][0]
            if at >= i + LONGEST and _mixed(tokens[j]):
                break
            if c.isspace():
                if j < at < i + LONGEST or "\n" in tokens[j]:
                    break  # no blanks in an address, no data over lines
            elif c.isdigit():
                digits += len(tokens[j])
            elif c.isalpha() and at >= i + LONGEST:
                break
            if c.isalnum() and (at < j or at >= i + LONGEST and digits >= LEAST_DIGITS):
                yield i, j + 1


class Field:
    """The weights, and what they say of one island."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.weights = defaultdict(float, weights or {})

    def scores(self, tokens: list[str], before: str) -> dict[tuple[int, int], tuple[list[str], list[float]]]:
        """For each candidate segment its features and its score by kind (plain text: 0)."""
        out = {}
        weigh = self.weights
        for i, j in candidates(tokens):
            found = features(tokens, i, j, before if i == 0 else "")
            out[i, j] = found, [sum(weigh.get((k, f), 0.0) for f in found) for k in TYPES]
        return out

    def best(self, tokens: list[str], before: str) -> list[tuple[int, int, str, float]]:
        """Segments (first, last, kind, log odds) of the best path."""
        scored = self.scores(tokens, before)
        ends = defaultdict(list)
        for (i, j), (_, by_kind) in scored.items():
            top = max(range(len(TYPES)), key=by_kind.__getitem__)
            if by_kind[top] > 0:
                ends[j].append((i, top, by_kind[top]))
        value, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            value[j] = value[j - 1]
            for i, kind, score in ends[j]:
                if value[i] + score > value[j]:
                    value[j], back[j] = value[i] + score, (i, TYPES[kind], score)
        out, j = [], len(tokens)
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind, score = back[j]
                out.append((i, j, kind, score))
                j = i
        return out[::-1]

    def step(self, tokens: list[str], before: str, gold: set[tuple[int, int, str]], rate: float) -> None:
        """One ascent on the conditional log likelihood of the gold segments."""
        scored = self.scores(tokens, before)
        n = len(tokens)
        by_end, by_start = defaultdict(list), defaultdict(list)
        for (i, j), (_, by_kind) in scored.items():
            total = _log_sum(by_kind)
            by_end[j].append((i, total))
            by_start[i].append((j, total))
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = _log_sum([ahead[j - 1], *(ahead[i] + s for i, s in by_end[j])])
        for i in range(n - 1, -1, -1):
            behind[i] = _log_sum([behind[i + 1], *(behind[j] + s for j, s in by_start[i])])
        for (i, j), (found, by_kind) in scored.items():
            for kind, score in zip(TYPES, by_kind, strict=True):
                move = ((i, j, kind) in gold) - math.exp(ahead[i] + score + behind[j] - ahead[n])
                if abs(move) > 1e-3:
                    for f in found:
                        self.weights[kind, f] += rate * move


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _island(text: str, start: int, end: int) -> tuple[list[str], list[int], str]:
    """Tokens, their starts, and the word before the island."""
    found = list(_TOKEN.finditer(text, start, end))
    before = text[max(0, start - 24) : start].split()
    word = before[-1].strip(":=.,;\"'").lower() if before else ""
    return [m[0] for m in found], [m.start() for m in found], word


def rewritten(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """The text with one span written otherwise, and the spans that are right for it."""

    def put(span: tuple[str, int, int], new: str, kind: str | None) -> tuple[str, list[tuple[str, int, int]]]:
        _, a, b = span
        moved = len(new) - (b - a)
        others = [
            (k, x + moved * (x >= b), y + moved * (x >= b)) for k, x, y in spans if (k, x, y) != span and (y <= a or x >= b)
        ]
        return text[:a] + new + text[b:], others + ([(kind, a, a + len(new))] if kind else [])

    for span in spans:
        kind, a, b = span
        own = text[a:b]
        if kind == "phone":
            yield put(span, own.lstrip("+"), "phone")
            yield put(span, "".join(c if c.isdigit() else "-" for c in own.lstrip("+")).replace("--", "-"), "phone")
        elif kind == "card":
            yield put(span, _digits(own)[:4], None)
            yield put(span, _digits(own)[:7], None)
        elif kind == "ip":
            yield put(span, ".".join(own.split(".")[:2]), None)


def fit(samples: list[str], rounds: int = 6) -> Field:
    """Learn from islands with a little text before them, as they are and rewritten."""
    field = Field()
    ready_made = []
    for sample in samples:
        spans = base_spans(sample) + announced(sample)
        for text, right in ((sample, spans), *rewritten(sample, spans)):
            for start, end in islands(text):
                tokens, starts, before = _island(text, start, end)
                place = {s: i for i, s in enumerate([*starts, end])}
                gold = {(place[a], place[b], k) for k, a, b in right if a in place and b in place}
                ready_made.append((tokens, before, gold))
    for turn in range(rounds):
        for tokens, before, gold in ready_made:
            field.step(tokens, before, gold, 0.5 / (1 + turn))
    return field


def all_spans(text: str, field: Field) -> list[tuple[str, int, int]]:
    """Pattern spans and those that the field adds, by kind and start."""
    base = base_spans(text)
    added = []
    taken = sorted((a, b) for _, a, b in base)
    at = 0
    for start, end in islands(text):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        upto = at
        while upto < len(taken) and taken[upto][0] < end:
            upto += 1
        near = taken[at:upto]
        tokens, starts, before = _island(text, start, end)
        for i, j, kind, odds in field.best(tokens, before):
            a, b = starts[i], starts[j - 1] + len(tokens[j - 1])
            if odds >= MARGIN and not any(x < b and a < y for x, y in near):
                added.append((kind, a, b))
    return sorted(base + added, key=lambda s: (TYPES.index(s[0]), s[1], s[2]))


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sample_islands(docs: DataFrame, text: str, islands_at_most: int = SAMPLE_ISLANDS) -> list[str]:
    """Islands of bounded length and number, chosen by a hash, each with its left context."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [t[max(0, a - 24) : b] for a, b in islands(t) if b - a <= SAMPLE_CHARS]
        )

    marked = docs.filter(F.col(text).rlike("[0-9@]")).select(F.explode(cut(text)).alias("island"))
    rows = marked.groupBy("island").agg(F.first(F.xxhash64("island")).alias("draw"))
    return [r.island for r in rows.orderBy("draw", "island").limit(islands_at_most).collect()]


def report(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", islands_at_most: int = SAMPLE_ISLANDS
) -> DataFrame:
    """One row per document: doc_id, counts by kind, base (pattern spans), spans (all)."""
    ready(docs.sparkSession)
    field = Field(dict(fit(sample_islands(docs, text, islands_at_most)).weights))

    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            t = t or ""
            if not _HIT.search(t):
                rows.append((0, 0, 0, 0, "", ""))
                continue
            base, every = base_spans(t), all_spans(t, field)
            rows.append((*(sum(s[0] == k for s in base) for k in KINDS), _written(base), _written(every)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    judged = F.pandas_udf(judge, "n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
    return docs.select(F.col(doc_id).alias("doc_id"), judged(F.coalesce(F.col(text), F.lit(""))).alias("p")).select(
        "doc_id", "p.*"
    )
