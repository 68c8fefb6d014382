"""Lexical search, conversation repair and fingerprints against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tripweave.llm import fingerprints, ranking, repair

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item string, score string, n string, term string"
EXTRA = ("a", "b", "c", "d")


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], DOCS).repartition(parts)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 7) for i, t in rows], "item_id long, text string, rank int")


# -- ranked lexical search -------------------------------------------------------------


def lowered(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def search_by_hand(docs, items, top=20):
    cut = [(i, lowered(t)) for i, t in docs]
    held = [(i, t) for i, t in cut if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = Counter(term for _, t in held for term in set(t))
    out = []
    asked = {}
    for item, text in sorted(set(items), key=repr):
        asked.setdefault(item, Counter()).update(lowered(text))
    for item, terms in asked.items():
        scored = []
        for doc, words in held:
            tf, m = Counter(words), 75 + (25 * len(words) * n_docs) // n_terms
            score = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
                for t, k in terms.items()
                if tf[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (s, none, doc) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if none else doc, -s))
    return sorted(out, key=repr)


def some_texts(seed, n):
    rnd = random.Random(seed)
    words = ["Ape", "bee", "cat", "dög", "ELK", "fox2", "gnu", "hen", "日本", "x"]
    made = [" ".join(rnd.choices(words, k=rnd.randint(1, 12))) for _ in range(n)]
    return [t.replace(" ", rnd.choice([" ", "-", "\x7f", "\x00", "_"])) for t in made]


@pytest.mark.parametrize("limit", [ranking.ITEM_TERMS, 5, 1])
def test_search_equals_brute_force(spark, limit):
    texts = some_texts(1, 60)
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "ape bee"), (None, None), (77, ""), (78, " .,")]
    docs += [(i, "tie tie") for i in range(100, 140)]
    items = [(1, "ape ape fox2 日本"), (1, "extra cat"), (1, "extra cat"), (2, "tie"), (3, None), (4, "nothing here"), (None, "elk")]
    got = ranking.search(docs_of(spark, docs), items_of(spark, items), item_terms=limit).collect()
    assert sorted((tuple(r) for r in got), key=repr) == search_by_hand(docs, items)


def test_search_of_nothing(spark):
    docs, items = docs_of(spark, [(1, "ape")]), items_of(spark, [(1, "ape")])
    none_docs, none_items = docs_of(spark, []), items_of(spark, [])
    assert ranking.search(none_docs, items).count() == 0
    assert ranking.search(docs, none_items).count() == 0
    long = docs_of(spark, [(1, "ape " * 200_000), (2, "ape bee")])
    assert [r.doc_id for r in ranking.search(long, items).orderBy("rank").collect()] == [1, 2]


def test_tiles_stay_exact():
    # Whole numbers near the bound: tiles are cut until every row sum is below 2^53.
    values = np.array([4e9, 4e9, 4e9, 1.0, 2.0])
    tiles = ranking.ItemTiles(np.array([0, 0, 0, 0, 1]), np.array([0, 1, 2, 3, 3]), values, 2)
    (rows, parts), = tiles.tiles
    assert len(parts) > 1 and all(m.sum(axis=1).max() * ranking.FULL < ranking.EXACT for _, m in parts)
    assert sum(m.sum() for _, m in parts) == values.sum()
    with pytest.raises(OverflowError):
        ranking.ItemTiles(np.array([0]), np.array([0]), np.array([1e10]), 1)


def test_best_keeps_ties_by_id():
    best = ranking.Best(1, 3)
    ids = np.array([9, 8, 7, 6, 5, 4])
    none = np.zeros(6, bool)
    best.offer(slice(0, 1), np.array([[5, 5, 5, 5, 1, 6]]), ids, none)
    best.offer(slice(0, 1), np.array([[5, 5, 0, 0, 0, 0]]), np.array([1, 2, 3, 3, 3, 3]), none)
    assert list(zip(best.scores[0], best.ids[0])) == [(6, 4), (5, 1), (5, 2)]


# -- conversation repair ---------------------------------------------------------------


def repair_by_hand(letters, goes, broken):
    """Every edit sequence, cheapest first, ties by audit."""
    best = None

    def tried(i, last, cost, audit):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(letters) and last in ("", "a") and (best is None or (cost, audit) < best):
            best = (cost, audit)
        expected = "a" if last == "u" else "u"
        if len(audit) < 2 * len(letters) + 3:
            tried(i, expected, cost + 3, audit + "I")
        if i < len(letters):
            tried(i + 1, last, cost + 4, audit + "D")
            if not goes[i]:
                stays = cost + 3 * broken[i]
                if letters[i] == expected or (letters[i] == "s" and last == ""):
                    tried(i + 1, letters[i], stays, audit + "K")
                tried(i + 1, expected, stays + 3, audit + "R")

    tried(0, "", 0, "")
    return best


def test_alignment_equals_every_edit_sequence():
    rnd = random.Random(4)
    for _ in range(250):
        n = rnd.randint(0, 5)
        letters = [rnd.choice("uuuaaas?") for _ in range(n)]
        goes = np.array([rnd.random() < 0.2 for _ in range(n)], dtype=bool)
        broken = np.array([not g and rnd.random() < 0.3 for g in goes], dtype=np.int64)
        expected = repair_by_hand(letters, goes, broken.tolist())
        for run in (repair.RUN, 1, 2, 3):
            assert repair.align(letters, goes, broken, run) == expected, (letters, goes, broken, run)


def test_runs_do_not_change_the_result():
    rnd = random.Random(9)
    for n in (70, 300):
        letters = [rnd.choice("uuaas") for _ in range(n)]
        goes = np.array([rnd.random() < 0.1 for _ in range(n)])
        broken = np.array([not g and rnd.random() < 0.1 for g in goes], dtype=np.int64)
        whole = repair.align(letters, goes, broken, n)
        assert [repair.align(letters, goes, broken, run) for run in (7, 32)] == [whole, whole]


def conversation_by_hand(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of damaged, ordered rows."""
    seen, goes, broken, counts = set(), [], [], Counter()
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        goes.append(fault in ("blank", "duplicate"))
        broken.append(int(fault == "truncated"))
    letters = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    cost, audit = repair_by_hand(letters, goes, broken)
    lines, at, expected = [], 0, "u"
    for edit in audit:
        role, text = (rows[at][1], rows[at][2]) if edit != "I" else ("", "")
        at += edit != "I"
        if edit != "D":
            if edit != "K":
                role = {"u": "user", "a": "assistant"}[expected]
            expected = {"u": "a", "a": "u"}.get(role[:1], expected)
            lines.append(f"{role}:{text}")
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)


TALK = "conv_id long, turn int, role string, text string, letter string, audit int, digest string, copies int"


def talk_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], TALK).repartition(3)


def test_repair_of_conversations_equals_brute_force(spark):
    rnd = random.Random(11)
    texts = ["Yes.", "No!", "Well", " \t", "", "So it is?  ", "One. Two", "ok "]
    rows = []
    for conv in range(60):
        for turn in range(rnd.randint(1, 6)):
            if rnd.random() < 0.9:
                rows.append((conv, turn, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(texts)))
    rows += [(100, None, "user", "Hi."), (100, 5, None, None), (None, 1, "user", "A."), (None, 2, "assistant", "B.")]
    rows += [(101, 1, "user", "Same."), (101, 1, "user", "Same."), (101, 9, "user", "Same."), (102, -3, "", "x.")]
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(repair.damage(talk_of(spark, rows)), talk_of(spark, rows)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        damaged = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = role if role is not None else " ", text if text is not None else " "
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            damaged += [(turn, role, text)] * (2 if kind == 3 else 1)
        digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        assert got[conv] == conversation_by_hand(damaged), (conv, damaged)


def test_repaired_turns_and_nothing(spark):
    talk = talk_of(
        spark,
        [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "assistant", "What now?")],
    )
    found = repair.audits(talk)
    row = found.first()
    assert (row.cost, row.audit) == (3, "KIKKK")
    out = repair.repaired(talk, found).orderBy("position").collect()
    assert [(r.position, r.role, r.text, r.edit) for r in out] == [
        (1, "system", "Be brief.", "K"),
        (2, "user", "", "I"),
        (3, "assistant", "Hello.", "K"),
        (4, "user", "Hi.", "K"),
        (5, "assistant", "What now?", "K"),
    ]
    none = talk_of(spark, [])
    assert repair.report(none, none).count() == 0
    gone = repair.report(none, talk).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_turn_repeated_without_end_and_a_long_text(spark):
    rows = [(1, 0, "user", "Again.")] * 3000 + [(1, 1, "assistant", "word " * 100_000 + "end.")]
    found = repair.report(talk_of(spark, rows)).first()
    assert (found.duplicate, found.cost, found.audit) == (2999, 4 * 2999, "K" + "D" * 2999 + "K")


# -- fingerprints ----------------------------------------------------------------------


def print_by_hand(text):
    words = {w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w}
    votes, total = np.zeros(128, dtype=np.int64), sum(map(len, words))
    seed = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), seed=42)
    for w in words:
        high, low = xxhash.xxh64_intdigest(w.encode(), seed=42), xxhash.xxh64_intdigest(w.encode(), seed=seed)
        votes += len(w) * np.array([((high << 64 | low) >> k) & 1 for k in range(128)])
    return f"{sum(1 << k for k in range(128) if 2 * votes[k] > total):032x}"


def likeness(a, b):
    return 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128


def ordered_by_hand(rows):
    tie = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), seed=42)).astype(np.int64)
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1]), r[1]))


@pytest.mark.parametrize("range_rows", [fingerprints.RANGE_ROWS, 4, 1])
def test_edits_and_prints_equal_brute_force(spark, range_rows):
    rnd = random.Random(6)
    words = ["ape", "Bee", "über", "日本語", "a", "longerword", "\U0001f600"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 9))) for _ in range(40)]
    rows = [(rnd.choice([-5, 0, 3, 4, 10**15 + k, 2**62]), t) for k, t in enumerate(texts)]
    rows += [(None, None), (None, "x y"), (None, "x y"), (3, "same"), (3, "same"), (3, "same"), (8, ""), (-(2**63), "least")]
    rows += [(None, "hot")] * 12
    order = ordered_by_hand(rows)
    expected = []
    for k, (i, t) in enumerate(order):
        other, half = order[(k + 1) % len(order)][1], len(t) // 2
        changed = t[: len(t) - half] + other[:half]
        prints = [print_by_hand(x) for x in (t, changed, other)]
        expected.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), *prints[:2], *[likeness(prints[0], p) for p in prints[1:]]))
    got = fingerprints.report(docs_of(spark, rows, 1), range_rows).collect()
    made = [tuple(r)[:-1] for r in got]
    assert sorted(made, key=repr) == sorted(expected, key=repr)


def test_likeness_to_the_next_document(spark):
    got = {r.doc_id: r for r in fingerprints.report(docs_of(spark, [(3, "a b c d"), (2, "a b c d"), (1, "q")]), 1).collect()}
    assert got[3].near_next == 1 and got[3].near_edited == 1
    assert got[1].near_next == got[2].near_next < 1
    alone = fingerprints.report(docs_of(spark, [(1, "left right")])).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"left left ").hexdigest()
    assert fingerprints.report(docs_of(spark, [])).count() == 0


def test_long_texts_have_exact_votes(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    got = fingerprints.report(docs_of(spark, [(1, text), (2, "")])).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {1: print_by_hand(text), 2: "0" * 32}


def test_tables_find_all_pairs_within_the_radius(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(128) for _ in range(12)]
    made = set(base)
    for b in base:
        for flips in (1, 3, 5, 6, 6, 7, 8):
            made.add(b ^ sum(1 << k for k in rnd.sample(range(128), flips)))
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    rows = [(signed(m >> 64), signed(m & (2**64 - 1))) for m in made] * 2
    prints = spark.createDataFrame(rows, "high long, low long")
    for radius in (0, 3, fingerprints.RADIUS):
        got = fingerprints.near_pairs(prints, radius).collect()
        whole = lambda h, l: ((h % 2**64) << 64) | (l % 2**64)  # noqa: E731, E741
        pairs = Counter(frozenset((whole(r[0], r[1]), whole(r[2], r[3]))) for r in got)
        expected = {frozenset(p) for p in combinations(made, 2) if bin(p[0] ^ p[1]).count("1") <= radius}
        assert set(pairs) == expected and set(pairs.values()) <= {1}
    with pytest.raises(ValueError):
        fingerprints.near_pairs(prints, fingerprints.RADIUS + 1)


def test_the_tables_of_prints_are_not_broadcast(spark):
    # Few prints in bytes, 28 times as many rows once exploded: the driver held them all.
    prints = spark.range(1000).select(F.xxhash64("id").alias("high"), F.xxhash64(F.lit(1), "id").alias("low"))
    pairs = fingerprints.near_pairs(prints)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_prints_number_their_near_ones(spark):
    words = [f"word{i:03d}" for i in range(200)]
    docs = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[:199] + ["other"])), (4, "far away")]
    got = {r.doc_id: r for r in fingerprints.report(docs_of(spark, docs)).collect()}
    apart = bin(int(got[1].fingerprint, 16) ^ int(got[3].fingerprint, 16)).count("1")
    assert got[1].fingerprint == got[2].fingerprint
    assert got[1].n_near == got[2].n_near == got[3].n_near == int(0 < apart <= fingerprints.RADIUS)
    assert got[4].n_near == 0
