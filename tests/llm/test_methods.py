"""Each operator against a brute-force version, planted cases or held-out accuracy."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.llm import exact_dedup, language, licenses, near_dup, packing, pii, quoting, substring_dedup, url_rules
from tripweave.llm.common import Scratch
from tripweave.llm.components import components
from tripweave.llm.shingles import Signer, WordHashes, shingle_set, windows


def corpus(seed=3):
    """Texts with copies, near copies of many degrees, shared passages and short ones."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    shared = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(5, 120))]
        for _ in range(rnd.randint(1, 7)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if rnd.random() < 0.2 else "  ".join(copy))
    for _ in range(8):
        cut = rnd.randint(0, 20)
        texts.append(" ".join([word() for _ in range(rnd.randint(1, 30))] + shared[cut : cut + 40]))
    texts += ["", "one", "one", "one two", None]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def linked_by_hand(rows, size=4, percent=80):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split() if t else []
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and least[a] != least[b]:
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


@pytest.mark.parametrize("block", [near_dup.BLOCK, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = corpus()
    got = near_dup.report(frame(spark, rows), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == linked_by_hand(rows)


def test_pruning_bound_is_the_chance_of_a_miss():
    rng = np.random.default_rng(1)
    for n, least in near_dup.required_matches(80, 1e-3):
        # Under a uniform prior: draws of the similarity given the agreement.
        chance = [(rng.beta(m + 1, n - m + 1, 400_000) >= 0.8).mean() for m in (least - 1, least)]
        assert chance[0] < 1.2e-3 and chance[1] > 0.8e-3


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    sign = Signer(near_dup.BANDS * near_dup.BAND_ROWS)
    for shared in (0.5, 0.8, 0.95):
        found = []
        for _ in range(60):
            n = int(300 * shared)
            common, a, b = rng.integers(0, 2**63, n), rng.integers(0, 2**63, 300 - n), rng.integers(0, 2**63, 300 - n)
            one, two = (np.concatenate([common, x]).astype(np.uint64) for x in (a, b))
            found.append((sign(one) == sign(two)).mean())
        truth = n / (600 - n)
        assert abs(np.mean(found) - truth) < 0.02


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (200, 202)]
    random.Random(4).shuffle(links)
    found = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r.node: r.label for r in found} == {
        **{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200,
    }


@pytest.mark.parametrize("window", [35, 8, 1])
def test_repeated_passages_equal_brute_force(spark, window):
    rows = corpus(5)
    times, words = Counter(), {i: (t or "").encode().split() for i, t in rows}
    for w in words.values():
        times.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    want = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if times[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(left).hexdigest())
    got = substring_dedup.report(frame(spark, rows), window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_equal_runs_have_equal_hashes_and_others_not():
    words = [b"a", b"b", b"a", b"b", b"a", b"b", b"c"] * 3
    hashes = WordHashes()(words)
    for size in (1, 2, 3, 5, 7, 12):
        made = windows(hashes, size)
        same = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
        assert len(set(made.tolist())) == len(same) and len(made) == len(words) - size + 1
    assert len(shingle_set(WordHashes()(words[:2]), 5)) == 1


def test_exact_copies_with_a_frequent_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 50}") for i in range(600)] + [(600, None), (601, "")]
    got = {r.doc_id: r for r in exact_dedup.report(frame(spark, rows), counters=7).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t in rows:
        mine = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(mine), len(mine), i == max(mine))
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    left = exact_dedup.deduplicate(frame(spark, rows), counters=7).collect()
    assert sorted(r.doc_id for r in left) == sorted(max(g) for g in groups.values())


def test_frequent_digests_are_found_and_few(spark):
    rows = [(i, hashlib.sha256(str(i if i % 4 else 0).encode()).digest()) for i in range(2000)]
    digests = spark.createDataFrame(rows, "i long, sha binary").repartition(5)
    found = exact_dedup.frequent(digests, 9).collect()
    assert 1 <= len(found) <= 10 and hashlib.sha256(b"0").digest() in {bytes(r.sha) for r in found}


def test_best_fit_takes_the_tightest_compatible_bin():
    rnd = random.Random(7)
    items = sorted(
        ((rnd.randint(1, 60), rnd.choice("aabc") if rnd.random() < 0.8 else None, rnd.randint(0, 90)) for _ in range(300)),
        key=lambda x: -x[0],
    )
    chosen = packing.best_fit(*map(list, zip(*items)), 100)
    bins = {}
    for (n, s, c), which in zip(items, chosen):
        fits = {
            b: 100 - sum(x[0] for x in held)
            for b, held in bins.items()
            if 100 - sum(x[0] for x in held) >= n and not any((s is not None and s == x[1]) or c == x[2] for x in held)
        }
        if fits:
            assert which in fits and fits[which] == min(fits.values())
        else:
            assert which not in bins
        bins.setdefault(which, []).append((n, s, c))


def test_packed_bins_hold_no_conflict_and_give_the_texts_back(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i * 7 % 90)), f"s{i % 3}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    packed = packing.pack(docs, capacity=40, shard_rows=50).cache()
    placed = packed.filter("bin_id IS NOT NULL").join(docs, "doc_id").groupBy("bin_id").agg(
        F.sum("n_words").alias("n"), F.first("bin_words").alias("said"), F.count("source").alias("k"), F.count_distinct("source").alias("s")
    )
    assert placed.filter("n > 40 OR n != said OR k != s").count() == 0
    words = Counter(w for r in packing.sequences(docs, packed).collect() for w in r.text.split())
    assert words == Counter(w for _, t, _ in rows for w in t.split())


def test_licenses_are_found_near_and_exact():
    scanner = licenses.Scanner()
    noise = " ".join(f"word{i}" for i in range(70))
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            assert any(f[0] == name and f[3] == 1 for f in scanner.scan(f"{noise}. {notice.upper()}\n{noise}")), notice
    long = licenses.TEMPLATES["GPL-3.0"][1].split()
    long[20] = "different"
    assert [f[0] for f in scanner.scan(f"{noise} {' '.join(long)} {noise}")] == ["GPL-3.0"]
    assert scanner.scan(noise) == [] and scanner.scan("") == []
    twice = scanner.scan("All rights reserved. " + noise + " all RIGHTS reserved")
    assert [f[:3] for f in twice] == [("reserved", 0, 3), ("reserved", 73, 76)]


PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(9)
    for _ in range(20_000):
        text = "".join(rnd.choice("a1.@+ -(9%_2.5é") for _ in range(rnd.randint(1, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_the_field_learns_from_the_patterns_and_adds_spans():
    rnd = random.Random(10)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    samples = [f"call +1 ({d(3)}) 555-{d(4)}" for _ in range(60)] + [f"from {rnd.randint(1, 255)}.{rnd.randint(0, 255)}.7.9" for _ in range(60)]
    samples += [f"about {d(2)} of {d(3)}" for _ in range(60)] + [f"mail ab.{d(2)}@mail{d(1)}.example.com" for _ in range(60)]
    field = pii.fit(samples)
    text = "please call +1 (204) 555-1234 or see 10.1.2.3 on page 25 of 300"
    tokens, starts, before = pii._island(text, 12, 29)
    assert [k for _, _, k, _ in field.best(tokens, before)] == ["phone"]
    every = pii.all_spans(text, field)
    assert set(pii.base_spans(text)) <= set(every) and all(k != "card" for k, _, _ in every)
    # Base spans stay as they are, added ones do not touch them.
    places = sorted((a, b) for _, a, b in every)
    assert all(x[1] <= y[0] for x, y in zip(places, places[1:]))
    long = " ".join(d(3) for _ in range(3000))
    assert pii.all_spans(long, field) is not None


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.report(docs, sample_per_language=60).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in got)


def test_copies_of_a_text_teach_once(spark):
    rows = [(f"ein kurzer text nummer {'abcdefghij'[i % 10] * (i // 10 + 1)}", "de", 3000 if i < 3 else 1) for i in range(60)]
    # All texts of fr are copied, so that their rows are far more than the bound allows.
    rows += [(f"un petit texte {'abcdefghij'[i % 10] * (i // 10 + 1)}", "fr", 2000) for i in range(30)]
    docs = spark.createDataFrame(rows, "text string, lang string, copies int").repartition(5)
    docs = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("text", "lang")
    for bound in (20, 100):
        sample = language.labelled_sample(docs, Scratch(spark, "test"), "text", "lang", bound)
        got = sample.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("features").alias("d")).collect()
        assert {r.lang: (r.n, r.d) for r in got} == {"de": (min(bound, 60),) * 2, "fr": (min(bound, 30),) * 2}


def test_no_letter_is_no_language_and_one_label_is_enough(spark):
    rows = [(1, "eins zwei drei", "de"), (2, "123", "de"), (3, None, None), (4, "quatre", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    found = {r.doc_id: r.p.lang_pred for r in docs.select("doc_id", language.predicted(model).alias("p")).collect()}
    assert found == {1: "de", 2: "und", 3: "und", 4: "de"}
    nothing = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.p.lang_pred for r in docs.select(language.predicted(nothing).alias("p")).collect()} == {"und"}


def test_url_rules_are_mined_and_fixed_rules_go_first(spark):
    rnd = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        host = "www.casino.example.info" if bad else f"{rnd.choice('abcd')}.example.{rnd.choice(['org', 'net', 'com'])}"
        rows.append((i, f"https://{host}/{rnd.choice(['en', 'de', 'fr', 'es'])}/{i}?page=2"))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.report(pages, marks).collect()}
    for i, url in rows:
        host, path = re.match(r"https://([^/]*)([^?]*)", url).groups()
        fits = [r for r in url_rules.HOST_RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.text)
        assert got[i].verdict == (rule.verdict if rule else "block" if i % 4 == 0 else "allow"), url


def rules_by_hand(baskets, min_confidence=url_rules.MIN_CONFIDENCE):
    """Every combination of page-set classes, by enumeration."""
    least, base = url_rules.MIN_PAGES, sum(bad for _, bad in baskets) / len(baskets)
    pages = {}
    for i, (tokens, _) in enumerate(baskets):
        for t in tokens:
            pages.setdefault(t, set()).add(i)
    classes = {}
    for t, on in pages.items():
        if len(on) >= least:
            classes.setdefault(frozenset(on), []).append(t)
    rules = {}
    for size in range(1, len(classes) + 1):
        for some in itertools.combinations(classes, size):
            on = frozenset.intersection(*some)
            blocked = sum(baskets[i][1] for i in on)
            if blocked >= least and blocked / len(on) >= min_confidence and blocked / len(on) > base:
                rules[frozenset(t for c in some for t in classes[c])] = blocked / len(on)
    return {r: c for r, c in rules.items() if not any(s < r and rules[s] >= c for s in rules)}


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_rules_equal_enumeration(spark, seed):
    rnd = random.Random(seed)
    baskets = []
    for _ in range(600):
        tokens = {t for t in "abcdef" if rnd.random() < 0.4}
        tokens |= {"twin of a", "third of a"} & ({"twin of a", "third of a"} if "a" in tokens else set())
        tokens |= {"always"} | ({"rare"} if rnd.random() < 0.01 else set())
        chance = 0.9 if {"a", "b"} <= tokens else 0.75 if "c" in tokens else 0.2
        baskets.append((sorted(tokens), rnd.random() < chance))
    labelled = spark.createDataFrame(baskets, "tokens array<string>, blocked boolean").repartition(3)
    got = url_rules.mine(labelled, Scratch(spark, "test")).collect()
    want = rules_by_hand(baskets)
    assert len(want) > 2 and {frozenset(r.antecedent): r.confidence for r in got} == pytest.approx(want)
    assert len(got) == len(want)


def test_deep_shared_paths_are_one_item(spark):
    """Thirty segments that many pages share would be 2^30 itemsets."""
    deep = "/".join(f"level{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30))
    rows = [(i, f"https://h{'ab'[i % 2]}.example.net/{deep if i % 3 == 0 else 'plain'}/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = url_rules.report(pages, marks).collect()
    assert {r.page_id: r.verdict for r in got} == {i: "block" if i % 3 == 0 else "allow" for i in range(300)}
    assert {len(r.mined_rule.split(" & ")) >= 30 for r in got if r.verdict == "block"} == {True}


def test_quotes_are_linked_and_leave_the_text(spark):
    rows = [
        (1, 0, "u", "Hello there friend.\nSecond line.\n\nA paragraph here"),
        (1, 1, "a", "> hello there FRIEND\n> second line\nMy reply to this"),
        (1, 2, "u", ">> Second line.\n> My reply to this\nno"),
        (1, 3, "a", "> not anywhere\nfine"),
        (2, 0, "u", None),
        (2, 1, "u", "> A paragraph here\nabroad"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.message.conv_id, r.message.turn): r for r in quoting.link_quotes(messages).collect()}
    assert {k: (r.n_quotes, r.n_linked, r.reply_to, r.root_turn, r.from_conv, r.text) for k, r in got.items()} == {
        (1, 0): (0, 0, None, 0, None, rows[0][3]),
        (1, 1): (1, 1, 0, 0, None, "My reply to this"),
        (1, 2): (2, 2, 1, 0, None, "no"),
        (1, 3): (1, 0, None, 3, None, "> not anywhere\nfine"),
        (2, 0): (0, 0, None, 0, None, None),
        (2, 1): (1, 1, None, 1, 1, "abroad"),
    }


def test_partial_quotes_of_several_lines_are_linked(spark):
    five = "One line\nline two,\nLine three.\nline four\nline five"
    rows = [
        (1, 0, "u", five + "\n\nSecond paragraph\nof two lines\n\nThird paragraph"),
        (1, 1, "a", "> Line two,\n> line three.\nlines two and three"),
        (1, 2, "u", "> second paragraph\n> of two lines\n>\n> third paragraph\ntwo of three paragraphs"),
        (1, 3, "a", "> line three\n> line two\nnot in this order"),
        (1, 4, "u", "> line two\n> line four\nnot consecutive"),
        (1, 5, "a", "> line four\n> line five\n> second paragraph\n>> lines two and three\nacross paragraphs"),
        (1, 6, "u", "> third paragraph\n> lines two and three\nof two messages"),
        (2, 0, "u", "> line three\n> line four\nabroad"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.message.conv_id, r.message.turn): r for r in quoting.link_quotes(messages).collect()}
    assert {k: (r.n_quotes, r.n_linked, r.reply_to, r.root_turn, r.from_conv, r.text) for k, r in got.items()} == {
        (1, 0): (0, 0, None, 0, None, rows[0][3]),
        (1, 1): (1, 1, 0, 0, None, "lines two and three"),
        (1, 2): (1, 1, 0, 0, None, "two of three paragraphs"),
        (1, 3): (1, 0, None, 3, None, rows[3][3]),
        (1, 4): (1, 0, None, 4, None, rows[4][3]),
        (1, 5): (2, 2, 0, 0, None, "across paragraphs"),
        (1, 6): (1, 0, None, 6, None, rows[6][3]),
        (2, 0): (1, 1, None, 0, 1, "abroad"),
    }
