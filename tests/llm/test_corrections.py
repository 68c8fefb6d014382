"""License windows, quotes from elsewhere, number signs, several texts under one id, rare misses."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripweave.llm import decontaminate, language, licenses, pii, queries, quoting, substring_dedup


# -- license scan ----------------------------------------------------------------------


def passages_by_hand(words, t, contained=licenses.CONTAINED):
    """Merged passages of at most twice the template's words that hold enough of its shingles."""
    need = math.ceil(contained * len(t.shingles) - 1e-9)
    found = []
    for a in range(len(words)):
        held = set()
        for b in range(a + t.shingle, min(a + t.longest, len(words)) + 1):
            shingle = tuple(words[b - t.shingle : b])
            if shingle in t.shingles:
                held.add(shingle)
            if len(held) >= need:
                found.append((a, b))
                break
    # Least ones only: none that holds another.
    least = [f for f in found if not any(g != f and f[0] <= g[0] and g[1] <= f[1] for g in found)]
    merged = []
    for a, b in sorted(least):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def scanned(scanner, words):
    """Passages of every template before overlaps of different ones are settled."""
    kept = licenses._best
    try:
        licenses._best = lambda matches: matches
        return sorted((m.license, m.words, m.start, m.end) for m in scanner.scan(" ".join(words)))
    finally:
        licenses._best = kept


def test_bands_reach_the_least_similar_window():
    for t in licenses._templates(licenses.TEMPLATES):
        assert (1 - licenses.least_similarity(t)) ** (licenses.BANDS // licenses.BAND_ROWS) <= 1e-5, t.words


def test_license_scan_equals_brute_force_over_insertions_at_every_offset():
    rnd = random.Random(8)
    scanner = licenses.Scanner()
    notices = [t for t in scanner.templates if len(t.words) >= licenses.NOTICE_WORDS]
    found = expected_all = 0
    for t in notices:
        for offset in range(0, 60, 5):
            words = [f"w{rnd.randrange(900)}" for _ in range(offset)]
            body = list(t.words)
            for _ in range(rnd.choice([0, 1, 2])):
                at = rnd.randrange(1, len(body))
                body[at:at] = [f"x{k}" for k in range(rnd.choice([1, 4, 8, 15, 25]))]
            if rnd.random() < 0.4:
                del body[rnd.randrange(len(body))]
            words += [*body, *[f"w{rnd.randrange(900)}" for _ in range(30)]]
            expected = sorted(
                (o.license, len(o.words), *p) for o in scanner.templates for p in passages_by_hand(words, o)
            )
            assert scanned(scanner, words) == expected, (t.license, offset)
            found += any(m[0] == t.license for m in expected)
            expected_all += 1
    assert found > expected_all / 3


def test_insertions_do_not_hide_a_notice():
    scanner = licenses.Scanner()
    words = licenses.TEMPLATES["GPL-3.0"][1].split()
    for k in (4, 8, 10, 15, 30):
        for offset in range(30):
            text = " ".join([*["pad"] * offset, *words[:20], *["more"] * k, *words[20:]])
            assert [m.license for m in scanner.scan(text)] == ["GPL-3.0"], (k, offset)


def test_sibling_licenses_are_told_apart(spark):
    rows = [(k, licenses.TEMPLATES[name][-1], name) for k, name in enumerate(licenses.TEMPLATES)]
    rows += [(90, "nobody said: all rights reserved", None), (None, None, None), (91, "", None)]
    found = {r.doc_id: r for r in licenses.report(spark.createDataFrame(rows, "doc_id int, text string, licenses string")).collect()}
    for k, text, name in rows[:-3]:
        notice = len(licenses._WORD.findall(text.lower())) >= licenses.NOTICE_WORDS
        assert (found[k].licenses if notice else found[k].mentions) == name
    assert (found[90].licenses, found[90].n_matches, found[90].mentions) == ("", 0, "reserved")
    assert (found[None].n_matches, found[91].n_mentions) == (0, 0)
    none = spark.createDataFrame([], "doc_id int, text string")
    assert licenses.report(none).count() == 0


# -- quotation linking -----------------------------------------------------------------


def test_a_quote_whose_own_conversation_says_it_later_comes_from_elsewhere(spark):
    said = "the fox jumps over it"
    rows = [(1, 5, "user", f"> {said}\nindeed"), (1, 7, "user", said), (2, 0, "user", said), (3, 0, "user", said)]
    rows += [(3, 4, "user", f"> {said}")]
    found = quoting.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.message.conv_id, r.message.turn): (r.n_linked, r.from_conv, r.reply_to) for r in found.collect()}
    assert got[1, 5] == (1, 2, None) and got[3, 4] == (1, None, 0)


# -- language --------------------------------------------------------------------------


def test_number_signs_are_no_letters(spark):
    rows = [(k, t, g) for k, (t, g) in enumerate([("the one and the other", "en"), ("le un et le autre", "fr")] * 20)]
    rows += [(100, "²½", None), (101, "Ⅷ ① ³", None), (102, "_ 12", None), (103, "ª", None)]
    found = {r.doc_id: r for r in language.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [found[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and found[103].lang_pred != "und"


def test_a_row_without_an_id_does_not_teach(spark):
    rows = [(k, "the one and the other", "en") for k in range(20)] + [(None, "le un et le autre", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.report(docs).collect()} == {"en"}


# -- repeated passages -----------------------------------------------------------------


def test_many_texts_without_an_id_meet_once_each(spark):
    rnd = random.Random(3)
    shared = " ".join(f"s{k}" for k in range(40))
    rows = [(None, f"{' '.join(f'w{rnd.randrange(10**6)}' for _ in range(50))} {shared}") for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.report(docs)
    assert {(r.n_words, r.n_removed) for r in got.collect()} == {(90, 40)} and got.count() == 60
    found = substring_dedup.Repeats(docs, "doc_id", "text", 35)
    assert found.partly.count() == 60


# -- decontamination -------------------------------------------------------------------


@pytest.mark.parametrize("q", [9, 12, 16, 31, 32, 40])
def test_the_filter_misses_rarely(q):
    _, p = decontaminate.resolution(q)
    shared = math.ceil(q * decontaminate.CONTAINED)
    expected = shared * p
    least = max(1.0, expected - math.sqrt(2 * expected * math.log(1 / decontaminate.MISS)))
    # The chance that fewer agree, summed exactly.
    miss = sum(math.comb(shared, k) * p**k * (1 - p) ** (shared - k) for k in range(math.ceil(least)))
    assert miss <= decontaminate.MISS


def test_items_of_every_size_are_found_in_long_documents(spark):
    rnd = random.Random(5)
    word = lambda: f"t{rnd.randrange(10**6)}"
    items, docs = [], []
    for q in range(9, 41):
        body = [word() for _ in range(q + 4)]
        items.append((q, " ".join(body)))
        for k in range(6):
            cut = body[: len(body) - rnd.randrange(0, q // 5 + 1)]
            text = [*[word() for _ in range(rnd.randrange(900))], *cut, *[word() for _ in range(rnd.randrange(900))]]
            docs.append((q * 10 + k, " ".join(text)))
    found = decontaminate.report(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    pairs = {(r.doc_id, r.item_id) for r in found.select("doc_id", "item_id").collect()}
    assert pairs == {(d, d // 10) for d, _ in docs}


def test_the_private_data_query_keeps_the_order_of_its_contract(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_pii(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert got.select(F.sha2("spans", 256) == F.col("base_sha256")).first()[0]


# -- personal data ---------------------------------------------------------------------


def segmentations(n, scored):
    """Every way to cut tokens 0..n into plain tokens and candidate segments of a type."""
    if n == 0:
        return [(0.0, ())]
    out = [(v, p) for v, p in segmentations(n - 1, scored)]
    for (i, j), (_, by_type) in scored.items():
        if j == n:
            out += [(v + s, (*p, (i, j, k))) for v, p in segmentations(i, scored) for k, s in zip(pii.TYPES, by_type)]
    return out


def test_best_path_and_sums_equal_enumeration():
    rnd = random.Random(2)
    for text in ("12 34-5678 9012", "a1@b2.co 5555", "+1 (22) 333-4444", "x9f8e7d6c5b4a39281706f5 77 88"):
        (start, end), *_ = pii.islands(text)
        tokens, _, before = pii._island(text, start, end)
        field = pii.Field()
        names = {f for i, j in pii.candidates(tokens) for f in pii.features(tokens, i, j, "")}
        field.weights.update({(k, f): rnd.gauss(0, 1) for k in pii.TYPES for f in names})
        scored = field.scores(tokens, before)
        every = segmentations(len(tokens), scored)
        value, path = max(every)
        best = field.best(tokens, before)
        assert sum(b[3] for b in best) == pytest.approx(value) and {b[:3] for b in best} == set(path)
        # The step moves each weight by the gold count less the expected one.
        gold = set(path)
        total = sum(math.exp(v) for v, _ in every)
        expected = {}
        for v, p in every:
            for i, j, k in p:
                for f in scored[i, j][0]:
                    expected[k, f] = expected.get((k, f), 0.0) + math.exp(v) / total
        before_step = dict(field.weights)
        field.step(tokens, before, gold, 1.0)
        for i, j, k in gold:
            for f in scored[i, j][0]:
                expected[k, f] = expected.get((k, f), 0.0) - 1
        for key, off in expected.items():
            assert field.weights[key] == pytest.approx(before_step.get(key, 0.0) - off, abs=2e-2)


def test_the_field_finds_what_no_pattern_does():
    rnd = random.Random(7)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    secret = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))

    def card():
        while True:
            made = "4" + digits(15)
            if pii.luhn(made):
                return made

    samples = []
    for _ in range(60):
        samples += [f"word +1 ({digits(3)}) 555-{digits(4)} more", f"word {rnd.randint(1, 200)}.{rnd.randint(1, 200)}.3.4 x"]
        samples += [f"word {card()} x", f"ann.{digits(2)}@mail{digits(1)}.example.com", f'is token = "{secret()}" then']
    field = pii.fit(samples)
    kinds = lambda text: [(k, text[a:b]) for k, a, b in pii.all_spans(text, field)]
    hidden = secret()
    assert kinds(f"see {hidden} there") == [("secret", hidden)] or kinds(f'token = "{hidden}"') == [("secret", hidden)]
    assert kinds(f'the token = "{hidden}" was') == [("secret", hidden)]
    assert kinds("call 1 (204) 555-1234 now") == [("phone", "1 (204) 555-1234")]
    for plain in ("in 2024 there", "about 1234567 people", "at 12.5 percent", "the abcdefghijklmnopqrst word", ""):
        assert kinds(plain) == [], plain
    for text in ("+1 (204) 555-1234", "a@b.example.com", "59.36.80.30"):
        assert [s[0] for s in kinds(text)] == [s[0] for s in pii.base_spans(text)]
