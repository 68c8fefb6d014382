"""Every operator and stage over odd tables: nulls, empty and long texts, ties, repeated
rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tripweave.llm import (
    decontaminate,
    exact_dedup,
    language,
    licenses,
    near_dup,
    packing,
    pii,
    quoting,
    substring_dedup,
    url_rules,
)

LONG = " ".join(f"word{i % 977} and{i}" for i in range(6_000))
ITEM = "the quick brown fox jumps over a lazy dog while seven wizards watch from the hill"
COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " label string, sha string, node string, whole string, value string, shard string, row_id string"
)
ROWS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n", "en", "a"),
    (4, "1234 !! 5", None, "a"),
    (5, "one word", "en", None),
    (6, "one word", "en", "b"),
    (6, "one word", "en", "b"),
    (7, LONG, "en", "a"),
    (8, LONG + " tail", "en", "a"),
    (None, "une phrase assez courte pour un essai", "fr", "c"),
    (None, None, None, None),
    (9, f"before it {ITEM} and after it", "en", "a"),
    (10, ITEM, "en", "a"),
    (11, "One  WORD", "en", "b"),
    (11, "a different text under the same id", "en", "b"),
]


def docs_of(spark, rows):
    made = [(i, t, g, s, len(t or ""), "x", "y", "z", "w", "v", "u", "r") for i, t, g, s in rows]
    return spark.createDataFrame(made, COLUMNS)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    docs_of(spark, ROWS).write.parquet(f"{path}/documents.parquet")
    docs_of(spark, []).write.parquet(f"{path}/none.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet"
    )
    return path


def tables(spark, odd):
    return (
        spark.read.parquet(f"{odd}/documents.parquet"),
        spark.read.parquet(f"{odd}/none.parquet"),
        spark.read.parquet(f"{odd}/benchmark.parquet"),
    )


REPORTS = {
    "exact": exact_dedup.report,
    "near": near_dup.report,
    "language": language.report,
    "license": licenses.report,
    "pii": pii.report,
    "passages": substring_dedup.report,
}


@pytest.mark.parametrize("name", REPORTS)
def test_one_row_for_each_document(spark, odd, name):
    docs, none, _ = tables(spark, odd)
    found = REPORTS[name](docs).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((r.doc_id for r in found), key=key) == sorted((r[0] for r in ROWS), key=key)
    assert REPORTS[name](none).count() == 0


def test_stages_keep_the_columns_and_survive_nothing(spark, odd):
    docs, none, _ = tables(spark, odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, odd)
        assert kept.columns == docs.columns
        assert stage(spark, none, odd).count() == 0
        assert kept.count() <= len(ROWS)
    assert corpus_pipeline.STAGES[-1][1](spark, none, odd).count() == 0


def kept_texts(frame):
    return sorted((r.text or "") for r in frame.select("text").collect())


def test_language_stage_rejects_texts_without_a_letter(spark, odd):
    docs, _, _ = tables(spark, odd)
    kept = kept_texts(corpus_pipeline.identify_language(spark, docs, odd))
    assert len(kept) == len(ROWS) - 5 and all(any(c.isalpha() for c in t) for t in kept)


def test_exact_stage_leaves_one_row_for_each_text(spark, odd):
    docs, _, _ = tables(spark, odd)
    kept = corpus_pipeline.drop_copies(spark, docs, odd)
    assert kept_texts(kept) == sorted({t or "" for _, t, _, _ in ROWS})
    assert {r.doc_id for r in kept.filter("text = 'one word'").collect()} == {6}
    assert {r.doc_id for r in kept.filter("coalesce(text, '') = ''").collect()} == {2}


def test_near_stage_keeps_the_least_of_each_group(spark, odd):
    docs, _, _ = tables(spark, odd)
    ids = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, odd).collect()]
    # 5, 6 and a text of 11 are one word sequence; 7 and 8 differ in one word.
    assert 7 in ids and 8 not in ids and 5 in ids and 6 not in ids and 11 not in ids
    assert {1, 2, 3, 4, 9, 10} <= set(ids) and ids.count(None) == 2


def test_decontamination_stage_drops_what_holds_an_item(spark, odd):
    docs, _, _ = tables(spark, odd)
    kept = corpus_pipeline.drop_benchmark(spark, docs, odd)
    ids = [r.doc_id for r in kept.collect()]
    assert 9 not in ids and 10 not in ids and ids.count(None) == 2 and len(ids) == len(ROWS) - 2


def test_items_of_nothing_contaminate_nothing(spark, odd):
    docs, none, items = tables(spark, odd)
    assert decontaminate.decontaminate(docs, items.filter("item_id IN (2, 3)")).count() == len(ROWS)
    assert decontaminate.report(none, items).count() == 0
    found = decontaminate.report(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(9, 1), (10, 1)}


def test_packing_places_every_piece_once(spark, odd):
    docs, _, _ = tables(spark, odd)
    packed = packing.pack(docs)
    placed = packed.agg(F.sum("n_words").alias("n"), F.count("bin_id").alias("b")).first()
    words = sum(len((t or "").split()) for _, t, _, _ in ROWS)
    assert placed.n == words
    assert packed.filter("bin_id IS NULL AND n_words > 0").count() == 0
    assert packed.select("bin_id", "position").filter("bin_id IS NOT NULL").distinct().count() == placed.b


def test_urls_that_are_none(spark):
    pages = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "no scheme", "x"), (None, "http://A.org", "x"), (4, "://", "x"), (4, "://", "x")],
        "page_id long, url string, same string",
    )
    labels = spark.createDataFrame([(1, None, 1), (None, 0, 0), (4, 0, None)], "doc_id long, quality int, toxic int")
    for marked in (labels, labels.limit(0)):
        found = url_rules.report(pages, marked).collect()
        assert len(found) == 6 and {r.verdict for r in found} == {"allow"}
        assert {r.host for r in found} == {"", "a.org"}
    assert url_rules.report(pages.limit(0), labels).count() == 0


def test_messages_that_are_none(spark):
    rows = [(None, None, None, None), (1, None, "u", "> a b"), (1, 0, "u", ""), (1, 0, "u", ""), (1, 1, None, ">")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = quoting.link_quotes(messages.withColumn("hash", F.lit("x")).withColumn("runs", F.lit("x")))
    assert found.count() == 5 and found.filter("n_linked > 0").count() == 0
    assert found.select("message.*").columns == ["conv_id", "turn", "role", "text", "hash", "runs"]
    assert quoting.link_quotes(messages.limit(0)).count() == 0
