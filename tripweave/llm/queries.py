"""Registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import (
    decontaminate,
    exact_dedup,
    fingerprints,
    language,
    licenses,
    near_dup,
    packing,
    pii,
    quoting,
    ranking,
    repair,
    substring_dedup,
    url_rules,
)
from tripweave.llm.common import ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op6_exact_dedup",
    """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = docs.select("doc_id", "source", "text")
    return packing.pack(ids)


@query(
    "op3_near_dedup",
    r"""
    WITH RECURSIVE cut AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
        ) AS w FROM documents
    ),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM cut WHERE len(w) > 0)
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
    ),
    links AS (
        SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
        WHERE 100 * c >= 80 * (p.n + q.n - c)
    ),
    reach AS (
        SELECT x AS node, y AS other FROM links
        UNION SELECT node, y FROM reach JOIN links ON other = x
    ),
    least_of AS (SELECT node, least(node, min(other)) AS component_id FROM reach GROUP BY node)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
           coalesce(component_id, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON node = d.doc_id
    """,
)
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(table(spark, sf_dir, "documents"), shingle=4)


@query(
    "op7_substring_dedup",
    r"""
    WITH cut AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    places AS (
        SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM cut WHERE len(w) >= 35)
    ),
    repeated AS (SELECT doc_id, i FROM places JOIN (SELECT s FROM places GROUP BY s HAVING count(*) > 1) USING (s)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM repeated),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM cut),
    kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS body
        FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
    FROM cut LEFT JOIN kept USING (doc_id)
    """,
)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


@query(
    "op8_decontamination",
    r"""
    WITH cut AS (
        SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
        UNION ALL
        SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark
    ),
    shingles AS (
        SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM cut WHERE len(w) > 0)
    ),
    sizes AS (SELECT id AS item_id, count(*) AS n_shingles FROM shingles WHERE kind = 'i' GROUP BY id)
    SELECT d.id AS doc_id, i.id AS item_id, any_value(n_shingles) AS n_shingles, count(*) AS n_shared
    FROM shingles d JOIN shingles i ON d.kind = 'd' AND i.kind = 'i' AND d.s = i.s
    JOIN sizes ON sizes.item_id = i.id
    GROUP BY d.id, i.id
    HAVING count(*) >= 0.8 * any_value(n_shingles)
    """,
)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_url_rules")
def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.report(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.report(table(spark, sf_dir, "documents"))
    counts = [f"n_{kind}" for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


@query("op4_quote_linking")
def op4_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quoting.link_quotes(table(spark, sf_dir, "conversations"))
    return found.select(
        "message.conv_id",
        "message.turn",
        "message.role",
        "root_turn",
        "reply_to",
        "n_quotes",
        "n_linked",
        "from_conv",
        "text",
    )


@query(
    "op11_lexical_search",
    r"""
    WITH cut AS (
        SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'
        ) AS terms FROM documents
    ),
    held AS (SELECT * FROM cut WHERE len(terms) > 0),
    totals AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM held),
    asked AS (
        SELECT item_id, term, count(*) AS times
        FROM (
            SELECT item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'
            )) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)
        )
        GROUP BY item_id, term
    ),
    places AS (
        SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM held)
        WHERE term IN (SELECT term FROM asked) GROUP BY row_id, term
    ),
    weights AS (
        SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
        FROM places, totals GROUP BY term, n_docs
    ),
    lengths AS (
        SELECT row_id, doc_id, 100 - 25 + (25 * len(terms) * n_docs) // n_terms AS m FROM held, totals
    ),
    scores AS (
        SELECT item_id, row_id, doc_id,
               sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
        FROM asked JOIN places USING (term) JOIN weights USING (term) JOIN lengths USING (row_id)
        GROUP BY item_id, row_id, doc_id
    )
    SELECT item_id, rank, doc_id, score FROM (
        SELECT item_id, doc_id, score, row_number() OVER (
            PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST
        )::INTEGER AS rank
        FROM scores WHERE score > 0
    ) WHERE rank <= 20
    """,
)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_document_fingerprints")
def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def _repair_sql() -> str:
    """An automaton over the turns in order: for each state (nothing yet, after s, after u,
    after a) the least cost, audit and repaired text, all of which compare in that order."""

    def then(state: str, cost: str, edit: str, line: str | None = None) -> str:
        made = f"{state}.r || CASE WHEN {state}.r = '' THEN '' ELSE chr(10) END || {line}" if line else f"{state}.r"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {made}}}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    user, assistant, never = "'user:'", "'assistant:'", "{'c': 1000000000::BIGINT, 'a': '~', 'r': ''}"
    from_any = least(*[then(s, "3", "I", user) for s in ("s0", "ss", "sa")])
    own = "role || ':' || text"

    def stay(state: str, letter: str, role: str) -> str:
        return (
            f"CASE WHEN goes THEN {never} WHEN letter = '{letter}' THEN {then(state, 'stays', 'K', own)}"
            f" ELSE {then(state, 'stays + 3', 'R', role + ' || text')} END"
        )

    return f"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
        FROM conversations
    ),
    chosen AS (
        SELECT *, xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)),
            lambda crc, b: list_reduce(
                list_prepend(xor(crc, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]),
                lambda x, i: xor(x >> 1, 3988292384 * (x & 1))
            )
        ), 4294967295) % 20 AS kind
        FROM keyed
    ),
    turns AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM chosen WHERE kind <> 0
    ),
    placed AS (
        SELECT *, left(role, 1) AS letter, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS i
        FROM turns
    ),
    judged AS (
        SELECT *, said = '' AS blank,
               said <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
               lag(letter) OVER (PARTITION BY conv_id ORDER BY i) || letter NOT IN ('su', 'ua', 'au') AS illegal
        FROM placed
    ),
    faults AS (
        SELECT *, blank OR duplicate AS goes,
               NOT blank AND NOT duplicate AND right(said, 1) NOT IN ('.', '!', '?') AS truncated,
               3 * (NOT blank AND NOT duplicate AND right(said, 1) NOT IN ('.', '!', '?'))::BIGINT AS stays
        FROM judged
    ),
    marks AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
               count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n
        FROM faults GROUP BY conv_id
    ),
    states AS (
        SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, {never} AS ss, {never} AS su, {never} AS sa
        FROM marks
        UNION ALL
        SELECT o.conv_id, o.i, {then("s0", "4", "D")},
               {least(then("ss", "4", "D"), f"CASE WHEN letter = 's' AND NOT goes THEN {then('s0', 'stays', 'K', own)} ELSE {never} END")},
               {least(then("nu", "4", "D"), stay("s0", "u", user), stay("ss", "u", user), stay("na", "u", user))},
               {least(then("na", "4", "D"), stay("nu", "a", assistant))}
        FROM (
            SELECT conv_id, i, s0, ss, {least("su", from_any)} AS nu,
                   {least("sa", then("su", "3", "I", assistant), then("s0", "6", "II", user + " || chr(10) || " + assistant), then("ss", "6", "II", user + " || chr(10) || " + assistant))} AS na
            FROM states
        ) b JOIN faults o ON o.conv_id IS NOT DISTINCT FROM b.conv_id AND o.i = b.i + 1
    ),
    ends AS (
        SELECT s.conv_id, {least("s0", "sa", then("su", "3", "I", assistant), then("ss", "6", "II", user + " || chr(10) || " + assistant))} AS best
        FROM states s JOIN marks m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.n = s.i
    )
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
           coalesce(best.a, '') AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN marks m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """


@query("op12_structure_repair", _repair_sql())
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.report(repair.damage(conversations), conversations)
