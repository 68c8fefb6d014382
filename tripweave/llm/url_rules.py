"""URL filtering by association rules.

Labelled urls are baskets of tokens: host suffixes, path segments, query keys, the file
ending. Spark's FP-growth mines the token combinations that are frequent among labelled
pages together with a label; a rule says that a combination means ``block``. Tokens that
the very same labelled pages have are mined as one item: a path that many pages share is
one item however deep it is, and a rule on it names all its tokens. Rules stay
if support and confidence suffice, if they lift the base rate, and if no shorter rule is
as confident. They match through an inverted index: each rule hangs on the rarest of its
tokens, a page meets only rules that hang on one of its own, and the whole combination
is compared then. Fixed host and path rules go before the method.

Defined cases: a null url, or one without ``://``, has an empty host and path and no
tokens; it is allowed. Pages without a label teach nothing; with no labels at all there
are no rules and the method allows. Labels that contradict each other for one page count
as block. Rows that repeat are judged alike; of equal confidence the rule of larger
support, then of smaller text decides. A url may have any length. An empty table gives an
empty one. Other columns are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import Scratch, ready


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The host and path rules of the registered query.
HOST_RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)

#: Share of the labelled pages that a combination and its label must be in.
MIN_SUPPORT = 0.002
#: Share of the pages with the combination that carry the label.
MIN_CONFIDENCE = 0.6
#: Labelled pages that it must be in at least, however few there are.
MIN_PAGES = 20
BLOCK = "label=block"
#: Labels of the host suffixes that are tokens; the whole host is one besides.
SUFFIXES = (1, 2, 3, 4)
#: Rules up to which the index is broadcast; beyond that the join shuffles.
BROADCAST_RULES = 100_000


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = _lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: host suffixes, path segments by place, query keys, ending.

    Digits are folded, so that page numbers do not make tokens of their own.
    """
    host, path = host_and_path(url)
    suffixes = F.array(*[F.concat(F.lit("host="), F.substring_index(host, ".", -n)) for n in SUFFIXES])
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    folded = F.transform(
        segments,
        lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(s, "[0-9]+", "0")),
    )
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(
        F.filter(F.split(query, "&"), lambda s: s != ""),
        lambda s: F.concat(F.lit("query="), F.split(s, "=", 2)[0]),
    )
    scheme = F.array(F.concat(F.lit("scheme="), _lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    mark = F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(scheme, suffixes, F.array(F.concat(F.lit("host="), host)), folded, keys, mark))
    return F.when(F.instr(url, "://") > 0, every).otherwise(F.array().cast("array<string>"))


def host_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(
            found
        )
    return found


def _items(baskets: DataFrame, least: float) -> DataFrame:
    """(item, part): the tokens of at least ``least`` baskets (page, tokens), folded.

    Tokens of one and the same set of pages are one item, named by the first of them;
    ``part`` lists them. A set of pages is told by its size and two sums of hashes. As
    itemsets they would differ in nothing, yet double in number with each of them.
    """
    sums = [F.sum(F.xxhash64("page", F.lit(k)).cast("decimal(38,0)")).alias(f"sum{k}") for k in (0, 1)]
    sets = (
        baskets.select("page", F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), *sums)
        .filter(F.col("n") >= least)
    )
    return sets.groupBy("n", "sum0", "sum1").agg(
        F.min("token").alias("item"), F.array_sort(F.collect_set("token")).alias("part")
    ).select("item", "part")


def _hung(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Rules with the ``token`` of theirs that is rarest by ``counts`` (token, count)."""
    every = rules.select("antecedent", F.explode("antecedent").alias("token")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)), "token")).alias("r")
    return rules.join(every.groupBy("antecedent").agg(rarest), "antecedent").select(*rules.columns, "r.token")


def mine(
    labelled: DataFrame, scratch: Scratch, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Rules (antecedent, confidence, support) of baskets (tokens, blocked).

    A rule goes if one of its subsets, itself a rule, is at least as confident.
    """
    # Written, so that a page has one name however often it is read.
    baskets = labelled.filter("size(tokens) > 0").select(F.uuid().alias("page"), "tokens", "blocked")
    baskets = scratch.keep(baskets, "baskets")
    pages = max(1, baskets.count())
    support = min(1.0, max(min_support, MIN_PAGES / pages))
    items = scratch.keep(_items(baskets, support * pages), "items")
    # Of an item's tokens the one that names it stands for all.
    named = (
        baskets.select("page", F.explode("tokens").alias("item"))
        .join(items.select("item"), "item", "left_semi")
        .groupBy("page")
        .agg(F.collect_set("item").alias("items"))
    )
    none = F.array().cast("array<string>")
    folded = baskets.select("page", "blocked").join(named, "page", "left").withColumn("items", F.coalesce("items", none))
    folded = folded.select(F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(folded)
    found = scratch.keep(
        model.associationRules.filter((F.col("consequent")[0] == BLOCK) & (F.col("lift") > 1)).select(
            "antecedent", "confidence", "support"
        ),
        "found",
    )
    whole = (
        found.select("antecedent", F.explode("antecedent").alias("item"))
        .join(items, "item")
        .groupBy("antecedent")
        .agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("whole"))
    )
    rules = found.join(whole, "antecedent").select(F.col("whole").alias("antecedent"), "confidence", "support")
    rules = scratch.keep(rules, "rules")
    # A subset is met under one token of its own, that of the fewest rules.
    counts = rules.select(F.explode("antecedent").alias("token")).groupBy("token").count()
    short = _hung(rules, counts).select("token", F.col("antecedent").alias("part"), F.col("confidence").alias("sure"))
    long = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    needless = (
        long.join(short, "token")
        .filter(
            (F.size("part") < F.size("antecedent"))
            & (F.col("sure") >= F.col("confidence"))
            & (F.size(F.array_except("part", "antecedent")) == 0)
        )
        .select("antecedent")
        .distinct()
    )
    return scratch.keep(rules.join(needless, "antecedent", "left_anti"), "pruned")


def _indexed(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """Rules under the token that the fewest pages have."""
    wanted = rules.select(F.explode("antecedent").alias("token")).distinct()
    counts = pages.select(F.explode("tokens").alias("token")).groupBy("token").count().join(wanted, "token")
    return _hung(rules, counts)


def report(
    pages: DataFrame,
    labels: DataFrame,
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    page_id: str = "page_id",
    url: str = "url",
    label_id: str = "doc_id",
    quality: str = "quality",
    toxic: str = "toxic",
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined_rule, confidence.

    A page's label is that of the same id: of low quality or toxic means block.
    """
    scratch = Scratch(ready(pages.sparkSession), "urls")
    link = F.col(url).cast("string")
    host, path = host_and_path(link)
    cut = scratch.keep(
        pages.select(
            F.col(page_id).alias("page_id"),
            host.alias("host"),
            path.alias("path"),
            tokens(link).alias("tokens"),
            F.xxhash64(link).alias("same"),
        ).withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))),
        "pages",
    )
    marked = (
        labels.select(
            F.col(label_id).alias("page_id"),
            ((F.col(quality) == 0) | F.coalesce(F.col(toxic) == 1, F.lit(False))).alias("blocked"),
        )
        .filter("blocked IS NOT NULL")
        .groupBy("page_id")
        .agg(F.max("blocked").alias("blocked"))
    )
    labelled = scratch.keep(cut.join(marked, "page_id").select("tokens", "blocked"), "labelled")
    rules = _indexed(mine(labelled, scratch, min_support, min_confidence), cut)
    rules = scratch.keep(rules, "index")
    if rules.count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    # Pages of one token set meet the rules once.
    sets = cut.filter("size(tokens) > 0").select(F.array_sort("tokens").alias("tokens")).distinct()
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(rules, "token")
    best = F.max_by(
        F.struct("antecedent", "confidence"),
        F.struct("confidence", "support", F.reverse(F.array_join("antecedent", " "))),
    )
    hits = (
        met.filter(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("tokens").agg(best.alias("hit"))
    )
    # Written before the join, whose tasks Spark can split then: one token set may be hot.
    hits = scratch.keep(hits, "hits")
    judged = cut.withColumn("tokens", F.array_sort("tokens")).join(hits, "tokens", "left")
    fixed = host_rule(F.col("host"), F.col("path"), host_rules)
    return judged.select("page_id", "host", "path", fixed.alias("fixed"), "hit").select(
        "page_id",
        "host",
        "path",
        F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", F.when(F.col("hit").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.array_join("hit.antecedent", " & ").alias("mined_rule"),
        F.col("hit.confidence").alias("confidence"),
    )
