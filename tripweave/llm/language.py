"""Language identification in two steps: the family first, then the language within it.

A text becomes counts of hashed letter n-grams (one to three letters), square-rooted and
scaled to length one. Linear support vector machines, one for each pair of families and
one for each pair of languages of a family, are fitted with Spark ML on a bounded sample
of distinct labelled texts; the pair machines vote, and the logistic of their margins breaks ties
and gives the score.

Defined cases: null text and text without a letter give ``und`` with score 0. Languages
outside the family table are families of their own. With one learned language every
other text gets it; with none every text gets ``und``. Labels that are null teach nothing.
Rows that repeat are judged alike. Other columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripweave.llm.common import Scratch, ready

# Language families, by ISO 639-1 codes.
FAMILIES = {
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "uralic": ("et", "fi", "hu"),
}

#: Distinct labelled texts that a language is learned from, at most.
SAMPLE_PER_LANGUAGE = 400
#: Buckets of the hashed n-grams.
BUCKETS = 4096

UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), f"only {language}")


def profile(text: str | None) -> np.ndarray | None:
    """Hashed n-gram profile of a whole text; None where it has no letter."""
    letters = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not any(c.isalpha() for c in letters):  # superscripts and number signs are no letters
        return None
    points = np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    one, two, three = _MULTIPLIERS
    gram = points * one
    counts = np.bincount(gram[1:-1] >> 20, minlength=BUCKETS)
    gram = (gram[:-1] ^ (gram[:-1] >> 15)) * two + points[1:]
    counts += np.bincount((gram * one) >> 20, minlength=BUCKETS)
    gram = (gram[:-1] ^ (gram[:-1] >> 13)) * three + points[2:]
    counts += np.bincount((gram * one) >> 20, minlength=BUCKETS)
    weights = np.sqrt(counts, dtype=np.float32)
    return weights / np.sqrt(np.dot(weights, weights))


@dataclass
class PairMachines:
    """Linear machines, one for each pair of classes, that vote."""

    classes: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS), np.float32))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class and its mean pairwise probability, for each row of ``x``."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, dtype=int), np.ones(n)
        sure = 1 / (1 + np.exp(-2 * np.clip(x @ self.weights.T + self.offsets, -30, 30)))
        votes, mean = np.zeros((n, k)), np.zeros((n, k))
        for pair, (a, b) in enumerate(combinations(range(k), 2)):
            for which, p in ((a, sure[:, pair]), (b, 1 - sure[:, pair])):
                votes[:, which] += p >= 0.5
                mean[:, which] += p / (k - 1)
        best = np.argmax(votes + 0.5 * mean, axis=1)
        return best, mean[np.arange(n), best]


@dataclass
class LanguageModel:
    families: PairMachines | None
    languages: dict[str, PairMachines]

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        profiles = [profile(t) for t in texts]
        names = np.full(len(profiles), UNDETERMINED, dtype=object)
        scores = np.zeros(len(profiles))
        known = np.array([i for i, p in enumerate(profiles) if p is not None], dtype=int)
        if self.families and len(known):
            x = np.stack([profiles[i] for i in known])
            family, family_score = self.families.judge(x)
            for f, name in enumerate(self.families.classes):
                rows = np.flatnonzero(family == f)
                if len(rows):
                    machines = self.languages[name]
                    language, score = machines.judge(x[rows])
                    names[known[rows]] = np.array(machines.classes, dtype=object)[language]
                    scores[known[rows]] = family_score[rows] * score
        return pd.DataFrame({"lang_pred": names, "score": scores.astype(float)})


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept out of learning: crc32 of the id's text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame, scratch: Scratch, text: str, lang: str, bound: int = SAMPLE_PER_LANGUAGE
) -> DataFrame:
    """(lang, features): at most ``bound`` distinct texts of each language, drawn by their hash.

    Copies of a text count once, in the rate as in the places. A first draw at that rate
    keeps about four times the bound, so that choosing the bound itself orders few rows.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    rows = rows.withColumn("draw", F.xxhash64("text"))
    hashes = scratch.keep(rows.select("lang", "draw").distinct(), "hashes")
    rate = F.least(F.lit(1.0), F.lit(4.0 * bound) / F.col("count"))
    rates = hashes.groupBy("lang").count().select("lang", rate.alias("rate"))
    drawn = hashes.join(F.broadcast(rates), "lang").filter(
        F.pmod("draw", F.lit(1_000_000)) < F.col("rate") * 1_000_000
    )
    first = Window.partitionBy("lang").orderBy("draw")
    few = scratch.keep(
        drawn.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= bound).select("lang", "draw"),
        "drawn",
    )
    # Each task sends a text once, however many copies it has.
    few = rows.join(F.broadcast(few), ["lang", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text"))

    @F.pandas_udf("array<float>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(profile)

    return scratch.keep(
        few.select("lang", features("text").alias("features")).filter("features IS NOT NULL"),
        "sample",
    )


def _fit_pairs(sample: DataFrame, classes: list[str], column: str) -> PairMachines:
    if len(classes) < 2:
        return PairMachines(classes)
    weights, offsets = [], []
    svm = LinearSVC(maxIter=40, regParam=1e-3, standardization=False)
    for a, b in combinations(classes, 2):
        two = sample.filter(F.col(column).isin(a, b)).select(
            (F.col(column) == a).cast("double").alias("label"),
            array_to_vector("features").alias("features"),
        )
        fitted = svm.fit(two)
        weights.append(fitted.coefficients.toArray())
        offsets.append(fitted.intercept)
    return PairMachines(classes, np.array(weights, np.float32), np.array(offsets, np.float32))


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
) -> LanguageModel:
    """Learn from the labelled rows of ``docs``; pass only those that may teach."""
    scratch = Scratch(ready(docs.sparkSession), "language")
    sample = labelled_sample(docs, scratch, text, lang, sample_per_language).coalesce(4)
    found = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not found:
        return LanguageModel(None, {})
    members: dict[str, list[str]] = {}
    for name in found:
        members.setdefault(family_of(name), []).append(name)
    pairs = F.create_map(*[F.lit(x) for n in found for x in (n, family_of(n))])
    sample = sample.withColumn("family", pairs[F.col("lang")])
    return LanguageModel(
        _fit_pairs(sample, sorted(members), "family"),
        {f: _fit_pairs(sample, names, "lang") for f, names in members.items()},
    )


def predicted(model: LanguageModel, text: str = "text") -> Column:
    """Struct of lang_pred and score for a column of whole texts."""
    return F.pandas_udf(model.predict, "lang_pred string, score double")(F.col(text))


def report(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    ready(docs.sparkSession)
    # A row without an id has no known remainder and does not teach.
    model = fit(docs.filter(~held_out(doc_id) & F.col(doc_id).isNotNull()), text, lang, sample_per_language)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        held_out(doc_id).alias("held_out"),
        predicted(model, text).alias("found"),
    ).select("doc_id", "held_out", "found.lang_pred", "found.score")


def identified(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
) -> DataFrame:
    """The rows of ``docs`` whose text has a language; the others are rejected."""
    ready(docs.sparkSession)
    model = fit(docs, text, lang, sample_per_language)
    if model.families is None:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    rows = docs.select(F.struct("*").alias("whole"), predicted(model, text).alias("found"))
    return rows.filter(F.col("found.lang_pred") != UNDETERMINED).select("whole.*")
