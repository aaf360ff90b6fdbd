r"""Language detection by a trained classifier of character trigrams.

A text is lower-cased, runs of characters that are no letters become one blank, and a blank stands at both ends. Each
three characters in a row fall into one of `BUCKETS` by a polynomial of their code points. Training counts buckets over
labelled rows, by language; the model is smoothed log-probabilities, `BUCKETS` numbers a language whatever the
size of the corpus, so that it travels in the plan. Scoring is one scan without a shuffle and without Python.

Defined results: a text without letters (or null) has no language; of languages that fit equally the first in text
order is told. Rows without a label train nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, so that the code points of close letters spread.
BUCKETS = 8191
FIRST, SECOND = 6151, 97
#: Added to each count.
SMOOTH = 0.5


def trigram_buckets(text: Column) -> Column:
    """The bucket of each three characters in a row; empty for a text without letters."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))
    codes = F.transform(F.regexp_extract_all(F.concat(F.lit(" "), plain, F.lit(" ")), F.lit("(?s)."), F.lit(0)), F.ascii)
    # Within an array of one, the codes are made once and not for each place.
    made = F.transform(F.array(codes), lambda cs: F.transform(F.slice(cs, 1, F.greatest(F.size(cs) - 2, F.lit(0))), lambda c, i: (c * FIRST + F.get(cs, i + 1) * SECOND + F.get(cs, i + 2)) % BUCKETS))
    return F.when(plain == "", F.array().cast("array<int>")).otherwise(F.element_at(made, 1))


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities of the buckets for each language."""

    weights: dict[str, list[float]]

    def __post_init__(self):
        if not self.weights or any(len(w) != BUCKETS for w in self.weights.values()):
            raise ValueError(f"a model has {BUCKETS} weights for each of one or more languages")


#: Labelled rows of a language that are counted, about; all, where there are fewer.
SAMPLE_ROWS = 200


def sampled(rows: DataFrame, key: str, language: str = "language", most: int = SAMPLE_ROWS) -> DataFrame:
    """About `most` of each language's rows, chosen by the MD5 of their key."""
    known = rows.where(F.col(language).isNotNull())
    shares = F.lit(0)
    for row in known.groupBy(language).count().collect():
        shares = F.when(F.col(language) == row[0], min(1 << 32, most * (1 << 32) // row["count"])).otherwise(shares)
    return known.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") < shares)


def train(rows: DataFrame, text: str = "text", language: str = "language") -> LanguageModel:
    """The model of all rows that have a language. Buckets by languages come to the driver: 8,191 numbers for each language."""
    grams = rows.where(F.col(language).isNotNull()).select(F.col(language).alias("l"), F.explode(trigram_buckets(F.col(text))).alias("b"))
    counts: dict[str, dict[int, int]] = {}
    for row in grams.groupBy("l", "b").count().collect():
        counts.setdefault(row.l, {})[row.b] = row["count"]
    weights = {}
    for name in sorted(counts):
        total = sum(counts[name].values()) + SMOOTH * BUCKETS
        weights[name] = [math.log((counts[name].get(b, 0) + SMOOTH) / total) for b in range(BUCKETS)]
    return LanguageModel(weights)


def detect(text: Column, model: LanguageModel) -> Column:
    """A struct (language, confidence): the likeliest language and its share of all languages' likelihoods."""
    # The text is read once: an array of one struct holds its buckets for all languages.
    buckets = F.array(F.struct(trigram_buckets(text).alias("b")))
    # Spark folds this to one literal array.
    table = lambda name: F.split(F.lit(" ".join(map(repr, model.weights[name]))), " ").cast("array<double>")

    def sum_of(buckets: Column, name: str) -> Column:
        return F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(table(name), b))

    def told(x: Column) -> Column:
        log = [F.struct(sum_of(x["b"], n).alias("log"), F.lit(-i).alias("first"), F.lit(n).alias("language")) for i, n in enumerate(model.weights)]
        return F.struct(F.size(x["b"]).alias("n"), F.array(*log).alias("logs"))

    best = F.transform(F.transform(buckets, told), lambda y: F.struct(y["n"].alias("n"), y["logs"].alias("logs"), F.array_max(y["logs"]).alias("top")))

    def answer(y: Column) -> Column:
        rest = F.aggregate(y["logs"], F.lit(0.0), lambda s, z: s + F.exp(z["log"] - y["top"]["log"]))
        some = y["n"] > 0
        return F.struct(F.when(some, y["top"]["language"]).alias("language"), F.when(some, 1 / rest).alias("confidence"))

    return F.element_at(F.transform(best, answer), 1)
