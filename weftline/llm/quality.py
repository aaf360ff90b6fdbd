r"""Quality rules by distribution divergence, in DataFrame functions only.

Each document is reduced to counts: base features, characters by class, and its common function words. The counts of
all documents of a language add up to that language's reference; a document whose histograms lie too far from its
reference, by Jensen-Shannon distance (base 2, 0 to 1), is rejected: one alone beyond its `MAX`, or both beyond their
`BOTH`. Guards: only texts of `MIN_CHARS` characters and `MIN_WORDS` words or more are judged, shorter ones pass. Languages outside `LANGUAGES` and null share one
reference, so the references are five rows at most and are broadcast.

One scan computes the counts, which are staged; sums over them give the references. Nothing is shuffled but partial
sums. Defined results: a null text has no words or lines and fails the base rule; repeated rows are judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.staging import stage
from weftline.llm.text import packed, unpacked, whole, words

LANGUAGES = ("en", "de", "fr", "es")
MIN_CHARS, MIN_WORDS = 200, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.32, 0.30
BOTH_CLASS_DISTANCE, BOTH_WORD_DISTANCE = 0.145, 0.24

# Frequent function words of the four languages.
COMMON = (
    ["the", "of", "and", "to", "in", "a", "is", "that"]
    + ["der", "die", "und", "das", "von", "den", "mit", "zu"]
    + ["de", "la", "le", "et", "les", "des", "un", "que"]
    + ["el", "los", "las", "en", "por", "con", "para", "y"]
)
SYMBOLS = r"[#*$%&|<>]"


def _left(text: Column, others: str) -> Column:
    """How many characters are not of the class `others`."""
    return F.length(F.regexp_replace(text, others + "+", "")).cast("long")


#: Of the window hashes `h`: their order, as longs that hold a hash's high bits over its place in the low `b` bits.
_SORTED = "sort_array(transform(h, (x, i) -> shiftleft(shiftright(x, b), b) | cast(i AS bigint)))"
_SAME = "shiftright(x, b) = shiftright(get(s, {j}), b) AND get(h, int(x & shiftleft(1L, b) - 1)) = get(h, int(get(s, {j}) & shiftleft(1L, b) - 1))"
#: Places of the windows that stand twice or more: neighbours in that order whose whole hashes are equal.
_PLACES = f"transform(filter(s, (x, i) -> coalesce({_SAME.format(j='i - 1')}, false) OR coalesce({_SAME.format(j='i + 1')}, false)), x -> x & shiftleft(1L, b) - 1)"


def _covered(places: Column) -> Column:
    """How many words the 3-word windows at these places cover."""
    return F.size(F.array_distinct(F.concat(places, F.transform(places, lambda p: p + 1), F.transform(places, lambda p: p + 2))))


#: Names of the operator's own columns.
OWN = {
    "doc_id", "lang", "text", "w", "n_words", "word_chars", "n_symbols", "n_chars", "n_dup_lines", "n_repeat_words", "upper", "digits", "points", "wide", "lines", "h", "b", "s",
    "places", "listed", "classes", "common", "language", "classes_ref", "common_ref", "classes_unit", "common_unit", "classes_ref_unit", "common_ref_unit", "class_distance",
    "word_distance", "base_failed", "kept",
}


def measure(docs: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, *keep, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common).

    Kept columns may have any names; one with the name of a result is left out.
    """
    if set(keep) & OWN:
        return unpacked(measure(packed(docs, keep), keep=("__kept",)), keep)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *keep, "lang", text.alias("text"), words(text).alias("w"))
    # Generators hold what lies below them fixed: each array is made once, not once per use.
    rows = rows.select("doc_id", *keep, "lang", F.inline(F.array(F.struct("text", "w"))))
    n = F.size("w") - 2
    windows = F.when(n > 0, F.transform(F.slice("w", 1, n), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    listed = F.filter("w", lambda x: x.isin(*COMMON))
    size = F.length("text").cast("long")
    fields = {
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": (F.size(F.split("text", SYMBOLS, -1)) - 1).cast("long"),
        "n_chars": size,
        "upper": _left(F.col("text"), "[^A-Z]"),
        "digits": _left(F.col("text"), "[^0-9]"),
        "points": _left(F.col("text"), "[^.,;:!?]"),
        "wide": _left(F.col("text"), r"[\x00-\x7F]"),
        "lines": lines,
        "h": F.coalesce(windows, F.array().cast("array<bigint>")),
        "b": F.length(F.bin(F.size("w"))),
        "listed": listed,
    }
    rows = rows.select("doc_id", *keep, "lang", F.inline(F.array(F.struct(*[c.alias(k) for k, c in fields.items()]))))
    repeats = F.size("h") > F.size(F.array_distinct("h"))
    rows = rows.withColumn("h", F.when(repeats, F.col("h")).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("*", F.inline(F.array(F.struct(F.expr(_SORTED).alias("s")))))
    rows = rows.select("*", F.inline(F.array(F.struct(F.expr(_PLACES).alias("places")))))
    blank = F.col("n_chars") - F.col("word_chars")
    marked = [F.col("upper"), F.col("digits"), F.col("points"), F.col("wide"), F.col("n_symbols"), blank]
    other = F.col("n_chars") - reduce(lambda a, b: a + b, marked)
    counts = [(F.size("listed") - F.size(F.array_remove("listed", w))).cast("long") for w in COMMON]
    return rows.select(
        "doc_id", *keep, "lang", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("places")).cast("long").alias("n_repeat_words"),
        F.array(*marked, other).alias("classes"),
        F.array(*counts, F.col("n_words") - F.size("listed")).alias("common"),
    )


def references(measured: DataFrame) -> DataFrame:
    """One row per language: what the counts of all its documents add up to."""

    def total(name: str, width: int) -> Column:
        return F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(width)]).alias(f"{name}_ref")

    return measured.groupBy("language").agg(total("classes", 7), total("common", len(COMMON) + 1))


def distance(own: str, ref: str) -> Column:
    """Jensen-Shannon distance of two count arrays; null where either is empty."""
    # The reciprocals are columns of the row, or they would be summed again for each element.
    share = lambda c: F.transform(c, lambda x: x.cast("double") * F.col(f"{c}_unit"))

    def part(p: Column, q: Column) -> Column:
        both = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / both)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / both)).otherwise(0.0)

    parts = F.zip_with(share(own), share(ref), part)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """`measure`'s rows with base_failed, the two distances and kept."""
    if set(keep) & OWN:
        return unpacked(judge(packed(docs, keep), keep=("__kept",)), keep)
    measured = stage(measure(docs, keep=keep), "measured")
    listed = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("other")
    measured = measured.withColumn("language", listed)
    rows = measured.join(F.broadcast(references(measured)), "language", "left")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    units = [F.try_divide(F.lit(1.0), total(c)).alias(f"{c}_unit") for c in ("classes", "classes_ref", "common", "common_ref")]
    rows = rows.select("*", F.inline(F.array(F.struct(*units))))
    rows = rows.withColumns({"class_distance": distance("classes", "classes_ref"), "word_distance": distance("common", "common_ref")})
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    chars = total("classes")
    by_class, by_word = F.col("class_distance"), F.col("word_distance")
    far = (by_class > MAX_CLASS_DISTANCE) | (by_word > MAX_WORD_DISTANCE) | ((by_class > BOTH_CLASS_DISTANCE) & (by_word > BOTH_WORD_DISTANCE))
    far = far & (chars >= MIN_CHARS) & (n >= MIN_WORDS)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(far, F.lit(False)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose verdict is kept; every row of equal text and language is judged alike.

    Each row goes with its measures into the staged table, so no text is shuffled.
    """
    packed = docs.select("doc_id", "text", "lang", whole(docs).alias("__doc"))
    return judge(packed, keep=("__doc",)).where("kept").select("__doc.*")
