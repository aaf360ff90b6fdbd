"""Judge answers and tolerant JSON, as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import once

def tolerant_json(text: Column) -> Column:
    """A variant from JSON text, unwrapped once where it is a JSON string of JSON; null where it is neither."""
    outer = F.try_parse_json(text)
    return F.coalesce(F.try_parse_json(F.try_variant_get(outer, "$", "string")), outer)


def first_object(text: Column) -> Column:
    """JSON text out of prose or code fences: from the first brace to the last."""
    block = lambda bare: once(F.regexp_extract(bare, r"(?s)\{.*\}", 0), lambda x: F.when(x == "", bare).otherwise(x))
    return once(_bare(text), lambda bare: F.when(bare.startswith("{"), bare).otherwise(block(bare)))


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?m)^```[a-zA-Z]*\s*|\s*```\s*$", ""))


def balanced_object(text: Column) -> Column:
    """JSON text out of prose or code fences: all of it where it is JSON, else from the first brace to the one that closes
    it; null where there is none. Braces inside strings count."""
    bare = _bare(text)
    after = F.regexp_extract(bare, r"(?s)\{.*", 0)
    # One piece up to each brace; the depth behind it; the pieces up to the first depth of zero.
    pieces = F.regexp_extract_all(after, F.lit(r"[^{}]*[{}]"), F.lit(0))
    state = F.aggregate(
        pieces, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["depth"] + F.when(x.endswith("{"), 1).otherwise(-1)).alias("depth"), (s["size"] + F.length(x)).alias("size"),
            F.when((s["end"] == 0) & x.endswith("}") & (s["depth"] == 1), s["size"] + F.length(x)).otherwise(s["end"]).alias("end"),
        ),
    )
    block = F.when(state["end"] > 0, F.substr(after, F.lit(1), state["end"]))
    return F.when(F.try_parse_json(bare).isNotNull(), bare).otherwise(block)


def parse_judge(text: Column, axes: dict[str, int]) -> Column:
    """A struct (scores map<string,int>, verdict, rationale, parsed).

    Scores are cut to whole numbers and clamped to 1..scale, missing ones count as 1. Without a valid verdict, the
    worst score's place in its scale decides: 0.6 passes, 0.3 warns. What is no JSON scores 0 and fails.
    """
    text = F.coalesce(text, F.lit(""))
    return once(F.try_parse_json(first_object(text)), lambda parsed: once(_scores(parsed, axes), lambda whole: _judged(text, parsed, whole, axes)))


def _scores(parsed: Column, axes: dict[str, int]) -> Column:
    """A struct of the axes' scores, of which each place is named by its number."""

    def score(axis: str, scale: int) -> Column:
        value = F.try_variant_get(parsed, f"$.scores.{axis}", "double")
        # A quoted number with a fraction is no whole number to the judge protocol.
        quoted = F.try_variant_get(parsed, f"$.scores.{axis}", "string")
        number = once(value, lambda x: F.when(x.isNotNull(), x.cast("int")).otherwise(quoted.try_cast("int")))
        return once(number, lambda x: F.when(F.coalesce(x, F.lit(0)) > 0, F.least(x, F.lit(scale))).otherwise(1))

    return F.struct(*[score(a, n).alias(f"s{i}") for i, (a, n) in enumerate(axes.items())])


def _judged(text: Column, parsed: Column, scores: Column, axes: dict[str, int]) -> Column:
    whole = {a: scores[f"s{i}"] for i, a in enumerate(axes)}
    places = [(whole[a] - 1) / max(1, s - 1) for a, s in axes.items()]
    given = F.try_variant_get(parsed, "$.verdict", "string")
    by_score = once(reduce(F.least, places), lambda worst: F.when(worst >= 0.6, "pass").when(worst >= 0.3, "warn").otherwise("fail"))
    verdict = once(given, lambda x: F.when(x.isin("pass", "warn", "fail"), x).otherwise(by_score))
    pairs = [x for a, c in whole.items() for x in (F.lit(a), F.when(parsed.isNull(), 0).otherwise(c).cast("int"))]
    rationale = F.substring(F.coalesce(F.try_variant_get(parsed, "$.rationale", "string"), F.lit("")), 1, 2000)
    invalid = F.concat(F.lit("Judge response was not valid JSON. Raw head: "), F.substring(text, 1, 200))
    return F.struct(
        F.create_map(*pairs).alias("scores"),
        F.when(parsed.isNull(), "fail").otherwise(verdict).alias("verdict"),
        F.when(parsed.isNull(), invalid).otherwise(rationale).alias("rationale"),
        parsed.isNotNull().alias("parsed"),
    )
