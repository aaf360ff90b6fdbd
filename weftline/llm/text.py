r"""Spark expressions on words `[^\x20\x09-\x0D]+`, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import BLANKS

_BLANK_CHARS = " \t\n\x0b\x0c\r"


def whole(df: DataFrame) -> Column:
    """All columns of `df` as one, so that no other column can have the name of one of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def word_count(text: Column) -> Column:
    """The number of words; 0 for a null text. The pieces between blanks, less an empty one at either end."""
    text = F.coalesce(text, F.lit(""))
    blank = lambda c: F.when(F.instr(F.lit(_BLANK_CHARS), c) > 0, 1).otherwise(0)
    pieces = F.size(F.split(text, BLANKS, -1)) - blank(F.substring(text, 1, 1)) - blank(F.right(text, F.lit(1)))
    return F.when(text == "", 0).otherwise(pieces).cast("long")


def words(text: Column) -> Column:
    """The words in order; an empty array for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), "")


def packed(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """`df` with the columns to keep as one, `__kept`, for operators whose own columns have some of their names."""
    return df.withColumn("__kept", F.struct(*[F.col(f"`{c}`") for c in keep]))


def unpacked(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """`df` with the kept columns behind its first one; where a result has the name of one, the result stays."""
    first, *rest = [c for c in df.columns if c != "__kept"]
    return df.select(first, *[F.col(f"__kept.`{c}`").alias(c) for c in keep if c not in (first, *rest)], *rest)
