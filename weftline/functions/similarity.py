"""Structural similarity of tool-call arguments: the one comparison that Spark's own functions cannot express."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import ship


def similarity(a: object, b: object) -> float:
    """1 for equal values of equal type; objects by the union of keys, lists by place, strings by matching runs."""
    if type(a) is not type(b):
        return 0.0
    if isinstance(a, dict):
        both = [similarity(x, b[k]) for k, x in a.items() if k in b]
        return sum(both) / (len(a) + len(b) - len(both)) if a or b else 1.0
    if isinstance(a, list):
        return sum(map(similarity, a, b)) / max(len(a), len(b)) if a or b else 1.0
    if isinstance(a, str):
        return matched(a.lower(), b.lower())
    return float(a == b)


def matched(a: str, b: str) -> float:
    """The share of matching runs; equal texts, and texts without a common character, are not searched for them."""
    if a == b:
        return 1.0
    if set(a).isdisjoint(b):
        return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


_decode = json.JSONDecoder().decode


def arguments(text: str | None) -> dict:
    """Arguments from JSON text; {} where that is no object."""
    try:
        value = _decode(text or "{}")
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def _similarities(expected: pd.Series, predicted: pd.Series) -> pd.Series:
    return pd.Series([similarity(arguments(a), arguments(b)) for a, b in zip(expected, predicted, strict=True)], dtype=float)


def _accuracies(expected: pd.Series, predicted: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(expected, predicted, strict=True):
        want, got = arguments(a), arguments(b)
        correct = sum(1 for k, v in want.items() if k in got and got[k] == v)
        rows.append((correct, len(want), correct / len(want) if want else 1.0))
    return pd.DataFrame(rows, columns=["correct", "total", "accuracy"])


def argument_similarity(expected: str, predicted: str) -> Column:
    """Similarity of two columns of JSON arguments, 0 to 1."""
    ship(SparkSession.active())
    return F.pandas_udf(_similarities, T.DoubleType())(expected, predicted)


def parameter_accuracy(expected: str, predicted: str) -> Column:
    """A struct (correct, total, accuracy): expected keys whose value is equal (1, 1.0 and true are), of all expected
    keys; where none is expected, accuracy is 1."""
    ship(SparkSession.active())
    kind = T.StructType([T.StructField("correct", T.LongType()), T.StructField("total", T.LongType()), T.StructField("accuracy", T.DoubleType())])
    return F.pandas_udf(_accuracies, kind)(expected, predicted)
