"""Tool calls and function schemas: stored calls as Spark expressions, free text and nested schemas in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import ship

# How models write calls into their text.
SENTINEL = "[TOOL_CALLS]"
_TAGGED = re.compile(r"<tool_call>\s*(\{.*?\})\s*</tool_call>", re.DOTALL)
_NAMED = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?=\{)")
_DECODER = json.JSONDecoder()

_CALL = "struct<id:string,name:string,arguments:string,function:struct<id:string,name:string,arguments:string>>"


def stored_calls(text: Column) -> Column:
    """An array of (id, name, arguments) from stored JSON, flat or with a nested function; arguments become JSON text,
    {} where there are none; calls without a name go; what is no array gives an empty one."""
    raw = F.coalesce(F.from_json(text, f"array<{_CALL}>"), F.array().cast(f"array<{_CALL}>"))

    def plain(c: Column) -> Column:
        nested = c["function"].isNotNull()
        pick = lambda k: F.when(nested, c["function"][k]).otherwise(c[k])
        return F.struct(
            F.coalesce(F.nullif(c["id"], F.lit("")), F.when(nested, c["function"]["id"]), F.lit("")).alias("id"),
            pick("name").alias("name"), F.coalesce(pick("arguments"), F.lit("{}")).alias("arguments"),
        )

    return F.filter(F.transform(F.filter(raw, lambda c: c.isNotNull()), plain), lambda c: c["name"].isNotNull())


def _plain(call: object) -> dict | None:
    if not isinstance(call, dict):
        return None
    inner = call["function"] if isinstance(call.get("function"), dict) else {}
    name, found = call.get("name") or inner.get("name"), call.get("arguments")
    found = inner.get("arguments") if found is None else found
    if not isinstance(name, str) or not name:
        return None
    text = "{}" if found is None else found if isinstance(found, str) else json.dumps(found, ensure_ascii=False)
    return {"id": call.get("id"), "name": name, "arguments": text}


def _after_sentinel(part: str) -> tuple[list[dict], str | None]:
    """Calls at the beginning of what follows a sentinel, and the rest of it; None where nothing can be parsed."""
    bare = part.lstrip()
    if bare.startswith("["):
        try:
            value, end = _DECODER.raw_decode(bare)
        except ValueError:
            return [], None
        return [c for c in map(_plain, value) if c], bare[end:]
    calls, at = [], 0
    while found := _NAMED.match(bare, at):
        try:
            value, end = _DECODER.raw_decode(bare, found.end())
        except ValueError:
            break
        calls.append({"id": None, "name": found[1], "arguments": json.dumps(value, ensure_ascii=False)})
        at = end
    return calls, bare[at:] if at else part


def inline_calls(text: str | None) -> tuple[list[dict], str | None]:
    """Calls that a model wrote into its text, and the text without them; the text is unchanged where there are none."""
    if not text:
        return [], text
    head, *parts = text.split(SENTINEL)
    calls: list[dict] = []
    kept = [head]
    for part in parts:
        found, rest = _after_sentinel(part)
        calls += found
        kept.append(SENTINEL + part if rest is None else rest)
    content = "".join(kept).strip() if calls else text
    tagged = []
    for body in _TAGGED.findall(content):
        try:
            tagged.append(_plain(json.loads(body)))
        except ValueError:
            continue
    if any(tagged):
        calls += [c for c in tagged if c]
        content = _TAGGED.sub("", content).strip()
    return calls, content


def _inline(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([inline_calls(t) for t in texts], columns=["calls", "content"])


def parse_inline_calls(text: str | Column) -> Column:
    """A struct (calls array of (id, name, arguments), content). A call without an id has a null one."""
    ship(SparkSession.active())
    call = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "arguments")])
    kind = T.StructType([T.StructField("calls", T.ArrayType(call)), T.StructField("content", T.StringType())])
    return F.pandas_udf(_inline, kind)(text)


def inlined(schema: object, shared: dict, seen: tuple[str, ...] = ()) -> object:
    """A schema with its references to shared entities replaced; one that leads back to itself is left as it is."""
    if isinstance(schema, list):
        return [inlined(x, shared, seen) for x in schema]
    if not isinstance(schema, dict):
        return schema
    parts = str(schema.get("$ref", "")).lstrip("#/").split("/")
    if "$ref" not in schema:
        return {k: inlined(v, shared, seen) for k, v in schema.items()}
    if len(parts) != 2 or parts[0] != "shared_entities" or parts[1] in seen:
        return schema
    return inlined(shared.get(parts[1], {}), shared, (*seen, parts[1]))


def _resolved(schemas: pd.Series, shared: pd.Series) -> pd.Series:
    def one(schema: str | None, entities: str | None) -> str | None:
        try:
            return json.dumps(inlined(json.loads(schema or "null"), json.loads(entities or "{}")), ensure_ascii=False)
        except ValueError:
            return None

    return pd.Series([one(a, b) for a, b in zip(schemas, shared, strict=True)], dtype=object)


def resolve_references(schema: str | Column, shared: str | Column) -> Column:
    """JSON schemas with `#/shared_entities/<name>` inlined, at any depth; null where either is no JSON."""
    ship(SparkSession.active())
    return F.pandas_udf(_resolved, T.StringType())(schema, shared)
