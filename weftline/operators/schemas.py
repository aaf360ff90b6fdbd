"""Examples of tools held against their JSON Schemas, and the schemas against the rules for schemas.

A tool's schema is a tree of constraints, an example a tree of values. Schemas are flattened by path, level by level, and
become a map of plain constraints for each tool; each example is joined with its tool's map once, and its values meet the
constraints of their paths inside the row, so what is shuffled is one row an example. Each breach is a row. A step of a path
is `.name` into an object and `[]` into an array, so all items of an array meet the constraint of its items.

Checked: type (one or several), enum, const, required, properties, additionalProperties (true or false), items,
minimum, maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength, minItems, maxItems, and schemas that are
true or false. Other keywords that constrain are told as `unchecked` rows of the schema, never passed over in silence.
Numbers compare by value (1 is 1.0, and an integer); enum and const of arrays and objects by their text, keys sorted.

Defined results: a schema that is no JSON object is one breach, `not_an_object`; of a tool whose schema is in breach no
example is checked and all are kept. An example that is no JSON is in breach at its root (`not_json`). Null examples
and tools without a schema row have no rows. Depth beyond `MAX_DEPTH` is an error, not a cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import once
from weftline.session import cut

MAX_DEPTH = 24
#: So many constraints at most are sent to all tasks, some 20 MB; examples then stay where they are read.
SENT = 50_000
# The names of JSON Schema.
TYPES = ("null", "boolean", "integer", "number", "string", "array", "object")
CHECKED = (
    "type", "enum", "const", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "exclusiveMinimum",
    "exclusiveMaximum", "minLength", "maxLength", "minItems", "maxItems",
)
SILENT = ("title", "description", "default", "examples", "example", "$schema", "$id", "$comment", "$defs", "definitions", "format", "deprecated", "readOnly", "writeOnly")
_NUMBERS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum")
_SIZES = ("minLength", "maxLength", "minItems", "maxItems")


def _scalar_kind(v: Column) -> Column:
    def named(name: Column) -> Column:
        value = F.try_variant_get(v, "$", "double")
        number = F.substring_index(name, "(", 1).isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")
        return F.when(name == "VOID", "null").when(name == "BOOLEAN", "boolean").when(name == "STRING", "string").when(number & (value == F.floor(value)), "integer").when(number, "number")

    return once(F.schema_of_variant(v), named)


def kind_of(v: Column) -> Column:
    """The JSON type of a variant, integer for numbers without a fraction; null for no variant at all."""
    inner = lambda kind: F.try_variant_get(v, "$", kind).isNotNull()
    return F.when(inner("map<string,variant>"), "object").when(inner("array<variant>"), "array").otherwise(_scalar_kind(v))


def _fields(v: Column) -> Column:
    """(key, value) pairs of an object; empty for all else."""
    none = F.array().cast("array<struct<key:string,value:variant>>")
    return F.when(kind_of(v) == "object", F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))).otherwise(none)


def _items(v: Column) -> Column:
    return F.when(kind_of(v) == "array", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def _flat(rows: DataFrame, keys: list[str], children) -> DataFrame:
    """Rows (keys, path, shown, depth, v) of a tree and all below it, from rows (keys, v); `children(v)` gives (step, shown, v) of a node."""
    front = cut(rows.select(*keys, F.lit("").alias("path"), F.lit("").alias("shown"), F.lit(0).alias("depth"), "v"))
    found = front
    for depth in range(MAX_DEPTH + 1):
        below = front.where(kind_of(F.col("v")).isin("object", "array")).select(*keys, "path", "shown", F.explode(children(F.col("v"))).alias("c"))
        front = cut(below.select(*keys, F.concat("path", "c.step").alias("path"), F.concat("shown", "c.shown").alias("shown"), F.lit(depth + 1).alias("depth"), "c.v"))
        if front.isEmpty():
            return found
        if depth == MAX_DEPTH:
            raise ValueError(f"a JSON tree is deeper than {MAX_DEPTH} levels")
        found = found.unionAll(front)
    return found


def _too_deep(text: Column) -> Column:
    """Whether JSON text has values below `MAX_DEPTH`: strings, blanks and empty containers count for nothing, brackets are counted."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\.", ""), r'"[^"]*"', "x"), r"\s+", "")
    brackets = F.regexp_replace(F.regexp_replace(plain, r"\[\]|\{\}", "x"), r"[^\[\]{}]+", "")
    depth = F.aggregate(
        F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: once(s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0), lambda now: F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))),
        lambda s: s["most"],
    )
    # Few texts have so many brackets at all.
    return (F.length(text) - F.length(F.translate(text, "[{", "")) > MAX_DEPTH) & (depth > MAX_DEPTH)


def _step(step: Column, shown: Column, v: Column) -> Column:
    return F.struct(step.alias("step"), shown.alias("shown"), v.alias("v"))


def _named(key: Column) -> Column:
    """A step into an object; names keep their dots and brackets apart from steps."""
    return F.concat(F.lit("."), F.regexp_replace(key, r"([\\.\[])", r"\\$1"))


def _schema_children(v: Column) -> Column:
    properties = F.transform(_fields(F.try_variant_get(v, "$.properties", "variant")), lambda e: _step(_named(e["key"]), F.concat(F.lit(".properties."), e["key"]), e["value"]))
    items = F.try_variant_get(v, "$.items", "variant")
    some = F.when(items.isNotNull() & (kind_of(v) == "object"), F.array(_step(F.lit("[]"), F.lit(".items"), items))).otherwise(F.array().cast("array<struct<step:string,shown:string,v:variant>>"))
    return F.concat(properties, some)


def schema_nodes(tools: DataFrame) -> DataFrame:
    """Rows (tool, path, shown, depth, v), one for each schema in a tool's schema; `tools` has tool and parameters (JSON)."""
    return _flat(tools.select("tool", F.try_parse_json("parameters").alias("v")), ["tool"], _schema_children)


def _strings(v: Column) -> Column:
    """An array of strings, or null where a variant is none."""
    return F.when((F.size(_items(v)) == 0) | ~F.exists(_items(v), lambda x: kind_of(x) != "string"), F.transform(_items(v), lambda x: F.try_variant_get(x, "$", "string")))


def _breach(rule: str, when: Column, detail: Column | None = None) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")))


def _parts(nodes: DataFrame, *names: str) -> DataFrame:
    """`nodes` with the kind of v, and each named keyword's value and kind (k_ and its name)."""
    with_parts = nodes.withColumns({"kind": kind_of(F.col("v"))} | {n: F.try_variant_get("v", f"$.{n}", "variant") for n in names})
    return with_parts.withColumns({f"k_{n}": kind_of(F.col(n)) for n in names})


def schema_breaches(tools: DataFrame) -> DataFrame:
    """Rows (tool, path, rule, detail): what is wrong with the schemas themselves; rule `unchecked` only tells."""
    return _schema_breaches(schema_nodes(tools))


def _schema_breaches(nodes: DataFrame) -> DataFrame:
    v, kind = F.col("v"), F.col("kind")
    part, of, there = F.col, lambda name: F.col(f"k_{name}"), lambda name: F.col(name).isNotNull()
    one = F.try_variant_get(part("type"), "$", "string")
    several = F.filter(_items(part("type")), lambda x: ~F.coalesce(F.try_variant_get(x, "$", "string").isin(*TYPES), F.lit(False)))
    known = F.when(of("type") == "string", one.isin(*TYPES)).otherwise((of("type") == "array") & (F.size(_items(part("type"))) > 0) & (F.size(several) == 0))
    required = F.col("names")
    unknown = F.filter(F.transform(_fields(v), lambda e: e["key"]), lambda k: ~k.isin(*CHECKED, *SILENT))
    additional = of("additionalProperties")
    checks = [
        _breach("not_an_object", (F.col("path") == "") & ~F.coalesce(kind == "object", F.lit(False))),
        _breach("not_a_schema", (F.col("path") != "") & ~kind.isin("object", "boolean")),
        _breach("type", there("type") & ~F.coalesce(known, F.lit(False)), F.to_json(part("type"))),
        _breach("required", there("required") & ((of("required") != "array") | required.isNull() | (F.size(required) != F.size(F.array_distinct(required))))),
        _breach("properties", there("properties") & (of("properties") != "object")),
        _breach("enum", there("enum") & (of("enum") != "array")),
        *[_breach(n, there(n) & ~of(n).isin("integer", "number")) for n in _NUMBERS],
        *[_breach(n, there(n) & ~F.coalesce((of(n) == "integer") & (F.try_variant_get(part(n), "$", "double") >= 0), F.lit(False))) for n in _SIZES],
        _breach("additionalProperties", there("additionalProperties") & ~additional.isin("object", "boolean")),
    ]
    told = F.transform(unknown, lambda k: F.struct(F.lit("unchecked").alias("rule"), k.alias("detail")))
    half = F.when(additional == "object", F.array(F.struct(F.lit("unchecked").alias("rule"), F.lit("additionalProperties").alias("detail")))).otherwise(F.array().cast("array<struct<rule:string,detail:string>>"))
    rows = _parts(nodes, "type", "required", "properties", "enum", "additionalProperties", *_NUMBERS, *_SIZES).withColumn("names", _strings(part("required")))
    return rows.select("tool", F.concat(F.lit("$"), "shown").alias("path"), F.inline(F.concat(F.filter(F.array(*checks), F.isnotnull), told, half)))


def _comparable(v: Column) -> Column:
    """What `_same` compares: the number, or null for what is none, and the text."""
    return F.struct(F.when(kind_of(v).isin("integer", "number"), F.try_variant_get(v, "$", "double")).alias("number"), F.to_json(v).alias("text"))


def _same(a: Column, b: Column) -> Column:
    return F.when(a["number"].isNotNull() & b["number"].isNotNull(), a["number"] == b["number"]).otherwise(a["text"] == b["text"])


def _constraints(nodes: DataFrame) -> DataFrame:
    """Rows (tool, nodes, depth): for each tool the map of its schemas' constraints by path, in plain types."""
    part, none = F.col, F.array().cast("array<string>")
    limit = lambda name: F.try_variant_get(part(name), "$", "double").alias(name)
    types = F.when(F.col("k_type") == "array", _strings(part("type"))).otherwise(F.array(F.try_variant_get(part("type"), "$", "string")))
    plain = F.struct(
        (~F.coalesce(F.try_variant_get("v", "$", "boolean"), F.lit(True))).alias("never"),
        F.when(part("type").isNotNull(), types).alias("types"),
        F.when(part("enum").isNotNull(), F.transform(_items(part("enum")), _comparable)).alias("enum"),
        F.when(part("const").isNotNull(), _comparable(part("const"))).alias("const"),
        *map(limit, (*_NUMBERS, *_SIZES)),
        F.coalesce(_strings(part("required")), none).alias("required"),
        F.transform(_fields(part("properties")), lambda e: e["key"]).alias("properties"),
        (~F.coalesce(F.try_variant_get(part("additionalProperties"), "$", "boolean"), F.lit(True))).alias("closed"),
    )
    rows = _parts(nodes, "type", "enum", "const", "required", "properties", "additionalProperties", *_NUMBERS, *_SIZES).select("tool", "path", "depth", plain.alias("s"))
    rows = rows.groupBy("tool", "path").agg(F.collect_list("s").alias("s"), F.max("depth").alias("depth"))
    return rows.groupBy("tool").agg(F.map_from_entries(F.collect_list(F.struct("path", "s"))).alias("nodes"), F.max("depth").alias("depth"))


def _met(path: Column, shown: Column, v: Column) -> Column:
    """A value at a path, with the entries of an object and the items of an array; null where it is neither."""
    fields, items = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.try_variant_get(v, "$", "array<variant>")
    return F.struct(path.alias("path"), shown.alias("shown"), v.alias("v"), fields.alias("fields"), items.alias("items"))


def _below(e: Column, nodes: Column) -> Column:
    """The values inside the value of `e` for whose paths there are constraints."""
    steps = lambda path, shown, v: F.struct(F.concat(e["path"], path).alias("path"), F.concat(e["shown"], F.lit("."), shown).alias("shown"), v.alias("v"))
    named = F.transform(e["fields"], lambda x: steps(_named(x["key"]), x["key"], x["value"]))
    listed = F.transform(e["items"], lambda x, i: steps(F.lit("[]"), i.cast("string"), x))
    known = F.filter(F.coalesce(named, listed), lambda x: F.map_contains_key(nodes, x["path"]))
    return F.coalesce(F.transform(known, lambda x: _met(x["path"], x["shown"], x["v"])), F.filter(F.array(e), lambda x: F.lit(False)))


def _breaches(e: Column, s: Column, kind: Column, number: Column) -> Column:
    """An array of breaches (path, rule, detail) of the constraints `s` by the value of `e`; number is null for what is none."""
    v, shown = e["v"], F.when(e["shown"] == "", "<root>").otherwise(F.substring(e["shown"], 2, 1 << 20))
    typed = F.array_contains(s["types"], kind) | ((kind == "integer") & F.array_contains(s["types"], "number"))
    size = F.when(kind == "string", F.length(F.try_variant_get(v, "$", "string")))
    many = F.size(e["items"])
    breach = lambda rule, when, detail=None: F.when(when, F.struct(shown.alias("path"), F.lit(rule).alias("rule"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")))
    own = F.struct(number.alias("number"), F.to_json(v).alias("text"))
    limit = lambda rule, there, beyond, detail: breach(rule, s[rule].isNotNull() & there & beyond(s[rule]), detail)
    one = [
        breach("false_schema", s["never"]),
        breach("type", s["types"].isNotNull() & ~F.coalesce(typed, F.lit(False)), kind),
        breach("enum", s["enum"].isNotNull() & ~once(own, lambda o: F.exists(s["enum"], lambda x: _same(x, o))), F.to_json(v)),
        breach("const", s["const"].isNotNull() & ~once(own, lambda o: _same(s["const"], o)), F.to_json(v)),
        limit("minimum", number.isNotNull(), lambda x: number < x, F.to_json(v)),
        limit("maximum", number.isNotNull(), lambda x: number > x, F.to_json(v)),
        limit("exclusiveMinimum", number.isNotNull(), lambda x: number <= x, F.to_json(v)),
        limit("exclusiveMaximum", number.isNotNull(), lambda x: number >= x, F.to_json(v)),
        limit("minLength", kind == "string", lambda x: size < x, size),
        limit("maxLength", kind == "string", lambda x: size > x, size),
        limit("minItems", kind == "array", lambda x: many < x, many),
        limit("maxItems", kind == "array", lambda x: many > x, many),
    ]
    each = lambda rule, listed: F.transform(F.array_sort(listed), lambda x: F.struct(shown.alias("path"), F.lit(rule).alias("rule"), x.alias("detail")))
    none = F.array().cast("array<struct<path:string,rule:string,detail:string>>")
    names = F.transform(e["fields"], lambda x: x["key"])
    missing, extra = each("required", F.array_except(s["required"], names)), F.when(s["closed"], each("additionalProperties", F.array_except(names, s["properties"]))).otherwise(none)
    return F.concat(F.filter(F.array(*one), F.isnotnull), F.when(kind == "object", F.concat(missing, extra)).otherwise(none))


def example_breaches(tools: DataFrame, examples: DataFrame) -> DataFrame:
    """Rows (tool, example, path, rule, detail) from `examples` (tool, example, value as JSON), of tools whose schema is sound."""
    given = examples.where("value IS NOT NULL").select("tool", "example", "value")
    if not given.where(_too_deep(F.col("value")) & F.try_parse_json("value").isNotNull()).isEmpty():
        raise ValueError(f"a JSON tree is deeper than {MAX_DEPTH} levels")
    every = schema_nodes(tools)
    unsound = _schema_breaches(every).where("rule <> 'unchecked'").select("tool").distinct()
    # Written, so that the join below is of two plain shuffles, which Spark can split where a tool has many examples.
    sound = cut(_constraints(every.join(unsound, "tool", "left_anti")))
    levels, size = sound.agg(F.coalesce(F.max("depth"), F.lit(0)), F.coalesce(F.sum(F.size("nodes")), F.lit(0))).first()
    nodes = F.col("nodes")

    def values(found: Column, front: Column, left: int) -> Column:
        return found if left == 0 else once(F.flatten(F.transform(front, lambda e: _below(e, nodes))), lambda below: values(F.concat(found, below), below, left - 1))

    root = F.array(_met(F.lit(""), F.lit(""), F.col("v")))
    met = once(root, lambda front: values(front, front, levels))
    kind = lambda e: F.when(e["fields"].isNotNull(), "object").when(e["items"].isNotNull(), "array").otherwise(_scalar_kind(e["v"]))
    number = lambda e, kind: F.when(kind.isin("integer", "number"), F.try_variant_get(e["v"], "$", "double"))
    held = lambda e: once(kind(e), lambda k: once(number(e, k), lambda n: F.flatten(F.transform(F.element_at(nodes, e["path"]), lambda s: _breaches(e, s, k, n)))))
    found = F.flatten(F.transform(met, held))
    broken = F.array(F.struct(F.lit("<root>").alias("path"), F.lit("not_json").alias("rule"), F.col("value").alias("detail")))
    known = sound.select("tool", "nodes")
    rows = given.join(F.broadcast(known) if size <= SENT else known, "tool").select("tool", "example", "value", "nodes", F.try_parse_json("value").alias("v"))
    return rows.select("tool", "example", F.inline(F.when(F.col("v").isNull(), broken).otherwise(found)))


def valid_examples(tools: DataFrame, examples: DataFrame) -> DataFrame:
    """The rows of `examples` without a breach."""
    return examples.join(example_breaches(tools, examples).select("tool", "example").distinct(), ["tool", "example"], "left_anti")
