"""Lint of tool-calling transcripts and function libraries: every breach is a row (id, rule, detail).

Messages have conversation_id, ordinal, role, content, tool_calls (array of id, name, arguments) and tool_call_id.
Calls and results are matched by hash joins on (conversation_id, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import stored

VOCATIVES = ("Encik", "Puan", "Sir", "Madam")


def _rows(frame: DataFrame, rule: str, detail: Column | None = None) -> DataFrame:
    return frame.select("conversation_id", F.lit(rule).alias("rule"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def tool_calls(messages: DataFrame) -> DataFrame:
    """Rows (conversation_id, ordinal, id, name, arguments), one for each call."""
    return messages.where("role = 'assistant'").select("conversation_id", "ordinal", F.inline("tool_calls"))


def unpaired_results(messages: DataFrame) -> DataFrame:
    """Tool messages whose id no earlier call of the conversation has."""
    first = tool_calls(messages).groupBy("conversation_id", F.col("id").alias("tool_call_id")).agg(F.min("ordinal").alias("called"))
    found = messages.where("role = 'tool'").join(first, ["conversation_id", "tool_call_id"], "left")
    return found.where("called IS NULL OR called >= ordinal")


def lint_transcripts(messages: DataFrame, library: DataFrame, forbidden: tuple[str, ...] = (), turns: tuple[int, int] = (10, 20), functions: int = 8) -> DataFrame:
    """Unknown functions, arguments and contents that are no JSON, unpaired results, forbidden words, a missing
    vocative, too few or many user turns, too few distinct functions. `library` has name."""
    messages = stored(messages, "messages")
    calls = tool_calls(messages)
    spoken = messages.where("role IN ('user', 'assistant')")
    per = messages.groupBy("conversation_id").agg(F.count_if(F.col("role") == "user").alias("n_user"), F.bool_or((F.col("role").isin("user", "assistant")) & F.col("content").rlike(r"\b(" + "|".join(VOCATIVES) + r")\b")).alias("addressed"))
    distinct = calls.groupBy("conversation_id").agg(F.count_distinct("name").alias("n_functions"))
    per = per.join(distinct, "conversation_id", "left").withColumn("n_functions", F.coalesce("n_functions", F.lit(0)))
    low, high = turns
    parts = [
        _rows(calls.join(library.select("name").distinct(), "name", "left_anti"), "unknown_function", F.col("name")),
        _rows(calls.where(F.try_parse_json("arguments").isNull()), "arguments_not_json", F.col("name")),
        _rows(messages.where((F.col("role") == "tool") & F.try_parse_json(F.coalesce("content", F.lit(""))).isNull()), "content_not_json"),
        _rows(unpaired_results(messages), "unpaired_result", F.col("tool_call_id")),
        _rows(per.where(~F.coalesce("addressed", F.lit(False))), "no_vocative"),
        _rows(per.where(~F.col("n_user").between(low, high)), "user_turns", F.col("n_user")),
        _rows(per.where(F.col("n_functions") < functions), "few_functions", F.col("n_functions")),
    ]
    parts += [_rows(spoken.where(F.col("content").rlike("(?i)" + p)).select("conversation_id").distinct(), "forbidden", F.lit(p)) for p in forbidden]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def transcript_metadata(messages: DataFrame) -> DataFrame:
    """Per conversation: user turns, distinct functions in order of first call, most calls at once, API errors."""
    calls = tool_calls(messages)
    first = calls.groupBy("conversation_id", "name").agg(F.min("ordinal").alias("at"))
    used = first.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("functions"))
    body = F.try_parse_json("content")
    status = F.coalesce(F.try_variant_get(body, "$.error.http_status", "int"), F.try_variant_get(body, "$.http_status", "int"), F.try_variant_get(body, "$.status_code", "int"))
    failed = F.schema_of_variant(F.try_variant_get(body, "$.error", "variant")).startswith("OBJECT") | (status >= 400)
    error = (F.col("role") == "tool") & F.coalesce(failed, F.lit(False))
    per = messages.groupBy("conversation_id").agg(
        F.count_if(F.col("role") == "user").alias("user_turns"), F.max(F.coalesce(F.size("tool_calls"), F.lit(0))).alias("max_parallel"), F.count_if(error).alias("api_errors"),
    )
    return per.join(used, "conversation_id", "left")


def harvested_ids(content: Column) -> Column:
    """Distinct strings in JSON text that look like ids: 5 to 80 characters with a hyphen and no blank, no keys."""
    pattern = F.lit(r'"((?:[^"\\]|\\.)*)"(\s*:)?')
    text = F.when(F.try_parse_json(content).isNotNull(), content).otherwise("")
    strings = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("s"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("colon"))
    values = F.transform(F.filter(strings, lambda x: x["colon"] == ""), lambda x: x["s"])
    return F.array_distinct(F.filter(values, lambda x: x.contains("-") & F.length(x).between(5, 80) & ~x.contains(" ")))


def keyed_ids(content: Column) -> Column:
    """(key, value) of the string fields named id, or ending in _id, _ref, _token, _number or _no; each pair once, at its first place."""
    pattern = r'(?i)"(id|(?:[^"\\])*_(?:id|ref|token|number|no))"\s*:\s*"((?:[^"\\]|\\.)+)"'
    text = F.when(F.try_parse_json(content).isNotNull(), content).otherwise("")
    return F.array_distinct(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value")))


def id_propagation(ids: Column, reference: Column, model: Column) -> Column:
    """Of the ids that the reference's arguments use, the share that the model's use; null where it uses none."""
    used = F.filter(ids, lambda x: F.contains(reference, x))
    return F.try_divide(F.size(F.filter(used, lambda x: F.contains(model, x))).cast("double"), F.size(used))


_SCHEMA = "struct<required:array<string>,properties:map<string,struct<type:string>>>"


def required_coverage(arguments: Column, parameters: Column) -> Column:
    """The share of required parameters that JSON arguments name; 1 where none is required."""
    required = F.coalesce(F.from_json(parameters, _SCHEMA)["required"], F.array().cast("array<string>"))
    given = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    share = F.try_divide(F.size(F.filter(required, lambda r: F.array_contains(given, r))).cast("double"), F.size(required))
    return F.coalesce(share, F.lit(1.0))


def type_accuracy(arguments: Column, parameters: Column) -> Column:
    """The share of arguments, of those whose parameter names a type, that have it; booleans count as numbers."""
    wanted = F.coalesce(F.from_json(parameters, _SCHEMA)["properties"], F.create_map().cast("map<string,struct<type:string>>"))
    given = F.map_entries(F.coalesce(F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))

    def kind(v: Column) -> Column:
        name = F.schema_of_variant(v)
        number = name.rlike("^(BIGINT|INT|DECIMAL|DOUBLE|FLOAT)")
        whole = name.rlike("^(BIGINT|INT)") | name.rlike(r"^DECIMAL\(\d+,0\)")
        true = F.lit(True)
        return F.create_map(
            F.lit("string"), name == "STRING", F.lit("number"), number | (name == "BOOLEAN"), F.lit("integer"), whole | (name == "BOOLEAN"),
            F.lit("boolean"), name == "BOOLEAN", F.lit("array"), name.startswith("ARRAY") & true, F.lit("object"), name.startswith("OBJECT"),
        )

    checks = F.filter(F.transform(given, lambda e: F.try_element_at(kind(e["value"]), F.try_element_at(wanted, e["key"])["type"])), F.isnotnull)
    return F.coalesce(F.try_divide(F.size(F.filter(checks, lambda x: x)).cast("double"), F.size(checks)), F.lit(1.0))


def lint_library(functions: DataFrame, originals: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows (library, rule, detail). Functions have library, name, description, stage, returns and parameters (JSON);
    originals have library and name; entities have library and key. 30 to 50 functions, all fields, object parameters,
    unique names, references that exist, originals kept."""
    names = functions.select("library", "name")
    rows = lambda df, rule, detail: df.select("library", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    counted = functions.groupBy("library").agg(F.count("*").alias("n"))
    missing = F.exists(F.array("name", "description", "stage", "parameters", "returns"), lambda x: x.isNull())
    object_type = F.coalesce(F.try_variant_get(F.try_parse_json("parameters"), "$.type", "string"), F.lit("")) == "object"
    refs = functions.select("library", F.explode(F.array_distinct(F.regexp_extract_all("parameters", F.lit(r"#/shared_entities/([A-Za-z0-9_\-]+)"), F.lit(1)))).alias("key")).distinct()
    parts = [
        rows(counted.where("n NOT BETWEEN 30 AND 50"), "function_count", F.col("n")),
        rows(functions.where(missing), "missing_field", F.col("name")),
        rows(functions.where(~object_type), "parameters_type", F.col("name")),
        rows(names.groupBy("library", "name").count().where("count > 1"), "duplicate_name", F.col("name")),
        rows(refs.join(entities.select("library", "key"), ["library", "key"], "left_anti"), "dangling_ref", F.col("key")),
        rows(originals.join(names, ["library", "name"], "left_anti"), "original_lost", F.col("name")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Words that show a profile's language in Latin letters.
MARKERS = {
    "tamil": ("Vanakkam", "Nandri", "Romba", "Aiyo", "Aiyoyo", "Aiyaa", "appadi", "seri"),
    "mandarin": ("Ni hao", "Zao", "Wan an", "Xie xie", "Hao de", "Dui", "Bu hao", "bu xing", "Ai yaa"),
}
SCRIPTS = {"tamil": r"\p{IsTamil}", "mandarin": r"\p{IsHan}"}
#: Least numbers: API errors, off-topic turns, edges between agents, markers by profile.
LEAST = {"api_errors": 3, "off_topic": 2, "agent_edges": 2, "tamil": 3, "mandarin": 2}


def agent_edges(messages: DataFrame) -> DataFrame:
    """Rows (conversation_id, source, target, times): how often one agent's assistant message is followed by another agent's.

    Messages have agent; those of other roles or without an agent do not come between.
    """
    spoken = messages.where("role = 'assistant' AND agent IS NOT NULL")
    before = F.lag("agent").over(W.partitionBy("conversation_id").orderBy("ordinal"))
    steps = spoken.select("conversation_id", before.alias("source"), F.col("agent").alias("target")).where("source <> target")
    return steps.groupBy("conversation_id", "source", "target").agg(F.count("*").alias("times"))


def language_marks(text: Column, profile: str) -> Column:
    """How many of a profile's markers stand in a text, in either case, and runs of letters of its script."""
    markers = [F.when(F.contains(F.lower(text), F.lit(m.lower())), 1).otherwise(0) for m in MARKERS[profile]]
    runs = F.size(F.regexp_extract_all(text, F.lit(SCRIPTS[profile] + "+"), F.lit(0)))
    return sum(markers[1:], markers[0]) + runs


def lint_extra(messages: DataFrame, profiles: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """Rows (conversation_id, rule, found): what each conversation has too little of, beside `lint_transcripts`.

    Messages have agent and off_topic (of user messages); `profiles` has conversation_id and profile. Rules: api_errors, off_topic,
    agent_edges (distinct), and for profiles tamil and mandarin the marks of the language in all user messages together, texts
    in its own script included. Null counts as none; a conversation without messages is not judged.
    """
    least = LEAST | (least or {})
    errors = transcript_metadata(messages).select("conversation_id", "api_errors")
    user = F.col("role") == "user"
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(user, F.struct("ordinal", F.coalesce("content", F.lit("")).alias("c"))))), lambda x: x["c"]), " ")
    per = messages.groupBy("conversation_id").agg(F.count_if(user & F.col("off_topic")).alias("off_topic"), said.alias("said"))
    edges = agent_edges(messages).groupBy("conversation_id").agg(F.count("*").alias("agent_edges"))
    rows = per.join(errors, "conversation_id").join(edges, "conversation_id", "left").join(profiles.select("conversation_id", "profile"), "conversation_id", "left")
    rule = lambda name, found: F.when(found < least[name], F.struct(F.lit(name).alias("rule"), found.cast("long").alias("found")))
    checks = [rule(n, F.coalesce(F.col(n), F.lit(0))) for n in ("api_errors", "off_topic", "agent_edges")]
    checks += [F.when(F.col("profile") == p, rule(p, language_marks(F.col("said"), p))) for p in MARKERS]
    return rows.select("conversation_id", F.inline(F.filter(F.array(*checks), F.isnotnull)))
