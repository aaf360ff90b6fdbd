"""Exports of whole conversations: rows of the function-call benchmark, nested records, traces.

Each conversation becomes one JSON text, grouped by one hash aggregation of its messages; parts that may be missing
(persona, topic, run, job) come by left joins on their ids, which are unique in their tables. Objects have no blanks
between their fields. Messages have conversation_id, ordinal, role, content, tool_calls and tool_call_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what stands for a function that the catalog does not have.
MISSING = "(tool definition missing from catalog)"


def _ordered(one: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("ordinal", one.alias("m")))), lambda x: x["m"])


def _with_nulls(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def function_bench_rows(conversations: DataFrame, messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows (conversation_id, conversation, functions, language) of the conversations in which an assistant calls a function.

    conversation is `{"messages": [...]}`, without null contents, calls of assistants only and ids of tools' results only; functions is
    `{"functions": [...]}`, the distinct functions called, by name, with their definition (JSON) in `catalog` (name, definition),
    or a stub. Calls without a name are not referenced; a definition that is no JSON is a stub, too. A conversation that is not in
    `conversations` (conversation_id, language) has no row.
    """
    calls = F.when((F.col("role") == "assistant") & (F.size("tool_calls") > 0), F.col("tool_calls"))
    shaped = F.transform(calls, lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
    one = F.struct("role", "content", shaped.alias("tool_calls"), F.when((F.col("role") == "tool") & (F.col("tool_call_id") != ""), F.col("tool_call_id")).alias("tool_call_id"))
    told = messages.withColumn("calls", calls).groupBy("conversation_id").agg(F.to_json(F.struct(_ordered(one).alias("messages"))).alias("conversation"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("calls", lambda c: c["name"]))))).alias("names"), F.count("calls").alias("n"))
    told = told.where("n > 0")
    known = catalog.groupBy("name").agg(F.min(F.when(F.try_parse_json("definition").isNotNull(), F.col("definition"))).alias("definition"))
    named = told.select("conversation_id", F.posexplode("names").alias("place", "name")).where("name IS NOT NULL").join(known, "name", "left")
    stub = F.to_json(F.struct(F.col("name").alias("name"), F.lit(MISSING).alias("description"), F.struct(F.lit("object").alias("type"), F.create_map().cast("map<string,string>").alias("properties")).alias("parameters")))
    listed = named.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("definition", stub).alias("d")))), lambda x: x["d"]), ",").alias("listed"))
    rows = told.join(listed, "conversation_id", "left").join(conversations.select("conversation_id", "language"), "conversation_id")
    functions = F.concat(F.lit('{"functions":['), F.coalesce("listed", F.lit("")), F.lit("]}"))
    return rows.select("conversation_id", "conversation", functions.alias("functions"), "language")


def nested_records(conversations: DataFrame, messages: DataFrame, personas: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows (conversation_id, created_at, record): all columns of `conversations` with persona, topic and messages nested.

    `conversations` has conversation_id, persona_id, topic_id and created_at, `personas` persona_id, `topics` topic_id; a missing
    one is null in the record, as all null fields are; a conversation without messages has an empty list.
    """
    nest = lambda df, key, name: df.select(F.col(key), F.struct(*df.columns).alias(name))
    columns = [c for c in messages.columns if c != "conversation_id"]
    told = messages.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*["ordinal"], *[c for c in columns if c != "ordinal"]))), lambda x: x).alias("messages"))
    rows = conversations.join(nest(personas, "persona_id", "persona"), "persona_id", "left").join(nest(topics, "topic_id", "topic"), "topic_id", "left").join(told, "conversation_id", "left")
    own = [c for c in conversations.columns if c not in ("persona_id", "topic_id")]
    listed = F.coalesce("messages", F.array().cast(told.schema["messages"].dataType))
    return rows.select("conversation_id", "created_at", _with_nulls(F.struct(*own, "persona", "topic", listed.alias("messages"))).alias("record"))


def version_records(links: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (version_id, added_at, conversation_id, record): the records that a frozen version holds; sort by added_at for its export."""
    return links.join(records.select("conversation_id", "record"), "conversation_id").select("version_id", "added_at", "conversation_id", "record")


def write_lines(records: DataFrame, path: str, order: Column) -> None:
    """The records as JSON lines, in order over all files."""
    records.orderBy(order, "conversation_id").select("record").write.text(path)


def traces(conversations: DataFrame, messages: DataFrame, validations: DataFrame, personas: DataFrame, runs: DataFrame, jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Rows (conversation_id, trace): all that is known of a conversation as one JSON text.

    conversation has persona_id and run_id; jobs have conversation_id and job_id, of which the last by job_id counts; events have
    job_id and seq. Messages are in order, validations by validator and verdict, events of the job by seq; what is missing is null or empty.
    """
    listed = lambda df, key, order: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in (key, *order)]))).alias("listed"))
    last = jobs.groupBy("conversation_id").agg(F.max_by(F.struct(*[c for c in jobs.columns if c != "conversation_id"]), "job_id").alias("job"), F.max("job_id").alias("job_id"))
    # Events meet the jobs, not the conversations: those without a job would all come to one task, with all they hold.
    happened = listed(events, "job_id", ["seq"]).withColumnRenamed("listed", "events")
    last = last.where("job_id IS NOT NULL").join(happened, "job_id", "left").select("conversation_id", "job", "events").unionByName(last.where("job_id IS NULL").select("conversation_id", "job"), allowMissingColumns=True)
    rows = conversations.join(personas.select("persona_id", F.struct(*personas.columns).alias("persona")), "persona_id", "left").join(runs.select("run_id", F.struct(*runs.columns).alias("run")), "run_id", "left").join(last, "conversation_id", "left")
    rows = rows.withColumn("events", F.coalesce("events", F.array().cast(happened.schema["events"].dataType)))
    for name, df, order in (("messages", messages, ["ordinal"]), ("validations", validations, ["validator", "verdict"])):
        found = listed(df, "conversation_id", order)
        rows = rows.join(found.withColumnRenamed("listed", name), "conversation_id", "left").withColumn(name, F.coalesce(name, F.array().cast(found.schema["listed"].dataType)))
    own = F.struct(*[c for c in conversations.columns if c not in ("persona_id",)])
    return rows.select("conversation_id", _with_nulls(F.struct(F.lit(1).alias("_schemaVersion"), own.alias("conversation"), "messages", "validations", "persona", "run", "job", "events")).alias("trace"))
