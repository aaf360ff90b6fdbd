"""Frozen datasets and their exports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def freeze_stats(conversations: DataFrame, *facets: str) -> DataFrame:
    """Rows (facet, value, n): all, and by each facet with null as unknown, from one pass of grouping sets."""
    known = conversations.select(*[F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias(f) for f in facets])
    counted = known.groupingSets([[f] for f in facets] + [[]], *facets).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    all_bits = (1 << len(facets)) - 1
    facet, value = F.when(F.col("g") == all_bits, "total"), F.when(F.col("g") == all_bits, "all")
    for i, f in enumerate(facets):
        own = F.col("g") == all_bits - (1 << (len(facets) - 1 - i))
        facet, value = facet.when(own, f), value.when(own, F.col(f))
    return counted.select(facet.alias("facet"), value.alias("value"), "n")


def next_version(versions: DataFrame) -> DataFrame:
    """One row: the highest x.y.z with its last number raised; 0.1.0 where there is none."""
    parts = F.transform(F.split("version", r"\."), lambda x: x.try_cast("int"))
    valid = versions.where(F.col("version").rlike(r"^\d+\.\d+\.\d+$"))
    top = valid.agg(F.max(parts).alias("top"))
    raised = F.concat_ws(".", F.col("top")[0].cast("string"), F.col("top")[1].cast("string"), (F.col("top")[2] + 1).cast("string"))
    return top.select(F.when(F.col("top").isNull(), "0.1.0").otherwise(raised).alias("version"))


def split_frozen(ids: DataFrame, frozen: DataFrame, key: str = "conversation_id") -> tuple[DataFrame, DataFrame]:
    """Ids that may be deleted, and those that a frozen version holds."""
    return ids.join(frozen, key, "left_anti"), ids.join(frozen, key, "left_semi")


def json_message(role: Column, content: Column) -> Column:
    """One message as JSON with blanks after separators; null content is left out."""
    string = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.concat(F.lit('{"role": '), string(role), F.when(content.isNull(), "").otherwise(F.concat(F.lit(', "content": '), string(content))), F.lit("}"))


def chat_lines(messages: DataFrame) -> DataFrame:
    """Rows (conversation_id, line): one JSON object per conversation with its messages in order.

    Conversations are grouped once; each line is as long as its conversation. Empty conversations have no row.
    """
    one = F.struct("ordinal", json_message(F.col("role"), F.col("content")).alias("json"))
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["json"])
    return messages.groupBy("conversation_id").agg(F.concat(F.lit('{"messages": ['), F.array_join(ordered, ", "), F.lit("]}")).alias("line"))


def write_chat_lines(messages: DataFrame, path: str, order: str = "conversation_id") -> DataFrame:
    """Writes `chat_lines` as text in order and returns one row (rows, bytes, checksum over all lines' checksums), summed from what was written."""
    chat_lines(messages).orderBy(order).select("line").write.text(path)
    lines = messages.sparkSession.read.text(path).withColumnRenamed("value", "line")
    summed = lines.select(F.octet_length("line").alias("size"), F.conv(F.substring(F.sha2("line", 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("sum"))
    return summed.agg(F.count("*").alias("rows"), F.sum(F.col("size") + 1).alias("bytes"), F.sum("sum").alias("checksum"))


def records(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with their messages nested, as one JSON string each."""
    nested = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "role", "content"))).alias("messages"))
    rows = conversations.join(nested, "conversation_id", "left")
    return rows.select("conversation_id", F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("record"))


def used_functions(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per conversation: the sorted distinct functions it calls, with a stub for those the catalog lacks."""
    used = calls.select("conversation_id", "name").distinct().join(catalog.select("name", "definition"), "name", "left")
    stub = F.concat(F.lit('{"name": "'), F.col("name"), F.lit('"}'))
    return used.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("name", F.coalesce("definition", stub).alias("definition")))).alias("functions"))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9._-]+", "-")


def upload_batches(rows: DataFrame, order: str, size: int = 100, part_rows: int = 1_000_000) -> DataFrame:
    """Numbers rows in order and puts them into batches; nulls first.

    Rows are cut into about `part_rows` by fixed bounds (a sample's, 1,023 at most), so that counting and numbering agree
    however Spark deals them out; each part is ranked by itself behind the number of rows before it. Rows of an equal key
    stay in one part and are numbered in any order.
    """
    n = rows.count()
    parts = min(1024, math.ceil(n / part_rows))
    key, bounds = F.col(order), []
    if parts > 1:
        # About 64 keys for each part, chosen by hash.
        known = rows.where(key.isNotNull()).select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(max(1, n // (64 * parts)))) == 0)
        sampled = known.agg(F.array_sort(F.collect_set("k"))).first()[0]
        bounds = [sampled[len(sampled) * i // parts] for i in range(1, parts)] if len(sampled) >= parts else sampled
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= key)), F.lit(0)) if bounds else F.lit(0)
    marked = rows.withColumn("__part", F.when(key.isNull(), 0).otherwise(part))
    before = marked.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(W.orderBy("__part")) - F.col("__n"))
    place = F.row_number().over(W.partitionBy("__part").orderBy(key.asc_nulls_first())) - 1 + F.col("__before")
    # One row for each part.
    placed = marked.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn("place", place.cast("long"))
    return placed.withColumn("batch", F.floor(F.col("place") / size)).drop("__part", "__before")


def import_plan(incoming: DataFrame, existing: DataFrame, overwrite: bool) -> DataFrame:
    """Per incoming name: failed (no identifier), skipped or updated (exists), or created; repeats are not told apart."""
    from weftline.functions.text import is_identifier

    there = incoming.join(existing.select("name", F.lit(True).alias("there")).distinct(), "name", "left")
    action = F.when(~is_identifier(F.col("name")), "failed").when(F.col("there"), "updated" if overwrite else "skipped").otherwise("created")
    return there.select("name", action.alias("action"))
