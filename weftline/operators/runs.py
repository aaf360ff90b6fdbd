"""Reads and rewrites of runs, jobs and conversations: guarded filters, pages, lookups, restarts, upserts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def without(rows: DataFrame, column: str, value: object | None) -> DataFrame:
    """All rows where no value is given, else those of another value; rows without one go, as in SQL."""
    return rows if value is None else rows.where(F.col(column) != F.lit(value))


def with_any(rows: DataFrame, related: DataFrame, key: str) -> DataFrame:
    """Rows that have at least one related row."""
    return rows.join(related.select(key), key, "left_semi")


def free_name(taken: DataFrame, wanted: str) -> DataFrame:
    """One row: the wanted name, or with the lowest suffix `-2`, `-3`, ... that no taken name has."""
    known = taken.where(F.startswith("name", F.lit(wanted))).select("name").distinct()
    suffix = F.regexp_extract("name", "^" + "".join(f"\\x{{{ord(c):x}}}" for c in wanted) + r"-(\d+)$", 1).try_cast("long")
    used = known.select(F.when(F.col("name") == wanted, 1).otherwise(suffix).alias("n")).where("n IS NOT NULL")
    # The lowest gap is behind a used number whose successor is free.
    after = used.select((F.col("n") + 1).alias("n")).unionByName(used.sparkSession.range(1, 2).select(F.col("id").alias("n"))).join(used, "n", "left_anti")
    return after.agg(F.min("n").alias("n")).select(F.when(F.col("n") == 1, wanted).otherwise(F.concat(F.lit(wanted + "-"), F.col("n"))).alias("name"))


def sorted_page(rows: DataFrame, allowed: Mapping[str, Column], key: str | None, direction: str | None, tie: str, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page by a whitelisted sort key, nulls last, and one row with its range: total, first, last.

    An unknown key or direction falls back to the first allowed key, descending. A page has 500 rows at most.
    """
    column = allowed.get(key or "", next(iter(allowed.values())))
    order = column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last()
    size = max(0, min(limit, 500))
    page = rows.orderBy(order, F.col(tie).asc()).offset(offset).limit(size)
    total = F.count("*")
    shown = F.least(total, F.lit(offset + size))
    return page, rows.agg(total.alias("total"), F.when(total > offset, offset + 1).otherwise(0).cast("long").alias("first"), F.when(total > offset, shown).otherwise(0).alias("last"))


def active_and_recent(jobs: DataFrame, active: tuple[str, ...], order: str, n: int = 32) -> DataFrame:
    """The n first active jobs, then the n last others, with the branch they come from."""
    is_active = F.col("status").isin(*active)
    first = jobs.where(is_active).orderBy(F.asc(order)).limit(n).withColumn("branch", F.lit("active"))
    return first.unionByName(jobs.where(~is_active).orderBy(F.desc(order)).limit(n).withColumn("branch", F.lit("recent")))


def by_id_or_name(wanted: DataFrame, tools: DataFrame) -> DataFrame:
    """Rows (asked, tool_id, name): a tool whose id is asked for, else one of that name; two equi-joins, no OR."""
    by_id = wanted.join(tools, F.col("asked") == F.col("tool_id")).select("asked", "tool_id", "name", F.lit(0).alias("rank"))
    by_name = wanted.join(tools, F.col("asked") == F.col("name")).select("asked", "tool_id", "name", F.lit(1).alias("rank"))
    best = F.row_number().over(W.partitionBy("asked").orderBy("rank", "tool_id"))
    return by_id.unionByName(by_name).withColumn("place", best).where("place = 1").select("asked", "tool_id", "name")


def label_counts(rows: DataFrame, column: str, missing: str = "(none)") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("label")).agg(F.count("*").alias("n"))


def call_tally(calls: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Per conversation: how often each function is called, sorted by name."""
    counted = calls.groupBy(key, "name").agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias("tally"))


def id_pool(messages: DataFrame, ids: Column) -> DataFrame:
    """Messages in blocks with `pool`: the distinct ids of tool results before each in its block, sorted.

    `messages` has conversation_id, block, ordinal, role and content (see `blocks.with_blocks`); a user message begins a
    block, so the pool starts anew there. No more than a block's ids are held for a row.
    """
    found = F.when(F.col("role") == "tool", ids).otherwise(F.array().cast("array<string>"))
    before = W.partitionBy("conversation_id", "block").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    return messages.withColumn("__ids", found).withColumn("pool", F.array_sort(F.array_distinct(F.flatten(F.collect_list("__ids").over(before))))).drop("__ids")


def prefix_texts(messages: DataFrame) -> DataFrame:
    """Rows (conversation_id, block, prefix): the transcript up to each block's end. `messages` come in blocks.

    A prefix grows with its conversation, so the rows of one conversation take the square of its blocks.
    """
    line = F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.coalesce("content", F.lit("")))
    one = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"])
    blocks = messages.groupBy("conversation_id", "block").agg(F.array_join(one, "\n\n").alias("text"))
    so_far = W.partitionBy("conversation_id").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    return blocks.select("conversation_id", "block", F.array_join(F.collect_list("text").over(so_far), "\n\n").alias("prefix"))


def restart(jobs: DataFrame, job_ids: DataFrame | None = None, zero_attempts: bool = False) -> DataFrame:
    """Jobs with the named ones (or all) queued again: no conversation and error; attempts are kept unless zeroed."""
    named = jobs if job_ids is None else jobs.join(job_ids.select("job_id", F.lit(True).alias("again")).distinct(), "job_id", "left")
    again = F.lit(True) if job_ids is None else F.coalesce("again", F.lit(False))
    changes = {"status": F.when(again, "queued").otherwise(F.col("status")), "conversation_id": F.when(~again, F.col("conversation_id"))}
    if zero_attempts:
        changes["attempts"] = F.when(again, 0).otherwise(F.col("attempts"))
    return named.withColumns(changes).drop("again")


def upsert(rows: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows with changes by key: a null in a change keeps what was there; unknown keys are added.

    Of several changes of a key the last by the column `order` counts, nulls first; without an order they are an error.
    """
    place = W.partitionBy(key)
    if order is None:
        several = F.count("*").over(place) > 1
        told = F.when(several, F.raise_error(F.concat(F.lit("several changes of the key "), F.col(key).cast("string")))).otherwise(F.lit(1))
        changes = changes.withColumn("__one", told.cast("int")).where("__one = 1").drop("__one")
    else:
        last = F.row_number().over(place.orderBy(F.col(order).desc_nulls_last()))
        changes = changes.withColumn("__last", last).where("__last = 1").drop("__last")
    columns = [c for c in rows.columns if c != key]
    joined = rows.alias("r").join(changes.alias("c"), key, "full")
    return joined.select(key, *[F.coalesce(F.col(f"c.{c}"), F.col(f"r.{c}")).alias(c) if c in changes.columns else F.col(f"r.{c}") for c in columns])


def missing_presets(presets: DataFrame, existing: DataFrame) -> DataFrame:
    """Presets whose name is not there yet; adding them twice adds nothing."""
    return presets.join(existing.select("name"), "name", "left_anti")


def turns_under_items(rows: DataFrame, key: str, kind: str = "kind", turn: str = "chat-replay-turn") -> DataFrame:
    """One row per item: its own columns and the array `turns` of its detail rows in order (ordinal, verdict)."""
    items = rows.where(F.col(kind) != turn)
    detail = rows.where(F.col(kind) == turn).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "verdict"))).alias("turns"))
    none = F.array().cast(detail.schema["turns"].dataType)
    return items.join(detail, key, "left").withColumn("turns", F.coalesce("turns", none))


def knowledge_block(sources: DataFrame, group: str, order: str) -> DataFrame:
    """Rows (group, block): numbered Markdown sections of the sources in order."""
    listed = F.array_sort(F.collect_list(F.struct(order, "title", "text")))
    part = lambda x, i: F.concat(F.lit("### ["), (i + 1).cast("string"), F.lit("] "), x["title"], F.lit("\n"), x["text"])
    return sources.groupBy(group).agg(F.array_join(F.transform(listed, part), "\n\n").alias("block"))


def grid_places(rows: DataFrame, order: str, group: str, width: int, height: int) -> DataFrame:
    """Rows with x and y of boxes in ceil(sqrt(n)) columns per group."""
    n = F.count("*").over(W.partitionBy(group))
    place = F.row_number().over(W.partitionBy(group).orderBy(order)) - 1
    columns = F.ceil(F.sqrt(n.cast("double")))
    return rows.withColumns({"x": ((place % columns) * width).cast("long"), "y": (F.floor(place / columns) * height).cast("long")})


# What a language profile leaves open.
PROFILE_DEFAULTS = {"primary": "ms", "script": "latin", "register": "mixed", "allow_particles": True, "loanwords": "allow"}


def validator_context(items: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Items with their profile's settings; what the profile lacks, and all of a missing one, takes the defaults."""
    joined = items.join(profiles, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in profiles.columns else F.lit(v) for c, v in PROFILE_DEFAULTS.items()})


def result_rows(items: DataFrame, turns: DataFrame) -> DataFrame:
    """Benchmark results to append: one conversation row per item and one detail row per turn, in one shape."""
    whole = items.select("run", "item", F.lit("chat-replay").alias("kind"), F.lit(None).cast("long").alias("turn"), "verdict")
    return whole.unionByName(turns.select("run", "item", F.lit("chat-replay-turn").alias("kind"), F.col("turn").cast("long").alias("turn"), "verdict"))


def listed_judges(groups: DataFrame) -> DataFrame:
    """Rows (group_id, place, provider_id, model) from groups (group_id, judges): a JSON list of objects with
    providerCredentialId and model, as JSON or as a JSON string that holds it. Entries that are no object or lack either go."""
    parsed = F.try_parse_json("judges")
    inner = F.coalesce(F.try_parse_json(F.try_variant_get(parsed, "$", "string")), parsed)
    rows = groups.select("group_id", F.posexplode(F.try_variant_get(inner, "$", "array<variant>")).alias("place", "judge"))
    text = lambda path: F.try_variant_get("judge", path, "string")
    entries = rows.select("group_id", "place", text("$.providerCredentialId").alias("provider_id"), text("$.model").alias("model"))
    return entries.where("coalesce(provider_id, '') <> '' AND coalesce(model, '') <> ''")


def run_metadata(runs: DataFrame, benchmarks: DataFrame, providers: DataFrame, groups: DataFrame, rubrics: DataFrame) -> DataFrame:
    """What a benchmark's run needs, one row a run: (run_id, benchmark_id, kind, project_id, candidate, model, group_name, judges,
    consensus_method, rubric_name, axes).

    runs: run_id, benchmark_id, provider_id, model, group_id, judge_provider_id, judge_model, consensus_method, rubric_id; benchmarks:
    benchmark_id, kind, project_id; providers: provider_id, name; groups: group_id, name, judges (JSON); rubrics: rubric_id, name, axes
    (JSON). Ids of providers are strings. A run without its benchmark or provider has no row. judges are (provider_id, name, model), those of the
    group in its order whose provider exists, repeats included; where none is left the run's own judge, if its provider exists; else empty. No or an empty
    consensus method is median; a rubric without a list of axes has none. Ids are unique in their tables.
    """
    named = providers.select("provider_id", F.col("name").alias("provider_name"))
    judge = lambda model: F.struct("provider_id", F.col("provider_name").alias("name"), F.col(model).alias("model"))
    hydrated = listed_judges(groups).join(named, "provider_id").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("place", judge("model").alias("j")))).alias("listed"))
    listed = groups.select("group_id", F.col("name").alias("group_name")).join(hydrated, "group_id", "left")
    own = named.withColumnsRenamed({"provider_id": "judge_provider_id", "provider_name": "judge_name"})
    parsed = F.try_parse_json("axes")
    axes = F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.try_variant_get(F.try_parse_json(F.try_variant_get(parsed, "$", "string")), "$", "array<variant>"), F.array().cast("array<variant>"))
    scales = rubrics.select("rubric_id", F.col("name").alias("rubric_name"), F.transform(axes, lambda a: F.struct(F.coalesce(F.try_variant_get(a, "$.key", "string"), F.lit("axis")).alias("key"), F.greatest(F.lit(1), F.coalesce(F.try_variant_get(a, "$.scale", "int"), F.lit(5))).alias("scale"))).alias("axes"))
    rows = runs.join(benchmarks.select("benchmark_id", "kind", "project_id"), "benchmark_id").join(named.withColumnRenamed("provider_name", "candidate"), "provider_id")
    rows = rows.join(listed, "group_id", "left").join(own, "judge_provider_id", "left").join(scales, "rubric_id", "left")
    single = F.array(F.struct(F.col("judge_provider_id").alias("provider_id"), F.col("judge_name").alias("name"), F.col("judge_model").alias("model")))
    none = F.array().cast("array<struct<provider_id:string,name:string,model:string>>")
    judges = F.when(F.col("listed").isNotNull(), F.transform("listed", lambda x: x["j"])).when(F.col("judge_name").isNotNull(), single).otherwise(none)
    return rows.select(
        "run_id", "benchmark_id", "kind", "project_id", "candidate", "model", "group_name", judges.alias("judges"),
        F.when(F.coalesce("consensus_method", F.lit("")) == "", "median").otherwise(F.col("consensus_method")).alias("consensus_method"), "rubric_name",
        F.coalesce("axes", F.array().cast(scales.schema["axes"].dataType)).alias("axes"),
    )
