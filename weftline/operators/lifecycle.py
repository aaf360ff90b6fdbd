"""State changes as the set of rows that result; counters are always derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def restart(conversations: DataFrame, jobs: DataFrame, runs: DataFrame, status: str = "pending") -> tuple[DataFrame, DataFrame]:
    """Without the runs' conversations; their jobs begin again."""
    kept = conversations.join(runs.select("run_id"), "run_id", "left_anti")
    hit = jobs.join(F.broadcast(runs.select("run_id", F.lit(True).alias("hit"))) if runs.isLocal() else runs.select("run_id", F.lit(True).alias("hit")), "run_id", "left")
    return kept, hit.withColumn("status", F.when(F.col("hit"), status).otherwise(F.col("status"))).drop("hit")


def cancelled(status: Column) -> Column:
    """pending is skipped; queued and running are cancelled; all else stays."""
    return F.when(status == "pending", "skipped").when(status.isin("queued", "running"), "cancelled").otherwise(status)


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return items.join(done.select(key), key, "left_anti")


def run_counters(jobs: DataFrame) -> DataFrame:
    """Per run: jobs, produced, failed, tokens, and whether it is complete."""
    open_jobs = F.count_if(F.col("status").isin("pending", "queued", "running"))
    return jobs.groupBy("run_id").agg(
        F.count("*").alias("jobs"), F.count_if(F.col("status") == "succeeded").alias("produced"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("tokens").alias("tokens"), (open_jobs == 0).alias("complete"),
    )


def deletable(ids: DataFrame, conversations: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rows (conversation_id, outcome): deleted, missing or frozen."""
    there = ids.join(conversations.select("conversation_id", F.lit(True).alias("there")), "conversation_id", "left")
    there = there.join(frozen.select("conversation_id", F.lit(True).alias("held")).distinct(), "conversation_id", "left")
    return there.select("conversation_id", F.when(F.col("there").isNull(), "missing").when(F.col("held"), "frozen").otherwise("deleted").alias("outcome"))


def replicated(runs: DataFrame) -> DataFrame:
    """The jobs of runs made anew from their frozen grids: rows (run_id, place, persona, topic, difficulty).

    `runs` has run_id and config, a JSON object with the lists personaIds, taxonomyNodeIds and difficulties and samplesPerCell; each cell of the three
    lists gives so many jobs (one, if it is no positive number), numbered in the lists' order. An empty or missing list is one null. The grid is
    expanded within its row; a config that is no object gives one job.
    """
    v = F.try_parse_json("config")
    one = F.array(F.lit(None).cast("string"))

    def items(path):
        found = F.transform(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")), lambda x: F.try_variant_get(x, "$", "string"))
        return F.when(F.size(found) > 0, found).otherwise(one)

    times = F.greatest(F.lit(1), F.coalesce(F.try_variant_get(v, "$.samplesPerCell", "int"), F.lit(1)))
    lists = runs.select("run_id", items("$.personaIds").alias("p"), items("$.taxonomyNodeIds").alias("t"), items("$.difficulties").alias("d"), times.alias("n"))
    cells = lists.select("run_id", F.size("t").alias("nt"), F.size("d").alias("nd"), "n", F.posexplode("p").alias("i", "persona"), "t", "d")
    cells = cells.select("run_id", "nt", "nd", "n", "i", "persona", F.posexplode("t").alias("j", "topic"), "d")
    cells = cells.select("run_id", "nt", "nd", "n", "i", "persona", "j", "topic", F.posexplode("d").alias("k", "difficulty"))
    place = ((F.col("i").cast("long") * F.col("nt") + F.col("j")) * F.col("nd") + F.col("k")) * F.col("n") + F.col("again") - 1
    return cells.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n")))).select("run_id", place.alias("place"), "persona", "topic", "difficulty")
