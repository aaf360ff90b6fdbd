"""Event streams of runs: parsing, live metrics, bounded buffers, tool-call assembly.

The functions take batch or streaming DataFrames alike wherever Spark allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions.judge import tolerant_json
from weftline.session import ship

EVENT = "key string, seq long, event string, payload string"


def read_events(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """JSON lines that arrive in a folder, as a stream; lines without a key or event are dropped."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(folder)
    return well_formed(rows)


def well_formed(rows: DataFrame) -> DataFrame:
    return rows.where("key IS NOT NULL AND event IS NOT NULL").withColumn("data", F.to_json(tolerant_json(F.col("payload"))))


def live_metrics(events: DataFrame) -> DataFrame:
    """Per key: items done and failed, tokens, and whether the run ended; the same in update mode and in batch."""
    tokens = F.coalesce(F.get_json_object("data", "$.tokens").try_cast("long"), F.lit(0))
    return events.groupBy("key").agg(
        F.count_if(F.col("event") == "item.done").alias("completed"), F.count_if(F.col("event") == "item.error").alias("failed"),
        F.sum(tokens).alias("tokens"), F.bool_or(F.col("event").isin("done", "run.done")).alias("ended"),
    )


def tumbling_counts(events: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Counts by event type in windows of event time; rows later than the watermark are dropped by a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def assemble_calls(fragments: DataFrame) -> DataFrame:
    """Rows (key, index, id, name, arguments) from streamed fragments: the last id and name win, arguments append.

    Of fragments with one number, the greatest id, name or argument counts as the last.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias(c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("a")))), lambda x: x["a"]), "")
    return fragments.groupBy("key", "index").agg(last("id"), last("name"), text.alias("arguments"))


def buffered(events: DataFrame, most: int = 10_000, retention: str = "60 seconds") -> DataFrame:
    """A stream's events by key as they pass a buffer of at most `most`; a restart clears it, an end keeps it a while.

    Rows (key, seq, event, kept). State is one counter per key, whatever the buffer holds.
    """
    wait = int(float(retention.split()[0]) * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else 0
        ended = False
        for batch in batches:
            kept = []
            for event in batch.sort_values("seq")["event"]:
                if event == "restart":
                    held, ended = 0, False
                kept.append(held < most)
                held += held < most
                ended = ended or event in ("done", "run.done")
            yield batch.sort_values("seq")[["key", "seq", "event"]].assign(kept=kept)
        state.update((held,))
        if ended:
            state.setTimeoutDuration(wait)

    ship(events.sparkSession)
    schema = "key string, seq long, event string, kept boolean"
    return events.select("key", "seq", "event").groupBy("key").applyInPandasWithState(step, schema, "held long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def replay(results: DataFrame) -> DataFrame:
    """The events of a finished run from its stored rows (row_idx, turn_num, kind), in order."""
    event = F.when(F.col("turn_num").isNull(), "item.done").otherwise("turn.judged")
    return results.select("row_idx", "turn_num", event.alias("event")).orderBy("row_idx", F.asc_nulls_last("turn_num"))
