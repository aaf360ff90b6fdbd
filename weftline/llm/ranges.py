"""Rows in one global order, dealt out by ranges, for groups that no task could hold.

`in_order` sorts rows over all tasks: each gets a range (`chunk`) of the order, whatever groups the rows belong to, so
a group may stand over many chunks and a chunk may hold many groups. Only the groups at a chunk's two ends can go on
in another: what has to be carried from chunk to chunk is at most two rows a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.staging import stage


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df`, written to the shared folder, with `chunk` and `place`, which rises through all chunks.

    The order's columns should be short, as a sample of them goes to the driver; their last may be `tie()`, which lets
    equal rows stand in several chunks. They are dropped if their names begin with `__`.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = [c for c in df.columns if not c.startswith("__")]
    return stage(dealt.select(*kept, F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("place")), name)


def tie() -> Column:
    """A number of its own for each row of a scan, the same when the scan runs again."""
    return F.monotonically_increasing_id()


def carried(placed: DataFrame, key: list[str], **totals: tuple) -> DataFrame:
    """Rows (key, chunk, totals) for the groups that come from an earlier chunk: what their earlier chunks add up to.

    A total is a pair: the aggregate that gives a chunk's part, and the one that adds up parts. At most one row a chunk.
    """
    parts = placed.groupBy(*key, "chunk").agg(*[part.alias(n) for n, (part, _) in totals.items()])
    earlier = W.partitionBy(*key).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    first = F.row_number().over(W.partitionBy(*key).orderBy("chunk"))
    summed = parts.select(*key, "chunk", *[whole(F.col(n)).over(earlier).alias(n) for n, (_, whole) in totals.items()], first.alias("__nth"))
    return summed.where("__nth > 1").drop("__nth")
