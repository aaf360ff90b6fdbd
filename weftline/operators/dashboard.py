"""Dashboard aggregates: each is one hash aggregation with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_groups(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def daily(rows: DataFrame, ts: str, days: int = 14) -> DataFrame:
    """Counts of the last `days` days up to the latest row's, days without rows as 0."""
    day = F.to_date(F.col(ts))
    counted = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    last = rows.agg(F.max(day).alias("last")).where("last IS NOT NULL")
    series = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("day"))
    return series.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def acceptance(rows: DataFrame, status: str, accepted: str) -> DataFrame:
    """Total, accepted, and the rounded percentage; 0 for none."""
    total, good = F.count("*"), F.count_if(F.col(status) == accepted)
    return rows.agg(total.alias("total"), good.alias("accepted"), F.coalesce(F.round(F.try_divide(100 * good, total)), F.lit(0)).cast("long").alias("rate"))


def relation_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with the number of rows in each child table; children are counted before they are joined."""
    for name, child in children.items():
        counted = child.groupBy(key).agg(F.count("*").alias(name))
        parents = parents.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return parents


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """One row: the sorted distinct values, null as unknown."""
    return rows.agg(F.array_sort(F.collect_set(F.coalesce(F.col(column).cast("string"), F.lit("unknown")))).alias("values"))


def histogram(rows: DataFrame, value: Column, digits: int = 1) -> DataFrame:
    return rows.groupBy(F.round(value, digits).alias("bucket")).agg(F.count("*").alias("n"))


def changed_only(snapshots: DataFrame, key: str, order: str, signature: str) -> DataFrame:
    """Rows whose signature differs from the one before of the same key; the first of a key always. Null is a signature like any other."""
    from pyspark.sql import Window as W

    before = F.lag(F.struct(signature)).over(W.partitionBy(key).orderBy(order))
    return snapshots.withColumn("__before", before).where(F.col("__before").isNull() | ~F.col(signature).eqNullSafe(F.col(f"__before.{signature}"))).drop("__before")


def since_latest(events: DataFrame, key: str, ts: str, anchor: Column) -> DataFrame:
    """Events from each key's latest anchor event on; keys without one keep all."""
    from pyspark.sql import Window as W

    start = F.max(F.when(anchor, F.col(ts))).over(W.partitionBy(key))
    return events.withColumn("__start", start).where(F.col("__start").isNull() | (F.col(ts) >= F.col("__start"))).drop("__start")
