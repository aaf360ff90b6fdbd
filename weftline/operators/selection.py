"""Selection: filters from optional parameters, paging, sampling, top shares, stratified picks, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def where_equal(rows: DataFrame, **wanted: object) -> DataFrame:
    """Keeps rows equal in every column that is given; None means any. The filters reach the scan."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in wanted.items() if v is not None), rows)


def where_in(rows: DataFrame, column: str, values: list | None, default: list) -> DataFrame:
    """Keeps listed values; an empty or missing list means the default."""
    return rows.where(F.col(column).isin(values or default))


def scoped(rows: DataFrame, array: str, value: object) -> DataFrame:
    """Keeps rows whose array is empty or holds the value."""
    return rows.where((F.size(array) == 0) | F.array_contains(array, value))


def search(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Keeps rows where any of the columns holds the text in any case."""
    return rows.where(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])).contains(text.lower()))


def page(rows: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page: 50 rows unless asked, 500 at most; Spark takes the top rows of each partition first."""
    return rows.orderBy(*order).offset(offset).limit(min(limit or 50, 500))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest `order` of each key, by a hash aggregation with map-side combine."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("r")).select(key, *[f"r.{c}" for c in columns])


def top_per_key(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts to k per key before the shuffle."""
    return rows.withColumn("__place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("__place") <= k).drop("__place")


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same ones for the same seed, wherever they lie."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def top_share(rows: DataFrame, score: str, order: str, share: float) -> DataFrame:
    """The best `share` of rows, at least one: int(n * share + 0.999) of them, ties by `order`."""
    n = rows.count()
    return rows.orderBy(F.desc(score), order).limit(max(1, int(n * share + 0.999))) if n else rows.limit(0)


def stratified(candidates: DataFrame, share: float, score: str = "score", cell: str = "cell", order: str = "seq", key: str | None = "hash") -> DataFrame:
    """Round robin over cells: everyone's best, in order of the cells' first rows, then everyone's second best.

    The target is ceil(n * share) of all candidates, at least one; then repeated keys keep their first row (rows
    without a key all stay), then ranks are given. Ranks are windows by cell; the final order is a top-k.
    """
    import math

    from weftline.operators.validators import drop_repeats

    n = candidates.count()
    if not n:
        return candidates.limit(0)
    kept = drop_repeats(candidates, key, order) if key else candidates
    by_score = F.row_number().over(W.partitionBy(cell).orderBy(F.desc(score), order))
    ranked = kept.withColumns({"rank_in_cell": by_score, "cell_first": F.min(order).over(W.partitionBy(cell))})
    return ranked.orderBy("rank_in_cell", "cell_first").limit(max(1, math.ceil(n * share))).drop("cell_first")


def grid(topics: DataFrame, personas: DataFrame, copies: int) -> DataFrame:
    """Every topic with every persona, `copies` times: the stated plan of a run, from two small dimension tables."""
    cells = topics.select(F.col("id").alias("topic")).join(F.broadcast(personas.select(F.col("id").alias("persona"))), how="cross")
    cells = cells.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return cells.withColumn("cell_key", F.concat_ws(":", F.col("topic").cast("string"), F.col("persona").cast("string"), F.col("copy").cast("string")))
