"""Mixing sources to target weights, by subset-sum budget fitting.

Sources get shares of a token budget by weight; no target exceeds `cap` times its source's size, and what is cut off is
reshared by weight among the others (the water level is found with running sums over one row per source). A source
whose target is at least its size is taken whole as often as that fits; the rest of the target is fitted exactly:
documents are counted by exact length, each length gives its proportional part, and a bounded-knapsack program over
what is left of each length fills the remaining budget. From each length, the documents with the smallest seeded hash
are taken.

Only counts by (source, length) and by (source, length, hash range) leave the documents; a crowded length is cut into
hash ranges of about `RANGE_ROWS` rows, so no task ranks more than such a range.

Defined results: a null text has size 0; sizes of 0 are never taken; a null source is a source of its own, last in
order; documents of equal hash go by id, then by the kept columns, so rows that still tie are alike and the mix does not
depend on the table's layout. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.staging import stage
from weftline.llm.text import packed, unpacked, whole, word_count
from weftline.session import ship

RANGE_ROWS = 20_000
#: Tokens that the knapsack program fills, about (or 4 of the longest documents), and the most steps it counts in; beyond, a step is several tokens.
RESERVE, MOST = 32_768, 1 << 23


def knapsack(sizes: np.ndarray, spare: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size (at most `spare`) come nearest to `budget`, of equally near sums the smaller."""
    taken = np.zeros(len(sizes), np.int64)
    # Beyond twice the budget, taking nothing is nearer; beyond one largest item, some item can be left out.
    top = min(2 * budget, budget + int(sizes.max(initial=0)))
    reached, via = np.zeros(top + 1, bool), np.full(top + 1, -1, np.int32)
    reached[0] = True
    items: list[tuple[int, int, int]] = []
    for i in np.argsort(sizes, kind="stable"):
        left, part = min(int(spare[i]), top // int(sizes[i])), 1
        while left > 0 and not reached[budget]:
            part = min(part, left)
            weight = part * int(sizes[i])
            fresh = np.flatnonzero(reached[: top + 1 - weight] & ~reached[weight:]) + weight
            via[fresh] = len(items)
            reached[fresh] = True
            items.append((i, part, weight))
            left, part = left - part, part * 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, part, weight = items[via[at]]
        taken[i] += part
        at -= weight
    return taken


def nearest_counts(sizes: np.ndarray, spare: np.ndarray, budget: int) -> np.ndarray:
    """`knapsack` for any budget: a large one is filled in steps of several tokens, and what that leaves, again."""
    step = -(-min(2 * budget, budget + int(sizes.max(initial=0))) // MOST)
    if step <= 1:
        return knapsack(sizes, spare, budget)
    taken = knapsack(np.maximum(1, np.rint(sizes / step).astype(np.int64)), spare, round(budget / step))
    left = budget - int((taken * sizes).sum())
    fits = np.flatnonzero((sizes < 2 * left) & (taken < spare))
    if left > 0 and taken.any() and len(fits):
        taken[fits] += nearest_counts(sizes[fits], (spare - taken)[fits], left)
    return taken


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take for a sum near `budget`; sizes are distinct and positive."""
    if budget <= 0:
        return np.zeros(len(sizes), np.int64)
    if budget >= int((sizes * counts).sum()):
        return counts.copy()
    order = np.argsort(-sizes, kind="stable")
    size, count = sizes[order], counts[order]
    reserve = min(budget, max(RESERVE, 4 * int(size[0])))
    ideal = np.cumsum(size * count) * ((budget - reserve) / max(1, int((size * count).sum())))
    taken, used = np.zeros(len(size), np.int64), 0
    for i in range(len(size)):
        taken[i] = max(0, min(int(count[i]), int((ideal[i] - used) // size[i])))
        used += int(taken[i] * size[i])
    for i in range(len(size)):
        more = min(int(count[i] - taken[i]), max(0, budget - used - reserve) // int(size[i]))
        taken[i] += more
        used += int(more * size[i])
    left = budget - used
    fits = np.flatnonzero((size < 2 * left) & (taken < count))
    if left > 0 and len(fits):
        taken[fits] += nearest_counts(size[fits], (count - taken)[fits], left)
    out = np.empty(len(size), np.int64)
    out[order] = taken
    return out


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Rows (source, source_size, weight, target) from rows (source, size); one row per source in one window."""
    source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    source = source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    source = source.withColumns({"most": cap * F.col("source_size"), "budget": share * F.sum("source_size").over(W.partitionBy())})
    by_level = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    source = source.withColumn("full", F.col("most") * weight_left <= F.col("weight") * (F.col("budget") - before))
    full = lambda c, yes: F.coalesce(F.sum(F.when(F.col("full") == yes, F.col(c))).over(W.partitionBy()), F.lit(0.0))
    level = F.try_divide(F.col("budget") - full("most", True), full("weight", False))
    return source.select("source", "source_size", "weight", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level).alias("target"))


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    size, n = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    budget = math.floor(target + 0.5)
    rounds = budget // total if total else 0
    picked = np.zeros(len(size), np.int64)
    some = size > 0
    picked[some] = fit_counts(size[some], n[some], budget - rounds * total)
    return group.assign(rounds=rounds, picked=picked)[["source", "size", "source_size", "target", "rounds", "picked"]]


#: Names of `mix`'s own columns.
OWN = {"doc_id", "source", "size", "source_size", "target", "copies", "order", "range", "n", "rounds", "first", "picked", "before"}


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    *,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (doc_id, *keep, source, size, source_size, target, copies), one for each row of `docs`.

    `weights` repeat over the sources in code-point order; targets add up to `share` times all sizes. `copies` says
    how often the mix takes the document. Kept columns may have any names; one with the name of a result is left out.
    """
    if set(keep) & OWN:
        options = {"weights": weights, "share": share, "cap": cap, "seed": seed}
        return unpacked(mix(packed(docs, keep), keep=("__kept",), **options), keep)
    ship(docs.sparkSession)
    sized = docs.select("doc_id", *keep, "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("order"))
    sized = stage(sized, "sizes")
    bits = max(0, math.ceil(math.log2(max(1, sized.count()) / RANGE_ROWS)))
    unsigned = F.col("order").bitwiseXOR(F.lit(-(1 << 63)))
    sized = sized.withColumn("range", F.shiftrightunsigned("order", 64 - bits) if bits else F.lit(0).cast("long"))

    ranges = sized.groupBy("source", "size", "range").agg(F.count("*").alias("n"))
    lengths = ranges.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = targets(lengths.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, cap)
    known = lengths.alias("l").join(totals.alias("t"), F.expr("l.source <=> t.source")).select("l.*", "source_size", "target")
    schema = "source string, size long, source_size long, target double, rounds long, picked long"
    plan = known.groupBy("source").applyInPandas(_fit, schema)

    before = F.sum("n").over(W.partitionBy("source", "size").orderBy("range")) - F.col("n")
    ranges = ranges.withColumn("before", before).alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source AND r.size = p.size"))
    ranges = ranges.select("r.source", "r.size", "r.range", "source_size", "target", "rounds", (F.col("picked") - F.col("before")).alias("first"))
    same = F.expr("d.source <=> r.source AND d.size = r.size AND d.range = r.range")
    found = sized.withColumn("order", unsigned).alias("d").join(ranges.alias("r"), same).select("d.*", "source_size", "target", "rounds", "first")
    # Rows that tie even by the kept columns are alike in all that is returned.
    rank = F.row_number().over(W.partitionBy("source", "size", "range").orderBy("order", "doc_id", *keep))
    copies = F.when(F.col("size") > 0, F.col("rounds") + F.when(rank <= F.col("first"), 1).otherwise(0)).otherwise(0)
    return found.select("doc_id", *keep, "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it takes it."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keys = {"__row": F.xxhash64(*columns), "__twin": F.xxhash64(F.lit(1), *columns)}
    keyed = docs.select(whole(docs).alias("doc"), *[c.alias(k) for k, c in keys.items()])
    sized = docs.select("doc_id", "text", "source", *[c.alias(k) for k, c in keys.items()])
    taken = mix(sized, keep=tuple(keys), **options).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("times"))
    found = keyed.join(taken.where("copies > 0"), list(keys))
    once, repeated = found.where("times = 1"), found.where("times > 1").dropDuplicates(list(keys))
    rows = once.unionByName(repeated).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc.*")
