"""Toxicity by class-conditional Kneser-Ney models.

Tokens are lower-cased runs of letters, digits and non-ASCII characters. A token is a chain of pieces: its first 5
bytes, then up to byte 7, up to byte 9, and the rest; a piece's context is the beginning of the token before it, so
inflected and compounded forms share evidence. For each class c the interpolated Kneser-Ney probability is

    P_c(piece | context) = (n_c - D(n_c) + r_c(context) * P(piece)) / n_c(context)

with r_c the sum of what was discounted. P(piece), shared by both classes, comes from continuation counts: in how many
contexts the piece occurs in either class. Discounts are Kneser-Ney's from the counts of counts; counts up to a cutoff
go to the backoff whole, as in pruned models, so that an expression rare in a class tells no more than the shared
counts do. Toxic texts are ordinary ones with some toxic expressions: their model gives a token the probability
(1 - EPSILON) * P_ordinary + EPSILON * P_toxic. The two log-likelihoods are divided by the number of tokens; the
score is a rising logistic function of their difference, fitted on labelled rows that were not counted.

Training: about `SAMPLE_TOXIC` and `SAMPLE_PLAIN` labelled documents, chosen by a hash of their id. Nodes at or below
the cutoff have the value of unseen ones and are not kept. Up to `MAX_NODES` nodes are broadcast; where the sampled texts are so
long that more are left, all of them are written to the shared folder as sorted arrays, in shards of about that many,
which the workers map into memory: the same values, by another way. Cutoff, share of expressions and bounds of pieces were
chosen on rows of remainders 1 to 4 only, each held out in turn (tests/llm/choose_toxicity.py).
Rows whose crc32(doc_id) mod 5 is 0 are never used; of the others, remainder 4 calibrates and the rest are counted. All
else covers every document in one scan without a shuffle.

Defined results: a null or empty text gets the score of a difference of 0. Rows of one id are scored by their own
text, and each counts if its id is sampled. A null id counts as empty text in the checksum (remainder 0, held out).
Labels that repeat for an id count as toxic if any does; null labels are ignored. With labels of one class only, or
none, every score is that class's label, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import files
from weftline.llm.staging import fresh_path, stage
from weftline.llm.words import IS_TOKEN, hash_prefixes, hash_words, mix, split_words, text_buffers
from weftline.session import ship

SAMPLE_TOXIC, SAMPLE_PLAIN = 1500, 6000
#: Counts up to this one tell nothing by themselves; nodes of a broadcast model at most (16 bytes each).
CUTOFF, MAX_NODES = 2, 2_000_000
#: The part of a toxic text's tokens that are toxic expressions.
EPSILON = 0.02
_CUTS = (5, 7, 9)
_HIGHEST = 50.0


def remainder(doc_id: Column, by: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(by))


def _tokens(column: pa.Array, pieces: bool = False) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """Of some texts: the hashes of all tokens' beginnings, level by level, and of their pieces; each text's tokens."""
    for at in range(0, len(column), 256):
        raw, offsets = text_buffers(column[at : at + 256])
        starts, lengths, counts = split_words(raw, offsets, IS_TOKEN)
        whole, *cut = hash_prefixes(raw, starts, lengths, _CUTS, lower=True)
        # A hash stands for a beginning at its level: the same bytes at another level, or ended, are another node.
        chain = [mix(h + np.uint64(level + 1)) for level, h in enumerate([*cut, whole])]
        own = []
        if pieces:
            for low, high in zip((0, *_CUTS), (*_CUTS, None), strict=True):
                size = np.maximum(lengths - low, 0)
                own.append(hash_words(raw, np.minimum(starts + low, len(raw)), np.minimum(size, high - low) if high else size, lower=True))
        yield chain, own, counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        at = 0
        for chain, pieces, counts in _tokens(batch.column(0), pieces=True):
            label = np.repeat(toxic[at : at + len(counts)], counts)
            at += len(counts)
            _, first, inverse = np.unique(chain[-1], return_index=True, return_inverse=True)
            times = [np.bincount(inverse, label == c, len(first)).astype(np.int64) for c in (1, 0)]
            parent = np.zeros(len(first), np.uint64)
            for level, (h, piece) in enumerate(zip(chain, pieces, strict=True)):
                own = h[first]
                columns = [np.full(len(own), level, np.int32), parent.view(np.int64), own.view(np.int64), piece[first].view(np.int64), *times]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["level", "parent", "node", "piece", "toxic", "plain"])
                parent = own


def sample_labels(labels: DataFrame, sizes: tuple[int, int] = (SAMPLE_PLAIN, SAMPLE_TOXIC)) -> tuple[DataFrame, dict[int, float]]:
    """Rows (doc_id, toxic, calibrates) of about `sizes` labelled ids per class, and each class's sampled share."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("rest", remainder(F.col("doc_id"))).where("rest <> 0 AND toxic IN (0, 1)")
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {c: min(1.0, sizes[c] / n) for c, n in totals.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.lit(False)
    for c, part in share.items():
        wanted = wanted | ((F.col("toxic") == c) & (place < part))
    return known.where(wanted).select("doc_id", "toxic", (F.col("rest") == 4).alias("calibrates")), share


def _discounts(counts: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney's discounts of counts of 0, 1, 2, and 3 or more, from how often 1 to 4 occur."""
    n = [max(1, counts.get(k, 0)) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0, *(min(k - 0.05, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))]


def _counts_of(values: DataFrame) -> dict[int, int]:
    return {r["n"]: r["count"] for r in values.where("n BETWEEN 1 AND 4").groupBy("n").count().collect()}


class Ratios:
    """Log-likelihood ratios by hash, in one sorted array or in sorted shards of the shared folder."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None, folder: str = "", shards: int = 0):
        self.folder, self.shards, self.keys, self.values = folder, shards, keys, values

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are there, and the ratios of those."""
        if not self.shards:
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            there = self.keys[place] == wanted
            return there, self.values[place[there]]
        there, value = np.zeros(len(wanted), bool), np.zeros(len(wanted))
        shard = (wanted >> np.uint64(33)) % np.uint64(self.shards)
        for n in np.unique(shard).tolist():
            own = np.flatnonzero(shard == n)
            keys = files.load(self.folder, f"keys-{n}")
            place = np.minimum(np.searchsorted(keys, wanted[own]), len(keys) - 1)
            found = keys[place] == wanted[own]
            there[own[found]] = True
            value[own[found]] = files.load(self.folder, f"values-{n}")[place[found]]
        return there, value[there]


def _stored(rows: DataFrame, name: str) -> Ratios:
    """`Ratios` of rows (key, llr), at least one."""
    n = rows.count()
    if n <= MAX_NODES:
        held = rows.toPandas()
        keys = held["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return Ratios(keys[order], held["llr"].to_numpy(np.float64)[order])
    # One more than is asked for, and an array for each, whatever its keys: the last key is beyond all hashes that are looked up.
    shards, folder = -(-n // MAX_NODES), fresh_path(rows.sparkSession, name)
    end = np.array([np.iinfo(np.uint64).max])

    def write(key, table):
        keys = table["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        files.save(folder, f"keys-{key[0].as_py()}", np.append(keys[order], end))
        files.save(folder, f"values-{key[0].as_py()}", np.append(table["llr"].to_numpy()[order], 0.0))
        return pa.table({"n": pa.array([table.num_rows])})

    every = rows.sparkSession.range(shards).select(F.col("id").alias("shard"), F.lit(-1).cast("long").alias("key"), F.lit(0.0).alias("llr"))
    dealt = rows.select(F.pmod(F.shiftrightunsigned("key", 33), F.lit(shards)).cast("long").alias("shard"), "key", "llr").unionAll(every)
    dealt.groupBy("shard").applyInArrow(write, "n long").agg(F.sum("n")).first()
    return Ratios(folder=folder, shards=shards)


def train(sample: DataFrame) -> dict[str, Ratios] | None:
    """Log-likelihood ratios from rows (text, toxic): of each node, and of its unseen children."""
    nodes = sample.mapInArrow(_count, "level int, parent long, node long, piece long, toxic long, plain long")
    nodes = stage(nodes.groupBy("level", "parent", "node", "piece").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")), "nodes")
    most = _discounts(_counts_of(nodes.select(F.explode(F.array("toxic", "plain")).alias("n"))))[3]
    pieces = stage(nodes.groupBy("level", "piece").agg(F.count("*").alias("n")), "pieces")
    shared = _discounts(_counts_of(pieces.select("n")))
    taken = F.element_at(F.array(*map(F.lit, shared)), F.least("n", F.lit(3)).cast("int") + 1)
    levels = pieces.groupBy("level").agg(F.sum("n").alias("all"), (F.sum(taken) / (F.count("*") + 1)).alias("spread"))
    pieces = pieces.join(F.broadcast(levels), "level").select("level", "piece", ((F.col("n") - taken + F.col("spread")) / F.col("all")).alias("low"))

    cut = lambda c: F.when(F.col(c) <= CUTOFF, F.col(c)).otherwise(most)
    sums = [f(c) for c in ("toxic", "plain") for f in (lambda c: F.sum(c).alias(f"{c}_n"), lambda c: F.sum(cut(c)).alias(f"{c}_r"))]
    parents = nodes.groupBy("level", "parent").agg(*sums, F.max(F.greatest("toxic", "plain")).alias("most"))
    kept = parents.where(F.col("most") > CUTOFF)
    spare = lambda c: F.coalesce(F.try_divide(f"{c}_r", f"{c}_n"), F.lit(1.0))
    likelihood = lambda c: F.coalesce(F.try_divide(F.col(c) - cut(c), f"{c}_n"), F.lit(0.0)) + spare(c) * F.col("low")
    ratio = F.log(likelihood("toxic")) - F.log(likelihood("plain"))
    seen = nodes.where(F.greatest("toxic", "plain") > CUTOFF).join(kept, ["level", "parent"]).join(pieces, ["level", "piece"])
    seen = stage(seen.select(F.col("node").alias("key"), ratio.alias("llr")), "seen")
    if seen.isEmpty():
        return None
    unseen = kept.select(F.col("parent").alias("key"), (F.log(spare("toxic")) - F.log(spare("plain"))).alias("llr"))
    return {"nodes": _stored(seen, "seen"), "parents": _stored(stage(unseen, "unseen"), "unseen")}


def differences(model: dict[str, Ratios], column: pa.Array) -> np.ndarray:
    """Of each text: how much more likely the toxic model finds it than the ordinary one, in logarithms per token."""
    found = [np.zeros(0)]
    for chain, _, counts in _tokens(column):
        # Each kind of token is looked up once, in order of its hash.
        kinds, first, inverse = np.unique(chain[-1], return_index=True, return_inverse=True)
        value = np.zeros(len(kinds))
        left, parent = np.arange(len(kinds)), np.zeros(len(kinds), np.uint64)
        for h in chain:
            own = h[first[left]]
            there, ratio = model["nodes"].find(own)
            value[left[there]] += ratio
            known, ratio = model["parents"].find(parent[~there])
            value[left[~there][known]] += ratio
            # What follows a node that is not kept is as likely in both models.
            left, parent = left[there], own[there]
        mixed = np.log1p(EPSILON * np.expm1(np.minimum(value, _HIGHEST)))
        total = np.concatenate([[0.0], np.cumsum(mixed[inverse])])
        ends = np.cumsum(counts)
        found.append((total[ends] - total[ends - counts]) / np.maximum(counts, 1))
    return np.concatenate(found)


def calibrate(difference: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Scale, slope (0 at least) and offset of a ridge logistic regression on asinh(difference / scale)."""
    scale = max(float(np.median(np.abs(difference))), 1e-9)
    x = np.stack([np.arcsinh(difference / scale), np.ones(len(difference))], axis=1)
    theta, weight = np.zeros(2), weight / weight.mean()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (x * curve[:, None]) + 0.01 * np.eye(2), x.T @ (weight * (toxic - p)) - 0.01 * theta)
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return scale, max(0.0, float(theta[0])), float(theta[1])


def score(docs: DataFrame, labels: DataFrame, sizes: tuple[int, int] = (SAMPLE_PLAIN, SAMPLE_TOXIC)) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, difference), one for each row of `docs`."""
    spark = docs.sparkSession
    ship(spark)
    chosen, share = sample_labels(labels, sizes)
    # About 7,500 ids.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("long").alias("toxic"), "calibrates")
    sample = stage(sample, "labelled")
    model = train(sample.where("NOT calibrates").select("text", "toxic")) if len(share) == 2 else None
    flat = float(max(share)) if len(share) == 1 else 0.0
    scale, slope, offset, held = 1.0, 0.0, 0.0, None
    if model is not None:
        held = spark.sparkContext.broadcast(model)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(differences(held.value, batch.column(0)))], names=["toxic", "difference"])

        rows = sample.where("calibrates").select("text", "toxic").mapInArrow(measured, "toxic long, difference double").toPandas()
        rows = rows.sort_values(["toxic", "difference"])
        if rows["toxic"].nunique() == 2:
            weight = 1 / rows["toxic"].map(share).to_numpy(float)
            scale, slope, offset = calibrate(rows["difference"].to_numpy(), rows["toxic"].to_numpy(float), weight)
    trained = model is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            difference = differences(held.value, batch.column(2)) if trained else np.zeros(batch.num_rows)
            value = 1 / (1 + np.exp(-np.clip(slope * np.arcsinh(difference / scale) + offset, -30, 30))) if trained else np.full(batch.num_rows, flat)
            predicted = (value >= 0.5).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value), pa.array(predicted), pa.array(difference)], names=["doc_id", "held_out", "score", "predicted", "difference"])

    rows = docs.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, difference double")
