"""Nearest neighbours by inner product, over randomly rotated one-bit codes.

Every vector is rotated by one fixed random rotation and kept as a packed sign per dimension with two correction
scalars: its norm, and the cosine f between the rotated vector and its sign vector. A rotated query q is rounded to 4
bits a dimension, kept as 4 packed planes, so that <q, signs> is a sum of popcounts; norm * <q, signs> / (f * sqrt(d))
estimates the inner product, off by more than EPSILON times its standard deviation, which the scalars give, with a
probability of about 2 in 10,000.

Codes alone meet queries in blocks: one task takes a block of queries and a block of candidates. A candidate is looked
at again where its estimate plus error bound reaches the block's k-th best score so far; there, a byte per rotated
dimension and the norm of what the bytes miss give an interval that holds the inner product for certain. Of each query
only what can be among its k nearest by these intervals leaves the block, a little over k rows; the same rule over all
blocks chooses the vectors that are fetched, by two joins on ids, and scored exactly in double precision.

The rotation depends on the dimension and a seed alone, so nothing is trained; every row is indexed. A block of rows
travels once for each `QUERY_BLOCK` queries, at d + d / 8 + 40 bytes a row; vectors travel with what is reranked.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a
null id; vectors meet only vectors of equal length. A repeated id counts once, with its smallest vector. Equal scores
are ordered by id; of equal vectors no more than k + 1 meet the queries, as the ids decide among them. An empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.staging import stage
from weftline.session import ship

QUERY_BLOCK, ROW_BLOCK = 8192, 32_768
EPSILON = 3.5
#: Bits of a rounded query's dimension; room for single precision in the bytes' intervals.
PLANES, SLACK = 4, 1e-5


def rotation(d: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    spare = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, spare))), axis=1).view(np.uint64)


class Codes:
    """Signs, norms, cosines to the signs, bytes with their scale, and the norm of what the bytes miss."""

    def __init__(self, signs, norm, cosine, small, scale, missed):
        self.signs, self.norm, self.cosine, self.small, self.scale, self.missed = signs, norm, cosine, small, scale, missed


def encode(vectors: np.ndarray, turn: np.ndarray) -> Codes:
    turned = vectors @ turn
    norm = np.linalg.norm(vectors, axis=1)
    cosine = np.abs(turned).sum(axis=1) / (norm * math.sqrt(vectors.shape[1]))
    scale = np.abs(turned).max(axis=1) / 127
    small = np.rint(turned / scale[:, None]).astype(np.int8)
    missed = np.linalg.norm(turned - small * scale[:, None], axis=1) + SLACK * norm
    return Codes(pack(turned > 0), norm, cosine, small, scale, missed)


def estimate(turned: np.ndarray, codes: Codes, signs: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one rotated query and all codes (their words one below the other): inner products, and how far they may be off."""
    d = len(turned)
    low, step = turned.min(), max((turned.max() - turned.min()) / ((1 << PLANES) - 1), 1e-300)
    level = np.rint((turned - low) / step).astype(np.uint8)
    planes = pack((level[None, :] >> np.arange(PLANES)[:, None] & 1).astype(bool))
    inner = np.zeros(signs.shape[1], np.int64)
    for number, plane in enumerate(planes):
        for word, row in zip(plane, signs, strict=True):
            inner += np.bitwise_count(row & word).astype(np.int64) << number
    rounded = d * low + step * float(level.sum())
    towards = codes.norm / np.maximum(codes.cosine, 1e-9)
    value = towards / math.sqrt(d) * (2 * (low * ones + step * inner) - rounded)
    spread = np.sqrt(np.maximum(1 - codes.cosine**2, 0) / max(1, d - 1)) * np.linalg.norm(turned) + step / math.sqrt(12)
    return value, EPSILON * towards * spread


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, codes: Codes, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query what can be among its k nearest of the block: query id, ids, and bounds of the inner products."""
    turned = queries @ rotation(queries.shape[1])
    signs = np.ascontiguousarray(codes.signs.T)
    ones = np.bitwise_count(codes.signs).sum(axis=1, dtype=np.int64)
    small = codes.small.astype(np.float32)
    for qid, q in zip(query_ids, turned, strict=True):
        value, off = estimate(q, codes, signs, ones)
        value[ids == qid] = -np.inf
        length, single = np.linalg.norm(q), q.astype(np.float32)

        def bounds(rows, length=length, single=single):
            middle = codes.scale[rows] * (small[rows] @ single).astype(np.float64)
            return middle - codes.missed[rows] * length, middle + codes.missed[rows] * length

        def kth(lower):
            return np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else -np.inf

        n = min(2 * k, len(ids))
        first = np.argpartition(-value, n - 1)[:n]
        reach = kth(bounds(first[ids[first] != qid])[0])
        chosen = np.flatnonzero((value + off >= reach) & (ids != qid))
        lower, upper = bounds(chosen)
        able = upper >= max(reach, kth(lower))
        yield qid, ids[chosen[able]], lower[able], upper[able]


def usable(vector: Column) -> Column:
    """Whether a vector takes part; needs no more than its own components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _inner(a: str, b: str) -> Column:
    """Inner products in double precision, summed in order of dimension."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row where `is_query`, its k nearest of all other rows."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    rows = stage(rows.withColumn("d", F.size("vector")), "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    row_blocks, query_blocks = max(1, math.ceil(n / ROW_BLOCK)), max(1, math.ceil(asked / QUERY_BLOCK))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Codes of every row."""
        for batch in batches:
            for d, part in batch.groupby("d"):
                codes = encode(np.stack(part["vector"].to_numpy()).astype(np.float64), rotation(int(d)))
                packed = {"signs": [x.tobytes() for x in codes.signs], "small": [x.tobytes() for x in codes.small]}
                scalars = {"norm": codes.norm, "cosine": codes.cosine, "scale": codes.scale, "missed": codes.missed}
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "d": part["d"].to_numpy(), **packed, **scalars})

    spread = F.xxhash64("vec_id")
    # Of equal vectors only the k + 1 smallest ids can be among anyone's nearest; map tasks drop the others before the shuffle.
    alike = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    distinct = rows.select("vec_id", "vector", "d", alike.alias("place")).where(F.col("place") <= k + 1)
    candidates = distinct.select("vec_id", "vector", "d").mapInPandas(index, "vec_id long, d int, signs binary, small binary, norm double, cosine double, scale double, missed double")
    candidates = candidates.withColumn("row_block", F.pmod(spread, F.lit(row_blocks))).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = rows.where("asks").select("vec_id", "vector", "d", F.pmod(spread, F.lit(query_blocks)).cast("int").alias("query_block"))
    queries = queries.withColumn("row_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(q) and len(c):
            matrix = lambda name, kind: np.frombuffer(b"".join(c[name]), kind).reshape(len(c), -1)
            codes = Codes(matrix("signs", np.uint64), c["norm"].to_numpy(), c["cosine"].to_numpy(), matrix("small", np.int8), c["scale"].to_numpy(), c["missed"].to_numpy())
            block = search_block(q["vec_id"].to_numpy(), np.stack(q["vector"].to_numpy()).astype(np.float64), c["vec_id"].to_numpy(), codes, k)
            out = [pd.DataFrame({"query_id": qid, "vec_id": ids, "lower": lower, "upper": upper}) for qid, ids, lower, upper in block if len(ids)]
        empty = {"query_id": "int64", "vec_id": "int64", "lower": "float64", "upper": "float64"}
        return pd.concat(out) if out else pd.DataFrame({name: pd.Series(dtype=kind) for name, kind in empty.items()})

    by = ("d", "query_block", "row_block")
    found = queries.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, lower double, upper double")
    by_lower = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("lower"), "vec_id"))
    reach = F.min(F.when(F.col("place") == k, F.col("lower"))).over(W.partitionBy("query_id"))
    found = found.withColumn("place", by_lower).withColumn("reach", reach).where("reach IS NULL OR upper >= reach").select("query_id", "vec_id")
    asking = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"))
    scored = found.join(rows.select("vec_id", "vector"), "vec_id").join(asking, "query_id").select("query_id", "vec_id", _inner("asked", "vector").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
