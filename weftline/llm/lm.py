"""Language-model scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark over all training texts.

Counting takes two scans. The first counts tokens; slots by range of their 64-bit hash write sorted hash arrays, and a
token's number is its place in them. The second counts pairs of numbers, merged in slots by a hash of the pair, which
write sorted arrays of pairs and counts; what a slot knows of contexts and continuations goes on to the slots of those
tokens, which write one array each by number. Map tasks count inside packs of texts first, so a frequent token or pair
costs one entry per pack. Scoring is a third scan: workers memory-map the arrays in the shared folder, look up each
kind of pair of a pack once, and need no shuffle.

Modified Kneser-Ney: three discounts per order from the counts of counts; words are interpolated from continuation
counts, and those with a uniform share for one unknown token. With the order at two, the arrays take about the size
of the input; a third order would take several times that, since nearly every triple of this kind of text is new.

Defined results: a null text is empty and has one token, its end. Without training texts every probability is 1 and
every score 0. Repeated rows count and are scored as often as they occur; a null id has the checksum of empty text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import files
from weftline.llm.staging import fresh_path, stage
from weftline.llm.words import hash_words, mix, split_words, text_buffers
from weftline.session import input_bytes, ship

PACK_TOKENS = 1 << 19
SLOT_BYTES = 8 << 20
#: The hash of the token that ends a text.
END = np.uint64(0x5851F42D4C957F2D)
_WIRE = "slot int, keys binary, counts binary"


def remainder(doc_id: Column, by: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(by))


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """Token hashes of many texts end to end, with their ends; where each text begins; the batches they came in."""
    tokens, sizes, held, total = [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            raw, offsets = text_buffers(part.column(part.num_columns - 1))
            starts, lengths, counts = split_words(raw, offsets)
            words = hash_words(raw, starts, lengths, lower=True)
            tokens.append(np.insert(words, np.cumsum(counts), END))
            sizes.append(counts + 1)
            held.append(part)
            total += len(tokens[-1])
            if total >= PACK_TOKENS:
                yield _joined(tokens, sizes, held)
                tokens, sizes, held, total = [], [], [], 0
    if held:
        yield _joined(tokens, sizes, held)


def _joined(tokens, sizes, held):
    counts = np.concatenate(sizes)
    return np.concatenate(tokens), np.cumsum(counts) - counts, held


def _planes(keys: np.ndarray) -> bytes:
    """Sorted 8-byte keys, byte by byte across all: their first bytes repeat and compress."""
    return keys.view(np.uint8).reshape(-1, keys.itemsize).T.tobytes()


def _unplanes(data: bytes, kind=np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _wire(slots: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each slot; rows come ordered by slot."""
    edges = np.flatnonzero(np.r_[np.ones(min(1, len(slots)), bool), slots[1:] != slots[:-1]])
    ends = [*edges[1:].tolist(), len(slots)]
    rows = [(int(slots[lo]), _planes(keys[lo:hi]), _planes(counts[lo:hi])) for lo, hi in zip(edges.tolist(), ends, strict=False)]
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slot", "keys", "counts"])


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of one slot and their summed counts."""
    keys = np.concatenate([_unplanes(x) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([_unplanes(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[begins], np.add.reduceat(counts, begins)


def _search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


class Model:
    """A handle on the arrays: their folder, what each token slot holds, and the totals. Small, whatever the corpus."""

    def __init__(self, folder: str, bits: int, sizes: dict[int, int]):
        self.folder, self.bits = folder, bits
        self.base = np.zeros((1 << bits) + 1, np.int64)
        for slot, n in sizes.items():
            self.base[slot + 1] = n
        self.base = np.cumsum(self.base)
        self.vocabulary = int(self.base[-1])
        self.tokens = 0
        self.pair_slots: set[int] = set()
        self.pair_discounts = self.word_discounts = (0.0, 0.0, 0.0)
        self.continuations = 0
        self.word_spare = 0.0

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of sorted token hashes; -1 where a token is unknown."""
        out = np.full(len(hashes), -1, np.int64)
        edges = np.searchsorted(self.slot(hashes), np.arange((1 << self.bits) + 1))
        for slot in np.flatnonzero((np.diff(edges) > 0) & (np.diff(self.base) > 0)):
            some = slice(edges[slot], edges[slot + 1])
            place, there = _search(files.load(self.folder, f"token-{slot}"), hashes[some])
            out[some] = np.where(there, place + self.base[slot], -1)
        return out

    def by_number(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """Values that token slots hold for sorted numbers, one row each."""
        out = None
        edges = np.searchsorted(numbers, self.base)
        for slot in np.flatnonzero(np.diff(edges) > 0):
            some = slice(edges[slot], edges[slot + 1])
            held = files.load(self.folder, f"{name}-{slot}")
            if out is None:
                out = np.zeros((len(numbers), *held.shape[1:]), held.dtype)
            out[some] = held[numbers[some] - self.base[slot]]
        return out if out is not None else np.zeros((0, 5), np.uint64)

    def pair_slot(self, pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs) >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(pairs), np.int64)

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of distinct sorted pairs, 0 for those never seen."""
        out = np.zeros(len(pairs), np.int64)
        slots = self.pair_slot(pairs)
        order = np.argsort(slots, kind="stable")
        edges = np.searchsorted(slots[order], np.arange((1 << self.bits) + 1))
        for slot in np.flatnonzero(np.diff(edges) > 0):
            if int(slot) in self.pair_slots:
                some = order[edges[slot] : edges[slot + 1]]
                place, there = _search(files.load(self.folder, f"pair-{slot}"), pairs[some])
                out[some] = np.where(there, files.load(self.folder, f"times-{slot}")[place], 0)
        return out


def _pair_keys(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    return before.astype(np.uint64) << np.uint64(32) | own.astype(np.uint64)


def _before(numbers: np.ndarray, begins: np.ndarray, start: int) -> np.ndarray:
    out = np.empty(len(numbers), np.int64)
    out[1:] = numbers[:-1]
    out[begins] = start
    return out


def _discounts(counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney's discounts from the numbers of types seen once to four times."""
    n1, n2, n3, n4 = (max(1, n) for n in counts)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(k - 0.05, max(0.05, k - (k + 1) * y * after / own)) for k, own, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _cut(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def train(docs: DataFrame) -> Model:
    """Counts the texts of `docs` and writes the model's arrays into the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    bits = max(0, math.ceil(math.log2(max(1, input_bytes(docs)) / SLOT_BYTES)))
    folder = fresh_path(spark, "model")
    texts = docs.select("text")
    empty = Model(folder, bits, {})

    def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _, _ in _packs(batches):
            kinds, times = np.unique(tokens, return_counts=True)
            yield _wire(empty.slot(kinds), kinds, times.astype(np.uint32))

    def write_tokens(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        keys, counts = _merge(table)
        files.save(folder, f"token-{slot}", keys)
        files.save(folder, f"count-{slot}", counts)
        return pa.table({"slot": pa.array([slot], pa.int32()), "n": pa.array([len(keys)]), "total": pa.array([int(counts.sum())])})

    found = texts.mapInArrow(count_tokens, _WIRE).groupBy("slot").applyInArrow(write_tokens, "slot int, n long, total long").collect()
    model = Model(folder, bits, {r["slot"]: r["n"] for r in found})
    model.tokens = sum(r["total"] for r in found)
    if not model.tokens:
        return model
    if model.vocabulary >= 1 << 32:
        raise ValueError("more than 2^32 kinds of tokens")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, begins, _ in _packs(batches):
            kinds, inverse = np.unique(tokens, return_inverse=True)
            numbers = model.numbers(kinds)[inverse]
            pairs, times = np.unique(_pair_keys(_before(numbers, begins, model.vocabulary), numbers), return_counts=True)
            slots = model.pair_slot(pairs)
            order = np.argsort(slots, kind="stable")
            yield _wire(slots[order], pairs[order], times[order].astype(np.uint32))

    def write_pairs(table: pa.Table) -> pa.Table:
        """Writes a slot's pairs; passes on, by token slot, (1) contexts and (0) continuations, and counts of counts."""
        slot = table.column("slot")[0].as_py()
        pairs, counts = _merge(table)
        files.save(folder, f"pair-{slot}", pairs)
        files.save(folder, f"times-{slot}", counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64))
        rows = [(-1, slot, np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6).astype(np.uint64).tobytes(), b"")]
        context, own = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begins = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        level = np.minimum(counts, 3)
        stats = np.stack([np.add.reduceat(counts, begins)] + [np.add.reduceat((level == k).astype(np.uint64), begins) for k in (1, 2, 3)], axis=1)
        words, kinds = np.unique(own, return_counts=True)
        for kind, numbers, values in ((1, context[begins], stats), (0, words, kinds.astype(np.uint64)[:, None])):
            edges = np.searchsorted(numbers, model.base)
            # The start of a text stands behind all tokens and is kept by the last slot.
            edges[-1] = len(numbers)
            for i in np.flatnonzero(np.diff(edges) > 0):
                some = slice(edges[i], edges[i + 1])
                rows.append((int(i), kind, numbers[some].astype(np.uint32).tobytes(), values[some].tobytes()))
        columns = zip(*rows, strict=True)
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slot", "kind", "numbers", "stats"])

    def write_words(table: pa.Table) -> pa.Table:
        """One token slot: for each number its continuations, then as a context its tokens and types seen 1, 2, 3+ times."""
        slot = table.column("slot")[0].as_py()
        base, n = int(model.base[slot]), int(model.base[slot + 1] - model.base[slot])
        last = int(model.base[slot + 1] == model.vocabulary)
        held = np.zeros((n + last, 5), np.uint64)
        for kind, numbers, stats in zip(*(table.column(c).to_pylist() for c in ("kind", "numbers", "stats")), strict=True):
            at = np.frombuffer(numbers, np.uint32).astype(np.int64) - base
            values = np.frombuffer(stats, np.uint64).reshape(len(at), -1)
            held[at, (1 if kind else 0) : (5 if kind else 1)] += values
        files.save(folder, f"word-{slot}", held[:n])
        start = held[n] if last else np.zeros(5, np.uint64)
        own = np.bincount(np.minimum(held[:n, 0], 5).astype(np.int64), minlength=6)
        return pa.table({"own": pa.array([own.tolist()], pa.list_(pa.int64())), "kinds": pa.array([int(held[:n, 0].sum())]), "start": pa.array([start.astype(np.int64).tolist()], pa.list_(pa.int64()))})

    counted = texts.mapInArrow(count_pairs, _WIRE).groupBy("slot").applyInArrow(write_pairs, "slot int, kind int, numbers binary, stats binary")
    counted = stage(counted, "stats")
    totals = np.zeros(6, np.int64)
    for r in counted.where("slot = -1").collect():
        model.pair_slots.add(r["kind"])
        totals += np.frombuffer(r["numbers"], np.uint64).astype(np.int64)
    model.pair_discounts = _discounts(totals[1:5].tolist())
    words = counted.where("slot >= 0").groupBy("slot").applyInArrow(write_words, "own array<long>, kinds long, start array<long>").collect()
    own = np.sum([r["own"] for r in words], axis=0)
    model.word_discounts = _discounts(own[1:5].tolist())
    model.continuations = sum(r["kinds"] for r in words)
    many = int(own[3:].sum())
    model.word_spare = sum(d * n for d, n in zip(model.word_discounts, (own[1], own[2], many), strict=True)) / model.continuations
    model.start = np.sum([r["start"] for r in words], axis=0).astype(np.float64)
    return model


def _score_pack(model: Model, tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text: tokens, known tokens, and its log10 probability by unigrams and by the model."""
    kinds, inverse = np.unique(tokens, return_inverse=True)
    numbers = model.numbers(kinds)
    known = numbers >= 0
    held = np.zeros((len(kinds), 5))
    counts = np.zeros(len(kinds))
    order = np.flatnonzero(known)
    if len(order):
        # Sorted hashes have ascending numbers, so both look-ups run forward through the arrays.
        held[order] = model.by_number("word", numbers[order])
        counts[order] = model.by_number("count", numbers[order])
    uniform = 1 / (model.vocabulary + 1)
    base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
    if model.continuations:
        word = np.maximum(held[:, 0] - _cut(held[:, 0], model.word_discounts), 0) / model.continuations + model.word_spare * uniform
    else:
        word = np.full(len(kinds), uniform)
    # Each kind of pair once; kinds are numbered in the pack, with one more for the start.
    pack_before = _before(inverse.astype(np.int64), begins, len(kinds))
    pairs, back = np.unique(pack_before * (len(kinds) + 1) + inverse, return_inverse=True)
    before, own = pairs // (len(kinds) + 1), pairs % (len(kinds) + 1)
    context = np.concatenate([held[:, 1:], [getattr(model, "start", np.zeros(5))[1:]]])[before]
    seen = np.zeros(len(pairs))
    global_before = np.append(numbers, model.vocabulary)[before]
    ask = np.flatnonzero((global_before >= 0) & (numbers[own] >= 0))
    if len(ask) and model.tokens:
        keys = _pair_keys(global_before[ask], numbers[own[ask]])
        order = np.argsort(keys)
        seen[ask[order]] = model.pair_counts(keys[order])
    total = context[:, 0]
    safe = np.maximum(total, 1)
    spare = np.where(total > 0, context[:, 1:] @ np.array(model.pair_discounts) / safe, 1.0)
    p = np.maximum(seen - _cut(seen, model.pair_discounts), 0) / safe + spare * word[own]
    sizes = np.diff(begins, append=len(tokens))
    return sizes, np.add.reduceat(known[inverse].astype(np.int64), begins), np.add.reduceat(base[inverse], begins), np.add.reduceat(np.log10(p)[back], begins)


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*keep, n_tokens, n_known, train_tokens, base_score, score), one for each row of `docs`.

    Kept columns of these names give way to the new ones.
    """
    ship(docs.sparkSession)
    keep = tuple(c for c in keep if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score"))
    rows = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, begins, held in _packs(batches):
            found = _score_pack(model, tokens, begins)
            at = 0
            for part in held:
                some = slice(at, at + part.num_rows)
                at += part.num_rows
                n, known, base, value = (x[some] for x in found)
                columns = [*part.columns[:-1], pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "n_tokens long, n_known long, train_tokens long, base_score double, score double"]))


def perplexity(scored: DataFrame) -> DataFrame:
    """`score`'s rows with the perplexity per token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
