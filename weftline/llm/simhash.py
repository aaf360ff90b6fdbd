"""SimHash near-dedup: 64-bit fingerprints, linked when few bits differ, grouped by reachability.

Links are found by anchor-point covering. A fingerprint's bits are cut into parts, and each choice of some parts is a
block, so that two fingerprints of at most 4 differing bits differ in at most 1 bit of some block: one of 3 parts for
small tables, 2 of 5 or 3 of 6 for larger ones, whose longer blocks keep an anchor's rows few (`cover`). In each block
the anchors are the words of the perfect (15, 11) Hamming code on 15 bits times all patterns of the remaining bits: a
covering code of radius 1. Each distinct fingerprint is at home at its nearest anchor and is replicated to every anchor
within radius + threshold = 2; comparing homes with replicas per anchor therefore sees every link. Two blocks that
differ in one bit have different parities and equal ones share their home, so only odd ones need replicas.

An anchor does not return pairs but a spanning forest of its links, so a group of n near copies costs fewer than n
rows. Anchors that are home to very many fingerprints are split: homes are dealt out by a salt and replicas go to each
part; homes go to half of the other parts as replicas too, so that any two of them meet. Equal fingerprints are merged
before all this.

`keep_one` removes near copies by the exact Jaccard similarity of word shingles, 0.8 or more. Texts whose fingerprints differ
in at most 4 bits meet at the anchors above, and there only; each link counts if the two sets, read from the shared folder
(`sets`), have that similarity. Sets at 0.8 differ in about 15 of 100 bits, too many for a covering whose rows a text
would not grow with the table; so texts of 5 to `NEAR_BITS` differing bits meet by `BANDS` further keys a text, each of the least
hashes of its shingles under `BAND_ROWS` functions. A pair at exactly 0.8 has an equal key with a probability of 0.992, one
at 0.85 of 0.9997; texts that share a fifth of their shingles meet once in 15,000 pairs. Texts with equal keys are compared
as homes of one anchor are, hot keys split alike. A text sends `BANDS` rows of 20 bytes beside its anchors' rows.

Defined results: a null or blank text has fingerprint zero and is linked like any other. Repeated rows share a
fingerprint. A component whose ids are all null has a null component_id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import sets
from weftline.llm.components import components
from weftline.llm.staging import fresh_path, stage
from weftline.llm.text import whole
from weftline.llm.words import mix
from weftline.session import ship

MAX_BITS = 4
#: Parts of a fingerprint, and how many make a block; from so many fingerprints on.
COVERS = ((0, 3, 1), (1 << 20, 5, 2), (1 << 28, 6, 3))
#: A third of the fingerprints at home in one slot, about; rows dealt at a time, so that a slot gets few packs.
SLOT_ROWS, PACK_ROWS = 10_000, 8192
#: Homes of an anchor that is split, and such anchors at most.
HOT_HOMES, MAX_HOT = 20_000, 10_000
_PAIRS, _CHECKS = 500_000, 4096
#: Candidates for a Jaccard similarity of 0.8: keys of a text, and least hashes in each.
BANDS, BAND_ROWS = 26, 8
#: Bits of the fingerprints of candidates that may differ. At 0.8 more differ in about 1 of 20,000 pairs.
NEAR_BITS = 22
_STEP = 0x9E3779B97F4A7C15


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 hash of each word shingle of the lower-cased text, in order; of a shorter text, of all its words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: max(1, len(tokens) - shingle + 1)]
    last = ends[min(shingle, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts.tolist(), last.tolist(), strict=True)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of some hashes: each bit that more than half of them have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        some = hashes[at : at + 65536]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


_FACTORS = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)


def band_keys(grams: np.ndarray) -> np.ndarray:
    """The keys, of 48 bits, of a set of shingle hashes; an empty set has keys as well."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1024):
        np.minimum(least, (mix(grams[at : at + 1024])[None, :] * _FACTORS[:, None]).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = mix(keys * np.uint64(_STEP) + column)
    return keys >> np.uint64(16)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp): a long whose 64 bits are the fingerprint of the whole lower-cased text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, fp long")


Block = tuple[tuple[int, int], ...]


def cover(n: int) -> list[Block]:
    """The blocks for n fingerprints: ranges (lowest bit, width) of up to 3 parts each."""
    parts, take = [c[1:] for c in COVERS if n >= c[0]][-1]
    edges = [64 * i // parts for i in range(parts + 1)]
    ranges = [(low, high - low) for low, high in zip(edges, edges[1:], strict=False)]
    return list(combinations(ranges, take))


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Of 15-bit words: the XOR of the numbers 1 to 15 of the bits that are set; zero for the code's own words."""
    out = np.zeros(word.shape, np.int64)
    for bit in range(15):
        out ^= ((word >> bit) & 1) * (bit + 1)
    return out


def _near_words() -> list[np.ndarray]:
    """For each syndrome, the error patterns of up to 2 bits that lead from a word to words of the code."""
    patterns = [0] + [1 << i for i in range(15)] + [1 << i | 1 << j for i in range(15) for j in range(i)]
    found: list[list[int]] = [[] for _ in range(16)]
    for p, s in zip(patterns, _syndrome(np.array(patterns)).tolist(), strict=True):
        found[s].append(p)
    return [np.array(x) for x in found]


def anchors(fps: np.ndarray, block: Block, number: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In one block: key of the anchor, index of the fingerprint, whether it is at home there."""
    near, value, width = _near_words(), np.zeros(len(fps), np.int64), 0
    for low, bits in block:
        value |= ((fps >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1)) << width
        width += bits
    word, rest, free = value & 0x7FFF, value >> 15, width - 15
    syndrome = _syndrome(word)
    home = word ^ np.where(syndrome > 0, 1 << np.maximum(syndrome - 1, 0), 0)
    key = lambda w, r: (number << width) | (r << 15) | w
    index = np.arange(len(fps))
    keys, who = [key(home, rest)], [index]

    def reach(k, i):
        keys.append(k)
        who.append(i)

    odd = index[np.bitwise_count(value) % 2 == 1]
    for s in range(16):
        i = odd[syndrome[odd] == s]
        for p in near[s]:
            if p != (1 << (s - 1) if s else 0):
                reach(key(word[i] ^ p, rest[i]), i)
    exact = odd[syndrome[odd] == 0]
    for a in range(free):
        reach(key(home[odd], rest[odd] ^ (1 << a)), odd)
        for b in range(a):
            reach(key(home[exact], rest[exact] ^ (1 << a) ^ (1 << b)), exact)
    who = np.concatenate(who)
    return np.concatenate(keys), who, np.arange(len(who)) < len(fps)


Spread = Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _anchors_of(blocks: list[Block]) -> Spread:
    """`anchors` of each block of fingerprints, with keys of their own."""

    def run(marks: np.ndarray):
        for number, block in enumerate(blocks):
            yield anchors(np.ascontiguousarray(marks[:, 0]), block, number)

    return run


def _by_band(marks: np.ndarray):
    """Of band keys: each is an anchor, and every row is at home at each of its own."""
    for k in range(marks.shape[1]):
        yield marks[:, k].astype(np.int64), np.arange(len(marks)), np.ones(len(marks), bool)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (what is sent with each anchor, the fingerprints), longs or several of them in bytes: two matrices."""

    def matrix(column: pa.Array) -> np.ndarray:
        if pa.types.is_int64(column.type):
            return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, 1)
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(batch.num_rows, -1)

    return tuple(map(matrix, batch.columns))


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`_columns` of about `PACK_ROWS` rows at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append(_columns(batch))
        if sum(len(sent) for sent, _ in held) >= PACK_ROWS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _deal(slots: int, hot: dict[int, int], spread_out: Spread):
    """Map side: what each row sends, packed byte by byte, for the slots of its anchors, `slots` for each block or band."""
    hot_keys = np.array(sorted(hot), np.int64)
    parts = np.array([hot[k] for k in sorted(hot)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sent, marks in _packs(batches):
            for number, (keys, who, own) in enumerate(spread_out(marks)):
                if len(hot_keys):
                    place = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
                    n = np.where(hot_keys[place] == keys, parts[place], 1)
                    # Of two parts one is within half a round of the other, so either home meets the other as a replica.
                    copies = np.where(own, 1 + n // 2, n)
                    again = np.repeat(np.arange(len(keys)), copies)
                    step = np.arange(len(again)) - np.repeat(np.cumsum(copies) - copies, copies)
                    first = ((sent[who[again], 0] * np.uint64(_STEP)) >> np.uint64(33)).astype(np.int64)
                    salt = np.where(own[again], first + step, step) % n[again]
                    keys, who, own = keys[again] | salt << 48, who[again], own[again] & (step == 0)
                spread = mix(keys.view(np.uint64))
                # Anchors of equal low bits in a slot only meet once more than they need.
                slot, low = number * slots + (spread >> np.uint64(32)).astype(np.int64) % slots, spread.astype(np.uint32)
                order = np.lexsort((low, slot))
                slot = slot[order]
                edges = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                rows = []
                for lo, hi in zip(edges, np.append(edges[1:], len(slot)), strict=False):
                    some = order[lo:hi]
                    rows.append((int(slot[lo]), low[some].view(np.uint8).reshape(-1, 4).T.tobytes(), sent[who[some]].view(np.uint8).reshape(len(some), -1).T.tobytes(), np.packbits(own[some]).tobytes()))
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["slot", "keys", "sent", "own"])

    return run


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i]; label holds each node's smallest known equal."""
    while len(a):
        x, y = label[a], label[b]
        if (x == y).all():
            return
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while True:
            nearer = label[label]
            if (nearer == label).all():
                break
            label[:] = nearer
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slot's keys, what was sent with them and whether at home, ordered by key."""
    keys, sent, own = [], [], []
    for k, s, o in zip(*(table.column(c).to_pylist() for c in ("keys", "sent", "own")), strict=True):
        keys.append(np.frombuffer(k, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel())
        n = len(keys[-1])
        sent.append(np.frombuffer(s, np.uint8).reshape(-1, n).T.copy().view(np.uint64))
        own.append(np.unpackbits(np.frombuffer(o, np.uint8), count=n).astype(bool))
    keys, sent, own = np.concatenate(keys), np.concatenate(sent), np.concatenate(own)
    order = np.argsort(keys, kind="stable")
    return keys[order], sent[order], own[order]


def _met(keys: np.ndarray, own: np.ndarray, index: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of homes and of all rows at their anchors, in blocks of pairs, less those whose nodes `label` connects."""
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(begins, append=len(keys))
    group = np.repeat(np.arange(len(begins)), sizes)
    homes = np.flatnonzero(own)
    homes = homes[sizes[group[homes]] > 1]
    width = sizes[group[homes]]
    total, at = np.cumsum(width), 0
    while at < len(homes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, side="right")))
        w = width[at:to]
        a = np.repeat(homes[at:to], w)
        b = np.repeat(begins[group[homes[at:to]]], w) + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)
        apart = label[index[a]] != label[index[b]]
        yield a[apart], b[apart]
        at = to


def _forest(nodes: np.ndarray, label: np.ndarray) -> pa.Table:
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"a": pa.array(nodes[tied].view(np.int64)), "b": pa.array(nodes[label[tied]].view(np.int64))})


def _link(max_bits: int):
    """One slot: a spanning forest of the links between homes and replicas of equal anchors."""

    def run(table: pa.Table) -> pa.Table:
        keys, fps, own = _unpacked(table)
        nodes, index = np.unique(fps[:, 0], return_inverse=True)
        label = np.arange(len(nodes))
        for a, b in _met(keys, own, index, label):
            near = np.bitwise_count(fps[a, 0] ^ fps[b, 0]) <= max_bits
            _merge(label, index[a[near]], index[b[near]])
        return _forest(nodes, label)

    return run


def _link_similar(folder: str, least: int, most: int):
    """One slot: a spanning forest of the links of a Jaccard similarity of 0.8 or more and `least` to `most` differing bits; rows send (place, fingerprint)."""

    def run(table: pa.Table) -> pa.Table:
        keys, sent, own = _unpacked(table)
        nodes, index = np.unique(sent[:, 0], return_inverse=True)
        label, held = np.arange(len(nodes)), sets.Heads(folder, nodes)
        for a, b in _met(keys, own, index, label):
            bits = np.bitwise_count(sent[a, 1] ^ sent[b, 1])
            near = (least <= bits) & (bits <= most)
            a, b = index[a[near]], index[b[near]]
            pairs = np.unique(np.minimum(a, b) * len(nodes) + np.maximum(a, b))
            a, b = pairs // len(nodes), pairs % len(nodes)
            able = held.able(a, b)
            a, b = a[able], b[able]
            while len(a):
                n = held.fitting(a[:_CHECKS], b[:_CHECKS])
                grams = held.grams(np.unique(np.concatenate([a[:n], b[:n]])))
                alike = np.array([sets.alike(grams[x], grams[y]) for x, y in zip(a[:n].tolist(), b[:n].tolist(), strict=True)])
                _merge(label, a[:n][alike], b[:n][alike])
                a, b = a[n:], b[n:]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
        return _forest(nodes, label)

    return run


def _links(rows: DataFrame, spread_out: Spread, groups: int, n: int, link) -> DataFrame:
    """Rows (a, b): what `link` finds in the slots of n rows (sent, marks), whose marks have `groups` blocks or bands."""
    limit = max(HOT_HOMES, groups * n // MAX_HOT)
    hot: dict[int, int] = {}
    if n > limit:

        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [keys[own] for keys, _, own in spread_out(_columns(batch)[1])] if batch.num_rows else [np.empty(0, np.int64)]
                keys, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], names=["anchor", "n"])

        crowded = rows.mapInArrow(homes, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
        # No more than groups * n / limit <= MAX_HOT anchors can be that crowded.
        hot = {r["anchor"]: math.ceil(r["n"] / limit) for r in crowded.where(F.col("n") > limit).collect()}
    slots = max(1, math.ceil(n / (3 * SLOT_ROWS)))
    dealt = rows.mapInArrow(_deal(slots, hot, spread_out), "slot long, keys binary, sent binary, own binary")
    return dealt.groupBy("slot").applyInArrow(link, "a long, b long").distinct()


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (a, b) of fingerprints that connect all those within `max_bits`; `distinct` has one row per fp."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the blocks find links of up to {MAX_BITS} bits")
    n = distinct.count()
    blocks = cover(n)
    return _links(distinct.select(F.col("fp").alias("sent"), F.col("fp").alias("marks")), _anchors_of(blocks), len(blocks), n, _link(max_bits))


def near_groups(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component, component_id), one for each row of `docs`.

    `component` is the smallest fingerprint reachable, as a long; `component_id` the smallest doc_id.
    """
    marked = stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct, max_bits))
    labelled = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("component"))
    # Written, so that the join below is of two plain shuffles, which Spark can split where a component is large.
    ids = stage(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    return marked.join(labelled.join(ids, "component").select("fp", "component", "component_id"), "fp")


def covered_links(distinct: DataFrame, folder: str) -> DataFrame:
    """Rows (a, b) of places of sets of a similarity of 0.8 or more whose fingerprints are within `MAX_BITS`: all that meet at the anchors of `links`."""
    n = distinct.count()
    blocks = cover(n)
    rows = distinct.select("sent", F.substring("sent", 9, 8).alias("marks"))
    return _links(rows, _anchors_of(blocks), len(blocks), n, _link_similar(folder, 0, MAX_BITS))


def similar_links(distinct: DataFrame, folder: str) -> DataFrame:
    """Rows (a, b) of places of sets that connect those of a similarity of 0.8 or more; `distinct` has (sent, marks)."""
    farther = _links(distinct.select("sent", "marks"), _by_band, BANDS, distinct.count(), _link_similar(folder, MAX_BITS + 1, NEAR_BITS))
    return covered_links(distinct, folder).unionAll(farther)


def _marked_sets(docs: DataFrame, shingle: int, folder: str) -> DataFrame:
    """Rows (doc_id, __row, node, at, sent, marks): node names a text's set, `at` is its place in the shared folder."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each attempt of a task has files of its own; only what the attempt that counts has written is referred to.
        writer, places = sets.Writer(folder, TaskContext.get().taskAttemptId()), {}
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                grams = np.unique(shingle_hashes(text, shingle))
                node = int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), 7)).view(np.int64))
                if node not in places:
                    places[node] = writer.add(grams)
                sent = np.array([places[node], fingerprint_of(grams)], np.uint64)
                rows.append((node, places[node], sent.tobytes(), band_keys(grams).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "__row", "node", "at", "sent", "marks"])
        writer.close()

    rows = docs.select(F.col("doc.doc_id").alias("doc_id"), "__row", "doc.text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, __row long, node long, at long, sent binary, marks binary")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of `docs`, one for each group of near copies: its smallest doc_id (nulls last, then by row hash).

    Ids may be of any type that has an order. Of rows that repeat in all columns one is kept. Texts of equal sets, such as null
    and blank ones, are copies. `docs` may be any plan: a task that runs again leaves files that nobody refers to.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("__row"), whole(docs).alias("doc"))
    folder = fresh_path(docs.sparkSession, "shingles")
    marked = stage(_marked_sets(keyed, shingle, folder), "sets")
    distinct = marked.groupBy("node").agg(F.min(F.struct("at", "sent", "marks")).alias("m")).select("node", "m.*")
    distinct = stage(distinct, "distinct")
    found = components(similar_links(distinct, folder)).withColumnRenamed("node", "__node")
    rows = marked.groupBy("node", "doc_id", "__row").agg(F.count("*").alias("__times"))
    best = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row", "__times")).alias("best"))
    best = best.join(distinct.select("node", "at"), "node").join(found, F.col("at") == F.col("__node"), "left")
    best = best.groupBy(F.coalesce("label", "at").alias("component")).agg(F.min("best").alias("best"))
    best = best.select(F.col("best.doc_id").alias("__id"), F.col("best.__row").alias("__best"), "best.__times")
    kept = keyed.join(best, (F.col("__row") == F.col("__best")) & F.col("doc.doc_id").eqNullSafe(F.col("__id"))).drop("__best")
    once, repeated = kept.where("__times = 1"), kept.where("__times > 1").dropDuplicates(["__id", "__row"])
    return once.unionByName(repeated).select("doc.*")
