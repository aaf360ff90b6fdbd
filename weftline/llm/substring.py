"""Exact substring dedup over words, by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of `window // 2` words; their hashes are the anchors. Any run
of `window` words that occurs twice holds a whole block of its earlier occurrence, so probing the anchors with every
rolling block finds at least one hit inside each repeat. Windows around hits are candidates: they are compared by a
64-bit hash (in buckets chosen by independent bits) with all other candidates, and consecutive windows that have an
earlier twin join to the maximal exact repeat, which is removed.

Volume: a map task works on packs of texts. It answers what it can inside its pack and sends, per bucket, one packed
row of 4-byte hashes and 2-byte position gaps. A block that is frequent everywhere costs one entry per pack and bucket
then, however many rows hold it. Buckets follow the size of the input.

Defined results: a null text has no words. Rows of one doc_id and equal text count as one document written twice: all
are cut alike. Where rows of one doc_id differ in text, "earlier" compares (doc_id, start). A null doc_id comes last,
together with the largest long.
Other columns are ignored. Ids must be integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import hash_words, mix, split_words, text_buffers, window_hashes, windows_of
from weftline.session import input_bytes, ship

#: Words of a pack, and bytes of stored input for a bucket: with these, a Python worker takes some 150 MB. Larger
#: executors should take larger ones, for fewer and longer rows.
PACK_WORDS = 1 << 19
BUCKET_BYTES = 8 << 20

_LAST_ID = (1 << 63) - 1
_WIRE = "slot int, kind int, pack long, a binary, b binary, c binary"
_PROBES, _TEXTS, _KNOWN = 0, 1, 2


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _packs(batches: Iterator[pa.RecordBatch], extra: str | None = None) -> Iterator[tuple]:
    """Texts of many batches as one run of word hashes: ids, text hashes, word counts, hashes, extra column."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        step = 1024
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            raw, offsets = text_buffers(_column(part, "text"))
            starts, lengths, counts = split_words(raw, offsets)
            held.append(
                (
                    _column(part, "dk").to_numpy(zero_copy_only=False),
                    _column(part, "th").to_numpy(zero_copy_only=False),
                    counts,
                    hash_words(raw, starts, lengths),
                    _column(part, extra).to_pylist() if extra else [],
                )
            )
            size += len(starts)
            if size >= PACK_WORDS:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple:
    dk, th, counts, words = (np.concatenate([x[i] for x in held]) for i in range(4))
    return dk, th, counts, words, [x for h in held for x in h[4]]


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)


def _spans(begins: np.ndarray, n: int) -> list[tuple[int, int]]:
    return list(zip(begins.tolist(), [*begins[1:].tolist(), n], strict=False))


def _gaps(positions: np.ndarray) -> bytes:
    """Ascending positions as gaps behind a byte for their width: 1 where most fit (255 says that more follows), 2, or 4."""
    gaps = np.diff(positions, prepend=0)
    more, rest = np.divmod(gaps, 255)
    if more.sum() < len(gaps):
        out = np.full(len(gaps) + int(more.sum()), 255, np.uint8)
        out[np.cumsum(more + 1) - 1] = rest
        return b"\1" + out.tobytes()
    return b"\2" + gaps.astype(np.uint16).tobytes() if gaps.max(initial=0) < 65536 else b"\4" + gaps.astype(np.uint32).tobytes()


def _ungaps(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[data[0]], offset=1)
    positions = np.cumsum(gaps, dtype=np.int64)
    return positions[gaps < 255] if data[0] == 1 else positions


def _wire(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    names = ("slot", "kind", "pack", "a", "b", "c")
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))


def _probe(block: int, buckets: int):
    """Map side of the anchor search: per pack, probes for each bucket, its list of texts, and repeats inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dk, th, counts, words, _ in _packs(batches):
            at, per = windows_of(counts, block)
            if not len(at):
                continue
            hashes = window_hashes(words, block)[at]
            in_text = np.arange(len(at)) - np.repeat(np.cumsum(per) - per, per)
            anchor = in_text % block == 0
            order = np.argsort(hashes, kind="stable")
            begins = _groups(hashes[order])
            sizes = np.diff(begins, append=len(order))
            anchored = np.maximum.reduceat(anchor[order], begins)
            first = order[begins]
            several = np.zeros(len(order), bool)
            several[order] = np.repeat(sizes > 1, sizes)
            # One entry per hash goes out, at its first place; repeats inside the pack are candidates already.
            send, marked = np.zeros(len(order), bool), np.zeros(len(order), bool)
            send[first], marked[first] = True, anchored
            places = np.flatnonzero(send)
            slots = ((hashes[places] >> np.uint64(36)) % np.uint64(buckets)).astype(np.int32)
            by_slot = np.argsort(slots, kind="stable")
            places, slots = places[by_slot], slots[by_slot]
            digest = hashlib.sha256(dk.tobytes() + th.tobytes()).digest()
            pack = int.from_bytes(digest[:8], "little", signed=True)
            home = pack % buckets
            rows = [
                (home, _TEXTS, pack, dk.astype(np.int64).tobytes(), th.astype(np.int64).tobytes(), per.astype(np.int32).tobytes()),
                (home, _KNOWN, pack, np.flatnonzero(several).astype(np.uint32).tobytes(), None, None),
            ]
            edges = _groups(slots)
            for lo, hi in _spans(edges, len(slots)):
                own = places[lo:hi]
                keys = (hashes[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows.append((int(slots[lo]), _PROBES, pack, keys.tobytes(), _gaps(own), np.packbits(marked[own]).tobytes()))
            yield _wire(rows)

    return run


def _match(table: pa.Table) -> pa.Table:
    """One bucket: the probes whose block occurs twice, once at least as an anchor, by pack; other rows pass."""
    rows = table.to_pylist()
    out = [tuple(r[k] for k in ("slot", "kind", "pack", "a", "b", "c")) for r in rows if r["kind"] != _PROBES]
    probes = [r for r in rows if r["kind"] == _PROBES]
    if probes:
        keys = [np.frombuffer(r["a"], np.uint32) for r in probes]
        marks = np.concatenate([np.unpackbits(np.frombuffer(r["c"], np.uint8), count=len(k)) for r, k in zip(probes, keys, strict=True)])
        ends = np.cumsum([len(k) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        begins = _groups(keys[order])
        sizes = np.diff(begins, append=len(order))
        hit = np.zeros(len(order), bool)
        hit[order] = np.repeat((sizes > 1) & (np.maximum.reduceat(marks[order], begins) > 0), sizes)
        for r, lo, hi in zip(probes, [0, *ends[:-1]], ends, strict=True):
            found = _ungaps(r["b"])[hit[lo:hi]]
            if len(found):
                out.append((r["slot"], _KNOWN, r["pack"], found.astype(np.uint32).tobytes(), None, None))
    return pa.Table.from_batches([_wire(out)])


def _resolve(table: pa.Table) -> pa.Table:
    """One pack: its hits as places in each of its texts."""
    rows = table.to_pylist()
    texts = next((r for r in rows if r["kind"] == _TEXTS), None)
    hits = [np.frombuffer(r["a"], np.uint32) for r in rows if r["kind"] == _KNOWN]
    dk, th, places = [], [], []
    if texts and hits:
        ids, hashes = np.frombuffer(texts["a"], np.int64), np.frombuffer(texts["b"], np.int64)
        ends = np.cumsum(np.frombuffer(texts["c"], np.int32))
        at = np.unique(np.concatenate(hits)).astype(np.int64)
        text = np.searchsorted(ends, at, side="right")
        edges = _groups(text)
        for lo, hi in _spans(edges, len(text)):
            if hi > lo:
                i = text[lo]
                dk.append(int(ids[i]))
                th.append(int(hashes[i]))
                places.append((at[lo:hi] - (ends[i - 1] if i else 0)).astype(np.uint32).tobytes())
    return pa.table({"dk": pa.array(dk, pa.int64()), "th": pa.array(th, pa.int64()), "places": pa.array(places, pa.binary())})


def _extend(window: int, block: int, buckets: int):
    """Map side of the comparison: hashes of all windows that hold a hit, for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dk, th, counts, words, places in _packs(batches, "places"):
            at, per = windows_of(counts, window)
            if not len(at):
                continue
            # A hit at p lies in the windows that start from p - (window - block) to p.
            reach = np.zeros(len(words) + 1, np.int32)
            for base, n, found in zip(np.cumsum(counts) - counts, per, places, strict=True):
                if n:
                    p = np.concatenate([np.frombuffer(x, np.uint32) for x in found]).astype(np.int64)
                    np.add.at(reach, base + np.maximum(p - (window - block), 0), 1)
                    np.add.at(reach, base + p + 1, -1)
            wanted = np.cumsum(reach)[at] > 0
            text = np.repeat(np.arange(len(counts)), per)[wanted]
            at = at[wanted]
            if not len(at):
                continue
            base = np.cumsum(counts) - counts
            start = at - base[text]
            hashes = window_hashes(words, window)[at]
            slots = (window_hashes(words, window, seed=1)[at] % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((start, dk[text], hashes, slots))
            hashes, slots, text, start, at = hashes[order], slots[order], text[order], start[order], at[order]
            begins = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (slots[1:] != slots[:-1])])
            head = np.repeat(begins, np.diff(begins, append=len(hashes)))
            later = (dk[text] != dk[text[head]]) | (start != start[head])
            rows = _flags(dk[text[later]], th[text[later]], start[later], buckets)
            keep = np.flatnonzero(~later)
            slot = slots[keep]
            edges = _groups(slot)
            for lo, hi in _spans(edges, len(slot)):
                own = keep[lo:hi]
                own = own[np.argsort(at[own])]
                t = text[own]
                runs = _groups(t)
                heads = np.concatenate([dk[t[runs]].astype(np.int64), th[t[runs]].astype(np.int64), np.diff(runs, append=len(t)), base[t[runs]]])
                rows.append((int(slot[lo]), _PROBES, 0, hashes[own].tobytes(), heads.astype(np.int64).tobytes(), _gaps(at[own])))
            yield _wire(rows)

    return run


def _flags(dk: np.ndarray, th: np.ndarray, start: np.ndarray, buckets: int) -> list[tuple]:
    """Words at which windows with an earlier twin start, packed by a slot of their text's id."""
    slot = mix(dk.astype(np.int64).view(np.uint64)) % np.uint64(buckets)
    order = np.lexsort((start, th, dk, slot))
    dk, th, start, slot = dk[order], th[order], start[order], slot[order]
    rows = []
    for lo, hi in _spans(_groups(slot), len(slot)):
        i, t = dk[lo:hi].astype(np.int64), th[lo:hi].astype(np.int64)
        runs = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (t[1:] != t[:-1])])
        n = np.diff(runs, append=hi - lo)
        # Texts are laid end to end, so that places ascend and gaps stay small.
        ends = np.cumsum(start[lo:hi][runs + n - 1] + 1)
        base = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        heads = np.concatenate([i[runs], t[runs], n, base])
        rows.append((int(slot[lo]), _KNOWN, 0, heads.tobytes(), _gaps(start[lo:hi] + np.repeat(base, n)), None))
    return rows


def _unpack(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, text hashes and places from packed rows of (heads, places)."""
    found = [[np.empty(0, np.int64)] for _ in range(3)]
    for heads, places in rows:
        ids, texts, n, base = np.frombuffer(heads, np.int64).reshape(4, -1)
        for out, values in zip(found, (np.repeat(ids, n), np.repeat(texts, n), _ungaps(places) - np.repeat(base, n)), strict=True):
            out.append(values)
    return tuple(np.concatenate(x) for x in found)


def _by_text(table: pa.Table) -> pa.Table:
    """One slot of texts: the flagged words of each text."""
    dk, th, start = _unpack(list(zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True)))
    order = np.lexsort((start, th, dk))
    dk, th, start = dk[order], th[order], start[order]
    runs = np.flatnonzero(np.r_[np.ones(min(1, len(dk)), bool), (dk[1:] != dk[:-1]) | (th[1:] != th[:-1])])
    starts = [np.unique(start[lo:hi]).astype(np.uint32).tobytes() for lo, hi in _spans(runs, len(dk))]
    return pa.table({"dk": pa.array(dk[runs]), "th": pa.array(th[runs]), "starts": pa.array(starts, pa.binary())})


def _settle(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket: every window but the earliest of its kind is flagged."""
        rows = table.to_pylist()
        out = [tuple(r[k] for k in ("slot", "kind", "pack", "a", "b", "c")) for r in rows if r["kind"] == _KNOWN]
        sent = [r for r in rows if r["kind"] == _PROBES]
        if sent:
            hashes = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in sent])
            dk, th, start = _unpack([(r["b"], r["c"]) for r in sent])
            order = np.lexsort((start, dk, hashes))
            begins = _groups(hashes[order])
            head = order[np.repeat(begins, np.diff(begins, append=len(order)))]
            later = np.empty(len(order), bool)
            later[order] = (dk[order] != dk[head]) | (start[order] != start[head])
            out += _flags(dk[later], th[later], start[later], buckets)
        return pa.Table.from_batches([_wire(out)])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(_column(batch, "text").to_pylist(), _column(batch, "starts").to_pylist(), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if starts:
                    edge = np.zeros(n + 1, np.int32)
                    at = np.frombuffer(starts, np.uint32).astype(np.int64)
                    edge[at] += 1
                    edge[at + window] -= 1
                    keep = np.flatnonzero(np.cumsum(edge)[:n] == 0)
                    words = [words[i] for i in keep.tolist()]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            columns = [_column(batch, "doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): each text without the words of windows that start earlier elsewhere.

    `kept` joins the remaining words with single spaces. The text is shuffled once, on (doc_id, text hash); both
    later passes over it are joined in that partitioning.
    """
    ship(docs.sparkSession)
    block = window // 2
    size = input_bytes(docs, text_col)
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    # The session's own number: with another, the joins would shuffle the text once more to agree on one.
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = base.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("dk"), F.xxhash64("text").alias("th"))

    slim = base.select("dk", "th", "text")
    probes = slim.mapInArrow(_probe(block, buckets), _WIRE)
    hits = probes.groupBy("slot").applyInArrow(_match, _WIRE)
    places = hits.groupBy("pack").applyInArrow(_resolve, "dk long, th long, places binary")
    places = places.groupBy("dk", "th").agg(F.collect_list("places").alias("places"))

    keyed = base.repartition(slots, "dk", "th")
    # Both joins read the same columns of `keyed`, so that Spark shuffles it once and reads it twice.
    around = keyed.join(places, ["dk", "th"]).select("doc_id", "dk", "th", "text", "places")
    windows = around.mapInArrow(_extend(window, block, buckets), _WIRE)
    flags = windows.groupBy("slot").applyInArrow(_settle(buckets), _WIRE)
    flags = flags.groupBy("slot").applyInArrow(_by_text, "dk long, th long, starts binary")
    joined = keyed.join(flags, ["dk", "th"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string")
