r"""SentencePiece encoding and decoding of texts of any length, by a max-plus parallel scan.

A byte-pair model's segmentation of a text is the only path of pieces in which every two neighbours are compatible,
that is, segmented as themselves when joined. With weight 0 for compatible neighbours and minus infinity for others it
is the best path in the max-plus semiring, so it can be found in parallel: a giant text is cut into chunks of fixed
length; a boundary's states are the pieces that may lie across or end at it; each chunk yields its transfer matrix from
the states of its left to those of its right boundary; matrices are combined associatively, forwards and backwards, to
the one finite state at each boundary; and every chunk is then backtraced on its own between its two states.

Between two points where no piece can reach across (the first blank of a run, or a character outside the vocabulary)
the path does not depend on the boundaries, so a chunk that has such points has a matrix of rank one, and the library's
encoder writes the pieces between them. A chunk without any is traced piece by piece. Texts of one chunk have fixed
states at both ends and need no scan. Ids equal those of the sentencepiece library.

Giant texts are told apart by two 64-bit hashes, so copies are traced once; their chunks are dealt over all tasks.
Defined results: a null or empty text has no ids. Decoding gives back the text, but that U+2581 becomes a blank. The
model file must be at the same path on every worker; only models that never join a blank to a letter before it are
accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.staging import stage
from weftline.llm.text import whole
from weftline.session import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 16_384
_BLANK = "▁"


class Pieces:
    """A model file's vocabulary, and its merging of short strings."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(self.library)
        names = [self.library.id_to_piece(i) for i in range(n)]
        plain = [not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if plain[i]}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        if any(x != int(x) for x in self.scores.values()):
            raise ValueError("the scores of the pieces are no ranks: this is no byte-pair model")
        self.longest = max(map(len, self.ids))
        if any(_BLANK in p.lstrip(_BLANK) for p in self.ids):
            raise ValueError("a piece holds a blank after a letter")
        self.letters = {c for p in self.ids for c in p}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(names) if self.library.is_byte(i)}
        self.raw = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(_BLANK, " ").encode() if plain[i] else b"" for i, p in enumerate(names)]
        inside = "".join(re.escape(c) for c in sorted(self.letters - {_BLANK}))
        self.breaks = re.compile(f"(?<![{_BLANK}]){_BLANK}|[^{_BLANK}{inside}]")
        self._fits: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.scores.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.scores:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether b may follow a: the weight of the step is 0, else minus infinity."""
        key = (a, b)
        if key not in self._fits:
            if len(self._fits) > 1 << 20:
                self._fits.clear()
            self._fits[key] = self.merge(a + b) == [a, b]
        return self._fits[key]

    def starting(self, text: str, at: int) -> list[str]:
        """The pieces, or the lone character, that begin at a place."""
        found = [text[at : at + n] for n in range(1, min(self.longest, len(text) - at) + 1) if text[at : at + n] in self.ids]
        return found if text[at] in self.ids else [*found, text[at]]

    def path(self, text: str, at: int, end: int, first: str | None) -> dict[int, tuple[str, int]]:
        """From each place reachable after `first` (ending at `at`): the piece that ends there, and where it begins."""
        reach: dict[int, tuple[str | None, int]] = {at: (first, at - len(first or ""))}
        for i in range(at, end):
            if i in reach:
                last = reach[i][0]
                for piece in self.starting(text, i):
                    if last is None or self.fits(last, piece):
                        reach[i + len(piece)] = (piece, i)
        return reach

    def numbers(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]

    def encode_from_break(self, text: str) -> list[int]:
        """Ids of a text that begins at a break; blanks are U+2581. The library puts one blank before all it encodes."""
        if not text:
            return []
        if text[0] != _BLANK:
            return self.library.encode(text)[1:]
        return self.library.encode(text[1:]) if len(text) > 1 else [self.ids[_BLANK]]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.raw[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def blanked(text: str) -> str:
    return _BLANK + text.replace(" ", _BLANK) if text else ""


def states(model: Pieces, text: str, at: int) -> list[tuple[int, int]]:
    """The pieces that may end at or lie across a place, as (begin, end)."""
    found = []
    for begin in range(max(0, at - model.longest), at):
        for piece in model.starting(text, begin):
            if begin + len(piece) >= at:
                found.append((begin, begin + len(piece)))
    return found


def transfer(model: Pieces, text: str, left: int, right: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """States at both ends of text[left:right] and the matrix of weights between them; `text` reaches beyond both ends."""
    into = states(model, text, left) if left else [(0, 0)]
    out = states(model, text, right) if right < len(text) else [(right, right)]
    weights = np.full((len(into), len(out)), -np.inf)
    breaks = [m.start() for m in model.breaks.finditer(text, min(left + model.longest, right), right)]
    if breaks:
        first, last = breaks[0], breaks[-1]
        reaches = np.array([first in model.path(text, end, first, text[begin:end] or None) for begin, end in into])
        ends = _leads(model, text, last, right, out, None)
        weights[np.ix_(reaches, ends)] = 0
    else:
        for i, (begin, end) in enumerate(into):
            weights[i, _leads(model, text, end, right, out, text[begin:end] or None)] = 0
    return into, out, weights


def _leads(model: Pieces, text: str, at: int, right: int, out: list[tuple[int, int]], first: str | None) -> np.ndarray:
    """Which states at `right` lie on the paths from `at`."""
    reach = model.path(text, at, right, first)
    return np.array([(begin == end and end in reach) or reach.get(end, (None, -1))[1] == begin for begin, end in out], bool)


def trace(model: Pieces, text: str, into: tuple[int, int], out: tuple[int, int]) -> list[int]:
    """Ids of the pieces after state `into` up to and with state `out`."""
    at, end = into[1], out[1]
    found = model.breaks.search(text, at)
    if at == 0 and into == (0, 0):
        first = 0
    elif found and found.start() < end:
        first = found.start()
    else:
        first = None
    if first is None:
        return _walk(model, text, at, end, text[into[0] : at] or None)
    last = _last_break(model, text, first, max(out[0], first))
    ids = _walk(model, text, at, first, text[into[0] : at] or None)
    return ids + model.encode_from_break(text[first:last]) + _walk(model, text, last, end, None)


def _last_break(model: Pieces, text: str, first: int, end: int) -> int:
    for low in (max(first, end - 4096), first):
        found = [m.start() for m in model.breaks.finditer(text, low, end + 1)]
        if found:
            return found[-1]
    return first


def _walk(model: Pieces, text: str, at: int, end: int, first: str | None) -> list[int]:
    reach = model.path(text, at, end, first)
    back = []
    while end > at:
        piece, begin = reach[end]
        back.append(piece)
        end = begin
    return [n for p in reversed(back) for n in model.numbers(p)]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def settle(matrices: list[np.ndarray]) -> list[int]:
    """The state at each inner boundary that lies on the finite path, from running products from either end."""
    forward, backward = [matrices[0]], [matrices[-1]]
    for m in matrices[1:-1]:
        forward.append(combine(forward[-1], m))
    for m in matrices[-2:0:-1]:
        backward.append(combine(m, backward[-1]))
    return [int(np.argmax(f[0] + b[:, 0])) for f, b in zip(forward, reversed(backward), strict=True)]


def encode(docs: DataFrame, model_path: str = MODEL, chunk: int = CHUNK, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (*keep, text, ids array<int>), one for each row of `docs`; a kept column named ids gives way to the new one."""
    ship(docs.sparkSession)
    columns = [c for c in dict.fromkeys([*keep, "text"]) if c != "ids"]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    size = F.coalesce(F.length("text"), F.lit(0))
    small, giant = docs.where(size < chunk), docs.where(size >= chunk)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        at = columns.index("text")
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            ids = model.library.encode(texts, num_threads=1) if texts else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*columns, "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with as much of their neighbours as pieces can reach."""
        beside = pieces(model_path).longest
        for batch in batches:
            for a, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = blanked(text)
                edges = [*range(0, len(text), chunk), len(text)]
                for lo in range(0, len(edges) - 1, 64):
                    rows = [
                        (a, b, i, max(0, edges[i] - beside), edges[i], edges[i + 1], len(text), text[max(0, edges[i] - beside) : edges[i + 1] + beside])
                        for i in range(lo, min(lo + 64, len(edges) - 1))
                    ]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=wire)

    names = ("a", "b", "chunk", "origin", "low", "high", "total", "part")
    wire = pa.schema([(n, pa.string() if n == "part" else pa.int64()) for n in names])
    keyed = giant.select(whole(giant).alias("doc"), F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))
    texts = keyed.groupBy("a", "b").agg(F.any_value("doc.text").alias("text"))
    chunks = texts.mapInArrow(cut, "a long, b long, chunk long, origin long, low long, high long, total long, part string")
    chunks = stage(chunks.repartition("a", "b", "chunk"), "chunks")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            rows = []
            for a, b, i, origin, low, high, _, part in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                into, out, weights = transfer(model, part, low - origin, high - origin)
                rows.append((a, b, i, [x + origin for s in into for x in s], [x + origin for s in out for x in s], (weights == 0).ravel().tolist()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
            cols = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["a", "b", "chunk", "into", "out", "open"])

    def choose(table: pa.Table) -> pa.Table:
        """One text: its boundary states; takes the small matrices of its chunks, not its text."""
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        matrices = [np.where(np.array(r["open"]).reshape(len(r["into"]) // 2, -1), 0.0, -np.inf) for r in rows]
        at = [0, *settle(matrices), 0] if len(rows) > 1 else [0, 0]
        pick = lambda flat, i: flat[2 * i : 2 * i + 2]
        return pa.table({
            "a": pa.array([r["a"] for r in rows], pa.int64()), "b": pa.array([r["b"] for r in rows], pa.int64()), "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
            "into": pa.array([pick(r["into"], i) for r, i in zip(rows, at, strict=False)], pa.list_(pa.int64())),
            "out": pa.array([pick(r["out"], i) for r, i in zip(rows, at[1:], strict=False)], pa.list_(pa.int64())),
        })

    weighed = chunks.mapInArrow(weigh, "a long, b long, chunk long, into array<long>, out array<long>, open array<boolean>")
    chosen = weighed.groupBy("a", "b").applyInArrow(choose, "a long, b long, chunk long, into array<long>, out array<long>")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            rows = batch.to_pylist()
            ids = [trace(model, r["part"], tuple(x - r["origin"] for x in r["into"]), tuple(x - r["origin"] for x in r["out"])) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("a", "b", "chunk")), pa.array(ids, pa.list_(pa.int32()))], names=["a", "b", "chunk", "ids"])

    traced = chunks.join(chosen, ["a", "b", "chunk"]).select("a", "b", "chunk", "origin", "part", "into", "out").mapInArrow(back, "a long, b long, chunk long, ids array<int>")
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"]))
    encoded = traced.groupBy("a", "b").agg(ordered.alias("ids"))
    long = keyed.join(encoded, ["a", "b"]).select("doc.*", "ids")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema] + ["ids array<int>"])
    return small.mapInArrow(at_once, schema).unionByName(long)


def decode(rows: DataFrame, model_path: str = MODEL, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (*keep, decoded) from rows with ids."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    slim = rows.select(*keep, "ids")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1]]
    return slim.mapInArrow(run, ", ".join([*fields, "decoded string"]))
