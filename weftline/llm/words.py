r"""Words `[^\x20\x09-\x0D]+` of Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than the six ASCII blanks; UTF-8 continuation bytes are never blanks, so
working on bytes gives the same words as working on code points. Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The pattern of a word for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of a token for models that look through punctuation: letters, digits and all non-ASCII.
IS_TOKEN = np.zeros(256, bool)
IS_TOKEN[48:58] = IS_TOKEN[65:91] = IS_TOKEN[97:123] = IS_TOKEN[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_LONG = 48
_PRIME = np.uint64(0x100000001B3)
_START = np.uint64(0xCBF29CE484222325)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's offsets into them, without copying."""
    column = pc.fill_null(column, "")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def split_words(raw: np.ndarray, offsets: np.ndarray, belongs: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word, and the number of words of each text."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = belongs[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = word[edges]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, lengths, counts


def hash_words(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with `lower`, of the word with A-Z lower-cased."""
    return hash_prefixes(raw, starts, lengths, (), lower)[0]


def hash_prefixes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cuts: tuple[int, ...], lower: bool = False) -> list[np.ndarray]:
    """Hashes of each word, and of its first `cut` bytes for each of the (ascending) cuts."""
    if lower:
        raw = _LOWER[raw]
    out = [np.empty(len(starts), np.uint64) for _ in range(len(cuts) + 1)]
    if not len(starts):
        return out
    short = np.minimum(lengths, _LONG + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]
    active = np.searchsorted(-short[order].astype(np.int64), -np.arange(1, _LONG + 2), side="right")
    at = starts[order]
    h = np.full(len(order), _START)
    for k in range(_LONG):
        if k in cuts:
            out[1 + cuts.index(k)][order] = mix(h ^ np.minimum(short[order], k))
        n = active[k]
        h[:n] = (h[:n] ^ raw[at[:n] + k]) * _PRIME
        if not n and k >= max(cuts, default=0):
            break
    out[0][order] = mix(h ^ short[order])
    for i in np.flatnonzero(lengths > _LONG):
        out[0][i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + lengths[i]].tobytes(), 7)
    return out


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of `size` words, by the place of its first word (texts' ends not yet regarded)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * factor + words[k : k + n]
    return mix(h)


def windows_of(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of `counts` words each, laid end to end: the first words of all windows, and windows per text."""
    per = np.maximum(counts - size + 1, 0)
    base = np.cumsum(counts) - counts
    skip = np.repeat(base - (np.cumsum(per) - per), per)
    return np.arange(per.sum()) + skip, per
