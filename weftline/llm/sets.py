"""Sets of word shingles in files of the shared folder, and their exact Jaccard similarity.

A task writes the sets of its texts one after the other; a set's place, a long, says in which file and where. Of each
set there are its size, 512 bits of which every shingle turns one, and its sorted hashes, 40 of their 64 bits each.
Two different shingles of a pair of texts look equal once in 10^12 comparisons of one shingle with another.
"""

from __future__ import annotations

import numpy as np

from weftline.llm.files import read, save

_HEAD, _WIDE = 72, 5
_FILE_BYTES = 32 << 20
_AT, _NUMBER = 28, 8


def parity(grams: np.ndarray) -> np.ndarray:
    turned = np.bincount((grams >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(turned.astype(np.uint8))


class Writer:
    """The files of one attempt of a task, whose number is in their names and in the sets' places."""

    def __init__(self, folder: str, task: int):
        self.folder, self.task, self.number, self.used = folder, task, 0, 0
        self.parts: list[np.ndarray] = []

    def add(self, grams: np.ndarray) -> int:
        """The place of a sorted set of hashes."""
        if self.used >= _FILE_BYTES:
            self.close()
            self.number += 1
        if self.number >> _NUMBER or self.task >> (63 - _AT - _NUMBER):
            raise ValueError("too many files of sets; read the texts in smaller or fewer partitions")
        place = (self.task << _NUMBER | self.number) << _AT | self.used
        size = np.array([len(grams)], np.uint64).view(np.uint8)
        self.parts += [size, parity(grams), grams.view(np.uint8).reshape(-1, 8)[:, 8 - _WIDE :].ravel()]
        self.used += _HEAD + _WIDE * len(grams)
        return place

    def close(self) -> None:
        if self.parts:
            save(self.folder, str(self.task << _NUMBER | self.number), np.concatenate(self.parts))
            self.parts, self.used = [], 0


#: Sets that lie so near to each other in a file are read at once; bytes of sets that a task holds at a time, about.
_GAP, _HELD = 1 << 16, 64 << 20


def _bytes(folder: str, places: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Of places in rising order, so many bytes from each: of each file few reads, in order, over what lies close together."""
    files, low = places >> _AT, places & (1 << _AT) - 1
    parts, at = [], 0
    while at < len(places):
        to, end = at + 1, int(low[at] + sizes[at])
        while to < len(places) and files[to] == files[at] and low[to] <= end + _GAP and end - low[at] < _FILE_BYTES // 4:
            end, to = max(end, int(low[to] + sizes[to])), to + 1
        block = read(folder, str(int(files[at])), int(low[at]), end - int(low[at]))
        parts += [block[int(x - low[at]) : int(x - low[at]) + int(n)] for x, n in zip(low[at:to], sizes[at:to], strict=True)]
        at = to
    return parts


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sorted sets have a Jaccard similarity of 0.8 or more."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 5 * shared >= 4 * (len(both) - shared)


class Heads:
    """What a task has read of the sets at some places: heads on demand, sets not at all."""

    def __init__(self, folder: str, places: np.ndarray):
        self.folder, self.places = folder, places.astype(np.int64)
        self.size = np.full(len(places), -1, np.int64)
        self.bits = np.zeros((len(places), 8), np.uint64)

    def _load(self, nodes: np.ndarray) -> None:
        nodes = np.unique(nodes[self.size[nodes] < 0])  # places rise with nodes
        for node, head in zip(nodes.tolist(), _bytes(self.folder, self.places[nodes], np.full(len(nodes), _HEAD)), strict=True):
            self.size[node] = head[:8].copy().view(np.uint64)[0]
            self.bits[node] = head[8:].copy().view(np.uint64)

    def able(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs: whether a similarity of 0.8 is possible. Such sets differ in a ninth of their shingles at most."""
        self._load(np.concatenate([a, b]))
        size, other = self.size[a], self.size[b]
        turned = np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1, dtype=np.int64)
        return (5 * np.minimum(size, other) >= 4 * np.maximum(size, other)) & (9 * turned <= size + other)

    def fitting(self, a: np.ndarray, b: np.ndarray) -> int:
        """How many of some pairs, from the first on, have sets that may be held at once; one at least."""
        total = np.cumsum(_WIDE * (self.size[a] + self.size[b]))
        return max(1, int(np.searchsorted(total, _HELD)))

    def grams(self, nodes: np.ndarray) -> dict[int, np.ndarray]:
        """The sorted hashes of each node's set; nodes in rising order, whose heads are there."""
        found = {}
        for node, data in zip(nodes.tolist(), _bytes(self.folder, self.places[nodes] + _HEAD, _WIDE * self.size[nodes]), strict=True):
            out = np.zeros((len(data) // _WIDE, 8), np.uint8)
            out[:, :_WIDE] = data.reshape(-1, _WIDE)
            found[node] = out.view(np.uint64).ravel()
        return found
