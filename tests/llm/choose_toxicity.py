"""Chooses the settings of the toxicity model on rows whose crc32(doc_id) mod 5 is 1 to 4; rows of remainder 0 are not read.

    python tests/llm/choose_toxicity.py [folder of tables]

Each remainder is held out in turn: of the other three, one calibrates and two are counted, as the operator does with its own. A
setting's worth, fixed before the search, is the mean over the four folds of recall less five times the share of
ordinary documents called toxic. Ties go to the setting nearest the beginning of the lists below.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from itertools import product
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from weftline.llm.toxicity import _discounts, calibrate  # noqa: E402

CUTS = ((4, 6, 8), (3, 5, 7), (5, 7, 9))
CUTOFFS = (2, 1, 3, 4)
EPSILONS = (0.02, 0.01, 0.05)


def rows(folder: str) -> list[tuple[int, str, int, int]]:
    import duckdb

    found = duckdb.sql(f"SELECT doc_id, any_value(text), max(toxic) FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id) WHERE toxic IS NOT NULL GROUP BY doc_id ORDER BY doc_id").fetchall()
    return [(i, t or "", c, r) for i, t, c in found if (r := zlib.crc32(str(i).encode()) % 5)]


class Texts:
    """Documents as numbers of words, and words as chains of pieces."""

    def __init__(self, data, cuts):
        self.words: dict[bytes, int] = {}
        self.docs = [np.array([self.words.setdefault(w, len(self.words)) for w in re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())], np.int64) for _, t, _, _ in data]
        bounds = list(zip((0, *cuts), (*cuts, None), strict=True))
        self.chains = [[((level, w[:low], len(w) < low), w[low:high]) for level, (low, high) in enumerate(bounds)] for w in self.words]

    def times(self, members) -> np.ndarray:
        out = np.zeros(len(self.words), np.int64)
        for m in members:
            out += np.bincount(self.docs[m], minlength=len(self.words))
        return out


def word_values(texts: Texts, times: dict[int, np.ndarray], cutoffs) -> dict[int, np.ndarray]:
    """Each word's logarithm of how much likelier the toxic model finds it."""
    count = {c: Counter() for c in times}
    for w, chain in enumerate(texts.chains):
        for c, n in times.items():
            if n[w]:
                for v, x in chain:
                    count[c][v, x] += int(n[w])
    most = _discounts(Counter(n for c in count.values() for n in c.values()))[3]
    low = Counter((v[0], x) for v, x in set(count[0]) | set(count[1]))
    d = _discounts(Counter(low.values()))
    total, kinds, spread = Counter(), Counter(), Counter()
    for (level, _), n in low.items():
        total[level] += n
        kinds[level] += 1
        spread[level] += d[min(n, 3)]
    out = {}
    for cutoff in cutoffs:
        sums, rest = {c: Counter() for c in count}, {c: Counter() for c in count}
        for c in count:
            for (v, _), n in count[c].items():
                sums[c][v] += n
                rest[c][v] += n if n <= cutoff else most

        def p(c, v, x, cutoff=cutoff, sums=sums, rest=rest):
            n = low[v[0], x]
            q = (n - d[min(n, 3)] + spread[v[0]] / (kinds[v[0]] + 1)) / total[v[0]]
            m = count[c][v, x]
            return (m - (m if m <= cutoff else most) + rest[c][v] * q) / sums[c][v] if sums[c][v] else q

        values = np.zeros(len(texts.chains))
        for w, chain in enumerate(texts.chains):
            for v, x in chain:
                if sums[0][v] or sums[1][v]:
                    values[w] += np.log(p(1, v, x) / p(0, v, x))
        out[cutoff] = values
    return out


def main(folder: str) -> None:
    data = rows(folder)
    toxic, rest = np.array([c for _, _, c, _ in data]), np.array([r for *_, r in data])
    found: dict[tuple, list[tuple[float, float]]] = {}
    for cuts in CUTS:
        texts = Texts(data, cuts)
        for fold in (1, 2, 3, 4):
            calibrates = fold % 4 + 1
            counted = {c: texts.times(np.flatnonzero((rest != fold) & (rest != calibrates) & (toxic == c))) for c in (0, 1)}
            for cutoff, values in word_values(texts, counted, CUTOFFS).items():
                for epsilon in EPSILONS:
                    mixed = np.log1p(epsilon * np.expm1(np.minimum(values, 50)))
                    score = np.array([mixed[d].sum() / max(1, len(d)) for d in texts.docs])
                    own = rest == calibrates
                    scale, slope, offset = calibrate(score[own], toxic[own].astype(float), np.ones(own.sum()))
                    called = slope * np.arcsinh(score / scale) + offset >= 0
                    held = rest == fold
                    found.setdefault((cuts, cutoff, epsilon), []).append((called[held & (toxic == 1)].mean(), called[held & (toxic == 0)].mean()))
    worth = {s: np.mean([r - 5 * f for r, f in folds]) for s, folds in found.items()}
    order = list(product(CUTS, CUTOFFS, EPSILONS))
    for s in sorted(order, key=lambda s: (-worth[s], order.index(s))):
        print(s, f"worth {worth[s]:.4f}", "recall, false positives by fold:", " ".join(f"{r:.3f},{f:.4f}" for r, f in found[s]))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
