"""Short items to be found in documents, their word shingles, and the windows of documents that could hold one.

A window that is alike an item shares a shingle with it. So only windows over a shingle of an item need a fingerprint
or a signature; which items they may hold is for the index to say.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from graphloom.llm.arrays import spread, utf8, window_hashes, word_hashes

#: Bytes of item text in one index. More items are taken in blocks of that size, each with its own pass.
BLOCK = 8 << 20


class Items:
    """Items with at least one word; shingle weights are integers, so that sums are exact."""

    def __init__(self, ids: list, texts: list[str], size: int = 5, idf: bool = False):
        data, off = utf8(pa.array(texts, pa.large_string()))
        words, rows = word_hashes(data, off)
        n = np.diff(rows)
        keep = np.flatnonzero(n > 0)
        self.ids, self.n = [ids[i] for i in keep], n[keep]
        self.k = np.minimum(self.n, size)
        self.words = [words[rows[i] : rows[i + 1]] for i in keep]
        self.bags = [window_hashes(w, int(k)) for w, k in zip(self.words, self.k, strict=True)]
        self.distinct = [np.unique(b, return_counts=True) for b in self.bags]
        self.sizes: dict[int, tuple] = {}
        top = np.log1p(max(1, len(self.ids)))
        self.heaviest = int(round(1000 * top)) if idf else 1
        for k in sorted(set(self.k.tolist())):
            own = np.flatnonzero(self.k == k)
            flat = np.concatenate([self.distinct[i][0] for i in own])
            item = np.repeat(own, [len(self.distinct[i][0]) for i in own])
            order = np.argsort(flat, kind="stable")
            keys, first, df = np.unique(flat[order], return_index=True, return_counts=True)
            weight = np.round(1000 * np.log1p(len(self.ids) / df)).astype(np.int64) if idf else np.ones(len(keys), np.int64)
            near = np.zeros(1 << 20, bool)
            near[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.sizes[k] = (near, keys, np.append(first, len(flat)), item[order], weight)
        self.weights = [self.weigh(int(k), d) for k, (d, _) in zip(self.k, self.distinct, strict=True)]
        self.total = np.array([int((w * c).sum()) for w, (_, c) in zip(self.weights, self.distinct, strict=True)], np.int64)

    def weigh(self, k: int, shingles: np.ndarray) -> np.ndarray:
        _, keys, _, _, weight = self.sizes[k]
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        return np.where(keys[at] == shingles, weight[at], self.heaviest)

    def hits(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, k, words of the row, its shingles of k words, places of those that an item has, which of the keys they are)."""
        words, rows = word_hashes(data, off)
        for k, (near, keys, _, _, _) in self.sizes.items():
            sh = window_hashes(words, k)
            p = np.flatnonzero(near[(sh >> np.uint64(44)).astype(np.int64)])
            row = np.searchsorted(rows, p, "right") - 1
            ok = p + k <= rows[row + 1]
            p, row = p[ok], row[ok]
            at = np.minimum(np.searchsorted(keys, sh[p]), len(keys) - 1)
            ok = keys[at] == sh[p]
            p, row, at = p[ok], row[ok], at[ok]
            for lo, hi in _runs(row):
                w0, w1 = int(rows[row[lo]]), int(rows[row[lo] + 1])
                yield int(row[lo]), k, w1 - w0, sh[w0 : w1 - k + 1], p[lo:hi] - w0, at[lo:hi]

    def regions(self, data: np.ndarray, off: np.ndarray, share: float) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, k, item words, window words, starts, shingles of the row, their weights) for each row, k and item length.

        A window starts at word ``start`` of the row. All windows are given of which the shingles that occur in any item
        weigh ``share`` of the lightest item of that length; others can't be alike to an item of it.
        """
        lightest = {(k, n): int(self.total[(self.k == k) & (self.n == n)].min()) for k, n in set(zip(self.k.tolist(), self.n.tolist(), strict=True))}
        for row, k, size, shingles, hit, key in self.hits(data, off):
            length, weight = len(shingles), self.sizes[k][4]
            mass = np.zeros(length + 1, np.int64)
            mass[hit + 1] = weight[key]
            np.cumsum(mass, out=mass)
            weights = None
            _, _, first, item_of, _ = self.sizes[k]
            # an item that shares no shingle with the row is in no window of it
            shared = np.unique(key)
            for n in np.unique(self.n[item_of[spread(first[shared], first[shared + 1] - first[shared])]]).tolist():
                m = min(n, size)
                span = m - k + 1
                if mass[-1] < share * lightest[k, n]:
                    continue
                starts = np.flatnonzero(mass[span:] - mass[: length - span + 1] >= share * lightest[k, n])
                if len(starts):
                    if weights is None:
                        weights = self.weigh(k, shingles)
                    yield row, k, n, m, starts, shingles, weights


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(x):
        cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
        yield from zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def item_blocks(items, id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """All items, in blocks of at most BLOCK bytes of text; each block is what one pass may broadcast."""
    ids, texts, size = [], [], 0
    for r in items.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        if not r[1]:
            continue
        if size and size + len(r[1]) > BLOCK:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
    if ids:
        yield ids, texts


def grouped(pairs: Iterator[tuple]) -> dict:
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
