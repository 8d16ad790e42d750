"""Benchmark decontamination (operator 1): SimHash over item-sized windows, a multi-index for the Hamming search.

A window of a document has as many words as a benchmark item. Its fingerprint has 256 bits, from 5-word shingles
weighted by their inverse frequency among the items. Windows of similarity 0.75 lie 44 bits away on average, with a
deviation of 6, and unlike ones 128; ``RADIUS`` is 62. The index cuts fingerprints into 16 blocks of 16 bits. Two that
differ in at most 62 bits differ in at most 4 in each of 4 blocks at least (13 blocks with 5 or more would be 65 bits),
so an item is a candidate when 4 blocks are that near. No fingerprint within the radius is missed; of fingerprints by
chance one in 250 passes. Candidates are verified by the exact weighted Jaccard similarity (of bags).

Windows that can't reach the threshold, whatever the index says, as too little of their shingles' weight occurs in any
item, are not looked up at all; that loses nothing.

A document is contaminated by an item if some window reaches ``threshold``. Documents with fewer words than an item
are compared whole. Null and wordless texts match nothing, and items without words match nothing; repeated rows each
give their own. Items of fewer than 5 words are one shingle. More items than one block broadcasts are taken in
several passes. Columns of the documents other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrays import mix, slices, spread, trimmed, utf8
from graphloom.llm.windows import Items, item_blocks

THRESHOLD = 0.75
RADIUS = 62
BLOCKS, WIDE = 16, 16
#: A block may differ in so many bits, and so many blocks of a near fingerprint do at most that.
NEAR_BITS = 4
NEAR_BLOCKS = BLOCKS - RADIUS // (NEAR_BITS + 1)
SEEDS = mix(np.arange(1, BLOCKS * WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_bits = np.array([bin(i).count("1") for i in range(1 << WIDE)], np.uint8)
#: Masks of at most NEAR_BITS bits.
NEAR = np.flatnonzero(_bits <= NEAR_BITS).astype(np.uint16)
#: Windows whose fingerprints are made at once stand in so many shingles.
STRETCH = 4096


def fingerprints(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """SimHash of shingles[s : s + span] for each start (ascending), as 16 blocks of 16 bits each."""
    out, at = np.empty((len(starts), BLOCKS), np.uint16), 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, lo + STRETCH)))
        hi = int(starts[to - 1]) + span
        part, w = mix(shingles[lo:hi, None] ^ SEEDS[None]), weights[lo:hi]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(hi - lo, -1), axis=1)
        total = np.zeros((hi - lo + 1, bits.shape[1]), np.int64)
        np.cumsum(np.where(bits == 1, w[:, None], -w[:, None]), axis=0, out=total[1:])
        i = starts[at:to] - lo
        out[at:to] = np.packbits(total[i + span] > total[i], axis=1).view(">u2")
        at = to
    return out


class HammingIndex:
    """All items whose fingerprint is within RADIUS bits of a given one."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.tables, self.probes, self.listed = prints, [], 0, 0
        for b in range(BLOCKS):
            order = np.argsort(prints[:, b], kind="stable")
            values, first = np.unique(prints[order, b], return_index=True)
            place = np.zeros(1 << WIDE, np.int32)  # of a value among those that occur, from 1
            place[values] = np.arange(1, len(values) + 1)
            self.tables.append((values, place, np.append(first, len(order)), order))

    def candidates(self, given: np.ndarray) -> np.ndarray:
        """Items of which NEAR_BLOCKS blocks differ in at most NEAR_BITS bits."""
        hits = np.zeros(len(self.prints), np.uint8)
        for v, (values, place, first, order) in zip(given, self.tables, strict=True):
            # the values near this one: all that there are, looked up, or all that occur, compared; whichever is fewer
            if len(values) > len(NEAR):
                near = place[NEAR ^ v]
                near = near[near > 0] - 1
            else:
                near = np.flatnonzero(_bits[values ^ v] <= NEAR_BITS)
            hits[order[spread(first[near], first[near + 1] - first[near])]] += 1  # an item once a block
        return np.flatnonzero(hits >= NEAR_BLOCKS)

    def search(self, given: np.ndarray) -> np.ndarray:
        near = self.candidates(given)
        self.probes, self.listed = self.probes + 1, self.listed + len(near)
        return near[_bits[self.prints[near] ^ given].sum(axis=1, dtype=np.int64) <= RADIUS]


class Detector:
    def __init__(self, ids: list, texts: list[str], threshold: float):
        self.items, self.threshold = Items(ids, texts, idf=True), threshold
        #: An index for each shingle size; items of another length than the window's are left out of what it finds.
        self.index: dict[int, tuple[np.ndarray, HammingIndex]] = {}
        for k in sorted(set(self.items.k.tolist())):
            own = np.flatnonzero(self.items.k == k)
            bags = [self.items.bags[i] for i in own]
            prints = np.concatenate([fingerprints(b, self.items.weigh(k, b), np.zeros(1, np.int64), len(b)) for b in bags])
            self.index[k] = own, HammingIndex(prints)

    def similarity(self, item: int, shingles: np.ndarray, weights: np.ndarray) -> float:
        """Weighted Jaccard of two bags of shingles."""
        (keys, counts), w = self.items.distinct[item], self.items.weights[item]
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        both = np.minimum(np.bincount(at[keys[at] == shingles], minlength=len(keys)), counts)
        common = int((both * w).sum())
        return common / (int(weights.sum()) + int(self.items.total[item]) - common)

    def scan(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of the best window of each row and item."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for row, k, n, m, starts, shingles, weights in self.items.regions(data, off, self.threshold):
            span = m - k + 1
            own, index = self.index[k]
            for s, given in zip(starts.tolist(), fingerprints(shingles, weights, starts, span), strict=True):
                for i in own[index.search(given)].tolist():
                    if self.items.n[i] != n:
                        continue
                    sim = self.similarity(i, shingles[s : s + span], weights[s : s + span])
                    if sim >= self.threshold and (sim, -s) > best.get((row, i), (0.0, 0, 0))[:2]:
                        best[row, i] = (sim, -s, m)
        return [(row, i, sim, -s, m) for (row, i), (sim, s, m) in best.items()]


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, similarity, first_word, n_words. No shuffle of documents."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id {item_kind}, similarity double, first_word long, n_words long"
    found = None
    for ids, texts in item_blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            detector = Detector(*shared.value, threshold)
            names = pa.array(detector.items.ids)
            for b in slices(batches, text_col):
                rows = sorted(detector.scan(*utf8(b.column(1))))
                if rows:
                    row, item, sim, first, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), names.take(pa.array(item)), pa.array(sim), pa.array(first, pa.int64()), pa.array(n, pa.int64())], [id_col, "item_id", "similarity", "first_word", "n_words"])

        part = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
