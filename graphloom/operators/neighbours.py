"""Approximate neighbours by a navigable graph: built shard by shard, kept as a table, searched by beams in shards.

Rows are dealt to shards of a bounded size by a hash, one shuffle in all. In a shard the nearest others of each row are found by
products of blocks of rows with the whole shard, so the work of building is the number of rows times the size of a shard. The table of
links (lists, some of their reverses, and a few random ones as long ways) is the index. A search walks the links of each shard from some
of its rows, nearest first, until the beam holds nothing that it has not looked around; many queries take a step at once. The shards'
best meet in one window.

Similarity is the cosine; null vectors take no part, a zero vector is as far from all. Copies are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import written as cut

#: Rows of a shard at most, on average: what one task holds while it builds or searches.
SHARD = 16_384
#: Queries that one task searches in one shard, queries that take a step at once, and rows that each of these looks around in a step.
ASKED, TOGETHER, STEP = 4096, 128, 8
#: Rows whose products with a shard are made at once.
ROWS = 512
LONG = 6


def packed(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x): the vector's unit vector as 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
                x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], ["id", "x"])

    v = F.col(vector)
    usable = df.where(v.isNotNull() & F.forall(v, lambda c: c.isNotNull()))
    return usable.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).mapInArrow(run, "id long, x binary")


def _vectors(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Whole groups of consecutive rows with equal values in the first ``by`` columns."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(by)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        at = 0
        for stop in [*cuts.tolist(), b.num_rows]:
            first = tuple(keys[:, at])
            if held and first != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, stop - at))
            now, at = first, stop
    if held:
        yield pa.Table.from_batches(held)


def _near(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities) of the k nearest others of each row, nearest first, ties to the smaller place; -1 where there are fewer."""
    n = len(ids)
    at, sim = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32)
    m = min(k, n - 1)
    for y in range(0, n if m > 0 else 0, ROWS):
        s = x[y : y + ROWS] @ x.T
        s[np.arange(len(s)), np.arange(y, y + len(s))] = -np.inf
        p = np.sort(np.argpartition(-s, m - 1, axis=1)[:, :m], axis=1)
        v = np.round(np.take_along_axis(s, p, axis=1), 6)
        order = np.argsort(-v, axis=1, kind="stable")
        at[y : y + ROWS, :m], sim[y : y + ROWS, :m] = np.take_along_axis(p, order, axis=1), np.take_along_axis(v, order, axis=1)
    return at, sim


def _linked(at: np.ndarray, sim: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to), each once: the lists, up to k rows in whose lists a row is, and LONG random ones, along rings of about 64."""
    n, k = at.shape
    row, place = np.nonzero(at >= 0)
    to = at[row, place]
    order = np.lexsort((row, -sim[row, place], to))
    first = np.searchsorted(to[order], np.arange(n))
    back = order[np.arange(len(order)) - first[to[order]] < k]
    links = [row * n + to, to[back] * n + row[back]]
    rng = np.random.default_rng(seed)
    for _ in range(LONG):
        ring = rng.permutation(n)
        inner = np.arange(n - 1)[np.arange(1, n) % 64 > 0]
        links.append(ring[inner] * n + ring[inner + 1])
    return np.divmod(np.unique(np.concatenate(links)), max(n, 1))


def neighbour_graph(corpus: DataFrame, k: int = 16, id_col: str = "vec_id", vector: str = "embedding", seed: int = 7, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lists, index). lists: shard, id, other, sim, place, the k nearest of each row in its shard. index: shard, id, x, links."""
    x = packed(corpus, id_col, vector)
    x = cut(x.groupBy("id").agg(F.min("x").alias("x")))
    shards = max(1, -(-x.count() // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 1):
            ids, own, v = g["id"].to_numpy(), g["shard"][0].as_py(), _vectors(g["x"])
            at, sim = _near(ids, v, k)
            row, to = _linked(at, sim, seed + own)
            cuts = np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32)
            size = np.concatenate([[0], np.cumsum((at >= 0).sum(axis=1))]).astype(np.int32)
            lists = lambda c, values: pa.ListArray.from_arrays(pa.array(c), pa.array(values))
            made = pa.table([g["shard"], g["id"], g["x"], lists(size, ids[at[at >= 0]]), lists(size, sim[at >= 0]), lists(cuts, ids[to])], ["shard", "id", "x", "near", "sims", "links"])
            yield from made.combine_chunks().to_batches(2048)

    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = x.select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"), "id", "x").repartition(max(n, shards), "shard").sortWithinPartitions("shard", "id")
    made = cut(dealt.mapInArrow(run, "shard int, id long, x binary, near array<long>, sims array<float>, links array<long>"))
    lists = made.select("shard", "id", F.posexplode(F.arrays_zip("near", "sims")).alias("place", "_n"))
    return lists.select("shard", "id", F.col("_n.near").alias("other"), F.col("_n.sims").alias("sim"), (F.col("place") + 1).alias("place")), made.select("shard", "id", "x", "links")


class Walker:
    """The links of a shard, and searches along them. Rows stand by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, links: pa.ListArray, seed: int = 7):
        n, size = len(ids), np.diff(links.offsets.to_numpy())
        self.ids, self.x = ids, x
        # the place after the last one stands for no row
        self.links = np.full((n + 1, max(1, int(size.max(initial=0)))), n, np.int32)
        row = np.repeat(np.arange(n), size)
        self.links[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.searchsorted(ids, links.flatten().to_numpy())
        self.doors = np.random.default_rng(seed).permutation(n)[:64]

    def search(self, q: np.ndarray, own: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, similarities, rows looked at) of the k best of each query, best first, ties to the smaller id, similarity -inf where
        there are fewer; ``own`` are the ids of the queries, which aren't their own answers."""
        n, m = len(self.ids), len(q)
        seen = np.zeros((m, n + 1), bool)
        seen[:, self.doors] = seen[:, n] = True
        best, score = np.full((m, beam), n, np.int64), np.full((m, beam), -np.inf, np.float32)
        looked = np.ones((m, beam), bool)  # around this row of the beam, or there is none
        self._kept(best, score, looked, np.arange(m), np.broadcast_to(self.doors, (m, len(self.doors))), np.einsum("bd,kd->bk", q, self.x[self.doors]))
        live = np.arange(m)
        while len(live := live[~looked[live].all(axis=1)]):
            open_ = np.where(looked[live], -np.inf, score[live])
            take = np.argpartition(-open_, min(STEP, beam) - 1, axis=1)[:, : min(STEP, beam)]
            rows = live[:, None]
            chosen = np.where(np.take_along_axis(open_, take, axis=1) > -np.inf, best[rows, take], n)
            looked[rows, take] = True
            near = np.sort(self.links[chosen].reshape(len(live), -1), axis=1)
            new = ~seen[rows, near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[rows, near] = True
            r, c = np.nonzero(new)
            sim = np.full(near.shape, -np.inf, np.float32)
            sim[r, c] = np.einsum("ij,ij->i", self.x[near[r, c]], q[live[r]])
            self._kept(best, score, looked, live, near, sim)
        score = np.where(self.ids[np.minimum(best, n - 1)] == own[:, None], -np.inf, score)
        order = np.lexsort((best, -score), axis=1)[:, :k]
        return np.take_along_axis(best, order, axis=1), np.take_along_axis(score, order, axis=1), seen[:, :n].sum(axis=1)

    @staticmethod
    def _kept(best: np.ndarray, score: np.ndarray, looked: np.ndarray, rows: np.ndarray, near: np.ndarray, sim: np.ndarray) -> None:
        """Puts rows that were found into the beams of ``rows``, and keeps the best of each."""
        beam = best.shape[1]
        s = np.concatenate([score[rows], sim], axis=1)
        keep = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
        score[rows] = kept = np.take_along_axis(s, keep, axis=1)
        best[rows] = np.take_along_axis(np.concatenate([best[rows], near], axis=1), keep, axis=1)
        looked[rows] = np.take_along_axis(np.concatenate([looked[rows], np.zeros(near.shape, bool)], axis=1), keep, axis=1) | (kept == -np.inf)


def graph_search(queries: DataFrame, index: DataFrame, k: int, beam: int = 160, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, visited): the k nearest that a beam of each shard finds, by exact cosines of 32-bit unit vectors, and
    how many rows were looked at for the query in all shards."""
    q = packed(queries, id_col, vector).dropDuplicates(["id"])
    q = cut(q)
    blocks = max(1, -(-q.count() // ASKED))
    last = index.agg(F.max("shard")).head()[0]
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    # every block of queries meets every shard: as many rows as queries times shards, and shards times blocks
    asked = q.select(F.explode(F.sequence(F.lit(0), F.lit(last or 0))).alias("shard"), block.alias("block"), F.lit(1).alias("kind"), "id", "x", none("links", "array<long>"))
    held = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "id", "x", "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 2):
            kind = g["kind"].to_numpy()
            cut_at = int((kind == 0).sum())
            mine, theirs = g.slice(0, cut_at), g.slice(cut_at)
            if not cut_at or not theirs.num_rows:
                continue
            w = Walker(mine["id"].to_numpy(), _vectors(mine["x"]), mine["links"].combine_chunks())
            asked_ids, vectors = theirs["id"].to_numpy(), _vectors(theirs["x"])
            for y in range(0, len(asked_ids), TOGETHER):
                own = asked_ids[y : y + TOGETHER]
                at, score, visited = w.search(vectors[y : y + TOGETHER], own, k, max(beam, k + 1))
                r, c = np.nonzero(score > -np.inf)
                # what was looked at stands once, with the first answer of a query
                yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(w.ids[at[r, c]]), pa.array(np.round(score[r, c].astype(np.float64), 6)), pa.array(np.where(c == 0, visited[r], 0))], ["query_id", "vec_id", "score", "visited"])

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = held.unionByName(asked).repartition(n, "shard", "block").sortWithinPartitions("shard", "block", "kind", "id")
    found = both.select("shard", "block", "kind", "id", "x", "links").mapInArrow(run, "query_id long, vec_id long, score double, visited long")
    by = Window.partitionBy("query_id")
    found = found.withColumn("visited", F.sum("visited").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "vec_id")))
    return found.where(F.col("place") <= k).select("query_id", "vec_id", "score", "visited")
