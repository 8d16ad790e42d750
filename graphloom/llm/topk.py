"""Exact top-k by inner product over KD-trees (operator 3).

Vectors are dealt to shards; each shard is packed into blocks, and over each block a KD-tree is built: median splits,
tight bounding boxes. A query visits a tree best-first: the bound of a box is the largest inner product that any point
in it could have; boxes below the query's k-th score so far are never opened. A first pass searches the query's own
shard; its k-th score goes along to all the others, where it prunes from the start.

Queries are packed into blocks of bounded size; every shard meets every block of queries. A tree has 1024 to 8192
vectors, so that there are some trees for each core, and trees are dealt in turn to partitions of their own. Vectors
that are null, or hold null, NaN or infinite components take no part. Scores are exact: doubles as long as they stay
under 2**53, 64-bit integers beyond, and Python's integers where a score might pass those. They rank by their exact
value up to 38 digits; the score given is the nearest long, so what is beyond a long is the largest or the smallest one.
A component that a double can't hold after scaling is the largest double. Rows repeated under an id count once (the least vector). Vectors of unlike lengths are read as if
zeros followed the shorter. An empty table has no rows in the result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.shared import Tables, width

LEAF = 128
#: Vectors in a tree, and queries in a block: a row of either stays at a few MB.
LEAST_ROWS, TREE_ROWS = 1024, 8192
BLOCK_ROWS = 1024
EXACT = float(1 << 53)
#: Sums of 64-bit integers stay under this.
WHOLE = float(1 << 62)
LONG = (1 << 63) - 1
#: What a decimal of 38 digits holds.
DIGITS = 10**38 - 1


class Tree:
    """A KD-tree over integer vectors held as doubles. ``opened`` counts the leaves that searches have read."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        with np.errstate(over="ignore"):
            self.reach, self.opened = float(np.abs(self.x).sum(axis=1).max(initial=0)), 0
        self.whole = self.x.astype(np.int64) if self.reach < WHOLE else None
        self.lo, self.hi, self.least, self.kids, self.rows = [], [], [], [], []
        if len(ids):
            self.build(np.arange(len(ids)))
        self.lo, self.hi = np.array(self.lo).reshape(-1, x.shape[1]), np.array(self.hi).reshape(-1, x.shape[1])

    def build(self, rows: np.ndarray) -> int:
        points, me = self.x[rows], len(self.kids)
        lo, hi = points.min(axis=0), points.max(axis=0)
        self.lo.append(lo)
        self.hi.append(hi)
        self.least.append(int(self.ids[rows[0]]))
        self.kids.append(None)
        self.rows.append(rows)
        extent = hi - lo if len(lo) else np.zeros(1)
        axis = int(extent.argmax())
        if len(rows) > LEAF and extent[axis] > 0:
            cut = points[:, axis]
            middle = np.median(cut)
            left = cut < middle if (cut < middle).any() else cut <= middle
            self.kids[me] = (self.build(rows[left]), self.build(rows[~left]))
            self.rows[me] = None
        return me

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each box, or a little more where doubles round."""
        with np.errstate(over="ignore", invalid="ignore"):
            out = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T
            if self.reach * np.abs(queries).max(initial=0) < EXACT:
                return out
            # sums of parts of both signs lose up to so much; what isn't a number may be anything
            lost = np.abs(queries) @ np.maximum(np.abs(self.hi), np.abs(self.lo)).T
            return np.nan_to_num(out + lost * 1e-9 + 1, nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            most = self.reach * np.abs(query).max(initial=0)
        if most < EXACT:
            return self.x[rows] @ query
        if self.whole is not None and most < WHOLE:
            return self.whole[rows] @ query.astype(np.int64)
        q = [int(c) for c in query.tolist()]
        return np.array([sum(int(a) * b for a, b in zip(v, q, strict=True)) for v in self.x[rows].tolist()], object)

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, -id) with a score of ``floor`` at least; the row of id ``own`` is left out."""
        best: list[tuple[float, int]] = []
        if not len(bound):
            return best
        bound = bound.tolist()  # Python compares its integers with doubles exactly
        queue = [(-bound[0], self.least[0], 0)]
        while queue:
            b, least, node = heapq.heappop(queue)
            if -b < floor:
                break
            if len(best) == k and (-b, -least) < best[0]:
                if -b < best[0][0]:
                    break
                continue
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bound[kid] >= floor:
                        heapq.heappush(queue, (-bound[kid], self.least[kid], kid))
                continue
            rows = self.rows[node]
            if (self.lo[node] == self.hi[node]).all():
                rows = rows[: k + 1]  # equal points: those of the least ids, one of which may be the query's own
            self.opened += 1
            score, ids = self.scores(rows, query), self.ids[rows]
            near = np.flatnonzero((score >= max(floor, best[0][0] if len(best) == k else floor)) & (ids != own))
            for s, i in zip(score[near].tolist(), ids[near].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def under(score: float) -> float:
    """The score as a double that isn't greater."""
    if abs(score) < EXACT:
        return float(score)
    score = float(max(-(1 << 1023), min(1 << 1023, score)))
    return score - abs(score) * 1e-9 - 1 if score > -float(1 << 1023) else -np.inf


def unpack(ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(x, np.float64).reshape(len(i), -1) if len(i) else np.empty((0, 0))


def fit(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def quantise(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = np.diff(vectors.offsets.to_numpy())
    with np.errstate(over="ignore"):
        flat = np.nan_to_num(np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)))
    out = np.zeros((len(ids), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return ids.astype(np.int64), out


def pack(vectors: DataFrame, rows: int, scale: float) -> DataFrame:
    """Blocks of up to ``rows`` vectors: block (an id of its own), ids and values packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush(b: pa.Table) -> pa.RecordBatch:
            nonlocal n
            b = b.combine_chunks().to_batches()[0]
            ids, x = quantise(b, scale)
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["block", "ids", "x"])

        count = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                piece = b.slice(at, rows - count)
                held.append(piece)
                count, at = count + piece.num_rows, at + piece.num_rows
                if count == rows:
                    yield flush(pa.Table.from_batches(held))
                    held, count = [], 0
        if held and count:
            yield flush(pa.Table.from_batches(held))

    return vectors.mapInArrow(run, "block long, ids binary, x binary")


def first_pass(packed: DataFrame, every: int, k: int) -> DataFrame:
    """The query rows of each block, with the k-th score that the block itself gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                i, v = unpack(ids, x)
                tree, pick = Tree(i, v), np.flatnonzero(i % every == 0)
                for at in range(0, len(pick), BLOCK_ROWS):
                    p = pick[at : at + BLOCK_ROWS]
                    bound = tree.bounds(v[p])
                    found = [tree.search(v[r], int(i[r]), bound[n], k, -np.inf) for n, r in enumerate(p)]
                    floor = [under(f[0][0]) if len(f) == k else -np.inf for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(i[p]), pa.array(floor, pa.float64()), pa.array([v[r].tobytes() for r in p], pa.binary())], ["query_id", "floor", "q"])

    return packed.select("ids", "x").mapInArrow(run, "query_id long, floor double, q binary")


def query_blocks(queries: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                s = b.slice(at, BLOCK_ROWS)
                q = [np.frombuffer(v, np.float64) for v in s.column(2).to_pylist()]
                x = np.zeros((len(q), max(map(len, q))))
                for r, v in zip(x, q, strict=True):
                    r[: len(v)] = v
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), *(pa.array([y], pa.binary()) for y in (s.column(0).to_numpy().tobytes(), s.column(1).to_numpy().tobytes(), x.tobytes()))], ["query_block", "query_ids", "floors", "q"])

    return queries.mapInArrow(run, "query_block long, query_ids binary, floors binary, q binary")


def second_pass(pairs: DataFrame, k: int) -> DataFrame:
    """Every tree against every block of queries that stands beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for b in batches:
            for r in range(b.num_rows):
                block, ids, x, qids, floors, q = (b.column(c)[r].as_py() for c in range(6))
                qi, f = np.frombuffer(qids, np.int64), np.frombuffer(floors, np.float64)
                qv = np.frombuffer(q, np.float64).reshape(len(qi), -1)
                i, v = unpack(ids, x)
                dims = max(v.shape[1], qv.shape[1])
                if block != now or tree.x.shape[1] != dims:
                    now, tree = block, Tree(i, fit(v, dims))
                qv = fit(qv, dims)
                bound = tree.bounds(qv)
                out = [(int(qi[n]), -i2, Decimal(max(-DIGITS, min(DIGITS, int(s))))) for n in range(len(qi)) for s, i2 in tree.search(qv[n], int(qi[n]), bound[n], k, f[n])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.decimal128(38, 0)), strict=True)], ["query_id", "vec_id", "score"])

    return pairs.select("block", "ids", "x", "query_ids", "floors", "q").mapInArrow(run, "query_id long, vec_id long, score decimal(38,0)")


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k best among all other rows."""
    spark = vectors.sparkSession
    t = Tables(spark, "topk")
    v = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    clean = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    clean = clean.groupBy("vec_id").agg(F.min("v").alias("v"))
    clean = t.write(clean)
    size = min(TREE_ROWS, max(LEAST_ROWS, -(-clean.count() // (4 * width(spark)))))
    packed = t.write(pack(clean, size, scale))
    blocks = t.write(query_blocks(first_pass(packed, every, k).repartition(max(1, width(spark) // 4))))
    # trees are numbered through, and lie in turn in slots; every block of queries goes to every slot
    per = packed.groupBy(F.shiftright("block", 32).alias("part")).agg(F.count("*").alias("n"))
    per = t.write(per.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before")))  # a row a partition
    slots = max(1, min(packed.count(), 4 * width(spark)))
    place = F.col("before") + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)) - 1
    trees = packed.join(per, F.shiftright("block", 32) == F.col("part")).withColumn("slot", F.pmod(place, F.lit(slots)).cast("int"))
    sent = blocks.select("query_ids", "floors", "q", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    found = second_pass(trees.repartitionById(slots, F.col("slot")).join(sent.repartitionById(slots, F.col("slot")).hint("merge"), "slot"), k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.greatest(F.lit(Decimal(-LONG - 1)), F.least(F.lit(Decimal(LONG)), "score")).cast("long").alias("score"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
