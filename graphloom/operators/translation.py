"""Relations as translations of vectors: training by margin ranking in shuffled batches, and tails found near head + relation.

Edges are dealt by a hash to parts of a bounded size. In an epoch each part goes through its edges in batches of 256, in an order
and with false ends drawn anew from the seed, from the relation vectors of the last epoch; then the parts' vectors are averaged by
their numbers of edges. Node vectors stay as they are. The number of Spark's partitions changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import seeded_unit
from graphloom.operators import neighbours
from graphloom.session import dropped
from graphloom.session import written as cut

#: Edges of a part, on average, and of a batch.
PART, BATCH = 16_384, 256


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _plus(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def train(edges: DataFrame, vectors: DataFrame, dims: int, epochs: int = 12, rate: float = 0.5, margin: float = 1.0, negatives: int = 5, seed: int = 42) -> DataFrame:
    """(rel, vector): for each relation (in capitals) a unit vector that takes heads to tails. edges: src, rel, tgt; vectors: node, vector.

    Each edge is ranked against ``negatives`` false ones, with the head or the tail changed for a node of the same part; those whose
    distance isn't greater by ``margin`` pull the relation's vector. It starts from the unit vector of its name, and one that never
    errs keeps it. Edges whose ends have no vector don't count.
    """
    h, t = vectors.select(F.col("node").alias("src"), F.col("vector").alias("h")), vectors.select(F.col("node").alias("tgt"), F.col("vector").alias("t"))
    e = cut(edges.select("src", F.upper("rel").alias("rel"), "tgt").dropna().join(h, "src").join(t, "tgt").select("rel", "h", "t", F.xxhash64("src", "rel", "tgt", F.lit(seed)).alias("key")))
    parts = max(1, -(-e.count() // PART))
    e = e.withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    here = cut(e.select("part", "rel").distinct())
    rels = cut(e.select("rel").distinct().select("rel", seeded_unit(dims)("rel").alias("r")))
    for epoch in range(epochs):
        sent = here.join(rels, "rel").select("part", "rel", "r")
        learned = e.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(_epoch(epoch, rate, margin, negatives, seed), "rel string, n long, r array<double>")
        mean = learned.select("rel", "n", F.posexplode("r").alias("i", "x")).groupBy("rel", "i").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"))
        mean = mean.groupBy("rel").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.round("x", 12).alias("x")))), lambda z: z["x"]).alias("v"))
        after = cut(mean.select("rel", F.transform("v", lambda x: x / F.greatest(_length(F.col("v")), F.lit(1e-300))).alias("r")))
        dropped(rels)
        rels = after
    return rels.select("rel", F.col("r").alias("vector"))


def _epoch(epoch: int, rate: float, margin: float, negatives: int, seed: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One pass over a part's edges, from the vectors of its relations."""

    def run(mine: pa.Table, now: pa.Table) -> pa.Table:
        names = now["rel"].to_pylist()
        order = np.lexsort((mine["rel"].to_numpy(zero_copy_only=False).astype(str), mine["key"].to_numpy()))
        place = {n: i for i, n in enumerate(names)}
        which = np.array([place[r] for r in mine["rel"].to_pylist()], np.int64)[order]
        x, y = (np.array(mine[c].to_pylist(), np.float64).reshape(mine.num_rows, -1)[order] for c in ("h", "t"))
        r = np.array(now["r"].to_pylist(), np.float64).reshape(len(names), -1)
        nodes = np.concatenate([x, y])
        rng = np.random.default_rng([seed, epoch, mine["part"][0].as_py()])
        order = rng.permutation(len(which))
        for at in range(0, len(order), BATCH):
            b = np.repeat(order[at : at + BATCH], negatives)
            head = rng.random(len(b)) < 0.5
            false = nodes[rng.integers(0, len(nodes), len(b))]
            pos = x[b] + r[which[b]] - y[b]
            neg = np.where(head[:, None], false + r[which[b]] - y[b], x[b] + r[which[b]] - false)
            dp, dn = (np.sqrt((v * v).sum(axis=1)) + 1e-8 for v in (pos, neg))
            errs = margin + dp - dn > 0
            grad, n = np.zeros_like(r), np.zeros(len(r))
            np.add.at(grad, which[b][errs], (pos / dp[:, None] - neg / dn[:, None])[errs])
            np.add.at(n, which[b][errs], 1)
            moved = n > 0
            r[moved] -= rate * grad[moved] / n[moved, None]
            r[moved] /= np.maximum(np.sqrt((r[moved] ** 2).sum(axis=1, keepdims=True)), 1e-300)
        return pa.table({"rel": pa.array(names, pa.string()), "n": pa.array(np.bincount(which, minlength=len(names)), pa.int64()), "r": pa.array(r.tolist(), pa.list_(pa.float64()))})

    return run


def predicted_tails(asked: DataFrame, relations: DataFrame, vectors: DataFrame, known: DataFrame, k: int, beam: int = 100) -> DataFrame:
    """(src, rel, tgt, distance, score, place): the k tails that a head lacks and that are nearest to head + relation.

    asked: src, rel; relations: rel, vector; vectors: node, vector; known: src, rel, tgt, which are left out, as the head itself is.
    Candidates are found by their direction in a neighbour graph of all nodes, so many more of them as the head's known tails need,
    and then compared by the distance |h + r - t|; the score is 1 / (1 + distance). A relation without a vector asks for nodes like
    the head. Heads without a vector have no answer.
    """
    nodes = cut(vectors.where(F.col("vector").isNotNull()).select("node", "vector").dropDuplicates(["node"]).withColumn("vec_id", F.monotonically_increasing_id()))
    _, index = neighbours.neighbour_graph(nodes, vector="vector")
    q = asked.select("src", F.upper("rel").alias("rel")).distinct().join(nodes.select(F.col("node").alias("src"), F.col("vector").alias("h")), "src")
    q = q.join(relations.select("rel", F.col("vector").alias("r")), "rel", "left")
    q = q.withColumn("to", F.when(F.col("r").isNull(), F.col("h")).otherwise(_plus("h", "r")))
    has = known.select("src", F.upper("rel").alias("rel"), "tgt").distinct()
    lacks = has.groupBy("src", "rel").agg(F.count("*").alias("n"))
    # queries of like needs are searched together: k and the known tails, up to the next power of two
    q = q.join(lacks, ["src", "rel"], "left").withColumn("want", F.pow(F.lit(2.0), F.ceil(F.log2(F.coalesce("n", F.lit(0)) + k + 1))).cast("int"))
    q = cut(q.select("src", "rel", "to", "want").withColumn("id", -1 - F.monotonically_increasing_id()))  # no id of a node
    out = None
    for want in sorted(r.want for r in q.select("want").distinct().collect()):  # a number a power of two
        found = neighbours.graph_search(q.where(F.col("want") == want), index, want, max(beam, want), "id", "to")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return q.select("src", "rel", F.col("src").alias("tgt"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("score"), F.lit(0).alias("place"))
    j = out.select(F.col("query_id").alias("id"), "vec_id").join(q, "id").join(nodes.select("vec_id", F.col("node").alias("tgt"), F.col("vector").alias("t")), "vec_id")
    j = j.where("src <> tgt").join(has, ["src", "rel", "tgt"], "left_anti")
    distance = _length(F.zip_with("to", "t", lambda a, b: a - b)) + 1e-8
    j = j.withColumn("distance", F.round(distance, 6))
    place = F.row_number().over(Window.partitionBy("src", "rel").orderBy("distance", "tgt"))
    return j.withColumn("place", place).where(F.col("place") <= k).select("src", "rel", "tgt", "distance", F.round(1 / (1 + F.col("distance")), 6).alias("score"), "place")


def link_metrics(predicted: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(rel, edges, hits, mrr): of held-out edges (src, rel, tgt), the share whose tail is among the first k, and the mean of 1 / place (0
    if it isn't predicted)."""
    j = held.select("src", F.upper("rel").alias("rel"), "tgt").distinct().join(predicted.select("src", "rel", "tgt", "place"), ["src", "rel", "tgt"], "left")
    hit = F.coalesce(F.col("place") <= k, F.lit(False)).cast("double")
    return j.groupBy("rel").agg(F.count("*").alias("edges"), F.avg(hit).alias("hits"), F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))).alias("mrr"))
