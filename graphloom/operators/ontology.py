"""Class and property hierarchies, typed constraints, translation embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import cut, descendants
from graphloom.operators.owl import entailed  # noqa: F401
from graphloom.operators.translation import train as translations  # noqa: F401
from graphloom.session import dropped


def closure(tree: DataFrame, depth: int = 10) -> DataFrame:
    """(node, ancestor, depth) of a tree (src is under tgt), each node its own ancestor at depth 0."""
    nodes = tree.select(F.col("src").alias("node")).unionAll(tree.select("tgt")).distinct()
    return descendants(tree, depth).select("node", F.col("root").alias("ancestor"), "depth").unionAll(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))


def common_ancestor(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor): the nearest common ancestor of each pair, by summed distance, then name."""
    c = cut(closure(tree))
    j = pairs.join(c.select(F.col("node").alias("a"), "ancestor", F.col("depth").alias("x")), "a").join(c.select(F.col("node").alias("b"), "ancestor", F.col("depth").alias("y")), ["b", "ancestor"])
    return j.groupBy("a", "b").agg(F.min_by("ancestor", F.struct(F.col("x") + F.col("y"), "ancestor")).alias("ancestor"))


def constraint_violations(values: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, property, problem). values: node, property, value. rules: property, most, allowed (array, null: any)."""
    j = values.join(F.broadcast(rules), "property")
    few = j.groupBy("node", "property").agg(F.count_distinct("value").alias("n"), F.first("most").alias("most")).where("n > most").select("node", "property", F.lit("too_many").alias("problem"))
    other = j.where(F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("value"))).select("node", "property", F.lit("not_allowed").alias("problem")).distinct()
    return few.unionByName(other)


def density_groups(vectors: DataFrame, node: str, vector: str, least: int = 5, near: int = 32, exact: bool = False) -> DataFrame:
    """(node, community): clusters of at least ``least`` vectors by density, named by their smallest node; null is noise.

    Vectors count by their directions. Neighbours are the ``near`` nearest, by approximate search or, if ``exact``, by comparing
    all vectors; with all of them the clusters are those of the whole matrix of distances. Fewer than 10 vectors are all noise.
    Null vectors take no part.
    """
    from graphloom.operators.density import density_clusters
    from graphloom.operators.retrieval import knn

    x = cut(vectors.where(F.col(vector).isNotNull()).select(F.col(node).cast("long").alias("node"), F.col(vector).alias("v")))
    if x.limit(10).count() < 10:
        return x.select("node", F.lit(None).cast("long").alias("community"))
    found = knn(x, x, near, "node", "v") if exact else ann_search(x, x, near, id_col="node", vector="v")
    lists = found.select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), F.round(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))), 9).alias("d"))
    return density_clusters(cut(lists), x.select("node"), least)


#: Rows that an index is fitted on, vectors of a block of cells, and queries that meet them in one task, on average.
FITTED, CELL, ASKED = 20_000, 32_768, 65_536
#: Cosines are compared to nine digits; more than this apart they differ.
TIED = 2e-9


def fitted_cells(corpus: DataFrame, k: int, recall: float, id_col: str, vector: str, seed: int) -> tuple[np.ndarray, int]:
    """(centroids, cells to probe), from at most about FITTED rows drawn by a hash of the id: k-means of unit vectors, and as many of
    the nearest cells as hold ``recall`` of the k nearest rows of the sample for 500 of them. In the whole table the k nearest are
    nearer than in a sample, so they are in no more cells."""
    n = max(1, corpus.count())
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40)) < int(min(1.0, FITTED / n) * (1 << 40))
    rows = corpus.where(share).select(F.col(vector).cast("array<double>").alias("v"), F.col(id_col).alias("i")).orderBy("i").limit(2 * FITTED).collect()
    if not rows:
        return np.empty((0, 0)), 0
    x = np.array([r.v for r in rows])
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    rng = np.random.default_rng(seed)
    cells = min(len(x), max(1, min(1024, int(2 * n**0.5))))
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(8):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    own, asked = (x @ c.T).argmax(axis=1), rng.choice(len(x), min(500, len(x)), replace=False)
    sim = x[asked] @ x.T
    sim[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-sim, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[asked] @ c.T), axis=1), axis=1)
    depth = np.sort(place[np.arange(len(asked))[:, None], own[near]].ravel())
    return c, int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1 if len(depth) else 1


def ann_search(queries: DataFrame, corpus: DataFrame, k: int, recall: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """(query_id, vec_id, score): approximate neighbours by cosine, never itself: every row of the corpus lies in the cell of its
    nearest centroid, a query looks into so many of its nearest cells as ``recall`` needs by a sample, and scores are exact.

    Cells are packed into blocks of about CELL rows, a larger cell is dealt over several. A query goes once to each block with a cell of
    its own, meets the rows of its cells only, and brings back its k best of the block, so that what is shuffled grows with the
    rows times blocks, whatever the number of cells looked into. Null vectors, and those with a null, take no part.
    """
    from graphloom.operators.retrieval import ranked

    c, q = (cut(df.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))) for df in (corpus, queries))
    centroids, probes = fitted_cells(c, k, recall, "id", "v", seed)
    none = "query_id long, vec_id long, score double"
    if not probes:
        return corpus.sparkSession.createDataFrame([], none)
    kind = c.schema["v"].dataType.simpleString()

    def placed(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    b = whole.slice(at, 2048)
                    near = _units(b.column(1)) @ centroids.T
                    cells = near.argmax(axis=1)[:, None] if most == 1 else np.argpartition(-near, most - 1, axis=1)[:, :most]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells.tolist(), pa.list_(pa.int32()))], ["id", "v", "cells"])

        return run

    own = cut(c.mapInArrow(placed(1), f"id long, v {kind}, cells array<int>").select("id", "v", F.col("cells")[0].alias("cell")))
    size = dict.fromkeys(range(len(centroids)), 0) | {r.cell: r.n for r in own.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # as many as centroids
    first, parts, block, held = {}, {}, 0, 0
    for cell, n in size.items():
        parts[cell] = max(1, -(-n // CELL))
        if held and held + n > CELL:
            block, held = block + 1, 0
        first[cell], held = block, held + n
        if parts[cell] > 1:
            block, held = block + parts[cell], 0
    at = F.array(*[F.lit(first[cell]) for cell in sorted(first)])
    many = F.array(*[F.lit(parts[cell]) for cell in sorted(first)])
    groups = max(1, -(-q.count() // ASKED))
    rows = own.select(F.get(at, "cell").alias("block"), F.get(many, "cell").alias("parts"), "cell", "id", "v")
    rows = rows.select((F.col("block") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "cell", "id", "v")
    bounds = {b: [cell for cell in first if first[cell] <= b < first[cell] + parts[cell]] for b in range(block + 1)}

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and block, with the query's cells there."""
        mine = {b: np.array(cells, np.int64) for b, cells in bounds.items() if cells}
        for whole in placed(min(probes, len(centroids)))(batches):
            probed = np.zeros((whole.num_rows, len(centroids)), bool)
            probed[np.repeat(np.arange(whole.num_rows), min(probes, len(centroids))), whole.column(2).flatten().to_numpy()] = True
            for b, cells in mine.items():
                r = np.flatnonzero(probed[:, cells].any(axis=1))
                if len(r):
                    some = whole.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), b, np.int32)), some.column(0), some.column(1), pa.array([np.packbits(x).tobytes() for x in probed[r][:, cells]], pa.binary())], ["block", "id", "v", "cells"])

    asked = q.mapInArrow(asking, f"block int, id long, v {kind}, cells binary").withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if a.num_rows and b.num_rows:
            cell, ids, y = b["cell"].to_numpy(), b["id"].to_numpy(), _units(b["v"].combine_chunks())
            cells, m = bounds[b["block"][0].as_py()], min(k, len(ids))
            place, short = np.searchsorted(cells, cell), np.ascontiguousarray(y.T.astype(np.float32))
            by_id, off = np.argsort(ids, kind="stable"), (y.shape[1] + 2) * 2.5e-7  # by so much a product of short vectors may be off
            some_of = np.arange(0, len(ids), max(1, min(64, len(ids) // (4 * m))))
            every, other = np.empty((64, len(ids)), np.float32), np.empty((64, len(ids)), np.float32)
            for lo in range(0, a.num_rows, 64):
                some = a.slice(lo, 64)
                qs, x = some["id"].to_numpy(), _units(some["v"].combine_chunks())
                sim, less = every[: len(qs)], other[: len(qs)]
                bits = np.unpackbits(np.frombuffer(b"".join(some["cells"].to_pylist()), np.uint8).reshape(len(qs), -1), axis=1)
                np.matmul(x.astype(np.float32), short, out=sim)
                np.take(np.where(bits[:, : len(cells)], np.float32(0), np.float32(-4)), place, axis=1, out=less, mode="clip")
                sim += less
                start, stop = (np.searchsorted(ids, qs, side, sorter=by_id) for side in ("left", "right"))
                r = np.repeat(np.arange(len(qs)), stop - start)
                sim[r, by_id[start[r] + np.arange(len(r)) - np.searchsorted(r, r)]] = -4
                # the k-th of the best of some rows each is at most the k-th of all
                top = np.maximum.reduceat(sim, some_of, axis=1)
                kth = np.partition(top, len(some_of) - m, axis=1)[:, len(some_of) - m]
                r, col = np.divmod(np.flatnonzero(sim >= np.maximum(kth - 2 * off - TIED, -2).astype(np.float32)[:, None]), len(ids))
                score = np.concatenate([np.empty(0), *[np.einsum("ij,ij->i", x[r[at : at + 50_000]], y[col[at : at + 50_000]]) for at in range(0, len(r), 50_000)]])
                score = np.round(score, 9)
                order = np.lexsort((ids[col], -score, r))
                r, col, score = r[order], col[order], score[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k  # copies are ties: only the smallest ids go on
                out.append((qs[r[keep]], ids[col[keep]], score[keep]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    scored = asked.groupBy("block", "group").cogroup(rows.groupBy("block", "group")).applyInArrow(best, none)
    return ranked(scored, "query_id", "score", "vec_id", k).drop("rank")


def _units(column: pa.Array) -> np.ndarray:
    x = np.array(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


#: Predicates that name a resource, the best first.
NAMES = ("http://www.w3.org/2004/02/skos/core#prefLabel", "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2004/02/skos/core#altLabel")
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def label_candidates(triples: DataFrame) -> DataFrame:
    """(uri, label, hint): one candidate for each named resource: its best kind of label (the first by name), and the last
    part of its type in capitals, CONCEPT where it has none. triples: s, p, o."""
    order = F.when(F.col("p") == NAMES[0], 0).when(F.col("p") == NAMES[1], 1).when(F.col("p") == NAMES[2], 2)
    named = triples.where(F.col("p").isin(*NAMES)).groupBy(F.col("s").alias("uri")).agg(F.min_by("o", F.struct(order, "o")).alias("label"))
    typed = triples.where((F.col("p") == TYPE) & ~F.col("o").endswith("NamedIndividual")).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("_t"))
    hint = F.upper(F.regexp_extract("_t", r"([^/#]+)/*$", 1))
    return named.join(typed, "uri", "left").select("uri", "label", F.coalesce(hint, F.lit("CONCEPT")).alias("hint"))


def relations_of(triples: DataFrame, entity: str) -> DataFrame:
    """(s, p, o) of one entity, but for its types, labels and comments."""
    return triples.where((F.col("s") == entity) & ~F.col("p").isin("type", "label", "comment")).select("s", "p", "o")


def subclass_pairs(triples: DataFrame, root: str | None = None) -> DataFrame:
    """(s, p, o) of subClassOf, only those right under ``root`` where one is given."""
    pairs = triples.where(F.col("p") == "subClassOf")
    return (pairs if root is None else pairs.where(F.col("o") == root)).select("s", "p", "o")


def confident(edges: DataFrame, least: float) -> DataFrame:
    """(s, p, o) of edges (src, rel, tgt, confidence) of at least this confidence."""
    return edges.where(F.col("confidence") >= least).select(F.col("src").alias("s"), F.col("rel").alias("p"), F.col("tgt").alias("o"))
