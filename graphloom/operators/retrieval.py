"""Retrieval and ranking: exact nearest neighbours, BM25, rank fusion, MMR, metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as T
from graphloom.session import written as cut

#: Queries that a k-nearest search broadcasts at once; more are taken block by block.
QUERY_BLOCK = 20_000
#: Cosines are compared to nine digits; more than this apart they differ.
TIED = 2e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length, in doubles; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def knn(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", within: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, place): the k rows of ``corpus`` with the largest cosine, ties to the smaller id; never itself.
    With ``within``, only rows that have the query's value in that column; a null has none.

    Each block of queries is broadcast to the corpus, each batch of the corpus keeps for every query what can be among the k best
    that its task has seen, and these meet in one window per query. With ``within`` only rows of one value are multiplied. Scores are exact; queries
    of any number are taken in blocks, whose results are written one after the other, so that the driver holds one block at a time.
    """
    spark = corpus.sparkSession
    out, w = None, Window.partitionBy("query_id").orderBy(F.desc("rounded"), "vec_id")
    kind = F.lit(0).cast("long") if within is None else F.when(F.col(within).isNotNull(), F.xxhash64(within))
    q = queries.select(F.col(id_col).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"), kind.alias("g")).where("v IS NOT NULL AND g IS NOT NULL")
    blocks = -(-max(1, q.count()) // QUERY_BLOCK)
    for b in range(blocks):
        part = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).collect()  # at most about QUERY_BLOCK vectors
        shared = spark.sparkContext.broadcast((np.array([r.q for r in part], np.int64), np.array([r.v for r in part], np.float64), np.array([r.g for r in part], np.int64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors, groups = shared.value
            if not len(ids):
                return
            order = np.argsort(groups, kind="stable")
            ids, x, groups = ids[order], _normal(vectors)[order], groups[order]
            least = np.full(len(ids), -np.inf)  # the task has seen k rows of so much
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    batch = whole.slice(at, 4096)
                    every, kinds = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                    z = _normal(np.array(batch.column(1).to_pylist(), np.float64))
                    for g in np.unique(kinds):  # queries meet the rows of their own group only
                        first, stop = np.searchsorted(groups, g), np.searchsorted(groups, g, "right")
                        own, y = every[kinds == g], z[kinds == g]
                        for lo in range(first, stop, 1024):
                            hi = min(lo + 1024, stop)
                            sim = x[lo:hi] @ y.T
                            sim[ids[lo:hi, None] == own[None]] = -np.inf
                            some = np.flatnonzero((sim.max(axis=1) >= least[lo:hi]) & (sim.max(axis=1) > -np.inf))
                            if not len(some):
                                continue
                            sim, q = sim[some], lo + some
                            if len(own) >= k:
                                kth = sim.max(axis=1) if k == 1 else -np.partition(-sim, k - 1, axis=1)[:, k - 1]
                                least[q] = np.maximum(least[q], kth - TIED)
                            r, c = np.nonzero((sim >= least[q][:, None]) & (sim > -np.inf))
                            yield pa.RecordBatch.from_arrays([pa.array(ids[q[r]]), pa.array(own[c]), pa.array(sim[r, c])], ["query_id", "vec_id", "score"])

        found = corpus.select(F.col(id_col).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"), kind.alias("g")).where("v IS NOT NULL AND g IS NOT NULL").mapInArrow(run, "query_id long, vec_id long, score double")
        found = found.withColumn("rounded", F.round("score", 9)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("rounded")
        if blocks > 1:
            found = cut(found)
            shared.destroy()
        out = found if out is None else out.unionAll(found)
    return out


def _normal(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a query. Null texts are empty.

    Only terms of the queries are kept from the documents before anything is shuffled; the counts of those are written
    once and read for the document frequencies and for the scores.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    q = cut(queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("term")))
    d = docs.select(F.col(doc_id).alias("doc_id"), tokens(body).alias("t"))
    size = F.regexp_count(F.lower(body), F.lit(r"[\p{L}\p{N}]+"))  # as many as there are tokens
    stats = docs.select(size.alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = d.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    tf = cut(tf.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = df.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "mean")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return tf.join(weight, "term").select("term", "doc_id", part.alias("part")).join(q, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


#: About so many unlike openings of a language are in a block.
OPENINGS = 16_384


def near_openings(docs: DataFrame) -> DataFrame:
    """(a, b, ratio): all pairs of documents (doc_id, text, lang) of one language, a < b, whose openings are near.

    Unlike openings meet once in one cell of a square of blocks, where a bound that loses none spares most pairs the exact ratio; the
    documents of each are joined to what is found. The ratio depends on the order of the two, so both are taken. There are as many
    blocks as keep OPENINGS in each, so a cell's memory doesn't grow with the documents; the pairs, and the time, grow with their square.
    """
    x = cut(docs.select("doc_id", T.opening("text").alias("x"), "lang"))
    one = cut(x.select("lang", "x").distinct())
    most = one.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    side = max(2 * max(1, math.isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), -(-most // OPENINGS))
    one = one.withColumn("block", F.pmod(F.xxhash64("x"), F.lit(side)).cast("int"))
    cells = one.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    cells = cells.select("lang", F.least("block", "cell").alias("i"), F.greatest("block", "cell").alias("j"), (F.col("block") > F.col("cell")).alias("second"), "x")

    def met(t: pa.Table) -> pa.Table:
        second, text = t["second"].to_numpy(), t["x"].to_pylist()
        left, right = ([text[r] for r in np.flatnonzero(second == v)] for v in (False, True))
        found = T.near_texts(left, left if t["i"][0].as_py() == t["j"][0].as_py() else right)
        return pa.table([pa.array([t["lang"][0].as_py()] * len(found), t["lang"].type), *[pa.array(c, ty) for c, ty in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)]], ["lang", "x", "y", "xy", "yx"])

    near = cut(cells.repartition(min(4 * side * side, 2000), "lang", "i", "j").groupBy("lang", "i", "j").applyInArrow(met, f"lang {docs.schema['lang'].dataType.simpleString()}, x string, y string, xy double, yx double"))
    own = lambda text, name: x.select(F.col("doc_id").alias(name), F.col("x").alias(text), F.col("lang").alias(f"l{text}"))
    pairs = near.join(own("x", "p"), ["x"]).where(F.col("lang").eqNullSafe(F.col("lx"))).join(own("y", "q"), ["y"]).where(F.col("lang").eqNullSafe(F.col("ly")) & (F.col("p") != F.col("q")))
    pairs = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.when(F.col("p") < F.col("q"), F.col("xy")).otherwise(F.col("yx")).alias("ratio")).where(F.col("ratio") >= T.NEAR)
    copies = own("x", "a").join(own("x", "b").withColumnRenamed("lx", "l"), ["x"]).where(F.col("lx").eqNullSafe(F.col("l")) & (F.col("a") < F.col("b")))
    return pairs.unionAll(copies.select("a", "b", F.lit(1.0)))


def ranked(df: DataFrame, by: str, score: str, tie: str, k: int | None = None) -> DataFrame:
    """``df`` with a 0-based ``rank``; of ``k`` rows a key at most."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)) - 1)
    return out.where(F.col("rank") < k) if k else out


def fused(lists: list[DataFrame], by: str, item: str, k: int = 60) -> DataFrame:
    """(by, item, score): reciprocal rank fusion, sum of 1 / (k + rank + 1) over the lists (by, item, rank)."""
    u = lists[0].select(by, item, "rank")
    for x in lists[1:]:
        u = u.unionAll(x.select(by, item, "rank"))
    return u.groupBy(by, item).agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def mmr(candidates: DataFrame, by: str, item: str, relevance: str, vector: str, take: int, weight: float = 0.7) -> DataFrame:
    """(by, item, place): greedy maximal marginal relevance; ties to the first by (relevance, item).

    Candidates are a ranked pool of bounded size a key; keep them so with ranked().
    """

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t[relevance].to_pylist(), t[item].to_pylist(), t[vector].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
        x = _normal(np.array([r[2] for r in rows], np.float64))
        rel, worst, left, out = np.array([r[0] for r in rows]), np.full(len(rows), -np.inf), np.ones(len(rows), bool), []
        for _ in range(min(take, len(rows))):
            value = weight * rel - (1 - weight) * np.where(np.isinf(worst), 0, worst)
            i = int(np.argmax(np.where(left, value, -np.inf)))
            out.append(rows[i][1])
            left[i] = False
            worst = np.maximum(worst, x @ x[i])
        return pa.table({by: pa.array([t[by][0].as_py()] * len(out), t[by].type), item: pa.array(out, t[item].type), "place": pa.array(range(1, len(out) + 1), pa.int64())})

    s = candidates.schema
    return candidates.select(by, item, relevance, vector).groupBy(by).applyInArrow(run, f"{by} {s[by].dataType.simpleString()}, {item} {s[item].dataType.simpleString()}, place long")


def retrieval_metrics(got: DataFrame, gold: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """(hit_rate, precision, recall, mrr) over the queries of ``gold``. got: by, item, place (from 1)."""
    j = got.where(F.col("place") <= k).join(gold.select(by, item).distinct(), [by, item]).groupBy(by).agg(F.count("*").alias("hits"), F.min("place").alias("first"))
    return _rates(gold.select(by, item).distinct().groupBy(by).agg(F.count("*").alias("gold")).join(j, by, "left"), k)


def label_metrics(got: DataFrame, queries: DataFrame, items: DataFrame, by: str, item: str, label: str, k: int) -> DataFrame:
    """retrieval_metrics() where all other items of a query's label are its gold. They are counted by label, so that no row is made for
    a query and an item. queries: by, label; items: item, label; a query that is an item bears its id."""
    own, q = items.select(item, label).distinct(), queries.select(by, label).distinct()
    size = own.groupBy(label).agg(F.count("*").alias("_n"))
    self = own.select(F.col(item).alias(by), label, F.lit(1).alias("_self"))
    gold = q.join(size, label).join(self, [by, label], "left").select(by, (F.col("_n") - F.coalesce("_self", F.lit(0))).alias("gold")).where("gold > 0")
    hit = got.where(F.col("place") <= k).join(q, by).join(own, [item, label]).groupBy(by).agg(F.count("*").alias("hits"), F.min("place").alias("first"))
    return _rates(gold.join(hit, by, "left"), k)


def _rates(per: DataFrame, k: int) -> DataFrame:
    per = per.fillna(0, ["hits"])
    return per.agg(F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.col("hits") / k), 6).alias("prec"), F.round(F.avg(F.col("hits") / F.col("gold")), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def reranked(pool: DataFrame, by: str, item: str, doc: str, k: int = 5, floor: int = 2, diverse: int = 3) -> DataFrame:
    """(by, item, place): the ``k`` seeds of each query, place from 1. pool: by, item, doc, rank (of the fused list, from 0),
    score (of a model), code (null, or the place of the document's code in the question).

    1. The k best by score. 2. The ``floor`` first of the fused list come in before them, the weakest of the k give way.
    3. The best of each of the first ``diverse`` documents of the fused list come first (if there are two or more), then the
    others. 4. What the floor brought in moves to the front. 5. Of each document that the question names, the first in the
    fused list that isn't a seed yet goes before all, a later code before an earlier one. Ties of scores go by fused rank.
    """
    q = Window.partitionBy(by)
    row = lambda *order: F.row_number().over(q.orderBy(*order))
    total = lambda c: F.sum(c.cast("int")).over(q)
    p = pool.select(by, item, doc, "rank", "score", "code").withColumn("_rr", row(F.desc("score"), "rank") - 1).withColumn("_k", F.least(F.lit(k), F.count("*").over(q)))
    p = p.withColumn("_floor", (F.col("rank") < floor) & (F.col("_rr") >= k)).withColumn("_n", total(F.col("_floor")))
    p = p.withColumn("_in", F.col("_floor") | (F.col("_rr") < F.col("_k") - F.col("_n"))).withColumn("_pos", row(~F.col("_in"), ~F.col("_floor"), F.when(F.col("_floor"), F.col("rank")).otherwise(F.col("_rr"))))
    p = p.withColumn("_first", F.col(doc).isNotNull() & (F.row_number().over(Window.partitionBy(by, doc).orderBy("rank")) == 1))
    p = p.withColumn("_div", F.col("_first") & (F.sum(F.col("_first").cast("int")).over(q.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) <= diverse))
    p = p.withColumn("_div", F.col("_div") & (total(F.col("_div")) > 1) & (F.col("_k") > 1) & F.lit(diverse > 1))
    p = p.withColumn("_pos", row(F.when(F.col("_div"), 0).when(F.col("_in"), 1).otherwise(2), F.when(F.col("_div"), F.col("rank")).otherwise(F.col("_pos"))))
    p = p.withColumn("_in", (F.col("_div") | F.col("_in")) & (F.col("_pos") <= F.col("_k"))).withColumn("_front", F.col("_floor") & F.col("_in"))
    named = F.row_number().over(Window.partitionBy(by, "code").orderBy("_in", "rank"))
    p = p.withColumn("_named", F.col("code").isNotNull() & ~F.col("_in") & (named == 1))
    out = p.where("_in OR _named").withColumn("place", row(~F.col("_named"), F.desc(F.when(F.col("_named"), F.col("code"))), ~F.col("_front"), "_pos"))
    return out.where(F.col("place") <= F.col("_k")).select(by, item, "place")


def with_hops(seeds: DataFrame, edges: DataFrame, by: str, item: str) -> DataFrame:
    """(by, item, text, via): seeds score 1 - (place - 1) / n; what an edge (src, tgt, score) leads to from a seed, and is none,
    scores its best edge times 1 / n, so that it never beats a seed. ``via`` is the seed it was reached from (null: a seed)."""
    n = F.count("*").over(Window.partitionBy(by))
    s = seeds.select(by, item, "place", n.alias("_n"))
    own = s.select(by, item, (1 - (F.col("place") - 1) / F.col("_n")).alias("text"), F.lit(None).cast(seeds.schema[item].dataType).alias("via"))
    hop = s.join(edges.select(F.col("src").alias(item), "tgt", F.col("score").alias("_s")), item).groupBy(by, F.col("tgt").alias("_t"), "_n").agg(F.max("_s").alias("_s"), F.max_by(item, F.struct("_s", item)).alias("via"))
    new = hop.join(s.select(by, F.col(item).alias("_t")), [by, "_t"], "left_anti").select(by, F.col("_t").alias(item), (F.col("_s") / F.col("_n")).alias("text"), "via")
    return own.unionByName(new)


def tiebroken(scored: DataFrame, by: str, item: str, least: float = 0.4, weight: float = 0.15, top: int = 5) -> DataFrame:
    """(by, item, final, place): ranked by ``final``; where the best of a query is under ``least``, the ``top`` first get up to
    ``weight`` more by their share of the greatest ``authority`` among them. scored: by, item, final, authority."""
    q = Window.partitionBy(by)
    s = scored.withColumn("_r", F.row_number().over(q.orderBy(F.desc("final"), item)))
    most = F.max(F.when(F.col("_r") <= top, F.col("authority"))).over(q)
    weak = F.max("final").over(q) < least
    s = s.withColumn("_final", F.col("final") + F.when(weak & (F.col("_r") <= top) & (most > 0), weight * F.coalesce("authority", F.lit(0.0)) / most).otherwise(0.0))
    order = F.row_number().over(q.orderBy(F.col("_r") > top, F.desc("_final"), item))
    return s.select(by, item, F.col("_final").alias("final"), order.alias("place"))


def community_search(queries: DataFrame, snapshots: DataFrame, k: int, tenant: str, valid_at: Column, known_at: Column) -> DataFrame:
    """(query_id, vec_id, level, score, place): the k nearest communities of a tenant as their summaries stood: valid at one
    moment and known at another, half-open intervals, null ends open. The filters come before the search, so that other
    tenants' communities never crowd out its own. snapshots: vec_id, embedding, level, tenant, valid_from, valid_to,
    known_from, known_to."""
    from graphloom.operators.joins import visible

    seen = snapshots.where(F.col("tenant") == tenant).where(visible("valid_from", "valid_to", valid_at) & visible("known_from", "known_to", known_at))
    return knn(queries, seen, k).join(seen.select("vec_id", "level"), "vec_id").select("query_id", "vec_id", "level", "score", "place")


def direct_context(found: DataFrame, by: str, community: str, summary: str, budget: int) -> DataFrame:
    """(by, community, place, taken, part): summaries of each query's communities in their order under headers, until
    ``budget`` characters are used, headers counted; the last is cut. Blank summaries are left out. found: by, community,
    level, score, place, summary; a bounded number a query."""
    f = found.withColumn("_t", F.trim(F.coalesce(F.col(summary), F.lit("")))).where("_t <> ''")
    head = F.concat(F.lit("[Community "), F.col(community).cast("string"), F.lit(" | Level "), F.col("level").cast("string"), F.lit(" | Similarity "), F.format_string("%.3f", "score"), F.lit("]\n"))
    f = f.withColumn("_h", head).withColumn("_n", F.length("_h") + F.length("_t"))
    w = Window.partitionBy(by).orderBy("place")
    left = budget - (F.sum("_n").over(w) - F.col("_n")) - F.length("_h")
    return f.withColumn("taken", F.least(F.length("_t"), left).cast("int")).where("taken > 0").select(by, community, "place", "taken", F.concat("_h", F.substring("_t", F.lit(1), F.col("taken"))).alias("part"))


def context(pool: DataFrame, by: str, item: str, text: str, k: int = 5, hops: int = 0, least: float = 0.3) -> DataFrame:
    """(by, item, place): what goes into each query's context: by score, ties to the smaller item, an item once, and none whose
    opening is near (0.85) that of one taken before; ``k`` of them. After these up to ``hops`` items that were reached by the
    graph (``hop``) with a graph score of ``least``. pool: by, item, text, score, hop, graph; a bounded pool a query."""

    def run(t: pa.Table) -> pa.Table:
        import difflib

        rows = sorted(zip(*(t[c].to_pylist() for c in (item, text, "score", "hop", "graph")), strict=True), key=lambda r: (-r[2], r[0]))
        taken: list[tuple] = []
        opening = lambda x: " ".join((x or "").lower().split())[:300]

        def fresh(r: tuple) -> bool:
            known = any(r[0] == i for i, _ in taken)
            return not known and all(difflib.SequenceMatcher(None, opening(r[1]), o).ratio() < T.NEAR for _, o in taken)

        for r in rows:
            if len(taken) == k:
                break
            if fresh(r):
                taken.append((r[0], opening(r[1])))
        have = {i for i, _ in taken}
        reached = sorted((r for r in rows if r[3] and (r[4] or 0) >= least and r[0] not in have), key=lambda r: (-r[2], r[0]))
        for r in reached[:hops]:
            if fresh(r):
                taken.append((r[0], opening(r[1])))
        return pa.table({by: pa.array([t[by][0].as_py()] * len(taken), t[by].type), item: pa.array([i for i, _ in taken], t[item].type), "place": pa.array(range(1, len(taken) + 1), pa.int64())})

    kind = pool.schema
    return pool.select(by, item, text, "score", "hop", "graph").groupBy(by).applyInArrow(run, f"{by} {kind[by].dataType.simpleString()}, {item} {kind[item].dataType.simpleString()}, place long")


def ranking_metrics(ranked_items: DataFrame, relevant: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """(by, precision_at_k, recall_at_k, mrr) of each query of either table: hits over the items shown (0 for none), distinct hits
    over the relevant ones (1 where there are none), and 1 over the place of the first hit. ranked_items: by, item, place."""
    top = ranked_items.where(F.col("place") <= k).select(by, item, "place")
    gold = relevant.select(by, item).distinct()
    hit = top.join(gold.withColumn("_hit", F.lit(1)), [by, item], "left").groupBy(by).agg(F.count("*").alias("_shown"), F.count("_hit").alias("_hits"), F.count_distinct(F.when(F.col("_hit") == 1, F.col(item))).alias("_found"), F.min(F.when(F.col("_hit") == 1, F.col("place"))).alias("_first"))
    j = hit.join(gold.groupBy(by).agg(F.count("*").alias("_gold")), by, "full_outer").fillna(0, ["_shown", "_hits", "_found", "_gold"])
    share = lambda a, b, none: F.when(F.col(b) == 0, F.lit(none)).otherwise(F.col(a) / F.col(b))
    return j.select(by, share("_hits", "_shown", 0.0).alias("precision_at_k"), share("_found", "_gold", 1.0).alias("recall_at_k"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"))


#: Queries, documents and dimensions that are multiplied at once in a sparse search.
SPARSE = (1024, 4096, 512)
#: Documents of like dimensions that one bound stands for in a sparse search.
LIKE = 32
#: More than rounding to 5 digits moves a score.
NEAR = 1.1e-5


def sparse_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): the k largest inner products of sparse vectors (query_id / doc_id, dim, w), never with itself,
    ties to the smaller doc_id. Queries are packed as one map each in blocks of QUERY_BLOCK, and every document, packed as
    well, meets a block once: no row is made for a shared dimension. A null dimension or weight is none.

    A task keeps for each query what can be among its k best of all that the task has seen. Documents lie in the order of their
    dimensions, after growing samples of them, so that LIKE in a row are alike: what their largest weights would score is a bound,
    and only those that reach a query's k-th score, or tie with it under a smaller doc_id, are multiplied with it. With weights
    that aren't all positive, or many dimensions, all pairs are scored, in tiles.
    """
    given = lambda df: df.where("dim IS NOT NULL AND w IS NOT NULL")
    q = cut(given(queries).groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.collect_list("dim").alias("d"), F.collect_list("w").alias("w")))
    blocks = -(-max(1, q.count()) // QUERY_BLOCK)
    packed, out = given(docs).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("dim", F.col("w").cast("double").alias("w")))).alias("e")), None
    sample = F.ceil(F.log(8.0, F.pmod(F.xxhash64("doc_id"), F.lit(4096)) + 1))
    packed = packed.select("doc_id", F.col("e.dim").alias("d"), F.col("e.w").alias("w")).sortWithinPartitions(sample, F.desc(F.size("d")), "d", "w")
    packed = packed if blocks == 1 else cut(packed)  # each block of queries reads it
    for b in range(blocks):
        part = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()  # at most about QUERY_BLOCK vectors
        dims = sorted({x for r in part for x in r.d})
        at = {x: i for i, x in enumerate(dims)}
        row, col = np.repeat(np.arange(len(part)), [len(r.d) for r in part]), np.array([at[x] for r in part for x in r.d], np.int64)
        shared = docs.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in part], np.int64), dims, row, col, np.array([x for r in part for x in r.w], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, dims, row, col, weight = shared.value
            if not len(ids):
                return
            best, fresh, waiting, seen = _Best(len(ids), k), [], 0, 0
            few = len(dims) <= SPARSE[2] and (not len(weight) or weight.min() > 1e-100)
            if few:
                asked = np.zeros((len(ids), len(dims)))
                asked[row, col] = weight
            for whole in batches:
                lo = 0
                while lo < whole.num_rows:
                    step = min(SPARSE[1], max(64, 3 * seen))  # few at first, while nothing is ruled out
                    own, j, i, w = _unpacked(whole.slice(lo, step), dims)
                    lo, seen = lo + step, seen + len(own)
                    if few and (not len(w) or w.min() > 1e-100):
                        found = _bounded(ids, asked, own, j, i, w, best)
                    else:
                        found = _in_tiles(ids, row, col, weight, own, j, i, w, best)
                    fresh.append(found)
                    waiting += len(found[0])
                    if waiting > len(best.kept[0]) // 2 or seen <= SPARSE[1]:
                        best.add(fresh)
                        fresh, waiting = [], 0
            best.add(fresh)
            for lo in range(0, len(best.kept[0]), 100_000):
                p, d, x = (v[lo : lo + 100_000] for v in best.kept)
                yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(d), pa.array(x)], ["query_id", "doc_id", "score"])

        found = packed.mapInArrow(run, "query_id long, doc_id long, score double")
        out = found if out is None else out.unionAll(found)
    s = out.withColumn("score", F.round("score", 5))
    return ranked(s, "query_id", "score", "doc_id", k).select("query_id", "doc_id", "score")


class _Best:
    """What can be among the k best of each query: kept (place of the query, document, score); scores from ``least`` on can be, and
    of those up to ``tied`` only documents before ``last``."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k, self.kept = queries, k, [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        self.least, self.tied, self.last = np.full(queries, -np.inf), np.full(queries, -np.inf), np.full(queries, np.iinfo(np.int64).max)

    def add(self, found: list) -> None:
        self.kept, self.least = _kept([np.concatenate(x) for x in zip(self.kept, *found, strict=True)], self.queries, self.k)
        start = np.searchsorted(self.kept[0], np.arange(self.queries + 1))
        full = np.flatnonzero(start[1:] - start[:-1] >= self.k)
        at = start[full][:, None] + np.arange(self.k)
        self.tied[full] = np.round(self.kept[2][at[:, -1]] - 1e-9, 5) + 0.5e-5 - 1e-9 if len(full) else 0
        self.last[full] = self.kept[1][at].max(axis=1) if len(full) else 0

    def fresh(self, place: np.ndarray, document: np.ndarray, score: np.ndarray) -> np.ndarray:
        return (score > self.tied[place]) | (document < self.last[place])


def _bounded(ids: np.ndarray, asked: np.ndarray, own: np.ndarray, j: np.ndarray, i: np.ndarray, w: np.ndarray, best: _Best) -> list[np.ndarray]:
    """(place of the query, document, score) that can be among the best, by a bound for LIKE documents at once; all weights are positive."""
    groups = -(-len(own) // LIKE)
    has = np.zeros((groups * LIKE, asked.shape[1]))
    has[i, j] = w
    has = has.reshape(groups, LIKE, -1)
    first = np.minimum.reduceat(own, np.arange(0, len(own), LIKE))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    bound = has.max(axis=1) @ asked.T
    g, q = np.nonzero(bound >= np.maximum(best.least - 1e-9, 1e-250))
    on = best.fresh(q, first[g], bound[g, q] + 1e-9)
    g, q = g[on], q[on]
    to = np.searchsorted(g, np.arange(groups + 1))
    for n in range(groups):
        if to[n] == to[n + 1]:
            continue
        some = q[to[n] : to[n + 1]]
        sim = asked[some] @ has[n].T
        a, c = np.nonzero(sim >= np.maximum(best.least[some], 1e-250)[:, None])
        p, d, x = some[a], own[np.minimum(n * LIKE + c, len(own) - 1)], sim[a, c]
        ok = (ids[p] != d) & best.fresh(p, d, x)
        found.append((p[ok], d[ok], x[ok]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _in_tiles(ids: np.ndarray, row: np.ndarray, col: np.ndarray, weight: np.ndarray, own: np.ndarray, j: np.ndarray, i: np.ndarray, w: np.ndarray, best: _Best) -> list[np.ndarray]:
    """(place of the query, document, score) that can be among the best, of all pairs, in tiles over the dimensions that both have."""
    rows, _, dims_at_once = SPARSE
    first = np.searchsorted(row, np.arange(0, len(ids) + rows, rows))
    used, j = np.unique(j, return_inverse=True)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    positive = (not len(weight) or weight.min() > 1e-100) and (not len(w) or w.min() > 1e-100)
    for n, q0 in enumerate(range(0, len(ids), rows)):
        mine = slice(first[n], first[n + 1])
        here, r, c, x = min(rows, len(ids) - q0), row[mine] - q0, col[mine], weight[mine]
        to = np.searchsorted(used, c)
        ok = (to < len(used)) & (used[np.minimum(to, len(used) - 1)] == c) if len(used) else np.zeros(len(c), bool)
        r, to, x = r[ok], to[ok], x[ok]
        sim, hit = np.zeros((here, len(own))), np.zeros((here, len(own)), bool)
        for d0 in range(0, len(used), dims_at_once):
            m, o = (to >= d0) & (to < d0 + dims_at_once), (j >= d0) & (j < d0 + dims_at_once)
            left, right = np.zeros((here, min(dims_at_once, len(used) - d0))), np.zeros((min(dims_at_once, len(used) - d0), len(own)))
            left[r[m], to[m] - d0], right[j[o] - d0, i[o]] = x[m], w[o]
            sim += left @ right
            if not positive:  # a product may be zero or less in a shared dimension
                left[r[m], to[m] - d0], right[j[o] - d0, i[o]] = 1, 1
                hit |= left @ right > 0.5
        near = sim >= np.maximum(best.least[q0 : q0 + here], 1e-250 if positive else -np.inf)[:, None]
        a, c = np.nonzero(near if positive else near & hit)
        fresh = ids[q0 + a] != own[c]
        a, c = a[fresh], c[fresh]
        found.append((q0 + a, own[c], sim[a, c]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _unpacked(batch: pa.RecordBatch, dims: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of packed documents, and the place of the dimension, the document's number and the weight of each entry whose dimension
    is one of ``dims``."""
    of = batch.column(1)
    where = pc.index_in(of.flatten(), value_set=pa.array(dims, of.type.value_type))
    i = np.repeat(np.arange(batch.num_rows), pc.list_value_length(of).to_numpy(zero_copy_only=False))
    known = pc.is_valid(where).to_numpy(zero_copy_only=False)
    return batch.column(0).to_numpy(), where.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), i[known], batch.column(2).flatten().to_numpy(zero_copy_only=False)[known]


def _kept(found: list[np.ndarray], queries: int, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of (place of the query, document, score) what can be among the k best of a query once scores are rounded; and the score from
    which on others can be. Of equal scores only the k smallest documents can."""
    order = np.lexsort((found[1], -found[2], found[0]))
    p, d, x = (v[order] for v in found)
    n, new = np.arange(len(p)), np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (x[1:] != x[:-1])
    start = np.searchsorted(p, np.arange(queries + 1))
    least = np.full(queries, -np.inf)
    full = start[1:] - start[:-1] >= k
    least[full] = x[start[:-1][full] + k - 1] - NEAR
    keep = (x >= least[p]) & (n - np.maximum.accumulate(np.where(new, n, 0)) < k)
    return [p[keep], d[keep], x[keep]], least
