"""Graph operators over edge tables (src, rel, tgt, confidence).

Loops run on the driver and move no rows there; each round is written to the shared folder, so that plans stay short
and lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.aggregates import noisy_or
from graphloom.session import ROWS, dealt, dropped, written


#: Written tables in place of checkpoints: a checkpoint keeps the size estimate of its plan, which self-joins square each round.
cut = written


def merged_edges(evidence: DataFrame) -> DataFrame:
    """One edge for each (src, rel, tgt), its confidence from independent documents; a document counts once."""
    per = evidence.groupBy("src", "rel", "tgt", "doc").agg(F.max("confidence").alias("confidence"), F.min("valid_from").alias("valid_from"), F.min("recorded_at").alias("recorded_at"))
    return per.groupBy("src", "rel", "tgt").agg(noisy_or("confidence").alias("confidence"), F.count("*").alias("docs"), F.min("valid_from").alias("valid_from"), F.min("recorded_at").alias("recorded_at"))


def both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    """(u, v, cols...) for each direction of each edge."""
    return edges.select(F.col("src").alias("u"), F.col("tgt").alias("v"), *cols).unionAll(edges.select(F.col("tgt").alias("u"), F.col("src").alias("v"), *cols))


def neighbours(edges: DataFrame) -> DataFrame:
    return both_ways(edges).distinct().groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"), F.min("v").alias("first"))


def paths(edges: DataFrame, seeds: DataFrame, hops: int, per_seed: int | None = None) -> DataFrame:
    """(seed, node, hops, confidence, score) of undirected paths of 1 to ``hops`` edges that repeat no edge.

    Confidence is the product along the path; the score divides it by the length. Edges need (src, rel, tgt,
    confidence). With ``per_seed``, the best of each seed by (score, node, edges).
    """
    e = edges.select(F.xxhash64("src", "rel", "tgt").alias("e"), "src", "tgt", "confidence")
    e = both_ways(e, "e", "confidence").withColumnRenamed("confidence", "c")
    now = seeds.select(F.col("node").alias("seed"), F.col("node").alias("at"), F.array().cast("array<bigint>").alias("used"), F.lit(1.0).alias("confidence"))
    out = None
    for k in range(1, hops + 1):
        now = now.join(e, F.col("at") == F.col("u")).where(~F.array_contains("used", F.col("e"))).select("seed", F.col("v").alias("at"), F.array_append("used", F.col("e")).alias("used"), (F.col("confidence") * F.col("c")).alias("confidence"))
        found = now.withColumn("hops", F.lit(k))
        out = found if out is None else out.unionAll(found)
    out = out.withColumn("score", F.col("confidence") / F.col("hops"))
    if per_seed:
        w = Window.partitionBy("seed").orderBy(F.desc("score"), "at", "used")
        out = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_seed)
    return out.select("seed", F.col("at").alias("node"), "hops", "confidence", "score")


def hop_chunks(seeds: DataFrame, mentions: DataFrame, edges: DataFrame, quarantined: DataFrame, chunks: DataFrame, tenant: str, hops: int = 2, as_of: Column | None = None, known_at: Column | None = None, question: Column | None = None, weight: float = 0.0, per_seed: int = 200, total: int = 500) -> DataFrame:
    """(seed, chunk, via, hops, confidence, score, place): other chunks of a tenant that paths lead to from what the seeds (chunk) mention.

    A path has 1 to ``hops`` edges of the tenant, repeats none, and meets no quarantined node; its edges hold at ``as_of`` and were
    recorded by ``known_at``, where these are given; open ends and unknown times pass. The base score is the product of the
    confidences (1 if unknown) over the length; with a ``question`` (a vector), chunks that have a vector score
    (1 - weight) * base + weight * (1 + cosine) / 2. The ``per_seed`` best of each seed count, of these the ``total`` best.

    mentions: chunk, node; edges: src, rel, tgt, confidence, valid_from, valid_to, recorded_at, tenant; quarantined: node; chunks:
    chunk, tenant, vector. Filters reach the edges before any path is made.
    """
    from graphloom.operators.retrieval import dot, unit

    holds = F.col("tenant") == tenant
    if as_of is not None:
        holds &= (F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of))
    if known_at is not None:
        holds &= F.col("recorded_at").isNull() | (F.col("recorded_at") <= known_at)
    bad = quarantined.select("node").distinct()
    e = edges.where(holds).select("src", "rel", "tgt", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    for end in ("src", "tgt"):
        e = e.join(bad.select(F.col("node").alias(end)), end, "left_anti")
    start = cut(seeds.select("chunk").distinct().join(mentions.select("chunk", "node").distinct(), "chunk").join(bad, "node", "left_anti").select(F.col("chunk").alias("seed"), "node"))
    walk = paths(cut(e), start.select("node").distinct(), hops)
    reached = start.join(walk.select(F.col("seed").alias("node"), F.col("node").alias("via"), "hops", "confidence"), "node").select("seed", "via", "hops", "confidence").distinct()
    others = chunks.where(F.col("tenant") == tenant).join(seeds.select("chunk"), "chunk", "left_anti").select("chunk", "vector")
    found = reached.join(mentions.select("chunk", F.col("node").alias("via")).distinct(), "via").join(others, "chunk")
    base = F.col("confidence") / F.col("hops")
    score = base
    if question is not None and weight > 0:
        like = (1 + dot(unit(F.col("vector")), unit(question))) / 2
        score = F.when(F.col("vector").isNull(), base).otherwise((1 - weight) * base + weight * like)
    found = found.withColumn("score", F.round(score, 9))
    ties = (F.desc("score"), "hops", "chunk", "via", F.desc("confidence"))
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("seed").orderBy(*ties))).where(F.col("_r") <= per_seed)
    best = found.orderBy(*ties, "seed").limit(total)
    place = F.row_number().over(Window.orderBy(*ties, "seed"))  # ``total`` rows
    return best.withColumn("place", place).select("seed", "chunk", "via", "hops", "confidence", "score", "place")


def propagate(edges: DataFrame, seeds: DataFrame, hops: int = 3, least: float = 0.05) -> DataFrame:
    """(node, confidence): the best product of confidences on a path from a seed (1.0); below ``least`` it isn't followed."""
    e = both_ways(edges, "confidence").groupBy("u", "v").agg(F.max("confidence").alias("c"))
    known = seeds.select("node", F.lit(1.0).alias("confidence"))
    for _ in range(hops):
        step = known.join(e, F.col("node") == F.col("u")).select(F.col("v").alias("node"), (F.col("confidence") * F.col("c")).alias("confidence")).where(F.col("confidence") >= least)
        new = cut(known.unionAll(step).groupBy("node").agg(F.max("confidence").alias("confidence")))
        if hasattr(known, "_graphloom_path"):
            dropped(known)
        known = new
    return known


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, score): score = (1 - d) + d * sum of score * weight / outgoing weight, not normalised. edges: src, tgt, weight."""
    e = edges.groupBy("src", "tgt").agg(F.sum("weight").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("all"))
    e = cut(e.join(out, "src").select("src", "tgt", (F.col("w") / F.col("all")).alias("share")))
    score = edges.select(F.col("src").alias("node")).unionAll(edges.select("tgt")).distinct().withColumn("score", F.lit(1 - damping))
    nodes, last = cut(score.select("node")), None
    for k in range(rounds):
        flow = e.join(score, F.col("src") == F.col("node")).groupBy(F.col("tgt").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        score = nodes.join(flow, "node", "left").select("node", ((1 - damping) + damping * F.coalesce("in", F.lit(0.0))).alias("score"))
        if k % 3 == 2:
            score = cut(score)
            if last is not None:
                dropped(last)
            last = score
    return score


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that is reachable; labels spread and jump until they stay."""
    e = cut(both_ways(edges).distinct())
    held = cut(e.groupBy("u").agg(F.least("u", F.min("v")).alias("n")).select(F.col("u").alias("node"), "n"))
    while True:
        label = held.select("node", F.col("n").alias("c"))
        near = e.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("c").alias("m"))
        low = label.join(near, F.col("node") == F.col("u")).select("node", "c", F.least("c", "m").alias("n"))
        jump = label.select(F.col("node").alias("j"), F.col("c").alias("jc"))
        new = cut(low.join(jump, F.col("n") == F.col("j"), "left").select("node", "c", F.least("n", F.coalesce("jc", "n")).alias("n")))
        dropped(held)
        held = new
        if not new.where("c <> n").limit(1).count():
            dropped(e)
            return new.select("node", F.col("n").alias("component"))


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(node, length): the shortest directed cycle through each node, of at most ``longest`` edges."""
    e = edges.select("src", "tgt").where("src <> tgt").distinct()
    walk, found = e.select(F.col("src").alias("start"), F.col("tgt").alias("at")), None
    for k in range(2, longest + 1):
        walk = walk.join(e, F.col("at") == F.col("src")).select("start", F.col("tgt").alias("at")).distinct()
        back = walk.where("start = at").select(F.col("start").alias("node"), F.lit(k).alias("length"))
        found = back if found is None else found.unionAll(back)
        walk = cut(walk.where("start <> at"))
    return found.groupBy("node").agg(F.min("length").alias("length"))


def descendants(edges: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): nodes that reach ``root`` along src -> tgt edges, each at its least depth."""
    e = edges.select("src", "tgt").distinct()
    now = e.select(F.col("tgt").alias("root"), F.col("src").alias("node"))
    out = now.withColumn("depth", F.lit(1))
    for k in range(2, depth + 1):
        now = now.join(e, F.col("node") == F.col("tgt")).select("root", F.col("src").alias("node")).distinct()
        if k % 3 == 0 and now.isEmpty():
            break
        out = out.unionAll(now.withColumn("depth", F.lit(k)))
    return out.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None, back: bool = False) -> DataFrame:
    """(node, depth): what is reached from the seeds (node) along src -> tgt edges, or against them, each at its least depth (0: the
    seeds themselves); to any depth if none is given.

    Each round joins the nodes found last with the edges, so that what is shuffled grows with the answer; the frontier is broadcast
    by Spark while it is small.
    """
    a, b = ("tgt", "src") if back else ("src", "tgt")
    e = edges.select(F.col(a).alias("node"), F.col(b).alias("_to")).where("node IS NOT NULL AND _to IS NOT NULL")
    seen = cut(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    last, k = seen, 0
    while depth is None or k < depth:
        k += 1
        new = cut(last.join(e, "node").select(F.col("_to").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(k)))
        if new.isEmpty():
            dropped(new)
            break
        more = cut(seen.unionByName(new))
        dropped(*({id(t): t for t in (seen, last)}.values()))
        seen, last = more, new
    return seen


def transitive(edges: DataFrame, rel: str, depth: int, decay: float = 0.9) -> DataFrame:
    """Edges of ``rel`` that follow from chains of 2 to ``depth`` and aren't there yet; confidence: best product times decay a step.

    Each step is written, and dealt over as many tasks as its rows need, which degrees tell before the join."""
    base = cut(edges.where(F.col("rel") == rel).groupBy("src", "tgt").agg(F.max("confidence").alias("confidence")))
    step = base.select(F.col("src").alias("m"), F.col("tgt").alias("end"), F.col("confidence").alias("c"))
    now, out, ways = base, None, base.groupBy(F.col("src").alias("tgt")).agg(F.count("*").alias("k"))
    for _ in range(depth - 1):
        made = now.groupBy("tgt").agg(F.count("*").alias("n")).join(ways, "tgt").agg(F.sum(F.col("n") * F.col("k"))).head()[0] or 0
        now = dealt(now.join(step, F.col("tgt") == F.col("m")), made, "src", "end").where(F.col("src") != F.col("end")).groupBy("src", F.col("end").alias("tgt")).agg(F.max(F.col("confidence") * F.col("c") * decay).alias("confidence"))
        now = cut(now)
        out = now if out is None else out.unionAll(now)
    rows = out.count()
    new = dealt(out, rows, "src", "tgt").groupBy("src", "tgt").agg(F.max("confidence").alias("confidence"))
    return new.join(dealt(base.select("src", "tgt"), rows, "src", "tgt"), ["src", "tgt"], "left_anti").select("src", F.lit(rel).alias("rel"), "tgt", "confidence")


def composed(edges: DataFrame, first: str, second: str, derived: str, decay: float = 0.9) -> DataFrame:
    """first o second -> derived, where the derived edge isn't there."""
    a = edges.where(F.col("rel") == first).select("src", F.col("tgt").alias("m"), F.col("confidence").alias("c1"))
    b = edges.where(F.col("rel") == second).select(F.col("src").alias("m"), "tgt", F.col("confidence").alias("c2"))
    new = a.join(b, "m").where("src <> tgt").groupBy("src", "tgt").agg(F.max(F.col("c1") * F.col("c2") * decay).alias("confidence"))
    return new.join(edges.where(F.col("rel") == derived).select("src", "tgt"), ["src", "tgt"], "left_anti").select("src", F.lit(derived).alias("rel"), "tgt", "confidence")


def reversed_missing(edges: DataFrame, rel: str, inverse: str) -> DataFrame:
    """inverse(tgt, src) for each rel(src, tgt) where it isn't there; a symmetric relation is its own inverse."""
    new = edges.where(F.col("rel") == rel).select(F.col("tgt").alias("src"), F.lit(inverse).alias("rel"), F.col("src").alias("tgt"), "confidence")
    return new.join(edges.where(F.col("rel") == inverse).select("src", "tgt"), ["src", "tgt"], "left_anti").select("src", "rel", "tgt", "confidence")


def fixpoint(edges: DataFrame, rules: Sequence, most: int = 5) -> DataFrame:
    """All edges that the rules (functions of the edges) add, round by round, until none is new."""
    known = cut(edges.select("src", "rel", "tgt", "confidence", F.lit(0).alias("round")))
    for k in range(1, most + 1):
        new = None
        for rule in rules:
            r = rule(known)
            new = r if new is None else new.unionByName(r)
        new = cut(new.groupBy("src", "rel", "tgt").agg(F.max("confidence").alias("confidence")).join(known.select("src", "rel", "tgt"), ["src", "rel", "tgt"], "left_anti"))
        if new.isEmpty():
            break
        more = cut(known.unionByName(new.withColumn("round", F.lit(k))))
        dropped(known, new)
        known = more
    return known.where("round > 0")


def adjacency(edges: DataFrame, age_days: Column, half_life: float, least: float) -> DataFrame:
    """(u, v, weight), both ways: edges (src, tgt, confidence, weight) whose decayed confidence is at least ``least``; of
    several the greatest weight, times the smaller hub penalty 1 / log1p(degree) of its ends."""
    decayed = F.col("confidence") * F.exp(-F.log(F.lit(2.0)) / half_life * age_days)
    s = both_ways(edges.where((decayed >= least) & (F.col("src") != F.col("tgt"))), "weight").groupBy("u", "v").agg(F.max("weight").alias("w"))
    deg = s.groupBy("u").agg((1 / F.log1p(F.count("*"))).alias("p"))
    return s.join(deg, "u").join(deg.select(F.col("u").alias("v"), F.col("p").alias("q")), "v").select("u", "v", (F.col("w") * F.least("p", "q")).alias("weight"))


def gcn_layer(adj: DataFrame, x: DataFrame, relu: bool = True) -> DataFrame:
    """(node, dim, value): D^-1/2 (A + I) D^-1/2 x. adj: u, v, weight; x: node, dim, value."""
    loops = x.select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(1.0).alias("weight")).distinct()
    a = adj.select("u", "v", "weight").unionAll(loops)
    deg = a.groupBy("u").agg(F.sum("weight").alias("d"))
    n = a.join(deg, "u").join(deg.select(F.col("u").alias("v"), F.col("d").alias("e")), "v").select("u", "v", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("a"))
    y = n.join(x, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node"), "dim").agg(F.sum(F.col("a") * F.col("value")).alias("value"))
    return y.withColumn("value", F.greatest(F.lit(0.0), "value")) if relu else y


def attention_layer(pairs: DataFrame, x: DataFrame) -> DataFrame:
    """(node, value): each node's mean of its neighbours' and its own scalar, weighted by a softmax of their products."""
    loops = x.select(F.col("node").alias("u"), F.col("node").alias("v"))
    p = pairs.select("u", "v").unionAll(loops).distinct()
    j = p.join(x.select(F.col("node").alias("u"), F.col("value").alias("a")), "u").join(x.select(F.col("node").alias("v"), F.col("value").alias("b")), "v")
    w = F.exp(F.col("a") * F.col("b"))
    return j.groupBy(F.col("u").alias("node")).agg((F.sum(w * F.col("b")) / F.sum(w)).alias("value"))


def isolated_below(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes under the seeds (along tgt <- src) that no node outside of these and the seeds leads to as well."""
    all_ = reachable(edges, seeds, depth, back=True)
    start = seeds.select("node").distinct()
    below = all_.where("depth > 0").select("node")
    # a seed is under the seeds if another edge leads to it from below
    again = edges.join(all_.select(F.col("node").alias("tgt")), "tgt", "left_semi").select(F.col("src").alias("node")).distinct().join(start, "node", "left_semi")
    below = cut(below.unionAll(again).distinct())
    inside = below.unionAll(start).distinct()
    outside = edges.join(inside.select(F.col("node").alias("tgt")), "tgt", "left_anti").select(F.col("src").alias("node"))
    return below.join(outside, "node", "left_anti")


#: At most so many sources are voted for in one task.
CROWD = 2000
#: About so many edges are in memory at once when targets are voted for, and 128 times so many counts of common targets.
CELL = 1_000_000
#: Bytes of packed edges that a task keeps, to read them twice; more of them are sent twice.
HELD = 256 << 20


def missing_tails(edges: DataFrame, rel: str, k: int) -> DataFrame:
    """(src, tgt, score): for each source the k targets it lacks that most of its co-sources have.

    Every other source of a target votes, with the number of targets that it has in common. Sources that share no target, not
    even through others, have nothing to do with each other: groups of a bounded size that no target leads out of are counted
    whole, each edge in one task. What is left is counted for some sources a task, with the edges packed. Edges are shuffled once,
    by their targets, and are then lists of sources.
    """
    e = edges.where(F.col("rel") == rel).select("src", "tgt").dropna()
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = cut(e.repartition(max(partitions, -(-e.count() // ROWS)), "tgt").distinct().groupBy("tgt").agg(F.collect_list("src").alias("sources")))
    homes = lambda home: of.select("tgt", F.explode("sources").alias("src")).join(home, "src").groupBy("tgt")
    # the smallest source within two steps
    home = cut(of.select(F.explode("sources").alias("src"), F.array_min("sources").alias("home")).groupBy("src").agg(F.min("home").alias("home")))
    led = homes(home).agg(F.min("home").alias("home"))
    home = cut(of.join(led, "tgt").select(F.explode("sources").alias("src"), "home").groupBy("src").agg(F.min("home").alias("home")))
    of = cut(of.join(homes(home).agg(F.collect_set("home").alias("homes")), "tgt"))
    n = F.size("sources").cast("long")
    size = of.select(F.explode("homes").alias("home"), (F.size("homes") > 1).alias("open"), n.alias("n")).groupBy("home").agg(F.sum("n").alias("edges"), F.sum(F.col("n") * F.col("n")).alias("pairs"), F.max("open").alias("open"))
    size = cut(size.select("home", "edges", (~F.col("open") & (F.col("edges") <= CELL) & (F.col("pairs") <= 64 * CELL)).alias("whole")))
    total = {r.whole: r.edges for r in size.groupBy("whole").agg(F.sum("edges").alias("edges")).collect()}
    of = of.select("tgt", "sources", F.col("homes")[0].alias("home")).join(size.select("home", "whole"), "home")  # an open target's homes are all open
    out = None
    if True in total:
        blocks = max(-(-4 * total[True] // CELL), partitions)
        mine = of.where("whole").select(F.pmod(F.xxhash64("home"), F.lit(blocks)).alias("block"), "tgt", "sources").repartition(blocks, "block")
        kinds = {c: e.schema[c].dataType.simpleString() for c in ("src", "tgt")}
        out = mine.groupBy("block").applyInArrow(lambda t: _votes_within(_listed(t), k), f"src {kinds['src']}, tgt {kinds['tgt']}, score long")
    if False in total or out is None:
        rest = _votes_between(of.where("NOT whole").select(F.explode("sources").alias("src"), "tgt"), k)
        out = rest if out is None else out.unionByName(rest)
    return out


def _listed(t: pa.Table) -> pa.Table:
    """Edges (src, tgt) of lists of sources (tgt, sources)."""
    sources = t["sources"].combine_chunks()
    return pa.table({"src": sources.flatten(), "tgt": t["tgt"].combine_chunks().take(pc.list_parent_indices(sources))})


def _votes_within(t: pa.Table, k: int) -> pa.Table:
    """(src, tgt, score) of edges (src, tgt) that hold all sources of their targets."""
    t = t.combine_chunks()
    col = lambda c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
    sources, tails = pc.unique(col("src")), pc.unique(col("tgt"))
    tails = tails.take(pc.sort_indices(tails))
    own = pc.index_in(col("src"), value_set=sources).to_numpy(zero_copy_only=False)
    to = pc.index_in(col("tgt"), value_set=tails).to_numpy(zero_copy_only=False)
    order = np.argsort(to, kind="stable")
    owners, to_at = own[order], np.searchsorted(to[order], np.arange(len(tails) + 1))
    order = np.argsort(own, kind="stable")
    own, to = own[order], to[order]
    at = np.searchsorted(own, np.arange(len(sources) + 1))

    def gathered(values: np.ndarray, starts: np.ndarray, who: np.ndarray) -> np.ndarray:
        n = starts[who + 1] - starts[who]
        return values[np.repeat(starts[who] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def summed(places: np.ndarray, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        if len(places) * 8 < n:  # few of many: no array of all
            found, back = np.unique(places, return_inverse=True)
            return found, np.bincount(back, weight, len(found)).astype(np.int64)
        all_ = np.bincount(places, weight, n).astype(np.int64)
        found = np.flatnonzero(all_)
        return found, all_[found]

    who, what, score = [], [], []
    for s in range(len(sources)):
        has = to[at[s] : at[s + 1]]
        peers, common = summed(gathered(owners, to_at, has), len(sources))
        peers, common = peers[peers != s], common[peers != s]
        if not len(peers):
            continue
        n = at[peers + 1] - at[peers]
        if 2 * n.sum() > len(to):
            weight = np.zeros(len(sources))
            weight[peers] = common
            found, votes = summed(to, len(tails), weight[own])
        else:
            found, votes = summed(gathered(to, at, peers), len(tails), np.repeat(common, n))
        fresh = ~np.isin(found, has, assume_unique=True)
        found, votes = found[fresh], votes[fresh]
        if len(found) > k:
            near = votes >= np.partition(votes, len(votes) - k)[len(votes) - k]
            found, votes = found[near], votes[near]
        best = np.lexsort((found, -votes))[:k]
        who += [s] * len(best)
        what += found[best].tolist()
        score += votes[best].tolist()
    return pa.table({"src": sources.take(pa.array(who, pa.int64())), "tgt": tails.take(pa.array(what, pa.int64())), "score": pa.array(score, pa.int64())})


def _votes_between(e: DataFrame, k: int) -> DataFrame:
    """(src, tgt, score) of distinct edges (src, tgt) of any number.

    Edges are packed in blocks of targets, each target with the numbers of its sources. A task takes some sources, whose counts of
    common targets with all others are one matrix, and reads the blocks twice: to count, and to add up the counts of each
    target's sources. No table of pairs is made; what is shuffled are the packed edges, once a task.
    """
    s = cut(e.groupBy("src").agg(F.count("*").alias("n")))
    all_ = s.agg(F.count("*").alias("sources"), F.sum("n").alias("edges"), F.max("n").alias("most")).head()
    count, edges = all_.sources, all_.edges or 0
    rows = max(1, -(-count // min(CROWD, max(1, 128 * CELL // max(1, count)))), min(count, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    columns = max(1, -(-4 * edges // CELL))
    s = s.select("src", F.pmod(F.xxhash64("src"), F.lit(rows)).cast("int").alias("row"))
    size = dict.fromkeys(range(rows), 0) | {r.row: r.n for r in s.groupBy("row").agg(F.count("*").alias("n")).collect()}  # as many as tasks
    first = np.cumsum([0, *[size[r] for r in range(rows)]]).tolist()
    place = F.get(F.array(*[F.lit(x) for x in first]), "row") + F.row_number().over(Window.partitionBy("row").orderBy("src")) - 1
    number = cut(s.select("src", place.cast("int").alias("place")))
    wide = np.uint16 if count <= 1 << 16 else np.int32
    kinds = {c: e.schema[c].dataType.simpleString() for c in ("src", "tgt")}

    def packed(t: pa.Table) -> pa.Table:
        tails = pc.unique(t["tgt"].combine_chunks())
        tails = tails.take(pc.sort_indices(tails))
        to, own = pc.index_in(t["tgt"].combine_chunks(), value_set=tails).to_numpy(zero_copy_only=False), t["place"].to_numpy()
        order = np.lexsort((own, to))
        at = np.searchsorted(to[order], np.arange(len(tails) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array([0, len(tails)], pa.int32()), tails)
        return pa.table({"block": t["block"][:1], "tails": lists, "at": pa.array([at.tobytes()]), "owners": pa.array([own[order].astype(wide).tobytes()])})

    blocks = e.join(number, "src").select(F.pmod(F.xxhash64("tgt"), F.lit(columns)).cast("int").alias("block"), "place", "tgt")
    blocks = cut(blocks.groupBy("block").applyInArrow(packed, f"block int, tails array<{kinds['tgt']}>, at binary, owners binary"))
    twice = edges * np.dtype(wide).itemsize > HELD
    sent = blocks.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("again", F.explode(F.array(*[F.lit(x) for x in ([False, True] if twice else [False])])))
    sent = sent.select("row", "again", "tails", "at", "owners").repartitionById(rows, "row")
    sent = sent.sortWithinPartitions("again") if twice else sent
    common = np.uint16 if (all_.most or 0) < 1 << 16 else np.uint32

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes, held = None, []
        for b in batches:
            for r in range(b.num_rows):
                tails = b.column("tails")[r].values
                block = tails, np.frombuffer(b.column("at")[r].as_buffer(), np.int32), np.frombuffer(b.column("owners")[r].as_buffer(), wide)
                if votes is None:
                    row = b.column("row")[r].as_py()
                    votes = _Votes(first[row], first[row + 1], count, common, k)
                if b.column("again")[r].as_py():
                    votes.cast(*block)
                else:
                    votes.count(*block[1:])
                    if not twice:
                        held.append(block)
        for block in held:
            votes.cast(*block)
        if votes is not None and votes.best is not None:
            yield from votes.best.select(["place", "tgt", "score"]).to_batches()

    found = sent.mapInArrow(vote, f"place int, tgt {kinds['tgt']}, score long")
    return found.join(number, "place").select("src", "tgt", "score")


class _Votes:
    """The k best targets of the sources from ``lo`` to ``hi`` of ``count``. All blocks of targets are counted, then all are cast."""

    def __init__(self, lo: int, hi: int, count: int, kind: type, k: int):
        self.lo, self.hi, self.k, self.most = lo, hi, k, None
        self.common = np.zeros((count, hi - lo), kind)
        self.least, self.best = np.ones(hi - lo, np.int64), None

    def count(self, at: np.ndarray, owners: np.ndarray) -> None:
        """Adds up in ``common`` how many targets each source has in common with those of the task."""
        own = np.flatnonzero((owners >= self.lo) & (owners < self.hi))
        of = np.searchsorted(at, own, "right") - 1
        n = (at[of + 1] - at[of]).astype(np.int64)
        flat, wide = self.common.reshape(-1), self.hi - self.lo
        for some in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(n) // (4 * CELL))) + 1):
            m = n[some]
            p = owners[np.repeat(at[of[some]] - np.cumsum(m) + m, m) + np.arange(m.sum())].astype(np.int64)
            np.add.at(flat, p * wide + np.repeat(owners[own[some]].astype(np.int64) - self.lo, m), 1)

    def cast(self, tails: pa.Array, at: np.ndarray, owners: np.ndarray) -> None:
        """Votes for the targets of a block, those of as many sources together."""
        wide, k = self.hi - self.lo, self.k
        if self.most is None:
            self.common[np.arange(self.lo, self.hi), np.arange(wide)] = 0  # no vote for oneself
            self.most = int(self.common.max(initial=0))
        degree = np.diff(at)
        order = np.argsort(degree, kind="stable")
        who, what, score = [], [], []
        for run in np.split(order, np.flatnonzero(np.diff(degree[order])) + 1):
            m = int(degree[run[0]])
            kind = np.uint16 if self.most * m < 1 << 16 else np.int64
            step = max(1, (256 << 10) // (2 * max(1, wide)))
            for some in (run[x : x + step] for x in range(0, len(run), step)):
                sources = owners[at[some][:, None] + np.arange(m)]
                votes = self._sum(sources, kind)
                r, c = np.nonzero((sources >= self.lo) & (sources < self.hi))
                votes[r, sources[r, c].astype(np.int64) - self.lo] = 0
                near = votes >= np.minimum(self.least, np.iinfo(kind).max).astype(kind)
                if len(some) > k and np.count_nonzero(near) > 4 * k * wide:  # many tie: the k best of these, then the smallest
                    key = (votes.astype(np.int64) << 32) + (0xFFFFFFFF - some.astype(np.int64))[:, None]
                    key = np.partition(key, len(some) - k, axis=0)[len(some) - k :]
                    self.least = np.maximum(self.least, key[0] >> 32)
                    x, c = np.nonzero(key >> 32 >= self.least)
                    who, what, score = [*who, c], [*what, 0xFFFFFFFF - (key[x, c] & 0xFFFFFFFF)], [*score, key[x, c] >> 32]
                else:
                    x, c = np.nonzero(near)
                    who, what, score = [*who, c], [*what, some[x]], [*score, votes[x, c].astype(np.int64)]
        if who:
            self._add(np.concatenate(who), tails.take(pa.array(np.concatenate(what))), np.concatenate(score))

    def _sum(self, sources: np.ndarray, kind: type) -> np.ndarray:
        if sources.shape[1] > 4096:
            return np.array([sum(self.common[s[x : x + 4096]].sum(axis=0, dtype=np.int64) for x in range(0, len(s), 4096)) for s in sources]).astype(kind)
        votes, more = self.common[sources[:, 0]].astype(kind), np.empty((len(sources), self.hi - self.lo), self.common.dtype)
        for c in range(1, sources.shape[1]):
            np.take(self.common, sources[:, c], axis=0, out=more, mode="clip")
            np.add(votes, more, out=votes, casting="unsafe")
        return votes

    def _add(self, who: np.ndarray, what: pa.Array, score: np.ndarray) -> None:
        ok = score >= self.least[who]
        new = pa.table({"place": pa.array(who[ok].astype(np.int32) + np.int32(self.lo)), "tgt": what.filter(pa.array(ok)), "score": pa.array(score[ok])})
        both = new if self.best is None else pa.concat_tables([self.best, new])
        both = both.take(pc.sort_indices(both, [("place", "ascending"), ("score", "descending"), ("tgt", "ascending")])).combine_chunks()
        place = both["place"].to_numpy() - self.lo
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        full = rank == self.k - 1
        self.least[place[full]] = both["score"].to_numpy()[full]
        self.best = both.filter(pa.array(rank < self.k))


#: Weights become whole numbers of this unit, so that sums don't depend on the order of rows.
UNIT = 1 << 20


def _symmetric(edges: DataFrame) -> DataFrame:
    """(u, v, w) both ways, w in whole units; several edges between two nodes are one."""
    one = edges.where("src <> tgt AND weight > 0").select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), F.round(F.col("weight") * UNIT).cast("long").alias("w"))
    one = one.groupBy("src", "tgt").agg(F.sum("w").alias("w")).where("w > 0")
    return cut(both_ways(one, "w"))


def _coin(node: str, *salt: int) -> Column:
    """A number in [0, 1) for each node, from a hash."""
    return F.pmod(F.xxhash64(node, *[F.lit(s) for s in salt]), F.lit(1 << 30)) / float(1 << 30)


def _quality(e: DataFrame, label: DataFrame, degree: DataFrame, resolution: float, whole: int) -> float:
    """Modularity of a partition: label (node, c), degree (node, k), e (u, v, w) with loops."""
    inside = e.join(label.select(F.col("node").alias("u"), F.col("c").alias("cu")), "u").join(label.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv").agg(F.sum("w").alias("w"))
    sizes = label.join(degree, "node").groupBy("c").agg(F.sum("k").cast("decimal(19,0)").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("s"))
    r = inside.crossJoin(sizes).head()
    return (r.w or 0) / whole - resolution * float(r.s or 0) / whole / whole


def _gains(e: DataFrame, who: DataFrame, label: DataFrame, degree: DataFrame, resolution: float, whole: int) -> DataFrame:
    """(node, own, c, gain): what each of ``who`` gains in each neighbouring community, and in its own, without itself in it."""
    size = label.join(degree, "node").groupBy("c").agg(F.sum("k").alias("inside"), F.count("*").alias("members"))
    near = e.where("u <> v").join(who.select(F.col("node").alias("u")), "u").join(label.select(F.col("node").alias("v"), "c"), "v").groupBy(F.col("u").alias("node"), "c").agg(F.sum("w").alias("w"))
    own = label.join(who.select("node"), "node", "left_semi").join(degree, "node").select("node", F.col("c").alias("own"), "k")
    option = near.unionByName(own.select("node", F.col("own").alias("c"), F.lit(0).cast("long").alias("w"))).groupBy("node", "c").agg(F.sum("w").alias("w"))
    j = option.join(own, "node").join(size, "c")
    rest = F.col("inside") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0)
    return j.select("node", "own", "c", "members", (F.col("w") - resolution * F.col("k") * rest / whole).alias("gain"))


def _moved(e: DataFrame, label: DataFrame, degree: DataFrame, resolution: float, whole: int, seed: int) -> tuple[DataFrame, bool]:
    """Local moves from a partition until no node gains by one; whether any was made.

    A queue holds the nodes to be looked at: at first all, then those next to a moved node, and those whose turn didn't come.
    A round moves a part of the nodes that gain, drawn by a hash; if modularity falls, as neighbours moved at once, the
    round is undone and a smaller part is drawn. The smallest part is one move for each community at most that it leaves or
    enters, of most gain, which can't fall. So every round that counts raises modularity, and the rounds come to an end.
    """
    queue, now, any_, round_, share, spent = label.select("node"), label, False, 0, 0.5, []
    least = whole * 1e-12  # gains that modularity, as a double, still shows
    q = _quality(e, now, degree, resolution, whole)
    while True:
        g = _gains(e, queue, now, degree, resolution, whole)
        stay = F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay")
        alone = F.max(F.when(F.col("c") == F.col("own"), F.col("members"))).alias("alone")
        best = g.groupBy("node", "own").agg(stay, alone, F.max_by(F.struct("c", "gain", "members"), F.struct("gain", F.col("c") == F.col("own"), F.xxhash64("c", F.lit(seed)))).alias("b"))
        # of two single nodes that would swap, the one of the larger name moves
        swap = (F.col("alone") == 1) & (F.col("b.members") == 1) & (F.col("b.c") > F.col("own"))
        want = cut(best.where((F.col("b.c") != F.col("own")) & (F.col("b.gain") > F.col("stay") + least) & ~swap).select("node", "own", F.col("b.c").alias("c"), (F.col("b.gain") - F.col("stay")).alias("rise")))
        if want.isEmpty():
            dropped(want, *spent)
            return now.select("node", "c"), any_
        while True:
            if share >= 1 / 64:
                go = want.where(_coin("node", seed, round_) < share)
            else:
                rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("rise"), "node"))
                ends = want.select("node", "own", "c", "rise", F.explode(F.array("own", "c")).alias("end"))
                go = ends.withColumn("r", rank("end")).groupBy("node", "own", "c").agg(F.max("r").alias("r")).where("r = 1")
            round_ += 1
            new = cut(now.join(go.select("node", F.col("c").alias("to")), "node", "left").select("node", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")))
            then = _quality(e, new, degree, resolution, whole)
            if then > q:
                break
            dropped(new)
            if share < 1 / 64:  # a gain lost in rounding
                return now.select("node", "c"), any_
            share /= 4
        any_, q, share = True, then, min(0.5, share * 2)
        near = e.join(new.where("moved").select(F.col("node").alias("u"), F.col("c").alias("cu")), "u").join(new.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v").where("cu <> cv").select(F.col("v").alias("node"))
        queue = near.unionByName(want.select("node")).distinct()
        dropped(*spent)
        spent = [want] if now is label else [want, now]
        now = new


def _refined(e: DataFrame, label: DataFrame, degree: DataFrame, resolution: float, whole: int, seed: int) -> tuple[DataFrame, bool]:
    """(node, c): each community built anew from single nodes, so that every part hangs together; whether any two met.

    A node that is well connected to the rest of its community, and still alone, joins the part of most gain that is well
    connected to the rest, too. None joins a node that goes elsewhere in the same round: of two that choose each other the smaller
    stands, and where a node chooses another single one, coins decide who goes.
    """
    k = degree.select("node", "k")
    home = cut(label.join(k, "node").select("node", "c", "k"))
    total = home.groupBy("c").agg(F.sum("k").alias("all"))
    side = lambda end, name: home.select(F.col("node").alias(end), F.col("c").alias(name))
    inner = cut(e.where("u <> v").join(side("u", "cu"), "u").join(side("v", "cv"), "v").where("cu = cv").select("u", "v", "w"))
    cross = inner.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("w"))
    well = lambda w, part: F.col(w) >= resolution * F.col(part) * (F.col("all") - F.col(part)) / whole
    fit = cut(home.join(cross, "node").join(total, "c").where(well("w", "k")).select("node", "c", "k", "all"))
    part, any_, round_ = cut(home.select("node", F.col("node").alias("p"))), False, 0
    while True:
        size = part.join(k, "node").groupBy("p").agg(F.sum("k").alias("pk"), F.count("*").alias("members"))
        held = inner.join(part.select(F.col("node").alias("u"), F.col("p").alias("pu")), "u").join(part.select(F.col("node").alias("v"), F.col("p").alias("pv")), "v").where("pu <> pv")
        out = held.groupBy(F.col("pu").alias("p")).agg(F.sum("w").alias("cut"))
        free = fit.join(part.where("node = p").select("node", "p"), "node").join(size.where("members = 1").select("p"), "p").select("node", "c", "k", "all")
        near = held.join(free.select(F.col("node").alias("u"), "k", "all"), "u").groupBy(F.col("u").alias("node"), "k", "all", F.col("pv").alias("p")).agg(F.sum("w").alias("w"))
        option = near.join(size, "p").join(out, "p").where(well("cut", "pk"))
        gain = F.col("w") - resolution * F.col("k") * F.col("pk") / whole
        best = option.withColumn("gain", gain).where("gain > 0").groupBy("node").agg(F.max_by(F.struct("p", "members"), F.struct("gain", F.xxhash64("p", F.lit(seed)))).alias("b"))
        pick = cut(best.select("node", "b.p", (F.col("b.members") > 1).alias("joined"), (_coin("node", seed, round_, 7) < 0.5).alias("goes")))
        if pick.isEmpty():
            dropped(pick)
            break
        there = pick.select(F.col("node").alias("p"), F.col("p").alias("p2"), F.col("joined").alias("joined2"), F.col("goes").alias("goes2"))
        pair, other = F.col("p2") == F.col("node"), F.col("p2").isNotNull()
        # another single node stands if it has nowhere to go, or its coin says so and it doesn't go for sure
        stands = ~other | (~F.col("joined2") & ~F.col("goes2"))
        go = pick.join(there, "p", "left").where(F.col("joined") | F.when(F.coalesce(pair, F.lit(False)), F.col("node") > F.col("p")).otherwise(F.col("goes") & stands))
        # nor does it stand if it leaves its pair
        leaves = pick.select("node", F.col("p").alias("q")).join(there.select(F.col("p").alias("q"), "p2"), "q").where((F.col("p2") == F.col("node")) & (F.col("node") > F.col("q"))).select(F.col("node").alias("p"))
        go = go.join(leaves, "p", "left_anti").select("node", F.col("p").alias("to"))
        new = cut(part.join(go, "node", "left").select("node", F.coalesce("to", "p").alias("p")))
        any_ = any_ or not new.where("node <> p").isEmpty()  # asked until two have met
        dropped(pick, part)
        part, round_ = new, round_ + 1
    dropped(home, inner, fit)
    return part.select("node", F.col("p").alias("c")), any_


def leiden(edges: DataFrame, resolution: float = 1.0, seed: int = 42, passes: int = 1) -> DataFrame:
    """(node, community) of an undirected graph (src, tgt, weight): Leiden's three phases until none changes anything.

    Nodes move between communities; each community is refined from single nodes; the refined parts become the nodes of a smaller
    graph, which starts from the communities found. Further passes start from the single nodes again, in the communities of
    the pass before, as long as modularity rises (``passes`` at most). Every community hangs together and is named by its smallest node. Weights
    are summed as whole numbers and chance comes from hashes, so the number of partitions changes nothing. Loops, and edges
    without a positive weight, don't count; a node needs an edge.

    At a resolution of 1 at most, a node with one neighbour is never better off without it: such nodes are part of their neighbour
    from the start, so that the many leaves of a hub take no rounds of their own.
    """
    first = _symmetric(edges)
    whole = first.agg(F.sum("w")).head()[0]
    if not whole:
        nodes = first.select(F.col("u").alias("node")).distinct()
        return nodes.select("node", F.col("node").alias("community"))
    hub = cut(_hubs(first, resolution <= 1))
    first = _within(first, hub.withColumnRenamed("hub", "p"))
    nodes = hub.select(F.col("hub").alias("node")).distinct()
    degree = cut(first.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")))
    label, best, quality = cut(nodes.select("node", F.col("node").alias("c"))), None, None
    for p in range(passes):
        member, moved = _pass(first, label, degree, resolution, whole, seed + p)
        if best is not None and not moved:
            break
        # what the moves put together but doesn't hang together falls apart, which never lowers modularity
        a, b = member.select(F.col("node").alias("u"), F.col("c").alias("cu")), member.select(F.col("node").alias("v"), F.col("c").alias("cv"))
        inside = first.join(a, "u").join(b, "v").where("cu = cv").select(F.col("u").alias("src"), F.col("v").alias("tgt"))
        found = cut(member.select("node").join(connected_components(inside), "node", "left").select("node", F.coalesce("component", "node").alias("c")))
        q = _quality(first, found, degree, resolution, whole)
        if best is not None and q <= quality + 1e-9:
            break
        best, quality, label = found, q, found
    best = cut(hub.join(best.select(F.col("node").alias("hub"), "c"), "hub").select("node", "c"))
    return best.join(best.groupBy("c").agg(F.min("node").alias("community")), "c").select("node", "community")


def _hubs(e: DataFrame, fold: bool) -> DataFrame:
    """(node, hub): the one neighbour of each node that has no other, and itself of any other node; of two nodes that have only each
    other the smaller is the hub. e: u, v, w, both ways, without loops."""
    ends = e.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    leaf = F.col("n") == 1
    alone = ends.where(leaf).select(F.col("u").alias("v"), F.lit(True).alias("alone"))
    goes = leaf & (F.col("alone").isNull() | (F.col("v") < F.col("u"))) & F.lit(fold)
    return ends.join(alone, "v", "left").select(F.col("u").alias("node"), F.when(goes, F.col("v")).otherwise(F.col("u")).alias("hub"))


def _within(e: DataFrame, found: DataFrame) -> DataFrame:
    """The edges between the parts p that the nodes are in; those inside a part are its loop. found: node, p."""
    a, b = found.select(F.col("node").alias("u"), F.col("p").alias("pu")), found.select(F.col("node").alias("v"), F.col("p").alias("pv"))
    return cut(e.join(a, "u").join(b, "v").groupBy(F.col("pu").alias("u"), F.col("pv").alias("v")).agg(F.sum("w").alias("w")))


def _pass(first: DataFrame, label: DataFrame, degree: DataFrame, resolution: float, whole: int, seed: int) -> tuple[DataFrame, bool]:
    """(node, c) after moves, refinements and aggregations from a partition of single nodes; whether any node moved."""
    e, member, any_ = first, None, False  # member: a node of the graph, the node p of the small graph that it is in, its community
    while True:
        if member is not None:
            degree = cut(e.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")))
        label, moved = _moved(e, label, degree, resolution, whole, seed)
        any_ = any_ or moved
        part, met = _refined(e, label, degree, resolution, whole, seed)
        found = cut(part.withColumnRenamed("c", "p").join(label, "node"))
        member = cut(found.select("node", "p", "c") if member is None else member.select("node", F.col("p").alias("n")).join(found.withColumnRenamed("node", "n"), "n").select("node", "p", "c"))
        if not met:  # no two nodes of the small graph belong together any more
            return member, any_
        e = _within(e, found)
        label = cut(found.groupBy(F.col("p").alias("node")).agg(F.min("c").alias("c")))


def modularity_of(edges: DataFrame, member: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of a partition (node, community) of an undirected graph (src, tgt, weight)."""
    e = _symmetric(edges)
    degree = e.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
    return _quality(e, member.select("node", F.col("community").alias("c")), degree, resolution, e.agg(F.sum("w")).head()[0])


def community_hierarchy(edges: DataFrame, levels: int = 3, resolution: float = 1.0, least: int = 3, seed: int = 42) -> DataFrame:
    """(node, level, community): communities of the whole graph at each level's resolution, which halves from level to level.
    Communities of fewer than ``least`` nodes are left out."""
    out = None
    for level in range(levels):
        found = cut(leiden(edges, resolution * 0.5**level, seed))
        big = found.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("community")
        found = found.join(big, "community").select("node", F.lit(level).alias("level"), "community")
        out = found if out is None else out.unionByName(found)
    return out


def blended(chunks: DataFrame, links: DataFrame, alpha: float = 0.7, beta: float = 0.3, unnamed: tuple[str, ...] = ("LOCATION",)) -> DataFrame:
    """(item, gnn, final, label): alpha * text + beta * max(0, best similarity of a linked entity); the label is the most
    similar entity, of a kind in ``unnamed`` only where there is no other. chunks: item, text; links: item, entity, kind,
    similarity. An item without links has no label and no graph score."""
    named = F.col("kind").isNull() | ~F.col("kind").isin(*unnamed)
    best = links.groupBy("item").agg(F.max("similarity").alias("_s"), F.max_by("entity", F.struct(named, "similarity", "entity")).alias("label"))
    gnn = F.greatest(F.lit(0.0), F.coalesce("_s", F.lit(0.0)))
    return chunks.join(best, "item", "left").select("item", gnn.alias("gnn"), (alpha * F.col("text") + beta * gnn).alias("final"), "label")
