"""Clusters of vectors by density: a minimum spanning tree of mutual reachability, its condensed tree, and the clusters of
most stability.

The spanning tree comes from Boruvka rounds: each part takes its least edge that leaves it, and parts that are joined so
become one, named by its root. Along a chain of least edges the heights fall, so each part may hang from the root itself,
at its own height, without changing what is joined at any height. What results is a tree of as many levels as there were
rounds, and after each node has been hung from its first ancestor of greater height, everything below a node was joined
before the node itself. All later steps are aggregations and joins along that tree of logarithmic depth: nothing walks the
spanning tree edge by edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import dropped
from graphloom.session import written as cut

#: Heights are cut into about so many ranges, in which running sums along a node's joins are taken.
RANGES = 64
#: Vectors that are equal are this far apart, as far as densities go.
NEAREST = 1e-9


def reachability(lists: DataFrame, least: int) -> DataFrame:
    """(u, v, w), u < v: distances that are at least both ends' distances to their ``least``-th neighbour. lists: a, b, d."""
    r = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    core = cut(lists.withColumn("r", r).where(F.col("r") == least).select(F.col("a").alias("node"), F.col("d").alias("core")))
    one = lists.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "d").where("u <> v").groupBy("u", "v").agg(F.min("d").alias("d"))
    ends = one.join(core.select(F.col("node").alias("u"), F.col("core").alias("cu")), "u").join(core.select(F.col("node").alias("v"), F.col("core").alias("cv")), "v")
    return ends.select("u", "v", F.greatest("d", "cu", "cv").alias("w"))


def spanning_tree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(c, p, w): each node but one hangs from another at a height, as the minimum spanning tree of (u, v, w) joins them.

    Parts that no edge joins are joined at infinity.
    """
    e, found = cut(edges.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b"))), None
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "a", "b"))
        pick = cut(both.groupBy(F.col("u").alias("c")).agg(F.min_by(F.struct(F.col("v").alias("to"), "w"), F.struct("w", "a", "b")).alias("m")).select("c", "m.to", "m.w"))
        back = pick.select(F.col("c").alias("to"), F.col("to").alias("back"))
        hang = cut(pick.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"), "w"))
        root = _jumped(hang.select("c", "p"))
        own = cut(root.join(hang.where("c <> p").select("c", "w"), "c").select("c", "p", "w"))
        found = own if found is None else found.unionByName(own)
        at = lambda end, root=root: root.select(F.col("c").alias(end), F.col("p").alias(f"r{end}"))
        moved = e.join(at("u"), "u").join(at("v"), "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"), "w", "a", "b")
        new = cut(moved.groupBy("u", "v").agg(F.min(F.struct("w", "a", "b")).alias("m")).select("u", "v", "m.*"))
        dropped(e, pick, hang)
        e = new
    found = nodes.select(F.col("node").alias("c")).where("false").select("c", F.col("c").alias("p"), F.lit(0.0).alias("w")) if found is None else found
    found = cut(found)
    tops = cut(nodes.select(F.col("node").alias("c")).join(found.select("c"), "c", "left_anti"))
    first = tops.agg(F.min("c").alias("p"))
    return cut(found.unionByName(tops.join(F.broadcast(first), F.col("c") > F.col("p")).select("c", "p", F.lit(float("inf")).alias("w"))))


def _jumped(pointers: DataFrame) -> DataFrame:
    """(c, p) with each pointer followed to its end, a row that points to itself; a pointer's steps double in each round."""
    now = cut(pointers)
    while True:
        far = now.select(F.col("c").alias("p"), F.col("p").alias("q"))
        new = cut(now.join(far, "p").select("c", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
        dropped(now)
        now = cut(new.select("c", "p"))
        done = new.where("moved").isEmpty()
        dropped(new)
        if done:
            return now


def ordered(tree: DataFrame) -> DataFrame:
    """The same joins, each node hung from its first ancestor of a greater height; of joins at one height none is below another."""
    up, now = tree.select(F.col("c").alias("p"), F.col("p").alias("q"), F.col("w").alias("pw")), tree
    while True:
        lift = F.col("pw").isNotNull() & (F.col("w") >= F.col("pw"))
        new = cut(now.join(up, "p", "left").select("c", F.when(lift, F.col("q")).otherwise(F.col("p")).alias("p"), "w", lift.alias("moved")))
        done = new.where("moved").isEmpty()
        if now is not tree:
            dropped(now_at)
        now_at, now = new, new.select("c", "p", "w")
        if done:
            return now


def sizes(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(c, size): how many nodes hang from each, itself included; sums go up in steps that double."""
    now = cut(nodes.select(F.col("node").alias("c")).join(tree.select("c", F.col("p").alias("up")), "c", "left").select("c", "up", F.lit(1).cast("long").alias("size")))
    while not now.where("up IS NOT NULL").isEmpty():
        gain = now.where("up IS NOT NULL").groupBy(F.col("up").alias("c")).agg(F.sum("size").alias("more"))
        over = now.where("up IS NOT NULL").join(now.select(F.col("c").alias("up"), F.col("up").alias("next")), "up").select("c", "next")
        new = cut(now.join(gain, "c", "left").join(over, "c", "left").select("c", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        dropped(now)
        now = new
    return now.select("c", "size")


def _before(events: DataFrame, value: str, name: str) -> DataFrame:
    """``events`` (p, w, ...) with the sum of ``value`` over a node's earlier events; taken in ranges of w, then over these."""
    steps = events.where("w < double('infinity')").agg(F.percentile_approx("w", [i / RANGES for i in range(1, RANGES)], 10_000).alias("q")).head()[0] or []
    cuts = F.array(*[F.lit(float(s)) for s in sorted(set(steps))]) if steps else F.array().cast("array<double>")
    e = events.withColumn("_r", F.size(F.filter(cuts, lambda x: x < F.col("w"))))
    earlier = Window.partitionBy("p", "_r").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    total = e.groupBy("p", "_r").agg(F.sum(value).alias("_t"))
    below = Window.partitionBy("p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a node at most
    total = total.select("p", "_r", F.coalesce(F.sum("_t").over(below), F.lit(0)).alias("_t"))
    e = e.withColumn("_own", F.coalesce(F.sum(value).over(earlier), F.lit(0))).join(total, ["p", "_r"])
    return e.withColumn(name, F.col("_own") + F.col("_t")).drop("_own", "_t", "_r")


def condensed(tree: DataFrame, size: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, kids, homes) of an ordered tree.

    clusters: key, stability of the clusters of at least ``least`` nodes, without that of all nodes. kids: key, parent.
    homes: node, key, the smallest cluster that a node is in. A cluster is named by the node along which it was joined, and how
    many clusters there were along it before.
    """
    named = tree.join(size, "c").select("c", "p", "w", "size", (F.col("size") >= least).alias("big"))
    named = cut(named)
    total = named.groupBy("p", "w").agg(F.sum("size").alias("all"), F.sum(F.when(~F.col("big"), F.col("size")).otherwise(0)).alias("small"), F.count_if("big").alias("bigs"), F.min(F.when(F.col("big"), F.col("c"))).alias("one"))
    e = cut(_before(total, "all", "earlier"))
    self_big = F.col("earlier") + 1 >= least
    parties = F.col("bigs") + self_big.cast("int")
    after = F.col("earlier") + 1 + F.col("all")
    new = (parties >= 2) | ((parties == 0) & (after >= least))
    adopt = (parties == 1) & ~self_big
    e = e.select("p", "w", "small", "bigs", "one", (F.col("earlier") + 1).alias("begin"), after.alias("after"), self_big.alias("self_big"), new.alias("new"), adopt.alias("adopt"), (new | adopt).cast("long").alias("start"))
    e = cut(_before(e, "start", "seg").withColumn("seg", F.col("seg") + F.col("start")))
    key = lambda v, s: F.concat(F.col(v).cast("string"), F.lit("/"), (F.col(s) if isinstance(s, str) else s).cast("string"))
    last = cut(e.groupBy(F.col("p").alias("c")).agg(F.max("seg").alias("top")).where("top > 0").select("c", key("c", "top").alias("top")))
    # a small component that joins one cluster goes on under that cluster's name
    same = e.where("adopt").select(key("p", "seg").alias("c"), F.col("one")).join(last.select(F.col("c").alias("one"), "top"), "one").select("c", F.col("top").alias("p"))
    ends = same.select(F.col("p").alias("c")).join(same.select("c"), "c", "left_anti").distinct()
    same = _jumped(same.unionAll(ends.select("c", F.col("c").alias("p"))))
    real = lambda df, c: df.join(same.select(F.col("c").alias(c), F.col("p").alias("_real")), c, "left").withColumn(c, F.coalesce("_real", c)).drop("_real")

    rate = 1 / F.greatest(F.col("w"), F.lit(NEAREST))
    leaves = F.when(F.col("new"), F.col("after")).when(F.col("adopt"), F.col("begin") + F.col("small")).otherwise(F.col("small"))
    lost = real(e.where(F.col("after") >= least).select(key("p", "seg").alias("key"), leaves.alias("n"), rate.alias("rate")), "key")
    lost = lost.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rate")).alias("mass"))
    split = e.where(F.col("new") & (F.col("bigs") + F.col("self_big").cast("int") >= 2))
    own = split.where("self_big").select(key("p", F.col("seg") - 1).alias("key"), key("p", "seg").alias("parent"), rate.alias("rate"))
    other = named.where("big").join(split.select("p", "w", "seg"), ["p", "w"]).join(last, "c").select(F.col("top").alias("key"), key("p", "seg").alias("parent"), rate.alias("rate"))
    born = cut(real(real(own.unionByName(other), "key"), "parent"))
    clusters = cut(lost.join(born, "key").select("key", (F.col("mass") - F.col("rate") * F.col("n")).alias("stability")))

    # where a node's own component first was in a cluster: along itself, along its parent, or further up
    whole = size.where(F.col("size") >= least).select(F.col("c").alias("node"), F.concat(F.col("c").cast("string"), F.lit("/1")).alias("key"))
    small = named.where("NOT big").join(e.select("p", "w", "after", "seg"), ["p", "w"])
    met = small.where(F.col("after") >= least).select(F.col("c").alias("node"), key("p", "seg").alias("key"))
    on = small.where(F.col("after") < least).select("c", "p")
    stops = on.select(F.col("p").alias("c")).join(on.select("c"), "c", "left_anti").distinct()
    on = _jumped(on.unionAll(stops.select("c", F.col("c").alias("p"))))
    direct = cut(whole.unionByName(met))
    later = on.where("c <> p").select(F.col("c").alias("node0"), F.col("p").alias("node")).join(direct, "node").select(F.col("node0").alias("node"), "key")
    return clusters, born.select("key", "parent"), cut(real(direct.unionByName(later), "key"))


def most_stable(clusters: DataFrame, kids: DataFrame) -> DataFrame:
    """(key, chosen): the chosen cluster that each cluster is in or is; null if none. A cluster is chosen when it has as much
    stability as the best choice below it, and none above it is. clusters: key, stability; kids: key, parent.

    A round settles the clusters without open kids and, at once, the chains of clusters with one open kid each that end in one of
    them: along a chain the best is max(s, b + best of its end), in steps that double. So each round leaves at most half of the
    clusters with several open kids.
    """
    open_ = cut(clusters.join(kids, "key", "left").select("key", "parent", "stability", F.lit(0.0).alias("below")))
    done = None
    while not open_.isEmpty():
        waits = open_.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n"), F.min("key").alias("down"))
        now = open_.join(waits, "key", "left").select("key", F.when(F.col("n").isNull(), F.greatest("stability", "below")).otherwise(F.col("stability")).alias("s"), F.col("below").alias("b"), F.when(F.col("n") == 1, F.col("down")).alias("down"), F.col("n").isNull().alias("known"))
        best = _along(now).where("known").select("key", F.col("s").alias("best"))
        ready = cut(open_.join(best, "key").select("key", "parent", "stability", "best"))
        done = ready if done is None else done.unionByName(ready)
        given = ready.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.sum("best").alias("more"))
        new = cut(open_.join(ready.select("key"), "key", "left_anti").join(given, "key", "left").select("key", "parent", "stability", (F.col("below") + F.coalesce("more", F.lit(0.0))).alias("below")))
        dropped(open_)
        open_ = new
    if done is None:
        return clusters.select("key", F.lit(None).cast("string").alias("chosen"))
    below = done.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.sum("best").alias("below"))
    done = done.join(below, "key", "left").select("key", "parent", (F.col("stability") >= F.coalesce("below", F.lit(0.0))).alias("good"))
    # the highest good cluster on the way up, over twice as many steps in each round
    now = cut(done.select("key", F.col("parent").alias("up"), F.when(F.col("good"), F.col("key")).alias("chosen")))
    while not now.where("up IS NOT NULL").isEmpty():
        above = now.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("chosen").alias("higher"))
        new = cut(now.join(above, "up", "left").select("key", F.col("next").alias("up"), F.coalesce("higher", "chosen").alias("chosen")))
        dropped(now)
        now = new
    return now.select("key", "chosen")


def _along(now: DataFrame) -> DataFrame:
    """(key, s, b, down, known) with each chain of ``down`` followed: s is the best where the end is known, else the best is
    max(s, b + best of ``down``)."""
    now = cut(now)
    while True:
        end = now.select(F.col("key").alias("down"), F.col("s").alias("ds"), F.col("b").alias("db"), F.col("down").alias("next"), F.col("known").alias("dknown"))
        moves = F.coalesce(F.col("dknown") | F.col("next").isNotNull(), F.lit(False))
        go = lambda c, other: F.when(moves, c).otherwise(F.col(other)).alias(other)  # noqa: B023, E731
        new = now.join(end, "down", "left").select("key", go(F.greatest(F.col("s"), F.col("b") + F.col("ds")), "s"), go(F.col("b") + F.col("db"), "b"), go(F.col("next"), "down"), (F.col("known") | (moves & F.col("dknown"))).alias("known"), moves.alias("moved"))
        new = cut(new)
        dropped(now)
        done, now = new.where("moved").isEmpty(), new
        if done:
            return now.drop("moved")


def density_clusters(lists: DataFrame, nodes: DataFrame, least: int = 5) -> DataFrame:
    """(node, community): clusters of at least ``least`` nodes, named by their smallest node; null is noise.

    lists: a, b, d, the nearest others of each node and their distances, at least ``least`` of each. With all distances the
    result is that of the whole matrix; with fewer, what the lists don't join is joined at infinity.
    """
    tree = cut(ordered(spanning_tree(cut(reachability(lists, least)), nodes)))
    clusters, kids, homes = condensed(tree, cut(sizes(tree, nodes)), least)
    chosen = most_stable(clusters, kids)
    held = cut(homes.join(chosen, "key").where("chosen IS NOT NULL").select("node", "chosen"))
    name = held.groupBy("chosen").agg(F.min("node").alias("community"))
    return nodes.select("node").join(held.join(name, "chosen").select("node", "community"), "node", "left")
