"""Leiden communities: connected, no worse than plain Louvain's median, equal over partition counts."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph


def louvain(pairs, resolution, seed):
    """Plain Louvain: nodes in turn, then parts as nodes, until nothing moves."""
    rng, adj = random.Random(seed), {}
    for a, b, w in pairs:
        for x, y in ((a, b), (b, a)):
            adj.setdefault(x, {})
            adj[x][y] = adj[x].get(y, 0.0) + w
    member, whole = {n: n for n in adj}, sum(sum(v.values()) for v in adj.values())
    while True:
        degree = {n: sum(v.values()) for n, v in adj.items()}
        c, total, moved = {n: n for n in adj}, dict(degree), False
        while True:
            any_, order = False, list(adj)
            rng.shuffle(order)
            for n in order:
                to = {}
                for m, w in adj[n].items():
                    if m != n:
                        to[c[m]] = to.get(c[m], 0.0) + w
                total[c[n]] -= degree[n]
                best = max([c[n], *to], key=lambda k: (to.get(k, 0.0) - resolution * degree[n] * total[k] / whole, k == c[n]))
                total[best] += degree[n]
                if best != c[n]:
                    c[n], any_, moved = best, True, True
            if not any_:
                break
        member = {n: c[m] for n, m in member.items()}
        if not moved:
            return member
        new = {}
        for x, v in adj.items():
            for y, w in v.items():
                at = new.setdefault(c[x], {})
                at[c[y]] = at.get(c[y], 0.0) + w
        adj = new


def modularity(pairs, member, resolution):
    whole, inside, total = 2 * sum(w for *_, w in pairs), 0.0, {}
    for a, b, w in pairs:
        inside += 2 * w * (member[a] == member[b])
        for n in (a, b):
            total[member[n]] = total.get(member[n], 0.0) + w
    return inside / whole - resolution * sum((t / whole) ** 2 for t in total.values())


def planted(seed, groups, size, inner, outer):
    rng = random.Random(seed)
    nodes = [(g, i) for g in range(groups) for i in range(size)]
    pairs = [(a, b) for k, a in enumerate(nodes) for b in nodes[:k] if rng.random() < (inner if a[0] == b[0] else outer)]
    return [(f"n{a[0]}-{a[1]}", f"n{b[0]}-{b[1]}", round(rng.uniform(0.2, 1.0), 3)) for a, b in pairs]


def connected(pairs, member):
    near = {}
    for a, b, _ in pairs:
        if member[a] == member[b]:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    for c in set(member.values()):
        own = {n for n in member if member[n] == c}
        todo, seen = [next(iter(own))], set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near.get(n, [])
        if seen != own:
            return False
    return True


@pytest.mark.parametrize(("seed", "shape", "resolution"), [(2, (4, 12, 0.35, 0.06), 0.5)])
def test_connected_and_no_worse_than_louvain(spark, seed, shape, resolution):
    pairs = planted(seed, *shape)
    e = spark.createDataFrame(pairs, "src string, tgt string, weight double").repartition(3)
    got = {r.node: r.community for r in graph.leiden(e, resolution).collect()}
    assert set(got) == {n for p in pairs for n in p[:2]} and all(got[c] == c for c in got.values()) and all(c <= n for n, c in got.items())
    assert connected(pairs, got)
    assert modularity(pairs, got, resolution) >= statistics.median(modularity(pairs, louvain(pairs, resolution, s), resolution) for s in range(9)) - 1e-6
    assert abs(graph.modularity_of(e, graph.cut(spark.createDataFrame(list(got.items()), "node string, community string")), resolution) - modularity(pairs, got, resolution)) < 1e-6


def test_partitions_change_nothing(spark):
    pairs = planted(3, 2, 7, 0.6, 0.15)
    e = spark.createDataFrame(pairs, "src string, tgt string, weight double")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, graph.leiden(e.repartition(n)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_star_hub_loops_and_nothing(spark):
    """A hub with very many leaves is one community; loops and weights of 0 don't count."""
    pairs = [("hub", f"leaf{i}", 1.0) for i in range(300)]
    e = spark.createDataFrame([*pairs, ("hub", "hub", 5.0), ("lone", "lone", 1.0), ("a", "b", 0.0), ("c", None, 1.0)], "src string, tgt string, weight double")
    got = {r.node: r.community for r in graph.leiden(e, 0.5).collect()}
    assert len(got) == 301 and connected(pairs, got)
    assert graph.leiden(e.where(F.lit(False))).count() == 0


def test_leaves_take_no_rounds(spark, monkeypatch):
    """Nodes with one neighbour move with it: rounds see the hubs only, and communities hold the leaves and bear the smallest name."""
    pairs = [(100 * h, 100 * h + i) for h in (1, 2, 3) for i in range(1, 60)] + [(100, 200), (200, 300), (300, 100), (7, 8)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(200, 5, 1.0)], "src long, tgt long, weight double")
    seen, moved = [], graph._moved
    monkeypatch.setattr(graph, "_moved", lambda e, label, *rest: (seen.append(label.count()), moved(e, label, *rest))[1])
    got = {r.node: r.community for r in graph.leiden(e).collect()}
    want = {n: h for h in (100, 300) for n in range(h, h + 60)} | {n: 5 for n in [*range(200, 260), 5]} | {7: 7, 8: 7}
    assert got == want and max(seen) == 4
