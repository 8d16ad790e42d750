"""Density clusters against a brute-force condensed tree."""

import numpy as np
import pytest

from graphloom.operators import density


def brute(d, least):
    """Labels by density from a whole matrix of distances: merges by height, condensed top down, most stable clusters."""
    n = len(d)
    core = np.sort(d, axis=1)[:, least]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    np.fill_diagonal(reach, np.inf)
    parts = {i: [i] for i in range(n)}
    own = list(range(n))
    kids, height = {i: [] for i in range(n)}, {}
    fresh = n
    for w in np.unique(reach[np.isfinite(reach)]):
        pairs = np.argwhere(reach == w)
        links = {}
        for a, b in pairs:
            x, y = own[a], own[b]
            if x != y:
                links.setdefault(x, set()).add(y)
                links.setdefault(y, set()).add(x)
        seen = set()
        for x in list(links):
            if x in seen:
                continue
            group, todo = [], [x]
            while todo:
                t = todo.pop()
                if t not in seen:
                    seen.add(t)
                    group.append(t)
                    todo += links[t]
            parts[fresh] = sum((parts[g] for g in group), [])
            kids[fresh], height[fresh] = group, w
            for i in parts[fresh]:
                own[i] = fresh
            fresh += 1
    rate = lambda h: 1 / max(h, density.NEAREST)
    clusters = {}

    def down(node, key, birth):
        """The clusters below a node of the merge tree that is the top of cluster ``key``."""
        mass, below, members = 0.0, [], set(parts[node])
        while True:
            at = rate(height[node])
            big = [k for k in kids[node] if len(parts[k]) >= least]
            if len(big) == 1:
                mass += (len(parts[node]) - len(parts[big[0]])) * (at - birth)
                node = big[0]
                continue
            mass += len(parts[node]) * (at - birth)
            for k in big:
                down(k, k, at)
                below.append(k)
            clusters[key] = (mass, below, members)
            return

    label = np.full(n, -1)
    if n < least:
        return label
    top = own[0]
    down(top, top, 0.0)
    best, good = {}, {}

    def value(key):
        under = sum(value(k) for k in clusters[key][1])
        good[key] = key != top and clusters[key][0] >= under
        best[key] = clusters[key][0] if good[key] else under
        return best[key]

    def mark(key):
        if good[key]:
            label[list(clusters[key][2])] = min(clusters[key][2])
        else:
            for k in clusters[key][1]:
                mark(k)

    value(top)
    mark(top)
    return label


def points(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims)) * 4
    x = np.concatenate([centres[rng.integers(0, 4, n)] + rng.normal(size=(n, dims)) * rng.choice([0.2, 0.6, 1.5], size=(n, 1)), rng.normal(size=(n // 4, dims)) * 6])
    return np.concatenate([x, x[:7], x[:3]])  # some points twice or three times


@pytest.mark.parametrize(("seed", "n", "dims", "least"), [(1, 90, 2, 5), (2, 140, 3, 4)])
def test_equals_brute_force(spark, seed, n, dims, least):
    x = points(seed, n, dims)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).round(9)
    rows = [(i, j, float(d[i, j])) for i in range(len(x)) for j in range(len(x)) if i != j]
    nodes = spark.createDataFrame([(i,) for i in range(len(x))], "node long")
    got = {r.node: r.community for r in density.density_clusters(spark.createDataFrame(rows, "a long, b long, d double"), nodes, least).collect()}
    want = brute(d, least)
    assert len(got) == len(x) and len(set(want)) > 2
    assert [got[i] if got[i] is not None else -1 for i in range(len(x))] == want.tolist()


def test_little(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    none = spark.createDataFrame([], "a long, b long, d double")
    assert {tuple(r) for r in density.density_clusters(none, nodes).collect()} == {(1, None), (2, None)}
    assert density.density_clusters(none, nodes.limit(0)).count() == 0


def test_long_chains_of_clusters_take_few_rounds(spark, monkeypatch):
    """A chain of 120 clusters, bushes and random trees: the choice of brute force, with tables by the logarithm of the height."""
    import random

    r = random.Random(4)
    parent = {0: -1} | {i: i - 1 for i in range(1, 120)} | {i: i - 120 for i in range(120, 180)} | {200: -1} | {i: r.randrange(200, i) for i in range(201, 260)}
    worth = {i: float(r.randrange(1, 9 if i < 110 else 300)) for i in parent}
    kids = {}
    for i, p in parent.items():
        kids.setdefault(p, []).append(i)
    best, good, chosen = {}, {}, {}
    for i in sorted(parent, reverse=True):
        below = sum(best[k] for k in kids.get(i, []))
        best[i], good[i] = max(worth[i], below), worth[i] >= below
    for i in sorted(parent):
        chosen[i] = chosen.get(parent[i]) or (str(i) if good[i] else None)
    cut, tables = density.cut, []
    monkeypatch.setattr(density, "cut", lambda df: (tables.append(1), cut(df))[1])
    c = spark.createDataFrame([(str(i), w) for i, w in worth.items()], "key string, stability double")
    k = spark.createDataFrame([(str(i), str(p)) for i, p in parent.items()], "key string, parent string")
    assert {x.key: x.chosen for x in density.most_stable(c, k).collect()} == {str(i): x for i, x in chosen.items()}
    assert len(tables) < 100 and len(set(chosen.values())) > 20
