"""The navigable neighbour graph: recall against exact search, and how much of the table a search looks at."""

import numpy as np
import pytest

from graphloom.operators import neighbours, retrieval
from graphloom.session import Data
from tests.conftest import SMALL


def table(spark, x, extra=()):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + list(extra), "vec_id long, embedding array<double>").repartition(3)


def recall(exact, got, k):
    want = {}
    for r in exact.collect():
        want.setdefault(r.query_id, []).append(r.vec_id)
    found = {}
    rows = got.collect()
    for r in rows:
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(found[q]) == min(k, len(v)) for q, v in want.items())
    return sum(len(set(v) & set(found[q])) for q, v in want.items()) / sum(map(len, want.values())), max(r.visited for r in rows), rows


@pytest.mark.parametrize("shard", [2500, 700])
def test_recall_and_rows_looked_at(spark, shard):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 12))[rng.integers(0, 60, 2000)] * 2 + rng.normal(size=(2000, 12))
    x[100:140] = x[100]  # copies
    df = table(spark, x, [(5000, None), (5001, [1.0, None] * 6), (5002, [0.0] * 12)])
    lists, index = neighbours.neighbour_graph(df, k=12, shard=shard)
    q = df.where("vec_id % 40 = 3 AND vec_id < 2000")
    share, looked, rows = recall(retrieval.knn(q, df.where("vec_id < 2000"), 10), neighbours.graph_search(q, index, 10, beam=60), 10)
    assert share >= 0.95 and all(r.query_id != r.vec_id for r in rows)
    assert looked < (0.4 if shard == 2500 else 0.8) * 2000
    assert index.count() == 2001 and lists.groupBy("id").count().agg({"count": "max"}).head()[0] <= 12


def test_recall_on_the_table(spark):
    d = Data(spark, SMALL)
    q = d.embeddings.where("vec_id % 20 = 0")
    _, index = neighbours.neighbour_graph(d.embeddings)
    share, _, _ = recall(retrieval.knn(q, d.embeddings, 10), neighbours.graph_search(q, index, 10), 10)
    assert share >= 0.95


def test_few_rows(spark):
    df = table(spark, np.eye(3))
    _, index = neighbours.neighbour_graph(df)
    got = neighbours.graph_search(df, index, 5).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(a, b) for a in range(3) for b in range(3) if a != b]
    _, none = neighbours.neighbour_graph(df.limit(0))
    assert neighbours.graph_search(df, none, 5).count() == 0


def test_lists_are_exact_and_walks_stand_alone(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(900, 32)).astype(np.float32)
    df = table(spark, x.astype(np.float64))
    lists, index = neighbours.neighbour_graph(df, k=8, shard=300)
    u = (x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
    near: dict = {}
    for r in lists.collect():
        near.setdefault((r.shard, r.id), []).append((r.place, r.other))
    shard = {i: s for s, i in near}
    assert len(near) == 900 and len(set(shard.values())) == 3
    for (s, i), got in near.items():
        own = [o for o in range(900) if shard[o] == s and o != i]
        assert {o for _, o in got} == {own[p] for p in np.argsort(-(u[own] @ u[i]))[:8]} and sorted(p for p, _ in got) == list(range(1, 9))
    q = df.where("vec_id % 9 = 0")
    found = lambda: sorted(tuple(r) for r in neighbours.graph_search(q, index, 5, beam=20).collect())
    once = found()
    monkeypatch.setattr(neighbours, "TOGETHER", 7)
    monkeypatch.setattr(neighbours, "ASKED", 30)
    assert [r[:3] for r in found()] == [r[:3] for r in once] and len(once) == 500
