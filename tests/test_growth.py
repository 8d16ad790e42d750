"""Rows of large tables are dealt over as many tasks as they need: no task takes more the larger the table is."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import session
from graphloom.operators import governance, ontology, retrieval
from graphloom.plans.registry import ORACLE, QUERIES
from graphloom.session import Data, dealt
from tests.compare import assert_same, oracle
from tests.conftest import SMALL

DEALT = ["agg07_rate_per_thousand", "agg27_degree_outliers", "agg28_corroboration", "agg35_canonical_what_if", "gov01_contradictions", "gov03_remaining", "grf17_transitivity", "jon05_exclusive_entities", "sal05_signals", "sal06_digest", "snk02_evidence_merge", "snk06_reconciled_evidence"]


@pytest.mark.parametrize("name", DEALT)
def test_dealt_queries_keep_their_results(spark, monkeypatch, name):
    """With few rows a task the plans have more partitions than the session's shuffles, and the results of SQL."""
    monkeypatch.setattr(session, "ROWS", 500)
    df = QUERIES[name](spark, SMALL)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString() or name == "gov01_contradictions"  # its evidence is written before
    assert_same(df, oracle(SMALL), ORACLE[name])


def test_evidence_is_dealt_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS", 500)
    d = Data(spark, SMALL)
    per = d.evidence.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.count("*").alias("parts"), F.max("n").alias("most")).head()
    assert per.parts > 4 and per.most < 2 * 500
    assert dealt(d.lineitem, 100, "l_orderkey").rdd.getNumPartitions() == d.lineitem.rdd.getNumPartitions()


def test_edges_without_a_second_end_are_not_joined(spark):
    """They have a null key there, by which all of them went to one task."""
    mentions = spark.createDataFrame([(1, 10), (50, 20)], "doc long, entity long")
    edges = spark.range(1000).select("id", F.array(F.when(F.col("id") % 2 == 0, 10).otherwise(20).cast("long")).alias("ends"))
    edges = edges.unionAll(spark.createDataFrame([(5000, [10, 20]), (5001, [10, 10]), (5002, [])], "id long, ends array<long>"))
    left = governance.forget_documents(mentions, mentions.select("entity"), edges, F.col("doc") == 50)["edges"]
    got = {r.id for r in left.collect()}
    assert got == set(range(0, 1000, 2)) | {5001, 5002}
    assert left._jdf.queryExecution().analyzed().toString().lower().count("isnotnull(get(_ends") >= 2


def test_sparse_search_scores_all_pairs_in_tiles(spark, monkeypatch):
    """Weights of either sign, zero products, ties, several blocks of queries, tiles of all three kinds: as by brute force. A task
    returns some k rows a query, however many batches it reads."""
    import random

    from graphloom.operators import retrieval as R

    r = random.Random(5)
    for negative in (True, False):
        docs = [(i, d, float(r.choice([1, 2, 3, 0, -1] if negative else [1, 2, 3]))) for i in range(300) for d in r.sample(range(12), r.randint(1, 4))]
        asked = [(i, d, w) for i, d, w in docs if i % 20 == 0] + [(1000, 99, 1.0)]
        vec = {}
        for i, d, w in docs:
            vec.setdefault(i, {})[d] = w
        want = set()
        for q in range(0, 300, 20):
            s = [(-round(sum(vec[q][d] * vec[i][d] for d in vec[q] if d in vec[i]), 5), i) for i in vec if i != q and vec[q].keys() & vec[i].keys()]
            want |= {(q, i, -x) for x, i in sorted(s)[:7]}
        for block in (20_000, 5):
            monkeypatch.setattr(R, "QUERY_BLOCK", block)
            q, d = spark.createDataFrame(asked, "query_id long, dim long, w double"), spark.createDataFrame(docs, "doc_id long, dim long, w double")
            assert {tuple(x) for x in R.sparse_search(q, d, 7).collect()} == want
    p, x = [0] * 50, [1.0] * 40 + [2.0] * 10
    import numpy as np

    kept, least = R._kept([np.array(p), np.arange(50), np.array(x)], 2, 3)
    assert kept[1].tolist() == [40, 41, 42] and abs(least[0] - 2) < 1e-4 and least[1] == -np.inf


def test_sparse_search_passes_over_what_a_bound_rules_out(spark, monkeypatch):
    """Positive weights, copies and ties, tiny products and nulls: as by brute force, with few of the pairs multiplied."""
    from graphloom.operators import retrieval as R

    rng = np.random.default_rng(6)
    docs = [(i, int(d), float(rng.integers(1, 6))) for i in range(3000) for d in rng.choice(12, rng.integers(1, 7), replace=False)]
    docs += [(i + 10_000, d, w) for i, d, w in docs if i < 300] + [(5000, 50, 1e-60), (5020, 50, 1e-60), (5040, None, 1.0), (5060, 1, None)]
    vec = np.zeros((10_300, 51))
    for i, d, w in docs:
        if d is not None and w is not None:
            vec[i, d] = w
    ids = np.flatnonzero(vec.any(axis=1))
    asked = [x for x in docs if x[0] % 20 == 0]
    want = set()
    for q in {x[0] for x in asked}:
        s = vec[ids] @ vec[q]
        s[(ids == q)] = 0
        near = [(-round(x, 5), i) for x, i in zip(s.tolist(), ids.tolist()) if x > 0]
        want |= {(q, i, -x) for x, i in sorted(near)[:7]}
    q, d = spark.createDataFrame(asked, "query_id long, dim long, w double"), spark.createDataFrame(docs, "doc_id long, dim long, w double")
    for block in (20_000, 50):
        monkeypatch.setattr(R, "QUERY_BLOCK", block)
        assert {tuple(x) for x in R.sparse_search(q, d, 7).collect()} == want and (5000, 5020, 0.0) in want
    order, best, met = np.lexsort((*vec[ids].T, *(vec[ids] > 0).T)), R._Best(160, 7), 0
    some = np.concatenate([order[::8], order[np.arange(len(order)) % 8 > 0]])
    bounded = R._Best.fresh

    def counted(self, place, document, score):
        nonlocal met
        met += len(place)
        return bounded(self, place, document, score)

    monkeypatch.setattr(R._Best, "fresh", counted)
    for lo in range(0, len(some), 200):
        o = ids[some[lo : lo + 200]]
        i, j = np.nonzero(vec[o])
        best.add([R._bounded(ids[:3200:20], vec[ids[:3200:20]], o, j, i, vec[o][i, j], best)])
    assert met < 0.5 * 160 * len(ids)


def test_pairs_of_a_block_are_not_shuffled(spark):
    """Each mention lists the entities of its block; nulls and several blocks count as they do in a join."""
    from graphloom.operators import resolution as R

    m = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, None), (4, 9)], "mention long, block long")
    e = spark.createDataFrame([(10, 7), (11, 7), (11, 8), (12, None), (13, 8)], "entity long, block long")
    line = spark.createDataFrame([(1, 10), (1, 10), (2, 12), (3, 10), (5, 11), (None, 10), (2, None)], "mention long, entity long")
    pairs = m.join(e, "block").select("mention", "entity")
    want = R.candidates({"line": line, "block": pairs}, "mention", "entity").collect()
    got = R.block_candidates({"line": line}, "block", m, e, "mention", "entity")
    key = lambda r: (str(r.mention), str(r.entity), tuple(r.sources))
    assert sorted(map(key, got.collect())) == sorted(map(key, want)) and len(want) == 10


def test_pairs_of_sources_are_shuffled_once(spark):
    """By mention, before they are grouped; what is read from there on is joined with broadcast tables only."""
    from graphloom.operators import resolution as R

    m = spark.range(40).select(F.col("id").alias("mention"), (F.col("id") % 3).alias("block"))
    e = spark.range(20).select(F.col("id").alias("entity"), (F.col("id") % 3).alias("block"))
    line = spark.range(300).select((F.col("id") % 41).alias("mention"), (F.col("id") % 23).alias("entity"))
    found = {"a": line, "z": line.where("entity % 2 = 0")}
    out = R.block_candidates(found, "m", m, e, "mention", "entity", 3_000_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = R.block_candidates(found, "m", m, e, "mention", "entity")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" not in plan and "hashpartitioning(mention" not in plan
    want = R.candidates({**found, "m": m.join(e, "block").select("mention", "entity")}, "mention", "entity")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_a_search_holds_one_block_of_queries(spark, monkeypatch):
    from pyspark.core.broadcast import Broadcast

    from graphloom.operators import retrieval as R

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, R.knn(df, df, 3).collect()))
    gone, destroy = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False: (gone.append(self), destroy(self, blocking))[1])
    monkeypatch.setattr(R, "QUERY_BLOCK", 16)
    got = sorted(map(tuple, R.knn(df, df, 3).collect()))
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want]) and len(gone) == 4


def test_gold_of_a_label_is_counted(spark):
    from graphloom.operators import retrieval as R

    items = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2), (5, None)], "vec_id long, label int")
    q = spark.createDataFrame([(1, 0), (4, 2), (9, 1), (5, None)], "query_id long, label int")
    got = spark.createDataFrame([(1, 3, 1), (1, 2, 2), (9, 3, 1), (4, 1, 1)], "query_id long, vec_id long, place int")
    gold = q.join(items, "label").where("query_id <> vec_id")
    assert R.label_metrics(got, q, items, "query_id", "vec_id", "label", 2).collect() == R.retrieval_metrics(got, gold, "query_id", "vec_id", 2).collect()


def test_closed_groups_of_sources_are_counted_whole(spark, monkeypatch):
    """Groups that share no target make no table of pairs; what two steps don't close, and what is large, is counted pair by pair."""
    import random

    from graphloom.operators import graph

    r = random.Random(3)
    edges = {(100 * g + r.randrange(12), 100 * g + r.randrange(20)) for g in range(6) for _ in range(120)}
    chain = {(10_000 + i, 10_000 + i + j) for i in range(40) for j in (0, 1)}
    table = lambda pairs: spark.createDataFrame(sorted(pairs), "src long, tgt long").withColumn("rel", F.lit("r"))
    between, seen = graph._votes_between, []
    monkeypatch.setattr(graph, "_votes_between", lambda e, k: (seen.append({x.src for x in e.collect()}), between(e, k))[1])
    monkeypatch.setattr(graph, "CELL", 150)
    got = {tuple(x) for x in graph.missing_tails(table(edges | chain), "r", 3).collect()}
    assert seen == [{s for s, _ in chain}]
    assert {tuple(x) for x in graph.missing_tails(table(edges), "r", 3).collect()} == {x for x in got if x[0] < 10_000} and len(seen) == 1
    monkeypatch.setattr(graph, "CELL", 30)  # no group is small enough
    assert {tuple(x) for x in graph.missing_tails(table(edges | chain), "r", 3).collect()} == got and len(seen[-1]) > 90


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_votes_make_no_table_of_pairs(spark, monkeypatch, held):
    """One group of sources, of which most share a target: what is written are edges and less, and the votes are those of brute force."""
    import random
    from collections import Counter

    from graphloom.operators import graph

    r = random.Random(8)
    edges = {(r.randrange(120), f"t{r.randrange(40)}") for _ in range(1200)} | {(s, "all") for s in range(120)} | {(200, "all"), (201, "own")}
    has = {s: {t for x, t in edges if x == s} for s, _ in edges}
    want = set()
    for s in has:
        votes = Counter()
        for p in has:
            if p != s:
                votes.update({t: len(has[s] & has[p]) for t in has[p] - has[s] if has[s] & has[p]})
        want |= {(s, t, n) for t, n in sorted(votes.items(), key=lambda v: (-v[1], v[0]))[:3]}
    cut, rows = graph.cut, []

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    monkeypatch.setattr(graph, "CELL", 300)
    monkeypatch.setattr(graph, "CROWD", 50)
    monkeypatch.setattr(graph, "HELD", held, raising=False)
    e = spark.createDataFrame(sorted(edges) + [(3, None), (None, "t1")], "src long, tgt string").withColumn("rel", F.lit("r"))
    assert {tuple(x) for x in graph.missing_tails(e, "r", 3).collect()} == want and max(rows) <= len(edges)


def test_chunks_of_some_texts_at_once(spark, monkeypatch):
    """Chunks leave the task text by text, however many rows a batch has."""
    from graphloom.functions import text as T

    rows = [(i, "# Head\n" + "some words here. " * (60 * (i % 3)) + "\n\nTAIL PART\nx", f"s{i}" if i % 4 else None) for i in range(40)] + [(40, None, "s"), (41, " ", "s")]
    df = spark.createDataFrame(rows, "k long, t string, s string").coalesce(1)
    chunks = lambda: T.section_chunks(df, "k", "t", F.col("s"))
    want = sorted(map(tuple, chunks().collect()))
    monkeypatch.setattr(T, "TEXTS", 1)
    assert sorted(map(tuple, chunks().collect())) == want and len({w[0] for w in want}) == 40
    assert "ArrowEvalPython" not in chunks()._jdf.queryExecution().toString()


def test_neighbours_within_a_label_in_many_batches(spark):
    """What a task has seen bounds what it returns: ties, labels of few rows and nulls as by brute force."""
    import numpy as np

    from graphloom.operators import retrieval as R

    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (300, 3)).astype(float)
    label = [None if i % 50 == 7 else 9 if i in (3, 4) else i % 3 for i in range(300)]
    df = spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int").coalesce(2)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    u = x / np.where(n == 0, 1, n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for k in (1, 4):
            for within in (None, "label"):
                got = {(r.query_id, r.vec_id) for r in R.knn(df, df, k, within=within).collect()}
                want = set()
                for q in range(300):
                    ok = [i for i in range(300) if i != q and (within is None or label[i] is not None and label[i] == label[q])]
                    want |= {(q, i) for i in sorted(ok, key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:k]}
                assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_searched_cells_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ontology, "CELL", 60)
    monkeypatch.setattr(ontology, "ASKED", 70)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    x[50:150] = x[50]  # copies fill a cell of several blocks
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r.vec_id) for r in ontology.ann_search(df, df, 7, recall=1.0).collect())
    want = sorted((r.query_id, r.vec_id) for r in retrieval.knn(df.where("vec_id < 900"), df.where("vec_id < 900"), 7).collect())
    assert len(got) == len(want) == 2100 and len(set(got) & set(want)) >= 0.99 * len(want)


def test_cells_of_openings_keep_their_size(spark, monkeypatch):
    """More documents are more cells, not larger ones; the pairs stay the same."""
    texts = ["".join(f"w{(i * 7 + j) % 50} " for j in range(60)) + "end" * (i % 3) for i in range(80)] + ["", None]
    docs = spark.createDataFrame([(i, t, None if i % 9 == 4 else "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    want = sorted(map(tuple, retrieval.near_openings(docs).collect()))
    cut, plans = retrieval.cut, []
    monkeypatch.setattr(retrieval, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    monkeypatch.setattr(retrieval, "OPENINGS", 5, raising=False)
    assert sorted(map(tuple, retrieval.near_openings(docs).collect())) == want and len(want) > 20
    assert any(f"RepartitionByExpression [lang#" in p and int(p.split("RepartitionByExpression [lang#")[1].split("], ")[1].split("\n")[0].split(",")[0]) >= 4 * 10 * 10 for p in plans)


def test_pairs_of_sets_are_shuffled_packed(spark, monkeypatch):
    import random

    from graphloom.operators import joins

    monkeypatch.setattr(joins, "PAIRS", 50)
    rng = random.Random(4)
    rows = [[(rng.randrange(-9, 20) * 10**9, f"m{rng.randrange(40)}") for _ in range(300)] + [(None, "m1"), (7, None), (7, None), (8, "only" + side)] for side in "lr"]
    l, r = (spark.createDataFrame(x, "k long, m string").repartition(3) for x in rows)
    out = joins.set_similarity(l, r, "k", "m")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a" not in plan and "mapInArrow" in plan.replace("MapInArrow", "mapInArrow")
    sets = [{k: {m for i, m in x if i == k} for k, _ in x if k is not None} for x in rows]
    want = {a: max((len((x & y) - {None}) / (len(x) + len(y) - len((x & y) - {None})) for y in sets[1].values() if (x & y) - {None}), default=None) for a, x in sets[0].items()}
    assert {r.a: r.similarity for r in out.collect()} == {a: s for a, s in want.items() if s is not None}
    assert joins.set_similarity(l.limit(0), r, "k", "m").count() == 0
