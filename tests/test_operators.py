"""Small hand-made cases: boundaries, ties, nulls, cycles."""

import datetime as dt
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import aggregates, graph, joins, predicates, resolution, retrieval, selection, temporal, windows
from graphloom.sources import adapters


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_paths_repeat_nodes_but_no_edge(spark):
    e = spark.createDataFrame([("a", "r", "b", 0.5), ("b", "r", "d", 0.5), ("a", "r", "c", 1.0), ("c", "r", "d", 1.0), ("a", "s", "b", 0.9)], "src string, rel string, tgt string, confidence double")
    got = rows(graph.paths(e, spark.createDataFrame([("a",)], "node string"), 2), "node", "hops")
    assert got.count(("b", 1)) == 2  # parallel edges of two relations
    assert ("a", 2) in got and got.count(("d", 2)) == 3
    best = graph.paths(e, spark.createDataFrame([("a",)], "node string"), 2, per_seed=1).collect()
    assert [(r.node, r.score) for r in best] == [("c", 1.0)]


def test_cycles_and_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (9, 9), (7, 8)], "src long, tgt long")
    assert rows(graph.cycles(e, 4)) == [(1, 2), (2, 2), (3, 3), (4, 3)]
    assert rows(graph.connected_components(e)) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 9)]


def test_noisy_or_counts_a_document_once(spark):
    d = dt.date(2020, 1, 1)
    ev = [("a", "r", "b", 1, 0.5, d, d), ("a", "r", "b", 1, 0.5, d, d), ("a", "r", "b", 2, 0.5, d, d)]
    schema = "src string, rel string, tgt string, doc long, confidence double, valid_from date, recorded_at date"
    got = {round(graph.merged_edges(spark.createDataFrame(list(p), schema)).head().confidence, 9) for p in itertools.permutations(ev)}
    assert got == {0.75}


def test_half_open_interval(spark):
    df = spark.createDataFrame([("2020-01-01", "2020-02-01"), (None, None), ("2020-02-01", None)], "f string, t string").select(F.col("f").cast("date").alias("f"), F.col("t").cast("date").alias("t"))
    at = F.lit("2020-02-01").cast("date")
    assert df.where(joins.visible("f", "t", at)).count() == 2
    assert df.where(predicates.as_of(F.col("f"), F.col("t"), F.col("f"), at, F.lit("2020-01-31").cast("date"))).count() == 1


def test_unset_flag_is_not_quarantined(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "q boolean")
    assert df.where(predicates.live("q")).count() == 2


def test_asof_takes_ties_and_nothing(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("z", 3)], "k string, t int")
    right = spark.createDataFrame([("k", 2, 1, "a"), ("k", 5, 1, "b"), ("k", 5, 2, "c"), ("k", 6, 1, "d")], "k string, at int, seq int, v string")
    assert {(r.k, r.t, r.v) for r in joins.asof(left, right, ["k"], "t", "at", "v", "seq").collect()} == {("k", 5, "c"), ("k", 1, None), ("z", 3, None)}


def test_streaks(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    runs = {"six": range(6), "seven": range(7), "fourteen": range(14), "gap": [*range(7), *range(8, 15)]}
    df = spark.createDataFrame([(u, day(n)) for u, ns in runs.items() for n in [*ns, *ns]], "u string, d date")
    assert {r.u: (r.streaks, r.bonus) for r in windows.streak_bonus(df, "u", "d").collect()} == {"six": (1, 0), "seven": (1, 2000), "fourteen": (1, 4000), "gap": (2, 4000)}


def test_wrong_at_the_moment_of_completion_is_clean(spark):
    ev = [("p", "a", 1, True), ("p", "b", 2, True), ("p", "a", 2, False), ("q", "a", 1, True), ("q", "b", 3, True), ("q", "c", 2, False), ("r", "a", 1, True)]
    df = spark.createDataFrame(ev, "page string, item string, t int, ok boolean")
    got = windows.clean_pages(df, ["page"], "item", F.lit(2), "t", F.col("ok"), ~F.col("ok"))
    assert {(r.page, r.clean, r.bonus) for r in got.collect()} == {("p", True, 20), ("q", False, 0)}


def test_ewma_is_the_fold(spark):
    x = [random.Random(4).uniform(0, 9) for _ in range(300)]
    s = x[0]
    for v in x[1:]:
        s = 0.3 * v + 0.7 * s
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "k string, i int, v double")
    assert abs(windows.ewma(df, "k", ["i"], "v", 0.3).head().ewma - s) < 1e-9


def test_margin_of_one(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("b", 1, 0.9), ("b", 2, 0.9)], "k string, i int, s double")
    assert {r.k: r.margin for r in windows.margin(df, "k", "s", "i").collect()} == {"a": 0.9, "b": 0.0}


def test_indel_ratio_and_names(spark):
    df = spark.createDataFrame([("volks wagen", "volkswagen group"), ("", ""), ("a", None), ("abc", "abc")], "a string, b string")
    assert [None if r[0] is None else round(r[0], 4) for r in df.select(T.indel_ratio("a", "b")).collect()] == [0.7407, 1.0, None, 1.0]
    one = spark.createDataFrame([("The Acme & Sons Ltd.",)], "n string").select(T.short_names(F.col("n"))).head()[0]
    assert one == ["acme & sons", "a&s"]


def test_skipping_budget_and_windows(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 4), ("h", 1, 20)], "g string, i int, c int")
    assert rows(selection.skipping_budget(df, "g", ["i"], "c", 10, 9), "g", "i") == [("g", 1), ("g", 3)]
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, 10), (1, 1, 1.0, 2.0, 195), (1, 2, 9.0, 9.5, 3)], "conv long, seq long, started double, ended double, n_tokens long")
    assert rows(selection.transcript_windows(seg)) == [(1, 0, 0, 0), (1, 1, 0, 1), (1, 2, 2, 2)] or rows(selection.transcript_windows(seg))[-1][3] == 2


def test_policy_first_match_and_nulls(spark):
    rules = [{"id": "z", "priority": 1, "mode": "ALL", "tests": [("x", "GT", 5)], "result": "big"}, {"id": "a", "priority": 1, "mode": "ANY", "tests": [("x", "IS_EMPTY", None), ("x", "EQ", 7)], "result": "odd"}]
    df = spark.createDataFrame([(7,), (9,), (None,), (1,)], "x int")
    assert [r[0] for r in df.select(predicates.policy(rules, "none")).collect()] == ["odd", "big", "odd", "none"]


def test_rank_fusion_is_stable_under_permutation(spark):
    a = spark.createDataFrame([("q", i, i) for i in range(5)], "q string, d int, rank int")
    b = spark.createDataFrame([("q", 4 - i, i) for i in range(5)], "q string, d int, rank int")
    assert rows(retrieval.fused([a, b], "q", "d")) == rows(retrieval.fused([b, a], "q", "d"))


def test_knn_zero_vectors_and_mmr(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = retrieval.knn(v.where("vec_id = 0"), v, 2).orderBy("place").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 1.0), (1, 0.0)]
    c = spark.createDataFrame([("q", 1, 0.9, [1.0, 0.0]), ("q", 2, 0.89, [1.0, 0.0]), ("q", 3, 0.5, [0.0, 1.0])], "q string, i int, r double, v array<double>")
    assert [r.i for r in retrieval.mmr(c, "q", "i", "r", "v", 2, 0.5).orderBy("place").collect()] == [1, 3]


def test_decisions(spark):
    s = spark.createDataFrame([("m", "a", 0.9, 2), ("m", "b", 0.5, 0), ("n", "a", 0.6, 0), ("o", "a", 0.2, 0), ("p", "a", 0.95, 1), ("p", "b", 0.95, 1)], "m string, e string, base double, signals int")
    assert {r.m: r.decision for r in resolution.decisions(s, "m", "e").collect()} == {"m": "AUTO", "n": "REVIEW", "o": "UNRESOLVED", "p": "REVIEW"}


def test_reconcile_and_calibration_bins(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "k int, d string"), spark.createDataFrame([(1, "x"), (2, "y"), (4, "x")], "k int, d string")
    assert rows(temporal.reconcile(a, b, "k", "d")) == [(1, "NO_OP"), (2, "SUPERSEDED"), (3, "TOMBSTONED"), (4, "CREATED")]
    c = aggregates.calibration_curve(spark.createDataFrame([(1.0, 1.0), (0.0, 0.0)], "p double, y double"), "p", "y").orderBy("bin").collect()
    assert len(c) == 10 and c[9].n == 1 and c[4].mean_predicted == 0.45


def test_tenants_never_meet(spark):
    df = spark.createDataFrame([("a", "t0"), ("b", "t1")], "id string, tenant string")
    assert rows(predicates.tenant_scope(df, "t0"), "id") == [("a",)]


def test_readers(spark, tmp_path):
    (tmp_path / "x.nt").write_text("# c\n<a> <b> \"v w\" .\n\n<c> <d> <e> .\n")
    assert rows(adapters.triples(spark, str(tmp_path / "x.nt"))) == [("<a>", "<b>", '"v w"'), ("<c>", "<d>", "<e>")]
    (tmp_path / "s.csv").write_text("task_id,condition,duration_seconds,evidence_score,success\nt1,manual,10.5,0.5,true\n")
    assert adapters.study_rows(spark, str(tmp_path / "s.csv")).head().success is True


def test_gcn_matches_dense(spark):
    rng = np.random.default_rng(1)
    a = np.triu(rng.random((6, 6)) * (rng.random((6, 6)) < 0.5), 1)
    a = a + a.T
    x = rng.normal(size=6)
    full = a + np.eye(6)
    d = full.sum(1)
    want = np.maximum(0, (full / np.sqrt(np.outer(d, d))) @ x)
    adj = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(6) if a[i, j] > 0], "u int, v int, weight double")
    xs = spark.createDataFrame([(i, 0, float(x[i])) for i in range(6)], "node int, dim int, value double")
    got = {r.node: r.value for r in graph.gcn_layer(adj, xs).collect()}
    assert np.allclose([got[i] for i in range(6)], want)


def test_communities_of_cliques(spark):
    edges = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abcd" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0), ("b1", "c0", 1.0), ("c1", "d0", 1.0)]
    e = spark.createDataFrame(edges, "src string, tgt string, weight double")
    got = graph.community_hierarchy(e, levels=2).collect()
    first = {r.node: r.community for r in got if r.level == 0}
    assert all(len({first[f"{c}{i}"] for i in range(5)}) == 1 for c in "abcd") and len(set(first.values())) == 4
    m = spark.createDataFrame(list(first.items()), "node string, community string")
    assert aggregates.modularity(e, m).head()[0] > 0.6
    top = {r.node: r.community for r in got if r.level == 1}
    assert all(len({top[n] for n in first if first[n] == c}) == 1 for c in set(first.values()))  # levels nest
