"""The prefix trie and the Merkle manifest, against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle, order, prefix_trie
from graphloom.llm.registry import ORACLE, QUERIES
from graphloom.llm.shared import Tables
from tests.compare import assert_same, oracle
from tests.conftest import SMALL


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_merkle_manifest"])
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), oracle(SMALL), ORACLE[name])


def test_places_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 40}", rng.choice([None, 1, 2, 3, 500])) for i in range(4000)] + [("same", 7)] * 3000
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    got = order.numbered(df, "k", ["v"], Tables(spark, "t")).collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append((r["index"], r["v"], r["last"]))
    assert len(got) == len(rows)
    for k, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(len(found))) and [f[2] for f in found] == [False] * (len(found) - 1) + [True]
        assert [f[1] for f in found] == sorted((v for key, v in rows if key == k), key=lambda v: (v is not None, v or 0))
    assert not order.numbered(df.limit(0), "k", ["v"], Tables(spark, "t")).count()


def test_sums_along_a_long_key(spark):
    rows = [("a", i, i % 7, 1) for i in range(5000)] + [("b", i, 2, 3) for i in range(3)]
    got = {(r["k"], r["i"]): (r["x"], r["y"]) for r in order.running(spark.createDataFrame(rows, "k string, i long, x long, y long"), "k", "i", ["x", "y"]).collect()}
    total, n = 0, 0
    for _, i, x, y in rows[:5000]:
        total, n = total + x, n + y
        assert got["a", i] == (total, n)
    assert got["b", 2] == (6, 9)


def tries(rows):
    own, out = {}, {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes, kids, leaves, saved = {}, {}, {}, {}
    for c, t in out.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
    ends = {k: H(",".join(map(str, sorted(c for c in m if len(out[c]) == len(k))))) for k, m in nodes.items()}
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -10**9, len(m), len(kids.get(k, [])), leaves[k], saved[k], ends[k]) for k, m in nodes.items())


def trie_of(spark, df):
    tables = Tables(spark, "t")
    return sorted(tuple(-(10**9) if x is None else x for x in r) for r in prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(df, tables), tables), tables).collect())


CONV = "conv_id long, turn long, role string, text string, index long, conv string, depth int, owner double"


def test_trie_of_odd_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 420, 3), -7, -250, -200, 10**12 + 5, 10**12]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "ok", "é" * 30]), 1, "x", 2, 0.5))
    rows += [(c, t, "user", "same", 1, "x", 2, 0.5) for c in range(500, 1800) for t in range(3)]  # more copies than a block of ids
    rows += [(2000, t, "user", str(t), 1, "x", 2, 0.5) for t in range(2500)] + [(2001, t, "user", str(t), 1, "x", 2, 0.5) for t in range(2400)]  # longer than a block of turns
    rows += [(None, 1, "user", "nobody", 1, "x", 2, 0.5), (7, 1, "user", "twice", 1, "x", 2, 0.5), (7, 1, "user", "twice", 1, "x", 2, 0.5)]
    df = spark.createDataFrame(rows, CONV).repartition(3)
    assert trie_of(spark, df) == tries([r[:4] for r in rows])
    assert trie_of(spark, df.limit(0)) == []


def test_chains_that_hang_from_chains(spark):
    """A tree of chains that is as high as it has chains: base-less conversations, each a prefix and one turn more."""
    tables = Tables(spark, "t")
    seqs = {c: [f"x{i}" for i in range(c)] + [f"end{c}"] for c in range(1, 40)}
    rows = spark.createDataFrame([(c, i, hash(s) % 10**9, 5, 2) for c, t in seqs.items() for i, s in enumerate(t)], "conv long, index long, a long, b long, chars long")
    sizes = spark.createDataFrame([(c, len(t)) for c, t in seqs.items()], "conv long, n long")
    root = [r for r in prefix_trie.trie(rows, sizes, tables).collect() if r["depth"] == 0]
    saved = sum(2 * (sum(1 for t in seqs.values() if t[:d] == [f"x{i}" for i in range(d)]) - 1) for d in range(1, 40))
    assert [(r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in root] == [(39, 39, saved)]


def proofs(rows):
    def build(levels):
        while len(levels[-1]) > 1:
            c = levels[-1]
            levels.append([H(*c[i : i + 3]) for i in range(0, len(c), 3)])
        return levels

    def fold(levels, i, h):
        beside = []
        for at in levels[:-1]:
            run, p = at[i // 3 * 3 : i // 3 * 3 + 3], i % 3
            beside += run[:p] + run[p + 1 :]
            h, i = H(*run[:p], h, *run[p + 1 :]), i // 3
        return beside, h

    def leaf(r):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: build([[leaf(r) for r in g]]) for s, g in groups.items()}
    top, out = build([[subs[s][-1][0] for s in names]]), []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            one, h = fold(subs[s], i, leaf((*r[:4], text)))
            two, h = fold(top, k, h)
            out.append((str(r[0]), subs[s][0][i], subs[s][-1][0], top[-1][0], H(*one, *two), h, h == top[-1][0]))
    return sorted(out)


DOC = "doc_id long, source string, lang string, n_chars long, text string, grp string, level int, hash string, path string"


def manifested(spark, rows, partitions=4):
    df = spark.createDataFrame([(*r, "g", 1, "h", "p") for r in rows], DOC).repartition(partitions)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got, nodes, top = merkle.manifest(df, "source", "doc_id", merkle.FIELDS, merkle.leaf([text if c == "text" else F.col(c) for c in merkle.FIELDS]))
    return sorted((str(r[0]), *r[1:]) for r in got.drop("grp").collect()), nodes, top


@pytest.mark.parametrize("tier", [1, 2])
def test_manifest_of_odd_rows(spark, monkeypatch, tier):
    """Small blocks have several tiers of blocks, as very large groups have with the usual ones."""
    monkeypatch.setattr(merkle, "TIER", tier)
    monkeypatch.setattr(merkle, "SPAN", 3**tier)
    rng = random.Random(tier)
    rows = [(i, rng.choice(["hot"] * 4 + ["é", "z", "a,b", None, ""]), rng.choice(["en", None]), i, rng.choice(["a\nb", "\n", "", None, "x" * 5000, "日本\n語"])) for i in range(330)]
    rows += [(None, "hot", None, None, None)] * 3 + [(5, "hot", "en", 1, "twice\n")] * 40 + [(1, "alone", None, None, "one\n"), (1, "two", "", 0, ""), (2, "two", "", 0, "b\n")]
    got, nodes, _ = manifested(spark, rows)
    assert got == proofs(rows)
    groups = {}
    for r in nodes.collect():
        groups.setdefault((r["grp"], r["level"]), []).append(r["index"])
    assert all(sorted(v) == list(range(len(v))) for v in groups.values())


def test_manifest_of_a_large_group(spark):
    rows = [(i, "one", "en", 1, f"t{i}\n") for i in range(2187 * 2 + 1)]
    assert manifested(spark, rows)[0] == proofs(rows)


def test_manifest_of_little(spark):
    assert manifested(spark, [(1, "s", None, 2, "t")])[0] == proofs([(1, "s", None, 2, "t")])
    got, nodes, top = manifested(spark, [(1, "s", None, 2, "t")], 1)[0], *manifested(spark, [])[1:]
    assert got and not nodes.count() and not top.count()
    assert manifested(spark, [])[0] == []
