"""Language model scores, language identification, top-k, chats."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, language_id, pitman_yor, topk
from tests.llm.test_duplicates import words


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_scores(spark, odd_docs, odd_texts, no_docs):
    flag = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    got = {r.doc_id: r for r in pitman_yor.score(odd_docs, flag).collect()}
    count = Counter(w for i, t in odd_texts if not held(i) for w in [*words(t), "\0"])
    n, v = sum(count.values()), len(count)
    for i, t in odd_texts:
        w, r = [*words(t), "\0"], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(x in count for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert -math.inf < r.score <= 0
    assert pitman_yor.score(no_docs, flag).count() == 0


def test_better_than_the_base_on_held_out_texts(spark):
    rng = random.Random(4)
    after = {i: [rng.randrange(60) for _ in range(4)] for i in range(60)}
    rows = []
    for d in range(400):
        x, text = rng.randrange(60), []
        for _ in range(60):
            text.append(f"w{x}")
            x = rng.choice(after[x])
        rows.append((d, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r for r in pitman_yor.score(df, F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect() if r.held_out]
    assert sum(r.score for r in out) / sum(r.n_tokens for r in out) > sum(r.base_score for r in out) / sum(r.n_tokens for r in out) + 0.8


def test_probabilities_of_a_context_sum_to_one(spark):
    """One-word texts: the scores of all words after the start, plus one unknown word, make a distribution (with the end)."""
    train = [(i, f"w{i % 7}") for i in range(200)]
    probe = [(1000 + k, f"w{k}") for k in range(7)] + [(2000, ""), (3000, "unknown"), (3001, "unknown unknown")]
    df = spark.createDataFrame(train + probe, "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score(df, F.col("doc_id") >= 1000).collect()}
    # p(w) * p(end | w): the end after each known word is divided out by training counts being all ends
    after_unknown = 10 ** (got[3001] - got[3000])  # p(unknown | unknown)
    start = [10 ** got[1000 + k] for k in range(7)]
    assert sum(start) < 1 and 10 ** got[2000] < 1 and 0 < after_unknown < 0.5
    assert sum(start) > 0.8


def test_stirling_and_gibbs_step_follow_the_restaurant():
    """Tables drawn by the Gibbs step against seatings simulated customer by customer (one dish that the parent always gives)."""
    d, s = 0.6, 2.0
    assert np.allclose(np.exp(pitman_yor.log_stirling(3, d)), [(1 - d) * (2 - d), 3 * (1 - d), 1])
    rng = np.random.default_rng(3)
    for n in (12, 90):
        keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
        t = pitman_yor.draw_tables(np.full(20_000, n), np.zeros(20_000), np.ones(20_000), d, s, keys)
        sim = []
        for _ in range(4000):
            k = 1
            for c in range(1, n):
                k += rng.random() < (s + d * k) / (s + c)
            sim.append(k)
        assert abs(t.mean() - np.mean(sim)) < 0.03 * np.mean(sim) and abs(t.std() - np.std(sim)) < 0.05 * np.std(sim) + 0.05


def test_many_customers_are_near_the_conditional(monkeypatch):
    """Draws with approximated Stirling numbers against exact ones, where both can be made: means within 2 in 100."""
    rng = np.random.default_rng(3)
    worst = 0.0
    for n, others, p, d in ((600, 0.0, 0.3, 0.75), (800, 0.0, 0.999, 0.6), (800, 5000.0, 1e-3, 0.75), (900, 200.0, 0.01, 0.85), (900, 20_000.0, 1e-4, 0.6), (700, 0.0, 1e-6, 0.85), (900, 3000.0, 0.2, 0.75)):
        keys = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
        args = np.full(3000, n), np.full(3000, others), np.full(3000, p), d, 1.0, keys
        near = pitman_yor.draw_tables(*args)
        with monkeypatch.context() as m:
            m.setattr(pitman_yor, "MANY", 1000)
            exact = pitman_yor.draw_tables(*args)
        worst = max(worst, abs(near.mean() - exact.mean()) / exact.mean())
        assert abs(near.std() - exact.std()) < 0.1 * exact.std() + 0.1
    assert worst < 0.02
    c = rng.integers(1, 900, 40_000)
    alike = pitman_yor.draw_alike(c, 3000.0, 1e-3, 0.6, 10.0, rng.integers(0, 1 << 63, len(c), dtype=np.uint64))
    one = pitman_yor.draw_tables(c, np.full(len(c), 3000.0), np.full(len(c), 1e-3), 0.6, 10.0, rng.integers(0, 1 << 63, len(c), dtype=np.uint64))
    assert (alike <= c).all() and abs(alike.mean() - one.mean()) < 0.02 * one.mean() and abs(alike.std() - one.std()) < 0.03 * one.std()
    more = pitman_yor.draw_tables(np.array([10**6, 10**6, 10**8]), np.array([1000.0, 1000.0, 1e7]), np.array([0.1, 1e-6, 0.01]), 0.8, 1.0, keys[:3])
    assert 1 <= more[1] < more[0] < more[2] < 10**7


class PlainModel:
    """The same hierarchy with every customer seated one by one, removed and seated again in every sweep."""

    def __init__(self, texts, discounts, strengths, rng):
        self.d, self.s, self.rng = discounts[::-1], strengths[::-1], rng
        self.tables, self.words = {}, {w for t in texts for w in t}
        self.tokens = [(("^", *t)[i], ("^", "^", *t)[i], w) for t in texts for i, w in enumerate(t)]
        self.seated = []
        for last, first, w in self.tokens:
            self.add((last, first), w)

    def rooms(self, ctx):
        return [(), ctx[:1], ctx]

    def p(self, ctx, w, upto=2):
        out = 1 / (len(self.words) + 1)
        for k, room in enumerate(self.rooms(ctx)[: upto + 1]):
            dishes = self.tables.get(room, {})
            n, t = sum(map(sum, dishes.values())), sum(map(len, dishes.values()))
            own = dishes.get(w, [])
            if n:
                out = (sum(own) - self.d[k] * len(own) + (self.s[k] + self.d[k] * t) * out) / (n + self.s[k])
        return out

    def add(self, ctx, w, level=2):
        if level < 0:
            return
        room = self.rooms(ctx)[level]
        own = self.tables.setdefault(room, {}).setdefault(w, [])
        t = sum(map(len, self.tables[room].values()))
        up = self.p(ctx, w, level - 1) if level else 1 / (len(self.words) + 1)
        weights = [max(n - self.d[level], 0) for n in own] + [(self.s[level] + self.d[level] * t) * up]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k == len(own):
            own.append(1)
            self.add(ctx, w, level - 1)
        else:
            own[k] += 1

    def remove(self, ctx, w, level=2):
        if level < 0:
            return
        own = self.tables[self.rooms(ctx)[level]][w]
        k = self.rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            self.remove(ctx, w, level - 1)

    def sweep(self):
        for last, first, w in self.tokens:
            self.remove((last, first), w)
            self.add((last, first), w)


def test_scores_are_those_of_a_plain_sampler(spark):
    rng = random.Random(14)
    after = {i: [rng.randrange(12) for _ in range(3)] for i in range(12)}

    def text():
        x, out = rng.randrange(12), []
        for _ in range(rng.randint(4, 14)):
            out.append(f"w{x}")
            x = rng.choice(after[x]) if rng.random() < 0.8 else rng.randrange(12)
        return out

    train, probe = [text() for _ in range(60)], [text() for _ in range(30)] + [["w1", "new", "w2"]]
    plain = PlainModel([[*t, "$"] for t in train], pitman_yor.DISCOUNTS, pitman_yor.STRENGTHS, rng)
    sums = [[0.0] * (len(t) + 1) for t in probe]
    for k in range(30):
        plain.sweep()
        if k >= 10:
            for t, out in zip(probe, sums, strict=True):
                tokens = [*t, "$"]
                known = [w if w in plain.words else None for w in ["^", "^", *tokens]]
                for i, w in enumerate(tokens):
                    out[i] += plain.p((known[i + 1], known[i]), w, 2 if known[i] and known[i + 1] else 1 if known[i + 1] else 0) / 20
    want = [sum(math.log10(x) for x in out) for out in sums]
    rows = [(i, " ".join(t)) for i, t in enumerate(train)] + [(1000 + i, " ".join(t)) for i, t in enumerate(probe)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for hot in (pitman_yor.HOT, 20):
        got = {r.doc_id: r.score for r in pitman_yor.score(df, F.col("doc_id") >= 1000, hot).collect()}
        n = sum(len(t) + 1 for t in probe)
        off = [got[1000 + i] - w for i, w in enumerate(want)]
        assert abs(sum(off)) / n < (0.02 if hot > 20 else 0.06), (hot, sum(off) / n)
        assert max(abs(o) / (len(t) + 1) for o, t in zip(off, probe, strict=True)) < 0.25  # one short text with an unknown word


def test_packed_blocks_come_back():
    a = [np.array([], np.uint8), np.arange(5, dtype=np.int64) * 10**12, np.array([1.5], np.float32), np.array([True, False])]
    assert all(np.array_equal(x, y) and x.dtype == y.dtype for x, y in zip(a, pitman_yor.unpack(pitman_yor.pack(*a)), strict=True))


def test_language(spark, no_docs):
    rng = random.Random(1)
    alphabets = {"aa": "abcde ", "bb": "vwxyz ", "cc": "éèàçù "}
    rows = [(i, "".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(30, 200))), lang) for i in range(300) for lang in [list(alphabets)[i % 3]]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !!", None), (903, "abcabc abd", None), (904, "éé", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(df, language_id.train(df.where("doc_id % 4 <> 2"))).collect()}
    assert all(got[i].lang_pred == lang for i, t, lang in rows[:300])
    assert [got[i].lang_pred for i in range(900, 905)] == ["und", "und", "und", "aa", "cc"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.train(no_docs) is None
    assert {r.lang_pred for r in language_id.predict(df.limit(5), None).collect()} == {"und"}


def test_no_labels_reject_no_text(spark, odd_docs):
    from corpus_pipeline import known_language

    bare = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    kept = known_language(spark, bare, "")
    labelled = language_id.identified(bare, language_id.train(odd_docs))
    assert kept.columns == bare.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted(r.doc_id for r in labelled.select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in bare.where(F.col("text").rlike(r"\p{L}")).collect()) and ids


def test_language_slices(monkeypatch):
    t = "abc déf " * 300 + "xyz"
    whole = language_id.counts(t)
    for size in (500, 3, 2):
        monkeypatch.setattr(language_id, "SLICE", size)
        assert np.array_equal(language_id.counts(t), whole)


def test_language_of_odd_rows(spark, monkeypatch):
    """Very long texts, repeated rows, clashing columns, and more labels than are learned."""
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    monkeypatch.setattr(language_id, "SLICE", 1000)
    rows = [(i, ["abc " * 30, "xyz " * 30, "qqq "][i % 3 if i < 59 else 2], ["aa", "bb", "rare"][i % 3 if i < 59 else 2] if i % 3 < 2 or i == 59 else None) for i in range(60)]
    rows += [(100, "abc " * 5000, None), (101, "xyz " * 5000, None), (0, "abc " * 30, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit("z").alias(c) for c in ("lang_pred", "score", "h", "label", "at")])
    got = {}
    for r in language_id.predict(df, language_id.train(df)).collect():
        got.setdefault(r.doc_id, []).append(r.lang_pred)
    assert got[100] == ["aa"] and got[101] == ["bb"] and got[0] == ["aa", "aa"] and {x for v in got.values() for x in v} == {"aa", "bb"}


@pytest.mark.parametrize("case", ["random", "ties", "few"])
def test_topk_is_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(topk, "TREE_ROWS", 90)
    monkeypatch.setattr(topk, "LEAST_ROWS", 20)
    monkeypatch.setattr(topk, "LEAF", 12)
    rng = np.random.default_rng(4)
    n = 4 if case == "few" else 500
    x = rng.normal(size=(n, 8)).astype(np.float32)
    if case == "ties":
        x = np.round(x[:, :] / 2)
        x[: n // 3] = x[0]
    rows = [(i * 10, [float(v) for v in x[i]]) for i in range(n)] + [(5, None), (7, [1.0, None]), (9, [float("nan")] * 8), (11, [float("inf")] * 8)]
    rows += rows[:3]  # repeated rows count once
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit(1).alias(c) for c in ("query_id", "rank", "score", "block", "slot", "v")]).repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_topk(df).collect())
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(n):
        if i * 10 % 50 == 0:
            s = sorted((-int(q[i] @ q[j]), j * 10) for j in range(n) if j != i)[:5]
            want += [(i * 10, k + 1, v, -m) for k, (m, v) in enumerate(s)]
    assert got == sorted(want)
    assert topk.exact_topk(df.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    """Scores beyond what doubles and longs hold still rank exactly; every finite vector takes part."""
    rng = np.random.default_rng(8)
    x = [[int(v) / 256 for v in row] for row in rng.integers(-(1 << 26), 1 << 26, (60, 5))]
    rows = [(i * 25, v) for i, v in enumerate(x)] + [(7, [1e300, 0.0, 0.0, 0.0, 0.0]), (8, [float(1 << 27), 0.0, 0.0, 0.0, 0.0]), (9, [600000.0, 1.0]), (50 * 77, [2.0**40, -(2.0**40), 3.0, 1.0, 0.0]), (11, [2.0**40, 2.0**40, 5.0]), (13, [1.7e308] * 5), (15, [float("inf"), 1.0]), (17, [float("nan")])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    most, digits = (1 << 63) - 1, 10**38 - 1
    q = {i: [int(min(max(np.floor(256 * c), -np.finfo(float).max), np.finfo(float).max)) if abs(c) < 1e300 else int(min(256.0 * c, np.finfo(float).max)) for c in v] for i, v in rows if np.isfinite(v).all()}
    want = []
    for i in q:
        if i % 50 == 0:
            best = sorted((-max(-digits, min(digits, sum(a * b for a, b in zip(q[i], q[j], strict=False)))), j) for j in q if j != i)[:5]
            want += [(i, k + 1, v, max(-most - 1, min(most, -s))) for k, (s, v) in enumerate(best)]
    assert got == sorted(want)


def test_boxes_prune():
    """Clustered vectors: most leaves are never read."""
    rng = np.random.default_rng(9)
    x = np.floor((rng.normal(size=(40, 6))[rng.integers(0, 40, 8000)] * 8 + rng.normal(size=(8000, 6)) * 0.2) * 256)
    tree = topk.Tree(np.arange(8000), x)
    for i in range(20):
        tree.search(x[i], i, tree.bounds(x[i][None])[0], 5, -np.inf)
    leaves = sum(k is None for k in tree.kids)
    assert tree.opened / 20 < 0.4 * leaves


def test_chats(spark):
    rng = random.Random(7)
    bits = ["</s>", "[INST]", "<<SYS>>", "\\", "<", "[/INST", "]", "<s>", "ok", "é\n", "[ROLE]", "[/TURN]", " "]
    rows = [(c, t, rng.choice(["system", "user", "assistant", None, "tool</s>", ""]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(100, 0, "user", "hi"), (100, 1, "assistant", "yo"), (101, 0, "assistant", "no"), (102, 0, "user", "a"), (102, 0, "user", "a"), (103, None, "user", "x"), (104, 0, "user", "[INST] \\" * 30_000), (104, 1, "assistant", "é</s>" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    for c, turns in by.items():
        turns = sorted(turns)
        text = "".join(f"{r[1]}\n{x[1]}\n" for _, r, x in turns)
        loss = "".join(x[1] for _, r, x in turns if r[1] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[100].valid_order and not got[101].valid_order and not got[102].valid_order
    assert chat.format_chat(df.limit(0)).count() == 0
