"""Decontamination and license scans against brute force; the pipeline."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontamination, license_scan, windows
from tests.llm.test_duplicates import words


def bag(w, k=5):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    rows = [(i, words(t)) for i, t in items if words(t)]
    bags = {i: (w, min(5, len(w)), bag(w, min(5, len(w)))) for i, w in rows}
    df = Counter(s for _, _, b in bags.values() for s in b)
    weight = lambda s: round(1000 * math.log1p(len(rows) / df[s] if s in df else len(rows)))
    out = {}
    for d, t in docs:
        w = words(t)
        for i, (iw, k, b) in bags.items():
            m = min(len(iw), len(w))
            for s in range(len(w) - m + 1) if m >= k else ():
                c = bag(w[s : s + m], k)
                both = sum(weight(x) * min(n, c[x]) for x, n in b.items())
                if both:
                    sim = both / (sum(weight(x) * n for x, n in b.items()) + sum(weight(x) * n for x, n in c.items()) - both)
                    if sim >= 0.75:
                        out[d, i] = max(out.get((d, i), 0), sim)
    return out


@pytest.fixture(scope="module")
def leaky(odd_texts):
    rng = random.Random(9)
    items = [(k, " ".join(f"q{rng.randrange(80)}" for _ in range(rng.choice([3, 12, 30, 45])))) for k in range(25)] + [(90, None), (91, ""), (92, "only three words"), (93, "same same same same same same same same")]
    docs = [(i, t) for i, t in odd_texts if t is None or len(t) < 9000]
    for n, (k, t) in enumerate(items[:25]):
        w = t.split()
        if n % 3 == 1:
            w[0] = "changed"
        if n % 3 == 2:
            w[len(w) // 2] = "changed"
        docs.append((1000 + n, f"before it {' '.join(w).upper() if n % 2 else ' '.join(w)} and after"))
    docs += [(2000, items[3][1]), (2001, items[3][1]), (2002, "Only THREE words"), (2003, "same " * 30)]
    return docs, items


def test_decontamination_is_brute_force(spark, odd_docs, leaky, monkeypatch):
    docs, items = leaky
    clash = ("item_id", "similarity", "first_word", "n_words", "ids")
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("z").alias(c) for c in clash]).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("y"))
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contamination(d, b).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert len(want) > 15
    assert decontamination.contamination(d, b.limit(0)).count() == 0 and decontamination.contamination(d.limit(0), b).count() == 0


def test_many_items_take_several_passes(spark, leaky, monkeypatch):
    """Weights come from the items of a pass, so exact copies are what must not depend on the blocks."""
    docs, items = leaky
    monkeypatch.setattr(windows, "BLOCK", 400)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contamination(d, b).collect()}
    assert {(2000, 3), (2001, 3), (1000, 0), (1003, 3)} <= got


def test_hamming_index_finds_all_and_prunes():
    """Everything within the radius is listed, and of all else only a small part."""
    import numpy as np

    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 16, (2000, 16), dtype=np.uint16)
    index = decontamination.HammingIndex(prints)
    bits = lambda x: np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1)
    for n in range(120):
        flips = np.zeros(256, np.uint8)
        flips[rng.choice(256, decontamination.RADIUS - n % 9 if n % 3 else 20, replace=False)] = 1
        q = prints[rng.integers(2000)] ^ np.packbits(flips).view(np.uint16)
        want = np.flatnonzero((bits(prints) ^ bits(q[None])).sum(axis=1) <= decontamination.RADIUS)
        assert len(want) and np.array_equal(index.search(q), want)
    assert index.listed / index.probes / len(prints) < 0.02


def test_fingerprints_are_those_of_each_window(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    sh, w = rng.integers(0, 1 << 63, 900, dtype=np.uint64), rng.integers(1, 50, 900)
    starts = np.unique(rng.integers(0, 860, 200))
    whole = decontamination.fingerprints(sh, w, starts, 40)
    monkeypatch.setattr(decontamination, "STRETCH", 30)
    assert np.array_equal(whole, decontamination.fingerprints(sh, w, starts, 40))
    one = np.concatenate([decontamination.fingerprints(sh[s : s + 40], w[s : s + 40], np.zeros(1, np.int64), 40) for s in starts])
    assert np.array_equal(whole, one)


def test_licenses_are_brute_force(spark):
    rng = random.Random(2)
    names = list(license_scan.TEMPLATES)
    docs = []
    for i in range(60):
        w = license_scan.TEMPLATES[names[i % len(names)]].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = "other"
        docs.append((i, f"x y z {' '.join(w)} x y" if i % 2 else " ".join(w)))
    docs += [(100, None), (101, ""), (102, "a clean text of no license at all"), (103, docs[0][1])]
    for i in range(40):  # stretches of licenses inside longer texts, some too short to count
        w = license_scan.TEMPLATES[names[i % len(names)]].split()
        cut = rng.randrange(max(1, len(w) // 3))
        docs.append((200 + i, " ".join([f"p{rng.randrange(99)}" for _ in range(rng.randrange(60))] + w[cut:] + [f"s{k}" for k in range(rng.randrange(60))])))
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("license", "containment", "first_word", "n_words")])
    got = {(r.doc_id, r.license): round(r.containment, 9) for r in license_scan.license_scan(df).collect()}
    table = spark.createDataFrame(list(license_scan.TEMPLATES.items()), "license string, text string")
    assert license_scan.license_scan(df, table).count() == len(got) and license_scan.license_scan(df.limit(0)).count() == 0
    assert license_scan.license_scan(df, table.limit(0)).count() == 0
    want = {}
    for d, t in docs:
        w = words(t)
        for name, text in license_scan.TEMPLATES.items():
            tw = words(text)
            b, m = set(bag(tw)), min(len(tw), len(w))
            best = max((len(b & set(bag(w[s : s + m]))) / len(b) for s in range(len(w) - m + 1)), default=0) if m >= 5 else 0
            if best >= 0.75:
                want[d, name] = round(best, 9)
    assert got == want and len(want) >= 30


def test_templates_in_blocks(spark, monkeypatch):
    """More templates than are broadcast at once, and very long texts: the same rows, in several passes."""
    rng = random.Random(17)
    fresh = lambda n: " ".join(f"t{rng.randrange(900)}" for _ in range(n))
    texts = {f"l{k:02d}": fresh(rng.choice([9, 30, 80])) for k in range(25)}
    docs = spark.createDataFrame([(k, f"{fresh(30)} {t} {fresh(30)}") for k, t in enumerate(texts.values())] + [(90, f"{fresh(40_000)} {texts['l03']} {fresh(40_000)}"), (91, None), (92, "")], "doc_id long, text string")
    want = sorted(map(tuple, license_scan.license_scan(docs, texts).collect()))
    assert {r[:2] for r in want} >= {(k, name) for k, name in enumerate(texts)} | {(90, "l03")}
    monkeypatch.setattr(license_scan, "MOST", 1500)
    table = spark.createDataFrame([*texts.items(), ("none", None)], "license string, text string")
    assert len(list(license_scan.template_blocks(table))) > 3 and len(list(license_scan.template_blocks(texts))) > 3
    assert sorted(map(tuple, license_scan.license_scan(docs, table).collect())) == want
    assert sorted(map(tuple, license_scan.license_scan(docs, texts).collect())) == want


def test_near_duplicates_of_repeated_ids(spark):
    """Of equal rows one stays; unlike texts under one id all stay, unless the id is linked to a smaller one."""
    import corpus_pipeline as C

    rng = random.Random(19)
    fresh = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(40))
    a, b, c = fresh(), fresh(), fresh()
    rows = [(1, a, "y"), (1, a, "x"), (1, b, "x"), (2, c, "x"), (3, f"{a} end", "x"), (None, a, "x"), (None, None, "x"), (4, None, "x"), (4, None, "x"), (5, "", "x")]
    got = C.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted(map(key, got)) == sorted(map(key, [(1, a, "x"), (1, b, "x"), (2, c, "x"), (None, a, "x"), (None, None, "x"), (4, None, "x"), (5, "", "x")]))


def test_pipeline(spark, odd_docs, tmp_path):
    import corpus_pipeline as C

    from tests.conftest import SMALL

    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "score")
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    last = C.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == docs.count() and last.columns[0] == "doc_id"
    ids = {r.doc_id for r in docs.collect()}
    assert 0 in ids and 40 not in ids  # a copy of document 3


def test_pipeline_of_nothing(spark, no_docs):
    import corpus_pipeline as C

    from tests.conftest import SMALL

    docs = no_docs
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_pipeline_is_brute_force(spark, tmp_path):
    """Every stage at once, against plain Python on a small table: what stays, its text, and its tokens."""
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline as C
    from graphloom.llm import byte_bpe
    from tests.llm.test_duplicates import components, without_strings

    rng = random.Random(21)
    fresh = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(2000)}" for _ in range(n))
    items = [(k, fresh(rng.choice([12, 25, 40]))) for k in range(5)]
    shared, long = fresh(55), fresh(90)
    rows = [(i, fresh(rng.randint(20, 150))) for i in range(30)]
    rows += [(30, rows[3][1]), (31, rows[4][1] + " end"), (32, None), (33, ""), (34, "123 !!"), (35, f"{fresh(40)} {items[1][1]} {fresh(40)}")]
    rows += [(40 + k, f"{fresh(80)} {shared if k % 2 else long} {fresh(90)}") for k in range(6)]
    docs = [(i, t, ["en", "de", None][i % 3], "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_tokens, list(r.ids)) for r in C.run(spark, str(tmp_path)).collect()}

    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    near = components(left)
    left = [(i, t) for i, t in left if near[i][1] == i]
    left = list(without_strings(left).items())
    bad = {d for d, _ in brute(left, items)}
    assert bad == {35}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks, special_tokens={})
    want = {i: enc.encode_ordinary(t) for i, t in left if i not in bad}
    assert got == {i: (len(x), x) for i, x in want.items()} and 30 not in got and 31 not in got


def test_rows_without_an_id_are_decontaminated(spark, tmp_path):
    import corpus_pipeline as C

    item = " ".join(f"z{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(None, f"a {item} b"), (None, "clean text"), (None, None), (5, item), (6, "clean")], "doc_id long, text string").withColumn("_key", F.lit(0))
    got = C.decontaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [("6", "clean"), ("None", "None"), ("None", "clean text")]


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
