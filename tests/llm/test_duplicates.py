"""Jaccard join and suffix deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from graphloom.llm import arrays, jaccard_join, suffix_dedup, suffix_sort


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets, parent = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_join_is_brute_force(odd_docs, odd_texts, no_docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd_docs).collect()}
    assert got == components(odd_texts)
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_all_links_are_brute_force(odd_docs, odd_texts, no_docs):
    found, member = jaccard_join.jaccard_join(odd_docs)
    sets = {i: shingles(t) for i, t in odd_texts}
    of = {i: min(j for j in sets if sets[j] == s) if s else None for i, s in sets.items()}
    reps = sorted({c for c in of.values() if c is not None})
    want = {(a, b): len(sets[a] & sets[b]) for x, b in enumerate(reps) for a in reps[:x] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {(r.doc_a, r.doc_b): r.overlap for r in found.collect()} == want and len(want) > 5
    links = {r.doc_id: (r.class_id, r.n_shingles, r.n_links) for r in member.collect()}
    assert links == {i: (of[i], len(s), sum(of[i] in p for p in want)) for i, s in sets.items()}
    found, member = jaccard_join.jaccard_join(no_docs)
    assert found.count() == member.count() == 0


@pytest.mark.parametrize("few", [0, 2])
def test_many_near_copies(spark, monkeypatch, few):
    """A large group of which only some pairs link, by stars alone and with all pairs at the end."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    rng = random.Random(8)
    base = [f"v{rng.randrange(50)}" for _ in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        if i % 3 == 0:
            w = w[: rng.randint(50, 80)]
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("1", "1"), ("1", "1"), ("2", "1"), ("None", "None")]


def kept(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    at = defaultdict(int)
    for _, b in texts:
        for s in range(len(b) - 399):
            at[b[s : s + 400]] += 1
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - 399):
            if at[b[s : s + 400]] > 1:
                gone[s : s + 400] = b"\x01" * 400
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def without_strings(rows, length=400, size=50):
    """The texts (ASCII) without what 400-byte strings or strings of 50 words cover."""
    at = defaultdict(int)
    for _, t in rows:
        for s in range(len(t) - length + 1):
            at[t[s : s + length]] += 1
    spans = {i: [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0d]+", t)] for i, t in rows}
    own = {i: words(t) for i, t in rows}
    for w in own.values():
        for s in range(len(w) - size + 1):
            at[tuple(w[s : s + size])] += 1
    out = {}
    for i, t in rows:
        gone, w = set(), own[i]
        for s in range(len(t) - length + 1):
            if at[t[s : s + length]] > 1:
                gone.update(range(s, s + length))
        for s in range(len(w) - size + 1):
            if at[tuple(w[s : s + size])] > 1:
                gone.update(range(spans[i][s][0], spans[i][s + size - 1][1]))
        out[i] = "".join(c for k, c in enumerate(t) if k not in gone)
    return out


def digests(df):
    out = {}
    for r in suffix_dedup.with_spans(df.select("doc_id", "text"), "s").collect():
        b = (r.text or "").encode()
        gone = suffix_dedup.removed(b, r.s)
        out[r.doc_id] = (len(b), sum(y - x for x, y in gone), len(gone), hashlib.sha256(suffix_dedup.cut(b, r.s)).hexdigest())
    return out


@pytest.mark.parametrize("crowd,chunk", [(20_000, 1 << 20), (1, 3000)])
def test_suffix_dedup_is_brute_force(odd_docs, odd_texts, monkeypatch, crowd, chunk):
    """Also with every group counted window by window, and with rows longer than a chunk."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in odd_texts]
    df = odd_docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digests(df) == kept(rows)


def test_pieces_share_windows(monkeypatch):
    """Rows longer than a chunk give each window to one anchor."""
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    data = np.frombuffer(random.Random(3).randbytes(7000), np.uint8)
    off = np.array([0, 100, 5200, 5200, 7000])
    row, _, first, last, _, _ = suffix_dedup.anchors(data, off)
    for r in range(4):
        n = max(0, off[r + 1] - off[r] - 399)
        starts = sorted(x for a, b in zip(first[row == r], last[row == r], strict=True) for x in range(a, b + 1))
        assert starts == list(range(n))


def words_kept(rows, size=50):
    """(repeated words, the text without them) by brute force."""
    spans = {i: [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0d]+", t or "")] for i, t in rows}
    own = {i: words(t) for i, t in rows}
    at = defaultdict(int)
    for w in own.values():
        for s in range(len(w) - size + 1):
            at[tuple(w[s : s + size])] += 1
    out = {}
    for i, t in rows:
        w, gone = own[i], [False] * len(own[i])
        for s in range(len(w) - size + 1):
            if at[tuple(w[s : s + size])] > 1:
                gone[s : s + size] = [True] * size
        text, k = list(t or ""), 0
        while k < len(w):
            e = k
            while e < len(w) and gone[e]:
                e += 1
            if e > k:
                text[spans[i][k][0] : spans[i][e - 1][1]] = [""] * (spans[i][e - 1][1] - spans[i][k][0])
            k = e + 1
        out[i] = (sum(gone), "".join(text))
    return out


@pytest.mark.parametrize("crowd,chunk", [(20_000, 1 << 20), (1, 300)])
def test_repeated_words_are_brute_force(odd_docs, odd_texts, monkeypatch, crowd, chunk):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in odd_texts]
    rows += [(900, "Tail " + " ".join(f"Q{k % 61}" for k in range(52))), (901, "  ".join(f"q{k % 61}" for k in range(52)) + "\nend")]
    df = odd_docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = words_kept(rows)
    assert want[900][0] == want[901][0] == 52
    found = suffix_dedup.with_spans(df, "s", (suffix_dedup.WORDS,)).collect()
    assert {r.doc_id: sum(y - x for x, y in suffix_dedup.runs(r.s, suffix_dedup.WORDS)) for r in found} == {i: n for i, (n, _) in want.items()}
    assert {r.doc_id: suffix_dedup.cut((r.text or "").encode(), r.s).decode() for r in found} == {i: t for i, (_, t) in want.items()}


def test_planted_passages_go(spark):
    """Passages of 51 to 70 words, far under 400 bytes, that stand in several documents; other texts are left alone."""
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n))
    passages = [fresh(n) for n in (51, 55, 60, 70)]
    rows, clean = [], {}
    for i in range(60):
        if i % 2:
            rows.append((i, f"{fresh(40)} {passages[i % 4]} {fresh(30)}"))
        else:
            clean[i] = fresh(100)
            rows.append((i, clean[i]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs, (suffix_dedup.BYTES, suffix_dedup.WORDS)).collect()}
    assert all(got[i] == t for i, t in clean.items())
    assert all(len(got[i].split()) == 70 and passages[i % 4] not in got[i] for i in got if i % 2)


def test_texts_keep_their_columns(odd_docs, no_docs):
    both = suffix_dedup.without_repeats(odd_docs, (suffix_dedup.BYTES, suffix_dedup.WORDS))
    assert both.columns == odd_docs.columns and both.count() == odd_docs.count()
    out = suffix_dedup.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert suffix_dedup.without_repeats(no_docs).count() == 0
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.collect())


def test_rows_are_told_apart_by_more_than_their_id(spark):
    """Unlike texts under one id, repeated rows and rows without an id are each judged by their own text."""
    rng = random.Random(13)
    fresh = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randrange(5000)}" for _ in range(n))
    long, clean = fresh(150), fresh(220)
    rows = [(1, f"{fresh(60)} {long} {fresh(60)}"), (1, clean), (1, "short"), (2, f"{long} tail"), (None, fresh(120)), (None, f"x {long}"), (3, None), (4, fresh(90))]
    rows += [(5, rows[7][1])] + [(6, "twice " * 100)] * 2
    numbered = [(k, t or "") for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row long").repartition(3)
    both = (suffix_dedup.BYTES, suffix_dedup.WORDS)
    got = {r["_row"]: r.text for r in suffix_dedup.without_repeats(df, both).collect()}
    want = without_strings(numbered)
    assert {k: t or "" for k, t in got.items()} == want and got[6] is None
    assert got[1] == clean and got[2] == "short" and got[4] == rows[4][1] and long not in got[0]


def test_suffix_sort_orders():
    rng = random.Random(6)
    for _ in range(200):
        x = [b"pp" + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) + b"c" * rng.choice([0, 0, 300]) for _ in range(rng.randint(1, 80))]
        sa, common = suffix_sort.suffix_array(x, 2)
        assert [x[i] for i in sa] == sorted(x)
        for a, b, n in zip(sa[:-1], sa[1:], common[1:], strict=True):
            assert x[a][:n] == x[b][:n] and (len(x[a]) == n or len(x[b]) == n or x[a][n] != x[b][n])


def test_word_arrays(odd_texts):
    import pyarrow as pa

    texts = [t for _, t in odd_texts]
    data, off = arrays.utf8(pa.array(texts))
    hashes, rows = arrays.word_hashes(data, off, part=500)
    known = {}
    for r, t in enumerate(texts):
        own = words(t)
        assert rows[r + 1] - rows[r] == len(own)
        for w, h in zip(own, hashes[rows[r] : rows[r + 1]].tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_blocks_of_shingles_come_back():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        v, r = np.sort(rng.integers(0, 1 << 48, n, dtype=np.uint64)), rng.integers(0, 70_000 if n > 5 else 9, n)
        got = jaccard_join._decode(jaccard_join._code(v, r))
        assert np.array_equal(got[0], v) and np.array_equal(got[1], r)
