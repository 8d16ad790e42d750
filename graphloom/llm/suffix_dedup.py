"""Removal of repeated strings by sparse suffix arrays (operator 8): of 400 bytes, or of 50 words.

Each letter goes that a string of the given length covers which also starts anywhere else, in the same document or
another. Letters are bytes, or words as 64-bit hashes (A-Z lower-cased, white space not heeded; two words meet with a
chance of 2**-64 a pair). What follows is told for 400 bytes; 50 words take the same way with their own lengths.

1. Of the 301 hundred-byte strings in a 400-byte string, the one of least hash (the leftmost of equals) is its anchor.
   Equal strings have equal anchors at equal distances. So all windows of a document fall to some anchors, about one in
   150 bytes, and only windows of anchors with equal hashes can be equal. A window's anchor, and the stretch of text
   that the windows of an anchor span (its segment), are hashed in one pass.
2. Anchors that occur once are done with. Segments that occur twice or more are repeated as a whole, whatever else
   holds: they are counted, not gathered. Of each other segment of a shared anchor, and one of each repeated, the text
   is sent to the anchor's group.
3. In a group, the suffixes that begin at the anchors are sorted (deep-shallow, see suffix_sort), and so are the
   reversed texts before them. A window at distance d before the anchor is repeated when another member agrees in d
   bytes to the left and 400 - d to the right; both are read from the common prefixes in the two orders.
   Groups of more than ``CROWD`` members are not gathered: their windows are counted one by one.

A text of fewer letters than the length has no such string.

Null and empty texts have nothing to remove. Every row is judged by its own text: the same row twice is a copy, unlike texts
under one id are texts of their own, and so are those without an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrays import LOWER, mix, prefix_hash, slices, span_hash, spread, trimmed, utf8, word_hashes, word_spans
from graphloom.llm.shared import Tables, width
from graphloom.llm.suffix_sort import lcp, suffix_array

CHUNK = 1 << 20
CROWD = 20_000
#: Segments of more copies than MANY are broadcast while there are at most FEW of them (16 bytes each).
MANY, FEW = 500, 200_000


@dataclass(frozen=True)
class Letters:
    """What strings are made of: ``length`` letters to a repeated string, ``gram`` to an anchor, ``size`` bytes to a letter."""

    length: int
    gram: int
    size: int

    @property
    def reach(self) -> int:
        return self.length - self.gram

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The letters of all rows, and each row's range in them (rows + 1)."""
        data, off = utf8(column)
        return (data, off) if self.size == 1 else word_hashes(data, off)

    def of(self, part: bytes) -> np.ndarray:
        return np.frombuffer(part, np.uint8 if self.size == 1 else np.uint64)


BYTES = Letters(length=400, gram=100, size=1)
WORDS = Letters(length=50, gram=12, size=8)


def _sliding_least(key: np.ndarray, size: int) -> np.ndarray:
    """The least of key[i : i + size] for each i that has so many."""
    n = len(key)
    blocks = -(-n // size)
    padded = np.full(blocks * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, size)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - size + 1], before[size - 1 : n])


def anchors(data: np.ndarray, off: np.ndarray, letters: Letters = BYTES) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last, anchor hash, segment hash): windows first..last (starts within the row) fall to the anchor.

    A row longer than CHUNK is taken in pieces that share all letters but one of a window; each window is in one piece.
    """
    length, gram = letters.length, letters.gram
    out = []
    for lo, hi, rows in _pieces(off, length):
        part = data[lo:hi]
        if len(part) < length:
            continue
        p = prefix_hash(part)
        start = np.arange(len(part) - gram + 1)
        h = span_hash(p, start, start + gram)
        place = _sliding_least((h & ~np.uint64(0xFFFFFF)) | start.astype(np.uint64), letters.reach + 1) & np.uint64(0xFFFFFF)
        place = place.astype(np.int64)
        begin = np.array([b - lo for _, b, _, _ in rows])
        end = np.array([e - lo for _, _, e, _ in rows])
        counts = np.maximum(end - begin - length + 1, 0)
        s = spread(begin, counts)
        if not len(s):
            continue
        of = np.repeat(np.arange(len(rows)), counts)
        a = place[s]
        head = np.ones(len(s), bool)
        head[1:] = (a[1:] != a[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(s)) - 1
        a, s1, s2, of = a[first], s[first], s[last], of[first]
        shift = np.array([b - lo - skip for _, b, _, skip in rows])[of]
        seg = mix(span_hash(p, s1, s2 + length) ^ ((a - s1).astype(np.uint64) << np.uint64(32) | (s2 - s1).astype(np.uint64)))
        out.append((np.array([r for r, _, _, _ in rows])[of], a - shift, s1 - shift, s2 - shift, h[a], seg))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pieces(off: np.ndarray, length: int) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """(from, to, rows) with rows (row, from, to, letters of the row before it), of about CHUNK letters."""
    held: list[tuple[int, int, int, int]] = []
    for r, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        at = a
        while True:
            to = min(b, at + CHUNK + length - 1)
            if held and to - held[0][1] > CHUNK + length:
                yield held[0][1], held[-1][2], held
                held = []
            held.append((r, at, to, at - a))
            if to == b:
                break
            yield held[0][1], held[-1][2], held
            held = []
            at += CHUNK
    if held:
        yield held[0][1], held[-1][2], held


def repeated_windows(members: list[tuple[bytes, int, int]], letters: Letters = BYTES) -> list[list[tuple[int, int]]]:
    """For each member (text, letters before the anchor, windows), the ranges (from, to) of its windows that another member has."""
    m, size, length = len(members), letters.size, letters.length
    right = [t[o * size :] for t, o, _ in members]
    left = [letters.of(t[: o * size])[::-1].tobytes() for t, o, _ in members]
    if m == 2:
        r, x = lcp(right[0], right[1]) // size, lcp(left[0], left[1]) // size
        lo, hi = max(0, length - r), x
        return [[(o - min(hi, o), o - max(lo, o - n + 1))] if min(hi, o) >= max(lo, o - n + 1) else [] for _, o, n in members]
    sa, ra = suffix_array(right)
    la, rl = suffix_array(left)
    ra, rl = ra // size, rl // size
    hit = np.zeros((m, letters.reach + 2), bool)  # by distance of the window before the anchor
    right_class, left_class = np.empty(m, np.int64), np.empty(m, np.int64)
    far = max(o for _, o, _ in members)
    near = min(max(0, o - n + 1) for _, o, n in members)
    for d in range(near, min(far, letters.reach) + 1):
        right_class[sa] = np.cumsum(ra < length - d)
        left_class[la] = np.cumsum(rl < d)
        both = right_class * (m + 1) + left_class
        order = np.argsort(both, kind="stable")
        v = both[order]
        same = v[1:] == v[:-1]
        twin = np.zeros(m, bool)
        twin[order[1:][same]] = True
        twin[order[:-1][same]] = True
        hit[:, d] = twin
    out = []
    for i, (_, o, n) in enumerate(members):
        ok = hit[i, max(0, o - n + 1) : o + 1][::-1]  # by window
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
        out.append(list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)))
    return out


def _texts(docs: DataFrame, wanted: DataFrame, letters: Letters) -> DataFrame:
    """(khash, doc_id, first, before, windows, alone, part, crowd) for each wanted segment. wanted: doc_id, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                data, off = letters.read(b.column(1))
                out = []
                for r, (doc, packed) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    text = data[off[r] : off[r + 1]]
                    for s in packed:
                        out.append((s["khash"], doc, s["first"], s["anchor"] - s["first"], s["last"] - s["first"] + 1, s["alone"], text[s["first"] : s["last"] + letters.length].tobytes(), s["crowd"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.bool_()), strict=True)], ["khash", "doc_id", "first", "before", "windows", "alone", "part", "crowd"])

    return docs.join(wanted, "doc_id").select("doc_id", "text", "packed").mapInArrow(trimmed(run), "khash long, doc_id long, first long, before int, windows int, alone boolean, part binary, crowd boolean")


def _groups(parts: DataFrame, letters: Letters) -> DataFrame:
    """(doc_id, first, last): ranges of repeated windows. Rows of a group stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def close() -> None:
            if len(held) > 1:
                for (doc, first, _, _, alone, _), found in zip(held, repeated_windows([(h[5], h[2], h[3]) for h in held], letters), strict=True):
                    if alone:
                        out.extend((doc, first + x, first + y) for x, y in found)
            held.clear()

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "first", "last"])
            out.clear()
            return b

        for b in batches:
            for k, *row in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
                if k != now:
                    close()
                    now = k
                held.append(row)
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return parts.mapInArrow(trimmed(run), "doc_id long, first long, last long")


def _crowds(parts: DataFrame, letters: Letters) -> DataFrame:
    """The same for groups of any size: each window's hashes are counted, and no group is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, doc, first, before, n, alone, part in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
                p = prefix_hash(letters.of(part))
                s = np.arange(n)
                h = span_hash(p, s, s + letters.length)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(mix(h ^ np.uint64(before) - s.astype(np.uint64)).view(np.int64)), pa.array(np.full(n, doc)), pa.array(s + first), pa.array(np.full(n, alone))], ["h", "g", "doc_id", "first", "alone"])

    w = parts.mapInArrow(trimmed(run), "h long, g long, doc_id long, first long, alone boolean")
    twice = w.groupBy("h", "g").agg(F.count("*").alias("k")).where("k > 1").select("h", "g")
    return w.where("alone").join(twice, ["h", "g"]).select("doc_id", "first", F.col("first").alias("last"))


def repeats(docs: DataFrame, tables: Tables, letters: Letters = BYTES) -> DataFrame:
    """(doc_id, first, last): ranges of each document's repeated windows by their starts. A window may be in two ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK):
            row, a, s1, s2, h, seg = anchors(*letters.read(b.column(1)), letters)
            if len(row):
                ids = b.column(0).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(a), pa.array(s1), pa.array(s2), pa.array(h.view(np.int64)), pa.array(seg.view(np.int64))], ["doc_id", "anchor", "first", "last", "khash", "seg"])

    docs = docs.where("doc_id IS NOT NULL")
    found = tables.write(docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, anchor long, first long, last long, khash long, seg long"))
    # written, so that both sides of the join are shuffled as they are, and Spark can split a hot anchor's partition
    shared = tables.write(found.groupBy("khash").agg(F.count("*").alias("k")).where("k > 1").select("khash"))
    common = tables.write(found.join(shared, "khash"))
    tables.drop(found, shared)
    segs = common.groupBy("khash", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "anchor", "first", "last")).alias("one"))
    segs = tables.write(segs)
    # segments of very many copies are few, and are met where their rows stand; the others' rows are dealt out
    twice, keys = segs.where("copies > 1").select("khash", "seg", "copies"), ["khash", "seg"]
    hot = tables.write(twice.where(F.col("copies") > MANY).select(*keys))
    if hot.limit(FEW + 1).count() <= FEW:
        other = common.join(F.broadcast(hot), keys, "left_anti").join(twice.where(F.col("copies") <= MANY).select(*keys), keys)
        whole = common.join(F.broadcast(hot), keys).unionByName(other.select(common.columns))
    else:
        whole = common.join(twice.select(*keys), keys)
    whole = whole.select("doc_id", "first", "last")
    kinds = segs.groupBy("khash").agg(F.count("*").alias("kinds")).where("kinds > 1")
    need = segs.join(kinds, "khash").select("khash", "kinds", "one.*", (F.col("copies") == 1).alias("alone"), (F.col("kinds") > CROWD).alias("crowd"))
    need = tables.write(need)
    wanted = tables.write(need.groupBy("doc_id").agg(F.collect_list(F.struct("khash", "anchor", "first", "last", "alone", "crowd")).alias("packed")))
    texts = _texts(docs.select("doc_id", "text"), wanted, letters)
    parts = _groups(texts.where("NOT crowd").drop("crowd").repartition(width(docs.sparkSession), "khash").sortWithinPartitions("khash"), letters)
    if not need.where("crowd").isEmpty():
        parts = parts.unionByName(_crowds(texts.where("crowd").drop("crowd"), letters))
    out = tables.write(whole.unionByName(parts))
    tables.drop(common, segs, hot, need, wanted)
    del found, shared, common, segs, twice, hot, whole, kinds, need, wanted, texts, parts
    tables.tidy()
    return out


def runs(spans: list | None, letters: Letters = BYTES) -> list[tuple[int, int]]:
    """Maximal runs (from, to) of repeated letters."""
    own = [(s["first"], s["last"] + letters.length) for s in spans or () if s["size"] == letters.size]
    return joined(own)


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(text: bytes, spans: list | None) -> list[tuple[int, int]]:
    """Maximal runs (from, to) of bytes that repeated strings of either letters cover; of words, also what stands between them."""
    found, words = runs(spans), runs(spans, WORDS)
    if words:
        data = LOWER[np.frombuffer(text, np.uint8)]
        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
        found += [(int(starts[a]), int(ends[b - 1])) for a, b in words]
    return joined(found)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_spans(docs: DataFrame, name: str, letters: tuple[Letters, ...] = (BYTES,)) -> DataFrame:
    """The documents with a column ``name`` of repeated window ranges (first, last, size of a letter; null: none).

    Rows are told apart by doc_id. Where ids are null or repeated, the table is written once with numbers of its own, so that
    each row is judged by its own text.
    """
    tables = Tables(docs.sparkSession, "suffix")
    row, key = unused("_row", [*docs.columns, name]), unused("_id", [*docs.columns, name])
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        docs = docs.withColumn(row, F.col("doc_id").cast("long"))
    else:
        docs = tables.write(docs.withColumn(row, F.monotonically_increasing_id()))
    slim = docs.select(F.col(row).alias("doc_id"), "text")
    found = [repeats(slim, tables, x).withColumn("size", F.lit(x.size)) for x in letters]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    spans = tables.write(every.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("first", "last", "size")).alias(name)))
    return docs.join(spans, docs[row] == spans[key], "left").drop(key, row)


def without_repeats(docs: DataFrame, letters: tuple[Letters, ...] = (BYTES,)) -> DataFrame:
    """The documents with repeated strings cut out of ``text``, other columns as they are, n_chars as the new text has them.

    A character cut in half goes whole. A null text stays null.
    """
    name = unused("_spans", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = []
                for t, s in zip(b.column("text").to_pylist(), b.column(name).to_pylist(), strict=True):
                    if t is not None and s:
                        t = cut(t.encode(), s).decode(errors="ignore")
                    texts.append(t)
                cols = {c: b.column(c) for c in b.schema.names if c != name}
                cols["text"] = pa.array(texts, pa.string())
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_pydict(cols)

    return with_spans(docs, name, letters).mapInArrow(trimmed(run), docs.schema)


def cut(text: bytes, spans: list | None) -> bytes:
    return _cut(text, removed(text, spans))


def _cut(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in gone:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns are those of 400-byte strings. n_repeated_words counts the words that 50-word strings cover
    which also start anywhere else; it is told only, and nothing is cut for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, t, s in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                t = (t or "").encode()
                gone = runs(s)
                words = sum(y - x for x, y in runs(s, WORDS))
                rows.append((doc, len(t), sum(y - x for x, y in gone), len(gone), hashlib.sha256(_cut(t, gone)).hexdigest(), words))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_spans(docs, "_spans", (BYTES, WORDS)).select("doc_id", "text", "_spans").mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long")
