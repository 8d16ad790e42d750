"""Byte-level BPE encoding and decoding by DuckDB recursive queries (operator 4).

In each partition the distinct pre-tokens of a batch become token-position rows; a recursive query joins neighbours
with the merge table and contracts each word's leftmost pair of least rank until no pair is left. Ordered aggregation
reads the ids. A text's ids are those of its pre-tokens in order. decode() turns lists of ids into texts by ordered
aggregation of the vocabulary's bytes; where ids have just been made, their bytes are looked up in one array instead.

Pre-tokens of more than ``LONG`` bytes, which would take a round of the query for each merge, are merged by a heap: the
same merges in the same order.

Null and empty texts have no ids. Special strings are ordinary text. Long texts are read whole. Repeated rows are each
encoded. Columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrays import CACHES, slices, spread, trimmed

#: Longer pre-tokens (bytes) have too many rounds for the query; a heap makes the same merges.
LONG = 128
REMEMBERED = 200_000
ROUND = 20_000
_coders: dict[tuple[str, str], Coder] = CACHES.setdefault("byte_bpe", {})

#: State rows hold a token, the position and token after it, and the token that the two join to, if any. A word's
#: least joined token (which is the pair's rank), at the leftmost position, is contracted in each step.
CONTRACT = """
WITH RECURSIVE state(step, word, pos, id, next_pos, next_id, joined) AS (
    SELECT 0, s.word, s.pos, s.id, s.next_pos, s.next_id, m.joined
    FROM start s LEFT JOIN merges m ON m.pair = s.id::BIGINT * 65536 + s.next_id
  UNION ALL
    (WITH best AS (
        SELECT word, min(joined * 1024 + pos) AS b FROM state WHERE joined IS NOT NULL GROUP BY word),
     spot AS (
        SELECT s.word, s.pos AS p, s.joined AS j, s.next_pos AS q
        FROM best JOIN state s ON s.word = best.word AND s.joined * 1024 + s.pos = best.b),
     hit AS (
        SELECT spot.*, s.next_pos AS after, s.next_id AS after_id
        FROM spot JOIN state s ON s.word = spot.word AND s.pos = spot.q),
     contracted AS (
        SELECT s.step + 1 AS step, s.word, s.pos,
               CASE WHEN s.pos = p THEN j ELSE s.id END AS id,
               CASE WHEN s.pos = p THEN after ELSE s.next_pos END AS next_pos,
               CASE WHEN s.pos = p THEN after_id WHEN s.next_pos = p THEN j ELSE s.next_id END AS next_id
        FROM state s JOIN hit ON hit.word = s.word WHERE s.pos <> q)
     SELECT c.*, m.joined FROM contracted c LEFT JOIN merges m ON m.pair = c.id::BIGINT * 65536 + c.next_id)
), last AS (SELECT word, max(step) AS step FROM state WHERE pos = 0 GROUP BY word)
SELECT s.word, list(s.id ORDER BY s.pos) AS ids
FROM state s JOIN last USING (word, step)
GROUP BY s.word
"""


class Coder:
    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.iter = regex.compile(pattern).finditer
        self.pairs = {(l, r): i for t, i in self.ranks.items() for k in range(1, len(t)) if (l := self.ranks.get(t[:k])) is not None and (r := self.ranks.get(t[k:])) is not None}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "120MB", "preserve_insertion_order": False})
        merges = pa.table({"pair": pa.array([l << 16 | r for l, r in self.pairs], pa.int64()), "joined": pa.array(self.pairs.values(), pa.int64())})
        vocabulary = pa.table({"id": pa.array(self.bytes, pa.int32()), "hex": pa.array([t.hex() for t in self.bytes.values()])})
        self.db.register("m", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.register("v", vocabulary)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        #: pre-token -> ids as little-endian 32-bit integers
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        #: the vocabulary's bytes one after another, by id, to decode lists of ids at once
        top = max(self.bytes) + 1
        self.size = np.zeros(top, np.int64)
        self.size[list(self.bytes)] = [len(t) for t in self.bytes.values()]
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes[i] for i in sorted(self.bytes)), np.uint8)

    def learn(self, words: set[str]) -> None:
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.before, self.known, new = self.known, {}, words
        rest: list[tuple[str, bytes]] = []
        for w in new:
            b = w.encode()
            if (old := self.before.get(w)) is not None:
                self.known[w] = old
            elif (i := self.ranks.get(b)) is not None:
                self.known[w] = struct.pack("<I", i)
            elif len(b) > LONG:
                ids = self.long(b)
                self.known[w] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append((w, b))
        for at in range(0, len(rest), ROUND):
            part = rest[at : at + ROUND]
            size = np.array([len(b) for _, b in part])
            ids = self.single[np.frombuffer(b"".join(b for _, b in part), np.uint8)]
            pos = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
            ends = np.cumsum(size) - 1
            following, next_ids = pos + 1, np.append(ids[1:], -1)
            following[ends], next_ids[ends] = -1, -1
            columns = {"word": np.repeat(np.arange(len(part)), size), "pos": pos, "id": ids, "next_pos": following, "next_id": next_ids}
            start = pa.table({k: v.astype(np.int32) for k, v in columns.items()})
            self.db.register("start", start)
            out = self.db.sql(CONTRACT).to_arrow_table()
            self.db.unregister("start")
            lists = out.column("ids").combine_chunks()
            flat, cut = lists.flatten().to_numpy().astype("<u4").tobytes(), (lists.offsets.to_numpy() * 4).tolist()
            for i, a, b in zip(out.column("word").to_pylist(), cut[:-1], cut[1:], strict=True):
                self.known[part[i][0]] = flat[a:b]

    def long(self, b: bytes) -> list[int]:
        ids = [self.ranks[bytes([x])] for x in b]
        n = len(ids)
        nxt, prev, alive = list(range(1, n)) + [-1], list(range(-1, n - 1)), [True] * n
        heap = [(j, i, ids[i], ids[i + 1]) for i in range(n - 1) if (j := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            joined, i, left, right = heapq.heappop(heap)
            k = nxt[i]
            if not alive[i] or k < 0 or ids[i] != left or ids[k] != right:
                continue
            ids[i], alive[k], nxt[i] = joined, False, nxt[k]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (j := self.pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (j, x, ids[x], ids[y]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Packed ids of each text, and the bytes that these stand for. A text's pre-tokens are listed once and looked up."""
        cut = [self.find(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        get = self.known.__getitem__
        for words in cut:
            ids = b"".join(map(get, words))
            yield ids, self.decode(np.frombuffer(ids, "<u4").astype(np.int64)).tobytes()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, one after another."""
        return self.flat[spread(self.at[ids], self.size[ids])]


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield from slices(iter([whole.slice(at, rows)]), whole.schema.names[-1], size)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (array of int) and decoded (the text that the ids stand for) of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in _pieces(batches):
            packed = list(c.encode(b.column(1).to_pylist()))
            ids = [pa.array(memoryview(p).cast("I") if p else [], pa.int32()) for p, _ in packed]
            flat = pa.ListArray.from_arrays(pa.array([0, *_sums(len(x) for x in ids)], pa.int32()), pa.concat_arrays(ids) if ids else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), flat, pa.array([d.decode() for _, d in packed], pa.string())], [id_col, "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run, "byte_bpe"), f"`{id_col}` {kind}, n_tokens long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row's ids, by ordered aggregation of the vocabulary's bytes. A null list is the empty text; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b = whole.slice(at, 100)
                c.db.register("given", pa.table({"k": pa.array(range(b.num_rows), pa.int32()), "ids": b.column(1)}))
                rows = c.db.execute("SELECT k, list(hex ORDER BY pos) FROM (SELECT k, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM given) JOIN vocabulary USING (id) GROUP BY k").fetchall()
                c.db.unregister("given")
                got = {k: bytes.fromhex("".join(h)).decode(errors="replace") for k, h in rows}
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([got.get(i, "") for i in range(b.num_rows)], pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(trimmed(run, "byte_bpe"), f"`{id_col}` {kind}, text string")


def _sums(sizes: Iterator[int]) -> Iterator[int]:
    total = 0
    for n in sizes:
        total += n
        yield total


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode(), with digests in place of the lists, so that only a few bytes a row leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in _pieces(batches):
            n, ids, text = [], [], []
            for p, d in c.encode(b.column(1).to_pylist()):
                n.append(len(p) // 4)
                ids.append(hashlib.sha256(p).hexdigest())
                text.append(hashlib.sha256(d).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run, "byte_bpe"), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
