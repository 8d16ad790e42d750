"""Token counts by rank-synchronous array merging (operator 10).

A sentencepiece BPE model joins, again and again, the neighbouring symbols whose joined piece has the best score, the
leftmost first. Here a batch of distinct pre-tokens lies in one ragged numpy array; in each step every pre-token
applies its own lowest-rank pair, all at the same time, until none has a pair left; surviving symbols are counted.
A pre-token is a run of spaces with the word after it: no piece of the model has a space after another character.

Null and empty texts have no tokens. Special strings inside texts are ordinary text. Texts of any length are read
whole, in slices cut before a space.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrays import CACHES, trimmed

MARK = "▁"
NO_RANK = np.int64(1 << 40)
#: Pre-tokens of more symbols are merged with a heap, which takes n log n steps.
LONG = 400
#: Distinct pre-tokens that a worker remembers.
REMEMBERED = 400_000
SLICE = 1 << 20
_models: dict[str, Merger] = CACHES.setdefault("token_counts", {})


class Merger:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        for p in pieces:
            if MARK in p.lstrip(MARK):
                raise ValueError(f"piece {p!r} has a space inside; pre-tokens can't be cut at spaces")
        self.ids = {p: i for i, p in enumerate(pieces)}
        for p in pieces:
            for c in p:
                self.ids.setdefault(c, len(self.ids))
        order = sorted(set(pieces.values()), reverse=True)
        rank = {s: i for i, s in enumerate(order)}
        #: Tokens that a symbol left over stands for: one for a piece, its bytes for another character.
        self.cost = np.ones(len(self.ids), np.int64)
        for s, i in self.ids.items():
            if s not in pieces:
                self.cost[i] = len(s.encode())
        pairs = {}
        for p, s in pieces.items():
            for k in range(1, len(p)):
                left, right = self.ids.get(p[:k]), self.ids.get(p[k:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = (rank[s], self.ids[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NO_RANK], np.int64)
        self.joined = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int64)
        self.known: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands in ranks and joined; the last place where it is no pair."""
        key = np.where((left < 0) | (right < 0), -1, left << 20 | right)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))

    def symbols(self, word: str) -> list[int]:
        """Symbol ids; -1 less the bytes for a character that is in no piece."""
        return [i if (i := self.ids.get(c)) is not None else -1 - len(c.encode()) for c in word]

    def count(self, words: list[str]) -> list[int]:
        rows = [self.symbols(w.replace(" ", MARK)) for w in words]
        out = np.zeros(len(rows), np.int64)
        for i, r in enumerate(rows):
            if len(r) > LONG:
                out[i] = self.count_long(r)
                rows[i] = []
        sizes = np.array([len(r) for r in rows], np.int64)
        sym = np.array([x for r in rows for x in r], np.int64)
        row = np.repeat(np.arange(len(rows)), sizes)
        at = np.full(len(sym), len(self.keys))  # of the pair of each symbol and the next
        if len(sym) > 1:
            same = np.flatnonzero(row[:-1] == row[1:])
            at[same] = self.look(sym[same], sym[same + 1])
        ranks = self.ranks[at]
        while len(sym):
            head = np.concatenate([[True], row[:-1] != row[1:]])
            best = np.minimum.reduceat(ranks, np.flatnonzero(head))
            group = np.cumsum(head) - 1
            if (done := best == NO_RANK).any():
                over = done[group]
                cost = np.where(sym[over] >= 0, self.cost[np.maximum(sym[over], 0)], -1 - sym[over])
                out += np.bincount(row[over], cost, len(out)).astype(np.int64)
                live = ~over
                sym, row, at, ranks, group, head = sym[live], row[live], at[live], ranks[live], group[live], head[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(ranks == best[group])
            lead = np.ones(len(hit), bool)
            lead[1:] = row[hit[1:]] != row[hit[:-1]]
            hit = hit[lead]  # the leftmost of each pre-token
            sym[hit] = self.joined[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, row, at, ranks = sym[keep], row[keep], at[keep], ranks[keep]
            hit -= np.arange(len(hit))  # one symbol less before each later hit
            for i in (hit, hit[hit > 0] - 1):  # only pairs with a joined symbol are new
                i = i[i + 1 < len(sym)]
                i_in = row[i] == row[i + 1]
                at[i] = np.where(i_in, self.look(sym[i], sym[i + 1]), len(self.keys))
                ranks[i] = self.ranks[at[i]]
            if len(hit) and hit[-1] == len(sym) - 1:
                at[-1], ranks[-1] = len(self.keys), NO_RANK
        return out.tolist()

    def count_long(self, sym: list[int]) -> int:
        """The same merges for one very long pre-token, by a heap over a linked list."""
        n = len(sym)
        nxt, prev, alive = list(range(1, n)) + [-1], list(range(-1, n - 1)), [True] * n
        a = np.array(sym, np.int64)
        at = self.look(a[:-1], a[1:])
        heap = [(r, i, sym[i], sym[i + 1], j) for i, (r, j) in enumerate(zip(self.ranks[at].tolist(), self.joined[at].tolist(), strict=True)) if j >= 0]
        heapq.heapify(heap)

        def push(i: int, k: int) -> None:
            if sym[i] >= 0 and sym[k] >= 0:
                p = int(np.searchsorted(self.keys, key := sym[i] << 20 | sym[k]))
                if p < len(self.keys) and self.keys[p] == key:
                    heapq.heappush(heap, (int(self.ranks[p]), i, sym[i], sym[k], int(self.joined[p])))

        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            k = nxt[i]
            if not alive[i] or k < 0 or sym[i] != left or sym[k] != right:
                continue
            sym[i], alive[k], nxt[i] = joined, False, nxt[k]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
                push(i, nxt[i])
            if prev[i] >= 0:
                push(prev[i], i)
        return sum(int(self.cost[s]) if s >= 0 else -1 - s for s, ok in zip(sym, alive, strict=True) if ok)

    def learn(self, words: set[str]) -> None:
        """From now on the words are in ``known``; the older half is forgotten when it grows too large."""
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.before, self.known, new = self.known, {}, words
        rest = []
        for w in new:
            if (n := self.before.get(w)) is None:
                rest.append(w)
            else:
                self.known[w] = n
        for i in range(0, len(rest), 50_000):
            part = rest[i : i + 50_000]
            self.known.update(zip(part, self.count(part), strict=True))

    def text(self, text: str) -> int:
        if not text:
            return 0
        text, n = " " + text.replace(MARK, " "), 0
        while text:
            if len(text) > SLICE:
                cut = next((m.start() + 1 for m in re.compile(r"[^ ] ").finditer(text, SLICE)), len(text))
                part, text = text[:cut], text[cut:]
            else:
                part, text = text, ""
            words = re.findall(" +[^ ]*", part)
            self.learn(set(words))
            n += sum(map(self.known.__getitem__, words))
        return n


def merger(path: str) -> Merger:
    if path not in _models:
        _models[path] = Merger(path)
    return _models[path]


def warm(m: Merger, texts: list[str | None]) -> None:
    """Learns all new pre-tokens of a batch of texts in one ragged array."""
    new: set[str] = set()
    for t in texts:
        if t and len(t) <= SLICE:
            new.update(re.findall(" +[^ ]*", " " + t.replace(MARK, " ")))
    m.learn(new)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = b.column(1).to_pylist()
                warm(m, texts)
                n = np.array([m.text(t) if t else 0 for t in texts], np.int64)
                size = np.array([len(t.encode()) if t else 0 for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run, "token_counts"), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
