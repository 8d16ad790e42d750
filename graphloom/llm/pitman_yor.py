"""LM scoring by a hierarchical Pitman-Yor model (operator 2).

A context is the two words before a word. Its restaurant has the restaurant of the last word as its parent, which all
contexts with that last word share; the parents of all of these are one restaurant of single words, whose base is
uniform. Customers of a context are its following words in the training texts; each table sends one customer to the
parent. The seating is sampled by Gibbs: a step draws a dish's number of tables from its conditional, given the
restaurant's other tables and what the parent would give without this dish's own customers there (generalised Stirling
numbers count the seatings); dishes of a level step at the same time, from the contexts up to the single words, in
every sweep. After ``BURN_IN`` sweeps, the predictive probabilities of ``SAMPLES`` sweeps are averaged. Perplexity is
made of these.

The model is as large as the corpus and is never in one place. Texts are tokenised once, into chunks with a vocabulary
each. Chunks send their words to word ranges, and get global ids and counts back; they send their distinct contexts and
following words to buckets of the last word, where both context levels are sampled, and get predictive shares back;
then they score their texts. All tables between the steps are packed blocks, a row for each chunk and bucket.

The restaurant of single words is shared by all buckets. Within the sweeps each bucket keeps a copy of it: its
customers are the bucket's own tables and, for the other buckets, as many as the bucket has for its share of the
training tokens, spread as the words' counts to the power of the discount. After the sweeps its customers are summed exactly over
all buckets, and it is seated once more for the answer.

A last word that occurs more than ``HOT`` times has several restaurants; its contexts are dealt among them by a hash of
their first word. So no bucket grows with one frequent word. Random numbers come from hashes of the dishes, so that
another number of partitions moves scores only through the copies of the restaurant of single words.

Null and empty texts have one token, the end. Rows repeated under an id are scored one by one. Unknown words get the
mass of new ones; an unknown word in a context leaves the shorter one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrays import mix, slices, trimmed, utf8, word_hashes
from graphloom.llm.shared import Tables, width

CHUNK = 6 << 20
END = np.uint64(0xE5D0000000000E5D)
BURN_IN, SAMPLES = 2, 3
#: Discounts and strengths of contexts of two words, of one word, and of the single words.
DISCOUNTS, STRENGTHS = (0.85, 0.75, 0.6), (1.0, 1.0, 10.0)
#: A restaurant of one word has at most about so many customers.
HOT = 500_000
#: For dishes with more customers, Stirling numbers are approximated at a saddle point.
MANY = 512
FEW = 12
WORDS, LOOKED_UP, PAIRS, SHARES, NUMERATORS, VOCABULARY = range(6)
BLOCK = "kind int, bucket int, chunk long, payload binary"


_zstd = pa.Codec("zstd", compression_level=5)


def indexed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values as steps, and each value's place among them."""
    values, at = np.unique(x, return_inverse=True)
    return small(np.diff(values, prepend=0)), small(at)


def values_of(steps: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.int64)[at]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types, byte by byte (all first bytes, then all second ones), compressed."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (len(a), np.dtype(a.dtype).num)], "<i8").tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + _zstd.compress(raw, asbytes=True)


_TYPES = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.uint64, np.int32, np.int64, np.float32, np.float64, np.bool_)}


def unpack(b: bytes) -> list[np.ndarray]:
    raw = _zstd.decompress(memoryview(b)[8:], int.from_bytes(b[:8], "little"), asbytes=True)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * k, 8).tolist(), 8 + 16 * k, []
    for n, kind in zip(head[::2], head[1::2], strict=True):
        size = _TYPES[kind].itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(_TYPES[kind]))
        at += n * size
    return out


def small(x: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the narrowest type."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def rows(items: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*items, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["kind", "bucket", "chunk", "payload"])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, dict[int, bytes]]]]:
    """(chunk, kind -> bucket -> payload), of rows that stand together by chunk."""
    now, held = None, {}
    for kind, bucket, chunk, payload in blocks(batches):
        if chunk != now:
            if held:
                yield now, held
            now, held = chunk, {}
        held.setdefault(kind, {})[bucket] = payload
    if held:
        yield now, held


# Tokens -------------------------------------------------------------------------------------------------------------


def tokenised(docs: DataFrame) -> DataFrame:
    """Blocks of a chunk: WORDS 0 (held flags), 1 (length of each text, local token ids) and 2 (ids and which are null);
    VOCABULARY (hashes as steps; training tokens of each word). docs: doc_id, text, held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in slices(batches, "text", CHUNK):
            words, at = word_hashes(*utf8(b.column(1)))
            size = np.diff(at) + 1
            ends = np.cumsum(size) - 1
            all_words = np.full(len(words) + len(size), END, np.uint64)
            inner = np.ones(len(all_words), bool)
            inner[ends] = False
            all_words[inner] = words
            vocabulary, local = np.unique(all_words, return_inverse=True)
            held = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            train = np.repeat(~held, size)
            ids = np.array([0 if i is None else i for i in b.column(0).to_pylist()] + b.column(0).is_null().to_pylist(), np.int64)
            n += 1
            chunk = part << 32 | n
            known = pack(np.diff(vocabulary, prepend=np.uint64(0)), small(np.bincount(local[train], minlength=len(vocabulary))))
            yield rows([(WORDS, 0, chunk, held.tobytes()), (WORDS, 1, chunk, pack(small(size), small(local))), (WORDS, 2, chunk, ids.tobytes()), (VOCABULARY, 0, chunk, known)])

    return docs.mapInArrow(trimmed(run), BLOCK)


# Words --------------------------------------------------------------------------------------------------------------


def word_requests(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, chunk, v in blocks(batches):
            steps, count = unpack(v)
            words = np.cumsum(steps, dtype=np.uint64)
            bucket = (words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(parts + 1, dtype=np.uint64))
            yield rows([(WORDS, k, chunk, pack(np.diff(words[x:y], prepend=np.uint64(0)), count[x:y])) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y])

    return run


def weights(count: np.ndarray) -> np.ndarray:
    """How words are spread over contexts, but for a factor: tables grow as customers to the power of the discount."""
    return count ** DISCOUNTS[1]


def word_counts(parts: int) -> Callable:
    """Answers each request with (place among the range's known words, from 1; count) of its words; place 0: not in a training text.
    Chunk -1: totals of tokens, of words, and of the words' weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(bucket, chunk, *unpack(p)) for _, bucket, chunk, p in blocks(batches)]
        if not held:
            return
        words, at = np.unique(np.concatenate([np.cumsum(h[2], dtype=np.uint64) for h in held]), return_inverse=True)
        count = np.bincount(at, np.concatenate([h[3] for h in held]), len(words)).astype(np.int64)
        bucket = held[0][0]
        known = count > 0
        ids = np.where(known, np.cumsum(known), 0)
        x = 0
        for _, chunk, w, _ in held:
            i = at[x : x + len(w)]
            x += len(w)
            yield rows([(LOOKED_UP, bucket, chunk, pack(small(ids[i]), small(count[i])))])
        yield rows([(LOOKED_UP, bucket, -1, pack(np.array([count.sum(), known.sum(), weights(count).sum()], np.float64)))])

    return run


# Contexts -----------------------------------------------------------------------------------------------------------


class ChunkGrams:
    """The distinct contexts of a chunk whose last word is known, what follows each, by bucket, and where each token's is.

    ``offsets``: how many known words the ranges before each have, and all. Ids are places in the order of all known words, from
    1; 0 is unknown, and the one after the last is the start of a text.
    """

    def __init__(self, tokens: bytes, looked_up: dict[int, bytes], offsets: np.ndarray, parts: int, hot: int):
        size, local = unpack(tokens)
        got = [(k, unpack(looked_up[k])) for k in sorted(looked_up)]
        place = np.concatenate([g[0] for _, g in got]).astype(np.int64)
        base = np.repeat([offsets[k] for k, _ in got], [len(g[0]) for _, g in got])
        self.ids = np.where(place > 0, place + base, 0)
        self.count = np.concatenate([g[1] for _, g in got]).astype(np.int64)
        self.size, self.local = size.astype(np.int64), local.astype(np.int32)
        self.ends = np.cumsum(self.size) - 1
        begin, n = self.ends - self.size + 1, len(self.ids)
        ids = np.append(self.ids, offsets[-1] + 1)
        # texts start as often as they end
        count = np.append(self.count, self.count[self.local[self.ends[0]]] if len(self.ends) else 0)
        before = [np.empty_like(self.local) for _ in range(2)]
        for k, x in enumerate(before):
            x[k + 1 :] = self.local[: -k - 1]
            for j in range(k + 1):
                x[np.minimum(begin + j, self.ends)] = n
        # what a text of one token leaves of the second word before is overwritten above: both are the start
        self.at = np.flatnonzero(ids[before[0]] > 0)
        last, first = before[0][self.at].astype(np.int64), before[1][self.at].astype(np.int64)
        pair, of = np.unique(last << 24 | first, return_inverse=True)
        last, first = pair >> 24, pair & 0xFFFFFF
        split = 1 + count[last] // hot
        part = np.where(split > 1, (mix(ids[first].astype(np.uint64)) % split.astype(np.uint64)).astype(np.int64), 0)
        bucket = (mix(ids[last].astype(np.uint64) << np.uint64(20) ^ part.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((ids[first], part, ids[last], bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_word = np.argsort(self.ids, kind="stable")
        word_rank = np.empty(max(n, 1), np.int64)
        word_rank[by_word] = np.arange(n)
        # unknown words are one dish
        word_rank[:n][self.ids == 0] = 0
        key, self.dish_of = np.unique(rank[of] << 24 | word_rank[self.local[self.at]], return_inverse=True)
        self.ctx_of = key >> 24  # of each dish
        self.l = by_word[key & 0xFFFFFF] if n else np.empty(0, np.int64)
        self.w = self.ids[self.l]
        self.last, self.first, self.part = ids[last][order], ids[first][order], part[order]
        self.cut_ctx = np.searchsorted(bucket[order], np.arange(parts + 1))
        self.cut = np.searchsorted(self.ctx_of, self.cut_ctx)


def requests(parts: int, offsets: np.ndarray, weight: float, hot: int) -> Callable:
    """Sends runs of (last word, restaurant), their contexts' first words, what follows each with training counts, and how words are
    spread over contexts (in 1/25 of a decade) to the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, got in by_chunk(batches):
            held, tokens = got[WORDS][0], got[WORDS][1]
            p = ChunkGrams(tokens, got[LOOKED_UP], offsets, parts, hot)
            train = np.repeat(~np.frombuffer(held, np.bool_), p.size)[p.at]
            n = np.bincount(p.dish_of[train], minlength=len(p.w))
            likely = np.clip(np.round(-25 * np.log10(weights(np.maximum(p.count, 1)) / max(weight, 1))), 0, 255).astype(np.uint8)
            out = []
            for k in range(parts):
                c0, c1, x, y = p.cut_ctx[k], p.cut_ctx[k + 1], p.cut[k], p.cut[k + 1]
                if x < y:
                    head = np.flatnonzero(np.concatenate([[True], (p.last[c0 + 1 : c1] != p.last[c0 : c1 - 1]) | (p.part[c0 + 1 : c1] != p.part[c0 : c1 - 1])]))
                    _, at = np.unique(p.w[x:y], return_index=True)
                    dishes = np.bincount(p.ctx_of[x:y] - c0, minlength=c1 - c0)
                    out.append((PAIRS, k, chunk, pack(small(p.last[c0:c1][head]), small(p.part[c0:c1][head]), small(np.diff(np.append(head, c1 - c0))), *indexed(p.first[c0:c1]), small(dishes), *indexed(p.w[x:y]), small(n[x:y]), likely[p.l[x:y][at]])))
            if out:
                yield rows(out)

    return run


_stirling: dict[float, list[np.ndarray]] = {}


def log_stirling(c: int, d: float) -> np.ndarray:
    """log S(c, t) for t = 1..c: the weight of all seatings of c customers at t tables, each table of k weighing (1 - d)(2 - d)...(k - 1 - d)."""
    made = _stirling.setdefault(d, [np.zeros(1)])
    while len(made) < c:
        n, last = len(made), made[-1]
        t = np.arange(1, n + 1)
        stay = np.append(last + np.log(n - t * d), -np.inf)
        opened = np.append(-np.inf, last)
        top = np.maximum(stay, opened)
        made.append(top + np.log(np.exp(stay - top) + np.exp(opened - top)))
    return made[c - 1]


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 from the bits of hashes."""
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _ranges() -> list[tuple[int, int]]:
    """Customers that are drawn for together: 2, 3, ... and then ranges of a quarter."""
    out, lo = [], 2
    while lo <= MANY:
        out.append((lo, min(MANY, lo + max(0, lo // 4 - 2))))
        lo = out[-1][1] + 1
    return out


_weights: dict[tuple[float, int], np.ndarray] = {}


def seating_weights(lo: int, hi: int, d: float) -> np.ndarray:
    """Row n - lo: log_stirling(n, d), then minus infinity up to ``hi`` tables."""
    if (d, lo) not in _weights:
        _weights[d, lo] = np.array([np.append(log_stirling(n, d), np.full(hi - n, -np.inf)) for n in range(lo, hi + 1)])
    return _weights[d, lo]


def draw_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, strength: float, key: np.ndarray) -> np.ndarray:
    """A Gibbs step: the tables of dishes with c customers, given the other tables of the restaurant and the parent's probability p.
    ``key``: a hash for each dish, from which its random numbers come.

    Up to MANY customers the Stirling numbers are exact; beyond they are approximated (see the tests for by how much).
    """
    t = np.minimum(c, 1).astype(np.int64)
    order = np.argsort(c, kind="stable")
    sizes = c[order]
    for lo, hi in _ranges():
        x, y = np.searchsorted(sizes, lo), np.searchsorted(sizes, hi, "right")
        k = np.arange(1, hi + 1)
        step = k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for at in range(x, y, max(1, 200_000 // hi)):
            i = order[at : min(y, at + max(1, 200_000 // hi))]
            # the restaurant's weight of k more tables is a product of strength / d + others + 0, 1, ..., k - 1
            w = np.cumsum(np.log((strength / d + others[i])[:, None] + (k - 1)), axis=1)
            w += seating_weights(lo, hi, d)[c[i] - lo] + k * np.log(p[i] * d)[:, None]
            w -= np.log(-np.log(uniform(key[i, None] + step)))  # Gumbel noise: the greatest is a draw
            t[i] = 1 + np.argmax(w, axis=1)
    big = np.flatnonzero(c > MANY)
    for at in range(0, len(big), 2000):
        i = big[at : at + 2000]
        t[i] = many_tables(c[i].astype(np.float64), strength / d + others[i], p[i], d, key[i])
    return t


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1, by Stirling's series after a shift to 9 and more."""
    low = np.where(x < 9, x, 9.0)
    shift = sum(np.log(low + j) for j in range(8)) * (x < 9)
    x = np.where(x < 9, x + 8, x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) - shift


_saddles: dict[float, tuple[np.ndarray, np.ndarray]] = {}


def tables_at(y: np.ndarray, d: float) -> np.ndarray:
    """Tables over customers of which y is the saddle."""
    return (1 - y**d) * y ** (1 - d) / (d * (1 - y))


def saddle(ratio: np.ndarray, d: float) -> np.ndarray:
    """The y of a number of tables over customers, read from a table of logarithms."""
    if d not in _saddles:
        fall = np.geomspace(1e-7, 300, 20_000)[::-1]  # -log y
        _saddles[d] = np.log(tables_at(np.exp(-fall), d)), np.log(fall)
    return np.exp(-np.exp(np.interp(np.log(ratio), *_saddles[d])))


def many_weights(n: np.ndarray, b: np.ndarray, p: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of tables about the likeliest one of each dish, their distance, and the logarithms of their weights, with generalised
    Stirling numbers by the saddle point of their generating function, S(n, t) = n! / (t! d**t) [x**n] (1 - (1 - x)**d)**t.
    b: strength over discount, and the restaurant's other tables."""
    lo, hi = np.full(n.shape, -80.0), np.full(n.shape, -1e-7)  # of log y at the likeliest number
    for _ in range(40):
        y = np.exp((lo + hi) / 2)
        t = n * tables_at(y, d)
        more = p * (1 - y**d) * (b + t) > t
        lo, hi = np.where(more, np.log(y), lo), np.where(more, hi, np.log(y))
    likely = np.clip(n * tables_at(np.exp(lo), d), 1, n)
    step = np.maximum(1, np.floor(np.sqrt(likely) / 4))
    grid = np.round(likely)[:, None] + np.arange(-48, 49) * step[:, None]
    ok = (grid >= 1) & (grid <= n[:, None] - 1)
    t = np.clip(grid, 1, n[:, None] - 1)
    y = saddle(t / n[:, None], d)
    x, z = 1 - y, 1 - y**d
    slope = d * y ** (d - 1) / z * (1 + x * (1 - d) / y - x * d * y ** (d - 1) / z)
    w = t * np.log(z) - n[:, None] * np.log(x) - 0.5 * np.log(2 * np.pi * t * x * slope)
    # few tables: the series of (1 - x)**(j d), whose terms fall fast for so many customers
    some = np.flatnonzero(likely < 2 * FEW + 48)
    if len(some):
        m, few = n[some], np.arange(1, FEW + 1)
        total = np.zeros((len(some), FEW))
        for j in range(1, FEW + 1):
            of = np.where(few >= j, np.exp(log_gamma(few + 1.0) - log_gamma(np.array(j + 1.0)) - log_gamma(np.maximum(few - j, 0) + 1.0)), 0.0)
            total += (-1) ** (j + 1) * np.sin(np.pi * j * d) / np.pi * np.exp(log_gamma(np.array([j * d + 1.0])) + log_gamma(m - j * d) - log_gamma(m - d))[:, None] * of
        series = np.log(np.maximum(total, 1e-300)) + (log_gamma(m - d) - log_gamma(m + 1))[:, None]
        w[some] = np.where(t[some] <= FEW, np.take_along_axis(series, np.minimum(t[some], FEW).astype(np.int64) - 1, axis=1), w[some])
    w += t * np.log(p)[:, None] - log_gamma(t + 1) + log_gamma(b[:, None] + t + 1) - np.log(b[:, None] + t)
    return t, step, np.where(ok, w, -np.inf)


def many_tables(n: np.ndarray, b: np.ndarray, p: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """Draws like those of draw_tables for many customers."""
    t, step, w = many_weights(n, b, p, d)
    w -= np.log(-np.log(uniform(key[:, None] + np.arange(97, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    found = t[np.arange(len(n)), np.argmax(w, axis=1)]
    # numbers between two of the grid are as likely as the nearer one
    found += np.round((uniform(key ^ np.uint64(0x5851F42D4C957F2D)) - 0.5) * (step - 1))
    return np.clip(found, 1, n).astype(np.int64)


def draw_alike(c: np.ndarray, every: float, p: float, d: float, strength: float, key: np.ndarray) -> np.ndarray:
    """draw_tables for one restaurant of many dishes with the same probability, of which none has a large part of all tables
    (``every``): dishes with as many customers (within 1 in 100 beyond MANY) have one distribution."""
    b, u, t = strength / d + every, uniform(key), np.minimum(c, 1).astype(np.int64)
    kind = np.where(c <= MANY, c, MANY + 1 + np.floor(100 * np.log(np.maximum(c, 1) / MANY))).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    kinds, first = np.unique(kind[order], return_index=True)
    cut = np.append(first, len(c))
    # the weights of all kinds of many customers at once, for the middle one of each
    many = np.flatnonzero(kinds > MANY)
    n = c[order[(cut[many] + cut[many + 1]) // 2]].astype(np.float64)
    large = many_weights(n, np.full(len(n), b), np.full(len(n), p), d)
    rise = np.cumsum(np.log(b + np.arange(MANY)))
    for j, k in enumerate(kinds.tolist()):
        if k < 2:
            continue
        i = order[cut[j] : cut[j + 1]]
        if k <= MANY:
            at, step = np.arange(1, k + 1), 1.0
            w = log_stirling(k, d) + at * np.log(p * d) + rise[:k]
        else:
            at, step, w = (v[j - many[0]] for v in large)
        share = np.cumsum(np.exp(w - w.max()))
        found = at[np.minimum(np.searchsorted(share, u[i] * share[-1]), len(at) - 1)]
        found = found + np.round((uniform(key[i] ^ np.uint64(0x5851F42D4C957F2D)) - 0.5) * (step - 1))
        t[i] = np.clip(found, 1, c[i])
    return t


class Seating:
    """Both context levels of a bucket. Dishes of the contexts have customers ``n``; ``ctx`` and ``up`` are a dish's context and the
    dish of the context's parent; ``room`` is the restaurant of each parent's dish, ``word`` its word, ``house`` that of each context."""

    def __init__(self, n, ctx, up, house, room, word, keys, up_keys, spread, outside, distinct):
        self.n, self.ctx, self.up, self.house, self.room, self.word = n, ctx, up, house, room, word
        self.keys, self.up_keys = keys, up_keys
        #: how words are spread over contexts, customers a table here stands for elsewhere, and words in all
        self.spread, self.outside, self.distinct = spread, outside, distinct
        self.t, self.c2 = np.minimum(n, 1), np.bincount(up, np.minimum(n, 1), len(room)).astype(np.int64)
        self.t2, self.t1 = np.minimum(self.c2, 1), np.ones(len(spread), np.int64)
        self.all = np.bincount(ctx, n, len(house))

    def single(self, less: np.ndarray | int = 0) -> np.ndarray:
        """What the restaurant of single words gives each parent's dish without ``less`` of its customers."""
        d, s = DISCOUNTS[2], STRENGTHS[2]
        own = np.bincount(self.word, self.t2, len(self.spread))
        away = own.sum() * self.outside
        customers = np.maximum((own + away * self.spread)[self.word] - less, 0)
        tables = np.minimum(self.t1[self.word], customers)
        every = self.t1.mean() * self.distinct if len(self.t1) else 0.0
        return (customers - d * tables + (s + d * every) / (self.distinct + 1)) / (own.sum() + away - less + s)

    def sweep(self, k: int) -> None:
        seed = np.uint64((k * 0xD6E8FEB86659FD93 + 0xA5A5) & 0xFFFFFFFFFFFFFFFF)
        d3, d2, d1 = DISCOUNTS
        s3, s2, s1 = STRENGTHS
        p1 = self.single()
        # contexts of two words: the parent without what the dish itself sends there
        some = np.flatnonzero(self.n > 1)
        tables2, all2 = np.bincount(self.room, self.t2), np.bincount(self.room, self.c2)
        u, t = self.up[some], self.t[some]
        c = self.c2[u] - t
        t2 = np.minimum(self.t2[u], c)
        r = self.room[u]
        p2 = (c - d2 * t2 + (s2 + d2 * (tables2[r] - self.t2[u] + t2)) * p1[u]) / (all2[r] - t + s2)
        others = np.bincount(self.ctx, self.t, len(self.house))[self.ctx[some]] - t
        self.t[some] = draw_tables(self.n[some], others, p2, d3, s3, self.keys[some] ^ seed)
        # contexts of one word
        self.c2 = np.bincount(self.up, self.t, len(self.room)).astype(np.int64)
        self.t2 = np.minimum(np.maximum(self.t2, 1), self.c2)
        some = np.flatnonzero(self.c2 > 1)
        others = np.bincount(self.room, self.t2)[self.room[some]] - self.t2[some]
        self.t2[some] = draw_tables(self.c2[some], others, self.single(self.t2)[some], d2, s2, self.up_keys[some] ^ seed)
        # single words, as this bucket sees them
        own = np.bincount(self.word, self.t2, len(self.spread))
        customers = np.maximum(1, np.round(own + own.sum() * self.outside * self.spread)).astype(np.int64)
        every = self.t1.mean() * self.distinct if len(self.t1) else 0.0
        key = np.arange(len(self.spread), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ seed
        self.t1 = draw_alike(customers, every, 1 / (self.distinct + 1), d1, s1, key)

    def sample(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Averaged over the samples: each dish's probability but for the single words' share, that share for each context, and the
        tables of each parent's dish."""
        share, rest, tables = np.zeros(len(self.n)), np.zeros(len(self.house)), np.zeros(len(self.room))
        for k in range(BURN_IN + SAMPLES):
            self.sweep(k)
            if k < BURN_IN:
                continue
            d3, d2, _ = DISCOUNTS
            s3, s2, _ = STRENGTHS
            rooms = int(self.room.max(initial=-1)) + 1
            all2 = np.bincount(self.room, self.c2, rooms) + s2
            own2 = (self.c2 - d2 * self.t2) / all2[self.room]
            rest2 = (s2 + d2 * np.bincount(self.room, self.t2, rooms)) / all2
            rest3 = (s3 + d3 * np.bincount(self.ctx, self.t, len(self.house))) / (self.all + s3)
            share += (self.n - d3 * self.t) / (self.all + s3)[self.ctx] + rest3[self.ctx] * own2[self.up]
            rest += rest3 * rest2[self.house]
            tables += self.t2
        return share / SAMPLES, rest / SAMPLES, tables / SAMPLES


def restaurants(parts: int, offsets: np.ndarray, tokens_all: int, distinct: int) -> Callable:
    """Samples the seating of the contexts of a bucket. Answers each request with its dishes' and contexts' shares; sends the
    words' tables to their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for _, bucket, chunk, p in blocks(batches):
            last, part, runs, steps, at, dishes, word_steps, word_at, n, likely = unpack(p)
            held.append((bucket, chunk, last, part, runs, small(values_of(steps, at)), dishes, small(values_of(word_steps, word_at)), n, likely))
        if not held:
            return
        wide = lambda i: np.concatenate([h[i] for h in held]).astype(np.int64)
        runs = wide(4)
        last, first = np.repeat(wide(2), runs), wide(5)
        part = np.repeat(wide(3), runs)
        contexts, ctx_at = np.unique(last << 32 | first, return_inverse=True)
        houses, house_of = np.unique(last << 20 | part, return_inverse=True)
        house = np.empty(len(contexts), np.int64)
        house[ctx_at] = house_of
        del last, first, part, runs
        w = wide(7)
        dishes, at = np.unique(np.repeat(ctx_at, wide(6)) << 32 | w, return_inverse=True)
        n = np.bincount(at, wide(8), len(dishes)).astype(np.int64)
        ctx, of_word = dishes >> 32, dishes & 0xFFFFFFFF
        words = np.unique(of_word)
        spread = np.zeros(len(words))
        for h in held:
            spread[np.searchsorted(words, np.unique(h[7].astype(np.int64)))] = 10 ** (h[9] / -25.0)
        spread[words == 0] = 0  # unknown words
        above, up = np.unique(house[ctx] << 32 | of_word, return_inverse=True)
        room, word = above >> 32, np.searchsorted(words, above & 0xFFFFFFFF)
        keys = mix(mix(contexts[ctx].astype(np.uint64)) ^ of_word.astype(np.uint64))
        up_keys = mix(mix(houses[room].astype(np.uint64) ^ np.uint64(1 << 63)) ^ (above & 0xFFFFFFFF).astype(np.uint64))
        inside = int(n.sum())
        seating = Seating(n, ctx, up, house, room, word, keys, up_keys, spread, (tokens_all - inside) / max(inside, 1), distinct)
        share, rest, tables = seating.sample()
        x = y = 0
        for bucket, chunk, *h in held:
            i, j = at[x : x + len(h[5])], ctx_at[y : y + len(h[3])]
            x, y = x + len(h[5]), y + len(h[3])
            yield rows([(SHARES, bucket, chunk, pack(coded(share[i]), coded(rest[j])))])
        sent = np.bincount(word, tables, len(words))
        words, sent = words[sent > 0], sent[sent > 0]
        cut = np.searchsorted(words, offsets + 1)
        out = [(PAIRS, k, -2 - held[0][0], pack(small(words[x:y] - offsets[k]), sent[x:y].astype(np.float32))) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]
        if out:
            yield rows(out)

    return run


def coded(x: np.ndarray) -> np.ndarray:
    """Shares of 0 to 1 as whole steps of a thousandth of a decade, to within 1 in 800 of each down to 1e-11; 65535 is none."""
    return np.where(x > 0, np.clip(np.round(-1000 * np.log10(np.maximum(x, 1e-11))), 0, 65534), 65535).astype(np.uint16)


def decoded(x: np.ndarray) -> np.ndarray:
    return np.where(x == 65535, 0.0, 10 ** (x / -1000.0))


def parent(distinct: int) -> Callable:
    """Seats the single words' customers of a range; answers each chunk with kept customers per word. Chunk -1: totals.

    Tables of other ranges are as many a word as this one has, sweep by sweep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, sent, bucket = [], [], 0
        for _, bucket, chunk, p in blocks(batches):
            (sent if chunk < -1 else ask).append((chunk, *unpack(p)))
        if not sent and not ask:
            return
        words = np.concatenate([s[1] for s in sent]).astype(np.int64) if sent else np.empty(0, np.int64)
        words, at = np.unique(words, return_inverse=True)
        customers = np.bincount(at, np.concatenate([s[2] for s in sent]), len(words)) if sent else np.empty(0)
        whole = np.maximum(1, np.round(customers)).astype(np.int64)
        key = mix(words.astype(np.uint64) << np.uint64(20) ^ np.uint64(bucket))
        t, mean = np.ones(len(words), np.int64), np.zeros(len(words))
        for k in range(BURN_IN + SAMPLES):
            t = draw_alike(whole, t.mean() * distinct if len(t) else 0.0, 1 / (distinct + 1), DISCOUNTS[2], STRENGTHS[2], key + np.uint64(k))
            mean += t * (k >= BURN_IN)
        mean = np.minimum(mean / SAMPLES, customers)
        kept = customers - DISCOUNTS[2] * mean
        for chunk, ids, *_ in ask:
            ids = ids.astype(np.int64)
            i = np.minimum(np.searchsorted(words, ids), max(len(words) - 1, 0))
            found = (words[i] == ids) if len(words) else np.zeros(len(ids), bool)
            yield rows([(NUMERATORS, bucket, chunk, pack(np.where(found, kept[i] if len(words) else 0.0, 0.0).astype(np.float32)))])
        yield rows([(NUMERATORS, bucket, -1, pack(np.array([customers.sum(), mean.sum()])))])

    return run


def scores(parts: int, offsets: np.ndarray, hot: int, tokens_all: int, distinct: int, customers: float, tables: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = (STRENGTHS[2] + DISCOUNTS[2] * tables) / (distinct + 1)
        for _, got in by_chunk(batches):
            names, held, tokens = np.frombuffer(got[WORDS][2], np.int64), got[WORDS][0], got[WORDS][1]
            p = ChunkGrams(tokens, got[LOOKED_UP], offsets, parts, hot)
            kept = np.concatenate([unpack(got[NUMERATORS][k])[0] for k in sorted(got[NUMERATORS])]).astype(np.float64)
            single = ((kept + new) / (customers + STRENGTHS[2]))[p.local]
            share, rest = np.zeros(len(p.w)), np.ones(len(p.last))
            for k, payload in got.get(SHARES, {}).items():
                a, r = unpack(payload)
                share[p.cut[k] : p.cut[k + 1]], rest[p.cut_ctx[k] : p.cut_ctx[k + 1]] = decoded(a), decoded(r)
            token_share, token_rest = np.zeros(len(p.local)), np.ones(len(p.local))
            token_share[p.at], token_rest[p.at] = share[p.dish_of], rest[p.ctx_of[p.dish_of]]
            log = np.log10(token_share + token_rest * single)
            base = np.log10((p.count + 0.1) / (tokens_all + 0.1 * (distinct + 1)))[p.local]
            begin = p.ends - p.size + 1
            doc_ids = pa.array(names[: len(p.size)], mask=names[len(p.size) :].astype(bool))
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(np.frombuffer(held, np.bool_)), pa.array(p.size), pa.array(np.add.reduceat((p.count > 0)[p.local].astype(np.int64), begin)), pa.array(np.full(len(p.size), tokens_all)), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(log, begin))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, held: Column, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability) and perplexity of each text; the model
    is made of the rows for which ``held`` is false."""
    spark = docs.sparkSession
    t, parts = Tables(spark, "pitman-yor"), max(2, 2 * width(spark))

    def step(df: DataFrame) -> DataFrame:
        out = t.write(df)
        t.tidy()
        return out

    def to_bucket(df: DataFrame, run: Callable) -> DataFrame:
        return df.repartitionById(parts, F.col("bucket")).mapInArrow(trimmed(run), BLOCK)

    def to_chunk(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "bucket")

    chunks = t.write_by(tokenised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))), "kind", (WORDS, VOCABULARY))
    words = step(to_bucket(chunks[VOCABULARY].mapInArrow(trimmed(word_requests(parts)), BLOCK), word_counts(parts)))
    t.drop(chunks[VOCABULARY])
    totals = {r.bucket: unpack(r.payload)[0] for r in words.where("chunk = -1").collect()}  # three sums a range
    tokens_all, distinct, weight = (float(sum(v[i] for v in totals.values())) for i in range(3))
    tokens_all, distinct = int(tokens_all), int(distinct)
    offsets = np.concatenate([[0], np.cumsum([totals[k][1] if k in totals else 0 for k in range(parts)])]).astype(np.int64)
    plain = chunks[WORDS]
    answers = words.where("chunk >= 0")
    asked = to_chunk(plain.unionByName(answers)).mapInArrow(trimmed(requests(parts, offsets, weight, hot)), BLOCK)
    shares = step(to_bucket(asked, restaurants(parts, offsets, tokens_all, distinct)))
    tops = step(to_bucket(shares.where("chunk < -1").unionByName(answers), parent(distinct)))
    sums = sum((unpack(r.payload)[0] for r in tops.where("chunk = -1").collect()), np.zeros(2))
    every = to_chunk(plain.unionByName(answers).unionByName(shares.where("chunk >= 0")).unionByName(tops.where("chunk >= 0")))
    out = every.mapInArrow(trimmed(scores(parts, offsets, hot, tokens_all, distinct, float(sums[0]), float(sums[1]))), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0)
