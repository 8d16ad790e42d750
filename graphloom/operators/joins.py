"""Joins that Spark has no word for: as-of, exists-after, set similarity, interval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import ROWS

_zstd = pa.Codec("zstd", compression_level=3)


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, value: str, order: str, deal: Callable[..., DataFrame] = lambda df, *keys: df) -> DataFrame:
    """``left`` with the value of the last right row at or before its time (``order`` breaks ties), as ``value``; null if none.

    Both sides are put in one order and the last right value is carried forward: one shuffle by key, no join that
    grows with the product of a key's rows. ``deal`` (a table, its keys) may deal both over more tasks.
    """
    cols = left.columns
    l = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[order].dataType).alias("_o"), F.struct(*cols).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(order).alias("_o"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    seen = deal(l.unionByName(r), *by).withColumn("_last", F.last(F.when(F.col("_side") == 0, F.struct("_v")), ignorenulls=True).over(w))
    return seen.where("_side = 1").select("_row.*", F.col("_last._v").alias(value))


def latest_by(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(*by).agg(F.max(F.struct(*order, F.struct(*df.columns).alias("_row"))).alias("_m")).select("_m._row.*")


def exists_after(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, name: str, deal: Callable[..., DataFrame] = lambda df, *keys: df) -> DataFrame:
    """``left`` with the first right time after (or at) its own, as ``name``; null if none. The next right time is carried backward
    in one order of both sides, as asof() carries the last one forward."""
    l = left.select(*by, F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"))
    r = right.select(*by, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(0, Window.unboundedFollowing)
    seen = deal(l.unionByName(r), *by).withColumn("_next", F.first(F.when(F.col("_side") == 1, F.col("_t")), ignorenulls=True).over(w))
    return seen.where("_side = 0").select("_row.*", F.col("_next").alias(name))


#: Pairs of sets that are packed, and counted, at once.
PAIRS = 1 << 20


def _small(x: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type, byte by byte (all first bytes, then all second ones), compressed."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return bytes([x.itemsize]) + len(x).to_bytes(8, "little") + _zstd.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), asbytes=True)


def _wide(b: bytes) -> np.ndarray:
    size, n = b[0], int.from_bytes(b[1:9], "little")
    raw = _zstd.decompress(memoryview(b)[9:], n * size, asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(size, n).T.copy().view(f"u{size}").reshape(-1).astype(np.uint64).view(np.int64)


def _summed(a: np.ndarray, b: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, in order: a, b, the first values added up, the others as they are."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, np.int64)
    return a[first], b[first], np.add.reduceat(values[0][order], first) if len(a) else values[0], *[v[order][first] for v in values[1:]]


def set_similarity(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """For each left set the largest Jaccard similarity with any right set, through shared members. Keys are integers.

    Sets get their sizes where they are made distinct. Pairs that share a member are made by a join and go to the task of their left
    set packed, as steps in narrow integers, so that a pair takes some bytes.
    """
    both = left.select(F.lit(0).alias("side"), F.col(key).cast("long").alias("s"), F.col(member).alias("m")).unionAll(right.select(F.lit(1), F.col(key).cast("long"), F.col(member))).where("s IS NOT NULL")
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // ROWS))
    sets = both.repartition(parts, "side", "s").distinct().withColumn("n", F.count("*").over(Window.partitionBy("side", "s"))).where("m IS NOT NULL")
    of = lambda side, s, n: sets.where(F.col("side") == side).select("m", F.col("s").alias(s), F.col("n").alias(n))
    bucket = F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int").alias("bucket")
    pairs = of(0, "a", "na").join(of(1, "b", "nb"), "m").select(bucket, "a", "na", "b", "nb")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            t, a, na, b, nb = (np.concatenate([h[i] for h in held]) for i in range(5))
            for k in np.unique(t).tolist():
                i = t == k
                x, y, n, nx, ny = _summed(a[i], b[i], np.ones(int(i.sum()), np.int64), na[i], nb[i])
                first = np.append(True, x[1:] != x[:-1])
                step = np.where(first, y, np.diff(y, prepend=0))  # keys below 0 are steps of 64 bits
                columns = [_small(v.view(np.uint64)) for v in (np.diff(x[first], prepend=0), np.diff(np.flatnonzero(np.append(first, True))), step, n, nx[first], ny)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([columns], pa.list_(pa.binary()))], ["bucket", "pairs"])

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            rows += batch.num_rows
            if rows >= PAIRS:
                yield from out()
                held, rows = [], 0
        if rows:
            yield from out()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [p for b in batches for p in b.column(1).to_pylist()]
        passes = -(-sum(int.from_bytes(p[2][1:9], "little") for p in held) // PAIRS) | 1  # odd, as keys often are multiples of two
        for k in range(passes):
            some = []
            for p in held:
                x, size, step, n, nx, ny = (_wide(c) for c in p)
                x = np.cumsum(x)
                own, total = np.repeat(np.arange(len(x)), size), np.cumsum(step)
                begin = np.cumsum(size) - size
                y = total - (total[begin] - step[begin])[own]
                i = np.flatnonzero(x[own] % passes == k)
                some.append((x[own][i], y[i], n[i], nx[own][i], ny[i]))
            a, _, n, na, nb = _summed(*(np.concatenate([c[i] for c in some]) for i in range(5))) if some else [np.empty(0, np.int64)] * 5
            if len(a):
                first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(np.maximum.reduceat(n / (na + nb - n), first))], ["a", "similarity"])

    return pairs.mapInArrow(packed, "bucket int, pairs array<binary>").repartitionById(parts, F.col("bucket")).mapInArrow(counted, "a long, similarity double")


def visible(valid_from: str, valid_to: str, at: Column) -> Column:
    """Half-open interval; null ends are open."""
    return (F.col(valid_from).isNull() | (F.col(valid_from) <= at)) & (F.col(valid_to).isNull() | (F.col(valid_to) > at))
