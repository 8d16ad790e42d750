"""Greedy selections whose state depends on what was taken before."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import written as cut


def skipping_budget(df: DataFrame, by: str, order: list[str], cost: str, budget: int, most: int) -> DataFrame:
    """Rows (by, order..., cost) of each group in order, each taken if it still fits the budget; at most ``most``. An item too
    large is skipped. Costs aren't negative; null costs nothing. ``order`` tells rows of a group apart.

    A group may have a large share of all rows, so none is gathered: in each of at most ``most`` rounds an aggregation finds
    the next row that fits of every group.
    """
    rows = cut(df.select(by, F.struct(*order).alias("_o"), F.coalesce(F.col(cost), F.lit(0)).alias("_c"), F.col(cost).alias("_cost")).where(F.coalesce(F.col(cost), F.lit(0)) <= budget))
    state = rows.groupBy(by).agg(F.min("_o").alias("_first")).select(F.col(by).alias("_k"), F.lit(None).cast(rows.schema["_o"].dataType).alias("_at"), F.lit(0).cast("double").alias("_used"))
    out = None
    for _ in range(most):
        j = rows.join(state, F.col(by).eqNullSafe(F.col("_k"))).where((F.col("_at").isNull() | (F.col("_o") > F.col("_at"))) & (F.col("_used") + F.col("_c") <= budget))
        taken = cut(j.groupBy(by, "_used").agg(F.min_by(F.struct("_o", "_c", "_cost"), "_o").alias("_t")))
        if taken.isEmpty():
            break
        found = taken.select(by, *[F.col(f"_t._o.{o}").alias(o) for o in order], F.col("_t._cost").alias(cost))
        out = found if out is None else out.unionByName(found)
        state = taken.select(F.col(by).alias("_k"), F.col("_t._o").alias("_at"), (F.col("_used") + F.col("_t._c")).alias("_used"))
    return df.select(by, *order, cost).limit(0) if out is None else out


def transcript_windows(df: DataFrame, gap: float = 3.0, longest: float = 90.0, tokens: int = 200) -> DataFrame:
    """Windows over the segments (conv, seq, started, ended, n_tokens) of each conversation: (conv, window, first, last).

    A window is closed before a segment that comes ``gap`` seconds after the last, or with which it would be longer than
    ``longest`` seconds or hold more than ``tokens``; the next one starts with the last segment of the closed one. The
    tail is never dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out, k = None, [], [], 0

        def close() -> None:
            nonlocal k
            if held:
                out.append((now, k, held[0][0], held[-1][0]))
                k += 1

        for b in batches:
            for conv, *s in zip(*(b.column(c).to_pylist() for c in ("conv", "seq", "started", "ended", "n_tokens")), strict=True):
                if conv != now:
                    close()
                    now, held, k = conv, [], 0
                if held and (s[1] - held[-1][2] >= gap or s[2] - held[0][1] > longest or sum(h[3] for h in held) + s[3] > tokens):
                    close()
                    # one segment of overlap, unless the talk paused
                    held = [] if s[1] - held[-1][2] >= gap else held[-1:]
                held.append(s)
            if out:
                yield batch(out)
                out.clear()
        close()
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["conv", "window", "first", "last"])

    slim = df.select("conv", "seq", "started", "ended", "n_tokens")
    return slim.repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(run, "conv long, window long, first long, last long")
