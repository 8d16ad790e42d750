"""Places of rows within their key, and running sums along a key, without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import Tables, width

#: Places of a key that running sums take together; the sums of the blocks are added up in a second step.
BLOCK = 1024


def numbered(rows: DataFrame, key: str, order: list[str], tables: Tables) -> DataFrame:
    """``rows`` and, as ``index`` and ``last``, each row's place (from 0) within its key and whether it is the last one.

    Nulls come first, a null key is a key like others, and rows that are equal in all of ``order`` keep some fixed order.
    ``rows`` are written once, dealt out by ranges of (key, order), so that a key of any size lies on as many partitions
    as it fills, and numbered within the partitions. Only the first key of a partition can have begun before it: what has
    to be added are at most as many numbers as there are partitions, which are broadcast.
    """
    columns = rows.columns
    once = tables.write(rows.withColumn("_row", F.monotonically_increasing_id()))
    by = [F.col(c).asc_nulls_first() for c in (key, *order, "_row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, before, inner = TaskContext.get().partitionId(), None, 0, None, False

        def labelled(b: pa.RecordBatch, index: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            nonlocal inner
            edge = np.zeros(b.num_rows, bool)  # ends of the first and the last key of the partition
            if not inner and ends.any():
                edge[ends.argmax()] = inner = True
            if b is held[0] and closing:
                edge[-1] = True
            own = [pa.array(np.full(b.num_rows, part, np.int64)), pa.array(index), pa.array(ends), pa.array(edge)]
            return pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *own], [*columns, "_part", "index", "last", "_edge"])

        closing = False

        for b in batches:
            if not b.num_rows:
                continue
            runs = pc.run_end_encode(b.column(key))
            stops = runs.run_ends.to_numpy()
            starts = np.concatenate([[0], stops[:-1]])
            index = np.arange(b.num_rows, dtype=np.int64) - np.repeat(starts, stops - starts)
            values = runs.values
            if held is not None and values[0].as_py() == before:
                index[: stops[0]] += n
            elif held is not None:
                held[2][-1] = True
            if held is not None:
                yield labelled(*held)
            n, before = int(index[-1]) + 1, values[len(values) - 1].as_py()
            ends = np.zeros(b.num_rows, bool)
            ends[stops[:-1] - 1] = True
            held = (b, index, ends)
        if held is not None:
            held[2][-1] = closing = True
            yield labelled(*held)

    wide = once.repartitionByRange(width(rows.sparkSession), *by).sortWithinPartitions(*by).drop("_row")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local = tables.write(wide.mapInArrow(run, f"{kinds}, _part long, index long, last boolean, _edge boolean"))
    tables.drop(once)
    per = local.where("_edge").select("_part", F.col(key).alias("_key"), (F.col("index") + 1).alias("n"))
    w = Window.partitionBy("_key").orderBy("_part")
    shift = per.select("_part", "_key", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_add"), F.lead("_part").over(w).isNotNull().alias("_on"))
    begun = shift.where("_add > 0").select("_part", F.col("_add"), F.col("_key").alias("_first"), F.lit(True).alias("_late"))
    open_ = shift.where("_on").select("_part", F.col("_key").alias("_open"), F.lit(True).alias("_more"))
    out = local.join(F.broadcast(begun), "_part", "left").join(F.broadcast(open_), "_part", "left")
    same = lambda c: F.col(key).eqNullSafe(F.col(c))
    index = F.col("index") + F.when(F.col("_late") & same("_first"), F.col("_add")).otherwise(0)
    last = F.col("last") & ~(F.coalesce("_more", F.lit(False)) & same("_open"))
    return out.select(*columns, index.alias("index"), last.alias("last"))


def running(rows: DataFrame, key: str, place: str, sums: list[str]) -> DataFrame:
    """``rows`` with each of ``sums`` (integers) replaced by its sum over the key's rows up to this place, itself included.

    (key, place) is unique. Places are cut into blocks; blocks after a key's first one get the sums of the blocks before.
    """
    block = F.floor(F.col(place) / BLOCK)
    rows = rows.withColumn("_block", block)
    w = Window.partitionBy(key, "_block").orderBy(place)
    local = rows.select(*[F.sum(c).over(w).alias(c) if c in sums else F.col(c) for c in rows.columns])
    total = rows.groupBy(key, "_block").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(key, "_block", *[F.sum(f"_{c}").over(before).alias(f"_{c}") for c in sums])
    out = local.join(total, [key, "_block"], "left")
    return out.select(*[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) if c in sums else F.col(c) for c in rows.columns if c != "_block"])
