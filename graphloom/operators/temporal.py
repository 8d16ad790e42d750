"""Bitemporal and versioned tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType
from pyspark.sql.window import Window


def versions(df: DataFrame, key: str, order: list[str], since: str) -> DataFrame:
    """``df`` with ``valid_to``: when the next version of the key begins (null: it is current)."""
    return df.withColumn("valid_to", F.lead(since).over(Window.partitionBy(key).orderBy(*order)))


def reconcile(current: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action) of each record: CREATED, NO_OP, SUPERSEDED or TOMBSTONED, by content digest."""
    c, i = current.select(key, F.col(digest).alias("_c")), incoming.select(key, F.col(digest).alias("_i"))
    action = F.when(F.col("_c").isNull(), "CREATED").when(F.col("_i").isNull(), "TOMBSTONED").when(F.col("_c") == F.col("_i"), "NO_OP").otherwise("SUPERSEDED")
    return c.join(i, key, "full_outer").select(key, action.alias("action"))


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key from both."""
    both = current.unionByName(incoming)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), F.col(order)).alias("_r")).select("_r.*")


def insert_new(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """``current`` and, of the incoming rows, the first of each key that isn't in it."""
    fresh = incoming.join(current.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*fresh.columns), F.col(order)).alias("_r")).select("_r.*")
    return current.unionByName(first)


def without_document(evidence: DataFrame, doc) -> DataFrame:
    """Evidence after a document (condition ``doc``) is taken out; an edge without any left goes."""
    return evidence.where(~doc)


def metric_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta, pct) over the metrics of either."""
    j = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full_outer")
    delta = F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))
    return j.select("metric", "before", "after", delta.alias("delta"), F.round(100 * delta / F.nullif(F.col("before"), F.lit(0.0)), 4).alias("pct"))


def valid_transitions(events: DataFrame, key: str, order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Events with ``ok``: whether (state before, state) is in ``allowed`` (src, dst); a key's first event may have any state."""
    prev = events.withColumn("_p", F.lag(state).over(Window.partitionBy(key).orderBy(*order)))
    a = F.broadcast(allowed.select(F.col("src").alias("_p"), F.col("dst").alias(state), F.lit(True).alias("_ok")))
    return prev.join(a, ["_p", state], "left").withColumn("ok", F.col("_p").isNull() | F.coalesce("_ok", F.lit(False))).drop("_ok", "_p")


def transaction_diff(entities: DataFrame, edges: DataFrame, after: Column, upto: Column) -> DataFrame:
    """One row: entities and edges recorded in (after, upto], and how many there are as of ``upto``. Quarantined entities don't
    count; what has no recording time was always there. entities: recorded_at, quarantined; edges: recorded_at."""
    r = F.col("recorded_at")
    new, known = (r > after) & (r <= upto), r.isNull() | (r <= upto)
    count = lambda df, name: df.agg(F.count_if(new).alias(f"new_{name}"), F.count_if(known).alias("_n"))
    a = count(entities.where(~F.coalesce("quarantined", F.lit(False))), "entities").withColumnRenamed("_n", "entity_count")
    return a.crossJoin(F.broadcast(count(edges, "edges").withColumnRenamed("_n", "edge_count")))


#: The moves that each kind of record allows.
MOVES = {
    "finding": {"open": ("remediating", "accepted_risk"), "remediating": ("resolved", "open", "accepted_risk"), "resolved": ("open",), "accepted_risk": ("open",)},
    "work_order": {"draft": ("pending_approval", "cancelled"), "pending_approval": ("approved", "draft", "cancelled"), "approved": ("in_progress", "cancelled"), "in_progress": ("completed", "cancelled"), "completed": (), "cancelled": ()},
    "confidence": {"ASSERTED": ("APPROVED", "DISPUTED", "RETRACTED"), "INFERRED": ("ASSERTED", "APPROVED", "DISPUTED", "RETRACTED"), "DISPUTED": ("ASSERTED", "APPROVED", "RETRACTED"), "RETRACTED": (), "APPROVED": ("DISPUTED", "RETRACTED")},
}


def guarded_moves(requests: DataFrame, key: str, order: list[str], target: str, start: str, moves: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, order..., state, target, ok): requests of each key in order, from ``start``. A move that isn't allowed from the state
    a record is in is refused, and the record stays where it is. Rows stream through in order, so a key is never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, first = None, start, True
        for b in batches:
            states, oks = [], []
            for k, want in zip(b.column(key).to_pylist(), b.column(target).to_pylist(), strict=True):
                if first or k != now:
                    now, state, first = k, start, False
                ok = want in moves.get(state, ())
                states.append(state)
                oks.append(ok)
                state = want if ok else state
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(states, pa.string()), pa.array(oks, pa.bool_())], [*b.schema.names, "state", "ok"])

    slim = requests.select(key, *order, target)
    schema = StructType([*slim.schema.fields, StructField("state", StringType()), StructField("ok", BooleanType())])
    return slim.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def stale_chunks(chunks: DataFrame, kept: DataFrame, doc: str, index: str, keep: str) -> DataFrame:
    """Chunks that a shorter version of their document no longer has: index >= keep. Documents without a count keep all."""
    return chunks.join(kept.select(doc, keep), doc).where(F.col(index) >= F.col(keep)).select(chunks.columns)


def merge_scores(existing: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """``existing`` with the rows of ``changed`` in place of those with their key, and new keys added."""
    return existing.join(changed.select(key), key, "left_anti").unionByName(changed)


def integrity_digest(df: DataFrame, by: str, item: str, digits: int = 3) -> DataFrame:
    """(by, digest): a SHA-256 over all items of each key that their order doesn't change. Items go to 16**digits buckets by their
    own hash; the sorted items of a bucket have a digest, and the buckets' digests in order give the key's. So a key's items are
    never in one place, only its few thousand digests. A repeated item changes the digest; null items are left out."""
    h = df.where(F.col(item).isNotNull()).select(by, F.col(item).cast("string").alias("_i")).withColumn("_b", F.substring(F.sha2("_i", 256), 1, digits))
    per = h.groupBy(by, "_b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_i")), "\n"), 256).alias("_d"))
    return per.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"]), "\n"), 256).alias("digest"))
