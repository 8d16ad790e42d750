"""Structured Streaming over an event log: dedup, windows, quotas, smoothing, keyed recomputation."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import scratch

#: How late an event may come.
LATE = "10 minutes"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of ``path``, with ``ts`` as an instant."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def once(stream: DataFrame, mode: str, work: str | None = None) -> DataFrame:
    """All that the stream has now, as a table: every batch is appended (or, in complete mode, the last one kept)."""
    spark = stream.sparkSession
    at = f"{work.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}" if work else scratch(spark)
    put = "append" if mode == "append" else "overwrite"

    def keep(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}" if put == "append" else f"{at}/out/last")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out/*")


def deduplicated(events: DataFrame, key: str) -> DataFrame:
    """Each key once, as long as its repeats come within the lateness."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, length: str, by: list[str], value: str) -> DataFrame:
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", length), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return w.select(F.unix_timestamp("window.start").alias("started"), *by, "n", "total")


def sliding(events: DataFrame, length: str, step: str) -> DataFrame:
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n"))
    return w.select(F.unix_timestamp("window.start").alias("started"), "n")


def sessions(events: DataFrame, gap: str, by: str) -> DataFrame:
    s = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return s.select(F.unix_timestamp("session_window.start").alias("started"), by, "n")


def over_quota(events: DataFrame, length: str, by: str, most: int) -> DataFrame:
    """Fixed windows in which a key has more than ``most`` events."""
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", length), by).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return w.select(F.unix_timestamp("window.start").alias("started"), by, "n")


def smoothed(events: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """(key, n, ewma) after each batch: an exponentially weighted mean kept as state; ``order`` sorts a batch's events."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, s = state.get if state.exists else (0, 0.0)
        for x in pd.concat(list(frames)).sort_values(order)[value]:
            s = float(x) if n == 0 else alpha * float(x) + (1 - alpha) * s
            n += 1
        state.update((n, s))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ewma": [s]})

    return events.select(key, order, value).groupBy(key).applyInPandasWithState(fold, f"{key} long, n long, ewma double", "n long, ewma double", "append", "NoTimeout")


def recompute(changed: DataFrame, everything: Callable[[], DataFrame], key: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of just those keys that have a row in ``changed``, from all their rows."""
    return score(everything().join(changed.select(key).distinct(), key, "left_semi"))


def split_errors(batch: DataFrame, ok) -> tuple[DataFrame, DataFrame]:
    """Good rows, and those for the dead-letter table with the reason."""
    good = F.coalesce(ok, F.lit(False))
    return batch.where(good), batch.where(~good).withColumn("reason", F.lit("rejected"))


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """A topic of JSON rows; offsets are kept by the checkpoint, so a row is seen at least once and a keyed sink makes it once."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r"), F.col("timestamp").alias("received")).select("r.*", "received")


def since(events: DataFrame, recorded: str, revision, ended) -> DataFrame:
    """Rows recorded after one revision and up to another: what an incremental refresh has to look at."""
    return events.where((F.col(recorded) > revision) & (F.col(recorded) <= ended))


def affected(changed: DataFrame, total: DataFrame, key: str, full_at: float = 0.2) -> DataFrame:
    """Keys to refresh: those with changes; all of them once the changed share reaches ``full_at``."""
    c = changed.select(key).distinct()
    share = c.agg(F.count("*").alias("_c")).crossJoin(total.agg(F.count_distinct(key).alias("_t"))).select((F.col("_c") >= F.col("_t") * full_at).alias("_full"))
    every = total.select(key).distinct().crossJoin(F.broadcast(share)).where("_full").select(key)
    return c.unionByName(every).distinct()


def work_queue(spark: SparkSession, queue: str, done: str, dead: str, ok: Callable[[DataFrame], Column], most: int = 3) -> None:
    """Works off a folder of Parquet rows with a column ``attempt`` (0 at first) until it is empty. Rows for which ``ok`` holds go to
    ``done``; others come back to the queue with one attempt more, or go to ``dead`` once they have had ``most``.

    Offsets are kept by the checkpoint and move on only after a batch's side effects, so a row is handled at least once. A batch
    that runs again overwrites what it wrote to ``done`` and ``dead``; a row it put back twice is handled twice, so readers of
    ``done`` take each key once.
    """
    schema, again = spark.read.parquet(queue).schema, [1]

    def handle(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_errors(batch, ok(batch))
        bad = bad.drop("reason").withColumn("attempt", F.col("attempt") + 1)
        good.withColumn("attempt", F.col("attempt") + 1).write.mode("overwrite").parquet(f"{done}/batch={batch_id}")
        bad.where(F.col("attempt") >= most).write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        back = bad.where(F.col("attempt") < most)
        again[0] += back.limit(1).count()
        back.write.mode("append").parquet(queue)

    while again[0]:
        again[0] = 0
        spark.readStream.schema(schema).parquet(queue).writeStream.option("checkpointLocation", f"{queue}-offsets").trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()


def reaped(claims: DataFrame, now: Column, timeout: str, most: int) -> DataFrame:
    """(item, attempt, outcome) of claimed work: ``kept`` while a worker's claim is younger than ``timeout``; else (or without a time
    of the claim, which is taken as stale) it has one attempt more and is ``requeued``, or ``dead`` once it has had ``most``.
    claims: item, claimed_at, attempt."""
    fresh = F.coalesce(F.col("claimed_at") + F.expr(f"INTERVAL {timeout}") > now, F.lit(False))
    attempt = F.when(fresh, F.col("attempt")).otherwise(F.col("attempt") + 1)
    return claims.select("item", attempt.alias("attempt"), F.when(fresh, "kept").when(attempt >= most, "dead").otherwise("requeued").alias("outcome"))
