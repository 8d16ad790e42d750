"""Streaming queries (STM), run to the end of what is there and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.registry import query
from graphloom.session import Data, scratch
from graphloom.streaming import event_log as S


def log(d: Data) -> DataFrame:
    return S.read(d.spark, f"{d.dir}/events.parquet")


@query("stm01_dead_letters", "SELECT CASE WHEN value > 5 THEN 'good' ELSE 'dead' END AS lane, count(*) AS n FROM events GROUP BY 1")
def dead_letters(d: Data) -> DataFrame:
    rows = S.once(log(d).select("event_id", "value"), "append")
    good, dead = S.split_errors(rows, F.col("value") > 5)
    return good.agg(F.lit("good").alias("lane"), F.count("*").alias("n")).unionByName(dead.agg(F.lit("dead").alias("lane"), F.count("*").alias("n")))


@query("stm02_sampled_stage", "SELECT event_id FROM events WHERE event_id % 5 = 0")
def sampled_stage(d: Data) -> DataFrame:
    return S.once(log(d).where("event_id % 5 = 0").select("event_id"), "append")


@query("stm04_deduplicated", "SELECT DISTINCT event_id FROM events")
def deduplicated(d: Data) -> DataFrame:
    return S.once(S.deduplicated(log(d), "event_id").select("event_id"), "append")


@query("stm06_recomputed_scores", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 997 = 0) GROUP BY user_id")
def recomputed_scores(d: Data) -> DataFrame:
    changed = S.once(log(d).where("event_id % 997 = 0").select("user_id"), "append")
    return S.recompute(changed, lambda: d.events, "user_id", lambda e: e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))


@query("stm07_smoothed", """
WITH RECURSIVE o AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), e AS (SELECT user_id, i, x AS s FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, 0.2 * o.x + 0.8 * e.s FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1) SELECT user_id, max(i) AS n, round(max_by(s, i), 6) AS ewma FROM e GROUP BY user_id""")
def smoothed(d: Data) -> DataFrame:
    return S.once(S.smoothed(log(d), "user_id", "event_id", "value", 0.2), "append").withColumn("ewma", F.round("ewma", 6))


@query("stm08_over_quota", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 5")
def over_quota(d: Data) -> DataFrame:
    return S.once(S.over_quota(log(d), "1 hour", "event_type", 5), "complete")


@query("stm12_tumbling", "SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(d: Data) -> DataFrame:
    return S.once(S.tumbling(log(d), "1 day", ["event_type"], "value"), "complete")


@query("stm13_sliding", "SELECT CAST(epoch(b) AS BIGINT) AS started, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS b FROM events) GROUP BY 1")
def sliding(d: Data) -> DataFrame:
    return S.once(S.sliding(log(d), "1 day", "12 hours"), "complete")


@query("stm14_sessions", """
WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR > ts THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l) SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS started, user_id, count(*) AS n FROM s GROUP BY user_id, s""")
def sessions(d: Data) -> DataFrame:
    return S.once(S.sessions(log(d), "2 hours", "user_id"), "complete")


@query("stm03_work_queue", "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 'done' ELSE 'dead' END AS outcome, least(event_id % 5 + 1, 3) AS attempt FROM events")
def work_queue(d: Data) -> DataFrame:
    """Handling fails event_id % 5 times; after three attempts an event is dead."""
    at = scratch(d.spark)
    d.events.select("event_id", (F.col("event_id") % 5).alias("fails"), F.lit(0).cast("long").alias("attempt")).write.parquet(f"{at}/queue")
    S.work_queue(d.spark, f"{at}/queue", f"{at}/done", f"{at}/dead", lambda b: F.col("attempt") >= F.col("fails"))
    out = d.spark.read.parquet(f"{at}/done").select("event_id", F.lit("done").alias("outcome"), "attempt").unionByName(d.spark.read.parquet(f"{at}/dead").select("event_id", F.lit("dead").alias("outcome"), "attempt"))
    return out.dropDuplicates(["event_id"])


@query("stm05_reaper", """
WITH c AS (SELECT o_orderkey AS item, o_orderkey % 4 AS attempt, CASE WHEN o_custkey % 20 <> 3 THEN o_orderdate END AS claimed FROM orders), f AS (SELECT *, coalesce(claimed + INTERVAL 30 DAY > TIMESTAMP '1998-01-15', false) AS fresh FROM c)
SELECT item, CASE WHEN fresh THEN attempt ELSE attempt + 1 END AS attempt, CASE WHEN fresh THEN 'kept' WHEN attempt + 1 >= 3 THEN 'dead' ELSE 'requeued' END AS outcome FROM f""")
def reaper(d: Data) -> DataFrame:
    """Every order is claimed by a worker at its date; one worker in twenty has lost its claim's time."""
    c = d.orders.select(F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 4).alias("attempt"), F.when(F.col("o_custkey") % 20 != 3, F.col("o_orderdate").cast("timestamp")).alias("claimed_at"))
    return S.reaped(c, F.lit("1998-01-15").cast("timestamp"), "30 DAYS", 3)
