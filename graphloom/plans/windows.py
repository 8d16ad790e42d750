"""Window queries (WIN) and date functions (DAT)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import selection
from graphloom.operators import windows as W
from graphloom.plans.registry import query
from graphloom.session import Data


@query("win01_leaderboard", """
WITH s AS (SELECT o_custkey, count(*) AS points, round(avg(o_totalprice), 2) AS accuracy, max(o_orderdate) AS updated FROM orders GROUP BY o_custkey)
SELECT o_custkey, points, row_number() OVER (ORDER BY points DESC, accuracy DESC, updated, o_custkey) AS place FROM s ORDER BY place LIMIT 100""")
def leaderboard(d: Data) -> DataFrame:
    s = d.orders.groupBy("o_custkey").agg(F.count("*").alias("points"), F.round(F.avg("o_totalprice"), 2).alias("accuracy"), F.max("o_orderdate").alias("updated"))
    # the limit comes first, so that the window over all rows sees a hundred
    top = s.orderBy(F.desc("points"), F.desc("accuracy"), "updated", "o_custkey").limit(100)
    w = Window.orderBy(F.desc("points"), F.desc("accuracy"), "updated", "o_custkey")
    return top.select("o_custkey", "points", F.row_number().over(w).cast("long").alias("place"))


@query("win02_board_per_key", "WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) SELECT c_mktsegment, c_custkey, place FROM r WHERE place <= 5")
def board_per_key(d: Data) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long")
    return d.customer.select("c_mktsegment", "c_custkey", r.alias("place")).where("place <= 5")


@query("win03_streaks", """
WITH x AS (SELECT DISTINCT user_id, day FROM kpi), r AS (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM x), n AS (SELECT user_id, island, count(*) AS days FROM r GROUP BY user_id, island)
SELECT user_id, count(*) AS streaks, max(days) AS longest, CAST(sum(days // 7 * 2000) AS BIGINT) AS bonus FROM n GROUP BY user_id""")
def streaks(d: Data) -> DataFrame:
    return W.streak_bonus(d.kpi, "user_id", "day")


CLEAN = """
WITH g AS (SELECT user_id, day, event_type, min(event_id) AS seen FROM kpi WHERE event_type <> 'error' GROUP BY user_id, day, event_type), c AS (SELECT user_id, day, max(seen) AS completed FROM g GROUP BY user_id, day HAVING count(*) >= 2),
b AS (SELECT user_id, day, min(event_id) AS wrong FROM kpi WHERE event_type = 'error' GROUP BY user_id, day)
SELECT c.user_id, CAST(c.day AS VARCHAR) AS day, completed, coalesce(wrong >= completed, true) AS clean, CASE WHEN coalesce(wrong >= completed, true) THEN 20 ELSE 0 END AS bonus FROM c LEFT JOIN b ON b.user_id = c.user_id AND b.day = c.day"""


@query("win04_clean_pages", CLEAN)
def clean_pages(d: Data) -> DataFrame:
    out = W.clean_pages(d.kpi, ["user_id", "day"], "event_type", F.lit(2), "event_id", F.col("event_type") != "error", F.col("event_type") == "error")
    return out.withColumn("day", F.col("day").cast("string"))


@query("win06_latest_per_key", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest(d: Data) -> DataFrame:
    return d.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("win07_margin", "WITH r AS (SELECT o_custkey, o_totalprice, lead(o_totalprice) OVER w AS n, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) SELECT o_custkey, o_totalprice AS best, round(o_totalprice - coalesce(n, 0), 4) AS margin FROM r WHERE r = 1")
def margin(d: Data) -> DataFrame:
    return W.margin(d.orders, "o_custkey", "o_totalprice", "o_orderkey").withColumn("margin", F.round("margin", 4))


@query("win08_rank_to_score", "SELECT s_suppkey, round(1 - (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1) / CAST(count(*) OVER (PARTITION BY s_nationkey) AS DOUBLE), 6) AS score FROM supplier")
def rank_to_score(d: Data) -> DataFrame:
    w = Window.partitionBy("s_nationkey")
    return d.supplier.select("s_suppkey", F.round(1 - (F.row_number().over(w.orderBy(F.desc("s_acctbal"), "s_suppkey")) - 1) / F.count("*").over(w), 6).alias("score"))


@query("win09_ewma", """
WITH RECURSIVE o AS (SELECT user_id, latency_ms AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM kpi), e AS (SELECT user_id, i, x AS s FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, 0.2 * o.x + 0.8 * e.s FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1)
SELECT user_id, round(max_by(s, i), 6) AS ewma, max(i) AS n FROM e GROUP BY user_id""")
def ewma(d: Data) -> DataFrame:
    return W.ewma(d.kpi, "user_id", ["event_id"], "latency_ms", 0.2).withColumn("ewma", F.round("ewma", 6))


@query("win10_snapshot_delta", """
WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT month, n, lag(n) OVER (ORDER BY month) AS p FROM s)
SELECT CAST(month AS VARCHAR) AS month, n, n - coalesce(p, 0) AS delta, round(100.0 * (n - p) / p, 4) AS pct FROM l""")
def snapshot_delta(d: Data) -> DataFrame:
    s = d.orders.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.count("*").alias("n"))
    p = F.lag("n").over(Window.orderBy("month"))  # a row a month
    return s.select(F.col("month").cast("string").alias("month"), "n", (F.col("n") - F.coalesce(p, F.lit(0))).alias("delta"), F.round(100.0 * (F.col("n") - p) / p, 4).alias("pct"))


@query("win11_relative_mean", "SELECT s_suppkey, round(s_acctbal / avg(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS ratio FROM supplier")
def relative_mean(d: Data) -> DataFrame:
    return d.supplier.select("s_suppkey", F.round(F.col("s_acctbal") / F.avg("s_acctbal").over(Window.partitionBy("s_nationkey")), 6).alias("ratio"))


@query("win12_transcript_windows")
def transcript_windows(d: Data) -> DataFrame:
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = d.conversations.withColumn("n_tokens", words).withColumn("length", F.col("n_tokens") * 0.4)
    start = F.sum("length").over(w) - F.col("length") + F.col("turn") % 3 * 2.0
    return selection.transcript_windows(s.select(F.col("conv_id").alias("conv"), F.col("turn").alias("seq"), start.alias("started"), (start + F.col("length")).alias("ended"), "n_tokens"))


@query("win13_change_capture", "WITH l AS (SELECT deal, seq, stage, lag(stage) OVER (PARTITION BY deal ORDER BY changed, seq) AS previous FROM changes) SELECT deal, seq, stage, previous FROM l WHERE previous IS NULL OR previous <> stage")
def change_capture(d: Data) -> DataFrame:
    return W.changes(d.changes, "deal", ["changed", "seq"], "stage").select("deal", "seq", "stage", "previous")


@query("win14_versions", "SELECT deal, seq, CAST(changed AS VARCHAR) AS valid_from, CAST(lead(changed) OVER (PARTITION BY deal ORDER BY changed, seq) AS VARCHAR) AS valid_to FROM changes")
def versions(d: Data) -> DataFrame:
    t = F.lead("changed").over(Window.partitionBy("deal").orderBy("changed", "seq"))
    return d.changes.select("deal", "seq", F.col("changed").cast("string").alias("valid_from"), t.cast("string").alias("valid_to"))


@query("win15_diversity_cap", "WITH r AS (SELECT subject, claim_id, predicate, row_number() OVER (PARTITION BY subject, predicate ORDER BY amount DESC, claim_id) AS r FROM claims) SELECT subject, predicate, claim_id FROM r WHERE r <= 2")
def diversity_cap(d: Data) -> DataFrame:
    w = Window.partitionBy("subject", "predicate").orderBy(F.desc("amount"), "claim_id")
    return d.claims.withColumn("r", F.row_number().over(w)).where("r <= 2").select("subject", "predicate", "claim_id")


# Dates ------------------------------------------------------------------------------------------------------------


@query("dat01_half_life", "SELECT src, tgt, round(max(confidence * exp(-ln(2.0) / 180 * greatest(0, date_diff('day', valid_from, DATE '2001-01-01')))), 6) AS decayed FROM evidence GROUP BY src, tgt")
def half_life(d: Data) -> DataFrame:
    age = F.greatest(F.lit(0), F.datediff(F.lit("2001-01-01").cast("date"), F.col("valid_from")))
    from graphloom.functions.dates import half_life as decay

    return d.spread(d.evidence, "src", "tgt").groupBy("src", "tgt").agg(F.round(F.max(decay(F.col("confidence"), age, 180)), 6).alias("decayed"))


@query("dat02_recency", "SELECT claim_id, round(1.0 / (1 + date_diff('day', valid_from, DATE '2001-12-31') / 30.0), 6) AS weight FROM claims")
def recency(d: Data) -> DataFrame:
    from graphloom.functions.dates import recency as weight

    return d.claims.select("claim_id", F.round(weight(F.datediff(F.lit("2001-12-31").cast("date"), "valid_from")), 6).alias("weight"))


@query("dat04_expiry", """
SELECT claim_id, CASE WHEN left_ <= 7 THEN 'high' WHEN left_ <= 14 THEN 'medium' ELSE 'low' END AS urgency FROM (SELECT claim_id, date_diff('day', DATE '1998-03-01', valid_from) AS left_ FROM claims) WHERE left_ BETWEEN 0 AND 30""")
def expiry(d: Data) -> DataFrame:
    left = F.datediff(F.col("valid_from"), F.lit("1998-03-01").cast("date"))
    return d.claims.withColumn("left_", left).where("left_ BETWEEN 0 AND 30").select("claim_id", F.when(F.col("left_") <= 7, "high").when(F.col("left_") <= 14, "medium").otherwise("low").alias("urgency"))


@query("dat05_validity", "SELECT deal, CASE WHEN min(changed) <= DATE '1997-01-01' THEN 'valid' ELSE 'not_valid' END AS state FROM changes GROUP BY deal")
def validity(d: Data) -> DataFrame:
    return d.changes.groupBy("deal").agg(F.when(F.min("changed") <= F.lit("1997-01-01").cast("date"), "valid").otherwise("not_valid").alias("state"))


@query("dat06_overdue", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-06-01'")
def overdue(d: Data) -> DataFrame:
    return d.orders.where("o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-06-01'").select("o_orderkey")
