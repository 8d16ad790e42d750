"""Aggregation queries (AGG)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import aggregates as A
from graphloom.plans.registry import query
from graphloom.session import Data

CALIBRATION = """samples AS (
  SELECT l.doc_id, least(CAST(0.99 AS DOUBLE), round(n_chars / CAST(8000 AS DOUBLE), 2)) AS p, CAST(quality AS DOUBLE) AS y, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def samples(d: Data) -> DataFrame:
    """Predicted probability and outcome: text length as the prediction of quality."""
    p = F.least(F.lit(0.99), F.round(F.col("n_chars") / 8000.0, 2))
    return d.labels.join(d.documents.select("doc_id", "n_chars", "lang"), "doc_id").select("doc_id", p.alias("p"), F.col("quality").cast("double").alias("y"), "lang")


@query("agg01_kpi_summary", """
SELECT event_type, count(*) AS n, round(avg(latency_ms), 4) AS avg_value, min(latency_ms) AS min_value, max(latency_ms) AS max_value,
       round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95
FROM kpi WHERE day >= DATE '2024-01-08' GROUP BY event_type""")  # fmt: skip
def kpi_summary(d: Data) -> DataFrame:
    return A.latency_summary(d.kpi.where("ts >= TIMESTAMP_NTZ '2024-01-08'"), ["event_type"], "latency_ms")


@query("agg02_exact_percentile", "SELECT tenant, round(quantile_cont(latency_ms, 0.25), 6) AS p25, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM kpi GROUP BY tenant")
def exact_percentile(d: Data) -> DataFrame:
    return d.kpi.groupBy("tenant").agg(F.round(F.percentile("latency_ms", F.lit(0.25)), 6).alias("p25"), F.round(F.percentile("latency_ms", F.lit(0.99)), 6).alias("p99"))


@query("agg03_nearest_rank", """
WITH s AS (SELECT tenant, latency_ms, row_number() OVER (PARTITION BY tenant ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY tenant) AS n FROM kpi)
SELECT tenant, max(CASE WHEN i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN latency_ms END) AS nearest, round(stddev_samp(latency_ms), 6) AS stdev FROM s GROUP BY tenant""")
def nearest_rank(d: Data) -> DataFrame:
    return A.nearest_rank(d.kpi, ["tenant"], "latency_ms", 0.95)


@query("agg04_confidence_interval", "SELECT event_type, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99, round(avg(latency_ms), 6) AS mean, round(1.96 * stddev_samp(latency_ms) / sqrt(count(latency_ms)), 6) AS ci95 FROM kpi GROUP BY event_type")
def confidence_interval(d: Data) -> DataFrame:
    return A.confidence_interval(d.kpi, ["event_type"], "latency_ms")


@query("agg05_conditional_counts", """
SELECT count(*) AS n, count(CASE WHEN confidence >= 0.7 THEN 1 END) AS high, count(CASE WHEN confidence < 0.55 THEN 1 END) AS noise,
       count(CASE WHEN valid_from > recorded_at THEN 1 END) AS late, count(DISTINCT doc) AS docs FROM evidence""")
def conditional_counts(d: Data) -> DataFrame:
    c = F.col("confidence")
    return d.evidence.agg(F.count("*").alias("n"), F.count_if(c >= 0.7).alias("high"), F.count_if(c < 0.55).alias("noise"), F.count_if(F.col("valid_from") > F.col("recorded_at")).alias("late"), F.count_distinct("doc").alias("docs"))


@query("agg06_alias_coverage", """
WITH a AS (SELECT c.c_custkey, count(o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey)
SELECT count(*) AS entities, count(CASE WHEN n > 0 THEN 1 END) AS with_any, count(CASE WHEN n >= 5 THEN 1 END) AS with_five, count(CASE WHEN n = 0 THEN 1 END) AS without, round(avg(n), 6) AS mean FROM a""")
def alias_coverage(d: Data) -> DataFrame:
    counts = d.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    n = F.coalesce("k", F.lit(0))
    return d.customer.select("c_custkey").join(counts, "c_custkey", "left").agg(F.count("*").alias("entities"), F.count_if(n > 0).alias("with_any"), F.count_if(n >= 5).alias("with_five"), F.count_if(n == 0).alias("without"), F.round(F.avg(n), 6).alias("mean"))


@query("agg07_rate_per_thousand", """
WITH e AS (SELECT src, tgt, count(DISTINCT doc) AS docs FROM evidence GROUP BY src, tgt)
SELECT count(*) AS edges, count(CASE WHEN docs > 2 THEN 1 END) AS open_conflicts, round(count(CASE WHEN docs > 2 THEN 1 END) * 1000.0 / count(*), 6) AS per_thousand FROM e""")
def rate_per_thousand(d: Data) -> DataFrame:
    e = d.spread(d.evidence, "src", "tgt").groupBy("src", "tgt").agg(F.count_distinct("doc").alias("docs"))
    k = F.count_if(F.col("docs") > 2)
    return e.agg(F.count("*").alias("edges"), k.alias("open_conflicts"), F.round(A.ratio(k * 1000.0, F.count("*")), 6).alias("per_thousand"))


@query("agg08_orphan_rate", """
WITH o AS (SELECT c_custkey, max(CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 END) AS ever, max(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END) AS before
           FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
SELECT round(avg(1.0 - ever), 6) AS orphan_rate, round(avg(1.0 - before), 6) AS previous, round(avg(1.0 - ever) - avg(1.0 - before), 6) AS delta FROM o""")
def orphan_rate(d: Data) -> DataFrame:
    per = d.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderdate") < "1998-01-01", 1.0).otherwise(0.0)).alias("before"), F.lit(1.0).alias("ever"))
    j = d.customer.select("c_custkey").join(per, "c_custkey", "left").select(1 - F.coalesce("ever", F.lit(0.0)), 1 - F.coalesce("before", F.lit(0.0))).toDF("a", "b")
    return j.agg(F.round(F.avg("a"), 6).alias("orphan_rate"), F.round(F.avg("b"), 6).alias("previous"), F.round(F.avg("a") - F.avg("b"), 6).alias("delta"))


@query("agg09_coherence", """
WITH e AS (SELECT DISTINCT src, tgt FROM evidence), m AS (SELECT concat('SUPPLIER:', CAST(s_suppkey AS STRING)) AS node, s_nationkey % 5 AS community FROM supplier UNION ALL SELECT concat('PART:', CAST(p_partkey AS STRING)), p_size % 5 FROM part),
p AS (SELECT a.community AS c, avg(CASE WHEN a.community = b.community THEN 1.0 ELSE 0.0 END) AS share FROM e JOIN m a ON e.src = a.node LEFT JOIN m b ON e.tgt = b.node GROUP BY a.community)
SELECT round(avg(share), 6) AS coherence, count(*) AS communities FROM p""")
def coherence(d: Data) -> DataFrame:
    return A.coherence(d.evidence.select("src", "tgt").distinct(), communities(d))


def communities(d: Data) -> DataFrame:
    s = d.supplier.select(F.concat(F.lit("SUPPLIER:"), F.col("s_suppkey").cast("string")).alias("node"), (F.col("s_nationkey") % 5).alias("community"))
    return s.unionAll(d.part.select(F.concat(F.lit("PART:"), F.col("p_partkey").cast("string")), F.col("p_size") % 5))


@query("agg10_modularity", """
WITH e AS (SELECT DISTINCT least(src, tgt) AS u, greatest(src, tgt) AS v FROM relations), ends AS (SELECT u AS node FROM e UNION ALL SELECT v FROM e), deg AS (SELECT node, count(*) AS degree FROM ends GROUP BY node),
c AS (SELECT node, degree, coalesce(r.tgt, node) AS community FROM deg LEFT JOIN relations r ON r.src = node AND r.rel = 'PART_OF'), m AS (SELECT count(*) AS m FROM e),
i AS (SELECT a.community, count(*) AS inside FROM e JOIN c a ON a.node = e.u JOIN c b ON b.node = e.v WHERE a.community = b.community GROUP BY a.community),
d AS (SELECT community, sum(degree) AS d FROM c GROUP BY community)
SELECT round(sum(coalesce(inside, 0) / CAST(m AS DOUBLE) - (d / (2.0 * m)) * (d / (2.0 * m))), 6) AS modularity FROM d LEFT JOIN i ON i.community = d.community CROSS JOIN m""")
def modularity(d: Data) -> DataFrame:
    r = d.relations
    return A.modularity(r, r.where("rel = 'PART_OF'").select(F.col("src").alias("node"), F.col("tgt").alias("community")))


@query("agg11_bounded_groups", """
WITH r AS (SELECT o_orderpriority AS k, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS i FROM orders)
SELECT k AS o_orderpriority, count(*) AS n, string_agg(CASE WHEN i <= 3 THEN CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS members FROM r GROUP BY k""")
def bounded_groups(d: Data) -> DataFrame:
    return A.bounded_groups(d.orders, "o_orderpriority", "o_orderkey", 3)


@query("agg12_distinct_pairs", "SELECT l_returnflag, count(*) AS pairs FROM (SELECT DISTINCT l_returnflag, l_partkey, l_suppkey FROM lineitem) GROUP BY l_returnflag")
def distinct_pairs(d: Data) -> DataFrame:
    return d.lineitem.groupBy("l_returnflag").agg(F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("pairs"))


@query("agg13_filtered_distinct", "SELECT user_id, count(DISTINCT event_type) FILTER (WHERE latency_ms > 50) AS kinds, count(DISTINCT day) AS days FROM kpi GROUP BY user_id")
def filtered_distinct(d: Data) -> DataFrame:
    return d.kpi.groupBy("user_id").agg(F.count_distinct(F.when(F.col("latency_ms") > 50, F.col("event_type"))).alias("kinds"), F.count_distinct("day").alias("days"))


@query("agg14_first_per_key", "SELECT user_id, event_type, CAST(min(day) AS VARCHAR) AS first_day, min(event_id) AS first_event FROM kpi GROUP BY user_id, event_type")
def first_per_key(d: Data) -> DataFrame:
    return d.kpi.groupBy("user_id", "event_type").agg(F.min("day").cast("string").alias("first_day"), F.min("event_id").alias("first_event"))


@query("agg15_best_attempts", "SELECT o_custkey, max(o_totalprice) AS best, count(*) AS attempts, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS best_final FROM orders GROUP BY o_custkey")
def best_attempts(d: Data) -> DataFrame:
    return d.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"), F.count("*").alias("attempts"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("best_final"))


@query("agg16_accuracy", "SELECT user_id, CAST(coalesce(round(100.0 * count(CASE WHEN event_type = 'purchase' THEN 1 END) / nullif(count(CASE WHEN event_type IN ('purchase', 'error') THEN 1 END), 0)), 0) AS BIGINT) AS accuracy FROM kpi GROUP BY user_id")
def accuracy(d: Data) -> DataFrame:
    good, tries = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type").isin("purchase", "error"))
    return d.kpi.groupBy("user_id").agg(F.coalesce(F.round(F.try_divide(good * 100.0, tries)), F.lit(0.0)).cast("long").alias("accuracy"))


@query("agg17_cost_rollup", "SELECT tenant, event_type, round(sum(latency_ms), 4) AS cost, count(*) AS n FROM kpi GROUP BY ROLLUP (tenant, event_type)")
def cost_rollup(d: Data) -> DataFrame:
    return d.kpi.rollup("tenant", "event_type").agg(F.round(F.sum("latency_ms"), 4).alias("cost"), F.count("*").alias("n"))


@query("agg18_outcomes_unattributed", "SELECT coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END, 'unattributed') AS correlation, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1, 2")
def outcomes(d: Data) -> DataFrame:
    k = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")), F.lit("unattributed"))
    return d.orders.groupBy(k.alias("correlation"), "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("cost"))


@query("agg19_two_arm_study", """
WITH a AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'manual' ELSE 'assisted' END AS arm, latency_ms, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS ok FROM kpi),
s AS (SELECT arm, median(latency_ms) AS med, avg(latency_ms) AS mean, avg(ok) AS success FROM a GROUP BY arm)
SELECT round(max(CASE WHEN arm = 'manual' THEN med END), 6) AS manual_median, round(max(CASE WHEN arm = 'assisted' THEN med END), 6) AS assisted_median,
       round(max(CASE WHEN arm = 'manual' THEN success END), 6) AS manual_success, round(max(CASE WHEN arm = 'assisted' THEN success END), 6) AS assisted_success,
       round(100 * (max(CASE WHEN arm = 'manual' THEN mean END) - max(CASE WHEN arm = 'assisted' THEN mean END)) / max(CASE WHEN arm = 'manual' THEN mean END), 6) AS reduction FROM s""")
def two_arm_study(d: Data) -> DataFrame:
    arm = F.when(F.col("user_id") % 2 == 0, "manual").otherwise("assisted")
    s = d.kpi.groupBy(arm.alias("arm")).agg(F.median("latency_ms").alias("med"), F.avg("latency_ms").alias("mean"), F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)).alias("success"))
    of = lambda a, c: F.max(F.when(F.col("arm") == a, F.col(c)))
    return s.agg(*[F.round(of(a, c), 6).alias(f"{a}_{n}") for c, n in (("med", "median"), ("success", "success")) for a in ("manual", "assisted")], F.round(100 * (of("manual", "mean") - of("assisted", "mean")) / of("manual", "mean"), 6).alias("reduction"))


@query("agg20_revenue_summary", "SELECT o_orderpriority, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS won FROM orders GROUP BY o_orderpriority")
def revenue_summary(d: Data) -> DataFrame:
    return d.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)), 2).alias("won"))


@query("agg21_cohort_readiness", """
SELECT c_mktsegment, count(o_orderkey) AS assigned, count(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 END) AS completed,
       round(count(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 END) * 1.0 / nullif(count(o_orderkey), 0), 6) AS rate, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS score
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def cohort_readiness(d: Data) -> DataFrame:
    done, all_ = F.count_if(F.col("o_orderstatus").isin("F", "O")), F.count("o_orderkey")
    j = d.customer.join(d.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_mktsegment").agg(all_.alias("assigned"), done.alias("completed"), F.round(A.ratio(done, all_, None), 6).alias("rate"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 4).alias("score"))


@query("agg22_feedback_summary", "SELECT event_type, tenant, count(*) AS n, round(avg(latency_ms / 100), 6) AS relevance FROM kpi GROUP BY event_type, tenant")
def feedback_summary(d: Data) -> DataFrame:
    return d.kpi.groupBy("event_type", "tenant").agg(F.count("*").alias("n"), F.round(F.avg(F.col("latency_ms") / 100), 6).alias("relevance"))


@query("agg23_feedback_score", """
SELECT user_id, round(greatest(0.0, least(1.0, avg(coalesce(CASE WHEN latency_ms > 60 THEN latency_ms / 100 END, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'error' THEN -1.0 ELSE 0.0 END)))), 6) AS score FROM kpi GROUP BY user_id""")
def feedback_score(d: Data) -> DataFrame:
    by_kind = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.5).when(F.col("event_type") == "error", -1.0).otherwise(0.0)
    value = F.coalesce(F.when(F.col("latency_ms") > 60, F.col("latency_ms") / 100), by_kind)
    return d.kpi.groupBy("user_id").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(value))), 6).alias("score"))


@query("agg24_embedding_inventory", "SELECT coalesce(CASE WHEN label < 8 THEN concat('m', CAST(label % 2 AS STRING)) END, 'unknown') AS model, CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n FROM embeddings GROUP BY 1, 2")
def embedding_inventory(d: Data) -> DataFrame:
    model = F.coalesce(F.when(F.col("label") < 8, F.concat(F.lit("m"), (F.col("label") % 2).cast("string"))), F.lit("unknown"))
    return d.embeddings.groupBy(model.alias("model"), F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


@query("agg25_embedding_compatibility", """
SELECT CASE WHEN embedding IS NULL OR label >= 8 THEN 'unknown' WHEN len(embedding) <> 64 THEN 'dim_mismatch' WHEN label % 2 = 0 THEN 'stale' ELSE 'up_to_date' END AS status, count(*) AS n FROM embeddings GROUP BY 1""")
def embedding_compatibility(d: Data) -> DataFrame:
    s = F.when(F.col("embedding").isNull() | (F.col("label") >= 8), "unknown").when(F.size("embedding") != 64, "dim_mismatch").when(F.col("label") % 2 == 0, "stale").otherwise("up_to_date")
    return d.embeddings.groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("agg26_graph_snapshot", """
SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relations) AS relations, (SELECT count(DISTINCT type) FROM entities) AS types, (SELECT count(DISTINCT tenant) FROM entities) AS tenants,
       (SELECT count(*) FROM (SELECT DISTINCT src, tgt FROM evidence)) AS edges, (SELECT count(DISTINCT doc) FROM evidence) AS docs""")
def graph_snapshot(d: Data) -> DataFrame:
    e = d.entities.agg(F.count("*").alias("entities"), F.count_distinct("type").alias("types"), F.count_distinct("tenant").alias("tenants"))
    ev = d.evidence.agg(F.count_distinct(F.struct("src", "tgt")).alias("edges"), F.count_distinct("doc").alias("docs"))
    return e.crossJoin(d.relations.agg(F.count("*").alias("relations"))).crossJoin(ev)


@query("agg27_degree_outliers", """
WITH e AS (SELECT src AS node FROM evidence UNION ALL SELECT tgt FROM evidence), d AS (SELECT node, count(*) AS degree FROM e GROUP BY node), m AS (SELECT avg(degree) AS mean FROM d)
SELECT node, degree FROM d CROSS JOIN m WHERE degree > 3 * mean""")
def degree_outliers(d: Data) -> DataFrame:
    ev = d.evidence
    deg = ev.select(F.col("src").alias("node")).unionAll(ev.select("tgt")).groupBy("node").agg(F.count("*").alias("degree"))
    return deg.crossJoin(F.broadcast(deg.agg(F.avg("degree").alias("mean")))).where("degree > 3 * mean").select("node", "degree")


@query("agg28_corroboration", """
WITH p AS (SELECT a.src, a.tgt, a.doc AS d1, b.doc AS d2 FROM (SELECT DISTINCT src, tgt, doc FROM evidence) a JOIN (SELECT DISTINCT src, tgt, doc FROM evidence) b ON a.src = b.src AND a.tgt = b.tgt AND a.doc < b.doc WHERE b.doc - a.doc > 100),
x AS (SELECT src, tgt, d1 AS doc FROM p UNION SELECT src, tgt, d2 FROM p) SELECT src, tgt, count(*) AS independent FROM x GROUP BY src, tgt""")
def corroboration(d: Data) -> DataFrame:
    from graphloom.operators.governance import corroboration

    return corroboration(d.spread(d.evidence, "src", "tgt").withColumn("position", F.col("doc")), "position", 100)


@query("agg29_brier", f"WITH {CALIBRATION} SELECT lang, round(avg((p - y) * (p - y)), 6) AS brier, count(*) AS n FROM samples GROUP BY lang")
def brier(d: Data) -> DataFrame:
    return A.brier(samples(d), ["lang"], "p", "y")


CURVE = f"""WITH {CALIBRATION}, b AS (SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, avg(p) AS p, avg(y) AS y, count(*) AS n FROM samples GROUP BY 1),
c AS (SELECT CAST(r.i AS INTEGER) AS bin, coalesce(p, (r.i + 0.5) / 10) AS p, coalesce(y, (r.i + 0.5) / 10) AS y, coalesce(n, 0) AS n FROM range(10) r(i) LEFT JOIN b ON b.bin = r.i),
curve AS (SELECT bin, round(p, 6) AS mean_predicted, round(y, 6) AS mean_actual, n, round(abs(p - y), 6) AS gap FROM c)"""


@query("agg30_calibration_curve", f"{CURVE} SELECT * FROM curve")
def calibration_curve(d: Data) -> DataFrame:
    return A.calibration_curve(samples(d), "p", "y")


@query("agg31_calibration_verdict", f"""{CURVE}, v AS (SELECT round(sum(gap * n) / sum(n), 6) AS ece, count(CASE WHEN n > 0 AND mean_predicted - mean_actual > 0.05 THEN 1 END) AS over_bins, count(CASE WHEN n > 0 AND mean_actual - mean_predicted > 0.05 THEN 1 END) AS under_bins FROM curve)
SELECT *, CASE WHEN ece <= 0.10 THEN 'well_calibrated' WHEN ece <= 0.20 THEN 'fair' ELSE 'poor' END AS verdict FROM v""")  # fmt: skip
def calibration_verdict(d: Data) -> DataFrame:
    return A.calibration_verdict(A.calibration_curve(samples(d), "p", "y"))


@query("agg32_audit_outcomes", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def audit_outcomes(d: Data) -> DataFrame:
    return d.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("agg33_inconsistent_decisions", "SELECT user_id, day, count(DISTINCT event_type) AS choices FROM (SELECT user_id, CAST(day AS VARCHAR) AS day, event_type FROM kpi) GROUP BY user_id, day HAVING count(DISTINCT event_type) > 1")
def inconsistent(d: Data) -> DataFrame:
    return d.kpi.groupBy("user_id", F.col("day").cast("string").alias("day")).agg(F.count_distinct("event_type").alias("choices")).where("choices > 1")


@query("agg34_decision_coverage", """
WITH f AS (SELECT o_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS feedback, max(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS outcome FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT round(avg(feedback), 6) AS feedback, round(avg(outcome), 6) AS outcome, round(avg(feedback * outcome), 6) AS both_flags FROM f""")
def decision_coverage(d: Data) -> DataFrame:
    f = d.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("fb"), F.max(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)).alias("oc"))
    j = d.orders.select("o_orderkey").join(f, "o_orderkey", "left").fillna(0.0)
    return j.agg(F.round(F.avg("fb"), 6).alias("feedback"), F.round(F.avg("oc"), 6).alias("outcome"), F.round(F.avg(F.col("fb") * F.col("oc")), 6).alias("both_flags"))


@query("agg35_canonical_what_if", """
WITH b AS (SELECT src, rel, tgt, doc, confidence, CASE WHEN doc % 3 = 0 THEN 'PROVIDES' ELSE rel END AS raw FROM evidence), before AS (SELECT src, raw, tgt, count(DISTINCT doc) AS d FROM b GROUP BY src, raw, tgt), after AS (SELECT src, tgt, count(DISTINCT doc) AS d, 1 - product(1 - confidence) AS c FROM b GROUP BY src, tgt)
SELECT (SELECT count(*) FROM before) AS edges_before, (SELECT count(*) FROM after) AS edges_after, (SELECT count(*) FROM before WHERE d > 1) AS multi_before, (SELECT count(*) FROM after WHERE d > 1) AS multi_after, (SELECT count(*) FROM after WHERE c >= 0.95) AS certain""")
def canonical_what_if(d: Data) -> DataFrame:
    b = d.spread(d.evidence, "src", "tgt").withColumn("raw", F.when(F.col("doc") % 3 == 0, F.lit("PROVIDES")).otherwise(F.col("rel")))
    before = b.groupBy("src", "raw", "tgt").agg(F.count_distinct("doc").alias("d")).agg(F.count("*").alias("edges_before"), F.count_if(F.col("d") > 1).alias("multi_before"))
    after = b.groupBy("src", "tgt").agg(F.count_distinct("doc").alias("d"), A.noisy_or("confidence").alias("c")).agg(F.count("*").alias("edges_after"), F.count_if(F.col("d") > 1).alias("multi_after"), F.count_if(F.col("c") >= 0.95).alias("certain"))
    return before.crossJoin(after)


@query("agg36_noisy_or", "SELECT src, tgt, round(1 - product(1 - confidence), 6) AS confidence, count(*) AS n FROM evidence GROUP BY src, tgt")
def noisy_or(d: Data) -> DataFrame:
    return d.spread(d.evidence, "src", "tgt").groupBy("src", "tgt").agg(F.round(A.noisy_or("confidence"), 6).alias("confidence"), F.count("*").alias("n"))


@query("agg37_failure_taxonomy", """
SELECT CASE WHEN n_chars < 100 THEN 'ingest' WHEN lang <> 'en' THEN 'language' WHEN source = 'src0' THEN 'source' ELSE 'none' END AS layer, count(*) AS n FROM documents GROUP BY 1""")
def failure_taxonomy(d: Data) -> DataFrame:
    layer = F.when(F.col("n_chars") < 100, "ingest").when(F.col("lang") != "en", "language").when(F.col("source") == "src0", "source").otherwise("none")
    return d.documents.groupBy(layer.alias("layer")).agg(F.count("*").alias("n"))


@query("agg38_capitalised_terms", r"""
WITH w AS (SELECT unnest(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]{2,})', 1)) AS term FROM documents) SELECT term, count(*) AS n FROM w GROUP BY term HAVING count(*) >= 2""")
def capitalised_terms(d: Data) -> DataFrame:
    w = d.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z,] ([A-Z][a-z]{2,})"), F.lit(1))).alias("term"))
    return w.groupBy("term").agg(F.count("*").alias("n")).where("n >= 2")


@query("agg39_coverage_report", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def coverage_report(d: Data) -> DataFrame:
    return d.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.sum("n_chars").alias("chars"))


@query("agg40_metric_grouping_sets", """
SELECT c_mktsegment, round(avg(CASE WHEN isfinite(v) THEN v END), 6) AS mean, count(*) AS n FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN CAST('nan' AS DOUBLE) ELSE c_acctbal END AS v FROM customer) GROUP BY GROUPING SETS ((c_mktsegment), ())""")
def metric_grouping_sets(d: Data) -> DataFrame:
    v = d.customer.select("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("v"))
    return v.groupingSets([["c_mktsegment"], []], "c_mktsegment").agg(F.round(F.avg(F.when(~F.isnan("v"), F.col("v"))), 6).alias("mean"), F.count("*").alias("n"))


@query("agg41_backend_gate", """
WITH s AS (SELECT CAST(label % 2 AS INTEGER) AS backend, count(*) AS n, avg(CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE 1.0 END) AS equal FROM embeddings GROUP BY 1)
SELECT backend, n, round(equal, 6) AS equivalence, CASE WHEN equal >= 0.99 THEN 'migrate' WHEN equal >= 0.8 THEN 'pilot' ELSE 'stay' END AS decision FROM s""")
def backend_gate(d: Data) -> DataFrame:
    s = d.embeddings.groupBy((F.col("label") % 2).cast("int").alias("backend")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(1.0)).alias("e"))
    return s.select("backend", "n", F.round("e", 6).alias("equivalence"), F.when(F.col("e") >= 0.99, "migrate").when(F.col("e") >= 0.8, "pilot").otherwise("stay").alias("decision"))


@query("agg42_alerts", """
WITH g AS (SELECT tenant, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_rate, quantile_cont(latency_ms, 0.95) AS p95 FROM kpi GROUP BY tenant), m AS (SELECT tenant, 'error_rate' AS gauge, error_rate AS v, CAST(0.19 AS DOUBLE) AS top FROM g UNION ALL SELECT tenant, 'p95', p95, 90.0 FROM g)
SELECT tenant, gauge, round(v, 6) AS v FROM m WHERE v > top""")
def alerts(d: Data) -> DataFrame:
    g = d.kpi.groupBy("tenant").agg(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("error_rate"), F.percentile("latency_ms", F.lit(0.95)).alias("p95"))
    limits = F.array(F.struct(F.lit("error_rate").alias("gauge"), F.col("error_rate").alias("v"), F.lit(0.19).alias("top")), F.struct(F.lit("p95").alias("gauge"), F.col("p95").alias("v"), F.lit(90.0).alias("top")))
    return g.select("tenant", F.inline(limits)).where("v > top").select("tenant", "gauge", F.round("v", 6).alias("v"))


@query("gov09_fdr_threshold", f"""
WITH {CALIBRATION}, s AS (SELECT p AS s, count(*) AS k, sum(1 - y) AS bad FROM samples GROUP BY p), r AS (SELECT s, sum(k) OVER w AS n, sum(bad) OVER w AS wrong FROM s WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), b AS (SELECT max_by(s, n) AS accept, max(n) AS covered FROM r WHERE wrong <= n * 0.45)
SELECT round(accept, 6) AS accept, round(accept * 0.6, 6) AS retrieve, CAST(coalesce(covered, 0) AS BIGINT) AS covered FROM b""")
def fdr_threshold(d: Data) -> DataFrame:
    return A.fdr_threshold(samples(d), "p", "y", 0.45)
