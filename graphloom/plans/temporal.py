"""Temporal, sink and governance queries (TMP, SNK, GOV)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import governance as G
from graphloom.operators import temporal as T
from graphloom.plans.registry import query
from graphloom.session import Data, written


@query("tmp01_as_of_edges", "SELECT src, tgt, count(*) AS n FROM evidence WHERE valid_from <= DATE '1996-01-01' AND valid_from + 90 > DATE '1996-01-01' AND recorded_at <= DATE '1995-12-15' GROUP BY src, tgt")
def as_of_edges(d: Data) -> DataFrame:
    from graphloom.operators.predicates import as_of

    at = lambda s: F.lit(s).cast("date")
    seen = d.evidence.where(as_of(F.col("valid_from"), F.date_add("valid_from", 90), F.col("recorded_at"), at("1996-01-01"), at("1995-12-15")))
    return seen.groupBy("src", "tgt").agg(F.count("*").alias("n"))


@query("tmp02_transaction_diff", """
WITH n AS (SELECT id, CASE WHEN id LIKE '%:7' THEN NULL ELSE min(r) END AS r, id LIKE '%9' AS quarantined FROM (SELECT src AS id, recorded_at AS r FROM evidence UNION ALL SELECT tgt, recorded_at FROM evidence) GROUP BY id), e AS (SELECT src, tgt, min(recorded_at) AS r FROM evidence GROUP BY src, tgt)
SELECT (SELECT count(*) FROM n WHERE NOT quarantined AND r > DATE '1996-01-01' AND r <= DATE '1997-01-01') AS new_entities, (SELECT count(*) FROM e WHERE r > DATE '1996-01-01' AND r <= DATE '1997-01-01') AS new_edges, (SELECT count(*) FROM n WHERE NOT quarantined AND (r IS NULL OR r <= DATE '1997-01-01')) AS entity_count, (SELECT count(*) FROM e WHERE r IS NULL OR r <= DATE '1997-01-01') AS edge_count""")
def transaction_diff(d: Data) -> DataFrame:
    ends = d.evidence.select(F.explode(F.array("src", "tgt")).alias("id"), "recorded_at")
    n = ends.groupBy("id").agg(F.min("recorded_at").alias("recorded_at")).select("id", F.when(~F.col("id").endswith(":7"), F.col("recorded_at")).alias("recorded_at"), F.col("id").endswith("9").alias("quarantined"))
    e = d.spread(d.evidence, "src", "tgt").groupBy("src", "tgt").agg(F.min("recorded_at").alias("recorded_at"))
    return T.transaction_diff(n, e, F.lit("1996-01-01").cast("date"), F.lit("1997-01-01").cast("date"))


@query("tmp03_history", "SELECT seq, stage, CAST(changed AS VARCHAR) AS changed FROM changes WHERE deal = 10")
def history(d: Data) -> DataFrame:
    return d.changes.where("deal = 10").select("seq", "stage", F.col("changed").cast("string").alias("changed"))


@query("tmp04_time_travel", "SELECT stage, count(*) AS n FROM (SELECT deal, max_by(stage, (changed, seq)) AS stage FROM changes WHERE changed <= DATE '1997-12-31' GROUP BY deal) GROUP BY stage")
def time_travel(d: Data) -> DataFrame:
    last = d.changes.where("changed <= DATE '1997-12-31'").groupBy("deal").agg(F.max_by("stage", F.struct("changed", "seq")).alias("stage"))
    return last.groupBy("stage").agg(F.count("*").alias("n"))


@query("tmp05_snapshot_diff", """
WITH b AS (SELECT o_orderpriority AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), a AS (SELECT o_orderpriority AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1)
SELECT coalesce(b.metric, a.metric) AS metric, b.value AS before, a.value AS after, coalesce(a.value, 0) - coalesce(b.value, 0) AS delta, round(100 * (coalesce(a.value, 0) - coalesce(b.value, 0)) / nullif(b.value, 0), 4) AS pct FROM b FULL OUTER JOIN a ON a.metric = b.metric""")
def snapshot_diff(d: Data) -> DataFrame:
    of = lambda o: o.groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return T.metric_diff(of(d.orders.where("o_orderdate < TIMESTAMP '1997-01-01'")), of(d.orders))


@query("tmp06_integrity_hash", "WITH b AS (SELECT tenant, left(sha256(id), 3) AS b, sha256(string_agg(id, chr(10) ORDER BY id)) AS d FROM entities GROUP BY tenant, left(sha256(id), 3)) SELECT tenant, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM b GROUP BY tenant")
def integrity_hash(d: Data) -> DataFrame:
    return T.integrity_digest(d.entities, "tenant", "id")


@query("tmp07_reconcile", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'CREATED' WHEN o_orderkey % 10 = 1 THEN 'TOMBSTONED' WHEN o_orderstatus = 'P' THEN 'SUPERSEDED' ELSE 'NO_OP' END AS action FROM orders""")
def reconcile(d: Data) -> DataFrame:
    digest = lambda s: F.sha2(F.concat_ws("|", F.col("o_orderkey"), s), 256).alias("digest")
    now = d.orders.where("o_orderkey % 10 <> 0").select("o_orderkey", digest(F.col("o_orderstatus")))
    come = d.orders.where("o_orderkey % 10 <> 1").select("o_orderkey", digest(F.replace("o_orderstatus", F.lit("P"), F.lit("F"))))
    return T.reconcile(now, come, "o_orderkey", "digest")


@query("tmp08_closed_intervals", "SELECT subject, claim_id, lead(claim_id) OVER (PARTITION BY subject, predicate ORDER BY valid_from, claim_id) IS NOT NULL AS superseded FROM claims")
def closed_intervals(d: Data) -> DataFrame:
    from pyspark.sql.window import Window

    later = F.lead("claim_id").over(Window.partitionBy("subject", "predicate").orderBy("valid_from", "claim_id"))
    return d.claims.select("subject", "claim_id", later.isNotNull().alias("superseded"))


@query("tmp11_guarded_transition", "WITH l AS (SELECT deal, stage, lag(stage) OVER (PARTITION BY deal ORDER BY changed, seq) AS p FROM changes) SELECT coalesce(p IS NULL OR (p = 'O' AND stage = 'F') OR (p = 'F' AND stage = 'O') OR p = stage, false) AS ok, count(*) AS n FROM l GROUP BY 1")
def guarded_transition(d: Data) -> DataFrame:
    ok = d.spark.createDataFrame([("O", "F"), ("F", "O"), ("O", "O"), ("F", "F"), ("P", "P")], "src string, dst string")
    return T.valid_transitions(d.changes, "deal", ["changed", "seq"], "stage", ok).groupBy("ok").agg(F.count("*").alias("n"))


@query("tmp12_lifecycle", """
WITH RECURSIVE m(s, t) AS (VALUES ('open', 'remediating'), ('open', 'accepted_risk'), ('remediating', 'resolved'), ('remediating', 'open'), ('remediating', 'accepted_risk'), ('resolved', 'open'), ('accepted_risk', 'open')),
e AS (SELECT deal, seq, CASE seq % 4 WHEN 0 THEN 'remediating' WHEN 1 THEN 'resolved' WHEN 2 THEN 'open' ELSE 'accepted_risk' END AS target, row_number() OVER (PARTITION BY deal ORDER BY changed, seq) AS i FROM changes),
r AS (SELECT deal, seq, i, 'open' AS state, target, EXISTS (SELECT 1 FROM m WHERE s = 'open' AND t = target) AS ok FROM e WHERE i = 1 UNION ALL SELECT e.deal, e.seq, e.i, CASE WHEN r.ok THEN r.target ELSE r.state END, e.target, EXISTS (SELECT 1 FROM m WHERE s = CASE WHEN r.ok THEN r.target ELSE r.state END AND t = e.target) FROM r JOIN e ON e.deal = r.deal AND e.i = r.i + 1)
SELECT deal, seq, state, target, ok FROM r""")
def lifecycle(d: Data) -> DataFrame:
    k = F.col("seq") % 4
    moves = d.changes.select("deal", "changed", "seq", F.when(k == 0, "remediating").when(k == 1, "resolved").when(k == 2, "open").otherwise("accepted_risk").alias("target"))
    return T.guarded_moves(moves, "deal", ["changed", "seq"], "target", "open", T.MOVES["finding"]).select("deal", "seq", "state", "target", "ok")


@query("tmp13_staleness", """
WITH s AS (SELECT o_custkey, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN n > 20 THEN 'reingest' WHEN date_diff('day', last, DATE '2001-08-02') > 60 THEN 'aged' ELSE 'fresh' END AS state FROM s""")
def staleness(d: Data) -> DataFrame:
    s = d.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max(F.col("o_orderdate").cast("date")).alias("last"))
    age = F.datediff(F.lit("2001-08-02").cast("date"), F.col("last"))
    return s.select("o_custkey", F.when(F.col("n") > 20, "reingest").when(age > 60, "aged").otherwise("fresh").alias("state"))


# Sinks --------------------------------------------------------------------------------------------------------------


@query("snk01_upsert", "SELECT c_custkey, round(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 4) AS balance FROM customer")
def upsert(d: Data) -> DataFrame:
    old = d.customer.select("c_custkey", F.col("c_acctbal").alias("balance"), F.lit(1).alias("version"))
    new = d.customer.where("c_custkey % 4 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("balance"), F.lit(2).alias("version"))
    return T.upsert(old, new, "c_custkey", "version").select("c_custkey", F.round("balance", 4).alias("balance"))


@query("snk03_mentions", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
def mentions(d: Data) -> DataFrame:
    return d.lineitem.select("l_orderkey", "l_partkey").dropDuplicates()


@query("snk05_stale_chunks", "SELECT l_orderkey AS doc, l_linenumber - 1 AS chunk FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_linenumber - 1 >= l_orderkey % 5")
def stale_chunks(d: Data) -> DataFrame:
    chunks = d.lineitem.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - 1).alias("chunk"))
    kept = d.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 5).alias("keep"))
    return T.stale_chunks(chunks, kept, "doc", "chunk", "keep")


@query("snk06_reconciled_evidence", "SELECT src, tgt, count(DISTINCT doc) AS docs FROM evidence WHERE doc % 5 <> 0 GROUP BY src, tgt")
def reconciled_evidence(d: Data) -> DataFrame:
    return d.spread(T.without_document(d.evidence, F.col("doc") % 5 == 0), "src", "tgt").groupBy("src", "tgt").agg(F.count_distinct("doc").alias("docs"))


@query("snk07_tombstones", "SELECT c_custkey, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1999-01-01') AS tombstone FROM customer")
def tombstones(d: Data) -> DataFrame:
    listed = d.orders.where("o_orderdate >= TIMESTAMP '1999-01-01'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("live", F.lit(True))
    return d.customer.select("c_custkey").join(listed, "c_custkey", "left").select("c_custkey", F.col("live").isNull().alias("tombstone"))


@query("snk08_idempotent_insert", "SELECT event_id FROM events")
def idempotent_insert(d: Data) -> DataFrame:
    e = d.events.select("event_id", "value")
    return T.insert_new(e.where("event_id % 2 = 0"), e.unionAll(e.where("event_id % 3 = 0")), "event_id", "value").select("event_id")


@query("snk13_audit_rows", "SELECT c_custkey, '{\"before\":' || CAST(c_nationkey AS VARCHAR) || ',\"after\":' || CAST(c_nationkey + 1 AS VARCHAR) || '}' AS change FROM customer")
def audit_rows(d: Data) -> DataFrame:
    return d.customer.select("c_custkey", F.to_json(F.struct(F.col("c_nationkey").alias("before"), (F.col("c_nationkey") + 1).alias("after"))).alias("change"))


# Governance ---------------------------------------------------------------------------------------------------------


@query("gov01_functional_violations", "SELECT tgt AS subject, count(DISTINCT src) AS targets FROM evidence GROUP BY tgt HAVING count(DISTINCT src) > 1")
def functional_violations(d: Data) -> DataFrame:
    return G.functional_violations(d.spread(d.evidence, "tgt", "src"), "tgt", "src")


@query("gov02_arbitration", """
SELECT a.claim_id AS id_a, b.claim_id AS id_b, CASE WHEN abs(a.amount - b.amount) > 1e-9 THEN CASE WHEN a.amount > b.amount THEN a.claim_id ELSE b.claim_id END WHEN a.valid_from <> b.valid_from THEN CASE WHEN a.valid_from > b.valid_from THEN a.claim_id ELSE b.claim_id END ELSE -1 END AS winner
FROM claims a JOIN claims b ON a.subject = b.subject AND a.predicate = b.predicate AND a.claim_id < b.claim_id AND a.object <> b.object""")
def arbitration(d: Data) -> DataFrame:
    c = d.claims.select("subject", "predicate", "claim_id", "object", "amount", "valid_from")
    a, b = (c.select("subject", "predicate", *[F.col(x).alias(f"{x}_{s}") for x in ("claim_id", "object", "amount", "valid_from")]) for s in "ab")
    j = a.join(b, ["subject", "predicate"]).where("claim_id_a < claim_id_b AND object_a <> object_b")
    pick = lambda x: F.when(F.col(f"{x}_a") > F.col(f"{x}_b"), F.col("claim_id_a")).otherwise(F.col("claim_id_b"))
    w = F.when(F.abs(F.col("amount_a") - F.col("amount_b")) > 1e-9, pick("amount")).when(F.col("valid_from_a") != F.col("valid_from_b"), pick("valid_from")).otherwise(-1)
    return j.select(F.col("claim_id_a").alias("id_a"), F.col("claim_id_b").alias("id_b"), w.alias("winner"))


@query("gov03_forget_document", "SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey % 50 <> 0) AS kept, (SELECT count(*) FROM lineitem WHERE l_orderkey % 50 = 0) AS erased, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(CASE WHEN l_orderkey % 50 <> 0 THEN 1 END) = 0)) AS orphaned")
def forget_document(d: Data) -> DataFrame:
    gone = F.col("l_orderkey") % 50 == 0
    a = d.lineitem.agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("erased"))
    o = d.lineitem.groupBy("l_partkey").agg(F.count_if(~gone).alias("k")).agg(F.count_if(F.col("k") == 0).alias("orphaned"))
    return a.crossJoin(o)


@query("gov04_subject_erasure", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN '[ERASED]' ELSE md5(coalesce(text, '')) END AS text FROM conversations")
def subject_erasure(d: Data) -> DataFrame:
    return d.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", "[ERASED]").otherwise(F.md5(F.coalesce("text", F.lit("")))).alias("text"))


@query("gov05_retraction_impact", "WITH p AS (SELECT src, tgt, count(CASE WHEN doc % 10 = 3 THEN 1 END) AS lost, count(*) AS n FROM evidence GROUP BY src, tgt) SELECT count(*) AS affected, count(CASE WHEN lost = n THEN 1 END) AS orphaned, count(CASE WHEN n - lost = 1 THEN 1 END) AS at_risk FROM p WHERE lost > 0")
def retraction_impact(d: Data) -> DataFrame:
    return G.retraction_impact(d.spread(d.evidence, "src", "tgt"), F.col("doc") % 10 == 3)


@query("gov06_retention", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' AND o_orderstatus <> 'O'")
def retention(d: Data) -> DataFrame:
    return d.orders.where("o_orderdate < TIMESTAMP '1995-06-01' AND o_orderstatus <> 'O'").select("o_orderkey")


@query("gov07_ingestion_report", """
SELECT 'low_confidence' AS issue, count(*) AS n FROM evidence WHERE confidence < 0.55 UNION ALL SELECT 'self_loop', count(*) FROM evidence WHERE src = tgt UNION ALL SELECT 'late_record', count(*) FROM evidence WHERE recorded_at > valid_from""")
def ingestion_report(d: Data) -> DataFrame:
    checks = F.array_compact(F.array(F.when(F.col("confidence") < 0.55, F.lit("low_confidence")), F.when(F.col("src") == F.col("tgt"), F.lit("self_loop")), F.when(F.col("recorded_at") > F.col("valid_from"), F.lit("late_record"))))
    found = d.evidence.select(F.explode(checks).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    kinds = d.spark.createDataFrame([("low_confidence",), ("self_loop",), ("late_record",)], "issue string")
    return kinds.join(found, "issue", "left").fillna(0, ["n"])


@query("gov08_quarantine_log", "SELECT user_id, max_by(event_type, event_id) = 'error' AS quarantined FROM kpi GROUP BY user_id")
def quarantine_log(d: Data) -> DataFrame:
    from graphloom.operators.resolution import latest_state

    return latest_state(d.kpi, "user_id", ["event_id"], "event_type").select("user_id", (F.col("event_type") == "error").alias("quarantined"))


@query("gov10_judge", "SELECT doc_id, CASE WHEN n_chars >= 4000 THEN 'answer' WHEN n_chars >= 2400 THEN 'retrieve' ELSE 'abstain' END AS decision FROM documents")
def judge(d: Data) -> DataFrame:
    p = F.col("n_chars") / 8000.0
    return d.documents.select("doc_id", F.when(p >= 0.5, "answer").when(p >= 0.3, "retrieve").otherwise("abstain").alias("decision"))


@query("gov11_apply_calibration", """
WITH s AS (SELECT l.doc_id, least(CAST(0.99 AS DOUBLE), round(n_chars / CAST(8000 AS DOUBLE), 2)) AS p, CAST(quality AS DOUBLE) AS y FROM labels l JOIN documents d ON l.doc_id = d.doc_id), b AS (SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, avg(y) AS y FROM s GROUP BY 1)
SELECT doc_id, round(b.y, 6) AS calibrated FROM s JOIN b ON b.bin = least(CAST(floor(s.p * 10) AS INTEGER), 9)""")
def apply_calibration(d: Data) -> DataFrame:
    from graphloom.plans.aggregates import samples

    s = samples(d).withColumn("bin", F.least(F.floor(F.col("p") * 10), F.lit(9)))
    curve = s.groupBy("bin").agg(F.avg("y").alias("m"))
    return s.join(F.broadcast(curve), "bin").select("doc_id", F.round("m", 6).alias("calibrated"))


@query("gov12_provenance", "SELECT 'claim' AS kind, count(DISTINCT claim_id) AS n FROM claims UNION ALL SELECT 'subject', count(DISTINCT subject) FROM claims UNION ALL SELECT 'predicate', count(DISTINCT predicate) FROM claims")
def provenance(d: Data) -> DataFrame:
    n = d.claims.select(F.explode(F.array(F.struct(F.lit("claim").alias("kind"), F.col("claim_id").cast("string").alias("id")), F.struct(F.lit("subject").alias("kind"), F.col("subject").cast("string").alias("id")), F.struct(F.lit("predicate").alias("kind"), F.col("predicate").alias("id")))).alias("x")).select("x.*")
    return n.distinct().groupBy("kind").agg(F.count("*").alias("n"))


@query("gov01_contradictions", """
WITH e AS (SELECT DISTINCT src, tgt FROM evidence), p AS (SELECT c_nationkey % 7 AS a, c_custkey % 11 AS b FROM customer), ring AS (SELECT DISTINCT 'N' || CAST(a AS VARCHAR) AS src, CASE WHEN (a + b) % 3 = 0 THEN 'RELATED_TO' ELSE 'SUPERSEDES' END AS rel, 'N' || CAST(b AS VARCHAR) AS tgt FROM p),
st AS (SELECT l_partkey AS e, CASE l_returnflag WHEN 'A' THEN 'IS_ACTIVE' ELSE 'IS_DEPRECATED' END AS rel, l_orderkey AS doc FROM lineitem WHERE l_returnflag IN ('A', 'R')),
ex AS (SELECT 'PART:' || CAST(e AS VARCHAR) AS src, count(DISTINCT doc) AS docs FROM st GROUP BY e HAVING count(DISTINCT rel) = 2 AND count(DISTINCT doc) > 1),
fv AS (SELECT tgt AS src, count(DISTINCT src) AS n, count(DISTINCT doc) AS docs FROM evidence GROUP BY tgt HAVING count(DISTINCT src) > 1),
pn AS (SELECT src, tgt, count(DISTINCT doc) AS docs FROM evidence WHERE confidence >= 0.85 OR confidence <= 0.55 GROUP BY src, tgt HAVING max(confidence) >= 0.85 AND min(confidence) <= 0.55),
x AS (SELECT 'directional_reversal' AS kind, a.src, a.rel, a.tgt, 0 AS docs FROM ring a JOIN ring b ON b.src = a.tgt AND b.tgt = a.src AND b.rel = a.rel WHERE a.rel <> 'RELATED_TO' AND a.src < a.tgt UNION ALL SELECT 'exclusive_state', src, 'IS_ACTIVE vs IS_DEPRECATED', '', docs FROM ex
UNION ALL SELECT 'functional_violation', src, 'SUPPLIED_BY', '', docs FROM fv UNION ALL SELECT 'positive_negative_pair', src, 'SUPPLIES', tgt, docs FROM pn)
SELECT kind, src, rel, tgt, CAST(docs AS BIGINT) AS docs FROM x WHERE NOT (kind = 'functional_violation' AND right(src, 1) = '3')""")
def contradictions(d: Data) -> DataFrame:
    """All four kinds at once, but for those that stand open already (parts that end in 3)."""
    n = lambda c: F.concat(F.lit("N"), c.cast("string"))
    a, b = F.col("c_nationkey") % 7, F.col("c_custkey") % 11
    ring = d.customer.select(n(a).alias("src"), F.when((a + b) % 3 == 0, "RELATED_TO").otherwise("SUPERSEDES").alias("rel"), n(b).alias("tgt"), F.lit(None).cast("long").alias("doc")).distinct()
    part = F.concat(F.lit("PART:"), F.col("l_partkey").cast("string"))
    states = d.lineitem.where("l_returnflag IN ('A', 'R')").select(part.alias("src"), F.when(F.col("l_returnflag") == "A", "IS_ACTIVE").otherwise("IS_DEPRECATED").alias("rel"), F.lit("").alias("tgt"), F.col("l_orderkey").alias("doc"))
    ev = written(d.evidence.select("src", "rel", "tgt", "doc", "confidence"))  # read five times
    supplied = ev.select(F.col("tgt").alias("src"), F.lit("SUPPLIED_BY").alias("rel"), F.col("src").alias("tgt"), "doc")
    said = lambda c: ev.where(c).select("src", "rel", "tgt", "doc")
    edges = ring.unionByName(states).unionByName(supplied).unionByName(said("confidence >= 0.85"))
    known = d.part.select(F.lit("functional_violation").alias("kind"), F.concat(F.lit("PART:"), F.col("p_partkey").cast("string")).alias("src"), F.lit("SUPPLIED_BY").alias("rel"), F.lit("").alias("tgt")).where(F.col("src").endswith("3"))
    return G.contradictions(edges, said("confidence <= 0.55"), [("IS_ACTIVE", "IS_DEPRECATED")], ["SUPPLIED_BY"], known, d.spread)


@query("gov03_remaining", """
WITH gone AS (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(CASE WHEN l_orderkey % 50 <> 0 THEN 1 END) = 0)
SELECT 'mention' AS kind, CAST(l_orderkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b, count(*) AS n FROM lineitem WHERE l_orderkey % 50 <> 0 GROUP BY 2, 3 UNION ALL SELECT 'entity', CAST(p_partkey AS VARCHAR), NULL, 1 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM gone)
UNION ALL SELECT 'edge', CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR), count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM gone) GROUP BY 2, 3 UNION ALL SELECT 'audit', 'entities', NULL, (SELECT count(*) FROM gone) UNION ALL SELECT 'audit', 'mentions', NULL, (SELECT count(*) FROM lineitem WHERE l_orderkey % 50 = 0)
UNION ALL SELECT 'audit', 'edges', NULL, (SELECT count(*) FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM gone))""")
def remaining(d: Data) -> DataFrame:
    """What is left when every fiftieth order is forgotten: orders mention parts, suppliers are linked to parts."""
    mentions = d.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("entity"))
    edges = d.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt"))
    left = G.forget_documents(mentions, d.part.select(F.col("p_partkey").alias("entity")), edges.withColumn("ends", F.array("tgt")), F.col("doc") % 50 == 0, d.spread)
    s = lambda c: F.col(c).cast("string")
    out = d.spread(left["mentions"], "doc", "entity").groupBy("doc", "entity").agg(F.count("*").alias("n")).select(F.lit("mention").alias("kind"), s("doc").alias("a"), s("entity").alias("b"), "n")
    out = out.unionByName(left["entities"].select(F.lit("entity").alias("kind"), s("entity").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(1).cast("long").alias("n")))
    out = out.unionByName(d.spread(left["edges"], "src", "tgt").groupBy("src", "tgt").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), s("src").alias("a"), s("tgt").alias("b"), "n"))
    return out.unionByName(left["audit"].select(F.lit("audit").alias("kind"), F.col("what").alias("a"), F.lit(None).cast("string").alias("b"), "n"))


@query("gov12_claim_graph", r"""
WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS q, role FROM conversations), ans AS (SELECT *, (conv_id % 11) / 10.0 AS faith, CASE conv_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'retrieve' ELSE 'abstain' END AS decision FROM a WHERE role = 'assistant'),
c AS (SELECT q, decision, unnest(list_filter([trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FOR s IN string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(31), 'g'), chr(31))], lambda s: s <> '')) AS s, generate_subscripts(list_filter([trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FOR s IN string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(31), 'g'), chr(31))], lambda s: s <> ''), 1) - 1 AS i FROM ans),
cl AS (SELECT q, decision, 'claim:' || q || ':' || CAST(i AS VARCHAR) AS claim FROM c), ar AS (SELECT q, 'artifact:' || q || ':document:' || CAST(conv_id AS VARCHAR) AS artifact FROM ans UNION ALL SELECT q, 'artifact:' || q || ':context:' || left(sha256(context), 16) FROM ans)
SELECT claim AS src, 'PRODUCED_BY' AS rel, 'action:' || q AS tgt FROM cl UNION ALL SELECT claim, 'SUPPORTED_BY', artifact FROM cl JOIN ar USING (q) UNION ALL SELECT claim, 'VALIDATED_BY', 'check:' || q || ':faithfulness' FROM cl UNION ALL SELECT claim, 'VALIDATED_BY', 'check:' || q || ':judge' FROM cl WHERE decision = 'accept'""")
def claim_graph(d: Data) -> DataFrame:
    """Each answer of a conversation with the turn before it as what was retrieved."""
    from pyspark.sql.window import Window

    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    a = d.conversations.withColumn("context", before).where("role = 'assistant'")
    k = F.col("conv_id") % 3
    results = a.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text", F.array(F.col("conv_id").cast("string")).alias("citations"), F.array("context").alias("contexts"), ((F.col("conv_id") % 11) / 10).alias("faithfulness"), F.when(k == 0, "accept").when(k == 1, "retrieve").otherwise("abstain").alias("decision"))
    return G.claim_graph(results)["edges"]


@query("gov10_judge_flow", r"""
WITH a AS (SELECT conv_id, turn, role, coalesce(text, '') AS answer, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS ref FROM conversations), t AS (SELECT conv_id, turn, answer, list_distinct(regexp_extract_all(lower(answer), '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*')) AS x, list_distinct(regexp_extract_all(lower(ref), '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*')) AS y, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE (turn * 37 + conv_id * 11) % 101 / 100.0 END AS found FROM a WHERE role = 'assistant'),
c AS (SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END AS conf FROM t), f AS (SELECT *, trim(answer, ' ' || chr(10) || chr(9) || chr(13)) = '' OR regexp_matches(lower(answer), REFUSAL) AS none FROM c)
SELECT conv_id, turn, CASE WHEN none THEN 'abstain' WHEN conf >= 0.3 THEN 'accept' WHEN found IS NULL THEN 'abstain' WHEN found >= 0.3 THEN 'accept' ELSE 'abstain' END AS decision, round(CASE WHEN none OR conf >= 0.3 OR found IS NULL THEN conf ELSE found END, 6) AS confidence,
CASE WHEN none THEN 'empty_or_refusal_answer' WHEN conf >= 0.3 THEN '' WHEN found IS NULL THEN 'retrieval_score_unavailable' WHEN found >= 0.3 THEN '' ELSE 'retrieval_score_below_accept_threshold' END AS reason, NOT none AND conf < 0.3 AS retrieved FROM f""".replace("REFUSAL", "'" + "|".join(G.REFUSALS).replace("'", "''") + "'"))
def judge_flow(d: Data) -> DataFrame:
    """Each answer against the turn before it; what a retrieval would score is a stand-in."""
    from pyspark.sql.window import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    a = d.conversations.withColumn("ref", before).where("role = 'assistant'")
    found = F.when(F.col("conv_id") % 4 != 0, (F.col("turn") * 37 + F.col("conv_id") * 11) % 101 / 100)
    j = G.judged(F.col("text"), F.col("ref"), found, 0.3)
    return a.select("conv_id", "turn", j.alias("j")).select("conv_id", "turn", "j.decision", F.round("j.confidence", 6).alias("confidence"), "j.reason", "j.retrieved")
