"""Filter queries (FLT) and scans (SRC)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import predicates as P
from graphloom.plans.registry import query
from graphloom.session import Data


@query("src01_tenant_scan", "SELECT id, name, type FROM entities WHERE tenant = 't1' AND type IN ('NATION', 'SUPPLIER')")
def tenant_scan(d: Data) -> DataFrame:
    return P.tenant_scope(d.entities, "t1").where(F.col("type").isin("NATION", "SUPPLIER")).select("id", "name", "type")


@query("src04_relational_mapping", "SELECT concat('SUPPLIER:', CAST(s_suppkey AS STRING)) AS src, concat('NATION:', CAST(n_nationkey AS STRING)) AS tgt, n_nationkey IS NULL AS missing FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def relational_mapping(d: Data) -> DataFrame:
    from graphloom.sources.relational import mapped_edges

    return mapped_edges(d.supplier, "s_suppkey", "SUPPLIER", "s_nationkey", d.nation, "n_nationkey", "NATION")


@query("src05_config_digest", "SELECT type, sha256(concat('{\"kind\":\"', type, '\",\"tenant\":\"', tenant, '\"}')) AS digest FROM (SELECT DISTINCT type, tenant FROM entities)")
def config_digest(d: Data) -> DataFrame:
    return d.entities.select("type", "tenant").distinct().select("type", F.sha2(F.to_json(F.struct(F.col("type").alias("kind"), "tenant")), 256).alias("digest"))


@query("src08_call_segments", "SELECT conv_id, turn, role AS speaker, length(text) AS n FROM conversations WHERE text IS NOT NULL")
def call_segments(d: Data) -> DataFrame:
    from graphloom.sources.adapters import call_segments

    calls = d.conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))).alias("transcript"))).alias("body"))
    return call_segments(calls, "conv_id", "body").select("conv_id", "turn", "speaker", F.length("text").cast("long").alias("n"))


@query("src12_verse_markers", "WITH s AS (SELECT doc_id, i, CASE WHEN (i - 1) % 4 = 0 THEN 1 ELSE 0 END AS one FROM documents, unnest(range(1, 1 + len(string_split(text, chr(10))))) t(i)) SELECT doc_id, i AS pos, CAST(sum(one) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS chapter FROM s")
def verse_markers(d: Data) -> DataFrame:
    from graphloom.sources.adapters import chapters

    lines = d.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return chapters(lines.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), ((F.col("p") % 4) == 0).alias("one")), "doc_id", "pos", "one")


@query("flt02_not_quarantined", "SELECT c_custkey FROM customer WHERE coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal < 0 END, false) = false")
def not_quarantined(d: Data) -> DataFrame:
    return d.customer.withColumn("q", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") < 0)).where(P.live("q")).select("c_custkey")


@query("flt03_bitemporal", """
WITH v AS (SELECT deal, seq, stage, changed, lead(changed) OVER (PARTITION BY deal ORDER BY changed, seq) AS t FROM changes) SELECT deal, seq FROM v WHERE changed <= DATE '1997-07-01' AND (t IS NULL OR t > DATE '1997-07-01') AND changed + 30 <= DATE '1997-07-20'""")
def bitemporal(d: Data) -> DataFrame:
    from pyspark.sql.window import Window

    t = F.lead("changed").over(Window.partitionBy("deal").orderBy("changed", "seq"))
    at = F.lit("1997-07-01").cast("date")
    return d.changes.withColumn("t", t).where(P.as_of(F.col("changed"), F.col("t"), F.date_add("changed", 30), at, F.lit("1997-07-20").cast("date"))).select("deal", "seq")


@query("flt04_anti_quarantined_mention", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size > 45)")
def anti_quarantined(d: Data) -> DataFrame:
    bad = d.lineitem.join(d.part.where("p_size > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return d.orders.select("o_orderkey").join(bad, "o_orderkey", "left_anti")


@query("flt05_list_membership", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING list_contains(list(o_orderpriority), '1-URGENT')")
def list_membership(d: Data) -> DataFrame:
    per = d.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("kinds"))
    return per.where(F.array_contains("kinds", "1-URGENT")).select("o_custkey")


@query("flt06_contains", "SELECT id FROM entities WHERE contains(lower(name), lower('Er#0')) OR contains(lower(name), 'an')")
def contains(d: Data) -> DataFrame:
    n = F.lower("name")
    return d.entities.where(n.contains("er#0") | n.contains("an")).select("id")


@query("flt07_servable", """
WITH a AS (SELECT o_orderkey, o_orderstatus = 'P' AS archived, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS shareable, CAST(o_orderdate AS DATE) AS f, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 400 END AS t FROM orders)
SELECT o_orderkey FROM a WHERE NOT archived AND coalesce(shareable, true) AND f <= DATE '1998-01-01' AND (t IS NULL OR DATE '1998-01-01' < t)""")
def servable(d: Data) -> DataFrame:
    day, k, at = F.col("o_orderdate").cast("date"), F.col("o_orderkey"), F.lit("1998-01-01").cast("date")
    ends = F.when(k % 5 != 0, F.date_add(day, 400))
    return d.orders.where((F.col("o_orderstatus") != "P") & F.coalesce(F.when(k % 3 != 0, k % 2 == 0), F.lit(True)) & (day <= at) & (ends.isNull() | (ends > at))).select("o_orderkey")


@query("flt08_policy", """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'escalate' WHEN o_orderstatus = 'P' OR contains(o_orderpriority, 'LOW') THEN 'hold' ELSE 'allow' END AS decision FROM orders""")
def policy(d: Data) -> DataFrame:
    rules = [
        {"id": "b", "priority": 2, "mode": "ANY", "tests": [("o_orderstatus", "EQ", "P"), ("o_orderpriority", "CONTAINS", "LOW")], "result": "hold"},
        {"id": "a", "priority": 1, "mode": "ALL", "tests": [("o_totalprice", "GT", 300000), ("o_orderpriority", "IN", ["1-URGENT", "2-HIGH"])], "result": "escalate"},
    ]
    return d.orders.select("o_orderkey", P.policy(rules, "allow").alias("decision"))


@query("flt09_filter_or_all", "WITH f AS (SELECT * FROM supplier WHERE s_acctbal > 1e9) SELECT s_suppkey FROM f UNION ALL SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM f)")
def filter_or_all(d: Data) -> DataFrame:
    limit = F.expr("try_cast(regexp_replace('$1000000000', '[^0-9.]', '') AS DOUBLE)")
    return P.filtered_or_all(d.supplier, F.col("s_acctbal") > limit).select("s_suppkey")


@query("flt11_access", "SELECT c_custkey, (c_mktsegment = 'BUILDING' OR c_acctbal < 5000) AND c_nationkey <> 3 AS allowed FROM customer")
def access(d: Data) -> DataFrame:
    return d.customer.select("c_custkey", (((F.col("c_mktsegment") == "BUILDING") | (F.col("c_acctbal") < 5000)) & (F.col("c_nationkey") != 3)).alias("allowed"))


@query("flt12_eligibility", """
SELECT p_partkey, concat_ws(',', CASE WHEN NOT p_size < 40 THEN 'size' END, CASE WHEN NOT p_retailprice < 1500 THEN 'price' END, CASE WHEN NOT p_brand <> 'Brand#1' THEN 'brand' END) AS rejected FROM part""")
def eligibility(d: Data) -> DataFrame:
    r = P.reasons([("size", F.col("p_size") < 40), ("price", F.col("p_retailprice") < 1500), ("brand", F.col("p_brand") != "Brand#1")])
    return d.part.select("p_partkey", F.array_join(r, ",").alias("rejected"))


@query("flt13_low_confidence", "SELECT count(*) AS n, round(min(confidence), 4) AS least FROM evidence WHERE confidence < 0.6")
def low_confidence(d: Data) -> DataFrame:
    return d.evidence.where("confidence < 0.6").agg(F.count("*").alias("n"), F.round(F.min("confidence"), 4).alias("least"))


@query("flt14_self_loops", "SELECT count(*) AS n FROM lineitem WHERE l_suppkey = l_partkey")
def self_loops(d: Data) -> DataFrame:
    return d.lineitem.where("l_suppkey = l_partkey").agg(F.count("*").alias("n"))


@query("flt15_stale", "SELECT o_custkey, coalesce(date_diff('day', max(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END), DATE '2001-08-01') > 900, true) AS stale FROM orders GROUP BY o_custkey")
def stale(d: Data) -> DataFrame:
    last = F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date")))
    return d.orders.groupBy("o_custkey").agg(F.coalesce(F.datediff(F.lit("2001-08-01").cast("date"), last) > 900, F.lit(True)).alias("stale"))


@query("flt16_template_query", "SELECT tgt AS answer, count(*) AS n FROM relations WHERE rel = 'LOCATED_IN' GROUP BY tgt ORDER BY n DESC, tgt LIMIT 5")
def template_query(d: Data) -> DataFrame:
    from graphloom.operators.intents import answer

    return answer("which 5 places have the most located entities", d.relations)
