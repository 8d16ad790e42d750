"""Join, top-k and set queries (JON, TOP, SET)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import governance as G
from graphloom.operators import joins as J
from graphloom.plans.registry import query
from graphloom.session import Data


@query("jon01_inner_expand", "SELECT n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def inner_expand(d: Data) -> DataFrame:
    return d.supplier.join(d.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("jon02_left_outer", "SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def left_outer(d: Data) -> DataFrame:
    return d.customer.join(d.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).cast("long").alias("o_orderkey"))


@query("jon03_left_count", "SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_returnflag = 'R' GROUP BY p_partkey")
def left_count(d: Data) -> DataFrame:
    n = d.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("k"))
    return d.part.select("p_partkey").join(n, "p_partkey", "left").select("p_partkey", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


@query("jon04_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi(d: Data) -> DataFrame:
    return d.customer.join(d.orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jon05_exclusive_entities", "SELECT tgt, min(doc) AS doc FROM evidence GROUP BY tgt HAVING count(DISTINCT doc) <= 20")
def exclusive_entities(d: Data) -> DataFrame:
    return d.spread(d.evidence, "tgt", "doc").groupBy("tgt").agg(F.min("doc").alias("doc"), F.count_distinct("doc").alias("k")).where("k <= 20").select("tgt", "doc")


@query("jon06_nested_anti", """
SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = s_suppkey AND o_orderpriority = '1-URGENT' AND l_discount = 0.1 AND l_tax = 0.08)""")
def nested_anti(d: Data) -> DataFrame:
    two = d.lineitem.where("l_discount = 0.1 AND l_tax = 0.08").join(d.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return d.supplier.join(two, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey")


@query("jon07_anti_inequality", """
WITH p AS (SELECT user_id, day, min(event_id) AS done FROM kpi WHERE event_type = 'purchase' GROUP BY user_id, day)
SELECT user_id, CAST(day AS VARCHAR) AS day, done FROM p WHERE NOT EXISTS (SELECT 1 FROM kpi e WHERE e.event_type = 'error' AND e.user_id = p.user_id AND e.day = p.day AND e.event_id < p.done)""")
def anti_inequality(d: Data) -> DataFrame:
    p = d.kpi.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.min("event_id").alias("done")).alias("p")
    e = d.kpi.where("event_type = 'error'").alias("e")
    on = (F.col("e.user_id") == F.col("p.user_id")) & (F.col("e.day") == F.col("p.day")) & (F.col("e.event_id") < F.col("p.done"))
    return p.join(e, on, "left_anti").select("user_id", F.col("day").cast("string").alias("day"), "done")


@query("jon08_reverse_edges", "WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT x.a, x.b FROM e x JOIN e y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def reverse_edges(d: Data) -> DataFrame:
    e = d.lineitem.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return e.where("a < b").join(e.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])


@query("jon09_self_theta", """
SELECT x.l_partkey, x.l_orderkey AS doc_a, y.l_orderkey AS doc_b FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R') x JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'A') y ON x.l_partkey = y.l_partkey AND x.l_orderkey <> y.l_orderkey""")
def self_theta(d: Data) -> DataFrame:
    e = d.lineitem.select("l_partkey", "l_orderkey", F.col("l_returnflag").alias("rel")).distinct()
    return G.exclusive_violations(e, "R", "A", ["l_partkey"], "l_orderkey")


@query("jon10_conflict_pairs", """
SELECT a.subject, a.predicate, a.claim_id AS id_a, b.claim_id AS id_b FROM claims a JOIN claims b ON a.subject = b.subject AND a.predicate = b.predicate AND a.claim_id < b.claim_id WHERE a.object <> b.object""")
def conflict_pairs(d: Data) -> DataFrame:
    c = d.claims.select("subject", "predicate", "claim_id", "object")
    a, b = c.withColumnsRenamed({"claim_id": "id_a", "object": "oa"}), c.withColumnsRenamed({"claim_id": "id_b", "object": "ob"})
    return a.join(b, ["subject", "predicate"]).where("id_a < id_b AND oa <> ob").select("subject", "predicate", "id_a", "id_b")


@query("jon11_positive_negative", """
WITH p AS (SELECT DISTINCT src, tgt FROM evidence WHERE confidence >= 0.85), n AS (SELECT DISTINCT src, tgt FROM evidence WHERE confidence <= 0.55) SELECT p.src, p.tgt FROM p JOIN n ON p.src = n.src AND p.tgt = n.tgt""")
def positive_negative(d: Data) -> DataFrame:
    e = d.evidence
    return e.where("confidence >= 0.85").select("src", "tgt").distinct().join(e.where("confidence <= 0.55").select("src", "tgt").distinct(), ["src", "tgt"])


@query("jon12_as_of", """
WITH s AS (SELECT DISTINCT c_custkey AS deal, DATE '1998-06-30' AS shared FROM customer), h AS (SELECT deal, shared, (SELECT max_by(stage, (changed, seq)) FROM changes x WHERE x.deal = s.deal AND changed <= shared) AS past, (SELECT min_by(stage, (changed, seq)) FROM changes x WHERE x.deal = s.deal AND changed > shared) AS later FROM s)
SELECT deal, coalesce(past, later) AS stage FROM h""")
def as_of(d: Data) -> DataFrame:
    shared = d.customer.select(F.col("c_custkey").alias("deal"), F.lit("1998-06-30").cast("date").alias("shared"))
    past = J.asof(shared, d.changes, ["deal"], "shared", "changed", "stage", "seq")
    later = d.changes.where("changed > DATE '1998-06-30'").groupBy("deal").agg(F.min_by("stage", F.struct("changed", "seq")).alias("later"))
    return past.join(later, "deal", "left").select("deal", F.coalesce("stage", "later").alias("stage"))


@query("jon13_as_of_latest", "SELECT deal, max_by(stage, (changed, seq)) AS stage, CAST(max(changed) AS VARCHAR) AS changed FROM changes WHERE changed <= DATE '1999-01-01' GROUP BY deal")
def as_of_latest(d: Data) -> DataFrame:
    return J.latest_by(d.changes.where("changed <= DATE '1999-01-01'"), ["deal"], ["changed", "seq"]).select("deal", "stage", F.col("changed").cast("string").alias("changed"))


@query("jon14_interval", """
WITH v AS (SELECT deal, stage, changed AS f, lead(changed) OVER (PARTITION BY deal ORDER BY changed, seq) AS t FROM changes) SELECT deal, stage, CAST(f AS VARCHAR) AS since FROM v WHERE f <= DATE '1997-05-05' AND (t IS NULL OR t > DATE '1997-05-05')""")
def interval(d: Data) -> DataFrame:
    v = d.changes.withColumn("t", F.lead("changed").over(Window.partitionBy("deal").orderBy("changed", "seq")))
    return v.where(J.visible("changed", "t", F.lit("1997-05-05").cast("date"))).select("deal", "stage", F.col("changed").cast("string").alias("since"))


@query("jon15_multi_key", "WITH k AS (SELECT n_name AS name, 'NATION' AS type FROM nation WHERE n_nationkey < 5 UNION ALL SELECT r_name, 'REGION' FROM region) SELECT e.id FROM entities e JOIN k ON e.name = k.name AND e.type = k.type")
def multi_key(d: Data) -> DataFrame:
    k = d.nation.where("n_nationkey < 5").select(F.col("n_name").alias("name"), F.lit("NATION").alias("type")).unionAll(d.region.select("r_name", F.lit("REGION")))
    return d.entities.join(F.broadcast(k), ["name", "type"]).select("id")


@query("jon16_route", """
SELECT c_mktsegment, p_brand, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'O' AND l_returnflag = 'N' GROUP BY c_mktsegment, p_brand""")
def route(d: Data) -> DataFrame:
    o = d.orders.where("o_orderstatus = 'O'").join(d.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    l = d.lineitem.where("l_returnflag = 'N'").join(d.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_mktsegment", "p_brand").agg(F.count("*").alias("n"))


@query("jon17_batched_fetch", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_custkey")
def batched_fetch(d: Data) -> DataFrame:
    return d.orders.join(d.customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("jon18_exists_after", "WITH s AS (SELECT DISTINCT user_id, day FROM kpi WHERE event_type = 'click'), v AS (SELECT DISTINCT user_id, day FROM kpi WHERE event_type = 'purchase') SELECT s.user_id, CAST(s.day AS VARCHAR) AS day, CAST(min(v.day) AS VARCHAR) AS opened FROM s LEFT JOIN v ON s.user_id = v.user_id AND v.day >= s.day GROUP BY s.user_id, s.day")
def exists_after(d: Data) -> DataFrame:
    s, v = d.kpi.where("event_type = 'click'").select("user_id", "day").distinct(), d.kpi.where("event_type = 'purchase'").select("user_id", F.col("day").alias("seen"))
    return J.exists_after(s, v, ["user_id"], "day", "seen", "opened").select("user_id", F.col("day").cast("string").alias("day"), F.col("opened").cast("string").alias("opened"))


@query("jon20_set_similarity", """
WITH a AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS m FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS b, l_partkey AS m FROM lineitem WHERE l_returnflag = 'A'),
na AS (SELECT a, count(*) AS na FROM a GROUP BY a), nb AS (SELECT b, count(*) AS nb FROM b GROUP BY b), c AS (SELECT a, b, count(*) AS k FROM a JOIN b USING (m) GROUP BY a, b)
SELECT c.a, round(max(k / CAST(na + nb - k AS DOUBLE)), 6) AS similarity FROM c JOIN na ON na.a = c.a JOIN nb ON nb.b = c.b GROUP BY c.a""")
def set_similarity(d: Data) -> DataFrame:
    of = lambda f: d.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("m"))
    return J.set_similarity(of("R"), of("A"), "s", "m").select("a", F.round("similarity", 6).alias("similarity"))


@query("jon21_disjoint_branches", """
SELECT o_orderpriority, count(*) AS orders, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(same) AS BIGINT) AS same FROM (SELECT o.o_orderkey, o_orderpriority, (SELECT count(*) FROM lineitem WHERE l_orderkey = o.o_orderkey) AS lines, (SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'F') AS same FROM orders o) GROUP BY o_orderpriority""")
def disjoint_branches(d: Data) -> DataFrame:
    lines = d.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    same = d.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("same"))
    j = d.orders.join(lines, "o_orderkey", "left").join(same, "o_custkey", "left").fillna(0, ["lines", "same"])
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.sum("same").alias("same"))


# Top-k ------------------------------------------------------------------------------------------------------------


@query("top01_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_global(d: Data) -> DataFrame:
    return d.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("top02_filter_then_top", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def filter_then_top(d: Data) -> DataFrame:
    return d.orders.where("o_orderstatus = 'F' AND o_custkey % 3 = 1").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("top03_per_seed_cap", "WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber FROM r WHERE r <= 10 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 500")
def per_seed_cap(d: Data) -> DataFrame:
    best = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    r = d.lineitem.withColumn("r", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*best))).where("r <= 10")
    return r.orderBy(*best).limit(500).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("top04_pages", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def pages(d: Data) -> DataFrame:
    return d.customer.select("c_custkey", "c_name").orderBy("c_custkey").offset(50).limit(25)


@query("top06_token_budget", """
WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 20000""")
def token_budget(d: Data) -> DataFrame:
    from graphloom.operators.windows import within_budget

    return within_budget(d.documents.select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 20000).select("source", "doc_id", "used")


@query("top07_skipping_budget", """
WITH RECURSIVE r AS (SELECT DISTINCT source, CAST(-1 AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS n_chars, 0 AS n FROM documents UNION ALL SELECT r.source, min(d.doc_id), r.used + arg_min(d.n_chars, d.doc_id), arg_min(d.n_chars, d.doc_id), r.n + 1 FROM r JOIN documents d ON d.source = r.source AND d.doc_id > r.doc_id AND r.used + d.n_chars <= 20000 WHERE r.n < 12 GROUP BY r.source, r.used, r.n)
SELECT source, doc_id, n_chars FROM r WHERE n > 0""")
def skipping_budget(d: Data) -> DataFrame:
    from graphloom.operators.selection import skipping_budget

    return skipping_budget(d.documents, "source", ["doc_id"], "n_chars", 20000, 12).select("source", "doc_id", "n_chars")


@query("top08_char_budget", """
WITH r AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) SELECT conv_id, turn, CAST(least(n, 500 - (used - n)) AS BIGINT) AS taken FROM r WHERE used - n < 500""")
def char_budget(d: Data) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    r = d.conversations.withColumn("n", n).withColumn("used", F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn")))
    return r.where("used - n < 500").select("conv_id", "turn", F.least(F.col("n"), 500 - (F.col("used") - F.col("n"))).cast("long").alias("taken"))


@query("top09_priority_classes", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 10")
def priority_classes(d: Data) -> DataFrame:
    k = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return d.orders.orderBy(k, F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_orderstatus")


# Sets -------------------------------------------------------------------------------------------------------------


@query("set01_union_all", "SELECT claim_id, 'current' AS kind FROM claims WHERE object = 'O' UNION ALL SELECT claim_id, 'revision' FROM claims WHERE amount > 300000")
def union_all(d: Data) -> DataFrame:
    c = d.claims
    return c.where("object = 'O'").select("claim_id", F.lit("current").alias("kind")).unionByName(c.where("amount > 300000").select("claim_id", F.lit("revision").alias("kind")))


@query("set02_union_neighbours", "SELECT src AS node FROM relations WHERE tgt = 'NATION:3' UNION SELECT tgt FROM relations WHERE src = 'NATION:3'")
def union_neighbours(d: Data) -> DataFrame:
    r = d.relations
    return r.where("tgt = 'NATION:3'").select(F.col("src").alias("node")).union(r.where("src = 'NATION:3'").select("tgt")).distinct()


@query("set04_difference", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def difference(d: Data) -> DataFrame:
    l = d.lineitem
    return l.where("l_returnflag = 'R'").select("l_partkey").subtract(l.where("l_quantity > 49").select("l_partkey"))


@query("set05_key_diff", """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01') SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'kept' END AS change, count(*) AS n FROM a FULL OUTER JOIN b ON a.k = b.k GROUP BY 1""")
def key_diff(d: Data) -> DataFrame:
    early = F.col("l_shipdate") < "1997-01-01"
    per = d.lineitem.groupBy("l_partkey").agg(F.bool_or(early).alias("a"), F.bool_or(~early).alias("b"))
    change = F.when(~F.col("a"), "added").when(~F.col("b"), "removed").otherwise("kept")
    return per.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query("set06_precision_recall", """
WITH g AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_quantity > 30), k AS (SELECT coalesce(g.s, r.s) AS s, count(g.p) AS gold, count(r.p) AS got, count(CASE WHEN g.p IS NOT NULL AND r.p IS NOT NULL THEN 1 END) AS hit FROM g FULL OUTER JOIN r ON g.s = r.s AND g.p = r.p GROUP BY 1)
SELECT s, round(hit / CAST(got AS DOUBLE), 6) AS prec, round(hit / CAST(gold AS DOUBLE), 6) AS recall FROM k""")
def precision_recall(d: Data) -> DataFrame:
    per = d.lineitem.groupBy(F.col("l_suppkey").alias("s"), "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("g"), F.bool_or(F.col("l_quantity") > 30).alias("r"))
    hit = F.count_if(F.col("g") & F.col("r"))
    return per.groupBy("s").agg(F.round(hit / F.count_if("r"), 6).alias("prec"), F.round(hit / F.count_if("g"), 6).alias("recall"))
