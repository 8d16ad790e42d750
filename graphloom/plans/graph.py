"""Graph queries (GRF)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import owl
from graphloom.operators import retrieval as R
from graphloom.operators import translation as X
from graphloom.plans.registry import query
from graphloom.session import Data, written

#: A digraph of all parts: two arcs by arithmetic on the key, and one to the part whose key is the size, so that there are hubs.
RING = """ring AS (SELECT DISTINCT src, tgt FROM (SELECT p_partkey AS src, 1 + (p_partkey * 7 + p_size) % n AS tgt FROM part, (SELECT count(*) AS n FROM part) UNION ALL SELECT p_partkey, 1 + (p_partkey * 3 + p_size * 5) % n FROM part, (SELECT count(*) AS n FROM part) UNION ALL SELECT p_partkey, CAST(p_size AS BIGINT) FROM part))"""


def ring(d: Data) -> DataFrame:
    k, size, n = F.col("p_partkey"), F.col("p_size").cast("long"), F.col("n")
    p = d.part.select("p_partkey", "p_size").crossJoin(F.broadcast(d.part.agg(F.count("*").alias("n"))))
    return p.select(k.alias("src"), F.explode(F.array(1 + (k * 7 + size) % n, 1 + (k * 3 + size * 5) % n, size)).alias("tgt")).distinct()


@query("grf01_neighbours", "SELECT u AS node, count(*) AS n, min(v) AS first FROM (SELECT src AS u, tgt AS v FROM relations UNION SELECT tgt, src FROM relations) GROUP BY u")
def neighbours(d: Data) -> DataFrame:
    return G.neighbours(d.relations)


@query("grf02_paths", """
WITH e AS (SELECT src AS u, tgt AS v, concat(src, '|', tgt) AS e, confidence FROM relations UNION ALL SELECT tgt, src, concat(src, '|', tgt), confidence FROM relations),
p1 AS (SELECT u AS seed, v AS node, 1 AS hops, confidence, [e] AS used FROM e WHERE u IN ('REGION:1', 'NATION:7')), p2 AS (SELECT p.seed, x.v AS node, 2 AS hops, p.confidence * x.confidence AS confidence, list_append(p.used, x.e) AS used FROM p1 p JOIN e x ON p.node = x.u WHERE NOT list_contains(p.used, x.e)),
p3 AS (SELECT p.seed, x.v AS node, 3 AS hops, p.confidence * x.confidence AS confidence, list_append(p.used, x.e) AS used FROM p2 p JOIN e x ON p.node = x.u WHERE NOT list_contains(p.used, x.e)), a AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
SELECT seed, node, hops, round(confidence, 6) AS confidence, round(confidence / hops, 6) AS score FROM a""")
def paths(d: Data) -> DataFrame:
    seeds = d.entities.where(F.col("id").isin("REGION:1", "NATION:7")).select(F.col("id").alias("node"))
    return G.paths(d.relations, seeds, 3).select("seed", "node", "hops", F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("score"))


@query("grf02_hop_chunks", """
WITH sd AS (SELECT max_by(o_orderkey, (o_totalprice, o_orderkey)) AS seed FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment), men AS (SELECT DISTINCT l_orderkey AS chunk, 'S' || CAST(l_suppkey AS VARCHAR) AS node FROM lineitem UNION SELECT DISTINCT l_orderkey, 'P' || CAST(l_partkey AS VARCHAR) FROM lineitem),
bad AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS node FROM part WHERE p_size = 13), g AS (SELECT l_suppkey, l_partkey, max(l_discount) + 0.5 AS confidence, min(CAST(l_shipdate AS DATE)) AS valid_from, max(CAST(l_shipdate AS DATE)) AS valid_to, min(CAST(o_orderdate AS DATE)) AS recorded_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
e AS (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS s, 'P' || CAST(l_partkey AS VARCHAR) AS t, confidence FROM g WHERE l_suppkey % 3 <> 0 AND valid_from <= DATE '1998-06-01' AND (l_partkey % 2 = 0 OR valid_to > DATE '1998-06-01') AND recorded_at <= DATE '1999-06-01'), f AS (SELECT * FROM e WHERE t NOT IN (SELECT node FROM bad)),
p AS (SELECT DISTINCT seed, via, confidence FROM sd JOIN men ON men.chunk = seed JOIN (SELECT s AS node, t AS via, confidence FROM f UNION ALL SELECT t, s, confidence FROM f) w ON w.node = men.node), q AS (SELECT [CAST(x AS DOUBLE) FOR x IN embedding] AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
h AS (SELECT seed, m.chunk, via, confidence, round(CASE WHEN v IS NULL THEN confidence ELSE 0.7 * confidence + 0.3 * (1 + list_inner_product(v, q) / sqrt(list_inner_product(v, v) * list_inner_product(q, q))) / 2 END, 9) AS score FROM p JOIN men m ON m.node = via JOIN orders o ON o.o_orderkey = m.chunk AND o_orderstatus = 'F' LEFT JOIN v ON vec_id = m.chunk, q WHERE m.chunk NOT IN (SELECT seed FROM sd)),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, chunk, via, confidence DESC) AS r FROM h) SELECT seed, chunk, via, 1 AS hops, round(confidence, 6) AS confidence, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, chunk, via, confidence DESC, seed) AS place FROM r WHERE r <= 200 ORDER BY place LIMIT 500""")
def hop_chunks(d: Data) -> DataFrame:
    """Orders are chunks that mention their suppliers and parts; the seeds are the largest order of each market segment."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    j = d.lineitem.join(d.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    seeds = d.orders.join(d.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("chunk"))
    mentions = d.lineitem.select(F.col("l_orderkey").alias("chunk"), node("S", "l_suppkey").alias("node")).union(d.lineitem.select("l_orderkey", node("P", "l_partkey")))
    day = lambda c: F.col(c).cast("date")
    g = j.groupBy("l_suppkey", "l_partkey").agg((F.max("l_discount") + 0.5).alias("confidence"), F.min(day("l_shipdate")).alias("valid_from"), F.max(day("l_shipdate")).alias("last"), F.min(day("o_orderdate")).alias("recorded_at"))
    edges = g.select(node("S", "l_suppkey").alias("src"), F.lit("SUPPLIES").alias("rel"), node("P", "l_partkey").alias("tgt"), "confidence", "valid_from", F.when(F.col("l_partkey") % 2 != 0, F.col("last")).alias("valid_to"), "recorded_at", F.when(F.col("l_suppkey") % 3 != 0, "own").otherwise("other").alias("tenant"))
    vectors = d.embeddings.select(F.col("vec_id").alias("chunk"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    chunks = d.orders.select(F.col("o_orderkey").alias("chunk"), F.when(F.col("o_orderstatus") == "F", "own").otherwise("other").alias("tenant")).join(vectors, "chunk", "left")
    asked = d.embeddings.where("vec_id = 0").select("embedding").head()  # the question
    question = F.array(*[F.lit(float(x)) for x in asked.embedding]) if asked else None
    bad = d.part.where("p_size = 13").select(node("P", "p_partkey").alias("node"))
    date = lambda s: F.lit(s).cast("date")
    out = G.hop_chunks(seeds, mentions, edges, bad, chunks, "own", 1, date("1998-06-01"), date("1999-06-01"), question, 0.3)
    return out.withColumn("confidence", F.round("confidence", 6)).withColumn("score", F.round("score", 6)).withColumn("hops", F.col("hops").cast("int"))


@query("grf03_induced", "SELECT src, rel, tgt FROM relations WHERE src IN (SELECT id FROM entities WHERE tenant = 't0') AND tgt IN (SELECT id FROM entities WHERE tenant = 't0')")
def induced(d: Data) -> DataFrame:
    own = d.entities.where("tenant = 't0'").select("id")
    e = d.relations.join(own, F.col("src") == F.col("id"), "left_semi")
    return e.join(own, F.col("tgt") == F.col("id"), "left_semi").select("src", "rel", "tgt")


@query("grf04_propagation", """
WITH e AS (SELECT u, v, max(c) AS c FROM (SELECT src AS u, tgt AS v, confidence AS c FROM relations UNION ALL SELECT tgt, src, confidence FROM relations) GROUP BY u, v), k0 AS (SELECT 'NATION:3' AS node, 1.0::DOUBLE AS c),
k1 AS (SELECT node, max(c) AS c FROM (SELECT * FROM k0 UNION ALL SELECT v, k.c * e.c FROM k0 k JOIN e ON k.node = e.u WHERE k.c * e.c >= 0.05) GROUP BY node), k2 AS (SELECT node, max(c) AS c FROM (SELECT * FROM k1 UNION ALL SELECT v, k.c * e.c FROM k1 k JOIN e ON k.node = e.u WHERE k.c * e.c >= 0.05) GROUP BY node),
k3 AS (SELECT node, max(c) AS c FROM (SELECT * FROM k2 UNION ALL SELECT v, k.c * e.c FROM k2 k JOIN e ON k.node = e.u WHERE k.c * e.c >= 0.05) GROUP BY node) SELECT node, round(c, 6) AS confidence FROM k3""")
def propagation(d: Data) -> DataFrame:
    seeds = d.spark.createDataFrame([("NATION:3",)], "node string")
    return G.propagate(d.relations, seeds).select("node", F.round("confidence", 6).alias("confidence"))


@query("grf05_pagerank", f"""
WITH RECURSIVE {RING}, n AS (SELECT src AS node FROM ring UNION SELECT tgt FROM ring), w AS (SELECT src, tgt, 1.0 / count(*) OVER (PARTITION BY src) AS share FROM ring UNION ALL SELECT node, node, 0.0 FROM n),
r AS (SELECT 0 AS i, node, 0.15::DOUBLE AS score FROM n UNION ALL SELECT r.i + 1, w.tgt, 0.15 + 0.85 * sum(r.score * w.share) FROM r JOIN w ON w.src = r.node WHERE r.i < 20 GROUP BY r.i, w.tgt)
SELECT node, round(score, 6) AS score FROM r WHERE i = 20""")
def pagerank(d: Data) -> DataFrame:
    return G.pagerank(ring(d).withColumn("weight", F.lit(1.0))).select("node", F.round("score", 6).alias("score"))


@query("grf06_components", """
WITH RECURSIVE s AS (SELECT src AS u, tgt AS v FROM relations UNION SELECT tgt, src FROM relations), r(node, c) AS (SELECT u, u FROM s UNION SELECT s.v, r.c FROM r JOIN s ON s.u = r.node)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def components(d: Data) -> DataFrame:
    return G.connected_components(d.relations)


@query("grf08_cycles", f"""
WITH {RING}, e AS (SELECT * FROM ring WHERE src <> tgt), w2 AS (SELECT DISTINCT a.src, b.tgt FROM e a JOIN e b ON a.tgt = b.src), w3 AS (SELECT DISTINCT a.src, b.tgt FROM w2 a JOIN e b ON a.tgt = b.src WHERE a.src <> a.tgt), w4 AS (SELECT DISTINCT a.src, b.tgt FROM w3 a JOIN e b ON a.tgt = b.src WHERE a.src <> a.tgt), f AS (SELECT src AS node, 2 AS length FROM w2 WHERE src = tgt UNION ALL SELECT src, 3 FROM w3 WHERE src = tgt UNION ALL SELECT src, 4 FROM w4 WHERE src = tgt)
SELECT node, min(length) AS length FROM f GROUP BY node""")
def cycles(d: Data) -> DataFrame:
    return G.cycles(ring(d), 4)


@query("grf09_descendants", """
WITH RECURSIVE r(root, node, depth) AS (SELECT tgt, src, 1 FROM relations UNION SELECT r.root, e.src, r.depth + 1 FROM r JOIN relations e ON e.tgt = r.node WHERE r.depth < 10) SELECT root, count(DISTINCT node) AS n, max(depth) AS depth FROM r GROUP BY root""")
def descendants(d: Data) -> DataFrame:
    return G.descendants(d.relations, 10).groupBy("root").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


@query("grf10_supersession", "SELECT deal, count(*) - 1 AS depth, max_by(seq, (changed, seq)) AS terminal FROM changes GROUP BY deal")
def supersession(d: Data) -> DataFrame:
    return d.changes.groupBy("deal").agg((F.count("*") - 1).alias("depth"), F.max_by("seq", F.struct("changed", "seq")).alias("terminal"))


@query("grf11_isolated", """
WITH b AS (SELECT src AS node FROM relations WHERE tgt IN ('NATION:1', 'NATION:2')), i AS (SELECT node FROM b UNION SELECT unnest(['NATION:1', 'NATION:2'])) SELECT DISTINCT node FROM b WHERE node NOT IN (SELECT src FROM relations WHERE tgt NOT IN (SELECT node FROM i))""")
def isolated(d: Data) -> DataFrame:
    return G.isolated_below(d.relations, d.spark.createDataFrame([("NATION:1",), ("NATION:2",)], "node string"), 2)


ADJ = f"""{RING}, e AS (SELECT src, tgt, 1.0 + src % 3 AS w FROM ring WHERE src <> tgt AND (0.5 + (src % 5) / 10.0) * exp(-ln(2) / 180 * (tgt % 400)) >= 0.3), s AS (SELECT u, v, max(w) AS w FROM (SELECT src AS u, tgt AS v, w FROM e UNION ALL SELECT tgt, src, w FROM e) GROUP BY u, v), g AS (SELECT u, 1 / ln(1 + count(*)) AS p FROM s GROUP BY u), adj AS (SELECT s.u, s.v, s.w * least(a.p, b.p) AS weight FROM s JOIN g a ON a.u = s.u JOIN g b ON b.u = s.v)"""


def adjacency_of(d: Data) -> DataFrame:
    e = ring(d).where("src <> tgt").withColumn("confidence", 0.5 + (F.col("src") % 5) / 10.0).withColumn("weight", 1.0 + F.col("src") % 3)
    return G.adjacency(e, F.col("tgt") % 400, 180, 0.3)


@query("grf14_adjacency", f"WITH {ADJ} SELECT u, v, round(weight, 6) AS weight FROM adj")
def adjacency(d: Data) -> DataFrame:
    return adjacency_of(d).select("u", "v", F.round("weight", 6).alias("weight"))


@query("grf12_gcn_layer", f"""
WITH {ADJ}, n AS (SELECT DISTINCT u AS node FROM adj), x AS (SELECT node, (node % 97) / 97.0 - 0.3 AS value FROM n), a AS (SELECT u, v, weight FROM adj UNION ALL SELECT node, node, 1.0 FROM n), d AS (SELECT u, sum(weight) AS d FROM a GROUP BY u)
SELECT a.u AS node, 0 AS dim, round(greatest(0.0, sum(a.weight / sqrt(d.d * e.d) * x.value)), 6) AS value FROM a JOIN d ON d.u = a.u JOIN d e ON e.u = a.v JOIN x ON x.node = a.v GROUP BY a.u""")
def gcn_layer(d: Data) -> DataFrame:
    adj = adjacency_of(d)
    x = adj.select(F.col("u").alias("node")).distinct().select("node", F.lit(0).alias("dim"), ((F.col("node") % 97) / 97.0 - 0.3).alias("value"))
    return G.gcn_layer(adj, x).withColumn("value", F.round("value", 6))


@query("grf13_attention_layer", f"""
WITH {ADJ}, n AS (SELECT DISTINCT u AS node FROM adj), x AS (SELECT node, (node % 97) / 97.0 - 0.3 AS value FROM n), p AS (SELECT u, v FROM adj UNION SELECT node, node FROM n)
SELECT p.u AS node, round(sum(exp(a.value * b.value) * b.value) / sum(exp(a.value * b.value)), 6) AS value FROM p JOIN x a ON a.node = p.u JOIN x b ON b.node = p.v GROUP BY p.u""")
def attention_layer(d: Data) -> DataFrame:
    adj = adjacency_of(d)
    x = adj.select(F.col("u").alias("node")).distinct().select("node", ((F.col("node") % 97) / 97.0 - 0.3).alias("value"))
    return G.attention_layer(adj, x).withColumn("value", F.round("value", 6))


@query("grf16_authority", """
SELECT o_orderkey, round((1 - l.least) * CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0 WHEN '2' THEN 0.95 WHEN '3' THEN 0.85 ELSE 0.70 END * CASE WHEN o_orderstatus = 'P' THEN 0.5 ELSE 1.0 END, 6) AS weight FROM orders JOIN (SELECT l_orderkey, min(l_discount) AS least FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
def authority(d: Data) -> DataFrame:
    rank = F.substring("o_orderpriority", 1, 1)
    by = F.when(rank == "1", 1.0).when(rank == "2", 0.95).when(rank == "3", 0.85).otherwise(0.70) * F.when(F.col("o_orderstatus") == "P", 0.5).otherwise(1.0)
    l = d.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_discount").alias("least"))
    return d.orders.join(l, "o_orderkey").select("o_orderkey", F.round((1 - F.col("least")) * by, 6).alias("weight"))


@query("grf17_transitivity", f"""
WITH {RING}, b AS (SELECT src, tgt, max(0.5 + src % 5 / 10.0) AS c FROM ring GROUP BY src, tgt), t2 AS (SELECT a.src, b.tgt, max(a.c * b.c * 0.9) AS c FROM b a JOIN b ON a.tgt = b.src WHERE a.src <> b.tgt GROUP BY a.src, b.tgt), t3 AS (SELECT a.src, b.tgt, max(a.c * b.c * 0.9) AS c FROM t2 a JOIN b ON a.tgt = b.src WHERE a.src <> b.tgt GROUP BY a.src, b.tgt)
SELECT src, 'NEXT' AS rel, tgt, round(max(c), 6) AS confidence FROM (SELECT * FROM t2 UNION ALL SELECT * FROM t3) x WHERE NOT EXISTS (SELECT 1 FROM ring r WHERE r.src = x.src AND r.tgt = x.tgt) GROUP BY src, tgt""")
def transitivity(d: Data) -> DataFrame:
    e = ring(d).select("src", F.lit("NEXT").alias("rel"), "tgt", (0.5 + (F.col("src") % 5) / 10.0).alias("confidence"))
    return G.transitive(e, "NEXT", 3).withColumn("confidence", F.round("confidence", 6))


@query("grf18_symmetry", f"WITH {RING} SELECT a.tgt AS src, 'NEXT' AS rel, a.src AS tgt FROM ring a WHERE NOT EXISTS (SELECT 1 FROM ring b WHERE b.src = a.tgt AND b.tgt = a.src)")
def symmetry(d: Data) -> DataFrame:
    e = ring(d).select("src", F.lit("NEXT").alias("rel"), "tgt", F.lit(1.0).alias("confidence"))
    return G.reversed_missing(e, "NEXT", "NEXT").drop("confidence")


@query("grf19_composition", "SELECT a.src, 'IN_REGION' AS rel, b.tgt, round(max(a.confidence * b.confidence * 0.9), 6) AS confidence FROM relations a JOIN relations b ON a.tgt = b.src WHERE a.rel = 'LOCATED_IN' AND b.rel = 'PART_OF' GROUP BY a.src, b.tgt")
def composition(d: Data) -> DataFrame:
    return G.composed(d.relations, "LOCATED_IN", "PART_OF", "IN_REGION").withColumn("confidence", F.round("confidence", 6))


@query("grf20_fixpoint", """
WITH c AS (SELECT a.src, b.tgt FROM relations a JOIN relations b ON a.tgt = b.src WHERE a.rel = 'LOCATED_IN' AND b.rel = 'PART_OF') SELECT src, 'IN_REGION' AS rel, tgt, 1 AS round FROM c UNION ALL SELECT tgt, 'CONTAINS', src, 2 FROM c""")
def fixpoint(d: Data) -> DataFrame:
    rules = [lambda e: G.composed(e, "LOCATED_IN", "PART_OF", "IN_REGION"), lambda e: G.reversed_missing(e, "IN_REGION", "CONTAINS")]
    return G.fixpoint(d.relations, rules).select("src", "rel", "tgt", "round")


@query("grf22_shapes", """
WITH v AS (SELECT CAST(c_custkey AS VARCHAR) AS node, 'acctbal' AS shape, 'warning' AS severity FROM customer WHERE c_acctbal < 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'size', 'violation' FROM part WHERE p_size > 40 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'orders', 'violation' FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_orderkey) = 0) SELECT shape, severity, count(*) AS n FROM v GROUP BY shape, severity""")
def shapes(d: Data) -> DataFrame:
    row = lambda df, key, shape, severity: df.select(F.col(key).cast("string").alias("node"), F.lit(shape).alias("shape"), F.lit(severity).alias("severity"))
    v = row(d.customer.where("c_acctbal < 0"), "c_custkey", "acctbal", "warning").unionAll(row(d.part.where("p_size > 40"), "p_partkey", "size", "violation"))
    v = v.unionAll(row(d.customer.join(d.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti"), "c_custkey", "orders", "violation"))
    return v.groupBy("shape", "severity").agg(F.count("*").alias("n"))


@query("grf24_domain_range", """
SELECT r.rel, a.type AS src_type, b.type AS tgt_type, count(*) AS n FROM relations r JOIN entities a ON a.id = r.src JOIN entities b ON b.id = r.tgt WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('PART_OF', 'NATION', 'REGION'), ('LOCATED_IN', 'SUPPLIER', 'NATION')) k(rel, s, t) WHERE k.rel = r.rel AND k.s = a.type AND k.t = b.type) GROUP BY 1, 2, 3""")
def domain_range(d: Data) -> DataFrame:
    ok = d.spark.createDataFrame([("PART_OF", "NATION", "REGION"), ("LOCATED_IN", "SUPPLIER", "NATION")], "rel string, src_type string, tgt_type string")
    t = d.entities.select("id", "type")
    e = d.relations.join(t.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src").join(t.select(F.col("id").alias("tgt"), F.col("type").alias("tgt_type")), "tgt")
    return e.join(F.broadcast(ok), ["rel", "src_type", "tgt_type"], "left_anti").groupBy("rel", "src_type", "tgt_type").agg(F.count("*").alias("n"))


@query("grf26_type_expansion", "SELECT e.id FROM entities e WHERE e.type IN ('REGION', 'NATION')")
def type_expansion(d: Data) -> DataFrame:
    tree = d.spark.createDataFrame([("REGION", "PLACE"), ("NATION", "PLACE"), ("SUPPLIER", "PARTY"), ("CUSTOMER", "PARTY"), ("PARTY", "THING"), ("PLACE", "THING")], "src string, tgt string")
    kinds = G.descendants(tree, 5).where("root = 'PLACE'").select(F.col("node").alias("type"))
    return d.entities.join(F.broadcast(kinds), "type", "left_semi").select("id")


@query("grf28_missing_links")
def missing_links(d: Data) -> DataFrame:
    e = d.lineitem.select(F.col("l_suppkey").alias("src"), F.lit("SUPPLIES").alias("rel"), F.col("l_partkey").alias("tgt"))
    return G.missing_tails(e, "SUPPLIES", 3)


@query("grf28_predicted_links")
def predicted_links(d: Data) -> DataFrame:
    """Each vector's nearest one of its label is its link; a fifth of the links is held out and looked for by translation."""
    v = d.embeddings.select(F.col("vec_id").cast("string").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    near = R.knn(d.embeddings, d.embeddings, 1, within="label").join(d.embeddings.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    links = written(near.select(F.col("query_id").cast("string").alias("src"), F.concat(F.lit("LIKE_"), F.col("label").cast("string")).alias("rel"), F.col("vec_id").cast("string").alias("tgt")))
    out = F.pmod(F.xxhash64("src"), F.lit(5)) == 0
    learned = X.train(links.where(~out), v, 64, epochs=6)
    return X.link_metrics(X.predicted_tails(links.where(out).select("src", "rel"), learned, v, links.where(~out), 10), links.where(out), 10)


@query("grf29_rename", "SELECT CASE r.rel WHEN 'LOCATED_IN' THEN 'BASED_IN' ELSE r.rel END AS rel, count(*) AS n FROM relations r GROUP BY 1")
def rename(d: Data) -> DataFrame:
    names = d.spark.createDataFrame([("LOCATED_IN", "BASED_IN")], "rel string, name string")
    return d.relations.join(F.broadcast(names), "rel", "left").groupBy(F.coalesce("name", "rel").alias("rel")).agg(F.count("*").alias("n"))


@query("grf30_overmerged", "SELECT l_partkey AS entity, count(DISTINCT l_orderkey) AS mentions, max(l_linenumber) - min(l_linenumber) AS spread FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 4 AND max(l_linenumber) - min(l_linenumber) >= 2")
def overmerged(d: Data) -> DataFrame:
    return d.lineitem.groupBy(F.col("l_partkey").alias("entity")).agg(F.count_distinct("l_orderkey").alias("mentions"), (F.max("l_linenumber") - F.min("l_linenumber")).alias("spread")).where("mentions >= 4 AND spread >= 2")


@query("snk02_evidence_merge", """
WITH p AS (SELECT src, rel, tgt, doc, max(confidence) AS c FROM evidence GROUP BY src, rel, tgt, doc) SELECT src, rel, tgt, round(1 - product(1 - c), 6) AS confidence, count(*) AS docs FROM p GROUP BY src, rel, tgt""")
def evidence_merge(d: Data) -> DataFrame:
    return d.edges.select("src", "rel", "tgt", F.round("confidence", 6).alias("confidence"), "docs")


@query("grf06_community_hierarchy")
def community_hierarchy(d: Data) -> DataFrame:
    return G.community_hierarchy(d.relations.select("src", "tgt", F.col("confidence").alias("weight")), levels=2, least=3)


#: Places within places, under two names, and suppliers that are the customers of their number.
PLACES = [("PART_OF", "subPropertyOf", "WITHIN"), ("LOCATED_IN", "subPropertyOf", "WITHIN"), ("WITHIN", "type", "TransitiveProperty"), ("WITHIN", "inverseOf", "CONTAINS"), ("WITHIN", "range", "PLACE"), ("PLACE", "subClassOf", "THING")]


@query("grf21_owl_closure", """
WITH same AS (SELECT concat('SUPPLIER:', CAST(s_suppkey AS VARCHAR)) AS n, concat('CUSTOMER:', CAST(s_suppkey AS VARCHAR)) AS r FROM supplier), given AS (SELECT DISTINCT src AS s, rel AS p, tgt AS o FROM relations),
base AS (SELECT DISTINCT coalesce(r, s) AS s, p, o FROM given LEFT JOIN same ON n = s), within AS (SELECT DISTINCT s, o FROM base UNION SELECT b.s, c.o FROM base b JOIN base c ON c.s = b.o),
a AS (SELECT s, p, o FROM base UNION SELECT s, 'WITHIN', o FROM within UNION SELECT o, 'CONTAINS', s FROM within UNION SELECT o, 'type', 'PLACE' FROM within UNION SELECT o, 'type', 'THING' FROM within)
SELECT s, p, o FROM a WHERE (s, p, o) NOT IN (SELECT (s, p, o) FROM given)""")
def owl_closure(d: Data) -> DataFrame:
    name = lambda kind: F.concat(F.lit(f"{kind}:"), F.col("s_suppkey").cast("string"))
    same = d.supplier.select(name("SUPPLIER").alias("s"), F.lit("sameAs").alias("p"), name("CUSTOMER").alias("o"))
    return owl.entailed(d.relations.select("src", "rel", "tgt").toDF("s", "p", "o").unionAll(same).unionAll(d.spark.createDataFrame(PLACES, "s string, p string, o string")))


@query("grf21_inconsistencies", """
WITH t AS (SELECT DISTINCT o_custkey AS c, o_orderstatus AS s FROM orders) SELECT concat('CUSTOMER:', CAST(a.c AS VARCHAR)) AS node, 'disjoint classes' AS problem, 'F P' AS other FROM t a JOIN t b ON b.c = a.c WHERE a.s = 'F' AND b.s = 'P'""")
def inconsistencies(d: Data) -> DataFrame:
    types = d.orders.select(F.concat(F.lit("CUSTOMER:"), F.col("o_custkey").cast("string")).alias("s"), F.lit("type").alias("p"), F.col("o_orderstatus").alias("o"))
    return owl.closure(types.unionAll(d.spark.createDataFrame([("F", "disjointWith", "P")], "s string, p string, o string"))).problems
