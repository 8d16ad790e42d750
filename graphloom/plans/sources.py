"""Source and sink queries that go through files, and the rest of the string, graph, retrieval and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as T
from graphloom.functions import vectors as V
from graphloom.operators import graph as G
from graphloom.operators import neighbours as N
from graphloom.operators import ontology as O
from graphloom.operators import retrieval as R
from graphloom.plans.registry import query
from graphloom.plans.retrieval import BM25, best_documents
from graphloom.plans.windows import CLEAN
from graphloom.session import Data, scratch, written
from graphloom.sources import adapters, sinks
from graphloom.streaming import event_log as S


@query("src06_text_files", "SELECT item_id, md5(text) AS digest, 'txt' AS kind FROM benchmark")
def text_files(d: Data) -> DataFrame:
    at = scratch(d.spark)
    d.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("value")).repartition("id").write.partitionBy("id").option("lineSep", "\u0000").text(at)
    docs = adapters.documents(d.spark, at)
    return docs.select(F.regexp_extract("path", r"id=(\d+)", 1).cast("long").alias("item_id"), F.md5(F.rtrim("text", F.lit("\u0000"))).alias("digest"), "kind")


@query("src07_crm_accounts", "SELECT coalesce(CASE WHEN c_custkey % 6 = 0 THEN 'A1' END, 'A' || CAST(c_custkey AS VARCHAR)) AS account, 'A' || CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE c_custkey % 5 <> 0")
def crm_accounts(d: Data) -> DataFrame:
    """Exports of a hundred accounts each."""
    k = F.col("c_custkey")
    a = F.struct(F.concat(F.lit("A"), k).alias("Id"), F.col("c_name").alias("Name"), (k % 5 == 0).alias("IsDeleted"), F.when(k % 6 == 0, "A1").alias("MasterRecordId"))
    body = d.customer.groupBy(F.floor(k / 100).alias("g")).agg(F.to_json(F.struct(F.collect_list(a).alias("accounts"))).alias("body"))
    return adapters.crm_accounts(body, "body")


@query("src09_lenient_flags", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'true' WHEN c_custkey % 3 = 1 THEN 'false' ELSE 'unknown' END AS shareable FROM customer")
def lenient_flags(d: Data) -> DataFrame:
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, " Yes").when(k == 1, "0").otherwise("maybe")
    return d.customer.select("c_custkey", F.coalesce(adapters.lenient_bool(raw).cast("string"), F.lit("unknown")).alias("shareable"))


@query("src10_golden_rows", "SELECT CAST(item_id AS VARCHAR) AS id, text AS question FROM benchmark")
def golden_rows(d: Data) -> DataFrame:
    at = scratch(d.spark)
    d.benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question")).write.json(at)
    return adapters.golden_rows(d.spark, at).select("id", "question")


@query("src11_study_rows", "SELECT CAST(event_id AS VARCHAR) AS task_id, CASE WHEN user_id % 2 = 0 THEN 'manual' ELSE 'assisted' END AS condition, round(value, 4) AS duration_seconds FROM events")
def study_rows(d: Data) -> DataFrame:
    at = scratch(d.spark)
    d.events.select(F.col("event_id").alias("task_id"), F.when(F.col("user_id") % 2 == 0, "manual").otherwise("assisted").alias("condition"), F.col("value").alias("duration_seconds"), F.lit(0.5).alias("evidence_score"), F.lit(True).alias("success")).write.option("header", True).csv(at)
    return adapters.study_rows(d.spark, at).select("task_id", "condition", F.round("duration_seconds", 4).alias("duration_seconds"))


@query("src13_first_vectors", "SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 6) AS total FROM embeddings ORDER BY vec_id LIMIT 100")
def first_vectors(d: Data) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return d.embeddings.orderBy("vec_id").limit(100).select("vec_id", F.round(total, 6).alias("total"))


@query("src14_triples", "SELECT '<' || src || '>' AS s, '<' || rel || '>' AS p, '\"' || tgt || '\"' AS o FROM relations WHERE rel = 'PART_OF'")
def triples(d: Data) -> DataFrame:
    at = scratch(d.spark)
    sinks.write_triples(d.relations.where("rel = 'PART_OF'").select(F.col("src").alias("s"), F.col("rel").alias("p"), F.col("tgt").alias("o")), at)
    return adapters.triples(d.spark, at)


@query("src15_label_candidates", """
SELECT id AS uri, CASE WHEN type = 'NATION' THEN lower(name) WHEN type = 'REGION' THEN name ELSE 'alt ' || name END AS label, CASE WHEN type = 'SUPPLIER' THEN 'CONCEPT' ELSE type END AS hint FROM entities WHERE type IN ('NATION', 'REGION', 'SUPPLIER')""")
def label_candidates(d: Data) -> DataFrame:
    e = d.entities.where("type IN ('NATION', 'REGION', 'SUPPLIER')")
    said = F.array(
        F.when(F.col("type") == "NATION", F.struct(F.lit("http://www.w3.org/2004/02/skos/core#prefLabel").alias("p"), F.lower("name").alias("o"))),
        F.when(F.col("type") != "SUPPLIER", F.struct(F.lit("http://www.w3.org/2000/01/rdf-schema#label").alias("p"), F.col("name").alias("o"))),
        F.struct(F.lit("http://www.w3.org/2004/02/skos/core#altLabel").alias("p"), F.concat(F.lit("alt "), "name").alias("o")),
        F.when(F.col("type") != "SUPPLIER", F.struct(F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type").alias("p"), F.concat(F.lit("http://example.org/kinds#"), F.initcap("type")).alias("o"))),
    )
    t = e.select(F.col("id").alias("s"), F.explode(F.array_compact(said)).alias("x")).select("s", "x.p", "x.o")
    return O.label_candidates(t)


@query("snk09_score_upsert", """
WITH changed AS (SELECT DISTINCT user_id FROM events WHERE event_id % 50 = 0), p AS (SELECT user_id, CAST(sum(CASE event_type WHEN 'purchase' THEN 5 WHEN 'click' THEN 1 ELSE 0 END) AS BIGINT) AS points FROM events WHERE user_id IN (SELECT user_id FROM changed) GROUP BY user_id)
SELECT user_id, points FROM p UNION ALL SELECT DISTINCT user_id, CAST(-1 AS BIGINT) FROM events WHERE user_id % 10 <> 0 AND user_id NOT IN (SELECT user_id FROM changed)""")
def score_upsert(d: Data) -> DataFrame:
    """A table of scores in which a tenth of the users is missing; the users of every fiftieth event are computed anew."""
    from graphloom.operators.temporal import merge_scores

    points = F.sum(F.when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "click", 1).otherwise(0))
    known = d.events.where("user_id % 10 <> 0").select("user_id").distinct().withColumn("points", F.lit(-1).cast("long"))
    new = S.recompute(d.events.where("event_id % 50 = 0"), lambda: d.events, "user_id", lambda e: e.groupBy("user_id").agg(points.alias("points")))
    return merge_scores(known, new, "user_id")


@query("snk11_by_day", "SELECT event_id FROM kpi WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-06'")
def by_day(d: Data) -> DataFrame:
    at = scratch(d.spark)
    sinks.write_by_day(d.events.select("event_id", "ts"), at, "ts")
    return d.spark.read.parquet(at).where("day BETWEEN DATE '2024-01-05' AND DATE '2024-01-06'").select("event_id")


@query("snk12_backup", "SELECT src, rel, tgt FROM relations")
def backup(d: Data) -> DataFrame:
    at = scratch(d.spark)
    sinks.backup({"relations": d.relations}, at)
    return sinks.restore(d.spark, at, ["relations"])["relations"].select("src", "rel", "tgt")


@query("snk04_document_upsert", "SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source")
def document_upsert(d: Data) -> DataFrame:
    from graphloom.operators.temporal import upsert

    x = d.documents.select("source", "doc_id")
    return upsert(x.where("doc_id % 2 = 0"), x.where("doc_id % 2 = 1"), "source", "doc_id")


@query("flt10_filtered_top", """
WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND b.label = 5),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS r FROM s) SELECT query_id, vec_id, round(score, 6) AS score FROM r WHERE r <= 10""")
def filtered_top(d: Data) -> DataFrame:
    """The tag is filtered before the search."""
    return R.knn(d.embeddings.where("vec_id % 20 = 0"), d.embeddings.where("label = 5"), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("flt17_read_only", r"""
WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'SELECT ?x WHERE { ?x a "' || p_name || '" } # delete it later' WHEN 1 THEN 'ASK { SERVICE <http://x> { ?s ?p "' || p_name || '" } }' WHEN 2 THEN 'INSERT DATA { <a> <b> "' || p_name || '" }' WHEN 3 THEN 'describe <' || p_brand || '> "say \" DROP \" twice"' ELSE p_name END AS q FROM part)
SELECT p_partkey, regexp_matches(u, '\b(SELECT|ASK|CONSTRUCT|DESCRIBE)\b') AND NOT regexp_matches(u, '\b(SERVICE|LOAD|INSERT|DELETE|CLEAR|DROP|CREATE|ADD|MOVE|COPY)\b') AS ok FROM (SELECT p_partkey, upper(regexp_replace(regexp_replace(q, '#[^\n]*', '', 'g'), '"(?:[^"\\]|\\.)*"|' || chr(39) || '(?:[^' || chr(39) || '\\]|\\.)*' || chr(39), '""', 'g')) AS u FROM s)""")
def read_only(d: Data) -> DataFrame:
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    q = F.when(k == 0, F.concat(F.lit('SELECT ?x WHERE { ?x a "'), name, F.lit('" } # delete it later'))).when(k == 1, F.concat(F.lit('ASK { SERVICE <http://x> { ?s ?p "'), name, F.lit('" } }')))
    q = q.when(k == 2, F.concat(F.lit('INSERT DATA { <a> <b> "'), name, F.lit('" }'))).when(k == 3, F.concat(F.lit("describe <"), "p_brand", F.lit('> "say \\" DROP \\" twice"'))).otherwise(name)
    return d.part.select("p_partkey", T.read_only(q).alias("ok"))


@query("win05_clean_pages_by_fold", CLEAN)
def clean_by_fold(d: Data) -> DataFrame:
    w = Window.partitionBy("user_id", "day").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("event_type") == "error"
    first = F.row_number().over(Window.partitionBy("user_id", "day", "event_type").orderBy("event_id")) == 1
    e = d.kpi.withColumn("all", F.size(F.collect_set(F.when(~bad, F.col("event_type"))).over(Window.partitionBy("user_id", "day")))).withColumn("new", first & ~bad)
    e = e.withColumn("solved", F.sum(F.col("new").cast("int")).over(w)).withColumn("wrong", F.max(bad).over(w))
    done = e.where(F.col("new") & (F.col("solved") == F.col("all")) & (F.col("all") >= 2))
    return done.select("user_id", F.col("day").cast("string").alias("day"), F.col("event_id").alias("completed"), (~F.col("wrong")).alias("clean"), F.when(F.col("wrong"), 0).otherwise(20).alias("bonus"))


@query("set03_merged_files", "SELECT count(*) AS n FROM (SELECT src, tgt FROM relations UNION SELECT src, tgt FROM evidence)")
def merged_files(d: Data) -> DataFrame:
    return d.relations.select("src", "tgt").union(d.evidence.select("src", "tgt")).distinct().agg(F.count("*").alias("n"))


@query("str08_opening_ratio")
def opening_ratio(d: Data) -> DataFrame:
    return R.near_openings(d.documents).select("a", "b", F.round("ratio", 6).alias("ratio"))


@query("str11_cross_score", r"""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), c AS (SELECT doc_id, contains(t, 'of the and') AS phrase, contains(t, 'of') AS a, contains(t, 'the') AS b, contains(t, 'and') AS c, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM t)
SELECT doc_id, round(least(1.0, (CASE WHEN phrase THEN 0.5 ELSE 0 END + CASE WHEN a THEN 0.1 + CASE WHEN b THEN 0.05 ELSE 0 END ELSE 0 END + CASE WHEN b THEN 0.1 + CASE WHEN a THEN 0.05 ELSE 0 END + CASE WHEN c THEN 0.05 ELSE 0 END ELSE 0 END + CASE WHEN c THEN 0.1 + CASE WHEN b THEN 0.05 ELSE 0 END ELSE 0 END) * CASE WHEN n < 20 OR n > 500 THEN 0.8 ELSE 1.0 END), 4) AS score FROM c""")
def cross_score(d: Data) -> DataFrame:
    return d.documents.select("doc_id", F.round(T.cross_score(F.col("text"), "of the and"), 4).alias("score"))


@query("str15_citations", r"""
WITH o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS k, o_orderkey % 4 AS m FROM orders), s AS (SELECT o_orderkey, m, c, k, CASE WHEN m = 0 THEN 'doc-' || c || ' DOC-' || c || ' Dr. N' || k WHEN m = 1 THEN 'an ANNEX ' || k || ' of smith' ELSE 'none' END AS src, CASE WHEN m = 2 THEN 'LAB-' || k ELSE '-' END AS known FROM o),
x AS (SELECT o_orderkey, src, known, unnest(['DOC-' || c, 'LAB-' || k, 'Dr', 'annex ' || k, 'Smith']) AS cited FROM s)
SELECT o_orderkey, cited, CASE WHEN contains(cited, 'DOC-') OR contains(cited, 'LAB-') THEN CASE WHEN contains(src, cited) OR known = cited THEN 'verified' ELSE 'fake_doc' END WHEN contains(lower(src), lower(cited)) THEN 'verified' ELSE 'unverified' END AS state FROM x""")
def citations(d: Data) -> DataFrame:
    c, k, m = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    text = F.concat(F.lit("It stands [source: DOC-"), c, F.lit("] and (document LAB-"), k, F.lit("), according to Dr. N"), k, F.lit(", as mentioned in annex "), k, F.lit(". So per Smith's view."))
    sources = F.when(m == 0, F.concat(F.lit("doc-"), c, F.lit(" DOC-"), c, F.lit(" Dr. N"), k)).when(m == 1, F.concat(F.lit("an ANNEX "), k, F.lit(" of smith"))).otherwise("none")
    o = d.orders.select("o_orderkey", text.alias("t"), sources.alias("src"), F.array(F.when(m == 2, F.concat(F.lit("LAB-"), k)).otherwise("-")).alias("known"))
    return o.select("o_orderkey", "src", "known", F.explode(T.citations(F.col("t"))).alias("cited")).select("o_orderkey", "cited", T.citation_state(F.col("cited"), F.col("known"), F.col("src")).alias("state"))


@query("str16_section_chunks")
def section_chunks(d: Data) -> DataFrame:
    """Documents with a heading line before every tenth line, so that sections of all sizes come up."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    titled = F.array_join(F.transform(lines, lambda x, i: F.when(i % 10 == 9, F.concat(F.lit("SECTION "), i.cast("string"), F.lit(":\n"), x)).otherwise(x)), "\n")
    c = T.section_chunks(d.documents.select("doc_id", "source", titled.alias("text")), "doc_id", "text", F.col("source"))
    return c.select("doc_id", "chunk", "heading", F.length("body").alias("n"), F.md5("body").alias("digest"))


@query("str21_stop_word_language")
def stop_word_language(d: Data) -> DataFrame:
    return d.documents.select("doc_id", T.stop_word_language(F.col("text")).alias("guess"), "lang")


@query("str27_cache_key", r"SELECT item_id, sha256(trim(regexp_replace(lower('  What   IS ' || text), '\s+', ' ', 'g')) || chr(31) || 'k=5') AS key FROM benchmark")
def cache_key(d: Data) -> DataFrame:
    return d.benchmark.select("item_id", T.cache_key(F.concat(F.lit("  What   IS "), "text"), F.lit("k=5")).alias("key"))


@query("mth03_seeded_vectors")
def seeded_vectors(d: Data) -> DataFrame:
    return d.nation.select("n_nationkey", F.posexplode(V.seeded_unit(8)("n_name")).alias("dim", "value"))


TREE = [("REGION", "PLACE"), ("NATION", "PLACE"), ("SUPPLIER", "PARTY"), ("CUSTOMER", "PARTY"), ("PARTY", "THING"), ("PLACE", "THING")]


@query("mth05_common_ancestor", """
WITH p AS (SELECT DISTINCT split_part(src, ':', 1) AS a, split_part(tgt, ':', 1) AS b FROM relations), k(t, up) AS (VALUES ('REGION', 'PLACE'), ('NATION', 'PLACE'), ('SUPPLIER', 'PARTY'), ('CUSTOMER', 'PARTY'))
SELECT a, b, CASE WHEN a = b THEN a WHEN x.up = y.up THEN x.up ELSE 'THING' END AS ancestor FROM p JOIN k x ON x.t = a JOIN k y ON y.t = b""")
def common_ancestor(d: Data) -> DataFrame:
    """Of the kinds of the two ends of each kind of relation that there is."""
    tree = d.spark.createDataFrame(TREE, "src string, tgt string")
    kind = lambda end: F.split_part(F.col(end), F.lit(":"), F.lit(1))
    return O.common_ancestor(tree, d.relations.select(kind("src").alias("a"), kind("tgt").alias("b")).distinct())


@query("grf07_semantic_groups")
def semantic_groups(d: Data) -> DataFrame:
    return O.density_groups(d.embeddings, "vec_id", "embedding")


@query("grf15_blend", """
WITH l AS (SELECT l_suppkey AS item, 'PART:' || CAST(l_partkey AS VARCHAR) AS entity, 'PART' AS kind, max(l_discount * 6 - 0.2) AS sim FROM lineitem GROUP BY 1, 2 UNION ALL SELECT s_suppkey, 'NATION:' || CAST(s_nationkey AS VARCHAR), 'LOCATION', 0.9 FROM supplier), b AS (SELECT item, max(sim) AS s, max_by(entity, (kind <> 'LOCATION', sim, entity)) AS label FROM l GROUP BY item)
SELECT s_suppkey AS item, round(greatest(0, coalesce(s, 0)), 6) AS gnn, round(0.7 * (s_acctbal / 10000) + 0.3 * greatest(0, coalesce(s, 0)), 6) AS final, label FROM supplier LEFT JOIN b ON item = s_suppkey""")
def blend(d: Data) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("entity")
    links = d.lineitem.groupBy(F.col("l_suppkey").alias("item"), name("PART", "l_partkey")).agg(F.max(F.col("l_discount") * 6 - 0.2).alias("similarity")).select("item", "entity", F.lit("PART").alias("kind"), "similarity")
    links = links.unionByName(d.supplier.select(F.col("s_suppkey").alias("item"), name("NATION", "s_nationkey"), F.lit("LOCATION").alias("kind"), F.lit(0.9).alias("similarity")))
    out = G.blended(d.supplier.select(F.col("s_suppkey").alias("item"), (F.col("s_acctbal") / 10000).alias("text")), links)
    return out.select("item", F.round("gnn", 6).alias("gnn"), F.round("final", 6).alias("final"), "label")


@query("grf21_entailed", """
WITH t AS (SELECT id AS s, type AS c FROM entities WHERE type IN ('NATION', 'REGION')) SELECT s, 'type' AS p, 'PLACE' AS o FROM t UNION ALL SELECT s, 'type', 'THING' FROM t UNION ALL SELECT 'NATION', 'subClassOf', 'THING' UNION ALL SELECT 'REGION', 'subClassOf', 'THING'
UNION ALL SELECT src, 'IN', tgt FROM relations WHERE rel = 'PART_OF'""")
def entailed(d: Data) -> DataFrame:
    known = d.entities.where("type IN ('NATION', 'REGION')").select(F.col("id").alias("s"), F.lit("type").alias("p"), F.col("type").alias("o"))
    known = known.unionAll(d.relations.where("rel = 'PART_OF'").select("src", "rel", "tgt"))
    tree = [("NATION", "subClassOf", "PLACE"), ("REGION", "subClassOf", "PLACE"), ("PLACE", "subClassOf", "THING"), ("PART_OF", "subPropertyOf", "IN"), ("PART_OF", "domain", "NATION")]
    return O.entailed(known.unionAll(d.spark.createDataFrame(tree, "s string, p string, o string")))


@query("grf23_property_rules", "SELECT CAST(o_custkey AS VARCHAR) AS node, 'status' AS property, 'too_many' AS problem FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 2 UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 'status', 'not_allowed' FROM orders WHERE o_orderstatus = 'P'")
def property_rules(d: Data) -> DataFrame:
    v = d.orders.select(F.col("o_custkey").cast("string").alias("node"), F.lit("status").alias("property"), F.col("o_orderstatus").alias("value"))
    return O.constraint_violations(v, d.spark.createDataFrame([("status", 2, ["O", "F"])], "property string, most int, allowed array<string>"))


@query("grf25_confident_relations", "SELECT src, rel, tgt FROM relations WHERE confidence >= 0.9")
def confident_relations(d: Data) -> DataFrame:
    return O.confident(d.relations, 0.9).toDF("src", "rel", "tgt")


@query("grf25_triple_lookups", """
SELECT 'relation' AS kind, 'NATION:7' AS s, rel AS p, tgt AS o FROM relations WHERE src = 'NATION:7' UNION ALL SELECT 'subclass', a, 'subClassOf', b FROM (VALUES ('REGION', 'PLACE'), ('NATION', 'PLACE')) t(a, b) UNION ALL SELECT 'confident', src, rel, tgt FROM relations WHERE confidence >= 0.9""")
def triple_lookups(d: Data) -> DataFrame:
    tree = d.spark.createDataFrame([(a, "subClassOf", b) for a, b in TREE], "s string, p string, o string")
    t = d.relations.select(F.col("src").alias("s"), F.col("rel").alias("p"), F.col("tgt").alias("o")).unionByName(d.entities.select(F.col("id").alias("s"), F.lit("type").alias("p"), F.col("type").alias("o"))).unionByName(d.entities.select(F.col("id").alias("s"), F.lit("label").alias("p"), F.col("name").alias("o"))).unionByName(tree)
    found = {"relation": O.relations_of(t, "NATION:7"), "subclass": O.subclass_pairs(t, "PLACE"), "confident": O.confident(d.relations, 0.9)}
    out = None
    for kind, df in found.items():
        df = df.select(F.lit(kind).alias("kind"), "s", "p", "o")
        out = df if out is None else out.unionByName(df)
    return out


@query("grf27_translations")
def translations(d: Data) -> DataFrame:
    nodes = d.entities.where("type IN ('NATION', 'REGION', 'SUPPLIER', 'CUSTOMER')").select(F.col("id").alias("node"), V.seeded_unit(8)("id").alias("vector"))
    return O.translations(d.relations, nodes, 8).select("rel", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("ret02_approximate")
def approximate(d: Data) -> DataFrame:
    """Ten neighbours by beams along a graph of neighbours, and how many rows the beams looked at for each query."""
    _, index = N.neighbour_graph(d.embeddings)
    return N.graph_search(d.embeddings.where("vec_id % 20 = 0"), index, 10)


SNAPSHOTS = """v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), t AS (SELECT vec_id, label % 3 AS level, 't' || CAST(vec_id % 3 AS VARCHAR) AS tenant, CASE WHEN vec_id % 11 <> 0 THEN vec_id % 28 + 1 END AS vf, CASE WHEN vec_id % 13 <> 0 THEN vec_id % 28 + 11 END AS vt, vec_id % 28 + 3 AS kf, CASE WHEN vec_id % 5 = 0 THEN vec_id % 28 + 8 END AS kt FROM embeddings),
seen AS (SELECT v.vec_id, level, e FROM v JOIN t ON t.vec_id = v.vec_id WHERE tenant = 't1' AND (vf IS NULL OR vf <= 15) AND (vt IS NULL OR vt > 15) AND kf <= 16 AND (kt IS NULL OR kt > 16)),
n AS (SELECT a.vec_id AS query_id, b.vec_id, b.level, list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) AS score FROM v a JOIN seen b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS place FROM n)"""


def found_communities(d: Data) -> DataFrame:
    day, k = F.col("vec_id") % 28, F.col("vec_id")
    snapshots = d.embeddings.select("vec_id", "embedding", (F.col("label") % 3).alias("level"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("tenant"), F.when(k % 11 != 0, day + 1).alias("valid_from"), F.when(k % 13 != 0, day + 11).alias("valid_to"), (day + 3).alias("known_from"), F.when(k % 5 == 0, day + 8).alias("known_to"))
    return R.community_search(d.embeddings.where("vec_id % 20 = 0"), snapshots, 5, "t1", F.lit(15), F.lit(16))


@query("ret04_as_of_snapshots", f"WITH {SNAPSHOTS} SELECT query_id, vec_id, level, round(score, 6) AS score, place FROM found WHERE place <= 5")
def as_of_snapshots(d: Data) -> DataFrame:
    return found_communities(d).withColumn("score", F.round("score", 6))


POOL = f"""{BM25}, pool AS (SELECT query_id, b.doc_id, source, (n_chars * 7 + b.doc_id) % 1009 AS score, CASE WHEN source = 'src' || CAST(query_id % 20 AS VARCHAR) THEN 0 END AS code, row_number() OVER (PARTITION BY query_id ORDER BY round(b.score, 6) DESC, b.doc_id) - 1 AS rank FROM b JOIN documents ON documents.doc_id = b.doc_id)"""


def candidate_chunks(d: Data) -> DataFrame:
    """The 20 best documents of each benchmark item by BM25; the model's score is a stand-in."""
    pool = best_documents(d, 20)
    named = F.when(F.col("source") == F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")), 0)
    return pool.join(d.documents.select("doc_id", "source", "n_chars"), "doc_id").select("query_id", "doc_id", "source", "rank", ((F.col("n_chars") * 7 + F.col("doc_id")) % 1009).alias("score"), named.alias("code"))


@query("ret07_diverse_rerank", f"""
WITH {POOL}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) - 1 AS rr, least(5, count(*) OVER (PARTITION BY query_id)) AS k FROM pool WHERE rank < 20), b1 AS (SELECT *, rank < 2 AND rr >= 5 AS fl FROM a), b2 AS (SELECT *, fl OR rr < k - sum(fl::INT) OVER (PARTITION BY query_id) AS s1 FROM b1),
b3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT s1, NOT fl, CASE WHEN fl THEN rank ELSE rr END) AS p1, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1 AS f FROM b2), b4 AS (SELECT *, f AND sum(f::INT) OVER (PARTITION BY query_id ORDER BY rank) <= 3 AS dv FROM b3), b5 AS (SELECT * REPLACE (dv AND sum(dv::INT) OVER (PARTITION BY query_id) > 1 AND k > 1 AS dv) FROM b4),
b6 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN dv THEN 0 WHEN s1 THEN 1 ELSE 2 END, CASE WHEN dv THEN rank ELSE p1 END) AS p2 FROM b5), b7 AS (SELECT *, (dv OR s1) AND p2 <= k AS s2 FROM b6), nm AS (SELECT query_id, min(rank) AS rank FROM b7 WHERE code = 0 AND NOT s2 GROUP BY query_id), b8 AS (SELECT b7.*, nm.rank IS NOT NULL AS named FROM b7 LEFT JOIN nm ON nm.query_id = b7.query_id AND nm.rank = b7.rank),
z AS (SELECT query_id, doc_id, k, row_number() OVER (PARTITION BY query_id ORDER BY NOT named, NOT (fl AND s2), p2) AS place FROM b8 WHERE s2 OR named) SELECT query_id, doc_id, place FROM z WHERE place <= k""")
def diverse_rerank(d: Data) -> DataFrame:
    return R.reranked(candidate_chunks(d), "query_id", "doc_id", "source")


@query("ret09_local_search")
def local_search(d: Data) -> DataFrame:
    """Every benchmark item is a question; the vector of a question or a document is that of its id. Lexical and vector ranks
    are fused and reranked, the seeds' three nearest documents join as hops, scores are blended with the similarity to the
    question, and weak answers are tie-broken by authority (a stand-in)."""
    lexical = best_documents(d, 50)
    vectors = d.embeddings.join(d.documents.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = d.embeddings.join(d.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = R.knn(asked, vectors, 50).select("query_id", F.col("vec_id").alias("doc_id"), (F.col("place") - 1).alias("rank"))
    fused = R.ranked(R.fused([lexical, near], "query_id", "doc_id").withColumn("s", F.round("score", 9)), "query_id", "s", "doc_id", 50)
    pool = fused.join(d.documents.select("doc_id", "source", "n_chars"), "doc_id").select("query_id", "doc_id", "source", "rank", ((F.col("n_chars") * 7 + F.col("doc_id")) % 1009).alias("score"), F.lit(None).cast("int").alias("code"))
    seeds = written(R.reranked(pool, "query_id", "doc_id", "source"))
    edges = R.knn(vectors.join(seeds.select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi"), vectors, 3).select(F.col("query_id").alias("src"), F.col("vec_id").alias("tgt"), F.greatest(F.lit(0.0), "score").alias("score"))
    text = R.with_hops(seeds, edges, "query_id", "doc_id")
    x, y = d.embeddings.select(F.col("vec_id").alias("query_id"), R.unit(F.col("embedding")).alias("x")), d.embeddings.select(F.col("vec_id").alias("doc_id"), R.unit(F.col("embedding")).alias("y"))
    gnn = F.greatest(F.lit(0.0), F.coalesce(R.dot(F.col("x"), F.col("y")), F.lit(0.0)))
    scored = text.join(x, "query_id", "left").join(y, "doc_id", "left").join(d.documents.select("doc_id", (F.col("n_chars") / 1000).alias("authority")), "doc_id", "left")
    final = R.tiebroken(scored.select("query_id", "doc_id", F.round(0.7 * F.col("text") + 0.3 * gnn, 9).alias("final"), "authority"), "query_id", "doc_id")
    return final.where("place <= 10").select("query_id", "doc_id", F.round("final", 6).alias("final"), "place")


@query("ret11_global_context", f"""
WITH {SNAPSHOTS}, c AS (SELECT query_id, vec_id, place, trim(text) AS t, '[Community ' || CAST(vec_id AS VARCHAR) || ' | Level ' || CAST(level AS VARCHAR) || ' | Similarity ' || printf('%.3f', score) || ']' || chr(10) AS h FROM found JOIN documents ON doc_id = vec_id WHERE place <= 5 AND trim(coalesce(text, '')) <> ''),
u AS (SELECT *, 6000 - (sum(length(h) + length(t)) OVER (PARTITION BY query_id ORDER BY place) - length(h) - length(t)) - length(h) AS left_ FROM c) SELECT query_id, vec_id, place, CAST(least(length(t), left_) AS INTEGER) AS taken, md5(h || substr(t, 1, CAST(least(length(t), left_) AS BIGINT))) AS digest FROM u WHERE left_ > 0""")
def global_context(d: Data) -> DataFrame:
    """The nearest communities as of a moment, of which the document of the same id is the summary."""
    found = found_communities(d).join(d.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return R.direct_context(found, "query_id", "vec_id", "text", 6000).select("query_id", "vec_id", "place", "taken", F.md5("part").alias("digest"))


@query("ret12_context_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(lower(left(text, 300)))")
def context_dedup(d: Data) -> DataFrame:
    return d.documents.groupBy(F.md5(F.lower(F.left("text", F.lit(300)))).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


@query("ret16_precision_at_k", "WITH r AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders) SELECT o_custkey, round(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / 5.0, 6) AS prec FROM r WHERE p <= 5 GROUP BY o_custkey")
def precision_at_k(d: Data) -> DataFrame:
    r = R.ranked(d.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), "o_custkey", "o_totalprice", "o_orderkey", 5)
    return r.groupBy("o_custkey").agg(F.round(F.count_if(F.col("o_orderstatus") == "F") / 5, 6).alias("prec"))


@query("ent10_cross_links", "SELECT e.id, CASE WHEN e.type = 'NATION' THEN 'auto' WHEN e.type = 'REGION' THEN 'queue' ELSE 'unmatched' END AS lane FROM entities e WHERE e.type IN ('NATION', 'REGION', 'SUPPLIER')")
def cross_links(d: Data) -> DataFrame:
    from graphloom.operators.resolution import cascade

    e = d.entities.where("type IN ('NATION', 'REGION', 'SUPPLIER')").select(F.col("id").alias("mention"), "name", "type")
    exact = e.where("type = 'NATION'").join(d.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("entity")), "name").select("mention", "entity")
    alias = e.where("type = 'REGION'").join(d.region.select(F.lower("r_name").alias("alias"), F.col("r_regionkey").alias("entity")), F.lower("name") == F.col("alias")).select("mention", "entity")
    c = cascade(e.select("mention"), "mention", [("auto", exact), ("queue", alias)], "entity")
    return c.select(F.col("mention").alias("id"), F.when(F.col("stage") == "none", "unmatched").otherwise(F.col("stage")).alias("lane"))


@query("tmp09_recorded_since", "SELECT claim_id FROM claims WHERE valid_from <= DATE '1997-06-01' AND valid_from > DATE '1997-05-01'")
def recorded_since(d: Data) -> DataFrame:
    at = lambda s: F.lit(s).cast("date")
    return S.since(d.claims, "valid_from", at("1997-05-01"), at("1997-06-01")).select("claim_id")


@query("tmp10_replay", "SELECT deal, max_by(stage, (changed, seq)) AS approval, count(CASE WHEN changed + 365 > DATE '1998-01-01' THEN 1 END) AS open_exceptions FROM changes WHERE changed <= DATE '1998-01-01' GROUP BY deal")
def replay(d: Data) -> DataFrame:
    at = F.lit("1998-01-01").cast("date")
    return d.changes.where(F.col("changed") <= at).groupBy("deal").agg(F.max_by("stage", F.struct("changed", "seq")).alias("approval"), F.count_if(F.date_add("changed", 365) > at).alias("open_exceptions"))


@query("sal08_refused_question", "SELECT CASE WHEN regexp_matches(text, 'places have the most located', 'i') THEN 0 WHEN regexp_matches(text, 'regions have the most nations', 'i') THEN 1 WHEN regexp_matches(text, 'entities are located nowhere', 'i') THEN 2 END AS intent, count(*) AS n FROM (SELECT text FROM conversations WHERE role = 'user' UNION ALL SELECT 'Which regions have the most nations? ' || n_name FROM nation) GROUP BY 1")
def refused_question(d: Data) -> DataFrame:
    """What users said in conversations, most of which no intent answers (null), and a question about each nation."""
    from graphloom.operators.intents import routed

    asked = d.conversations.where("role = 'user'").select("text").unionAll(d.nation.select(F.concat(F.lit("Which regions have the most nations? "), "n_name")))
    return asked.groupBy(routed("text").alias("intent")).agg(F.count("*").alias("n"))


@query("stm09_affected_keys", "WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_id >= 9900), t AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT user_id FROM c) OR (SELECT count(*) FROM c) >= 0.2 * (SELECT n FROM t)")
def affected_keys(d: Data) -> DataFrame:
    return S.affected(d.events.where("event_id >= 9900"), d.events, "user_id")


@query("stm10_dirty_ancestors", "SELECT DISTINCT tgt AS node FROM relations WHERE src IN ('SUPPLIER:1', 'SUPPLIER:2') UNION SELECT b.tgt FROM relations a JOIN relations b ON a.tgt = b.src WHERE a.src IN ('SUPPLIER:1', 'SUPPLIER:2')")
def dirty_ancestors(d: Data) -> DataFrame:
    seeds = d.entities.where(F.col("id").isin("SUPPLIER:1", "SUPPLIER:2")).select(F.col("id").alias("node"))
    return G.reachable(d.relations, seeds).where("depth > 0").select("node")


@query("stm11_revisions", "SELECT CAST(max(event_id) AS BIGINT) AS revision, count(*) AS n FROM events")
def revisions(d: Data) -> DataFrame:
    rows = S.once(S.read(d.spark, f"{d.dir}/events.parquet").select("event_id"), "append")
    return rows.agg(F.max("event_id").alias("revision"), F.count("*").alias("n"))


@query("src02_table_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_scan(d: Data) -> DataFrame:
    from graphloom.sources.relational import read_table

    return read_table(d.spark, d.dir, "nation")


@query("snk10_appended_events", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def appended_events(d: Data) -> DataFrame:
    at = scratch(d.spark)
    for _ in range(2):
        d.events.select("event_id", "event_type").write.mode("append").parquet(at)
    return d.spark.read.parquet(at).groupBy("event_type").agg(F.count("*").alias("n"))


@query("flt01_scoped_edges", "SELECT r.src, r.tgt FROM relations r JOIN entities a ON a.id = r.src AND a.tenant = 't2' JOIN entities b ON b.id = r.tgt AND b.tenant = 't2'")
def scoped_edges(d: Data) -> DataFrame:
    from graphloom.operators.predicates import tenant_scope

    own = tenant_scope(d.entities, "t2").select("id")
    return induced(d.relations, own).select("src", "tgt")


def induced(edges: DataFrame, own: DataFrame) -> DataFrame:
    return edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "tgt"), "tgt", "left_semi")


@query("top10_candidate_pool", "WITH p AS (SELECT DISTINCT s_suppkey, levenshtein(s_name, 'Supplier#000000042') AS d FROM supplier WHERE s_nationkey < 20 OR s_acctbal > 0) SELECT s_suppkey, d FROM p ORDER BY d, s_suppkey LIMIT 50")
def candidate_pool(d: Data) -> DataFrame:
    s = d.supplier
    pool = s.where("s_nationkey < 20").unionByName(s.where("s_acctbal > 0")).dropDuplicates(["s_suppkey"])
    far = F.levenshtein("s_name", F.lit("Supplier#000000042")).cast("long")
    return pool.select("s_suppkey", far.alias("d")).orderBy("d", "s_suppkey").limit(50)


@query("str13_egress", r"""
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace('mail a.b@c.org, card 4111 1111 1111 1111, 123-45-6789 or (555) 123-4567: ' || coalesce(text, ''), '\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,4}\b', '[CARD_REDACTED]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[SSN_REDACTED]', 'g'),
'\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b', '[PHONE_REDACTED]', 'g'), '\b[\w.+-]+@[\w-]+\.[\w.-]+\b', '[EMAIL_REDACTED]', 'g') AS safe FROM conversations""")
def egress(d: Data) -> DataFrame:
    t = F.concat(F.lit("mail a.b@c.org, card 4111 1111 1111 1111, 123-45-6789 or (555) 123-4567: "), F.coalesce("text", F.lit("")))
    return d.conversations.select("conv_id", "turn", T.egress(t).alias("safe"))


@query("stm03_at_least_once", "SELECT count(*) AS n, count(DISTINCT event_id) AS events FROM events")
def at_least_once(d: Data) -> DataFrame:
    """Every row delivered twice; the keyed sink has it once."""
    from graphloom.operators.temporal import insert_new

    rows = S.once(S.read(d.spark, f"{d.dir}/events.parquet").select("event_id", "value"), "append")
    sink = insert_new(rows.limit(0), rows.unionAll(rows), "event_id", "value")
    return sink.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))


@query("ret12_context")
def context_of(d: Data) -> DataFrame:
    """The contexts of all benchmark items, from their 20 best documents; documents of an odd id count as reached by the graph."""
    pool = candidate_chunks(d).join(d.documents.select("doc_id", "text"), "doc_id")
    return R.context(pool.select("query_id", "doc_id", "text", F.col("score").cast("double").alias("score"), (F.col("doc_id") % 2 == 1).alias("hop"), (F.col("score") / 1009).alias("graph")), "query_id", "doc_id", "text", 5, 2)


@query("ret16_ranking_metrics", """
WITH t AS (SELECT o_custkey AS q, o_orderkey AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_custkey % 9 <> 0), g AS (SELECT DISTINCT o_custkey AS q, o_orderkey AS i FROM orders WHERE o_orderstatus = 'F'), top AS (SELECT * FROM t WHERE place <= 5), h AS (SELECT top.q, count(*) AS shown, count(g.i) AS hits, count(DISTINCT g.i) AS found, min(CASE WHEN g.i IS NOT NULL THEN place END) AS first FROM top LEFT JOIN g ON g.q = top.q AND g.i = top.i GROUP BY top.q), n AS (SELECT q, count(*) AS gold FROM g GROUP BY q)
SELECT coalesce(h.q, n.q) AS q, round(CASE WHEN coalesce(shown, 0) = 0 THEN 0.0 ELSE hits / CAST(shown AS DOUBLE) END, 6) AS precision_at_k, round(CASE WHEN coalesce(gold, 0) = 0 THEN 1.0 ELSE coalesce(found, 0) / CAST(gold AS DOUBLE) END, 6) AS recall_at_k, round(coalesce(1.0 / first, 0.0), 6) AS mrr FROM h FULL OUTER JOIN n ON n.q = h.q""")
def ranking_metrics(d: Data) -> DataFrame:
    shown = R.ranked(d.orders.where("o_custkey % 9 <> 0").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("i"), "o_totalprice"), "q", "o_totalprice", "i").withColumn("place", F.col("rank") + 1)
    gold = d.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("i"))
    m = R.ranking_metrics(shown, gold, "q", "i", 5)
    return m.select("q", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k", "mrr")])


@query("src03_database_scan", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def database_scan(d: Data) -> DataFrame:
    """Through a database's JDBC source, in ranges of the key: the session's ``graphloom.jdbc.url``; only in a local session, which has
    one JVM, the database embedded in Spark stands for it."""
    from graphloom.sources.relational import read_jdbc

    url = d.spark.conf.get("graphloom.jdbc.url", None)
    if url is None:
        if not d.spark.sparkContext.master.startswith("local["):
            raise ValueError("set graphloom.jdbc.url to a database that all executors reach")
        url = "jdbc:derby:memory:graphloom;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"} if url.startswith("jdbc:derby") else {}
    name = f"customer_{uuid.uuid4().hex[:8]}"
    d.customer.select("c_custkey", "c_name", "c_nationkey").write.format("jdbc").options(url=url, dbtable=name, **options).save()
    most = d.customer.agg(F.max("c_custkey")).head()[0] or 0
    found = read_jdbc(d.spark, url, name, partitionColumn="C_CUSTKEY" if options else "c_custkey", lowerBound="0", upperBound=str(most), numPartitions="4", **options)
    return found.toDF(*[c.lower() for c in found.columns])
