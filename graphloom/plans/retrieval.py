"""Retrieval queries (RET) and vector functions (MTH)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import postings as P
from graphloom.operators import retrieval as R
from graphloom.plans.registry import query
from graphloom.session import Data

UNIT = """v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
u AS (SELECT vec_id, label, [x / CASE WHEN list_inner_product(e, e) = 0 THEN 1 ELSE sqrt(list_inner_product(e, e)) END FOR x IN e] AS e FROM v)"""
KNN = f"""{UNIT}, s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, a.label AS ql, list_inner_product(a.e, b.e) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"""


def queries_of(d: Data) -> DataFrame:
    return d.embeddings.where("vec_id % 20 = 0")


@query("ret01_exact_knn", f"WITH {KNN}, r AS (SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS place FROM s) SELECT query_id, vec_id, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10")
def exact_knn(d: Data) -> DataFrame:
    return R.knn(queries_of(d), d.embeddings, 10).withColumn("score", F.round("score", 6))


@query("ret03_filtered_knn", f"WITH {KNN}, r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS place FROM s WHERE label = 3) SELECT query_id, vec_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5")
def filtered_knn(d: Data) -> DataFrame:
    return R.knn(queries_of(d), d.embeddings.where("label = 3"), 5).drop("score")


BM25 = r"""d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents), l AS (SELECT doc_id, len(t) AS n, t FROM d), g AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS term FROM benchmark),
w AS (SELECT doc_id, n, unnest(t) AS term FROM l), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT q.query_id, tf.doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM tf JOIN df ON df.term = tf.term JOIN q ON q.term = tf.term CROSS JOIN g GROUP BY q.query_id, tf.doc_id)"""


def best_documents(d: Data, k: int) -> DataFrame:
    """query_id, doc_id, score, s, rank of the k best documents of each benchmark item, from the inverted index."""
    asked = P.query_terms(d.benchmark, "item_id")
    best, _ = P.search(P.text_index(d.documents, "doc_id", only=asked), asked, k)
    return R.ranked(best.withColumn("s", F.round("score", 6)), "query_id", "s", "doc_id", k)


@query("ret05_bm25", f"WITH {BM25}, r AS (SELECT query_id, doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM b) SELECT query_id, doc_id, score FROM r WHERE r <= 10")
def bm25(d: Data) -> DataFrame:
    return best_documents(d, 10).select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query("ret05_postings_read")
def postings_read(d: Data) -> DataFrame:
    """How many postings of each question's terms a search for ten documents reads."""
    asked = P.query_terms(d.benchmark, "item_id")
    return P.search(P.text_index(d.documents, "doc_id", only=asked), asked, 10)[1]


@query("ret06_rank_fusion", f"""
WITH {BM25}, x AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank FROM b), y AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY len(t), doc_id) - 1 AS rank FROM b JOIN d USING (doc_id)),
z AS (SELECT * FROM x WHERE rank < 50 UNION ALL SELECT * FROM y WHERE rank < 50) SELECT query_id, doc_id, round(sum(1.0 / (61 + rank)), 8) AS score FROM z GROUP BY query_id, doc_id""")
def rank_fusion(d: Data) -> DataFrame:
    """The shortest of a query's documents are among the shortest of one of its terms."""
    asked = P.query_terms(d.benchmark, "item_id")
    index = P.text_index(d.documents, "doc_id", only=asked)
    x = R.ranked(P.search(index, asked, 50)[0].withColumn("s", F.round("score", 6)), "query_id", "s", "doc_id", 50)
    short = index.shortest(50).join(asked, "term").groupBy("query_id", "doc_id").agg((-F.min("len")).alias("short"))
    y = R.ranked(short, "query_id", "short", "doc_id", 50)
    return R.fused([x, y], "query_id", "doc_id").withColumn("score", F.round("score", 8))


@query("ret08_mmr")
def mmr(d: Data) -> DataFrame:
    near = R.knn(queries_of(d), d.embeddings, 50).join(d.embeddings.select("vec_id", "embedding"), "vec_id")
    return R.mmr(near, "query_id", "vec_id", "score", "embedding", 5)


@query("ret10_tiebreak", """
WITH r AS (SELECT s_suppkey, s_acctbal / 10000 AS final, s_nationkey AS pr FROM supplier), m AS (SELECT max(final) AS top, max(pr) AS most FROM r) SELECT s_suppkey, round(final + CASE WHEN top < 1.4 THEN 0.15 * pr / most ELSE 0 END, 6) AS final FROM r CROSS JOIN m""")
def tiebreak(d: Data) -> DataFrame:
    r = d.supplier.select("s_suppkey", (F.col("s_acctbal") / 10000).alias("final"), F.col("s_nationkey").alias("pr"))
    m = r.agg(F.max("final").alias("top"), F.max("pr").alias("most"))
    bonus = F.when(F.col("top") < 1.4, 0.15 * F.col("pr") / F.col("most")).otherwise(0.0)
    return r.crossJoin(F.broadcast(m)).select("s_suppkey", F.round(F.col("final") + bonus, 6).alias("final"))


@query("ret13_feedback_blend", """
WITH f AS (SELECT user_id, avg(latency_ms / 100) AS fb FROM kpi WHERE event_type = 'click' GROUP BY user_id) SELECT c_custkey, round(CASE WHEN fb IS NULL THEN c_acctbal / 10000 ELSE 0.8 * c_acctbal / 10000 + 0.2 * fb END, 6) AS score FROM customer LEFT JOIN f ON c_custkey = user_id""")
def feedback_blend(d: Data) -> DataFrame:
    f = d.kpi.where("event_type = 'click'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.avg(F.col("latency_ms") / 100).alias("fb"))
    base = F.col("c_acctbal") / 10000
    return d.customer.join(f, "c_custkey", "left").select("c_custkey", F.round(F.when(F.col("fb").isNull(), base).otherwise(0.8 * base + 0.2 * F.col("fb")), 6).alias("score"))


@query("ret14_route_choice", """
WITH s AS (SELECT tenant, event_type AS mode, count(*) AS n, avg(CASE WHEN latency_ms > 40 THEN 1.0 ELSE 0.0 END) - 0.1 * ln(1 + avg(latency_ms) / 1000) AS util FROM kpi GROUP BY tenant, event_type), m AS (SELECT tenant, max_by(mode, (round(util, 9), mode)) AS mode, count(*) AS k FROM s WHERE n >= 20 GROUP BY tenant)
SELECT tenant, CASE WHEN k >= 2 THEN mode ELSE 'default' END AS mode FROM m""")
def route_choice(d: Data) -> DataFrame:
    util = F.avg(F.when(F.col("latency_ms") > 40, 1.0).otherwise(0.0)) - 0.1 * F.log1p(F.avg("latency_ms") / 1000)
    s = d.kpi.groupBy("tenant", F.col("event_type").alias("mode")).agg(F.count("*").alias("n"), F.round(util, 9).alias("util")).where("n >= 20")
    return s.groupBy("tenant").agg(F.max_by("mode", F.struct("util", "mode")).alias("mode"), F.count("*").alias("k")).select("tenant", F.when(F.col("k") >= 2, F.col("mode")).otherwise("default").alias("mode"))


@query("ret15_metrics", f"""
WITH {KNN}, r AS (SELECT query_id, vec_id, label, ql, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS place FROM s), j AS (SELECT query_id, count(*) AS hits, min(place) AS first FROM r WHERE place <= 10 AND label = ql GROUP BY query_id), g AS (SELECT query_id, count(*) AS gold FROM s WHERE label = ql GROUP BY query_id)
SELECT round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(hits, 0) / 10.0), 6) AS prec, round(avg(coalesce(hits, 0) / CAST(gold AS DOUBLE)), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM g LEFT JOIN j ON j.query_id = g.query_id""")
def metrics(d: Data) -> DataFrame:
    lab = d.embeddings.select("vec_id", "label")
    q = queries_of(d).select(F.col("vec_id").alias("query_id"), "label")
    return R.label_metrics(R.knn(queries_of(d), d.embeddings, 10), q, lab, "query_id", "vec_id", "label", 10)


@query("ret17_recall_vs_gold", f"""
WITH {KNN}, g AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS p FROM s), a AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS p FROM s WHERE label = ql)
SELECT g.query_id, round(count(a.vec_id) / 10.0, 6) AS recall FROM g LEFT JOIN a ON a.query_id = g.query_id AND a.vec_id = g.vec_id AND a.p <= 10 WHERE g.p <= 10 GROUP BY g.query_id""")
def recall_vs_gold(d: Data) -> DataFrame:
    gold = R.knn(queries_of(d), d.embeddings, 10).select("query_id", "vec_id")
    got = R.knn(queries_of(d), d.embeddings, 10, within="label").select("query_id", "vec_id", F.lit(1).alias("hit"))
    return gold.join(got, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / 10, 6).alias("recall"))


@query("ret18_grid_search", """
WITH g AS (SELECT a / 4.0 AS alpha FROM range(5) t(a)), s AS (SELECT alpha, avg(abs(alpha * s_acctbal / 10000 + (1 - alpha) * s_nationkey / 25 - 0.5)) AS loss FROM supplier CROSS JOIN g GROUP BY alpha) SELECT round(alpha, 4) AS alpha, round(loss, 6) AS loss FROM s ORDER BY round(loss, 9), alpha LIMIT 1""")
def grid_search(d: Data) -> DataFrame:
    g = d.supplier.select("s_acctbal", "s_nationkey", F.explode(F.array(*[F.lit(a / 4.0) for a in range(5)])).alias("alpha"))
    a = F.col("alpha")
    s = g.groupBy("alpha").agg(F.avg(F.abs(a * F.col("s_acctbal") / 10000 + (1 - a) * F.col("s_nationkey") / 25 - 0.5)).alias("loss"))
    return s.orderBy(F.round("loss", 9), "alpha").limit(1).select(F.round("alpha", 4).alias("alpha"), F.round("loss", 6).alias("loss"))


@query("ret19_ablation", "SELECT o_orderpriority AS profile, o_orderstatus AS kind, round(avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def ablation(d: Data) -> DataFrame:
    return d.orders.cube(F.col("o_orderpriority").alias("profile"), F.col("o_orderstatus").alias("kind")).agg(F.round(F.avg(F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0)), 6).alias("recall"), F.count("*").alias("n"))


@query("ret20_claim_selection", """
WITH s AS (SELECT subject, claim_id, 0.5 * least(1.0, amount / 500000) + 0.3 / (1 + date_diff('day', valid_from, DATE '2001-12-31') / 30.0) + 0.2 * CASE object WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.0 END AS score FROM claims), r AS (SELECT subject, claim_id, round(score, 4) AS score, row_number() OVER (PARTITION BY subject ORDER BY round(score, 9) DESC, claim_id) AS r FROM s)
SELECT subject, claim_id, score FROM r WHERE r <= 3""")
def claim_selection(d: Data) -> DataFrame:
    from graphloom.functions.dates import recency

    age = F.datediff(F.lit("2001-12-31").cast("date"), "valid_from")
    standing = F.when(F.col("object") == "F", 1.0).when(F.col("object") == "O", 0.5).otherwise(0.0)
    score = 0.5 * F.least(F.lit(1.0), F.col("amount") / 500000) + 0.3 * recency(age) + 0.2 * standing
    return R.ranked(d.claims.withColumn("score", score).withColumn("s", F.round("score", 9)), "subject", "s", "claim_id", 3).select("subject", "claim_id", F.round("score", 4).alias("score"))


@query("ret21_precedents", """
WITH o AS (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS same, max(o_totalprice) / 500000 AS outcome, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' THEN 0.0 END) AS fb FROM orders GROUP BY o_custkey)
SELECT o_custkey, round(0.65 * same + 0.2 * outcome + 0.15 * coalesce(fb, 0.5), 4) AS score FROM o""")
def precedents(d: Data) -> DataFrame:
    o = d.orders.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)).alias("same"), (F.max("o_totalprice") / 500000).alias("outcome"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)).alias("fb"))
    return o.select("o_custkey", F.round(0.65 * F.col("same") + 0.2 * F.col("outcome") + 0.15 * F.coalesce("fb", F.lit(0.5)), 4).alias("score"))


@query("ret22_sparse_dot", """
WITH p AS (SELECT l_orderkey AS a, l_suppkey % 20 AS dim, max(ln(1 + l_quantity)) AS w FROM lineitem GROUP BY 1, 2), q AS (SELECT * FROM p WHERE a % 20 = 0), s AS (SELECT q.a AS query_id, p.a AS doc_id, round(sum(q.w * p.w), 5) AS score FROM q JOIN p ON p.dim = q.dim AND p.a <> q.a GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s) SELECT query_id, doc_id, score FROM r WHERE r <= 10""")
def sparse_dot(d: Data) -> DataFrame:
    """Orders as sparse vectors over 20 dimensions; orders divisible by 20 ask all others for their ten best."""
    p = d.lineitem.groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 20).alias("dim")).agg(F.max(F.log1p("l_quantity")).alias("w"))
    return R.sparse_search(p.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), p, 10)


@query("mth01_cosine_to_first", f"WITH {UNIT} SELECT u.vec_id, round(greatest(0.0, least(1.0, list_inner_product(u.e, f.e))), 6) AS similarity FROM u CROSS JOIN (SELECT e FROM u WHERE vec_id = 0) f")
def cosine(d: Data) -> DataFrame:
    first = d.embeddings.where("vec_id = 0").select(R.unit(F.col("embedding")).alias("f"))
    s = R.dot(R.unit(F.col("embedding")), F.col("f"))
    return d.embeddings.crossJoin(F.broadcast(first)).select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 6).alias("similarity"))


@query("mth02_l2_to_first", "WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings) SELECT v.vec_id, round(1 / (1 + sqrt(greatest(0, list_inner_product(v.e, v.e) + list_inner_product(f.e, f.e) - 2 * list_inner_product(v.e, f.e)))), 5) AS similarity FROM v CROSS JOIN (SELECT e FROM v WHERE vec_id = 1) f WHERE v.vec_id <> 1")
def l2(d: Data) -> DataFrame:
    first = d.embeddings.where("vec_id = 1").select(F.col("embedding").alias("f"))
    square = F.aggregate(F.zip_with("embedding", "f", lambda a, b: (a.cast("double") - b.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    return d.embeddings.where("vec_id <> 1").crossJoin(F.broadcast(first)).select("vec_id", F.round(1 / (1 + F.sqrt(square)), 5).alias("similarity"))


@query("mth04_drift", "SELECT o_orderpriority, round(0.4 * abs(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) - count(CASE WHEN o_orderstatus = 'O' THEN 1 END)) / CAST(count(*) AS DOUBLE) + 0.6 * abs(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)) / CAST(count(*) AS DOUBLE), 4) AS drift FROM orders GROUP BY 1")
def drift(d: Data) -> DataFrame:
    n, of = F.count("*"), lambda s: F.count_if(F.col("o_orderstatus") == s)
    return d.orders.groupBy("o_orderpriority").agg(F.round(0.4 * F.abs(of("F") - of("O")) / n + 0.6 * of("P") / n, 4).alias("drift"))


@query("top05_per_query", f"WITH {KNN}, r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS place FROM s) SELECT query_id, min(vec_id) AS least, max(vec_id) AS most FROM r WHERE place <= 3 GROUP BY query_id")
def per_query(d: Data) -> DataFrame:
    return R.knn(queries_of(d), d.embeddings, 3).groupBy("query_id").agg(F.min("vec_id").alias("least"), F.max("vec_id").alias("most"))


@query("jon19_blocks_of_queries", f"WITH {KNN} SELECT query_id, round(max(score), 6) AS best FROM s GROUP BY query_id")
def blocks_of_queries(d: Data) -> DataFrame:
    return R.knn(queries_of(d), d.embeddings, 1).select("query_id", F.round("score", 6).alias("best"))
