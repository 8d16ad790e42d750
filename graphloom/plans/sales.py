"""Sales queries (SAL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import sales as S
from graphloom.plans.registry import query
from graphloom.session import Data


@query("sal01_top_objections", "SELECT o_orderpriority AS objection, count(*) AS n, min(o_orderkey) AS first_id FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 ORDER BY n DESC, objection LIMIT 3")
def top_objections(d: Data) -> DataFrame:
    o = d.orders.where("o_orderstatus <> 'P'").groupBy(F.col("o_orderpriority").alias("objection")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"))
    return o.orderBy(F.desc("n"), "objection").limit(3)


#: What is told to a customer: lines of flag A are shares (an answer to the line before), N are views, R are claims of a call.
LINES = """lines AS (SELECT o_custkey AS deal, l_orderkey AS call, l_orderkey * 10 + l_linenumber AS id, l_linenumber AS n, l_partkey AS asset, CAST(l_shipdate AS DATE) AS told, l_returnflag AS flag, l_suppkey AS party, l_discount AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
shares AS (SELECT DISTINCT deal, id AS share, asset, told AS shared, id - 1 AS triggered_by FROM lines WHERE flag = 'A'), views AS (SELECT deal, asset, told AS seen FROM lines WHERE flag = 'N')"""


def lines(d: Data) -> DataFrame:
    j = d.spread(d.lineitem, "l_orderkey").join(d.spread(d.orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_custkey").alias("deal"), F.col("l_orderkey").alias("call"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("asset"), F.col("l_shipdate").cast("date").alias("at"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("party"), F.col("l_discount").alias("discount"))


def shares_of(d: Data) -> DataFrame:
    return d.spread(lines(d).where("flag = 'A'").select("deal", F.col("id").alias("share"), "asset", F.col("at").alias("shared"), (F.col("id") - 1).alias("triggered_by")), "deal", "share").distinct()


def views_of(d: Data) -> DataFrame:
    return lines(d).where("flag = 'N'").select("deal", "asset", F.col("at").alias("seen"))


@query("sal02_content_effectiveness", f"""
WITH {LINES}, o AS (SELECT s.deal, share, s.asset, shared, min(seen) FILTER (WHERE seen >= shared) AS opened_at FROM shares s LEFT JOIN views v ON v.deal = s.deal AND v.asset = s.asset GROUP BY s.deal, share, s.asset, shared),
a AS (SELECT s.deal, shared, max_by(stage, (changed, seq)) AS stage FROM (SELECT DISTINCT deal, shared FROM shares) s JOIN changes c ON c.deal = s.deal AND changed <= shared GROUP BY s.deal, shared), e AS (SELECT deal, max_by(stage, (changed, seq)) AS latest_stage, max(changed) AS last FROM changes GROUP BY deal)
SELECT o.deal, o.share, o.asset, opened_at IS NOT NULL AS opened, CAST(opened_at AS VARCHAR) AS opened_at, coalesce(stage, 'NEW') AS stage_at_share, latest_stage, coalesce(last > o.shared, false) AS advanced FROM o LEFT JOIN a ON a.deal = o.deal AND a.shared = o.shared LEFT JOIN e ON e.deal = o.deal""")
def content_effectiveness(d: Data) -> DataFrame:
    w = Window.partitionBy("deal").orderBy("changed", "seq")
    changes = d.changes.withColumn("before", F.coalesce(F.lag("stage").over(w), F.lit("NEW")))
    return S.effectiveness(shares_of(d), views_of(d), changes, d.spread).withColumn("opened_at", F.col("opened_at").cast("string")).drop("shared", "triggered_by")


@query("sal03_recommendation", f"""
WITH {LINES}, l AS (SELECT o_custkey AS deal, max_by(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS call FROM orders GROUP BY o_custkey),
c AS (SELECT l.deal, max_by(CAST(asset % 5 + 1 AS VARCHAR), (told, id)) AS t FROM l JOIN lines x ON x.call = l.call WHERE flag = 'R' AND discount <= 0.08 AND n % 2 = 1 GROUP BY l.deal), a AS (SELECT p_partkey AS asset, p_name AS title, CAST(p_size % 5 + 1 AS VARCHAR) AS t FROM part),
r AS (SELECT c.deal, a.asset, 1 AS matches, row_number() OVER (PARTITION BY c.deal ORDER BY title, a.asset) AS r FROM c JOIN a USING (t) WHERE NOT EXISTS (SELECT 1 FROM views WHERE views.deal = c.deal AND views.asset = a.asset)) SELECT deal, asset, matches FROM r WHERE r <= 3""")
def recommendation(d: Data) -> DataFrame:
    x = lines(d)
    calls = d.orders.select(F.col("o_custkey").alias("deal"), F.col("o_orderkey").alias("call"), F.col("o_orderdate").cast("date").alias("at"))
    when = lambda c, a, b: F.when(c, a).otherwise(b)
    claims = x.select("call", F.col("id").alias("claim"), when(F.col("flag") == "R", "RAISED_OBJECTION", "OTHER").alias("predicate"), when(F.col("discount") <= 0.08, "AFFIRMED", "NEGATED").alias("polarity"), F.lit(None).cast("string").alias("status"), when(F.col("n") % 2 == 1, "BUYER", "SELLER").alias("speaker"), F.col("at").alias("said"), (F.col("asset") % 5 + 1).cast("string").alias("value"))
    needs = S.latest_objection(calls, claims).select("deal", F.array("category").alias("tags"))
    assets = d.part.select(F.col("p_partkey").alias("asset"), F.col("p_name").alias("title"), F.array((F.col("p_size") % 5 + 1).cast("string")).alias("tags"))
    return S.recommendation(needs, assets, views_of(d), "deal", "tags", "asset", "title", 3)


@query("sal04_committee", "SELECT conv_id, count(DISTINCT CASE WHEN role = 'user' THEN turn END) AS buyers, CASE WHEN count(DISTINCT CASE WHEN role = 'user' THEN turn END) = 0 THEN 'uncovered' WHEN count(DISTINCT CASE WHEN role = 'user' THEN turn END) = 1 THEN 'single_threaded' ELSE 'multi_threaded' END AS shape FROM conversations GROUP BY conv_id")
def committee(d: Data) -> DataFrame:
    return S.committee(d.conversations, "conv_id", "turn", F.col("role") == "user")


def found_signals(d: Data) -> DataFrame:
    x = lines(d)
    opened = S.effectiveness(shares_of(d), views_of(d), d.changes.withColumn("before", F.lit("NEW")), d.spread)
    both = d.claims.where("object IN ('F', 'O')").groupBy("subject", "predicate").agg(F.min(F.when(F.col("object") == "F", F.col("claim_id"))).alias("id_a"), F.min(F.when(F.col("object") == "O", F.col("claim_id"))).alias("id_b")).where("id_a IS NOT NULL AND id_b IS NOT NULL")
    conflicts = both.select(F.col("subject").alias("deal"), "id_a", "id_b", F.when((F.col("id_a") + F.col("id_b")) % 2 == 0, "OPEN").otherwise("RESOLVED").alias("status"))
    parties = x.select("deal", "party", (F.col("flag") == "A").alias("buyer"))
    objections = x.where("flag = 'R' AND discount >= 0.09").select("deal", F.col("id").alias("claim"))
    return S.signals(parties, objections, opened, conflicts, d.changes, F.lit("2001-08-02").cast("date"), deal=d.spread)


SIGNALS = LINES + """, cf AS (SELECT subject, min(claim_id) FILTER (WHERE object = 'F') AS a, min(claim_id) FILTER (WHERE object = 'O') AS b FROM claims GROUP BY subject, predicate),
g AS (SELECT deal, 'single_threaded_deal' AS signal, NULL AS evidence FROM lines GROUP BY deal HAVING count(DISTINCT CASE WHEN flag = 'A' THEN party END) = 1
UNION ALL SELECT deal, 'objection_without_follow_up', CAST(id AS VARCHAR) FROM lines WHERE flag = 'R' AND discount >= 0.09 AND id NOT IN (SELECT triggered_by FROM shares)
UNION ALL SELECT deal, 'shared_content_never_opened', CAST(share AS VARCHAR) FROM shares s WHERE date_diff('day', shared, DATE '2001-08-02') >= 7 AND NOT EXISTS (SELECT 1 FROM views v WHERE v.deal = s.deal AND v.asset = s.asset AND seen >= shared)
UNION ALL SELECT subject, 'unresolved_conflict', concat(a, ' ', b) FROM cf WHERE a IS NOT NULL AND b IS NOT NULL AND (a + b) % 2 = 0
UNION ALL SELECT deal, 'stalled_deal', NULL FROM changes GROUP BY deal HAVING date_diff('day', max(changed), DATE '2001-08-02') >= 21)"""


@query("sal05_signals", f"WITH {SIGNALS} SELECT deal, signal, evidence FROM g")
def signals(d: Data) -> DataFrame:
    return found_signals(d)


@query("sal06_digest", f"WITH {SIGNALS} SELECT c_nationkey AS seller, count(DISTINCT deal) AS deals, count(*) AS signals FROM g JOIN customer ON c_custkey = deal GROUP BY c_nationkey")
def digest(d: Data) -> DataFrame:
    j = found_signals(d).join(d.customer.select(F.col("c_custkey").alias("deal"), F.col("c_nationkey").alias("seller")), "deal")
    return j.groupBy("seller").agg(F.count_distinct("deal").alias("deals"), F.count("*").alias("signals"))


@query("sal07_call_briefing", "SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, count(CASE WHEN contains(text, '?') THEN 1 END) AS questions FROM conversations GROUP BY conv_id")
def call_briefing(d: Data) -> DataFrame:
    return d.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.count_if(F.col("text").contains("?")).alias("questions"))


@query("sal09_readiness", "SELECT c_mktsegment, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS readiness, round(sum(o_totalprice), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def readiness(d: Data) -> DataFrame:
    j = d.customer.join(d.orders, F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("c_mktsegment").agg(F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 6).alias("readiness"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("sal10_grounding", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS grounded FROM orders")
def grounding(d: Data) -> DataFrame:
    k = F.col("o_orderkey")
    a = d.orders.select("o_orderkey", F.array(k, F.when(k % 3 == 0, k + 1).otherwise(k)).alias("cited"), F.array(k, k - 1).alias("allowed"))
    return a.select("o_orderkey", S.grounded(a, "cited", "allowed").alias("grounded"))


CLAIMS = """cl AS (SELECT o_custkey AS deal, o_orderkey AS claim, CASE left(o_orderpriority, 1) WHEN '1' THEN 'RAISED_OBJECTION' WHEN '2' THEN 'HAS_BLOCKER' WHEN '3' THEN 'HAS_ACTION_ITEM' ELSE 'MENTIONED' END AS predicate, CASE WHEN o_orderkey % 7 = 0 THEN 'NEGATED' ELSE 'AFFIRMED' END AS polarity, CASE WHEN o_orderstatus = 'P' THEN 'REJECTED' WHEN o_orderstatus = 'F' THEN 'APPROVED' END AS status, o_orderdate AS said FROM orders)"""


def deal_claims(d: Data) -> DataFrame:
    k = F.left("o_orderpriority", F.lit(1))
    predicate = F.when(k == "1", "RAISED_OBJECTION").when(k == "2", "HAS_BLOCKER").when(k == "3", "HAS_ACTION_ITEM").otherwise("MENTIONED")
    return d.orders.select(F.col("o_custkey").alias("deal"), F.col("o_orderkey").alias("claim"), predicate.alias("predicate"), F.when(F.col("o_orderkey") % 7 == 0, "NEGATED").otherwise("AFFIRMED").alias("polarity"), F.when(F.col("o_orderstatus") == "P", "REJECTED").when(F.col("o_orderstatus") == "F", "APPROVED").alias("status"), F.col("o_orderdate").alias("at"), F.col("o_orderdate").alias("recorded"))


@query("sal07_deal_answers", f"""
WITH {CLAIMS}, live AS (SELECT * FROM cl WHERE polarity = 'AFFIRMED' AND coalesce(status, '') <> 'REJECTED')
SELECT 'objections' AS intent, deal, claim, row_number() OVER (PARTITION BY deal ORDER BY said DESC, claim) AS place FROM live WHERE predicate = 'RAISED_OBJECTION' UNION ALL SELECT 'commitments', deal, claim, row_number() OVER (PARTITION BY deal ORDER BY said DESC, claim) FROM live WHERE predicate = 'HAS_ACTION_ITEM'
UNION ALL SELECT 'new', deal, claim, row_number() OVER (PARTITION BY deal ORDER BY said DESC, claim) FROM cl WHERE said >= TIMESTAMP '1998-01-01' UNION ALL SELECT 'briefing:' || s, deal, claim, row_number() OVER (PARTITION BY deal, s ORDER BY said DESC, claim) FROM (SELECT *, CASE predicate WHEN 'RAISED_OBJECTION' THEN 'objection' WHEN 'HAS_BLOCKER' THEN 'blocker' WHEN 'HAS_ACTION_ITEM' THEN 'action_item' ELSE 'other' END AS s FROM cl)""")
def deal_answers(d: Data) -> DataFrame:
    """What four of the catalogue's intents answer, for every deal."""
    c = deal_claims(d)
    found = {"objections": S.open_claims(c, "RAISED_OBJECTION"), "commitments": S.open_claims(c, "HAS_ACTION_ITEM"), "new": S.whats_new(c, F.lit("1998-01-01").cast("timestamp_ntz"))}
    out = S.briefing(c).select(F.concat(F.lit("briefing:"), "section").alias("intent"), "deal", "claim", "place")
    for intent, df in found.items():
        out = out.unionByName(df.select(F.lit(intent).alias("intent"), "deal", "claim", "place"))
    return out


@query("sal10_narratives", r"""
WITH o AS (SELECT o_orderkey AS k, 'Claim [' || CAST(o_orderkey AS VARCHAR) || '] stands. It was seen before! ' || CASE WHEN o_orderkey % 3 = 0 THEN 'So does [' || CAST(o_orderkey + 1 AS VARCHAR) || '] and [x].' ELSE '' END AS t FROM orders)
SELECT k, k % 3 <> 0 AS grounded, CASE WHEN k % 3 = 0 THEN CAST(k + 1 AS VARCHAR) || ',x' ELSE '' END AS unknown, 1 AS uncited FROM o""")
def narratives(d: Data) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Claim ["), k.cast("string"), F.lit("] stands. It was seen before! "), F.when(k % 3 == 0, F.concat(F.lit("So does ["), (k + 1).cast("string"), F.lit("] and [x]."))).otherwise(""))
    n = S.narrative(text, F.array(k.cast("string"), (k - 1).cast("string")))
    return d.orders.select(k.alias("k"), n.alias("n")).select("k", "n.grounded", F.array_join("n.unknown", ",").alias("unknown"), "n.uncited")


@query("sal08_dispatch", """
WITH q AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'account-objections' WHEN 1 THEN 'open-commitments' WHEN 2 THEN 'call-briefing' WHEN 3 THEN 'whats-new' WHEN 4 THEN 'as-of' WHEN 5 THEN 'top-objections' WHEN 6 THEN 'buying-committee' WHEN 7 THEN 'recommend-content' ELSE 'sing-a-song' END AS intent, (event_id * 7) % 100 / 100.0 AS confidence, CASE event_id % 4 WHEN 0 THEN 'opportunity_id' WHEN 1 THEN 'subject_id,since,as_of' WHEN 2 THEN 'opportunity_id,buyer_contact_id' ELSE '' END AS given FROM events),
c(intent, needs, hidden) AS (VALUES ('account-objections', 'opportunity_id', false), ('open-commitments', 'opportunity_id', false), ('call-briefing', '', false), ('whats-new', 'subject_id,since', false), ('as-of', 'subject_id,as_of', false), ('top-objections', 'seller_id', false), ('buying-committee', 'opportunity_id', true), ('recommend-content', 'opportunity_id,buyer_contact_id', false))
SELECT event_id, CASE WHEN c.intent IS NULL OR hidden THEN 'refused: unknown intent' WHEN confidence < 0.5 THEN 'refused: not sure' WHEN len(list_filter(string_split(needs, ','), lambda n: n <> '' AND NOT list_contains(string_split(given, ','), n))) > 0 THEN 'refused: parameters missing' ELSE c.intent END AS outcome FROM q LEFT JOIN c ON c.intent = q.intent""")
def dispatch(d: Data) -> DataFrame:
    """Classified questions, one an event, against the catalogue."""
    from graphloom.operators.intents import dispatched

    k, g = F.col("event_id") % 9, F.col("event_id") % 4
    intent = F.when(k == 0, "account-objections").when(k == 1, "open-commitments").when(k == 2, "call-briefing").when(k == 3, "whats-new").when(k == 4, "as-of").when(k == 5, "top-objections").when(k == 6, "buying-committee").when(k == 7, "recommend-content").otherwise("sing-a-song")
    given = F.when(g == 0, F.array(F.lit("opportunity_id"))).when(g == 1, F.array(F.lit("subject_id"), F.lit("since"), F.lit("as_of"))).when(g == 2, F.array(F.lit("opportunity_id"), F.lit("buyer_contact_id"))).otherwise(F.array().cast("array<string>"))
    asked = d.events.select("event_id", intent.alias("intent"), ((F.col("event_id") * 7) % 100 / 100).alias("confidence"), given.alias("given"))
    return dispatched(asked).select("event_id", "outcome")
