"""Pipeline and content analytics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def committee(parties: DataFrame, deal: str, party: str, buyer: Column) -> DataFrame:
    """(deal, buyers, shape): distinct buyers of each deal; one is single_threaded, none is uncovered."""
    n = F.count_distinct(F.when(buyer, F.col(party)))
    return parties.groupBy(deal).agg(n.alias("buyers")).withColumn("shape", F.when(F.col("buyers") == 0, "uncovered").when(F.col("buyers") == 1, "single_threaded").otherwise("multi_threaded"))


def _signal(df: DataFrame, name: str, deal: str, evidence: Column) -> DataFrame:
    return df.select(F.col(deal).alias("deal"), F.lit(name).alias("signal"), evidence.cast("string").alias("evidence"))


def signals(parties: DataFrame, objections: DataFrame, shares: DataFrame, conflicts: DataFrame, changes: DataFrame, now: Column, stale: int = 7, stalled: int = 21, deal: Callable[..., DataFrame] = lambda df, *keys: df) -> DataFrame:
    """(deal, signal, evidence) of the five kinds: one buyer alone on all calls of a deal; an objection that no share answers; what was
    shared ``stale`` days ago or earlier and never opened; a conflict that is open; no change of stage for ``stalled`` days, where
    there was one at all. Evidence is the claim, the share, the two claims, or null.

    parties: deal, party, buyer; objections: deal, claim; shares: deal, share, shared, opened_at, triggered_by; conflicts: deal, id_a,
    id_b, status; changes: deal, changed. Each kind is one aggregation, or one anti join. ``deal`` (a table, its keys) may deal rows over more tasks.
    """
    alone = committee(deal(parties, "deal", "party"), "deal", "party", F.col("buyer")).where("shape = 'single_threaded'")
    answered = deal(shares.select(F.col("triggered_by").alias("claim")).where("claim IS NOT NULL"), "claim").distinct()
    last = changes.groupBy("deal").agg(F.max("changed").alias("last")).where(F.datediff(now, "last") >= stalled)
    found = [
        _signal(alone, "single_threaded_deal", "deal", F.lit(None)),
        _signal(deal(objections, "claim").join(answered, "claim", "left_anti"), "objection_without_follow_up", "deal", F.col("claim")),
        _signal(shares.where(F.col("opened_at").isNull() & (F.datediff(now, "shared") >= stale)), "shared_content_never_opened", "deal", F.col("share")),
        _signal(conflicts.where("status = 'OPEN'"), "unresolved_conflict", "deal", F.concat_ws(" ", F.col("id_a").cast("string"), F.col("id_b").cast("string"))),
        _signal(last, "stalled_deal", "deal", F.lit(None)),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def latest_objection(calls: DataFrame, claims: DataFrame) -> DataFrame:
    """(deal, call, claim, category): of each deal's latest call, the latest objection that a buyer affirmed and nobody rejected. calls:
    deal, call, at; claims: call, claim, predicate, polarity, status, speaker, said, value. Deals without one have no row."""
    last = calls.groupBy("deal").agg(F.max_by("call", F.struct("at", "call")).alias("call"))
    own = claims.where("predicate = 'RAISED_OBJECTION' AND polarity = 'AFFIRMED' AND coalesce(status, '') <> 'REJECTED' AND speaker = 'BUYER'")
    one = own.groupBy("call").agg(F.max_by(F.struct("claim", F.lower(F.trim(F.coalesce("value", F.lit("")))).alias("category")), F.struct("said", "claim")).alias("m"))
    return last.join(one, "call").select("deal", "call", "m.claim", "m.category")


def effectiveness(shares: DataFrame, views: DataFrame, changes: DataFrame, deal: Callable[..., DataFrame] = lambda df, *keys: df) -> DataFrame:
    """``shares`` with opened, opened_at, stage_at_share, latest_stage, advanced: the first view at or after it, the stage it
    met (the one before the first later change if there was none yet), and whether the stage changed afterwards.

    shares: deal, share, asset, shared; views: deal, asset, seen; changes: deal, seq, changed, before, stage.
    """
    from graphloom.operators.joins import asof, exists_after

    seen = exists_after(shares, views, ["deal", "asset"], "shared", "seen", "opened_at", deal)
    at = asof(seen, changes, ["deal"], "shared", "changed", "stage", "seq", deal)
    ends = changes.groupBy("deal").agg(F.max_by("stage", F.struct("changed", "seq")).alias("latest_stage"), F.max("changed").alias("_last"), F.min_by("before", F.struct("changed", "seq")).alias("_first"))
    j = at.join(ends, "deal", "left")
    return j.select(*shares.columns, F.col("opened_at").isNotNull().alias("opened"), "opened_at", F.coalesce("stage", "_first").alias("stage_at_share"), "latest_stage", F.coalesce(F.col("_last") > F.col("shared"), F.lit(False)).alias("advanced"))


def recommendation(needs: DataFrame, assets: DataFrame, seen: DataFrame, key: str, tags: str, asset: str, title: str, k: int) -> DataFrame:
    """(key, asset, matches): assets that share most tags with a need and weren't seen; ties by title, then asset.

    Assets are ranked once for each distinct set of tags; a key looks at as many of its set's ranks as it has seen assets, and k
    more, so nothing grows with keys times assets.
    """
    from pyspark.sql.window import Window

    n = needs.select(key, F.array_sort(F.array_distinct(tags)).alias("_set"))
    sets = n.select("_set").distinct().select("_set", F.explode("_set").alias("_t"))
    a = assets.select(asset, title, F.explode(F.array_distinct(tags)).alias("_t"))
    m = sets.join(a, "_t").groupBy("_set", asset, title).agg(F.count("*").alias("matches"))
    ranked = m.withColumn("_r", F.row_number().over(Window.partitionBy("_set").orderBy(F.desc("matches"), title, asset)))
    had = seen.select(key, asset).distinct()
    looks = n.join(had.groupBy(key).agg(F.count("*").alias("_n")), key, "left").select(key, "_set", F.explode(F.sequence(F.lit(1), (k + F.coalesce("_n", F.lit(0))).cast("int"))).alias("_r"))
    new = looks.join(ranked, ["_set", "_r"]).join(had, [key, asset], "left_anti")
    w = Window.partitionBy(key).orderBy("_r")
    return new.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).select(key, asset, "matches")


#: Predicates that a briefing shows apart.
HIGHLIGHTED = {"RAISED_OBJECTION": "objection", "HAS_BLOCKER": "blocker", "HAS_ACTION_ITEM": "action_item"}


def briefing(claims: DataFrame) -> DataFrame:
    """(deal, section, claim, place): the claims of each deal by what they are, the latest first. claims: deal, claim, predicate, at."""
    from pyspark.sql.window import Window

    section = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HIGHLIGHTED.items() for x in kv]), F.col("predicate")), F.lit("other"))
    w = Window.partitionBy("deal", "section").orderBy(F.desc("at"), "claim")
    return claims.withColumn("section", section).select("deal", "section", "claim", F.row_number().over(w).alias("place"))


def open_claims(claims: DataFrame, predicate: str) -> DataFrame:
    """(deal, claim, place) of the affirmed claims with a predicate that nobody rejected, the latest first: objections, commitments.
    claims: deal, claim, predicate, polarity, status, at."""
    from pyspark.sql.window import Window

    live = claims.where((F.col("predicate") == predicate) & (F.col("polarity") == "AFFIRMED") & (F.coalesce("status", F.lit("")) != "REJECTED"))
    return live.select("deal", "claim", F.row_number().over(Window.partitionBy("deal").orderBy(F.desc("at"), "claim")).alias("place"))


def whats_new(claims: DataFrame, since: Column) -> DataFrame:
    """(deal, claim, place) of claims recorded since a moment, the latest record first. claims: deal, claim, recorded."""
    from pyspark.sql.window import Window

    return claims.where(F.col("recorded") >= since).select("deal", "claim", F.row_number().over(Window.partitionBy("deal").orderBy(F.desc("recorded"), "claim")).alias("place"))


def cited(text: Column) -> Column:
    """What a narrative cites in brackets, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([^\[\]]+)\]"), F.lit(1)))


def narrative(text: Column, allowed: Column) -> Column:
    """struct(grounded, unknown, uncited): whether all that is cited is allowed, what isn't (sorted), and how many sentences cite
    nothing. A narrative without citations is grounded and has only uncited sentences."""
    unknown = F.array_sort(F.array_except(cited(text), allowed))
    sentences = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    return F.struct((F.size(unknown) == 0).alias("grounded"), unknown.alias("unknown"), F.size(F.filter(sentences, lambda s: ~s.rlike(r"\[([^\[\]]+)\]"))).alias("uncited"))


def grounded(answers: DataFrame, cited: str, allowed: str) -> Column:
    """Whether every cited id is allowed; an answer without citations isn't grounded."""
    return (F.size(cited) > 0) & (F.size(F.array_except(cited, allowed)) == 0)
