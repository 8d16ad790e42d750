"""Signals of deals, what shares led to, and the objection that a recommendation answers."""

from datetime import date

from pyspark.sql import functions as F

from graphloom.operators import sales


def day(n):
    return date(2024, 1, n)


def test_effectiveness(spark):
    shares = spark.createDataFrame([("d", 1, "a", day(5)), ("d", 2, "b", day(1)), ("d", 3, "a", day(20)), ("e", 4, "a", day(5))], "deal string, share int, asset string, shared date")
    views = spark.createDataFrame([("d", "a", day(4)), ("d", "a", day(5)), ("d", "a", day(9)), ("e", "b", day(9))], "deal string, asset string, seen date")
    changes = spark.createDataFrame([("d", 1, day(3), "NEW", "DEMO"), ("d", 2, day(5), "DEMO", "OFFER"), ("d", 3, day(20), "OFFER", "WON")], "deal string, seq int, changed date, before string, stage string")
    got = {r.share: (r.opened, r.opened_at, r.stage_at_share, r.latest_stage, r.advanced) for r in sales.effectiveness(shares, views, changes).collect()}
    assert got == {1: (True, day(5), "OFFER", "WON", True), 2: (False, None, "NEW", "WON", True), 3: (False, None, "WON", "WON", False), 4: (False, None, None, None, False)}


def test_latest_objection(spark):
    calls = spark.createDataFrame([("d", 1, day(1)), ("d", 2, day(9)), ("e", 3, day(1)), ("f", 4, day(1))], "deal string, call int, at date")
    row = lambda call, claim, said, **k: (call, claim, k.get("predicate", "RAISED_OBJECTION"), k.get("polarity", "AFFIRMED"), k.get("status"), k.get("speaker", "BUYER"), day(said), k.get("value", " Price "))
    claims = [row(1, 10, 30), row(2, 11, 3, value=None), row(2, 12, 2), row(2, 13, 9, status="REJECTED"), row(2, 14, 9, speaker="SELLER"), row(2, 15, 9, polarity="NEGATED"), row(2, 16, 9, predicate="OTHER"), row(4, 17, 1)]
    df = spark.createDataFrame(claims, "call int, claim int, predicate string, polarity string, status string, speaker string, said date, value string")
    assert {tuple(r) for r in sales.latest_objection(calls, df).collect()} == {("d", 2, 11, ""), ("f", 4, 17, "price")}


def test_signals(spark):
    parties = spark.createDataFrame([("d", "x", True), ("d", "x", True), ("d", "s", False), ("e", "x", True), ("e", "y", True), ("f", "s", False)], "deal string, party string, buyer boolean")
    objections = spark.createDataFrame([("d", 1), ("d", 2), ("e", 3)], "deal string, claim int")
    shares = spark.createDataFrame([("d", 10, day(1), None, 1), ("d", 11, day(24), None, None), ("e", 12, day(1), day(3), 3)], "deal string, share int, shared date, opened_at date, triggered_by int")
    conflicts = spark.createDataFrame([("d", 1, 2, "OPEN"), ("e", 3, 4, "RESOLVED")], "deal string, id_a int, id_b int, status string")
    changes = spark.createDataFrame([("d", day(2)), ("d", day(9)), ("e", day(1)), ("e", day(25))], "deal string, changed date")
    got = {tuple(r) for r in sales.signals(parties, objections, shares, conflicts, changes, F.lit("2024-01-30").cast("date")).collect()}
    assert got == {("d", "single_threaded_deal", None), ("d", "objection_without_follow_up", "2"), ("d", "shared_content_never_opened", "10"), ("d", "unresolved_conflict", "1 2"), ("d", "stalled_deal", None)}
