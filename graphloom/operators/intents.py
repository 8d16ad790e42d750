"""A closed set of questions, each answered by a fixed plan; anything else is refused."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 100


def _ranked(relations: DataFrame, limit: int, rel: str, end: str) -> DataFrame:
    return relations.where(F.col("rel") == rel).groupBy(F.col(end).alias("answer")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "answer").limit(limit)


INTENTS: list[tuple[str, Callable[[DataFrame, int], DataFrame]]] = [
    (r"places have the most located", lambda r, n: _ranked(r, n, "LOCATED_IN", "tgt")),
    (r"regions have the most nations", lambda r, n: _ranked(r, n, "PART_OF", "tgt")),
    (r"entities are located nowhere", lambda r, n: r.select("src").subtract(r.where("rel = 'LOCATED_IN'").select("src")).select(F.col("src").alias("answer"), F.lit(0).cast("long").alias("n")).orderBy("answer").limit(n)),
]


def routed(question: str) -> Column:
    """The place of the first intent that a question in a column matches; null: it is refused."""
    out = F.lit(None).cast("int")
    for k in range(len(INTENTS) - 1, -1, -1):
        out = F.when(F.col(question).rlike(f"(?i){INTENTS[k][0]}"), F.lit(k)).otherwise(out)
    return out


def answer(question: str, relations: DataFrame) -> DataFrame:
    """(answer, n) of the first intent that the question matches; a number in it is the limit, 1 to MOST."""
    found = re.search(r"\d+", question)
    limit = max(1, min(MOST, int(found[0]))) if found else 10
    for pattern, plan in INTENTS:
        if re.search(pattern, question, re.I):
            return plan(relations, limit)
    raise ValueError("the question matches no intent")


#: The intents that can be asked for, what each needs, and whether a classifier may choose it (aliases it may not).
CATALOGUE = (
    ("account-objections", ("opportunity_id",), True),
    ("open-commitments", ("opportunity_id",), True),
    ("call-briefing", (), True),
    ("open-conflicts", ("opportunity_id",), True),
    ("missing-stakeholders", ("opportunity_id",), True),
    ("whats-new", ("subject_id", "since"), True),
    ("as-of", ("subject_id", "as_of"), True),
    ("recommend-content", ("opportunity_id", "buyer_contact_id"), True),
    ("content-effectiveness", ("opportunity_id",), True),
    ("top-objections", ("seller_id",), True),
    ("opportunity-conflicts", ("opportunity_id",), False),
    ("buying-committee", ("opportunity_id",), False),
)


def dispatched(asked: DataFrame, sure: float = 0.5) -> DataFrame:
    """``asked`` (intent, confidence, given: names of parameters) with ``outcome``: the intent that runs, or why it is refused: it isn't
    in the catalogue, the classifier isn't sure (or says nothing), or a parameter is missing."""
    known = asked.sparkSession.createDataFrame([(i, list(n)) for i, n, shown in CATALOGUE if shown], "intent string, _needs array<string>")
    j = asked.join(F.broadcast(known), "intent", "left")
    short = F.size(F.array_except("_needs", F.coalesce("given", F.array().cast("array<string>")))) > 0
    outcome = F.when(F.col("_needs").isNull(), "refused: unknown intent").when(F.coalesce("confidence", F.lit(0.0)) < sure, "refused: not sure").when(short, "refused: parameters missing").otherwise(F.col("intent"))
    return j.withColumn("outcome", outcome).drop("_needs")
