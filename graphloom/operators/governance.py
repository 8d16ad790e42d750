"""Corroboration, contradictions, retraction, erasure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corroboration(evidence: DataFrame, position: str, gap: int) -> DataFrame:
    """(src, tgt, independent): documents of an edge that are independent of some other one of it. Documents at positions within
    ``gap`` of each other (revisions of one text) aren't independent. A document is far from some other exactly when it is far
    from the first or the last, so no pairs are made."""
    e = evidence.select("src", "tgt", "doc", position).distinct()
    ends = e.groupBy("src", "tgt").agg(F.min(position).alias("_lo"), F.max(position).alias("_hi")).where(F.col("_hi") - F.col("_lo") > gap)
    far = (F.col(position) - F.col("_lo") > gap) | (F.col("_hi") - F.col(position) > gap)
    return e.join(ends, ["src", "tgt"]).where(far).groupBy("src", "tgt").agg(F.count_distinct("doc").alias("independent"))


def contradictions(edges: DataFrame, negative: DataFrame, exclusive: list[tuple[str, str]], functional: list[str], known: DataFrame, deal: Callable[..., DataFrame] = lambda df, *keys: df) -> DataFrame:
    """(kind, src, rel, tgt, docs) of what contradicts itself and isn't ``known`` (kind, src, rel, tgt) as open: the same relation
    both ways, two exclusive relations of one node from different documents, several targets of a functional relation, and an
    edge that is asserted and denied. ``docs``: how many documents say so. edges, negative: src, rel, tgt, doc.

    Each kind is one aggregation; pairs of documents are never made, and only documents are counted as distinct ones: that there
    are two values shows in the least and the greatest, which multiplies no rows. ``deal`` (a table, its keys) may deal rows over
    more tasks.
    """
    two = lambda c: F.min(c) != F.max(c)
    docs = F.count_distinct("doc").alias("docs")
    row = lambda df, kind, rel, tgt: df.select(F.lit(kind).alias("kind"), "src", rel.alias("rel"), tgt.alias("tgt"), "docs")
    # an edge and its reverse under the name of the smaller end; documents of either direction are counted once
    same = edges.where((F.col("rel") != "RELATED_TO") & (F.col("src") != F.col("tgt"))).select(F.least("src", "tgt").alias("src"), "rel", F.greatest("src", "tgt").alias("tgt"), "doc", (F.col("src") < F.col("tgt")).alias("_up"))
    both = deal(same, "src", "rel", "tgt").groupBy("src", "rel", "tgt").agg(docs, two("_up").alias("_n")).where("_n")
    out = row(both, "directional_reversal", F.col("rel"), F.col("tgt"))
    for a, b in exclusive:
        # documents of either differ exactly when there are two or more in all
        one = edges.where(F.col("rel").isin(a, b) & F.col("doc").isNotNull()).select("src", "doc", (F.col("rel") == a).alias("_a"))
        found = deal(one, "src", "doc").groupBy("src").agg(docs, two("_a").alias("_n")).where("_n AND docs > 1")
        out = out.unionByName(row(found, "exclusive_state", F.lit(f"{a} vs {b}"), F.lit("")))
    many = deal(edges.where(F.col("rel").isin(*functional)), "src", "rel", "doc").groupBy("src", "rel").agg(docs, two("tgt").alias("_n")).where("_n")
    out = out.unionByName(row(many, "functional_violation", F.col("rel"), F.lit("")))
    signed = edges.select("src", "rel", "tgt", "doc", F.lit(True).alias("_yes")).unionByName(negative.select("src", "rel", "tgt", "doc", F.lit(False).alias("_yes")))
    denied = deal(signed, "src", "rel", "tgt").groupBy("src", "rel", "tgt").agg(docs, two("_yes").alias("_n")).where("_n")
    out = out.unionByName(row(denied, "positive_negative_pair", F.col("rel"), F.col("tgt")))
    return out.join(known, ["kind", "src", "rel", "tgt"], "left_anti")


def forget_documents(mentions: DataFrame, entities: DataFrame, edges: DataFrame, gone, deal: Callable[..., DataFrame] = lambda df, *keys: df) -> dict[str, DataFrame]:
    """The tables without the documents for which ``gone`` holds: their mentions go, entities that only they mention go, and edges
    with such an end go. ``audit`` counts what went. mentions: doc, entity; entities: entity; edges: ends (one or two entities). ``deal`` (a table,
    its keys) may deal edges over more tasks."""
    erased = mentions.groupBy("entity").agg(F.count_if(~gone).alias("_left")).where("_left = 0").select("entity")
    erased = deal(erased, "entity")  # what joins with it is dealt likewise
    kept = mentions.where(~gone)
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    touched = edges.where(F.size("ends") > 0).select(F.explode(F.array_distinct("ends")).alias("entity")).join(erased, "entity", "left_semi")
    audit = count(erased, "entities").unionByName(count(mentions.where(gone), "mentions")).unionByName(count(touched, "edges"))
    left = edges.select("*", F.array_distinct("ends").alias("_ends"))
    for i in range(2):  # each end must survive; edges that have no such end aren't joined, as all of them would meet in one task
        end = F.get("_ends", F.lit(i))
        left = left.where(end.isNull()).unionAll(left.where(end.isNotNull()).join(erased, end == F.col("entity"), "left_anti"))
    return {"mentions": kept, "entities": entities.join(erased, "entity", "left_anti"), "edges": left.drop("_ends"), "audit": audit}


def claim_graph(results: DataFrame) -> dict[str, DataFrame]:
    """Tables ``nodes`` (id, kind, text, status, score) and ``edges`` (src, rel, tgt) of answered questions (query_id, text, citations,
    contexts, faithfulness, decision): a claim for each sentence, an artifact for each distinct citation and each context (by the
    first 16 digits of its SHA-256), the action, and two checks. A claim is PRODUCED_BY the action, SUPPORTED_BY each artifact, and
    VALIDATED_BY the faithfulness check, and by the judge where it accepts."""
    q = F.col("query_id")
    sentences = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])[ \t\n\r\f\x0B]+"), lambda s: F.regexp_replace(s, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")), lambda s: s != "")
    claims = results.select(q, "decision", F.posexplode(sentences).alias("_i", "text")).select(F.concat(F.lit("claim:"), q, F.lit(":"), F.col("_i").cast("string")).alias("claim"), q, "decision", "text")
    cited = F.transform(F.filter(F.array_distinct("citations"), lambda c: F.trim(c) != ""), lambda c: F.concat(F.lit("artifact:"), q, F.lit(":document:"), c))
    shown = F.transform("contexts", lambda c: F.concat(F.lit("artifact:"), q, F.lit(":context:"), F.substring(F.sha2(c, 256), 1, 16)))
    artifacts = results.select(q, F.explode(F.concat(cited, shown)).alias("artifact"))
    check = lambda name: F.concat(F.lit("check:"), q, F.lit(f":{name}"))
    edge = lambda df, rel, tgt: df.select(F.col("claim").alias("src"), F.lit(rel).alias("rel"), tgt.alias("tgt"))
    edges = edge(claims, "PRODUCED_BY", F.concat(F.lit("action:"), q)).unionByName(edge(claims.join(artifacts, "query_id"), "SUPPORTED_BY", F.col("artifact")))
    edges = edges.unionByName(edge(claims, "VALIDATED_BY", check("faithfulness"))).unionByName(edge(claims.where("decision = 'accept'"), "VALIDATED_BY", check("judge")))
    none = F.lit(None).cast("string")
    node = lambda df, id_, kind, text=none, status=none, score=F.lit(None).cast("double"): df.select(id_.alias("id"), F.lit(kind).alias("kind"), text.alias("text"), status.alias("status"), score.alias("score"))
    faith = F.when(~F.isnan("faithfulness"), F.col("faithfulness"))
    nodes = node(claims, F.col("claim"), "claim", F.col("text")).unionByName(node(artifacts.distinct(), F.col("artifact"), "artifact")).unionByName(node(results, F.concat(F.lit("action:"), q), "action"))
    nodes = nodes.unionByName(node(results, check("faithfulness"), "check", none, F.when(faith >= 0.8, "passed").otherwise("unscorable"), faith)).unionByName(node(results, check("judge"), "check", none, F.col("decision")))
    return {"nodes": nodes, "edges": edges}


#: Phrases of an answer that refuses.
REFUSALS = ("insufficient context", "cannot answer", "not enough information", "no relevant information", "i don't know")


def overlap_confidence(answer: Column, reference: Column) -> Column:
    """F1 of the sets of words of two texts, 0 where either has none."""
    word = F.lit(r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*")
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), word, F.lit(0))) for c in (answer, reference))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def judged(answer: Column, reference: Column, retrieved_score: Column, accept: float = 0.9) -> Column:
    """struct(decision, confidence, reason, retrieved): an answer is accepted when it agrees with the reference; one that is empty
    or refuses is an abstention; any other waits for a retrieval, whose score (clipped to 0 to 1; null or NaN: none) decides."""
    text = F.coalesce(answer, F.lit(""))
    none = (F.regexp_replace(text, r"[ \n\t\r]+", "") == "") | F.lower(text).rlike("|".join(REFUSALS))
    first, score = overlap_confidence(answer, reference), F.greatest(F.lit(0.0), F.least(F.lit(1.0), retrieved_score))
    missing = retrieved_score.isNull() | F.isnan(retrieved_score.cast("double"))
    sure = first >= accept
    decision = F.when(none, "abstain").when(sure, "accept").when(missing, "abstain").when(score >= accept, "accept").otherwise("abstain")
    reason = F.when(none, "empty_or_refusal_answer").when(sure, "").when(missing, "retrieval_score_unavailable").when(score >= accept, "").otherwise("retrieval_score_below_accept_threshold")
    return F.struct(decision.alias("decision"), F.when(none | sure | missing, first).otherwise(score).alias("confidence"), reason.alias("reason"), (~none & ~sure).alias("retrieved"))


def functional_violations(edges: DataFrame, subject: str, target: str) -> DataFrame:
    """Subjects of a functional relation with more than one target."""
    return edges.groupBy(F.col(subject).alias("subject")).agg(F.count_distinct(target).alias("targets")).where("targets > 1")


def exclusive_violations(edges: DataFrame, first: str, second: str, key: list[str], doc: str) -> DataFrame:
    """Pairs of exclusive relations between the same nodes that come from different documents."""
    a = edges.where(F.col("rel") == first).select(*key, F.col(doc).alias("doc_a"))
    b = edges.where(F.col("rel") == second).select(*key, F.col(doc).alias("doc_b"))
    return a.join(b, key).where("doc_a <> doc_b")


def retraction_impact(evidence: DataFrame, doc: Column) -> DataFrame:
    """What goes when the documents for which ``doc`` holds are taken back: edges that lose some or all evidence."""
    per = evidence.groupBy("src", "tgt").agg(F.count_if(doc).alias("lost"), F.count("*").alias("n"))
    hit = per.where("lost > 0")
    return hit.agg(F.count("*").alias("affected"), F.count_if(F.col("lost") == F.col("n")).alias("orphaned"), F.count_if((F.col("n") - F.col("lost")) == 1).alias("at_risk"))
