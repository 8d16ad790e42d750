"""Aggregations: summaries, rates, calibration, noisy-OR, modularity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def noisy_or(confidence: Column | str) -> Column:
    """Probability that at least one of independent pieces of evidence holds: 1 - product(1 - c)."""
    return 1 - F.product(1 - F.col(confidence) if isinstance(confidence, str) else 1 - confidence)


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole, and ``empty`` where the whole is zero."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def latency_summary(df: DataFrame, by: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """Count, mean, least, greatest, linear p50 and p95 of ``value``."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(v), digits).alias("avg_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.round(F.percentile(v, F.lit(0.5)), digits).alias("p50"), F.round(F.percentile(v, F.lit(0.95)), digits).alias("p95"))


def confidence_interval(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"), F.round(F.percentile(v, F.lit(0.99)), 6).alias("p99"), F.round(F.avg(v), 6).alias("mean"), F.round(1.96 * F.stddev_samp(v) / F.sqrt(F.count(v)), 6).alias("ci95"))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, p: float) -> DataFrame:
    """The element at index floor(n * p) of the sorted values (the last, if there is none), and the sample deviation.

    Values are ranked by count, not gathered: equal values are one row before any group is sorted.
    """
    from pyspark.sql.window import Window

    counts = df.groupBy(*by, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by).orderBy(value)
    run = counts.withColumn("upto", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(Window.partitionBy(*by)))
    at = F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    found = run.where(F.col("upto") > at).groupBy(*by).agg(F.min(value).alias("nearest"))
    return found.join(df.groupBy(*by).agg(F.round(F.stddev_samp(value), 6).alias("stdev")), list(by))


def brier(df: DataFrame, by: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """Mean squared error of probabilities; -1 where nothing was predicted."""
    return df.groupBy(*by).agg(F.round(F.coalesce(F.avg((F.col(predicted) - F.col(actual)) ** 2), F.lit(-1.0)), 6).alias("brier"), F.count(predicted).alias("n"))


def calibration_curve(df: DataFrame, predicted: str, actual: str, bins: int = 10) -> DataFrame:
    """For each bin of predicted probability: means, count and gap; an empty bin stands at its midpoint."""
    bin_ = F.least(F.floor(F.col(predicted) * bins), F.lit(bins - 1)).cast("int")
    got = df.where(F.col(predicted).isNotNull()).groupBy(bin_.alias("bin")).agg(F.avg(predicted).alias("p"), F.avg(actual).alias("y"), F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    middle = (F.col("bin") + 0.5) / bins
    out = every.join(got, "bin", "left").select("bin", F.coalesce("p", middle).alias("p"), F.coalesce("y", middle).alias("y"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return out.select("bin", F.round("p", 6).alias("mean_predicted"), F.round("y", 6).alias("mean_actual"), "n", F.round(F.abs(F.col("p") - F.col("y")), 6).alias("gap"))


def calibration_verdict(curve: DataFrame, good: float = 0.10, fair: float = 0.20, margin: float = 0.05) -> DataFrame:
    """The count-weighted gap, a verdict, and how many bins claim too much or too little."""
    over = F.count_if((F.col("n") > 0) & (F.col("mean_predicted") - F.col("mean_actual") > margin))
    under = F.count_if((F.col("n") > 0) & (F.col("mean_actual") - F.col("mean_predicted") > margin))
    one = curve.agg(F.round(F.sum(F.col("gap") * F.col("n")) / F.sum("n"), 6).alias("ece"), over.alias("over_bins"), under.alias("under_bins"))
    return one.withColumn("verdict", F.when(F.col("ece") <= good, "well_calibrated").when(F.col("ece") <= fair, "fair").otherwise("poor"))


def bounded_groups(df: DataFrame, key: str, member: str, keep: int) -> DataFrame:
    """Count of each key with its ``keep`` smallest members; the lists are cut before they are gathered."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(member)
    few = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.col(member).cast("string"))), ",").alias("members"))
    return df.groupBy(key).agg(F.count("*").alias("n")).join(few, key)


def coherence(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Mean over communities of the share of outgoing edges that stay inside. member: node, community."""
    a, b = member.select(F.col("node").alias("src"), F.col("community").alias("c")), member.select(F.col("node").alias("tgt"), F.col("community").alias("d"))
    per = edges.join(a, "src").join(b, "tgt", "left").groupBy("c").agg(F.avg(F.when(F.col("c") == F.col("d"), 1.0).otherwise(0.0)).alias("share"))
    return per.agg(F.round(F.avg("share"), 6).alias("coherence"), F.count("*").alias("communities"))


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Newman-Girvan modularity of an undirected simple graph; a node without a community is one of its own."""
    e = edges.where("src <> tgt").select(F.least("src", "tgt").alias("u"), F.greatest("src", "tgt").alias("v")).distinct()
    ends = e.select(F.col("u").alias("node")).unionAll(e.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    known = ends.join(member, "node", "left").select("node", "degree", F.coalesce("community", "node").alias("community"))
    c = known.select("node", "community")
    inner = e.join(c.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(c.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v").where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.count("*").alias("inside"))
    m = e.agg(F.count("*").alias("m"))
    per = known.groupBy("community").agg(F.sum("degree").alias("d")).join(inner, "community", "left").crossJoin(F.broadcast(m))
    return per.agg(F.round(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - (F.col("d") / (2 * F.col("m"))) ** 2), 6).alias("modularity"))


def fdr_threshold(df: DataFrame, score: str, correct: str, target: float) -> DataFrame:
    """The lowest score at which answers above it are wrong in at most ``target`` of cases, its coverage, and 0.6 of it.

    Cumulative counts run over distinct scores of four decimals, so ties are taken together, and the window over all of them
    has 10,001 rows at most for scores of 0 to 1.
    """
    from pyspark.sql.window import Window

    per = df.groupBy(F.round(score, 4).alias("s")).agg(F.count("*").alias("k"), F.sum(1 - F.col(correct)).alias("bad"))
    w = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = per.select("s", F.sum("k").over(w).alias("n"), F.sum("bad").over(w).alias("wrong"))
    best = run.where(F.col("wrong") <= F.col("n") * target).agg(F.max_by("s", "n").alias("accept"), F.max("n").alias("covered"))
    return best.select(F.round("accept", 6).alias("accept"), F.round(F.col("accept") * 0.6, 6).alias("retrieve"), F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))
