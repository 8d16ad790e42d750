"""Window operators: streaks, clean pages, smoothing, change capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def streak_bonus(days: DataFrame, user: str, day: str, length: int = 7, bonus: int = 2000) -> DataFrame:
    """(user, streaks, longest, bonus): runs of consecutive days; each whole ``length`` of days in a run earns ``bonus``."""
    d = days.select(user, day).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(user).orderBy(day)))
    runs = d.withColumn("island", island).groupBy(user, "island").agg(F.count("*").alias("days"))
    return runs.groupBy(user).agg(F.count("*").alias("streaks"), F.max("days").alias("longest"), F.sum(F.expr(f"days div {length}") * bonus).alias("bonus"))


def ewma(df: DataFrame, by: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """(by, ewma): exponentially weighted mean of each key's values in order; the first value seeds it.

    s_n = (1-a)**(n-1) x_1 + sum of a (1-a)**(n-i) x_i. Weights below 1e-18 can't be seen in a double, so the sum is
    a plain aggregation over ranks from the end and nothing is gathered.
    """
    w = Window.partitionBy(by)
    r = df.select(by, *order, value).withColumn("_r", F.row_number().over(w.orderBy(*[F.desc(o) for o in order])) - 1).withColumn("_n", F.count("*").over(w))
    weight = F.when(F.col("_r") == F.col("_n") - 1, F.pow(F.lit(1 - alpha), F.col("_r"))).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("_r")))
    return r.groupBy(by).agg(F.sum(weight * F.col(value)).alias("ewma"), F.count("*").alias("n"))


def changes(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows where ``value`` isn't that of the row before, with it as ``previous``; the first row counts as a change."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).where(~F.col("previous").eqNullSafe(F.col(value)))


def margin(df: DataFrame, by: str, score: str, tie: str) -> DataFrame:
    """(by, best, margin): the gap of the two best scores; the best itself where there is one row."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    r = df.withColumn("_n", F.lead(score).over(w)).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return r.select(by, F.col(score).alias("best"), (F.col(score) - F.coalesce("_n", F.lit(0.0))).alias("margin"))


def clean_pages(events: DataFrame, page: list[str], item: str, size: Column, when: str, good: Column, bad: Column, bonus: int = 20) -> DataFrame:
    """(page..., completed, clean, bonus): pages of which ``size`` items were solved; clean if nothing was wrong strictly before.

    A page is complete when the last of its first right answers comes in.
    """
    first = events.where(good).groupBy(*page, item).agg(F.min(when).alias("_at"), F.first(size).alias("_size"))
    done = first.groupBy(*page).agg(F.count("*").alias("_n"), F.max("_at").alias("completed"), F.max("_size").alias("_size")).where("_n >= _size")
    wrong = events.where(bad).groupBy(*page).agg(F.min(when).alias("_wrong"))
    ok = F.col("_wrong").isNull() | (F.col("_wrong") >= F.col("completed"))
    return done.join(wrong, page, "left").select(*page, "completed", ok.alias("clean"), F.when(ok, bonus).otherwise(0).alias("bonus"))


def within_budget(df: DataFrame, by: str, order: str, cost: str, budget: float, blocks: int = 1024) -> DataFrame:
    """``df`` with ``used``, the running total of ``cost`` of each key in ``order`` (a number, distinct within a key), as far as it is
    within the budget. Costs aren't negative; null costs nothing.

    A key may have a large share of all rows: the order is cut into blocks, their sums say which blocks the budget reaches, and
    only the rows of these meet in a window.
    """
    c = F.coalesce(F.col(cost), F.lit(0))
    ends = df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    width = F.greatest(F.lit(1.0), (F.col("_hi") - F.col("_lo") + 1) / blocks)
    b = df.crossJoin(F.broadcast(ends)).withColumn("_b", F.floor((F.col(order) - F.col("_lo")) / width)).drop("_lo", "_hi")
    per = b.groupBy(by, "_b").agg(F.sum(c).alias("_s"))
    start = F.sum("_s").over(Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")
    reached = per.withColumn("_start", start).where(F.col("_start") <= budget).select(F.col(by).alias("_k"), F.col("_b").alias("_c"))
    near = b.join(reached, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c"))).drop("_b", "_c", "_k")
    used = F.sum(c).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("used", used).where(F.col("used") <= budget)
