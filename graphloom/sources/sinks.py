"""Writers: partitioned facts, backups, triples, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_day(df: DataFrame, path: str, ts: str) -> None:
    """Rows in a folder a day, so that a range of days reads its own files only."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def backup(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_triples(triples: DataFrame, path: str) -> None:
    """N-Triples lines of (s, p, o); quotes and backslashes of literals are escaped."""
    iri = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    literal = F.concat(F.lit('"'), F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    triples.select(F.concat_ws(" ", iri("s"), iri("p"), literal, F.lit(".")).alias("value")).write.text(path)
