"""Where intermediate tables go, and how wide a job is."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session without it (tests) gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("graphloom.local.dir", None)
        if not found:
            found = tempfile.mkdtemp(prefix="graphloom-")
            spark.conf.set("graphloom.local.dir", found)
    return found.rstrip("/")


class Tables:
    """Written intermediate tables of one run; they survive lost executors and cut lineage. drop() frees those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(_delete, spark, self.at)  # results may be read as long as the driver lives

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._graphloom_path = path
        return out

    def write_by(self, df: DataFrame, column: str, values: tuple) -> dict:
        """A table for each value of an integer column, from one pass over ``df``."""
        self.n += 1
        df.write.partitionBy(column).parquet(f"{self.at}/{self.n}")
        out = {}
        for v in values:
            path = f"{self.at}/{self.n}/{column}={v}"
            rest = StructType([f for f in df.schema if f.name != column])
            try:
                got = self.spark.read.schema(rest).parquet(path)
            except AnalysisException:  # no row has the value
                got = self.spark.createDataFrame([], rest)
            out[v] = got.select(*[F.lit(v).cast(f.dataType).alias(column) if f.name == column else F.col(f.name) for f in df.schema])
            out[v]._graphloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._graphloom_path)

    def tidy(self) -> None:
        """Shuffles that nothing reads any more leave the disk."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and sc._jsc.sc().isStopped() is False:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_sql(c: str) -> str:
    """crc32 of a decimal number in DuckDB, bit by bit."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({c}::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
