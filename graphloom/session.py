"""Session settings and the input tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    return SparkSession.builder.master(master).appName("graphloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false").getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; a local one only where that is unset.

    It goes when the driver ends: results may be read as long as it lives.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("graphloom.scratch.dir", None)
        if not found:
            found = tempfile.mkdtemp(prefix="graphloom-")
            spark.conf.set("graphloom.scratch.dir", found)
            atexit.register(_delete, spark, found)
    at = f"{found.rstrip('/')}/{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, at)
    return at


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, and its size is that of its files."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._graphloom_path = at
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, so that a loop keeps a round or two on disk and no more."""
    for t in tables:
        _delete(t.sparkSession, t._graphloom_path)


#: About so many rows of a large table are in one task at once.
ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over as many tasks as ``rows`` rows need, so that a task's memory doesn't grow with the table; as it
    is where the session's shuffles have that many partitions anyway. Groups and joins by these keys, or more, shuffle nothing again."""
    parts = -(-rows // ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


#: The graph read from the relational tables, in SQL that Spark and DuckDB both take. Evidence has a row for each
#: document (order) that says so; relations are certain ones, with one row each.
VIEWS = {
    "entities": """
SELECT concat('REGION:', CAST(r_regionkey AS STRING)) AS id, r_name AS name, 'REGION' AS type, concat('t', CAST(r_regionkey % 3 AS STRING)) AS tenant FROM region
UNION ALL SELECT concat('NATION:', CAST(n_nationkey AS STRING)), n_name, 'NATION', concat('t', CAST(n_nationkey % 3 AS STRING)) FROM nation
UNION ALL SELECT concat('SUPPLIER:', CAST(s_suppkey AS STRING)), s_name, 'SUPPLIER', concat('t', CAST(s_suppkey % 3 AS STRING)) FROM supplier
UNION ALL SELECT concat('CUSTOMER:', CAST(c_custkey AS STRING)), c_name, 'CUSTOMER', concat('t', CAST(c_custkey % 3 AS STRING)) FROM customer
UNION ALL SELECT concat('PART:', CAST(p_partkey AS STRING)), p_name, 'PART', concat('t', CAST(p_partkey % 3 AS STRING)) FROM part""",
    "relations": """
SELECT concat('NATION:', CAST(n_nationkey AS STRING)) AS src, 'PART_OF' AS rel, concat('REGION:', CAST(n_regionkey AS STRING)) AS tgt, CAST(0.99 AS DOUBLE) AS confidence FROM nation
UNION ALL SELECT concat('SUPPLIER:', CAST(s_suppkey AS STRING)), 'LOCATED_IN', concat('NATION:', CAST(s_nationkey AS STRING)), CAST(0.9 AS DOUBLE) FROM supplier
UNION ALL SELECT concat('CUSTOMER:', CAST(c_custkey AS STRING)), 'LOCATED_IN', concat('NATION:', CAST(c_nationkey AS STRING)), CAST(0.8 AS DOUBLE) FROM customer""",
    "evidence": """
SELECT concat('SUPPLIER:', CAST(l_suppkey AS STRING)) AS src, 'SUPPLIES' AS rel, concat('PART:', CAST(l_partkey AS STRING)) AS tgt,
       l_orderkey AS doc, round(CAST(0.5 AS DOUBLE) + l_discount * 4, 2) AS confidence, CAST(l_shipdate AS DATE) AS valid_from, CAST(o_orderdate AS DATE) AS recorded_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "kpi": """
SELECT event_id, concat('t', CAST(user_id % 3 AS STRING)) AS tenant, user_id, event_type, value AS latency_ms, ts, CAST(ts AS DATE) AS day FROM events""",
    "claims": """
SELECT c_custkey AS subject, o_orderpriority AS predicate, o_orderkey AS claim_id, o_orderstatus AS object, CAST(o_orderdate AS DATE) AS valid_from, o_totalprice AS amount
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "changes": """
SELECT o_custkey AS deal, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS changed, o_orderstatus AS stage FROM orders""",
}


def with_views(sql: str) -> str:
    """A DuckDB query with the views that it names put before it."""
    used = [v for v in VIEWS if v in sql]
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if not head:
        return body
    return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE') if body.upper().startswith('WITH RECURSIVE') else 4 :].lstrip()}" if body.upper().startswith("WITH") else f"WITH {head}\n{body}"


class Data:
    """The tables and views of one folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if f"FROM {t}" in sql or f"JOIN {t}" in sql}
        if name == "evidence":
            used = {"lineitem": self.spread(used["lineitem"], "l_orderkey"), "orders": self.spread(used["orders"], "o_orderkey")}
        for t in used:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        return self.spark.sql(sql, **used)

    @cached_property
    def lines(self) -> int:
        """How many rows the largest table has, by the footers of its files."""
        return self.lineitem.count()

    def spread(self, df: DataFrame, *keys: str) -> DataFrame:
        """``df``, which has a row for each row of lineitem at most, dealt by its keys; see dealt()."""
        return dealt(df, self.lines, *keys)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)

    @cached_property
    def edges(self) -> DataFrame:
        from graphloom.operators.graph import merged_edges

        return merged_edges(self.spread(self.evidence, "src", "rel", "tgt"))
