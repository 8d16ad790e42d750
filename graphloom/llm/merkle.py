"""Merkle dataset manifest (operator 12): a hash tree of each group's rows, a tree of the groups' roots over them, and proofs.

Nodes of a level are hashed in runs of three, the last run with what is left of it, without padding, until one is left.
Leaves are numbered within their group by ranges of the order. Each task reads rows in their order and keeps a stack of
finished nodes, as mountains in a range: a leaf that ends a run of three, or ends its group, takes its siblings from the
stack, and the carry goes on upwards. Each carry is a record of the node. What stays on a stack (a run that a task's rows
begin or end within) is a peak; peaks are merged by the same stack, in aligned blocks of 3**7 nodes at a time. Rows in
another order than expected would only give more peaks. Proofs go downwards, block by block: a block's nodes and the path
above it are enough for the paths of all that is in it.

A null field is written as ``-``. A null group is a group, before all others; groups are ordered bytewise. Rows of a group
ascend by id, null first; equal ids by their leaf, equal leaves are equal rows. Other columns aren't read. An empty table
has no nodes. Long texts are hashed by the JVM and go no further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.order import numbered
from graphloom.llm.shared import Tables, crc32_sql, width

FANOUT = 3
#: Levels that one block takes: 3**7 = 2,187 nodes at most.
TIER = 7
SPAN = FANOUT**TIER
NODE = "grp string, level long, index long, hash string, last boolean, peak boolean"


def joined(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """How a value enters a leaf: its length in bytes, a colon and itself; a dash if null."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


class Mountains:
    """The stack of one contiguous run of nodes; add() returns the nodes that a node completes."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, int, str, bool]] = []

    def follows(self, level: int, index: int) -> bool:
        """Whether a node begins where the last one on the stack ends."""
        top, at, *_ = self.stack[-1]
        return index * FANOUT**level == (at + 1) * FANOUT**top

    def add(self, level: int, index: int, digest: str, last: bool) -> list[tuple[int, int, str, bool]]:
        made, stack = [], self.stack
        stack.append((level, index, digest, last))
        while index and (last or index % FANOUT == FANOUT - 1):
            n = index % FANOUT + 1
            if len(stack) < n or any(stack[-k][0] != level for k in range(1, n + 1)):
                break
            digest = joined(*(x[2] for x in stack[-n:]))
            del stack[-n:]
            level, index = level + 1, index // FANOUT
            stack.append((level, index, digest, last))
            made.append(stack[-1])
        return made


def _stacked(names: list[str], block: str | None):
    """A mapper from nodes in order to the nodes that they complete and to the peaks that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, m, begun = None, Mountains(), False

        def close(out: list[tuple]) -> None:
            out += [(now[0], *x, True) for x in m.stack]

        for b in batches:
            out: list[tuple] = []
            cols = [b.column(c).to_pylist() for c in (names if block is None else [*names, block])]
            for grp, level, index, digest, last, *rest in zip(*cols, strict=True):
                key = (grp, *rest)
                if not begun or key != now or not m.follows(level, index):
                    if begun:
                        close(out)
                    now, m, begun = key, Mountains(), True
                out += [(grp, *x, False) for x in m.add(level, index, digest, last)]
            if out:
                yield _nodes(out)
        if begun:
            out = []
            close(out)
            yield _nodes(out)

    return run


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["grp", "level", "index", "hash", "last", "peak"])


def tree(leaves: DataFrame, tables: Tables) -> DataFrame:
    """All nodes of the groups' trees: grp, level, index, hash, last. leaves: grp, index, hash, last (from numbered()).

    The node with index 0 that is last is its group's root. Level 0 has the leaves themselves.
    """
    names = ["grp", "level", "index", "hash", "last"]
    nodes = leaves.select("grp", F.lit(0).cast("long").alias("level"), "index", "hash", "last")
    found = tables.write(nodes.mapInArrow(_stacked(names, None), NODE))
    out, peaks, span = [nodes, found.where("NOT peak").select(names)], found.where("peak AND NOT (index = 0 AND last)"), TIER
    while not peaks.isEmpty():
        low, high = peaks.where(F.col("level") < span), peaks.where(F.col("level") >= span)
        place = lambda c: F.col(c) * F.pow(F.lit(float(FANOUT)), F.col("level")).cast("long")
        low = low.withColumn("_at", place("index")).withColumn("_block", F.expr(f"_at div {FANOUT**span}L"))
        low = low.repartition(width(leaves.sparkSession), "grp", "_block").sortWithinPartitions("grp", "_block", "_at")
        found = tables.write(low.mapInArrow(_stacked(names, "_block"), NODE))
        out.append(found.where("NOT peak").select(names))
        peaks, span = high.unionByName(found.where("peak AND NOT (index = 0 AND last)")), span + TIER
    return reduce(DataFrame.unionByName, out)


def _below(hashes: list[str], levels: int, path: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(row, path) of the nodes of one block. A path has a step a level: hashes to the left, a comma, hashes to the right."""
    at, steps = hashes, []
    for _ in range(levels):
        runs = [at[i : i + FANOUT] for i in range(0, len(at), FANOUT)]
        steps.append([f"{''.join(run[:k])},{''.join(run[k + 1 :])}" for run in runs for k in range(len(run))])
        at = [joined(*run) for run in runs]
    for i in range(len(hashes)):
        own, k = [], i
        for s in steps:
            own.append(s[k])
            k //= FANOUT
        yield i, own + path


def folded(digest: str, path: list[str]) -> str:
    for step in path:
        left, _, right = step.partition(",")
        digest = joined(left, digest, right)
    return digest


def _walk(final: bool):
    """A mapper from blocks (kind 0: the path above, then its nodes) to the paths of their nodes, or to proofs if final."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, above, tag, rows, begun = None, (0, []), None, [], False

        def close(out: list[tuple]) -> None:
            for i, path in _below([r[1] for r in rows], *above):
                index, digest, other, name = rows[i]
                if final:
                    proof = joined(*(s.replace(",", "") for s in path))
                    out.append((now[0], name, digest, proof, folded(other or digest, path), tag))
                else:
                    out.append((now[0], index, path, tag))

        for b in batches:
            out: list[tuple] = []
            for grp, block, kind, index, digest, other, name, levels, path, mark in zip(*(b.column(c).to_pylist() for c in ("grp", "block", "kind", "index", "hash", "other", "name", "levels", "path", "tag")), strict=True):
                if not begun or (grp, block) != now:
                    if begun:
                        close(out)
                    now, above, rows, begun = (grp, block), (0, []), [], True
                if kind == 0:
                    above, tag = (levels, path), mark
                else:
                    rows.append((index, digest, other, name))
            if out:
                yield batch(out)
        if begun:
            out = []
            close(out)
            if out:
                yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        if final:
            kinds, names = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()), ["grp", "name", "hash", "proof_sha256", "folded_root", "tag"]
        else:
            kinds, names = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()), ["grp", "index", "path", "tag"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def paths(leaves: DataFrame, nodes: DataFrame, above: DataFrame, tables: Tables, final: bool) -> DataFrame:
    """The way from each leaf to the root, continued by the way that ``above`` (grp, level of the root, path, tag) knows.

    leaves: grp, index, hash, other (a hash to be folded instead, or null), name. With ``final``: grp, name, hash, proof_sha256,
    folded_root, tag; else grp, index, path, tag. Blocks of 3**7 nodes go down from the top, each with the path above it.
    """
    top = above.select("grp", "tag", F.col("level").alias("_height"), "path", F.greatest(F.lit(0), F.expr(f"(level - 1) div {TIER}")).alias("_tier"))
    highest = top.agg(F.max("_tier")).head()[0]
    if highest is None:
        highest = 0
    known = None
    for t in range(highest, -1, -1):
        begin = top.where(F.col("_tier") == t).select("grp", F.lit(0).cast("long").alias("block"), (F.col("_height") - TIER * t).alias("levels"), "path", "tag")
        if known is not None:
            begin = begin.unionByName(known.select("grp", F.col("index").alias("block"), F.lit(TIER).cast("long").alias("levels"), "path", "tag"))
        rows = nodes.where(F.col("level") == TIER * t).select("grp", "index", "hash", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("name")) if t else leaves.select("grp", "index", "hash", "other", "name")
        rows = rows.withColumn("block", F.expr(f"index div {SPAN}"))
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        both = begin.select("grp", "block", F.lit(0).alias("kind"), none("index", "long"), none("hash", "string"), none("other", "string"), none("name", "long"), "levels", "path", "tag").unionByName(rows.select("grp", "block", F.lit(1).alias("kind"), "index", "hash", "other", "name", none("levels", "long"), none("path", "array<string>"), none("tag", "string")))
        if t:  # only groups that are so high
            both = both.join(top.where(F.col("_tier") >= t).select(F.col("grp").alias("_g")), F.col("grp").eqNullSafe(F.col("_g")), "left_semi")
        both = both.repartition(width(leaves.sparkSession), "grp", "block").sortWithinPartitions("grp", "block", "kind", "index")
        end = final and t == 0
        found = both.mapInArrow(_walk(end), "grp string, name long, hash string, proof_sha256 string, folded_root string, tag string" if end else "grp string, index long, path array<string>, tag string")
        known = found if end else tables.write(found)
    return known


def manifest(rows: DataFrame, group: str, name: str, fields: list[str], other: Column | None = None, tables: Tables | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proofs, nodes, top): a row for each of ``rows``, the nodes of all groups' trees, and those of the tree over their roots.

    proofs: grp, name, leaf, subroot, root, proof_sha256 (of the siblings on the way up, from left to right), folded_root (from
    ``other``, a leaf column of possibly altered rows, up to the root by the original siblings), verified. nodes: grp, level,
    index, hash, last; the same for top, whose leaves are the groups in order and whose group is the empty string.
    """
    tables = tables or Tables(rows.sparkSession, "merkle")
    own = leaf([F.col(c) for c in fields])
    rows = rows.select(F.col(group).cast("string").alias("grp"), F.col(name).cast("long").alias("name"), own.alias("hash"), (F.lit(None).cast("string") if other is None else other).alias("other"))
    rows = rows.withColumn("other", F.when(F.col("other") != F.col("hash"), F.col("other")))
    leaves = tables.write(numbered(rows, "grp", ["name", "hash"], tables))
    nodes = tables.write(tree(leaves, tables))
    roots = nodes.where("index = 0 AND last").select("grp", "hash", "level")
    line = numbered(roots.select(F.lit("").alias("one"), "grp", "hash"), "one", ["grp"], tables)
    line = tables.write(line.select(F.col("one").alias("grp"), F.col("grp").alias("source"), "index", "hash", "last"))
    top = tables.write(tree(line, tables))
    root = top.where("index = 0 AND last").select("grp", "level", "hash")
    whole = (root.head() or ["", 0, ""])[2]  # one row; none without rows
    start = root.select("grp", "level", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("tag"))
    way = paths(line.select("grp", "index", "hash", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("name")), top, start, tables, False)
    way = way.select("index", "path").join(line.select("index", F.col("source").alias("grp")), "index").select("grp", "path")
    above = way.join(roots.select(F.col("grp").alias("_g"), "level", F.col("hash").alias("tag")), F.col("grp").eqNullSafe(F.col("_g")))
    found = paths(leaves, nodes, tables.write(above.select("grp", "level", "path", "tag")), tables, True)
    return found.select("grp", "name", F.col("hash").alias("leaf"), F.col("tag").alias("subroot"), F.lit(whole).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(whole)).alias("verified")), nodes, top


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proofs, _, _ = manifest(docs, "source", "doc_id", FIELDS, leaf([text if c == "text" else F.col(c) for c in FIELDS]))
    return proofs.select(F.col("name").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes, their siblings to the left and right, of trees over ``leaves`` (g, i, h, n) in DuckDB."""
    return f"""{name} AS (SELECT 0 AS lvl, g, i, h, n FROM {leaves} UNION ALL SELECT lvl + 1, g, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY lvl, g, i // 3, n),
{name}_beside AS (SELECT lvl, g, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, g, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, g, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name})"""


_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END" for c in FIELDS)
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({_FIELDS}) AS leaf, CASE WHEN {crc32_sql("doc_id")} % 2 = 0 THEN sha256({_FIELDS.replace("text::", "replace(text, chr(10), '')::")}) END AS other FROM documents),
s AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
s0 AS (SELECT g, i, leaf AS h, n FROM s), {_tree_sql("t", "s0")},
u0 AS (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM t WHERE n = 1), {_tree_sql("u", "u0")},
w AS (SELECT g, i AS own, 0 AS lvl, i AS pos, '' AS sibs, coalesce(other, leaf) AS f FROM s UNION ALL SELECT w.g, own, w.lvl + 1, pos // 3, sibs || l || r, sha256(l || f || r) FROM w JOIN t_beside b ON b.g = w.g AND b.lvl = w.lvl AND b.i = pos WHERE b.n > 1),
x AS (SELECT w.g, own, 0 AS lvl, w.g AS pos, sibs, f FROM w JOIN t ON t.g = w.g AND t.lvl = w.lvl AND t.n = 1 UNION ALL SELECT x.g, own, x.lvl + 1, pos // 3, sibs || l || r, sha256(l || f || r) FROM x JOIN u_beside b ON b.lvl = x.lvl AND b.i = pos WHERE b.n > 1),
z AS (SELECT x.* FROM x JOIN u ON u.lvl = x.lvl AND u.n = 1)
SELECT doc_id, leaf, u0.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(sibs) AS proof_sha256, f AS folded_root, f = (SELECT h FROM u WHERE n = 1) AS verified FROM s JOIN z ON z.g = s.g AND z.own = s.i JOIN u0 ON u0.i = s.g"""
