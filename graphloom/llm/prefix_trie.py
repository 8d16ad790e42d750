"""Conversation prefix trie (operator 11): shared beginnings of conversations as a tree of turns.

Each conversation has a digest of its first d turns for each d: sums of hashes of (place, role, text), so that the turns of
one conversation of any length are summed in blocks. A node is a digest with its depth; it belongs to its smallest
conversation. What a conversation owns begins at some depth and goes on to its end, since deeper nodes have fewer members:
that first depth is found by binary search, all conversations at once, each round a join with the minima of the digests.
Owned nodes of a conversation form a chain. Chains hang from each other as a tree; counts of leaves and saved tokens go up
it in steps that double, so the number of rounds is the logarithm of its height; inside a chain they are running sums.

Null role or text: empty. Turns ascend, null first; equal turns by role, then by the text's digest; equal rows are turns of
their own. Rows without a conversation id belong to none. Other columns aren't read. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.order import numbered, running
from graphloom.llm.shared import Tables, crc32_sql, width

#: A conversation may take over at most so many turns of its base.
MOST_SHARED = 5
SUMS = ["d0", "d1", "d2", "d3"]
#: So many consecutive ids are joined to one string before strings of a node meet.
IDS = 1024
#: Rounds of the binary search in one plan.
ROUNDS = 8


def turns(conversations: DataFrame, tables: Tables) -> DataFrame:
    """conv, index, a, b, chars of each turn; a and b are halves of a digest of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda k: F.conv(F.substring("_h", k, 15), 16, 10).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.char_length(text).cast("long").alias("chars"), digest.alias("_h"))
    rows = rows.select("conv", "turn", "role", "chars", half(1).alias("a"), half(16).alias("b"))
    return tables.write(numbered(rows, "conv", ["turn", "role", "a", "b"], tables).select("conv", "index", "a", "b", "chars", "last"))


def rebuilt(own: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(rows, sizes): conversations that begin with turns of their base. rows: conv, index, a, b, chars; sizes: conv, n.

    The base of c is c - c % 100. The first crc32(c) % 6 turns of the base come first, then what c has after as many.
    """
    size = own.where("last").select("conv", (F.col("index") + 1).alias("n"))
    head = own.where((F.col("conv") % 100 == 0) & (F.col("index") < MOST_SHARED)).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("index", "a", "b", "chars"))).alias("head"))
    head = head.select(F.col("conv").alias("base"), "head")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")
    all_ = size.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % 100).join(head, "base", "left")
    all_ = all_.withColumn("head", F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.greatest("h", F.lit(1)))))
    all_ = all_.withColumn("k", F.when(F.col("head").isNull(), 0).otherwise(F.size("head")))
    all_ = tables.write(all_.select("conv", "h", "k", "head", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    first = all_.select("conv", F.explode("head").alias("t")).select("conv", F.col("t.index").alias("index"), "t.a", "t.b", "t.chars")
    rest = own.where(F.col("index") >= h).join(all_.select("conv", "h", "k"), "conv").select("conv", (F.col("index") - F.col("h") + F.col("k")).alias("index"), "a", "b", "chars")
    return first.unionByName(rest), all_.select("conv", F.col("n").cast("long").alias("n"))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, depth, g0, g1 (the digest of the first ``depth`` turns), chars of the last of them."""
    x, y = F.xxhash64("index", "a", "b"), F.xxhash64("b", F.lit("+"), "index", "a")
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    parts = rows.select("conv", "index", "chars", low(x).alias("d0"), F.shiftrightunsigned(x, 32).alias("d1"), low(y).alias("d2"), F.shiftrightunsigned(y, 32).alias("d3"))
    s = running(parts, "conv", "index", SUMS)
    both = lambda p, q: F.shiftleft(low(F.col(p)), 32).bitwiseOR(low(F.col(q)))
    return s.select("conv", (F.col("index") + 1).alias("depth"), both("d0", "d1").alias("g0"), both("d2", "d3").alias("g1"), "chars")


def first_owned(sizes: DataFrame, minima: DataFrame, tables: Tables) -> DataFrame:
    """conv, n, first: the least depth from which on a conversation owns the nodes of its prefixes; n + 1 if it owns none.

    minima: owner, depth. A conversation has one prefix of each depth, so it owns that node if the node's minimum is itself.
    """
    longest = sizes.agg(F.max("n")).head()[0] or 0
    left = (longest + 1).bit_length()
    now = sizes.select("conv", "n", F.lit(0).cast("long").alias("lo"), (F.col("n") + 1).alias("hi"))
    mine = minima.select(F.col("owner").alias("conv"), F.col("depth").alias("mid"), F.lit(True).alias("own"))
    while left > 0:
        for _ in range(min(left, ROUNDS)):
            mid = F.expr("(lo + hi) div 2")
            probe = now.withColumn("mid", F.when(F.col("lo") < F.col("hi"), mid)).join(mine, ["conv", "mid"], "left")
            open_, own = F.col("mid").isNotNull(), F.col("own").isNotNull()
            now = probe.select("conv", "n", F.when(open_ & ~own, F.col("mid") + 1).otherwise(F.col("lo")).alias("lo"), F.when(open_ & own, F.col("mid")).otherwise(F.col("hi")).alias("hi"))
        left -= ROUNDS
        now = tables.write(now)
    return now.select("conv", "n", F.col("lo").alias("first"))


def up_chains(chains: DataFrame, tables: Tables) -> DataFrame:
    """conv, leaves, saved of all chains below one, itself included. chains: conv, parent (null: root), leaves, saved.

    After round k a chain knows the sums of all that hang less than 2**k chains below it, and its 2**k-th ancestor.
    """
    now = tables.write(chains.select("conv", F.col("parent").alias("up"), "leaves", "saved"))
    while not now.where("up IS NOT NULL").isEmpty():
        gain = now.where("up IS NOT NULL").groupBy(F.col("up").alias("conv")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("rest"))
        over = now.where("up IS NOT NULL").join(now.select(F.col("conv").alias("up"), F.col("up").alias("next")), "up").select("conv", "next")
        more = now.join(gain, "conv", "left").join(over, "conv", "left")
        new = tables.write(more.select("conv", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("rest", F.lit(0))).alias("saved")))
        tables.drop(now)
        now = new
    return now.select("conv", "leaves", "saved")


def id_digests(ends: DataFrame, tables: Tables) -> DataFrame:
    """owner, depth, ends_sha256: the digest of the ids of a node, ascending and joined by commas. ends: owner, depth, conv; distinct.

    Ids are joined in blocks of 1,024 consecutive ones; only nodes with several blocks have their digest streamed over them.
    """
    node = ["owner", "depth"]
    block = ends.groupBy(*node, F.floor(F.col("conv") / IDS).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    block = tables.write(block)
    per = block.groupBy(*node).agg(F.count("*").alias("blocks"), F.min("ids").alias("ids"))
    one = per.where("blocks = 1").select(*node, F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], [*node, "ends_sha256"])

        for b in batches:
            out = []
            for owner, depth, ids in zip(*(b.column(c).to_pylist() for c in (*node, "ids")), strict=True):
                if digest is not None and (owner, depth) == now:
                    digest.update(f",{ids}".encode())
                    continue
                if digest is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (owner, depth), hashlib.sha256(ids.encode())
            if out:
                yield batch(out)
        if digest is not None:
            yield batch([(*now, digest.hexdigest())])

    many = block.join(per.where("blocks > 1").select(*node), node, "left_semi")
    many = many.repartition(width(ends.sparkSession), *node).sortWithinPartitions(*node, "block").select(*node, "ids")
    return one.unionByName(many.mapInArrow(run, "owner long, depth long, ends_sha256 string"))


def trie(rows: DataFrame, sizes: DataFrame, tables: Tables) -> DataFrame:
    """The nodes of the trie of conversations. rows: conv, index, a, b, chars of each turn; sizes: conv, n of all conversations."""
    prefix = tables.write(prefixes(rows))
    node = prefix.groupBy("depth", "g0", "g1").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    zero = lambda c: F.lit(0).cast("long").alias(c)
    root = sizes.agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 0")
    node = tables.write(node.unionByName(root.select(zero("depth"), zero("g0"), zero("g1"), "owner", "n_convs", zero("chars"))))
    state = tables.write(first_owned(sizes, node.select("owner", "depth"), tables))

    # the node above each chain, and the node where each conversation ends that owns none
    above = state.where("first > 0 AND first <= n").select("conv", (F.col("first") - 1).alias("depth"), F.lit(True).alias("chain"))
    ended = state.where("first > n").select("conv", F.col("n").alias("depth"), F.lit(False).alias("chain"))
    ask = above.unionByName(ended)
    deep = ask.where("depth > 0").join(prefix.select("conv", "depth", "g0", "g1"), ["conv", "depth"])
    flat = ask.where("depth = 0").select("conv", "depth", "chain", zero("g0"), zero("g1"))
    found = tables.write(deep.unionByName(flat).join(node.select("depth", "g0", "g1", "owner"), ["depth", "g0", "g1"]).select("conv", "depth", "chain", "owner"))
    parent = found.where("chain").select("conv", F.col("owner").alias("parent"), "depth")

    # chains as wholes: saved tokens of their own nodes, and a leaf where nothing hangs from the end
    hung = parent.groupBy(F.col("parent").alias("owner"), "depth").agg(F.count("*").alias("hung"))
    own = tables.write(node.join(hung, ["owner", "depth"], "left").join(state.select(F.col("conv").alias("owner"), "n", "first"), "owner").select("owner", "depth", "n_convs", F.coalesce("hung", F.lit(0)).alias("hung"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), "n", "first"))
    leaf = F.when((F.col("depth") == F.col("n")) & (F.col("hung") == 0), 1).otherwise(0)
    whole = own.groupBy(F.col("owner").alias("conv")).agg(F.sum(leaf).alias("leaves"), F.sum("saved").alias("saved"))
    sums = up_chains(whole.join(parent.select("conv", "parent"), "conv", "left"), tables)

    # inside a chain: what hangs from each node, then sums from the end upwards
    hanging = parent.join(sums, "conv").groupBy(F.col("parent").alias("owner"), "depth").agg(F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))
    line = own.join(hanging, ["owner", "depth"], "left").select("owner", "depth", "n_convs", "hung", "n", "first", (F.col("n") - F.col("depth")).alias("place"), (leaf + F.coalesce("in_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("in_saved", F.lit(0))).alias("saved_tokens"))
    line = running(line, "owner", "place", ["n_leaves", "saved_tokens"])

    ends = state.where("first <= n").select(F.col("conv").alias("owner"), F.col("n").alias("depth"), "conv").unionByName(found.where("NOT chain").select("owner", "depth", "conv"))
    ends = id_digests(ends, tables)
    top = parent.select(F.col("conv").alias("owner"), (F.col("depth") + 1).alias("depth"), "parent")
    out = line.join(top, ["owner", "depth"], "left").join(ends, ["owner", "depth"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("owner").alias("conv_id"), "depth",
        F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", (F.col("hung") + (F.col("depth") < F.col("n")).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "trie")
    rows, sizes = rebuilt(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), tables), tables)
    return trie(rows, sizes, tables)


OP11_SQL = f"""
WITH t AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own, {crc32_sql("conv_id")} % 6 AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
f AS (SELECT t.c, list_concat(coalesce(b.own[1:t.h], []), t.own[t.h + 1:]) AS s FROM t LEFT JOIN t b ON b.c = t.c - t.c % 100),
p AS (SELECT c, s, unnest(range(len(s) + 1)) AS depth FROM f), q AS (SELECT c, depth, sha256(s[1:depth]::VARCHAR) AS k, sha256(s[1:depth - 1]::VARCHAR) AS up, coalesce(length(s[depth].t), 0) AS chars, len(s) = depth AS ended FROM p),
n AS (SELECT depth, k, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends_sha256 FROM q GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2), m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, k)),
below AS (SELECT a.depth, a.k, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(m.saved) AS saved_tokens FROM m JOIN q o ON o.c = m.conv_id AND o.depth = m.depth AND o.k = m.k JOIN q a ON a.c = o.c AND a.depth <= o.depth GROUP BY a.depth, a.k)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256 FROM m JOIN below USING (depth, k) LEFT JOIN n u ON u.depth = m.depth - 1 AND u.k = m.up AND m.depth > 0"""
