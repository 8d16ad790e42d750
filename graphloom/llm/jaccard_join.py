"""Set-similarity join on word n-grams by vertical partitioning (operator 6).

A document's set is its distinct 5-word shingles. Two documents link when 100 * |intersection| >= 75 * |union|.

1. Every shingle's document frequency is counted: sets go to hash ranges as sorted, delta-coded blocks, one block a
   chunk of documents and range, and only counts of shared shingles come back. A document of which less than 75 in 100
   shingles occur elsewhere can't link and is left out. Equal sets become one class, and the count is repeated among
   the classes. Neither step loses a link.
2. What is left is put in the global order (frequency, hash). The order is cut into fragments; a set's part in a
   fragment is a segment. Two sets that link share a shingle among the first n - ceil(0.75 n) + 1 of either.
3. Candidate pairs are verified fragment by fragment: partial overlaps are counted separately and summed per pair.
   Candidates are drawn in stars: in each posting list of a prefix shingle, one document against the others. Verified
   links merge components, and only pairs across components remain to be tested. When these are few for the number of
   postings, or a round of stars draws few, all that remain are tested. So a group of near copies needs about as many
   tests as it has members. Pairs are dropped before verification only where their sizes and the places of their shared
   prefix shingles leave no room for the overlap they need.

Null and wordless texts have the empty set and link with nothing. Fewer than 5 words make one shingle. An id names one
text; a row repeated as it is counts as a copy. Rows without an id have no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.arrays import mix, shingles, slices, trimmed, utf8, word_hashes
from graphloom.llm.components import components
from graphloom.llm.shared import Tables, width

SIZE = 5
#: Links need PERCENT * |union| <= 100 * |intersection|.
PERCENT = 75
FRAGMENTS = 8
CHUNK = 4 << 20
#: Ids of a semi-join are broadcast up to this number (8 bytes each); beyond it Spark shuffles.
SMALL = 500_000
#: All pairs across components are tested when they are at most so many times the postings.
FEW = 2
STAR_ROUNDS = 5
META = np.dtype([("id", "<i8"), ("n", "<i8"), ("f1", "<i8"), ("f2", "<i8"), ("f3", "<i8"), ("f4", "<i8")])


def chunk_sets(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and rows, sorted by (shingle, row) and distinct, and the row of META of each document."""
    words, rows = word_hashes(*utf8(b.column(1)))
    sh, at = shingles(words, rows, SIZE)
    row = np.repeat(np.arange(b.num_rows), np.diff(at))
    order = np.lexsort((row, sh))
    sh, row = sh[order], row[order]
    keep = np.ones(len(sh), bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    sh, row = sh[keep], row[keep]
    meta = np.zeros(b.num_rows, META)
    meta["id"] = b.column(0).to_numpy(zero_copy_only=False)
    meta["n"] = np.bincount(row, minlength=b.num_rows)
    for k, seed in ((0, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        m = mix(sh ^ np.uint64(seed))
        for j, part in enumerate((m >> np.uint64(32), m & np.uint64(0xFFFFFFFF))):
            meta[f"f{k + j + 1}"] = np.bincount(row, part.astype(np.float64), b.num_rows).astype(np.int64)  # exact to 2**21 shingles a document
    for r in np.flatnonzero(meta["n"] > 1 << 21):
        own = sh[row == r]
        for k, seed in ((0, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
            m = mix(own ^ np.uint64(seed))
            meta[r][f"f{k + 1}"], meta[r][f"f{k + 2}"] = (int((m >> np.uint64(32)).sum()), int((m & np.uint64(0xFFFFFFFF)).sum()))
    return sh, row, meta


def _code(values: np.ndarray, row: np.ndarray) -> bytes:
    """Sorted 48-bit values as 32-bit steps (with what is above 32 bits of the few longer ones), their rows in 2 or 4 bytes."""
    step = np.diff(values, prepend=values[:1])
    wide = np.flatnonzero(step >> np.uint64(32))
    rows = row.astype("<u2") if not len(row) or int(row.max()) < 1 << 16 else row.astype("<u4")
    first = int(values[0]) if len(values) else 0
    return b"".join((np.array([len(values), first, len(wide), rows.itemsize], "<i8").tobytes(), (step & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), wide.astype("<u4").tobytes(), (step[wide] >> np.uint64(32)).astype("<u4").tobytes(), rows.tobytes()))


def _decode(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first, k, size = np.frombuffer(b, "<i8", 4).tolist()
    step = np.frombuffer(b, "<u4", n, 32).astype(np.uint64)
    at, high = np.frombuffer(b, "<u4", k, 32 + 4 * n), np.frombuffer(b, "<u4", k, 32 + 4 * (n + k))
    step[at] |= high.astype(np.uint64) << np.uint64(32)
    return np.cumsum(step, dtype=np.uint64) + np.uint64(first), np.frombuffer(b, "<u2" if size == 2 else "<u4", n, 32 + 4 * (n + 2 * k))


def shared_counts(docs: DataFrame, by_class: bool = False) -> DataFrame:
    """doc_id, n, f1..f4 (a 128-bit fingerprint of the set) and shared: how many shingles occur in another row."""
    spark = docs.sparkSession
    parts = max(2, width(spark))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in slices(batches, "text", CHUNK):
            sh, row, meta = chunk_sets(b)
            n += 1
            chunk = part << 32 | n
            values = sh >> np.uint64(16)
            bucket = (values >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(parts + 1, dtype=np.uint64))
            home = (part * 7919 + n) % parts
            out = [(k, chunk, _code(values[cut[k] : cut[k + 1]], row[cut[k] : cut[k + 1]]), meta.tobytes() if k == home else b"", len(meta)) for k in range(parts) if cut[k] < cut[k + 1] or k == home]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], ["bucket", "chunk", "block", "meta", "rows"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)]
        if not held:
            return
        coded = [_decode(h[1]) for h in held]
        values = np.concatenate([v for v, _ in coded])
        order = np.argsort(values)
        s = values[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:]
        shared = np.empty(len(s), bool)
        shared[order] = same
        at = 0
        for (chunk, _, meta, rows), (_, row) in zip(held, coded, strict=True):
            n = np.bincount(row[shared[at : at + len(row)]], minlength=rows).astype("<u4")
            at += len(row)
            if meta or n.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([n.tobytes()], pa.binary()), pa.array([meta], pa.binary())], ["chunk", "counts", "meta"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        metas: dict[int, bytes] = {}
        for b in batches:
            for chunk, n, meta in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                got = np.frombuffer(n, "<u4").astype(np.int64)
                total[chunk] = total[chunk] + got if chunk in total else got
                if meta:
                    metas[chunk] = meta
        for chunk, meta in metas.items():
            m = np.frombuffer(meta, META)
            yield pa.RecordBatch.from_arrays([*(pa.array(m[c]) for c in META.names), pa.array(total[chunk])], ["doc_id", *META.names[1:], "shared"])

    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(scatter), "bucket int, chunk long, block binary, meta binary, rows int")
    counted = blocks.repartitionById(parts, F.col("bucket")).mapInArrow(trimmed(count), "chunk long, counts binary, meta binary")
    return counted.repartition(parts, "chunk").mapInArrow(trimmed(gather), "doc_id long, n long, f1 long, f2 long, f3 long, f4 long, shared long")


def only(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """The documents whose id is in ``ids``; broadcast only while there are few."""
    return docs.join(F.broadcast(ids) if count <= SMALL else ids, "doc_id", "left_semi")


def could_link() -> Column:
    return (F.col("n") > 0) & (F.col("shared") * 100 >= F.col("n") * PERCENT)


def ordered(docs: DataFrame) -> DataFrame:
    """(doc, n, sh, k, prefix) of all shared shingles, k being the place in the global order on a scale for pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK >> 1):
            sh, row, meta = chunk_sets(b)
            for at in range(0, len(sh), 100_000):
                s, r = sh[at : at + 100_000], row[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(meta["id"][r]), pa.array(meta["n"][r]), pa.array(s.view(np.int64))], ["doc", "n", "sh"])

    t = docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc long, n long, sh long")
    t = t.withColumn("df", F.count("*").over(Window.partitionBy("sh"))).where("df > 1")
    place = Window.partitionBy("doc").orderBy("df", "sh")
    own = Window.partitionBy("doc")
    t = t.withColumn("rank", F.col("n") - F.count("*").over(own) + F.row_number().over(place))
    t = t.withColumn("central", F.sum("df").over(own) / F.col("n"))
    need = F.ceil(F.col("n") * PERCENT / 100.0)
    t = t.withColumn("prefix", F.col("rank") <= F.col("n") - need + 1).withColumn("any", F.max("prefix").over(own)).where("any")
    return t.select("doc", "n", "sh", (F.col("df") + F.col("sh") / float(1 << 63) * 0.49).alias("k"), "rank", "central", "prefix")


def least_overlap(na: Column, nb: Column) -> Column:
    """The smallest intersection with which sets of these sizes link."""
    return F.floor((PERCENT * (na + nb) + (100 + PERCENT - 1)) / (100 + PERCENT)).cast("long")


def meet(x: str, y: str) -> Column:
    """A shared shingle stands in the prefix that these two sizes leave, in both sets."""
    need = least_overlap(F.col(f"{x}.n"), F.col(f"{y}.n"))
    return (F.col(f"{x}.rank") <= F.col(f"{x}.n") - need + 1) & (F.col(f"{y}.rank") <= F.col(f"{y}.n") - need + 1)


def candidates(met: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb) of the documents x and y of each row. What follows the last shared prefix shingle bounds the overlap."""
    low = F.col("x.doc") < F.col("y.doc")
    pick = lambda c, first: F.when(low if first else ~low, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    pairs = met.select(pick("doc", True).alias("a"), pick("n", True).alias("na"), pick("rank", True).alias("ra"), pick("doc", False).alias("b"), pick("n", False).alias("nb"), pick("rank", False).alias("rb"))
    most = F.count("*") + F.least(F.col("na") - F.max("ra"), F.col("nb") - F.max("rb"))
    return pairs.groupBy("a", "na", "b", "nb").agg(most.alias("most")).where(F.col("most") >= least_overlap(F.col("na"), F.col("nb"))).drop("most")


def verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    return overlapping(pairs, segments).select("a", "b")


def overlapping(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs (a, na, b, nb) that link, with their overlap: partial overlaps by fragment, summed per pair."""
    left = pairs.join(segments.select(F.col("doc").alias("a"), "fragment", F.col("part").alias("pa")), "a")
    both = left.join(segments.select(F.col("doc").alias("b"), "fragment", F.col("part").alias("pb")), ["b", "fragment"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("overlap"))
    whole = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return whole.where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * PERCENT)


def links(docs: DataFrame, tables: Tables) -> DataFrame | None:
    """Links (u, v) between documents of unlike sets, enough of them to connect all that are connected."""
    order = tables.write(ordered(docs))
    if order.isEmpty():
        return None
    cuts = order.select(F.percentile_approx("k", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 2000)).head()[0]
    fragment = sum((F.when(F.col("k") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    segments = tables.write(order.groupBy("doc", fragment.alias("fragment")).agg(F.collect_list("sh").alias("part")))
    postings = tables.write(order.where("prefix").select("sh", "doc", "n", "rank", "central"))
    tables.drop(order)
    # of two sets that link, the smaller has a shared shingle in this shorter prefix
    short = F.col("rank") <= F.col("n") - least_overlap(F.col("n"), F.col("n")) + 1
    size = postings.count()
    found = tested = comp = None
    drawn = size
    for round_ in range(STAR_ROUNDS + 1):
        now = postings if comp is None else postings.join(comp, "doc", "left")
        now = now.withColumn("c", F.col("doc") if comp is None else F.coalesce("component", "doc")).withColumn("short", short).drop("component")
        by = now.groupBy("sh", "c").agg(F.count("*").alias("k"), F.count_if("short").alias("i")).groupBy("sh").agg(*[F.sum(e).alias(n) for n, e in (("s", F.col("k")), ("q", F.col("k") * F.col("k")), ("t", F.col("k") - F.col("i")), ("r", (F.col("k") - F.col("i")) * (F.col("k") - F.col("i"))))])
        cross = by.agg(F.sum((F.col("s") * F.col("s") - F.col("q") - F.col("t") * F.col("t") + F.col("r")) / 2)).head()[0] or 0
        if not cross:
            break
        last = cross <= FEW * size or drawn <= size // 100 or round_ == STAR_ROUNDS
        if last:
            x, y = now.where("short").alias("x"), now.alias("y")
            larger = (F.col("y.n") > F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.doc") > F.col("x.doc")))
            met = x.join(y, (F.col("x.sh") == F.col("y.sh")) & larger & (F.col("x.c") != F.col("y.c")) & meet("x", "y"))
        else:
            # first the documents that share most of their shingles with most others, then others by chance
            key = -F.col("central") if not round_ else F.xxhash64("doc", F.lit(round_)).cast("double")
            center = now.groupBy("sh").agg(F.min(F.struct(key.alias("key"), "doc", "n", "rank", "c")).alias("m")).select("sh", "m.*")
            x, y = now.alias("x"), center.alias("y")
            met = x.join(y, (F.col("x.sh") == F.col("y.sh")) & (F.col("x.c") != F.col("y.c")) & meet("x", "y"))
        pairs = candidates(met)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = tables.write(pairs)
        drawn = pairs.count()
        new = tables.write(verified(pairs, segments))
        found = new if found is None else tables.write(found.unionByName(new))
        if last:
            break
        tested = pairs.select("a", "b") if tested is None else tables.write(tested.unionByName(pairs.select("a", "b")))
        comp = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), tables).withColumnRenamed("node", "doc")
    return None if found is None else found.select(F.col("a").alias("u"), F.col("b").alias("v"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row."""
    spark = docs.sparkSession
    tables = Tables(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id IS NOT NULL")
    prints = ["n", "f1", "f2", "f3", "f4"]
    sets = tables.write(shared_counts(known))
    some = sets.where(could_link())
    classes = some.groupBy(*prints).agg(F.min("doc_id").alias("rep"))
    member = tables.write(some.select("doc_id", *prints).join(classes, prints).select("doc_id", "rep").distinct())
    reps = tables.write(member.groupBy("doc_id").agg(F.min("rep").alias("rep")).where("doc_id = rep").select("doc_id"))
    again = tables.write(shared_counts(only(known, reps, reps.count())).where(could_link()).select("doc_id").distinct())
    edges = links(only(known, again, again.count()), tables)
    all_edges = member.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    all_edges = all_edges if edges is None else all_edges.unionByName(edges)
    comp = components(all_edges, tables)
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(comp, F.col("doc_id") == F.col("node"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    none = F.lit(None).cast("long")
    nameless = shared_counts(docs.where("doc_id IS NULL").withColumn("doc_id", F.lit(0).cast("long"))).select(none.alias("doc_id"), F.col("n").alias("n_shingles"), none.alias("component_id"))
    return out.unionByName(nameless) if docs.where("doc_id IS NULL").limit(1).count() else out


def jaccard_join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links, not just enough to connect: (doc_a, doc_b, overlap, similarity) with doc_a < doc_b between the representatives of
    classes of equal sets, and (doc_id, class_id, n_shingles, n_links) of each document: its class, and to how many other classes
    it links. The empty set is no class.

    Where many documents are alike there are as many links as pairs of them; jaccard_components() needs far fewer tests.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "jaccard-links")
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = ["n", "f1", "f2", "f3", "f4"]
    sets = tables.write(shared_counts(docs))
    classes = sets.where("n > 0").groupBy(*prints).agg(F.min("doc_id").alias("class_id"))
    member = tables.write(sets.join(classes, prints, "left").select("doc_id", "class_id", F.col("n").alias("n_shingles")))
    reps = tables.write(member.where("doc_id = class_id").select("doc_id").distinct())
    again = tables.write(shared_counts(only(docs, reps, reps.count()).dropDuplicates(["doc_id"])).where(could_link()).select("doc_id").distinct())
    order = tables.write(ordered(only(docs, again, again.count()).dropDuplicates(["doc_id"])))
    empty = spark.createDataFrame([], "doc_a long, doc_b long, overlap long, similarity double")
    links_ = empty if order.isEmpty() else tables.write(_all_links(order, tables))
    per = links_.select(F.explode(F.array("doc_a", "doc_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return links_, member.join(per, "class_id", "left").select("doc_id", "class_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _all_links(order: DataFrame, tables: Tables) -> DataFrame:
    cuts = order.select(F.percentile_approx("k", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 2000)).head()[0]
    fragment = sum((F.when(F.col("k") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    segments = tables.write(order.groupBy("doc", fragment.alias("fragment")).agg(F.collect_list("sh").alias("part")))
    now = tables.write(order.where("prefix").select("sh", "doc", "n", "rank").withColumn("short", F.col("rank") <= F.col("n") - least_overlap(F.col("n"), F.col("n")) + 1))
    x, y = now.where("short").alias("x"), now.alias("y")
    larger = (F.col("y.n") > F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.doc") > F.col("x.doc")))
    found = overlapping(tables.write(candidates(x.join(y, (F.col("x.sh") == F.col("y.sh")) & larger & meet("x", "y")))), segments)
    union = F.col("na") + F.col("nb") - F.col("overlap")
    return found.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), F.col("overlap").cast("long").alias("overlap"), (F.col("overlap") / union).alias("similarity"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
