"""The corpus pipeline: language identification, near duplicates, repeated strings, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of
``documents``. run() writes each stage's rows to the shared folder and reads them back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import byte_bpe, decontamination, jaccard_join, language_id, suffix_dedup
from graphloom.llm.shared import Tables

ORACLE_SQL = None


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id isn't in ``ids``; ids are broadcast only while there are few."""
    ids = Tables(docs.sparkSession, "without").write(ids.select("doc_id").distinct())
    few = ids.limit(jaccard_join.SMALL + 1).count() <= jaccard_join.SMALL
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, of which no language can be told, go."""
    return language_id.identified(docs, language_id.train(docs.select("doc_id", "text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Of rows that repeat an id and its text one stays, the least by its other columns; unlike texts under one id are linked by
    any of them, and stay or go together. Null and empty texts, and rows without an id, are linked with nothing and stay.
    """
    found = Tables(spark, "near").write(jaccard_join.jaccard_components(docs))
    kept = without(docs, found.where("doc_id <> component_id"))
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    single = without(kept, twice)
    rest = [c for c in single.columns if c not in ("doc_id", "text")]
    several = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest")) if rest else kept.join(twice, "doc_id", "left_semi").distinct()
    return single.unionByName(several.select("doc_id", "text", "_rest.*").select(single.columns) if rest else several.select(single.columns))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes, and those of 50 words, that occur more than once are cut out of the texts, each copy of them.

    Words are compared with A-Z lower-cased and white space not heeded. Null and empty texts stay as they are. Every row is
    judged by its own text, whether its id is null or repeated.
    """
    return suffix_dedup.without_repeats(docs, (suffix_dedup.BYTES, suffix_dedup.WORDS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, rows without an id as well. Null and empty texts contain none; without
    benchmark items all stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = without(docs, decontamination.contamination(docs, items))
    nameless = kept.where("doc_id IS NULL")
    if nameless.isEmpty():
        return kept
    key = suffix_dedup.unused("_key", docs.columns)
    nameless = nameless.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    found = Tables(spark, "nameless").write(decontamination.contamination(nameless, items, id_col=key).select(key).distinct())
    return kept.where("doc_id IS NOT NULL").unionByName(nameless.join(found, key, "left_anti").select(kept.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text that the ids stand for; of a null or empty text no ids."""
    import public_tokenizers as P

    out = byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language identification", known_language),
    ("near duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("decontamination", decontaminated),
    ("byte-level BPE", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark, "pipeline")
    for _, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir))
    return docs
