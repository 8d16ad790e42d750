"""Nested JSON and text exports as flat tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

CALL = "struct<transcript:array<struct<turn:bigint,speaker:string,text:string>>>"
CRM = "struct<accounts:array<struct<Id:string,Name:string,Website:string,IsDeleted:boolean,MasterRecordId:string>>,opportunities:array<struct<Id:string,Name:string,AccountId:string,OwnerId:string,StageName:string,IsClosed:boolean,IsDeleted:boolean>>>"


def call_segments(calls: DataFrame, key: str, body: str) -> DataFrame:
    """A row for each segment of each call; segments without text go."""
    seg = F.explode(F.from_json(F.col(body), CALL)["transcript"]).alias("s")
    return calls.select(key, seg).select(key, "s.turn", "s.speaker", "s.text").where("text IS NOT NULL")


def crm_accounts(exports: DataFrame, body: str) -> DataFrame:
    """Live accounts of CRM exports; one merged into another stands under the id of its master."""
    a = F.explode(F.from_json(F.col(body), CRM)["accounts"]).alias("a")
    return exports.select(a).where("NOT coalesce(a.IsDeleted, false)").select(F.coalesce("a.MasterRecordId", "a.Id").alias("account"), F.col("a.Id").alias("id"), F.col("a.Name").alias("name"))


def lenient_bool(c):
    """yes/true/1 and no/false/0 in any case; else null."""
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin("true", "yes", "1", "y"), True).when(v.isin("false", "no", "0", "n"), False)


def chapters(lines: DataFrame, key: str, pos: str, one: str) -> DataFrame:
    """(key, pos, chapter): a chapter begins at each line that is a first verse."""
    return lines.select(key, pos, F.sum(F.col(one).cast("long")).over(Window.partitionBy(key).orderBy(pos)).alias("chapter"))


@F.pandas_udf(StringType())
def _plain(names: pd.Series, bodies: pd.Series) -> pd.Series:
    """The text of a .txt, .md, .docx or .pdf file; null where a file can't be read (for .pdf: where pypdf is absent)."""
    import io
    import zipfile
    from xml.etree import ElementTree

    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def docx(body: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        return "\n".join("".join(t.text or "" for t in p.iter(f"{word}t")) for p in root.iter(f"{word}p"))

    def pdf(body: bytes) -> str | None:
        try:
            import pypdf
        except ImportError:
            return None
        return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(body)).pages)

    def one(name: str, body: bytes) -> str | None:
        kind = name.lower().rpartition(".")[2]
        try:
            return docx(body) if kind == "docx" else pdf(body) if kind == "pdf" else body.decode("utf-8", "replace")
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
            return None

    return pd.Series([one(n, b) for n, b in zip(names, bodies, strict=True)], dtype=object)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text) of all .txt, .md, .docx and .pdf files under a folder, each read whole."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return raw.where(kind.isin("txt", "md", "docx", "pdf")).select("path", kind.alias("kind"), _plain("path", "content").alias("text"))


def study_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="task_id string, condition string, duration_seconds double, evidence_score double, success boolean")


def golden_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, category string, question string, answer string, contexts array<string>").json(path)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples files; comments and blank lines go."""
    p = r"^\s*(\S+)\s+(\S+)\s+(.*?)\s*\.\s*$"
    v = F.col("value")
    return spark.read.text(path).where(~v.rlike(r"^\s*(#|$)")).select(*[F.regexp_extract(v, p, i).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"))])
