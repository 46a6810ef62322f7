"""Export and import of a library as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
_DOCUMENT = "struct<filename:string,text:string,tags:array<string>,doc_type:string,created_at:string>"


def exported(docs: DataFrame) -> DataFrame:
    """(doc_id, document): each document as a JSON object; blank texts are left out."""
    kept = docs.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    fields = F.struct("filename", "text", "tags", "doc_type", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"))
    return kept.select("doc_id", F.to_json(fields).alias("document"))


def write_export(docs: DataFrame, path: str) -> None:
    """JSON lines of ``version`` and ``document``, written in parallel."""
    rows = exported(docs).select(F.lit(VERSION).alias("version"), F.from_json("document", _DOCUMENT).alias("document"))
    rows.write.json(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Documents of an export, ready for ingestion; rows of another version or without text give an error column instead of failing."""
    raw = spark.read.schema(f"version int, document {_DOCUMENT}").json(path)
    d = raw.select("version", "document.*")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    problem = F.when(F.coalesce(F.col("version"), F.lit(0)) != VERSION, "unknown version").when(blank, "no text")
    return d.withColumn("error", F.coalesce(problem, F.lit("")))
