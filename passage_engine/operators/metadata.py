"""Operators over document metadata: doc_id, filename, doc_type, status, created_at, content_hash, chunk_count, and tags
(doc_id, tag).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passage_engine.functions import text


def filtered(docs: DataFrame, doc_type: str | None = None, query: str | None = None) -> DataFrame:
    """Documents of a type whose file name holds ``query`` (case of ASCII letters aside), or whose id is it."""
    if doc_type:
        docs = docs.where(F.col("doc_type") == text.normalize_doc_type(F.lit(doc_type)))
    if query:
        docs = docs.where(F.contains(F.lower("filename"), F.lit(query.lower())) | (F.col("doc_id").cast("string") == query))
    return docs


def ordered(sort: str = "newest") -> list[Column]:
    """Sort keys: newest (also for unknown names), oldest, or name."""
    if sort == "oldest":
        return [F.col("created_at").asc(), F.col("doc_id").asc()]
    if sort == "name":
        return [F.lower("filename").asc(), F.col("doc_id").asc()]
    return [F.col("created_at").desc(), F.col("doc_id").desc()]


def page(docs: DataFrame, sort: str = "newest", limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page of a sorted list; a negative offset counts as 0, a limit must be from 1 to 500."""
    if limit is not None and not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    out = docs.orderBy(*ordered(sort))
    if offset > 0:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def lookup(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of the given ids."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def duplicates(docs: DataFrame) -> DataFrame:
    """(content_hash, doc_type, doc_id) of the newest document of each hash and type; empty hashes and missing files never match."""
    usable = docs.where((F.col("content_hash") != "") & (F.col("status") != "missing"))
    newest = F.max(F.struct("created_at", "doc_id"))["doc_id"]
    return usable.groupBy("content_hash", "doc_type").agg(newest.alias("doc_id"))


def with_tags(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """Documents with their sorted tags; none is an empty array."""
    listed = tags.groupBy("doc_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return docs.join(listed, "doc_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tag_histogram(tags: DataFrame) -> DataFrame:
    """(tag, n), most frequent first, then by tag."""
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "tag")


def having_all_tags(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Ids of documents that carry every wanted tag (normalised, repeats count once); blank tags alone match nothing."""
    names = list(dict.fromkeys(" ".join(t.split()).lower()[:64] for t in wanted))
    names = [n for n in names if n]
    found = tags.where(F.col("tag").isin(names) if names else F.lit(False))
    return found.groupBy("doc_id").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(names)).select("doc_id")


def of_type(docs: DataFrame, doc_type: str) -> DataFrame:
    return docs.where(F.col("doc_type") == text.normalize_doc_type(F.lit(doc_type))).select("doc_id")


def since(docs: DataFrame, moment: str) -> DataFrame:
    """Ids of documents made at or after an ISO moment; a moment that is none raises ValueError."""
    at = datetime.fromisoformat(moment)
    return docs.where(F.col("created_at") >= F.lit(at.isoformat()).cast("timestamp")).select("doc_id")


def scope(docs: DataFrame, tags: DataFrame, doc_ids: list | None = None, with_all_tags: list[str] | None = None, doc_type: str | None = None, from_moment: str | None = None) -> DataFrame | None:
    """Ids that pass all the given filters; None without any filter. An empty list of ids is no filter."""
    parts = []
    if doc_ids:
        parts.append(docs.where(F.col("doc_id").isin(doc_ids)).select("doc_id"))
    if with_all_tags:
        parts.append(having_all_tags(tags, with_all_tags))
    if doc_type:
        parts.append(of_type(docs, doc_type))
    if from_moment:
        parts.append(since(docs, from_moment))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "doc_id", "left_semi")
    return out.distinct()


def version(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """One row that changes with the library: documents, chunks, latest, tags, tag_chars."""
    a = docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunks"), F.max("created_at").alias("latest"))
    b = tags.agg(F.count(F.lit(1)).alias("tags"), F.coalesce(F.sum(F.length("tag")), F.lit(0)).cast("long").alias("tag_chars"))
    return a.crossJoin(b)  # one row each


def status_counts(docs: DataFrame) -> DataFrame:
    """(status, n) of the documents."""
    return docs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def page_count(docs: DataFrame, size: int) -> DataFrame:
    """One row: total documents and pages of ``size``."""
    return docs.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def newest(rows: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """Of rows that repeat keys, the one of the largest ``order`` (then of the largest columns), with the columns named."""
    last = F.max(F.struct(order, *columns)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")
