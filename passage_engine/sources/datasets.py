"""Evaluation datasets: corpora, queries and judgements as DataFrames, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passage_engine import session


def corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, filename, text, tags, doc_type) of JSON lines; ValueError if ids are missing or repeated, or a text is blank."""
    raw = spark.read.schema("doc_id string, filename string, text string, tags array<string>, doc_type string").json(path)
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    row = raw.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"), F.count_if(F.coalesce(F.trim("doc_id"), F.lit("")) == "").alias("unnamed"), F.count_if(blank).alias("blank")).first()
    if not row["n"]:
        raise ValueError("the corpus is empty")
    if row["unnamed"] or row["blank"] or row["ids"] < row["n"]:
        raise ValueError(f"{row['unnamed']} documents without id, {row['blank']} without text, {row['n'] - row['ids']} repeated ids")
    none = F.array().cast("array<string>")
    return raw.select("doc_id", F.coalesce("filename", F.concat("doc_id", F.lit(".md"))).alias("filename"), "text", F.coalesce("tags", none).alias("tags"), F.coalesce("doc_type", F.lit("document")).alias("doc_type"))


def queries_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, query) and judgements (query_id, id, level), level ``chunk`` or ``doc``; ValueError if a query has none."""
    raw = spark.read.schema("query string, relevant_doc_ids array<string>, relevant_chunk_ids array<string>").json(path)
    numbered = raw.withColumn("query_id", F.sha2(F.concat_ws("\u0001", "query", F.array_join("relevant_doc_ids", ","), F.array_join("relevant_chunk_ids", ",")), 256))
    none = F.array().cast("array<string>")
    docs, chunks = F.coalesce("relevant_doc_ids", none), F.coalesce("relevant_chunk_ids", none)
    if not numbered.where((F.size(docs) + F.size(chunks) == 0) | (F.trim(F.coalesce("query", F.lit(""))) == "")).isEmpty():
        raise ValueError("a query is blank or has no relevant ids")
    use_chunks = F.size(chunks) > 0
    judged = numbered.select("query_id", F.explode(F.when(use_chunks, chunks).otherwise(docs)).alias("id"), F.when(use_chunks, "chunk").otherwise("doc").alias("level"))
    return numbered.select("query_id", "query").distinct(), judged.distinct()


def _there(spark: SparkSession, path: str) -> bool:
    fs, maker = session.file_system(spark, path)
    return fs.exists(maker(path))


def beir(spark: SparkSession, path: str, max_queries: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, judgements) of a folder with corpus and queries as .jsonl, as folders of Parquet files, or queries as
    .tsv, and qrels.tsv.

    Titles stand above texts, blank documents go, judgements count with a score above 0 (a header has none) and for
    known queries; with ``max_queries`` the first judged queries by id stay. The corpus keeps all documents. ValueError
    where no document or no judged query is left.
    """
    blank = F.lit("")

    def rows(name: str, schema: str) -> DataFrame:
        if _there(spark, f"{path}/{name}.jsonl"):
            return spark.read.schema(schema).json(f"{path}/{name}.jsonl")
        if _there(spark, f"{path}/{name}.tsv"):
            return spark.read.schema("_id string, text string").csv(f"{path}/{name}.tsv", sep="\t", quote="")
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    raw = rows("corpus", "_id string, title string, text string")
    title, body = F.trim(F.coalesce("title", blank)), F.trim(F.coalesce("text", blank))
    corpus = raw.select(F.col("_id").alias("doc_id"), F.when(title == "", body).otherwise(F.concat(title, F.lit("\n\n"), body)).alias("text")).where(F.trim("text") != "")
    asked = rows("queries", "_id string, text string").select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    lines = spark.read.schema("query_id string, id string, score string").csv(f"{path}/qrels.tsv", sep="\t")
    judged = lines.where(F.col("score").try_cast("double") > 0).select("query_id", "id").distinct()
    queries = asked.join(judged.select("query_id").distinct(), "query_id", "left_semi")
    if max_queries is not None:
        queries = queries.orderBy("query_id").limit(max_queries)
    if corpus.isEmpty() or queries.isEmpty():
        raise ValueError("no document or no judged query is left")
    return corpus, queries, judged.join(queries.select("query_id"), "query_id", "left_semi")


def convert(spark: SparkSession, source: str, to: str, max_queries: int | None = None) -> dict[str, int]:
    """Writes a folder for ``beir`` as corpus.jsonl, queries.jsonl and manifest.json in this library's own form; returns the manifest."""
    corpus, queries, judged = beir(spark, source, max_queries)
    corpus.write.json(f"{to}/corpus.jsonl")
    relevant = judged.groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("relevant_doc_ids"))
    queries.join(relevant, "query_id").select("query", "relevant_doc_ids").write.json(f"{to}/queries.jsonl")
    manifest = {"documents": corpus.count(), "queries": queries.count(), "judgements": judged.count()}
    spark.createDataFrame([manifest]).coalesce(1).write.json(f"{to}/manifest.json")
    return manifest


def remapped(judged: DataFrame, ids: DataFrame) -> DataFrame:
    """Judgements of corpus ids as those of library ids (doc_id, library_id); unknown ids go, and queries left without any."""
    return judged.join(ids.withColumnRenamed("doc_id", "id"), "id").select("query_id", F.col("library_id").alias("id"))


def report_markdown(summary: dict) -> str:
    """A one-row summary as a Markdown table."""
    return "\n".join(["| metric | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in summary.items())])


def write_report(each: DataFrame, summary: DataFrame, path: str) -> None:
    """A run's rows, one per query, and its summary, as JSON lines in two folders."""
    each.write.json(f"{path}/queries")
    summary.write.json(f"{path}/summary")
