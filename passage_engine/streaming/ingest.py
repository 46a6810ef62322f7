"""Streaming ingestion: new files or rows are added to a library batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passage_engine.operators.library import Library
from passage_engine.sources import extract

BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Files that appear below a folder, as a stream of at most ``max_files`` a batch."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("place"), "content", F.sha2("content", 256).alias("content_hash"))


def ingest(stream: DataFrame, library: Library, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs the batch ingestion on every micro-batch; a batch that is run again finds its own texts and adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        read = batch.withColumn("x", extract.extract("filename", "content"))
        none = F.array().cast("array<string>")
        library.ingest(read.select("filename", "place", "x.text", "x.error", none.alias("tags"), F.lit("document").alias("doc_type")))

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
