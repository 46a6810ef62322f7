"""Arrow batches of whole documents, bounded in bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows that a Python worker holds at once; one longer document makes a batch of its own.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096


def bound(spark: SparkSession) -> None:
    """Batches to Python hold so many bytes and rows at most, whatever the length of documents."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def per_document(docs: DataFrame, rows: Callable[..., dict], schema: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``rows(texts)`` beside each document's id, in batches and without a shuffle.

    ``rows`` takes a list of texts (null read as empty) and gives a dict of columns as long. Columns of ``docs``
    other than the two named are not read, so their names cannot clash.
    """
    bound(docs.sparkSession)
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = rows([x or "" for x in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c], kinds[c]) for c in names)], ["doc_id", *names])

    kinds = {c.split()[0]: {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(",")}
    pair = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return pair.mapInArrow(run, f"doc_id {pair.schema['doc_id'].dataType.simpleString()}, {schema}")
