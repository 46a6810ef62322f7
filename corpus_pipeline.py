"""Training-data pipeline over the documents table.

Each stage takes all rows that the stage before kept and returns a DataFrame of the columns of documents, but for the
last, which returns digests of the encoded texts. ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passage_engine import session
from passage_engine.llm import agenda_bpe, minhash, mixing, quality, suffix_dedup
from passage_engine.llm.queries import vocabulary

#: Bytes of a passage of 50 words of three letters and a space: shorter shared strings are common phrases. The query of
#: the operator alone has its own, longer match.
PASSAGE_BYTES = 200


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of documents that are here and not held out; documents below a score of 0.5 go."""
    session.ship(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score_column(model)("text") >= 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one of the least id."""
    session.ship(spark)
    return minhash.keep_one(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE_BYTES that occur twice are cut out; every document stays, with what is left of it."""
    session.ship(spark)
    kept = suffix_dedup.without_repeats(docs, match=PASSAGE_BYTES)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    session.ship(spark)
    return mixing.take(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each row, as counts and digests."""
    session.ship(spark)
    return agenda_bpe.encode_decode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_removal),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", encoding),
]

#: SQL expresses neither the classifier nor the suffix dedup; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written as Parquet to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = session.scratch(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
