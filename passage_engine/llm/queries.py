"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passage_engine import session
from passage_engine.llm import embedding_dedup, mixing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session.ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passage_engine.llm import token_files

    to = session.scratch(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), to, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, to, with_ids=False)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passage_engine.llm import agenda_bpe

    return agenda_bpe.encode_decode(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passage_engine.llm import suffix_dedup

    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passage_engine.llm import fingerprints

    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passage_engine.llm import token_counts

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passage_engine.llm import minhash

    return minhash.classes(_table(spark, sf_dir, "documents")).drop("vertex", "check")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passage_engine.llm import quality

    return quality.train_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passage_engine.llm import line_dedup

    return line_dedup.dedup(_table(spark, sf_dir, "documents"), line_words=1).select("doc_id", "n_chars", "n_removed", "removed_chars", F.to_json("spans").alias("spans"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_token_files, op3_mixing, op4_sentencepiece, op5_suffix_dedup, op6_fingerprints, op7_token_counts, op8_minhash, op9_quality, op10_line_dedup)}
ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": embedding_dedup.SQL, "op3_mixing": mixing.MIX_SQL}
