"""BM25 retrieval for a table of queries.

An index is a table (id, term, tf, length) with one more row per text, whose term is empty: it holds the text's length, so
the number of texts and their mean length come from the same table as the postings. One pass over the texts makes it,
for all terms (``library`` stores it) or for the terms of the queries at hand (``search`` writes it to the shared folder
and reads everything else from there).

Global statistics (number of texts, mean length, document frequencies) cover all texts; a scope only limits what is
returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from passage_engine import session
from passage_engine.functions import porter, scoring, text

#: Rows and bytes of strings of a small side that is sent to all executors; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def small(side: DataFrame, at_most: int | None = None, like: DataFrame | None = None) -> DataFrame:
    """Marks a side for broadcast if it is small: by a bound on its rows, which then hold ids and numbers alone, or by
    counting rows and the bytes of strings, its own or those of ``like``, of which it has no more rows or strings.
    """
    if at_most is not None:
        return F.broadcast(side) if at_most <= BROADCAST_ROWS else side
    held = side if like is None else like
    size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in held.schema if isinstance(f.dataType, StringType)), F.lit(0).cast("long"))
    n, chars = held.select(size.alias("size")).limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(side) if n <= BROADCAST_ROWS and chars <= BROADCAST_BYTES else side


def query_terms(queries: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, place, term, key): a query's content terms once each, and what they are looked up by."""
    terms = queries.select("query_id", F.posexplode(text.content_terms("query")).alias("place", "term"))
    return terms.withColumn("key", porter.stem_of("term") if stem else F.col("term"))


def index(docs: DataFrame, keys: DataFrame | None = None, tokens: Column | None = None) -> DataFrame:
    """The index of (id, text), with all terms or those of a one-column table ``key``."""
    found = docs.select("id", (text.tokens("text") if tokens is None else tokens).alias("tokens"))
    each = found.select("id", F.size("tokens").alias("length"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term"))
    if keys is not None:
        # The empty term stands for the texts' own rows.
        wanted = keys.select(F.explode(F.array("key", F.lit(""))).alias("term")).distinct()
        each = each.join(small(wanted, like=keys.select("key")), "term", "left_semi")
    return each.groupBy("id", "term", "length").agg(F.count(F.lit(1)).alias("tf")).select("id", "term", "tf", "length")


def stored(found: DataFrame) -> DataFrame:
    """The index, written to the shared folder and read from there: the texts are not read again for each use."""
    path = session.scratch(found.sparkSession, "index")
    found.write.parquet(path)
    return found.sparkSession.read.parquet(path)


def postings(found: DataFrame) -> DataFrame:
    """(id, term, tf, length) of an index, without the texts' own rows."""
    return found.where("term <> ''")


def corpus(found: DataFrame) -> DataFrame:
    """One row of an index: n_texts and mean_length."""
    return found.where("term = ''").agg(F.count(F.lit(1)).alias("n_texts"), F.avg("length").alias("mean_length"))


def document_frequencies(found: DataFrame) -> DataFrame:
    return postings(found).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def search(docs: DataFrame, queries: DataFrame, top_n: int, scope: DataFrame | None = None, stem: bool = False) -> DataFrame:
    """(query_id, id, score, rank) of the best ``top_n`` texts of each query; equal scores rank by id.

    With ``stem`` both sides are folded and stemmed, as a full-text index does.
    """
    terms = query_terms(queries, stem)
    return search_index(index_for(docs, terms, stem), terms, top_n, scope)


def index_for(docs: DataFrame, terms: DataFrame, stem: bool = False) -> DataFrame:
    """The stored index of the texts for the keys of ``terms``."""
    return stored(index(docs, terms.select("key"), porter.stemmed("text") if stem else None))


def search_index(found: DataFrame, terms: DataFrame, top_n: int, scope: DataFrame | None = None) -> DataFrame:
    """``search`` of an index for the terms (query_id, key)."""
    entries = postings(found)
    stats = document_frequencies(found).crossJoin(F.broadcast(corpus(found)))  # the corpus is one row
    idf = stats.select("term", "mean_length", scoring.bm25_idf(F.col("n_texts"), F.col("df")).alias("idf"))
    # A query counts a term as often as its own terms lead to it.
    weights = terms.groupBy("query_id", F.col("key").alias("term")).agg(F.count(F.lit(1)).alias("times"))
    if scope is not None:
        entries = entries.join(scope.select("id").distinct(), "id", "left_semi")
    wanted = small(weights.join(idf, "term"), like=terms.select("query_id", "key"))
    part = scoring.bm25_part(F.col("idf"), F.col("tf"), F.col("length"), F.col("mean_length")) * F.col("times")
    total = entries.join(wanted, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    return ranked(total, top_n)


def ranked(hits: DataFrame, top_n: int, score: str = "score") -> DataFrame:
    """The best rows of each query with their rank from 1; scores that differ by rounding alone rank by id."""
    order = W.partitionBy("query_id").orderBy(scoring.level(F.col(score)).desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_n)
