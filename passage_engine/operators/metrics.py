"""Retrieval metrics of ranked lists against relevance judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_occurrences(run: DataFrame) -> DataFrame:
    """(query_id, id, rank): each id once per query, ranks closed up."""
    once = run.groupBy("query_id", "id").agg(F.min("rank").alias("at"))
    return once.select("query_id", "id", F.row_number().over(W.partitionBy("query_id").orderBy("at")).cast("long").alias("rank"))


def per_query(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, hit, ndcg, rr) for every judged query; precision divides by k, rr uses the whole list."""
    judged = qrels.select("query_id", "id").distinct()
    relevant = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = first_occurrences(run).join(judged, ["query_id", "id"])
    top = F.col("rank") <= k
    found = hits.groupBy("query_id").agg(F.count_if(top).alias("n_hits"), F.min("rank").alias("first"), F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    n = F.coalesce("n_hits", F.lit(0))
    return relevant.join(found, "query_id", "left").select(
        "query_id",
        (n / F.col("n_relevant")).alias("recall"),
        (n / F.lit(float(k))).alias("precision"),
        F.when(n > 0, 1.0).otherwise(0.0).alias("hit"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.coalesce(1 / F.col("first").cast("double"), F.lit(0.0)).alias("rr"),
    )


def summary(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """One row: means of the queries' metrics, themselves rounded to four decimals, MRR and the share without hits."""
    each = per_query(run, qrels, k)
    empty = qrels.select("query_id").distinct().join(run.select("query_id").distinct(), "query_id", "left_anti")
    means = [F.round(F.avg(F.round(m, 4)), 4).alias(m) for m in ("recall", "precision", "hit", "ndcg")]
    one = each.agg(F.count(F.lit(1)).alias("queries"), *means, F.round(F.avg("rr"), 4).alias("mrr"))
    share = empty.agg(F.count(F.lit(1)).alias("n_empty"))
    return one.crossJoin(share).withColumn("zero_result_rate", F.round(F.coalesce(F.try_divide("n_empty", "queries"), F.lit(0.0)), 4)).drop("n_empty")


def level_counts(queries: DataFrame) -> DataFrame:
    """One row of (query_id, level): queries judged by chunks and by documents."""
    return queries.agg(F.count_if(F.col("level") == "chunk").alias("chunk_queries"), F.count_if(F.col("level") == "doc").alias("doc_queries"))


def report(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Per query: the ids retrieved, in order and once each, how many are relevant, and the metrics at each depth."""
    listed = first_occurrences(run).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("x")).select("query_id", F.array_join(F.transform("x", lambda r: r["id"].cast("string")), ",").alias("retrieved"))
    out = qrels.select("query_id", "id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant")).join(listed, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.lit("")))
    for k in ks:
        each = per_query(run, qrels, k)
        out = out.join(each.select("query_id", *(F.round(m, 4).alias(f"{m}_at_{k}") for m in ("recall", "precision", "hit", "ndcg")), *([F.round("rr", 4).alias("rr")] if k == ks[0] else [])), "query_id")
    return out


def latency(times: DataFrame, seconds: str = "seconds") -> DataFrame:
    """One row of count, mean, nearest-rank p50 and p95, min and max; zeros without rows."""

    def rank(p: float) -> Column:
        return F.coalesce(F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{seconds}`)"), 4), F.lit(0.0))

    zero = F.lit(0.0)
    return times.agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.round(F.avg(seconds), 4), zero).alias("mean_s"),
        rank(0.5).alias("p50_s"),
        rank(0.95).alias("p95_s"),
        F.coalesce(F.round(F.min(seconds), 4), zero).alias("min_s"),
        F.coalesce(F.round(F.max(seconds), 4), zero).alias("max_s"),
    )
