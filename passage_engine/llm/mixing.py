"""Mixing sources to target weights.

Each source gets a share of the wanted words by weight, at most ``MOST_EPOCHS`` times its own words; what a full source
cannot take is shared among the others by weight. A source's documents stand in a random order: by a hash of their ids.
The order is cut into equal ranges of the hash, as many as the source has rows for, so a source that holds a third of
all rows is spread like the others; sums per range give each range's start, a window within a range gives each
document's start, and the source's budget ends at an exact word: whole epochs first, then documents from the start of
the order, the last of them in part.

Only ids, sources, sizes and hashes are shuffled. ``take`` applies the same cuts to whole rows without moving them.

Defined results: a null or empty text has no words and takes none; a null source is a source of its own, ordered last;
rows with one id and unequal texts are ordered by size; repeated rows each take their own part; empty tables give none;
columns of other names are kept by ``take`` and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passage_engine import session

WEIGHTS, SHARE, MOST_EPOCHS = (5, 2, 1), 1.5, 2
#: Rows in a range of the hash, and sources whose cuts are sent to all executors (about 100 bytes each).
RANGE_ROWS, BROADCAST_SOURCES = 2048, 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORDS)), F.lit(0)).cast("long")


def _key(doc_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.lit(f":{seed}")))


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, size) rows: source, rows, source_size, target. One row per source, in one window over them."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1).cast("int"))
    most = F.lit(float(MOST_EPOCHS)) * F.col("source_size")
    # In order of most / weight, sources fill up one after the other; the level is what a unit of weight gets at last.
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    before = F.sum("most").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("most")
    weights = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    step = (F.lit(SHARE) * F.sum("source_size").over(whole) - before) / weights
    return (
        per.withColumn("weight", weight)
        .withColumn("most", most)
        .withColumn("step", step)
        .withColumn("level", F.max("step").over(whole))
        .select("source", "rows", "source_size", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target"))
    )


def _placed(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """Per row: doc_id, source, size, key, rows, source_size, target, epochs, rest (words after whole epochs), before."""
    spark = docs.sparkSession
    path = session.scratch(spark, "mix-sizes")
    docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), _size(text).alias("size"), _key(doc_id, seed).alias("key")).write.parquet(path)
    sizes = spark.read.parquet(path)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    goals = targets(sizes).withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")).withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS))
    goals = _small(goals.withColumnRenamed("source", "of"))
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranged = sizes.join(goals, sizes.source.eqNullSafe(goals.of)).drop("of").withColumn("range", F.floor(share * F.col("ranges") / F.lit(1 << 32)))
    totals = ranged.groupBy("source", "range").agg(F.sum("size").alias("n"))
    starts = totals.select(F.col("source").alias("s"), F.col("range").alias("r"), (F.sum("n").over(W.partitionBy("source").orderBy("range")) - F.col("n")).alias("start"))
    inside = F.sum("size").over(W.partitionBy("source", "range").orderBy("key", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    within = ranged.withColumn("inside", inside)
    return within.join(starts, within.source.eqNullSafe(starts.s) & (within.range == starts.r)).withColumn("before", F.col("start") + F.col("inside")).drop("s", "r")


def _small(sources: DataFrame) -> DataFrame:
    """Marks a table of one row per source for broadcast where it has few rows; else Spark splits skewed keys."""
    return F.broadcast(sources) if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else sources


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """Per row: doc_id, size, source_size, target and the words taken."""
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return _placed(docs, doc_id, text, source, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs") + part).alias("taken"))


def take(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """The mixed rows themselves, whole: each as often as epochs reach it, the row at a source's cut included."""
    placed = _placed(docs, doc_id, text, source, seed)
    reached = F.when((F.col("rest") > 0) & (F.col("before") < F.col("rest")), F.col("key"))
    cuts = _small(placed.groupBy("source").agg(F.max("epochs").alias("_epochs"), F.max(reached).alias("_last")).withColumnRenamed("source", "_of"))
    copies = F.col("_epochs") + F.coalesce(F.col("_key") <= F.col("_last"), F.lit(False)).cast("long")
    rows = docs.withColumn("_key", _key(doc_id, seed))
    joined = rows.join(cuts, rows[f"`{source}`"].eqNullSafe(cuts["_of"])).withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))


#: DuckDB SQL for ``mix`` over documents, with the constants above.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17') AS key
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM per),
steps AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - (sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - most))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step
  FROM weighed),
goals AS (SELECT source, source_size, least(most, max(step) OVER () * weight) AS target FROM steps),
budgets AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS BIGINT) AS epochs,
         CAST(floor(target) AS BIGINT) AS budget
  FROM goals),
placed AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d)
SELECT p.doc_id, p.size, b.source_size, b.target,
       CAST(p.size * b.epochs + greatest(0, least(p.size, b.budget - b.epochs * b.source_size - p.before)) AS BIGINT) AS taken
FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
"""
