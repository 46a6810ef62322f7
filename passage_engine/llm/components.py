"""Connected components of a table of links, by alternating large and small stars.

Each round points every vertex's larger neighbours, then its smaller ones, at the least vertex it knows; the links of a
component thus turn into a star around its least vertex, in a number of rounds that grows with the logarithm of its size.
A vertex may have any number of links: minima are combined before the shuffle, and the join that hands them back is one
whose skewed keys Spark splits. Lineage is cut by ``checkpoint`` in the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage_engine import session

MOST_ROUNDS = 60


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """For each u: larger neighbours are linked to the least of u and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "least").alias("least"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """For each u: u and its smaller neighbours are linked to the least of these."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (u, v), long ids: (id, component) of every vertex, the component named by its least vertex."""
    session.shared_dir(links.sparkSession)
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    # Equal sums of two hashes over the links mean equal links, but for a chance of 2^-64 or so.
    mark = [F.count(F.lit(1)), *(F.coalesce(F.bit_xor(F.xxhash64("u", "v", F.lit(k))), F.lit(0)) for k in (1, 2))]
    seen = tuple(now.agg(*mark).first())
    for _ in range(MOST_ROUNDS):
        now = _small_star(_large_star(now)).checkpoint()
        found = tuple(now.agg(*mark).first())
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
