"""Embedding near-dedup: an exact metric range join of vectors of one label.

Vectors are normalised; a cosine of at least ``COSINE`` is a distance of at most r = sqrt(2 - 2 COSINE). Equal vectors of
a label are joined as one with its number of copies. A label with more rows than a cell should hold gets pivots, drawn
by a hash of its vectors in proportion to its rows and at most ``MOST_PIVOTS`` in all, so what is broadcast has a bound.
Each vector lives in the cell of its nearest pivot p. By the triangle inequality two vectors within r of each other that
live in the cells of p and q satisfy d(x, q) <= d(x, p) + 2 r, and, as the boundary between the cells is a plane, x is
within r of it; a vector is replicated to the cells where both hold. A cell thus has all partners of its residents and is
joined by itself. A cell of more than ``BLOCK`` vectors is cut into blocks that meet pairwise, so no task holds more
than two blocks, however many vectors are alike.

Inside a pair of blocks the cosines are computed in double precision. Residents get their number of links there, and the
links are handed on as a forest that connects the same vectors, so a group of n near vectors gives n rows, not n * n.

Defined results: a vector that is null, of zero length, or has null or non-finite components has no links, nor has one
whose label is null; vectors of unequal widths are not linked; each repeated row counts as a vector of its own, except
that rows of one id are one vertex of the components; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passage_engine import session
from passage_engine.llm.batches import bound
from passage_engine.llm.components import components

COSINE = 0.98
#: Vectors meant for a cell, vectors in a block, pivots of all labels together (about 500 bytes each at width 64), and
#: distances to pivots that a task holds at once.
CELL, BLOCK, MOST_PIVOTS, DISTANCES = 512, 2048, 32768, 4 << 20
#: Slack for rounding when distances decide where a vector is sent; links themselves are decided by the cosine alone.
SLACK = 1e-6


def _unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(unit: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, pivot, whether it lives there) for every cell that a vector is sent to; a bounded number of distances at once."""
    step = max(1, DISTANCES // len(pivots))
    found = []
    for k in range(0, max(1, len(unit)), step):
        vector, cell, home = _cells(unit[k : k + step], pivots, radius)
        found.append((vector + k, cell, home))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _cells(unit: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    squares = np.maximum(2 - 2 * (unit @ pivots.T), 0)
    home = squares.argmin(axis=1)
    near = squares[np.arange(len(unit)), home][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * (pivots[home] @ pivots.T), 0))
    triangle = np.sqrt(squares) <= np.sqrt(near) + 2 * radius + SLACK
    plane = squares - near <= 2 * apart * (radius + SLACK) + SLACK
    sent = triangle & plane
    sent[np.arange(len(unit)), home] = True
    vector, cell = np.nonzero(sent)
    return vector, cell, cell == home[vector]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect what the links a[i] - b[i] connect, at most n - 1 of them."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        s, t = root(x), root(y)
        if s != t:
            parent[max(s, t)] = min(s, t)
            out.append((x, y))
    return out


def joined(table: pa.Table, cosine: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of one pair of blocks (side, id, x, copies): (id, links of a resident, copies counted) and a forest of the links (id, id)."""
    side, ids, copies = (table.column(c).to_numpy() for c in ("side", "id", "copies"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return [], []
    unit = _unit(table.column("x").combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
    a, b, own, others = unit[left], unit[right], ids[left], ids[right]
    n_links, links_a, links_b = np.zeros(len(left), np.int64), [], []
    for k in range(0, len(left), 256):
        near = (a[k : k + 256] @ b.T >= cosine) & (own[k : k + 256, None] != others[None, :])
        n_links[k : k + 256] = near @ copies[right]
        i, j = np.nonzero(near)
        links_a.append(own[i + k])
        links_b.append(others[j])
    found = [(int(own[i]), int(n_links[i])) for i in np.flatnonzero(n_links)]
    # The same vector may stand on both sides: links are between ids.
    names, place = np.unique(np.concatenate([*links_a, *links_b]), return_inverse=True)
    half = len(place) // 2
    return found, [(int(names[x]), int(names[y])) for x, y in _forest(place[:half], place[half:], len(names))]


def links(vectors: DataFrame, cosine: float, path: str) -> None:
    """Writes (id, n, other) rows to ``path``: link counts of distinct vectors (other null) and forests (n null).

    ``vectors`` has id, label, x (array of doubles) and copies, one row per distinct vector.
    """
    spark, radius = vectors.sparkSession, math.sqrt(max(0.0, 2 - 2 * cosine))
    total = vectors.count()
    # Only labels of more than a cell need pivots; there are at most total / CELL of them, and MOST_PIVOTS are drawn.
    share = min(1.0 / CELL, MOST_PIVOTS / max(1, 2 * total))
    per_label = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    drawn = vectors.where((F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))).join(per_label, "label", "left_semi")
    picked = drawn.select("label", "x").limit(MOST_PIVOTS).collect()
    grouped: dict = {}
    for row in sorted(picked, key=lambda r: r["x"]):
        grouped.setdefault((row["label"], len(row["x"])), []).append(row["x"])
    pivots = spark.sparkContext.broadcast({k: _unit(v) for k, v in grouped.items()})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, flat = batch.column(2).value_lengths().to_pylist(), batch.column(2)
            rows: dict = {}
            for k, key in enumerate(zip(batch.column(1).to_pylist(), widths, strict=True)):
                rows.setdefault(key, []).append(k)
            vector, cell, home = [], [], []
            for key, own in rows.items():
                if key in pivots.value:
                    v, c, h = cells(_unit(flat.take(pa.array(own)).flatten().to_numpy().reshape(len(own), -1)), pivots.value[key], radius)
                    vector += [own[k] for k in v.tolist()]
                    cell += c.tolist()
                    home += h.tolist()
                else:
                    vector, cell, home = vector + own, cell + [0] * len(own), home + [True] * len(own)
            taken = batch.take(pa.array(vector, pa.int32()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32()), pa.array(home, pa.bool_())], ["id", "label", "x", "copies", "cell", "home"])

    sent = vectors.select("id", "label", "x", "copies").mapInArrow(send, "id long, label string, x array<double>, copies long, cell int, home boolean")
    sent_path = session.scratch(spark, "vector-cells")
    sent.withColumn("width", F.size("x")).write.parquet(sent_path)
    dealt = spark.read.parquet(sent_path)
    keys = ["label", "width", "cell"]
    sizes = dealt.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = dealt.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # Residents of a block meet all vectors of every block of the cell.
    left = placed.where("home").select(*keys, F.col("block").alias("i"), F.explode(every).alias("j"), F.lit(0).alias("side"), "id", "x", "copies")
    right = placed.select(*keys, F.explode(every).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "id", "x", "copies")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        found, forest = joined(table, cosine)
        rows = [(i, n, None) for i, n in found] + [(i, None, o) for i, o in forest]
        ids, n, other = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "other": pa.array(other, pa.int64())})

    both = left.unionByName(right)
    both.groupBy(*keys, "i", "j").applyInArrow(join, "id long, n long, other long").write.parquet(path)


def near_duplicates(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    bound(spark)
    rows = embeddings.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists("x", lambda c: c != 0), F.lit(False))
    # Equal vectors: found by two hashes of label and components, 128 bits together.
    marked = rows.select("vec_id", valid.alias("valid"), "label", "x", F.xxhash64("label", "x").alias("h1"), F.xxhash64("x", F.lit(1), "label").alias("h2"))
    alike = marked.where("valid").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("id"))
    vectors_path, links_path = session.scratch(spark, "vectors"), session.scratch(spark, "vector-links")
    named = marked.where("valid").select("vec_id", "h1", "h2", "label", "x")
    # The row of the least id stands for its copies; joined by id too, so copies do not meet in one task.
    own = alike.withColumnRenamed("id", "vec_id")
    named.join(own, ["h1", "h2", "vec_id"]).dropDuplicates(["h1", "h2", "vec_id"]).withColumnRenamed("vec_id", "id").write.parquet(vectors_path)
    vectors = spark.read.parquet(vectors_path)
    links(vectors.select("id", "label", "x", "copies"), cosine, links_path)
    found = spark.read.parquet(links_path)
    counts = found.where("n is not null").groupBy("id").agg(F.sum("n").alias("others"))
    parts = components(found.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v"))).withColumnRenamed("id", "part_id")
    about = vectors.select("h1", "h2", "id", "copies").join(counts, "id", "left").join(parts, F.col("id") == F.col("part_id"), "left")
    about = about.select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = marked.select("vec_id", "valid", F.when(F.col("valid"), F.col("h1")).alias("h1"), F.when(F.col("valid"), F.col("h2")).alias("h2")).join(about, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: DuckDB SQL for ``near_duplicates`` over embeddings.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reach AS (
  SELECT vec_id AS id, vec_id AS r FROM embeddings
  UNION
  SELECT reach.id, links.v FROM reach JOIN links ON reach.r = links.u),
parts AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN parts p ON p.id = e.vec_id LEFT JOIN counts c ON c.u = e.vec_id
"""
