"""Substring dedup by line hashing.

A unit is a paragraph (the lines between blank ones) or a line of it, of ``line_words`` words or more, or a sentence of a
line, of ``MIN_WORDS`` words or more: passages pasted into the middle of a line share whole sentences, not lines. A shorter
sentence makes a unit with those after it in its line, and one with those before it, that bring it to ``MIN_WORDS``. What
a passage shares with the text around it in one sentence stays. Units are normalised (lower case, white space
collapsed) and their digests grouped over all documents; the occurrence of the lowest rank (doc_id, then the text's hash,
then the place in it) is kept and all later ones are removed. Results carry the removed spans, the union of those of all
units, as offsets into the original text.

Texts are cut once, into a table of digests and offsets; only these are shuffled, never texts. What a text repeats of
itself is found there. The group-by is combined before its shuffle and keeps the first place of each digest; only digests
that occur twice come back, in a join whose skewed keys Spark splits.

Defined results: a null or empty text has no units; rows that repeat an id and its text are one document; rows with one
id and unequal texts are separate documents ordered by the text's hash; null ids are one id, which ranks last; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passage_engine import session
from passage_engine.llm.batches import bound

MIN_WORDS = 5
_SENTENCE = re.compile(r".+?(?:[.!?]+(?=\s)|\Z)")


def units(text: str, line_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, digest of 16 bytes) of each unit, in characters of the text."""
    at, lines = 0, []  # (start, end, words) of the paragraph's lines
    for line in text.split("\n"):
        parts = []  # the same of the line's sentences
        for m in _SENTENCE.finditer(line):
            raw = m[0]
            if words := raw.lower().split():
                parts.append((at + m.end() - len(raw.lstrip()), at + m.start() + len(raw.rstrip()), words))
        at += len(line) + 1
        if parts:
            whole = _joined(parts)
            found = {p[:2]: p[2] for p in parts if len(p[2]) >= MIN_WORDS} | _with_neighbours(parts)
            if len(whole[2]) >= line_words:
                found[whole[:2]] = whole[2]
            for (start, end), words in found.items():
                yield start, end - start, _digest(words)
            lines.append(whole)
        if lines and (not parts or at > len(text)):
            if len(lines) > 1:
                start, end, words = _joined(lines)
                if len(words) >= line_words:
                    yield start, end - start, _digest(words)
            lines = []


def _joined(parts: list[tuple[int, int, list[str]]]) -> tuple[int, int, list[str]]:
    return parts[0][0], parts[-1][1], [w for p in parts for w in p[2]]


def _with_neighbours(parts: list[tuple[int, int, list[str]]]) -> dict[tuple[int, int], list[str]]:
    """Each short sentence with the fewest that follow it, and with the fewest before it, that make MIN_WORDS words."""
    found = {}
    for k, (_, _, words) in enumerate(parts):
        if len(words) < MIN_WORDS:
            i, j, n, m = k, k, len(words), len(words)
            while n < MIN_WORDS and j + 1 < len(parts):
                j += 1
                n += len(parts[j][2])
            while m < MIN_WORDS and i > 0:
                i -= 1
                m += len(parts[i][2])
            for size, run in ((n, parts[k : j + 1]), (m, parts[i : k + 1])):
                if size >= MIN_WORDS:
                    start, end, both = _joined(run)
                    found[start, end] = both
    return found


def _digest(words: list[str]) -> bytes:
    return blake2b(" ".join(words).encode(), digest_size=16).digest()


def _explode(pairs: DataFrame, line_words: int) -> DataFrame:
    """A row per unit: doc_id, text_hash, at, n_chars, again (whether the same text has it before), h1, h2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, at, size, again, digests = [], [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                found, first = [*units(text, line_words)], {}
                for start, _, digest in found:
                    first[digest] = min(start, first.get(digest, start))
                for start, length, digest in found:
                    which.append(k)
                    at.append(start)
                    size.append(length)
                    again.append(start > first[digest])
                    digests.append(digest)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            keys = batch.select([0, 1]).take(pa.array(which, pa.int32()))
            columns = [*keys.columns, pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(again, pa.bool_()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "at", "n_chars", "again", "h1", "h2"])

    return pairs.mapInArrow(run, "doc_id long, text_hash long, at int, n_chars int, again boolean, h1 long, h2 long")


def _pairs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))


def repeated_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", line_words: int = MIN_WORDS) -> DataFrame:
    """Spans to remove: doc_id, text_hash, at, n_chars; offsets are in characters of the original text; spans may overlap."""
    spark = docs.sparkSession
    bound(spark)
    path = session.scratch(spark, "line-units")
    _explode(_pairs(docs, doc_id, text), line_words).write.parquet(path)
    found = spark.read.parquet(path)
    # Rank of an occurrence: the least doc_id first, null last, among its rows the least text; within a text its first place.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    fresh = found.where(~F.col("again")).withColumn("place", place)
    groups = fresh.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1").select("h1", "h2", "first")
    later = fresh.join(groups, ["h1", "h2"]).where(~F.col("place").eqNullSafe(F.col("first")))
    spans = ["doc_id", "text_hash", "at", "n_chars"]
    return later.select(*spans).unionByName(found.where("again").select(*spans))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", line_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_chars, n_removed (spans), removed_chars and spans, sorted and apart (start, length)."""
    base = _pairs(docs, doc_id, text).groupBy("doc_id", "text_hash").agg(F.max(F.length("text")).alias("size"))
    found = repeated_units(docs, doc_id, text, line_words).select("doc_id", "text_hash", "at", (F.col("at") + F.col("n_chars")).alias("end"), F.lit(None).cast("int").alias("size"))
    rows = found.unionByName(base.withColumns({"at": F.lit(None).cast("int"), "end": F.lit(None).cast("int")}))
    # A span that starts after all before it end begins a new one; the document's own row, without a span, comes first.
    order = W.partitionBy("doc_id", "text_hash").orderBy("at", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = rows.withColumn("fresh", (F.col("at").isNotNull() & F.coalesce(F.col("at") > before, F.lit(True))).cast("int"))
    runs = fresh.withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    merged = runs.groupBy("doc_id", "text_hash", "run").agg(F.min("at").alias("at"), F.max("end").alias("end"), F.max("size").alias("size"))
    span = F.when(F.col("at").isNotNull(), F.struct("at", (F.col("end") - F.col("at")).alias("n_chars")))
    spans = merged.groupBy("doc_id", "text_hash").agg(F.max("size").cast("long").alias("n_chars"), F.sort_array(F.collect_list(span)).alias("spans"))
    return spans.select(
        "doc_id",
        "n_chars",
        F.size("spans").cast("long").alias("n_removed"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["n_chars"]).alias("removed_chars"),
        "spans",
    )


def keep_rest(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its spans (start, length), which are sorted and apart."""
    parts, end = [], 0
    for start, length in spans:
        parts.append(text[end:start])
        end = start + length
    return "".join([*parts, text[end:]])
