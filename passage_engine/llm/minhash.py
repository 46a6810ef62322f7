"""MinHash near-dedup by ProbMinHash: weighted five-word shingles, banding and exact verification.

Sketch. Each shingle of a text (lower case words; a shorter text is one shingle) sends arrivals of a Poisson process
whose rate is the shingle's count; each arrival falls on one of the sketch's registers, which keeps the shingle that came
first. A shingle stops once its next arrival is later than all registers' first ones. Two texts share a register's
shingle with a probability equal to their probability Jaccard similarity J_P, in which only proportions count.

Candidates. ``BANDS`` bands of ``ROWS`` registers each give a key; texts that share a key may be near. At J_P = 0.8 a
pair shares none with a probability of 5e-6. In each key's group every text is first compared with one hub, the member
met in most groups (the likely origin of near copies), so a group of n takes n - 1 comparisons. Groups of one hub that
the links found so do not connect are compared in full, in pairs of blocks of texts, and hand on only a forest of the
links they find. There posting lists of the block's shingles bound J_P first: as a collision probability of two samples it is
at most the share of either text that both have in common. Nothing is capped or left out.

Verification. J_P of the whole texts, exactly; pairs of ``SIMILARITY`` or more are links, and classes are the links'
connected components. Copies of one text are one vertex throughout: only ids are kept for them. A vertex is named by a
64-bit hash of its text; a second one tells unequal texts of one name apart, which then get other names.

Texts move once, and only from there on those in candidate pairs; otherwise ids and keys are shuffled.

Defined results: null and empty texts are copies of each other, near nothing else; rows that repeat an id each get their
row, with the class of their own text; equal texts are always in one class; of equal ids the row is kept if its id is the
class's least; null ids rank last: a class that holds nothing else has a null component_id, and of its texts the one of the
least hash is kept; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passage_engine import session
from passage_engine.llm.batches import bound
from passage_engine.llm.components import components
from passage_engine.llm.hashing import mix64, windows

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 52, 7
REGISTERS = BANDS * ROWS
#: Texts and characters meant for a block, and characters that are sketched at once.
BLOCK_TEXTS, BLOCK_CHARS, SKETCH_CHARS = 1024, 4 << 20, 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def shingle_weights(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, shingle's hash, count), sorted by number and hash, of whole texts."""
    lines = [" ".join(t.lower().split()) for t in texts]
    raw = np.frombuffer(("\n".join(lines) + "\n").encode(), np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))
    starts = np.concatenate([[0], ends[:-1] + 1])
    line = np.cumsum(raw[ends] == 10) - (raw[ends] == 10)
    real = ends > starts
    starts, ends, line = starts[real], ends[real], line[real]
    words = mix64(windows(raw, starts, ends))
    first = np.searchsorted(line, np.arange(len(texts)))
    count = np.diff(np.append(first, len(line)))
    long = count >= SHINGLE
    heads = np.flatnonzero((np.arange(len(line)) + SHINGLE <= (first + count)[line]) & long[line]) if len(line) else np.zeros(0, np.int64)
    folded = np.zeros(len(heads), np.uint64)
    for k in range(SHINGLE):
        folded = mix64(folded * _FOLD + words[heads + k])
    number, hashes = [line[heads]], [folded]
    for n in range(1, SHINGLE):  # texts of n words
        some = np.flatnonzero(count == n)
        short = np.full(len(some), n, np.uint64)
        for k in range(n):
            short = mix64(short * _FOLD + words[first[some] + k])
        number.append(some)
        hashes.append(short)
    number, hashes = np.concatenate(number), np.concatenate(hashes)
    order = np.lexsort((hashes, number))
    number, hashes = number[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (hashes[1:] != hashes[:-1])])) if len(number) else np.zeros(0, np.int64)
    return number[new], hashes[new], np.diff(np.append(new, len(number)))


def sketch(number: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The shingle in each register, (n, REGISTERS); all texts' arrivals are drawn together, in growing rounds."""
    first = np.full(n * REGISTERS, np.inf)
    held = np.zeros(n * REGISTERS, np.uint64)
    live, time, step, size = np.arange(len(hashes)), np.zeros(len(hashes)), 0, 1
    while len(live):
        owner = hashes[live]
        draws = mix64(owner[:, None] + _STEP * np.arange(step + 1, step + size + 1, dtype=np.uint64))
        gaps = -np.log(((draws >> np.uint64(20)).astype(np.float64) + 0.5) * 2.0**-44) / weights[live, None]
        arrivals = time[live, None] + np.cumsum(gaps, axis=1)
        register = ((draws & np.uint64(0xFFFFF)) * np.uint64(REGISTERS)) >> np.uint64(20)
        at = number[live, None] * REGISTERS + register.astype(np.int64)
        sooner = arrivals < first[at]
        where, when = at[sooner], arrivals[sooner]
        np.minimum.at(first, where, when)
        won = first[where] == when
        held[where[won]] = np.broadcast_to(owner[:, None], at.shape)[sooner][won]
        time[live] = arrivals[:, -1]
        last = first.reshape(n, REGISTERS).max(axis=1)
        live = live[time[live] < last[number[live]]]
        step, size = step + size, min(64, step + size)
    return held.reshape(n, REGISTERS)


def band_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each text, (n, BANDS), and whether it has shingles; about SKETCH_CHARS of text at once."""
    ends = np.cumsum([len(t) for t in texts]) // SKETCH_CHARS
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    found = [_band_keys(texts[i:j]) for i, j in pairwise(edges)]
    return np.concatenate([k for k, _ in found]), np.concatenate([s for _, s in found])


def _band_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    number, hashes, weights = shingle_weights(texts)
    held = sketch(number, hashes, weights, len(texts)).reshape(len(texts), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(texts), BANDS))
    for k in range(ROWS):
        keys = mix64(keys * _FOLD + held[:, :, k])
    return keys.view(np.int64), np.bincount(number, minlength=len(texts)) > 0


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets (sorted hashes, counts): the sum, over what both hold, of one by the sum of larger ratios."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if a[1].max() == 1 and b[1].max() == 1:
        return len(both) / (len(a[0]) + len(b[0]) - len(both))
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    # max(x' / x, y' / y) is x' / x for elements whose ratio is at least this one's, else y' / y.
    at = np.searchsorted(ratio, ratio, "left")
    above = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])[at] + only_a
    below = np.concatenate([[0.0], np.cumsum(y)])[at] + only_b
    return float((1 / (above / x + below / y)).sum())


def _vertex(text: str) -> Column:
    """The name of a text."""
    return F.xxhash64(text)


def _sketched(rows: DataFrame) -> DataFrame:
    """From (doc_id, vertex, check, text): doc_id, vertex, check, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, some = band_keys(batch.column(3).to_pylist())
            ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))], ["doc_id", "vertex", "check", "keys"])

    return rows.select("doc_id", "vertex", "check", "text").mapInArrow(run, "doc_id long, vertex long, check long, keys array<long>")


def _verified(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (u, v) of a member and its hub, from (hub, vertex), whose texts (id, text) have a J_P of SIMILARITY or more.

    A hub's members are dealt in parts of about BLOCK_TEXTS; its own text goes once to each part and stands before them.
    """
    sizes = stars.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("vertex"), F.col("parts")).cast("int")
    members = stars.join(sizes, "hub").select("hub", part.alias("part"), F.col("vertex").alias("id"), F.lit(1).alias("member"))
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("id"), F.lit(0).alias("member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            hub, member, name, text = (c.to_pylist() for c in batch.columns)
            number, hashes, weights = shingle_weights(text)
            ends = np.searchsorted(number, np.arange(len(text) + 1)).tolist()
            keep = []
            for k in range(len(text)):
                mine = hub[k], hashes[ends[k] : ends[k + 1]], weights[ends[k] : ends[k + 1]]
                if not member[k]:
                    own = mine
                elif own[0] == hub[k] and probability_jaccard(own[1:], mine[1:]) >= SIMILARITY:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([name[k] for k in keep], pa.int64()), pa.array([hub[k] for k in keep], pa.int64())], ["u", "v"])

    placed = members.unionByName(hubs).join(texts, "id").repartition("hub", "part").sortWithinPartitions("hub", "part", "member")
    return placed.select("hub", "member", "id", "text").mapInArrow(run, "u long, v long")


def _forest(own: dict[int, str], component: dict[int, int]) -> list[tuple[int, int]]:
    """Links between texts (by id) of SIMILARITY or more that connect what all such links and the components connect."""
    names = list(own)
    number, hashes, weights = shingle_weights([own[k] for k in names])
    ends = np.searchsorted(number, np.arange(len(names) + 1))
    sets = [(hashes[s:e], weights[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
    share = weights / np.bincount(number, weights, minlength=len(names))[number]
    _, column = np.unique(hashes, return_inverse=True)
    order = np.argsort(column, kind="stable")
    holder, held = number[order], share[order]
    begin = np.searchsorted(column[order], np.arange(column.max() + 2 if len(column) else 1))
    parent = {c: c for c in component.values()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    # Texts of the largest component are connected already; every other text is compared with all that may be near it.
    inside = Counter(component.values())
    largest = max(inside, key=inside.get, default=None)
    out = []
    for i, name in enumerate(names):
        if component[name] == largest:
            continue
        own_columns = column[ends[i] : ends[i + 1]]
        size = begin[own_columns + 1] - begin[own_columns]
        at = np.repeat(begin[own_columns + 1] - np.cumsum(size), size) + np.arange(size.sum())
        mine = np.bincount(holder[at], np.repeat(share[ends[i] : ends[i + 1]], size), len(names))
        theirs = np.bincount(holder[at], held[at], len(names))
        for j in np.flatnonzero(np.minimum(mine, theirs) >= SIMILARITY - 1e-9).tolist():
            a, b = root(component[name]), root(component[names[j]])
            if a != b and probability_jaccard(sets[i], sets[j]) >= SIMILARITY:
                parent[max(a, b)] = min(a, b)
                out.append((name, names[j]))
    return out


def _rest(stars: DataFrame, parts: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among the members of hubs (hub, vertex) whose members the parts (id, component) do not connect."""
    members = stars.unionByName(stars.select("hub", F.col("hub").alias("vertex")).distinct())
    # Hubs of one component make one group, so that two texts meet once however many hubs they share.
    of_hub = parts.select(F.col("id").alias("hub"), F.col("component").alias("group"))
    grouped = members.join(of_hub, "hub", "left").select(F.coalesce("group", "hub").alias("hub"), "vertex").distinct()
    named = grouped.join(parts, grouped.vertex == parts.id, "left").select("hub", "vertex", F.coalesce("component", "vertex").alias("component")).checkpoint()
    sized = named.join(texts.select(F.col("id").alias("vertex"), F.length("text").alias("size")), "vertex")
    apart = sized.groupBy("hub").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars")).where("a <> b and n > 2")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("chars") / BLOCK_CHARS)).cast("int")
    placed = named.join(apart.select("hub", blocks.alias("blocks")), "hub").withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("vertex").alias("id"), "component")

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        found = _forest(dict(zip(ids, table.column("text").to_pylist(), strict=True)), dict(zip(ids, table.column("component").to_pylist(), strict=True)))
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return pairs.join(texts, "id").groupBy("hub", "i", "j").applyInArrow(compare, "u long, v long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, vertex and check (hashes of its text), component_id (least doc_id of its class), kept (whether its id is that)."""
    spark = docs.sparkSession
    bound(spark)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text")).withColumns({"vertex": _vertex("text"), "check": F.xxhash64(F.lit(1), "text")})
    path = session.scratch(spark, "minhash-keys")
    _sketched(rows).write.parquet(path)
    keyed = spark.read.parquet(path)
    # Unequal texts whose names are equal get other names, from both hashes: 128 bits tell texts apart.
    clash = keyed.groupBy("vertex").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("vertex")
    if not clash.isEmpty():
        again = lambda df: df.join(clash.withColumn("clash", F.lit(True)), "vertex", "left").withColumn("vertex", F.when(F.col("clash"), F.xxhash64("vertex", "check")).otherwise(F.col("vertex"))).drop("clash")
        keyed, rows = again(keyed), again(rows)
    members = keyed.select("doc_id", "vertex", "check")
    # Keys that two different texts share, then their texts.
    spread = keyed.select("vertex", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("vertex").alias("a"), F.max("vertex").alias("b")).where("a <> b").select("key")
    groups = spread.join(shared, "key").distinct().checkpoint()
    sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    degree = groups.join(sizes, "key").groupBy("vertex").agg(F.sum("n").alias("degree"))
    hubs = groups.join(degree, "vertex").groupBy("key").agg(F.max(F.struct("degree", "vertex")).alias("hub")).select("key", F.col("hub.vertex").alias("hub"))
    stars = groups.join(hubs, "key").where("vertex <> hub").select("hub", "vertex").distinct().checkpoint()
    # One row of each text that is in a group; found by id and text, so copies do not meet in one task.
    first = members.groupBy("vertex").agg(F.min("doc_id").alias("doc_id"))
    wanted = first.join(groups.select("vertex").distinct(), "vertex")
    chosen = wanted.select(F.col("vertex").alias("id"), F.col("doc_id").alias("first_id"))
    found = rows.join(chosen, (rows.vertex == chosen.id) & rows.doc_id.eqNullSafe(chosen.first_id)).select("id", "text")
    text_path = session.scratch(spark, "minhash-texts")
    found.dropDuplicates(["id"]).write.parquet(text_path)
    texts = spark.read.parquet(text_path)
    links = _verified(stars, texts).checkpoint()
    parts = components(links)
    more = _rest(stars, parts, texts).checkpoint()
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    # From vertices to documents: the least doc_id of a class names it.
    named_first = first.join(parts, first.vertex == parts.id, "left").select("vertex", "doc_id", F.coalesce("component", "vertex").alias("component"))
    least = named_first.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = named_first.join(least, "component").select("vertex", "component", "component_id")
    # A class of null ids alone has no least id; its component is the least vertex.
    kept = F.expr("doc_id <=> component_id AND (doc_id IS NOT NULL OR vertex = component)")
    return members.join(of, "vertex").select("doc_id", "vertex", "check", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the least id of their class, one per class; of equal ids with equal texts one stays."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kept = classes(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("_kept"), F.col("check").alias("_text")).distinct()
    marked = docs.withColumn("_tie", F.xxhash64(F.lit(1), body))
    same = marked[f"`{doc_id}`"].eqNullSafe(kept["_kept"]) & (marked["_tie"] == kept["_text"])
    return marked.join(kept, same, "left_semi").dropDuplicates([doc_id, "_tie"]).drop("_tie")
