"""Suffix-array dedup: bytes covered by a string of ``MATCH`` bytes that also starts elsewhere are removed.

The construction is blockwise suffix sorting with a difference cover. A difference cover modulo v is a set of residues such
that any two positions i, j have a shift s < v with both i + s and j + s in the set.

1. Pruning. Two equal strings of MATCH bytes hold equal strings of MATCH - v + 1 bytes at positions of a cover. Suffixes at
   the positions of a wide cover, about one in seventeen, are keyed by a hash of those bytes, and the suffixes that a shared
   key lets through by a hash of their first MATCH bytes. Hashes only leave out suffixes that cannot repeat: equal strings
   have equal hashes. Nothing is taken as repeated because of a hash.
2. Blocks. Within a block, suffixes of one key are compared byte by byte with the first of them; equal ones are one class,
   and a class goes to the other blocks once. Step 3 reads the bytes of these suffixes alone, not whole blocks.
3. Buckets. The suffixes that other blocks may have too are dealt by the least hash of the short strings within their MATCH
   bytes: equal suffixes have the same one, and neighbours mostly share it. So a run of neighbours goes to a bucket as one
   stretch of text, MATCH - 1 bytes longer than the run, and not as so many strings.
4. Sorting. In a bucket, the suffixes at the positions of a narrow cover (modulo ``v`` of about MATCH / 12) are sorted by
   their first MATCH - v + 1 bytes and ranked. The suffixes themselves are sorted by their first v - 1 and the last v - 1 of
   their MATCH bytes; ties between are resolved by the ranks at the shift that the cover gives for the pair. Both are worked
   off one range of leading letters at a time, so that a large bucket needs no more memory for strings than a small one.
5. Every suffix that is equal to another one covers MATCH bytes of its document; what is covered is cut out.

Texts are packed once into blocks of about ``BLOCK`` bytes, in a table bucketed by block, so that no later step moves them.
A passage that any number of documents share sends its suffixes once per block. Equal texts, told apart by 128 bits, are one
text from the start.

Defined results: null and empty texts, and texts shorter than MATCH bytes, keep all; a text of MATCH bytes or more that
occurs in two rows is removed from both; rows of one id are separate documents; strings never cross documents; other
columns are ignored, or kept by ``without_repeats``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from passage_engine import session
from passage_engine.llm.batches import bound
from passage_engine.llm.hashing import mix64, windows

MATCH = 400
#: Bytes of text in a block, and bytes of keys meant for a bucket.
BLOCK, BUCKET = 4 << 20, 8 << 20
#: Suffixes meant for a bucket, suffixes sorted at once, of which one of ``SPARSE`` divides the ranges, and their letters.
BUCKET_SUFFIXES, SORTED, SPARSE, LETTERS = 1 << 18, 1 << 19, 256, 64
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def difference_cover(most: int) -> tuple[int, tuple[int, ...]]:
    """The largest modulus up to ``most`` for which Singer's construction over a prime field gives a cover, and the cover.

    The powers of a generator of the field of p ** 3 elements whose last coordinate is 0 form, as exponents modulo
    p * p + p + 1, a set of p + 1 residues in which each difference occurs once.
    """
    p = max(q for q in range(2, 60) if all(q % d for d in range(2, q)) and q * q + q + 1 <= most)
    v = p * p + p + 1
    for a in range(p):
        for b in range(p):
            for c in range(1, p):
                x, found = (1, 0, 0), []
                for e in range(v):
                    if x[2] == 0:
                        found.append(e)
                    # Times the generator t, with t ** 3 = a t ** 2 + b t + c.
                    x = (x[2] * c % p, (x[0] + x[2] * b) % p, (x[1] + x[2] * a) % p)
                if len(found) == p + 1 and len({(i - j) % v for i in found for j in found}) == v:
                    return v, tuple(found)
    raise ValueError(f"no cover of modulus {v}")


class Block:
    """The texts of a block and the keys of their suffixes."""

    #: Bytes compared at once.
    COMPARED = 1 << 20

    def __init__(self, payload: bytes, lengths: list[int], match: int):
        self.match, self.raw = match, np.frombuffer(payload, np.uint8)
        self.ends = np.cumsum(np.array(lengths, np.int64))
        self.starts = self.ends - np.array(lengths, np.int64)
        self.modulus, self.cover = difference_cover(max(7, match * 4 // 5))

    def _keys(self, at: np.ndarray, length: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, sorted; each position's place among them; which of them occur twice in this block."""
        keys, place, count = np.unique(mix64(windows(self.raw, at, at + length, which=which)), return_inverse=True, return_counts=True)
        return keys, place, count > 1

    def sampled(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        length = self.match - self.modulus + 1
        at = (np.arange(0, len(self.raw), self.modulus)[:, None] + np.array(self.cover)).ravel()
        at = at[at + length <= len(self.raw)]
        at = at[at + length <= self.ends[np.searchsorted(self.ends, at, "right")]]
        return at, self._keys(at, length, 0)

    def suffixes(self, bits: bytes) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Suffixes that may repeat, from the answer to the sampled keys."""
        at, (keys, place, twice) = self.sampled()
        shared = at[(twice | _unpacked(bits, len(keys)))[place]]
        text = np.searchsorted(self.ends, shared, "right")
        low = np.maximum(shared - (self.modulus - 1), self.starts[text])
        high = np.minimum(shared, self.ends[text] - self.match)
        low, high = low[high >= low], high[high >= low]
        may = np.flatnonzero(_covered(low, high + 1, len(self.raw)))
        return may, self._keys(may, self.match, 1)

    def strings(self, at: np.ndarray, length: int) -> np.ndarray:
        """The bytes from each position on, as an array of byte strings of one length."""
        shape = (max(0, len(self.raw) - length + 1),)
        return np.ndarray(shape, f"S{length}", self.raw, strides=(1,))[at]

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes from a and from b, as many as match, are the same.

        Neighbours at one distance from their partners are a run, whose bytes are compared once.
        """
        same = a == b
        rest = np.flatnonzero(~same)
        if not len(rest):
            return same
        at, apart = a[rest], (a - b)[rest]
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(apart) != 0)]))
        count = np.diff(np.append(begin, len(at)))
        size = count + self.match - 1
        share = np.cumsum(size) // self.COMPARED
        equal = np.zeros(len(begin), bool)
        for runs in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(share)) + 1):
            offsets = np.cumsum(size[runs]) - size[runs]
            places = np.arange(size[runs].sum()) + np.repeat(at[begin[runs]] - offsets, size[runs])
            alike = self.raw[places] == self.raw[places - np.repeat(apart[begin[runs]], size[runs])]
            equal[runs] = np.logical_and.reduceat(alike, offsets)
        same[rest] = np.repeat(equal, count)
        for k in rest[np.repeat(~equal, count)].tolist():  # a run that differs somewhere: each of its suffixes by itself
            same[k] = np.array_equal(self.raw[a[k] : a[k] + self.match], self.raw[b[k] : b[k] + self.match])
        return same

    def classes(self, bits: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes that may repeat and the class of each; per class of equal suffixes its first position, whether it
        occurs twice here, and whether another block may have it.
        """
        at, (keys, place, twice) = self.suffixes(bits)
        other = _unpacked(more, len(keys))
        held = (twice | other)[place]
        at, place = at[held], place[held]
        key = np.flatnonzero(twice | other)
        first = np.zeros(len(keys), np.int64)
        first[place[::-1]] = at[::-1]  # of equal places the last one written, the first position, stays
        first, asked = first[key], other[key]
        of = (np.cumsum(twice | other) - 1)[place]
        strays = np.flatnonzero(~self._equal(at, first[of]))  # one key, other bytes
        of[strays] = len(first) + np.arange(len(strays))
        first, asked = np.concatenate([first, at[strays]]), np.concatenate([asked, np.ones(len(strays), bool)])
        by = np.argsort(first)  # classes in the order of their places
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        of = number[of]
        return at, of, first[by], np.bincount(of, minlength=len(first)) > 1, asked[by]


def narrow_cover(match: int) -> tuple[int, np.ndarray]:
    """Modulus v of the ranked cover, and per residue r the shifts s < v with r + s in the cover."""
    v, cover = difference_cover(max(7, match // 12))
    return v, np.sort((np.array(cover)[None, :] - np.arange(v)[:, None]) % v, axis=1)


def _covered(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    step = np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def _unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin among sorted keys; buckets are equal ranges of the key."""
    limits = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])


def _sent(block: int, keys: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    e = _edges(keys, buckets)
    full = np.flatnonzero(e[1:] > e[:-1])
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([block] * len(full), pa.int64()), pa.array([keys[e[b] : e[b + 1]].tobytes() for b in full], pa.binary())], ["bucket", "block", "keys"])


def _answer(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block's keys, which of them another block has too. Bits of a block are kept as bytes."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys) + 1, bool)
    shared[1:-1] = same
    shared[:-2] |= same
    out = np.empty(len(keys), bool)
    out[order] = shared[:-1]
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(out[e - len(p) : e]).tobytes() for p, e in zip(parts, ends, strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": pa.array([len(p) for p in parts], pa.int32()), "bits": pa.array(bits, pa.binary())})


def _joined_bits(answers: list[dict] | None) -> bytes:
    """One run of bits from the answers of all buckets, in the buckets' order."""
    parts = [_unpacked(a["bits"], a["n"]) for a in sorted(answers or [], key=lambda a: a["bucket"])]
    return np.packbits(np.concatenate(parts)).tobytes() if parts else b""


def _asked(blocks: DataFrame, buckets: int, keys_of) -> DataFrame:
    """Answers to all blocks: block, answers (array of bucket, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _sent(row["block"], keys_of(row), buckets)

    sent = blocks.mapInArrow(run, "bucket int, block long, keys binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block long, bucket int, n int, bits binary")
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("answers"))


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))


def _results(docs: DataFrame, doc_id: str, text: str, match: int, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2, n_bytes, short_sha256) of each row, and per distinct text of MATCH bytes or more: h1, h2,
    n_removed, n_spans, kept_sha256, kept.
    """
    spark = docs.sparkSession
    bound(spark)
    rows = _hashed(docs, doc_id, text)
    base_path = session.scratch(spark, "repeats-rows")
    rows.select("doc_id", "h1", "h2", "n_bytes", F.when(F.col("n_bytes") < match, F.sha2("text", 256)).alias("short_sha256")).write.parquet(base_path)
    base = spark.read.parquet(base_path)
    firsts = base.where(F.col("n_bytes") >= match).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("size"))
    total = firsts.agg(F.sum("size")).first()[0] or 0
    # Joined by id as well as by text, so that copies of one text do not meet in one task.
    named = firsts.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first", "copies")
    long = rows.where(F.col("n_bytes") >= match)
    texts = long.join(named, (long.h1 == named.f1) & (long.h2 == named.f2) & long.doc_id.eqNullSafe(named["first"])).select("h1", "h2", "copies", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        names = ["block", "h1", "h2", "copies", "lengths", "payload"]

        def out() -> pa.RecordBatch:
            h1, h2, copies, parts = (list(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.list_(pa.int64())) for x in (h1, h2, copies)), pa.array([[len(p) for p in parts]], pa.list_(pa.int32())), pa.array([b"".join(parts)], pa.binary())], names)

        for batch in batches:
            for h1, h2, copies, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((h1, h2, copies, part := t.encode()))
                size += len(part)
                if size >= BLOCK:
                    yield out()
                    held, size, number = [], 0, number + 1
        if held:
            yield out()

    name, place = f"repeat_blocks_{uuid.uuid4().hex}", session.scratch(spark, "repeats-blocks")
    packed = texts.mapInArrow(pack, "block long, h1 array<long>, h2 array<long>, copies array<long>, lengths array<int>, payload binary")
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    made, freed = [place], spark.conf.get(FREE_SHUFFLES, None)
    try:
        if freed is not None:
            spark.conf.set(FREE_SHUFFLES, "true")
        dealt = min(most, max(8, total // (2 * BLOCK)))
        packed.write.bucketBy(dealt, "block").option("path", place).option("compression", "zstd").format("parquet").saveAsTable(name)
        done_path = _cut(spark.table(name), f"{name}_classes", dealt, total, match, with_text, made)
    finally:
        if freed is not None:
            spark.conf.set(FREE_SHUFFLES, freed)
        for table in (name, f"{name}_classes"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in made:
            session.remove(spark, path)
    return base, spark.read.parquet(done_path).dropDuplicates(["h1", "h2"])


def _small(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True) if x.size else b""


def _large(data: bytes, kind: str, n: int) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True) if size else b"", kind)


def _steps(x: np.ndarray) -> bytes:
    return _small(np.diff(x, prepend=0).astype(np.int32))


def _summed(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_large(data, "i4", n), dtype=np.int64)


class State:
    """What a block keeps of its classes between the steps."""

    #: ``bytes`` holds what the suffixes asked for cover, and no other byte of the block; ``places`` where they begin in it.
    SCHEMA = "block long, n int, at binary, of binary, classes int, twice binary, asked binary, wanted int, places binary, bytes binary"

    @staticmethod
    def row(block: Block, bits: bytes, more: bytes) -> dict:
        at, of, first, twice, asked = block.classes(bits, more)
        wanted = first[asked]
        held = _covered(wanted, wanted + block.match, len(block.raw))
        places = (np.cumsum(held) - 1)[wanted]
        flags = {"twice": np.packbits(twice).tobytes(), "asked": np.packbits(asked).tobytes()}
        return flags | {"n": len(at), "at": _steps(at), "of": _steps(of), "classes": len(first), "wanted": len(wanted), "places": _steps(places), "bytes": block.raw[held].tobytes()}

    def __init__(self, row: dict):
        self.at, self.of = (_summed(row[c], row["n"]) for c in ("at", "of"))
        self.twice, self.asked = (_unpacked(row[c], row["classes"]) for c in ("twice", "asked"))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima from both ends of stretches of that length."""
    stretches = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    stretches[: len(x)] = x
    stretches = stretches.reshape(-1, width)
    up = np.minimum.accumulate(stretches, axis=1).ravel()
    down = np.ascontiguousarray(np.minimum.accumulate(stretches[:, ::-1], axis=1)[:, ::-1]).ravel()
    n = max(0, len(x) - width + 1)
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


class Asked:
    """The suffixes that a block asks the others for."""

    def __init__(self, row: dict, match: int):
        self.match, self.raw = match, np.frombuffer(row["bytes"], np.uint8)
        self.at = _summed(row["places"], row["wanted"])

    def buckets(self, n: int) -> np.ndarray:
        """The bucket of each suffix, by the least hash of the short strings within it."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        short = max(1, self.match // 6)
        starts = np.arange(len(self.raw) - short + 1)
        least = _least(mix64(windows(self.raw, starts, starts + short)), self.match - short + 1)[self.at]
        return (mix64(least) % np.uint64(n)).astype(np.int64)

    def stretches(self, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray, bytes]]:
        """Per bucket: its number, the suffixes in each run of neighbours, in the order of their places, and the runs' bytes."""
        if not len(self.at):
            return
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(self.at) != 1) | (np.diff(bucket) != 0)]))
        count = np.diff(np.append(begin, len(self.at)))
        order = np.argsort(bucket[begin], kind="stable")
        full, first = np.unique(bucket[begin][order], return_index=True)
        raw = memoryview(self.raw)
        for b, runs in zip(full.tolist(), np.split(order, first[1:]), strict=True):
            low, n = self.at[begin[runs]].tolist(), count[runs].tolist()
            yield b, count[runs], b"".join(raw[k : k + c + self.match - 1] for k, c in zip(low, n, strict=True))


class Ranges:
    """Ranges of leading letters, divided by hashes of the letters where the ranges are too few."""

    def __init__(self, heads: list[bytes], wanted: int):
        take = np.linspace(0, len(heads), min(wanted, len(heads) + 1), endpoint=False).astype(int)[1:]
        self.limits = sorted({sorted(heads)[k] for k in take.tolist()})
        self.parts = max(1, -(-wanted // (len(self.limits) + 1)))
        self.buckets = (len(self.limits) + 1) * self.parts

    def of(self, letters: np.ndarray) -> np.ndarray:
        """The bucket of each string."""
        found = np.searchsorted(np.array(self.limits, f"S{LETTERS}"), letters, "right") if self.limits else np.zeros(len(letters), np.int64)
        if self.parts == 1 or not len(letters):
            return found
        width = letters.dtype.itemsize
        starts = np.arange(len(letters)) * width
        hashed = mix64(windows(np.frombuffer(letters.tobytes(), np.uint8), starts, starts + width))
        return found * self.parts + (hashed % np.uint64(self.parts)).astype(np.int64)


def _dealt(number: int, asked: Asked, buckets: int) -> Iterator[pa.RecordBatch]:
    """The suffixes that a block asks for, a slice for each bucket."""
    found = [(b, int(count.sum()), _small(count.astype(np.int32)), len(count), len(data), pa.compress(data, "zstd", asbytes=True)) for b, count, data in asked.stretches(asked.buckets(buckets))]
    if found:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
        columns = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), *columns], ["block", "bucket", "n", "counts", "runs", "size", "bytes"])


_DEALT, _ANSWERED = "block long, bucket int, n int, counts binary, runs int, size int, bytes binary", "block long, bucket int, n int, found binary"


def _numbered(strings: np.ndarray) -> np.ndarray:
    """The number of each string among the different ones, in their order."""
    order = np.argsort(strings, kind="stable")
    ordered = strings[order]
    number = np.empty(len(order), np.int64)
    number[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return number


def _by_letters(strings, at: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Which of the suffixes ``at`` are in each range of leading letters, of about ``most`` suffixes; ``strings`` reads some."""
    wanted = -(-len(at) // most)
    if wanted <= 1:
        yield np.arange(len(at))
        return
    ranges = Ranges([bytes(x)[:LETTERS] for x in strings(at[::SPARSE]).tolist()], wanted)
    number = np.concatenate([ranges.of(strings(x)) for x in np.array_split(at, wanted)])
    for k in range(ranges.buckets):
        if len(found := np.flatnonzero(number == k)):
            yield found


def _tied(letters: np.ndarray, ranks: np.ndarray, residues: np.ndarray, v: int, shifts: np.ndarray) -> np.ndarray:
    """Which suffixes are equal to another one. Equal letters at both ends and equal ranks at a common shift are equal
    strings, and equal strings have a common shift.
    """
    most = int(ranks.max(initial=0)) + 1
    ties = ((_numbered(letters)[:, None] * v + shifts[residues]) * most + ranks).ravel()
    by = np.argsort(ties)
    same = ties[by][1:] == ties[by][:-1]
    equal = np.zeros(len(ties), bool)
    equal[by[1:][same]] = equal[by[:-1][same]] = True
    return equal.reshape(ranks.shape).any(axis=1)


def _repeated(block: Block, at: np.ndarray) -> np.ndarray:
    """Which of a block's suffixes at some positions are equal to another one of them."""
    v, shifts = narrow_cover(block.match)
    depth = block.match - v + 1

    def cover_strings(x: np.ndarray) -> np.ndarray:
        return block.strings(x, depth)

    def letters(x: np.ndarray) -> np.ndarray:
        both = [block.strings(y, v - 1).view(np.uint8).reshape(len(y), v - 1) for y in (x, x + depth)]
        return np.ascontiguousarray(np.concatenate(both, axis=1)).view(f"S{2 * (v - 1)}").ravel()

    begins = np.zeros(len(block.raw), bool)
    for shift in shifts.T:
        begins[at + shift[at % v]] = True
    cover, number = np.flatnonzero(begins), np.cumsum(begins, dtype=np.int32)
    ranks, known = np.empty(len(cover), np.int64), 0
    for part in _by_letters(cover_strings, cover, max(1, SORTED // shifts.shape[1])):
        ranks[part] = known + _numbered(cover_strings(cover[part]))
        known = int(ranks[part].max()) + 1
    equal = np.zeros(len(at), bool)
    for part in _by_letters(letters, at, SORTED):
        x = at[part]
        equal[part] = _tied(letters(x), ranks[number[x[:, None] + shifts[x % v]] - 1], x % v, v, shifts)
    return equal


def _back(table: pa.Table, equal: np.ndarray) -> pa.Table:
    """The answers to the slices of a bucket, as bits."""
    parts = np.split(equal, np.cumsum(table.column("n").to_pylist())[:-1])
    return pa.table([table.column("block"), table.column("bucket"), table.column("n"), pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())], names=["block", "bucket", "n", "found"])


def _sorted(match: int):
    """Of one bucket of stretches of text: which of their suffixes are equal to one of another block."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        count = np.concatenate([_large(r["counts"], "i4", r["runs"]) for r in rows]).astype(np.int64)
        raw = b"".join(pa.decompress(r["bytes"], r["size"], "zstd", asbytes=True) for r in rows)
        low = np.cumsum(count + match - 1) - (count + match - 1)
        at = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
        return _back(table, _repeated(Block(raw, [len(raw)], match), at))

    return run


def _resolved(match: int):
    """``_tied`` for one bucket of suffixes that come as letters, ranks (those of one shift after another) and residues."""
    v, shifts = narrow_cover(match)
    kinds = {"letters": (f"S{2 * (v - 1)}", 1), "ranks": ("i8", shifts.shape[1]), "residues": ("u2", 1)}

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        read = {c: [_large(x, kind, n * width).reshape(width, n).T for x, n in zip(table.column(c).to_pylist(), sizes, strict=True)] for c, (kind, width) in kinds.items()}
        letters, ranks, residues = (np.concatenate(x) for x in read.values())
        return _back(table, _tied(letters.ravel(), ranks, residues.ravel(), v, shifts))

    return run


def _in_order(bucket: np.ndarray, answers: list[dict] | None, read) -> np.ndarray:
    """The answers of all buckets, in the order of the block's strings."""
    parts = [read(a["found"], a["n"]) for a in sorted(answers or [], key=lambda a: a["bucket"])]
    found = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    out = np.empty(len(bucket), found.dtype)
    out[np.argsort(bucket, kind="stable")] = found
    return out


def _cut(blocks: DataFrame, name: str, dealt: int, total: int, match: int, with_text: bool, made: list[str]) -> str:
    """Where the results of all texts in the blocks are written; tables to be removed after are added to ``made``.

    What is known of the blocks' suffixes is table ``name``, dealt to as many buckets as the blocks, so that no step moves
    either. Whole texts are read to find the suffixes and to cut; all between reads the bytes of the suffixes asked for.
    """
    spark = blocks.sparkSession
    modulus, cover = difference_cover(max(7, match * 4 // 5))
    buckets = max(8, -(-total * len(cover) * 8 // (modulus * BUCKET)))

    def path(name: str) -> str:
        made.append(session.scratch(spark, f"repeats-{name}"))
        return made[-1]

    def rows(work):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from work(Block(row["payload"], row["lengths"], match), row)

        return run

    def sampled_keys(row: dict) -> np.ndarray:
        return Block(row["payload"], row["lengths"], match).sampled()[1][0]

    def suffix_keys(row: dict) -> np.ndarray:
        return Block(row["payload"], row["lengths"], match).suffixes(_joined_bits(row["first"]))[1][0]

    def pruned(block: Block, row: dict) -> Iterator[pa.RecordBatch]:
        kept = {"block": row["block"]} | State.row(block, _joined_bits(row["first"]), _joined_bits(row["second"]))
        yield pa.RecordBatch.from_pylist([{c: kept[c] for c in held.names}], schema=held)

    held = to_arrow_schema(StructType.fromDDL(State.SCHEMA))
    texts_of = blocks.select("block", "lengths", "payload")
    first_path, second_path, state_path, equal_path = (path(x) for x in ("cover", "suffixes", "classes", "equal"))
    _asked(texts_of, buckets, sampled_keys).withColumnRenamed("answers", "first").write.parquet(first_path)
    first = spark.read.parquet(first_path).hint("shuffle_hash")
    _asked(texts_of.join(first, "block"), 4 * buckets, suffix_keys).withColumnRenamed("answers", "second").write.parquet(second_path)
    second = spark.read.parquet(second_path).hint("shuffle_hash")
    texts_of.join(first, "block").join(second, "block", "left").mapInArrow(rows(pruned), State.SCHEMA).write.bucketBy(dealt, "block").option("path", state_path).option("compression", "zstd").format("parquet").saveAsTable(name)
    for done in (first_path, second_path):
        session.remove(spark, done)

    states = spark.table(name)
    sorts = max(8, -(-(states.agg(F.sum("wanted")).first()[0] or 0) // BUCKET_SUFFIXES))

    def dealt_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _dealt(row["block"], Asked(row, match), sorts)

    states.select("block", "wanted", "places", "bytes").mapInArrow(dealt_suffixes, _DEALT).groupBy("bucket").applyInArrow(_sorted(match), _ANSWERED).write.parquet(equal_path)
    equal = spark.read.parquet(equal_path).groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "found")).alias("found")).hint("shuffle_hash")

    def cut(block: Block, row: dict) -> Iterator[pa.RecordBatch]:
        state = State(row)
        again = state.twice.copy()
        again[state.asked] |= _in_order(Asked(row, match).buckets(sorts), row["found"], _unpacked).astype(bool)
        repeated = state.at[again[state.of]]
        gone = _covered(repeated, repeated + match, len(block.raw))
        n_removed, n_spans, digests, kept = [], [], [], []
        for start, end, copies in zip(block.starts.tolist(), block.ends.tolist(), row["copies"], strict=True):
            own = gone[start:end] if copies == 1 else np.ones(end - start, bool)
            rest = block.raw[start:end][~own].tobytes()
            n_removed.append(int(own.sum()))
            n_spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()))
            digests.append(sha256(rest).hexdigest())
            kept.append(rest.decode(errors="ignore") if with_text else None)
        yield pa.RecordBatch.from_arrays([pa.array(row["h1"], pa.int64()), pa.array(row["h2"], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests), pa.array(kept, pa.string())], ["h1", "h2", "n_removed", "n_spans", "kept_sha256", "kept"])

    done_path = session.scratch(spark, "repeats-done")
    blocks.join(states.hint("shuffle_hash"), "block").join(equal, "block", "left").mapInArrow(rows(cut), "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string, kept string").write.parquet(done_path)
    return done_path


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", match: int = MATCH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    base, done = _results(docs, doc_id, text, match, with_text=False)
    zero = F.lit(0).cast("long")
    return base.join(done, ["h1", "h2"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "short_sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", match: int = MATCH) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts; bytes of a character cut in two go as well."""
    _, done = _results(docs, doc_id, text, match, with_text=True)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = docs.withColumns({"_h1": F.xxhash64(body), "_h2": F.xxhash64(F.lit(1), body)})
    changed = done.where("n_removed > 0").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("kept").alias("_kept"))
    return marked.join(changed, ["_h1", "_h2"], "left").select(*(F.coalesce("_kept", F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
