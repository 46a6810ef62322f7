"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

A text is cut before each single space between two characters that are not white space. The byte-level pre-tokenizer
never joins what stands on both sides of such a cut, so a count for a text is the sum, over its distinct pre-tokens, of
frequency times pieces.

1. Frequencies. Documents are taken in blocks of about ``BLOCK_CHARS``. A block is one row: its distinct pre-tokens, in the
   order of a hash, and the places of each document's pre-tokens among them with their frequencies. Texts are read once
   and not moved.
2. Pieces. A block sends each bucket, a range of the hash, its pre-tokens, compressed. In the bucket equal ones of all
   blocks meet, and the tokenizers library counts the pieces of each distinct one once.
3. Join. A block gets the pieces back, in the order of its pre-tokens, and sums frequency times pieces per document.

A very common pre-token is sent once per block, not once per document, and all blocks spread over the buckets alike.

Ids are not kept. For vocabularies whose pre-tokenizer gives no such promise the library encodes whole texts, and for
sentencepiece models the agenda encoder's units are counted; both without a shuffle.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside texts are handled as the library
does by default; repeated rows each get their own row; columns other than the two named are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passage_engine import session
from passage_engine.llm import agenda_bpe
from passage_engine.llm.batches import bound, per_document

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel

#: Characters of text in a block (a longer document makes a block of its own), and pre-tokens meant for a bucket.
BLOCK_CHARS, BUCKET_NAMES = 8 << 20, 1 << 20

_CUT = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = re.compile(r" \s|\s ")
_counters: dict[str, PieceCounter] = {}


class PieceCounter:
    """Pieces of pre-tokens for a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the library encodes it."""
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def counter(path: str) -> PieceCounter:
    """The counter of this path, loaded once per Python worker."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def cuts(path: str) -> bool:
    """Whether a vocabulary's pre-tokenizer and added strings allow the cut at single spaces."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    return plain and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))


def pre_tokens(text: str) -> list[str]:
    """The text's parts, named apart: the first with a space before it, which no later one begins with."""
    if not text:
        return []
    uneven = text[0] == " " or text[-1] == " " or _UNEVEN.search(text)
    parts = _CUT.split(text) if uneven else text.split(" ")
    parts[0] = " " + parts[0]
    return parts


class _Places(dict):
    """Numbers of pre-tokens, in the order in which they are first asked for."""

    def __missing__(self, name: str) -> int:
        self[name] = n = len(self)
        return n


def frequencies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks: block, names (distinct pre-tokens, by hash), doc_ids, n_bytes, sizes (distinct pre-tokens of each document),
    and the places of these among the names and how often each occurs. Names, places and counts are packed.
    """
    pair = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = pair.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.add(d, t or "")
                if held.chars >= BLOCK_CHARS:
                    yield held.row(number, batch.schema.field(0).type)
                    number, held = number + 1, _Block()
        if held.ids:
            yield held.row(number, batch.schema.field(0).type)

    return pair.mapInArrow(run, f"block long, n_names int, hashes binary, lengths binary, names binary, doc_ids array<{kind}>, n_bytes array<long>, sizes array<int>, places binary, counts binary")


class _Block:
    def __init__(self) -> None:
        self.places, self.chars = _Places(), 0
        self.ids, self.n_bytes, self.at = [], [], []

    def add(self, doc_id: object, text: str) -> None:
        names = pre_tokens(text)
        self.ids.append(doc_id)
        self.n_bytes.append(len(text.encode()))
        self.at.append(np.fromiter(map(self.places.__getitem__, names), np.int64, len(names)))
        self.chars += len(text)

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        raw = [n.encode() for n in self.places]
        hashes = np.fromiter(map(crc32, raw), np.uint32, len(raw))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(raw), np.int64)
        rank[order] = np.arange(len(raw))
        words = np.array([len(a) for a in self.at], np.int64)
        keys, counts = np.unique((np.repeat(np.arange(len(words)), words) << 32) | rank[np.concatenate(self.at)], return_counts=True)
        sizes = np.bincount(keys >> 32, minlength=len(words))
        # Places rise within a document: their steps are small numbers.
        steps = np.diff(keys & 0xFFFFFFFF, prepend=0)
        sent = [raw[k] for k in order.tolist()]
        columns = [
            pa.array([number]), pa.array([len(raw)], pa.int32()), pa.array([hashes[order].astype("<u4").tobytes()], pa.binary()), pa.array([_packed([*map(len, sent)])], pa.binary()), pa.array([_zipped(b"".join(sent))], pa.binary()),
            pa.array([self.ids], pa.list_(kind)), pa.array([self.n_bytes], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([_packed(steps)], pa.binary()), pa.array([_packed(counts)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "n_names", "hashes", "lengths", "names", "doc_ids", "n_bytes", "sizes", "places", "counts"])


def _zipped(raw: bytes) -> bytes:
    """Compressed bytes after their number."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unzipped(raw: bytes) -> bytes:
    n = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], n, "zstd", asbytes=True) if n else b""


def _packed(values: list[int] | np.ndarray) -> bytes:
    """32-bit numbers, their bytes of equal weight together, compressed."""
    return _zipped(np.ascontiguousarray(np.array(values, "<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzipped(packed), np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def pieces(blocks: DataFrame, path: str, buckets: int) -> DataFrame:
    """Pieces of the blocks' pre-tokens, each distinct one counted once: block, bucket, n (distinct ones counted there), pieces."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = np.array([(b << 32) // buckets for b in range(1, buckets)], np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                edges = [0, *np.searchsorted(np.frombuffer(row["hashes"], "<u4"), limits).tolist(), row["n_names"]]
                lengths, raw = _unpacked(row["lengths"]), _unzipped(row["names"])
                ends = np.concatenate([[0], np.cumsum(lengths)])
                parts = [(b, s, e) for b, (s, e) in enumerate(pairwise(edges)) if e > s]
                if parts:
                    columns = [[b for b, _, _ in parts], [row["block"]] * len(parts), [_packed(lengths[s:e]) for _, s, e in parts], [_zipped(raw[ends[s] : ends[e]]) for _, s, e in parts]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "lengths", "names"])

    def count(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in table.column("lengths").to_pylist()]
        raw = b"".join(map(_unzipped, table.column("names").to_pylist()))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(parts))])
        coded = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        names = [n[1:] if n[0] == " " else " " + n for n in coded.dictionary.to_pylist()]
        found = np.concatenate([counter(path).count(names[k : k + 4096]) for k in range(0, len(names), 4096)])[coded.indices.to_numpy()]
        ends = np.cumsum([len(p) for p in parts])
        answers = [_packed(found[e - len(p) : e]) for p, e in zip(parts, ends, strict=True)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": pa.array([len(names)] * len(parts), pa.int32()), "pieces": pa.array(answers, pa.binary())})

    sent = blocks.select("block", "n_names", "hashes", "lengths", "names").mapInArrow(send, "bucket int, block long, lengths binary, names binary")
    return sent.groupBy("bucket").applyInArrow(count, "block long, bucket int, n int, pieces binary")


def token_counts(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and whether it has more than ``limit`` tokens."""
    if path.endswith(".model") or not cuts(path):
        return _by_text(docs, path, limit, doc_id, text)
    spark = docs.sparkSession
    bound(spark)
    at = session.scratch(spark, "token-frequencies")
    frequencies(docs, doc_id, text).write.parquet(at)
    blocks = spark.read.parquet(at)
    n_names = blocks.agg(F.sum("n_names")).first()[0] or 0
    found = pieces(blocks, path, max(8, -(-n_names // BUCKET_NAMES)))
    answers = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "pieces"))).alias("answers")).select("block", F.col("answers.pieces").alias("pieces"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_ids"), batch.drop_columns(["doc_ids"]).to_pylist()
            for k, row in enumerate(rows):
                sizes = np.array(row["sizes"], np.int64)
                of_name = np.concatenate([np.zeros(0, np.int64), *map(_unpacked, row["pieces"] or [])])
                each = of_name[np.cumsum(_unpacked(row["places"]))] * _unpacked(row["counts"])
                sums, ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)]), np.cumsum(sizes)
                n = sums[ends] - sums[ends - sizes]
                own = ids.slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([own, pa.array(row["n_bytes"], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    packed = blocks.select("block", "doc_ids", "n_bytes", "sizes", "places", "counts")
    return packed.join(answers, "block", "left").drop("block").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def _by_text(docs: DataFrame, path: str, limit: int, doc_id: str, text: str) -> DataFrame:
    def rows(texts: list[str]) -> dict:
        if path.endswith(".model"):
            counts = [sum(len(u[0]) for u in units) for units in agenda_bpe.encode_texts(texts, path)]
        else:
            counts = counter(path).count(texts)
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return per_document(docs, rows, "n_bytes long, n_tokens long, over_limit boolean", doc_id, text)
