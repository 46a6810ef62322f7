"""Token ids of whole documents in files of Simple-8b words, and reading them back.

A file is Parquet whose rows are segments: whole documents in ascending order, about ``SEGMENT_IDS`` ids in each, with
the documents' ids and lengths, the words, the offset of each block and the escaped values (see ``simple8b``). Segments
name their shard (a range of doc_id) and place in it, so each is read and decoded by itself, by any task.

Writing shuffles the texts once, by ranges of doc_id. The position of a document's first id in the whole sequence is
its place within the segment plus the ids of all segments before, a sum over one short row per segment.

Defined results: a null or empty text has only the end id; equal doc_ids are ordered by a hash of the text; repeated rows each keep
their own place; a document longer than a segment makes one of its own; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passage_engine.llm import simple8b
from passage_engine.llm.batches import bound

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel

SEGMENT_IDS = 1 << 18
#: Words kept by a Python worker, those of them that stay when the table is full, and the longest one kept.
TABLE_SIZE, TABLE_STAYS, TABLE_CHARS = 800_000, 400_000, 48
SEGMENT = "shard int, part int, doc_ids array<bigint>, lengths array<int>, n_ids bigint, words binary, offsets binary, escapes binary"

#: White space to Python's split() that the tokenizers library takes for other characters.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Byte-level vocabularies write a byte that is no printable character as one from 256 on, in the bytes' order.
_BYTE_LEVEL = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
_encoders: dict[str, WordEncoder] = {}


def _word_rule(path: str) -> regex.Pattern | None:
    """The pattern of pre-tokens of a vocabulary that tidies, lowers and splits as the encoder below does; None for others."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    level = [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in rest]
    if steps != ["NFC", "Replace", "Lowercase"] or level != [("ByteLevel", False, False)] or not (split.get("invert") and split.get("behavior") == "Removed"):
        return None
    return regex.compile(split["pattern"]["Regex"])


class _Words(dict):
    """Ids of words; a word that is missing is encoded when it is first asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= TABLE_CHARS:
            self[word] = ids
        return ids


class WordEncoder:
    """Ids, as bytes of little-endian unsigned 32-bit integers, for vocabularies that drop white space.

    Their pre-tokenizer never joins what stands on both sides of white space, so a text's ids are its words' ids, and a
    word met before is taken from a bounded table. Words of Latin-1 characters, which the normaliser only lowers, are cut
    by the vocabulary's own pattern and go to the merges directly; others go through the library's whole chain.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.rule, self.merges = _word_rule(path), self.tokenizer.model.tokenize
        self.table = _Words(self._encode)
        probe = "A b,\n\n c. d'Été's 3\u00bd <x_y>"
        whole = self._whole(probe)
        if self.rule and (any(map(str.isalpha, self.special)) or b"".join(map(self._encode, probe.split())) != whole):
            self.rule = None
        self.by_word = b"".join(map(self._whole, probe.split())) == whole

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encode(self, word: str) -> bytes:
        if not self.rule:
            return self._whole(word)
        if word.isascii():
            if word.islower() and word.isalpha():
                return array("I", [x.id for x in self.merges(word)]).tobytes()
        else:
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                return self._whole(word)
        low = word.lower()
        if low.isalpha():
            return self._merged(low) if low == word else self.table[low]
        if any(s in word for s in self.special):
            return self._whole(word)
        parts = self.rule.findall(low)
        return self._merged(low) if parts == [word] else b"".join(map(self.table.__getitem__, parts))

    def _merged(self, part: str) -> bytes:
        symbols = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return array("I", [x.id for x in self.merges(symbols)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.table.__getitem__
        out = [b"".join(map(get, t.split())) if self.by_word and not _SEPARATORS.search(t) else self._whole(t) for t in texts]
        if len(self.table) > TABLE_SIZE:
            # Words met first are mostly the frequent ones.
            for w in [*islice(self.table, TABLE_STAYS, None)]:
                del self.table[w]
        return out


def encoder(path: str) -> WordEncoder:
    """The encoder of this path, loaded once per Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write(docs: DataFrame, to: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of every whole text, each with ``end_id`` after it, in ascending order of doc_id."""
    spark = docs.sparkSession
    bound(spark)

    def segment(shard: int, part: int, ids: list, parts: list[bytes]) -> dict:
        values = np.frombuffer(b"".join(parts), "<u4")
        words, offsets, escapes = simple8b.encode(values.astype(np.uint64))
        return {"shard": shard, "part": part, "doc_ids": ids, "lengths": [len(p) // 4 for p in parts], "n_ids": len(values), "words": words.tobytes(), "offsets": offsets.astype("<u4").tobytes(), "escapes": escapes.tobytes()}

    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("words", pa.binary()), ("offsets", pa.binary()), ("escapes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, ids, parts, held = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            coded = encoder(path).encode(batch.column(1).to_pylist())
            for d, b in zip(batch.column(0).to_pylist(), coded, strict=True):
                ids.append(d)
                parts.append(b + end)
                held += len(b) // 4 + 1
                if held >= SEGMENT_IDS:
                    yield pa.RecordBatch.from_pylist([segment(shard, part, ids, parts)], schema)
                    part, ids, parts, held = part + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([segment(shard, part, ids, parts)], schema)

    pair = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # The driver samples ids and hashes to set the ranges, no texts.
    ranged = pair.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    ranged.mapInArrow(run, SEGMENT).write.parquet(to)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, with ``with_ids``, ids (array of ints, in order)."""
    bound(spark)
    files = spark.read.schema(SEGMENT).parquet(path)
    # One row of three numbers per segment; the window over shards sees one row each.
    sizes = files.select("shard", "part", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", "part", inside.alias("inside")).join(shards, "shard").select("shard", "part", (F.col("shard_start") + F.col("inside")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, lengths = row["n_ids"], np.array(row["lengths"], np.int64)
                values = simple8b.decode(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["offsets"], "<u4"), np.frombuffer(row["escapes"], np.uint64), n).astype("<u4")
                ends = np.cumsum(lengths)
                raw = memoryview(values.tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array([row["shard"]] * len(ends), pa.int32()), pa.array([row["part"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["shard", "part", "doc_id", "within", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    read_back = files.mapInArrow(run, "shard int, part int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return read_back.join(starts, ["shard", "part"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
