"""The pipeline's stages, each against brute force over its own input, and the whole of it on odd and on empty tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from test_operators import classes_of, prose
from pyspark.sql import functions as F

import corpus_pipeline
from passage_engine.llm import minhash, mixing, quality
from passage_engine.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept boolean, vertex string"


def rows():
    """Good and bad texts, copies, near copies, shared passages, nulls, empty and repeated rows, one long text; columns of clashing names."""
    r = random.Random(2)
    passage = prose(900, 70)
    out = []
    for k in range(80):
        text = prose(k, 40 + k)
        if k % 8 == 1:
            text = " ".join(w + r.choice(("%%%", "###", "$$$")) for w in text.split())
        if k in (10, 20, 30):
            text = f"{text} {passage} {prose(700 + k, 30)}"
        if k in (41, 42):
            text = prose(40, 80)
        if k in (51, 52):
            text = " ".join(w if j != k else "zzz" for j, w in enumerate(prose(50, 90).split()))
        out.append((k, text))
    out += [(200, None), (201, ""), (60, out[60][1]), (None, prose(999, 50)), (202, "é" * 300 + " " + prose(998, 3000))]
    return [(d, t, "en", None if d == 5 else f"src{(d or 0) % 3}", len(t or ""), 1, True, "v") for d, t in out]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(k, int(k % 8 != 1), 0) for k in range(80)] + [(7777, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, sf).cache()
        out.append((name, docs.collect(), done.collect(), done.columns))
        docs = done
    return {name: x for name, *x in out}


def texts_of(some):
    return Counter((r["doc_id"], r["text"]) for r in some)


def test_stages_keep_columns(stages):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    assert [x[2] == names for x in stages.values()] == [True] * 4 + [False]


def test_quality_stage(spark, sf, stages):
    before, after, _ = stages["quality classifier"]
    frame = spark.createDataFrame(before, SCHEMA)
    scored = quality.train_and_score(frame, spark.read.parquet(f"{sf}/labels.parquet")).where("score >= 0.5")
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in scored.collect())
    kept = {r["doc_id"] for r in after}
    assert not kept & {k for k in range(80) if k % 8 == 1 and k not in (41,)} and len(kept & {k for k in range(80) if k % 8 != 1}) >= 65


def test_near_dedup_stage(stages):
    before, after, _ = stages["MinHash near-dedup"]
    parent = classes_of([r["text"] for r in before], minhash.SIMILARITY)
    least = {}
    for r, p in zip(before, parent, strict=True):
        d = r["doc_id"]
        least[p] = min(least.get(p, (True, 0)), (d is None, d or 0))
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == Counter(least.values())
    assert len(before) > len(after)


def test_suffix_stage(stages):
    before, after, _ = stages["suffix-array dedup"]
    match, raws = corpus_pipeline.PASSAGE_BYTES, [(r["doc_id"], (r["text"] or "").encode()) for r in before]
    seen = Counter(t[k : k + match] for _, t in raws for k in range(len(t) - match + 1))
    want, cut = Counter(), 0
    for (d, t), r in zip(raws, before, strict=True):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - match + 1):
            if seen[t[k : k + match]] > 1:
                gone[k : k + match] = True
        cut += gone.any()
        want[d, bytes(c for c, g in zip(t, gone, strict=True) if not g).decode(errors="ignore") if gone.any() else r["text"]] += 1
    assert texts_of(after) == want and cut >= 3
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
    words = prose(900, 70)
    assert sum(words in (r["text"] or "") for r in before) >= 2 and not any(words in (r["text"] or "") for r in after)


def test_mixing_stage(spark, stages):
    before, after, _ = stages["mixing sources to target weights"]
    frame = spark.createDataFrame(before, SCHEMA)
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(frame).collect()}
    want = Counter({d: -(-n // size) for d, (n, size) in taken.items() if size and n})
    got = Counter(r["doc_id"] for r in after if taken[r["doc_id"]][1])
    assert got == want
    assert {(r["doc_id"], r["text"]) for r in after} <= {(r["doc_id"], r["text"]) for r in before}


def test_encoding_stage(stages):
    before, after, _ = stages["SentencePiece encoding and decoding"]
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))

    def row(r):
        ids = sp.encode(r["text"] or "")
        return r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((sp.decode(ids) if ids else "").encode()).hexdigest()

    assert Counter(map(tuple, after)) == Counter(map(row, before))


def test_run_is_the_stages_after_each_other(spark, sf, stages):
    want = Counter(map(tuple, stages["SentencePiece encoding and decoding"][1]))
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == want


def test_run_of_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0


def test_run_of_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert out.where(F.col("n_tokens") > 0).count() > 100
