import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passage_engine.functions import scoring
from passage_engine.operators import bm25, dense, embed, metrics
from passage_engine.plans import search

TEXTS = [(1, "Kettle kettle kettle descaled kettle repair sheet."), (2, "Garden hose fittings for May. Sprinklers need the longer hose."), (3, "Kettle hose garden descaled.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_bm25_order(spark, docs):
    q = spark.createDataFrame([(1, "kettle descaled"), (2, "hose"), (3, "zzz"), (4, '"kettle" OR (hose)'), (5, "!!")], "query_id long, query string")
    got = found(bm25.search(docs, q, 5))
    assert set(got) == {1, 2, 4}
    assert set(got[1]) == {1, 3} and got[2][0] in (2, 3) and set(got[4]) == {1, 2, 3}
    scope = spark.createDataFrame([(3,)], "id long")
    whole = {(r["query_id"], r["id"]): r["score"] for r in bm25.search(docs, q, 5).collect()}
    inside = bm25.search(docs, q, 5, scope).collect()
    assert {r["id"] for r in inside} == {3}
    assert all(math.isclose(r["score"], whole[r["query_id"], 3]) for r in inside)


def test_bm25_equals_full_text_index(spark):
    import sqlite3

    rows = [(k, " ".join(["alpha"] * (k % 3) + ["beta"] * (k % 5 == 0) + ["filler"] * (k + 3))) for k in range(1, 25)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", rows)
    want = {r[0]: -r[1] for r in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH 'alpha OR beta OR filler'")}
    q = spark.createDataFrame([(1, "alpha beta filler")], "query_id long, query string")
    got = {r["id"]: r["score"] for r in bm25.search(spark.createDataFrame(rows, "id long, text string"), q, 100).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16))
    x[3], x[11] = 0, x[10]
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + [(99, [1.0, 2.0]), (98, None)], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, x[10].tolist()), (2, x[5].tolist()), (3, [1.0, 2.0]), (4, [0.0] * 16)], "query_id long, embedding array<double>")
    got = found(dense.search(v, q, 5))
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    for name, row in ((1, 10), (2, 5)):
        s = np.round(unit @ unit[row], 9)
        assert got[name] == sorted(range(60), key=lambda k: (-s[k], k))[:5]
    assert got[3] == [99] and got[4] == [0, 1, 2, 3, 4]
    assert found(dense.by_pairs(v.where("embedding is not null"), q, 5)) == got
    assert found(dense.search(v, q.where("query_id = 1"), 5, spark.createDataFrame([(5,), (5,), (7,), (1000,)], "id long")))[1] in ([5, 7], [7, 5])
    assert tuple(dense.mismatched(v.where("embedding is not null"), 2).first()) == (1, 60)


def test_fusion(spark):
    def hits(d):
        return spark.createDataFrame([(1, k, float(s), i + 1) for i, (k, s) in enumerate(d.items())], "query_id long, id long, score double, rank int")

    got = {r["id"]: r["fused"] for r in search.fused(hits({1: 10, 2: 0}), hits({2: 4, 3: 2}), 0.25).collect()}
    assert got == {1: 0.25, 2: 0.75, 3: 0.0}
    assert search.fused(hits({1: 0.5}), hits({}), 0.3).first()["fused"] == pytest.approx(0.3)
    assert search.fused(hits({}), hits({7: 3}), 0.3).first()["fused"] == pytest.approx(0.7)
    assert search.rrf_fused(hits({1: 9, 2: 8}), hits({2: 5})).orderBy("rank").first()["id"] == 2


def test_coverage(spark):
    row = spark.createDataFrame([("owner of barn", "The owner of the old mill is abroad.")], "q string, t string")
    terms = F.array(F.lit("owner"), F.lit("barn"))
    got = row.select(search.coverage(F.array(F.lit(1.0), F.lit(1.0)), terms, F.col("q"), F.col("t")).alias("c")).first()["c"]
    assert got == pytest.approx(0.625)


def test_hybrid_end_to_end(spark, docs):
    e = embed.HashingEmbedder(64)
    vectors = docs.select("id", embed.embedding(e, "text").alias("embedding"))
    q = spark.createDataFrame([(1, "kettle hose"), (2, "  ")], "query_id long, query string").withColumn("embedding", embed.embedding(e, "query"))
    out = search.search(docs, q, search.Settings(top_k=2), vectors).orderBy("rank").collect()
    assert [r["rank"] for r in out] == [1, 2] and out[0]["id"] == 3

    class Longest:
        def score(self, pairs):
            return [len(t) for _, t in pairs]

    assert search.search(docs, q, search.Settings(top_k=3), vectors, reranker=Longest()).orderBy("rank").first()["id"] == 2
    assert search.search(docs, q, search.Settings(top_k=3, hybrid=False, rerank=False), vectors).count() == 3
    with pytest.raises(ValueError):
        search.Settings(top_k=51)


def test_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "b", 3), ("q", "c", 4), ("r", "x", 1), ("r", "g", 2)], "query_id string, id string, rank int")
    qrels = spark.createDataFrame([("q", "b"), ("q", "d"), ("r", "g"), ("s", "z")], "query_id string, id string")
    got = {r["query_id"]: r for r in metrics.per_query(run, qrels, 2).collect()}
    assert (got["q"]["recall"], got["q"]["precision"], got["q"]["hit"]) == (0.5, 0.5, 1.0)
    assert got["r"]["rr"] == 0.5 and 0 < got["r"]["ndcg"] < 1 and got["s"]["rr"] == 0
    s = metrics.summary(run, qrels, 2).first()
    assert s["queries"] == 3 and s["mrr"] == pytest.approx(0.3333) and s["zero_result_rate"] == pytest.approx(0.3333)
    t = spark.createDataFrame([(float(k),) for k in range(1, 21)], "seconds double")
    assert tuple(metrics.latency(t).first()) == (20, 10.5, 10.0, 19.0, 1.0, 20.0)
    assert tuple(metrics.latency(t.where("seconds < 0")).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_stemmed_search_stems_both_sides(spark):
    d = spark.createDataFrame([(1, "He runs home."), (2, "A walk home."), (3, "Running it is, they ran."), (4, "Nothing here."), (5, "More of that.")], "id long, text string")
    q = spark.createDataFrame([(1, "running")], "query_id long, query string")
    assert set(found(bm25.search(d, q, 5, stem=True))[1]) == {1, 3} and set(found(bm25.search(d, q, 5))[1]) == {3}


def test_search_reads_the_texts_once(spark, tmp_path):
    """BM25 makes its index in one pass; a search adds one more, for the texts of the pool."""
    spark.createDataFrame([(k, f"word{k % 7} hose kettle") for k in range(50)], "id long, text string").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    q = spark.createDataFrame([(1, "word3 hose")], "query_id long, query string")

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count(f"{tmp_path}/d")

    assert scans(bm25.search(d, q, 5)) == 0 and scans(search.search(d, q)) == 1


def test_dense_holds_a_bounded_number_of_scores(spark, monkeypatch):
    monkeypatch.setattr(dense, "SCORES", 8)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(12, 5)), 3, axis=0)
    v = spark.createDataFrame([(f"v{k:02d}", r.tolist()) for k, r in enumerate(x)], "id string, embedding array<double>")
    q = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rng.normal(size=(6, 5)))], "query_id long, embedding array<double>")
    assert found(dense.search(v, q, 4)) == found(dense.by_pairs(v, q, 4))


def test_dense_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(20)], "id long, embedding array<double>")
    q = v.withColumnRenamed("id", "query_id")
    whole = found(dense.search(v, q, 3))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    assert found(dense.search(v, q, 3)) == whole and len(whole) == 20


def test_by_pairs_serves_all_queries(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rng.normal(size=(30, 4)))], "id long, embedding array<double>")
    q = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rng.normal(size=(10, 4)))], "query_id long, embedding array<double>")
    got = found(dense.by_pairs(v, q, 5))
    assert len(got) == 10 and got == found(dense.search(v, q, 5))
