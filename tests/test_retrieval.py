from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.operators import retrieval as rt

DOCS = [("a", 0, "red apple pie", "Apple", "fruit"), ("a", 1, "green apple", "", ""), ("b", 0, "blue sky", "Sky", None), ("b", 1, "red red red", None, "red"), ("c", 0, "", "", "")]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id string, chunk_index int, content string, title string, section_path string")


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([("q1", "red apple apple"), ("q2", "sky"), ("q3", "nothing here"), ("q4", None)], "id string, query string")


def model_bm25(query):
    """Scores by the published formula, straight from its definition."""
    out = {}
    for field, boost in rt.FIELDS.items():
        at = {"content": 2, "title": 3, "section_path": 4}[field]
        texts = {(d[0], d[1]): (d[at] or "").lower().split() for d in DOCS}
        filled = {k: t for k, t in texts.items() if t}
        mean = sum(map(len, filled.values())) / len(filled)
        for term in query.lower().split():
            df = sum(term in t for t in filled.values())
            idf = math.log(1 + (len(filled) - df + 0.5) / (df + 0.5))
            for k, t in filled.items():
                if tf := t.count(term):
                    out[k] = out.get(k, 0) + boost * idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len(t) / mean))
    return out


def test_bm25_is_the_formula(corpus, queries):
    got = {(r.query_id, r.doc_id, r.chunk_index): r.score for r in rt.bm25(corpus, queries).collect()}
    want = {("q1", *k): v for k, v in model_bm25("red apple apple").items()} | {("q2", *k): v for k, v in model_bm25("sky").items()}
    assert got == pytest.approx(want, abs=1e-5)


def test_padding_fills_up_with_zero_scores(corpus, queries):
    allowed = corpus.select("doc_id", "chunk_index")
    rows = rt.bm25_topk(corpus, queries, 4, allowed=allowed, pad=True).filter("query_id = 'q2'").orderBy("bm25_rank").collect()
    assert [(r.doc_id, r.chunk_index) for r in rows] == [("b", 0), ("a", 0), ("a", 1), ("b", 1)] and [r.score > 0 for r in rows] == [True, False, False, False]
    assert rt.bm25_topk(corpus, queries, 4, allowed=allowed).filter("query_id = 'q2'").count() == 1
    assert rt.bm25_topk(corpus, queries, 9, allowed=allowed, pad=True).filter("query_id = 'q3'").count() == 5


def test_statistics_ignore_filters(corpus, queries):
    some = corpus.filter("doc_id = 'b'").select("doc_id", "chunk_index")
    whole = {(r.doc_id, r.chunk_index): r.score for r in rt.bm25_topk(corpus, queries).filter("query_id = 'q1'").collect()}
    assert {(r.doc_id, r.chunk_index): r.score for r in rt.bm25_topk(corpus, queries, allowed=some).filter("query_id = 'q1'").collect()} == {("b", 1): whole["b", 1]}


def test_knn_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    rows = [(f"d{i % 7}", i, v.tolist()) for i, v in enumerate(x)] + [("n", 0, None), ("n", 1, [0.0] * 8), ("n", 2, [float("nan")] * 8), ("n", 3, [1.0])]
    corpus = spark.createDataFrame(rows, "doc_id string, chunk_index int, embedding array<float>")
    queries = spark.createDataFrame([("q", x[5].tolist()), ("bad", [0.0] * 8), ("none", None)], "query_id string, vector array<float>")
    got = rt.knn(corpus, queries, 5, 8).orderBy("knn_rank").collect()
    w = x.astype(np.float64)
    w /= np.linalg.norm(w, axis=1)[:, None]
    score = np.round((1 + w @ w[5]) / 2, 6)
    want = sorted(range(60), key=lambda i: (-score[i], f"d{i % 7}", i))[:5]
    assert [(r.query_id, r.chunk_index, r.score) for r in got] == [("q", i, pytest.approx(score[i], abs=1e-6)) for i in want]


def test_fusion(spark):
    lex = spark.createDataFrame([("q", "a", 0, 2.0, 1), ("q", "b", 0, 1.0, 2), ("q", "d", 0, 0.5, 3)], "query_id string, doc_id string, chunk_index int, score double, bm25_rank int")
    vec = spark.createDataFrame([("q", "c", 0, 0.9, 1), ("q", "a", 0, 0.8, 2)], "query_id string, doc_id string, chunk_index int, score double, knn_rank int")
    fused = rt.rrf(lex, vec).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == ["a", "c", "b", "d"]
    assert fused[0].score == pytest.approx(1 / 61 + 1 / 62)
    gap = rt.rrf_gap(rt.rrf(lex, vec)).first()
    assert gap.candidate_count == 4 and gap.rrf_top_gap == pytest.approx(1 / 62, abs=1e-6)
    assert rt.rrf_gap(rt.rrf(lex.filter("doc_id = 'a'"), vec.filter("doc_id = 'a'"))).first().rrf_top_gap == 0
    tie = rt.rrf(lex.filter("doc_id = 'b'").withColumn("bm25_rank", F.lit(1)), vec.filter("doc_id = 'c'")).orderBy("rank").collect()
    assert [r.doc_id for r in tie] == ["b", "c"]  # equal scores keep the lexical one first
    assert [(r.doc_id, r.score) for r in rt.native_fusion(lex, vec, 2).orderBy("rank").collect()] == [("a", 2.8), ("b", 1.0)]


def test_rerank_keeps_order_of_ties(spark):
    rows = [("q", "a", 0, 1, "x"), ("q", "b", 0, 2, "red"), ("q", "c", 0, 3, "y")]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, chunk_index int, rank int, content string")
    out = rt.rerank(df, rt.overlap_score(F.lit("red fox"), "content"), 3).orderBy("rank").collect()
    assert [(r.doc_id, r.rerank_score) for r in out] == [("b", 0.5), ("a", 0.0), ("c", 0.0)]
    assert rt.rerank(df.limit(0), rt.overlap_score(F.lit("red"), "content")).count() == 0


def test_neighbours(spark):
    corpus = spark.createDataFrame([("a", i, "s", f"t{i}") for i in (0, 1, 2, 4)] + [("b", 0, "s", "u")], "doc_id string, chunk_index int, section_path string, content string")
    hits = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 0), ("q", None, 3), ("q", "zz", None)], "query_id string, doc_id string, chunk_index int")
    got = {(r.doc_id, r.chunk_index): [n.chunk_index for n in r.neighbours] for r in rt.neighbours(hits, corpus, 1).collect()}
    assert got == {("a", 1): [0, 2], ("a", 2): [1], ("b", 0): [], (None, 3): [], ("zz", None): []}


def test_ranking_limits_groups_before_the_shuffle(corpus, queries):
    plan = rt.bm25_topk(corpus, queries)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
