from __future__ import annotations

import re

import numpy as np
import pytest

from notelake.operators import retrieval as rt
from notelake.operators.index import SearchIndex

DIM = 16
SCHEMA = "doc_id string, chunk_index int, content string, title string, section_path string, embedding array<float>"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    r = np.random.default_rng(3)
    centres = r.standard_normal((60, DIM))
    words = [f"w{i}" for i in range(300)]
    rows = [(f"d{i % 40}", i, " ".join(r.choice(words, 12)), f"title {i % 7}", "", (centres[i % 60] + 0.3 * r.standard_normal(DIM)).astype(np.float32).tolist() if i % 50 else None) for i in range(3000)]
    corpus = spark.createDataFrame(rows, SCHEMA)
    return corpus, SearchIndex(spark, str(tmp_path_factory.mktemp("index")), dim=DIM).build(corpus)


def test_scores_are_those_of_the_corpus(spark, built):
    corpus, index = built
    queries = spark.createDataFrame([("a", "w1 w2 w2"), ("b", "title 3 w7"), ("c", "nothing here"), ("d", None)], "id string, query string")
    assert sorted(map(tuple, index.bm25(queries).collect())) == sorted(map(tuple, rt.bm25(corpus, queries).collect()))


def test_only_the_terms_asked_for_are_read(spark, built):
    plan = built[1].postings(spark.createDataFrame([("w1",), ("w2",)], "term string"), 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*term", plan)


def test_recall_of_the_vector_index(spark, built):
    corpus, index = built
    r = np.random.default_rng(4)
    own = [x.embedding for x in corpus.filter("embedding is not null").limit(40).collect()]
    queries = spark.createDataFrame([(i, (np.array(v) + 0.1 * r.standard_normal(DIM)).tolist()) for i, v in enumerate(own)] + [(99, None), (98, [0.0] * DIM)], "query_id int, vector array<double>")
    exact = {(x.query_id, x.doc_id, x.chunk_index) for x in rt.knn(corpus, queries, 10, DIM).collect()}
    found = {(x.query_id, x.doc_id, x.chunk_index) for x in index.knn(queries, 10, probes=1).collect()}
    assert len(exact & found) / len(exact) >= 0.9 and {q for q, *_ in found} == set(range(40))


def test_blocks_of_queries_do_not_change_the_result(spark, built):
    corpus, _ = built
    queries = corpus.filter("embedding is not null").limit(30).selectExpr("chunk_index as query_id", "cast(embedding as array<double>) as vector")
    assert sorted(map(tuple, rt.knn(corpus, queries, 5, DIM, block=8).collect())) == sorted(map(tuple, rt.knn(corpus, queries, 5, DIM).collect()))


def test_empty_corpus(spark, built, tmp_path):
    index = SearchIndex(spark, str(tmp_path), dim=DIM).build(built[0].limit(0))
    assert index.bm25(spark.createDataFrame([("a", "w1")], "id string, query string")).count() == 0
    assert index.knn(spark.createDataFrame([(1, [1.0] * DIM)], "query_id int, vector array<double>"), 3).count() == 0
