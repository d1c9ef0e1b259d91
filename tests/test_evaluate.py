from __future__ import annotations

import math

import pytest

from notelake import schema
from notelake.operators import evaluate as ev


def scores(spark, ranked, relevant, k=5):
    r = spark.createDataFrame([("q", d, i) for i, d in enumerate(ranked, 1)], "query_id string, doc_id string, rank int")
    rel = spark.createDataFrame([("q", d, g) for d, g in relevant.items()], "query_id string, doc_id string, grade int")
    return ev.metrics(ev.dedupe_ranked(r), rel, spark.createDataFrame([("q",)], "query_id string"), k).first()


@pytest.mark.parametrize(
    ("ranked", "relevant", "k", "ndcg", "mrr"),
    [
        (["a", "b", "c"], {"a": 3, "b": 2, "c": 1}, 3, 1.0, 1.0),
        (["c", "b", "a"], {"a": 3, "b": 2, "c": 1}, 3, (1 + 3 / math.log2(3) + 7 / 2) / (7 + 3 / math.log2(3) + 0.5), 1.0),
        (["a"], {}, 3, 0.0, 0.0),
        (["x", "a"], {"a": 3}, 1, 0.0, 0.5),
        (["x", "a"], {"a": 3}, 2, 1 / math.log2(3), 0.5),
        (["a", "b"], {"c": 1}, 3, 0.0, 0.0),
        (["a"], {"a": 0}, 3, 0.0, 1.0),
    ],
)
def test_ranking_metrics(spark, ranked, relevant, k, ndcg, mrr):
    got = scores(spark, ranked, relevant, k)
    assert got.ndcg == pytest.approx(ndcg, abs=1e-6) and got.mrr == pytest.approx(mrr)


def test_hits(spark):
    got = scores(spark, ["x", "y", "z", "a"], {"a": 1})
    assert (got.hit_at_1, got.hit_at_3, got.hit_at_5) == (0, 0, 1)


def test_dedupe(spark):
    r = spark.createDataFrame([("q", d, i) for i, d in enumerate(["", "a", "", "b", "a", "c", None], 1)], "query_id string, doc_id string, rank int")
    assert [x.doc_id for x in ev.dedupe_ranked(r).orderBy("rank").collect()] == ["a", "b", "c"]


def test_relevance_map(spark):
    rows = [("q", "x", None, None, None, [("a", None, None), (None, 3, None), ("b", 2, "r"), ("b", 1, "r"), ("", 2, None)]), ("n", "x", None, None, None, None)]
    got = ev.relevance_map(spark.createDataFrame(rows, schema.GOLDEN)).collect()
    assert {(r.query_id, r.doc_id): r.grade for r in got} == {("q", "a"): 1, ("q", "b"): 1}


def log(spark, rows):
    import datetime as dt

    made = [(dt.datetime(2025, 1, 1, 0, i), q, None, 5, "rrf", on, {"total_ms": ms}, [(d, 0, s, None) for d, s in res]) for i, (q, on, ms, res) in enumerate(rows)]
    return spark.createDataFrame(made, schema.SEARCH_LOG)


def test_gap_analysis(spark):
    df = log(spark, [("a", False, 10.0, [("x", 0.9), ("y", 0.4)]), ("a", True, 50.0, [("y", 0.9)]), ("b", False, 20.0, [("x", 0.5), ("y", 0.5)]), ("b", True, 40.0, [("x", 0.1), ("y", 0.1)]), ("c", False, 5.0, [])])
    pairs = ev.paired_runs(df)
    got = {r["query"]: (r.gap, r.top1_changed, r.top3_overlap) for r in pairs.collect()}
    assert got == {"a": (0.5, True, pytest.approx(1 / 3, abs=1e-6)), "b": (0.0, False, pytest.approx(2 / 3, abs=1e-6))}
    sim = {r.threshold: r for r in ev.threshold_simulation(pairs, (0.0, 0.1, 0.9)).collect()}
    assert (sim[0.0].skip_n, sim[0.0].wrong_n, sim[0.0].wrong_pct, sim[0.0].avg_save_ms) == (2, 1, 50.0, 30.0)
    assert (sim[0.1].skip_n, sim[0.1].wrong_n) == (1, 1) and sim[0.9].skip_n == 0 and sim[0.9].avg_save_ms == 0
    q = ev.gap_quartiles(df).first()
    assert (q.n, q.gap_min, q.p25, q.p50, q.p75, q.gap_max) == (3, 0.0, 0.0, 0.0, 0.5, 0.5)


def test_empty_log(spark):
    none = spark.createDataFrame([], schema.SEARCH_LOG)
    assert ev.paired_runs(none).count() == 0 and ev.gap_quartiles(none).count() == 0
    assert {r.skip_n for r in ev.threshold_simulation(ev.paired_runs(none)).collect()} == {0}


def test_benchmark_matrix(spark):
    names = "config string, query_id string, hit_at_1 int, hit_at_3 int, hit_at_5 int, mrr double, ndcg double"
    scored = spark.createDataFrame([("base", "q", 0, 1, 1, 0.5, 0.6), ("new", "q", 1, 1, 1, 1.0, 1.0)], names)
    times = spark.createDataFrame([("base", 10.0), ("new", 25.0), ("new", 15.0)], "config string, total_ms double")
    got = {r.config: r for r in ev.benchmark_matrix(scored, times, "base").collect()}
    assert got["new"].speed == "2.0x slower" and got["new"].d_ndcg == pytest.approx(0.4) and got["base"].speed == "~same"
