from __future__ import annotations

import os

import numpy as np
import pytest

from notelake.llm import mixing as mx

pytestmark = pytest.mark.skipif(not os.path.exists(mx.VOCABULARY), reason="no vocabulary file")
DOCS = "doc_id long, source string, text string, tokens string, uses string"


def frames(spark):
    docs = [(i, " Big " if i % 2 else "BIG", f"big text number {i} " * 10) for i in range(600)] + [(1000 + i, "small", f"small text {i} " * 10) for i in range(30)]
    docs += [(2000 + i, "copies", "the very same text " * 10) for i in range(20)] + [(3000, None, "x y z"), (3001, "unknown", "x y z"), (3002, "small", None), (3003, "small", ""), (1000, "small", "small text 0 " * 10)]
    targets = [("big", 0.5, 2), ("Small", 0.2, 12), ("copies", 0.1, 3), ("absent", 0.1, 5), (None, 0.1, 1)]
    return spark.createDataFrame([(*d, "clash", "clash") for d in docs], DOCS), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_supply(spark):
    docs, targets = frames(spark)
    got = {r.source: r for r in mx.source_supply(docs, targets).collect()}
    assert set(got) == {"big", "small", "copies", "absent"} and got["small"].docs == 32
    total = sum(r.own_tokens for r in got.values())
    assert all(r.total_tokens == total for r in got.values())
    assert {s for s, r in got.items() if r.short} == {s for s, r in got.items() if r.max_repeats * r.own_tokens < r.target_share * total} >= {"absent"}


def test_uses_are_capped_reproducible_and_near_the_rate(spark):
    docs, targets = frames(spark)
    plan = mx.replication(docs, targets, seed=3)
    rows = sorted(map(tuple, plan.collect()))
    assert rows == sorted(map(tuple, mx.replication(docs.repartition(7), targets, seed=3).collect()))
    assert rows != sorted(map(tuple, mx.replication(docs, targets, seed=4).collect()))
    caps = {"big": 2, "small": 12, "copies": 3}
    assert all(0 <= r[5] <= caps[r[1]] for r in rows) and sum(r[1] == "copies" for r in rows) == 1
    supply = {r.source: r for r in mx.source_supply(docs, targets).collect()}
    big = [r for r in rows if r[1] == "big"]
    assert sum(r[3] * r[5] for r in big) == pytest.approx(supply["big"].wanted_tokens, rel=0.12)
    assert sum(r[3] * r[4] for r in big) == pytest.approx(supply["big"].wanted_tokens, rel=1e-9)


def test_report_and_mix(spark):
    docs, targets = frames(spark)
    report = {r.source: r for r in mx.reached_shares(docs, targets).collect()}
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1) and report["absent"].uses == 0
    mix = mx.mixed(docs, targets, partitions=3)
    assert mix.count() == sum(r.uses for r in report.values())
    assert mix.groupBy("source", "text").count().filter("source = 'copies'").first()["count"] <= 3
    order = [r.doc_id for r in mix.coalesce(1).collect()]
    assert order != sorted(order)


def test_empty_tables(spark):
    docs, targets = frames(spark)
    assert mx.replication(docs.limit(0), targets).count() == 0
    assert {r.short for r in mx.source_supply(docs.limit(0), targets).collect()} == {False}
    assert mx.source_supply(docs, targets.limit(0)).count() == 0 and mx.mixed(docs, targets.limit(0)).count() == 0


def test_no_target_source_is_dropped(spark):
    n = 100_050
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('s', id) AS source", "'a b' AS text")
    targets = spark.range(n).selectExpr("concat('s', id) AS source", f"1D / {n} AS target_share", "2 AS max_repeats")
    assert mx.replication(docs, targets).count() == n


def test_poisson_inversion():
    u = (np.arange(20_000) + 0.5) / 20_000
    for mean in (0.1, 1.0, 7.5, 800.0, 40_000.0):
        counts = mx.poisson_counts(u, mean)
        assert counts.mean() == pytest.approx(mean, rel=0.01) and counts.var() == pytest.approx(mean, rel=0.02)
    for rate, cap in ((0.5, 2), (1.9, 2), (3.0, 12), (900.0, 10**9)):
        m = mx.mean_for(rate, cap)
        assert mx.capped_mean(m, cap) == pytest.approx(rate, rel=1e-6)
    assert mx.mean_for(2.0, 2) == float("inf") and mx.mean_for(0, 3) == 0


def test_level_makes_up_for_copies_at_the_cap():
    copies, tokens = np.array([1, 2, 50]), np.array([1000, 300, 100])
    for wanted, cap in ((200.0, 2), (1500.0, 2), (2700.0, 2), (5000.0, 4)):
        level = mx.level_for(copies, tokens, wanted, cap)
        assert (np.minimum(level * copies, cap) * tokens).sum() == pytest.approx(wanted)
    assert mx.level_for(copies, tokens, 2800.0, 2) == float("inf")


def test_reached_shares_are_near_the_reachable_ones(spark):
    """Sources that are not short get within 2 % of their tokens, and copies do not cost them any."""
    docs = [(i, "a", f"text {i} of the first source " * 3) for i in range(9000)] + [(20_000 + i, "b", f"text {i % 2000} of the other one " * 3) for i in range(4000)] + [(40_000, "c", "few words")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.4, 3), ("b", 0.5, 4), ("c", 0.1, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mx.reached_shares(frame, targets).collect()}
    for name in "ab":
        r = report[name]
        assert r.expected_tokens == pytest.approx(r.wanted_tokens) and r.mix_tokens == pytest.approx(r.wanted_tokens, rel=0.02)
    assert report["c"].short and report["c"].uses == 2
    reachable = {k: r.expected_tokens / sum(x.expected_tokens for x in report.values()) for k, r in report.items()}
    assert all(report[k].reached_share == pytest.approx(v, rel=0.02) for k, v in reachable.items())
    assert [r.source for r in mx.short_sources(frame, targets).collect()] == ["c"]


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("<|endoftext|>",)], "text string").coalesce(1)
    counts = [r.tokens for r in mx.with_token_counts(df).collect()]
    assert counts[0] == 2 and counts[1:3] == [0, 0] and counts[3] > 1
