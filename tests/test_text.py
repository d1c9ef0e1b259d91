"""Closed-form expectations of the text expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from notelake.functions import text as tx
from notelake.functions import vectors as vx


def values(spark, inputs, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}").coalesce(1)
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_clean_name(spark):
    got = values(spark, ["4.2.6_청크_크기_선택", "1_Introduction", "some_nested-topic", "  multi   space  ", "2024년 회고", "", None], tx.clean_name)
    assert got == ["청크 크기 선택", "Introduction", "some nested topic", "multi space", "년 회고", "", None]


def test_derive_section_and_category(spark):
    paths = ["data/study/rag-v2/4_신뢰·운영/4.2_코퍼스/4.2.6_청크_크기.md", "data/about/JK.md", "a/b/c/d.md", "data/career/x.md", "notes/x.md"]
    assert values(spark, paths, tx.derive_section) == ["신뢰·운영 > 코퍼스 > 청크 크기", "about > JK", "c > d", "career > x", "notes > x"]
    assert values(spark, paths, tx.derive_category) == ["study", "about", "misc", "career", "misc"]


def test_title(spark):
    rows = [("# Hello World\n\nx", "a/b.md"), ("## no\ntext", "a/1_my_note.md"), (None, "a/123.md"), ("\n" * 10 + "# late", "late-one.md"), ("#nospace", "z.tar.md")]
    df = spark.createDataFrame(rows, "t string, p string").coalesce(1)
    assert [r[0] for r in df.select(tx.extract_title("t", "p")).collect()] == ["Hello World", "my note", "123", "late one", "z.tar"]


def test_expiry(spark):
    given = ["2026-12-31", "2026-12-31T10:30:00", "20261231", "2026-12-31T10", "not-a-date", "2026/12/31", "2026", "2026-12", "2026-13-40", None]
    got = values(spark, given, lambda c: F.date_format(tx.parse_expiry(c), "yyyy-MM-dd HH:mm"))
    assert got == ["2026-12-31 00:00", "2026-12-31 10:30", "2026-12-31 00:00", "2026-12-31 10:00", None, None, None, None, None, None]


def test_language_tags_slug(spark):
    assert values(spark, ["가" * 11, "가" * 10, "x" * 500 + "가" * 50, "", None], tx.detect_language) == ["ko", "en", "en", "en", "en"]
    assert values(spark, ["a, b ,,c ", "", None], tx.normalize_tags) == [["a", "b", "c"], [], []]
    assert values(spark, ["  Dependency   Injection! ", "C++", "Éa·b-c_d", "!!!", "A B", None], tx.slug) == ["dependency injection", "c", "éa·b-c_d", "", "a b", None]


def test_tokens_and_counts(spark):
    assert values(spark, ["Hello, WORLD 42!", "검색-엔진", "", None], tx.tokens) == [["hello", "world", "42"], ["검색", "엔진"], [], []]
    assert values(spark, ["a b, c!", "", None], tx.token_count) == [5, 0, 0]
    assert values(spark, [": name: d :", None], lambda c: tx.embedding_text(c, F.lit(None).cast("string"))) == ["name: d", ""]


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), (None, [1.0], 0.0), ([], [], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert df.select(vx.cosine("a", "b")).first()[0] == pytest.approx(want)


def test_usable_vectors(spark):
    rows = [([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([1.0],), (None,), ([None, 1.0],)]
    assert [r[0] for r in spark.createDataFrame(rows, "v array<float>").coalesce(1).select(vx.usable("v", 2)).collect()] == [True] + [False] * 6


def test_hashed_embedding(spark):
    a, b, c = values(spark, ["red apple", "apple red", ""], lambda v: vx.hashed_embedding(v, 16))
    assert a == b and sum(map(abs, a)) in (0.0, 2.0) and c == [0.0] * 16
