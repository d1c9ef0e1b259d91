from __future__ import annotations

import pytest

from notelake.llm import unify as un

SAME = [("ｎｏｔｅ", "note"), ("résumé", "résumé"), ("한글", "한글"), ("no​te­", "note"), ("a b", "a b"), ("a　b", "a b"), ("a‑b", "a-b"), ("ﬁle", "file"), ("nоte", "note"), ("Ｂeta", "Βeta"), ("ï", "ї"), ("граф", "гpaф"), ("﻿x", "x"), ("Ӏ", "I"), ("ϹϳͿ", "CjJ"), ("Ѵӕ", "Væ")]
OTHER = [("resume", "résumé"), ("Note", "note"), ("x²", "x2"), ("a b", "ab"), ("a-b", "a b"), ("a_b", "a-b"), ("a  b", "a b"), ("①", "1"), ("½", "1/2"), ("o", "0")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert un.same_look(a) == un.same_look(b) and un.same_look(un.same_look(a)) == un.same_look(a)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    assert un.same_look(a) != un.same_look(b)


def test_comparison_form_folds_case():
    assert un.comparison_form("Straße Ⅳ x²") == un.comparison_form("STRASSE IV x2") == "strasse iv x2"
    assert un.comparison_form(None) is None and un.same_look(None) is None and un.same_look("") == "" and un.same_look("​") == ""


def test_pairs(spark):
    rows = [("note", 1), ("nоte", 2), ("ｎｏｔｅ", 3), ("note", 4), ("other", 5), (None, 6), ("", 7), ("​", 8), ("x" * 50_000, 9)]
    df = spark.createDataFrame(rows, "slug string, form int")
    got = sorted((r.value_a, r.value_b) for r in un.lookalikes(df, "slug").collect())
    values = ["note", "nоte", "ｎｏｔｅ"]
    assert got == sorted([(a, b) for a in values for b in values if a < b] + [("", "​")])
    assert un.lookalikes(df.limit(0), "slug").count() == 0


def test_a_form_with_many_spellings_is_spread(spark):
    spellings = ["n" + "\u200b" * i + "ote" for i in range(40)] + ["Note", "n\u00b2", "n2"]
    df = spark.createDataFrame([(s,) for s in spellings * 2], "slug string")
    want = sorted((a, b) for a in spellings[:40] for b in spellings[:40] if a < b)
    assert sorted(map(tuple, un.lookalikes(df, "slug", per_task=7).collect())) == want


def test_unify_column_keeps_rows(spark):
    df = spark.createDataFrame([("ａ",), (None,), ("b",), ("ａ",)], "v string").coalesce(1)
    assert [r[0] for r in df.select(un.unify("v")).collect()] == ["a", None, "b", "a"]
