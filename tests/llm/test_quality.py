from __future__ import annotations

import numpy as np
import pytest

from notelake.llm import quality as ql

COMMON = ["the", "a", "of", "and", "is", "in", "to", "that", "it", "was", "but", "not", "this", "나는", "우리는", "は", "が", "を", "der", "die", "und", "ist"]
PROSE = "The review of the draft was short, but it is not the end of this story. " * 6
CASES = {
    "prose": [PROSE, PROSE.lower().replace(".", "").replace(",", ""), "\n".join(PROSE[i : i + 50] for i in range(0, len(PROSE), 50)), "A: The review was short, and it is in the draft.\nB: It is not the end of that story.\n" * 3,
              "우리는 시끄러운 각주와 쓸모있는 비유를 함께 개선했다. 나는 다시 중복을 늘렸다. " * 4, "新しい会議がないと会議は去年の冬に索引を変えてしまう。私は昨日概念を測った。" * 3, PROSE + "\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |", "# Title\n\n" + PROSE],
    "list": ["- alpha beta\n- gamma delta\n" * 8, "1. one thing\n2. other thing\n3. third\n" * 4, "* [x] done item (Abc)\n* [ ] open item\n" * 5, "Bob: red green blue\nAnn: green red\nTim: blue\n" * 5],
    "table": ["| a | b |\n|---|---|\n" + "| 1 | x |\n" * 9, "name,value,unit\n" + "abc,12,kg\n" * 9, "name\tvalue\n" + "abc\t12.5\n" * 9, "name      value     unit\n" + "abc       12        kg\n" * 9],
    "junk": ["[12:00:01] INFO core.run:12 0xdeadbeef rc=0\n" * 9, "QmFzZTY0IGVuY29kZWQgZGF0YSBsb29rcyBsaWtlIHRoaXM3OHg5WWFCYzEyMzQ1Njc4OTBBQkNERUY\n" * 5, "85e3f400 21435e92 64d8378341044d15 e14390a2b7eb4fec 97808bec " * 5, "spam ham eggs " * 40, "token, alias, editor, draft, garden, kitchen, index, filter, memory, bridge, vector, lantern " * 3,
             "/$@ >+~<+@_~/&/ _?~&~_/?<~_:_-&??$=^_;& !+&^ &*(%$#@!" * 5],
}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t) for i, t in enumerate(t for texts in CASES.values() for t in texts)] + [(900, None), (901, ""), (902, "   \n "), (903, "x" * 300_000), (0, CASES["prose"][0])]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, kind string, words int")
    words = spark.createDataFrame([("en", w) for w in COMMON] + [("en", None)], "lang string, word string")
    return docs, words


def test_kinds(table):
    got = {r.doc_id: r.kind for r in ql.text_statistics(*table).collect()}
    want = dict(enumerate(k for k, texts in CASES.items() for _ in texts))
    assert {i: got[i] for i in want} == want
    assert got[900] is None and got[901] is None and got[903] == "junk" and len(got) == len(want) + 4


def test_statistics(spark, table):
    docs = spark.createDataFrame([(1, "The cat sat. On the mat!\nno stop\n\n")], "doc_id long, text string")
    r = ql.text_statistics(docs, table[1]).first()
    assert (r.words, r.mean_word_length, r.stop_line_share, r.common_word_share) == (8, pytest.approx(23 / 8), 0.5, 0.25)
    assert r.symbol_ratio == pytest.approx(2 / 34)


def test_empty_tables(table):
    assert ql.text_statistics(table[0].limit(0), table[1]).count() == 0
    assert ql.text_statistics(table[0], table[1].limit(0)).count() == table[0].select("doc_id").distinct().count()


def test_layouts_of_lines():
    profiler = ql.Profiler(frozenset(COMMON), ql.Profiles.seeds())
    lines = ["Nov 26 15:31:00 The disk of the host is full.", "Nov 26 was the day of the review.", "| a | b |", "- one", "x  y  z", "?!/&%$"]
    assert list(map(profiler.layout, lines)) == [ql._LOG, ql._PLAIN, ql._CELL, ql._BULLET, ql._CELL, ql._NOISE]
    assert [k for k in profiler.runs([lines[0], lines[1]])["layout"]] == [ql._LOG, ql._PLAIN]


def test_kinds_come_from_the_profiles():
    """Where every profile stands for prose, nothing is a list, a table or junk, whatever its lines look like."""
    seeds = ql.Profiles.seeds()
    blind = ql.Profiles(seeds.names, ["prose"] * len(seeds.names), seeds.rows)
    texts = [t for own in CASES.values() for t in own]
    assert set(ql.Profiler(frozenset(COMMON), blind).measure(texts)["kind"]) == {0}


def test_batches_do_not_change_the_result():
    profiler = ql.Profiler(frozenset(COMMON), ql.Profiles.seeds())
    texts = [ql.tidy(t) for own in CASES.values() for t in own] + ["\n", " ", "a", "---\ntitle: x\n---\nThe end of it is a story.", "x\r\ny"]
    together = profiler.measure(texts)
    for i, t in enumerate(texts):
        alone = profiler.measure([t])
        assert alone["kind"][0] == together["kind"][i] and alone["parts"][0].tolist() == together["parts"][i].tolist(), t[:40]


def test_fit_moves_profiles_and_learns_endings(spark):
    korean = "우리는 시끄러운 각주와 쓸모있는 비유를 함께 개선했다. 나는 다시 중복을 늘렸다."
    docs = spark.createDataFrame([(i, korean * 3, "ko") for i in range(60)] + [(100 + i, PROSE, "EN") for i in range(60)], "doc_id long, text string, lang string")
    got = ql.fitted(docs, frozenset(COMMON), lang="lang", sample=10**6)
    assert {"prose hangul ko", "prose latin en"} <= set(got.names) and set("를다을") <= set(got.endings) <= set(korean)
    assert not np.allclose(got.rows[0], ql.Profiles.seeds().rows[0])


def test_fit_reads_every_document(spark):
    """The profile of Latin prose is the mean of all its runs, the first and the last of more documents than a sample would hold."""
    texts = [PROSE[: 75 + i % 90] + "REVIEW " * (i % 5) + "is in the draft." for i in range(2500)]
    got = ql.fitted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), frozenset(COMMON))
    runs = ql.Profiler(frozenset(COMMON), ql.Profiles.seeds()).runs(texts)
    own = runs["p"][ql.Profiles.seeds().divergences(runs["p"]).argmin(1) == 0]
    assert len(own) > 2000 and np.allclose(got.rows[0], own.astype(np.float64).mean(0), rtol=0, atol=1e-6)


def test_rare_profiles_keep_their_first_values_in_tables_of_any_size(spark):
    texts = ["token, alias, editor, draft, garden, kitchen, index, filter, memory, bridge, vector, lantern"] * 21
    few, many = (spark.createDataFrame(list(enumerate(texts + [PROSE] * n)), "doc_id long, text string") for n in (100, 2500))
    at, seeds = ql.Profiles.seeds().names.index("keywords latin"), ql.Profiles.seeds().rows
    assert not np.allclose(ql.fitted(few, frozenset(COMMON)).rows[at], seeds[at], atol=1e-3)
    assert np.array_equal(ql.fitted(many, frozenset(COMMON)).rows[at], seeds[at])


def test_too_many_common_words_are_an_error(table, monkeypatch):
    monkeypatch.setattr(ql, "MOST_COMMON_WORDS", 3)
    with pytest.raises(ValueError, match="common words"):
        ql.text_statistics(*table)


def test_divergence():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])
    assert ql.divergence(p, q)[0] == pytest.approx([0.0, 1.0], abs=1e-9)
