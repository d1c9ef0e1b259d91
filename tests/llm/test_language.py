from __future__ import annotations

import pytest

from notelake.llm import language as la

TEXTS = {
    "en": ["The quick review was moved because of the note in this section.", "There is no reason that we should not see the other draft again."],
    "de": ["Ich habe gestern gemerkt, dass der Beweis und die Frage zusammengehören.", "Es gibt keinen Grund, warum das nicht auch so sein sollte."],
    "fr": ["Je ne sais pas pourquoi la question a été posée sans le signal.", "Nous avons enfin trouvé la réponse, mais elle reste dans le cahier."],
    "es": ["Hemos medido la prueba a menudo, pero el concepto sigue siendo claro.", "No sé por qué la muestra parece más larga que el ruido."],
    "ko": ["우리는 시끄러운 각주와 쓸모있는 비유를 함께 개선했다.", "나는 다시 중복을 늘렸고 결과를 설명했다."],
    "ja": ["新しい会議がないと会議は去年の冬に索引を変えてしまう。", "私は昨日概念を測ったことになっている。"],
}


@pytest.fixture(scope="module")
def filters():
    samples = {k: [t for t in v] * 3 for k, v in TEXTS.items()}
    samples["de"] = samples["de"] + TEXTS["en"][:1]  # a wrong label
    return la.fit(samples, {"en": ["the", "and"], "de": ["der", "und"], "fr": ["le", "et"], "es": ["el", "y"]})


def test_labels(spark):
    given = ["ko", "KOR", "en-US", "eng", "pt", "xx", "und", "", None, "unknown", "fre", "ES", " ja ", "de_AT"]
    df = spark.createDataFrame([(x,) for x in given], "l string").coalesce(1)
    assert [r[0] for r in df.select(la.label_language("l")).collect()] == ["ko", "ko", "en", "en", None, None, None, None, None, None, "fr", "es", "ja", "de"]


def test_sentences_are_prose_only():
    text = "# A heading that ends in a stop.\n\nFirst sentence here. Second one\nis wrapped! cut off\n\n- list item number one.\n1. Another item of it.\n\n| a | b. |\n\n```\nCode that looks like prose.\n```\n\nword,12,34.5\n\n> Quoted words are prose too.\n"
    got = [text[a:b] for a, b in la.sentences(text)]
    assert got == ["First sentence here.", "Second one\nis wrapped!", "Quoted words are prose too."]
    assert la.sentences("") == [] and la.sentences(None) == [] and la.sentences("x" * 200_000) == [] and la.sentences("3.14 and 2.71") == []
    assert len(la.sentences("日本語の文です。次の文もあります。\r\n短い。")) == 2


def test_held_out_sentences(filters):
    held = {"en": "This is the other section because there was no review.", "de": "Das ist nicht der Grund, dass die Frage auch fehlt.", "fr": "La réponse ne reste pas dans le signal sans question.", "es": "El concepto sigue siendo la prueba, pero no más claro.", "ko": "우리는 결과를 다시 늘렸고 비유를 설명했다.", "ja": "去年の冬に私は索引を測ってしまう。"}
    share = filters.shares(list(held.values()))
    assert [la.LANGUAGES[i] for i in share.argmax(1)] == list(held)
    assert filters.shares(["", "123"]).max() == 0


def test_sentences_of_other_languages_have_none(spark, filters):
    other = ["Сегодня мы долго говорили о новой книге и старом друге.", "我们昨天讨论了这个问题并且得到了新的结果。", "ابتدأ الاجتماع في الصباح وانتهى قبل الظهر."]
    assert filters.best(other)[0].tolist() == [-1, -1, -1]
    df = spark.createDataFrame([("a", 0, other[0] + " " + TEXTS["en"][0], "ru"), ("a", 1, other[0], "ru")], "doc_id string, chunk_index int, content string, language string")
    seg = {r.chunk_index: r for r in la.segments_of(df, ["doc_id", "chunk_index"], "content", filters).collect()}
    assert [s.language for s in seg[0].segments] == [None, "en"] and seg[1].language is None and seg[1].confidence == 0 and len(seg[1].segments) == 1
    assert [tuple(r) for r in la.mislabelled(df, ["doc_id", "chunk_index"], "content", "language", filters).collect()] == [("a", 0, "en")]


def test_more_languages_than_a_slice_holds():
    languages = (*(f"x{i}" for i in range(70)), *la.LANGUAGES)
    model = la.fit({k: v * 3 for k, v in TEXTS.items()}, languages=languages)
    assert model.cells.shape[0] == 2
    names = [languages[i] for i in model.best([TEXTS[k][0] for k in la.LANGUAGES])[0]]
    assert names == list(la.LANGUAGES)


def test_mixed_and_mislabelled(spark, filters):
    en, de, ko = (" ".join(TEXTS[x]) for x in ("en", "de", "ko"))
    rows = [("a", 0, en, "en"), ("a", 1, en, "de"), ("a", 2, en + "\n\n" + ko, "en"), ("a", 3, de, None), ("a", 4, "- list\n- only", "xx"), ("a", 5, None, "en"), ("a", 6, "", None), ("a", 7, en, "ENG"), ("a", 1, en, "de"), (None, 8, ko, "en")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id string, chunk_index int, content string, language string, segments string")
    got = sorted((r.chunk_index, r.language) for r in la.mislabelled(df, ["doc_id", "chunk_index"], "content", "language", filters).collect())
    assert got == [(1, "en"), (2, "en"), (2, "ko"), (3, "de"), (8, "ko")]
    seg = {r.chunk_index: r for r in la.detected(df.dropDuplicates(["chunk_index"]), ["doc_id", "chunk_index"], "content", filters).collect()}
    assert [s.language for s in seg[2].segments] == ["en", "ko"] and 0 < seg[2].confidence <= 1
    assert seg[5].language is None and seg[5].segments == [] and seg[4].confidence == 0
    s = seg[2].segments[1]
    assert rows[2][2][s.start : s.start + s.length] == ko
    assert la.mislabelled(df.limit(0), ["doc_id", "chunk_index"], "content", "language", filters).count() == 0


def test_fit_from_a_table(spark):
    rows = [(t + " " + u, k) for k, v in TEXTS.items() for t in v for u in v] + [("no label here at all, sorry.", None)]
    df = spark.createDataFrame(rows, "content string, language string")
    model = la.fitted(df, "content", "language", rows=3)
    assert [la.LANGUAGES[i] for i in model.shares([TEXTS["de"][0], TEXTS["ko"][1]]).argmax(1)] == ["de", "ko"]
    assert la.fitted(df.limit(0), "content", "language").shares(["x"]).max() == 0


def test_too_many_common_words_are_an_error(spark):
    df = spark.createDataFrame([(TEXTS["en"][0], "en")], "content string, language string")
    words = spark.range(la.MOST_COMMON_WORDS + 1).selectExpr("'ko' AS lang", "concat('w', id) AS word", "id")
    with pytest.raises(ValueError, match="common words"):
        la.fitted(df, "content", "language", words)
    assert la.fitted(df, "content", "language", words.filter(f"id < {la.MOST_COMMON_WORDS}")) is not None
