from __future__ import annotations

import random

from notelake.llm import leaks as lk

DOCS = "doc_id long, text string, item_id string, key string"
ITEMS = "item_id long, text string, doc_id string"


def setup(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=r.choice([5, 13, 14, 40])))) for i in range(25)]
    docs = []
    for d in range(80):
        body = r.choices(words, k=r.randint(0, 60))
        if r.random() < 0.6:
            source = r.choice(items)[1].split()
            n = min(len(source), r.choice([8, 12, 13, 20]))
            at = r.randrange(len(source) - n + 1)
            body[len(body) // 2 : len(body) // 2] = source[at : at + n]
        docs.append((d, r.choice([" ", "\n", ", "]).join(body)))
    docs += [(100, None), (101, ""), (0, docs[0][1]), (102, items[1][1].upper()), (103, "ｗ" + items[2][1][1:]), (104, "x " * 50_000 + items[3][1])]
    items += [(50, None), (3, items[3][1]), (51, "")]
    return docs, items


def exact(docs, items, n=13):
    def grams(t):
        w = lk.words_of(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    return {(d, i) for d, t in docs for i, u in items if t and u and grams(t) & grams(u)}


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "clash", "clash") for d in docs], DOCS), spark.createDataFrame([(*i, "clash") for i in items], ITEMS)


def test_against_brute_force(spark):
    docs, items = setup(spark)
    want = exact(docs, items)
    a, b = frames(spark, docs, items)
    assert {tuple(r) for r in lk.leaked_items(a, b).collect()} == want and len(want) > 15
    assert {tuple(r) for r in lk.leaked_items(a, b, most_windows=0).collect()} == want  # without a broadcast


def test_empty_tables(spark):
    docs, items = setup(spark)
    a, b = frames(spark, docs, items)
    assert lk.leaked_items(a.limit(0), b).count() == 0 and lk.leaked_items(a, b.limit(0)).count() == 0


def test_words():
    assert lk.words_of("Ｆｕｌｌ Café_x-1 ﬁn") == ["full", "café", "x", "1", "fin"] and lk.words_of(None) == []


def test_spans_are_cut_out(spark):
    item = " ".join(f"t{i}" for i in range(15))
    docs = [(1, "Before this: " + item.upper() + ". " + "after that " * 20), (2, item + " x"), (3, "clean"), (4, None), (3, "clean")]
    a, b = frames(spark, docs, [(9, item)])
    rows = lk.without_leaks(a, b).collect()
    assert len(rows) == 4
    got = {r.doc_id: r for r in rows}
    assert sorted(map(tuple, got.values())) == sorted(map(tuple, lk.without_leaks(a, b, most_windows=0).collect()))  # without a broadcast
    assert got[1].text == "Before this: . " + "after that " * 20 and got[1].removed_words == 15 and not got[1].dropped
    assert got[2].dropped and got[2].text is None and got[3].text == "clean" and got[4].text is None
    assert lk.leaked_items(a.filter("doc_id <> 2"), b).count() == 1


def test_the_index_is_compact():
    r = random.Random(4)
    words = [f"word{i}" for i in range(5000)]
    index = lk.PassageIndex([(i, " ".join(r.choices(words, k=1000))) for i in range(100)], 13)
    assert len(index.hashes) == 100 * 988 and sum(x.nbytes for x in (index.hashes, index.items, index.places, index.starts)) + len(index.packed) < 50 * len(index.hashes)


def test_rows_of_a_key_once(spark):
    from notelake.llm.rows import once

    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (None, "c"), (None, "c")], "k long, t string")
    for most in (0, 5):
        assert sorted(map(str, once(df, ["k"], most).collect())) == sorted(map(str, df.distinct().collect()))
    assert once(df.limit(0), ["k"]).count() == 0
