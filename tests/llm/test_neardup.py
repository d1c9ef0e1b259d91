from __future__ import annotations

import random

import numpy as np
import pytest

from notelake.llm import neardup as nd

SCHEMA = "doc_id string, chunk_index int, content string, text_id string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def shingles(text, least=20):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= least else frozenset()


def exact(rows, t=0.6):
    sets = sorted({(d, i): shingles(c) for d, i, c in rows}.items())
    return {(*a, *b) for x, (a, s) in enumerate(sets) for b, u in sets[x + 1 :] if s and u and len(s & u) >= t * len(s | u) - 1e-12}


def edited(r, n=120, vocabulary=80):
    words = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        base = r.choices(words, k=r.choice([19, 20, 21, 25, 40, 90, 300]))
        rows.append((f"d{i % 9}", i, " ".join(base)))
        for _ in range(r.randint(0, 3)):
            other = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                at = r.randrange(len(other))
                if r.random() < 0.5:
                    other[at] = r.choice(words)
                elif r.random() < 0.5:
                    other.insert(at, r.choice(words))
                else:
                    other = other[at:] + other[:at]
            if r.random() < 0.3:
                other = other[: int(len(other) * r.uniform(0.55, 1))]
            rows.append((f"d{i % 7}", len(rows) + 1000, " ".join(other).upper() if r.random() < 0.2 else " ".join(other)))
    return rows


def found(df):
    out = [tuple(r) for r in nd.similar_keys(df, ["doc_id", "chunk_index"]).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_pair_above_the_threshold_is_found(spark, seed):
    rows = edited(random.Random(seed))
    want = exact(rows)
    assert found(frame(spark, rows)) == want and len(want) > 60


def test_repetitive_texts(spark):
    rows = [("a", i, " ".join(f"w{j % p}" for j in range(n))) for i, (p, n) in enumerate([(1, 20), (1, 500), (2, 30), (2, 31), (3, 60), (5, 25), (5, 26), (40, 40), (40, 80)])]
    assert found(frame(spark, rows)) == exact(rows)


def test_null_short_empty_repeated_and_very_long_texts(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [("a", 0, None), ("a", 1, ""), ("a", 2, "too short"), ("b", 0, long), ("b", 0, long), ("b", 1, long + " end"), ("c", 0, long)]
    assert found(frame(spark, rows)) == {("b", 0, "b", 1), ("b", 0, "c", 0), ("b", 1, "c", 0)}
    assert found(frame(spark, [])) == set()


def test_large_classes_of_copies_stand_as_membership(spark, monkeypatch):
    monkeypatch.setattr(nd, "ALL_PAIRS", 5)
    text = " ".join(f"u{i}" for i in range(40))
    rows = [("h", i, text) for i in range(9)] + [("n", 0, text + " more"), ("s", 0, "x " * 10)]
    assert found(frame(spark, rows)) == {("h", 0, "h", i) for i in range(1, 9)} | {("h", 0, "n", 0)}


def test_groups(spark):
    rows = edited(random.Random(5), 60)
    pairs = exact(rows)
    out = {(r.doc_id, r.chunk_index): r for r in nd.duplicate_groups(frame(spark, rows), ["doc_id", "chunk_index"]).collect()}
    assert set(out) == {(d, i) for d, i, c in rows if shingles(c)}
    assert all(out[p[:2]].group_id == out[p[2:]].group_id for p in pairs)
    parent = {k: k for k in out}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p in pairs:
        parent[find(p[:2])] = find(p[2:])
    assert len({r.group_id for r in out.values()}) == len({find(k) for k in out})
    text = {(d, i): c for d, i, c in rows}
    for k in list(out)[:40]:
        assert out[k].links == len({text[q] for p in pairs for q in (p[:2], p[2:]) if k in (p[:2], p[2:]) and text[q] != text[k]})


def texts_of(spark, rows):
    return {nd.text_ids(spark.createDataFrame([(c,)], "content string"), "content").first().text_id: c for c in {c for _, _, c in rows}}


def test_sets_without_enough_budget_are_found_by_plain_elements(spark):
    """With one segment for everything no budget sums up, so all pairs must come from the plain path."""
    rows = edited(random.Random(8), 25)
    ids = nd.text_ids(frame(spark, rows).select("content").distinct(), "content").collect()
    shingler, scheme = nd.Shingler(3, 20), nd.Scheme(0.6)
    signer = nd.Signer(0.6)
    signer.scheme.segments = lambda band: np.ones_like(band)
    batch = nd.pa.RecordBatch.from_arrays([nd.pa.array([r.text_id for r in ids]), nd.pa.array([r.content for r in ids])], ["id", "content"])
    sizes, elements = shingler.sets(batch.column("content").to_pylist())
    assert (signer.short(sizes, elements) | (sizes < 4)).all() and scheme.segments(np.array([5]))[0] > 1
    lacking, ends = [], np.cumsum(sizes)
    for i, r in enumerate(ids):
        own = elements[ends[i] - sizes[i] : ends[i]]
        lacking += [(int(e), r.text_id, int(sizes[i])) for e in own[: len(own) - int(np.ceil(0.6 * len(own) - 1e-9)) + 1].view(np.int64)]
    plain = spark.createDataFrame([(r.text_id, r.content) for r in ids], "id long, content string")
    met = nd._plain_pairs(plain, spark.createDataFrame(lacking, "element long, id long, size long"), 0.6, 3, 20).distinct().collect()
    text = {r.text_id: shingles(r.content) for r in ids}
    want = {(a, b) for a in text for b in text if a < b and text[a] and text[b] and len(text[a] & text[b]) >= 0.6 * len(text[a] | text[b])}
    assert want <= {(r.a, r.b) for r in met} and want


def test_signatures_of_many_texts_are_spread_in_pairs_of_blocks(spark):
    """A family of texts that share nearly everything; with blocks of three sets nearly all its pairs come from the second way."""
    r = random.Random(4)
    base = [f"t{i}" for i in range(60)]
    rows = [("f", i, " ".join(base[: i % 50] + [f"x{i}"] + base[i % 50 :])) for i in range(60)] + [(d, i + 1000, c) for d, i, c in edited(r, 20)]
    df = frame(spark, rows)
    got = {(x.a, x.b) for x in nd.similar_texts(df, block=3).collect()}
    assert got == {(x.a, x.b) for x in nd.similar_texts(df).collect()} and len(got) >= 60 * 59 // 2


def test_parts_do_not_change_the_result(spark):
    df = frame(spark, edited(random.Random(6), 40))
    few, many = ({(x.a, x.b) for x in nd.similar_texts(df.repartition(n), tasks=t).collect()} for n, t in ((1, 1), (6, 450)))
    assert few == many and few
