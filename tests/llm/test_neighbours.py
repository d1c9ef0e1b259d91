from __future__ import annotations

import numpy as np

from notelake.llm import neighbours as nb

SCHEMA = "kind int, key string, embedding array<float>, id string, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def exact(rows, k=3, dim=16):
    out = {}
    for kind in {r[0] for r in rows}:
        own = {r[1]: np.array(r[2], np.float32).astype(np.float64) for r in rows if r[0] == kind and r[1] and r[2] and len(r[2]) == dim and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])}
        keys = sorted(own)
        if not keys:
            continue
        x = np.stack([own[i] for i in keys])
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        c = np.round(x @ x.T, 12)
        for i, key in enumerate(keys):
            best = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (-c[i, j], keys[j]))[:k]
            out[kind, key] = [keys[j] for j in best]
    return out


def found(df, **options):
    got: dict = {}
    for r in nb.most_similar(df, dim=16, **options).collect():
        got.setdefault((r.kind, r.key), []).append((-r.cosine, r.other))
    return {k: [o for _, o in sorted(v)] for k, v in got.items()}


def clustered(n, seed=0, noise=0.15):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((max(1, n // 12), 16))
    return [(int(i % 2), f"k{i}", (centres[r.integers(len(centres))] + noise * r.standard_normal(16)).astype(np.float32).tolist()) for i in range(n)]


def test_recall_against_brute_force(spark):
    rows = clustered(1500)
    got, want = found(frame(spark, rows)), exact(rows)
    hit = sum(len(set(got.get(k, [])) & set(v)) for k, v in want.items())
    assert hit / sum(map(len, want.values())) > 0.97


def test_splitting_large_buckets_keeps_recall(spark):
    rows = clustered(1500, 4)
    got, want = found(frame(spark, rows), cap=40), exact(rows)
    assert sum(len(set(got.get(k, [])) & set(v)) for k, v in want.items()) / sum(map(len, want.values())) > 0.9


def test_unusable_vectors_and_repeated_rows(spark):
    good = clustered(30, 1)
    bad = [(0, "nan", [float("nan")] * 16), (0, "inf", [float("inf")] * 16), (0, "zero", [0.0] * 16), (0, "short", [1.0]), (0, "null", None), (0, None, [1.0] * 16), (0, "hole", [None] * 16)]
    got = found(frame(spark, good + bad + good[:5]))
    assert {k for _, k in got} <= {k for _, k, _ in good} and all(len(v) == 3 for v in got.values())
    assert found(frame(spark, [])) == {} and found(frame(spark, good[:1])) == {}


def test_copies_and_scaled_copies_tie_by_key(spark):
    v = [float(x) for x in np.random.default_rng(3).standard_normal(16).astype(np.float32)]
    rows = [(0, f"c{i:04d}", v) for i in range(400)] + [(0, "a", [2 * x for x in v]), (0, "z", [4 * x for x in v])] + [(0, k, e) for _, k, e in clustered(20, 9)]
    got, want = found(frame(spark, rows)), exact(rows)
    same = [k for k in want if k[1].startswith("c") or k[1] in "az"]
    assert {k: got[k] for k in same} == {k: want[k] for k in same}


def test_pairs_are_ordered_and_distinct(spark):
    rows = nb.similar_pairs(frame(spark, clustered(60, 2)), dim=16).collect()
    assert all(r.key_a < r.key_b for r in rows) and len(set(rows)) == len(rows)


def test_tight_hot_group_is_exact(spark):
    r = np.random.default_rng(8)
    centre = r.standard_normal(16)
    rows = [(0, f"t{i}", (centre + 1e-4 * r.standard_normal(16)).astype(np.float32).tolist()) for i in range(300)]
    got, want = found(frame(spark, rows), cap=20, tight=50), exact(rows)
    assert sum(len(set(got.get(k, [])) & set(v)) for k, v in want.items()) / sum(map(len, want.values())) > 0.9


def test_hot_group_split_by_a_deep_level_is_searched_in_all_tables(spark):
    r = np.random.default_rng(2)
    centre = r.standard_normal(16)
    rows = [(0, f"t{i}", (centre + 0.03 * r.standard_normal(16)).astype(np.float32).tolist()) for i in range(1500)]
    got, want = found(frame(spark, rows), cap=20, tight=50), exact(rows)
    assert sum(len(set(got.get(k, [])) & set(v)) for k, v in want.items()) / sum(map(len, want.values())) > 0.95


def test_joins_find_what_sent_names_find(spark):
    r = np.random.default_rng(5)
    centre = r.standard_normal(16)
    rows = clustered(600, 6) + [(0, f"t{i}", (centre + 0.01 * r.standard_normal(16)).astype(np.float32).tolist()) for i in range(200)]
    df = frame(spark, rows)
    assert found(df, cap=25, tight=60, most_heavy=0) == found(df, cap=25, tight=60)


def test_oversized_prefixes_do_not_depend_on_the_cut_into_tasks(spark):
    rows = clustered(2000, 7)
    hasher = nb.CrossPolytope(16, 3, 2, nb.LEVELS, 7)
    names = [nb.heavy_prefixes(frame(spark, rows).repartition(n), hasher, 30, 60, 10**6) for n in (1, 60)]
    assert len(names[0][0]) > 100 and np.array_equal(names[0][0], names[1][0]) and names[0][1:] == names[1][1:] and names[0][2] == 2000


def test_fast_transform_is_the_matrix_product():
    x = np.random.default_rng(1).standard_normal((5, 32)).astype(np.float32)
    assert np.allclose(nb.fast_hadamard(x), x @ nb.hadamard(32), atol=1e-5)
