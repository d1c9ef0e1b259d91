from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from notelake import schema
from notelake.operators import graph as gr
from notelake.operators.components import connected


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 4)]
    df = spark.createDataFrame(pairs, "a long, b long")
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {x: find(x) for x in parent}
    assert {r.id: r.root for r in connected(df).collect()} == want
    assert connected(df.limit(0)).count() == 0


def test_resolution_is_the_sequential_rule(spark):
    r = np.random.default_rng(7)
    for trial in range(3):
        base = r.standard_normal((12, 16))
        rows = []
        for at in range(60):
            v = base[r.integers(12)] + 0.35 * r.standard_normal(16)
            name = f"N{r.integers(25)} x"
            aliases = [f"N{r.integers(25)} x" for _ in range(r.integers(3))] if r.random() < 0.4 else []
            rows.append((at, name, aliases, None if r.random() < 0.2 else v.astype(np.float32).tolist()))
        df = spark.createDataFrame(rows, "at long, name string, aliases array<string>, embedding array<float>")
        got = {x.slug: (x.concept_slug, x.how) for x in gr.resolve_concepts(df, dim=16).collect()}
        slugs, aliases = {}, {}
        for at, name, names, v in rows:
            s = name.lower()
            slugs.setdefault(s, (at, v))
            for a in names:
                aliases.setdefault((a.lower(), s), at)
        one = gr.resolve_in_order(pd.DataFrame([(s, at, v) for s, (at, v) in slugs.items()], columns=["slug", "at", "embedding"]), pd.DataFrame([(a, s, at) for (a, s), at in aliases.items()], columns=["alias_slug", "slug", "at"]))
        assert got == {x.slug: (x.concept_slug, x.how) for x in one.itertuples()}, trial


def test_resolution_rules_one_by_one():
    v = lambda *x: np.array(x, float)
    slugs = pd.DataFrame([("di", 0, v(1, 0)), ("dependency injection", 2, v(0, 1)), ("di framework", 3, v(0.99, 0.05)), ("far", 4, v(-1, 0)), ("none", 5, None)], columns=["slug", "at", "embedding"])
    aliases = pd.DataFrame([("dependency injection", "di", 1)], columns=["alias_slug", "slug", "at"])
    out = gr.resolve_in_order(slugs, aliases).set_index("slug")
    assert out.concept_slug.to_dict() == {"di": "di", "dependency injection": "di", "di framework": "di", "far": "far", "none": "none"}
    assert out.how.to_dict() == {"di": "new", "dependency injection": "alias", "di framework": "similar", "far": "new", "none": "new"}


@pytest.fixture
def graph(spark):
    concepts = spark.createDataFrame([(i, f"c{i}", f"c{i}", "study" if i < 3 else "misc") for i in range(1, 6)], "id long, name string, slug string, category string")
    edges = spark.createDataFrame([(1, 2, "r", 3.0, 3), (1, 3, "r", 1.0, 1), (2, 4, "r", 2.0, 2), (3, 4, "s", 9.0, 9), (2, 1, "r", 1.0, 1), (4, 5, "r", None, 1), (1, 1, "r", 1.0, 1)], schema.EDGES)
    return concepts, edges


def test_two_hops_take_the_heaviest_path(spark, graph):
    concepts, edges = graph
    rows = gr.two_hop(edges, concepts, concepts.filter("id = 1")).collect()
    assert sorted((r.hop, r.other_id, r.via_id) for r in rows if r.hop == 2) == [(2, 4, 2)]  # by the heavier first edge
    assert sorted(r.other_id for r in rows if r.hop == 1) == [1, 2, 3]


def test_listing_and_top_k(spark, graph):
    concepts, edges = graph
    rows = gr.list_edges(edges, concepts, "both", top_k=1).filter("concept_id = 4").collect()
    assert sorted((r.direction, r.other_id) for r in rows) == [("in", 3), ("out", 5)]
    assert gr.list_edges(edges, concepts, "out", relation="s").count() == 1


def test_accumulation(spark, graph):
    _, edges = graph
    fresh = spark.createDataFrame([(1, 2, "r"), (1, 2, "r"), (5, 5, "r"), (2, 3, "n"), (1, 2, None)], "src_id long, dst_id long, relation string")
    got = {(r.src_id, r.dst_id, r.relation): (r.weight, r.evidence_count) for r in gr.accumulate_edges(edges, fresh).collect()}
    assert got[1, 2, "r"] == (5.0, 5) and got[2, 3, "n"] == (1.0, 1) and (5, 5, "r") not in got and got[1, 1, "r"] == (1.0, 1)


def test_export_needs_both_ends(spark, graph):
    concepts, edges = graph
    assert sorted((r.src_id, r.dst_id) for r in gr.export_edges(edges, concepts, "study", 1.0).collect()) == [(1, 1), (1, 2), (2, 1)]
    lines = [r.line for r in gr.export_mermaid(edges, concepts, "study", 2.0).orderBy("part", "place").collect()]
    assert lines == ["graph LR", '  n1["c1"]', '  n2["c2"]', "  n1 -- r --> n2"]


def test_extraction_answers(spark):
    good = '{"concepts":[{"name":"A"},{"name":" "},{"aliases":["x"]}],"relations":[{"src":"A","dst":"B","type":"t"},{"src":"A","dst":"","type":"t"}]}'
    rows = [(0, f"```json\n{good}\n```"), (1, f"text {good} text"), (2, "```\n{broken\n```"), (3, ""), (4, None), (5, "{}"), (6, "[1]")]
    got = {r.i: (len(r.concepts), len(r.relations)) for r in gr.extract_json(spark.createDataFrame(rows, "i int, response string")).collect()}
    assert got == {0: (1, 1), 1: (1, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0)}


def test_items_without_concepts_lose_their_relations(spark):
    rows = ['{"doc_id":"d","chunk_index":0,"concepts":[{"name":" A b "}],"relations":[{"src":"a B","dst":"C","type":"t"},{"src":"C","dst":"c","type":"t"}]}',
            '{"doc_id":"d","chunk_index":1,"concepts":[],"relations":[{"src":"A","dst":"C","type":"t"}]}', '{"chunk_index":1}', "no json"]
    items = gr.read_items(spark.createDataFrame([(r,) for r in rows], "item string"))
    assert items.count() == 2
    concepts = spark.createDataFrame([(1, "a b")], "id long, slug string")
    aliases = spark.createDataFrame([(2, "C", "c"), (3, "C", "c")], schema.ALIASES)
    mentions, edges = gr.store_items(items, concepts, aliases)
    assert [(r.concept_id, r.chunk_index) for r in mentions.collect()] == [(1, 0)]
    assert [(r.src_id, r.dst_id, r.relation) for r in edges.collect()] == [(1, 2, "t")]


def test_scope_of_a_rebuild(spark):
    mentions = spark.createDataFrame([(1, "a", 0, "s"), (1, "b", 0, None)], schema.MENTIONS)
    chunks = spark.createDataFrame([("a", "study"), ("b", "misc")], "doc_id string, category string")
    assert [r.doc_id for r in gr.clear_mentions(mentions, chunks, category="study").collect()] == ["b"]
    assert [r.doc_id for r in gr.clear_mentions(mentions, chunks, category="study", doc_id="b").collect()] == ["a"]
    with pytest.raises(ValueError):
        gr.clear_mentions(mentions, chunks)
