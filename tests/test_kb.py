from __future__ import annotations

import json

import pytest

from notelake.kb import KnowledgeBase
from notelake.operators.providers import extract


@pytest.fixture
def kb(spark, tmp_path):
    base = KnowledgeBase(spark, str(tmp_path), dim=32)
    base.write_file("data/study/rag/deep/vectors.md", "---\ntitle: Vectors\ntags: [a, b]\n---\n# Intro\nVector search finds similar chunks.\n\n## Detail\nChunks of text have embeddings.", ingest=False)
    base.write_file("data/career/plan.md", "# Plan\nThe interview plan for spring.", ingest=False)
    base.add(str(tmp_path / "data"))
    return base


def counters(row):
    return {k: v for k, v in row.first().asDict().items() if v}


def test_documents_come_change_and_go(kb, tmp_path):
    assert [(r.doc_id, r.chunks, r.title) for r in kb.list_documents().collect()] == [("data/study/rag/deep/vectors.md", 2, "Vectors"), ("data/career/plan.md", 1, "Plan")]
    assert counters(kb.add(str(tmp_path / "data"))) == {"reused": 3}
    kb.write_file("data/career/plan.md", "# Plan\nA new plan.", ingest=False)
    assert counters(kb.add(str(tmp_path / "data" / "career" / "plan.md"))) == {"embedded": 1}
    assert counters(kb.add(str(tmp_path / "data" / "career" / "plan.md"), tags=["t"])) == {"metadata_updated": 1}
    (tmp_path / "data" / "career" / "plan.md").write_text("\n")
    assert counters(kb.add(str(tmp_path / "data" / "career"))) == {"deleted": 1}
    assert kb.get_document("data/study/rag/deep/vectors.md").count() == 2 and kb.list_documents().count() == 1


def test_lifecycle_and_search(kb, spark):
    queries = spark.createDataFrame([("q", "vector search"), ("p", "interview plan")], "id string, query string")
    hits = {r.query_id: r for r in kb.search(queries, expand=1, log=True).filter("rank = 1").collect()}
    assert hits["q"].doc_id.endswith("vectors.md") and [n.chunk_index for n in hits["q"].neighbours] == [1] and hits["p"].doc_id.endswith("plan.md")
    assert kb.search_log().count() == 2
    kb.archive("data/career/plan.md", "old")
    assert kb.search(queries).filter("doc_id like '%plan.md'").count() == 0 and kb.search(queries, include_archived=True).filter("doc_id like '%plan.md'").count() > 0
    assert kb.doctor("2030-01-01")[1].first().archived == 1
    kb.restore("data/career/plan.md")
    assert kb.search(queries, category="career").select("doc_id").distinct().count() == 1
    kb.archive("data/career/plan.md")
    kb.purge()
    assert kb.list_documents(include_archived=True).count() == 1


def test_graph(kb, spark):
    items = [{"doc_id": "d", "chunk_index": 0, "category": "study", "concepts": [{"name": "Alpha", "aliases": ["First Letter"], "description": "one"}, {"name": "Beta", "description": "two"}], "relations": [{"src": "Alpha", "dst": "Beta", "type": "part_of"}]},
             {"doc_id": "d", "chunk_index": 1, "concepts": [{"name": "first letter"}], "relations": [{"src": "first letter", "dst": "Beta", "type": "part_of"}, {"src": "Alpha", "dst": "first letter", "type": "x"}]}]
    df = spark.createDataFrame([(json.dumps(i),) for i in items], "item string")
    assert kb.store_concepts(df).first().asDict() == {"concepts": 3, "mentions": 3, "edges": 2}
    assert [(r.id, r.slug, r.mention_count) for r in kb.table("concepts").orderBy("id").collect()] == [(1, "alpha", 2), (2, "beta", 1)]
    assert [(r.src_id, r.dst_id, r.weight) for r in kb.table("edges").collect()] == [(1, 2, 2.0)]
    kb.store_concepts(df)
    assert kb.table("concepts").count() == 2 and kb.table("mentions").count() == 3 and kb.table("edges").first().weight == 4.0
    names = spark.createDataFrame([("First letter",)], "name string")
    edges, hops, places = kb.explain_concept(names)
    assert [r.other for r in edges.collect()] == ["Beta"] and hops.count() == 1 and places.count() == 2
    assert kb.related_concepts(names, "out").count() == 1
    assert kb.search_concepts(spark.createDataFrame([("q", "Alpha: one")], "id string, query string"), 1).first().concept_id == 1


def test_building_from_chunks(kb):
    told = kb.build_graph(extract, category="study", now="2025-01-01").first()
    assert told.concepts >= 3 and kb.table("runs").first().chunks_processed == 2
    before = kb.table("mentions").count()
    kb.build_graph(extract, category="study", rebuild=True)
    assert kb.table("mentions").count() == before and kb.table("runs").count() == 2
    assert {r.name: r.rows for r in kb.graph_stats().collect()}["documents"] == 1


def test_ends_of_relations_are_found_by_alias(kb, spark):
    def store(*items):
        return kb.store_concepts(spark.createDataFrame([(json.dumps(i),) for i in items], "item string")).first()

    told = store({"doc_id": "d", "chunk_index": 0, "concepts": [{"name": "Dependency Injection", "aliases": ["DI"]}, {"name": "Inversion"}],
                  "relations": [{"src": "DI", "dst": "Inversion", "type": "part_of"}, {"src": "Dependency Injection", "dst": "Inversion", "type": "uses"}]})
    assert told.edges == 2 and {r.relation for r in kb.table("edges").collect()} == {"part_of", "uses"}
    # Both ends are known from before, one by its alias only.
    assert store({"doc_id": "d", "chunk_index": 1, "concepts": [{"name": "Container"}], "relations": [{"src": "Container", "dst": "DI", "type": "uses"}, {"src": "di", "dst": "Inversion", "type": "part_of"}]}).edges == 2
    edges = {(r.src_id, r.dst_id, r.relation): r.weight for r in kb.table("edges").collect()}
    assert edges == {(1, 2, "part_of"): 2.0, (1, 2, "uses"): 1.0, (3, 1, "uses"): 1.0}


def test_new_concepts_are_numbered_in_order(kb, spark):
    items = [{"doc_id": f"d{i:03d}", "chunk_index": 0, "concepts": [{"name": f"concept {i}"}]} for i in range(50)]
    kb.store_concepts(spark.createDataFrame([(json.dumps(i),) for i in items], "item string").repartition(5))
    rows = kb.table("concepts").orderBy("id").collect()
    # Names that the hashed embedding cannot tell apart are one concept.
    assert [r.id for r in rows] == list(range(1, len(rows) + 1)) and len(rows) > 20
    assert [int(r.name.split()[1]) for r in rows] == sorted(int(r.name.split()[1]) for r in rows)


def test_reindexing_and_unread_files(kb, tmp_path):
    (tmp_path / "data" / "career" / "plan.md").write_text("# Plan\nChanged.")
    assert counters(kb.reindex_document("data/career/plan.md")) == {"embedded": 1}
    (tmp_path / "data" / "bad.md").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "data" / "scan.pdf").write_bytes(b"%PDF-1.4 nothing")
    kb.archive("data/career/plan.md")
    told = kb.reindex()[0].first()
    assert (told.added, told.unread) == (3, 2) and kb.list_documents().count() == 2
    assert {(r.doc_id, r.reason) for r in kb.unread().collect()} == {("data/bad.md", "bytes are not UTF-8"), ("data/scan.pdf", "no text in the PDF")}
    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "note.md").write_text("# N\ntext")
    kb.sync_vault(str(vault))
    (vault / "note.md").write_text("# N\nother text")
    assert counters(kb.reindex_document("obsidian/note.md", str(vault))) == {"embedded": 1}


def test_converting_with_the_classifier(kb):
    path = kb.convert("in/talk.html", "<h1>Interview</h1><p>The interview and the portfolio.</p>".encode(), category="auto")
    assert path.endswith("data/career/talk.md") and kb.list_documents(category="career").count() == 2


def test_export(kb, spark, tmp_path):
    items = [{"doc_id": "d", "chunk_index": 0, "category": "study", "concepts": [{"name": 'A "quoted"', "description": "x"}, {"name": "B"}, {"name": "C"}], "relations": [{"src": 'A "quoted"', "dst": "B", "type": "uses"}, {"src": "B", "dst": "C", "type": "uses"}]}]
    kb.store_concepts(spark.createDataFrame([(json.dumps(i),) for i in items], "item string"))
    data = json.load(open(kb.export_graph(str(tmp_path / "g.json"))))
    assert [c["name"] for c in data["concepts"]] == ['A "quoted"', "B", "C"] and list(data["concepts"][0]) == ["id", "name", "category", "description", "mention_count"]
    assert data["edges"] == [{"src": 'A "quoted"', "dst": "B", "type": "uses", "weight": 1.0}, {"src": "B", "dst": "C", "type": "uses", "weight": 1.0}]
    assert open(kb.export_graph(str(tmp_path / "g.mmd"))).read() == "graph LR\n  n1[\"A 'quoted'\"]\n  n2[\"B\"]\n  n3[\"C\"]\n  n1 -- uses --> n2\n  n2 -- uses --> n3"
    assert json.load(open(kb.export_graph(str(tmp_path / "none.json"), category="career"))) == {"concepts": [], "edges": []}
    with pytest.raises(ValueError):
        kb.export_graph(str(tmp_path / "g.svg"))
