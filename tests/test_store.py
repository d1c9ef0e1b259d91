from __future__ import annotations

import datetime as dt

import pytest

from notelake import schema
from notelake.operators import store as st
from notelake.sources.snapshots import SnapshotTable

T = dt.datetime
COLUMNS = [f.split()[0] for f in schema.CHUNKS.replace("\n", " ").split(", ")]


def chunk(doc, index, content="x", **more):
    row = dict.fromkeys(COLUMNS) | {"doc_id": doc, "chunk_index": index, "content": content, "category": "study", "title": "t", "source_path": doc, "section_path": ""} | more
    return tuple(row[c] for c in COLUMNS)


def frame(spark, rows):
    return spark.createDataFrame(rows, schema.CHUNKS)


def keys(df):
    return sorted((r.doc_id, r.chunk_index) for r in df.collect())


def test_lifecycle(spark):
    df = frame(spark, [chunk("a", 0), chunk("b", 0, expires_at=T(2025, 1, 2)), chunk("c", 0, expires_at=T(2025, 1, 1)), chunk("d", 0, archived_at=T(2024, 1, 1)), chunk("e", 0, archived_at=T(2024, 1, 1), expires_at=T(2030, 1, 1))])
    assert keys(st.visible(df, "2025-01-01 00:00:00")) == [("a", 0), ("b", 0)]
    assert len(keys(st.visible(df, "2025-01-01", include_archived=True))) == 5
    assert [r.doc_id for r in st.list_documents(df).collect()] == ["a", "b", "c"]  # expired ones stay
    assert st.doctor_lifecycle(df, "2025-01-01").first().asDict() == {"total": 5, "archived": 2, "expired": 1, "missing_hash": 5}


def test_current_row_is_chosen_totally(spark):
    df = frame(spark, [chunk("a", 0, date_modified=dt.date(2024, 1, 1), tags=["x"]), chunk("a", 0, date_modified=dt.date(2024, 1, 2), tags=["y"]), chunk("a", 0, tags=["z"]), chunk(None, None)])
    rows = {r.doc_id: r for r in st.current(df).collect()}
    assert rows["a"].tags == ["y"] and None in rows


def test_scope_and_pages(spark):
    df = frame(spark, [chunk("a", i) for i in range(7)])
    with pytest.raises(ValueError):
        st.page_chunks(df)
    rows = st.page_chunks(df, doc_id="a", offset=4, limit=2).collect()
    assert [r.chunk_index for r in rows] == [4, 5] and rows[0].next_offset == 6 and rows[0].total == 7
    last = st.page_chunks(df, doc_id="a", offset=6, limit=200).collect()
    assert [r.next_offset for r in last] == [None] and last[0].returned == 1


def test_delta(spark):
    from pyspark.sql import functions as F

    old = frame(spark, [chunk("a", 0, "same", tags=["q", "p"]), chunk("a", 1, "old text"), chunk("a", 2, "gone"), chunk("a", 3, "tagged", tags=["t"], archived_at=T(2024, 1, 1)), chunk("z", 0, "other"), chunk("e", 0, "stale")])
    old = old.withColumn("content_hash", F.when(F.col("content") != "no hash", F.sha2("content", 256)))
    new = frame(spark, [chunk("a", 0, "same", tags=["p", "q"]), chunk("a", 1, "new text"), chunk("a", 3, "tagged", tags=["u"]), chunk("a", 4, "more"), chunk("e", 0, None)])
    changes = st.delta(old, new)
    assert {(r.doc_id, r.chunk_index): r.status for r in changes.collect()} == {("a", 0): "reused", ("a", 1): "embedded", ("a", 2): "deleted", ("a", 3): "metadata", ("a", 4): "added", ("e", 0): "deleted"}
    assert [r.changed for r in changes.filter("status = 'metadata'").collect()] == [["tags"]]
    assert st.delta_stats(changes).first().asDict() == {"reused": 1, "embedded": 1, "added": 1, "metadata_updated": 1, "deleted": 2}
    assert st.format_delta_stats(st.delta_stats(changes), spark.range(1).selectExpr("2L as files")).first().line == "files=2 reused=1 embedded=1 added=1 metadata_updated=1 deleted=2"
    merged = st.merge(old, changes, new)
    assert keys(merged) == [("a", 0), ("a", 1), ("a", 3), ("a", 4), ("z", 0)]
    kept = {r.chunk_index: r for r in merged.filter("doc_id = 'a'").collect()}
    assert kept[3].tags == ["u"] and kept[3].archived_at is not None and kept[1].content == "new text"
    assert keys(st.merge(old, st.delta(old, new, keep_emptied=True), new.filter("content is not null")))[-2:] == [("e", 0), ("z", 0)]


def test_delta_of_missing_hash_embeds_again(spark):
    one = frame(spark, [chunk("a", 0, "x")])
    assert st.delta(one, one).first().status == "embedded"


def test_archive_restore_purge(spark):
    df = frame(spark, [chunk("a", 0, archive_reason="old"), chunk("b", 0, archived_at=T(2023, 1, 1)), chunk("c", 0, archived_at=T(2024, 6, 1), archive_reason="r")])
    done = {r.doc_id: r for r in st.archive_document(df, ["a"], "2024-07-01").collect()}
    assert done["a"].archived_at == T(2024, 7, 1) and done["a"].archive_reason == "old"
    back = {r.doc_id: r for r in st.restore_document(df, ["a", "c"]).collect()}
    assert back["c"].archived_at is None and back["c"].archive_reason is None and back["a"].archive_reason == "old"
    assert keys(st.purge_archived(df)) == [("a", 0)]
    assert keys(st.purge_archived(df, "2024-01-01")) == [("a", 0), ("c", 0)]
    assert keys(st.delete_document(df, "a")) == [("b", 0), ("c", 0)]
    assert keys(st.upsert(df, frame(spark, [chunk("a", 0, title="n"), chunk("x", 1)]))) == [("a", 0), ("b", 0), ("c", 0), ("x", 1)]


def test_empty_store(spark):
    none = frame(spark, [])
    assert st.list_documents(none).count() == 0 and st.doctor_lifecycle(none).first().total == 0
    assert st.delta(none, none).count() == 0 and st.merge(none, st.delta(none, none), none).count() == 0


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "chunks"), "k int, v string")
    assert t.version() == 0 and t.read().count() == 0
    t.write(spark.createDataFrame([(1, "a")], "k int, v string"))
    t.write(t.read().unionByName(spark.createDataFrame([(2, "b")], "k int, v string")))  # reads what it replaces
    assert t.version() == 2 and sorted(r.k for r in t.read().collect()) == [1, 2] and t.read(1).count() == 1
    t.drop_old(1)
    assert t.versions() == [2] and not (tmp_path / "chunks" / "data" / "1").exists()
    t.drop()
    assert t.version() == 0


def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, str(tmp_path / "t"), "k int, v string", "k", 4)
    t.write(spark.createDataFrame([(i, "a") for i in range(20)], "k int, v string"))
    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            t.write(spark.createDataFrame([(1, "b")], "k int, v string"))
    fresh = SnapshotTable(spark, str(tmp_path / "t"), "k int, v string", "k", 4)
    assert fresh.version() == 1 and fresh.read().count() == 20
    fresh.write(fresh.read().filter("k < 5"))
    assert fresh.version() == 2 and fresh.read().count() == 5
    with pytest.raises(RuntimeError, match="another writer"):
        fresh._publish(2, {})


def test_a_change_touches_only_its_buckets(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), "k int, v string", "k", 8)
    t.write(spark.createDataFrame([(i, "a") for i in range(100)], "k int, v string"))
    own = t.buckets_of(spark.createDataFrame([(7,)], "k int"))
    t.change(own, lambda old: old.filter("k <> 7"))
    assert len(own) == 1 and t.read().count() == 99 and t.read(1).count() == 100
    assert [d.name for d in (tmp_path / "t" / "data" / "2").iterdir() if d.is_dir()] == [f"_b={own[0]}"]
    t.change(own, lambda old: old.limit(0))
    assert t.read(buckets=own).count() == 0 and 0 < t.read().count() < 99
    with pytest.raises(ValueError, match="other buckets"):
        t.change(own, lambda old: spark.createDataFrame([(i, "x") for i in range(100)], "k int, v string"))
    t.drop_old(1)
    assert t.read().count() == t.read(t.version()).count() and t.versions() == [3]
