from __future__ import annotations

import datetime as dt

from notelake import schema
from notelake.streaming import watch as wa

T = dt.datetime


def events(spark):
    rows = [(1, T(2025, 1, 1, 1), "created", "a.md", None), (2, T(2025, 1, 1, 2), "moved", "a.md", "b.md"), (3, T(2025, 1, 1, 3), "deleted", "c.txt", None), (4, T(2025, 1, 1, 2), "modified", "c.txt", None),
            (5, T(2025, 1, 1, 4), "moved", "x.png", "d.md"), (6, T(2025, 1, 1, 5), "opened", "d.md", None), (7, T(2025, 1, 1, 5), "moved", "d.md", "e.png"), (8, None, "created", None, None)]
    return spark.createDataFrame(rows, schema.FILE_EVENTS)


def test_changes_are_folded(spark):
    last = {r.doc_id: r.change for r in wa.latest_changes(wa.file_changes(events(spark))).collect()}
    assert last == {"a.md": "delete", "b.md": "upsert", "c.txt": "delete", "d.md": "delete"}
    chunks = spark.createDataFrame([("a.md", 0), ("b.md", 0), ("zz", 1)], "doc_id string, chunk_index int")
    assert sorted(r.doc_id for r in wa.deleted_documents(chunks, wa.file_changes(events(spark))).collect()) == ["b.md", "zz"]


def test_doc_ids(spark):
    df = spark.createDataFrame([("/v/x/a.md",), ("/other/a.md",)], "p string")
    assert [r[0] for r in df.select(wa.doc_id_of("p", "/v", "obsidian/")).collect()] == ["obsidian/x/a.md", ""]


def test_stream_of_events_equals_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    for i in (0, 1):
        events(spark).filter(f"event_id % 2 = {i}").coalesce(1).write.mode("append").parquet(str(src))
    seen: dict = {}

    def apply(batch, batch_id):
        for r in batch.collect():
            if r.doc_id not in seen or (r.ts, r.event_id) >= seen[r.doc_id][0]:
                seen[r.doc_id] = ((r.ts, r.event_id), r.change)

    stream = spark.readStream.schema(schema.FILE_EVENTS).option("maxFilesPerTrigger", 1).parquet(str(src))
    wa.watch(stream, apply, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {k: v[1] for k, v in seen.items()} == {"a.md": "delete", "b.md": "upsert", "c.txt": "delete", "d.md": "delete"}


def test_windows_on_a_stream_equal_the_table(spark, tmp_path):
    rows = [(T(2025, 1, 1, h, m), f"k{h % 2}", float(m)) for h in range(5) for m in (1, 30, 59)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, value double")
    df.write.parquet(str(tmp_path / "log"))
    batch = {tuple(r) for r in wa.tumbling(df, keys=("k",)).collect()}
    stream = wa.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "log")), keys=("k",))
    stream.writeStream.outputMode("complete").format("memory").queryName("tumbling_test").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("tumbling_test").collect()} == batch and len(batch) == 5


def test_sessions_and_chat(spark):
    df = spark.createDataFrame([(1, T(2025, 1, 1, 0, 0)), (1, T(2025, 1, 1, 0, 20)), (1, T(2025, 1, 1, 2, 0)), (2, T(2025, 1, 1, 0, 0))], "user_id int, ts timestamp")
    assert sorted((r.user_id, r.events) for r in wa.sessions(df).collect()) == [(1, 1), (1, 2), (2, 1)]
    from pyspark.sql import functions as F

    chat = spark.createDataFrame([("s", 2, "user", "b"), ("s", 1, "user", "a"), ("s", 3, "bot", ""), ("s", 4, "bot", "c"), ("t", 1, "user", None)], "s string, n int, role string, text string")
    got = wa.chat_history(chat, "s", ["n"], F.col("role"), F.col("text"), last=2).collect()
    assert [(r.session, r.turns, r.transcript) for r in got] == [("s", 2, "user: b\nbot: c")]
