"""Queries over the streaming operators; batch twins of what the streams compute, and the streams themselves."""

from __future__ import annotations

import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.plans.registry import query
from notelake.runtime import cut_lineage, local_folder, table
from notelake.sources.snapshots import SnapshotTable
from notelake.streaming import watch as wa

_NAMES = {"signup": "created", "view": "modified", "error": "deleted", "click": "moved"}


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_file_events(table(spark, sf_dir, "events"))


def as_file_events(events: DataFrame) -> DataFrame:
    """The event table, or a stream of it, read as file events: a user is a document, some of them of unsupported kinds."""
    event = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])[F.col("event_type")]
    ext = F.when(F.col("user_id") % 10 == 9, ".png").otherwise(".md")
    path = F.concat(F.lit("data/study/note-"), F.col("user_id").cast("string"), ext)
    moved = F.concat(F.lit("data/study/moved-"), (F.col("event_id") % 50).cast("string"), F.lit(".md"))
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), event.alias("event"), path.alias("path"), moved.alias("dest_path"))


_CHANGES = """ev AS (SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'modified' WHEN 'error' THEN 'deleted' WHEN 'click' THEN 'moved' END AS event,
  'data/study/note-' || user_id || CASE WHEN user_id % 10 = 9 THEN '.png' ELSE '.md' END AS path, 'data/study/moved-' || (event_id % 50) || '.md' AS dest FROM events),
c AS (SELECT path AS doc_id, ts, event_id, 0 AS part, CASE WHEN event IN ('deleted', 'moved') THEN 'delete' ELSE 'upsert' END AS change FROM ev WHERE event IS NOT NULL
  UNION ALL SELECT dest, ts, event_id, 1, 'upsert' FROM ev WHERE event = 'moved'),
k AS (SELECT * FROM c WHERE doc_id LIKE '%.md'),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC, part DESC) AS r, count(*) OVER (PARTITION BY doc_id) AS changes FROM k)"""


@query(f"WITH {_CHANGES} SELECT doc_id, event_id, change, changes FROM l WHERE r = 1")
def watch_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wa.latest_changes(wa.file_changes(file_events(spark, sf_dir))).select("doc_id", "event_id", "change", "changes")


@query(f"WITH {_CHANGES} SELECT doc_id, event_id, part, change FROM k")
def watch_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wa.file_changes(file_events(spark, sf_dir)).select("doc_id", "event_id", "part", "change")


@query("""WITH e AS (SELECT doc_id, CASE WHEN substr(md5(doc_id), 1, 1) < '8' THEN 'deleted' ELSE 'modified' END AS event FROM (SELECT DISTINCT doc_id FROM chunks))
SELECT DISTINCT doc_id, chunk_index FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM e WHERE event = 'deleted')""")
def watch_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks").select("doc_id", "chunk_index").distinct()
    event = F.when(F.substring(F.md5("doc_id"), 1, 1) < "8", "deleted").otherwise("modified")
    told = rows.select("doc_id").distinct().select(F.xxhash64("doc_id").alias("event_id"), F.to_timestamp(F.lit("2025-01-01")).alias("ts"), event.alias("event"), F.col("doc_id").alias("path"), F.lit(None).cast("string").alias("dest_path"))
    return wa.deleted_documents(rows, wa.file_changes(told))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS searches, round(sum(value), 4) AS total, max(value) AS slowest FROM events GROUP BY ALL""")
def stream_log_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the event file, run to its end in complete mode: equal to the batch result."""
    return _streamed(spark, sf_dir).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the event file as a stream leaves them: each micro-batch writes the windows it changed into a snapshot table."""
    root, held = _shared(spark, "tumbling")
    states = SnapshotTable(spark, f"{root}/windows", "window_start timestamp, event_type string, searches bigint, total double, slowest double", "window_start")

    def apply(batch: DataFrame, batch_id: int) -> None:
        fresh = cut_lineage(batch)
        states.change(states.buckets_of(fresh), lambda old: old.join(fresh, ["window_start", "event_type"], "left_anti").unionByName(fresh))
        states.drop_old()

    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    windows = wa.tumbling(source.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), keys=("event_type",))
    windows.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _result(states.read(), root, held)


def _result(out: DataFrame, root: str, held: bool) -> DataFrame:
    """``out``, cut off from ``root`` where that is a temporary folder of a local session, which is removed."""
    if held:
        return out
    kept = cut_lineage(out)
    shutil.rmtree(root, ignore_errors=True)
    return kept


def _shared(spark: SparkSession, name: str) -> tuple[str, bool]:
    """A folder for a stream's state below the one the cluster names; a local session without one gets a temporary folder, and False."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (f"{root.rstrip('/')}/{name}_{uuid.uuid4().hex}", True) if root else (local_folder(spark, f"{name}-"), False)


@query("""WITH d AS (SELECT DISTINCT ts, query, category, fusion, reranked, latency_ms['total_ms'] AS ms FROM search_log)
SELECT strftime(date_trunc('day', ts AT TIME ZONE 'UTC'), '%Y-%m-%d') AS day, fusion, count(*) AS searches, round(sum(ms), 4) AS total, max(ms) AS slowest FROM d GROUP BY ALL""")
def search_log_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "search_log").select("ts", "query", "category", "fusion", "reranked", F.col("latency_ms")["total_ms"].alias("value")).distinct()
    out = wa.tumbling(log, width="1 day", keys=("fusion",))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "fusion", "searches", "total", "slowest")


@query("""WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM x)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM s GROUP BY user_id, n""")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wa.sessions(table(spark, sf_dir, "events"))
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


@query(f"WITH {_CHANGES} SELECT doc_id, event_id, change FROM l WHERE r = 1")
def stream_watch_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event file as a stream of file events, moves included, folded per micro-batch into a snapshot table of document states."""
    root, held = _shared(spark, "watch")
    states = SnapshotTable(spark, f"{root}/states", "doc_id string, ts timestamp, event_id bigint, change string, changes bigint", "doc_id")

    def apply(batch: DataFrame, batch_id: int) -> None:
        fresh = cut_lineage(batch)

        def fold(old: DataFrame) -> DataFrame:
            later = fresh.join(old.select("doc_id", F.struct("ts", "event_id").alias("was")), "doc_id", "left").filter("was is null or struct(ts, event_id) >= was").drop("was")
            return old.join(later.select("doc_id"), "doc_id", "left_anti").unionByName(later)

        states.change(states.buckets_of(fresh), fold)
        states.drop_old()

    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    wa.watch(as_file_events(source), apply, f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _result(states.read(), root, held).select("doc_id", "event_id", "change")


@query("""WITH m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, ts, event_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'user' ELSE 'assistant' END AS role, event_type || ' ' || props AS text FROM events)
SELECT user_id AS session, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY ts, event_id) AS transcript FROM m WHERE back <= 20 GROUP BY user_id""")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("event_type").isin("click", "view"), "user").otherwise("assistant")
    out = wa.chat_history(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], role, F.concat_ws(" ", "event_type", "props"), last=20)
    return out.withColumn("turns", F.col("turns").cast("bigint"))
