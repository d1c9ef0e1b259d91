"""Keeping the store current: file events as a stream, and windows over the search log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from notelake.functions import text as tx


def supported(path: Column | str) -> Column:
    return F.coalesce(tx.extension(path).isin(*tx.EXTENSIONS), F.lit(False))


def doc_id_of(path: Column | str, base: str, prefix: str = "") -> Column:
    """The path below ``base`` with a prefix; '' outside of it."""
    p, root = tx.column(path), base.rstrip("/") + "/"
    return F.when(p.startswith(root), F.concat(F.lit(prefix), F.substring(p, len(root) + 1, 1 << 30))).otherwise("")


def file_changes(events: DataFrame) -> DataFrame:
    """``doc_id, ts, event_id, part, change`` with change upsert or delete.

    Takes event_id, ts, event (created, modified, deleted, moved), path, dest_path. A move is a delete of the
    old path (part 0) and an upsert of the new one (part 1), each only if its extension is supported; other
    events and unsupported files vanish.
    """
    one = F.array(F.struct(F.lit(0).alias("part"), F.col("path").alias("doc_id"), F.when(F.col("event") == "deleted", "delete").otherwise("upsert").alias("change")))
    two = F.array(F.struct(F.lit(0).alias("part"), F.col("path").alias("doc_id"), F.lit("delete").alias("change")), F.struct(F.lit(1).alias("part"), F.col("dest_path").alias("doc_id"), F.lit("upsert").alias("change")))
    known = events.filter(F.col("event").isin("created", "modified", "deleted", "moved"))
    rows = known.select("event_id", "ts", F.explode(F.when(F.col("event") == "moved", two).otherwise(one)).alias("c"))
    return rows.select("c.doc_id", "ts", "event_id", "c.part", "c.change").filter(F.col("doc_id").isNotNull() & supported("doc_id"))


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each document, by time, then event and part."""
    order = F.struct("ts", "event_id", "part")
    last = changes.groupBy("doc_id").agg(F.max_by(F.struct("ts", "event_id", "change"), order).alias("l"), F.count("*").alias("changes"))
    return last.select("doc_id", F.col("l.ts").alias("ts"), F.col("l.event_id").alias("event_id"), F.col("l.change").alias("change"), "changes")


def deleted_documents(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """``chunks`` without the documents whose last change is a delete."""
    gone = latest_changes(changes).filter("change = 'delete'").select("doc_id")
    return chunks.join(gone, "doc_id", "left_anti").select(*chunks.columns)


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands the last change per document of each micro-batch to ``apply`` (batch, batch id).

    ``apply`` must be idempotent per batch id, as a batch is repeated after a failure.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        apply(latest_changes(file_changes(batch)), batch_id)

    return events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)


def tumbling(log: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "1 day", keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """``window_start, <keys>, searches, total, slowest`` per window of event time; works on a table and on a stream.

    On a stream rows later than ``late`` are dropped by the watermark; on a table it has no effect.
    """
    timed = log.withColumn("_ts", F.col(ts).cast("timestamp"))
    if log.isStreaming:
        timed = timed.withWatermark("_ts", late)
    grouped = timed.groupBy(F.window("_ts", width).alias("w"), *keys)
    out = grouped.agg(F.count("*").alias("searches"), F.round(F.sum(value), 4).alias("total"), F.max(value).alias("slowest"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "searches", "total", "slowest")


def sessions(log: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``user, session_start, session_end, events`` of activity without a pause of ``gap``; works on a table and on a stream."""
    timed = log.withColumn("_ts", F.col(ts).cast("timestamp"))
    if log.isStreaming:
        timed = timed.withWatermark("_ts", late)
    out = timed.groupBy(user, F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def chat_history(messages: DataFrame, session: str, order: list[str], role: Column, text: Column, last: int | None = None) -> DataFrame:
    """``session, turns, transcript``: the messages of a session in order as 'role: text' lines; blank ones vanish.

    With ``last`` only the most recent ones; without it a transcript is as long as its session.
    """
    rows = messages.select(F.col(session).alias("session"), F.struct(*order, role.alias("role"), text.alias("text")).alias("m")).filter(F.coalesce(F.col("m.text"), F.lit("")) != "")
    if last:
        # The latest ones within shares of a session, then of the session: no list of a whole session comes into being.
        share = F.pmod(F.xxhash64("m"), F.lit(16))
        by = [F.col(f"m.{c}").desc() for c in order] + [F.col("m.role").desc(), F.col("m.text").desc()]
        for keys in (["session", "_s"], ["session"]):
            rows = rows.withColumn("_s", share).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("_r") <= last).drop("_s", "_r")
    lists = rows.groupBy("session").agg(F.array_sort(F.collect_list("m")).alias("all"))
    lines = F.transform("all", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return lists.select("session", F.size("all").alias("turns"), F.array_join(lines, "\n").alias("transcript"))
