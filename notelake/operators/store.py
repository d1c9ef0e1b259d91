"""The chunk store as data frames: visibility, listings, delta merges and lifecycle changes.

Every change is a data frame to a new data frame; :mod:`notelake.sources.snapshots` writes the result as
a new version and switches to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.functions.text import content_hash, tag_list
from notelake.runtime import broadcast_if_small, cut_lineage

KEY = ["doc_id", "chunk_index"]
# What counts as metadata, in the order it is reported.
METADATA = ("tags", "title", "expires_at", "date_modified", "category", "section_path", "language", "source_path")
#: Batches that touch at most so many documents filter the old rows by a broadcast.
MOST_DOCS = 1_000_000
#: Repeated keys up to this number are sent to the tasks.
MOST_KEYS = 1_000_000


def _now(now: str | None) -> Column:
    return F.to_timestamp(F.lit(now)) if now else F.current_timestamp()


def _last(chunks: DataFrame) -> DataFrame:
    order = [F.col(c).desc_nulls_last() for c in ("date_modified", "archived_at", "expires_at", "archive_reason")]
    order.append(F.array_join("tags", ",").desc_nulls_last())
    ranked = chunks.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)))
    return ranked.filter("_r = 1").drop("_r")


def current(chunks: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """One row per key: the last modified one; further ties fall by lifecycle fields and tags, so the choice is total.

    Keys alone are counted first. Rows whose key occurs once stay where they are; only those of repeated keys
    are ranked, and shuffled with their contents. Beyond ``most`` repeated keys all rows are.
    """
    a, b = (f"_{k}" for k in KEY)
    repeated = chunks.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(KEY[0]).alias(a), F.col(KEY[1]).alias(b))
    kept = cut_lineage(repeated.limit(most + 1))
    n = kept.count()
    if not n:
        return chunks
    if n > most:
        return _last(chunks)
    same = F.col(KEY[0]).eqNullSafe(F.col(a)) & F.col(KEY[1]).eqNullSafe(F.col(b))
    return chunks.join(F.broadcast(kept), same, "left_anti").unionByName(_last(chunks.join(F.broadcast(kept), same, "left_semi")))


def is_visible(now: str | None = None) -> Column:
    """Not archived and not expired; expiry at a date is midnight UTC, so the row is gone from the start of that day."""
    return F.col("archived_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > _now(now)))


def visible(chunks: DataFrame, now: str | None = None, include_archived: bool = False) -> DataFrame:
    return chunks if include_archived else chunks.filter(is_visible(now))


def scoped(chunks: DataFrame, category: str | None = None, doc_id: str | None = None) -> DataFrame:
    """Rows of a document or category; one of the two must be given. Archived rows are included."""
    if not category and not doc_id:
        raise ValueError("a scope needs a category or a doc_id")
    if category:
        chunks = chunks.filter(F.col("category") == category)
    return chunks.filter(F.col("doc_id") == doc_id) if doc_id else chunks


# ----------------------------------------------------------------------------- listings
def list_documents(chunks: DataFrame, category: str | None = None, include_archived: bool = False, limit: int = 10_000) -> DataFrame:
    """``doc_id, chunks, title, category, source_path, date_modified, language`` by number of chunks, then doc_id.

    The metadata is that of the document's first chunk. Expired chunks count, archived ones do not unless asked for.
    """
    rows = chunks if include_archived else chunks.filter("archived_at is null")
    if category:
        rows = rows.filter(F.col("category") == category)
    meta = F.struct("title", "category", "source_path", "date_modified", "language")
    grouped = rows.groupBy("doc_id").agg(F.count("chunk_index").alias("chunks"), F.min_by(meta, "chunk_index").alias("m"))
    return grouped.select("doc_id", "chunks", "m.*").orderBy(F.desc("chunks"), "doc_id").limit(limit)


def get_document(chunks: DataFrame, doc_id: str, include_content: bool = True, limit: int = 500) -> DataFrame:
    """The chunks of a document in order, whatever their lifecycle."""
    columns = ["doc_id", "chunk_index", "section_path", "title", *(["content"] if include_content else [])]
    return chunks.filter(F.col("doc_id") == doc_id).select(*columns).orderBy("chunk_index").limit(limit)


def page_chunks(chunks: DataFrame, category: str | None = None, doc_id: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of a scope in key order, each row with total, offset, returned and next_offset (null on the last page).

    ``limit`` is clamped to 1..50. The total is counted in the same job.
    """
    limit, rows = max(1, min(50, limit)), scoped(chunks, category, doc_id)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.select("doc_id", "chunk_index", "section_path", "title", "content").orderBy(*KEY).offset(offset).limit(limit)
    told = page.crossJoin(F.broadcast(total))  # one row
    returned = F.least(F.lit(limit).cast("bigint"), F.greatest(F.col("total") - offset, F.lit(0)))
    following = F.lit(offset) + returned
    return told.withColumns({"offset": F.lit(offset).cast("bigint"), "returned": returned, "next_offset": F.when(following < F.col("total"), following)})


def doctor_categories(chunks: DataFrame, top: int = 20) -> DataFrame:
    """``category, chunks`` of the largest categories."""
    return chunks.filter("category is not null").groupBy("category").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "category").limit(top)


def doctor_lifecycle(chunks: DataFrame, now: str | None = None) -> DataFrame:
    """``total, archived, expired, missing_hash`` in one row."""
    expired = F.col("archived_at").isNull() & (F.col("expires_at") <= _now(now))
    return chunks.agg(F.count("*").alias("total"), F.count_if(F.col("archived_at").isNotNull()).alias("archived"), F.count_if(expired).alias("expired"), F.count_if(F.col("content_hash").isNull()).alias("missing_hash"))


# ----------------------------------------------------------------------------- delta
def changed_metadata(old: str = "o", new: str = "n") -> Column:
    """Names of the metadata fields that differ, in fixed order; tags compare as sorted lists, null as empty."""
    def differs(f: str) -> Column:
        a, b = F.col(f"{old}.{f}"), F.col(f"{new}.{f}")
        return ~(tag_list(a).eqNullSafe(tag_list(b)) if f == "tags" else a.eqNullSafe(b))

    return F.array_compact(F.array(*[F.when(differs(f), F.lit(f)) for f in METADATA]))


def delta(old: DataFrame, new: DataFrame, keep_emptied: bool = False) -> DataFrame:
    """``doc_id, chunk_index, status, changed, o, n`` of every slot of the documents in ``new``.

    Both sides have one row per key. ``status`` is added, embedded (content hash differs, or the old one is
    null), metadata, reused or deleted. A document of which ``new`` knows only a row with null content is
    an emptied file: its old chunks are deleted, or kept if ``keep_emptied``.
    """
    ids = new.select("doc_id").distinct()
    touched = old.join(broadcast_if_small(ids, MOST_DOCS), "doc_id", "left_semi")
    filled = new.filter("content is not null")
    if keep_emptied:
        touched = touched.join(filled.select("doc_id").distinct(), "doc_id", "left_semi")
    o = touched.select(*KEY, F.struct(*touched.columns).alias("o"))
    n = filled.select(*KEY, F.struct(*filled.columns, content_hash("content").alias("fresh_hash")).alias("n"))
    joined = o.join(n, KEY, "full_outer")
    changed = F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), changed_metadata())
    status = (
        F.when(F.col("n").isNull(), "deleted").when(F.col("o").isNull(), "added")
        .when(~F.coalesce(F.col("o.content_hash") == F.col("n.fresh_hash"), F.lit(False)), "embedded")
        .when(F.size("changed") > 0, "metadata").otherwise("reused")
    )
    return joined.withColumn("changed", changed).withColumn("status", status).select(*KEY, "status", "changed", "o", "n")


def delta_stats(changes: DataFrame, files: int | Column | None = None) -> DataFrame:
    """``reused, embedded, added, metadata_updated, deleted`` in one row."""
    names = {"reused": "reused", "embedded": "embedded", "added": "added", "metadata": "metadata_updated", "deleted": "deleted"}
    return changes.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in names.items()])


def format_delta_stats(stats: DataFrame, files: DataFrame) -> DataFrame:
    """``line``: the counters as one line of text; ``files`` has one row with the number of files."""
    both = stats.crossJoin(F.broadcast(files.select(F.col(files.columns[0]).alias("files"))))
    parts = [F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in ("files", "reused", "embedded", "added", "metadata_updated", "deleted")]
    return both.select(F.concat_ws(" ", *parts).alias("line"))


def merge(old: DataFrame, changes: DataFrame, new_ids: DataFrame, reset_lifecycle: bool = False, embed=None) -> DataFrame:
    """The chunks after the delta: untouched documents, reused and updated slots, and new or changed content.

    New content has no embedding unless ``embed`` (a Column to Column function) makes one; it runs on these
    rows only. Lifecycle fields of a changed slot are carried over, or cleared with ``reset_lifecycle``.
    """
    untouched = old.join(broadcast_if_small(new_ids.select("doc_id").distinct(), MOST_DOCS), "doc_id", "left_anti")
    kept = changes.filter("status = 'reused'").select("o.*")
    metadata = changes.filter("status = 'metadata'").select(*[F.col(f"n.{c}" if c in METADATA else f"o.{c}").alias(c) for c in old.columns])
    content = changes.filter("status in ('added', 'embedded')")
    lifecycle = ("archived_at", "archive_reason")
    embedding = embed(F.col("n.content")) if embed else F.lit(None).cast("array<float>")
    fresh = {"content_hash": F.col("n.fresh_hash"), "embedding": embedding} | {c: F.lit(None).cast(old.schema[c].dataType) if reset_lifecycle else F.col(f"o.{c}") for c in lifecycle}
    written = content.select(*[fresh.get(c, F.col(f"n.{c}")).alias(c) for c in old.columns])
    return untouched.unionByName(kept).unionByName(metadata).unionByName(written)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key, lifecycle fields included; of several new rows the last modified one stays."""
    latest = current(new)
    return old.join(latest.select(*KEY), KEY, "left_anti").unionByName(latest)


# ----------------------------------------------------------------------------- lifecycle
def delete_document(chunks: DataFrame, doc_id: str) -> DataFrame:
    return chunks.filter(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))


def archive_document(chunks: DataFrame, doc_ids: list[str] | Column, now: str | None = None, reason: str | None = None) -> DataFrame:
    """Stamps every chunk of the documents, again if already archived; an old reason stays if none is given."""
    hit = F.col("doc_id").isin(doc_ids) if isinstance(doc_ids, list) else doc_ids
    out = chunks.withColumn("archived_at", F.when(hit, _now(now)).otherwise(F.col("archived_at")))
    return out.withColumn("archive_reason", F.when(hit, F.lit(reason)).otherwise(F.col("archive_reason"))) if reason else out


def restore_document(chunks: DataFrame, doc_ids: list[str] | Column) -> DataFrame:
    """Clears both archive fields where the chunk is archived; a stray reason of a live chunk stays."""
    hit = (F.col("doc_id").isin(doc_ids) if isinstance(doc_ids, list) else doc_ids) & F.col("archived_at").isNotNull()
    cleared = {c: F.when(F.coalesce(hit, F.lit(False)), F.lit(None)).otherwise(F.col(c)) for c in ("archived_at", "archive_reason")}
    return chunks.withColumns(cleared)


def purge_archived(chunks: DataFrame, before: str | None = None) -> DataFrame:
    """Drops archived chunks, or those archived before a time; expired ones that are not archived stay."""
    gone = F.col("archived_at").isNotNull()
    if before:
        gone = gone & (F.col("archived_at") < F.to_timestamp(F.lit(before)))
    return chunks.filter(~gone)
