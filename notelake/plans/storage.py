"""Queries over the chunk store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.operators import store as st
from notelake.plans.registry import CUR, NOW, VISIBLE, query
from notelake.runtime import table

HOT = "obsidian/inbox/clippings.md"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.current(table(spark, sf_dir, "chunks"))


@query(f"WITH {CUR} SELECT doc_id, chunk_index FROM cur WHERE {VISIBLE}")
def lifecycle_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.visible(chunks(spark, sf_dir), NOW).select("doc_id", "chunk_index")


@query(f"""WITH {CUR}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS r FROM cur WHERE archived_at IS NULL)
SELECT doc_id, count(chunk_index) AS chunks, max(CASE WHEN r = 1 THEN title END) AS title, max(CASE WHEN r = 1 THEN category END) AS category,
max(CASE WHEN r = 1 THEN source_path END) AS source_path, strftime(max(CASE WHEN r = 1 THEN date_modified END), '%Y-%m-%d') AS date_modified,
max(CASE WHEN r = 1 THEN language END) AS language FROM k GROUP BY doc_id ORDER BY chunks DESC, doc_id LIMIT 10000""")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.list_documents(chunks(spark, sf_dir)).withColumn("date_modified", F.date_format("date_modified", "yyyy-MM-dd"))


@query(f"WITH {CUR} SELECT doc_id, chunk_index, section_path, title, content FROM cur WHERE doc_id = '{HOT}' ORDER BY chunk_index LIMIT 500")
def get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.get_document(chunks(spark, sf_dir), HOT)


@query(f"""WITH {CUR}, s AS (SELECT * FROM cur WHERE category = 'study'), n AS (SELECT count(*) AS total FROM s)
SELECT doc_id, chunk_index, section_path, title, content, total, CAST(40 AS BIGINT) AS "offset", CAST(least(20, greatest(total - 40, 0)) AS BIGINT) AS returned,
CASE WHEN 40 + least(20, greatest(total - 40, 0)) < total THEN CAST(40 + least(20, greatest(total - 40, 0)) AS BIGINT) END AS next_offset
FROM s, n ORDER BY doc_id, chunk_index LIMIT 20 OFFSET 40""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.page_chunks(chunks(spark, sf_dir), category="study", offset=40, limit=20)


@query(f"WITH {CUR} SELECT category, count(*) AS chunks FROM cur WHERE category IS NOT NULL GROUP BY category ORDER BY chunks DESC, category LIMIT 20")
def doctor_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.doctor_categories(chunks(spark, sf_dir))


@query(f"""WITH {CUR} SELECT count(*) AS total, count(archived_at) AS archived,
count(*) FILTER (archived_at IS NULL AND expires_at <= TIMESTAMPTZ '{NOW}+00') AS expired, count(*) FILTER (content_hash IS NULL) AS missing_hash FROM cur""")
def doctor_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.doctor_lifecycle(chunks(spark, sf_dir), NOW)


# ------------------------------------------------------------------ an edited copy of the store
def _digit(place: int) -> Column:
    return F.conv(F.substring(F.md5("doc_id"), place, 1), 16, 10).cast("int")


def before_and_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the store: documents come and go, chunks are dropped, edited and tagged, by digits of a hash."""
    rows = chunks(spark, sf_dir).withColumn("h1", _digit(1)).withColumn("h2", F.col("chunk_index") + _digit(2))
    old = rows.filter("h1 <> 0").drop("h1", "h2")
    new = rows.filter("h1 <> 1 and h2 % 7 <> 0")
    new = new.withColumn("content", F.when(F.col("h2") % 5 == 0, F.concat("content", F.lit(" x"))).otherwise(F.col("content")))
    new = new.withColumn("tags", F.when(F.col("h2") % 3 == 0, F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("new")))).otherwise(F.col("tags")))
    return old, new.drop("h1", "h2", "content_hash")


_HEX = "instr('0123456789abcdef', substr(md5(doc_id), {0}, 1)) - 1"
_EDITED = f"""{CUR}, hashed AS (SELECT *, {_HEX.format(1)} AS h1, chunk_index + {_HEX.format(2)} AS h2 FROM cur),
old AS (SELECT * FROM hashed WHERE h1 <> 0),
new AS (SELECT * EXCLUDE (content, tags), CASE WHEN h2 % 5 = 0 THEN content || ' x' ELSE content END AS content,
  CASE WHEN h2 % 3 = 0 THEN list_append(coalesce(tags, []), 'new') ELSE tags END AS tags FROM hashed WHERE h1 <> 1 AND h2 % 7 <> 0),
o AS (SELECT * FROM old WHERE doc_id IN (SELECT doc_id FROM new)),
j AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.chunk_index, n.chunk_index) AS chunk_index, o.doc_id IS NOT NULL AS was, n.doc_id IS NOT NULL AS is_,
  o.content_hash = sha256(n.content) AS same, list_sort(coalesce(o.tags, [])) <> list_sort(coalesce(n.tags, [])) AS retagged,
  o.content_hash AS old_hash, sha256(n.content) AS new_hash, o.tags AS old_tags, n.tags AS new_tags, o.archived_at IS NOT NULL AS archived
  FROM o FULL JOIN new n ON o.doc_id = n.doc_id AND o.chunk_index = n.chunk_index),
c AS (SELECT *, CASE WHEN NOT is_ THEN 'deleted' WHEN NOT was THEN 'added' WHEN NOT coalesce(same, false) THEN 'embedded' WHEN retagged THEN 'metadata' ELSE 'reused' END AS status FROM j)"""


@query(f"WITH {_EDITED} SELECT doc_id, chunk_index, status FROM c")
def delta_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.delta(*before_and_after(spark, sf_dir)).select("doc_id", "chunk_index", "status")


@query(f"""WITH {_EDITED} SELECT count(*) FILTER (status = 'reused') AS reused, count(*) FILTER (status = 'embedded') AS embedded,
count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'metadata') AS metadata_updated, count(*) FILTER (status = 'deleted') AS deleted FROM c""")
def delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.delta_stats(st.delta(*before_and_after(spark, sf_dir)))


@query(f"WITH {_EDITED} SELECT doc_id, chunk_index, CASE WHEN retagged THEN 'tags' ELSE '' END AS changed FROM c WHERE was AND is_")
def metadata_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = st.delta(*before_and_after(spark, sf_dir)).filter("changed is not null")
    return changes.select("doc_id", "chunk_index", F.array_join("changed", ",").alias("changed"))


@query(f"""WITH {_EDITED}
SELECT doc_id, chunk_index, CASE WHEN status IN ('added', 'embedded') THEN new_hash ELSE old_hash END AS hash,
array_to_string(list_sort(coalesce(CASE WHEN status = 'reused' THEN old_tags ELSE new_tags END, [])), ',') AS tags, coalesce(archived, false) AS archived FROM c WHERE status <> 'deleted'
UNION ALL SELECT doc_id, chunk_index, content_hash, array_to_string(list_sort(coalesce(tags, [])), ','), archived_at IS NOT NULL FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)""")
def delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = before_and_after(spark, sf_dir)
    merged = st.merge(old, st.delta(old, new), new)
    return merged.select("doc_id", "chunk_index", F.col("content_hash").alias("hash"), F.array_join(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), ",").alias("tags"), F.col("archived_at").isNotNull().alias("archived"))


@query(f"""WITH {CUR}, hashed AS (SELECT *, {_HEX.format(1)} AS h1 FROM cur), base AS (SELECT * FROM hashed WHERE h1 <> 0), fresh AS (SELECT * FROM hashed WHERE h1 % 2 = 0)
SELECT doc_id, chunk_index, title || ' (new)' AS title FROM fresh
UNION ALL SELECT doc_id, chunk_index, title FROM base WHERE (doc_id, chunk_index) NOT IN (SELECT (doc_id, chunk_index) FROM fresh)""")
def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).withColumn("h1", _digit(1))
    fresh = rows.filter("h1 % 2 = 0").withColumn("title", F.concat("title", F.lit(" (new)"))).drop("h1")
    return st.upsert(rows.filter("h1 <> 0").drop("h1"), fresh).select("doc_id", "chunk_index", "title")


@query(f"WITH {CUR} SELECT doc_id, chunk_index FROM cur WHERE doc_id <> '{HOT}'")
def delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.delete_document(chunks(spark, sf_dir), HOT).select("doc_id", "chunk_index")


@query(f"""WITH {CUR} SELECT doc_id, chunk_index, CASE WHEN doc_id = '{HOT}' THEN '{NOW}' ELSE strftime(archived_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS archived_at,
CASE WHEN doc_id = '{HOT}' THEN 'done' ELSE archive_reason END AS archive_reason FROM cur""")
def archive_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.archive_document(chunks(spark, sf_dir), [HOT], NOW, "done")
    return out.select("doc_id", "chunk_index", F.date_format("archived_at", "yyyy-MM-dd HH:mm:ss").alias("archived_at"), "archive_reason")


@query(f"""WITH {CUR} SELECT doc_id, chunk_index, coalesce(category, '') <> 'career' AND archived_at IS NOT NULL AS archived,
CASE WHEN category = 'career' AND archived_at IS NOT NULL THEN NULL ELSE archive_reason END AS archive_reason FROM cur""")
def restore_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.restore_document(chunks(spark, sf_dir), F.col("category") == "career")
    return out.select("doc_id", "chunk_index", F.col("archived_at").isNotNull().alias("archived"), "archive_reason")


@query(f"WITH {CUR} SELECT doc_id, chunk_index FROM cur WHERE archived_at IS NULL OR NOT archived_at < TIMESTAMPTZ '{NOW}+00'")
def purge_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.purge_archived(chunks(spark, sf_dir), NOW).select("doc_id", "chunk_index")


@query(f"WITH {CUR} SELECT doc_id, chunk_index, section_path, title FROM cur WHERE category = 'study'")
def graph_scope_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.scoped(chunks(spark, sf_dir), category="study").select("doc_id", "chunk_index", "section_path", "title")
