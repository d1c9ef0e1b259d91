"""From documents to chunks: heading sections, greedy paragraph packing, derived metadata.

A document is one row, so everything here works inside the row with array expressions: no shuffle is
needed to number lines, sections or chunks, and a very long document never meets another one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions import text as tx

HEADING = r"(?sU)^(#{1,3})\s+(.+)$"


def _paths(headings: Column) -> Column:
    """The path of each heading: the stack of strictly shallower headings above it, and itself."""
    empty = F.array().cast("array<struct<level:int,name:string>>")
    start = F.struct(empty.alias("stack"), F.array().cast("array<string>").alias("paths"))

    def step(state: Column, h: Column) -> Column:
        kept = F.filter(state["stack"], lambda s: s["level"] < h["level"])
        stack = F.concat(kept, F.array(F.struct(h["level"].cast("int").alias("level"), h["name"].alias("name"))))
        path = F.array_join(F.transform(stack, lambda s: s["name"]), tx.ARROW)
        return F.struct(stack.alias("stack"), F.concat(state["paths"], F.array(path)).alias("paths"))

    return F.aggregate(headings, start, step, lambda s: s["paths"])


def section_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``parts`` array<struct<path, text>>: its sections in order; rows with null text are left out."""
    columns = df.columns
    lined = df.withColumn("_lines", F.split(F.col(text), "\n")).filter(F.col(text).isNotNull())
    numbered = F.sequence(F.lit(0), F.size("_lines") - 1)
    starts = F.filter(numbered, lambda i: F.get(F.col("_lines"), i).rlike(HEADING))
    lined = lined.withColumn("_heads", starts)
    named = F.transform("_heads", lambda i: F.struct(
        F.length(F.regexp_extract(F.get(F.col("_lines"), i), HEADING, 1)).alias("level"),
        tx.trimmed(F.regexp_extract(F.get(F.col("_lines"), i), HEADING, 2)).alias("name"),
    ))
    lead = F.coalesce(F.get("_heads", F.lit(0)), F.lit(-1)) != 0  # text before the first heading
    none = F.array().cast("array<int>")
    lined = (
        lined.withColumn("_paths", F.concat(F.when(lead, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), _paths(named)))
        .withColumn("_from", F.concat(F.when(lead, F.array(F.lit(0))).otherwise(none), F.col("_heads")))
        .withColumn("_to", F.concat(F.slice("_from", 2, F.size("_from")), F.array(F.size("_lines"))))
    )
    parts = F.transform(F.arrays_zip("_paths", "_from", "_to"), lambda p: F.struct(
        p["_paths"].alias("path"), F.array_join(F.slice(F.col("_lines"), p["_from"] + 1, p["_to"] - p["_from"]), "\n").alias("text"),
    ))
    return lined.select(*columns, parts.alias("parts"))


def sections(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with one row per section: adds section (number from 0), section_path and section_text.

    Headings of level one to three start a section and stay in its text; what precedes the first heading
    has the path ''. Deeper headings and headings in code fences are not told apart from text, as in the
    data model this follows. Null text gives no row; '' gives one section with empty text.
    """
    columns = df.columns
    # No text is without a section; a plain posexplode would have all of the above worked out twice more for a filter.
    rows = section_parts(df, text).select(*columns, F.posexplode_outer("parts").alias("section", "_part"))
    return rows.select(*columns, "section", F.col("_part.path").alias("section_path"), F.col("_part.text").alias("section_text"))


def spans_of(counts: np.ndarray, total: int, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int]]:
    """Runs of paragraphs (from a up to b) of the chunks of a section, from the tokens of each paragraph; one pass."""
    if total <= max_tokens:
        return [(0, len(counts))]
    before = np.r_[0, np.cumsum(counts)]
    start, out = 0, []
    for i in range(len(counts)):
        if i > start and before[i + 1] - before[start] > max_tokens:
            out.append((start, i))
            # The tail of at most so many tokens: the first paragraph from which the rest is that short.
            start = max(start, int(np.searchsorted(before[: i + 1], before[i] - overlap_tokens)))
    out.append((start, len(counts)))
    return out


def pack(df: DataFrame, max_tokens: int, overlap_tokens: int, separator: str = "\n\n", vocabulary: str | None = None) -> DataFrame:
    """``df`` (with ``parts``) with one row per chunk instead: chunk_index (from 0 over the sections of a row), path and content.

    Paragraphs are added while the sum of their tokens stays within ``max_tokens``; a new chunk begins with
    the tail of the one before that holds at most ``overlap_tokens``. A paragraph above the limit stays
    whole; blank chunks vanish. Tokens are counted in the JVM, or with ``vocabulary`` in its byte pairs, and
    summed up in one pass; all chunks of a row are made from that row, so nothing is shuffled.
    """
    columns = [c for c in df.columns if c != "parts"]
    counts = F.transform("parts", lambda p: F.transform(F.split(p["text"], separator), tx.token_count))
    totals = F.transform("parts", lambda p: tx.token_count(p["text"]))
    sized = df.select(*columns, "parts", *([] if vocabulary else [counts.alias("_counts"), totals.alias("_totals")]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from notelake.operators.providers import byte_pairs

        size = byte_pairs(vocabulary) if vocabulary else None
        for batch in batches:
            rows, places, paths, contents = [], [], [], []
            known = zip(batch.column("_counts").to_pylist(), batch.column("_totals").to_pylist(), strict=True) if size is None else repeat((None, None), batch.num_rows)
            for row, (parts, (own, all_)) in enumerate(zip(batch.column("parts").to_pylist(), known, strict=True)):
                place = 0
                for k, part in enumerate(parts):
                    paragraphs = part["text"].split(separator)
                    counts, total = (own[k], all_[k]) if size is None else ([size(p) for p in paragraphs], size(part["text"]))
                    for a, b in spans_of(np.array(counts), total, max_tokens, overlap_tokens):
                        content = separator.join(paragraphs[a:b]).strip()
                        if content:
                            rows.append(row), places.append(place), paths.append(part["path"]), contents.append(content)
                            place += 1
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in columns), pa.array(places, pa.int32()), pa.array(paths, pa.string()), pa.array(contents, pa.string())], [*columns, "chunk_index", "path", "content"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "parts"]
    return sized.mapInArrow(cut, ", ".join([*kinds, "chunk_index int, path string, content string"]))


def chunk_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_tokens: int = 500, overlap_tokens: int = 100, separator: str = "\n\n", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, chunk_index, section_path, content`` of each document; chunks are numbered from 0 over its sections.

    Sections without any text give no chunk; documents that are null or blank give no row. A document is
    chunked inside its row: nothing is shuffled.
    """
    parted = section_parts(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text").select("doc_id", "parts")
    return pack(parted, max_tokens, overlap_tokens, separator, vocabulary).select("doc_id", "chunk_index", F.col("path").alias("section_path"), "content")


def process_files(files: DataFrame, max_tokens: int = 500, overlap_tokens: int = 100, vocabulary: str | None = None) -> DataFrame:
    """Chunk records, without embeddings, from ``doc_id, text, title, tags, expires_at, modified_at`` rows.

    ``title``, ``tags`` and ``expires_at`` come from front matter and may be null. The section path falls
    back to the file's place if no chunk of the document has one. All of it happens inside a file's row.
    """
    kept = files.select(
        "doc_id", "text", F.coalesce("title", tx.extract_title("text", "doc_id")).alias("title"), tx.normalize_tags("tags").alias("tags"), tx.parse_expiry("expires_at").alias("expires_at"),
        F.to_date("modified_at").alias("date_modified"),
    )
    parted = section_parts(kept, "text")
    bare = F.forall("parts", lambda p: (p["path"] == "") | (tx.trimmed(p["text"]) == ""))
    placed = parted.select("doc_id", "title", "tags", "expires_at", "date_modified", F.when(bare, tx.derive_section("doc_id")).alias("place"), "parts")
    return pack(placed, max_tokens, overlap_tokens, vocabulary=vocabulary).select(
        "doc_id", "chunk_index", "content", tx.content_hash("content").alias("content_hash"), F.col("doc_id").alias("source_path"), tx.derive_category("doc_id").alias("category"),
        F.coalesce("place", "path").alias("section_path"), "title", "tags", "date_modified", tx.detect_language("content").alias("language"), "expires_at",
    )
