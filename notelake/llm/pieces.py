"""Cutting long markdown into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelake.runtime import cut_lineage

LIMIT, OVERLAP = 1200, 150
SENTENCE_END = re.compile(r"[.!?。！？](?=[ \t\r\n])|\n")
HEADING = re.compile(r"(#{1,6})[ \t]+\S")
FENCE = re.compile(r"[ \t]*(```|~~~)")
BULLET = re.compile(r"([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]+\S")


def cut_points(text: str) -> list[int]:
    """Offsets right after a line feed, and right after a sentence end that a blank follows."""
    return [m.end() for m in SENTENCE_END.finditer(text)]


# ----------------------------------------------------------------------------- structure tree
# A node is (start, end, children); children cover the node without gaps. Leaves are sentences or lines.


def _lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    out, at = [], start
    while at < end:
        nl = text.find("\n", at, end)
        nxt = end if nl < 0 else nl + 1
        out.append((at, nxt))
        at = nxt
    return out


def _leaves(text: str, start: int, end: int) -> list[tuple]:
    """Sentences of one line or paragraph line."""
    cuts = [m.end() for m in SENTENCE_END.finditer(text, start, end)]
    if end < len(text) and not cuts and end - start <= 1:
        return [(start, end, [])]
    edges = sorted({start, end, *(c for c in cuts if start < c < end)})
    return [(a, b, []) for a, b in zip(edges, edges[1:], strict=False)]


def _block(text: str, lines: list[tuple[int, int]]) -> tuple:
    """A paragraph, list, table or fenced block: lines become children; the items of a list become nodes that hold their own lines and the lists inside them."""
    start, end = lines[0][0], lines[-1][1]
    if len(lines) == 1:
        leaves = _leaves(text, start, end)
        return (start, end, leaves if len(leaves) > 1 else [])
    bullets = [BULLET.match(text, a, b) for a, b in lines]
    if not bullets[0]:
        return (start, end, [_block(text, [line]) for line in lines])
    return (start, end, _items(text, lines, [len(m.group(1).expandtabs(4)) if m else -1 for m in bullets]))


#: Lists inside lists are told apart down to this depth; below, lines are all that is left.
DEEPEST = 50


def _items(text: str, lines: list[tuple[int, int]], indents: list[int], depth: int = 1) -> list[tuple]:
    """The items of a list whose first line is a bullet: an item begins at each bullet that is not deeper than the first one of its list."""
    if depth > DEEPEST:
        return [_block(text, [line]) for line in lines]
    firsts, base = [0], indents[0]
    for i, indent in enumerate(indents):
        if i and 0 <= indent <= base:
            firsts.append(i)
            base = min(base, indent)
    out = []
    for first, stop in zip(firsts, [*firsts[1:], len(lines)], strict=True):
        inner = next((i for i in range(first + 1, stop) if indents[i] >= 0), stop)  # where a deeper list begins
        own = [_block(text, [line]) for line in lines[first:inner]]
        if inner < stop:
            own.append((lines[inner][0], lines[stop - 1][1], _items(text, lines[inner:stop], indents[inner:stop], depth + 1)))
        out.append((lines[first][0], lines[stop - 1][1], own) if len(own) > 1 else own[0])
    return out


def _blocks(text: str, lines: list[tuple[int, int]]) -> list[tuple]:
    """Blank lines end a block unless a fence is open; they stay with the block before them."""
    out, current, fence, closing = [], [], False, False
    for a, b in lines:
        blank = not text[a:b].strip()
        if closing and not blank:
            out.append(_block(text, current))
            current, closing = [], False
        current.append((a, b))
        if FENCE.match(text, a, b):
            fence = not fence
            closing = not fence
        elif blank and not fence:
            closing = True
    if current:
        out.append(_block(text, current))
    return out


def parse(text: str) -> tuple:
    """The document as a tree: sections by heading level, then blocks, lines and sentences."""
    lines, fence, heads = _lines(text, 0, len(text)), False, []
    for i, (a, b) in enumerate(lines):
        if FENCE.match(text, a, b):
            fence = not fence
        elif not fence and (m := HEADING.match(text, a, b)):
            heads.append((i, len(m.group(1))))

    def section(first: int, last: int, own: list[tuple[int, int]]) -> list[tuple]:
        """Children of the line range: the blocks before the first heading, then one node per shallowest heading run."""
        if not own:
            return _blocks(text, lines[first:last])
        children = _blocks(text, lines[first : own[0][0]]) if own[0][0] > first else []
        top = min(level for _, level in own)
        starts = [i for i, level in own if level == top]
        if own[0][0] != starts[0]:
            stop = starts[0]
            children += section(own[0][0], stop, [h for h in own if h[0] < stop])
        for i, nxt in zip(starts, [*starts[1:], last], strict=True):
            inner = [h for h in own if i < h[0] < nxt]
            head = _block(text, [lines[i]])
            body = section(i + 1, nxt, inner) if i + 1 < nxt else []
            children.append((lines[i][0], lines[nxt - 1][1], [head, *body] if body else head[2]))
        return children

    return (0, len(text), section(0, len(lines), heads))


def _pack(node: tuple, limit: int, out: list[tuple[int, int]]) -> None:
    """Spans of at most ``limit`` characters, bottom-up: whole siblings merge while they fit, only oversized nodes are entered.

    A span holds whole children of one node; what is left over of an entered node never joins its neighbours.
    A leaf above the limit stays one span here; the caller decides how to cut it.
    """
    todo = [node]
    while todo:
        start, end, children = todo.pop()
        if end - start <= limit or not children:
            out.append((start, end))
            continue
        inner, run = [], None  # children that are runs of siblings are leaves from here on
        for child in children:
            if run and child[1] - run[0] <= limit:
                run = (run[0], child[1])
                continue
            if run:
                inner.append((*run, []))
                run = None
            if child[1] - child[0] <= limit:
                run = (child[0], child[1])
            else:
                inner.append(child)
        if run:
            inner.append((*run, []))
        todo += reversed(inner)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """``(begin, start, end, forced)`` of each piece: it shows text[begin:end], of which text[begin:start] repeats the piece before.

    Pieces have at most ``limit`` characters with the repeated part; ``text[start:end]`` of all pieces in
    turn give the text back. ``forced`` marks a piece that begins or ends inside a stretch longer than
    the limit without a natural cut point.
    """
    if len(text) <= limit:
        return [(0, 0, len(text), False)]
    spans: list[tuple[int, int]] = []
    _pack(parse(text), limit - overlap, spans)
    edges = cut_points(text)
    parts: list[tuple[int, int, bool]] = []
    for a, b in spans:
        if b - a <= limit:
            parts.append((a, b, False))
            continue
        step = limit - overlap
        while b - a > limit:
            stop = a + step
            blank = max(text.rfind(" ", a + step // 2, stop), text.rfind("\t", a + step // 2, stop))
            stop = blank + 1 if blank > 0 else stop
            parts.append((a, stop, True))
            a = stop
        parts.append((a, b, True))
    out, where = [], 0
    for i, (a, b, forced) in enumerate(parts):
        begin = a
        if i:
            earliest = max(a - overlap, b - limit, parts[i - 1][0])
            while where < len(edges) and edges[where] < earliest:
                where += 1
            if where < len(edges) and edges[where] < a:
                begin = edges[where]
            else:
                blank = text.find(" ", earliest, a)
                begin = blank + 1 if 0 <= blank < a - 1 else earliest
        out.append((begin, a, b, forced))
    return out


def _cut(limit: int, overlap: int):
    kind = pa.list_(pa.struct([("piece", pa.string()), ("repeated", pa.int32()), ("forced", pa.bool_())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, how = [], []
            for text in batch.column("content").to_pylist():
                spans = split_text(text or "", limit, overlap)
                pieces.append([{"piece": text[a:c], "repeated": b - a, "forced": f} for a, b, c, f in spans] if text else [])
                how.append("whole" if len(text or "") <= limit else "forced" if any(f for *_, f in spans) else "natural")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(pieces, kind), pa.array(how, pa.string())], ["doc_id", "chunk_index", "section_path", "pieces", "cut_kind"])

    return cut


def _slim(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk_index").cast("int").alias("chunk_index"), F.col("section_path").cast("string").alias("section_path"), F.col("content").cast("string").alias("content"))


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, longer_than: int = -1) -> DataFrame:
    """``doc_id, chunk_index, section_path, pieces, cut_kind`` with pieces array<struct<piece, repeated, forced>>.

    ``cut_kind`` is whole, natural or forced. Rows of one key count once (the copies agree in content);
    null keys form keys of their own; null or empty content gives no pieces. ``longer_than`` keeps only
    contents of more characters, before they reach Python.
    """
    rows = _slim(chunks)
    if longer_than >= 0:
        rows = rows.filter(F.length("content") > longer_than)
    rows = rows.dropDuplicates(["doc_id", "chunk_index"]).select("doc_id", "chunk_index", "section_path", "content")
    return rows.mapInArrow(_cut(limit, overlap), "doc_id string, chunk_index int, section_path string, pieces array<struct<piece:string,repeated:int,forced:boolean>>, cut_kind string")


def _cut_in_order(limit: int, overlap: int):
    """Cuts rows sorted by (doc_id, chunk_index), each key once, and numbers the pieces from 0 within the part of a document that lies in the partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, 0
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for doc, index, section, text in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "chunk_index", "section_path", "content")), strict=True):
                if (doc, index) == last:
                    continue
                if last is None or doc != last[0]:
                    place = 0
                last = (doc, index)
                for begin, start, end, _ in split_text(text, limit, overlap) if text else []:
                    for column, value in zip(columns, (doc, place, text[begin:end], section, index, start - begin), strict=True):
                        column.append(value)
                    place += 1
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "place", "content", "section_path", "from_chunk", "repeated"])

    return cut


def renumbered_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, chunk_index, content, section_path, from_chunk, repeated``: the pieces, numbered from 0 without gaps in each document.

    A document may hold any share of the rows. Rows are range-partitioned by (doc_id, chunk_index), which is
    the only time texts are shuffled; each partition cuts its rows once and numbers the pieces it holds of a
    document. The result is stored, as what follows reads it twice: of the documents that cross from one
    partition into the next, at most two per partition, the numbers of pieces before each partition are
    summed up and sent to the tasks.
    """
    ranged = _slim(chunks).repartitionByRange("doc_id", "chunk_index").sortWithinPartitions("doc_id", "chunk_index")
    cut = ranged.mapInArrow(_cut_in_order(limit, overlap), "doc_id string, place bigint, content string, section_path string, from_chunk int, repeated int")
    placed = cut_lineage(cut.withColumn("part", F.spark_partition_id()))
    counted = placed.groupBy("doc_id", "part").agg(F.count("*").alias("n"))
    crossing = counted.withColumn("parts", F.count("*").over(Window.partitionBy("doc_id"))).filter("parts > 1")
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = crossing.select(F.col("doc_id").alias("d"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = placed.join(F.broadcast(offsets), placed.doc_id.eqNullSafe(offsets.d) & (placed.part == offsets.p), "left")
    return joined.select("doc_id", (F.col("place") + F.coalesce("offset", F.lit(0))).cast("int").alias("chunk_index"), "content", "section_path", "from_chunk", "repeated")
