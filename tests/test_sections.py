"""Sections and chunks against plain models of the rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from notelake.operators import sections as sc

COUNT = re.compile(r"[^\W_]+|[^\w\s]|_")


def model_sections(text):
    out, lines, stack, path = [], [], [], ""
    for line in text.split("\n"):
        m = re.match(r"(#{1,3})\s+(.+)$", line)
        if m:
            if lines:
                out.append((path, "\n".join(lines)))
            lines = []
            stack = [s for s in stack if s[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
            path = " > ".join(n for _, n in stack)
        lines.append(line)
    return [*out, (path, "\n".join(lines))]


def model_pack(text, most, overlap):
    """Chunks as runs of paragraphs: grow while the sum fits, restart from the tail that fits the overlap."""
    size = lambda t: len(COUNT.findall(t))
    if size(text) <= most:
        return [text.strip()] if text.strip() else []
    parts, begin, out = text.split("\n\n"), 0, []
    for i in range(len(parts)):
        if i > begin and sum(map(size, parts[begin : i + 1])) > most:
            out.append(parts[begin:i])
            begin = next(j for j in range(begin, i + 1) if sum(map(size, parts[j:i])) <= overlap)
    out.append(parts[begin:])
    return [c for c in ("\n\n".join(p).strip() for p in out) if c]


def random_text(r):
    words = ["alpha", "beta", "검색", "gamma.", "delta"]
    lines = []
    for _ in range(r.randint(1, 25)):
        kind = r.random()
        lines.append("" if kind < 0.4 else "#" * r.randint(1, 4) + " " + r.choice(words) if kind < 0.55 else " ".join(r.choices(words, k=r.randint(1, 9))))
    return "\n".join(lines)


def test_sections_follow_the_model(spark):
    r = random.Random(5)
    texts = [random_text(r) for _ in range(150)] + ["", "# A", "x\n# A\r\ny\n## B\n#### no\n# C", "#  \n# Z", "```\n# in code\n```"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got: dict = {}
    for row in sc.sections(df).orderBy("i", "section").collect():
        got.setdefault(row.i, []).append((row.section_path, row.section_text))
    assert [got[i] for i in range(len(texts))] == [model_sections(t) for t in texts]


def test_heading_paths(spark):
    df = spark.createDataFrame([("# Root\nx\n## A\n### a1\n## B\n#### deep",)], "text string")
    assert [r.section_path for r in sc.sections(df).orderBy("section").collect()] == ["Root", "Root > A", "Root > A > a1", "Root > B"]


def test_null_text_has_no_section(spark):
    assert sc.sections(spark.createDataFrame([(None,)], "text string")).count() == 0


def test_packing_follows_the_model(spark):
    r = random.Random(9)
    texts = ["\n\n".join(" ".join(["word"] * r.randint(0, 12)) for _ in range(r.randint(1, 12))) for _ in range(200)] + ["", "  ", "a " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    parts = df.selectExpr("i", "array(struct('p' as path, text)) as parts")
    got: dict = {}
    for row in sc.pack(parts, 20, 6).orderBy("i", "chunk_index").collect():
        got.setdefault(row.i, []).append(row.content)
    assert [got.get(i, []) for i in range(len(texts))] == [model_pack(t, 20, 6) for t in texts]
    assert sum(len(x) > 1 for x in got.values()) > 50


def test_chunk_numbers_run_over_sections(spark):
    df = spark.createDataFrame([(7, "# A\none\n## B\ntwo\n\nthree"), (8, "\n \n"), (9, None)], "doc_id int, text string")
    rows = sc.chunk_documents(df, max_tokens=2, overlap_tokens=0).orderBy("doc_id", "chunk_index").collect()
    assert [(x.doc_id, x.chunk_index, x.section_path, x.content) for x in rows] == [
        (7, 0, "A", "# A\none"), (7, 1, "A > B", "## B\ntwo"), (7, 2, "A > B", "three"),
    ]


def test_processing_files(spark):
    rows = [("data/study/rag/deep/x_note.md", "no heading", None, "a, b", "2026-01-01", None), ("data/career/y.md", "# T\nbody", "Given", None, "bad", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, title string, tags string, expires_at string, modified_at timestamp")
    got = {r.doc_id: r for r in sc.process_files(df).collect()}
    assert got["data/study/rag/deep/x_note.md"].section_path == "deep > x note" and got["data/study/rag/deep/x_note.md"].tags == ["a", "b"]
    assert got["data/career/y.md"].title == "Given" and got["data/career/y.md"].section_path == "T" and got["data/career/y.md"].expires_at is None
    assert got["data/career/y.md"].category == "career" and F is not None


def test_sizes_in_tokens_of_a_vocabulary(spark):
    import os

    from notelake.operators.providers import byte_pair_count, byte_pairs

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        return
    text = "\n\n".join(f"Paragraph number {i} of a longish note." for i in range(30))
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    size = byte_pairs(path)
    chunks = [r.content for r in sc.chunk_documents(df, max_tokens=40, overlap_tokens=10, vocabulary=path).orderBy("chunk_index").collect()]
    assert len(chunks) > 5 and all(sum(size(p) for p in c.split("\n\n")) <= 40 for c in chunks)
    assert {r.n for r in df.select(byte_pair_count(path)("text").alias("n")).collect()} == {size(text), 0}
