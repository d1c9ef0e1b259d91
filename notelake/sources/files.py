"""Files in and out: discovery, text and markup readers, front matter, guarded writes."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import text as tx
from notelake.sources.pdf import pdf_to_text

# Elements whose text is not shown, and elements that end a line.
HIDDEN = frozenset(("script", "style", "head", "template", "noscript"))
BLOCKS = frozenset(("p", "div", "section", "article", "ul", "ol", "table", "blockquote", "pre", "header", "footer", "main", "form"))


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = tx.EXTENSIONS) -> DataFrame:
    """``path, modified_at, length, content`` of every supported file below ``root`` (or of the one file), in no order.

    Hidden folders are included; Spark skips them while listing, so they are named to it as further roots.
    Files whose own name begins with '.' or '_', and files of no bytes at all, are not seen. Contents are read by the tasks, and only if a
    later step uses them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load([root, *_hidden_folders(spark, root)])
    named = files.select("path", F.col("modificationTime").alias("modified_at"), "length", "content")
    return named.filter(tx.extension("path").isin(*extensions))


def _hidden_folders(spark: SparkSession, root: str) -> list[str]:
    """The topmost folders below ``root`` that Spark's listing leaves out, and hidden folders inside of those.

    Only folders are walked, one listing per folder; files are left to Spark's own parallel listing.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], [(path(root), False)] if system.getFileStatus(path(root)).isDirectory() else []
    while todo:
        folder, _ = todo.pop()
        for status in system.listStatus(folder):
            if status.isDirectory():
                below = status.getPath()
                if below.getName()[:1] in (".", "_"):
                    found.append(below.toString())
                todo.append((below, True))
    return sorted(found)


def text_of(content: str = "content") -> Column:
    """UTF-8 text, null where the bytes are not valid (to be reported, never replaced)."""
    return F.when(F.is_valid_utf8(F.col(content).cast("string")), F.col(content).cast("string"))


class _Markdown(HTMLParser):
    """Visible text of a page as markdown: headings, list items, links and table rows keep their form."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = self.pre = 0
        self.link: str | None = None
        self.cells: list[str] | None = None

    def _break(self, lines: int) -> None:
        text = "".join(self.out)
        if text.strip():
            have = len(text) - len(text.rstrip("\n"))
            self.out.append("\n" * max(0, lines - have))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self._break(2)
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self._break(1)
            self.out.append("- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "tr":
            self._break(1)
            self.cells = []
        elif tag in ("td", "th"):
            self.mark = len(self.out)
        elif tag == "a":
            self.link = dict(attrs).get("href")
            self.mark_link = len(self.out)
        elif tag in BLOCKS:
            self._break(2)
            self.pre += tag == "pre"

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in BLOCKS:
            self._break(2)
            self.pre = max(0, self.pre - (tag == "pre"))
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("".join(self.out[self.mark :]).strip())
            del self.out[self.mark :]
        elif tag == "tr" and self.cells is not None:
            self.out.append("| " + " | ".join(self.cells) + " |")
            self.cells = None
        elif tag == "a" and self.link is not None:
            label = "".join(self.out[self.mark_link :])
            del self.out[self.mark_link :]
            self.out.append(f"[{label}]({self.link})" if label.strip() else label)
            self.link = None

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if not self.pre:
            data = re.sub(r"\s+", " ", data)
            if not self.out or self.out[-1].endswith(("\n", " ")):
                data = data.lstrip(" ")
        if data:
            self.out.append(data)


def html_to_markdown(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip() for line in "".join(parser.out).split("\n"))).strip()


def _tags(xml: bytes, paragraph: str, run: str) -> str:
    """Text runs of an office part, one line per paragraph element."""
    lines = []
    for p in ElementTree.fromstring(xml).iter():
        if p.tag.endswith("}" + paragraph):
            lines.append("".join(t.text or "" for t in p.iter() if t.tag.endswith("}" + run)))
    return "\n\n".join(x for x in lines if x.strip())


def office_to_markdown(content: bytes, ext: str) -> str | None:
    """Text of a docx, pptx or xlsx file; null if it cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = sorted(z.namelist(), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
            if ext == "docx":
                return _tags(z.read("word/document.xml"), "p", "t")
            if ext == "pptx":
                return "\n\n".join(f"# {i}\n\n{_tags(z.read(n), 'p', 't')}" for i, n in enumerate((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), 1))
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if si.tag.endswith("}si")]
            out = []
            for n in (n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                for row in (r for r in ElementTree.fromstring(z.read(n)).iter() if r.tag.endswith("}row")):
                    cells = []
                    for c in row:
                        value = next((v.text or "" for v in c.iter() if v.tag.endswith(("}v", "}t"))), "")
                        cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() else value)
                    out.append("| " + " | ".join(cells) + " |")
            return "\n".join(out)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError):
        return None


def text_of_file(name: str, content: bytes, pdf: Callable[[bytes], str | None] = pdf_to_text) -> str | None:
    """The text of one file by its suffix: HTML, office files and PDF as markdown or text, others decoded; None if it cannot be read."""
    ext = name.rsplit(".", 1)[-1].lower()
    if ext in ("docx", "pptx", "xlsx"):
        return office_to_markdown(content, ext)
    if ext == "pdf":
        return pdf(content)
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return html_to_markdown(text) if ext in ("html", "htm") else text


def unread_reason(path: str) -> Column:
    """Why the text of a file is null, by its suffix."""
    ext = tx.extension(path)
    return F.when(ext == "pdf", "no text in the PDF").when(ext.isin("docx", "pptx", "xlsx"), "broken office file").otherwise("bytes are not UTF-8")


def convert(files: DataFrame, pdf: Callable[[bytes], str | None] = pdf_to_text) -> DataFrame:
    """``files`` (path, content, ...) with text: plain files decoded, HTML and office files as markdown, PDF files as text.

    Bytes that are not UTF-8 and broken or unsupported files give null, to be reported (see
    :func:`unread_reason`). ``pdf`` may be another reader of PDF bytes.
    """

    @F.pandas_udf("string")
    def rich(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else text_of_file(p, bytes(c), pdf) for p, c in zip(paths, contents, strict=True)], dtype=object)

    plain = tx.extension("path").isin("md", "markdown", "txt")
    read = files.filter(plain).withColumn("text", text_of())
    return read.unionByName(files.filter(~plain).withColumn("text", rich("path", "content")))


def split_frontmatter(text: str | None) -> tuple[dict, str | None]:
    """``(metadata, body)``; ({}, text) if there is none, it is not closed, not YAML or no mapping."""
    if not text or not text.startswith(("---\n", "---\r\n")):
        return {}, text
    found = re.match(r"---\r?\n(.*?)\r?\n---\r?\n(.*)", text, re.DOTALL)
    if not found:
        return {}, text
    import yaml

    try:
        data = yaml.safe_load(found.group(1))
    except yaml.YAMLError:
        return {}, text
    if data is None:
        data = {}
    return (data, found.group(2)) if isinstance(data, dict) else ({}, text)


def _listed(value: object) -> str | None:
    """Tags as one comma-separated string: a list's elements, or a string as it is."""
    if isinstance(value, list):
        return ",".join(str(v) for v in value)
    return value if isinstance(value, str) else None


def _iso(value: object) -> str | None:
    return value.isoformat() if hasattr(value, "isoformat") else value if isinstance(value, str) else None


def with_frontmatter(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``files`` with title, tags and expires_at from the front matter of markdown files, and body, the text without it."""

    @F.pandas_udf("title string, tags string, expires_at string, body string")
    def parse(paths: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for p, t in zip(paths, texts, strict=True):
            meta, body = split_frontmatter(t) if str(p).lower().endswith((".md", ".markdown")) else ({}, t)
            rows.append((meta["title"] if isinstance(meta.get("title"), str) else None, _listed(meta.get("tags")), _iso(meta.get("expires_at")), body))
        return pd.DataFrame(rows, columns=["title", "tags", "expires_at", "body"], dtype=object)

    return files.withColumn("_f", parse(path, text)).select(*files.columns, "_f.title", "_f.tags", "_f.expires_at", "_f.body")


def guarded_write(root: str, path: str, content: str) -> str:
    """Writes a markdown file below root/data, with its folders; refuses other places and suffixes. Returns the full path."""
    base = os.path.realpath(os.path.join(root, "data"))
    target = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([base, target]) != base or target == base:
        raise ValueError(f"{path} lies outside of data/")
    if not target.endswith(".md"):
        raise ValueError(f"{path} is no .md file")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "w", encoding="utf-8") as file:
        file.write(content)
    return target


def converted_file(root: str, source: str, content: bytes, category: str = tx.DEFAULT_CATEGORY, name: str | None = None) -> str:
    """Converts a document and writes it as markdown below data/<category>, with a comment naming its source."""
    if category not in (*tx.CATEGORIES, tx.DEFAULT_CATEGORY, "obsidian"):
        raise ValueError(f"unknown category {category}")
    text = text_of_file(source, content)
    if text is None:
        raise ValueError(f"{source} cannot be read")
    stem = os.path.splitext(os.path.basename(source))[0]
    return guarded_write(root, f"data/{category}/{name or stem + '.md'}", f"<!-- source: {os.path.basename(source)} -->\n\n{text}\n")
