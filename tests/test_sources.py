from __future__ import annotations

import io
import zipfile

import pytest

from notelake.sources import files as fs


def test_front_matter():
    assert fs.split_frontmatter("---\ntitle: A\ntags: [x]\n---\nbody") == ({"title": "A", "tags": ["x"]}, "body")
    assert fs.split_frontmatter("---\r\ntitle: A\r\n---\r\nbody") == ({"title": "A"}, "body")
    for text in ("---\n: : [\n---\nb", "---\n- a\n- b\n---\nb", "---\ntitle: A\nbody", "no", "", None):
        assert fs.split_frontmatter(text) == ({}, text)
    assert fs.split_frontmatter("---\n\n---\nbody") == ({}, "body")


def test_front_matter_of_rows(spark):
    rows = [("a.md", "---\ntitle: T\ntags: [1, b]\nexpires_at: 2026-12-31\nother: {}\n---\nbody"), ("a.txt", "---\ntitle: T\n---\nbody"), ("b.MARKDOWN", "---\ntitle: 5\ntags: x, y\n---\nb"), ("c.md", None)]
    got = {r.path: r for r in fs.with_frontmatter(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert (got["a.md"].title, got["a.md"].tags, got["a.md"].expires_at, got["a.md"].body) == ("T", "1,b", "2026-12-31", "body")
    assert got["a.txt"].title is None and got["a.txt"].body.startswith("---")
    assert got["b.MARKDOWN"].title is None and got["b.MARKDOWN"].tags == "x, y" and got["c.md"].body is None


def test_html():
    page = "<html><head><title>no</title><script>x()</script></head><body><h2>Title</h2><p>One <b>two</b>\n three &amp; four</p><ul><li>a<li>b</ul><table><tr><th>h</th><td>1</td></tr></table><a href='u'>link</a><pre>x\n  y</pre></body></html>"
    assert fs.html_to_markdown(page) == "## Title\n\nOne two three & four\n\n- a\n- b\n\n| h | 1 |\n\n[link](u)\n\nx\n  y"
    assert fs.html_to_markdown("") == "" and fs.html_to_markdown(None) is None and fs.html_to_markdown("<p>open") == "open"


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def test_office_files():
    docx = _zip({"word/document.xml": '<w:d xmlns:w="u"><w:p><w:r><w:t>He</w:t><w:t>llo</w:t></w:r></w:p><w:p/><w:p><w:t>World</w:t></w:p></w:d>'})
    xlsx = _zip({"xl/sharedStrings.xml": '<s xmlns="u"><si><t>name</t></si></s>', "xl/worksheets/sheet1.xml": '<w xmlns="u"><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>'})
    pptx = _zip({f"ppt/slides/slide{i}.xml": f'<p xmlns:a="u"><a:p><a:t>s{i}</a:t></a:p></p>' for i in (1, 2, 10)})
    assert fs.office_to_markdown(docx, "docx") == "Hello\n\nWorld"
    assert fs.office_to_markdown(xlsx, "xlsx") == "| name | 7 |"
    assert fs.office_to_markdown(pptx, "pptx") == "# 1\n\ns1\n\n# 2\n\ns2\n\n# 3\n\ns10"
    assert fs.office_to_markdown(b"junk", "docx") is None


def test_scan_and_convert(spark, tmp_path):
    for name, data in {"a.md": b"# A", "sub/.hidden/b.TXT": b"text", "c.png": b"x", "bad.md": b"\xff\xfe", "d.html": b"<p>hi</p>", "e.pdf": b"%PDF"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = fs.scan_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.md", "b.TXT", "bad.md", "d.html", "e.pdf"]
    text = {r.path.rsplit("/", 1)[1]: r.text for r in fs.convert(found).collect()}
    assert text == {"a.md": "# A", "bad.md": None, "d.html": "hi", "e.pdf": None, "b.TXT": "text"}
    assert fs.scan_files(spark, str(tmp_path / "a.md")).count() == 1


def test_guarded_writes(tmp_path):
    path = fs.guarded_write(str(tmp_path), "data/study/new/x.md", "hi")
    assert open(path).read() == "hi"
    for bad in ("data/../x.md", "/etc/x.md", "other/x.md", "data/x.MD", "data/x.txt", "data"):
        with pytest.raises(ValueError):
            fs.guarded_write(str(tmp_path), bad, "no")
    out = fs.converted_file(str(tmp_path), "in/page.html", b"<h1>P</h1>", "career")
    assert open(out).read() == "<!-- source: page.html -->\n\n# P\n" and out.endswith("data/career/page.md")
    with pytest.raises(ValueError):
        fs.converted_file(str(tmp_path), "a.html", b"x", "unknown")


def test_all_kinds_of_notes_are_found(spark, tmp_path):
    for i, ext in enumerate((*fs.tx.EXTENSIONS, "png", "exe")):
        folder = tmp_path / f"d{i % 3}" / ("_hidden" if i % 2 else "open") / "deep"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"x.{ext}").write_bytes(b"x")
    got = sorted(r.path.rsplit(".", 1)[1] for r in fs.scan_files(spark, str(tmp_path)).collect())
    assert got == sorted(fs.tx.EXTENSIONS)


def _pdf(stream, extra=b"", fonts=b"", packed=True):
    import zlib

    body = zlib.compress(stream) if packed else stream
    head = b"<< /Length %d %s>>" % (len(body), b"/Filter /FlateDecode " if packed else b"")
    return b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Resources << /Font << " + fonts + b" >> >> /Contents 2 0 R >>\nendobj\n2 0 obj\n" + head + b"\nstream\n" + body + b"\nendstream\nendobj\n" + extra + b"trailer << >>\n%%EOF"


def test_pdf():
    from notelake.sources.pdf import pdf_to_text

    plain = b"BT /F1 12 Tf (Hello \\(world\\)) Tj 0 -14 Td [(Wi) -20 (de) -300 (gap)] TJ T* (caf\\351) ' ET"
    for packed in (True, False):
        assert pdf_to_text(_pdf(plain, packed=packed)) == "Hello (world)\nWide gap\ncaf\u00e9"
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <D55C> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange"
    extra = b"5 0 obj\n<< /Type /Font /ToUnicode 6 0 R >>\nendobj\n6 0 obj\n<< >>\nstream\n" + cmap + b"\nendstream\nendobj\n"
    assert pdf_to_text(_pdf(b"BT /F2 9 Tf <000300100012> Tj ET", extra, b"/F2 5 0 R")) == "\ud55cAC"
    assert pdf_to_text(b"junk") is None and pdf_to_text(b"%PDF-1.4 nothing") is None and pdf_to_text(_pdf(b"q 1 0 0 1 0 0 cm Q")) is None
