"""Text of PDF files: the strings that content streams show, read with the fonts' tables to Unicode where there are any.

Covers flate-compressed and plain streams, object streams, literal and hexadecimal strings and the usual
text operators. Encrypted files, scanned pages and fonts without a table to Unicode in more than one byte
give no text.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
FONT = re.compile(rb"/([A-Za-z0-9_.+-]+)\s+(\d+)\s+0\s+R")
HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")
TOKEN = re.compile(rb"""\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s\[\]()<>/%]+|[-+.\d]+|[A-Za-z'"*]+""", re.DOTALL)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _stream(body: bytes) -> bytes:
    found = STREAM.search(body)
    if not found:
        return b""
    if b"/FlateDecode" not in body[: found.start()]:
        return found.group(1)
    try:
        return zlib.decompressobj().decompress(found.group(1))
    except zlib.error:
        return b""


def _objects(content: bytes) -> dict[int, bytes]:
    objects = {int(n): body for n, body in OBJECT.findall(content)}
    for body in list(objects.values()):
        if b"/ObjStm" in body:  # objects inside a compressed stream: pairs of number and offset, then the objects
            first, data = re.search(rb"/First\s+(\d+)", body), _stream(body)
            if first and data:
                head = [int(x) for x in data[: int(first.group(1))].split() if x.isdigit()]
                places = sorted(zip(head[1::2], head[::2], strict=False))
                for (at, n), nxt in zip(places, [*places[1:], (len(data), 0)], strict=True):
                    objects.setdefault(n, data[int(first.group(1)) + at : int(first.group(1)) + nxt[0]])
    return objects


def _table(cmap: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and the text of each."""
    width, out = 1, {}

    def text(raw: bytes) -> str:
        return bytes.fromhex(re.sub(rb"\s", b"", raw).decode()).decode("utf-16-be", "ignore")

    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        codes = HEX.findall(block)
        for code, shown in zip(codes[::2], codes[1::2], strict=False):
            width = max(width, len(code) // 2)
            out[int(code, 16)] = text(shown)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for low, high, rest in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f\s]+>|\[.*?\])", block, re.DOTALL):
            width, shown = max(width, len(low) // 2), [text(x) for x in HEX.findall(rest)]
            for k in range(min(int(high, 16) - int(low, 16) + 1, 65_536)):
                if rest[:1] == b"[":
                    out[int(low, 16) + k] = shown[k] if k < len(shown) else ""
                elif shown and shown[0]:
                    out[int(low, 16) + k] = shown[0][:-1] + chr(ord(shown[0][-1]) + k)
    return width, out


def _shown(raw: bytes, table: tuple[int, dict[int, str]] | None) -> str:
    if raw[:1] == b"(":
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.DOTALL)
    else:
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    if table and table[1]:
        width, texts = table
        return "".join(texts.get(int.from_bytes(data[i : i + width], "big"), "") for i in range(0, len(data), width))
    return data.decode("utf-16-be", "ignore")[1:] if data[:2] == b"\xfe\xff" else data.decode("cp1252", "ignore")


def pdf_to_text(content: bytes) -> str | None:
    """The text of the pages in file order, a line per line move; None if the bytes are no PDF or show no text."""
    if not content.lstrip()[:5] == b"%PDF-" or b"/Encrypt" in content[-2048:]:
        return None
    objects = _objects(content)
    fonts: dict[bytes, tuple[int, dict[int, str]]] = {}
    for body in objects.values():
        for name, n in FONT.findall(body.split(b"stream")[0]):
            to = re.search(rb"/ToUnicode\s+(\d+)\s+0\s+R", objects.get(int(n), b""))
            if to and name not in fonts:
                fonts[name] = _table(_stream(objects.get(int(to.group(1)), b"")))
    pages = []
    for _, body in sorted(objects.items()):
        data = _stream(body) if b"stream" in body and b"/ObjStm" not in body and b"/XRef" not in body else b""
        if not re.search(rb"\bBT\b.*\bET\b", data, re.DOTALL):
            continue
        out, held, table = [], [], None
        for token in TOKEN.findall(data):
            first = token[:1]
            if first in b"(<[]/" or first in b"-+." or first.isdigit():
                held.append(token)
                continue
            strings = [t for t in held if t[:1] in (b"(", b"<")]
            if token == b"Tf":
                table = next((fonts.get(t[1:]) for t in reversed(held) if t[:1] == b"/"), None)
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                out.append("\n" * (token in (b"'", b'"')))
                for t in held:
                    if t in strings:
                        out.append(_shown(t, table))
                    elif token == b"TJ" and re.fullmatch(rb"-\d{3,}(?:\.\d+)?", t):
                        out.append(" ")  # a wide gap between two strings
            elif token in (b"T*", b"Td", b"TD", b"Tm", b"ET"):
                out.append("\n")
            held = []
        text = re.sub(r"[ \t]*\n\s*", "\n", "".join(out)).strip()
        if text:
            pages.append(text)
    return "\n\n".join(pages) or None
