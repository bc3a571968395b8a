"""Opening a PDF: what is wrong with it, or its metadata, table of contents and font spans.

``read_pdf`` uses PyMuPDF where it is installed and else ``read_plain_pdf``, a small reader for files whose objects stand in the open
(or in Flate streams) and whose fonts map codes to Latin-1 characters. Either can be replaced by any function of the same kind.
"""

from __future__ import annotations

import re
import zlib

#: What can be wrong with a file.
NOT_FOUND, NOT_A_FILE, CORRUPTED, INVALID, ENCRYPTED, EMPTY = "not_found", "not_a_file", "corrupted", "invalid", "encrypted", "empty"


class BadPdf(ValueError):
    def __init__(self, kind: str, why: str):
        super().__init__(why)
        self.kind = kind


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\nendstream", re.S)
_REFERENCE = rb"\s*(\d+)\s+\d+\s+R"
_STRING = re.compile(rb"\(((?:[^()\\]|\\.)*)\)|<([0-9A-Fa-f\s]*)>", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_SHOWN = re.compile(rb"/[^\s/]+\s+(-?[\d.]+)\s+Tf|(\[(?:[^\]\\(]|\\.|\((?:[^()\\]|\\.)*\))*\])\s*TJ|(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|\bET\b", re.S)
_INFO = ("title", "author", "subject", "keywords", "producer", "creator", "creationDate", "modDate")


def _text(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def _string(found: re.Match) -> bytes:
    if found[1] is None:
        digits = re.sub(rb"\s", b"", found[2])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), found[1], flags=re.S)


def _field(body: bytes, name: str) -> str | None:
    at = re.search(rb"/" + name.encode() + rb"\s*(?=[(<][^<])", body)
    found = _STRING.match(body, at.end()) if at else None
    return _text(_string(found)) if found else None


def _references(body: bytes, name: str) -> list[int]:
    one = re.search(rb"/" + name.encode() + rb"\b\s*(?:\[([^\]]*)\]|" + _REFERENCE + rb")", body)
    if not one:
        return []
    return [int(one[2])] if one[2] else [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", one[1])]


def read_plain_pdf(content: bytes) -> dict:
    """page_count, metadata (dict of str), toc (lists of level, title, page) and spans (page, block, span, size, text, kind); else BadPdf."""
    if not content.startswith(b"%PDF-"):
        raise BadPdf(CORRUPTED, "no PDF header")
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
    if not objects or b"%%EOF" not in content[-1024:]:
        raise BadPdf(CORRUPTED, "the file is cut off")
    if re.search(rb"/Encrypt\b", content):
        raise BadPdf(ENCRYPTED, "a password is needed")
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    if root is None:
        raise BadPdf(INVALID, "no catalog")
    pages, todo, seen = [], _references(root, "Pages"), set()
    while todo:
        k = todo.pop(0)
        if k in seen or k not in objects:
            continue
        seen.add(k)
        if re.search(rb"/Type\s*/Page\b", objects[k]):
            pages.append(k)
        else:
            todo = _references(objects[k], "Kids") + todo
    if not pages:
        raise BadPdf(EMPTY, "no pages")
    try:
        spans = [s for n, k in enumerate(pages, 1) for s in _spans(n, objects, objects[k])]
    except zlib.error as e:
        raise BadPdf(CORRUPTED, f"a stream can't be read: {e}") from e
    info = objects.get(next(iter(_references(content[content.rfind(b"trailer") :], "Info")), -1), b"")
    metadata = {n: _field(info, n[0].upper() + n[1:]) for n in _INFO}
    toc = _outline(objects, pages, _references(objects.get(next(iter(_references(root, "Outlines")), -1), b""), "First"))
    return {"page_count": len(pages), "metadata": metadata, "toc": toc, "spans": spans}


def _spans(page: int, objects: dict[int, bytes], body: bytes) -> list[tuple]:
    out, block, span, size = [], 0, 0, 0.0
    for k in _references(body, "Contents"):
        parts = _STREAM.match(objects.get(k, b""))
        if not parts:
            continue
        data = zlib.decompress(parts[2]) if b"/FlateDecode" in parts[1] else parts[2]
        for m in _SHOWN.finditer(data):
            if m[1]:
                size = float(m[1])
            elif m[2] or m[3]:
                text = _text(b"".join(_string(x) for x in _STRING.finditer(m[2] or m[3])))
                out.append((page, block, span, size, text, 0))
                span += 1
            else:  # a text object is a block
                block, span = block + (span > 0), 0
        if span:
            block, span = block + 1, 0
    out += [(page, block + n, 0, 0.0, "", 1) for n in range(len(re.findall(rb"/Subtype\s*/Image\b", body)))]
    return out


def _outline(objects: dict[int, bytes], pages: list[int], first: list[int]) -> list[list[str]]:
    out, todo, seen = [], [(k, 1) for k in first], set()
    while todo:
        k, level = todo.pop(0)
        if k in seen or k not in objects:
            continue
        seen.add(k)
        own = objects[k]
        at = re.search(rb"/Dest\s*\[" + _REFERENCE, own)
        page = [str(pages.index(int(at[1])) + 1)] if at and int(at[1]) in pages else []
        out.append([str(level), _field(own, "Title") or "", *page])
        todo = [(x, level + 1) for x in _references(own, "First")] + [(x, level) for x in _references(own, "Next")] + todo
    return out


def read_with_pymupdf(content: bytes) -> dict:
    """The same by PyMuPDF."""
    import fitz

    try:
        doc = fitz.open(stream=content, filetype="pdf")
    except fitz.FileDataError as e:
        raise BadPdf(CORRUPTED, str(e)) from e
    except Exception as e:
        raise BadPdf(INVALID, str(e)) from e
    with doc:
        if doc.needs_pass:
            raise BadPdf(ENCRYPTED, "a password is needed")
        if not doc.page_count:
            raise BadPdf(EMPTY, "no pages")
        spans = []
        for n, page in enumerate(doc, 1):
            for k, b in enumerate(page.get_text("dict")["blocks"]):
                if b["type"] == 1:
                    spans.append((n, k, 0, 0.0, "", 1))
                for i, s in enumerate(s for line in b.get("lines", ()) for s in line["spans"]):
                    spans.append((n, k, i, float(s["size"]), s["text"], 0))
        return {"page_count": doc.page_count, "metadata": dict(doc.metadata or {}), "toc": [[str(x) for x in e] for e in doc.get_toc()], "spans": spans}


def read_pdf(content: bytes) -> dict:
    try:
        import fitz  # noqa: F401
    except ImportError:
        return read_plain_pdf(content)
    return read_with_pymupdf(content)
