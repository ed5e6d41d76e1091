"""Zipped document containers: EPUB and DOCX read with the standard library alone."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

from ..functions.markup import html_text

# Suffixes of pictures in an EPUB, the WordprocessingML namespace.
IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".bmp", ".tif", ".tiff", ".avif")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MANY_IMAGES = 5


class Unsafe(ValueError):
    """A container that must not be parsed."""


def sniff(content: bytes) -> str | None:
    """Format by content alone: pdf, epub, docx, or None."""
    if content[:4] == b"%PDF":
        return "pdf"
    if content[:2] != b"PK":
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            if "mimetype" in names and z.read("mimetype").startswith(b"application/epub"):
                return "epub"
            return "docx" if "word/document.xml" in names else None
    except zipfile.BadZipFile:
        return None


def _attribute(tag: str, name: str) -> str | None:
    m = re.search(rf"""\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", tag)
    return (m.group(1) if m.group(1) is not None else m.group(2)) if m else None


def _member(z: zipfile.ZipFile, name: str) -> str | None:
    try:
        return z.read(name).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def read_epub(content: bytes) -> dict:
    """``{text, spine_items, images}``: pages in spine order, then the manifest's other pages, else all pages by name."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        package = _package(z, names)
        opf = _member(z, package) if package else None
        order: list[str] = []
        if opf:
            base = posixpath.dirname(package)
            place = lambda href: posixpath.normpath(posixpath.join(base, unquote(href)))
            items = [(_attribute(t, "id"), _attribute(t, "href")) for t in re.findall(r"<(?:\w+:)?item\b[^>]*>", opf)]
            manifest = {i: place(h) for i, h in items if i and h}
            spine = [manifest.get(_attribute(t, "idref") or "") for t in re.findall(r"<(?:\w+:)?itemref\b[^>]*>", opf)]
            rest = [h for h in manifest.values() if h.lower().endswith((".html", ".xhtml", ".htm"))]
            order = [h for h in dict.fromkeys([*filter(None, spine), *rest]) if h in names]
        if not order:
            order = sorted(n for n in names if n.lower().endswith((".html", ".xhtml", ".htm")))
        pages = [html_text(p) for p in (_member(z, n) for n in order) if p is not None]
        return {
            "text": "\n\n".join(pages),
            "spine_items": len(re.findall(r"<itemref\b", opf or "")),
            "images": sum(not n.endswith("/") and n.lower().endswith(IMAGES) for n in names),
        }


def _package(z: zipfile.ZipFile, names: list[str]) -> str | None:
    told = _member(z, "META-INF/container.xml")
    m = re.search(r"<(?:\w+:)?rootfile\b[^>]*>", told or "")
    path = _attribute(m.group(), "full-path") if m else None
    return path if path in names else next((n for n in names if n.lower().endswith(".opf")), None)


def check_docx(content: bytes) -> None:
    """Refuses document types and entities in any XML part, however the part is encoded."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if not name.endswith((".xml", ".rels")):
                    continue
                raw = z.read(name)
                for code in ("utf-8", "utf-16", "utf-16le", "utf-16be", "utf-32"):
                    seen = raw.decode(code, "ignore").upper()
                    if "<!DOCTYPE" in seen or "<!ENTITY" in seen:
                        raise Unsafe(f"{name} declares a document type or an entity")
    except zipfile.BadZipFile as e:
        raise Unsafe(f"not a readable container: {e}") from e


def read_docx(content: bytes) -> str:
    """Paragraphs and table rows in document order, a row's cells between tabs; blank rows are left out."""
    check_docx(content)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out: list[str] = []
    found = root.find(f"{_W}body")
    waiting = [found if found is not None else root]
    waiting = list(waiting[0])[::-1]
    while waiting:
        e = waiting.pop()
        if e.tag == f"{_W}p":
            if text := said(e):
                out.append(text)
        elif e.tag == f"{_W}tbl":
            rows = ([said(c).strip() for c in row.iter(f"{_W}tc")] for row in e.iter(f"{_W}tr"))
            out += ["\t".join(cells) for cells in rows if any(cells)]
        else:
            waiting += list(e)[::-1]
    return "\n".join(out)
