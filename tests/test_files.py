import io
import os
import zipfile

import pytest

from codexlake.sources import containers, files
from codexlake.streaming.files import extract_to

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), body)
    return out.getvalue()


def epub(opf=None):
    opf = opf or '<package><manifest><item id="a" href="b.xhtml"/><item id="c" href="a%20x.xhtml"/><item id="n" href="nav.xhtml"/></manifest><spine><itemref idref="c"/><itemref idref="a"/></spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfile full-path="OEBPS/p.opf"/></container>')
        z.writestr("OEBPS/p.opf", opf)
        for n, t in (("a x", "first"), ("b", "second"), ("nav", "nav")):
            z.writestr(f"OEBPS/{n}.xhtml", f"<p>{t}</p>")
        z.writestr("OEBPS/i.PNG", "x")
    return out.getvalue()


def docx(body, extra=""):
    return zipped(**{"word__document_DOT_xml": f"{extra}<w:document {W}><w:body>{body}</w:body></w:document>"})


def test_containers():
    got = containers.read_epub(epub())
    assert got == {"text": "first\n\nsecond\n\nnav", "spine_items": 2, "images": 1}
    assert containers.read_epub(epub("<package/>"))["text"] == "first\n\nsecond\n\nnav"
    p, row = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>", "<w:tr><w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc></w:tr>"
    body = p.format("one") + "<w:tbl>" + row.format("a", " b ") + row.format("", "") + "</w:tbl><w:sdt>" + p.format("two") + "</w:sdt>"
    assert containers.read_docx(docx(body)) == "one\na\tb\ntwo"
    with pytest.raises(containers.Unsafe):
        containers.read_docx(docx(body, '<!DOCTYPE x [<!ENTITY a "b">]>'))
    with pytest.raises(containers.Unsafe):
        containers.read_docx(b"PK no zip")
    assert [containers.sniff(x) for x in (b"%PDF-1.4", epub(), docx(""), b"PK", b"text")] == ["pdf", "epub", "docx", None, None]


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    content = {"b.txt": "Chapter 1\nx​y".encode(), "A.md": "“q”".encode("cp1252"), "sub/c.html": b"<p>h</p>", "d.epub": epub(), "e.docx": docx("<w:p><w:r><w:t>w</w:t></w:r></w:p>"), "f.rtf": rb"{\rtf1 r\par}", "g.bin": b"x", "bad.docx": b"zz", "blank.txt": b" \n"}
    for name, raw in content.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "odd").write_bytes(epub())
    got = files.extract(files.scan(spark, [str(tmp_path / "b.txt"), str(tmp_path), str(tmp_path / "*.md"), str(tmp_path / "missing.txt"), str(tmp_path / "odd")])).orderBy("source_ord").collect()
    names = [r["filename"] for r in got]
    assert names == ["b.txt", "A.md", "bad.docx", "blank.txt", "d.epub", "e.docx", "f.rtf", "c.html", "missing.txt", "odd"]
    text = {r["filename"]: r["text"] for r in got}
    assert text["b.txt"] == "Chapter 1\nxy" and text["A.md"] == "“q”" and text["c.html"] == "h" and text["e.docx"] == "w" and text["f.rtf"].strip() == "r" and text["odd"] == text["d.epub"]
    failed = {r["filename"] for r in got if r["error"]}
    assert failed == {"bad.docx", "blank.txt", "missing.txt"}
    epub_row = next(r for r in got if r["filename"] == "d.epub")
    assert (epub_row["pages"], epub_row["pages_label"], epub_row["images_dropped"], epub_row["method"]) == (2, "spine_items", 1, "zipfile")


def test_resolve_expands_home(spark, monkeypatch, tmp_path):
    monkeypatch.setenv("HOME", str(tmp_path))
    (tmp_path / "x.txt").write_text("x")
    asked = ["~/x.txt", "~/*.txt", "~", "~/none.txt", "~/*.pdf"]
    assert files.resolve(spark, asked) == [("file", str(tmp_path / "x.txt")), ("pattern", str(tmp_path / "*.txt")), ("folder", str(tmp_path)), ("missing", str(tmp_path / "none.txt")), ("missing", str(tmp_path / "*.pdf"))]


def test_folders_come_by_lower_cased_path(spark, tmp_path):
    (tmp_path / "Sub" / "deep").mkdir(parents=True)
    for name in ("Z.txt", "a.md", "d.rst", "f.txt", "Sub/c.txt", "Sub/deep/B.txt", "e.bin"):
        (tmp_path / name).write_text(name)
    for got in (files.scan_folder(spark, str(tmp_path)), files.scan(spark, [str(tmp_path)])):
        rows = got.orderBy("source_ord").collect()
        assert [r["source_ord"] for r in rows] == list(range(6)) and [r["filename"] for r in rows] == ["a.md", "d.rst", "f.txt", "c.txt", "B.txt", "Z.txt"]
    deep = files.scan(spark, [str(tmp_path / "**" / "*.txt")]).orderBy("source_ord").collect()
    assert [r["filename"] for r in deep] == ["f.txt", "c.txt", "B.txt", "Z.txt"]


def test_each_file_is_parsed_once_and_falls_back(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def counted(content, decoded):
        import uuid

        (log / uuid.uuid4().hex).write_text(decoded)
        return f"read {decoded}"

    def failing(content, decoded):
        raise RuntimeError("no")

    src = tmp_path / "in"
    src.mkdir()
    for k in range(6):
        (src / f"{k}.html").write_text(f"<p>{k}</p>")
    (src / "t.txt").write_text("plain")
    readers = files.READERS | {"html": (files.Reader("absent", failing, "no_such_module"), files.Reader("failing", failing), files.Reader("blank", lambda b, t: " "), files.Reader("counted", counted))}
    got = files.extract(files.scan_folder(spark, str(src)), files.Options(readers=readers)).collect()
    assert len(got) == 7 and len(list(log.iterdir())) == 6
    assert {r["method"] for r in got} == {"counted", "plain-text"} and all(r["error"] is None for r in got)
    only = files.extract(files.scan_folder(spark, str(src)), files.Options(readers={"html": readers["html"][:3]})).where("format = 'html'").first()
    assert only["text"] is None and only["method"] is None and [x.split(":")[0] for x in only["error"].split("; ")] == ["absent", "failing", "blank"]


def test_a_batch_fails_only_if_all_files_do(spark, tmp_path):
    (tmp_path / "good.txt").write_text("Chapter 1\nwords")
    (tmp_path / "bad.docx").write_bytes(b"zz")
    good, bad = files.extract_batch(files.scan(spark, [str(tmp_path)]))
    assert [r["filename"] for r in good.collect()] == ["good.txt"] and [r["source_ord"] for r in bad.collect()] == [0]
    whole = files.records(files.scan(spark, [str(tmp_path)])).orderBy("source_ord").collect()
    assert [(r["chapters_detected"], r["chapters_method"]) for r in whole] == [(0, "none"), (1, "numeric")]
    with pytest.raises(ValueError, match="all 2 sources failed"):
        files.extract_batch(files.scan(spark, [str(tmp_path / "bad.docx"), str(tmp_path / "gone.pdf")]))


def test_technical_mode_tries_the_layout_reader_first():
    assert [r.method for r in files.Options(mode="technical").of("pdf")] == ["docling", "pdftotext", "pypdf", "pdfminer"]
    assert [r.method for r in files.Options().of("pdf")] == ["pdftotext", "pypdf", "pdfminer"]
    assert [r.method for r in files.Options(main_text=True).of("html")] == ["trafilatura", "bs4", "html-parser"]


def test_pages_of_a_pdf(monkeypatch):
    """A stand-in for the reader: a page that fails is empty, and pictures in front reject the file."""
    import sys
    import types

    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            if self.text == "fail":
                raise RuntimeError("no")
            return self.text

    given = []
    module = types.ModuleType("pypdf")
    module.PdfReader = lambda f: types.SimpleNamespace(pages=given)
    monkeypatch.setitem(sys.modules, "pypdf", module)
    monkeypatch.setattr(files, "here", lambda t: t == "pypdf")
    given[:] = [Page("one"), Page("fail"), Page("three")]
    got = files.read_one("pdf", b"%PDF", None, files.Options())
    assert (got["text"], got["method"], got["pages"], got["pages_label"]) == ("one\f\fthree", "pypdf", 3, "pages")
    given[:] = [Page("")] * 5 + [Page("late")]
    assert files.read_one("pdf", b"%PDF", None, files.Options())["error"] == "the first pages hold pictures only"
    monkeypatch.setattr(files, "here", lambda t: False)
    assert files.read_one("pdf", b"%PDF", None, files.Options())["error"].startswith("pdftotext: pdftotext is not there")


def test_capabilities(spark):
    assert {r["format"] for r in files.capabilities(spark).collect()} == set(files.NEEDS)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello there")
    query = extract_to(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["hello there"]
    assert os.path.isdir(tmp_path / "cp")
