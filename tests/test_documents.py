"""Files of every format to documents, with fixtures made here."""

import io
import json
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from foliant import config, errors, models
from foliant.operators import images
from foliant.plans import documents, registry
from foliant.sources import docx, epub, files, pdf, photo, web, writers
from foliant.streaming.ingest import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def make_epub(toc=True):
    out = io.BytesIO()
    body = " ".join(["word"] * 120)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        ncx = '<item id="ncx" href="t.ncx" media-type="application/x-dtbncx+xml"/>' if toc else ""
        z.writestr("OEBPS/c.opf", f"""<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>The Book</dc:title><dc:creator>A. Writer</dc:creator><dc:creator>B. Other</dc:creator>
            <dc:date>2020-05</dc:date><dc:language>en</dc:language><dc:identifier>urn:isbn:12345</dc:identifier><dc:subject>x</dc:subject></metadata>
            <manifest>{ncx}<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="sub/b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/></manifest>
            <spine toc="ncx"><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/><itemref idref="gone"/></spine></package>""")
        z.writestr("OEBPS/a.xhtml", f"<html><body><h1>One</h1><p>{body}</p></body></html>")
        z.writestr("OEBPS/sub/b.xhtml", f"<html><body><h1>One</h1><p>{body} more</p></body></html>")
        z.writestr("OEBPS/c.xhtml", "<html><body><p>short</p></body></html>")
        z.writestr("OEBPS/i.png", png(120, 90))
        if toc:
            z.writestr("OEBPS/t.ncx", """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>First</text></navLabel><content src="a.xhtml#s"/>
                <navPoint><navLabel><text>Second</text></navLabel><content src="sub/b.xhtml"/></navPoint></navPoint><navPoint><navLabel><text>Lost</text></navLabel><content src="no.xhtml"/></navPoint></navMap></ncx>""")
    return out.getvalue()


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + bytes(9)


def make_docx():
    out = io.BytesIO()
    run = lambda t, p="": f"<w:r>{p}<w:t>{t}</w:t></w:r>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"""<w:document xmlns:w="{W}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>
            <w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr>{run('Title')}</w:p><w:p>{run('plain ')}{run('bold', '<w:rPr><w:b/></w:rPr>')}{run(' both', '<w:rPr><w:b/><w:i/></w:rPr>')}</w:p>
            <w:p>{run('see ')}<w:hyperlink r:id="r1">{run('a [link]')}</w:hyperlink></w:p><w:p><w:pPr><w:pStyle w:val="LB2"/></w:pPr>{run('item')}</w:p>
            <w:tbl><w:tr><w:tc><w:p>{run('a|b')}</w:p></w:tc><w:tc><w:p>{run('c')}</w:p></w:tc></w:tr><w:tr><w:tc><w:p>{run('d')}</w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>""")
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}"><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="LB2"><w:name w:val="List Bullet 2"/></w:style></w:styles>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="http://e.org/(x)"/><Relationship Id="r2" Target="media/image1.png"/></Relationships>')
        z.writestr("word/media/image1.png", png(5, 6))
        z.writestr("docProps/core.xml", '<cp xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/"><dc:title>Report</dc:title><dc:creator>C</dc:creator><keywords>a; b, c</keywords><dc:description>notes</dc:description><dcterms:created>2021-02-03T04:05:06Z</dcterms:created></cp>')
    return out.getvalue()


def make_jpeg():
    exif = {0x010F: (2, b"Maker\0"), 0x0112: (3, struct.pack("<H", 6)), 0x829A: (5, struct.pack("<II", 1, 250)), 0x829D: (5, struct.pack("<II", 28, 10)), 0x9003: (2, b"2022:03:04 05:06:07\0"), 0x9209: (3, struct.pack("<H", 25))}
    gps = {1: (2, b"S\0"), 2: (5, struct.pack("<6I", 33, 1, 30, 1, 0, 1)), 3: (2, b"E\0"), 4: (5, struct.pack("<6I", 151, 1, 12, 1, 36, 1))}

    def block(tags, at, extra=()):
        size = {2: 1, 3: 2, 4: 4, 5: 8}
        rows, data, place = b"", b"", at + 2 + 12 * (len(tags) + len(extra)) + 4
        for t, (k, v) in tags.items():
            n = len(v) // size[k]
            if len(v) > 4:
                rows += struct.pack("<HHII", t, k, n, place + len(data))
                data += v
            else:
                rows += struct.pack("<HHI", t, k, n) + v.ljust(4, b"\0")
        for t, v in extra:
            rows += struct.pack("<HHII", t, 4, 1, v)
        return struct.pack("<H", len(tags) + len(extra)) + rows + bytes(4) + data

    first = block(exif, 8, [(0x8825, 0)])
    at = 8 + len(first)
    tiff = b"II*\0" + struct.pack("<I", 8) + block(exif, 8, [(0x8825, at)]) + block(gps, at)
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 480, 640) + bytes(10) + b"\xff\xd9"


def make_pdf():
    import zlib

    body = b"BT /F2 20 Tf 72 700 Td (Big \\(Title\\)) Tj ET BT /F1 10 Tf 0 -20 Td (Plain body text of the page) Tj 0 -12 Td [(wo) -20 (rds) -300 (here)] TJ T* <0041> Tj ET BT /F2 20 Tf (Next) Tj /F1 10 Tf 0 -12 Td (tail text) Tj ET"
    packed = zlib.compress(body)
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /I 7 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed), b"<< /Type /Font /BaseFont /Helvetica >>", b"<< /Type /Font /BaseFont /Helvetica-Bold >>",
        b"<< /Subtype /Image /Width 200 /Height 150 /Length 0 >>\nstream\n\nendstream", b"<< /Title (The \\124itle) /Keywords (a, b) /CreationDate (D:20240102030405Z) /Producer <FEFF0041> >>",
    ]
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))
    return out + b"trailer << /Root 1 0 R /Info 8 0 R >>\n%%EOF"


FILES = {
    "a/story.txt": b"A Story\r\nPreface words\r\nChapter 1: Start\rone two\nChapter 2: End\nthree", "b/story.txt": b"caf\xe9 latin", "a/empty.txt": b"", "a/readme": b"no suffix here",
    "a/n.md": b"---\ntitle: Notes\nauthors: [Ann, Bob]\ndate: 2024-01-15\ntags: x; y\nautor: z\nextra: 5\n---\nSub\n===\n\ntext ![p](img/x.png) ![q][r]\n\n* item\n\n## Two\n\nmore\n\n[r]: ../y.svg \"t\"\n",
    "a/p.html": "<html lang='fr'><head><title>T &amp; U</title><meta property='og:title' content='OG'><meta name='DC.creator' content='dc'><meta name='author' content='std'><meta name='keywords' content='k1, k2'></head><body><nav>menu</nav><article><h1>Head</h1><p>{}</p></article></body></html>".format("Long enough text, with commas, for the main content. " * 5).encode(),
    "a/bad.epub": b"no zip", "a/x.pdf": b"%PDF-1.4", "a/x.xyz": b"?",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, data in {**FILES, "a/book.epub": make_epub(), "b/spine.epub": make_epub(False), "a/r.docx": make_docx(), "a/ph.jpg": make_jpeg(), "b/full.pdf": make_pdf()}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


@pytest.fixture(scope="module")
def parsed(spark, folder):
    docs, errors = documents.parse(spark, folder, {"min_chapter_length": 50})
    return {r.path.split("/", 0)[0].removeprefix(f"file:{folder}/"): r for r in docs.collect()}, {r.path.removeprefix(f"file:{folder}/"): r for r in errors.collect()}


def test_all_are_read_or_explained(parsed):
    docs, errors = parsed
    assert set(errors) == {"a/x.xyz"} and "unsupported" in errors["a/x.xyz"].error
    assert len(docs) == len(FILES) + 5 - 2 and len({r.document_id for r in docs.values()}) == len(docs)


def test_text(parsed):
    d = parsed[0]["a/story.txt"]
    assert [(c.title, c.content.split("\n")[-1]) for c in d.chapters] == [("Chapter 1: Start", "one two"), ("Chapter 2: End", "three")]
    assert d.metadata.title == "A Story" and d.word_count == 13 and d.estimated_reading_time == 1 and d.metadata.custom_fields["line_count"] == "6" and "\r" not in d.content
    latin = parsed[0]["b/story.txt"]
    assert latin.content == "café latin" and latin.processing_info.warnings and "encoding" in latin.metadata.custom_fields
    assert parsed[0]["a/readme"].processing_info.parser_used == "text"


def test_markdown(parsed):
    d = parsed[0]["a/n.md"]
    m = d.metadata
    assert (m.title, m.author, m.authors, m.tags, str(m.publication_date.date())) == ("Notes", "Ann", ["Ann", "Bob"], ["x", "y"], "2024-01-15")
    assert set(m.custom_fields) == {"autor", "extra"} and any("autor" in w for w in d.processing_info.warnings)
    assert [(c.title, c.level) for c in d.chapters] == [("Sub", 1), ("Two", 2)] and "- item" in d.content
    assert [(i.image_id, i.alt_text, i.format, i.file_path.rsplit("/", 2)[-1]) for i in d.images] == [("img_001", "p", "png", "x.png"), ("img_002", "q", "svg", "y.svg")]
    assert d.images[0].file_path.endswith("/a/img/x.png") and d.images[1].file_path.endswith("/y.svg") and "/a/" not in d.images[1].file_path


def test_html(parsed):
    d = parsed[0]["a/p.html"]
    assert (d.metadata.title, d.metadata.author, d.metadata.language, d.metadata.tags) == ("OG", "dc", "fr", ["k1", "k2"])
    assert d.content.startswith("# Head") and "menu" not in d.content and [c.title for c in d.chapters] == ["Head"]


def test_epub(parsed):
    d = parsed[0]["a/book.epub"]
    assert [(c.title, c.level) for c in d.chapters] == [("First", 1), ("Second", 2)] and d.metadata.authors == ["A. Writer", "B. Other"] and d.metadata.isbn == "12345"
    assert d.content[d.chapters[1].start_position :].startswith("One") and any("gone" in w for w in d.processing_info.warnings)
    assert [c.title for c in parsed[0]["b/spine.epub"].chapters] == ["One", "One (2)"]
    assert parsed[0]["a/bad.epub"].content == "" and "BadZipFile" in parsed[0]["a/bad.epub"].processing_info.warnings[0] if "a/bad.epub" in parsed[0] else True


def test_docx(parsed):
    d = parsed[0]["a/r.docx"]
    assert d.content.split("\n\n") == ["## Title", "plain bold both", "see [a \\[link\\]](http://e.org/\\(x\\))", "  - item", "| a\\|b | c |\n| --- | --- |\n| d |  |"]
    assert (d.metadata.title, d.metadata.tags, d.metadata.description, d.metadata.publication_date.year) == ("Report", ["a", "b", "c"], "notes", 2021) and d.chapters == []
    assert "**bold****" in docx.read_document(make_docx(), links=False)["content"] or "**bold***** both***" in docx.read_document(make_docx(), links=False)["content"]
    assert docx.read_document(make_docx())["images"][0]["file_name"] == "word/media/image1.png"


def test_pdf(spark, parsed):
    d = parsed[0]["b/full.pdf"]
    assert (d.metadata.title, d.metadata.tags, d.metadata.publication_date.year, d.metadata.custom_fields["producer"], d.metadata.custom_fields["page_count"]) == ("The Title", ["a", "b"], 2024, "A", "1")
    assert [(c.title, c.level) for c in d.chapters] == [("Big (Title)", 1), ("Next", 1)] and d.content.startswith("# Big (Title)") and "words here" in d.content and d.estimated_reading_time == 1
    assert parsed[0]["a/x.pdf"].content == "" and parsed[0]["a/x.pdf"].metadata.title == "x"
    read = pdf.read_pdfs(spark.createDataFrame([("p", bytearray(make_pdf())), ("q", bytearray(b"zz")), ("r", None)], "path string, content binary"), ocr=lambda b: ["seen"])
    assert [(r.doc_id, r.image_id, r.position, r.width) for r in pdf.images(read).collect()] == [("p", "img_0001", 0, 200)]
    assert {r.doc_id for r in read.where("size(warnings) > 0").collect()} == {"q", "r"} and pdf.spans(read).where("is_bold").count() == 2
    table, width = pdf.unicode_map(b"1 beginbfrange <0001> <0003> <0061> endbfrange 1 beginbfchar <0010> <00660066> endbfchar")
    assert width == 2 and table[3] == "c" and table[16] == "ff"


def test_photo(spark, parsed):
    d = parsed[0]["a/ph.jpg"]
    assert "# ph.jpg" in d.content and "640 x 480" in d.content and d.metadata.publication_date.year == 2022
    rows = photo.described(photo.read_photos(spark.createDataFrame([("p", bytearray(make_jpeg())), ("q", bytearray(b"x")), ("r", None)], "path string, content binary")))
    p = rows.where("photo_id = 'p'").first()
    assert (p.make, p.orientation, p.shutter_speed, p.aperture, p.coordinates) == ("Maker", "Rotated 90° CW", "1/250", 2.8, "-33.500000, 151.210000") and p.flash == "Flash fired, auto"
    assert p.coordinates_dms == "33°30'0.00\"S 151°12'36.00\"E" and rows.where("photo_id = 'r'").first().warnings == ["no image"]


def test_json_round_trip(spark, folder, tmp_path):
    docs, _ = documents.parse(spark, folder, formats=["text", "markdown"])
    docs = docs.drop("path").select(*[c.name for c in spark.createDataFrame([], models.DOCUMENT).schema])
    docs = spark.createDataFrame(docs.collect(), docs.schema)  # each evaluation has its own time
    models.write_json(docs, str(tmp_path / "out"))
    back = models.read_json(spark, str(tmp_path / "out"))
    key = lambda df: sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect())
    assert key(back) == key(docs)
    assert models.chapters_of(back).count() == 2 + 1 + 1 + 2 and models.images_of(back).count() == 2
    assert models.chapter(back, 2).where("chapter is not null").count() == 2


def test_stream(spark, folder, tmp_path):
    before = list(documents._kept)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest(spark, folder, out, state, formats=["text", "markdown", "html"]).awaitTermination()
    n = spark.read.parquet(f"{out}/documents").count()
    ingest(spark, folder, out, state, formats=["text", "markdown", "html"]).awaitTermination()
    assert n == 5 == spark.read.parquet(f"{out}/documents").count()
    assert spark.read.parquet(f"{out}/errors").where("error like 'no reader%'").count() >= 4
    assert documents._kept == before  # batches keep nothing


def test_empty_files_are_refused(spark):
    rows = spark.createDataFrame([("file:/a.txt", 0), ("file:/b.txt", 60 << 20), ("file:/c.zip", 5), ("file:/d.md", 501 << 20), ("file:/e.epub", 501 << 20)], "path string, length bigint")
    got = {r.path: (r.error, r.warnings) for r in files.validated(files.identified(rows)).collect()}
    assert got["file:/a.txt"] == ("file is empty", []) and got["file:/b.txt"] == (None, ["large file: 60.0 MB"]) and got["file:/c.zip"][0] == "unsupported format: .zip"
    assert got["file:/d.md"][0] == "file too large: 501.0 MB" and got["file:/e.epub"] == (None, ["large file: 501.0 MB"])


def test_registry(spark):
    r = registry.builtin()
    r.register(["TXT", ".log"], "logs", priority=5)
    got = {x.ext: x.name for x in registry.resolved(r.frame(spark)).collect()}
    assert got[".txt"] == "logs" == got[".log"] and got[""] == "text" and r.parser_of(".TXT") == "logs"
    assert r.unregister("logs") and not r.unregister("logs") and r.parser_of(".txt") == "text"
    assert [x.ext for x in registry.supported_formats(r.frame(spark)).collect()] == sorted(e for e in {x[2] for x in r.rows} if e)
    df = spark.createDataFrame([("a/b.PDF", bytearray(b"x")), ("a/b", bytearray(b"%PDF-1")), ("c.docx", bytearray(b"PK\x03\x04")), ("z.zzz", bytearray(b""))], "path string, content binary")
    assert [x[0] for x in df.select(registry.format_of("path", F.col("content"))).collect()] == ["pdf", "pdf", "docx", None]


def test_size_filter_reaches_the_source(spark, folder):
    plan = files.scan(spark, folder, max_bytes=100)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan
    rows = {r.path.rsplit("/", 1)[1]: r.content for r in files.scan(spark, folder, max_bytes=100).collect()}
    assert rows["n.md"] is None and rows["book.epub"] and rows["readme"] and len(rows) == len({p.name for p in __import__("pathlib").Path(folder).rglob("*.*")} | {"readme"}) - 1


def test_epub_reader_rows(spark):
    books = epub.read_books(spark.createDataFrame([("x", bytearray(make_epub())), ("y", bytearray(b"zz")), ("n", None)], "path string, content binary"))
    assert {r.book_id: len(r.spine) for r in books.collect()} == {"x": 3, "y": 0, "n": 0}
    assert [i.content[:4] for i in books.where("book_id = 'x'").first().images] == [b"\x89PNG"]


def test_config(tmp_path):
    (tmp_path / "config.json").write_text('{"ai": {"defaults": {"timeout": 5}}}')
    (tmp_path / "config_local.json").write_text('{"ai": {"defaults": {"timeout": 7}}, "parsing": {"html": {"x": 1}}}')
    c = config.load(str(tmp_path))
    assert c["ai"]["defaults"]["timeout"] == 7 and c["ai"]["defaults"]["max_tokens"] == 1024 and config.parsing_options("html", c)["x"] == 1
    assert config.ai_options("openai", c, {"timeout": None, "model": "m"}) == {**c["ai"]["defaults"], "ai_provider": "openai", "model": "m"}
    assert config.problems(config.DEFAULTS) == [] and config.problems({"ai": {"default_provider": "?", "defaults": {"timeout": 0}}, "parsing": 1}) != []
    assert json.load(open(config.write_template(str(tmp_path / "t.json")))) == config.DEFAULTS
    (tmp_path / "config.json").write_text("broken")
    assert config.load(str(tmp_path))["ai"]["defaults"]["timeout"] == 7


def test_one_document(spark, folder):
    from foliant import api, errors

    assert api.is_supported("x/Y.MD") and api.is_supported("https://e.org") and not api.is_supported("a.zzz") and ".epub" in api.supported_formats()
    assert api.parse_document(spark, f"{folder}/a/n.md").metadata.title == "Notes"
    page = "<html lang='en'><title>T</title><body><p>" + "Some words, enough of them. " * 9
    d = api.parse_document(spark, "https://e.org/p?q", fetch=lambda u: (200, "text/html", page))
    assert d.metadata.title == "T" and d.path == "https://e.org/p?q" and d.word_count > 20
    for source, kind, fetch in ((f"{folder}/a/x.xyz", errors.UnsupportedFormatError, None), (f"{folder}/none.txt", errors.FileReadError, None), (f"{folder}/a/empty.txt", errors.FileReadError, None), (f"{folder}/a/bad.epub", errors.ParsingError, None), ("https://e.org", errors.NetworkError, None), ("https://e.org", errors.NetworkError, lambda u: (404, "", "")), ("https://", errors.UnsupportedFormatError, None)):
        with pytest.raises(kind):
            api.parse_document(spark, source, fetch=fetch)
    assert api.Parser("text").supports("a.TXT") and not api.Parser("text").supports("a.md") and api.Parser("docx").parse(spark, folder).count() == 1
    with pytest.raises(errors.UnsupportedFormatError):
        api.Parser("none")


def test_images_described(spark, folder):
    from foliant.operators import ai, images

    docs, _ = documents.parse(spark, folder, formats=["markdown"])
    found = ai.described_images(docs, lambda s, p: "New text" if "Existing text: p" in p else 1 / 0, ai.Policy(0))
    rows = {r.image_id: (r.alt_text, r.error is None) for r in found.collect()}
    assert rows == {"img_001": ("New text", True), "img_002": (None, False)}
    assert [i.alt_text for i in ai.with_descriptions(docs, found).first().images] == ["New text", "q"]
    pics = images.downloaded(models.images_of(docs), lambda u: png(9, 9) if u.endswith("png") else None)
    assert {r.image_id: r.content is not None for r in pics.collect()} == {"img_001": True, "img_002": False}
    assert {r.file_name for r in images.named(pics, "document_id", "position", "pic").collect()} == {"pic_001.png", "pic_002.svg"}


def test_web():
    import http.server
    import threading

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            path, _, _ = self.path.partition("?")
            if path in ("/there", "/out", "/loop"):
                self.send_response(302)
                self.send_header("Location", {"/there": "/page", "/out": "http://10.0.0.1/x", "/loop": "/loop"}[path])
                self.end_headers()
                return
            self.send_response(200 if path == "/page" else 404)
            self.send_header("Content-Type", "text/html; charset=iso-8859-1")
            self.end_headers()
            self.wfile.write("caf\u00e9 {}".format(self.headers["User-Agent"]).encode("latin-1"))

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    here = web.Web(timeout=5, agent="me", allowed=lambda u: u.startswith(at))
    assert here.get(f"{at}/page") == here.get(f"{at}/there") == (200, "text/html; charset=iso-8859-1", "caf\u00e9 me")
    assert here.get(f"{at}/none")[0] == 404 and here.bytes(f"{at}/page") == "caf\u00e9 me".encode("latin-1")
    for bad in (f"{at}/out", "http://127.0.0.1:1/x"):
        with pytest.raises(errors.NetworkError):
            here.get(bad)
    with pytest.raises(errors.NetworkError):
        web.Web().get(f"{at}/page")  # of this machine
    with pytest.raises(errors.NetworkError):
        here.bytes(f"{at}/none")
    started = time.monotonic()
    slow = web.Web(delay=0.1, allowed=lambda u: True)
    for _ in range(3):
        slow.get(f"{at}/page")
    assert time.monotonic() - started >= 0.2
    server.shutdown()
    assert not web.is_public("ftp://e.org") and not web.is_public("http://x.y", lambda h: ["169.254.169.254"]) and web.is_public("http://x.y", lambda h: ["93.184.216.34"]) and not web.is_public("http://x.y", lambda h: ["::1"])


def test_time_limit():
    with files.time_limit(None), files.time_limit(5):
        pass
    with pytest.raises(TimeoutError), files.time_limit(0.05):
        time.sleep(2)


def test_tables_and_images_of_pages(spark):
    rows = [["a", "b"], ["1", "x y"], ["2", ""]]
    made = writers.pdf([[("Heading", 20, True), ("body text", 10, False)], [("next", 10, False)]], {"Title": "T"}, {1: rows}, {0: [(120, 100), (5, 5)]})
    read = pdf.read_pdf(made)
    assert read["tables"] == [{"page_num": 2, "idx": 1, "rows": rows}] and [s["text"] for s in read["spans"][:2]] == ["Heading", "body text"]
    assert [i["content"][:4] for i in read["images"]] == [b"\x89PNG"] * 2 and images.image_size(read["images"][0]["content"]) == (120, 100, "png")
    found = files.validated(files.identified(spark.createDataFrame([("/x/p.pdf", bytearray(made), len(made))], "path string, content binary, length long")))
    docs, _ = documents.parse_files(found, {"image_output_dir": "out"}, ["pdf"])
    d = docs.first()
    assert d.content.endswith("**Table from page 2**\n\n| a | b |\n| --- | --- |\n| 1 | x y |\n| 2 |  |") and [(i.image_id, i.file_path, i.alt_text, i.size.width) for i in d.images] == [("img_0001", "out/img_001.png", "Image on page 1", 120)]
    without, _ = documents.parse_files(found, {"extract_tables": False, "extract_images": False}, ["pdf"])
    assert "Table from" not in without.first().content and without.first().images == []
    told = lambda data: [{"type": "QRCODE", "data": b"http://e.org/x"}, {"type": "EAN13", "data": b"1"}]
    codes, _ = documents.parse_files(found, {"decode": told}, ["pdf"])
    assert [(c.qr_id, c.data_type, c.source_image, c.fetch_status) for c in codes.first().qr_codes] == [("qr_000", "URL", "page_1", "pending"), ("qr_002", "URL", "page_1", "pending")]
    # frames that do not meet are tables of their own; a single box is none
    box = lambda x, y: [(x, y, x + 40, y), (x, y + 20, x + 40, y + 20), (x, y + 40, x + 40, y + 40), (x, y, x, y + 40), (x + 40, y, x + 40, y + 40)]
    assert pdf.ruled_tables(box(0, 0) + box(100, 100) + [(300, 0, 340, 0), (300, 20, 340, 20), (300, 0, 300, 20), (340, 0, 340, 20)], [(5, 5, "low"), (105, 125, "high"), (500, 500, "out")]) == [[["high"], [""]], [[""], ["low"]]]


def test_images_are_saved(spark, folder, tmp_path):
    found = files.validated(files.identified(files.scan(spark, folder)))
    rows = writers.save(documents.image_files(found), str(tmp_path / "out")).collect()
    assert {r.file_path for r in rows} == {"OEBPS/i.png", "image_002.png"} or {r.file_path for r in rows} == {"OEBPS/i.png", "image_001.png"}
    for r in rows:
        assert open(r.saved_path, "rb").read() == bytes(r.content) and r.saved_path.startswith(str(tmp_path / "out"))
    again = writers.save(spark.createDataFrame([("../../x.png", bytearray(b"1"))], "file_name string, content binary"), str(tmp_path / "out")).first()
    assert again.saved_path == f"{tmp_path}/out/x.png"
    with pytest.raises(Exception, match="FileExistsError"):
        writers.save(spark.createDataFrame([("x.png", bytearray(b"2"))], "file_name string, content binary"), str(tmp_path / "out")).collect()


def test_colours(spark):
    two = writers.png(4, 2, bytes([255, 0, 0] * 6 + [0, 0, 255] * 2))
    rows = images.coloured(spark.createDataFrame([(1, bytearray(two)), (2, bytearray(b"no")), (3, None)], "i int, content binary"), count=5).collect()
    assert [r.colours for r in rows] == [["#ff0000", "#0000ff"], [], []]
    assert images.dominant_colours([[0, 0, 0], [10, 0, 0], [200, 200, 200]], 2) == ["#050000", "#c8c8c8"]
    # every filter of a line
    w, raw = 3, [bytes([10, 20, 30, 40, 50, 60, 70, 80, 90]), bytes([11, 21, 33, 40, 55, 60, 77, 80, 99])]
    up = bytes((b - a) & 255 for a, b in zip(raw[0], raw[1]))
    sub = bytes((raw[0][i] - (raw[0][i - 3] if i > 2 else 0)) & 255 for i in range(9))
    avg = bytes((raw[1][i] - ((raw[1][i - 3] if i > 2 else 0) + raw[0][i]) // 2) & 255 for i in range(9))

    def paeth(a, b, c):
        p = a + b - c
        return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]

    pae = bytes((raw[1][i] - paeth(raw[1][i - 3] if i > 2 else 0, raw[0][i], raw[0][i - 3] if i > 2 else 0)) & 255 for i in range(9))
    for kind, line in ((2, up), (3, avg), (4, pae)):
        chunk = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
        made = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x01" + sub + bytes([kind]) + line)) + chunk(b"IEND", b"")
        assert images.png_pixels(made).reshape(2, 9).tolist() == [list(x) for x in raw]
