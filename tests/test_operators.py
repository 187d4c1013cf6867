"""Expressions and operators against plain values."""

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant import queries
from foliant.functions import classify, markdown, text
from foliant.operators import ai, chapters, html, images, qr
from foliant.operators.frontmatter import extracted, metadata, split_head
from foliant.operators.images import image_size


@pytest.fixture(scope="module")
def one(spark):
    """The value of an expression over a text."""

    def run(expression, value="x", kind="string"):
        df = spark.createDataFrame([(value,)], f"t {kind}")
        return df.select(expression(F.col("t")).alias("v")).first().v

    return run


def test_strip_and_words(one):
    assert one(text.strip, " \x1c a b  \n") == "a b"
    assert one(text.word_count, "a b\tc\x1cd  ") == 4 and one(text.word_count, "") == 0 and one(text.word_count, None) is None
    assert one(text.unix_lines, "a\r\nb\rc\n") == "a\nb\nc\n"


def test_decode(one):
    assert one(text.decoded, bytearray("é\r\n".encode()), "binary") == "é\n" and one(text.decoded, bytearray(b"\xe9"), "binary") == "é"


def test_cleaner(one):
    dirty = "Note[12] <b>x</b>\nPage 3 of 9\n  Chapter 4  \n***\n____\n---\ntable of contents\n“q” ‘s’ — – …\ta   b\n\n\n\nend  "
    assert one(text.cleaned, dirty) == "Note x\n\n\"q\" 's' -- - ... a b\n\nend".replace("\n\n\"", "\n\n\"")
    assert one(text.cleaned, "") == "" and one(text.cleaned, None) is None
    assert one(lambda c: text.cleaned(c, rules=False), " a  b [1] ") == "a b [1]"
    assert one(lambda c: text.tidy_lines(c, 2), " a \n\n\n\n\n b ") == "a\n\n\nb"


def test_times(one):
    for n, up, even, down in ((0, 1, 1, 1), (200, 1, 1, 1), (201, 2, 1, 1), (562, 3, 2, 2), (563, 3, 3, 2), (1000, 5, 4, 4)):
        assert (one(text.minutes_up, n, "long"), one(text.minutes_even, n, "long"), one(text.minutes_down, n, "long")) == (up, even, down)


@pytest.mark.parametrize("a,b", [(0, 3), (2, None), (-3, None), (1, -1), (5, 2), (-99, 99)])
def test_ranges(one, a, b):
    assert one(lambda c: text.text_range(c, a, b), "abcdef") == "abcdef"[a:b]


def test_titles_names_sizes(one):
    assert one(lambda c: text.first_line_title(c, "D"), "\n  Head \nx") == "Head" and one(lambda c: text.first_line_title(c, "D"), "y" * 100) == "D" and one(lambda c: text.first_line_title(c, "D"), " ") == "D"
    assert one(text.byte_size, 1536, "long") == "1.5 KB" and one(text.byte_size, 10, "long") == "10.0 B"
    assert one(text.file_name, 'a<b>: c?.txt ') == "ab_c.txt" and one(text.file_name, "??") == "unnamed"


def test_headings_normalised(one):
    assert one(markdown.normalised, "Title\n===\n\nSub\n---\n\n*  a\n  * b\n\n\n\nx\n------------") == "# Title\n## Sub\n- a\n  - b\n\nx\n------------"
    assert one(markdown.normalised, "a\n---\nbc\n---\n\n\nx\n") == "a\n---\n## bc\nx\n"
    assert one(markdown.normalised, "") == "" and one(markdown.normalised, None) is None and one(markdown.normalised, "---\n---") == "## ---"


def test_markdown_words(one):
    t = "# H one\n\n```\ncode words\n```\n`x y` **b** *i* [l k](http://a) ![alt](p) https://e.org/x"
    assert one(markdown.markdown_word_count, t) == 7


def test_heading_places(spark):
    t = "x\n# A\n\n#\nB\n## C  \n####### no\n#no\n```\n# in code\n```\n### D"
    import re

    want = [(m.start(), len(m[1]), m[2].strip()) for m in re.finditer(r"^(#{1,6})\s+(.+?)$", t, re.M)]
    got = chapters.headings(spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id int, text string")).orderBy("position").collect()
    assert [(r.position, r.level, r.title) for r in got] == want


def test_chapters_without_headings(spark):
    rows = chapters.heading_chapters(spark.createDataFrame([(1, "plain"), (2, " \n"), (3, None), (4, "a\n### deep")], "doc_id int, text string")).collect()
    assert {(r.doc_id, r.title, r.auto_generated, r.end_position) for r in rows} == {(1, "Full Document", True, 5), (4, "Full Document", True, 10)}


def test_marker_chapters(spark):
    t = "intro\nPart I\n a\n\nSection B\nb\niv. Then\nc"
    rows = chapters.text_chapters(spark.createDataFrame([(1, t), (2, "one line"), (3, ""), (4, None), (5, "Chapter 1\nx")], "doc_id int, text string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.title, r.chapter_type, r.start_position, r.end_position, r.content))
    assert by[1] == [("Part I", "Part", 6, 17, "Part I\n a"), ("Section B", "Section", 17, 29, "Section B\nb"), ("iv. Then", "Section", 29, len(t) + 1, "iv. Then\nc")]
    assert by[2] == [("one line", "single", 0, 8, "one line")] and by[3][0][0] == "Document" and 4 not in by and by[5][0][1] == "single"


def test_font_headings(spark):
    spans = [("d", 1, i, t, s, b) for i, (t, s, b) in enumerate([("Big", 20.0, False), ("body text", 10.0, False), ("Bold", 12.0, True), ("more", 10.0, False), ("x " * 30, 20.0, True), ("tail", 10.0, False)])]
    df = spark.createDataFrame(spans, "doc_id string, page_num int, span_idx int, text string, font_size double, is_bold boolean")
    rows = chapters.font_headings(df).collect()
    assert {r.title for r in rows} <= {"Big", "Bold"} and all(r.level >= 1 for r in rows)
    assert chapters.font_headings(spark.createDataFrame([("d", 1, 0, "only", 9.0, False)], df.schema)).count() == 1


def test_font_headings_of_equal_places_come_by_size_and_weight(spark):
    spans = [("d", 1, 0, "T 1", 12.0, True), ("d", 1, 0, "T 1", 12.0, False), ("d", 1, 0, "T 1", 8.0, True), ("d", 1, 1, "low", 8.0, False), ("d", 1, 2, "low", 8.0, False)]
    for rows in (spans, spans[::-1], spans[1:] + spans[:1]):
        df = spark.createDataFrame(rows, "doc_id string, page_num int, span_idx int, text string, font_size double, is_bold boolean").coalesce(1)
        assert [(r.title, r.level, r.position) for r in chapters.font_headings(df).collect()] == [("T 1", 1, 0)]


def test_headings_set_into_text(spark):
    df = spark.createDataFrame([("Intro Big body Sub end", [("Big", 1, 6), ("Sub", 2, 15), ("none", 1, 3)])], "t string, h array<struct<title:string,level:int,position:bigint>>")
    assert df.select(chapters.with_headings(F.col("t"), F.col("h"))).first()[0] == "Intro \n\n# Big\n\n body \n\n## Sub\n\n end"


def test_payloads(one):
    for t, kind in {" HTTPS://a ": "URL", "ftp://x": "URL", "a.b@c.de": "EMAIL", "MAILTO:x": "EMAIL", "tel:1": "PHONE", "wifi:S": "WIFI", "begin:vcard": "VCARD", "GEO:1,2": "GEO", "sms:1": "SMS", "SMSTO:1": "SMS", "a@b": "TEXT", "": "TEXT"}.items():
        assert one(classify.payload_type, t) == kind, t


def test_addresses(one):
    assert one(classify.host, "https://u:p@Ex.org:8080/x") == "ex.org" and one(classify.host, "http://[::1]:80/") == "::1" and one(classify.host, "nope") == ""
    assert one(classify.suffix, "/a/b.tar.GZ") == ".gz" and one(classify.suffix, "/a/.hidden") == "" and one(classify.stem, "/a/b.c.txt") == "b.c"
    base = F.lit("https://e.org/a/b.html?q#f")
    for src, want in {"x.png": "https://e.org/a/x.png", "/x": "https://e.org/x", "//c.d/x": "https://c.d/x", "http://z/x": "http://z/x", "data:image/png;base64,x": "data:image/png;base64,x"}.items():
        assert one(lambda c: classify.resolved_url(c, base), src) == want
    assert one(lambda c: classify.resolved_url(c, F.lit("https://e.org")), "x") == "https://e.org/x" and one(lambda c: classify.resolved_url(c, F.lit(None).cast("string")), "x") == "x"
    assert one(classify.url_variations, "https://www.e.org/p?q=1") == ["https://www.e.org/p/print", "https://www.e.org/p", "https://m.e.org/p?q=1", "https://www.e.org/p/amp"]
    assert one(classify.with_scheme, " e.org ") == "https://e.org" and one(classify.ipv4_number, "10.0.0.256") is None and one(classify.ipv4_number, "10.0.0.1") == 167772161


def test_dates(one):
    for t in ("2025-01-15", "2025/01/15", "2025-01-15T10:30:00Z", "2025", "2025-01", "January 15, 2025", "Jan 15, 2025"):
        assert one(classify.date_of, t).year == 2025
    assert one(classify.date_of, "soon") is None and one(classify.iso_date, "2025-01-15T10:30:00+02:00").hour == 8 and one(classify.iso_date, "15.1.2025") is None
    assert str(one(classify.page_date, "D:20240102030405+01'00'")) == "2024-01-02 03:04:05" and one(classify.page_date, "20240102") is None and one(classify.page_date, "D:2024").month == 1


def test_tags(one):
    assert one(classify.tag_list, " a, b;;c ") == ["a", "b", "c"]
    assert one(lambda c: classify.model_tags(c, 3), '1. "Big Data", [spark]\n- BIG data, ' + "x" * 51 + ", z, w") == ["big data", "spark", "z"]
    assert one(lambda c: classify.isbn(F.array(F.lit("x"), c)), "urn:ISBN:978-1") == "978-1"


def test_image_formats(one):
    for p, want in {"a.PNG": "png", "data:image/jpeg;base64,": "jpeg", "p.jpg?w=1&format=webp": "webp", "http://x.y/z": "unknown", "a.b/c": "unknown", "q.jpg?x": "jpg"}.items():
        assert one(markdown.image_format, p) == want


def test_markdown_images(spark):
    t = '![a](x.png "t") ![b](x.png) ![c][R1] ![d][none] ![e](../y.jpg)\n[r1]: first.gif\n[R1]: http://h/last.svg "T"\n'
    rows = images.markdown_images(spark.createDataFrame([(1, t, "/d/e"), (2, None, "/"), (3, "none", "/")], "doc_id int, text string, folder string"), folder_col="folder").collect()
    assert [(r.image_id, r.file_path, r.alt_text, r.position) for r in sorted(rows, key=lambda r: r.image_id)] == [("img_001", "/d/e/x.png", "a", 0), ("img_002", "/d/y.jpg", "e", t.find("![e]")), ("img_003", "http://h/last.svg", "c", t.find("![c]"))]


def test_image_checks(spark):
    import struct

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 300, 20)
    assert image_size(png) == (300, 20, "png") and image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4, "gif") and image_size(None) == (None, None, "unknown") == image_size(b"\x89PNG\r\n\x1a\n")
    df = spark.createDataFrame([(1, bytearray(png)), (2, bytearray(b"")), (3, bytearray(b"zz"))], "i int, content binary")
    assert {r.i: r.problem for r in images.checked(images.sized(df)).collect()} == {1: "too small", 2: "empty", 3: "no image"}


def test_tables_and_links(spark):
    df = spark.createDataFrame([([["a|b", None], [" c\nd ", "e"]],), ([],)], "r array<array<string>>")
    assert [x[0] for x in df.select(markdown.table(F.col("r"))).collect()] == ["| a\\|b |  |\n| --- | --- |\n| c d | e |", ""]
    assert df.select(markdown.link(F.lit("a[b]"), F.lit("u(v)"))).first()[0] == "[a\\[b\\]](u\\(v\\))"


def test_html_to_markdown():
    page = """<html><body><h2>T</h2><p>a <b>b</b> <i>c</i> <a href="/x">l</a> <a>n</a> <code>k</code><br>z</p><ul><li>one<li>two</ul><ol><li>1</ol><blockquote><p>q</p></blockquote>
        <pre><code>x = 1</code></pre><table><tr><th>h</th><td>i</td></tr><tr><td>j</td></tr></table><img src="s.png" alt="A"><img alt="none"><script>no</script><footer>no</footer></body></html>"""
    md = html.to_markdown(html.tree(page))
    for part in ("## T", "a **b** *c* [l](/x) n `k`\nz", "- one\n- two", "1. 1", "> q", "```\nx = 1\n```", "| h | i |\n| --- | --- |\n| j |", "![A](s.png)"):
        assert part in md, part
    assert "no" not in md.replace("none", "") and "\n\n\n" not in md
    assert html.plain_text(html.tree("<p>a</p><ul><li>b</li><li> </li></ul>x<hr>")).split("\n")[0] == "a"
    assert html.to_markdown(html.tree("<div>" * 3000 + "deep" + "</div>" * 3000)) == "deep"


CUT = """<!DOCTYPE html><html lang="en"><head><title>A&amp;&amp</title><style>p{margin:0}</style><script>x = "&amp";</script></head><body><article><h1>A&amp;&amp</h1>"""
CUT += "<p>Words of some length, and &lt b &lt; c &ampx; &#39 &#39; &amp;lt; R&D then</p>" * 3 + "</article></body></html>"


def test_references_without_semicolon_are_text():
    assert html.tree(CUT).text().startswith("A&&ampA&&ampWords")
    texts = html.tree('<a href="/?a=1&copy=2&amp;b" title="x &amp">&nope; &eacute;&#x41;&#x42 \ufdd0</a><code><script>a&&b&amp;c&lt</script></code>')
    a, code = texts.children
    assert a.attrs == {"href": "/?a=1&copy=2&b", "title": "x &amp"} and a.text() == "&nope; éA&#x42 \ufdd0" and code.text(frozenset()) == "a&&b&amp;c&lt"


@pytest.mark.parametrize("name", ["page_documents", "page_metadata", "page_tags", "page_plain_text"])
def test_cut_references_as_in_sql(spark, tmp_path, name):
    pages = [(i, "http://example.com/a", CUT) for i in range(7)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) == 7


def against_sql(spark, folder, name, pages):
    """Rows of a query over these pages, and what its SQL has in their place."""
    rows = [(i, "http://example.com/a", page) for i, page in pages]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    got = queries.QUERIES[name](spark, str(folder))
    duck = duckdb.connect()
    duck.sql(f"create view pages as from '{folder}/pages.parquet/*.parquet'")
    want = duck.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    return sorted(map(str, map(tuple, got.collect()))), sorted(map(str, want))


def odd_pages():
    title = "<html{}><head><title>{}</title></head><body><h1>{}</h1><p>A</p></body></html>"
    pages = [None, "", " ", "no markup", title.replace("<title>{}</title>", "").format("", "B"), '<html lang="en"><head><title>Cut tit', '<html lang="en"><head><title>Cut</tit', '<html lang="en"><head><title>Cut</title']
    pages += [title.format(lang, "T", "T") for lang in (' lang="en" lang="fr"', ' lang=""', ' lang=" en "')]
    return pages + [title.format(' lang="de"', t, t) for t in ("", "  ", "\xa0a\xa0", "\x0ba\x1c", "\u2028a\u3000", "\ta\r\n\fb\r\n")]


@pytest.mark.parametrize("name", ["page_metadata", "page_tags", "page_plain_text"])
def test_odd_pages_as_in_sql(spark, tmp_path, name):
    odd = odd_pages()
    got, want = against_sql(spark, tmp_path, name, [(i, p) for i, p in enumerate(x for p in odd for x in [p] * 6)])
    assert got == want and len(want) == 6 * len(odd)


def test_tags_of_pages_with_odd_heads_and_keys_as_in_sql(spark, tmp_path):
    pages = ["<HEAD><title>T</title></HEAD><h1>a > b</h1>", '<head id="x"><title>T</title></head>', "<head><title>T</title></head><p><head></p>", "<h1>\"q\" &amp; 'r'</h1>"]
    got, want = against_sql(spark, tmp_path, "page_tags", [(i, p) for p in pages for i in (None, 5, 6, 7, 14, 2**62)])
    assert got == want and len(want) == 24


def test_pages_that_fail_are_rows(spark):
    rows = html.read_pages(spark.createDataFrame([(1, None), (2, ""), (3, "<html><body><p>" + "Text of some length, yes. " * 9)], "i int, html string"), ["i"]).orderBy("i").collect()
    assert rows[0].warnings == ["null page"] and rows[1].main_text is None and rows[2].markdown.startswith("Text of")


def test_front_matter(spark):
    assert split_head('{"a": {"b": "}"}}\nrest') == ({"a": {"b": "}"}}, "rest") and split_head('+++\na = 1\n+++\nx') == ({"a": 1}, "x")
    assert split_head("---\n- a\n---\nx")[1].startswith("---") and split_head("---\nno end") == ({}, "---\nno end") and split_head("{broken") == ({}, "{broken")
    df = spark.createDataFrame([(1, "---\nTitle: T\nauthor: A\nlang: de\nsummary: S\nkeywords: p, q\npublished: soon\n---\nbody"), (2, None), (3, "plain"), (4, "---\ndate: 2024-02-03\ntags:\n  - a\n  - b\n---\n")], "i int, text string")
    rows = {r.i: r for r in metadata(extracted(df)).collect()}
    a = rows[1]
    assert (a.title, a.author, a.language, a.description, a.tags, a.publication_date, a.body) == ("T", "A", "de", "S", ["p", "q"], None, "body") and a.front_warnings == ["no date: soon"] and "published" in a.custom_fields
    assert rows[2].body is None and rows[3].body == "plain" and rows[3].tags is None and rows[4].tags == ["a", "b"] and rows[4].publication_date.day == 3


def test_front_matter_without_letters_as_in_sql(spark, tmp_path):
    texts = ["plain words", "", None, "É.", "123", "  ", "---", "---\nx", '{"a": 1}', "null", "a: b # c", "x" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["front_matter"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES['front_matter']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) == len(texts)
    titles = spark.createDataFrame([("---\ntitle: ' T '\n---\n",), ("---\ntitle: ' '\n---\n",), ("---\ntitle: 7\n---\n",)], "text string")
    assert sorted(r.title for r in metadata(extracted(titles.withColumn("stem", F.lit("stem"))), "stem").collect()) == [" T ", "7", "stem"]


def test_codes_to_documents(spark):
    raw = spark.createDataFrame([("d", 1, 0, "QRCODE", "https://e.org/a?b"), ("d", 1, 1, "EAN13", "123"), ("d", 2, 0, "QRCODE", "tel:5")], "doc_id string, page_number int, decoder_idx int, symbology string, raw_data string")
    codes = qr.numbered(raw)
    assert {(r.qr_id, r.data_type, r.fetch_status) for r in codes.collect()} == {("qr_000", "URL", "pending"), ("qr_002", "PHONE", "skipped")}
    tries = qr.candidates(codes.where("data_type = 'URL'"), archive=None)
    page = "long page text " * 10

    def fetch(url):
        if url.endswith("/print"):
            return 200, "text/html", page
        if "m." in url:
            raise OSError("down")
        return 404, "", "x"

    best = qr.first_success(qr.fetched(tries, fetch), ["doc_id", "qr_id"])
    r = best.first()
    assert r.fetch_status == "success" and r.final_url == "https://e.org/a/print" and len(r.fetch_notes) == tries.count()
    done = qr.processed(codes, best)
    assert {x.qr_id: x.fetch_status for x in done.collect()} == {"qr_000": "success", "qr_002": "skipped"}
    assert {x.fetch_status for x in qr.processed(codes).collect()} == {"pending", "skipped"}
    docs = spark.createDataFrame([("d", "text", 1, 1), ("e", "other", 1, 1)], "doc_id string, content string, word_count bigint, estimated_reading_time bigint")
    out = {x.doc_id: x for x in qr.merged(docs, done).collect()}
    assert out["d"].word_count == 1 + 30 and out["d"].qr_codes == 2 and out["d"].content.count("QR Code:") == 2 and out["e"].content == "other"


def test_safe_addresses(spark):
    urls = spark.createDataFrame([("http://a.org/x",), ("file:///x",), ("http://b.a.org",), ("http://localhost/",), ("http://in.side/",), ("http://bad.a.org",)], "u string")
    known = spark.createDataFrame([("in.side", "10.1.2.3"), ("a.org", "8.8.8.8")], "host string, ip string")
    got = {r.u: r.safe for r in qr.safe(urls, "u", known, None, ["bad.a.org"]).collect()}
    assert got == {"http://a.org/x": True, "file:///x": False, "http://b.a.org": True, "http://localhost/": False, "http://in.side/": False, "http://bad.a.org": False}
    assert {r.u for r in qr.safe(urls, "u", None, ["a.org"]).where("safe").collect()} == {"http://a.org/x", "http://b.a.org", "http://bad.a.org"}
    assert qr.networks(spark, 6).count() == 3


def test_model_calls(spark):
    rows = spark.createDataFrame([("d1", "good text"), ("d2", "bad text"), ("d3", None)], "document_id string, content string")

    def call(system, prompt):
        if "bad" in prompt:
            raise ValueError("invalid api key")
        return "Alpha, beta, alpha"

    out = {r.document_id: r for r in ai.replied(rows.withColumn("prompt", ai.tag_prompt("content")), call, "s").withColumn("tags", ai.tags()).collect()}
    assert out["d1"].tags == ["alpha", "beta"] and out["d2"].tags == [] and "invalid" in out["d2"].error and out["d3"].reply is None
    waits, n = [], iter([ConnectionError("x"), ConnectionError("x"), None])

    def flaky(system, prompt):
        if e := next(n):
            raise e
        return "ok"

    assert ai.with_retries(flaky, ai.Policy(3, 1.0, waits.append))("", "") == "ok" and waits == [1.0, 2.0]
    assert ai.retriable(RuntimeError("Rate limit")) and not ai.retriable(RuntimeError("rate limit: invalid api key")) and ai.sees_images("lmstudio", "any") and not ai.sees_images("openai", "gpt-3")
    for bad in (lambda: ai.tag_prompt("content", 0), lambda: ai.summary_prompt("content", "odd"), lambda: ai.summary_prompt("content", most=0)):
        with pytest.raises(ValueError):
            bad()


def test_services(spark):
    import json

    rows = spark.createDataFrame([("a", 'say "hi"\n'), ("b", "odd"), ("c", None)], "id string, prompt string")
    policy = ai.Policy(1, 0.0, lambda s: None)

    def send(url, head, body):
        asked = json.loads(body)
        said = asked["messages"][-1]["content"]
        if said == "odd":
            return '{"success": false}'
        if "anthropic" in url:
            assert head["x-api-key"] == "k" and asked["system"] == "s" and asked["model"] == "m" and asked["max_tokens"] == 1024
            return json.dumps({"content": [{"type": "text", "text": said}]})
        assert head["Authorization"] == "Bearer k" and asked["messages"][0] == {"role": "system", "content": "s"}
        if "cloudflare" in url:
            assert "/accounts/acc/ai/run/m" in url and "model" not in asked
            return json.dumps({"success": True, "result": {"response": said}})
        return json.dumps({"choices": [{"message": {"role": "assistant", "content": said}}]})

    for provider in ai.ENDPOINTS:
        out = {r.id: r for r in ai.answered(rows, provider, "m", "k", "acc", system="s", policy=policy, send=send).collect()}
        assert out["a"].reply == 'say "hi"\n' and out["a"].error is None and out["b"].reply is None and "no text" in out["b"].error and (out["c"].reply, out["c"].error) == (None, None), provider
    failed = ai.answered(rows.where("id = 'a'"), "openai", "m", policy=policy, send=lambda u, h, b: (_ for _ in ()).throw(RuntimeError("403 forbidden"))).first()
    assert failed.reply is None and "403" in failed.error
    one = spark.createDataFrame([("what", bytearray(b"\x00\x01"))], "p string, i binary")
    body = lambda p: json.loads(one.select(ai.request(p, "p", "m", image=F.col("i"), media_type="image/gif")).first()[0])["messages"][0]["content"]
    assert body("anthropic") == [{"type": "image", "source": {"type": "base64", "media_type": "image/gif", "data": "AAE="}}, {"type": "text", "text": "what"}]
    assert body("openai") == [{"type": "image_url", "image_url": {"url": "data:image/gif;base64,AAE="}}, {"type": "text", "text": "what"}]
    with pytest.raises(ValueError):
        ai.request("none", "p", "m")


@pytest.mark.parametrize("said,again", [("Error 504", True), ("network is down", True), ("429: rate limit", True), ("403 while the connection was made", False), ("Unauthorized", False), ("overloaded", False), ("", False)])
def test_retries(one, said, again):
    assert ai.retriable(RuntimeError(said)) == again == one(ai.retriable_message, said)


def test_codes_of_images(spark):
    df = spark.createDataFrame([("d", 1, bytearray(b"two")), ("d", 2, bytearray(b"none")), ("e", 1, bytearray(b"bad")), ("f", 1, None)], "doc_id string, page_number int, content binary")

    def decode(data):
        if data == b"bad":
            raise ValueError("no image")
        return [{"type": "QRCODE", "data": b"caf\xe9"}, {"type": "CODE128", "data": "1"}, {"type": "QRCODE", "data": "tel:1", "x": 3}] if data == b"two" else []

    found = qr.decoded(df, decode)
    rows = found.collect()
    assert len(rows) == 4 and [r.warning for r in rows if r.doc_id == "e"] == ["ValueError: no image"] and "Latin-1" in rows[0].warning
    codes = qr.numbered(found.where("raw_data is not null")).orderBy("qr_id").collect()
    assert [(c.qr_id, c.raw_data, c.data_type, c.x) for c in codes] == [("qr_000", "café", "TEXT", None), ("qr_002", "tel:1", "PHONE", 3)]


def test_long_fetches_are_noted(spark):
    tries = spark.createDataFrame([(1, 0, "u", 200, "x" * 500_100), (2, 0, "v", 200, "y" * 60)], "k int, try_no int, try_url string, status int, content string")
    got = {r.k: r for r in qr.first_success(tries, ["k"]).collect()}
    assert len(got[1].fetched_content) == 500_000 and got[1].fetch_notes[-1] == "content cut at 500000 characters" and len(got[2].fetch_notes) == 1


def test_archive(spark):
    def fetch(url):
        if "wayback/available" in url:
            return 200, "application/json", '{"archived_snapshots": {"closest": {"available": true, "url": "http://w/1", "status": "200"}}}' if "%2Fe.org" in url else "{}"
        return 200, "text/html", f"copy of {url}"

    rows = qr.from_archive(spark.createDataFrame([("http://e.org/a b",), ("http://x.y",)], "url string"), fetch).collect()
    assert {(r.url, r.snapshot, r.content) for r in rows} == {("http://e.org/a b", "https://w/1", "copy of https://w/1"), ("http://x.y", None, None)}


def test_list_items_outside_lists():
    assert html.to_markdown(html.tree("<div><li>one</li><li>two</li></div>")) == "- one\n- two"


def test_fields_of_pages_on_demand():
    page = "<html lang='en'><title>T</title><body><p>" + "long text, " * 20 + "</p></body></html>"
    assert "markdown" not in html.read_page(page, frozenset({"title"})) and html.read_page(page, frozenset({"plain"}))["plain"] == html.read_page(page)["plain"]


def test_photo_tables(spark):
    from foliant.sources import photo

    df = spark.createDataFrame([(str(i),) for i in range(100)] + [(None,)], "c string")
    flash = {r.c: r.v for r in df.select("c", photo.flash(F.col("c")).alias("v")).collect()}
    assert len(photo.FLASH) == 22 and all(flash[str(i)] == photo.FLASH.get(i, f"Unknown ({i})") for i in range(100)) and flash[None] is None
    turned = {r.c: r.v for r in df.select("c", photo.orientation(F.col("c")).alias("v")).collect()}
    assert turned["3"] == "Rotated 180°" and turned[None] == turned["0"] == "Normal" and turned["9"] == "Unknown"


def test_model_replies(spark):
    reply = "Overall: 85\nReadability score: 120\nStructure: x\nStrengths:\n- clear\n* short\nSuggestions:\n1. more\n"
    df = spark.createDataFrame([("a", reply), ("b", "Overall: 85"), ("c", "")], "document_id string, reply string")
    q = {r.document_id: r for r in ai.quality(df).collect()}
    assert (q["a"].overall_score, q["a"].readability_score, q["a"].structure_score, q["a"].strengths, q["a"].suggestions) == (85, 100, 0, ["clear", "short"], ["more"]) and q["c"].overall_score == 0
    assert ai.compared(ai.quality(df), spark.createDataFrame([("a", "b"), ("c", "a")], "first string, second string")).orderBy("first").collect()[0].better == "a"
    img = spark.createDataFrame([("DESCRIPTION: A dog\nTEXT: none\nTYPE: photo\nOBJECTS: dog, - ball\nALT_TEXT: dog\nCONFIDENCE: High",), ("junk",)], "reply string")
    r = ai.image_analysis(img).collect()
    assert (r[0].description, r[0].objects, r[0].confidence, r[1].confidence, r[1].objects) == ("A dog", ["dog", "ball"], 0.9, 0.5, [])
    p = ai.photo_analysis(spark.createDataFrame([('ok {"caption": "C", "tags": ["x"], "other": 1} end',), ('caption: "Plain", x',)], "reply string")).collect()
    assert (p[0].caption, p[0].tags, p[1].caption, p[1].tags) == ("C", ["x"], "Plain", None)
    assert spark.range(1).select(ai.image_prompt(F.lit("x" * 500), F.lit(300), F.lit(None).cast("string"))).first()[0].count("x") >= 400


def test_wrongly_decoded_text(one):
    from foliant.functions.encoding import fixed, repaired

    for t in ("plain", "", "Â£ alone".replace("Â", ""), "naïve Ärger", "100 € ô"):
        assert repaired(t) == t
    assert repaired("café – “x".encode().decode("cp1252")) == "café – “x" and repaired("Ã©tÃ© and 漢") == "été and 漢"
    assert repaired("café".encode().decode("latin-1").encode().decode("latin-1")) == "café"
    assert one(fixed, "cafÃ©") == "café" and one(fixed, None) is None


def test_fetched_text_and_archives(spark):
    assert html.fetched_text("<body><nav>n</nav><div id=content><p>a <b>b</b></p><script>x</script></div>z") == "a\nb"
    assert html.fetched_text("<p>only</p>") == "only"
    df = spark.createDataFrame([('{"archived_snapshots": {"closest": {"available": true, "url": "http://w/1", "status": "200"}}}',), ("{}",), ("junk",)], "content string")
    assert [r.snapshot for r in qr.archived(df).collect()] == ["https://w/1", None, None]
    codes = spark.createDataFrame([("d", "qr_000", "URL", "u", "some fetched words"), ("d", "qr_001", "TEXT", "t", None)], "doc_id string, qr_id string, data_type string, raw_data string, fetched_content string")
    assert [(r.chapter_id, r.level, r.word_count) for r in qr.code_chapters(codes).collect()] == [(1, 2, 3)]
