"""Queries of the file readers and of model services over files and rows made from ``documents``, and their SQL.

Each query writes a file for every document, of its whole text, with ``sources.writers``, and reads it back; the SQL
says from the same table what must come out.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import ai, images, qr
from .plans import documents as plans
from .sources import docx, epub, pdf, photo, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"), F.col("doc_id").cast("string").alias("path"))


_STRIP = "regexp_replace({0}, '\\A\\s+|\\s+\\z', '', 'g')"
#: Documents with their lines, and for every line its number from 0 and its text.
_LINES = """d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)"""
_WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''))::BIGINT"


# --- office documents ------------------------------------------------------------------------------------------------


def _blocks(r: dict) -> list[dict]:
    """Lines in turn as a heading, plain, bold and italic, a link, and a list item; at last a table."""
    out: list[dict] = []
    for i, line in enumerate(r["text"].split("\n")):
        run, block = {"text": line}, {"runs": None}
        if i % 5 == 0:
            block["style"] = f"Heading {i % 3 + 1}"
        elif i % 5 == 2:
            run |= {"bold": True, "italic": i % 2 == 0}
        elif i % 5 == 3:
            run["url"] = f"http://e.org/({r['doc_id']})"
        elif i % 5 == 4:
            block |= {"style": "List Number" if i % 2 else "List Bullet", "numbered": True, "level": i % 3}
        out.append(block | {"runs": [run]})
    return [*out, {"rows": [["lang", "source"], [r["lang"], f"{r['source']}|x"]]}]


def _office(r: dict) -> bytes:
    i = r["doc_id"]
    about = {"title": f"Report {i}", "creator": f"Author {i % 7}", "subject": f"About {i}" if i % 2 == 0 else None, "description": "notes", "keywords": f"a{i % 3}; b, {r['lang']}", "created": f"{2000 + i % 30}-0{i % 9 + 1}-15T04:05:06Z", "lastModifiedBy": r["source"]}
    return writers.docx(_blocks(r), about, [writers.png(i % 200 + 1, i % 7 + 1)] * (i % 3))


def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.files(_documents(spark, sf_dir), _office)


def _office_sql(bold: str, link: str) -> str:
    line, plain = "lines[i + 1]", _STRIP.format("lines[i + 1]")
    return f"""CASE WHEN {plain} = '' THEN '' WHEN i % 5 = 0 THEN repeat('#', i % 3 + 1) || ' ' || {plain} WHEN i % 5 = 2 THEN {bold} WHEN i % 5 = 3 THEN {link}
        WHEN i % 5 = 4 THEN repeat('  ', i % 3) || CASE WHEN i % 2 = 1 THEN '1.' ELSE '-' END || ' ' || {plain} ELSE {line} END"""


_LINK = "'[' || regexp_replace(lines[i + 1], '([][])', '\\\\\\1', 'g') || '](http://e.org/\\(' || doc_id || '\\))'"
_OFFICE = """WITH {lines}, b AS (SELECT *, list_transform(range(len(lines)), lambda i: {line}) AS blocks FROM d),
    c AS (SELECT *, array_to_string(list_append(list_filter(blocks, lambda x: {blank} <> ''), '| lang | source |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || lang || ' | ' || source || '\\|x |'), chr(10) || chr(10)) AS content FROM b)"""


@query(f"""{_OFFICE.format(lines=_LINES, line=_office_sql('lines[i + 1]', _LINK), blank=_STRIP.format('x'))}
    SELECT doc_id, md5(content) AS content_md5, {_WORDS.format('content')} AS words FROM c""")
def office_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office documents of headings, links, lists and a table, as Markdown."""
    read = docx.read_documents(office_files(spark, sf_dir), images=False)
    return read.select(F.col("doc_id").cast("long"), F.md5("content").alias("content_md5"), text.word_count("content").alias("words"))


@query(f"""{_OFFICE.format(lines=_LINES, line=_office_sql("CASE WHEN i % 2 = 0 THEN '***' || lines[i + 1] || '***' ELSE '**' || lines[i + 1] || '**' END", 'lines[i + 1]'), blank=_STRIP.format('x'))}
    SELECT doc_id, md5(content) AS content_md5 FROM c""")
def office_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without links, so that bold and italic runs are marked."""
    read = docx.read_documents(office_files(spark, sf_dir), links=False, images=False)
    return read.select(F.col("doc_id").cast("long"), F.md5("content").alias("content_md5"))


@query("""SELECT doc_id, 'Report ' || doc_id AS title, 'Author ' || doc_id % 7 AS author, CASE WHEN doc_id % 2 = 0 THEN 'About ' || doc_id ELSE 'notes' END AS description, 'a' || doc_id % 3 || '|b|' || coalesce(lang, 'none') AS tags,
    (2000 + doc_id % 30) || '-0' || (doc_id % 9 + 1) || '-15 04:05:06' AS published, coalesce(source, 'none') AS last_modified_by FROM documents""")
def office_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core properties of office documents."""
    about = docx.metadata(docx.read_documents(office_files(spark, sf_dir), images=False))
    return about.select(F.col("doc_id").cast("long"), "title", "author", "description", F.array_join("tags", "|").alias("tags"), _utc("publication_date").alias("published"), "last_modified_by")


def _utc(c: str):
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


@query("""SELECT doc_id, 'img_00' || (i + 1) AS image_id, 'image_00' || (i + 1) || '.png' AS file_name, (doc_id % 200 + 1)::INT AS width, (doc_id % 7 + 1)::INT AS height, 'png' AS format, CASE WHEN least(doc_id % 200 + 1, doc_id % 7 + 1) < 4 THEN 'too small' END AS problem
    FROM (SELECT doc_id, unnest(range(doc_id % 3)) AS i FROM documents)""")
def office_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of office documents, checked and named."""
    rows = images.extracted(docx.read_documents(office_files(spark, sf_dir)), "doc_id", least=4, base="image")
    return rows.select(F.col("doc_id").cast("long"), "image_id", "file_name", "width", "height", "format", "problem")


# --- e-books ---------------------------------------------------------------------------------------------------------


def _book(r: dict) -> bytes:
    i, lines = r["doc_id"], r["text"].split("\n")
    cut = [k * len(lines) // 3 for k in range(4)]
    pages = [(f"text/p{k}.xhtml", f"<h1>Part {k + 1}</h1>" + "".join(f"<p>{escape(x)}</p>" for x in lines[cut[k] : cut[k + 1]])) for k in range(3)]
    about = [("title", f"Book {i}"), ("creator", f"Author {i % 5}"), ("creator", f"Editor {i % 4}"), ("publisher", r["source"]), ("date", f"{1990 + i % 40}-0{i % 9 + 1}"), ("language", r["lang"]), ("identifier", f"id-{i}"), ("identifier", f"urn:isbn:{1000 + i}"), ("description", f"About {i}"), ("subject", "x"), ("subject", f"s{i % 6}")]
    contents = [(1, "Start", "text/p0.xhtml"), (2, "Middle", "text/p1.xhtml#a"), (1, f"End {i % 3}", "text/p2.xhtml")] if i % 4 else None
    return writers.epub(about, pages, contents, {f"img/c{k}.png": writers.png(i % 50 + 1, 2 + k) for k in range(i % 3)})


def books(spark: SparkSession, sf_dir: str, pictures: bool = False) -> DataFrame:
    return epub.read_books(writers.files(_documents(spark, sf_dir), _book), images=pictures)


_TIDY = _STRIP.format("regexp_replace(array_to_string(list_transform(string_split({0}, chr(10)), lambda x: " + _STRIP.format("x") + "), chr(10)), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")
_SPINE = f"""WITH {_LINES}, k AS (SELECT *, unnest(range(3)) AS k FROM d), p AS (SELECT doc_id, k, lines[(k * len(lines) // 3) + 1 : (k + 1) * len(lines) // 3] AS mine FROM k),
    s AS (SELECT doc_id, k, {_TIDY.format("'Part ' || (k + 1) || chr(10) || chr(10) || array_to_string(list_transform(mine, lambda x: x || chr(10) || chr(10)), '')")} AS t FROM p)"""


@query(f"{_SPINE} SELECT doc_id, k::INT AS spine_idx, 'OEBPS/text/p' || k || '.xhtml' AS file_name, 'Part ' || (k + 1) AS item_title, md5(t) AS text_md5 FROM s")
def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of e-books in reading order, as plain text."""
    return epub.spine(books(spark, sf_dir)).select(F.col("book_id").cast("long").alias("doc_id"), "spine_idx", "file_name", "item_title", F.md5("text").alias("text_md5"))


@query("""SELECT doc_id, e.level::INT AS level, e.title AS title, e.href AS href, e.ord::INT AS ord FROM (SELECT doc_id, unnest([{'ord': 0, 'level': 1, 'title': 'Start', 'href': 'OEBPS/text/p0.xhtml'}, {'ord': 1, 'level': 2, 'title': 'Middle', 'href': 'OEBPS/text/p1.xhtml#a'},
    {'ord': 2, 'level': 1, 'title': 'End ' || doc_id % 3, 'href': 'OEBPS/text/p2.xhtml'}]) AS e FROM documents WHERE doc_id % 4 <> 0)""")
def book_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents of e-books, nested entries in order."""
    return epub.toc(books(spark, sf_dir)).select(F.col("book_id").cast("long").alias("doc_id"), "ord", "level", "title", "href")


@query("""SELECT doc_id, 'Book ' || doc_id AS title, 'Author ' || doc_id % 5 AS author, 'Author ' || doc_id % 5 || '|' || 'Editor ' || doc_id % 4 AS authors, coalesce(source, 'none') AS publisher, (1990 + doc_id % 40) || '-0' || (doc_id % 9 + 1) || '-01 00:00:00' AS published,
    coalesce(lang, 'none') AS language, (1000 + doc_id)::VARCHAR AS isbn, 'About ' || doc_id AS description, 'x|s' || doc_id % 6 AS tags FROM documents""")
def book_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of e-books."""
    m = epub.metadata(books(spark, sf_dir))
    return m.select(F.col("book_id").cast("long").alias("doc_id"), "title", "author", F.array_join("authors", "|").alias("authors"), "publisher", _utc("publication_date").alias("published"), "language", "isbn", "description", F.array_join("tags", "|").alias("tags"))


@query(f"""{_SPINE}, n AS (SELECT *, sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - length(t) - 2 AS place FROM s)
    SELECT doc_id, (k + 1)::BIGINT AS chapter_id, 'Part ' || (k + 1) AS title, place::BIGINT AS start_position, (place + length(t))::BIGINT AS end_position, {_WORDS.format('t')} AS word_count FROM n""")
def book_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of e-books by their pages."""
    rows = epub.chapters(books(spark, sf_dir), use_toc=False, min_words=1)
    return rows.select(F.col("book_id").cast("long").alias("doc_id"), "chapter_id", "title", "start_position", "end_position", "word_count")


@query("""SELECT doc_id, 'img_00' || (k + 4) AS image_id, 'OEBPS/img/c' || k || '.png' AS file_name, (doc_id % 50 + 1)::INT AS width, (2 + k)::INT AS height FROM (SELECT doc_id, unnest(range(doc_id % 3)) AS k FROM documents)""")
def book_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of e-books, with the names that they have in the book."""
    rows = images.extracted(books(spark, sf_dir, True), "book_id")
    return rows.where("problem is null").select(F.col("book_id").cast("long").alias("doc_id"), "image_id", "file_name", "width", "height")


# --- page-described documents ----------------------------------------------------------------------------------------

_PAGE_LINES = 40


def _cells(r: dict) -> list[list[str]]:
    return [["word", "place", "lang"], *[[w[:12], str(k), r["lang"]] for k, w in enumerate((r["text"].split() or ["-"])[:3])]]


def _described(r: dict) -> bytes:
    i, lines = r["doc_id"], r["text"].split("\n")
    pages = [[(x, 20.0 if k % 10 == 0 else 10.0, k % 10 == 0) for k, x in enumerate(lines) if k // _PAGE_LINES == p and x.strip()] for p in range(-(-len(lines) // _PAGE_LINES))]
    about = {"Title": f"Paper {i}", "Author": f"Author {i % 7}", "Subject": r["source"], "Keywords": f"k{i % 5}, {r['lang']},", "CreationDate": f"D:{2000 + i % 25}0{i % 9 + 1}02030405Z", "Producer": "p"}
    return writers.pdf(pages, about, {0: _cells(r)} if i % 2 else None, {0: [(90 + i % 30, 100)]})


def described(spark: SparkSession, sf_dir: str, pictures: bool = False) -> DataFrame:
    return pdf.read_pdfs(writers.files(_documents(spark, sf_dir), _described), images=pictures)


_PLACES = f"""WITH {_LINES}, l AS (SELECT doc_id, unnest(lines) AS x, unnest(range(len(lines))) AS k FROM d), s AS (SELECT doc_id, k, {_STRIP.format('x')} AS t, (k // {_PAGE_LINES} + 1)::INT AS page_num FROM l)"""


@query(f"""{_PLACES} SELECT doc_id, page_num, (row_number() OVER (PARTITION BY doc_id, page_num ORDER BY k) - 1)::INT AS span_idx, md5(t) AS text_md5, CASE WHEN k % 10 = 0 THEN 20.0 ELSE 10.0 END::DOUBLE AS font_size, k % 10 = 0 AS is_bold FROM s WHERE t <> ''""")
def described_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text spans of page-described documents, without those of their tables."""
    rows = pdf.spans(described(spark, sf_dir)).where("font_size <> 9")
    return rows.select(F.col("doc_id").cast("long"), "page_num", "span_idx", F.md5("text").alias("text_md5"), "font_size", "is_bold")


@query("""SELECT doc_id, 'Paper ' || doc_id AS title, 'Author ' || doc_id % 7 AS author, coalesce(source, 'none') AS description, 'k' || doc_id % 5 || '|' || coalesce(lang, 'none') AS tags, (2000 + doc_id % 25) || '-0' || (doc_id % 9 + 1) || '-02 03:04:05' AS published,
    ((len(string_split(coalesce(text, ''), chr(10))) + 39) // 40)::VARCHAR AS page_count, 'p' AS producer, '1.4' AS pdf_version FROM documents""")
def described_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The information dictionary of page-described documents."""
    m = pdf.metadata(described(spark, sf_dir))
    field = lambda k: F.try_element_at("custom_fields", F.lit(k)).alias(k)
    return m.select(F.col("doc_id").cast("long"), "title", "author", "description", F.array_join("tags", "|").alias("tags"), F.date_format("publication_date", "yyyy-MM-dd HH:mm:ss").alias("published"), field("page_count"), field("producer"), field("pdf_version"))


@query(f"""WITH {_LINES}, w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM d WHERE doc_id % 2 <> 0), r AS (SELECT doc_id, lang, CASE WHEN len(w) = 0 THEN ['-'] ELSE w[1:3] END AS w FROM w)
    SELECT doc_id, 1 AS page_num, '| word | place | lang |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(range(len(w)), lambda k: '| ' || substring(w[k + 1], 1, 12) || ' | ' || k || ' | ' || lang || ' |'), chr(10)) AS markdown FROM r""")
def described_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled tables of page-described documents, as Markdown."""
    return pdf.tables(described(spark, sf_dir)).select(F.col("doc_id").cast("long"), "page_num", "markdown")


@query("""SELECT doc_id, 'img_0001' AS image_id, 0::BIGINT AS position, 'Image on page 1' AS alt_text, (90 + doc_id % 30)::INT AS width, 100 AS height, 'png' AS format FROM documents WHERE doc_id % 30 >= 10""")
def described_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 100 pixels or more of page-described documents, read as files."""
    rows = images.sized(pdf.images(described(spark, sf_dir, True)).drop("width", "height"))
    return rows.select(F.col("doc_id").cast("long"), "image_id", "position", "alt_text", "width", "height", "format")


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, {_STRIP.format("array_to_string(list_filter(list_transform(lines, lambda x: " + _STRIP.format('x') + "), lambda x: x <> ''), ' ')")} AS t FROM d)
    SELECT doc_id, md5(t) AS text_md5, length(t) AS characters, length(t) < 100 AS scanned FROM c""")
def described_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of page-described documents, and whether they have so little that they are scans."""
    rows = described(spark, sf_dir)
    spans = pdf.spans(rows).where("font_size <> 9")
    joined = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "span_idx", "text"))).alias("s"))
    text_ = F.array_join(F.transform(F.coalesce("s", F.array().cast("array<struct<page_num:int,span_idx:int,text:string>>")), lambda x: x["text"]), " ")
    out = rows.select("doc_id").join(joined, "doc_id", "left").select(F.col("doc_id").cast("long"), text_.alias("t"))
    return out.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("characters"), (F.length(text.strip("t")) < 100).alias("scanned"))


# --- photos ----------------------------------------------------------------------------------------------------------


def _photo(r: dict) -> bytes:
    i = r["doc_id"]
    exif = {
        "Make": f"Maker {i % 5} ", "Model": f"M{i % 11}", "LensModel": f"L{i % 3}" if i % 2 else None, "Orientation": i % 10, "ExposureTime": (1, i % 500 + 2) if i % 3 else (i % 40 + 2, 2), "FNumber": (i % 160 + 10, 10), "ISOSpeedRatings": 100 * (i % 8 + 1), "Flash": i % 100,
        "FocalLength": (i % 90 + 10, 1), "ExposureBiasValue": (i % 7 - 3, 3), "MeteringMode": i % 8, "ExposureMode": i % 4, "ExposureProgram": i % 10, "WhiteBalance": i % 3, "ImageDescription": r["source"], "UserComment": b"ASCII\0\0\0" + r["lang"].encode(),
        "DateTimeOriginal": f"{2000 + i % 20}:0{i % 9 + 1}:15 10:20:30", "Artist": f"A{i % 4}",
    }
    gps = {"GPSLatitudeRef": "S" if i % 2 else "N", "GPSLatitude": [(i % 90, 1), (30, 1), (0, 1)], "GPSLongitudeRef": "W" if i % 3 == 0 else "E", "GPSLongitude": [(i % 180, 1), (15, 1), (0, 1)], "GPSAltitude": (i, 4)} if i % 4 else None
    return writers.jpeg(i % 4000 + 1, i % 3000 + 1, exif, gps)


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo.described(photo.read_photos(writers.files(_documents(spark, sf_dir), _photo)))


def _table_sql(code: str, names: dict[int, str], other: str = "NULL") -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE {other} END"


@query(f"""SELECT doc_id, 'Maker ' || doc_id % 5 AS make, 'M' || doc_id % 11 AS model, CASE WHEN doc_id % 2 = 1 THEN 'L' || doc_id % 3 END AS lens_model, {_table_sql('CASE WHEN doc_id % 10 = 0 THEN 1 ELSE doc_id % 10 END', photo.ORIENTATION, "'Unknown'")} AS orientation,
    {_table_sql('doc_id % 100', photo.FLASH, "'Unknown (' || doc_id % 100 || ')'")} AS flash, {_table_sql('doc_id % 8', photo.METERING)} AS metering_mode, {_table_sql('doc_id % 4', photo.EXPOSURE_MODE)} AS exposure_mode, {_table_sql('doc_id % 10', photo.EXPOSURE_PROGRAM)} AS exposure_program,
    {_table_sql('doc_id % 3', photo.WHITE_BALANCE)} AS white_balance, coalesce(source, 'none') AS description, coalesce(lang, 'none') AS user_comment, 'A' || doc_id % 4 AS artist, (2000 + doc_id % 20) || '-0' || (doc_id % 9 + 1) || '-15 10:20:30' AS taken FROM documents""")
def photo_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What photos say of camera, exposure and time, decoded."""
    names = ("make", "model", "lens_model", "orientation", "flash", "metering_mode", "exposure_mode", "exposure_program", "white_balance", "description", "user_comment", "artist")
    return photos(spark, sf_dir).select(F.col("photo_id").cast("long").alias("doc_id"), *names, F.date_format("taken", "yyyy-MM-dd HH:mm:ss").alias("taken"))


@query("""WITH v AS (SELECT doc_id, (doc_id % 4000 + 1)::INT AS width, (doc_id % 3000 + 1)::INT AS height, (doc_id % 40 + 2) / 2.0 AS slow FROM documents)
    SELECT doc_id, width, height, 'jpeg' AS format, round(width / height, 6) AS aspect_ratio, width::DOUBLE * height / 1e6 AS megapixels, CASE WHEN doc_id % 3 <> 0 THEN '1/' || (doc_id % 500 + 2) ELSE CASE WHEN slow % 1 = 0 THEN slow::INT::VARCHAR ELSE slow::DECIMAL(9, 1)::VARCHAR END || 's' END AS shutter_speed,
    (doc_id % 160 + 10) / 10.0 AS aperture, (100 * (doc_id % 8 + 1))::INT AS iso, (doc_id % 90 + 10)::DOUBLE AS focal_length, round((doc_id % 7 - 3) / 3.0, 6) AS exposure_bias FROM v""")
def photo_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and exposure numbers of photos."""
    rows = photos(spark, sf_dir)
    return rows.select(F.col("photo_id").cast("long").alias("doc_id"), "width", "height", "format", F.round("aspect_ratio", 6).alias("aspect_ratio"), "megapixels", "shutter_speed", "aperture", "iso", "focal_length", F.round("exposure_bias", 6).alias("exposure_bias"))


@query("""WITH v AS (SELECT doc_id, (doc_id % 90 + 0.5) * CASE WHEN doc_id % 2 = 1 THEN -1 ELSE 1 END AS lat, (doc_id % 180 + 0.25) * CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END AS lon FROM documents WHERE doc_id % 4 <> 0)
    SELECT doc_id, lat::DOUBLE AS latitude, lon::DOUBLE AS longitude, doc_id / 4.0 AS altitude, printf('%.6f, %.6f', lat::DOUBLE, lon::DOUBLE) AS coordinates,
    (doc_id % 90) || '°30''0.00"' || CASE WHEN doc_id % 2 = 1 THEN 'S' ELSE 'N' END || ' ' || (doc_id % 180) || '°15''0.00"' || CASE WHEN doc_id % 3 = 0 THEN 'W' ELSE 'E' END AS coordinates_dms FROM v""")
def photo_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where photos were taken."""
    return photos(spark, sf_dir).where("latitude is not null").select(F.col("photo_id").cast("long").alias("doc_id"), "latitude", "longitude", "altitude", "coordinates", "coordinates_dms")


# --- files of all formats --------------------------------------------------------------------------------------------

_FORMATS = ("epub", "docx", "pdf", "photo", "text")


def _any_file(r: dict) -> bytes:
    return (_book, _office, _described, _photo, lambda x: x["text"].encode())[r["doc_id"] % 5](r)


def any_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated files, of a format by the document's number."""
    suffix = F.element_at(F.array(*map(F.lit, (".epub", ".docx", ".pdf", ".jpg", ".txt"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = _documents(spark, sf_dir).withColumn("path", F.concat(F.lit("/in/f"), "path", suffix))
    found = writers.files(rows, _any_file).where("length > 0")
    return plans.files.validated(plans.files.identified(found))


@query(f"""WITH {_LINES}, v AS (SELECT *, {_STRIP.format("string_split(" + _STRIP.format('text') + ", chr(10))[1]")} AS line FROM d WHERE doc_id % 5 <> 4 OR text <> '')
    SELECT '/in/f' || doc_id || ['.epub', '.docx', '.pdf', '.jpg', '.txt'][doc_id % 5 + 1] AS path, ['epub', 'docx', 'pdf', 'photo', 'text'][doc_id % 5 + 1] AS parser_used, ['epub_', 'docx_', 'pdf_', 'photo_', 'text_'][doc_id % 5 + 1] || 'f' || doc_id || '-' || substring(sha1('/in/f' || doc_id || ['.epub', '.docx', '.pdf', '.jpg', '.txt'][doc_id % 5 + 1]), 1, 8) AS document_id,
    CASE doc_id % 5 WHEN 0 THEN 'Book ' || doc_id WHEN 1 THEN 'Report ' || doc_id WHEN 2 THEN 'Paper ' || doc_id WHEN 3 THEN 'f' || doc_id ELSE CASE WHEN length(line) BETWEEN 1 AND 99 THEN line ELSE 'f' || doc_id END END AS title,
    CASE doc_id % 5 WHEN 0 THEN doc_id % 3 WHEN 2 THEN (doc_id % 30 >= 10)::INT ELSE 0 END::BIGINT AS images FROM v""")
def files_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of five formats as documents under one schema."""
    docs, _ = plans.parse_files(any_files(spark, sf_dir), formats=list(_FORMATS), chapters=False)
    return docs.select("path", "processing_info.parser_used", "document_id", "metadata.title", F.size("images").cast("long").alias("images"))


# --- services of models ----------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT doc_id, lower('Status ' || (390 + doc_id % 220) || ': ' || coalesce(text, '')) AS said FROM documents)
    SELECT doc_id, NOT list_bool_or(list_transform(['401', '403', '400', '404', 'invalid api key', 'authentication', 'unauthorized', 'forbidden'], lambda x: contains(said, x)))
        AND list_bool_or(list_transform(['rate limit', '429', '500', '502', '503', '504', 'timeout', 'connection', 'network'], lambda x: contains(said, x))) AS again FROM m""")
def errors_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which errors of a service are worth another try."""
    said = F.concat(F.lit("Status "), F.col("doc_id") % 220 + 390, F.lit(": "), "text")
    return _documents(spark, sf_dir).select("doc_id", ai.retriable_message(said).alias("again"))


_PROVIDERS = ("anthropic", "openai", "cloudflare")


@query("""WITH p AS (SELECT doc_id, coalesce(text, '') AS text, ['anthropic', 'openai', 'cloudflare'][doc_id % 3 + 1] AS provider FROM documents)
    SELECT doc_id, provider, CASE WHEN provider = 'cloudflare' THEN NULL ELSE 'some-model' END AS model, 512::BIGINT AS max_tokens, CASE WHEN provider = 'anthropic' THEN 'You sort.' END AS system_field, CASE WHEN provider = 'anthropic' THEN 'user' ELSE 'system' END AS first_role,
        CASE WHEN provider = 'anthropic' THEN 1 ELSE 2 END::BIGINT AS messages, md5('Sort: ' || text) AS prompt_md5 FROM p""")
def service_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of calls to three services, read back."""
    rows = _documents(spark, sf_dir).withColumn("prompt", F.concat(F.lit("Sort: "), "text"))
    out = None
    for k, p in enumerate(_PROVIDERS):
        part = rows.where(F.col("doc_id") % 3 == k).select("doc_id", F.lit(p).alias("provider"), ai.request(p, "prompt", "some-model", "You sort.", max_tokens=512).alias("body"))
        out = part if out is None else out.unionByName(part)
    read = F.from_json("body", "model string, max_tokens long, system string, messages array<struct<role:string,content:string>>")
    return out.select("doc_id", "provider", read.alias("b")).select("doc_id", "provider", "b.model", "b.max_tokens", F.col("b.system").alias("system_field"), F.col("b.messages")[0]["role"].alias("first_role"), F.size("b.messages").cast("long").alias("messages"), F.md5(F.element_at("b.messages", -1)["content"]).alias("prompt_md5"))


@query("""SELECT doc_id, ['anthropic', 'openai', 'cloudflare'][doc_id % 3 + 1] AS provider, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE md5(coalesce(text, '')) END AS reply_md5 FROM documents""")
def service_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of three services' answers; an answer of another form has none."""
    t = F.col("text")
    bodies = {
        "anthropic": F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content"))),
        "openai": F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), t.alias("content")).alias("message"))).alias("choices"))),
        "cloudflare": F.to_json(F.struct(F.lit(True).alias("success"), F.struct(t.alias("response")).alias("result"))),
    }
    out = None
    for k, p in enumerate(_PROVIDERS):
        body = F.when(F.col("doc_id") % 7 == 0, F.lit('{"success":false,"error":"x"}')).otherwise(bodies[p])
        part = _documents(spark, sf_dir).where(F.col("doc_id") % 3 == k).select("doc_id", F.lit(p).alias("provider"), F.md5(ai.response_text(p, body)).alias("reply_md5"))
        out = part if out is None else out.unionByName(part)
    return out


_MODELS = ("gpt-4o", "gpt-4", "llava:13b", "llava-next", "claude-3-opus-20240229", "claude-2", "bakllava:x")


@query(f"""WITH m AS (SELECT doc_id, ['anthropic', 'openai', 'ollama', 'lmstudio'][doc_id % 4 + 1] AS provider, {list(_MODELS)}[doc_id % 7 + 1] AS model FROM documents)
    SELECT doc_id, provider, model, model IN {ai.VISION_MODELS} OR provider = 'lmstudio' OR (provider = 'ollama' AND (starts_with(model, 'llava') OR starts_with(model, 'bakllava'))) AS vision FROM m""")
def models_with_vision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which models take images."""
    at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % n + 1).cast("int"))
    return ai.with_vision(_documents(spark, sf_dir).select("doc_id", at(("anthropic", "openai", "ollama", "lmstudio"), 4).alias("provider"), at(_MODELS, 7).alias("model")))


# --- codes in images -------------------------------------------------------------------------------------------------


def _told(data: bytes) -> list[dict]:
    """A stand-in for a decoder of pixels: codes that are told in the bytes."""
    return [{"type": "QRCODE" if k % 3 else "EAN13", "data": x, "x": k, "y": 0, "width": 9, "height": 9} for k, x in enumerate(data.split(b"\n"))]


@query(f"""WITH {_LINES}, l AS (SELECT doc_id, unnest(lines) AS raw_data, unnest(range(len(lines))) AS k FROM d)
    SELECT doc_id, 'qr_' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS qr_id, md5(raw_data) AS data_md5, k::INT AS x FROM l WHERE k % 3 <> 0""")
def codes_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that a decoder finds in images, numbered; of several kinds only one counts."""
    pictures = _documents(spark, sf_dir).select("doc_id", F.lit(1).alias("page_number"), F.col("text").cast("binary").alias("content")).where(F.length("content") > 0)
    return qr.numbered(qr.decoded(pictures, _told)).select("doc_id", "qr_id", F.md5("raw_data").alias("data_md5"), "x")


# --- headings set into texts -----------------------------------------------------------------------------------------


@query(f"""{_PLACES}, h AS (SELECT doc_id, count(*) FILTER (WHERE t <> '') AS spans, count(*) FILTER (WHERE t <> '' AND k % 10 = 0) AS big FROM s GROUP BY doc_id) SELECT doc_id, spans::BIGINT AS spans, big::BIGINT AS big FROM h WHERE spans > 0""")
def described_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and large spans of page-described documents, from which headings are found."""
    rows = pdf.spans(described(spark, sf_dir)).where("font_size <> 9")
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("spans"), F.sum(F.col("is_bold").cast("long")).alias("big"))
