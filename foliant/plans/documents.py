"""From files to documents: one branch for each format, united under one schema.

A branch reads only its own files, and parts that nobody asks for (images, chapters) are pruned. Files that
can't be parsed are in ``errors``. Ids come from the file's path, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import parsing_options
from ..functions import markdown as md
from ..functions import text as tx
from ..models import CHAPTER, IMAGE, QR_CODE, metadata_struct, with_chapters
from ..operators import chapters as ch
from ..operators import frontmatter, html, images
from ..sources import docx, epub, files, pdf, photo

VERSION = "1.0.0"


def _document(rows: DataFrame, parser: str, id_: Column, content: Column, words: Column, minutes: Column, metadata: Column, warnings: Column) -> DataFrame:
    info = F.struct(
        F.lit(parser).alias("parser_used"), F.lit(VERSION).alias("parser_version"), F.lit(0.0).alias("processing_time"), F.current_timestamp().alias("timestamp"), warnings.alias("warnings"),
        F.create_map().cast("map<string,string>").alias("options_used"),
    )
    return rows.select(
        id_.alias("document_id"), F.col("path"), content.alias("content"), F.array().cast(f"array<{IMAGE}>").alias("images"), metadata.alias("metadata"), info.alias("processing_info"), words.cast("bigint").alias("word_count"),
        minutes.alias("estimated_reading_time"), F.array().cast(f"array<{QR_CODE}>").alias("qr_codes"),
    )


def _full_id(prefix: str) -> Column:
    """Prefix and stem; files of one name in several folders are told apart by a hash of the path."""
    return F.concat(F.lit(prefix), F.col("file_stem"), F.lit("-"), F.substring(F.sha1("path"), 1, 8))


def _with_images(docs: DataFrame, rows: DataFrame | None, options: dict) -> DataFrame:
    """``docs`` with their image rows (path, image_id, position, file_path, alt_text, width, height, format) as one array in order."""
    if rows is None:
        return docs
    folder = options.get("image_output_dir")
    path = F.concat(F.lit(folder.rstrip("/") + "/"), "file_path") if folder else F.col("file_path")
    size = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.struct("width", "height")).alias("size")
    one = F.struct("image_id", "position", path.alias("file_path"), "alt_text", size, "format")
    grouped = rows.groupBy("path").agg(F.array_sort(F.collect_list(one)).cast(f"array<{IMAGE}>").alias("found"))
    return docs.join(grouped, "path", "left").withColumn("images", F.coalesce("found", "images")).select(*docs.columns)


def _container_images(read: DataFrame, id_col: str, base: str | None) -> DataFrame:
    """Image rows of what a reader gave, with content; those with a problem are left out."""
    kept = images.extracted(read, id_col, base=base).where(F.col("problem").isNull() | (F.col("problem") == "no image"))
    return kept.select(F.col(id_col).alias("path"), "image_id", "position", F.col("file_name").alias("file_path"), F.lit(None).cast("string").alias("alt_text"), "width", "height", "format", "content")


def _page_images(read: DataFrame) -> DataFrame:
    rows = images.sized(pdf.images(read).drop("width", "height").where("content is not null"))
    kind = F.when(F.col("format") == "unknown", F.lit("png")).otherwise(F.col("format"))
    name = F.concat(F.lit("img_"), F.substring("image_id", -3, 3), F.lit("."), kind)
    return rows.select(F.col("doc_id").alias("path"), "image_id", "position", name.alias("file_path"), "alt_text", "width", "height", "format", "content")


def image_files(found: DataFrame, most_pages: int | None = None) -> DataFrame:
    """Images with their bytes of validated e-books, office and page-described files: (path, image_id, position, file_path, alt_text, width, height, format,
    content, file_name), as ``writers.save`` takes them; file_name puts each file's images below a folder of its own."""
    of = lambda parser: found.where((F.col("parser") == parser) & F.col("error").isNull())
    rows = _container_images(epub.read_books(of("epub")), "book_id", None).unionByName(_container_images(docx.read_documents(of("docx")), "doc_id", "image")).unionByName(_page_images(pdf.read_pdfs(of("pdf"), max_pages=most_pages)))
    return rows.withColumn("file_name", F.concat(F.substring(F.sha1("path"), 1, 8), F.lit("/"), "file_path"))


def _once(read: DataFrame) -> DataFrame:
    """What a reader gave, kept on the executors' disks: documents, chapters and images come from one reading of each file. What a lost
    executor kept is read again."""
    _kept.append(read.persist(StorageLevel.DISK_ONLY))
    return read


_kept: list[DataFrame] = []


@contextmanager
def released() -> Iterator[None]:
    """What is read within is let go at the end: for one batch after the other, as in a stream."""
    n = len(_kept)
    try:
        yield
    finally:
        for read in _kept[n:]:
            read.unpersist()
        del _kept[n:]


def text_documents(found: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    rows = files.texts(found)
    n = tx.word_count("text")
    encoding = F.try_element_at(F.filter("warnings", lambda w: F.contains(w, F.lit("encoding"))), F.lit(1))
    meta = metadata_struct(
        title=tx.first_line_title("text", F.col("file_stem")), original_format=F.lit("text"), file_size=F.col("length"),
        custom_fields=F.map_filter(F.create_map(F.lit("line_count"), F.size(tx.lines("text")).cast("string"), F.lit("encoding"), encoding), lambda _, v: v.isNotNull()),
    )
    docs = _document(rows, "text", _full_id("text_"), F.col("text"), n, tx.minutes_up(n), meta, F.col("warnings"))
    parts = ch.text_chapters(docs.select("document_id", F.col("content").alias("text")), "document_id") if options["detect_chapters"] else None
    return docs, parts


def markdown_documents(found: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    rows = frontmatter.metadata(frontmatter.extracted(files.texts(found).drop("content")), "file_stem")
    body = md.normalised("body")
    rows = rows.withColumn("body", body)
    n = md.markdown_word_count("body")
    fields = ("title", "author", "authors", "publisher", "publication_date", "language", "isbn", "description", "tags", "custom_fields")
    meta = metadata_struct(original_format=F.lit("markdown"), file_size=F.col("length"), **{f: F.col(f) for f in fields})
    docs = _document(rows, "markdown", _full_id("markdown_"), F.col("body"), n, tx.minutes_up(n), meta, F.concat("warnings", "front_warnings"))
    parts = ch.heading_chapters(docs.select("document_id", F.col("content").alias("text")), "document_id") if options["detect_chapters"] else None
    if options["extract_images"]:
        found_images = images.markdown_images(docs.select("document_id", F.col("content").alias("text"), F.regexp_replace("path", r"/[^/]*\z", "").alias("folder")), "document_id", "text", "folder")
        size = F.lit(None).cast("struct<width:int,height:int>").alias("size")
        grouped = found_images.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("image_id", "position", "file_path", "alt_text", size, "format"))).cast(f"array<{IMAGE}>").alias("found"))
        docs = docs.join(grouped, "document_id", "left").withColumn("images", F.coalesce("found", "images")).drop("found")
    return docs, parts


def html_documents(found: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    rows = files.texts(found).select("path", "file_stem", "length", F.col("warnings").alias("file_warnings"), "text")
    kept = ["path", "file_stem", "length", "file_warnings"]
    read = _once(html.read_pages(rows, kept, "text", ["title", "lang", "metas", "images", "markdown", "warnings"]))
    joined = html.metadata(read, [*kept, "markdown", "warnings"]).select(*kept, "markdown", "warnings", *[F.col(c).alias(f"m_{c}") for c in ("title", "author", "publisher", "publication_date", "language", "description", "tags")])
    n = tx.word_count("markdown")
    meta = metadata_struct(original_format=F.lit("html"), file_size=F.col("length"), **{c: F.col(f"m_{c}") for c in ("title", "author", "publisher", "publication_date", "language", "description", "tags")})
    docs = _document(joined, "html", _full_id("html_"), F.col("markdown"), n, tx.minutes_even(n), meta, F.concat("file_warnings", "warnings"))
    if options["extract_images"]:
        url = F.when(F.col("path").rlike(r"(?i)\Ahttps?://"), F.col("path"))
        docs = _with_images(docs, html.image_rows(read.withColumn("page_url", url), "path", "page_url").select("path", "image_id", "position", "file_path", "alt_text", "size.width", "size.height", "format"), {})
    return docs, ch.heading_chapters(docs.select("document_id", F.col("content").alias("text")), "document_id") if options["detect_chapters"] else None


def epub_documents(found: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    books = _once(epub.read_books(found, images=options["extract_images"]))
    ids = found.select(F.col("path").alias("book_id"), "path", "file_stem", "length", F.col("warnings").alias("file_warnings"))
    content = ch.joined_content(epub.spine(books))
    rows = books.select("book_id", "warnings").join(ids, "book_id").join(content, "book_id", "left").join(epub.metadata(books), "book_id")
    n = F.coalesce(tx.word_count("content"), F.lit(0))
    fields = ("title", "author", "authors", "publisher", "publication_date", "language", "isbn", "description", "tags")
    meta = metadata_struct(original_format=F.lit("epub"), file_size=F.col("length"), **{f: F.col(f) for f in fields})
    docs = _document(rows, "epub", _full_id("epub_"), F.coalesce("content", F.lit("")), n, tx.minutes_even(n), meta, F.concat("file_warnings", "warnings"))
    if options["extract_images"]:
        docs = _with_images(docs, _container_images(books, "book_id", None), options)
    parts = None
    if options["detect_chapters"]:
        found_parts = epub.chapters(books, options["use_toc"], options["use_spine_fallback"], options["min_chapter_length"])
        parts = found_parts.join(docs.select(F.col("path").alias("book_id"), "document_id"), "book_id").drop("book_id")
    return docs, parts


def docx_documents(found: DataFrame, options: dict) -> tuple[DataFrame, None]:
    saved = options["extract_images"] and bool(options.get("image_output_dir"))  # without a folder to save them in, office documents name no images
    read = _once(docx.read_documents(found, formatting=options["preserve_formatting"], links=options["extract_hyperlinks"], lists=options["extract_lists"], images=saved))
    ids = found.select(F.col("path").alias("doc_id"), "path", "file_stem", "length", F.col("warnings").alias("file_warnings"))
    rows = read.select("doc_id", "content", "warnings").join(docx.metadata(read), "doc_id").join(ids, "doc_id")
    n = F.coalesce(tx.word_count(md.office_plain("content")), F.lit(0))
    meta = metadata_struct(
        title=F.col("title"), author=F.col("author"), description=F.col("description"), tags=F.col("tags"), publication_date=F.col("publication_date"), original_format=F.lit("docx"), file_size=F.col("length"),
        custom_fields=F.map_filter(F.create_map(F.lit("last_modified_by"), F.col("last_modified_by")), lambda _, v: v.isNotNull()),
    )
    docs = _document(rows, "docx", _full_id("docx_"), F.coalesce("content", F.lit("")), n, tx.minutes_even(n), meta, F.concat("file_warnings", "warnings"))
    return (_with_images(docs, _container_images(read, "doc_id", "image"), options) if saved else docs), None


def pdf_documents(found: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    """Spans joined by spaces; headings by font set into the text; tables after it; chapters cut before cleaning, so places refer to the uncleaned text."""
    read = _once(pdf.read_pdfs(found, max_pages=options.get("max_pages"), ocr=options.get("ocr") if options["use_ocr"] else None, images=options["extract_images"], seconds=options.get("timeout"), ocr_seconds=options["ocr_timeout"]))
    spans = pdf.spans(read)
    joined = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "span_idx", "text"))).alias("s")).select("doc_id", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("raw"))
    heads = ch.font_headings(spans).groupBy("doc_id").agg(F.collect_list(F.struct("title", "level", "position")).alias("heads"))
    ids = found.select(F.col("path").alias("doc_id"), "path", "file_stem", "length", F.col("warnings").alias("file_warnings"))
    rows = read.select("doc_id", "warnings", pdf.tables_text().alias("tables")).join(pdf.metadata(read), "doc_id").join(ids, "doc_id").join(joined, "doc_id", "left").join(heads, "doc_id", "left")
    none = F.array().cast("array<struct<title:string,level:int,position:bigint>>")
    rows = rows.withColumn("marked", ch.with_headings(F.coalesce("raw", F.lit("")), F.coalesce("heads", none)))
    content = tx.cleaned("marked") if options["clean_text"] else F.col("marked")
    if options["extract_tables"]:
        content = F.when(F.col("tables") != "", F.concat(content, F.lit("\n\n"), "tables")).otherwise(content)
    n = tx.word_count(content)
    meta = metadata_struct(
        title=F.coalesce("title", "file_stem"), author=F.col("author"), description=F.col("description"), tags=F.col("tags"), publication_date=F.col("publication_date"), original_format=F.lit("pdf"), file_size=F.col("length"), custom_fields=F.col("custom_fields"),
    )
    docs = _document(rows, "pdf", _full_id("pdf_"), content, n, tx.minutes_down(n), meta, F.concat("file_warnings", "warnings"))
    if options["extract_images"]:
        docs = _with_images(docs, _page_images(read), options)
    if decode := options.get("decode"):
        docs = _with_codes(docs, pdf.scanned_codes(read, decode))
    parts = None
    if options["detect_chapters"]:
        cut = ch.heading_chapters(rows.select("path", "marked"), "path", "marked", 1, 3)
        parts = cut.join(docs.select("path", "document_id"), "path").drop("path").withColumn("content", tx.cleaned("content") if options["clean_text"] else F.col("content"))
    return docs, parts


def _with_codes(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """``docs`` with the codes of their pages; nothing is fetched here (``qr.candidates`` and ``qr.processed`` do that)."""
    place = F.struct("x", "y", "width", "height").alias("position")
    one = F.struct("qr_id", "raw_data", "data_type", "source_image", place, F.col("page_number").cast("int"), F.lit(None).cast("string").alias("fetched_content"), "fetch_status", F.array().cast("array<string>").alias("fetch_notes"))
    grouped = codes.groupBy(F.col("doc_id").alias("path")).agg(F.array_sort(F.collect_list(one)).cast(f"array<{QR_CODE}>").alias("found"))
    return docs.join(grouped, "path", "left").withColumn("qr_codes", F.coalesce("found", "qr_codes")).select(*docs.columns)


def photo_documents(found: DataFrame, options: dict) -> tuple[DataFrame, None]:
    seen = photo.described(photo.read_photos(found))
    ids = found.select(F.col("path").alias("photo_id"), "path", "file_stem", "length", F.col("warnings").alias("file_warnings"))
    rows = seen.select("photo_id", "warnings", "artist", "taken", "description", "exif").join(photo.markdown(seen), "photo_id").join(ids, "photo_id")
    meta = metadata_struct(title=F.col("file_stem"), author=F.col("artist"), publication_date=F.col("taken"), description=F.col("description"), original_format=F.lit("photo"), file_size=F.col("length"), custom_fields=F.col("exif"))
    return _document(rows, "photo", _full_id("photo_"), F.col("content"), tx.word_count("content"), F.lit(1).cast("bigint"), meta, F.concat("file_warnings", "warnings")), None


BRANCHES: dict[str, Callable] = {"text": text_documents, "markdown": markdown_documents, "html": html_documents, "epub": epub_documents, "docx": docx_documents, "pdf": pdf_documents, "photo": photo_documents}


def parse(spark: SparkSession, path: str, options: dict | None = None, formats: list[str] | None = None, chapters: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of the files below ``path``. documents have the columns of ``models.DOCUMENT`` and ``path``."""
    found = files.validated(files.identified(files.scan(spark, path)))
    return parse_files(found, options, formats, chapters)


def parse_files(found: DataFrame, options: dict | None = None, formats: list[str] | None = None, chapters: bool = True) -> tuple[DataFrame, DataFrame]:
    """As ``parse``, of validated files (also of one batch of a stream)."""
    out = None
    for name in formats or BRANCHES:
        chosen = parsing_options(name, user=options) | ({"detect_chapters": False} if not chapters else {})
        docs, parts = BRANCHES[name](found.where((F.col("parser") == name) & F.col("error").isNull()), chosen)
        docs = with_chapters(docs, parts) if parts is not None else docs.withColumn("chapters", F.array().cast(f"array<{CHAPTER}>"))
        out = docs if out is None else out.unionByName(docs)
    unread = F.coalesce("error", F.when(~F.col("parser").isin(*(formats or BRANCHES)), F.concat(F.lit("no reader here for "), "parser")))
    errors = found.withColumn("error", unread).where("error is not null").select("path", "parser", "error")
    return out, errors
