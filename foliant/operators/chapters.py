"""Chapters: headings, chapter markers, spine and contents joins, heading fonts. Windows run within a document.

Every function takes rows with an id and a text and gives chapter rows:
(id, chapter_id, title, content, start_position, end_position, word_count, level, ...). Positions count
characters from 0. A null text gives no chapters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import HEADING, found_with_places
from ..functions.text import SPACE, first_line_title, is_blank, lines, strip, word_count

# Chapter markers of plain text, tried in this order on the stripped line, in any case.
MARKERS = (
    (r"Chapter\s+(\d+)", "Chapter"),
    (r"Chapter\s+(One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve|Thirteen|Fourteen|Fifteen|Sixteen|Seventeen|Eighteen|Nineteen|Twenty)", "Chapter"),
    (r"CHAPTER\s+(\d+|[IVX]+)", "Chapter"),
    (r"Part\s+(\d+|[IVX]+|One|Two|Three|Four|Five)", "Part"),
    (r"Section\s+(\d+|[A-Z])", "Section"),
    (r"([IVX]+)\.\s+[A-Z]", "Section"),
    (r"(\d+)\.\s+[A-Z][a-z]+", "Chapter"),
)
#: The page count that a heading's title may have, in words.
MAX_HEADING_WORDS = 25


def _marker(pattern: str) -> str:
    return r"(?iu)\A" + pattern.replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}")


def headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, level, title) of every # heading, in code blocks too."""
    found = docs.select(id_col, F.explode(found_with_places(F.col(text_col), HEADING)).alias("h"))
    mark = F.regexp_extract("h.match", rf"\A(#{{1,6}}){SPACE}+", 1)
    title = strip(F.regexp_replace("h.match", rf"\A#{{1,6}}{SPACE}+", ""))
    return found.select(id_col, F.col("h.position").alias("position"), F.length(mark).alias("level"), title.alias("title"))


def heading_chapters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_level: int = 1, max_level: int = 2) -> DataFrame:
    """A chapter from each heading of the levels to the next such heading, or the text's end. What stands before the first
    is in none. Text without such headings is one chapter, ``Full Document`` (auto_generated); blank text has none.

    Native: the headings of a document are one array, so no join or shuffle is needed.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(~is_blank("text")).withColumn("kept", heading_marks(F.col("text"), min_level, max_level))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("position"), F.lit(1).alias("level"), F.lit("Full Document").alias("title")))
    base = base.withColumn("auto", F.size("kept") == 0).withColumn("kept", F.when(F.size("kept") == 0, whole).otherwise(F.col("kept")))
    # each chapter's text is cut out before the rows are made, so no row carries the whole text
    cut = """transform(kept, (h, i) -> struct(h.position AS start, coalesce(get(kept, i + 1).position, cast(length(text) AS bigint)) AS end, h.level AS level, h.title AS title,
        substring(text, cast(h.position AS int) + 1, cast(coalesce(get(kept, i + 1).position, length(text)) - h.position AS int)) AS content))"""
    rows = base.select("id", "auto", F.posexplode(F.expr(cut)).alias("i", "c"))
    content = F.when(F.col("auto"), F.col("c.content")).otherwise(strip(F.col("c.content")))
    return rows.select(
        F.col("id").alias(id_col), (F.col("i") + 1).cast("long").alias("chapter_id"), F.col("c.title").alias("title"), content.alias("content"), F.col("c.start").alias("start_position"), F.col("c.end").alias("end_position"),
        word_count(content).alias("word_count"), F.col("c.level").alias("level"), F.col("auto").alias("auto_generated"),
    )


def heading_marks(text: Column, min_level: int = 1, max_level: int = 2) -> Column:
    """array<struct<position, level, title>> of the # headings of the levels."""
    title = lambda h: strip(F.regexp_replace(h["match"], rf"\A#{{1,6}}{SPACE}+", ""))
    level = lambda h: F.length(F.regexp_extract(h["match"], r"\A(#{1,6})", 1))
    found = F.transform(found_with_places(text, HEADING), lambda h: F.struct(h["position"].alias("position"), level(h).alias("level"), title(h).alias("title")))
    return F.filter(found, lambda h: h["level"].between(min_level, max_level))


def heading_chapter_count(text: Column, min_level: int = 1, max_level: int = 2) -> Column:
    """How many chapters ``heading_chapters`` makes of a text."""
    return F.when(is_blank(text) | text.isNull(), F.lit(0)).otherwise(F.greatest(F.size(heading_marks(text, min_level, max_level)), F.lit(1))).cast("long")


def marker_type(line: Column) -> Column:
    """Type of the first marker that the stripped line begins with; null if none."""
    out = F.when(strip(line) == "", F.lit(None).cast("string"))
    for pattern, kind in MARKERS:
        out = out.when(strip(line).rlike(_marker(pattern)), kind)
    return out


def _after(acc: Column, line: Column) -> Column:
    """The fold's state at a line: its place, from that of an earlier line and the lines between."""
    between = F.slice("lines", acc["line"] + 1, line - acc["line"])
    at = (acc["at"] + F.length(F.array_join(between, "\n")) + F.when(line > acc["line"], 1).otherwise(0)).cast("bigint")
    return F.struct(at.alias("at"), line.cast("int").alias("line"), F.concat(acc["all"], F.array(at)).alias("all"))


def text_chapters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A chapter from each marker line to the line before the next. What stands before the first is in none, and the last
    ends one past the text. With fewer than two markers the text is one chapter; blank text is one without words.

    A document's lines are one array: offsets and next markers come from array functions, without a shuffle.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").withColumn("lines", lines("text"))
    marks = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("line"), strip(x).alias("title"), marker_type(x).alias("type"))), lambda m: m["type"].isNotNull())
    base = base.withColumn("marks", marks)
    # places of the marker lines only: each adds up the lines since the one before, so a text's lines are measured once
    starts = F.aggregate(
        "marks",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("line"), F.array().cast("array<bigint>").alias("all")),
        lambda acc, m: _after(acc, m["line"]),
    )["all"]
    many = base.where("size(marks) > 1").withColumn("starts", starts)
    # each segment's lines are joined before the rows are made, so no row carries all lines
    cut = """transform(marks, (m, i) -> struct(m.line AS line, m.title AS title, m.type AS type, get(starts, i) AS start, coalesce(get(starts, i + 1), cast(length(text) + 1 AS bigint)) AS end,
        array_join(slice(lines, m.line + 1, coalesce(get(marks, i + 1).line, size(lines)) - m.line), '\n') AS content))"""
    rows = many.select("id", F.posexplode(F.expr(cut)).alias("i", "m"))
    content = strip(F.col("m.content"))
    segments = rows.select(
        "id", (F.col("i") + 1).cast("long").alias("chapter_id"), F.col("m.title").alias("title"), content.alias("content"), F.col("m.start").alias("start_position"), F.col("m.end").alias("end_position"),
        word_count(content).alias("word_count"), F.lit(1).alias("level"), F.col("m.type").alias("chapter_type"), F.col("m.line").cast("long").alias("line_number"),
    )
    whole = base.where("size(marks) < 2").select(
        "id", F.lit(1).cast("long").alias("chapter_id"), first_line_title("text", "Document").alias("title"), F.col("text").alias("content"), F.lit(0).cast("long").alias("start_position"), F.length("text").cast("long").alias("end_position"),
        word_count("text").alias("word_count"), F.lit(1).alias("level"), F.lit("single").alias("chapter_type"), F.lit(0).cast("long").alias("line_number"),
    )
    return segments.unionByName(whole).withColumnRenamed("id", id_col)


def spine_chapters(spine: DataFrame, book_col: str = "book_id", order_col: str = "spine_idx", title_col: str = "item_title", text_col: str = "text", file_col: str | None = None) -> DataFrame:
    """A chapter for each spine document with text, with its place in the book's content (documents joined by a blank line).

    The title is the item's, else ``Chapter n``. ``file_col`` is carried for the contents join.
    """
    w = Window.partitionBy(book_col).orderBy(order_col)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    text = F.col(text_col)
    kept = spine.where(~is_blank(text))
    start = F.coalesce(F.sum(F.length(text) + 2).over(before), F.lit(0)).cast("long")
    number = F.row_number().over(w).cast("long")
    carried = [F.col(file_col).alias("file_name")] if file_col else []
    return kept.select(
        book_col, number.alias("chapter_id"), F.coalesce(F.nullif(strip(F.col(title_col)), F.lit("")), F.concat(F.lit("Chapter "), number)).alias("title"), text.alias("content"), start.alias("start_position"), (start + F.length(text)).alias("end_position"),
        word_count(text).alias("word_count"), F.lit(1).alias("level"), *carried,
    )


def joined_content(spine: DataFrame, book_col: str = "book_id", order_col: str = "spine_idx", text_col: str = "text") -> DataFrame:
    """(book, content): the spine's texts in order, with a blank line between. A book is one row, as its content is one value."""
    rows = spine.where(~is_blank(F.col(text_col))).groupBy(book_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t")))).alias("all"))
    return rows.select(book_col, F.array_join(F.transform("all", lambda x: x["t"]), "\n\n").alias("content"))


def contents_chapters(spine: DataFrame, toc: DataFrame, book_col: str = "book_id", order_col: str = "spine_idx", text_col: str = "text", file_col: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """(chapters, misses) of a table of contents (book, ord, level, title, href) over a spine.

    An entry begins where its file does (the anchor is not read) and ends where the next entry begins, or at the content's
    end if that entry's file is unknown or there is none. Entries whose file isn't in the spine are misses.
    """
    places = spine_chapters(spine, book_col, order_col, file_col, text_col, file_col).select(book_col, "file_name", F.col("start_position").alias("start"))
    content = joined_content(spine, book_col, order_col, text_col)
    entries = toc.withColumn("file_name", F.regexp_extract("href", r"\A([^#]*)", 1))
    located = entries.join(places, [book_col, "file_name"], "left")
    w = Window.partitionBy(book_col).orderBy("ord")
    ended = located.withColumn("next_start", F.lead("start").over(w))
    hit = ended.where("start is not null").join(content, book_col)
    end = F.coalesce("next_start", F.length("content").cast("long"))
    text = F.expr("substring(content, cast(start as int) + 1, greatest(cast(coalesce(next_start, length(content)) - start as int), 0))")
    chapters = hit.select(
        book_col, F.row_number().over(w).cast("long").alias("chapter_id"), "title", strip(text).alias("content"), F.col("start").alias("start_position"), end.alias("end_position"),
        word_count(text).alias("word_count"), "level",
    )
    return chapters, located.where("start is null").select(book_col, "ord", "title", "href")


def postprocessed(chapters: DataFrame, id_col: str, min_words: int = 100) -> DataFrame:
    """Chapters of ``min_words`` or more; a title seen before gets `` (2)``, `` (3)`` and so on; numbered anew."""
    order = Window.partitionBy(id_col).orderBy("chapter_id")
    same = Window.partitionBy(id_col, "title").orderBy("chapter_id")
    kept = chapters.where(F.col("word_count") >= min_words).withColumn("__nth", F.row_number().over(same))
    title = F.when(F.col("__nth") == 1, F.col("title")).otherwise(F.concat("title", F.lit(" ("), F.col("__nth"), F.lit(")")))
    return kept.withColumn("title", title).withColumn("chapter_id", F.row_number().over(order).cast("long")).drop("__nth")


def font_headings(spans: DataFrame, doc_col: str = "doc_id", max_words: int = MAX_HEADING_WORDS) -> DataFrame:
    """Spans (doc, span_idx, text, font_size, is_bold) that are headings, with level and position.

    Size at least mean + 1.5 sample deviations, or bold and above the mean; 1 to ``max_words`` words. The level is the
    rank of the size among the document's sizes, 6 at most. Positions run over the spans' texts with a space between;
    of spans with one place and text, the largest comes first, then bold before plain, whatever order they arrive in.
    """
    doc = Window.partitionBy(doc_col)
    order = doc.orderBy("page_num", "span_idx", "text", F.desc("font_size"), F.desc("is_bold")).rowsBetween(Window.unboundedPreceding, -1)
    stats = spans.withColumn("mean", F.avg("font_size").over(doc)).withColumn("dev", F.coalesce(F.stddev_samp("font_size").over(doc), F.lit(0.0)))
    ranked = stats.withColumn("level", F.least(F.dense_rank().over(doc.orderBy(F.desc("font_size"))), F.lit(6))).withColumn("position", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0)).cast("long"))
    large = (F.col("font_size") >= F.col("mean") + 1.5 * F.col("dev")) | (F.col("is_bold") & (F.col("font_size") > F.col("mean")))
    return ranked.where(large & word_count("text").between(1, max_words)).select(doc_col, "page_num", "span_idx", strip("text").alias("title"), "level", "position")


def with_headings(text: Column, found: Column) -> Column:
    """``text`` with each heading (array<struct<title, level, position>>) set as a # heading: at its place within 100
    characters, else at its first occurrence; from the last to the first, so that places stay right."""

    def put(acc: Column, h: Column) -> Column:
        low = F.greatest(h["position"].cast("int") - 100, F.lit(0))
        near = F.call_function("locate", h["title"], acc, low + 1)
        near = F.when((near > 0) & (near - 1 <= h["position"] + 100), near)
        at = F.coalesce(near, F.nullif(F.call_function("locate", h["title"], acc), F.lit(0)))
        mark = F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["title"], F.lit("\n\n"))
        return F.when(at.isNull(), acc).otherwise(F.concat(F.substring(acc, F.lit(1), at - 1), mark, F.substring(acc, at + F.length(h["title"]), F.length(acc))))

    return F.aggregate(F.reverse(F.array_sort(F.transform(found, lambda h: F.struct(h["position"].alias("position"), h["level"].alias("level"), h["title"].alias("title"))))), text, put)


def is_scanned(spans: DataFrame, doc_col: str = "doc_id", threshold: int = 100, pages: int = 3) -> DataFrame:
    """(doc, chars_per_page, scanned): fewer than ``threshold`` characters a page on the first pages."""
    per_page = spans.where(F.col("page_num") <= pages).groupBy(doc_col, "page_num").agg(F.sum(F.length(strip("text"))).alias("chars"))
    return per_page.groupBy(doc_col).agg(F.avg("chars").alias("chars_per_page")).withColumn("scanned", F.col("chars_per_page") < threshold)
