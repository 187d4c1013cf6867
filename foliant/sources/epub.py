"""E-books: the container as tables of spine, contents, metadata and images.

The zip container is opened with the standard library, one book a row; from the tables on, all is native.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import classify, text
from ..operators import chapters as ch
from ..operators.html import plain_text, tree

SCHEMA = """book_id string, spine array<struct<spine_idx:int,item_id:string,file_name:string,item_title:string,text:string>>,
toc array<struct<ord:int,level:int,title:string,href:string>>, dc array<struct<ord:int,name:string,value:string>>,
images array<struct<idx:int,file_name:string,content:binary>>, warnings array<string>"""


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _join(base: str, href: str) -> str:
    path, _, anchor = href.partition("#")
    full = posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(path))) if path else base
    return f"{full}#{anchor}" if anchor else full


def _contents(z: zipfile.ZipFile, name: str) -> list[dict]:
    """Entries of an NCX or navigation document, depth first."""
    out: list[dict] = []
    root = ElementTree.fromstring(z.read(name))

    def points(node, level):
        for p in node:
            if _local(p.tag) != "navPoint":
                continue
            label = next((t.text or "" for t in p.iter() if _local(t.tag) == "text"), "")
            src = next((c.get("src", "") for c in p if _local(c.tag) == "content"), "")
            out.append({"level": level, "title": label.strip(), "href": _join(name, src)})
            points(p, level + 1)

    def items(node, level):
        for li in (x for x in node if _local(x.tag) == "li"):
            for c in li:
                if _local(c.tag) in ("a", "span"):
                    out.append({"level": level, "title": "".join(c.itertext()).strip(), "href": _join(name, c.get("href", ""))})
                elif _local(c.tag) == "ol":
                    items(c, level + 1)

    for n in root.iter():
        if _local(n.tag) == "navMap":
            points(n, 1)
        elif _local(n.tag) == "nav" and any(v == "toc" for k, v in n.attrib.items() if _local(k) == "type"):
            for ol in (x for x in n if _local(x.tag) == "ol"):
                items(ol, 1)
    return [{"ord": i, **e} for i, e in enumerate(out)]


def read_book(data: bytes) -> dict:
    """One book's tables. Raises if the container or package can't be read; parts that are missing become warnings."""
    warnings: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        package = next(n.get("full-path") for n in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _local(n.tag) == "rootfile")
        root = ElementTree.fromstring(z.read(package))
        dc, items, order, ncx = [], {}, [], None
        for n in root.iter():
            tag = _local(n.tag)
            if n.tag.startswith("{http://purl.org/dc/elements/1.1/}"):
                dc.append({"ord": len(dc), "name": tag, "value": (n.text or "").strip()})
            elif tag == "item":
                items[n.get("id")] = (_join(package, n.get("href", "")), n.get("media-type", ""), n.get("properties") or "")
            elif tag == "spine":
                ncx = n.get("toc")
                order = [r.get("idref") for r in n if _local(r.tag) == "itemref"]
        spine = []
        for i, item in enumerate(order):
            path = items.get(item, ("", "", ""))[0]
            if path not in names:
                warnings.append(f"spine item {item} is missing")
                continue
            page = tree(z.read(path).decode("utf-8", "replace"))
            title = next((n.text().strip() for n in page.walk() if n.tag == "h1"), None)
            body = next((n for n in page.walk() if n.tag == "body"), page)
            spine.append({"spine_idx": i, "item_id": item, "file_name": path, "item_title": title or None, "text": plain_text(body)})
        toc: list[dict] = []
        nav = next((p for p, _, props in items.values() if "nav" in props.split()), None)
        for place in (items.get(ncx, (None,))[0] if ncx else None, nav):
            if place in names and not toc:
                try:
                    toc = _contents(z, place)
                except ElementTree.ParseError as e:
                    warnings.append(f"contents can't be read: {e}")
        images = [{"idx": i, "file_name": p, "content": z.read(p)} for i, (p, kind, _) in enumerate(items.values(), 1) if kind.startswith("image/") and p in names]
    return {"spine": spine, "toc": toc, "dc": dc, "images": images, "warnings": warnings}


def read_books(files: DataFrame, id_col: str = "path", content_col: str = "content", images: bool = True) -> DataFrame:
    """(book_id, spine, toc, dc, images, warnings) of every file; one that can't be read has a warning and nothing else."""
    names = ["spine", "toc", "dc", "images", "warnings"]

    kinds = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    row = read_book(data or b"")
                    if not images:
                        row["images"] = []
                except Exception as e:  # a bad book is a row with a warning
                    row = {**{n: [] for n in names}, "warnings": [f"{type(e).__name__}: {e}"]}
                yield pa.RecordBatch.from_arrays([pa.array([book], pa.string()), *[pa.array([row[n]], kinds.field(n).type) for n in names]], names=["book_id", *names])

    return files.select(F.col(id_col).cast("string"), content_col).mapInArrow(run, SCHEMA)


def metadata(books: DataFrame) -> DataFrame:
    """(book_id, title, author, authors, publisher, publication_date, language, isbn, description, tags) from Dublin Core elements."""
    values = lambda name: F.filter(F.transform(F.filter("dc", lambda d: d["name"] == name), lambda d: d["value"]), lambda v: v != "")
    first = lambda name: F.try_element_at(values(name), F.lit(1))
    return books.select(
        "book_id", F.coalesce(first("title"), F.lit("Untitled")).alias("title"), first("creator").alias("author"), values("creator").alias("authors"), first("publisher").alias("publisher"),
        classify.date_of(first("date"), classify.EBOOK_DATES).alias("publication_date"), first("language").alias("language"), classify.isbn(values("identifier")).alias("isbn"), first("description").alias("description"), values("subject").alias("tags"),
    )


def spine(books: DataFrame) -> DataFrame:
    return books.select("book_id", F.inline("spine")).withColumn("text", text.tidy_lines("text", 2))


def toc(books: DataFrame) -> DataFrame:
    return books.select("book_id", F.inline("toc"))


def chapters(books: DataFrame, use_toc: bool = True, spine_fallback: bool = True, min_words: int = 100) -> DataFrame:
    """Chapters by the contents where a book has any, else by its spine; short ones dropped, repeated titles told apart."""
    pages, parts = spine(books), []
    if use_toc:
        parts.append(ch.contents_chapters(pages, toc(books))[0])
    if spine_fallback:
        left = books.where(F.size("toc") == 0) if use_toc else books
        parts.append(ch.spine_chapters(spine(left)))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return ch.postprocessed(out, "book_id", min_words)
