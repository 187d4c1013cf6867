"""Office documents: blocks as Markdown, core properties, images. The container is read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import classify

SCHEMA = "doc_id string, content string, properties map<string,string>, images array<struct<idx:int,file_name:string,content:binary>>, warnings array<string>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _on(run, name: str) -> bool:
    mark = run.find(f"{_W}rPr/{_W}{name}")
    return mark is not None and mark.get(f"{_W}val", "true") not in ("0", "false", "off")


def _text(node) -> str:
    return "".join("\t" if n.tag == f"{_W}tab" else "\n" if n.tag in (f"{_W}br", f"{_W}cr") else n.text or "" for n in node.iter() if n.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))


def run_markdown(text: str, bold: bool, italic: bool) -> str:
    mark = "*" * (2 * bold + italic)
    return f"{mark}{text}{mark}" if text and mark else text


def link_markdown(text: str, url: str) -> str:
    return f"[{re.sub(r'([][])', r'\\\1', text)}]({re.sub(r'([()])', r'\\\1', url)})"


def cell_markdown(text: str) -> str:
    return text.strip().replace("\n", " ").replace("|", "\\|")


def heading_level(style: str) -> int | None:
    """1 to 6 for the styles Heading 1 to Heading 6."""
    m = re.fullmatch(r"heading ?([1-6])", style.lower())
    return int(m[1]) if m else None


def list_level(style: str, numbered: bool, ilvl: int | None) -> int:
    """Depth of a list item from 0; -1 for a paragraph that is none."""
    s = style.lower()
    if not numbered and ("no list" in s or not any(x in s for x in ("list", "bullet", "number"))):
        return -1
    if ilvl is not None:
        return ilvl
    m = re.search(r"(\d+)$", s)
    return max(0, int(m[1]) - 1) if m else 0


def _paragraph(p, styles: dict, rels: dict, formatting: bool, links: bool, lists: bool) -> str:
    ppr = p.find(f"{_W}pPr")
    ref = ppr.find(f"{_W}pStyle") if ppr is not None else None
    style = styles.get(ref.get(f"{_W}val"), ref.get(f"{_W}val") or "") if ref is not None else ""
    number = ppr.find(f"{_W}numPr") if ppr is not None else None
    ilvl = number.find(f"{_W}ilvl") if number is not None else None
    plain = _text(p).strip()
    if level := heading_level(style):
        return f"{'#' * level} {plain}" if plain else ""
    out = []
    for c in p:
        if c.tag == f"{_W}hyperlink":
            url = rels.get(c.get(f"{_R}id"), "")
            t = _text(c)
            out.append(link_markdown(t, url) if links and url and t else t)
        elif c.tag == f"{_W}r":
            # with links on, runs stay plain: bold and italic marks are for the mode without links
            out.append(run_markdown(_text(c), _on(c, "b"), _on(c, "i")) if formatting and not links else _text(c))
    line = "".join(out)
    if lists and (depth := list_level(style, number is not None, int(ilvl.get(f"{_W}val", 0)) if ilvl is not None else None)) >= 0:
        return f"{'  ' * depth}{'1.' if 'number' in style.lower() else '-'} {line.strip()}" if line.strip() else ""
    return line


def _table(t) -> str:
    rows = [[cell_markdown("\n".join(_text(p) for p in c.iter(f"{_W}p"))) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
    if not rows:
        return ""
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]])


def read_document(data: bytes, formatting: bool = True, links: bool = True, lists: bool = True, images: bool = True) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        xml = lambda n: ElementTree.fromstring(z.read(n)) if n in names else None
        body = xml("word/document.xml").find(f"{_W}body")
        styles = {s.get(f"{_W}styleId"): n.get(f"{_W}val", "") for s in (() if xml("word/styles.xml") is None else xml("word/styles.xml")) if s.tag == f"{_W}style" and (n := s.find(f"{_W}name")) is not None}
        rel = xml("word/_rels/document.xml.rels")
        rels = {r.get("Id"): r.get("Target", "") for r in (rel if rel is not None else ())}
        blocks = [_paragraph(b, styles, rels, formatting, links, lists) if b.tag == f"{_W}p" else _table(b) if b.tag == f"{_W}tbl" else "" for b in body]
        core = xml("docProps/core.xml")
        properties = {c.tag.rsplit("}", 1)[-1]: (c.text or "").strip() for c in (core if core is not None else ()) if (c.text or "").strip()}
        found = [(t if t.startswith("word/") else f"word/{t.lstrip('/')}") for t in rels.values() if "image" in t] if images else []
        pictures = [{"idx": i, "file_name": n, "content": z.read(n)} for i, n in enumerate(found, 1) if n in names]
    return {"content": "\n\n".join(b for b in blocks if b.strip()), "properties": properties, "images": pictures, "warnings": []}


def read_documents(files: DataFrame, id_col: str = "path", content_col: str = "content", **options) -> DataFrame:
    """(doc_id, content, properties, images, warnings) of every file; one that can't be read has a warning and nothing else."""

    kinds = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["content", "properties", "images", "warnings"]
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    row = read_document(data or b"", **options)
                except Exception as e:  # a bad file is a row with a warning
                    row = {"content": None, "properties": {}, "images": [], "warnings": [f"{type(e).__name__}: {e}"]}
                row["properties"] = list(row["properties"].items())
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.string()), *[pa.array([row[n]], kinds.field(n).type) for n in names]], names=["doc_id", *names])

    return files.select(F.col(id_col).cast("string"), content_col).mapInArrow(run, SCHEMA)


def metadata(read: DataFrame) -> DataFrame:
    """(doc_id, title, author, description, tags, publication_date, last_modified_by): subject before comments, created before modified."""
    p = lambda k: F.try_element_at("properties", F.lit(k))
    return read.select(
        "doc_id", p("title").alias("title"), p("creator").alias("author"), F.coalesce(p("subject"), p("description")).alias("description"), classify.tag_list(p("keywords"), "[;,]").alias("tags"),
        classify.iso_date(F.coalesce(p("created"), p("modified"))).alias("publication_date"), p("lastModifiedBy").alias("last_modified_by"),
    )
